"""Query blocks: pipelines gathered into the clauses of one SELECT.

Steps count by clause and not by place: FROM, joins, WHERE, GROUP BY, HAVING, SELECT, DISTINCT, set operations, ORDER BY,
OFFSET, LIMIT. Filters are joined by AND; grouping and sort keys add up; of select, having, limit and offset the last
wins. A pipeline on top of a let or of a pipeline in parentheses goes on in the same block; pipelines in joins, set
operations and predicates are blocks of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from millrace.lang import tree as t
from millrace.lang.errors import QueryError, at

JOINS = {"join": "inner", "left_join": "left", "right_join": "right", "full_join": "full", "cross_join": "cross"}
SETS = {"union": "UNION", "union_all": "UNION ALL", "intersect": "INTERSECT", "except": "EXCEPT"}


@dataclass(frozen=True)
class Source:
    """A table (name), a block, or a row generator, under an alias."""

    alias: str
    table: str | None = None
    block: Block | None = None
    call: t.Call | None = None


@dataclass(frozen=True)
class Join:
    how: str
    source: Source
    on: t.Node | None


@dataclass(frozen=True)
class Block:
    source: Source
    joins: tuple[Join, ...] = ()
    where: tuple[t.Node, ...] = ()
    group_by: tuple[t.Node, ...] = ()
    having: t.Node | None = None
    select: tuple[t.Node, ...] = ()
    distinct: bool = False
    sets: tuple[tuple[str, Block], ...] = ()
    order_by: tuple[t.Sort, ...] = ()
    limit: t.Node | None = None
    offset: t.Node | None = None
    insert: str | None = None

    def sources(self) -> list[Source]:
        return [self.source, *(j.source for j in self.joins)]

    def tables(self) -> set[str]:
        """Every table that the block or a block in it reads."""
        found: set[str] = set()
        for source in self.sources():
            found |= {source.table} if source.table else source.block.tables() if source.block else set()
        for _, other in self.sets:
            found |= other.tables()
        for node in [*self.where, *self.select, *self.group_by, *self.order_by, *(j.on for j in self.joins), self.having]:
            for rows in inner_blocks(node):
                found |= rows.tables()
        return found


@dataclass(frozen=True)
class Rows(t.Node):
    """A block in the place of a nested pipeline."""

    block: Block = field(compare=False)


def rewrite(node: t.Node, f: Callable[[t.Node], t.Node | None]) -> t.Node:
    """The tree with every node that f gives another for replaced, from the top down."""
    if (made := f(node)) is not None:
        return made
    changes = {}
    for name in getattr(node, "__dataclass_fields__", {}):
        old = getattr(node, name)
        new = _rewritten(old, f)
        if new is not old:
            changes[name] = new
    return replace(node, **changes) if changes else node


def _rewritten(value, f):
    if isinstance(value, t.Node):
        return rewrite(value, f)
    if isinstance(value, tuple):
        new = tuple(_rewritten(x, f) for x in value)
        return value if all(a is b for a, b in zip(value, new, strict=True)) else new
    return value


def inner_blocks(node: t.Node | None) -> list[Block]:
    found: list[Block] = []

    def look(x: t.Node) -> None:
        if isinstance(x, Rows):
            found.append(x.block)

    if node is not None:
        rewrite(node, look)
    return found


class Builder:
    """Turns a program into a block; lambda variables are resolved here, so that blocks hold plain names."""

    def __init__(self, program: t.Program):
        self.text, self.lets = program.text, dict(program.lets)

    def fail(self, message: str, place: tuple[int, int]) -> QueryError:
        return at(message, self.text, *place) if self.text else QueryError(message)

    def block(self, pipeline: t.Node, scope: frozenset[str] = frozenset()) -> Block:
        if not isinstance(pipeline, t.Pipeline):
            return self.start(pipeline, scope)
        made = self.start(pipeline.source, scope)
        for step in pipeline.steps:
            made = self.step(made, step, scope)
        return made

    def start(self, node: t.Node, scope: frozenset[str]) -> Block:
        if isinstance(node, t.Pipeline):
            return self.block(node, scope)
        if isinstance(node, t.Name):
            if len(node.parts) == 1 and node.parts[0] in self.lets:
                return self.block(self.lets[node.parts[0]], scope)
            return Block(Source(node.parts[-1], table=".".join(node.parts)))
        if isinstance(node, t.Call):
            return Block(Source(node.name.lower(), call=node))
        raise QueryError("A pipeline starts with a table, a let, a row generator or a pipeline")

    def source(self, node: t.Node, scope: frozenset[str]) -> Source:
        """What a join joins: a table, a let or a pipeline, under its own name unless ``as`` gives another."""
        alias = None
        if isinstance(node, t.Aliased):
            node, alias = node.of, node.alias
        if isinstance(node, t.Name) and not (len(node.parts) == 1 and node.parts[0] in self.lets):
            return Source(alias or node.parts[-1], table=".".join(node.parts))
        inner = self.block(node, scope)
        return Source(alias or (node.parts[0] if isinstance(node, t.Name) else inner.source.alias), block=inner)

    def expression(self, node: t.Node, scope: frozenset[str]) -> t.Node:
        if isinstance(node, t.Lambda):
            return self.expression(node.body, scope | {x.lower() for x in node.names})

        def look(x: t.Node) -> t.Node | None:
            if isinstance(x, t.Lambda):
                return self.expression(x, scope)
            if isinstance(x, t.Name) and len(x.parts) > 1 and x.parts[0].lower() in scope:
                return t.Name(x.parts[1:], x.place)
            if isinstance(x, t.AmongRows):
                return t.AmongRows(self.expression(x.of, scope), Rows(self.block(x.rows, scope)))
            if isinstance(x, t.Among) and len(x.items) == 1 and isinstance(x.items[0], t.Name) and x.items[0].parts[0] in self.lets and len(x.items[0].parts) == 1:
                return t.AmongRows(self.expression(x.of, scope), Rows(self.block(x.items[0], scope)))
            if isinstance(x, t.Exists):
                return t.Exists(Rows(self.block(x.rows, scope)))
            if isinstance(x, t.Pipeline):
                return Rows(self.block(x, scope))
            return None

        return rewrite(node, look)

    def step(self, b: Block, step: t.Step, scope: frozenset[str]) -> Block:
        name, args = step.name, step.args
        one = lambda what: args[0] if args else (_ for _ in ()).throw(self.fail(f"{name} needs {what}", step.place))
        ready = lambda xs: tuple(self.expression(x, scope) for x in xs)
        if name == "filter":
            if not args:
                return b
            test = self.expression(args[0], scope)
            if isinstance(test, t.Literal | t.Star | t.Sort | t.Named) and not (isinstance(test, t.Literal) and isinstance(test.value, bool)):
                raise self.fail("filter needs a condition", step.place)
            return replace(b, where=(*b.where, test))
        if name in ("select", "select_distinct", "map"):
            items = args[0].body if name == "map" and args and isinstance(args[0], t.Lambda) and len(args) == 1 else None
            return replace(b, select=(self.expression(args[0], scope),) if items is not None else ready(args), distinct=name == "select_distinct")
        if name == "distinct":
            return replace(b, distinct=True)
        if name in JOINS:
            on = next((x.value for x in args if isinstance(x, t.Named) and x.name == "on"), None)
            if on is None and name != "cross_join":
                raise self.fail(f"{name} needs on = a condition", step.place)
            source = self.source(one("what to join"), scope)
            if source.alias.lower() in {s.alias.lower() for s in b.sources()}:
                raise self.fail(f"{source.alias} is joined to itself; name the second one: {name}({source.alias} as other, on = ...)", step.place)
            return replace(b, joins=(*b.joins, Join(JOINS[name], source, None if on is None else self.expression(on, scope))))
        if name == "group_by":
            return replace(b, group_by=(*b.group_by, *ready(args)))
        if name == "having":
            return replace(b, having=self.expression(one("a condition"), scope))
        if name == "order_by":
            return replace(b, order_by=(*b.order_by, *(x if isinstance(x, t.Sort) else t.Sort(x) for x in ready(args))))
        if name == "limit":
            return replace(b, limit=args[0] if args else t.Literal(10))
        if name == "offset":
            return replace(b, offset=args[0] if args else t.Literal(0))
        if name in SETS:
            return replace(b, sets=(*b.sets, (SETS[name], self.block(one("the other rows"), scope))))
        if name == "insert":
            target = one("a table")
            if not isinstance(target, t.Name):
                raise self.fail("insert needs a table", step.place)
            return replace(b, insert=".".join(target.parts))
        raise self.fail(f"Unknown function: {name}", step.place)


def build(program: t.Program) -> Block:
    return Builder(program).block(program.result)
