"""Blocks as SQL text, for Spark (what the engine runs) and for the dialects of three databases."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from millrace.functions.scalar import RENDERED
from millrace.lang import tree as t
from millrace.lang.errors import QueryError
from millrace.plans.block import Block, Rows, Source, rewrite

DIALECTS = ("spark", "postgres", "sqlite", "sqlserver")
_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_BINDING = {"*": 3, "/": 3, "%": 3, "+": 2, "-": 2, "||": 2}


def _collected(node: t.Node, test: Callable[[t.Node], bool]) -> list[t.Node]:
    found: list[t.Node] = []

    def look(x: t.Node) -> t.Node | None:
        if test(x):
            found.append(x)
        return x if isinstance(x, Rows) else None

    rewrite(node, look)
    return found


def _has_window(node: t.Node) -> bool:
    return bool(_collected(node, lambda x: isinstance(x, t.Call) and x.over is not None))


def _names(node: t.Node) -> list[t.Node]:
    return _collected(node, lambda x: isinstance(x, t.Name))


class Renderer:
    def __init__(self, dialect: str = "spark", columns: Callable[[str], list[str]] | None = None, truncate: Callable[[t.Node, Block], bool] | None = None):
        if dialect not in DIALECTS:
            raise QueryError(f"Unknown dialect: {dialect}")
        self.dialect, self.columns, self.truncate = dialect, columns, truncate
        self.here: list[Block] = []

    # Names and values.
    def name(self, text: str) -> str:
        if self.dialect == "spark":
            return "`" + text.replace("`", "``") + "`"
        if _PLAIN.fullmatch(text):
            return text
        return f"[{text.replace(']', ']]')}]" if self.dialect == "sqlserver" else '"' + text.replace('"', '""') + '"'

    def dotted(self, text: str) -> str:
        return ".".join(map(self.name, text.split(".")))

    def literal(self, x: t.Literal) -> str:
        v = x.value
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return {"spark": ("FALSE", "TRUE"), "postgres": ("FALSE", "TRUE")}.get(self.dialect, ("0", "1"))[v]
        if isinstance(v, int | float):
            return x.text or (repr(v) + "D" if isinstance(v, float) and self.dialect == "spark" else repr(v))
        if self.dialect == "spark":
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + "'"
        return "'" + v.replace("'", "''") + "'"

    # Expressions.
    def expr(self, x: t.Node, binding: int = 0) -> str:
        if isinstance(x, t.Literal):
            return self.literal(x)
        if isinstance(x, t.Param):
            return (":" if self.dialect == "spark" else "@") + x.name
        if isinstance(x, t.Name):
            return ".".join(map(self.name, x.parts))
        if isinstance(x, t.Star):
            return f"{self.dotted(x.table)}.*" if x.table else "*"
        if isinstance(x, t.Aliased):
            return f"{self.expr(x.of)} AS {self.name(x.alias)}"
        if isinstance(x, t.Sort):
            return self.expr(x.of) + (" DESC" if x.descending else "")
        if isinstance(x, t.Call):
            return self.call(x)
        if isinstance(x, t.Binary):
            return self.binary(x, binding)
        if isinstance(x, t.Negative):
            return f"(- {self.expr(x.of, 4)})"
        if isinstance(x, t.Junction):
            return "(" + f" {x.op.upper()} ".join(self.expr(p) for p in x.parts) + ")"
        if isinstance(x, t.Not):
            return f"(NOT {self.expr(x.of)})"
        if isinstance(x, t.IsNull):
            return f"{self.expr(x.of, 4)} IS {'NOT ' * x.negated}NULL"
        if isinstance(x, t.Among):
            return f"{self.expr(x.of, 4)} IN ({', '.join(self.expr(i) for i in x.items)})"
        if isinstance(x, t.AmongRows):
            return f"{self.expr(x.of, 4)} IN ({self.block(x.rows.block)})"
        if isinstance(x, t.Exists):
            return f"EXISTS ({self.block(x.rows.block)})"
        if isinstance(x, t.Between):
            return f"({self.expr(x.of, 4)} BETWEEN {self.expr(x.low, 1)} AND {self.expr(x.high, 1)})"
        if isinstance(x, t.Case):
            whens = " ".join(f"WHEN {self.expr(a)} THEN {self.expr(b)}" for a, b in x.whens)
            return f"CASE {whens}{f' ELSE {self.expr(x.otherwise)}' if x.otherwise is not None else ''} END"
        if isinstance(x, Rows):
            return f"({self.block(x.block)})"
        raise QueryError(f"{type(x).__name__} can't stand in an expression")

    def binary(self, x: t.Binary, binding: int) -> str:
        own = _BINDING.get(x.op, 1)
        op = x.op.upper() if x.op == "like" else "+" if x.op == "||" and self.dialect == "sqlserver" else x.op
        if op == "/" and self.dialect == "spark" and self.truncate and self.here and self.truncate(x, self.here[-1]):
            op = "DIV"
        text = f"{self.expr(x.left, own)} {op} {self.expr(x.right, own + 1)}"
        return f"({text})" if own < binding else text

    def call(self, x: t.Call) -> str:
        if not _PLAIN.fullmatch(x.name):
            raise QueryError(f"Unknown function: {x.name}")
        rendered = RENDERED.get(self.dialect, {}).get(x.name.lower())
        args = [self.expr(a.of if isinstance(a, t.Aliased) else a) for a in x.args]
        text = rendered(args) if rendered and not x.distinct else f"{x.name.upper() if self.dialect != 'spark' else self.name(x.name) if x.name.lower() not in _BARE else x.name}({'DISTINCT ' * x.distinct}{', '.join(args)})"
        if x.over is None:
            return text
        partition = f"PARTITION BY {', '.join(self.expr(p) for p in x.over.partition)}" if x.over.partition else ""
        order = f"ORDER BY {', '.join(self.expr(s) for s in x.over.order)}" if x.over.order else ""
        return f"{text} OVER ({' '.join(filter(None, (partition, order)))})"

    # Blocks.
    def source(self, s: Source) -> str:
        if s.block:
            return f"({self.block(s.block)}) {'AS ' * (self.dialect == 'spark')}{self.name(s.alias)}"
        if s.call:
            return f"{s.call.name.lower()}({', '.join(self.expr(a) for a in s.call.args)}) AS {self.name(s.alias)}"
        text = self.dotted(s.table or "")
        return f"{text} AS {self.name(s.alias)}" if self.dialect == "spark" or s.alias != (s.table or "").split(".")[-1] else text

    def known(self, b: Block) -> set[str] | None:
        """Lower-cased columns of the block's own sources; None where one can't be told."""
        found: set[str] = set()
        for s in b.sources():
            if not s.table or not self.columns:
                return None
            found |= {c.lower() for c in self.columns(s.table)}
        return found

    def later(self, b: Block) -> list[t.Node]:
        """Conditions on aliases of window functions, which hold for the rows that the block gives."""
        windows = {s.alias.lower() for s in b.select if isinstance(s, t.Aliased) and _has_window(s.of)}
        known = self.known(b) if windows else None
        found = []
        for w in b.where if windows else ():
            names = _names(w)
            if any(n.parts[-1].lower() in windows and (known is None or n.parts[-1].lower() not in known) for n in names):
                found.append(w)
        return found

    def where(self, b: Block) -> list[str]:
        """Conditions; a name that is only an alias of the select list stands for what it names."""
        aliases = {s.alias.lower(): s.of for s in b.select if isinstance(s, t.Aliased)}
        known = self.known(b) if aliases else None
        here = {s.alias.lower() for s in b.sources()}

        def look(x: t.Node) -> t.Node | None:
            if isinstance(x, t.Name) and known is not None and (len(x.parts) == 1 or x.parts[0].lower() in here):
                last = x.parts[-1].lower()
                if last in aliases and last not in known:
                    return aliases[last]
            return x if isinstance(x, Rows) else None

        return [self.expr(rewrite(w, look)) for w in b.where]

    def core(self, b: Block) -> str:
        if later := self.later(b):
            # Window functions come after WHERE, so what tests them goes around the block.
            inner = self.core(replace(b, where=tuple(w for w in b.where if w not in later)))
            bare = lambda n: t.Name(n.parts[-1:], n.place) if isinstance(n, t.Name) else n if isinstance(n, Rows) else None
            return f"SELECT * FROM ({inner}) {'AS ' * (self.dialect == 'spark')}{self.name(b.source.alias)} WHERE {' AND '.join(self.expr(rewrite(w, bare)) for w in later)}"
        self.here.append(b)
        top = f"TOP {self.expr(b.limit)} " if self.dialect == "sqlserver" and b.limit is not None and b.offset is None and not b.sets else ""
        parts = [f"SELECT {'DISTINCT ' * b.distinct}{top}{', '.join(self.expr(s) for s in b.select) or '*'}", f"FROM {self.source(b.source)}"]
        for j in b.joins:
            parts.append(f"{'FULL OUTER' if j.how == 'full' else j.how.upper()} JOIN {self.source(j.source)}{f' ON {self.expr(j.on)}' if j.on is not None else ''}")
        if b.where:
            parts.append("WHERE " + " AND ".join(self.where(b)))
        if b.group_by:
            parts.append("GROUP BY " + ", ".join(self.expr(g) for g in b.group_by))
        if b.having is not None:
            parts.append("HAVING " + self.expr(b.having))
        self.here.pop()
        return " ".join(parts)

    def block(self, b: Block) -> str:
        text = self.core(b)
        for how, other in b.sets:
            inner = self.block(other)
            if other.order_by or other.limit is not None or other.offset is not None or other.sets:
                inner = f"({inner})" if self.dialect != "sqlite" else f"SELECT * FROM ({inner})"
            # INTERSECT would bind tighter than what stands before it; sets go from left to right.
            text = f"{f'({text})' if how == 'INTERSECT' and b.sets[0][1] is not other else text} {how} {inner}"
        if b.order_by:
            text += " ORDER BY " + ", ".join(self.expr(s) for s in b.order_by)
        if self.dialect == "sqlserver":
            if b.offset is not None or (b.limit is not None and b.sets):
                text += ("" if b.order_by else " ORDER BY (SELECT NULL)") + f" OFFSET {self.expr(b.offset or t.Literal(0))} ROWS"
                text += f" FETCH NEXT {self.expr(b.limit)} ROWS ONLY" if b.limit is not None else ""
            return text
        if b.limit is not None:
            text += f" LIMIT {self.expr(b.limit)}"
        elif b.offset is not None and self.dialect == "sqlite":
            text += " LIMIT -1"
        if b.offset is not None:
            text += f" OFFSET {self.expr(b.offset)}"
        return text

    def statement(self, b: Block) -> str:
        text = self.block(b)
        if not b.insert:
            return text
        return f"INSERT INTO {self.dotted(b.insert)}{self.insert_columns(b)} {text}"

    def insert_columns(self, b: Block) -> str:
        """The columns that the select list names, where it names them all."""
        names = [s.alias if isinstance(s, t.Aliased) else s.parts[-1] if isinstance(s, t.Name) else None for s in b.select]
        return f" ({', '.join(self.name(n) for n in names if n)})" if names and all(names) else ""


#: Functions whose name Spark's grammar treats specially, so that it can't be quoted.
_BARE = frozenset("extract cast position overlay trim current_date count".split())
