"""Recursive descent over the tokens, one function for each level of binding."""

from __future__ import annotations

from millrace.lang import tree as t
from millrace.lang.errors import QueryError, at
from millrace.lang.lexer import KEYWORDS, Token, tokens, unquoted

COMPARISONS = ("=", "!=", "<>", "<", ">", "<=", ">=")


def parse(text: str) -> t.Program:
    """The program of a text; its last statement is the result. Raises QueryError with the place of the fault."""
    if not text or not text.strip():
        raise QueryError("The query is empty", 1, 0, 0, 0)
    return _Parser(text).program()


class _Parser:
    def __init__(self, text: str):
        self.text, self.found, self.i = text, tokens(text), 0

    # Reading tokens.
    @property
    def now(self) -> Token:
        return self.found[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.found[min(self.i + n, len(self.found) - 1)]

    def take(self) -> Token:
        token = self.now
        self.i += token.kind != "end"
        return token

    def fail(self, message: str, token: Token | None = None) -> QueryError:
        token = token or self.now
        return at(message, self.text, token.start, max(token.stop, token.start + 1))

    def op(self, text: str) -> Token:
        if not self.now.is_op(text):
            raise self.fail(f"Expected {text!r} but found {self.now.text or 'the end'!r}")
        return self.take()

    def word(self, *names: str) -> Token:
        if not self.now.is_word(*names):
            raise self.fail(f"Expected {' or '.join(names)} but found {self.now.text or 'the end'!r}")
        return self.take()

    def ident(self) -> Token:
        if self.now.kind != "word" or self.now.text.lower() in KEYWORDS - {"by", "with", "order"}:
            raise self.fail(f"Expected a name but found {self.now.text or 'the end'!r}")
        return self.take()

    # Statements.
    def program(self) -> t.Program:
        lets: dict[str, t.Pipeline] = {}
        result, last = None, None
        while self.now.kind != "end":
            if self.now.kind == "word" and self.now.text == "let" and self.ahead().kind == "word":
                self.take()
                name = self.ident()
                self.op("=")
                lets[name.text] = result = self.pipeline()
                self.no_ring(lets, name)
            elif self.now.is_word("with") and self.ahead(2).is_word("as"):
                self.take()
                while True:
                    name = self.ident()
                    self.word("as")
                    self.op("(")
                    lets[name.text] = self.pipeline()
                    self.op(")")
                    self.no_ring(lets, name)
                    if not self.now.is_op(","):
                        break
                    self.take()
            else:
                if last is not None and self.now.start == last:
                    raise self.fail(f"Unexpected {self.now.text!r}")
                begin = self.now
                result = self.pipeline()
                last = self.now.start
                # Statements need no separator, but a bare name followed by an operator's name lacks its pipe.
                if self.now.kind == "word" and not result.steps and self.ahead().is_op("(") and self.now.text in OPERATORS:
                    raise self.fail(f"Missing '|>' between {begin.text!r} and {self.now.text!r}")
                if self.now.kind not in ("word", "end") and not self.now.is_op("("):
                    raise self.fail(f"Unexpected {self.now.text!r}")
                last = None
        if result is None:
            raise QueryError("The query has no statement", 1, 0, 0, 0)
        return t.Program(tuple(lets.items()), result, self.text)

    def no_ring(self, lets: dict[str, t.Pipeline], name: Token) -> None:
        """A let that reaches itself through its heads never ends."""
        seen, at_ = set(), name.text
        while at_ in lets and at_ not in seen:
            seen.add(at_)
            source = lets[at_].source
            while isinstance(source, t.Pipeline):
                source = source.source
            at_ = source.parts[0] if isinstance(source, t.Name) and len(source.parts) == 1 else ""
        if at_ and at_ in seen and at_ in lets:
            raise self.fail(f"Circular reference: {at_}", name)

    def pipeline(self) -> t.Pipeline:
        made = self.piped()
        return made if isinstance(made, t.Pipeline) else t.Pipeline(self.head(made))

    def head(self, node: t.Node) -> t.Node:
        if isinstance(node, t.Name | t.Call | t.Pipeline):
            return node
        raise self.fail("A pipeline starts with a table, a let, a row generator or a pipeline")

    def piped(self) -> t.Node:
        """An expression, or a pipeline if steps follow it."""
        first = self.logical()
        if not self.now.is_op("|>"):
            return first
        source, steps = self.head(first), []
        while self.now.is_op("|>"):
            self.take()
            name = self.now
            if name.kind != "word":
                raise self.fail("Expected an operator after '|>'")
            self.take()
            args: tuple[t.Node, ...] = ()
            if self.now.is_op("("):
                args = self.arguments()
            steps.append(t.Step(name.text, args, (name.start, name.stop)))
        return t.Pipeline(source, tuple(steps))

    # Arguments.
    def arguments(self) -> tuple[t.Node, ...]:
        self.op("(")
        found: list[t.Node] = []
        while not self.now.is_op(")"):
            if found:
                self.op(",")
            found.append(self.argument())
        self.op(")")
        return tuple(found)

    def argument(self) -> t.Node:
        if self.now.is_word("on") and self.ahead().is_op("="):
            self.take()
            self.take()
            return t.Named("on", self.logical())
        made = self.piped()
        if self.now.is_word("as"):
            self.take()
            return t.Aliased(made, self.ident().text)
        if self.now.is_word("asc", "desc"):
            return t.Sort(made, self.take().is_word("desc"))
        return made

    # Expressions, from the loosest binding to the tightest.
    def logical(self) -> t.Node:
        parts = [self.conjunction()]
        while self.now.is_word("or"):
            self.take()
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else t.Junction("or", tuple(parts))

    def conjunction(self) -> t.Node:
        parts = [self.negation()]
        while self.now.is_word("and"):
            self.take()
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else t.Junction("and", tuple(parts))

    def negation(self) -> t.Node:
        if self.now.is_word("not"):
            self.take()
            return t.Not(self.negation())
        return self.comparison()

    def comparison(self) -> t.Node:
        left = self.sum()
        if self.now.is_op(*COMPARISONS):
            op = self.take().text
            return t.Binary("!=" if op == "<>" else op, left, self.sum())
        if self.now.is_word("is"):
            self.take()
            negated = self.now.is_word("not") and bool(self.take())
            self.word("null")
            return t.IsNull(left, negated)
        negated = self.now.is_word("not") and self.ahead().is_word("in", "like", "between") and bool(self.take())
        made: t.Node
        if self.now.is_word("like"):
            self.take()
            made = t.Binary("like", left, self.sum())
        elif self.now.is_word("between"):
            self.take()
            low = self.sum()
            self.word("and")
            made = t.Between(left, low, self.sum())
        elif self.now.is_word("in"):
            self.take()
            self.op("(")
            items = [self.piped()]
            while self.now.is_op(","):
                self.take()
                items.append(self.logical())
            self.op(")")
            made = t.AmongRows(left, items[0]) if len(items) == 1 and isinstance(items[0], t.Pipeline) else t.Among(left, tuple(items))
        else:
            return left
        return t.Not(made) if negated else made

    def sum(self) -> t.Node:
        left = self.product()
        while self.now.is_op("+", "-", "||"):
            left = t.Binary(self.take().text, left, self.product())
        return left

    def product(self) -> t.Node:
        left = self.unary()
        while self.now.is_op("*", "/", "%"):
            left = t.Binary(self.take().text, left, self.unary())
        return left

    def unary(self) -> t.Node:
        if self.now.is_op("-"):
            self.take()
            of = self.unary()
            return t.Literal(-of.value, f"-{of.text}" if of.text else "") if isinstance(of, t.Literal) and isinstance(of.value, int | float) else t.Negative(of)
        return self.primary()

    def primary(self) -> t.Node:
        token = self.now
        if token.is_op("("):
            self.take()
            inner = self.piped()
            self.op(")")
            return inner
        if token.is_op("*"):
            self.take()
            return t.Star()
        if token.kind in ("string", "int", "decimal", "param"):
            self.take()
            return {"string": lambda: t.Literal(unquoted(token.text)), "int": lambda: t.Literal(int(token.text)), "decimal": lambda: t.Literal(float(token.text), token.text), "param": lambda: t.Param(token.text[1:])}[token.kind]()
        if token.kind != "word":
            raise self.fail(f"Unexpected {token.text or 'end of the query'!r}")
        if token.text == "fn" and self.ahead().is_op("("):
            return self.function()
        if token.is_word("case"):
            return self.case()
        if token.is_word("exists") and self.ahead().is_op("("):
            self.take()
            self.op("(")
            rows = self.pipeline()
            self.op(")")
            return t.Exists(rows)
        if token.is_word("null"):
            self.take()
            return t.Literal(None)
        if token.is_word("true", "false") and not self.ahead().is_op("(", "."):
            self.take()
            return t.Literal(token.is_word("true"))
        self.ident()
        if self.now.is_op("("):
            return self.call(token)
        parts = [token.text]
        while self.now.is_op("."):
            self.take()
            if self.now.is_op("*"):
                self.take()
                return t.Star(".".join(parts))
            if self.now.kind != "word":
                raise self.fail("Expected a name after '.'")
            parts.append(self.take().text)
        if token.is_word("current_date") and len(parts) == 1:
            return t.Call("current_date", place=(token.start, token.stop))
        return t.Name(tuple(parts), (token.start, self.found[self.i - 1].stop))

    def call(self, name: Token) -> t.Node:
        self.op("(")
        distinct = self.now.is_word("distinct") and bool(self.take())
        args: list[t.Node] = []
        while not self.now.is_op(")"):
            if args:
                self.op(",")
            args.append(self.argument())
        self.op(")")
        over = None
        if self.now.is_word("over"):
            self.take()
            self.op("(")
            partition: list[t.Node] = []
            order: list[t.Sort] = []
            if self.now.is_word("partition"):
                self.take()
                self.word("by")
                partition.append(self.sum())
                while self.now.is_op(","):
                    self.take()
                    partition.append(self.sum())
            if self.now.is_word("order"):
                self.take()
                self.word("by")
                while True:
                    of = self.sum()
                    order.append(t.Sort(of, self.now.is_word("asc", "desc") and self.take().is_word("desc")))
                    if not self.now.is_op(","):
                        break
                    self.take()
            self.op(")")
            over = t.Over(tuple(partition), tuple(order))
        return t.Call(name.text, tuple(args), distinct, over, (name.start, name.stop))

    def function(self) -> t.Node:
        self.take()
        self.op("(")
        names = [self.ident().text]
        while self.now.is_op(","):
            self.take()
            names.append(self.ident().text)
        self.op(")")
        self.op("=>")
        return t.Lambda(tuple(names), self.logical())

    def case(self) -> t.Node:
        self.take()
        whens = []
        while self.now.is_word("when"):
            self.take()
            test = self.logical()
            self.word("then")
            whens.append((test, self.logical()))
        if not whens:
            raise self.fail("A case needs a when")
        otherwise = None
        if self.now.is_word("else"):
            self.take()
            otherwise = self.logical()
        self.word("end")
        return t.Case(tuple(whens), otherwise)


OPERATORS = frozenset(
    "filter select select_distinct distinct map join left_join right_join full_join cross_join group_by having order_by limit offset union union_all intersect except insert".split()
)
