"""Advice on query texts that parse: unknown functions, missing space around pipes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from millrace.functions.scalar import KNOWN
from millrace.lang import tree as t
from millrace.lang.errors import QueryError
from millrace.lang.parser import OPERATORS, parse


@dataclass(frozen=True)
class Advice:
    level: str  # error, warning, info
    message: str
    line: int
    column: int


def lint(text: str, known: frozenset[str] = frozenset()) -> list[Advice]:
    try:
        program = parse(text)
    except QueryError as e:
        return [Advice("error", e.message, e.line or 1, e.column or 0)]
    from millrace.plans.block import rewrite

    found: list[Advice] = []

    def tell(level: str, message: str, start: int) -> None:
        found.append(Advice(level, message, text.count("\n", 0, start) + 1, start - (text.rfind("\n", 0, start) + 1)))

    def look(n: t.Node) -> None:
        if isinstance(n, t.Call) and n.name.lower() not in KNOWN | known and n.name.lower() != "range":
            tell("info", f"Unknown function: {n.name}", n.place[0])
        if isinstance(n, t.Step) and n.name not in OPERATORS:
            tell("error", f"Unknown operator: {n.name}", n.place[0])

    for _, pipeline in program.lets:
        rewrite(pipeline, look)
    if not program.lets or program.lets[-1][1] is not program.result:
        rewrite(program.result, look)
    bare = re.sub(r"'(?:[^'\\]|\\.)*'|--[^\r\n]*", lambda m: " " * len(m[0]), text)
    for m in re.finditer(r"\S\|>|\|>\S", bare):
        tell("warning", "Put space around '|>'", m.start())
    return sorted(found, key=lambda a: (a.line, a.column))
