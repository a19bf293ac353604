"""Tokens of the pipeline language."""

from __future__ import annotations

import re
from dataclasses import dataclass

from millrace.lang.errors import at

KEYWORDS = frozenset("asc desc and or distinct exists null is not in as case when then else end with over partition order by on like between".split())

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\r\n]*)
    |(?P<string>'(?:[^'\\]|\\.)*')
    |(?P<decimal>[0-9]+\.[0-9]+)
    |(?P<int>[0-9]+)
    |(?P<param>@[A-Za-z_][A-Za-z0-9_]*)
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op>\|>|\|\||=>|!=|<>|<=|>=|[=<>+\-*/%(),.])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str  # string, decimal, int, param, word, op, end
    text: str
    start: int
    stop: int

    def is_word(self, *names: str) -> bool:
        return self.kind == "word" and self.text.lower() in names

    def is_op(self, *ops: str) -> bool:
        return self.kind == "op" and self.text in ops


def tokens(text: str) -> list[Token]:
    found, i = [], 0
    while i < len(text):
        m = _TOKEN.match(text, i)
        if not m:
            what = "Unterminated string" if text[i] == "'" else f"Unexpected character {text[i]!r}"
            raise at(what, text, i, i + 1)
        if m.lastgroup == "int" and (bad := re.match(r"[0-9]+[A-Za-z_]\w*", text[i:])):
            raise at(f"Identifier can't start with a digit: {bad[0]}", text, i, i + len(bad[0]))
        if m.lastgroup != "space":
            found.append(Token(m.lastgroup or "", m[0], *m.span()))
        i = m.end()
    return [*found, Token("end", "", len(text), len(text))]


def unquoted(literal: str) -> str:
    """The value of a quoted string: a backslash takes the next character as it is, but n, t and r are control characters."""
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), literal[1:-1], flags=re.S)
