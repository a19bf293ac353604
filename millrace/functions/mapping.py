"""The scalar expressions of change mappings, compiled to columns over a JSON row image.

Forms: ``Col``, ``Col |> f() |> g('x')`` and ``f(Col, 'x')``. All arguments are texts, null counts as empty. In the pipe
form the value comes first and further arguments are literal texts; in the call form a bare argument is a column and a
nested call is evaluated. A function that isn't known returns its first argument.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_CALL = re.compile(r"\s*(\w+)\s*\((.*)\)\s*", re.S)
# Fixed values: .NET date letters and Spark's.
_DATE_LETTERS = {"yyyy": "yyyy", "yy": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "dddd": "EEEE", "ddd": "EEE", "dd": "dd", "d": "d", "HH": "HH", "H": "H", "hh": "hh", "h": "h", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "fff": "SSS", "ff": "SS", "f": "S", "tt": "a", "zzz": "xxx", "K": "XXX"}


def image(payload: Column) -> Column:
    """A JSON row image as a map of texts; nested values are their JSON text."""
    return F.from_json(payload, "map<string,string>")


def value(fields: Column, name: str) -> Column:
    """A field by its exact name, else by its name in any case; null where there is none."""
    loose = F.filter(F.map_entries(fields), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(F.try_element_at(fields, F.lit(name)), F.get(loose, F.lit(0))["value"])


def date_pattern(net: str) -> str:
    out, i = "", 0
    while i < len(net):
        if net[i] in "'\"":
            end = net.find(net[i], i + 1)
            end = len(net) if end < 0 else end
            out += "'" + net[i + 1 : end].replace("'", "''") + "'"
            i = end + 1
            continue
        run = re.match(r"([A-Za-z])\1*", net[i:])
        if run:
            out += _DATE_LETTERS.get(run[0]) or (f"'{run[0]}'" if run[1] not in "yMdHhmsf" else run[0].replace("f", "S"))
            i += len(run[0])
        else:
            out += net[i]
            i += 1
    return out


def _number(x: Column) -> Column:
    return F.when(F.trim(x).rlike(r"^[+-]?[0-9]{1,9}$"), F.trim(x).cast("int"))


def _substring(a: list[Column]) -> Column:
    if len(a) < 2:
        return F.lit(None).cast("string")
    first = _number(a[1])
    start = F.when(first.isNotNull(), F.greatest(first - 1, F.lit(0)))
    size = _number(a[2]) if len(a) > 2 else F.length(a[0])
    good = (a[0] != "") & start.isNotNull() & (size.isNotNull() if len(a) > 2 else F.lit(True))
    return F.when(good, F.when(start >= F.length(a[0]), F.lit("")).otherwise(F.substr(a[0], start + 1, F.greatest(size, F.lit(0)))))


def _side(f, a: list[Column]) -> Column:
    if len(a) < 2:
        return a[0]
    n = _number(a[1])
    return F.when(n.isNull() | (n < 0), a[0]).otherwise(f(a[0], n))


def _date(a: list[Column], pattern: str | None) -> Column:
    if pattern is None:
        return a[0]
    # Session-independent: an offset in the text counts, none means UTC.
    at = F.try_to_timestamp(F.concat(a[0], F.when(a[0].rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.lit("")).when(a[0].rlike(r"\d\d:\d\d"), F.lit("Z")).otherwise(F.lit("T00:00:00Z"))))
    utc = F.to_utc_timestamp(at, F.current_timezone())
    return F.coalesce(F.date_format(utc, date_pattern(pattern)), a[0])


def _apply(name: str, args: list[Column], texts: list[str | None]) -> Column:
    """texts: the arguments that are literal."""
    a = [F.coalesce(x, F.lit("")) for x in args]
    if not a:
        return F.lit("") if name == "concat" else F.lit(None).cast("string")
    blank = r"^[\s\u00a0\u2000-\u200a\u3000]+|[\s\u00a0\u2000-\u200a\u3000]+$"
    if name in ("upper", "lower"):
        return getattr(F, name)(a[0])
    if name == "length":  # in UTF-16 units, as the mappings' own runtime counts
        return F.char_length(a[0]) + F.regexp_count(a[0], F.lit("[\\x{10000}-\\x{10FFFF}]"))
    if name == "trim":
        return F.regexp_replace(a[0], blank, "")
    if name == "concat":
        return F.concat_ws("", *a)
    if name == "coalesce":
        return F.coalesce(*[F.nullif(x, F.lit("")) for x in a])
    if name == "substring":
        return _substring(a)
    if name == "replace":
        return F.when(a[1] == "", a[0]).otherwise(F.replace(a[0], a[1], a[2])) if len(a) > 2 else a[0]
    if name in ("left", "right"):
        return _side(getattr(F, name), a)
    if name == "dateformat":
        return _date(a, texts[1] if len(texts) > 1 else None)
    return a[0]


def split_arguments(text: str) -> list[str]:
    """Arguments at top-level commas; quotes and parentheses keep theirs."""
    out, depth, quote, now = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and not depth:
            out.append(now.strip())
            now = ""
            continue
        now += c
    return [*out, now.strip()] if now.strip() or out else []


def _literal(text: str) -> str | None:
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text if re.fullmatch(r"[+-]?[0-9.]+", text) else None


def compile_expression(text: str, fields: Column) -> Column:
    """The column of an expression over the map that image() makes."""
    steps = [s.strip() for s in _split_pipes(text)]
    m = _CALL.fullmatch(steps[0])
    if len(steps) == 1 and m:
        args = split_arguments(m[2])
        literal = [_literal(x) for x in args]
        made = [F.lit(v) if v is not None else compile_expression(x, fields) for x, v in zip(args, literal, strict=True)]
        return _apply(m[1].lower(), [x.cast("string") for x in made], literal)
    out = compile_expression(steps[0], fields) if m else value(fields, steps[0])
    for step in steps[1:]:
        if call := _CALL.fullmatch(step):
            args = [x.strip("'\"") for x in split_arguments(call[2])]
            out = _apply(call[1].lower(), [out.cast("string"), *map(F.lit, args)], [None, *args])
    return out


def _split_pipes(text: str) -> list[str]:
    out, quote, now, i = [], "", "", 0
    while i < len(text):
        if quote:
            quote = "" if text[i] == quote else quote
        elif text[i] in "'\"":
            quote = text[i]
        elif text[i : i + 2] == "|>":
            out.append(now)
            now, i = "", i + 2
            continue
        now += text[i]
        i += 1
    return [*out, now]
