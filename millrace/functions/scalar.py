"""How functions of the query language are written where a dialect has another name or form for them.

Everything else passes through: a name that Spark or a registered function knows works, an unknown one fails.
"""

from __future__ import annotations

import re

PARTS = frozenset("year quarter month week day hour minute second dow doy".split())
_QUOTED = re.compile(r"'([A-Za-z]+)'")


def part(text: str) -> str:
    """The date part that an argument names, quoted or bare."""
    m = _QUOTED.fullmatch(text)
    return (m[1] if m else text.strip("`")).lower()


def _spark_concat(a: list[str]) -> str:
    return f"concat_ws('', {', '.join(a)})"


RENDERED = {
    "spark": {
        "concat": _spark_concat,  # skips nulls, as the databases do
        "extract": lambda a: f"extract({part(a[0])} FROM {a[1]})",
        "date_trunc": lambda a: f"date_trunc('{part(a[0])}', {a[1]})",
        "now": lambda a: "current_timestamp()",
        "today": lambda a: "current_date()",
        "current_date": lambda a: "current_date()",
        "isnull": lambda a: f"isnull({a[0]})",
        "isnotnull": lambda a: f"isnotnull({a[0]})",
        "mod": lambda a: f"({a[0]} % {a[1]})",
        "date_add": lambda a: f"timestampadd({part(a[0]).upper()}, {a[1]}, {a[2]})" if len(a) == 3 else f"date_add({a[0]}, {a[1]})",
    },
    "postgres": {
        "extract": lambda a: f"EXTRACT({part(a[0])} FROM {a[1]})",
        "date_trunc": lambda a: f"DATE_TRUNC('{part(a[0])}', {a[1]})",
        "current_date": lambda a: "CURRENT_DATE",
        "date_add": lambda a: f"{a[2]} + INTERVAL '{a[1]} {part(a[0])}'",
    },
    "sqlite": {
        "current_date": lambda a: "datetime('now')",
        "substring": lambda a: f"substr({', '.join(a)})",
        "extract": lambda a: f"strftime('%{dict(year='Y', month='m', day='d', hour='H', minute='M', second='S').get(part(a[0]), 'Y')}', {a[1]})",
        "date_add": lambda a: f"datetime({a[2]}, '+{a[1]} {part(a[0])}')",
    },
    "sqlserver": {
        "length": lambda a: f"LEN({a[0]})",
        "current_date": lambda a: "GETDATE()",
        "extract": lambda a: f"DATEPART({part(a[0])}, {a[1]})",
        "date_trunc": lambda a: f"DATETRUNC({part(a[0])}, {a[1]})",
        "date_add": lambda a: f"DATEADD({part(a[0])}, {a[1]}, {a[2]})",
    },
}

#: What the linter knows besides.
AGGREGATES = frozenset("count sum avg min max first last".split())
KNOWN = AGGREGATES | frozenset(
    "concat substring length trim upper lower replace round floor ceil abs sqrt power mod now today year month day hour minute second "
    "coalesce nullif isnull isnotnull row_number rank dense_rank ntile lag lead extract date_trunc current_date date_add exists".split()
)
