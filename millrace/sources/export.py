"""Results as CSV and JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Result:
    """A report's rows on the driver."""

    columns: list[str]
    rows: list[list[Any]]
    total: int


def collect(df: DataFrame, most: int | None = None) -> Result:
    """The rows on the driver, at most ``most`` of them; total counts all."""
    rows = (df if most is None else df.limit(most)).collect()
    total = len(rows) if most is None or len(rows) < most else df.count()
    return Result(df.columns, [list(r) for r in rows], total)


def _cell(v: Any) -> str:
    if v is None:
        return ""
    text = ("true" if v else "false") if isinstance(v, bool) else v.isoformat(" ") if hasattr(v, "isoformat") else str(v)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n') else text


def to_csv(result: Result) -> str:
    """A header and a line per row; cells with comma, quote or line break are quoted, null is empty."""
    return "\n".join(",".join(map(_cell, r)) for r in [result.columns, *result.rows])


def to_json(result: Result) -> str:
    """An object with columnNames, rows and totalRows, not indented."""
    return json.dumps({"columnNames": result.columns, "rows": result.rows, "totalRows": result.total}, separators=(",", ":"), ensure_ascii=False, default=lambda v: v.isoformat() if hasattr(v, "isoformat") else str(v))


def write_csv(df: DataFrame, path: str) -> None:
    """All rows as distributed CSV files with the same quoting rules."""
    df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).write.option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """All rows as distributed JSON lines, nulls kept."""
    df.write.option("ignoreNullFields", "false").json(path)
