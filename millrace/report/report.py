"""Report definitions in JSON, and their execution."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from millrace.plans.engine import Engine, parameters
from millrace.sources import export


class ReportError(Exception):
    pass


@dataclass(frozen=True)
class Parameter:
    name: str
    type: str = "String"  # String, Date, Integer, Decimal, Boolean
    required: bool = False
    default: Any = None

    def convert(self, value: Any) -> Any:
        if value is None:
            return None
        try:
            return {
                "string": str, "integer": int, "decimal": lambda v: Decimal(str(v)), "date": lambda v: v if isinstance(v, date) else date.fromisoformat(str(v)[:10]),
                "boolean": lambda v: v if isinstance(v, bool) else {"true": True, "false": False, "1": True, "0": False}[str(v).lower()],
            }[self.type.lower()](value)
        except (ValueError, KeyError, ArithmeticError) as e:
            raise ReportError(f"parameter {self.name}: {value!r} is no {self.type}") from e


@dataclass(frozen=True)
class DataSource:
    id: str
    type: str  # sql, lql, api
    query: str
    connection: str = ""
    parameters: tuple[str, ...] = ()


@dataclass(frozen=True)
class Report:
    id: str
    title: str
    parameters: tuple[Parameter, ...] = ()
    sources: tuple[DataSource, ...] = ()
    layout: dict[str, Any] = field(default_factory=dict)
    css: str | None = None

    def metadata(self) -> dict[str, Any]:
        """What a client may see: everything but the queries."""
        return {"id": self.id, "title": self.title, "parameters": [{"name": p.name, "type": p.type, "required": p.required, "default": p.default} for p in self.parameters], "dataSources": [s.id for s in self.sources], "layout": self.layout, "css": self.css}


def _get(raw: dict, *names: str, default: Any = None) -> Any:
    return next((raw[n] for n in names if n in raw), default)


def load(text: str) -> Report:
    """A report from JSON. Raises ReportError where it isn't one."""
    try:
        raw = json.loads(text)
        parameters_ = tuple(Parameter(p["name"], str(_get(p, "type", default="String")), bool(_get(p, "required", default=False)), _get(p, "default", "defaultValue")) for p in raw.get("parameters") or [])
        sources = tuple(DataSource(s["id"], str(s["type"]).lower(), _get(s, "query", default=""), _get(s, "connectionRef", "connection", default=""), tuple(s.get("parameters") or ())) for s in raw.get("dataSources") or [])
        return Report(raw["id"], raw.get("title", raw["id"]), parameters_, sources, raw.get("layout") or {}, _get(raw, "customCss", "css"))
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise ReportError(f"not a report: {e}") from e


def load_folder(folder: str) -> dict[str, Report]:
    """Every ``*.report.json`` of a folder, by id."""
    found = [load(p.read_text()) for p in sorted(Path(folder).glob("*.report.json"))]
    return {r.id: r for r in found}


class Runner:
    """Runs reports over named engines (connections). With ``most``, run() takes so many rows of each source to the driver
    and tells the whole number, and render() refuses a source that has more."""

    def __init__(self, engines: dict[str, Engine], most: int | None = None):
        self.engines, self.most = engines, most

    def frames(self, report: Report, values: dict[str, Any] | None = None) -> dict[str, DataFrame]:
        """A DataFrame per data source; declared types and defaults apply to the parameters."""
        given = dict(values or {})
        bound: dict[str, Any] = {}
        for p in report.parameters:
            if p.required and given.get(p.name) is None and p.default is None:
                raise ReportError(f"parameter {p.name} is required")
            bound[p.name] = p.convert(given.get(p.name, p.default))
        bound |= {k: v for k, v in given.items() if k not in bound}
        out = {}
        for s in report.sources:
            if s.type == "api":
                raise ReportError(f"data source {s.id}: API sources are not supported")
            if s.type not in ("sql", "lql"):
                raise ReportError(f"data source {s.id}: unknown type {s.type}")
            engine = self.engines.get(s.connection) or (next(iter(self.engines.values())) if not s.connection and len(self.engines) == 1 else None)
            if engine is None:
                raise ReportError(f"data source {s.id}: unknown connection {s.connection}")
            used = {n: bound.get(n) for n in parameters(s.query)}
            try:
                out[s.id] = engine.sql(s.query, used) if s.type == "sql" else engine.query(s.query, used)
            except Exception as e:
                raise ReportError(f"data source {s.id}: {e}") from e
        return out

    def run(self, report: Report, values: dict[str, Any] | None = None) -> dict[str, export.Result]:
        """Every data source's rows; the sources are independent and run side by side."""
        frames = self.frames(report, values)
        with ThreadPoolExecutor(max(1, min(4, len(frames)))) as pool:
            return dict(zip(frames, pool.map(lambda df: export.collect(df, self.most), frames.values()), strict=True))

    def render(self, report: Report, values: dict[str, Any] | None = None, format: str = "json") -> dict[str, str]:
        write = {"json": export.to_json, "csv": export.to_csv}.get(format.lower())
        if write is None:
            raise ReportError(f"unknown format: {format}")
        found = self.run(report, values)
        if cut := [k for k, v in found.items() if len(v.rows) < v.total]:
            raise ReportError(f"data source {cut[0]}: {found[cut[0]].total} rows, more than {self.most}")
        return {k: write(v) for k, v in found.items()}
