"""Mapping configuration: records and their JSON form."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class KeyMapping:
    source: str
    target: str


@dataclass(frozen=True)
class ColumnMapping:
    source: str | None
    target: str
    transform: str = "none"  # none, constant, lql
    value: str | None = None
    lql: str | None = None


@dataclass(frozen=True)
class Target:
    table: str
    columns: tuple[ColumnMapping, ...] = ()


@dataclass(frozen=True)
class Tracking:
    enabled: bool = True
    strategy: str = "version"  # version, hash, timestamp, external
    column: str | None = None


@dataclass(frozen=True)
class TableMapping:
    id: str
    source: str
    target: str | None = None
    direction: str = "push"  # push, pull, both
    enabled: bool = True
    key: KeyMapping | None = None
    columns: tuple[ColumnMapping, ...] = ()
    excluded: tuple[str, ...] = ()
    filter: str | None = None
    tracking: Tracking = field(default_factory=Tracking)
    multi_target: bool = False
    targets: tuple[Target, ...] = ()


@dataclass(frozen=True)
class MappingConfig:
    version: str = "1.0"
    unmapped: str = "strict"  # strict, passthrough
    mappings: tuple[TableMapping, ...] = ()

    def find(self, table: str, direction: str) -> TableMapping | None:
        """The first mapping of a table that goes this way."""
        return next((m for m in self.mappings if m.source == table and m.direction in (direction, "both")), None)


def _word(text: object, known: tuple[str, ...], default: str) -> str:
    return text.lower() if isinstance(text, str) and text.lower() in known else default


def _columns(found: list | None) -> tuple[ColumnMapping, ...]:
    return tuple(
        # A column without a source that has a value is a constant, named so or not.
        ColumnMapping(c.get("source"), c["target"], _word(c.get("transform"), ("none", "constant", "lql"), "constant" if c.get("source") is None and c.get("value") is not None else "none"), c.get("value"), c.get("lql"))
        for c in found or []
        if c.get("target")
    )


def parse(text: str) -> MappingConfig:
    """A configuration from JSON; mappings without id or source table are left out. Raises ValueError on bad JSON."""
    raw = json.loads(text)
    if not isinstance(raw, dict):
        raise ValueError("the configuration is not an object")
    made = []
    for m in raw.get("mappings") or []:
        if not m.get("id") or not m.get("source_table"):
            continue
        key, tracking = m.get("pk_mapping"), m.get("sync_tracking") or {}
        made.append(
            TableMapping(
                m["id"], m["source_table"], m.get("target_table"), _word(m.get("direction"), ("push", "pull", "both"), "push"), m.get("enabled", True) is not False,
                KeyMapping(key["source_column"], key["target_column"]) if key else None, _columns(m.get("column_mappings")), tuple(m.get("excluded_columns") or ()), (m.get("filter") or {}).get("lql"),
                Tracking(tracking.get("enabled", True) is not False, _word(tracking.get("strategy"), ("version", "hash", "timestamp", "external"), "version"), tracking.get("tracking_column")),
                bool(m.get("multi_target")), tuple(Target(x["table"], _columns(x.get("column_mappings"))) for x in m.get("targets") or []),
            )
        )
    return MappingConfig(raw.get("version") or "1.0", _word(raw.get("unmapped_table_behavior"), ("strict", "passthrough"), "strict"), tuple(made))


def serialise(config: MappingConfig) -> str:
    def columns(found: tuple[ColumnMapping, ...]) -> list[dict]:
        return [{"source": c.source, "target": c.target, "transform": None if c.transform == "none" else c.transform, "value": c.value, "lql": c.lql} for c in found]

    mappings = [
        {
            "id": m.id, "source_table": m.source, "target_table": m.target, "direction": m.direction, "enabled": m.enabled,
            "pk_mapping": {"source_column": m.key.source, "target_column": m.key.target} if m.key else None,
            "column_mappings": columns(m.columns), "excluded_columns": list(m.excluded), "filter": {"lql": m.filter} if m.filter else None,
            "sync_tracking": {"enabled": m.tracking.enabled, "strategy": m.tracking.strategy, "tracking_column": m.tracking.column},
            "multi_target": m.multi_target, "targets": [{"table": x.table, "column_mappings": columns(x.columns)} for x in m.targets],
        }
        for m in config.mappings
    ]
    return json.dumps({"version": config.version, "unmapped_table_behavior": config.unmapped, "mappings": mappings}, indent=2)
