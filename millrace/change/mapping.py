"""Applies a mapping configuration to a log in one pass: every change becomes an array of mapped changes, exploded."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.change.config import ColumnMapping, MappingConfig, TableMapping
from millrace.change.errors import DatabaseError
from millrace.functions.mapping import compile_expression, image

RESULT = "array<struct<target_table:string,target_pk:string,mapped_payload:string,mapping_id:string>>"


def _raw(payload: Column, name: str) -> Column:
    """A field's own JSON value, by exact name; null where it is missing or null."""
    got = F.try_variant_get(F.try_parse_json(payload), f"$[{json.dumps(name)}]", "variant")
    return F.when(~F.is_variant_null(got), got)


def _any(payload: Column, name: str) -> Column:
    """As _raw(), but a name in another case will do."""
    keys = F.json_object_keys(payload)
    loose = F.get(F.filter(keys, lambda k: F.lower(k) == name.lower()), F.lit(0))
    exact = _raw(payload, name)
    found = F.element_at(F.from_json(payload, "map<string,variant>"), loose)
    return F.coalesce(exact, F.when(loose.isNotNull() & ~F.is_variant_null(found), found))


def _value(payload: Column, c: ColumnMapping) -> Column:
    if c.transform == "constant":
        return F.lit(c.value).cast("string")
    if c.transform == "lql" and c.lql and c.lql.strip():
        simple = c.lql.strip()
        if "|>" not in simple and "(" not in simple:
            return _any(payload, simple)
        return compile_expression(c.lql, image(payload))
    return _raw(payload, c.source) if c.source else F.lit(None).cast("string")


def map_payload(payload: Column, columns: tuple[ColumnMapping, ...], excluded: tuple[str, ...] = ()) -> Column:
    """The mapped row image. Without column mappings all but the excluded columns pass. A null is left out unless its
    mapping has no source."""
    if columns:
        last = {c.target: c for c in columns}  # of two mappings to one target the later holds
        fields = [(F.coalesce(_value(payload, c).cast("variant"), F.parse_json(F.lit("null"))) if c.source is None else _value(payload, c)).alias(name) for name, c in last.items()]
        return F.when(payload.isNotNull(), F.to_json(F.struct(*fields)))
    if not excluded:
        return payload
    gone = [x.lower() for x in excluded]
    kept = F.map_filter(F.from_json(payload, "map<string,variant>"), lambda k, _: ~F.lower(k).isin(gone))
    return F.when(payload.isNotNull(), F.to_json(kept))


def map_key(pk: Column, mapping: TableMapping) -> Column:
    """The key's JSON with its (single) column renamed."""
    if mapping.key is None:
        return pk
    first = F.get(F.map_values(F.from_json(pk, "map<string,variant>")), F.lit(0))
    return F.coalesce(F.to_json(F.struct(first.alias(mapping.key.target))), pk)


def _filter(mapping: TableMapping, payload: Column) -> Column | None:
    """The row filter, in the query language's conditions, over the row image."""
    if not mapping.filter:
        return None
    from millrace.lang import tree as t
    from millrace.lang.parser import parse
    from millrace.plans.block import rewrite
    from millrace.plans.render import Renderer

    tree = parse(f"x |> filter({mapping.filter.strip()})").result.steps[0].args[0]

    def look(n: t.Node) -> t.Node | None:
        if isinstance(n, t.Name):
            return t.Call("try_element_at", (t.Name(("__image",)), t.Literal(n.parts[-1])))
        if isinstance(n, t.Literal) and isinstance(n.value, bool):
            return t.Literal(str(n.value).lower())
        return None

    return F.expr(Renderer("spark").expr(rewrite(tree, look)))


def apply(log: DataFrame, config: MappingConfig, direction: str) -> DataFrame:
    """The log's columns with target_table, target_pk, mapped_payload, mapping_id; one row per change and target.

    Changes of unmapped tables are skipped, or pass as they are; those of disabled mappings and those that a mapping's
    filter rejects are skipped (a delete has no image to test and passes).
    """
    pk, payload = F.col("pk_value"), F.col("payload")
    made, seen = None, set()
    own = log.withColumn("__image", image(payload))
    for m in config.mappings:
        if m.source in seen or m.direction not in (direction, "both"):
            continue
        seen.add(m.source)
        key = map_key(pk, m)
        if not m.enabled:
            rows = F.lit(None).cast(RESULT)
        elif m.multi_target:
            if not m.targets:
                raise DatabaseError(f"mapping {m.id} has no targets")
            rows = F.array(*[F.struct(F.lit(x.table).alias("target_table"), key.alias("target_pk"), map_payload(payload, x.columns).alias("mapped_payload"), F.lit(m.id).alias("mapping_id")) for x in m.targets])
        else:
            rows = F.array(F.struct(F.lit(m.target or m.source).alias("target_table"), key.alias("target_pk"), map_payload(payload, m.columns, m.excluded).alias("mapped_payload"), F.lit(m.id).alias("mapping_id")))
        if (test := _filter(m, payload)) is not None:
            rows = F.when(payload.isNull() | test, rows)
        here = F.col("table_name") == m.source
        made = F.when(here, rows) if made is None else made.when(here, rows)
    same = F.array(F.struct(F.col("table_name").alias("target_table"), pk.alias("target_pk"), payload.alias("mapped_payload"), F.lit("identity").alias("mapping_id")))
    rest = same if config.unmapped == "passthrough" else F.lit(None).cast(RESULT)
    rows = rest if made is None else made.otherwise(rest)
    return own.select(*log.columns, F.explode(rows.cast(RESULT)).alias("m")).select(*log.columns, "m.*")
