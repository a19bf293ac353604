"""Tracking takes every mapping's state."""

from pyspark.sql import functions as F

from millrace.change import config, tracking


def test_no_state_is_cut(spark):
    n = 10_500
    how = config.parse('{"mappings": [{"id": "m10499", "source_table": "T", "target_table": "T", "direction": "both", "sync_tracking": {"enabled": true, "strategy": "version"}}]}')
    assert how.mappings[0].tracking.strategy == "version"
    state = spark.range(n).coalesce(1).select(F.format_string("m%d", "id").alias("mapping_id"), F.lit(5).cast("long").alias("last_synced_version"))
    mapped = spark.createDataFrame([("m10499", "1", v, "update", "{}") for v in (4, 5, 6)], "mapping_id string, pk_value string, version long, operation string, payload string")
    got = tracking.pending(mapped, how, state, spark.createDataFrame([], tracking.HASHES)).collect()
    assert [r.version for r in got] == [6]
