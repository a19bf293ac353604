"""Conflicts: changes of the same row from different origins, and who wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.change.errors import UnresolvedConflict
from millrace.change.log import COLUMNS, latest

STRATEGIES = ("last_write_wins", "server_wins", "client_wins")


def conflicts(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Pairs (local.*, remote.* as structs) of the last changes of one row on both sides, from different origins."""
    local, remote = latest(local), latest(remote)
    a = local.select("table_name", "pk_value", F.struct(*COLUMNS).alias("local"))
    b = remote.select("table_name", "pk_value", F.struct(*COLUMNS).alias("remote"))
    return a.join(b, ["table_name", "pk_value"]).where(~F.col("local.origin").eqNullSafe(F.col("remote.origin")))


def resolve(pairs: DataFrame, strategy: str | Callable[[dict, dict], dict | None] = "last_write_wins") -> DataFrame:
    """The winning change of each pair.

    Last write wins: the later timestamp as text, then the higher version, then the local one. A callable gets both
    changes as dicts and returns the winner; returning None raises UnresolvedConflict.
    """
    local, remote = F.col("local"), F.col("remote")
    if strategy == "last_write_wins":
        ahead = (remote["timestamp"] > local["timestamp"]) | ((remote["timestamp"] == local["timestamp"]) & (remote["version"] > local["version"]))
        winner = F.when(ahead, remote).otherwise(local)
    elif strategy == "server_wins":
        winner = remote
    elif strategy == "client_wins":
        winner = local
    elif callable(strategy):
        return _custom(pairs, strategy)
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return pairs.select(winner.alias("w")).select("w.*")


def _custom(pairs: DataFrame, choose: Callable[[dict, dict], dict | None]) -> DataFrame:
    import pandas as pd

    def rows(frames):
        for frame in frames:
            won = [choose(dict(a), dict(b)) for a, b in zip(frame["local"], frame["remote"], strict=True)]
            if any(w is None for w in won):
                raise UnresolvedConflict("the callback chose no change")
            yield pd.DataFrame([[w[c] for c in COLUMNS] for w in won], columns=COLUMNS)

    return pairs.select("local", "remote").mapInPandas(rows, pairs.schema["local"].dataType)
