"""The folder that driver and executors share for tables between steps."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names. Where none is set, a master on this machine gets a temporary one for the
    session, and any other has none that all executors share: an error."""
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getConf().get(SETTING)
    if not folder:
        if not (context.master or "").startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")
