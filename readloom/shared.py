"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder (local
    master) or one in the warehouse."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master.startswith("local") and not master.startswith("local-cluster"):
            found = "file://" + tempfile.mkdtemp(prefix="readloom-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_readloom"
            if conf.get("spark.sql.warehouse.dir", None) is None:
                raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found)
    return found
