"""Make this package importable in Spark's Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once for each Spark application, and
    keep Arrow batches small, since rows may hold long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    sc = spark.sparkContext
    if getattr(sc, "_readloom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="readloom-")) / "readloom_src.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    sc.addPyFile(str(to))
    sc._readloom_shipped = True
