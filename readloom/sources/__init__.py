"""FASTQ files and block archives as Spark data sources."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..shipping import ship


def register(spark: SparkSession) -> None:
    """Make the formats ``fastq`` and ``readarchive`` known."""
    from .archive import ArchiveSource
    from .fastq import FastqSource

    ship(spark)
    spark.dataSource.register(FastqSource)
    spark.dataSource.register(ArchiveSource)
