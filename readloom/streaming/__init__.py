"""FASTQ files that arrive in a landing folder, as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.fastq import parse


def landing_reads(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Streaming (file, read_no, title, seq, qual) of the files in folder."""
    ship(spark)
    arrived = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    arrived = arrived.select(F.col("_metadata.file_path").alias("file"), "value")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, text in zip(b["file"], b["value"], strict=True):
                titles, seqs, quals, _ = parse(text.encode("latin-1"))
                yield pd.DataFrame({"file": file, "read_no": range(len(titles)), "title": titles, "seq": seqs, "qual": quals})

    return arrived.mapInPandas(cut, "file string, read_no long, title string, seq string, qual string")


def running_sizes(reads: DataFrame) -> DataFrame:
    """Reads and stream bytes by file, kept up as files arrive."""
    size = lambda c: F.sum(F.length(c)).cast("long")
    return reads.groupBy("file").agg(F.count("*").alias("reads"), size("title").alias("title_bytes"), size("seq").alias("seq_bytes"), size("qual").alias("qual_bytes"))
