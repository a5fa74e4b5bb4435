"""pack, unpack, generate, inspect: the jobs of the command line."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import BLOCK_BYTES
from .sources import archive, fastq, files


def pack(spark: SparkSession, archive_path: str, fastq_path: str, chunk_bytes: int = BLOCK_BYTES, verify: bool = True) -> dict:
    """Encode FASTQ (a file, a folder or a glob) into an archive. Every byte of
    the input must come back, but for a missing last line end: the scan compares
    the records it found with the bytes they came from, and each block is
    decoded again and compared with them. Blocks are partitions of the scan, so
    nothing is shuffled. A failure leaves no archive.

    An archive path that ends in / is a folder of archives: tasks then find the
    ranges' boundaries themselves and write whole archives, so neither planning
    nor commit reads or copies data on the driver."""
    began = time.time()
    if not sum(map(files.size, files.listed(fastq_path))):
        raise ValueError(f"{fastq_path}: no records")
    if archive_path.endswith("/"):
        reads = fastq.read_fastq(spark, fastq_path, chunk_bytes, "exact", "ranges")
        archive.write_archive_parts(archive.encoded(reads, verify), archive_path)
    else:
        reads = fastq.read_fastq(spark, fastq_path, chunk_bytes, "exact")
        archive.write_archive(archive.encoded(reads, verify), archive_path)
    return report(spark, archive_path, fastq_path) | {"seconds": round(time.time() - began, 3)}


def report(spark: SparkSession, archive_path: str, fastq_path: str) -> dict:
    heads = archive.read_archive(spark, archive_path, "head").agg(F.count("*").alias("blocks"), F.sum("records").alias("records")).first()
    a, b = sum(map(files.size, files.listed(archive_path))), sum(map(files.size, files.listed(fastq_path)))
    return {"blocks": heads["blocks"], "records": heads["records"], "archive_bytes": a, "fastq_bytes": b, "ratio": round(b / a, 3)}


def unpack(spark: SparkSession, archive_path: str, fastq_path: str) -> dict:
    """Decode an archive, or a folder of archives, into a FASTQ file; into a
    folder of files where fastq_path ends in /."""
    began = time.time()
    index = archive.read_index(files.listed(archive_path)[0])
    reads = archive.read_archive(spark, archive_path)
    if fastq_path.endswith("/"):
        fastq.write_fastq_parts(reads, fastq_path, index.plus_repetition)
    else:
        fastq.write_fastq(reads, fastq_path, index.plus_repetition, in_order=True)
    return report(spark, archive_path, fastq_path) | {"seconds": round(time.time() - began, 3)}


def inspect(spark: SparkSession, archive_path: str) -> DataFrame:
    """A row for each block, from heads alone."""
    return archive.read_archive(spark, archive_path, "head")


def generated(spark: SparkSession, n: int, read_length: int = 100, seed: int = 42, block_reads: int = 4096) -> DataFrame:
    """Synthetic reads: a base repeats the one before it in 80 of 100 cases;
    qualities fall along the read and stay in 0..40."""
    h = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1_000_003))
    at = F.sequence(F.lit(1), F.lit(max(1, read_length)))
    step = lambda a, i: F.when((F.length(a) > 0) & (h("id", i, F.lit(1)) % 100 < 80), F.concat(a, F.substring(a, -1, 1))).otherwise(F.concat(a, F.substring(F.lit("ACGT"), (h("id", i, F.lit(2)) % 4 + 1).cast("int"), F.lit(1))))
    seq = F.aggregate(at, F.lit(""), step)
    q = F.transform(at, lambda i: F.char(33 + F.greatest(F.lit(0), F.least(F.lit(40), (40 - 20 * i / read_length + h("id", i, F.lit(3)) % 9 - 4).cast("int")))))
    title = F.concat(F.lit("@SRR001471."), 1_000_000 + F.col("id"), F.lit(" HWI-EAS7:1:3:"), h("id", F.lit(4)) % 2000, F.lit(":"), h("id", F.lit(5)) % 2000, F.lit("/1"))
    empty = read_length <= 0
    return spark.range(n).select(F.col("id").alias("read_id"), F.floor(F.col("id") / block_reads).alias("block_id"), title.alias("title"), F.lit("").alias("seq") if empty else seq.alias("seq"), F.lit("").alias("qual") if empty else F.array_join(q, "").alias("qual"))


def generate(spark: SparkSession, fastq_path: str, n: int, read_length: int = 100, seed: int = 42) -> None:
    fastq.write_fastq(generated(spark, n, read_length, seed), fastq_path)
