"""Record level: validity, stream sizes, dataset detection, block headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ALPHABET, QUALITY_OFFSET


def with_validity(records: DataFrame) -> DataFrame:
    """Adds ``valid`` (title starts with @, a plus line, equal lengths) and
    ``taken`` (valid, and so is each record before it in its block)."""
    plus = F.col("plus") if "plus" in records.columns else F.lit("+")
    valid = F.coalesce(F.col("title").startswith("@") & (F.length(plus) > 0) & (F.length("seq") == F.length("qual")), F.lit(False))
    before = Window.partitionBy("block_id").orderBy("read_id").rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("valid", valid).withColumn("taken", F.min("valid").over(before))


def valid_prefix(records: DataFrame) -> DataFrame:
    """The records of each block up to its first bad one."""
    return with_validity(records).where("taken").drop("valid", "taken")


def stream_sizes(reads: DataFrame) -> DataFrame:
    size = lambda c: F.sum(F.length(c)).cast("long")
    return reads.groupBy("block_id").agg(size("title").alias("title_bytes"), size("seq").alias("seq_bytes"), size("qual").alias("qual_bytes"))


def symbol_checks(reads: DataFrame) -> DataFrame:
    """Reads by block whose bases are outside the alphabet, whose qualities are
    below the offset, or too high to be coupled."""
    bad_base = ~F.translate("seq", ALPHABET, "").eqNullSafe("")
    low = F.exists(F.split("qual", ""), lambda c: (F.length(c) > 0) & (F.ascii(c) < QUALITY_OFFSET))
    high = F.exists(F.split("qual", ""), lambda c: F.ascii(c) >= QUALITY_OFFSET + 128)
    n = lambda c: F.count_if(c)
    return reads.groupBy("block_id").agg(n(bad_base).alias("bad_bases"), n(low).alias("low_qualities"), n(high).alias("high_qualities"))


def sniff(records: DataFrame) -> DataFrame:
    """One row: what the data set looks like (plus_repetition, color_space,
    min_q, max_q, quality_offset, ok). Flags must agree on all rows."""
    plus = F.col("plus") if "plus" in records.columns else F.lit("+")
    second = F.substring("seq", 2, 1)
    rows = records.select(
        "block_id",
        "read_id",
        (F.length(plus) > 1).alias("repeats"),
        (second.rlike("^[0-3.]$")).alias("color"),
        F.substring("seq", 1, 1).rlike("^[0-3]$").alias("digit"),
        F.array_min(F.transform(F.filter(F.split("qual", ""), lambda c: c != ""), lambda c: F.ascii(c))).alias("lo"),
        F.array_max(F.transform(F.filter(F.split("qual", ""), lambda c: c != ""), lambda c: F.ascii(c))).alias("hi"),
    )
    first = F.struct("block_id", "read_id")
    one = rows.agg(
        F.count("*").alias("n"),
        F.min_by("repeats", first).alias("plus_repetition"),
        F.min_by("color", first).alias("color_space"),
        F.bool_or("repeats").alias("any_r"),
        F.bool_and("repeats").alias("all_r"),
        F.bool_or("color").alias("any_c"),
        F.bool_and("color").alias("all_c"),
        F.count_if(F.col("color") & F.col("digit")).alias("digits"),
        F.min_by(F.col("color") & F.col("digit"), first).alias("first_digit"),
        F.min("lo").alias("min_q"),
        F.max("hi").alias("max_q"),
    )
    lo, hi = F.col("min_q"), F.col("max_q")
    offset = F.when((hi <= 74) & (lo >= 33), 33).when((hi > 74) & (hi <= 105) & (lo >= 64), 64).when((hi > 74) & (hi <= 105) & (lo >= 59), 59).when(lo >= 33, 33)
    same = (F.col("any_r") == F.col("all_r")) & (F.col("any_c") == F.col("all_c"))
    late = F.col("digits") - F.col("first_digit").cast("int") > 0
    ok = F.coalesce((F.col("n") > 1) & same & ~late & offset.isNotNull(), F.lit(False))
    return one.select("plus_repetition", "color_space", "min_q", "max_q", offset.cast("int").alias("quality_offset"), ok.alias("ok"))


def block_headers(reads: DataFrame) -> DataFrame:
    """The head of each block: records, longest and shortest quality, the
    variable-length flag and the size of the text the block came from."""
    n = F.length("qual")
    text = F.length("title") + F.length("seq") + F.length("qual") + 5
    head = reads.groupBy("block_id").agg(F.count("*").alias("records"), F.max(n).cast("long").alias("max_q"), F.min(n).cast("long").alias("min_q"), F.sum(text).cast("long").alias("chunk_size"))
    return head.withColumn("flags", F.when(F.col("max_q") != F.col("min_q"), 2).otherwise(0).cast("int"))
