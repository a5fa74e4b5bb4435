"""Entropy-coding cost from histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X


def histogram_bits(hist: DataFrame, keys: list[str], symbol: str, count: str) -> DataFrame:
    """(keys, symbols, total, bits) of an optimal prefix code for each group.
    hist has a row for each symbol that occurs; alphabets are bounded (a byte,
    or 512 numbers), so a group's list is too."""
    own = hist.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(count).cast("long").alias("f"), F.col(symbol).cast("long").alias("sym")))).alias("h"),
        F.sum(count).cast("long").alias("total"),
    )
    return own.select(*keys, F.size("h").cast("long").alias("symbols"), "total", F.expr(X.huffman_bits("h")).alias("bits"))
