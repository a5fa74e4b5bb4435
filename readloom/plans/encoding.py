"""The encoding plan of a read set, before any byte is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dna, quality, records, titles


def encoding_plan(reads: DataFrame) -> DataFrame:
    """(block_id, stream, scheme): what each stream of each block would use."""
    q = quality.schemes(reads).selectExpr("block_id", "'quality' as stream", "scheme")
    d = dna.schemes(reads).selectExpr("block_id", "'dna' as stream", "scheme")
    t = titles.schemes(reads).selectExpr("block_id", "concat('title.', field) as stream", "scheme")
    return q.unionByName(d).unionByName(t)


def size_estimate(reads: DataFrame) -> DataFrame:
    """(block_id, text_bytes, quality_bytes, dna_bytes): sizes by closed form
    of the sections that need no bits written."""
    head = records.block_headers(reads).selectExpr("block_id", "chunk_size as text_bytes")
    q = quality.section_bytes(reads).selectExpr("block_id", "bytes as quality_bytes")
    d = dna.section_bytes(reads).selectExpr("block_id", "bytes as dna_bytes")
    return head.join(q, "block_id").join(d, "block_id")


def refused(reads: DataFrame) -> DataFrame:
    """(block_id, stream, reason) of what the archive format can't hold."""
    plan = encoding_plan(reads)
    bad = plan.where(F.col("scheme").isin("ERROR", "VALUE_RLE", "DELTA_RLE")).selectExpr("block_id", "stream", "scheme as reason")
    mixed = titles.layouts(reads).where("mixed").selectExpr("block_id", "'title' as stream", "'MIXED_TITLES' as reason")
    return bad.unionByName(mixed)
