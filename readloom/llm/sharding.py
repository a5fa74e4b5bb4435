"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; rank r of n gets
the fraction (r + 0.5) / n. All rows are sorted by that fraction (ties: hash,
id, digests) and the order is cut into shards of equal row counts, so every
shard holds each source in the mixture's proportion (law ``rows``).

Both rankings are range shuffles of narrow rows with one count for each
partition sent to the driver, so a source with a third of all rows is split
over many tasks. The order depends on the rows and the seed alone.

Defined cases: a null source is a source of its own; null text has size 1 and
the checksum of no bytes (0); repeated rows each get a slot (which of equal
rows comes first makes no difference); a null id is an id like any other; equal
fractions, the ties of the order, go by hash, id and digests; long texts are
read whole but only their digests are moved; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ranked, sized

SEED = 20240229


def interleaved_shards(docs: DataFrame, shards: int = 8, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, text_crc32, law, shard, slot, grown_shard)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    own, total = ranked(rows, ["source", "h", "doc_id", "text_crc32", "size"], "g")
    of = checkpoint(own.groupBy("source").agg(F.min("g").alias("g0"), F.count("*").alias("n")))
    of = sized(of.select(F.col("source").alias("s_source"), "g0", "n"), 96)
    own = own.join(of, own["source"].eqNullSafe(F.col("s_source")))
    own = own.select("doc_id", "source", "size", "text_crc32", "h", ((F.col("g") - F.col("g0") + 0.5) / F.col("n")).alias("frac"))
    own, total = ranked(own, ["frac", "h", "doc_id", "source", "text_crc32", "size"], "g")
    n = max(total, 1)
    own = own.withColumn("shard", F.expr(f"cast(g * {shards} div {n} as int)"))
    return own.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.expr(f"g - (cast(shard as bigint) * {n} + {shards - 1}) div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
