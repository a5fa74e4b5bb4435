"""Coupling of bases and qualities, and the sequence stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..schema import ALPHABET, COUPLED_BASE
from .entropy import histogram_bits


def positions(reads: DataFrame) -> DataFrame:
    """A row for each position: (block_id, read_id, pos, b, q, cq, keep). cq is
    the coded quality; keep tells whether the base stays in its own stream."""
    rows = reads.selectExpr("block_id", "read_id", f"posexplode({X.cells()}) as (pos, c)")
    return rows.selectExpr("block_id", "read_id", "pos", "c.b as b", "c.q as q", f"{X.coupled_quality('c.b', 'c.q')} as cq", f"not {X.leaves_out('c.b', 'c.q')} as keep")


def couple(reads: DataFrame) -> DataFrame:
    """Adds ``dna`` (kept base indexes) and ``coded`` (coded qualities)."""
    done = reads.withColumn("c", F.expr(X.cells()))
    return done.withColumns(
        {
            "dna": F.expr(f"transform(filter(c, x -> not {X.leaves_out('x.b', 'x.q')}), x -> x.b)"),
            "coded": F.expr(f"transform(c, x -> {X.coupled_quality('x.b', 'x.q')})"),
        }
    ).drop("c")


def uncouple(coded: DataFrame) -> DataFrame:
    """Inverse of couple: adds ``seq_back`` and ``qual_back``. The kept bases
    are cut where a base was left out, which goes back in between."""
    kept = f"array_join(transform(dna, b -> substring('{ALPHABET}', b + 1, 1)), '')"
    out = f"filter(transform(coded, (v, i) -> named_struct('v', v, 'i', i)), x -> x.v >= {COUPLED_BASE})"
    base = f"substring('{ALPHABET}', 1 + (x.v - {COUPLED_BASE}) div 8 + 4, 1)"
    # before the k-th base left out, at place i, i - k kept ones stand
    part = f"concat(substring(kept, if(k = 0, 0, out[k - 1].i + 1 - k) + 1, x.i - if(k = 0, 0, out[k - 1].i + 1)), {base})"
    tail = "if(size(out) = 0, kept, substring(kept, element_at(out, -1).i + 2 - size(out), length(kept)))"
    seq = f"concat(array_join(transform(out, (x, k) -> {part}), ''), {tail})"
    quality = f"array_join(transform(coded, v -> char(33 + if(v >= {COUPLED_BASE}, v & 7, v))), '')"
    parts = coded.withColumns({"kept": F.expr(kept), "out": F.expr(out)})
    return parts.withColumns({"seq_back": F.expr(seq), "qual_back": F.expr(quality)}).drop("kept", "out")


def coupled_lengths(reads: DataFrame) -> DataFrame:
    done = couple(reads)
    return done.selectExpr("block_id", "read_id", "cast(size(dna) as bigint) as dna_length", f"cast(size(filter(coded, v -> v < {COUPLED_BASE})) as bigint) as recovered_length", "aggregate(coded, 0L, (a, v) -> a + v) as coded_sum")


def roundtrip(reads: DataFrame) -> DataFrame:
    back = uncouple(couple(reads))
    return back.groupBy("block_id").agg(F.count("*").alias("reads"), F.count_if(F.expr("seq_back <> seq or qual_back <> qual")).alias("mismatches"))


def base_histogram(reads: DataFrame) -> DataFrame:
    return positions(reads).where("keep").groupBy("block_id", F.col("b").cast("int").alias("base")).agg(F.count("*").alias("n"))


def schemes(reads: DataFrame) -> DataFrame:
    """(block_id, bases, symbols, scheme): NONE, B2, HUFFMAN, or ERROR for a
    small alphabet beyond ACGT, which a 2-bit code would corrupt."""
    per = positions(reads).groupBy("block_id").agg(F.count_if("keep").alias("bases"), F.count_distinct(F.when(F.col("keep"), F.col("b"))).alias("symbols"), F.max(F.when(F.col("keep"), F.col("b"))).alias("top"))
    return per.selectExpr("block_id", "bases", "symbols", "case when symbols = 0 then 'NONE' when symbols > 4 then 'HUFFMAN' when top >= 4 then 'ERROR' else 'B2' end as scheme")


def section_bytes(reads: DataFrame) -> DataFrame:
    """(block_id, scheme, bytes): stored size of the sequence section."""
    hist = base_histogram(reads)
    bits = histogram_bits(hist, ["block_id"], "base", "n").select("block_id", "bits")
    both = schemes(reads).join(bits, "block_id", "left")
    huff = f"1 + 3 + {X.tree_bytes('symbols', 'symbols')} + cast(ceil(bits / 8) as bigint)"
    return both.selectExpr("block_id", "scheme", f"case scheme when 'NONE' then 1L when 'B2' then 1 + cast(ceil(2 * bases / 8) as bigint) when 'HUFFMAN' then {huff} end as bytes")
