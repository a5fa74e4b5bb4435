"""Helpers shared by the corpus operators.

Conventions used by every operator here:

* An operator first projects the columns it needs under names of its own, so
  further columns of the input, whatever they are called, cannot clash.
* A document is known by ``(doc_id, text hash)``. Rows that repeat a document
  share its result; rows with one id but other texts stay apart. Keys are
  compared null-safely, so a null id is a key like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir
from ..shipping import ship

#: White space that separates words (space, tab, line feed, vertical tab, form feed, return).
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
#: A side of a join is broadcast only when its measured size is below this.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise reliably in the shared folder and cut the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind value to a lambda variable, so that it is evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a non-null text."""
    return let(F.btrim(text, F.lit(SPACE_CHARS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACES)))


def has_word(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS)) != ""


def digest_of(text: Column) -> Column:
    """Hash of a text that tells null from empty."""
    return F.xxhash64(text, text.isNull())


def same(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for a, b in keys:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def sized(df: DataFrame, row_bytes: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, a materialised table, marked for broadcast if it is measured to be
    small; otherwise unmarked, and the join shuffles (AQE splits hot keys)."""
    if row_bytes is None:
        width = sum((F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0)) if t.startswith(("array", "struct", "map", "string")) else F.lit(8)) for c, t in df.dtypes)
        total = df.agg(F.sum(width + F.lit(40))).first()[0] or 0
    else:
        total = df.count() * row_bytes
    return F.broadcast(df) if total <= limit else df


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 100_000) -> Iterator[pd.DataFrame]:
    """Batches sorted by keys, as frames that hold whole groups only."""
    held: list[pd.DataFrame] = []
    n = 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        n += len(b)
        if n >= rows:
            b = pd.concat(held, ignore_index=True)
            k = b[keys]
            differs = np.flatnonzero((k != k.iloc[-1]).any(axis=1).to_numpy())
            cut = int(differs[-1]) + 1 if len(differs) else 0
            if cut:
                yield b.iloc[:cut]
            held, n = [b.iloc[cut:]], len(b) - cut
    if n:
        yield pd.concat(held, ignore_index=True)


def ranked(df: DataFrame, order: Sequence[str], name: str) -> tuple[DataFrame, int]:
    """df with its gapless position (from 0) in the total order, and the number
    of rows. A range shuffle sorts; only one count for each partition is sent
    to the driver. order should be near unique, so that ranges can be cut."""
    done = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order))
    own = done.withColumn(name, F.monotonically_increasing_id())
    part = F.shiftright(name, 33)
    counts = sorted(own.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for at, n in counts:
        starts.append((at, total))
        total += n
    spark = df.sparkSession
    if not starts:
        return own.withColumn(name, F.lit(0).cast("long")), 0
    base = spark.createDataFrame(starts, "rl_part long, rl_start long")
    own = own.join(F.broadcast(base), part == F.col("rl_part"))
    low = F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    return own.withColumn(name, F.col("rl_start") + low).drop("rl_part", "rl_start"), total


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of long-valued links: (node, root), root being the
    smallest node reachable. Nodes without links are not listed.

    Alternating large-star and small-star rounds: each hangs a node's
    neighbours on the smallest of them, so paths shrink geometrically and only
    links are shuffled. Every round is checkpointed, which keeps lineage short
    and survives the loss of executors.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = checkpoint(e)
    mark = None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not now[0] or now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        mark = now
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # large-star: every larger neighbour of a node goes to its smallest neighbour
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        # small-star: a node and its smaller neighbours go to the smallest
        near = e.join(low, "u")
        e = near.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = checkpoint(e)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
