"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c lie at squared distance 2 - 2c. A rotation leaves
distances as they are; it is fitted (principal axes) on a bounded sample and
deals the axes out over ``blocks`` blocks of equal size. If two vectors are
within d2, some block is within its share d2 / blocks, so each block gives a
range join under that budget:

* The first ``grid`` coordinates of a block are cut into cells. With r the
  square root of the budget, a vector goes to each cell that its range
  [x - r, x] touches; a pair is examined in the cell that holds the smaller
  coordinate of the two in each direction, where both are present.
* In a cell the block distances are screened against the budget, and only pairs
  within it are verified by the cosine of the whole vectors in double
  precision. A pair counts in the first block that finds it, so the union of
  candidates has each pair once.

Vectors that are equal are joined first and carried as one with a weight. A
cell of more than ``chunk`` vectors is cut by a hash into chunks whose pairs
are tasks of their own. A task gives each member its number of links and what
it hangs together with: at most two rows a member, never its pairs.

Defined cases: only rows of equal, non-null labels are compared; a vector that
is null, empty, zero, or holds a null or non-finite component links with
nothing; vectors of other lengths than another's are not compared with it;
rows that repeat a vec_id count as other vectors; a null vec_id is kept, as a
component of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import checkpoint, components, sized, whole_groups
from .simhash import roots

COSINE = 0.93
BLOCKS = 8
GRID = 2
CHUNK = 2048
SAMPLE = 4000
SLACK = 1e-6  # on budgets, for rounding; the cosine itself is exact
ROUNDING = 1e-9  # on coordinates and distances from matrix products


def rotation(sample: np.ndarray, blocks: int) -> np.ndarray:
    """Orthonormal columns: principal axes dealt out over blocks, so that each
    block gets a like share of the variance."""
    dims = sample.shape[1]
    cov = sample.T @ sample if len(sample) else np.eye(dims)
    _, axes = np.linalg.eigh(cov)
    axes = axes[:, ::-1]
    return np.concatenate([axes[:, k::blocks] for k in range(blocks)], axis=1)


def block_sizes(dims: int, blocks: int) -> list[int]:
    return [len(range(k, dims, blocks)) for k in range(blocks)]


def links_of(x: np.ndarray, rot: np.ndarray, corner: np.ndarray, block: int, edges: list[int], budget: np.ndarray, cosine: float, two: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j), i < j, among members x (rows as given) of one cell of one
    block that belong to this cell and are not found by an earlier block.
    corner: for each member, a bit for each direction in which it is here by its
    lower cell; a pair belongs to the cell where no bit is set in both. two:
    chunk of each member, if only pairs across two chunks are wanted.

    Matrix products differ in their last bits from batch to batch, so they only
    screen, with slack; the block that counts a pair is told from sums in one
    fixed order, which come out the same in every cell."""
    n = len(x)
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    y = unit @ rot
    own = y[:, edges[block] : edges[block + 1]]
    sq = (own * own).sum(axis=1)
    fixed: dict[int, np.ndarray] = {}

    def rotated(k: int) -> np.ndarray:
        if k not in fixed:
            fixed[k] = (unit[k][:, None] * rot).sum(axis=0)
        return fixed[k]

    out_i, out_j = [], []
    for at in range(0, n, 512):
        to = min(n, at + 512)
        near = sq[at:to, None] + sq[None, at:] - 2 * own[at:to] @ own[at:].T <= budget[block] + ROUNDING
        i, j = np.nonzero(near)
        i, j = i + at, j + at
        ok = i < j
        if two is not None:
            ok &= two[i] != two[j]
        i, j = i[ok], j[ok]
        ok = corner[i] & corner[j] == 0  # pairs of this cell
        i, j = i[ok], j[ok]
        for b in range(block):  # those that an earlier block finds beyond doubt
            d = y[i, edges[b] : edges[b + 1]] - y[j, edges[b] : edges[b + 1]]
            ok = (d * d).sum(axis=1) > budget[b] - ROUNDING
            i, j = i[ok], j[ok]
        if len(i):
            dot = (x[i] * x[j]).sum(axis=1) / (np.sqrt((x[i] * x[i]).sum(axis=1)) * np.sqrt((x[j] * x[j]).sum(axis=1)))
            i, j = i[dot >= cosine], j[dot >= cosine]
        if len(i):
            d = np.stack([rotated(k) for k in i.tolist()]) - np.stack([rotated(k) for k in j.tolist()])
            near = np.stack([(d[:, edges[b] : edges[b + 1]] ** 2).sum(axis=1) <= budget[b] for b in range(block + 1)], axis=1)
            ok = near[:, block] & ~near[:, :block].any(axis=1)  # found here, by no earlier block
            out_i.append(i[ok])
            out_j.append(j[ok])
    none = np.empty(0, np.int64)
    return np.concatenate(out_i) if out_i else none, np.concatenate(out_j) if out_j else none


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, blocks: int = BLOCKS, grid: int = GRID, chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda e: e != 0) & F.col("label").isNotNull()
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    key = F.when(F.col("good"), F.struct("label", F.col("v").cast("array<double>").alias("v")))
    used = rows.where("good").select("id", key.alias("k"))
    # equal vectors as one; -0.0 and 0.0 are the same number to both sides of a group
    classes = used.groupBy("k").agg(F.count("*").alias("weight"), F.min("id").alias("low"))
    classes = checkpoint(classes.select(F.monotonically_increasing_id().alias("c"), "k.label", "k.v", "weight", "low"))
    members = _members(classes, cosine, blocks, grid, chunk, sample)
    found = checkpoint(members)
    count = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    root = components(found.where("b is not null"))
    own = classes.join(count, classes["c"] == count["a"], "left").join(root, classes["c"] == root["node"], "left")
    own = own.select("label", "v", "weight", "low", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "c").alias("root"))
    least = own.groupBy("root").agg(F.min("low").alias("component_id"))
    known = own.join(least, "root").select(F.struct("label", "v").alias("k"), (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id")
    known = checkpoint(known)
    linked = rows.withColumn("k", key).join(known.withColumnRenamed("k", "r_k"), F.col("k") == F.col("r_k"), "left")
    out = linked.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("good"), F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _members(classes: DataFrame, cosine: float, blocks: int, grid: int, chunk: int, sample: int) -> DataFrame:
    """(a, b, n): n links of class a where b is null, else a hangs together with b."""
    spark = classes.sparkSession
    sizes = [r[0] for r in classes.select(F.size("v")).distinct().limit(2).collect()]
    if len(sizes) == 2:  # each length has a rotation of its own
        every = [r[0] for r in classes.select(F.size("v")).distinct().collect()]
        parts = [_members(classes.where(F.size("v") == d), cosine, blocks, grid, chunk, sample) for d in every]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out
    dims = sizes[0] if sizes else 1
    blocks = min(blocks, dims)
    # a bounded sample, by hash, for the rotation alone
    seen = classes.orderBy(F.xxhash64("v")).limit(sample).select("v").collect()
    rows = np.array([r["v"] for r in seen], float).reshape(len(seen), dims)
    rot = rotation(rows / np.sqrt((rows * rows).sum(axis=1))[:, None] if len(rows) else rows, blocks)
    edges = np.concatenate([[0], np.cumsum(block_sizes(dims, blocks))]).tolist()
    d2 = 2 - 2 * cosine
    budget = np.array([d2 / blocks + SLACK] * blocks)
    r = math.sqrt(float(budget[0]))
    width = 1.5 * r
    g = min(grid, min(block_sizes(dims, blocks)))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            v = np.stack(b["v"].to_numpy()).astype(float)
            y = v / np.sqrt((v * v).sum(axis=1))[:, None] @ rot
            at, block, corners, cells = [], [], [], []
            for k in range(blocks):
                z = y[:, edges[k] : edges[k] + g]
                hi, lo = np.floor(z / width).astype(np.int64), np.floor((z - r - ROUNDING) / width).astype(np.int64)
                for corner in range(2**g):
                    pick = np.array([corner >> i & 1 for i in range(g)], bool)
                    ok = ((hi != lo) | ~pick).all(axis=1)  # the lower cell only where it differs
                    at.append(np.flatnonzero(ok))
                    block.append(np.full(int(ok.sum()), k))
                    corners.append(np.full(int(ok.sum()), corner))
                    cells.append(np.where(pick, lo, hi)[ok])
            at = np.concatenate(at)
            cell = np.concatenate(cells)
            yield pd.DataFrame({"c": b["c"].to_numpy()[at], "label": b["label"].to_numpy()[at], "block": np.concatenate(block), "corner": np.concatenate(corners), "cell": list(map(list, cell.tolist()))})

    slim = classes.select("c", "label", "v").mapInPandas(deal, "c long, label string, block int, corner int, cell array<long>")
    keyed = checkpoint(slim)
    keys = ["label", "block", "cell"]
    big = keyed.groupBy(*keys).count().where(F.col("count") > 1)
    big = checkpoint(big.select(*[F.col(k).alias(f"g_{k}") for k in keys], F.ceil(F.col("count") / chunk).cast("int").alias("cuts")))
    keyed = keyed.join(sized(big, 96), (F.col("label") == F.col("g_label")) & (F.col("block") == F.col("g_block")) & (F.col("cell") == F.col("g_cell")))
    own = F.pmod(F.xxhash64("c"), F.col("cuts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: F.struct(F.least(k, own).alias("c1"), F.greatest(k, own).alias("c2")))
    keyed = keyed.select("c", "corner", *keys, own.alias("own"), F.inline(pairs))
    # vectors travel once to each cell and chunk pair
    whole = keyed.join(classes.select("c", F.col("v").cast("array<float>").alias("f"), F.when(F.col("v").cast("array<float>").cast("array<double>") != F.col("v"), F.col("v")).alias("v"), "weight"), "c")
    group = F.concat_ws("|", "block", "c1", "c2", F.array_join(F.col("cell").cast("array<string>"), ","), "label")
    whole = whole.withColumn("group", group).drop("label")

    def compare(b: pd.DataFrame) -> pd.DataFrame | None:
        x = np.stack([f if v is None else v for f, v in zip(b["f"], b["v"], strict=True)]).astype(float)
        block = int(b["block"].iloc[0])
        two = b["own"].to_numpy() if b["c1"].iloc[0] != b["c2"].iloc[0] else None
        i, j = links_of(x, rot, b["corner"].to_numpy(), block, edges, budget, cosine, two)
        if not len(i):
            return None
        c, w = b["c"].to_numpy(np.int64), b["weight"].to_numpy(float)
        n = np.bincount(i, weights=w[j], minlength=len(c)) + np.bincount(j, weights=w[i], minlength=len(c))
        root = roots(len(c), i, j)
        some, hang = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(c)))
        none = lambda k: pd.array([None] * k, "Int64")
        return pd.concat([pd.DataFrame({"a": c[some], "b": none(len(some)), "n": pd.array(n[some].astype(np.int64), "Int64")}), pd.DataFrame({"a": c[hang], "b": pd.array(c[root[hang]], "Int64"), "n": none(len(hang))})])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, ["group"], 20_000):
            starts = np.flatnonzero(np.r_[True, b["group"].to_numpy()[1:] != b["group"].to_numpy()[:-1], True])
            out = [o for lo, hi in zip(starts, starts[1:], strict=False) if hi - lo > 1 and (o := compare(b.iloc[lo:hi])) is not None]
            if out:
                yield pd.concat(out)

    return whole.repartition("group").sortWithinPartitions("group", "c").mapInPandas(run, "a long, b long, n long")
