"""Sequence packing by length patterns and non-negative least squares.

Documents are encoded and end with an id of their own; only those over
``size`` ids are cut, into pieces of ``size`` (the first piece takes what is
over). The pieces' lengths make a histogram of at most ``size`` counts, the
only thing sent to the driver. There

1. all patterns of up to ``max_docs`` lengths that fill a sequence exactly are
   listed, and their repeat counts are fitted to the histogram by non-negative
   least squares (accelerated projected gradient);
2. the counts are rounded down and limited to the pieces there are (rounding
   down leaves a mixture of lengths that still packs well);
3. the rest is packed best-fit, longest first, over the histogram.

The result is a list of runs: so many sequences of one pattern. Pieces are put
in one global order by length (a range shuffle of narrow rows, so a length that
many pieces share is split), and a piece's place in that order gives its run,
sequence and offset. Texts are never shuffled.

Defined cases: null text is empty and has the end id alone; a null id is kept;
repeated rows each have pieces; pieces of equal length, the ties of the order,
go by id, text hash and place; an empty table gives an empty result; a long
text gives as many pieces as it needs; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import checkpoint, digest_of, ranked
from .tokens import encoder

SIZE = 1024
MAX_DOCS = 3
END_ID = 2
ROUNDS = 200

Run = tuple[tuple[int, ...], int]  # lengths in one sequence, number of sequences


def patterns(have: np.ndarray, size: int, max_docs: int = MAX_DOCS) -> np.ndarray:
    """Rows of up to max_docs lengths (descending, then zeros) that sum to size,
    of lengths that occur."""
    some = np.flatnonzero(have)
    some = some[some > 0]
    held = np.zeros(size + 1, bool)
    held[some] = True
    found, open_ = [], some[some <= size][:, None].astype(np.int64)
    for depth in range(max_docs):
        left = size - open_.sum(axis=1)
        done = open_[left == 0]
        found.append(np.pad(done, ((0, 0), (0, max_docs - open_.shape[1]))))
        open_, left = open_[left > 0], left[left > 0]
        if depth == max_docs - 1 or not len(open_):
            break
        if depth == max_docs - 2:  # the last length is what is left
            ok = (left <= open_[:, -1]) & held[np.minimum(left, size)]
            open_ = np.column_stack([open_[ok], left[ok]])
            continue
        grown = [np.column_stack([np.repeat(open_[i : i + 1], m, axis=0), c[:m]]) for i in range(len(open_)) if (m := int(np.searchsorted(c := some, min(left[i], open_[i, -1]), side="right")))]
        open_ = np.concatenate(grown) if grown else open_[:0]
    return np.concatenate(found) if found else np.empty((0, max_docs), np.int64)


def fit(pats: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that minimises ||A x - counts||, A[l, p] being how often length l
    is in pattern p."""
    if not len(pats):
        return np.empty(0)
    live = pats > 0
    times = lambda x: np.bincount(pats.ravel(), weights=(x[:, None] * live).ravel(), minlength=len(counts))
    back = lambda r: (r[pats] * live).sum(axis=1)
    v = np.ones(len(pats))
    for _ in range(30):  # largest eigenvalue of A'A
        v = back(times(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(times(y) - counts) / (1.01 * top))
        if (y - new) @ (new - x) > 0:  # restart where momentum leads uphill
            t = 1.0
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / nt * (new - x), nt
    return x


def best_fit(left: np.ndarray, size: int) -> list[Run]:
    """Best-fit decreasing over a histogram: bins alike are kept as one run."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}  # free space -> content -> bins

    def put(free: int, content: tuple[int, ...], n: int) -> None:
        own = bins.setdefault(free, {})
        own[content] = own.get(content, 0) + n

    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            free = min((s for s in bins if s >= length), default=None)
            if free is None:
                each = size // length
                full, rest = divmod(n, each)
                if full:
                    put(size - each * length, (length,) * each, full)
                if rest:
                    put(size - rest * length, (length,) * rest, 1)
                n = 0
                continue
            content, have = bins[free].popitem()
            use = min(n, have)
            if have > use:
                bins[free][content] = have - use
            if not bins[free]:
                del bins[free]
            put(free - length, (*content, length), use)
            n -= use
    return [(c, n) for own in bins.values() for c, n in own.items()]


def plan(counts: np.ndarray, size: int = SIZE, max_docs: int = MAX_DOCS) -> list[Run]:
    """Runs that hold counts[l] pieces of each length l."""
    left = np.array(counts, dtype=np.int64)
    runs: list[Run] = []
    if left[size]:
        runs.append(((size,), int(left[size])))
        left[size] = 0
    pats = patterns(left, size, max_docs)
    x = fit(pats, left.astype(float))
    whole = np.floor(x).astype(np.int64)
    for p in np.flatnonzero(whole).tolist():
        content = tuple(c for c in pats[p].tolist() if c)
        n = min(int(whole[p]), *(int(left[c]) // content.count(c) for c in content))
        if n:
            runs.append((content, n))
            for c in content:
                left[c] -= n
    return runs + best_fit(left, size)


def placed(runs: list[Run], counts: np.ndarray) -> pd.DataFrame:
    """Runs by place in the global order by length: each row (g, sequence_id,
    offset) holds from place g on, sequence rising by one with each place."""
    first = np.cumsum(counts) - counts
    used, rows, base = np.zeros(len(counts), np.int64), [], 0
    for content, n in runs:
        at = 0
        for c in content:
            rows.append((int(first[c] + used[c]), base, at))
            used[c] += n
            at += c
        base += n
    if not (used == counts).all():
        raise AssertionError("the plan does not hold every piece")
    return pd.DataFrame(rows, columns=["g", "sequence_id", "offset"]).sort_values("g", ignore_index=True)


def pieces(docs: DataFrame, tokenizer: str, kind: str = "byte", size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, piece, start, length, ids_crc32) of every document."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, last = encoder(tokenizer, kind), end_id.to_bytes(4, "little")
        for b in batches:
            rows = []
            for key, th, text in zip(b["id"], b["th"], b["text"], strict=True):
                ids = code.ids(text) + last
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    to = at + (size if at or n <= size else n % size or size)
                    to = min(to, n)
                    rows.append((key, th, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at, k = to, k + 1
            yield pd.DataFrame(rows, columns=["id", "th", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), digest_of(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(cut, "id string, th long, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", "doc_id")


def packed(docs: DataFrame, tokenizer: str, kind: str = "byte", size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    # kept, since ranking needs it twice and encoding is the dear part
    cut = checkpoint(pieces(docs, tokenizer, kind, size, end_id, id_col, text_col))
    counts = np.zeros(size + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most size rows
        counts[r["length"]] = r["count"]
    where = placed(plan(counts, size, max_docs), counts)
    own, _ = ranked(cut, ["length", "doc_id", "th", "piece", "start"], "g")
    shared = docs.sparkSession.sparkContext.broadcast(where.to_numpy(np.int64))  # a row for each length of each run

    def find(g: pd.Series) -> pd.DataFrame:
        t = shared.value
        at = np.searchsorted(t[:, 0], g.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": t[at, 1] + g.to_numpy() - t[at, 0], "offset": t[at, 2]})

    own = own.withColumn("p", F.pandas_udf(find, "sequence_id long, offset long")("g"))
    return own.select("doc_id", "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset")
