"""SimHash near-duplicates with bit-sliced comparison.

A text is lower-cased (A-Z) and split at white space; its shingles of three
words (repeats included; the whole sequence where there are fewer) are hashed
by XXH64 with seed 42, and a fingerprint bit is set where over half of the
hashes set it. Fingerprints with at most ``radius`` differing bits are linked,
and links are closed to components.

Only distinct fingerprints are compared. Cut into radius + p bands, two within
the radius agree on p bands at least, so each is sent, for every choice of p
bands, to the bucket of their bits; p is the least that keeps buckets small (it
grows with the logarithm of the number of fingerprints, so that comparisons do
not grow with its square). In a bucket, 64 fingerprints form a block that is
stored as bit planes: plane i holds bit i of all 64. A query is compared with a
whole block by XORing plane after plane and adding the mismatches to 64
vertical counters with carry-save logic; a block is abandoned once all its
counters exceed the radius. A bucket of more than ``chunk`` fingerprints is cut
by a hash into chunks, whose pairs are tasks of their own. A bucket reports
which of its members hang together, at most one row a member, never its pairs.

drop_near_duplicates can verify: of each group one row for each fingerprint is
compared with the one that stays, by the Jaccard similarity of their sets of
shingles, and goes only where it is ``similarity`` or more; a fingerprint keeps
one row in any case.

Defined cases: null or empty text, or one of white space alone, has
fingerprint 0 and links like any other; repeated rows share a result; a null id
is left out of the smallest id of a group unless the group has no other (then
null); a bit that exactly half of the hashes set is 0; long texts are hashed
whole, their bits counted in slices; an empty table gives an empty result;
other columns, whatever their names, pass through drop_near_duplicates and are
not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import checkpoint, components, digest_of, fresh, let, sized, whole_groups, words_of

SHINGLE = 3
RADIUS = 3
CHUNK = 2048
#: Fingerprints of a bucket, on average, from which on one more band is taken.
BUCKET = 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) > shingle:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    else:
        grams, n = [b" ".join(words)], 1
    ones, at = np.zeros(64, np.int64), 0
    h = np.fromiter(map(xxh64_intdigest, grams, repeat(42)), np.uint64, n)
    while at < n:  # bit counts of long texts in slices
        part = h[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        at += 65536
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


def shingle_set(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of the distinct shingles of a text, those that fingerprint() takes."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    some = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - shingle, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, shingle), " ")))
    return let(words_of(low), lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(some(w))))


def planes_of(prints: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bit planes (blocks, 64) of blocks of up to 64 fingerprints."""
    out = np.empty((len(first), 64), np.uint64)
    for at in range(0, len(first), 2048):
        f, s = first[at : at + 2048], size[at : at + 2048]
        rows = np.minimum(f[:, None] + np.arange(64), f[:, None] + s[:, None] - 1)
        bits = np.unpackbits(prints[rows].view(np.uint8).reshape(len(f), 64, 8), axis=2, bitorder="little")
        out[at : at + 2048] = np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]
    return out


def within(planes: np.ndarray, queries: np.ndarray, block: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each (query, block): the bits of the block's members within the radius."""
    width = max(1, radius.bit_length())
    live = np.arange(len(queries))
    near = np.zeros(len(queries), np.uint64)
    counters = [np.zeros(len(queries), np.uint64) for _ in range(width)]
    over = np.zeros(len(queries), np.uint64)
    q, b = queries, block
    for i in range(64):
        carry = planes[b, i] ^ (np.uint64(0) - ((q >> np.uint64(i)) & np.uint64(1)))
        for c in counters:
            carry, c[:] = c & carry, c ^ carry
        over |= carry
        if i % 8 == 7 and len(live):
            # counts over the radius that the counters can still hold
            more, equal = np.zeros(len(q), np.uint64), np.full(len(q), ALL)
            for k in reversed(range(width)):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    more |= equal & counters[k]
                    equal &= ~counters[k]
            over |= more
            stay = over != ALL
            if not stay.all():
                live, q, b, over = live[stay], q[stay], b[stay], over[stay]
                counters = [c[stay] for c in counters]
    near[live] = ~over
    return near


def linked(prints: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of linked members; group is sorted."""
    n = len(prints)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    blocks = -(-sizes // 64)
    offset = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = np.repeat(starts, blocks) + 64 * offset
    size = np.minimum(64, np.repeat(starts + sizes, blocks) - first)
    planes = planes_of(prints, first, size)
    block0 = np.repeat(np.cumsum(blocks) - blocks, sizes)  # first block of each row's group
    own = block0 + (np.arange(n) - np.repeat(starts, sizes)) // 64
    last = block0 + np.repeat(blocks, sizes) - 1
    times = last - own + 1
    out_i, out_j = [], []
    ends = np.cumsum(times)
    at = 0
    while at < n:  # a few million (query, block) pairs at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000, side="right")))
        i = np.repeat(np.arange(at, to), times[at:to])
        blk = np.arange(len(i)) - np.repeat(ends[at:to] - times[at:to] - (ends[at - 1] if at else 0), times[at:to]) + own[i]
        near = within(planes, prints[i], blk, radius)
        hit = np.flatnonzero(near)
        row, bit = np.nonzero(np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        j = first[blk[hit[row]]] + bit
        ok = (bit < size[blk[hit[row]]]) & (j > i[hit[row]])
        out_i.append(i[hit[row]][ok])
        out_j.append(j[ok])
        at = to
    return np.concatenate(out_i), np.concatenate(out_j)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of n positions."""
    at = np.arange(n)
    while True:
        low = np.minimum(at[i], at[j])
        new = at.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, at[i], low)
        np.minimum.at(new, at[j], low)
        new = new[new]
        if (new == at).all():
            return at
        at = new


def _stars(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by key; whole groups are compared as they complete."""
        def done(b: pd.DataFrame) -> pd.DataFrame:
            k = b[["band", "value", "c1", "c2"]].to_numpy()
            group = np.cumsum(np.r_[True, (k[1:] != k[:-1]).any(axis=1)]) if len(k) else np.empty(0, np.int64)
            one = np.r_[True, group[1:] != group[:-1]] & np.r_[group[1:] != group[:-1], True]  # alone in its bucket
            p, group = b["fp"].to_numpy(np.int64)[~one].view(np.uint64), group[~one]
            i, j = linked(p, group, radius)
            root = roots(len(p), i, j)
            own = np.flatnonzero(root != np.arange(len(p)))
            s = p.view(np.int64)
            return pd.DataFrame({"a": s[own], "b": s[root[own]]}).drop_duplicates()

        yield from map(done, whole_groups(batches, ["band", "value", "c1", "c2"]))

    return run


def keys_of(fp: Column, radius: int, n: int) -> Column:
    """Array of (band, value): the buckets of a fingerprint among n."""
    p = 1
    while p < 4 and n >> 64 * p // (radius + p) > BUCKET:
        p += 1
    edges = [64 * k // (radius + p) for k in range(radius + p + 1)]
    out = []
    for band, chosen in enumerate(combinations(range(radius + p), p)):
        value, width = F.lit(0).cast("long"), 0
        for k in chosen:
            size = edges[k + 1] - edges[k]
            value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << size) - 1)), width))
            width += size
        out.append(F.struct(F.lit(band).alias("band"), value.alias("value")))
    return F.array(*out)


def near_fingerprints(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` of prints
    exactly as all pairs within the radius would."""
    ship(prints.sparkSession)
    keyed = prints.select("fp", F.inline(keys_of(F.col("fp"), radius, prints.count())))
    big = keyed.groupBy("band", "value").count().where(F.col("count") > chunk)
    big = checkpoint(big.select(F.col("band").alias("g_band"), F.col("value").alias("g_value"), F.ceil(F.col("count") / (0.75 * chunk)).cast("int").alias("cuts")))
    keyed = keyed.join(sized(big, 32), (F.col("band") == F.col("g_band")) & (F.col("value") == F.col("g_value")), "left")
    cuts = F.coalesce("cuts", F.lit(1))
    own = F.pmod(F.xxhash64("fp", "band"), cuts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), cuts - 1), lambda c: F.struct(F.least(c, own).alias("c1"), F.greatest(c, own).alias("c2")))
    keyed = keyed.select("fp", "band", "value", F.inline(pairs))
    keys = ["band", "value", "c1", "c2"]
    return keyed.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInPandas(_stars(radius), "a long, b long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, chunk: int = CHUNK, shingle: int = SHINGLE) -> DataFrame:
    """(id, th, fp, root, component_id) for every row; root: a fingerprint
    that stands for the group."""
    ship(docs.sparkSession)
    rows = checkpoint(docs.select(F.col(id_col).alias("id"), digest_of(F.col(text_col)).alias("th"), fingerprints(F.col(text_col), shingle).alias("fp")))
    prints = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("low")))
    links = near_fingerprints(prints.select("fp"), radius, chunk)
    root = components(links)
    known = prints.join(root, prints["fp"] == root["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("low").alias("component_id"))
    known = checkpoint(known.join(least, "root").select(F.col("fp").alias("k_fp"), "root", "component_id"))
    return rows.join(sized(known, 48), rows["fp"] == F.col("k_fp")).select("id", "th", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    found = grouped(docs, id_col, text_col, radius, chunk)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _kept(found: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float | None) -> DataFrame:
    """(rl_id, rl_th, n): the rows that stay, by id and text hash, and how often
    each is there. found: as by grouped()."""
    same = found["id"].eqNullSafe(found["component_id"])
    if similarity is None:
        return found.where(same).groupBy("root").agg(F.min(F.struct("id", "th")).alias("k"), F.count("*").alias("n")).select(F.col("k.id").alias("rl_id"), F.col("k.th").alias("rl_th"), "n")
    # null ids come last here, as min(id) passes over them
    order = F.struct(F.col("id").isNull().alias("last"), "id", "th")
    leads = found.groupBy("root", "fp").agg(F.min(order).alias("k"), F.count("*").alias("n"))
    leads = checkpoint(leads.select("root", "fp", "k", "n"))
    tops = leads.groupBy("root").agg(F.min("k").alias("top"), F.count("*").alias("prints")).where("prints > 1")
    both = checkpoint(leads.join(sized(checkpoint(tops), 96), "root").select("root", "fp", "k", (F.col("k") == F.col("top")).alias("stays")))
    own = both.select(F.col("k.id").alias("v_id"), F.col("k.th").alias("v_th"), "root", "fp", "stays")
    texts = docs.select(F.col(id_col).alias("t_id"), digest_of(F.col(text_col)).alias("t_th"), F.col(text_col).alias("text"))
    texts = texts.join(sized(own, 64), F.col("t_id").eqNullSafe(F.col("v_id")) & (F.col("t_th") == F.col("v_th")))
    sets = checkpoint(texts.select("root", "fp", "stays", shingle_set(F.col("text"), shingle).alias("s")).dropDuplicates(["root", "fp"]))
    first = sets.where("stays").select("root", F.col("s").alias("first"))
    alike = sets.where("not stays").join(sized(first), "root")
    union = F.size(F.array_union("s", "first"))
    alike = alike.where((union == 0) | (F.size(F.array_intersect("s", "first")) >= similarity * union))
    gone = checkpoint(alike.select(F.col("fp").alias("g_fp")))
    stay = leads.join(sized(gone, 16), F.col("fp") == F.col("g_fp"), "left_anti")
    return stay.select(F.col("k.id").alias("rl_id"), F.col("k.th").alias("rl_th"), "n")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, chunk: int = CHUNK, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """docs with one row of each group: that of the smallest id (of rows that
    repeat it, the one of the smallest text hash); with a similarity, also one
    row of each fingerprint whose shingles are less alike to that row's. Same
    columns."""
    found = grouped(docs, id_col, text_col, radius, chunk, shingle)
    keep = checkpoint(_kept(found, docs, id_col, text_col, shingle, similarity))
    box = fresh(docs, "row")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(box), digest_of(docs[text_col]).alias("t_th"))
    whole = whole.join(sized(keep, 48), F.col(box)[id_col].eqNullSafe(F.col("rl_id")) & (F.col("t_th") == F.col("rl_th")))
    out = [F.col(box)[c].alias(c) for c in docs.columns]
    single = whole.where("n = 1").select(*out)
    # rows that repeat the kept document; few, as each shares id and text
    repeated = whole.where("n > 1").groupBy("rl_id", "rl_th").agg(F.first(box).alias(box)).select(*out)
    return single.unionByName(repeated)
