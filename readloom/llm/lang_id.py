"""Language identification with a bit-sliced Bloom filter of n-grams.

Training keeps, for every language, the character n-grams that are typical of
it: those that occur ``min_count`` times, make up ``min_gram_share`` of the
language's n-grams, and whose share is at least ``min_share`` of the largest
share that any language gives them.
All languages use one table: row i holds, as bits, the languages whose
filter has bit i set. An n-gram's k rows ANDed together give every language
that (probably) holds it in one look-up. For a text, the bits are counted by
language; with n n-grams and a language's false-positive rate f, the count c
becomes (c - n f) / (1 - f). The language with the largest corrected count
wins, and that count over n is the score.

Training counts n-grams over a sample of labelled documents, at most about
``sample_docs`` a language, taken by a hash of the id. N-grams are counted and
compared, and the filters merged, on the executors; the driver gets the merged
rows, 2**bits of 8 bytes for each 64 languages. The least share bounds the
n-grams of a language (to its inverse), so that ``bits`` keeps its filter thin.

Defined cases: null text, or one without a letter, is ``und`` with score 0; a
text with letters of which no n-gram is known gets the label of most training
rows, with score 0; rows with a null label do not train; without any training
row everything is ``und``; ties go to the alphabetically first language; long
texts are read whole; repeated rows share a result; an empty table gives an
empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import checkpoint, sized

N = 4
HASHES = 3
BITS = 20
SAMPLE_DOCS = 1500
MIN_GRAM_SHARE = 1e-5
MIN_COUNT = 3
MIN_SHARE = 0.2
UND = "und"
_MULTIPLY = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _letter_table() -> np.ndarray:
    """By code point: is it a letter (Unicode category L)?"""
    import unicodedata

    out = np.zeros(sys.maxunicode + 1, dtype=bool)
    out[[i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i))[0] == "L"]] = True
    return out


_TABLE: list[np.ndarray] = []


def grams(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of all letter n-grams of the texts, with a space for each
    run of non-letters, and the text that each came from."""
    if not _TABLE:
        _TABLE.append(_letter_table())
    low = [f" {t.lower()} " for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(t) for t in low])
    letter = _TABLE[0][code]
    keep = letter.copy()
    keep[0:1] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])  # the first of a run of other characters
    code, letter, owner = np.where(letter, code, 32)[keep].astype(np.uint64), letter[keep], owner[keep]
    if len(code) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    m = len(code) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h *= np.uint64(1_000_003)
        h += code[k : k + m]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # inside one text, and no space but at an end
    fit = owner[:m] == owner[n - 1 :]
    for k in range(1, n - 1):
        fit &= letter[k : k + m]
    return h[fit], owner[:m][fit]


def _slots(h: np.ndarray, bits: int, hashes: int) -> Iterator[np.ndarray]:
    for k in range(hashes):
        yield ((h * np.uint64(_MULTIPLY[k])) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    rows: np.ndarray
    rates: np.ndarray
    bits: int
    hashes: int
    n: int
    usual: int = 0  # the label of most training rows

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        some = [i for i, t in enumerate(texts) if t]
        names, scores = [UND] * len(texts), np.zeros(len(texts))
        if not some or not self.langs:
            return names, scores
        h, owner = grams([texts[i] for i in some], self.n)
        mask = np.full((len(h), self.rows.shape[1]), np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in _slots(h, self.bits, self.hashes):
            mask &= self.rows[at]
        total = np.bincount(owner, minlength=len(some)).astype(float)
        count = np.stack([np.bincount(owner, weights=((mask[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).astype(float), minlength=len(some)) for j in range(len(self.langs))], axis=1)
        right = np.clip((count - total[:, None] * self.rates) / (1 - self.rates), 0, None)
        best = right.argmax(axis=1)
        for j, i in enumerate(some):
            if total[j] and right[j, best[j]] > 0:
                names[i], scores[i] = self.langs[best[j]], min(1.0, right[j, best[j]] / total[j])
            elif any(map(str.isalpha, texts[i])):  # no n-gram, or none that is known
                names[i] = self.langs[self.usual]
        return names, scores


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, min_gram_share: float = MIN_GRAM_SHARE, min_count: int = MIN_COUNT, min_share: float = MIN_SHARE, bits: int = BITS, hashes: int = HASHES, n: int = N) -> Model:
    """labelled: (key, text, lang); rows with a null in text or lang are left out."""
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    langs = tuple(sorted(sizes))
    table = np.zeros((1 << bits, max(1, -(-len(langs) // 64))), np.uint64)
    if not langs:
        return Model(langs, table, np.empty(0), bits, hashes, n)
    unit = F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1_000_000)) / 1_000_000
    take = spark.createDataFrame([(x, min(1.0, sample_docs / size)) for x, size in sizes.items()], "lang string, take double")
    picked = rows.join(sized(take), "lang").where(unit < F.col("take")).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, own in b.groupby("lang"):
                code, times = np.unique(grams(list(own["text"]), n)[0], return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": code.view(np.int64), "times": times})

    found = checkpoint(picked.mapInPandas(count, "lang string, gram long, times long").groupBy("lang", "gram").agg(F.sum("times").alias("times")))
    totals = {r["lang"]: r["total"] for r in found.groupBy("lang").agg(F.sum("times").alias("total")).collect()}  # a row for each language
    each = spark.createDataFrame([(x, k, totals.get(x, 0)) for k, x in enumerate(langs)], "lang string, place int, total long")
    found = found.where(F.col("times") >= min_count).join(sized(each), "lang").withColumn("share", F.col("times") / F.col("total")).where(F.col("share") >= min_gram_share)
    top = F.max("share").over(Window.partitionBy("gram"))
    typical = found.withColumn("top", top).where(F.col("share") >= min_share * F.col("top")).select("gram", "place")

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            place = b["place"].to_numpy(np.int64)
            mask = (np.uint64(1) << (place % 64).astype(np.uint64)).view(np.int64)
            for slot in _slots(b["gram"].to_numpy(np.int64).view(np.uint64), bits, hashes):
                yield pd.DataFrame({"slot": slot, "word": place // 64, "mask": mask})

    merged = typical.mapInPandas(lay, "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table[merged["slot"].to_numpy(), merged["word"].to_numpy()] = merged["mask"].to_numpy().view(np.uint64)
    fill = np.array([((table[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).mean() for j in range(len(langs))])
    usual = min(range(len(langs)), key=lambda j: (-sizes[langs[j]], j))
    return Model(langs, table, np.minimum(fill**hashes, 0.999), bits, hashes, n, usual)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 3 == 1


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Struct (lang_pred, score) for a text column."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2**bits rows

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        names, scores, values = [], [], list(texts)
        at, size = 0, 0
        for i, t in enumerate([*values, None]):  # slices of about a million characters
            size += len(t or "")
            if size > 1_000_000 or i == len(values):
                a, b = shared.value.predict(values[at : i + 1])
                names, scores, at, size = names + a, [*scores, b], i + 1, 0
        return pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores) if scores else np.empty(0)})

    return of(F.col(text_col))


def model_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Model:
    """A model from the labelled rows that are not held out."""
    rows = docs.where(~held_out(F.col(id_col))).select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return train(rows, **options)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    model = model_of(docs, id_col, text_col, lang_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(rows, model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
