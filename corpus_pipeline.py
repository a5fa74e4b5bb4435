"""Corpus pipeline: quality rules, language ID, line de-duplication, SimHash
near-duplicates, best-fit packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last keep the
columns of ``documents``; the last gives the packed pieces.

Defined cases, for every stage: a null or empty text, or one without a word or
a letter, goes (it fails the quality rules; later stages treat it alike); a
null doc_id is kept like any other, and sorts first among ties; rows that
repeat a document (id and text) share its decisions, and one of them stays
after the near-duplicate stage; of documents that tie, the smallest id stays
(then the smallest text hash); an empty table gives an empty result; texts are
read whole, however long; further columns pass through up to the last stage,
whatever their names, and ``n_chars``, where there is one, follows the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import lang_id, line_dedup, packing, quality_rules, simhash
from readloom.llm.common import fresh, shared_dir, table

#: Share of a text's n-grams that its language must hold.
MIN_LANG_SCORE = 0.2
#: Words of a shingle, differing bits and similarity of near-duplicates.
NEAR_WORDS = 5
NEAR_BITS = 6
NEAR_SIMILARITY = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without over-frequent lines."""
    return quality_rules.quality_filter(docs, chars_col="n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: a letter, and a score of MIN_LANG_SCORE."""
    model = lang_id.model_of(docs)
    box = fresh(docs, "p")
    marked = docs.withColumn(box, lang_id.predicted(docs, model))
    return marked.where((F.col(box)["lang_pred"] != lang_id.UND) & (F.col(box)["score"] >= MIN_LANG_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of lines; those left without a word go."""
    cut = line_dedup.dedup_lines(docs)
    text = F.coalesce("text", F.lit(""))
    cut = cut.where(text.rlike(r"[^\x20\x09-\x0D]"))
    return cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints of five-word
    shingles within NEAR_BITS, verified by the similarity of the shingles."""
    return simhash.drop_near_duplicates(docs, radius=NEAR_BITS, shingle=NEAR_WORDS, similarity=NEAR_SIMILARITY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 ids."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("best_fit_packing", pack),
]
#: Hash fingerprints and token ids are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each through a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}_{name}")
        docs = spark.read.parquet(f"{top}/{k}_{name}")
    return docs
