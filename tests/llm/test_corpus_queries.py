"""Registered corpus queries: SQL parity and the pipeline."""

from __future__ import annotations

import os

import corpus_pipeline
import duckdb
import pytest

from readloom.llm import lang_id, line_dedup, queries, quality_rules, simhash
from readloom.llm.common import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name]).to_arrow_table().to_pylist()
    cols = sorted(got.columns)
    assert sorted(repr([r[c] for c in cols]) for r in got.collect()) == sorted(repr([r[c] for c in cols]) for r in want)


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]


def brute_near(texts: dict[int, str]) -> set[int]:
    """Ids that stay: groups of fingerprints by all pairs; of each group the
    least id, and the least of each fingerprint that is less than 0.8 like it."""
    radius, shingle = corpus_pipeline.NEAR_BITS, corpus_pipeline.NEAR_WORDS
    prints = {k: simhash.fingerprint(t, shingle) for k, t in texts.items()}
    lead: dict[int, int] = {}
    for k in sorted(texts):
        lead.setdefault(prints[k], k)
    up = {p: p for p in lead}

    def find(p):
        while up[p] != p:
            p = up[p]
        return p

    every = list(lead)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                up[find(a)] = find(b)
    top: dict[int, int] = {}
    for p, k in lead.items():
        top[find(p)] = min(top.get(find(p), k), k)

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))}

    alike = lambda a, b: len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b))
    return {k for p, k in lead.items() if k == top[find(p)] or not alike(texts[k], texts[top[find(p)]])}


def test_near_duplicates_verified(spark):
    import random

    rng = random.Random(11)
    texts = {}
    for g in range(40):
        w = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([30, 120, 400]))]
        for k in range(6):
            own = w.copy()
            for _ in range(rng.choice([0, 0, 1, 2, 4, 12])):
                own[rng.randrange(len(own))] = f"w{rng.randrange(4000)}"
            texts[100 * g + k] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for bucket in (simhash.BUCKET, 0):  # with more bands as well
        old, simhash.BUCKET = simhash.BUCKET, bucket
        got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
        simhash.BUCKET = old
        assert got == brute_near(texts)
    assert 40 <= len(got) < 200


def test_pipeline(spark, tmp_path):
    """Each stage's decisions, from the operators' own rows. Stages are written
    and read again in between, as in a run."""

    def stored(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    docs = table(spark, SF, "documents")
    columns = docs.columns
    a = stored(corpus_pipeline.quality(spark, docs, SF), "a")
    assert a.columns == columns
    assert {r["doc_id"] for r in a.collect()} == {r["doc_id"] for r in quality_rules.quality(docs).where("kept").collect()}
    b = stored(corpus_pipeline.language(spark, a, SF), "b")
    assert b.columns == columns
    model = lang_id.model_of(a)
    texts = a.select("doc_id", "text").collect()
    names, scores = model.predict([r["text"] for r in texts])
    assert {r["doc_id"] for r in b.collect()} == {r["doc_id"] for r, n, s in zip(texts, names, scores, strict=True) if n != lang_id.UND and s >= corpus_pipeline.MIN_LANG_SCORE}
    c = stored(corpus_pipeline.lines(spark, b, SF), "c")
    assert c.columns == columns
    want = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(b).collect() if r["text"].strip()}
    assert {r["doc_id"]: r["text"] for r in c.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in c.collect())
    d = stored(corpus_pipeline.near_duplicates(spark, c, SF), "d")
    assert d.columns == columns
    assert {r["doc_id"] for r in d.collect()} == brute_near({r["doc_id"]: r["text"] for r in c.collect()})
    whole = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in whole.select("doc_id").distinct().collect()} == {r["doc_id"] for r in d.collect()}


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns, no rows."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(2)
    words = "the and of that with this from have they were been their which would about".split()
    prose = lambda n: "\n".join(" ".join(rng.choice(words) + rng.choice(["", "s", "ed"]) + str(rng.randrange(40)) * (rng.random() < 0.3) for _ in range(12)) for _ in range(n))
    rows = [(k, prose(8), "en", f"s{k % 3}", 5) for k in range(60)]
    rows += [rows[3], rows[3], (70, rows[3][1], "en", "s0", 5), (71, None, "en", None, None), (72, "", None, "s1", 0), (73, " \n ", "en", "s1", 3), (None, prose(8), "en", "s1", 1), (None, None, None, None, None)]
    rows += [(80, prose(4000), "en", "s2", 1), (81, "x" * 30_000, "en", "s2", 1), (82, "1 2 3 " * 40, "en", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["id", "th", "row", "rl_id", "t_th", "p", "k", "n", "host", "removed", "root", "t_stats"]
    docs = docs.select("*", *[F.lit(f"extra {c}").alias(c) for c in clash])
    for name, frame, some in (("all", docs, True), ("none", docs.where("doc_id < -1"), False)):
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            done = f(spark, frame, "")
            assert k == len(corpus_pipeline.STAGES) - 1 or done.columns == docs.columns
            done.write.parquet(str(tmp_path / name / stage))
            frame = spark.read.parquet(str(tmp_path / name / stage))
            if stage == "simhash_near_dedup" and some:
                left = {r["doc_id"]: r for r in frame.collect()}
                assert not {71, 72, 73, 81, 82} & set(left)
                assert 80 in left and None in left
                # the copy's lines went in the line stage; the document's repeated rows are one
                assert 3 in left and 70 not in left
                assert frame.where("doc_id = 3").count() == 1
                assert all(r["n_chars"] == len(r["text"]) and r["id"] == "extra id" for r in left.values())
        assert (frame.count() > 0) == some
