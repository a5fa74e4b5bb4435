"""Whole results where an earlier version gave part of them."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import public_tokenizers

from readloom.llm import embed_dedup, lang_id, quality_rules, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_sentencepiece_ids_and_text(spark, tmp_path):
    import sentencepiece

    texts = ["Sphinx of  black quartz,\njudge my vow.", "x" * 70 + " été ☃ 𝔘", " lead", None, "", "a▁b", "Sphinx of  black quartz,\njudge my vow."]
    rows = [(k % 6, t, "en", "s", 0) for k, t in enumerate(texts)]  # the last repeats the first
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op6_sentencepiece(spark, str(tmp_path)).collect()
    plain = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((k, plain.encode(t or "")) for k, t, *_ in rows)
    assert sorted((r["doc_id"], list(r["ids"])) for r in got) == want
    assert all(r["n_pieces"] == len(r["ids"]) for r in got)
    # U+2581 in a text is a space once decoded, in the library as well
    assert {r["doc_id"]: r["same_text"] for r in got} == {k: plain.decode(plain.encode(t or "")) == (t or "") for k, t, *_ in rows}


def test_quality_keeps_one_copy(spark):
    line = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    body, other = f"{line('a', 30)}\n{line('b', 30)}", line("x", 70)
    rows = [(1, line("a", 30), "en", "near", 0), (2, line("b", 30), "en", "near", 0)]  # under 50 words: fail the base rules
    rows += [(10 + k, f"{body}\nown{k}", "en", "near", 0) for k in range(40)]
    # the first holder of a and b is itself depleted, by x
    rows += [(100, f"{other}\n{line('y', 20)}", "en", "dep", 0), (101, f"{body}\n{other}", "en", "dep", 0)]
    rows += [(110 + k, f"{body}\nown{k}", "en", "dep", 0) for k in range(40)] + [(160 + k, f"{other}\nown{k}", "en", "dep", 0) for k in range(40)]
    got = {r["doc_id"]: r["text"] for r in quality_rules.quality_filter(spark.createDataFrame(rows, SCHEMA)).collect()}
    # 101 loses 70 of its 130 words
    assert got == {k: t for k, t, *_ in rows if k in (10, 100, 110)}


def test_embeddings_of_low_rank(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-3, 4, (400, 3)) @ rng.integers(-2, 3, (3, 64))
    x = np.unique(x[(x != 0).any(axis=1)], axis=0).astype(float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cosines = unit @ unit.T
    np.fill_diagonal(cosines, 0)
    assert (abs(cosines - embed_dedup.COSINE) > 1e-9).all()
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.embedding_links(df).collect()}
    assert got == dict(enumerate((cosines >= embed_dedup.COSINE).sum(axis=1).tolist()))


def test_more_than_64_languages(spark):
    texts = {f"l{k:03d}": f"{chr(0x4E00 + 20 * k)}{chr(0x4E01 + 20 * k)}{chr(0x4E02 + 20 * k)}" * 5 for k in range(150)}
    df = spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(texts.items())], "key long, text string, lang string")
    names, scores = lang_id.train(df).predict(list(texts.values()))
    assert names == list(texts)
    assert (scores > 0.8).all()


def test_language_filter_against_sets(spark):
    """The merged filter, the counts by language and their correction, from sets."""
    rng = random.Random(4)
    words = {"aa": "the and of that with this from have", "bb": "der die und nicht ein wird auch sich", "cc": "le les des une dans pour avec sur", "dd": "the die les un"}
    rows = [(k, " ".join(rng.choice(words[x].split()) + rng.choice(["", "en", "s"]) for _ in range(40)), x) for k, x in enumerate(sorted(words) * 30)]
    rows += [(900, "x", "aa"), (901, None, "aa"), (902, "text", None)]
    df = spark.createDataFrame(rows, "key long, text string, lang string")
    bits, hashes = 10, lang_id.HASHES  # a small filter, so that false positives occur
    model = lang_id.train(df, bits=bits)
    counts = {x: Counter() for x in words}
    for _, t, x in rows:
        if t and x:
            counts[x].update(lang_id.grams([t])[0].tolist())
    share = {x: {g: n / sum(c.values()) for g, n in c.items() if n >= lang_id.MIN_COUNT and n / sum(c.values()) >= lang_id.MIN_GRAM_SHARE} for x, c in counts.items()}
    top = {g: max(s.get(g, 0) for s in share.values()) for s in share.values() for g in s}
    slots = lambda g: {int(a[0]) for a in lang_id._slots(np.array([g], np.uint64), bits, hashes)}
    held = {x: set().union(*(slots(g) for g, v in s.items() if v >= lang_id.MIN_SHARE * top[g])) for x, s in share.items()}
    assert model.langs == tuple(sorted(words))
    rates = {x: (len(h) / 2**bits) ** hashes for x, h in held.items()}
    texts = [t for _, t, _ in rows] + ["der und le", "qqq zzz", "", "!!", "é"]
    names, scores = model.predict(texts)
    for t, name, score in zip(texts, names, scores, strict=True):
        g = lang_id.grams([t])[0].tolist() if t else []
        right = {x: max(0.0, (sum(slots(c) <= held[x] for c in g) - len(g) * rates[x]) / (1 - rates[x])) for x in words}
        best = max(sorted(right), key=right.get)
        if g and right[best] > 1e-9:
            assert abs(score - min(1.0, right[best] / len(g))) < 1e-9
            assert abs(right[name] - right[best]) < 1e-9
        else:
            assert (name, score) == ("aa" if t and any(map(str.isalpha, t)) else lang_id.UND, 0)
