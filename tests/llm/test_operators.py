"""Corpus operators against brute force, and their defined edge cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from readloom.llm import embed_dedup, lang_id, license_scan, line_dedup, packing, piece_lattice, quality_rules, sharding, simhash, token_records, tokens
from readloom.llm.common import components

#: Names that operators use inside, as further columns of the input.
CLASH = ["id", "th", "h", "g", "n", "fp", "row", "rl_id", "t_th", "p", "shard", "words", "root", "low", "k", "s"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, words: str = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore") -> str:
    w = words.split()
    return " ".join(rng.choice(w) + rng.choice(["", "", "a", "ing", "er", str(rng.randrange(50))]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(k, "\n".join(prose(rng, rng.randrange(5, 30)) for _ in range(rng.randrange(1, 8))), rng.choice(["en", "xx"]), f"s{k % 3}", 7) for k in range(120)]
    base = out[3][1]
    out += [(200 + k, base, "en", "hot", 1) for k in range(60)]  # exact copies
    out += [(300 + k, f"{base}\n{prose(rng, 3)}", "en", "hot", 1) for k in range(50)]  # near copies
    out += [(400, None, None, None, None), (401, "", "en", "", 0), (402, " \t\n ", None, "s1", 4), (None, "null id text here", "en", "s1", 3), (None, None, None, None, None)]
    out += [(5, out[5][1], "en", "s2", 7), (5, out[5][1], "en", "s2", 7), (6, "other text under id six", "en", "s0", 1)]  # repeated rows
    out += [(500, "x" * 40_000, "en", "s1", 40_000), (501, "long word " * 20_000, "en", "s1", 9), (502, "été ¿qué? 日本 ☃ 𝔘", "fr", "s1", 9), (503, "!!! 123", "en", "s1", 7)]
    out += [(504, "Released under the MIT License.\nunder the mit license under the MIT license", "en", "s1", 1), (505, "Licensed under the GNU General Public License, version 3", "en", "s1", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < -1")


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, 7)]
    up: dict[int, int] = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_sharding(docs, none, rows):
    got = sharding.interleaved_shards(docs, 8).toPandas()
    assert len(got) == len(rows)
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    assert all(sorted(x["slot"]) == list(range(len(x))) for _, x in got.groupby("shard"))
    mix = got.groupby(["source", "shard"], dropna=False).size().groupby(level=0, dropna=False).agg(["min", "max"])
    assert (mix["max"] - mix["min"] <= 2).all()  # cuts are by rows, not by source
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None and r[0] > 10}
    assert all(zlib.crc32(texts[r.doc_id].encode()) == r.text_crc32 and len(texts[r.doc_id].encode()) + 1 == r.size for r in got.dropna(subset=["doc_id"]).itertuples() if r.doc_id > 10)
    again = sharding.interleaved_shards(docs.repartition(7), 8).toPandas()
    key = ["shard", "slot"]
    # the order from its definition: fractional ranks in each source, by seeded hash
    import struct
    from itertools import groupby

    from xxhash import xxh64_intdigest

    def seeded(*values) -> int:
        h = xxh64_intdigest(struct.pack("<i", sharding.SEED), 42)
        for v in values:
            h = h if v is None else xxh64_intdigest(struct.pack("<q", v), h)
        return h - (1 << 64) if h >> 63 else h

    first = lambda v: (v is not None, v)  # nulls come first
    plain = [(s, d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t, _, s, _ in rows]
    hashed = sorted(((s, seeded(d, c, n), d, c, n) for s, d, c, n in plain), key=lambda r: (first(r[0]), r[1], first(r[2]), r[3:]))
    ranked = []
    for _, own in groupby(hashed, key=lambda r: r[0]):
        own = list(own)
        ranked += [((k + 0.5) / len(own), *r) for k, r in enumerate(own)]
    ranked.sort(key=lambda r: (r[0], r[2], first(r[3]), first(r[1]), r[4:]))
    cuts = [k * 8 // len(ranked) for k in range(len(ranked))]
    want = [(c, k - cuts.index(c), *r[3:]) for k, (c, r) in enumerate(zip(cuts, ranked, strict=True))]
    assert want == [(r["shard"], r["slot"], r["doc_id"], r["text_crc32"], r["size"]) for r in sharding.interleaved_shards(docs, 8).orderBy("shard", "slot").collect()]
    assert got.sort_values(key)["text_crc32"].tolist() == again.sort_values(key)["text_crc32"].tolist()
    assert sharding.interleaved_shards(none).count() == 0


def brute_groups(prints: dict, radius: int = 3) -> dict:
    every = sorted(set(prints.values()))
    up = {p: p for p in every}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {p: find(p) for p in every}


@pytest.mark.parametrize("chunk", [2048, 8])
def test_simhash(docs, none, rows, chunk):
    got = simhash.near_duplicates(docs, chunk=chunk).collect()
    assert len(got) == len(rows)
    want = [simhash.fingerprint(r[1]) for r in rows]
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{p:016x}" for p in want)
    root = brute_groups(dict(enumerate(want)))
    low: dict[int, int] = {}
    for r, p in zip(rows, want, strict=True):
        if r[0] is not None:
            low[root[p]] = min(low.get(root[p], 1 << 60), r[0])
    assert all(r["component_id"] == low.get(root[int(r["fingerprint"], 16)]) for r in got)
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_comparison():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    p = np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, k), dtype=np.uint64), axis=1) for b in base for k in (1, 2, 4)])
    group = np.sort(rng.integers(0, 4, len(p)))
    for radius in (0, 1, 3, 5):
        i, j = simhash.linked(p, group, radius)
        want = {(a, b) for a in range(len(p)) for b in range(a + 1, len(p)) if group[a] == group[b] and int(p[a] ^ p[b]).bit_count() <= radius}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_fingerprint():
    assert simhash.fingerprint(None) == simhash.fingerprint("  \n") == 0
    from xxhash import xxh64_intdigest

    assert simhash.fingerprint("One  TWO") == xxh64_intdigest(b"one two", 42)
    text = "a b c a b c d É"
    w = [x for x in text.encode().lower().split()]
    h = [xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(len(w) - 2)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_drop_near_duplicates(docs, none, rows):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = [simhash.fingerprint(r[1]) for r in rows]
    assert kept.count() == len(set(brute_groups(dict(enumerate(want))).values()))
    assert simhash.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "white"), ("byte_bpe_50k.json", "byte")])
def test_encoder(name, kind, rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(name))
    code = tokens.Encoder(public_tokenizers.path(name), kind)
    rng = random.Random(2)
    letters = " \n\t  'sdtlé́a1,\x1cΣİ<|.ﬁ"
    texts = [r[1] or "" for r in rows] + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(2000)]
    added = ["<|endoftext|>", "<|startoftext|>"]
    texts += ["hello <|endoftext|>", "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>", "<|endoftext|> \n x.<|endoftext", *(rng.choice(added).join(rng.choices(texts, k=3)) for _ in range(200))]
    for t in texts:
        assert np.frombuffer(code.ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t[:80]


def test_checksum():
    assert token_records.crc32c([b"123456789"])[0] == 0xE3069283

    def slow(b: bytes) -> int:
        c = 0xFFFFFFFF
        for x in b:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    rng = random.Random(3)
    parts = [rng.randbytes(rng.choice([4, 9, 255, 256, 257, 1000])) for _ in range(40)]
    assert token_records.crc32c(parts).tolist() == list(map(slow, parts))


def test_token_records(spark, docs, none, rows, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    path = public_tokenizers.path("word_bpe_49k.json")
    to = str(tmp_path / "rec")
    manifest = token_records.write_records(docs, to, path)
    back = token_records.read_records(manifest, to).orderBy("start").collect()
    assert len(back) == len(rows)
    assert [r["doc_id"] for r in back] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    texts: dict = {}
    for r in rows:
        texts.setdefault(r[0], []).append(plain.encode(r[1] or "", add_special_tokens=False).ids + [2])
    at = 0
    for r in back:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        texts[r["doc_id"]].remove(ids)
        assert r["start"] == at
        at += len(ids)
    mixed = token_records.read_records(manifest, to, seed=1).collect()
    assert sorted((r["start"], bytes(r["ids"])) for r in mixed) == sorted((r["start"], bytes(r["ids"])) for r in back)
    assert token_records.read_records(token_records.write_records(none, str(tmp_path / "no"), path), to).count() == 0
    victim = next(p for p in sorted((tmp_path / "rec").iterdir()) if p.suffix == ".rec")
    data = bytearray(victim.read_bytes())
    data[len(data) // 2] ^= 1
    victim.write_bytes(bytes(data))
    with pytest.raises(Exception, match="checksum|length"):
        token_records.read_records(manifest, to).count()


def test_language(spark, docs, none):
    rng = random.Random(8)
    known = {"aa": "the and of that with this from have", "bb": "der die und nicht ein wird auch sich", "cc": "le les des une dans pour avec sur"}
    texts = [(k, prose(rng, 60, known[x]), x) for k, x in enumerate(rng.choice(list(known)) for _ in range(400))]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = lang_id.identify(df).toPandas()
    held = {k for k, _, _ in texts if zlib.crc32(str(k).encode()) % 3 == 1}
    assert set(got[got["held_out"]]["doc_id"]) == held
    truth = {k: x for k, _, x in texts}
    assert all(truth[r.doc_id] == r.lang_pred for r in got.itertuples() if r.held_out)
    odd = {r["doc_id"]: r for r in lang_id.identify(docs).collect()}
    assert odd[400]["lang_pred"] == odd[401]["lang_pred"] == odd[402]["lang_pred"] == odd[503]["lang_pred"] == lang_id.UND
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    assert lang_id.identify(none).count() == 0
    # labels of held-out rows, and the columns themselves, make no difference to predictions
    other = df.withColumn("lang", F.when(lang_id.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert lang_id.identify(other).toPandas().sort_values("doc_id")["lang_pred"].tolist() == got.sort_values("doc_id")["lang_pred"].tolist()


@pytest.mark.parametrize("chunk", [2048, 16])
def test_embeddings(spark, chunk):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 24))
    x[100:180] = x[0] + 0.15 * rng.normal(size=(80, 24))
    x[180:200] = x[5]
    data = [(k, v.astype("f4").tolist(), int(k % 2)) for k, v in enumerate(x)]
    odd = [None, [], [0.0] * 24, [1.0, None, *[0.0] * 22], [float("nan")] * 24, [float("inf"), *[0.0] * 23], [1.0, 2.0]]
    data += [(1000 + k, v, 0) for k, v in enumerate(odd)] + [(2000, data[5][1], None), (None, data[5][1], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("id", "v", "k", "c", "n", "root", "good")})
    got = {r["vec_id"]: r for r in embed_dedup.embedding_links(df, chunk=chunk).collect()}
    keep = [(k, np.array(v, float), lab) for k, v, lab in data if lab is not None and v and len(v) == 24 and k not in (1003,) and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    links = {k: 0 for k, _, _ in data}
    up = {k: k for k, _, _ in data}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, (a, v, la) in enumerate(keep):
        for b, w, lb in keep[i + 1 :]:
            if la == lb and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)), key=lambda z: (z is None, z))
                up[q] = p
    assert len(got) == len(data)
    assert {k: r["n_links"] for k, r in got.items()} == links
    assert all(got[k]["component_id"] == find(k) for k in links if k is not None)
    assert all(r["kept"] == (r["component_id"] == k) for k, r in got.items() if k is not None)
    assert embed_dedup.embedding_links(df.where("vec_id < 0")).count() == 0


def test_pieces(spark, docs, none, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, plain = piece_lattice.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(12)
    letters = " \n\t  'sdtlé́a1,\x1cΣİ<|.ﬁ▁the ing"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    # words of hundreds and thousands of characters that can and can't be cut
    texts += ["x" * 3000, " " * 70 + "z", " " * 300, " a" + " " * 37 + "b", "=-" * 300, "bananananana" * 30, "日本語テキスト" * 40, "a▁b", "QmFzZTY0/+4" * 60]
    more = [(10_000 + k, t, "en", "s", 0) for k, t in enumerate(texts)]
    every = docs.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")).unionByName(spark.createDataFrame(more, SCHEMA))
    for chunk, hot in ((64 << 20, 200_000), (20_000, 50)):
        got = sorted(((r["doc_id"], tuple(r["ids"])) for r in piece_lattice.encode_documents(every.repartition(3), model, chunk_chars=chunk, hot=hot).collect()), key=repr)
        assert got == sorted(((r[0], tuple(plain.encode(r[1] or ""))) for r in [*rows, *more]), key=repr)
    spans = [list(ids) for _, ids in got]
    b = model.byte0
    spans += [[0], [1, 2], [0, 300], [1, *plain.encode("hello")], [b + 32, *plain.encode("hello")], [b + 0xE6, b + 0x97, 300, b + 0xFF], [b + 0xF0, b + 0x9F, b + 0x41], []]
    spans += [[rng.choice([rng.randrange(3, 259), rng.randrange(32_000)]) for _ in range(rng.randrange(12))] for _ in range(300)]
    frame = spark.createDataFrame([*enumerate(spans), (-1, None), (-2, [300, None])], "key long, ids array<int>")
    back = {r["key"]: r["text"] for r in piece_lattice.decode_sequences(frame, model, "key").collect()}
    assert back == {-1: None, -2: None} | {k: plain.decode(x) for k, x in enumerate(spans)}
    with pytest.raises(Exception, match="outside the model"):
        piece_lattice.decode_sequences(spark.createDataFrame([(1, [32_000])], "key long, ids array<int>"), model, "key").collect()
    assert piece_lattice.round_trip(none, model).count() == 0


def test_unigram(spark, tmp_path):
    import sentencepiece

    raw = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    at = raw.rfind(b"\x18\x02\x20\x80\xfa\x01")  # the model type, before the vocabulary size
    (tmp_path / "u.model").write_bytes(raw[:at] + b"\x18\x01" + raw[at + 2 :])
    model, plain = piece_lattice.load(str(tmp_path / "u.model")), sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model"))
    assert model.kind == piece_lattice.UNIGRAM
    rng = random.Random(6)
    texts = [prose(rng, 12) for _ in range(100)] + ["x" * 500, "été ☃ 𝔘", ""]
    got = piece_lattice.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in got} == {k: plain.encode(t) for k, t in enumerate(texts)}


def test_unsupported_model(tmp_path):
    raw = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    user = b"\x0a\x0a" + b"\x0a\x01~" + b"\x15\x00\x00\x00\x00" + b"\x18\x04"  # a piece of the user
    (tmp_path / "u.model").write_bytes(raw + user)
    with pytest.raises(NotImplementedError):
        piece_lattice.load(str(tmp_path / "u.model"))


def test_line_dedup(docs, none, rows):
    got = line_dedup.dedup_lines(docs, removed_col="removed_lines")
    assert got.columns == [*docs.columns, "removed_lines"]
    unique = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    content = lambda t: [(p, x) for p, x in enumerate(t.split("\n")) if x.strip(" \t\x0b\x0c\r")]
    seen, gone = set(), {}
    for key in unique:
        c = content(key[1])
        for k in range(max(len(c) - 2, 1) if c else 0):
            w = tuple(x for _, x in c[k : k + 3])
            if w in seen:
                gone.setdefault(key, set()).update(p for p, _ in c[k : k + 3])
            seen.add(w)
    want = [(d, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get((d, t), ())), len(gone.get((d, t), ()))) for d, t, *_ in rows]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["text"], r["removed_lines"])) for r in got.collect())
    assert line_dedup.dedup_lines(none).count() == 0


def test_license_scan(docs, none, rows):
    got = license_scan.license_scan(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert (by[504]["n_base"], by[504]["first_word"], by[504]["last_word"], by[504]["base_labels"], by[504]["score"]) == (3, 1, 9, "mit", 1.0)
    assert (by[505]["n_base"], by[505]["base_labels"], by[505]["labels"]) == (0, "", "gpl-3")
    assert by[400]["n_words"] == by[401]["n_words"] == 0
    assert by[503]["n_words"] == 1
    assert by[502]["n_words"] == 5
    assert license_scan.license_scan(none).count() == 0


def brute_notices(text: str | None) -> tuple[set[str], float]:
    """Labels of all blocks at all words, and the best containment."""
    import math
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    labels, best = set(), 0.0
    for label, notice, must in license_scan.TEMPLATES:
        tokens, wide = set(notice.split()), 2 * len(notice.split())
        for i in range(len(w)):
            block = set(w[i : i + wide])
            n = len(block & tokens)
            # a block that starts between words of the notice holds no more than the next that starts at one
            if w[i] in tokens and n >= math.ceil(0.8 * len(tokens) - 1e-9) and set(must.split()) <= block and not block & set(license_scan.OTHERWISE.get(label, [])):
                labels.add(label)
                best = max(best, n / len(tokens))
    return labels, best


def test_license_notices(spark):
    rng = random.Random(9)
    filler = lambda n: " ".join(rng.choice("lorem ipsum dolor the of and license software use copy".split()) for _ in range(n))
    texts: list[str | None] = [None, ""]
    for label, notice, _ in license_scan.TEMPLATES:
        words = notice.split()
        for inserted, dropped in ((0, 0), (len(words) // 2, 0), (len(words), len(words) // 8), (len(words) // 3, len(words) // 4)):
            for lead in (0, 3, len(words) - 1):
                own = words.copy()
                for _ in range(dropped):
                    own.pop(rng.randrange(len(own)))
                for _ in range(inserted):
                    own.insert(rng.randrange(len(own) + 1), rng.choice(["foo", "bar", "the"]))
                texts.append(f"{filler(lead)} {' '.join(own)} {filler(5)}")
    near = ["licensed under the GNU General Public License version 2", "licensed under CC BY 4.0", "licensed under CC BY-SA 4.0", "released under the apache license", "released under the BSD license", "licensed under the GNU Lesser General Public License version 3"]
    texts += near
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.license_scan(df).collect()}
    for k, t in enumerate(texts):
        labels, best = brute_notices(t)
        base = set(filter(None, got[k]["base_labels"].split(",")))
        assert set(filter(None, got[k]["labels"].split(","))) == labels | base, t
        assert got[k]["score"] == (1.0 if base else best), t
    assert all(got[k]["labels"] == "" for k in range(len(texts) - len(near), len(texts)))
    assert sum(bool(got[k]["labels"]) for k in got) > 60


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), size=256).toPandas()
    want: dict = {}
    for r in rows:
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [2]
        n, at, k = len(ids), 0, 0
        while at < n:
            to = min(n, at + (256 if at or n <= 256 else n % 256 or 256))
            want[r[0], k, at, to - at, crc(ids[at:to])] = want.get((r[0], k, at, to - at, crc(ids[at:to])), 0) + 1
            at, k = to, k + 1
    for r in got.itertuples():
        key = (None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
        want[key] -= 1
    assert not any(want.values())
    for _, x in got.groupby("sequence_id"):
        x = x.sort_values("offset")
        assert x["offset"].tolist() == (x["length"].cumsum() - x["length"]).tolist()
        assert x["length"].sum() <= 256
    assert packing.packed(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("kind", ["uniform", "middle", "few"])
def test_plan(kind):
    rng = np.random.default_rng(1)
    sizes = {"uniform": rng.integers(1, 1025, 20_000), "middle": rng.integers(200, 700, 20_000), "few": rng.integers(1, 1025, 30)}[kind]
    counts = np.bincount(sizes, minlength=1025)
    runs = packing.plan(counts)
    held = np.zeros(1025, np.int64)
    for content, n in runs:
        assert sum(content) <= 1024
        for c in content:
            held[c] += n
    assert (held == counts).all()
    packing.placed(runs, counts)
    least = sum(n for _, n in packing.best_fit(counts.copy(), 1024))
    assert sum(n for _, n in runs) <= 1.002 * least + 1


def test_quality(docs, none, rows):
    import re

    got = quality_rules.quality(docs, max_line_docs=5).collect()
    assert len(got) == len(rows)
    word = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)

    def base(t):
        t = t or ""
        w = word(t)
        seen: dict = {}
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        cover = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(3)}
        lines = [x for x in t.split("\n") if word(x)]
        return len(w), len("".join(w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)

    figures = lambda r: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    assert sorted((repr(r["doc_id"]), figures(r)) for r in got) == sorted((repr(r[0]), base(r[1])) for r in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    holders, hosts = {}, {}
    norm = lambda x: " ".join(word(x)).lower()
    key = lambda d: d if d is not None else -1
    for d, t, _, s, _ in rows:
        if t is not None:
            hosts.setdefault(s, set()).add((key(d), t))
        for x in (t or "").split("\n"):
            if word(x):
                holders.setdefault((s, norm(x)), set()).add((key(d), t))
    limit = lambda s: min(5, max(4, 10 * len(hosts[s]) // 100))
    over = {k: min(v)[0] for k, v in holders.items() if len(v) > limit(k[0])}
    lost = {(d, t, s): sum(len(word(x)) for x in (t or "").split("\n") if word(x) and over.get((s, norm(x)), key(d)) != key(d)) for d, t, _, s, _ in rows}
    want = [(repr(d), lost[d, t, s], base(t)[0]) for d, t, _, s, _ in rows]
    assert sorted((repr(r["doc_id"]), r["removed_words"], r["n_words"]) for r in got) == sorted(want)
    assert sum(n > 0 for _, n, _ in want) > 100
    assert all(r["kept"] == (not r["base_failed"] and 2 * r["removed_words"] <= r["n_words"]) for r in got)
    passed = quality_rules.quality_filter(docs, max_line_docs=5)
    assert passed.columns == docs.columns
    assert passed.count() == sum(r["kept"] for r in got)
    assert quality_rules.quality(none).count() == quality_rules.quality_filter(none).count() == 0
