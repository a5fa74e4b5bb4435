"""Files of many small blocks: few tasks, each block decoded once, symbols in bulk."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame

from readloom import api
from readloom.sources import archive, bits, codec, fastq


def text_of(n: int) -> str:
    rng = random.Random(n)
    return "".join(f"@R.{1000 + k}:{'ab' * (k % 3)}\n{(s := ''.join(rng.choices('ACGT', k=rng.randrange(20, 60))))}\n+\n{'I' * len(s)}\n" for k in range(n))


def test_many_blocks_share_partitions(spark, tmp_path):
    p, a = tmp_path / "a.fastq", str(tmp_path / "a.arc")
    p.write_text(text_of(3000))
    made = api.pack(spark, a, str(p), chunk_bytes=400)
    assert made["blocks"] > 4 * fastq.PARTITIONS
    for parts in (fastq.FastqReader({"path": str(p), "chunkbytes": "400"}).partitions(), archive.ArchiveReader({"path": a}).partitions()):
        assert len(parts) <= fastq.PARTITIONS + 1
        ids = [b.block_id if isinstance(b, archive.Block) else b[0] for part in parts for b in part.blocks]
        assert ids == list(range(made["blocks"]))
    api.unpack(spark, a, str(tmp_path / "b.fastq"))
    assert (tmp_path / "b.fastq").read_bytes() == p.read_bytes()
    some = archive.read_archive(spark, a, blocks="7-9,400")
    assert {r["block_id"] for r in some.select("block_id").distinct().collect()} == {7, 8, 9, 400}
    heads = api.inspect(spark, a).orderBy("block_id").collect()
    assert [h["block_id"] for h in heads] == ids
    assert some.count() == sum(heads[k]["records"] for k in (7, 8, 9, 400))


def test_runs_of_blocks():
    assert list(fastq.dealt([], 9)) == []
    assert list(fastq.dealt([5] * fastq.PARTITIONS, 1)) == [slice(k, k + 1) for k in range(fastq.PARTITIONS)]
    sizes = [k % 7 for k in range(1000)]
    for most in (1, 10, 1 << 20):
        runs = list(fastq.dealt(sizes, most))
        assert [k for r in runs for k in range(r.start, r.stop)] == list(range(1000))
        assert all(sum(sizes[r]) < most + 7 for r in runs)


def test_unpack_decodes_once(spark, tmp_path, monkeypatch):
    """A sort by ranges would decode every block twice: for its sample, and for its rows."""
    p = tmp_path / "a.fastq"
    p.write_text(text_of(200))
    api.pack(spark, str(tmp_path / "a.arc"), str(p), chunk_bytes=2000)
    kind = type(spark.range(1))
    monkeypatch.setattr(kind, "repartitionByRange", lambda *_: pytest.fail("sorted"))
    assert issubclass(kind, DataFrame)
    api.unpack(spark, str(tmp_path / "a.arc"), str(tmp_path / "b.fastq"))
    assert (tmp_path / "b.fastq").read_bytes() == p.read_bytes()


def test_rendered_batch():
    rows = lambda q: pa.RecordBatch.from_pydict({"title": ["@a", "@\xe9 x"], "seq": ["AC", ""], "qual": ["II", q]})
    assert fastq.rendered_batch(rows(""), False) == "@a\nAC\n+\nII\n@\xe9 x\n\n+\n\n".encode("latin-1")
    assert fastq.rendered_batch(rows(""), True) == "@a\nAC\n+a\nII\n@\xe9 x\n\n+\xe9 x\n\n".encode("latin-1")
    with pytest.raises(ValueError):
        fastq.rendered_batch(rows(None), False)


def fibonacci(n: int) -> np.ndarray:
    out = [1, 1]
    while len(out) < n:
        out.append(out[-1] + out[-2])
    return np.array(out)


@pytest.mark.parametrize("kinds", [2, 5, 18])
def test_many_symbols(kinds):
    """Codes longer than the window too (18 kinds), and ends in any place."""
    counts = fibonacci(kinds)
    code = bits.PrefixCode(counts)
    assert (code.width.max() > bits.WINDOW) == (kinds == 18)
    symbols = np.tile(np.random.default_rng(1).permutation(np.repeat(np.arange(kinds), counts)), 12)
    for n in (0, 1, 15, 16, 17, len(symbols)):
        out = bits.BitWriter()
        out.byte(1)
        code.store(out)
        out.put(code.code[symbols[:n]], code.width[symbols[:n]])
        data, end = out.bytes(), out.n
        for read in (lambda c, r, n=n: c.many(r, n).tolist(), lambda c, r, n=n: [e >> bits.LENGTH_BITS for e in bits.read_each(r, [c] * n, [c.table] * n)]):
            r = bits.BitReader(data)
            r.byte()
            c = bits.PrefixReader(r)
            at = r.at
            assert read(c, r) == symbols[:n].tolist()
            assert r.at == at + int(code.width[symbols[:n]].sum()) <= end
            if n > 16:
                r = bits.BitReader(data[: (at + r.at) // 16])
                r.at = at
                with pytest.raises(EOFError):
                    read(c, r)


@pytest.mark.parametrize("kind", ["plain", "runs", "tail"])
def test_long_codes_round_trip(kind):
    rng = np.random.default_rng(2)
    letters = np.array(list("IJKLMNOPQRSTUVWXYZ"))
    pick = rng.permutation(np.repeat(letters, fibonacci(18)))
    n, size = len(pick) // 20, 20
    quals = ["".join(q) for q in pick[: n * size].reshape(n, size)]
    if kind == "runs":
        quals = ["".join(c * 5 for c in q[:4]) for q in quals]
    if kind == "tail":
        quals = [q[: k % 15 + 1] + "#" * (size - k % 15 - 1) for k, q in enumerate(quals)]
    seqs = ["".join(s) for s in rng.permutation(np.repeat(np.array(list("AGCTNRWSKMDVHBYXU."))[::-1], fibonacci(18)))[: n * size].reshape(n, size)]
    titles = [f"@R{letters[k * k % 18]}.{7 * k + k % 2}:{k * 7919 % 100003}:{pick[k] * (1 + k % 4)}:{pick[k]}z" for k in range(n)]
    data = codec.encode_block(titles, seqs, quals)
    assert codec.decode_block(data) == (titles, seqs, quals)
    for cut in (len(data) // 3, len(data) // 2, len(data) - 1):
        with pytest.raises((EOFError, ValueError)):
            codec.decode_block(data[:cut])
