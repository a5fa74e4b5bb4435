"""The block codec: quoted section lengths, refusals, round trips."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.sources import bits, codec


def section(put, *args) -> int:
    out = bits.BitWriter()
    put(out, *args)
    return len(out.bytes())


def test_sequence_sections():
    of = lambda s: codec._INDEX[codec._bytes(s)]
    assert section(codec.put_dna, of("A" * 10 + "G" * 10 + "C" * 10 + "T" * 10 + "N" * 9 + "A")) == 35
    assert section(codec.put_dna, of("ACGTACGT" + "GGCCTTAA")) == 5
    assert section(codec.put_dna, of("")) == 1
    with pytest.raises(codec.Refused):
        codec.put_dna(bits.BitWriter(), of("AATTNN"))


def test_block_head():
    data = codec.encode_block(["@R1", "@R2"], ["ACGTACGT", "GGCCTTAA"], ["IIIIIIII"] * 2, chunk_size=47)
    head = codec.block_head(data)
    assert (head["records"], head["max_q"], head["flags"], head["chunk_size"]) == (2, 8, 0, 47)


@pytest.mark.parametrize(
    ("seqs", "quals", "kept"),
    [(["ANCGT"], ["I#III"], 4), (["AGCGT"], ["IIIII"], 5), (["NNNNN"], ["#####"], 0), (["ACGTACGT"], ["!!!!!!!!"], 8)],
)
def test_coupling(seqs, quals, kept):
    dna, coded, sizes = codec.couple(seqs, quals)
    assert len(dna) == kept == int((coded < 128).sum())
    assert codec.uncouple(dna, coded, sizes) == (seqs, quals)


def test_refusals():
    for seqs, quals in ((["ACGT"], ["III"]), (["acgt"], ["IIII"]), (["ACGT"], ["II I"]), (["ACGT"], ["II\xa1I"])):
        with pytest.raises(codec.Refused):
            codec.encode_block(["@a"], seqs, quals)
    one = ["ACGT", "IIII"]
    with pytest.raises(codec.Refused, match="layout"):
        codec.encode_block(["@a:b:c", "@a:b"], [one[0]] * 2, [one[1]] * 2)
    with pytest.raises(codec.Refused, match="VALUE_RLE|DELTA_RLE"):
        codec.encode_block([f"@a.{k // 40 % 2 * 100}" for k in range(400)], [one[0]] * 400, [one[1]] * 400)


def test_schemes():
    flat = np.full(5000, 40)
    assert codec.quality_scheme(flat, np.full(50, 100)) == "RLE"
    assert codec.field_scheme([str(5 * k) for k in range(100)])[0] == "DELTA_CONST"
    assert codec.field_scheme([str(7 * k + k % 2) for k in range(100)])[0] == "DELTA_VAR"
    assert codec.field_scheme([str(k * 7919 % 401) for k in range(100)])[0] == "VALUE_VAR"
    assert codec.field_scheme(["007", "008"])[0] == "TEXT"
    assert codec.number("1073741824") == 1 << 30
    assert codec.number("1073741825") is None


def test_codes_beat_flat_width():
    counts = [1000, 500, 200, 50, 10, 5, 1, 1]
    code = bits.PrefixCode(counts)
    assert sum(int(w) * c for w, c in zip(code.width, counts, strict=True)) < 3 * sum(counts)
    lone = bits.PrefixCode([0, 9, 0])
    assert lone.width[1] == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_codes_in_step(seed):
    """Many codes at once are those built one by one, and so are their bytes."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    counts = rng.integers(0, rng.choice([2, 5, 1000]), (int(rng.integers(0, 30)), n)) * rng.integers(0, 2, n)
    many, one = bits.PrefixCodes(counts), [bits.PrefixCode(c) for c in counts]
    for k, c in enumerate(one):
        assert many.code[k].tolist() == c.code.tolist()
        assert many.width[k].tolist() == c.width.tolist()
    a, b = bits.BitWriter(), bits.BitWriter()
    for w in (a, b):
        w.put([1], 3)
    many.store(a)
    for c in one:
        c.store(b)
    assert a.bytes() == b.bytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 64)), max_size=200))
def test_packed_bits(parts):
    out = bits.BitWriter()
    for v, w in parts:
        out.put(np.array([v], np.uint64), w)
    text = "".join(format(v & (1 << w) - 1, f"0{w}b") for v, w in parts if w)
    text += "0" * (-len(text) % 8)
    assert out.bytes() == bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8))


def test_reader_refuses_to_run_over():
    r = bits.BitReader(b"\xf0")
    assert r.get(4) == 15
    with pytest.raises(EOFError):
        r.get(5)


def test_long_text_field():
    titles = [f"@L.{'xyz'[k % 3] * 75}{'ab'[k % 2] * 75}" for k in range(50)]
    data = codec.encode_block(titles, ["ACGT"] * 50, ["IIII"] * 50)
    assert codec.decode_block(data)[0] == titles
    assert codec.decode_block(data, titles_only=True) == (titles, [], [])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_round_trip(seed):
    rng = random.Random(seed)
    n, kind = rng.randrange(1, 40), rng.randrange(5)
    titles = [f"@R{rng.choice('ab')}.{rng.choice([5 * i, i * i % 97, rng.randrange(10**6)])}:{''.join(rng.choice('xyz09') for _ in range(rng.choice([0, 2, 140])))}" for i in range(n)]
    sizes = [rng.choice([0, 1, 20, 300]) if kind == 1 else 25 for _ in range(n)]
    seqs = ["".join(rng.choice("ACGTN" if kind != 2 else "ACGTNRW") for _ in range(k)) for k in sizes]
    quals = ["".join(rng.choice("#I" if kind == 3 else "!#$%IJK") for _ in range(k)) if kind != 4 else "I" * k for k in sizes]
    try:
        data = codec.encode_block(titles, seqs, quals)
    except codec.Refused:
        return
    assert codec.decode_block(data) == (titles, seqs, quals)
    assert sum(codec.sections(data).values()) + codec.block_head(data)["at"] // 8 == len(data)
