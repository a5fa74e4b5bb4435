"""The block codec: reads to the bytes of one archive block and back.

A block is its head, then titles, qualities and bases. What each stream's
scheme is and what it costs can be asked for relationally (``plans``); this
module writes the bits, with all codes of a stream laid out as arrays.
"""

from __future__ import annotations

import re
from itertools import pairwise, repeat

import numpy as np

from ..schema import (
    ALPHABET,
    COUPLED_BASE,
    COUPLING_QUALITY,
    DNA_SCHEMES,
    MAX_FIELDS,
    MAX_NUMBER,
    MAX_NUMERIC_SYMBOLS,
    MAX_RUN,
    MAX_TEXT_POSITIONS,
    NUMERIC_RLE_RATIO,
    NUMERIC_SCHEMES,
    QUALITY_OFFSET,
    QUALITY_SCHEMES,
    RLE_RATIO,
    TAIL_QUALITY,
    TITLE_SEPARATORS,
    TRUNCATED_RATIO,
)
from .bits import LENGTH_BITS, BitReader, BitWriter, PrefixCode, PrefixCodes, PrefixReader, joined, plain_tables, read_each, read_rows, width_of

VARIABLE_LENGTH = 2
_SEPARATORS = TITLE_SEPARATORS.encode()
_NO_SEPARATORS = bytes(b for b in range(256) if b not in _SEPARATORS)
_NO_SEPARATORS_OR_ENDS = _NO_SEPARATORS.replace(b"\n", b"")
_ENDS = bytes.maketrans(_SEPARATORS, b"\n" * len(_SEPARATORS))
_NUMBER = re.compile(r"0|[1-9][0-9]{0,9}")
_INDEX = np.full(256, -1, np.int64)
_INDEX[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
_BASES = np.frombuffer(ALPHABET.encode(), np.uint8)


class Refused(ValueError):
    """The archive format can't hold this block."""


def _bytes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("latin-1"), np.uint8)


# -- coupling ---------------------------------------------------------------


def couple(seqs: list[str], quals: list[str], offset: int = QUALITY_OFFSET) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept base indexes, coded qualities, length of each read)."""
    sizes = np.array([len(q) for q in quals], np.int64)
    if [len(s) for s in seqs] != sizes.tolist():
        raise Refused("a sequence and its qualities differ in length")
    b, q = _INDEX[_bytes("".join(seqs))], _bytes("".join(quals)).astype(np.int64) - offset
    if (b < 0).any():
        raise Refused("a base is outside the alphabet")
    if (q < 0).any() or (q >= COUPLED_BASE).any():
        raise Refused("a quality is outside the range that can be coded")
    out = (b > 3) & (q < COUPLING_QUALITY)
    return b[~out], np.where(out, COUPLED_BASE + (b - 4) * 8 + q, q), sizes


def uncouple(dna: np.ndarray, coded: np.ndarray, sizes: np.ndarray, offset: int = QUALITY_OFFSET) -> tuple[list[str], list[str]]:
    out = coded >= COUPLED_BASE
    b = np.zeros(len(coded), np.int64)
    b[~out] = dna
    b[out] = (coded[out] - COUPLED_BASE) // 8 + 4
    q = np.where(out, coded & 7, coded) + offset
    ends = np.cumsum(sizes).tolist()
    spans = list(zip([0, *ends], ends, strict=False))

    def text(x: np.ndarray) -> list[str]:
        whole = x.astype(np.uint8).tobytes().decode("latin-1")
        return [whole[a:b] for a, b in spans]

    return text(_BASES[b]), text(q)


# -- bases ------------------------------------------------------------------


def put_dna(out: BitWriter, dna: np.ndarray) -> None:
    counts = np.bincount(dna, minlength=len(ALPHABET))
    have = np.flatnonzero(counts)
    if not len(have):
        out.byte(DNA_SCHEMES["NONE"])
    elif len(have) <= 4:
        if have[-1] >= 4:
            raise Refused("a small alphabet beyond ACGT")
        out.byte(DNA_SCHEMES["B2"])
        out.put(dna, 2)
        out.align()
    else:
        out.byte(DNA_SCHEMES["HUFFMAN"])
        out.put((counts > 0).astype(int), 1)
        out.align()
        code = PrefixCode(counts[have])
        code.store(out)
        dense = np.searchsorted(have, dna)
        out.put(code.code[dense], code.width[dense])
        out.align()


def get_dna(r: BitReader, n: int) -> np.ndarray:
    scheme = r.byte()
    if scheme == DNA_SCHEMES["NONE"]:
        if n:
            raise ValueError("bases are missing")
        return np.empty(0, np.int64)
    if scheme == DNA_SCHEMES["B2"]:
        dna = r.array(n, 2)
    elif scheme == DNA_SCHEMES["HUFFMAN"]:
        have = np.array([k for k in range(len(ALPHABET)) if r.get(1)], np.int64)
        r.align()
        code = PrefixReader(r)
        dna = have[code.many(r, n)]
    else:
        raise ValueError(f"unknown sequence scheme {scheme}")
    r.align()
    return dna


# -- qualities --------------------------------------------------------------


def _last_other(coded: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Place of the last value of each read that is not the tail's; -1 if none is."""
    out = np.full(len(sizes), -1, np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        place = np.arange(len(coded)) - np.repeat(starts, sizes[some])
        out[some] = np.maximum.reduceat(np.where(coded != TAIL_QUALITY, place, -1), starts)
    return out


def quality_scheme(coded: np.ndarray, sizes: np.ndarray) -> str:
    raw, ends = len(coded), np.cumsum(sizes)[sizes > 0]
    new = np.r_[True, coded[1:] != coded[:-1]] if raw else np.empty(0, bool)
    new[ends[:-1]] = True  # each read begins anew
    rle = int(new.sum()) - int((coded[ends - 1] == TAIL_QUALITY).sum())
    th = int(np.maximum(_last_other(coded, sizes), 0).sum())
    if rle > 0 and th / rle > RLE_RATIO:
        return "RLE"
    return "TRUNCATED" if th > 0 and raw / th > TRUNCATED_RATIO else "PLAIN"


def _put_set(out: BitWriter, values: np.ndarray) -> np.ndarray:
    """A 256-bit set; returns its members, ascending."""
    there = np.bincount(values, minlength=256) > 0
    out.put(there, 1)
    return np.flatnonzero(there)


def _get_set(r: BitReader) -> list[int]:
    return [k for k in range(256) if r.get(1)]


def _by_position(coded: np.ndarray, sizes: np.ndarray, keep: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrix reads x positions of values, and of which are kept."""
    at = np.arange(most)
    inside = at[None, :] < sizes[:, None]
    grid = np.zeros((len(sizes), most), np.int64)
    grid[inside] = coded
    return grid, at[None, :] < keep[:, None]


def put_quality(out: BitWriter, coded: np.ndarray, sizes: np.ndarray) -> None:
    scheme = quality_scheme(coded, sizes)
    out.byte(QUALITY_SCHEMES[scheme])
    if scheme == "RLE":
        _put_runs(out, coded)
        return
    most = int(sizes.max(initial=0))
    keep = sizes
    if scheme == "TRUNCATED":
        keep = np.minimum(sizes, np.maximum(1, _last_other(coded, sizes) + 1))
    out.word(most)
    have = _put_set(out, coded)
    grid, live = _by_position(coded, sizes, keep, most)
    lookup = np.zeros(256, np.int64)
    lookup[have] = np.arange(len(have))
    dense, wide = lookup[grid], max(1, len(have))
    at = np.arange(most)
    counts = np.bincount((at[None, :] * wide + dense)[live], minlength=most * wide).reshape(most, wide)
    codes = PrefixCodes(counts)
    codes.store(out)
    values, widths = codes.code[at[None, :], dense], np.where(live, codes.width[at[None, :], dense], 0)
    if scheme == "TRUNCATED":
        varied = bool(sizes.min() != sizes.max())
        out.put([int(varied)], 1)
        cut = keep != sizes
        size = np.array([width_of(n) for n in (sizes if varied else np.full(len(sizes), most))], np.int64)
        lead = np.stack([cut.astype(np.int64), keep], axis=1)
        values = np.hstack([lead.astype(np.uint64), values.astype(np.uint64)])
        widths = np.hstack([np.stack([np.ones(len(sizes), np.int64), np.where(cut, size, 0)], axis=1), widths])
    out.put(values, widths)
    out.align()


def get_quality(r: BitReader, sizes: np.ndarray) -> np.ndarray:
    scheme = r.byte()
    if scheme == QUALITY_SCHEMES["RLE"]:
        return _get_runs(r, int(sizes.sum()))
    if scheme not in QUALITY_SCHEMES.values():
        raise ValueError(f"unknown quality scheme {scheme}")
    most = r.word()
    have = _get_set(r)
    codes = [PrefixReader(r) for _ in range(most)]
    r.align()
    cut = scheme == QUALITY_SCHEMES["TRUNCATED"]
    each = sizes.tolist()
    widths = ([width_of(n) for n in each] if r.get(1) else [width_of(most)] * len(each)) if cut else None
    out = read_rows(r, codes, each, widths, len(have) << LENGTH_BITS)
    r.align()
    symbols = np.array(out, np.int64) >> LENGTH_BITS
    if (symbols > len(have)).any() or (not cut and (symbols == len(have)).any()):
        raise ValueError("a quality symbol is out of range")
    return np.array([*have, TAIL_QUALITY], np.int64)[symbols]


def runs_of(coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and lengths less one of runs over a block, of at most MAX_RUN."""
    starts = np.flatnonzero(np.r_[True, coded[1:] != coded[:-1]]) if len(coded) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(coded)])
    parts = -(-sizes // MAX_RUN)
    place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(coded[starts], parts), np.minimum(MAX_RUN, np.repeat(sizes, parts) - MAX_RUN * place) - 1


def _put_runs(out: BitWriter, coded: np.ndarray) -> None:
    symbol, length = runs_of(coded)
    out.word(len(symbol))
    have, spans = _put_set(out, symbol), _put_set(out, length)
    q, n = np.searchsorted(have, symbol), np.searchsorted(spans, length)
    wide, long = len(have), len(spans)
    if len(have) == 1:
        if len(spans) == 2:
            out.align()
            out.byte(int(n[0]))
        out.align()
        return
    before = np.r_[0, q[:-1]]
    qs = PrefixCodes(np.bincount(before * wide + q, minlength=wide * wide).reshape(wide, wide))
    ns = PrefixCodes(np.bincount(q * long + n, minlength=wide * long).reshape(wide, long))
    out.align()
    out.put(*(np.hstack(x) for x in zip(qs.stored(), ns.stored(), strict=True)))  # by turns
    out.put(np.stack([qs.code[before, q], ns.code[q, n]], axis=1), np.stack([qs.width[before, q], ns.width[q, n]], axis=1))
    out.align()


def _read_runs(r: BitReader, codes: list[tuple[PrefixReader, PrefixReader]], count: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols, each by the code of the one before, and lengths, by the code of
    their symbol."""
    firsts, seconds = [c[0].table for c in codes], [c[1].table for c in codes]
    windows, at, k, out = r.windows, r.at, 0, []
    push, bits = out.append, (1 << LENGTH_BITS) - 1
    try:
        for _ in range(count):
            if e := firsts[k][windows[at]]:
                at += e & bits
            else:
                r.at = at
                e = codes[k][0].beyond(r)
                at = r.at
            k = e >> LENGTH_BITS
            push(e)
            if e := seconds[k][windows[at]]:
                at += e & bits
            else:
                r.at = at
                e = codes[k][1].beyond(r)
                at = r.at
            push(e)
    except IndexError:
        if at < r.end:
            raise ValueError("a quality symbol is out of range") from None
        at = r.end + 1
    if at > r.end:
        raise EOFError("the bit stream ends too early")
    r.at = at
    both = np.array(out, np.int64).reshape(count, 2) >> LENGTH_BITS
    return both[:, 0], both[:, 1]


def _get_runs(r: BitReader, total: int) -> np.ndarray:
    count = r.word()
    have, spans = _get_set(r), _get_set(r)
    if not have or not spans:
        raise ValueError("a run-length section without symbols")
    if len(have) == 1:
        first = last = spans[0]
        if len(spans) > 1:
            r.align()
            k = r.byte()
            if k >= len(spans) or len(spans) > 2:
                raise ValueError("a run length is out of range")
            first, last = spans[k], spans[1 - k]
        r.align()
        length = np.full(count, first)
        length[-1:] = last
        symbol = np.full(count, have[0])
    else:
        codes = [(PrefixReader(r), PrefixReader(r)) for _ in have]
        symbols, lengths = _read_runs(r, codes, count)
        symbol, length = np.array(have, np.int64)[symbols], np.array(spans, np.int64)[lengths]
        r.align()
    out = np.repeat(symbol, length + 1)
    if len(out) != total:
        raise ValueError("runs and read lengths differ")
    return out


# -- titles -----------------------------------------------------------------


def number(s: str) -> int | None:
    n = int(s) if _NUMBER.fullmatch(s) else None
    return n if n is not None and n <= MAX_NUMBER else None


def numbers(values: list[str]) -> np.ndarray | None:
    """number() of each; None where one is none."""
    whole = "".join(values)
    if not (whole.isascii() and whole.isdigit()) or "" in values or max(map(len, values)) > 10:
        return None
    x = np.array(list(map(int, values)), np.int64)
    if x.max() > MAX_NUMBER or sum(map(len, map(str, x.tolist()))) != len(whole):  # zeros in front
        return None
    return x


def _run_count(x: np.ndarray) -> int:
    if not len(x):
        return 0
    edges = np.r_[np.flatnonzero(np.r_[True, x[1:] != x[:-1]]), len(x)]
    sizes = np.diff(edges)
    return len(sizes) - 1 + int(((sizes - 1) // 256).sum()) + int((sizes[-1] - 1) % 256 > 0)


def field_scheme(values: list[str]) -> tuple[str, np.ndarray | None]:
    """How a title field is stored, and its numbers if it is numeric."""
    if values.count(values[0]) == len(values):
        return "CONST", None
    x = numbers(values)
    if x is None:
        return "TEXT", None
    d = np.diff(x)
    vr, dr = int(x.max() - x.min()), int(d.max() - d.min())
    if vr >= dr and dr == 0:
        return "DELTA_CONST", x
    if vr >= dr and (k := _run_count(d)) and len(x) / k > NUMERIC_RLE_RATIO:
        return "DELTA_RLE", x
    if (k := _run_count(x)) and len(x) / k > NUMERIC_RLE_RATIO:
        return "VALUE_RLE", x
    return ("DELTA_VAR" if vr >= dr else "VALUE_VAR"), x


def _put_numbers(out: BitWriter, scheme: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Head of a numeric field; returns its column of (values, widths)."""
    lo, hi, d = int(x.min()), int(x.max()), np.diff(x)
    out.byte(1)
    out.byte(NUMERIC_SCHEMES[scheme])
    out.word(lo)
    out.word(hi)
    values, widths = x - lo, np.full(len(x), width_of(hi - lo))
    if scheme.startswith("DELTA"):
        out.word(int(d.min()))
        out.word(int(d.max()))
        rest, times = d - d.min(), np.bincount(d - d.min())
    else:
        rest, times = values[1:], np.bincount(values)
        times[values[0]] += 1  # the format counts the first title twice
    if scheme == "DELTA_CONST":
        return values, np.r_[widths[:1], np.zeros(len(d), np.int64)]
    coded = len(times) <= MAX_NUMERIC_SYMBOLS
    out.byte(int(coded))
    if coded:
        code = PrefixCode(times)
        code.store(out)
        return np.r_[values[:1].astype(np.uint64), code.code[rest]], np.r_[widths[:1], code.width[rest]]
    return np.r_[values[:1], rest], np.r_[widths[:1], np.full(len(rest), width_of(len(times) - 1))]


def _put_text(out: BitWriter, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    first, sizes = _bytes(values[0]), np.array([len(v) for v in values], np.int64)
    most, least = int(sizes.max()), int(sizes.min())
    grid, inside = _by_position(_bytes("".join(values)).astype(np.int64), sizes, sizes, most)
    fixed = np.array([bool((grid[inside[:, j], j] == first[j]).all()) for j in range(len(first))], bool)
    out.byte(0)
    out.byte(int(most == least))
    for n in (len(first), most, least):
        out.word(n)
    out.raw(first.tobytes())
    out.put(fixed.astype(int), 1)
    out.align()
    stored = np.r_[~fixed, np.ones(most - len(first), bool)] if most > len(first) else ~fixed[:most]
    values_, widths = np.zeros((len(sizes), most), np.uint64), np.zeros((len(sizes), most), np.int64)
    for j in [*np.flatnonzero(stored[:MAX_TEXT_POSITIONS]).tolist(), *([MAX_TEXT_POSITIONS] if most >= MAX_TEXT_POSITIONS else [])]:
        cols = slice(j, j + 1) if j < MAX_TEXT_POSITIONS else slice(j, None)
        code = PrefixCode(np.bincount(grid[:, cols][inside[:, cols]], minlength=256))
        code.store(out)
        ok = inside[:, cols] & stored[cols][None, :]
        values_[:, cols] = np.where(ok, code.code[grid[:, cols]], 0)
        widths[:, cols] = np.where(ok, code.width[grid[:, cols]], 0)
    size = np.full(len(sizes), 0 if most == least else width_of(most - least))
    return np.column_stack([(sizes - least).astype(np.uint64), values_]), np.column_stack([size, widths])


def _columns(titles: list[str]) -> tuple[str, list[list[str]]]:
    """The separators of all titles, and a list of each field's values."""
    text = "\n".join(titles)
    if text.count("\n") != len(titles) - 1:
        raise Refused("a title with a line end")
    data = text.encode("latin-1")
    layout = titles[0].encode("latin-1").translate(None, _NO_SEPARATORS)
    if data.translate(None, _NO_SEPARATORS_OR_ENDS) != b"\n".join([layout] * len(titles)):
        raise Refused("titles of different layouts")
    cells = data.translate(_ENDS).decode("latin-1").split("\n")
    return layout.decode("latin-1"), [cells[k :: len(layout) + 1] for k in range(len(layout) + 1)]


def put_titles(out: BitWriter, titles: list[str], sizes: np.ndarray) -> None:
    layout, columns = _columns(titles)
    if len(columns) > MAX_FIELDS:
        raise Refused("too many title fields")
    out.byte(len(columns))
    cols: list[tuple[np.ndarray, np.ndarray]] = []
    for sep, values in zip([*layout, "\n"], columns, strict=True):
        scheme, x = field_scheme(values)
        if scheme in ("VALUE_RLE", "DELTA_RLE"):
            raise Refused(f"a title field needs the scheme {scheme}")
        out.byte(ord(sep))
        out.byte(int(scheme == "CONST"))
        if scheme == "CONST":
            out.word(len(values[0]))
            out.raw(values[0].encode("latin-1"))
        elif scheme == "TEXT":
            cols.append(_put_text(out, values))
        else:
            cols.append(_put_numbers(out, scheme, x))
    low, high = int(sizes.min()), int(sizes.max())
    cols.append((sizes - low, np.full(len(sizes), width_of(high - low))))
    two = lambda k: np.hstack([np.asarray(c[k]).reshape(len(titles), -1).astype(np.uint64 if k == 0 else np.int64) for c in cols])
    out.put(two(0), two(1))
    out.align()


def _signed(x: int) -> int:
    return x - (1 << 32) if x >= 1 << 31 else x


class _Plain:
    """A number of fixed width in every title."""

    def __init__(self, width: int):
        self.width, self.rest = width, None

    def codes(self, first: bool) -> list[tuple[PrefixReader | None, list[int]]]:
        return [(None, t) for t in plain_tables(self.width)]


class _Numbers:
    """A numeric field: the first title's number, then codes or plain steps."""

    rest = None

    def __init__(self, r: BitReader):
        scheme, self.lo, hi = r.byte(), r.word(), r.word()
        names = {v: k for k, v in NUMERIC_SCHEMES.items()}
        self.name = names.get(scheme)
        if self.name not in ("DELTA_CONST", "DELTA_VAR", "VALUE_VAR"):
            raise ValueError(f"unsupported numeric scheme {scheme}")
        self.dlo, dhi = (_signed(r.word()), _signed(r.word())) if self.name.startswith("DELTA") else (0, 0)
        self.code = PrefixReader(r) if self.name != "DELTA_CONST" and r.byte() else None
        if hi < self.lo or dhi < self.dlo:
            raise ValueError("the limits of a title field are out of order")
        self.lead = width_of(hi - self.lo)
        self.width = 0 if self.name == "DELTA_CONST" else width_of(dhi - self.dlo if self.name == "DELTA_VAR" else hi - self.lo)

    def codes(self, first: bool) -> list[tuple[PrefixReader | None, list[int]]]:
        if not first and self.code:
            return [(self.code, self.code.table)]
        return [(None, t) for t in plain_tables(self.lead if first else self.width)]

    def texts(self, first: np.ndarray, rest: np.ndarray, _) -> list[str]:
        lead = self.lo + joined(first, self.lead)
        step = rest[:, 0] >> LENGTH_BITS if self.code else joined(rest, self.width)
        x = np.r_[lead, self.lo + step] if self.name == "VALUE_VAR" else np.cumsum(np.r_[lead, self.dlo + step])
        return list(map(str, x.tolist()))


class _Text:
    """A text field: characters by position where they are not those of the
    first title; of uneven lengths, each title's length comes before them."""

    def __init__(self, r: BitReader):
        self.even, n, self.most, self.least = bool(r.byte()), r.word(), r.word(), r.word()
        first = r.raw(n)
        fixed = [bool(r.get(1)) for _ in range(n)]
        r.align()
        own = {j: PrefixReader(r) for j in [*[j for j in range(min(self.most, MAX_TEXT_POSITIONS)) if j >= n or not fixed[j]], *([MAX_TEXT_POSITIONS] if self.most >= MAX_TEXT_POSITIONS else [])]}
        if self.most < self.least or n > self.most:
            raise ValueError("the lengths of a title field are out of order")
        size = n if self.even else self.most
        self.base = first[:size] + bytes(size - n)
        self.places = [j for j in range(size) if j >= n or not fixed[j]]
        self.all = [(c := own[min(j, MAX_TEXT_POSITIONS)], c.table) for j in self.places]
        self.width = 0 if self.even else width_of(self.most - self.least)
        # how many characters are stored of a text, by its length
        self.stored = np.searchsorted(self.places, np.arange(size + 1)).tolist()
        self.rest = None if self.even else ([c for c, _ in self.all], [t for _, t in self.all])

    def codes(self, first: bool) -> list[tuple[PrefixReader | None, list[int]]]:
        return self.all if self.even else [(None, t) for t in plain_tables(self.width)]

    def size(self, pieces: list[int]) -> int:
        size = self.least + int(joined(np.array([pieces], np.int64).reshape(1, -1), self.width)[0])
        if size > self.most:
            raise ValueError("the length of a title field is out of range")
        return size

    def texts(self, first: np.ndarray, rest: np.ndarray, uneven: list[tuple[int, list[int]]]) -> list[str]:
        if self.even:
            grid = np.tile(np.frombuffer(self.base, np.uint8), (len(first) + len(rest), 1))
            symbols = np.concatenate([first, rest]) >> LENGTH_BITS
            if (symbols > 255).any():
                raise ValueError("a title symbol is out of range")
            grid[:, self.places] = symbols
            whole, n = grid.tobytes().decode("latin-1"), len(self.base)
            return [whole[k * n : (k + 1) * n] for k in range(len(grid))]
        out = []
        for size, entries in uneven:
            text = bytearray(self.base[:size])
            for j, e in zip(self.places, entries, strict=False):
                text[j] = e >> LENGTH_BITS
            out.append(text.decode("latin-1"))
        return out


def _read_records(r: BitReader, fields: list, first: bool, n: int) -> tuple[list[np.ndarray], list[list[tuple[int, list[int]]]]]:
    """Entries of n titles (titles x codes of each field), and lengths and
    entries of the texts of uneven lengths."""
    each = [f.codes(first) for f in fields]
    runs, codes = [], []  # codes up to each text of uneven lengths, and after the last
    for f, own in zip(fields, each, strict=True):
        codes += own
        if f.rest:
            runs.append(([c for c, _ in codes], [t for _, t in codes], f, len(own)))
            codes = []
    runs.append(([c for c, _ in codes], [t for _, t in codes], None, 0))
    flat: list[int] = []
    uneven: dict[int, list[tuple[int, list[int]]]] = {id(f): [] for f in fields}
    if len(runs) == 1:
        readers, tables, *_ = runs[0]
        many = max(1, 4096 // max(1, len(tables)))  # titles in a row
        for k in range(0, n, many):
            m = min(many, n - k)
            flat += read_each(r, readers * m, tables * m)
    else:
        for _ in range(n):
            for readers, tables, f, own in runs:
                flat += (got := read_each(r, readers, tables))
                if f:
                    size = f.size(got[len(got) - own :])
                    k = f.stored[size]
                    uneven[id(f)].append((size, read_each(r, f.rest[0], f.rest[1][:k])))
    table = np.array(flat, np.int64).reshape(n, sum(map(len, each)))
    ends = np.cumsum([0, *map(len, each)]).tolist()
    return [table[:, a:b] for a, b in pairwise(ends)], [uneven[id(f)] for f in fields]


def get_titles(r: BitReader, n: int, low: int, high: int) -> tuple[list[str], np.ndarray]:
    if high < low:
        raise ValueError("the lengths of a block are out of order")
    fields, parts, const = [], [], ""  # parts: fields, and what all titles have between them
    seps = r.byte()
    for k in range(seps):
        sep = chr(r.byte())
        if k == seps - 1:  # the line's end
            sep = ""
        if r.byte():
            const += r.raw(r.word()).decode("latin-1") + sep
            continue
        fields.append(_Numbers(r) if r.byte() else _Text(r))
        r.align()
        parts += [const, fields[-1]]
        const = sep
    fields.append(_Plain(width_of(high - low)))
    head, lead = _read_records(r, fields, True, min(n, 1))
    rest, others = _read_records(r, fields, False, max(0, n - 1))
    r.align()
    columns = {id(f): f.texts(a, b, x + y) for f, a, b, x, y in zip(fields[:-1], head, rest, lead, others, strict=False)}
    titles = list(map("".join, zip(*[columns[id(p)] if not isinstance(p, str) else repeat(p, n) for p in [*parts, const]], strict=False)))
    return titles, low + joined(np.concatenate([head[-1], rest[-1]]), width_of(high - low))


# -- blocks -----------------------------------------------------------------


def encode_block(titles: list[str], seqs: list[str], quals: list[str], chunk_size: int | None = None, offset: int = QUALITY_OFFSET) -> bytes:
    """The bytes of a block. Raises Refused for what the format can't hold."""
    if not titles:
        raise Refused("a block without records")
    dna, coded, sizes = couple(seqs, quals, offset)
    low, high = int(sizes.min()), int(sizes.max())
    if chunk_size is None:
        chunk_size = sum(map(len, titles)) + 2 * int(sizes.sum()) + 5 * len(titles)
    out = BitWriter()
    for w in (len(titles), high, VARIABLE_LENGTH * (low != high), chunk_size, *[low] * (low != high)):
        out.word(w)
    put_titles(out, titles, sizes)
    put_quality(out, coded, sizes)
    put_dna(out, dna)
    return out.bytes()


def block_head(data: bytes) -> dict[str, int]:
    r = BitReader(data)
    head = dict(zip(("records", "max_q", "flags", "chunk_size"), (r.word() for _ in range(4)), strict=True))
    if head["flags"] & ~VARIABLE_LENGTH:
        raise ValueError(f"unsupported block flags {head['flags']}")
    head["min_q"] = r.word() if head["flags"] & VARIABLE_LENGTH else head["max_q"]
    return head | {"at": r.at}


def decode_block(data: bytes, offset: int = QUALITY_OFFSET, titles_only: bool = False) -> tuple[list[str], list[str], list[str]]:
    """(titles, sequences, qualities); the last two are empty if only titles
    are asked for, which stops after the first section."""
    head = block_head(data)
    r = BitReader(data)
    r.at = head["at"]
    titles, sizes = get_titles(r, head["records"], head["min_q"], head["max_q"])
    if titles_only:
        return titles, [], []
    coded = get_quality(r, sizes)
    dna = get_dna(r, int((coded < COUPLED_BASE).sum()))
    return titles, *uncouple(dna, coded, sizes, offset)


def sections(data: bytes) -> dict[str, int]:
    """Bytes of the sections of a block."""
    head = block_head(data)
    r = BitReader(data)
    r.at = head["at"]
    marks = [r.at // 8]
    _, sizes = get_titles(r, head["records"], head["min_q"], head["max_q"])
    marks.append(r.at // 8)
    coded = get_quality(r, sizes)
    marks.append(r.at // 8)
    get_dna(r, int((coded < COUPLED_BASE).sum()))
    marks.append(r.at // 8)
    return dict(zip(("titles", "quality", "dna"), (b - a for a, b in pairwise(marks)), strict=True))
