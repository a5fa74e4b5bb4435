"""Bit streams (most significant bit first) and prefix codes, on arrays."""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np


class BitWriter:
    """Collects (value, width) arrays and packs them at once."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []
        self.n = 0

    def put(self, values, widths) -> None:
        """Arrays of values and their widths (0 to 32 bits), row by row."""
        v = np.asarray(values, np.uint64)
        w = np.full(v.size, widths, np.int64) if isinstance(widths, int) else np.broadcast_to(np.asarray(widths, np.int64), v.shape).ravel()
        self.values.append(v.ravel())
        self.widths.append(w)
        self.n += int(w.sum())

    def word(self, value: int) -> None:
        self.put([value & 0xFFFFFFFF], 32)

    def byte(self, value: int) -> None:
        self.put([value], 8)

    def raw(self, data: bytes) -> None:
        self.put(np.frombuffer(data, np.uint8), 8)

    def align(self) -> None:
        if self.n % 8:
            self.put([0], 8 - self.n % 8)

    def bytes(self) -> bytes:
        """The bits as 64-bit words: a value lies in one, or in two in a row."""
        self.align()
        if not self.n:
            return b""
        v, w = np.concatenate(self.values), np.concatenate(self.widths)
        v, w = v[w > 0], w[w > 0]
        ends = np.cumsum(w)
        word, over = (ends - w) >> 6, ((ends - w) & 63) + w - 64
        v = v & (~np.uint64(0) >> (64 - w).astype(np.uint64))
        first = np.where(over > 0, v >> np.maximum(over, 0).astype(np.uint64), v << np.maximum(-over, 0).astype(np.uint64))
        out = np.zeros(-(-self.n // 64), np.uint64)
        lead = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[lead]] = np.add.reduceat(first, lead)
        two = np.flatnonzero(over > 0)
        out[word[two] + 1] += v[two] << (64 - over[two]).astype(np.uint64)
        return out.astype(">u8").tobytes()[: self.n // 8]


#: Bits looked at together when codes are decoded.
WINDOW = 10


class BitReader:
    """Reads from any bit on; raises EOFError beyond the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)
        self._windows: memoryview | None = None

    @property
    def windows(self) -> memoryview:
        """The WINDOW bits that follow each bit (zeros beyond the end)."""
        if self._windows is None:
            b = np.frombuffer(self.data + bytes(3), np.uint8).astype(np.uint32)
            wide = (b[:-2] << 16 | b[1:-1] << 8 | b[2:])[:, None]
            shift = (24 - WINDOW - np.arange(8, dtype=np.uint32))[None, :]
            self._windows = memoryview(((wide >> shift) & ((1 << WINDOW) - 1)).astype(np.uint16).ravel())
        return self._windows

    def bits(self, n: int) -> str:
        """The next n bits as text, or as many as there are."""
        lo, hi = self.at // 8, min(len(self.data), -(-(self.at + n) // 8))
        return format(int.from_bytes(b"\1" + self.data[lo:hi], "big"), "b")[1 + self.at - 8 * lo :]

    def array(self, count: int, width: int) -> np.ndarray:
        """count values of equal width."""
        n = count * width
        if self.at + n > self.end:
            raise EOFError("the bit stream ends too early")
        lo, hi = self.at // 8, -(-(self.at + n) // 8)
        bits = np.unpackbits(np.frombuffer(self.data[lo:hi], np.uint8))[self.at - 8 * lo :][:n].reshape(count, width)
        self.at += n
        return bits @ (1 << np.arange(width)[::-1])

    def get(self, width: int) -> int:
        to = self.at + width
        if to > self.end:
            raise EOFError("the bit stream ends too early")
        if self._windows is not None and width <= WINDOW:
            out = self._windows[self.at] >> (WINDOW - width)
            self.at = to
            return out
        lo, hi = self.at // 8, (to + 7) // 8
        out = (int.from_bytes(self.data[lo:hi], "big") >> (8 * hi - to)) & ((1 << width) - 1)
        self.at = to
        return out

    def word(self) -> int:
        return self.get(32)

    def byte(self) -> int:
        return self.get(8)

    def raw(self, n: int) -> bytes:
        return bytes(self.get(8) for _ in range(n))

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8


def width_of(x: int) -> int:
    """Smallest n with x < 2**n."""
    return int(x).bit_length()


def id_width(n: int) -> int:
    """Smallest b with 2**b >= n."""
    return max(0, int(n) - 1).bit_length()


class PrefixCode:
    """Optimal code for counts by symbol. The two least nodes, by (count, id),
    are joined; a joined node's id is above all before it. Symbols that do not
    occur have no code; there are two leaves at least."""

    def __init__(self, counts):
        counts = [int(c) for c in counts]
        n = self.n = max(2, len(counts))
        counts += [0] * (n - len(counts))
        live = [s for s in range(n) if counts[s]]
        if len(live) < 2:
            live = sorted(range(n), key=lambda s: (counts[s], s))[-2:]
        least = 1 if n == 2 else 0  # of two symbols, one that does not occur counts once
        heap = [(max(counts[s], least), s) for s in live]
        heapq.heapify(heap)
        self.kids: dict[int, tuple[int, int]] = {}
        node = n
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            self.kids[node] = (a[1], b[1])
            heapq.heappush(heap, (a[0] + b[0], node))
            node += 1
        self.root = heap[0][1]
        self.code, self.width = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        shape, stack = [], [(self.root, 0, 0)]
        while stack:
            at, code, depth = stack.pop()
            if at < n:
                self.code[at], self.width[at] = code, depth
                shape.append((1, 1))
                shape.append((at, id_width(n)))
            else:
                shape.append((0, 1))
                a, b = self.kids[at]
                stack += [(b, 2 * code + 1, depth + 1), (a, 2 * code, depth + 1)]
        self.shape = shape

    def store(self, out: BitWriter) -> None:
        out.align()
        bits = sum(w for _, w in self.shape)
        head = 13 + -(-bits // 8), self.root, self.n, int(self.width[self.width > 0].min())
        out.put([*head, *[v for v, _ in self.shape], 0], [32, 32, 32, 8, *[w for _, w in self.shape], -bits % 8])


class PrefixCodes:
    """The codes of many histograms over the same symbols (a row each), built
    in step: code and width are matrices, rows x symbols."""

    def __init__(self, counts: np.ndarray):
        rows, n = len(counts), max(2, counts.shape[1])
        self.n, self.rows = n, rows
        counts = np.pad(counts.astype(np.int64), ((0, 0), (0, n - counts.shape[1])))
        live = counts > 0
        few = np.flatnonzero(live.sum(axis=1) < 2)
        if len(few):  # the two that come last by (count, symbol)
            last = np.argsort(counts[few], axis=1, kind="stable")[:, -2:]
            live[few] = False
            live[few[:, None], last] = True
        kinds = live.sum(axis=1)
        order = np.argsort(-kinds, kind="stable")  # rows with most symbols first, so that those still at work lead
        counts, live, kinds = counts[order], live[order], kinds[order]
        none = np.iinfo(np.int64).max
        node = np.full((rows, 2 * n - 1), none, np.int64)
        node[:, :n] = np.where(live, np.maximum(counts, 1 if n == 2 else 0), none)
        most = int(kinds.max(initial=0))
        work = [int(np.searchsorted(-kinds, -i - 1, side="left")) for i in range(most)]  # rows with over i + 1 symbols
        kids = np.zeros((2, rows, max(1, most - 1)), np.int64)
        for i in range(most - 1):
            own, at = node[: work[i], : n + i], np.arange(work[i])
            total = np.zeros(work[i], np.int64)
            for side in range(2):
                k = own.argmin(axis=1)
                total += own[at, k]
                own[at, k] = none
                kids[side, : work[i], i] = k
            node[: work[i], n + i] = total
        code, width = np.zeros((rows, 2 * n - 1), np.uint64), np.zeros((rows, 2 * n - 1), np.int64)
        for i in reversed(range(most - 1)):
            at = np.arange(work[i])
            for side in range(2):
                k = kids[side, : work[i], i]
                code[at, k] = 2 * code[at, n + i] + np.uint64(side)
                width[at, k] = width[at, n + i] + 1
        back = np.argsort(order, kind="stable")
        self.code, self.width, self.kinds = code[back, :n], width[back, :n], kinds[back]
        self.root = n + self.kinds - 2

    def store(self, out: BitWriter) -> None:
        """All codes, one after another, as PrefixCode.store() writes each. A
        tree in preorder is, leaf by leaf in order of codes, a 0 for each node
        on the way that the leaf before did not have, a 1 and the symbol."""
        out.align()
        if self.rows:
            out.put(*self.stored())

    def stored(self) -> tuple[np.ndarray, np.ndarray]:
        """Values and widths of what is stored, a row for each code."""
        if self.width.max() > 50:
            raise ValueError("a code tree is too deep")
        wide, most = id_width(self.n), int(self.kinds.max())
        key = np.where(self.width > 0, self.code << (50 - self.width).astype(np.uint64), np.uint64(1) << np.uint64(50))
        leaf = np.argsort(key, axis=1, kind="stable")[:, :most]
        there = np.arange(most)[None, :] < self.kinds[:, None]
        key, width = np.take_along_axis(key, leaf, 1), np.take_along_axis(self.width, leaf, 1)
        same = 50 - np.frexp((key[:, 1:] ^ key[:, :-1]).astype(float))[1]  # leading bits like the leaf before
        new = np.column_stack([width[:, 0], width[:, 1:] - same - 1])
        sizes = np.where(there, new + 1 + wide, 0)
        bits = sizes.sum(axis=1)
        least = np.where(self.width > 0, self.width, 64).min(axis=1)
        full = lambda x: np.broadcast_to(x, self.rows)
        values = np.column_stack([13 + -(-bits // 8), self.root, full(self.n), least, leaf | 1 << wide, full(0)])
        return values, np.column_stack([full(32), full(32), full(32), full(8), sizes, -bits % 8])


#: Bits of a table's entry that are the length; the symbol is above them.
LENGTH_BITS = 4
#: Bits of the longest code.
DEEPEST = 64


class PrefixReader:
    """A stored code, decoded through a table of the first bits: entries of
    symbol and length, 0 where a code is longer than the window."""

    def __init__(self, r: BitReader):
        r.align()
        _, self.root, n, _ = r.word(), r.word(), r.word(), r.byte()
        wide = id_width(n)
        self.long: dict[tuple[int, int], int] = {}
        self.table: list[int] = []
        # leaves come in the order of their codes: each is a 0 for every node on
        # the way that the leaf before did not have, a 1 and the symbol; place is
        # the code, from bit DEEPEST down
        seen, at, place, table = r.bits(2 * n + n * wide), 0, 0, self.table
        while place < 1 << DEEPEST:
            one = seen.find("1", at)
            if not 0 <= one < one + wide + 1 <= len(seen):
                raise EOFError("the bit stream ends too early")
            depth = (DEEPEST + 1 - (place & -place).bit_length() if place else 0) + one - at
            at = one + 1 + wide
            symbol = int(seen[one + 1 : at] or "0", 2)
            if depth > DEEPEST:
                raise ValueError("a code tree is too deep")
            if depth <= WINDOW:
                table += [symbol << LENGTH_BITS | depth if depth else 0] * (1 << (WINDOW - depth))
            else:
                self.long[place >> (DEEPEST - depth), depth] = symbol
                if len(table) == place >> (DEEPEST - WINDOW):
                    table.append(0)
            place += 1 << (DEEPEST - depth)
        r.at += at
        r.align()

    def beyond(self, r: BitReader) -> int:
        """The entry (without a length) of a code longer than the window."""
        code, depth = r.get(WINDOW), WINDOW
        while depth < 64:
            code, depth = 2 * code + r.get(1), depth + 1
            if (code, depth) in self.long:
                return self.long[code, depth] << LENGTH_BITS
        raise ValueError("no such code")

    def many(self, r: BitReader, count: int) -> np.ndarray:
        """count symbols in a row: where a code that starts at any bit would
        end is known at once; every STRIDE-th start is walked to, the others
        follow from these together."""
        table = np.array(self.table, np.int64)
        seen = np.frombuffer(r.windows, np.uint16)[r.at : r.end]
        bits = len(seen)
        entry = table[seen]
        step = np.r_[np.minimum(np.arange(bits) + (entry & ((1 << LENGTH_BITS) - 1)), bits), bits].astype(np.int32)
        far = step
        for _ in range(STRIDE.bit_length() - 1):
            far = far[far]
        starts = np.empty((-(-count // STRIDE), STRIDE), np.int32)
        at, jump, lead = 0, memoryview(far), []
        for _ in range(len(starts)):
            lead.append(at)
            at = jump[at]
        starts[:, 0] = lead
        for k in range(1, STRIDE):
            starts[:, k] = step[starts[:, k - 1]]
        starts = starts.ravel()[:count]
        if count and starts[-1] >= bits:
            raise EOFError("the bit stream ends too early")
        found = entry[starts]
        stop = np.flatnonzero(found == 0)
        if len(stop):  # a code longer than the window: the rest one by one
            r.at += int(starts[stop[0]])
            rest = read_each(r, [self] * (count - int(stop[0])), [self.table] * (count - int(stop[0])))
            return np.r_[found[: stop[0]], rest].astype(np.int64) >> LENGTH_BITS
        if count:
            end = int(starts[-1]) + int(found[-1] & ((1 << LENGTH_BITS) - 1))
            if end > bits:
                raise EOFError("the bit stream ends too early")
            r.at += end
        return found >> LENGTH_BITS


#: Symbols between the starts that PrefixReader.many() walks to; a power of two.
STRIDE = 16


def read_each(r: BitReader, codes: list, tables: list[list[int]]) -> list[int]:
    """Entries of each code in turn (tables are those of codes)."""
    windows, at, out = r.windows, r.at, []
    push, length = out.append, (1 << LENGTH_BITS) - 1
    try:
        for t in tables:
            if e := t[windows[at]]:
                at += e & length
            else:
                r.at = at
                e = codes[len(out)].beyond(r)
                at = r.at
            push(e)
    except IndexError:
        at = r.end + 1
    if at > r.end:
        raise EOFError("the bit stream ends too early")
    r.at = at
    return out


def read_rows(r: BitReader, codes: list, sizes: list[int], cut: list[int] | None, fill: int) -> list[int]:
    """Entries of rows of these sizes, of the first codes each. With ``cut`` a bit
    says whether a row's number of codes comes first, in cut's bits of this row;
    the rest of the row is then ``fill``."""
    windows, at, out, tables = r.windows, r.at, [], [c.table for c in codes]
    push, length, most = out.append, (1 << LENGTH_BITS) - 1, len(codes)
    try:
        for k, n in enumerate(sizes):
            keep = n
            if cut:
                at += 1
                if windows[at - 1] >> (WINDOW - 1):
                    r.at = at
                    keep = r.get(cut[k])
                    at = r.at
            if keep > n or n > most:
                raise ValueError("a length is out of range")
            start = len(out)
            for t in tables if keep == most else tables[:keep]:
                if e := t[windows[at]]:
                    at += e & length
                else:
                    r.at = at
                    e = codes[len(out) - start].beyond(r)
                    at = r.at
                push(e)
            if keep < n:
                out += [fill] * (n - keep)
    except IndexError:
        at = r.end + 1
    if at > r.end:
        raise EOFError("the bit stream ends too early")
    r.at = at
    return out


@lru_cache(WINDOW)
def plain_table(width: int) -> list[int]:
    """The table that reads numbers of 1 to WINDOW bits."""
    return ((np.arange(1 << WINDOW) >> (WINDOW - width) << LENGTH_BITS) | width).tolist()


def plain_tables(width: int) -> list[list[int]]:
    """Tables that read the pieces of a number of any width, highest first."""
    return [plain_table(WINDOW)] * (width // WINDOW) + ([plain_table(width % WINDOW)] if width % WINDOW else [])


def joined(pieces: np.ndarray, width: int) -> np.ndarray:
    """Numbers from their pieces' entries (numbers x pieces)."""
    out = np.zeros(len(pieces), np.int64)
    for k in range(pieces.shape[1]):
        out = out << min(WINDOW, width - WINDOW * k) | pieces[:, k] >> LENGTH_BITS
    return out
