"""SQL expressions shared by the read operators (Spark dialect)."""

from __future__ import annotations

from ..schema import ALPHABET, COUPLED_BASE, COUPLING_QUALITY, MAX_NUMBER, QUALITY_OFFSET

#: One title separator.
SEPARATOR = "[ ._,=:/#-]"
#: A merged node's symbol: above any symbol, so leaves win ties.
MERGED = 1_000_000_000


def base_index(char: str) -> str:
    """0-based index of a base in the alphabet; -1 if it is none."""
    return f"(instr('{ALPHABET}', {char}) - 1)"


def cells(seq: str = "seq", qual: str = "qual", offset: int = QUALITY_OFFSET) -> str:
    """Array of (b, q): base index and quality of each position."""
    at = f"transform(sequence(1, length({seq})), i -> named_struct('b', {base_index(f'substring({seq}, i, 1)')}, 'q', ascii(substring({qual}, i, 1)) - {offset}))"
    return f"if(length({seq}) = 0, cast(array() as array<struct<b:int,q:int>>), {at})"


def coupled_quality(b: str, q: str) -> str:
    """Quality that carries a base the sequence stream leaves out."""
    return f"if({leaves_out(b, q)}, {COUPLED_BASE} + ({b} - 4) * 8 + {q}, {q})"


def leaves_out(b: str, q: str) -> str:
    return f"({b} > 3 and {q} < {COUPLING_QUALITY})"


def bit_width(x: str) -> str:
    """Smallest n with x < 2^n, for x >= 0."""
    return f"(case when {x} = 0 then 0 else length(bin({x})) end)"


def id_width(n: str) -> str:
    """Smallest b with 2^b >= n."""
    return f"(case when {n} <= 1 then 0 else length(bin({n} - 1)) end)"


def is_number(s: str) -> str:
    """Canonical unsigned decimal up to 2^30."""
    return f"({s} rlike '^(0|[1-9][0-9]*)$' and length({s}) <= 10 and coalesce(try_cast({s} as bigint), {MAX_NUMBER + 1}) <= {MAX_NUMBER})"


def trimmed_length(qual: str = "qual") -> str:
    """1 + place of the last quality that is not 2; 1 if all are, 0 if none."""
    return f"(case when length({qual}) = 0 then 0 else greatest(1, length(rtrim('#', {qual}))) end)"


def huffman_bits(h: str) -> str:
    """Bits that an optimal code spends on h, an array of (f, sym) in ascending
    order; a lone symbol costs a bit each time."""
    return f"""(case when size({h}) = 0 then 0L when size({h}) = 1 then {h}[0].f else
      aggregate(sequence(1, size({h}) - 1), named_struct('h', {h}, 'cost', 0L),
        (a, i) -> named_struct('h', array_sort(concat(slice(a.h, 3, size(a.h)), array(named_struct('f', a.h[0].f + a.h[1].f, 'sym', cast({MERGED} + i as bigint))))),
                               'cost', a.cost + a.h[0].f + a.h[1].f), a -> a.cost) end)"""


def tree_bytes(present: str, n: str) -> str:
    """Stored size of a code tree with ``present`` leaves over n symbols."""
    p = f"greatest(2, {present})"
    return f"(13 + cast(ceil(({p} - 1 + {p} * (1 + {id_width(n)})) / 8) as bigint))"
