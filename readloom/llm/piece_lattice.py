"""SentencePiece encoding and decoding as a relational lattice.

A text is escaped as the model asks (a leading mark, ``U+2581`` for a space)
and cut into words where no piece reaches over: at line feeds, before a run of
marks, after letters before punctuation that no piece has there; longer words
also between any two characters that are adjacent in no piece. One pass over
the texts keeps each document's words as places in a dictionary of its chunk
(``chunk_chars`` characters of a task's documents at most), written to a file in
the shared folder, and gives the dictionaries' rows. The first places of every
dictionary are the ``hot`` commonest words of a bounded sample of documents,
which are solved once and sent to every task; which words these are has no
effect on results. For distinct words:

* each is exploded into its substrings of two characters and more, but no
  longer than the longest piece, which are equi-joined with the piece table (a
  parameter of fixed size, broadcast);
* the matches, which are the edges of the word's lattice, are grouped by word
  (two 64-bit hashes) and folded with ``aggregate`` into the word's symbols:

  - unigram models: Viterbi. The fold over edges by end keeps the best (score,
    start) of each end; a second one walks back. (Single characters are
    exploded and joined too, as their scores count.)
  - BPE models: best-path search gives other ids than the SentencePiece
    library, whose BPE merges greedily, so the fold merges. The state is the
    next boundary after each boundary; the edge of best score (ties: the
    leftmost) that spans two adjacent symbols makes them one, again and again.

Characters that stay alone are replaced by their pieces, or by those of their
UTF-8 bytes where they have none. Words of any length take the same way. The
answers go back to their chunks' dictionaries, and documents are put together
there: what is shuffled is dictionaries, never texts or occurrences of words.

Defined cases: null or empty text has no ids and decodes to the empty text;
repeated rows each get a row; a null id is kept; an empty table gives an empty
result; only the id and text columns are read, so others cannot clash; long
texts and words are whole (a word's edges are one row, and the cost of a run of
one character grows with the square of its length). Ids that decode to bytes which are not UTF-8 give
U+FFFD for each such byte, unknown ids `` U+2047 ``, control ids nothing, as in
the library; an id outside the model raises ValueError.
"""

from __future__ import annotations

import codecs
import re
import string
import struct
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import shared_dir
from ..shipping import ship
from .common import digest_of

MARK = "▁"
UNKNOWN_TEXT = " ⁇ "
#: Words beyond this are also cut between characters that no piece holds side by side.
CUT_BEYOND = 32
#: Characters of texts that share a dictionary, and words of a document batch.
CHUNK_CHARS = 64 << 20
BATCH_WORDS = 200_000
#: Common words that every dictionary begins with, and documents they are taken from.
HOT = 300_000
SAMPLE_DOCS = 12_000
#: Dictionary rows of a task that folds words.
FOLD_ROWS = 250_000
#: Characters of a word that are exploded at a time.
SPAN = 256
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNK_PENALTY = 10.0
_LETTER = r"[^\W\d_]"


@dataclass(frozen=True)
class Pieces:
    """A SentencePiece model: pieces with score and id, and how text is escaped."""

    kind: int
    table: tuple[tuple[str, float, int], ...]
    byte0: int
    prefix: bool
    unknown: tuple[int, ...] = (0,)
    control: tuple[int, ...] = (1, 2)

    @cached_property
    def pairs(self) -> set[str]:
        """Characters that stand side by side in a piece."""
        return {a + b for p, _, _ in self.table for a, b in zip(p, p[1:], strict=False)}

    @cached_property
    def after_letter(self) -> str:
        """ASCII punctuation that no piece has right after a letter; a text can
        be cut before it there, as no edge of the lattice reaches over."""
        joined = {x[1] for x in self.pairs if re.match(_LETTER, x[0])}
        return "".join(c for c in string.punctuation if c not in joined)

    @cached_property
    def singles(self) -> str:
        """Characters that are a piece, in order of ids."""
        return "".join(p for p, _, _ in sorted(self.table, key=lambda x: x[2]) if len(p) == 1)

    @cached_property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.table), default=1)

    def ranked(self) -> list[tuple[str, float, int, int, int]]:
        """(piece, score, id, rank, stands): rank ascends as scores fall. stands
        is 1 where every longer piece that holds this one ranks behind it, 2
        where some rank like it and none before, else 0."""
        order = {s: k for k, s in enumerate(sorted({s for _, s, _ in self.table}, reverse=True))}
        rank = {p: order[s] for p, s, _ in self.table}
        least: dict[str, int] = {}
        for p, r in rank.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p) and r < least.get(p[i:j], 1 << 30):
                        least[p[i:j]] = r
        stands = {p: (least.get(p, 1 << 30) > r) + 2 * (least.get(p) == r) for p, r in rank.items()}
        return [(p, s, i, rank[p], stands[p]) for p, s, i in self.table]


def _fields(b: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            c = b[at]
            at += 1
            out |= (c & 127) << shift
            shift += 7
            if c < 128:
                return out

    while at < len(b):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = number() if key & 7 == 2 else {5: 4, 1: 8}[key & 7]
            yield key >> 3, b[at : at + n]
            at += n


def load(path: str) -> Pieces:
    """Read a model file. Raises NotImplementedError for what the lattice does
    not cover: a normalisation other than identity, no byte pieces, pieces of
    the user or out of use."""
    pieces, trainer, norm = [], {}, {}
    with open(path, "rb") as f:
        for k, v in _fields(f.read()):
            if k == 1:
                d = dict(_fields(v))
                pieces.append((d[1].decode(), struct.unpack("<f", d.get(2, bytes(4)))[0], d.get(3, NORMAL)))
            elif k == 2:
                trainer = dict(_fields(v))
            elif k == 3:
                norm = dict(_fields(v))
    of = lambda kind: tuple(i for i, p in enumerate(pieces) if p[2] == kind)
    byte, kind = of(BYTE), trainer.get(3, UNIGRAM)
    odd = norm.get(2) or norm.get(4, 1) or not norm.get(5, 1) or len(byte) != 256 or byte != tuple(range(byte[0], byte[0] + 256)) or kind not in (UNIGRAM, BPE)
    odd = odd or any(t not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, t in pieces)
    table = tuple((p, s, i) for i, (p, s, t) in enumerate(pieces) if t == NORMAL)
    if odd or any(MARK in p.lstrip(MARK) or "\n" in p for p, _, _ in table):
        raise NotImplementedError("this model's normalisation, pieces or type")
    return Pieces(kind, table, byte[0], bool(norm.get(3, 1)), of(UNKNOWN), of(CONTROL))


# -- words ------------------------------------------------------------------


class Words(dict):
    """Places of words, given as they come up. Long words are not taken up
    before they are cut; ``cut`` tells that one came."""

    def __init__(self, model: Pieces, hot: list[str] = ()):
        super().__init__(zip(hot, range(len(hot)), strict=True))
        stop = "".join(map(re.escape, model.after_letter))
        first = rf" *{_LETTER}++(?=[{stop}])|" if stop else ""
        self.find = re.compile(first + r"\n| *[^ \n]+| +").findall
        self.model, self.cut, self.whole = model, False, False

    def __missing__(self, word: str) -> int:
        if len(word) > CUT_BEYOND and not self.whole:
            self.cut = True
            return 0
        at = self[word] = len(self)
        return at

    def parts(self, word: str) -> list[str]:
        """A long word cut where no piece reaches over."""
        if len(word) <= CUT_BEYOND:
            return [word]
        known, w = self.model.pairs, word.replace(" ", MARK)
        cuts = [0, *[i for i in range(1, len(w)) if w[i - 1 : i + 1] not in known], len(w)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def places(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        text = text.replace(MARK, " ")
        words = self.find(" " + text if self.model.prefix else text)
        self.cut = False
        got = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        if self.cut:
            self.whole, words = True, [p for w in words for p in self.parts(w)]
            got = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
            self.whole = False
        return got


def common_words(docs: DataFrame, model: Pieces, text_col: str = "text", most: int = HOT, sample_docs: int = SAMPLE_DOCS) -> list[str]:
    """The commonest words of a bounded sample of documents (by text hash), as
    in a text (with spaces for marks); at most ``most`` of CUT_BEYOND characters."""
    ship(docs.sparkSession)
    share = min(1.0, sample_docs / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64(F.lit("hot"), text_col), F.lit(1_000_000)) < F.lit(int(1_000_000 * share))).select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, prefix = Words(model).find, " " * model.prefix
        for b in batches:
            seen = Counter()
            for text in filter(None, b.column("text").to_pylist()):
                seen.update(find(prefix + text.replace(MARK, " ")))
            own = [(w, n) for w, n in seen.items() if len(w) <= CUT_BEYOND]
            yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in own], pa.string()), "times": pa.array([n for _, n in own], pa.int64())})

    found = some.mapInArrow(run, "word string, times long").groupBy("word").agg(F.sum("times").alias("times"))
    return found.orderBy(F.desc("times"), "word").limit(most).select("word").toArrow()["word"].to_pylist()


def dictionaries(docs: DataFrame, model: Pieces, folder: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, hot: list[str] = ()) -> DataFrame:
    """(chunk, at, word): the dictionary of each chunk from place len(hot) on,
    and a row for the chunk itself at place -1. A file in ``folder`` that bears
    the chunk's number holds its documents as (id, th, low, high), the latter
    being the halves of places. A chunk's number is drawn by the attempt that
    writes it, and the rows go to a table, so only files of attempts that
    succeeded are ever read."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(list(hot))  # HOT words of CUT_BEYOND characters at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, top = FileSystem.from_uri(folder)
        fs.create_dir(f"{top}/docs", recursive=True)
        own, out, chunk, chars, held, size = Words(model, shared.value), None, 0, 0, [], 0

        def flush() -> None:
            nonlocal out, chunk, held, size
            if not held:
                return
            ids, th, words = zip(*held, strict=True)
            ends = np.cumsum([0, *map(len, words)]).astype(np.int32)
            flat = np.concatenate(words)
            halves = [pa.ListArray.from_arrays(ends, x.astype(np.uint16)) for x in (flat & 0xFFFF, flat >> 16)]
            b = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(th, pa.int64()), *halves], ["id", "th", "low", "high"])
            if out is None:
                chunk = uuid.uuid4().int >> 65
                out = pa.ipc.new_file(fs.open_output_stream(f"{top}/docs/{chunk}.arrow"), b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            out.write_batch(b)
            held, size = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal out, own, chars
            flush()
            if out is not None:
                out.close()
                n = len(shared.value)
                words = [w.replace(" ", MARK) for w in islice(own, n, None)]
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "at": pa.array([-1], pa.int32()), "word": pa.array([""])})
                for k in range(0, len(words), 50_000):
                    part = words[k : k + 50_000]
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(part), chunk)), "at": pa.array(np.arange(n + k, n + k + len(part), dtype=np.int32)), "word": pa.array(part, pa.string())})
            out, own, chars = None, Words(model, shared.value), 0

        for b in batches:
            keys = b.column("id")
            for k, (text, th) in enumerate(zip(b.column("text").to_pylist(), b.column("th").to_pylist(), strict=True)):
                words = own.places(text)
                held.append((keys[k : k + 1], th, words))
                size += len(words) + 100
                chars += len(text or "")
                if size > BATCH_WORDS:
                    flush()
                if chars > chunk_chars:
                    yield from close()
        yield from close()

    rows = docs.select(F.col(id_col).alias("id"), digest_of(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    rows.mapInArrow(run, "chunk long, at int, word string").write.option("compression", "zstd").parquet(f"{folder}/rows")
    return spark.read.parquet(f"{folder}/rows")


# -- folds ------------------------------------------------------------------

_NONE = "cast(-1 as int)"


def _merge(most: int) -> str:
    """BPE. nx[i]: where the symbol that starts at i ends, -1 if none starts
    there. An edge fits when it spans two symbols. ``many`` is in order of
    (rank, start); a pass makes every edge that fits one symbol, until a longer
    piece around it might come before the edges that follow (where ranks are
    equal, only one that takes in the symbol on the left): the next pass is from
    the first edge again."""
    joined = f"concat(slice(a.nx, 1, x.s), array(x.e), array_repeat({_NONE}, x.e - x.s - 1), slice(a.nx, x.e + 1, n - x.e))"
    left = f"x.s > 0 and x.e - x.s < {most} and exists(sequence(greatest(0, x.e - {most}), x.s - 1), i -> get(a.nx, i) = x.s)"
    one = f"if(a.again or not coalesce(get(a.nx, get(a.nx, x.s)) = x.e, false), a, named_struct('nx', {joined}, 'again', case x.mark when 1 then false when 2 then {left} else true end))"
    each = f"aggregate(many, named_struct('nx', p.nx, 'again', false), (a, x) -> {one})"
    return f"""aggregate(if(size(many) = 0, cast(array() as array<int>), sequence(1, n)),
      named_struct('nx', sequence(1, n), 'again', true), (p, i) -> if(not p.again, p, {each}), p -> p.nx)"""


def _viterbi(model: Pieces) -> str:
    """Unigram. ``by_end`` is in order of (end, start); a tie keeps the
    smallest start. The walk back lays out nx as _merge() does."""
    unk = f"cast({min((x for _, x, _ in model.table), default=0.0) - UNK_PENALTY!r} as float)"
    start = "named_struct('score', cast(0 as float), 's', 0)"
    way = f"named_struct('score', cast(if(size(a.best) = x.e, a.best, concat(a.best, array(a.top)))[x.s].score + if(x.mark, {unk}, x.score) as float), 's', x.s)"
    step = f"""transform(array({way}), w -> if(size(a.best) = x.e,
        named_struct('best', a.best, 'top', if(w.score > a.top.score, w, a.top)),
        named_struct('best', concat(a.best, array(a.top)), 'top', w)))[0]"""
    # best[e] for ends before the open one, whose best so far is top
    forth = f"aggregate(by_end, named_struct('best', cast(array() as array<struct<score:float,s:int>>), 'top', {start}), (a, x) -> {step}, a -> concat(a.best, array(a.top)))"
    back = f"""aggregate(sequence(1, n), named_struct('at', n, 'nx', cast(array() as array<int>)), (a, i) -> if(a.at = 0, a,
        transform(array(best[a.at].s), s -> named_struct('at', s, 'nx', concat(array(a.at), array_repeat({_NONE}, a.at - s - 1), a.nx)))[0]), a -> a.nx)"""
    return f"transform(array({forth}), best -> {back})[0]"


def solved(words: DataFrame, model: Pieces) -> DataFrame:
    """(w1, w2, ids) of those of the distinct (w1, w2, word) that have an edge
    of two characters (unigram: of all); w1 and w2 tell words apart and rows
    are dealt by them. A character that stays alone at place s is -1 - s. For
    BPE an edge is one number, so that edges are gathered and sorted as such:
    rank, start, length, id and whether the piece stands."""
    spark = words.sparkSession
    ship(spark)
    most, ranked, least = model.longest, model.ranked(), 1 if model.kind == UNIGRAM else 2
    table = spark.createDataFrame(ranked, "piece string, score float, id int, rank int, stands int")
    long = words.select("w1", "w2", "word", F.explode(F.expr(f"sequence(0, cast((char_length(word) - 1) div {SPAN} as int))")).alias("k"))
    long = long.select("w1", "w2", "k", F.char_length("word").alias("n"), F.expr(f"substring(word, k * {SPAN} + 1, {SPAN + most - 1})").alias("part"))
    at = long.select("w1", "w2", "k", "n", "part", F.explode(F.expr(f"sequence(0, least({SPAN}, char_length(part)) - 1)")).alias("i"))
    at = at.select("w1", "w2", "n", F.expr(f"k * {SPAN} + i").alias("s"), F.expr(f"substring(part, i + 1, {most})").alias("tail")).where(F.char_length("tail") >= least)
    sub = at.select("w1", "w2", "n", "s", "tail", F.explode(F.expr(f"sequence({least}, char_length(tail))")).alias("m"))
    sub = sub.select("w1", "w2", "n", "s", "m", F.substring("tail", F.lit(1), F.col("m")).alias("piece"))
    # the join is on a hash, which Spark looks up fast; the pieces themselves are compared as well
    table = F.broadcast(table.select(F.xxhash64("piece").alias("key"), F.col("piece").alias("known"), "score", "id", "rank", "stands"))
    key = F.xxhash64("piece") == F.col("key")
    if model.kind == UNIGRAM:
        edges = sub.join(table, key, "left").withColumn("id", F.expr("if(piece <=> known, id, null)")).where("id is not null or m = 1")
        edge, name, fold = "named_struct('e', s + m, 's', s, 'score', score, 'id', coalesce(id, -1 - s), 'mark', id is null)", "by_end", _viterbi(model)
        each = "array_sort(edges)"
    else:
        edges = sub.join(table, key & (F.col("piece") >= F.col("known")) & (F.col("piece") <= F.col("known")))
        ids, size = max((i for _, _, i in model.table), default=0).bit_length(), most.bit_length()
        room = 63 - 2 - ids - size - max((r for *_, r, _ in ranked), default=0).bit_length()
        part = lambda low, bits: f"cast(shiftright(x, {low}) & {(1 << bits) - 1} as int)"
        far = f"if(s >= {1 << room}, raise_error('a word of {1 << room} characters or more that cannot be cut'), cast(s as bigint))"
        edge = f"shiftleft(cast(rank as bigint), {room + size + ids + 2}) | shiftleft({far}, {size + ids + 2}) | shiftleft(cast(m as bigint), {ids + 2}) | shiftleft(cast(id as bigint), 2) | cast(stands as bigint)"
        each = f"transform(sort_array(edges), x -> named_struct('s', {part(size + ids + 2, room)}, 'e', {part(size + ids + 2, room)} + {part(ids + 2, size)}, 'id', {part(2, ids)}, 'mark', cast(x & 3 as int)))"
        name, fold = "many", _merge(most)
    edges = edges.select("w1", "w2", "n", F.expr(edge).alias("x"))
    edges = edges.groupBy("w1", "w2").agg(F.max("n").alias("n"), F.collect_list("x").alias("edges"))
    found = f"transform(filter({name}, x -> get(nx, x.s) = x.e), x -> shiftleft(cast(x.s as bigint), 32) | (x.id & {0xFFFFFFFF}))"
    alone = "transform(filter(sequence(0, n - 1), s -> nx[s] = s + 1), s -> shiftleft(cast(s as bigint), 32) | (-1 - s & 4294967295))"
    both = found if model.kind == UNIGRAM else f"concat({found}, {alone})"
    ids_of = f"transform(sort_array({both}), x -> cast(if((x & 2147483648) = 0, x & 4294967295, (x & 4294967295) - 4294967296) as int))"
    return edges.select("w1", "w2", F.expr(f"transform(array({each}), {name} -> transform(array({fold}), nx -> {ids_of})[0])[0]").alias("ids"))


def answers(rows: DataFrame, model: Pieces) -> DataFrame:
    """(chunk, at, ids, lone) of dictionary rows (chunk, at, word). A character
    that stays alone is -1 less its place, from 1, among model.singles; -1 is
    one without a piece, whose code point is in lone."""
    kind = "smallint" if max(i for _, _, i in model.table) < 1 << 15 > len(model.singles) + 1 else "int"
    w1, w2 = F.xxhash64("word"), F.xxhash64(F.lit("word"), "word")
    n = max(1, -(-rows.count() // FOLD_ROWS))
    dealt = rows.repartition(n, w1, w2).select("chunk", "at", "word", w1.alias("w1"), w2.alias("w2"))
    # chunk and at are kept in sight, so that both sides read the same shuffle
    distinct = dealt.groupBy("w1", "w2", "word").agg(F.min("chunk").alias("c"), F.min("at").alias("a")).where("a >= 0 and c >= 0").select("w1", "w2", "word")
    both = dealt.join(solved(distinct, model), ["w1", "w2"], "left")
    ids = "coalesce(ids, transform(sequence(0, char_length(word) - 1), s -> -1 - s))"
    both = both.select("chunk", "at", "word", F.expr(ids).alias("ids"))
    known = "'" + "".join(c if c not in "\\'" else "\\" + c for c in model.singles) + "'"
    place = f"instr({known}, substring(word, -i, 1))"
    both = both.select("chunk", "at", "word", "ids", F.expr(f"transform(ids, i -> cast(if(i < 0, -1 - {place}, i) as {kind}))").alias("done"))
    lone = f"if(array_contains(done, cast(-1 as {kind})), transform(filter(ids, i -> i < 0 and {place} = 0), i -> ascii(substring(word, -i, 1))), cast(array() as array<int>))"
    return both.select("chunk", "at", F.col("done").alias("ids"), F.expr(lone).alias("lone"))


# -- documents --------------------------------------------------------------

codecs.register_error("readloom-each", lambda e: ("�", e.start + 1))


class Singles:
    """The ids of characters that stay alone, put in place of their marks."""

    def __init__(self, model: Pieces):
        ids = {p: i for p, _, i in model.table}
        self.id = np.array([0, 0, *(ids[c] for c in model.singles)], np.int32)  # by mark: -1 - place
        self.byte0 = model.byte0

    def put(self, ids: list[pa.Array], lone: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        """ids of words one after another, and how many are of each word; from
        answers' columns."""
        size = np.concatenate([x.value_lengths().to_numpy() for x in ids] or [np.empty(0)]).astype(np.int64)
        flat = np.concatenate([x.flatten().to_numpy() for x in ids] or [np.empty(0)]).astype(np.int32)
        at, alone = np.flatnonzero(flat == -1), np.flatnonzero(flat < -1)
        flat[alone] = self.id[-flat[alone]]
        point = np.concatenate([x.flatten().to_numpy() for x in lone] or [np.empty(0)]).astype(np.int64)
        if not len(at):
            return flat, size
        wide = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        times = np.ones(len(flat), np.int64)
        times[at] = wide
        word = np.repeat(np.arange(len(size)), size)
        out, start = np.repeat(flat, times), (np.cumsum(times) - times)[at]
        for n in np.unique(wide).tolist():
            own = wide == n
            for j in range(n):
                bits = point[own] >> 6 * (n - 1 - j)
                lead = bits if n == 1 else bits | (0xF00 >> n & 0xFF) if j == 0 else bits & 0x3F | 0x80
                out[start[own] + j] = self.byte0 + lead
        return out, np.bincount(word, weights=times, minlength=len(size)).astype(np.int64)


class Decoder:
    """Id sequences to texts, many at once."""

    def __init__(self, model: Pieces):
        known = {i: p.replace(MARK, " ").encode() for p, _, i in model.table} | {model.byte0 + b: bytes([b]) for b in range(256)}
        known |= {i: UNKNOWN_TEXT.encode() for i in model.unknown} | {i: b"" for i in model.control}
        every = [known.get(i, b"") for i in range(max(known) + 1)]
        self.size = np.array([len(x) for x in every], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(every), np.uint8)
        self.known = np.isin(np.arange(len(every)), list(known))
        self.silent = np.isin(np.arange(len(every)), model.control)
        self.leads = np.zeros(len(every), bool)  # normal pieces that start with a space
        if model.prefix:
            self.leads[[i for p, _, i in model.table if p.startswith(MARK)]] = True

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of the sequences that ids[ends[k]:ends[k + 1]] are."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.known[ids].all()):
            raise ValueError("an id is outside the model")
        size, start = self.size[ids], self.start[ids]
        loud = np.flatnonzero(~self.silent[ids])
        first = np.searchsorted(loud, ends[:-1])
        some = first < len(loud)
        at = loud[first[some]]
        at = at[(at < ends[1:][some]) & self.leads[ids[at]]]
        size[at] -= 1  # the space that the model put in front
        start[at] += 1
        to = np.cumsum(size)
        total = int(to[-1]) if len(to) else 0
        data = self.flat[np.arange(total) - np.repeat(to - size - start, size)].tobytes()
        cut = np.concatenate([[0], to])[ends]
        try:
            data.decode()
        except UnicodeDecodeError:
            return pa.array([data[a:b].decode("utf-8", "readloom-each") for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.string())
        whole = pa.Array.from_buffers(pa.large_string(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)])
        return whole if total >= 1 << 31 else whole.cast(pa.string())


def solved_words(words: list[str], docs: DataFrame, model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids, one after another, and sizes of a bounded list of words."""
    rows = docs.sparkSession.createDataFrame([(0, k, w.replace(" ", MARK)) for k, w in enumerate(words)], "chunk long, at int, word string")
    got = answers(rows, model).toArrow().sort_by("at")
    return Singles(model).put(got["ids"].chunks, got["lone"].chunks)


def assembled(found: DataFrame, rows: DataFrame, model: Pieces, folder: str, id_type: T.DataType, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, th, n_words, ids, text) of every document of the chunks in folder:
    text is decoded from the ids. found: answers; rows: dictionaries; hot: ids
    and sizes of the first places of all."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(hot)  # of HOT words
    chunks = rows.where("at < 0").select("chunk", "at")
    n = max(1, chunks.count())
    none = [F.array().cast(found.schema[c].dataType).alias(c) for c in ("ids", "lone")]
    every = found.unionByName(chunks.select("chunk", "at", *none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, top = FileSystem.from_uri(folder)
        decoder, singles = Decoder(model), Singles(model)
        first, first_size = shared.value

        def of(chunk: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = np.concatenate([p.column("at").to_numpy() for p in parts] or [np.empty(0, np.int32)])
            if (at != np.arange(len(first_size), len(first_size) + len(at))).any():
                raise ValueError(f"chunk {chunk}: words of the dictionary are missing")
            flat, size = singles.put([p.column("ids") for p in parts], [p.column("lone") for p in parts])
            flat, size = np.concatenate([first, flat]), np.concatenate([first_size, size])
            start = np.cumsum(size) - size
            with fs.open_input_file(f"{top}/docs/{chunk}.arrow") as f:
                file = pa.ipc.open_file(f)
                for k in range(file.num_record_batches):
                    b = file.get_batch(k)
                    low, high = (b.column(c).flatten().to_numpy().astype(np.int64) for c in ("low", "high"))
                    w, off = low | high << 16, np.concatenate([[0], np.cumsum(b.column("low").value_lengths().to_numpy())]).astype(np.int64)
                    n = size[w]
                    to = np.cumsum(n)
                    ids = flat[np.arange(int(to[-1]) if len(to) else 0) - np.repeat(to - n - start[w], n)]
                    ends = np.concatenate([[0], to])[off]
                    lists = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(np.diff(off)), lists, decoder.texts(ids, ends).cast(pa.string())], ["id", "th", "n_words", "ids", "text"])

        chunk, parts = None, []
        for b in batches:
            c = b.column("chunk").to_numpy()
            edges = np.flatnonzero(np.r_[True, c[1:] != c[:-1], True]) if len(c) else []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = b.slice(lo, hi - lo)
                if c[lo] != chunk:
                    if chunk is not None:
                        yield from of(chunk, parts)
                    chunk, parts, part = c[lo], [], part.slice(1)
                parts.append(part)
        if chunk is not None:
            yield from of(chunk, parts)

    schema = T.StructType([T.StructField("id", id_type), T.StructField("th", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())])
    return every.repartition(n, "chunk").sortWithinPartitions("chunk", "at").mapInArrow(run, schema)


def encoded(docs: DataFrame, model: Pieces, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, hot: int = HOT) -> DataFrame:
    """(id, th, n_words, ids, text) for each row: th is the text's digest, ids
    its whole id sequence, text what the ids decode to."""
    first = common_words(docs, model, text_col, hot)
    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/words-{uuid.uuid4().hex}"
    rows = dictionaries(docs, model, folder, id_col, text_col, chunk_chars, first)
    return assembled(answers(rows.where("at >= 0"), model), rows, model, folder, docs.schema[id_col].dataType, solved_words(first, docs, model))


def encode_documents(docs: DataFrame, model: Pieces, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, hot: int = HOT) -> DataFrame:
    """(doc_id, ids) for each row, ids in text order."""
    return encoded(docs, model, id_col, text_col, chunk_chars, hot).select(F.col("id").alias("doc_id"), "ids")


def decode_sequences(rows: DataFrame, model: Pieces, key: str, ids_col: str = "ids") -> DataFrame:
    """(key, text) of id sequences, in any number of rows a key; a null
    sequence, or a null in it, gives a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for b in batches:
            x = b.column("ids")
            ends = np.concatenate([[0], np.cumsum(x.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
            texts = decoder.texts(x.flatten().to_numpy().astype(np.int64), ends)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.compute.if_else(x.is_valid(), texts.cast(pa.string()), None)], ["key", "text"])

    ship(rows.sparkSession)
    ids = F.col(ids_col).cast("array<int>")
    whole = F.when(~F.exists(ids, lambda i: i.isNull()), ids)
    schema = T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("text", T.StringType())])
    return rows.select(F.col(key).alias("key"), whole.alias("ids")).mapInArrow(run, schema).withColumnRenamed("key", key)


def round_trip(docs: DataFrame, model: Pieces, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_pieces, ids, same_text) for each row: the whole id
    sequence, and whether it decodes to the text again (compared by hash; a
    text that holds U+2581 itself does not, as that becomes a space)."""
    every = encoded(docs, model, id_col, text_col, chunk_chars, hot)
    null = digest_of(F.lit(None).cast("string"))
    same: Column = (F.xxhash64("text", F.lit(False)) == F.col("th")) | ((F.col("text") == "") & (F.col("th") == null))
    return every.select(F.col("id").alias("doc_id"), "n_words", F.size("ids").cast("long").alias("n_pieces"), "ids", same.alias("same_text"))
