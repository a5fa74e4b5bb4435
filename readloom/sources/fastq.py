"""FASTQ as a data source: record-aligned chunks, one partition for each or, of
many, for a run of them.

A chunk is a block of the archive. With ``planning`` ``walk`` the driver walks
the file by its boundaries, reading a small tail for each chunk, and hands out
byte ranges; the blocks are those that the archive format's own tools cut. With
``ranges`` the driver knows file sizes only: a partition is a run of equal
nominal ranges, and its task looks for the first title at or after each range's
ends, so that planning costs the same for a file of any size. Both line ends,
and a last line without one, are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schema import BLOCK_BYTES, READS
from . import files

TAIL = 8192
DDL = "read_id bigint, block_id bigint, title string, seq string, qual string, plus string"
ARROW = pa.schema([("read_id", pa.int64()), ("block_id", pa.int64()), ("title", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("plus", pa.string())])
PLANNINGS = ("walk", "ranges")
#: Bytes of a partition of nominal ranges.
PARTITION_BYTES = 64 << 20
#: Blocks share partitions where there are more than this; a task costs more than a small block.
PARTITIONS = 128
#: A read's id: its block's number above, its place in the block below.
PLACE_BITS = 32
_LINE = re.compile(r"\r\n|\n|\r")


def last_record(window: bytes, tail: int = TAIL) -> int | None:
    """Where the last whole-record boundary search finds a title in window: the
    first line in the tail that starts with @, or the next line if that starts
    with @ too (the first is then a line of qualities)."""
    at = max(0, len(window) - tail)
    while (end := window.find(b"\n", at)) >= 0 and end + 1 < len(window):
        at = end + 1
        if window[at : at + 1] == b"@":
            after = window.find(b"\n", at) + 1
            if not 0 < after < len(window):
                return None  # the next line is not in sight
            return after if window[after : after + 1] == b"@" else at
    return None


def chunks(path: str, chunk_bytes: int = BLOCK_BYTES) -> list[tuple[int, int]]:
    """(start, end) of each chunk. Records longer than the tail are found by
    searching further back."""
    total, start, out = files.size(path), 0, []
    chunk_bytes = chunk_bytes if chunk_bytes > 0 else BLOCK_BYTES
    with files.opened(path) as f:
        while start < total:
            size, cut = chunk_bytes, None
            while cut is None and start + size < total:
                tail = min(TAIL, size)
                while cut is None and tail <= size:
                    window = f.read_at(tail, start + size - tail)
                    if (found := last_record(window, tail)) is not None and start + size - tail + found > start:
                        cut = start + size - tail + found
                    elif tail == size:
                        break
                    tail = min(size, tail * 4)
                size *= 2  # no record ends in this chunk
            end = cut if cut is not None else total
            out.append((start, end))
            start = end
    return out


def first_title(path: str, at: int, total: int, step: int = TAIL) -> int:
    """Where the first record at or after byte ``at`` starts; total if none does.

    A title is a line with @ whose next but one starts with +. The line after a
    quality line is a title and the next a sequence, which holds no +, so what
    is found does not depend on where the search began."""
    if at <= 0 or at >= total:
        return min(max(at, 0), total)
    lead, size = at - 1, step
    while True:
        window = files.read(path, lead, min(size, total - lead))
        starts = [m.end() for m in re.finditer(b"\n", window)]
        for k, a in enumerate(starts[:-2]):
            if window[a : a + 1] == b"@" and window[starts[k + 2] : starts[k + 2] + 1] == b"+":
                return lead + a
            if starts[k + 2] >= len(window):
                break
        if lead + len(window) >= total:
            return total
        if len(starts) > 6:  # go on from the first line that was not settled
            lead += starts[-4] - 1
        else:
            size *= 4


def range_chunks(path: str, first: int, stop: int, total: int, chunk_bytes: int) -> Iterator[tuple[int, int, int]]:
    """(number, start, end) of nominal ranges first to stop - 1, moved to titles.
    A range without a title is empty and left out."""
    start = first_title(path, first * chunk_bytes, total)
    for n in range(first, stop):
        end = first_title(path, (n + 1) * chunk_bytes, total) if start < min((n + 1) * chunk_bytes, total) else start
        if end > start:
            yield n, start, end
        start = end


Fields = tuple[list[str], list[str], list[str], list[str]]


def parse(data: bytes) -> Fields:
    """Titles, sequences, qualities and third lines up to the first bad record."""
    text = data.decode("latin-1")
    lines = _LINE.split(text) if "\r" in text else text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    k = len(lines) - len(lines) % 4
    fields = titles, seqs, pluses, quals = lines[0:k:4], lines[1:k:4], lines[2:k:4], lines[3:k:4]
    if not (all(map(str.startswith, titles, repeat("@"))) and all(pluses) and list(map(len, seqs)) == list(map(len, quals))):
        good = next(i for i, (t, s, p, q) in enumerate(zip(*fields, strict=True)) if not (t.startswith("@") and p and len(s) == len(q)))
        titles, seqs, pluses, quals = (x[:good] for x in fields)
    return titles, seqs, quals, pluses


def rendered(titles: list[str], seqs: list[str], quals: list[str]) -> bytes:
    """The text that an archive gives back for these records."""
    return "".join([f"{t}\n{s}\n+\n{q}\n" for t, s, q in zip(titles, seqs, quals, strict=True)]).encode("latin-1")


#: What a reader does with bytes that are no valid record: read up to them
#: (prefix), raise (strict), or raise for any byte that packing would change,
#: such as other line ends and repeated titles (exact). A last line end may be
#: missing in all.
MODES = ("prefix", "strict", "exact")


def parse_as(mode: str, data: bytes, where: str, start: int) -> Fields:
    """parse(), checked as the mode says; where and start name the place."""
    found = parse(data)
    if mode == "prefix" and found[0]:
        return found
    n = len(found[0])
    ends = [m.end() for m in _LINE.finditer(data.decode("latin-1"))] if not n or mode == "strict" else []
    done = 0 if not n else len(data) if 4 * n > len(ends) else ends[4 * n - 1]
    if mode == "strict" or not n:
        if not n or data[done:].strip(b"\r\n"):
            raise ValueError(f"{where}: no valid record at byte {start + done}")
        return found
    back = rendered(*found[:3])
    if back != data and back != data + b"\n":
        a, b = np.frombuffer(back, np.uint8), np.frombuffer(data, np.uint8)
        n = min(len(a), len(b))
        at = int(np.flatnonzero(a[:n] != b[:n])[0]) if (a[:n] != b[:n]).any() else n
        raise ValueError(f"{where}: byte {start + at} would be lost or changed: a bad record, another line end or a repeated title")
    return found


@dataclass
class Chunks(InputPartition):
    """Blocks in a row: block_id, path, start, end of each."""

    blocks: list[tuple[int, str, int, int]]


@dataclass
class Ranges(InputPartition):
    """Nominal ranges first to stop - 1 of a file whose block 0 is base."""

    path: str
    base: int
    first: int
    stop: int
    total: int


Span = tuple[int, int]


def block_spans(option: str | None) -> list[Span] | None:
    """The option ``blocks``: numbers and inclusive ranges, as in 2,5-9; None for
    every block. (Filters are not pushed down: Spark 4.1 keeps what was pushed
    for one query of a DataFrame for all later ones, which then lose rows.)"""
    if option is None:
        return None
    found = [re.fullmatch(r"\s*(\d+)(?:-(\d+))?\s*", x) for x in option.split(",")]
    if not all(found):
        raise ValueError(f"blocks are numbers and ranges, as in 2,5-9: {option}")
    return [(int(m[1]), int(m[2] or m[1])) for m in found]


def kept_blocks(spans: list[Span] | None, ids: list[int]) -> list[int]:
    """The blocks among those asked for."""
    return ids if spans is None else [i for i in ids if any(a <= i <= b for a, b in spans)]


def dealt(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of blocks of these sizes for a partition each: single blocks, or of
    more than PARTITIONS runs of equal bytes, up to ``most``."""
    limit, first, held = min(most, sum(sizes) // PARTITIONS) if len(sizes) > PARTITIONS else 0, 0, 0
    for k, n in enumerate(sizes):
        held += n
        if held >= limit or k == len(sizes) - 1:
            yield slice(first, k + 1)
            first, held = k + 1, 0


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.chunk = int(options.get("chunkbytes", BLOCK_BYTES))
        self.blocks = block_spans(options.get("blocks"))
        self.mode = options.get("mode", "strict")
        self.chunk = self.chunk if self.chunk > 0 else BLOCK_BYTES
        self.planning = options.get("planning", "walk")
        self.span = max(1, int(options.get("partitionbytes", PARTITION_BYTES)) // self.chunk)
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        if self.planning not in PLANNINGS:
            raise ValueError(f"planning is one of {', '.join(PLANNINGS)}")

    def ranges(self) -> Iterator[InputPartition]:
        """Runs of nominal ranges with a block that is asked for."""
        base = 0
        for path in files.listed(self.path):
            total = files.size(path)
            n = -(-total // self.chunk)
            for first in range(0, n, self.span):
                stop = min(n, first + self.span)
                if kept_blocks(self.blocks, list(range(base + first, base + stop))):
                    yield Ranges(path, base, first, stop, total)
            base += n

    def partitions(self) -> list[InputPartition]:
        if self.planning == "ranges":
            return list(self.ranges()) or [Chunks([])]
        every = [(p, *c) for p in files.listed(self.path) for c in chunks(p, self.chunk)]
        kept = [(i, *every[i]) for i in kept_blocks(self.blocks, list(range(len(every))))]
        return [Chunks(kept[run]) for run in dealt([end - start for *_, start, end in kept], PARTITION_BYTES)] or [Chunks([])]

    def read(self, part: Chunks | Ranges) -> Iterator[pa.RecordBatch]:
        if isinstance(part, Chunks):
            found = part.blocks
        else:
            found = ((part.base + n, part.path, a, b) for n, a, b in range_chunks(part.path, part.first, part.stop, part.total, self.chunk) if kept_blocks(self.blocks, [part.base + n]))
        for block_id, path, start, end in found:
            titles, seqs, quals, pluses = parse_as(self.mode, files.read(path, start, end - start), path, start)
            ids = range(block_id << PLACE_BITS, (block_id << PLACE_BITS) + len(titles))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([block_id] * len(titles), pa.int64()), pa.array(titles), pa.array(seqs), pa.array(quals), pa.array(pluses)], schema=ARROW)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str


def rendered_batch(rows: pa.RecordBatch, plus_repetition: bool) -> bytes:
    """The text of a batch of reads."""
    title, seq, qual = (rows.column(rows.schema.get_field_index(c)) for c in ("title", "seq", "qual"))
    if title.null_count or seq.null_count or qual.null_count:
        raise ValueError("a read without a title, a sequence or qualities")
    text = lambda s: pa.scalar(s, title.type)
    plus = pc.binary_join_element_wise(text("+"), pc.utf8_slice_codeunits(title, 1), text("")) if plus_repetition else text("+")
    lines = pc.binary_join_element_wise(title, seq, plus, qual, text(""), text("\n"))
    data = b"".join(lines.cast(pa.binary()).to_pylist())
    return data if data.isascii() else data.decode().encode("latin-1")


class FastqWriter(DataSourceArrowWriter):
    """Each task writes a part. The commit joins them in partition order into
    one file or, with the option ``parts``, lists them in the folder's manifest
    and moves no byte."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.parts = options.get("parts", "false").lower() == "true"
        self.mark = files.begin(self.path, self.parts)
        self.repeat = options.get("plusrepetition", "false").lower() == "true"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        part = Part(at, files.folder_part(self.path, self.mark, at, ".fastq") if self.parts else files.part_name(self.path, self.mark))
        with files.part(part.path) as f:
            for b in batches:
                f.write(rendered_batch(b, self.repeat))
        return part

    def commit(self, messages) -> None:
        parts = [m.path for m in sorted((m for m in messages if m), key=lambda m: m.partition)]
        if self.parts:
            files.write_manifest(self.path, [[p.rpartition("/")[2]] for p in parts if files.size(p)])
            files.remove(p for p in parts if not files.size(p))
            return
        with files.part(self.path) as out:
            files.join(out, parts)
        files.clear(self.path, self.mark, False)

    def abort(self, messages) -> None:
        files.clear(self.path, self.mark, self.parts)


class FastqSource(DataSource):
    """``spark.read.format("fastq")``; options chunkBytes, mode (one of MODES),
    planning (one of PLANNINGS), partitionBytes (of ``ranges``), blocks (read these alone), and for writing
    plusRepetition and parts. The path is a file, a folder or a glob; the files'
    blocks are numbered on in the order of their names."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FastqWriter(self.options)


def read_fastq(spark: SparkSession, path: str, chunk_bytes: int = BLOCK_BYTES, mode: str = "strict", planning: str = "walk", blocks: str | None = None) -> DataFrame:
    from . import register

    register(spark)
    return spark.read.format("fastq").option("chunkBytes", chunk_bytes).option("mode", mode).option("planning", planning).options(**({"blocks": blocks} if blocks else {})).load(path)


def write_fastq(reads: DataFrame, path: str, plus_repetition: bool = False, in_order: bool = False) -> None:
    """Write reads as one file in the order of (block_id, read_id), which is that
    of the partitions already where ``in_order`` says so (as the sources here
    give them): nothing is sorted then, and no row computed twice for the ranges
    of a sort. The driver copies the parts into it."""
    from . import register

    register(reads.sparkSession)
    rows = reads.select(*READS.fieldNames())
    if not in_order:
        rows = rows.repartitionByRange("block_id", "read_id").sortWithinPartitions("block_id", "read_id")
    rows.write.format("fastq").option("plusRepetition", plus_repetition).mode("append").save(path)


def write_fastq_parts(reads: DataFrame, path: str, plus_repetition: bool = False) -> None:
    """Write reads as a folder with a file for each partition, in the order they
    come in (that of the sources here): no shuffle, no byte through the driver."""
    from . import register

    register(reads.sparkSession)
    reads.select(*READS.fieldNames()).write.format("fastq").option("plusRepetition", plus_repetition).option("parts", True).mode("append").save(path)
