"""The block archive as a data source: one partition for each block (for a run
of them, of many), or, of a folder of archives with a manifest, one for each
archive in it.

    head    AA, version 2 0 2, footer size u32, footer offset u64, records u64
            (0), blocks u64, 8 x AA                         (40 bytes)
    blocks  one after another
    footer  CC, block sizes u32 (little-endian), data set flags, quality
            offset, settings flags, sequence order, quality order, title flags u64

All else is big-endian. Settings that the codec does not cover are refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schema import QUALITY_OFFSET
from . import files
from .codec import block_head, decode_block
from .fastq import PLACE_BITS, block_spans, dealt, kept_blocks

# Fixed values of the format.
HEAD = struct.Struct(">B3BIQQQ8s")
VERSION = (2, 0, 2)
HEAD_MARK, FOOTER_MARK = 0xAA, 0xCC
SETTINGS = struct.Struct(">BBBBBQ")
#: Bytes of blocks in an archive of a folder.
PART_BYTES = 64 << 20
#: Bytes of blocks in a partition of a single archive, at most.
READ_BYTES = 16 << 20
PLUS_REPETITION, COLOR_SPACE, LOSSY, CHECKSUM = 1, 2, 1, 2


@dataclass(frozen=True)
class Index:
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    plus_repetition: bool
    quality_offset: int


def read_index(path: str) -> Index:
    """Validate an archive's head and footer; the place of each block."""
    total = files.size(path)
    if total < HEAD.size:
        raise ValueError(f"{path}: too short for an archive")
    mark, major, minor, _, footer_size, footer_at, _, blocks, _ = HEAD.unpack(files.read(path, 0, HEAD.size))
    if mark != HEAD_MARK or (major, minor) != VERSION[:2]:
        raise ValueError(f"{path}: not an archive of version {VERSION[0]}.{VERSION[1]}")
    if not blocks:
        raise ValueError(f"{path}: an archive without blocks")
    if footer_size != 1 + 4 * blocks + SETTINGS.size or footer_at + footer_size > total:
        raise ValueError(f"{path}: the footer does not fit")
    footer = files.read(path, footer_at, footer_size)
    if footer[0] != FOOTER_MARK:
        raise ValueError(f"{path}: no footer where the head points")
    sizes = struct.unpack_from(f"<{blocks}I", footer, 1)
    data_flags, offset, flags, dna_order, quality_order, title_flags = SETTINGS.unpack_from(footer, 1 + 4 * blocks)
    odd = [n for n, bad in (("colour space", data_flags & COLOR_SPACE), ("lossy qualities", flags & LOSSY), ("checksums", flags & CHECKSUM), ("sequence order", dna_order), ("quality order", quality_order), ("title filtering", title_flags)) if bad]
    if odd:
        raise ValueError(f"{path}: unsupported settings: {', '.join(odd)}")
    offsets, at = [], HEAD.size
    for n in sizes:
        offsets.append(at)
        at += n
    if at != footer_at:
        raise ValueError(f"{path}: block sizes do not add up")
    return Index(tuple(offsets), sizes, bool(data_flags & PLUS_REPETITION), offset)


@dataclass
class Block:
    block_id: int
    offset: int
    size: int
    quality_offset: int


@dataclass
class Blocks(InputPartition):
    """Blocks of one archive, in order."""

    blocks: list[Block]


@dataclass
class Member(InputPartition):
    """An archive of a folder; its blocks are numbered on from first."""

    path: str
    first: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.blocks = block_spans(options.get("blocks"))
        self.titles_only = options.get("columns", "all") == "title"
        self.heads_only = options.get("columns", "all") == "head"

    def partitions(self) -> list[InputPartition]:
        if (known := files.manifest(self.path)) is not None:
            return list(self.members(known)) or [Blocks([])]
        x = read_index(self.path)
        kept = [Block(i, x.offsets[i], x.sizes[i], x.quality_offset) for i in kept_blocks(self.blocks, list(range(len(x.sizes))))]
        return [Blocks(kept[run]) for run in dealt([b.size for b in kept], READ_BYTES)] or [Blocks([])]

    def members(self, known: list[list]) -> Iterator[Member]:
        """Archives with a block that is asked for; their own index is read
        by the tasks."""
        first = 0
        for path, blocks in known:
            if kept_blocks(self.blocks, list(range(first, first + blocks))):
                yield Member(path, first)
            first += blocks

    def read(self, part: Blocks | Member) -> Iterator[pa.RecordBatch]:
        if isinstance(part, Member):
            path, x = part.path, read_index(part.path)
            blocks = [Block(i, x.offsets[i - part.first], x.sizes[i - part.first], x.quality_offset) for i in kept_blocks(self.blocks, list(range(part.first, part.first + len(x.sizes))))]
        else:
            path, blocks = self.path, part.blocks
        if blocks:
            with files.opened(path) as f:
                if self.heads_only:
                    yield self.read_heads(f, blocks)
                else:
                    for b in blocks:
                        yield self.read_block(f, b)

    def read_heads(self, f, blocks: list[Block]) -> pa.RecordBatch:
        """Counts records without decoding."""
        heads = [block_head(f.read_at(min(20, b.size), b.offset)) for b in blocks]
        return pa.RecordBatch.from_pydict({**{k: [getattr(b, k) for b in blocks] for k in ("block_id", "offset", "size")}, **{k: [h[k] for h in heads] for k in ("records", "min_q", "max_q", "chunk_size")}})

    def read_block(self, f, part: Block) -> pa.RecordBatch:
        titles, seqs, quals = decode_block(f.read_at(part.size, part.offset), part.quality_offset, self.titles_only)
        n = len(titles)
        ids = range(part.block_id << PLACE_BITS, (part.block_id << PLACE_BITS) + n)
        cols = {"read_id": pa.array(ids, pa.int64()), "block_id": pa.array([part.block_id] * n, pa.int64()), "title": titles}
        if not self.titles_only:
            cols |= {"seq": seqs, "qual": quals}
        return pa.RecordBatch.from_pydict(cols)


@dataclass
class Written(WriterCommitMessage):
    path: str
    blocks: list[tuple[int, int, int]]  # block_id, offset in the part, size


def head_and_footer(sizes: list[int], offset: int) -> tuple[bytes, bytes]:
    """What stands around blocks of these sizes."""
    footer = bytes([FOOTER_MARK]) + struct.pack(f"<{len(sizes)}I", *sizes) + SETTINGS.pack(0, offset, 0, 0, 0, 0)
    return HEAD.pack(HEAD_MARK, *VERSION, len(footer), HEAD.size + sum(sizes), 0, len(sizes), bytes([HEAD_MARK]) * 8), footer


def block_of(row) -> bytes:
    data = bytes(row["block"])
    if not data:
        raise ValueError("an empty block")
    return data


class ArchiveWriter(DataSourceWriter):
    """Tasks write parts of (block_id, block) rows; the commit puts the blocks
    in order and adds head and footer."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.mark = files.begin(self.path, False)
        self.offset = int(options.get("qualityoffset", QUALITY_OFFSET))

    def write(self, rows) -> Written:
        out = Written(files.part_name(self.path, self.mark), [])
        with files.part(out.path) as f:
            at = 0
            for r in rows:
                data = block_of(r)
                f.write(data)
                out.blocks.append((r["block_id"], at, len(data)))
                at += len(data)
        return out

    def commit(self, messages) -> None:
        done = [m for m in messages if m]
        blocks = sorted((b, m.path, at, n) for m in done for b, at, n in m.blocks)
        if not blocks:
            self.abort(messages)
            raise ValueError("an archive needs a block")
        head, footer = head_and_footer([n for *_, n in blocks], self.offset)
        with files.part(self.path) as out:
            out.write(head)
            for path, run in groupby(blocks, key=lambda b: b[1]):  # a stream for each run of blocks of a part
                with files.opened(path) as f:
                    for _, _, at, n in run:
                        out.write(f.read_at(n, at))
            out.write(footer)
        files.clear(self.path, self.mark, False)

    def abort(self, messages) -> None:
        files.clear(self.path, self.mark, False)


@dataclass
class WrittenParts(WriterCommitMessage):
    archives: list[tuple[str, int, int, int]]  # path, blocks, first and last block_id


class FolderWriter(DataSourceWriter):
    """Tasks write whole archives, a new one after PART_BYTES of blocks, which
    is what a task holds in memory; the commit writes the manifest alone."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.mark = files.begin(self.path, True)
        self.offset = int(options.get("qualityoffset", QUALITY_OFFSET))
        self.limit = int(options.get("partbytes", PART_BYTES))

    def write(self, rows) -> WrittenParts:
        from pyspark import TaskContext

        at, out, ids, held = TaskContext.get().partitionId(), WrittenParts([]), [], []

        def flush() -> None:
            name = files.folder_part(self.path, self.mark, at, ".arc")
            head, footer = head_and_footer([len(b) for b in held], self.offset)
            with files.part(name) as f:
                for b in (head, *held, footer):
                    f.write(b)
            out.archives.append((name, len(ids), ids[0], ids[-1]))
            ids.clear()
            held.clear()

        size, last = 0, None
        for r in rows:
            if last is not None and last >= r["block_id"]:
                raise ValueError("blocks of a folder come in the order of block_id")
            last = r["block_id"]
            ids.append(last)
            held.append(block_of(r))
            size += len(held[-1])
            if size >= self.limit:
                flush()
                size = 0
        if held:
            flush()
        return out

    def commit(self, messages) -> None:
        parts = sorted((a for m in messages if m for a in m.archives), key=lambda a: a[2])
        if not parts or any(a[3] >= b[2] for a, b in pairwise(parts)):
            self.abort(messages)
            raise ValueError("blocks of a folder come in ranges of block_id" if parts else "an archive needs a block")
        files.write_manifest(self.path, [[name.rpartition("/")[2], blocks] for name, blocks, *_ in parts])

    def abort(self, messages) -> None:
        files.clear(self.path, self.mark, True)


class ArchiveSource(DataSource):
    """``spark.read.format("readarchive")``; options columns = all, title or head, blocks (read these alone);
    for writing, parts (a folder of archives) and partBytes."""

    @classmethod
    def name(cls) -> str:
        return "readarchive"

    def schema(self) -> str:
        if self.options.get("columns", "all") == "head":
            return "block_id bigint, offset bigint, size bigint, records bigint, min_q bigint, max_q bigint, chunk_size bigint"
        return "read_id bigint, block_id bigint, title string" + ("" if self.options.get("columns", "all") == "title" else ", seq string, qual string")

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return (FolderWriter if self.options.get("parts", "false").lower() == "true" else ArchiveWriter)(self.options)


def encoded(reads: DataFrame, verify: bool = True) -> DataFrame:
    """(block_id, records, text_bytes, block, ok) of reads whose blocks are not
    split over partitions and come in order, as both sources give them."""
    from ..shipping import ship
    from .codec import encode_block

    ship(reads.sparkSession)

    def one(block_id: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = tuple([v for b in held for v in b.column(k).to_pylist()] for k in (1, 2, 3))
        data = encode_block(*rows)
        ok = not verify or decode_block(data) == rows
        if not ok:
            raise ValueError(f"block {block_id} does not decode to what was encoded")
        text = sum(map(len, rows[0])) + 2 * sum(map(len, rows[1])) + 5 * len(rows[0])
        return pa.RecordBatch.from_pydict({"block_id": [block_id], "records": [len(rows[0])], "text_bytes": [text], "block": [data], "ok": [ok]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
            for start, end in zip([0, *ends], ends, strict=False):
                own = int(ids[start])
                if held and last != own:
                    yield one(last, held)
                    held = []
                last = own
                held.append(b.slice(start, end - start))
        if held:
            yield one(last, held)

    return reads.select("block_id", "title", "seq", "qual").mapInArrow(run, "block_id long, records long, text_bytes long, block binary, ok boolean")


def blocks_in_place(reads: DataFrame) -> DataFrame:
    """Any reads, dealt so that each block is whole and in order in a partition."""
    return reads.repartition("block_id").sortWithinPartitions("block_id", "read_id")


def write_archive(blocks: DataFrame, path: str) -> None:
    """Write (block_id, block) rows as one archive, in the order of block_id."""
    from . import register

    register(blocks.sparkSession)
    blocks.select("block_id", "block").write.format("readarchive").mode("append").save(path)


def write_archive_parts(blocks: DataFrame, path: str, part_bytes: int = PART_BYTES) -> None:
    """Write (block_id, block) rows whose partitions are ranges of block_id in
    order, as the sources give them, as a folder of archives: no shuffle, and
    the driver gets a row for each archive."""
    from . import register

    register(blocks.sparkSession)
    blocks.select("block_id", "block").write.format("readarchive").option("parts", True).option("partBytes", part_bytes).mode("append").save(path)


def read_archive(spark: SparkSession, path: str, columns: str = "all", blocks: str | None = None) -> DataFrame:
    from . import register

    register(spark)
    return spark.read.format("readarchive").option("columns", columns).options(**({"blocks": blocks} if blocks else {})).load(path)


def decoded(blocks: DataFrame, offset: int = QUALITY_OFFSET) -> DataFrame:
    """(block_id, place, title, seq, qual) of (block_id, block) rows."""
    from ..shipping import ship

    ship(blocks.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block_id, data in zip(b["block_id"], b["block"], strict=True):
                titles, seqs, quals = decode_block(bytes(data), offset)
                yield pd.DataFrame({"block_id": block_id, "place": range(len(titles)), "title": titles, "seq": seqs, "qual": quals})

    return blocks.select("block_id", "block").mapInPandas(run, "block_id long, place long, title string, seq string, qual string")
