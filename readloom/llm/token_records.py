"""Token ids as length-delimited binary records with an offset index.

A record file is a sequence of frames:

    length   8 bytes, little-endian, of the payload
    check    4 bytes, masked CRC-32C of the length bytes
    payload
    check    4 bytes, masked CRC-32C of the payload

with mask(c) = rotate_right(c, 15) + 0xA282EAD8 modulo 2**32. A payload is one
byte (the ids' width, 2 or 4; plus 128 where the document id is null), the
document id (8 bytes, signed) and the ids, all little-endian. The index beside
a file holds, for each record, its offset and payload length (8 bytes each), so
records can be read in any order.

Documents are dealt to files by ranges of their id, so file order and order in
a file are ascending ids (ties: by text hash). A task writes a file under a
name of its own attempt, and only the attempts that succeed are listed in the
manifest; a repeated or lost attempt leaves no wrong data. The driver keeps one
manifest row for each file.

Defined cases: null text is empty and has the end id alone; a null id sorts
first; repeated rows each have a record; documents of one id are in order of
their text hash; long texts are one record each; an empty table gives no files
and an empty result; a damaged file raises ValueError; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import digest_of
from .tokens import encoder, vocabulary_size

END_ID = 2
CACHE = 1_000_000  # units of text whose ids a worker keeps, some 250 bytes each
_STEP = 256  # bytes of a slice of the checksum
_POLYNOMIAL = 0x82F63B78
_MANIFEST = "file int, path string, records long, tokens long, bytes long"
_T: list = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Checksum of two bytes at once, and of a state followed by _STEP zeros."""
    if not _T:
        c = np.arange(65536, dtype=np.uint32)
        for _ in range(16):
            c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLYNOMIAL), c >> 1).astype(np.uint32)
        zero = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        for _ in range(_STEP // 2):
            zero = c[zero & 0xFFFF] ^ (zero >> 16)
        _T.extend([c, zero])
    return _T[0], _T[1]


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part (4 bytes or longer), all slices at once."""
    if not parts:
        return np.empty(0, np.uint32)
    two, zero = _tables()
    size = np.array([len(p) for p in parts])
    count = -(-size // _STEP)
    lead = count * _STEP - size  # zeros in front leave a state of zero as it is
    blank = bytes(_STEP)
    whole = bytearray(b"".join(x for p, n in zip(parts, lead.tolist(), strict=True) for x in (blank[:n], p)))
    flat = np.frombuffer(whole, np.uint8)
    ends = np.cumsum(count)
    head = (ends - count) * _STEP + lead
    for k in range(4):  # an initial state of ones
        flat[head + k] ^= 0xFF
    words = np.ascontiguousarray(flat.view("<u2").reshape(-1, _STEP // 2).T)
    state = np.zeros(words.shape[1], np.uint32)
    for w in words:
        state = two[(state ^ w) & 0xFFFF] ^ (state >> 16)
    out = np.zeros(len(parts), np.uint32)
    order = np.argsort(-count, kind="stable")
    for j in range(int(count.max())):
        live = order[: np.searchsorted(-count[order], -j, side="left")]
        c = out[live]
        c = zero[0][c & 255] ^ zero[1][(c >> 8) & 255] ^ zero[2][(c >> 16) & 255] ^ zero[3][c >> 24]
        out[live] = c ^ state[(ends - count)[live] + j]
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    a, b = masked(crc32c(lengths)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [n + a[i].tobytes() + p + b[i].tobytes() for i, (n, p) in enumerate(zip(lengths, payloads, strict=True))]


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    body = ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    return bytes([width | 128 * (doc_id is None)]) + (doc_id or 0).to_bytes(8, "little", signed=True) + body


def parse(p: bytes) -> tuple[int | None, bytes]:
    ids = p[9:] if p[0] & 127 == 4 else np.frombuffer(p, "<u2", offset=9).astype("<u4").tobytes()
    return None if p[0] & 128 else int.from_bytes(p[1:9], "little", signed=True), ids


def write_records(docs: DataFrame, to: str, tokenizer: str, kind: str = "white", end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode docs into record files in folder ``to``; returns the manifest
    (file, path, records, tokens, bytes, base), base being the number of ids in
    all files before."""
    spark = docs.sparkSession
    ship(spark)
    width = 2 if max(vocabulary_size(tokenizer), end_id + 1) <= 65536 else 4

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        code, last = encoder(tokenizer, kind, CACHE), end_id.to_bytes(4, "little")
        at = TaskContext.get().partitionId()
        fs, folder = FileSystem.from_uri(to)
        path = f"{folder}/part-{at:06d}-{uuid.uuid4().hex}.rec"
        out, offsets, pos, tokens = None, [], 0, 0
        for b in batches:
            for k in range(0, len(b), 512):
                part = b.iloc[k : k + 512]
                packed = []
                for key, text in zip(part["id"], part["text"], strict=True):
                    ids = code.ids(text) + last
                    tokens += len(ids) // 4
                    packed.append(payload(None if pd.isna(key) else int(key), ids, width))
                if out is None:
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(path)
                for p, f in zip(packed, frames(packed), strict=True):
                    offsets.append((pos, len(p)))
                    pos += len(f)
                    out.write(f)
        if out is not None:
            out.close()
            with fs.open_output_stream(path + ".idx") as index:
                index.write(np.array(offsets, "<u8").tobytes())
            yield pd.DataFrame({"file": [at], "path": [path], "records": [len(offsets)], "tokens": [tokens], "bytes": [pos]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), digest_of(F.col(text_col)).alias("th"))
    rows = rows.repartitionByRange("id", "th").sortWithinPartitions("id", "th").select("id", "text")
    # nullable ids would become floats in pandas, so they travel as text
    rows = rows.select(F.col("id").cast("string").alias("id"), "text")
    files = sorted(tuple(r) for r in rows.mapInPandas(write, _MANIFEST).collect())  # a row for each file
    base, listed = 0, []
    for f in files:
        listed.append((*f, base))
        base += f[3]
    return spark.createDataFrame(listed, _MANIFEST + ", base long")


def read_records(manifest: DataFrame, root: str, seed: int | None = None) -> DataFrame:
    """Read record files back: (doc_id, file, record, start, ids); start counts
    the ids of all records before, ids are little-endian 32-bit. With a seed,
    the records of each file come in an order drawn from seed and file, found
    through the index."""
    ship(manifest.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(root)
        for b in batches:
            for row in b.itertuples():
                with fs.open_input_stream(row.path + ".idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype(np.int64)
                if len(index) != row.records:
                    raise ValueError(f"{row.path}: {len(index)} records indexed, {row.records} listed")
                width = None
                with fs.open_input_file(row.path) as f:
                    head = f.read_at(13, 0)
                    width = head[12] & 127
                    sizes = (index[:, 1] - 9) // width
                    start = row.base + np.cumsum(sizes) - sizes
                    order = np.arange(len(index)) if seed is None else np.random.default_rng([seed, row.file]).permutation(len(index))
                    for k in range(0, len(order), 512):
                        at = order[k : k + 512]
                        if seed is None:
                            lo, hi = index[at[0], 0], index[at[-1]].sum() + 16
                            block = f.read_at(hi - lo, lo)
                            raw = [block[o - lo : o - lo + n + 16] for o, n in index[at].tolist()]
                        else:
                            raw = [f.read_at(n + 16, o) for o, n in index[at].tolist()]
                        parts = [x[12:-4] for x in raw]
                        if [int.from_bytes(x[:8], "little") for x in raw] != index[at, 1].tolist() or any(len(p) != n for p, n in zip(parts, index[at, 1].tolist(), strict=True)):
                            raise ValueError(f"{row.path}: a length does not match the index")
                        checks = np.frombuffer(b"".join(x[8:12] + x[-4:] for x in raw), "<u4").reshape(-1, 2)
                        if (checks[:, 0] != masked(crc32c([x[:8] for x in raw]))).any() or (checks[:, 1] != masked(crc32c(parts))).any():
                            raise ValueError(f"{row.path}: checksum mismatch")
                        got = [parse(p) for p in parts]
                        yield pd.DataFrame({"doc_id": pd.array([d for d, _ in got], "Int64"), "file": row.file, "record": at, "start": start[at], "ids": [i for _, i in got]})

    n = max(1, manifest.count())
    return manifest.repartitionByRange(n, "file").mapInPandas(read, "doc_id long, file int, record long, start long, ids binary")


def records_folder(spark: SparkSession) -> str:
    from .common import shared_dir

    return f"{shared_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
