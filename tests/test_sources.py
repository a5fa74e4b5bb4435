"""FASTQ and archive sources: partition invariance, order, damage, pushdown."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from readloom import api, streaming
from readloom.sources import archive, fastq, files


def text_of(n: int, seed: int = 1, end: str = "\n", low: int = 20, high: int = 99) -> str:
    rng = random.Random(seed)
    out = []
    for k in range(n):
        size = rng.randrange(low, high)
        # qualities that start with @ look like titles
        out.append(f"@READ.{1000 + k}{end}{''.join(rng.choice('ACGTN') for _ in range(size))}{end}+{end}{'@' if k % 3 == 0 else 'I'}{''.join(rng.choice('@#IJ') for _ in range(size - 1))}{end}")
    return "".join(out)


@pytest.mark.parametrize("chunk", [300, 8704, 1 << 20])
def test_chunks_equal_whole(tmp_path, chunk):
    text = text_of(3000)
    p = tmp_path / "a.fastq"
    p.write_text(text)
    parts = fastq.chunks(str(p), chunk)
    assert parts[0][0] == 0
    assert [a for a, _ in parts[1:]] == [b for _, b in parts[:-1]]
    joined = [sum((fastq.parse(text[a:b].encode())[k] for a, b in parts), []) for k in range(4)]
    assert joined == list(map(list, fastq.parse(text.encode())))


def test_long_records(tmp_path):
    text = text_of(20, low=30_000, high=40_000)
    p = tmp_path / "a.fastq"
    p.write_text(text)
    got = [t for a, b in fastq.chunks(str(p), 100_000) for t in fastq.parse(text[a:b].encode())[0]]
    assert len(got) == 20


def test_parse_edges():
    two = "@a\nAC\n+\nII\n@b\nGT\n+\nII\n"
    assert fastq.parse(two.encode())[0] == ["@a", "@b"]
    assert fastq.parse(two.replace("\n", "\r\n").encode())[1] == ["AC", "GT"]
    assert fastq.parse(two[:-1].encode())[2] == ["II", "II"]
    assert len(fastq.parse((two + "@c\nAC\n+\n").encode())[0]) == 2
    assert fastq.parse(b"")[0] == []
    assert fastq.parse(b"a\nAC\n+\nII\n")[0] == []


def test_pack_unpack(spark, tmp_path):
    p = tmp_path / "a.fastq"
    p.write_text(text_of(2000))
    made = api.pack(spark, str(tmp_path / "a.arc"), str(p), chunk_bytes=20_000)
    assert made["records"] == 2000
    assert made["blocks"] > 5
    api.unpack(spark, str(tmp_path / "a.arc"), str(tmp_path / "b.fastq"))
    assert (tmp_path / "b.fastq").read_text() == p.read_text()
    assert sorted(f.name for f in tmp_path.iterdir() if ".part-" in f.name) == []
    heads = api.inspect(spark, str(tmp_path / "a.arc")).orderBy("block_id").collect()
    assert sum(h["records"] for h in heads) == 2000
    assert sum(h["chunk_size"] for h in heads) == len(p.read_text())
    one = archive.read_archive(spark, str(tmp_path / "a.arc"), blocks="2")
    assert one.rdd.getNumPartitions() == 1
    assert one.count() == heads[2]["records"]
    titles = archive.read_archive(spark, str(tmp_path / "a.arc"), "title")
    assert titles.columns == ["read_id", "block_id", "title"]
    assert titles.count() == 2000


def test_damaged_archives(tmp_path, spark):
    p = tmp_path / "a.fastq"
    p.write_text(text_of(50))
    api.pack(spark, str(tmp_path / "a.arc"), str(p))
    good = (tmp_path / "a.arc").read_bytes()
    for name, data in {"short": good[:20], "mark": b"\0" + good[1:], "cut": good[:-3], "version": good[:1] + b"\x09" + good[2:], "order": good[:-10] + b"\x01" + good[-9:]}.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            archive.read_index(str(tmp_path / name))


def test_refused_pack_leaves_nothing(spark, tmp_path):
    p = tmp_path / "bad.fastq"
    p.write_text("@a:b\nACGT\n+\nIIII\n@a\nACGT\n+\nIIII\n")
    with pytest.raises(Exception, match="layout"):
        api.pack(spark, str(tmp_path / "bad.arc"), str(p))
    assert not (tmp_path / "bad.arc").exists()
    (tmp_path / "empty.fastq").write_text("")
    with pytest.raises(ValueError):
        api.pack(spark, str(tmp_path / "empty.arc"), str(tmp_path / "empty.fastq"))


def test_generated(spark):
    rows = api.generated(spark, 500, 60).collect()
    assert len(rows) == 500
    same = sum(a == b for r in rows for a, b in zip(r["seq"], r["seq"][1:], strict=False)) / (500 * 59)
    assert 0.75 < same < 0.95
    assert all(len(r["seq"]) == len(r["qual"]) == 60 and set(r["seq"]) <= set("ACGT") and "!" <= min(r["qual"]) and max(r["qual"]) <= "I" for r in rows)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.fastq").write_text(text_of(10 + k, k))
    q = streaming.running_sizes(streaming.landing_reads(spark, str(tmp_path / "in"), 1)).writeStream.outputMode("complete").format("memory").queryName("sizes").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["reads"] for r in spark.table("sizes").collect()) == [10, 11, 12]


def test_write_order(spark, tmp_path):
    rows = api.generated(spark, 300, 30, block_reads=40).orderBy(F.rand(3))
    fastq.write_fastq(rows, str(tmp_path / "o.fastq"))
    titles = fastq.parse((tmp_path / "o.fastq").read_bytes())[0]
    assert [int(t.split(".")[1].split()[0]) for t in titles] == list(range(1_000_000, 1_000_300))


def broken(name: str) -> str:
    good = text_of(100)
    lines = good.split("\n")
    match name:
        case "bad record":
            return "\n".join([*lines[:21], lines[21][:-1], *lines[22:]])
        case "no title":
            return "\n".join([*lines[:200], "x" + lines[200], *lines[201:]])
        case "cut off":
            return "\n".join(lines[:-2]) + "\n"
        case "half a title":
            return good + "@READ"
        case "repeated title":
            return "\n".join(x if k % 4 != 2 else "+" + lines[k - 2][1:] for k, x in enumerate(lines))
        case "other line ends":
            return good.replace("\n", "\r\n")


@pytest.mark.parametrize("name", ["bad record", "no title", "cut off", "half a title", "repeated title", "other line ends"])
@pytest.mark.parametrize("chunk", [1 << 20, 2000])
def test_pack_refuses_what_would_not_come_back(spark, tmp_path, name, chunk):
    (tmp_path / "a.fastq").write_bytes(broken(name).encode())
    with pytest.raises(Exception, match="at byte|byte [0-9]+ would"):
        api.pack(spark, str(tmp_path / "a.arc"), str(tmp_path / "a.fastq"), chunk_bytes=chunk)
    assert [f.name for f in tmp_path.iterdir()] == ["a.fastq"]


def test_last_line_end_may_be_missing(spark, tmp_path):
    text = text_of(100)
    (tmp_path / "a.fastq").write_text(text[:-1])
    assert api.pack(spark, str(tmp_path / "a.arc"), str(tmp_path / "a.fastq"), chunk_bytes=3000)["records"] == 100
    api.unpack(spark, str(tmp_path / "a.arc"), str(tmp_path / "b.fastq"))
    assert (tmp_path / "b.fastq").read_text() == text


def test_modes(spark, tmp_path):
    text = broken("bad record").encode()
    (tmp_path / "a.fastq").write_bytes(text)
    read = lambda mode: fastq.read_fastq(spark, str(tmp_path / "a.fastq"), mode=mode)
    assert read("prefix").count() == 5
    at = len(b"\n".join(text.split(b"\n")[:20])) + 1
    with pytest.raises(Exception, match=f"no valid record at byte {at}"):
        read("strict").count()
    (tmp_path / "a.fastq").write_bytes(broken("other line ends").encode())
    assert read("strict").count() == 100
    assert read("strict").where("seq like '%\r%' or plus <> '+'").count() == 0


def test_folder_and_pattern(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.fastq").write_text(text_of(10 + k, k))
    (tmp_path / "in" / "_hidden").write_text("x")
    every = fastq.read_fastq(spark, str(tmp_path / "in"))
    assert [(r["block_id"], r["count"]) for r in every.groupBy("block_id").count().orderBy("block_id").collect()] == [(0, 10), (1, 11), (2, 12)]
    assert fastq.read_fastq(spark, str(tmp_path / "in" / "[12].fastq")).count() == 23
    with pytest.raises(Exception, match="No such|\\*"):
        fastq.read_fastq(spark, str(tmp_path / "in" / "*.none")).count()
    assert api.pack(spark, str(tmp_path / "a.arc"), str(tmp_path / "in"))["records"] == 33


def test_command_line(spark, tmp_path, capsys):
    from readloom.__main__ import main

    path = lambda x: str(tmp_path / x)
    for args in ([], ["pack", "a"], ["pack", "a", "b", "two"], ["generate", "a", "1"], ["mend", "a", "b"]):
        assert main(args) == 2
    assert main(["generate", path("a.fastq"), "300", "40"]) == 0
    assert main(["pack", path("a.arc"), path("a.fastq")]) == 0
    assert "300" in capsys.readouterr().out
    assert main(["unpack", path("a.arc"), path("b.fastq"), "2"]) == 0
    assert (tmp_path / "a.fastq").read_text() == (tmp_path / "b.fastq").read_text()
    assert main(["unpack", path("none.arc"), path("c.fastq")]) == 1
    assert main(["pack", path("c.arc"), path("none.fastq")]) == 1
    assert "error" in capsys.readouterr().err


@pytest.mark.parametrize("chunk", [50, 333, 10_000, 10**7])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_cover_every_byte(tmp_path, chunk, end):
    rng = random.Random(chunk)
    records = []
    for k in range(100):
        n = rng.choice([0, 1, 3, 40, 300])
        qual = "".join(rng.choice("@+I!") for _ in range(n))  # lines that look like titles and pluses
        records.append(f"@t.{k}{end}{'A' * n}{end}+{'@' * (k % 3)}{end}{qual}{end}")
    data = "".join(records).encode()[: -len(end)]
    p = tmp_path / "a.fastq"
    p.write_bytes(data)
    starts = {0, len(data)}
    at = 0
    for r in records:
        at += len(r)
        starts.add(min(at, len(data)))
    n = -(-len(data) // chunk)
    for span in (1, 3, 10**9):
        found = [c for first in range(0, n, span) for c in fastq.range_chunks(str(p), first, min(n, first + span), len(data), chunk)]
        assert [a for _, a, _ in found] == [0] + [b for _, _, b in found][:-1]
        assert found[-1][2] == len(data)
        assert {x for _, *ab in found for x in ab} <= starts
        assert len({k for k, *_ in found}) == len(found)


@pytest.mark.parametrize("step", [1, 16, 8192])
def test_first_title_from_any_byte(tmp_path, step):
    p = tmp_path / "a.fastq"
    texts = ["@a\nACGT\n+\n@III\n", "@b\n\n+\n\n", "@c\n" + "A" * 500 + "\n+\n" + "@" * 500 + "\n", "@d\nAC\n+@\n+@\n"]
    p.write_text("".join(texts))
    starts = [sum(map(len, texts[:k])) for k in range(5)]
    for at in range(starts[-1] + 3):
        assert fastq.first_title(str(p), at, starts[-1], step) == min((s for s in starts if s >= at), default=starts[-1])


def test_folders(spark, tmp_path):
    p = tmp_path / "a.fastq"
    p.write_text(text_of(3000))
    arc, back = str(tmp_path / "arc") + "/", str(tmp_path / "back") + "/"
    made = api.pack(spark, arc, str(p), chunk_bytes=9_000)
    assert made["records"] == 3000
    assert made["fastq_bytes"] == p.stat().st_size
    api.unpack(spark, arc, back)
    whole = fastq.read_fastq(spark, str(p)).orderBy("read_id").select("title", "seq", "qual").collect()
    assert fastq.read_fastq(spark, back).orderBy("read_id").select("title", "seq", "qual").collect() == whole
    api.unpack(spark, arc, str(tmp_path / "one.fastq"))
    assert (tmp_path / "one.fastq").read_text() == p.read_text()
    with pytest.raises(Exception, match="holds parts already"):
        api.pack(spark, arc, str(p), chunk_bytes=9_000)
    assert len([f for f in (tmp_path / "arc").iterdir() if f.suffix == ".arc"]) == len(files.manifest(arc))
    api.unpack(spark, arc, str(tmp_path / "two.fastq"))  # a refused second pack leaves the first as it was
    assert (tmp_path / "two.fastq").read_text() == p.read_text()


def test_folder_of_several_archives(spark, tmp_path):
    p = tmp_path / "a.fastq"
    p.write_text(text_of(2000).replace("N", "A"))  # a small last block has too few symbols for N
    reads = fastq.read_fastq(spark, str(p), 20_000)
    archive.write_archive_parts(archive.encoded(reads.coalesce(3)), str(tmp_path / "arc"), 10_000)
    listed = files.manifest(str(tmp_path / "arc"))
    assert len(listed) > 3
    assert sum(n for _, n in listed) == reads.select("block_id").distinct().count()
    assert len(archive.read_index(listed[0][0]).sizes) == listed[0][1]  # each is an archive of its own
    (tmp_path / "arc" / "part-000000-lost.arc").write_bytes(b"of a lost attempt")
    got = archive.read_archive(spark, str(tmp_path / "arc"))
    assert got.rdd.getNumPartitions() == len(listed)
    assert [r["title"] for r in got.orderBy("read_id").collect()] == [r["title"] for r in reads.orderBy("read_id").collect()]
    one = archive.read_archive(spark, str(tmp_path / "arc"), blocks="4")
    assert one.rdd.getNumPartitions() == 1
    assert one.select("title").collect() == reads.where("block_id = 4").select("title").collect()
    with pytest.raises(Exception, match="order of block_id"):
        archive.write_archive_parts(spark.createDataFrame([(2, b"x"), (1, b"y")], "block_id long, block binary").coalesce(1), str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").iterdir())


def test_ranges_equal_walk(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.fastq").write_text(text_of(700 + k))
    walk = fastq.read_fastq(spark, str(tmp_path / "*.fastq"), 20_000).orderBy("read_id").select("title", "seq", "qual").collect()
    ranges = fastq.read_fastq(spark, str(tmp_path / "*.fastq"), 20_000, "exact", "ranges")
    assert ranges.orderBy("read_id").select("title", "seq", "qual").collect() == walk
    some = fastq.read_fastq(spark, str(tmp_path / "*.fastq"), 20_000, "exact", "ranges", "1-2,4")
    assert sorted(r[0] for r in some.select("block_id").distinct().collect()) == [1, 2, 4]
    assert ranges.rdd.getNumPartitions() == 2
    part = ranges.where("block_id = 3").count()  # a filtered query leaves later ones whole
    assert 0 < part < ranges.count() == 1401
    assert ranges.where("block_id = 3").select("title").union(ranges.select("title")).count() == part + 1401
    with pytest.raises(Exception, match="numbers and ranges"):
        fastq.read_fastq(spark, str(tmp_path / "1.fastq"), blocks="x").count()
    (tmp_path / "0.fastq").write_text(text_of(300) + "@bad\nAC\n+\nI\n" + text_of(300))
    with pytest.raises(Exception, match="byte"):
        fastq.read_fastq(spark, str(tmp_path / "0.fastq"), 20_000, "exact", "ranges").count()
