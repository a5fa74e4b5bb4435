"""Every query that has SQL gives DuckDB's rows."""

from __future__ import annotations

import os

import duckdb
import pytest

from readloom import queries, views
from readloom.operators import quality, records

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = queries.oracle_sql()


def rows(columns, data):
    return sorted(repr([r[c] for c in sorted(columns)]) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{SF}/orders.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.sql(SQL[name]).to_arrow_table().to_pylist()
    assert sorted(got.columns) == sorted(con.sql(SQL[name]).columns)
    assert rows(got.columns, [r.asDict() for r in got.collect()]) == rows(got.columns, want)


def test_flagship(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_sniff_flags(spark):
    make = lambda *r: spark.createDataFrame([(k, 0, f"@r{k}", *x) for k, x in enumerate(r)], "read_id long, block_id long, title string, seq string, qual string, plus string")
    one = lambda *r: records.sniff(make(*r)).first()
    twice = one(("ACGT", "IIII", "+x"), ("ACGT", "####", "+y"))
    assert (twice["plus_repetition"], twice["color_space"], twice["quality_offset"], twice["ok"]) == (True, False, 33, True)
    assert not one(("ACGT", "IIII", "+"))["ok"]
    assert not one(("ACGT", "IIII", "+"), ("ACGT", "IIII", "+x"))["ok"]
    assert one(("T0123", "IIIII", "+"), ("T.123", "IIIII", "+"))["color_space"]
    assert not one(("T0123", "IIIII", "+"), ("01231", "IIIII", "+"))["ok"]
    assert one(("ACGT", "@hhh", "+"), ("ACGT", "hhhh", "+"))["quality_offset"] == 64
    assert one(("ACGT", ";hhh", "+"), ("ACGT", "hhhh", "+"))["quality_offset"] == 59


@pytest.mark.parametrize(("qual", "want"), [("", 0), ("&'(", 3), ("&'###", 2), ("###", 1), ("#&#", 2)])
def test_trimmed_length(spark, qual, want):
    df = spark.createDataFrame([(0, 0, "@a", "A" * len(qual), qual)], "read_id long, block_id long, title string, seq string, qual string")
    assert quality.trimmed_lengths(df).first()["trimmed"] == want


def test_empty(spark):
    none = views.view(spark, SF).where("read_id < 0")
    for name, (_, operator, _) in queries.TABLE.items():
        if name not in ("dataset_sniff", "archive_scan", "fastq_roundtrip", "pack_unpack"):
            df = none.withColumn("plus", none["qual"]) if name == "reads_valid" else none
            assert operator(df).count() == 0, name
