"""Views of reads derived from the orders table, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Standard SQL; the same rows in Spark and DuckDB.
READS_SQL = """select read_id, block_id,
  concat('@SRR001471.', cast(1000000 + read_id as varchar(20)), ' HWI-EAS7:1:3:', ck, ':', substring(md5(ok), 1, 4), '/1') as title,
  seq,
  case block_id % 3 when 0 then q
       when 1 then concat(substring(q, 1, 20), repeat('#', 12))
       else concat(repeat(substring(q, 1, 1), 11), repeat(substring(q, 2, 1), 11), repeat(substring(q, 3, 1), 10)) end as qual
from (select o_orderkey as read_id, cast(floor(o_orderkey / 512) as bigint) as block_id,
        cast(o_custkey as varchar(20)) as ck, cast(o_orderkey as varchar(20)) as ok,
        translate(md5(concat('s', cast(o_orderkey as varchar(20)))), '0123456789abcdef', 'ACGTACGTACGTACGN') as seq,
        translate(md5(concat('q', cast(o_orderkey as varchar(20)))), '0123456789abcdef', '#+5:?ADFGHI<=>@B') as q
      from orders) b"""

#: Reads of 20 to 32 bases.
VARIED_SQL = f"""select read_id, block_id, title, substring(seq, 1, cast(20 + read_id % 13 as int)) as seq, substring(qual, 1, cast(20 + read_id % 13 as int)) as qual from ({READS_SQL}) r"""

#: Blocks by turns: as they are; ACGT alone; A, T, N with high qualities; N alone.
ALPHABETS_SQL = f"""select read_id, block_id, title,
  case block_id % 4 when 0 then seq when 1 then translate(seq, 'N', 'A') when 2 then translate(seq, 'CG', 'AT') else repeat('N', 32) end as seq,
  case block_id % 4 when 2 then repeat('I', 32) when 3 then repeat('#', 32) else qual end as qual from ({READS_SQL}) r"""

#: Titles whose fields take every scheme: constant, deltas that are constant,
#: vary or repeat, values that vary or repeat, text.
TITLES_SQL = f"""select read_id, block_id,
  concat('@RUN.', cast(5 * read_id as varchar(20)), ':', cast(7 * read_id + read_id % 2 as varchar(20)), ':',
    cast(cast(floor(read_id % 512 / 40) as bigint) % 2 * 100 as varchar(20)), ':', cast(cast(floor(read_id % 512 / 40) as bigint) * 1000 + read_id as varchar(20)), ':',
    cast(read_id * 7919 % 401 as varchar(20)), ':', substring(md5(cast(read_id as varchar(20))), 1, cast(2 + read_id % 5 as int)), '/1') as title, seq, qual from ({READS_SQL}) r"""

#: What the archive holds in every scheme: title fields that are constant, of
#: constant or varied deltas, of few or many values, text; by turns two bits a
#: base, five symbols, none; qualities plain, cut, in runs, and of one symbol.
ARCHIVE_SQL = f"""select read_id, block_id,
  concat('@RUN.', cast(5 * read_id as varchar(20)), ':', cast(7 * read_id + read_id % 2 as varchar(20)), ':', cast(read_id * 7919 % 401 as varchar(20)), ':', cast(read_id * 7919 % 100003 as varchar(20)), ':',
    substring(md5(cast(read_id as varchar(20))), 1, cast(2 + read_id % 5 as int)), '/1') as title,
  case block_id % 4 when 0 then translate(seq, 'N', 'A') when 1 then seq when 2 then repeat('N', 32) else translate(seq, 'N', 'T') end as seq,
  case block_id % 4 when 2 then repeat('#', 32) when 3 then repeat('I', 32) else qual end as qual from ({READS_SQL}) r"""

#: Some records broken: no @, a base missing, an empty third line.
BROKEN_SQL = f"""select read_id, block_id, case when read_id % 211 = 100 then substring(title, 2, 100) else title end as title,
  case when read_id % 307 = 200 then substring(seq, 1, 31) else seq end as seq, qual,
  case when read_id % 401 = 300 then '' else '+' end as plus from ({READS_SQL}) r"""

#: Titles of two layouts in odd blocks.
MIXED_SQL = f"""select read_id, block_id, case when block_id % 2 = 1 and read_id % 5 = 0 then '@a:b' else title end as title, seq, qual from ({READS_SQL}) r"""


def view(spark: SparkSession, sf_dir: str, text: str = READS_SQL) -> DataFrame:
    """Rows of one of the texts above over sf_dir's orders. Reads are larger
    than the rows they are made from, so rows of few splits are dealt out first."""
    orders, cores = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.sparkContext.defaultParallelism
    if orders.rdd.getNumPartitions() < cores:
        orders = orders.repartition(cores)
    orders.createOrReplaceTempView("orders")
    return spark.sql(text)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir)
