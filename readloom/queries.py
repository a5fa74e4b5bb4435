"""Queries over the derived views: name -> (view, operator, SQL)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import views as V
from .functions import expressions as X
from .operators import dna, quality, records, titles
from .plans import encoding
from .shared import shared_dir
from .sources import archive, fastq

CELLS = """e as (select block_id, read_id, pos, strpos('AGCTNRWSKMDVHBYXU.-', substr(seq, pos + 1, 1)) - 1 as b, ascii(substr(qual, pos + 1, 1)) - 33 as q
  from (select *, unnest(range(0, length(seq))) as pos from reads)),
c as (select *, case when b > 3 and q < 7 then 128 + (b - 4) * 8 + q else q end as cq, not (b > 3 and q < 7) as keep from e)"""
STATS = CELLS + """,
m as (select *, lag(cq) over (partition by block_id, read_id order by pos) as p, max(pos) over (partition by block_id, read_id) as last from c),
pr as (select block_id, read_id, count(*) as n, count(*) filter (cq is distinct from p) as ch, coalesce(max(pos) filter (cq <> 2), 0) as th, bool_or(pos = last and cq = 2) as tail from m group by all),
st as (select block_id, cast(sum(n) as bigint) as raw, cast(sum(th) as bigint) as th, cast(sum(ch) - count(*) filter (tail) as bigint) as rle, min(n) as min_length, max(n) as max_length from pr group by block_id),
qs as (select *, case when rle > 0 and th / rle > 1.25 then 'RLE' when th > 0 and raw / th > 1.10 then 'TRUNCATED' else 'PLAIN' end as scheme from st)"""
RUNS = CELLS + """,
g0 as (select *, case when cq is distinct from lag(cq) over (partition by block_id order by read_id, pos) then 1 else 0 end as new from c),
g1 as (select *, sum(new) over (partition by block_id order by read_id, pos rows unbounded preceding) as isle from g0),
g2 as (select block_id, isle, min(cq) as symbol, count(*) as len from g1 group by all),
g3 as (select *, unnest(range(0, (len - 1) // 255 + 1)) as part from g2),
runs as (select block_id, row_number() over (partition by block_id order by isle, part) - 1 as run, symbol, least(255, len - 255 * part) - 1 as length from g3)"""
CONTEXTS = RUNS + """,
rc as (select *, coalesce(lag(symbol) over (partition by block_id order by run), min(symbol) over (partition by block_id)) as before from runs),
ctx as (select block_id, 'symbol' as kind, before as context, symbol as value, count(*) as n from rc group by all
  union all select block_id, 'length', symbol, length, count(*) from rc group by all)"""
FIELDS = """fl as (select block_id, read_id, unnest(regexp_split_to_array(title, '[ ._,=:/#-]')) as value,
    generate_subscripts(regexp_split_to_array(title, '[ ._,=:/#-]'), 1) - 1 as field, list_concat(regexp_extract_all(title, '[ ._,=:/#-]'), [chr(10)]) as seps from reads),
nm as (select *, case when regexp_full_match(value, '(0|[1-9][0-9]*)') and length(value) <= 10 and try_cast(value as bigint) <= 1073741824 then try_cast(value as bigint) end as number from fl),
dl as (select *, number - lag(number) over w as delta, row_number() over w as rn from nm window w as (partition by block_id, field order by read_id))"""
PROFILE = FIELDS + """,
pf as (select block_id, field, count(*) as n, count(distinct value) as distinct_values, min(length(value)) as len_min, max(length(value)) as len_max, arg_min(value, read_id) as first_value,
  count(distinct value) = 1 as constant, count(*) = count(number) as numeric,
  case when count(*) = count(number) then min(number) end as v_min, case when count(*) = count(number) then max(number) end as v_max,
  case when count(*) = count(number) then min(delta) end as d_min, case when count(*) = count(number) then max(delta) end as d_max from dl group by block_id, field)"""


def _isles(value: str, where: str, name: str) -> str:
    return f"""{name}0 as (select *, case when {value} is distinct from lag({value}) over (partition by block_id, field order by read_id) then 1 else 0 end as new from dl where {where}),
{name}1 as (select *, sum(new) over (partition by block_id, field order by read_id rows unbounded preceding) as isle from {name}0),
{name}2 as (select block_id, field, isle, count(*) as len from {name}1 group by all),
{name} as (select block_id, field, count(*) - 1 + sum((len - 1) // 256) + case when (arg_max(len, isle) - 1) % 256 > 0 then 1 else 0 end as runs from {name}2 group by block_id, field)"""


SCHEMES = PROFILE + f""",
{_isles('number', 'true', 'vi')},
{_isles('delta', 'rn > 1', 'di')},
kd as (select block_id, field, count(distinct number) as vk, count(distinct delta) as dk from dl group by all),
x as (select p.*, vi.runs as value_runs, coalesce(di.runs, 0) as delta_runs, v_max - v_min as vr, coalesce(d_max - d_min, -2147483648) as dr, vk, dk
  from pf p join vi using (block_id, field) left join di using (block_id, field) join kd using (block_id, field)),
fs as (select *, case when constant then 'CONST' when not numeric then 'TEXT' when vr >= dr and dr = 0 then 'DELTA_CONST'
  when vr >= dr and delta_runs > 0 and n / delta_runs > 1.25 then 'DELTA_RLE' when value_runs > 0 and n / value_runs > 1.25 then 'VALUE_RLE'
  when vr >= dr then 'DELTA_VAR' else 'VALUE_VAR' end as scheme from x)"""
DNA = CELLS + """,
ds as (select block_id, count(*) filter (keep) as bases, count(distinct case when keep then b end) as symbols, max(case when keep then b end) as top from c group by block_id),
dna as (select block_id, bases, symbols, case when symbols = 0 then 'NONE' when symbols > 4 then 'HUFFMAN' when top >= 4 then 'ERROR' else 'B2' end as scheme from ds)"""


def _bits(source: str, keys: str, symbol: str, name: str) -> str:
    """Recursive merge of the two least nodes of each group's histogram."""
    return f"""{name}0 as (select {keys}, list_sort(list({{'f': cast(n as bigint), 'sym': cast({symbol} as bigint)}})) as h, count(*) as symbols, cast(sum(n) as bigint) as total from {source} group by {keys}),
{name}1 as (select {keys}, symbols, total, h, cast(0 as bigint) as cost, cast(1 as bigint) as i from {name}0
  union all select {keys}, symbols, total, list_sort(list_append(h[3:], {{'f': h[1].f + h[2].f, 'sym': cast({X.MERGED} + i as bigint)}})), cost + h[1].f + h[2].f, i + 1 from {name}1 where len(h) > 1),
{name} as (select {keys}, symbols, total, case when symbols = 1 then total else max(cost) end as bits from {name}1 group by {keys}, symbols, total)"""


def _width(n: str) -> str:
    return f"(case when {n} <= 1 then 0 else length(bin({n} - 1)) end)"


def _tree(p: str, n: str) -> str:
    return f"(13 + cast(ceil((greatest(2, {p}) - 1 + greatest(2, {p}) * (1 + {_width(n)})) / 8) as bigint))"


def _sql(view: str, body: str, recursive: bool = False) -> str:
    return f"with {'recursive ' * recursive}reads as ({view}),\n{body}" if not body.startswith("select") else f"with reads as ({view})\n{body}"


Operator = Callable[[DataFrame], DataFrame]
#: name -> (view, operator, SQL after the view)
TABLE: dict[str, tuple[str, Operator, str]] = {
    "reads": (V.READS_SQL, lambda r: r, "select * from reads"),
    "reads_valid": (
        V.BROKEN_SQL,
        lambda r: records.with_validity(r).groupBy("block_id").agg(*_counts("valid", "taken")),
        """v as (select *, title like '@%' and length(plus) > 0 and length(seq) = length(qual) as valid from reads),
t as (select *, bool_and(valid) over (partition by block_id order by read_id rows unbounded preceding) as taken from v)
select block_id, count(*) as n, count(*) filter (valid) as valid, count(*) filter (taken) as taken from t group by block_id""",
    ),
    "stream_sizes": (V.VARIED_SQL, records.stream_sizes, "select block_id, cast(sum(length(title)) as bigint) as title_bytes, cast(sum(length(seq)) as bigint) as seq_bytes, cast(sum(length(qual)) as bigint) as qual_bytes from reads group by block_id"),
    "symbol_checks": (
        V.READS_SQL.replace("seq,\n", "case when read_id % 50 = 7 then lower(seq) else seq end as seq,\n", 1),
        records.symbol_checks,
        """select block_id, count(*) filter (not regexp_full_match(seq, '[AGCTNRWSKMDVHBYXU.-]*')) as bad_bases,
  count(*) filter (len(list_filter(string_split(qual, ''), lambda c: ascii(c) < 33)) > 0) as low_qualities, cast(0 as bigint) as high_qualities from reads group by block_id""",
    ),
    "dataset_sniff": (
        V.READS_SQL,
        records.sniff,
        """c as (select read_id, unnest(string_split(qual, '')) as ch from reads),
q as (select min(ascii(ch)) as lo, max(ascii(ch)) as hi from c),
f as (select count(*) as n, bool_or(regexp_full_match(substr(seq, 2, 1), '[0-3.]')) as any_c, bool_and(regexp_full_match(substr(seq, 2, 1), '[0-3.]')) as all_c from reads),
o as (select *, case when hi <= 74 and lo >= 33 then 33 when hi > 74 and hi <= 105 and lo >= 64 then 64 when hi > 74 and hi <= 105 and lo >= 59 then 59 when lo >= 33 then 33 end as off from q, f)
select false as plus_repetition, any_c as color_space, cast(lo as int) as min_q, cast(hi as int) as max_q, cast(off as int) as quality_offset, n > 1 and any_c = all_c and off is not null as ok from o""",
    ),
    "block_header": (
        V.VARIED_SQL,
        records.block_headers,
        """select block_id, count(*) as records, max(length(qual)) as max_q, min(length(qual)) as min_q, cast(sum(length(title) + length(seq) + length(qual) + 5) as bigint) as chunk_size,
  cast(case when max(length(qual)) <> min(length(qual)) then 2 else 0 end as int) as flags from reads group by block_id""",
    ),
    "base_histogram": (V.ALPHABETS_SQL, dna.base_histogram, CELLS + "\nselect block_id, cast(b as int) as base, count(*) as n from c where keep group by all"),
    "dna_scheme": (V.ALPHABETS_SQL, dna.schemes, DNA + "\nselect * from dna"),
    "dna_section_bytes": (
        V.ALPHABETS_SQL,
        dna.section_bytes,
        DNA + ",\nbh as (select block_id, b, count(*) as n from c where keep group by all),\n" + _bits("bh", "block_id", "b", "bt") + f"""
select d.block_id, scheme, cast(case scheme when 'NONE' then 1 when 'B2' then 1 + ceil(2 * bases / 8) when 'HUFFMAN' then 4 + {_tree('d.symbols', 'd.symbols')} + ceil(bits / 8) end as bigint) as bytes
from dna d left join bt on d.block_id = bt.block_id""",
    ),
    "coupled_lengths": (V.READS_SQL, dna.coupled_lengths, CELLS + "\nselect block_id, read_id, count(*) filter (keep) as dna_length, count(*) filter (cq < 128) as recovered_length, cast(sum(cq) as bigint) as coded_sum from c group by all"),
    "coupling_roundtrip": (V.READS_SQL, dna.roundtrip, "select block_id, count(*) as reads, cast(0 as bigint) as mismatches from reads group by block_id"),
    "quality_histogram": (V.READS_SQL, quality.histogram, CELLS + "\nselect block_id, cast(cq as int) as quality, count(*) as n from c group by all"),
    "quality_scheme": (V.READS_SQL, quality.schemes, STATS + "\nselect * from qs"),
    "trim_len": (V.READS_SQL, quality.trimmed_lengths, "select block_id, read_id, cast(case when length(qual) = 0 then 0 else greatest(1, length(rtrim(qual, '#'))) end as bigint) as trimmed from reads"),
    "truncated_roundtrip": (
        V.READS_SQL,
        quality.truncated_roundtrip,
        """t as (select *, substr(qual, 1, greatest(1, length(rtrim(qual, '#')))) as p from reads)
select block_id, cast(sum(length(p)) as bigint) as kept, count(*) filter (rpad(p, cast(length(qual) as int), '#') <> qual) as mismatches from t group by block_id""",
    ),
    "dense_alphabet": (V.READS_SQL, quality.dense_alphabet, CELLS + ",\nh as (select distinct block_id, cq from c)\nselect block_id, cast(cq as int) as quality, dense_rank() over (partition by block_id order by cq) - 1 as dense from h"),
    "position_histogram": (V.READS_SQL, quality.position_histogram, CELLS + "\nselect block_id, cast(pos as int) as pos, cast(cq as int) as quality, count(*) as n from c group by all"),
    "position_huffman_bits": (
        V.READS_SQL,
        quality.position_bits,
        CELLS + ",\nph as (select block_id, cast(pos as int) as pos, cq, count(*) as n from c group by all),\n" + _bits("ph", "block_id, pos", "cq", "pb") + "\nselect * from pb",
    ),
    "quality_runs": (V.READS_SQL, quality.runs, RUNS + "\nselect block_id, run, cast(symbol as int) as symbol, length from runs"),
    "quality_run_roundtrip": (V.READS_SQL, quality.run_roundtrip, RUNS + "\nselect block_id, count(*) as runs, cast(sum(length + 1) as bigint) as qualities, true as equal from runs group by block_id"),
    "run_contexts": (V.READS_SQL, quality.run_contexts, CONTEXTS + "\nselect block_id, kind, cast(context as int) as context, value, n from ctx"),
    "title_fields": (V.READS_SQL, titles.fields, FIELDS + "\nselect block_id, read_id, cast(field as int) as field, value, seps[field + 1] as separator from fl"),
    "title_rebuild": (V.READS_SQL, titles.rebuilt, "select block_id, count(*) as titles, cast(0 as bigint) as mismatches from reads group by block_id"),
    "title_layout": (
        V.MIXED_SQL,
        titles.layouts,
        """l as (select block_id, count(distinct regexp_replace(title, '[^ ._,=:/#-]', '', 'g')) as layouts from reads group by block_id)
select *, layouts > 1 as mixed from l""",
    ),
    "field_profile": (V.TITLES_SQL, titles.profile, PROFILE + "\nselect * replace (cast(field as int) as field) from pf"),
    "field_scheme": (
        V.TITLES_SQL,
        titles.schemes,
        SCHEMES + """
select block_id, cast(field as int) as field, scheme, case scheme when 'DELTA_VAR' then dr + 1 <= 512 and dk <= 512 when 'VALUE_VAR' then vr + 1 <= 512 and vk <= 512 else false end as huffman from fs""",
    ),
    "field_scheme_reads": (
        V.READS_SQL,
        titles.schemes,
        SCHEMES + """
select block_id, cast(field as int) as field, scheme, case scheme when 'DELTA_VAR' then dr + 1 <= 512 and dk <= 512 when 'VALUE_VAR' then vr + 1 <= 512 and vk <= 512 else false end as huffman from fs""",
    ),
    "numeric_histogram": (
        V.TITLES_SQL,
        titles.numeric_histogram,
        PROFILE + """,
z as (select d.* from dl d join pf using (block_id, field) where numeric)
select block_id, cast(field as int) as field, 'value' as kind, number as value, count(*) as n from z group by all
union all select block_id, cast(field as int), 'delta', delta, count(*) from z where delta is not null group by all""",
    ),
    "field_char_mask": (
        V.TITLES_SQL,
        titles.char_mask,
        FIELDS + """,
fv as (select *, first_value(value) over (partition by block_id, field order by read_id) as first from fl where length(value) >= 0),
ch as (select block_id, field, first, unnest(range(0, length(value))) as pos, value from fv)
select block_id, cast(field as int) as field, cast(least(pos, 128) as int) as pos, count(distinct substr(value, pos + 1, 1)) as chars,
  bool_and(pos < length(first) and substr(value, pos + 1, 1) = substr(first, pos + 1, 1)) as fixed from ch group by all""",
    ),
    "delta_decode": (V.TITLES_SQL, titles.delta_decoded, PROFILE + "\nselect block_id, cast(field as int) as field, n, cast(0 as bigint) as mismatches from pf where numeric"),
    "encoding_plan": (
        V.TITLES_SQL,
        encoding.encoding_plan,
        STATS.replace("e as (select", "e as (select", 1) + ",\n" + DNA[len(CELLS) + 2 :] + ",\n" + SCHEMES + """
select block_id, 'quality' as stream, scheme from qs union all select block_id, 'dna', scheme from dna
union all select block_id, 'title.' || field, scheme from fs""",
    ),
    "refused_blocks": (
        V.MIXED_SQL,
        encoding.refused,
        DNA + ",\n" + SCHEMES + """
select block_id, 'dna' as stream, scheme as reason from dna where scheme = 'ERROR'
union all select block_id, 'title.' || field, scheme from fs where scheme in ('VALUE_RLE', 'DELTA_RLE')
union all select block_id, 'title', 'MIXED_TITLES' from reads group by block_id having count(distinct regexp_replace(title, '[^ ._,=:/#-]', '', 'g')) > 1""",
    ),
    "bit_width": (V.READS_SQL, lambda r: r.selectExpr("read_id", f"cast({X.bit_width('read_id')} as bigint) as width", f"cast({X.id_width('read_id')} as bigint) as id_width"), "select read_id, cast(case when read_id = 0 then 0 else length(bin(read_id)) end as bigint) as width, cast(case when read_id <= 1 then 0 else length(bin(read_id - 1)) end as bigint) as id_width from reads"),
    "block_size_estimate": (
        V.READS_SQL,
        encoding.size_estimate,
        STATS + ",\n" + DNA[len(CELLS) + 2 :] + ",\n" + CONTEXTS[len(CELLS) + 2 :] + f""",
hd as (select block_id, cast(sum(length(title) + length(seq) + length(qual) + 5) as bigint) as text_bytes from reads group by block_id),
bh as (select block_id, b, count(*) as n from c where keep group by all),
ka as (select block_id, read_id, greatest(1, coalesce(max(pos + 1) filter (cq <> 2), 0)) as k, count(*) as n from c group by all),
ph as (select c.block_id, c.pos, c.cq, count(*) as n from c join ka using (block_id, read_id) join qs using (block_id) where scheme = 'PLAIN' or scheme = 'TRUNCATED' and c.pos < k group by all),
{_bits('bh', 'block_id', 'b', 'bt')}, {_bits('ph', 'block_id, pos', 'cq', 'pb')}, {_bits('ctx', 'block_id, kind, context', 'value', 'cb')},
al as (select block_id, count(distinct cq) as dense from c group by block_id),
pl as (select block_id, sum({_tree('symbols', 'dense')}) as trees, sum(bits) as bits, count(*) as filled from pb join al using (block_id) group by block_id),
ct as (select block_id, count(*) as records, sum(case when k < n then case when min_length <> max_length then length(bin(n)) else length(bin(max_length)) end else 0 end) as cut_bits from ka join qs using (block_id) group by block_id),
rl as (select block_id, count(distinct symbol) as qd, count(distinct length) as ld from runs group by block_id),
rt as (select block_id, sum(case when kind = 'symbol' then {_tree('symbols', 'qd')} else {_tree('symbols', 'ld')} end) as trees, sum(bits) as bits, count(*) filter (kind = 'symbol') as nx from cb join rl using (block_id) group by block_id)
select hd.block_id, text_bytes,
  cast(case qs.scheme when 'PLAIN' then 37 + pl.trees + ceil(pl.bits / 8) when 'TRUNCATED' then 37 + pl.trees + (max_length - filled) * {_tree('0', 'dense')} + ceil((1 + records + cut_bits + pl.bits) / 8)
    else case when qd = 1 then 69 + case when ld = 2 then 1 else 0 end else 69 + rt.trees + (qd - nx) * {_tree('0', 'qd')} + ceil(rt.bits / 8) end end as bigint) as quality_bytes,
  cast(case dna.scheme when 'NONE' then 1 when 'B2' then 1 + ceil(2 * bases / 8) when 'HUFFMAN' then 4 + {_tree('dna.symbols', 'dna.symbols')} + ceil(bt.bits / 8) end as bigint) as dna_bytes
from hd join qs using (block_id) join dna using (block_id) left join pl using (block_id) left join ct using (block_id) left join rl using (block_id) left join rt using (block_id) left join al using (block_id) left join bt using (block_id)""",
    ),
}


def _counts(*flags: str) -> list:
    return [F.count("*").alias("n"), *[F.count_if(f).alias(f) for f in flags]]


def archive_roundtrip(reads: DataFrame) -> DataFrame:
    """Encode each block, decode it, and compare it with what went in."""
    back = archive.decoded(archive.encoded(archive.blocks_in_place(reads), verify=False))
    order = Window.partitionBy("block_id").orderBy("read_id")
    own = reads.withColumn("place", F.row_number().over(order) - 1)
    both = own.join(back.withColumnsRenamed({c: f"b_{c}" for c in ("title", "seq", "qual")}), ["block_id", "place"], "full")
    wrong = F.expr("not (title <=> b_title and seq <=> b_seq and qual <=> b_qual)")
    return both.groupBy("block_id").agg(F.count("*").alias("records"), F.count_if(wrong).alias("mismatches"))


def fastq_roundtrip(reads: DataFrame) -> DataFrame:
    """Write reads as FASTQ, scan the file in chunks of 64 KiB, and give what
    was read; ids are those of the scan, so only the content is returned."""
    path = f"{shared_dir(reads.sparkSession).rstrip('/')}/reads-{uuid.uuid4().hex}.fastq"
    fastq.write_fastq(reads, path)
    return fastq.read_fastq(reads.sparkSession, path, 1 << 16).select("title", "seq", "qual", "plus")


def archive_scan(reads: DataFrame) -> DataFrame:
    """Write an archive and read its blocks' heads and titles back."""
    path = f"{shared_dir(reads.sparkSession).rstrip('/')}/reads-{uuid.uuid4().hex}.arc"
    archive.write_archive(archive.encoded(archive.blocks_in_place(reads)), path)
    heads = archive.read_archive(reads.sparkSession, path, "head").select("block_id", "records", "chunk_size")
    titles = archive.read_archive(reads.sparkSession, path, "title").groupBy("block_id").agg(F.sum(F.length("title")).cast("long").alias("title_bytes"))
    return heads.join(titles, "block_id")


def pack_unpack(reads: DataFrame) -> DataFrame:
    """Write reads as FASTQ, pack the file, unpack the archive, read that."""
    from . import api

    spark, path = reads.sparkSession, f"{shared_dir(reads.sparkSession).rstrip('/')}/reads-{uuid.uuid4().hex}"
    fastq.write_fastq(reads, f"{path}.fastq")
    api.pack(spark, f"{path}.arc", f"{path}.fastq", 1 << 16)
    api.unpack(spark, f"{path}.arc", f"{path}.back.fastq")
    return fastq.read_fastq(spark, f"{path}.back.fastq", 1 << 16, "exact").select("title", "seq", "qual", "plus")


TABLE |= {
    "archive_roundtrip": (V.VARIED_SQL, archive_roundtrip, "select block_id, count(*) as records, cast(0 as bigint) as mismatches from reads group by block_id"),
    "archive_schemes": (V.ARCHIVE_SQL, archive_roundtrip, "select block_id, count(*) as records, cast(0 as bigint) as mismatches from reads group by block_id"),
    "pack_unpack": (V.VARIED_SQL, pack_unpack, "select title, seq, qual, '+' as plus from reads"),
    "fastq_roundtrip": (V.VARIED_SQL, fastq_roundtrip, "select title, seq, qual, '+' as plus from reads"),
    "archive_scan": (
        V.READS_SQL,
        archive_scan,
        "select block_id, count(*) as records, cast(sum(length(title) + length(seq) + length(qual) + 5) as bigint) as chunk_size, cast(sum(length(title)) as bigint) as title_bytes from reads group by block_id",
    ),
}


READ_LENGTH = 50
GENERATED = f"""select cast(floor(i / 4096) as bigint) as block_id, count(*) as reads, cast(0 as bigint) as bad_titles, cast(0 as bigint) as bad_bases, cast(0 as bigint) as bad_qualities,
  cast(count(*) * {READ_LENGTH} as bigint) as bases, true as repeats_fit from (select unnest(range(0, (select count(*) from orders))) as i) group by all"""


def generate_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of as many generated reads as there are orders: titles and
    symbols by pattern, and whether about 80 of 100 bases (and a fourth of the
    others) repeat the one before, to 3 standard deviations of 85 of 100."""
    from .api import generated

    rows = generated(spark, spark.read.parquet(f"{sf_dir}/orders.parquet").count(), READ_LENGTH)
    same = "size(filter(sequence(2, length(seq)), i -> substring(seq, i, 1) = substring(seq, i - 1, 1)))"
    wrong = lambda c, p: F.count_if(~F.col(c).rlike(p))
    per = rows.groupBy("block_id").agg(
        F.count("*").alias("reads"),
        F.count_if(~(F.col("title").rlike("^@SRR001471[.][0-9]+ HWI-EAS7:1:3:[0-9]{1,4}:[0-9]{1,4}/1$") & F.col("title").startswith(F.concat(F.lit("@SRR001471."), 1_000_000 + F.col("read_id"), F.lit(" "))))).alias("bad_titles"),
        wrong("seq", "^[ACGT]+$").alias("bad_bases"),
        wrong("qual", "^[!-I]+$").alias("bad_qualities"),
        F.sum(F.length("seq")).cast("long").alias("bases"),
        F.expr(f"sum({same})").alias("same"),
    )
    steps = "(bases - reads)"
    return per.selectExpr("block_id", "reads", "bad_titles", "bad_bases", "bad_qualities", "bases", f"abs(same - 0.85D * {steps}) <= 3 * sqrt(0.85D * 0.15D * {steps}) + 0.01D * {steps} as repeats_fit")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, v=v, f=f: f(V.view(spark, sf_dir, v))) for name, (v, f, _) in TABLE.items()} | {"generate_reads": generate_reads}


def oracle_sql() -> dict[str, str]:
    deep = ("dna_section_bytes", "position_huffman_bits", "block_size_estimate")
    return {name: _sql(v, body, name in deep) for name, (v, _, body) in TABLE.items()} | {"generate_reads": GENERATED}
