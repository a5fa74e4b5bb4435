"""The title stream: tokens, field profiles, scheme choice, delta decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..schema import MAX_NUMERIC_SYMBOLS, MAX_TEXT_POSITIONS, NUMERIC_RLE_RATIO

SPLIT = f"split(title, '{X.SEPARATOR}')"


def fields(reads: DataFrame) -> DataFrame:
    """(block_id, read_id, field, value, separator): the title's tokens with
    the separator after each (a line feed after the last)."""
    seps = f"concat(regexp_extract_all(title, '({X.SEPARATOR})', 1), array('\\n'))"
    rows = reads.selectExpr("block_id", "read_id", f"posexplode(zip_with({SPLIT}, {seps}, (v, s) -> named_struct('v', v, 's', s))) as (field, x)")
    return rows.selectExpr("block_id", "read_id", "field", "x.v as value", "x.s as separator")


def rebuilt(reads: DataFrame) -> DataFrame:
    """Titles by block and how many differ when joined again from tokens."""
    seps = f"concat(regexp_extract_all(title, '({X.SEPARATOR})', 1), array(''))"
    back = f"array_join(zip_with({SPLIT}, {seps}, (v, s) -> concat(v, s)), '')"
    return reads.selectExpr("block_id", f"{back} <> title as bad").groupBy("block_id").agg(F.count("*").alias("titles"), F.count_if("bad").alias("mismatches"))


def layouts(reads: DataFrame) -> DataFrame:
    """(block_id, layouts, mixed): distinct separator sequences."""
    shape = "regexp_replace(title, '[^ ._,=:/#-]', '')"
    return reads.groupBy("block_id").agg(F.count_distinct(F.expr(shape)).alias("layouts")).selectExpr("block_id", "layouts", "layouts > 1 as mixed")


def _numbers(reads: DataFrame) -> DataFrame:
    rows = fields(reads).withColumn("number", F.expr(f"if({X.is_number('value')}, try_cast(value as bigint), null)"))
    order = Window.partitionBy("block_id", "field").orderBy("read_id")
    return rows.withColumns({"delta": F.col("number") - F.lag("number").over(order), "rn": F.row_number().over(order)})


def profile(reads: DataFrame) -> DataFrame:
    """A row for each field of each block: counts, lengths, constancy, and for
    fields that are numbers in every title the ranges of values and deltas."""
    rows = _numbers(reads)
    per = rows.groupBy("block_id", "field").agg(
        F.count("*").alias("n"),
        F.count_distinct("value").alias("distinct_values"),
        F.min(F.length("value")).cast("long").alias("len_min"),
        F.max(F.length("value")).cast("long").alias("len_max"),
        F.min_by("value", "read_id").alias("first_value"),
        F.bool_and(F.col("number").isNotNull()).alias("numeric"),
        F.min("number").alias("v_min"),
        F.max("number").alias("v_max"),
        F.min("delta").alias("d_min"),
        F.max("delta").alias("d_max"),
    )
    only = lambda c: F.when(F.col("numeric"), F.col(c)).alias(c)
    return per.select("block_id", "field", "n", "distinct_values", "len_min", "len_max", "first_value", (F.col("distinct_values") == 1).alias("constant"), "numeric", *map(only, ("v_min", "v_max", "d_min", "d_max")))


def _run_count(name: str, where: str) -> str:
    """Transitions between equal neighbours, a run splitting after 256 repeats.
    Of islands of equal values (place k of len), each adds 1 and one for every
    256 repeats, which come at places 257, 513 and so on; the last adds one only
    if what is left of it repeats."""
    last = f"(max_by({name}_place, rn) filter (where {where}) - 1) % 256 > 0"
    return f"count_if({where} and ({name}_place - 1) % 256 = 0) - 1 + if({last}, 1, 0)"


def schemes(reads: DataFrame) -> DataFrame:
    """(block_id, field, scheme, huffman): how each field is stored. One pass
    sorts the fields' values; all figures come from it."""
    order = "over (partition by block_id, field order by read_id)"
    rows = _numbers(reads)
    rows = rows.selectExpr("*", f"cast(number is distinct from lag(number) {order} as int) as v_new", f"cast(delta is distinct from lag(delta) {order} or rn = 2 as int) as d_new")
    rows = rows.selectExpr("*", f"last_value(if(v_new = 1, rn, null), true) {order} as v_first", f"last_value(if(d_new = 1, rn, null), true) {order} as d_first")
    rows = rows.selectExpr("*", "rn - v_first + 1 as v_place", "rn - d_first + 1 as d_place")
    x = rows.groupBy("block_id", "field").agg(
        F.count("*").alias("n"),
        (F.min("value") == F.max("value")).alias("constant"),
        F.bool_and(F.col("number").isNotNull()).alias("numeric"),
        F.expr("max(number) - min(number)").alias("vr"),
        F.expr(f"coalesce(max(delta) - min(delta), {-(1 << 31)})").alias("dr"),
        F.expr(_run_count("v", "true")).alias("value_runs"),
        F.expr(f"if(count(*) > 1, {_run_count('d', 'rn > 1')}, 0)").alias("delta_runs"),
        F.count_distinct("number").alias("v_keys"),
        F.count_distinct("delta").alias("d_keys"),
    )
    ratio = NUMERIC_RLE_RATIO
    ladder = f"""case when constant then 'CONST' when not numeric then 'TEXT'
      when vr >= dr and dr = 0 then 'DELTA_CONST'
      when vr >= dr and delta_runs > 0 and n / delta_runs > {ratio} then 'DELTA_RLE'
      when value_runs > 0 and n / value_runs > {ratio} then 'VALUE_RLE'
      when vr >= dr then 'DELTA_VAR' else 'VALUE_VAR' end"""
    x = x.withColumn("scheme", F.expr(ladder))
    huff = f"case scheme when 'DELTA_VAR' then dr + 1 <= {MAX_NUMERIC_SYMBOLS} and d_keys <= {MAX_NUMERIC_SYMBOLS} when 'VALUE_VAR' then vr + 1 <= {MAX_NUMERIC_SYMBOLS} and v_keys <= {MAX_NUMERIC_SYMBOLS} else false end"
    return x.selectExpr("block_id", "field", "scheme", f"{huff} as huffman")


def numeric_histogram(reads: DataFrame) -> DataFrame:
    """(block_id, field, kind, value, n) of values and deltas of numeric fields."""
    rows = _numbers(reads)
    whole = rows.groupBy("block_id", "field").agg(F.bool_and(F.col("number").isNotNull()).alias("numeric")).where("numeric").select("block_id", "field")
    pair = rows.join(whole, ["block_id", "field"]).selectExpr("block_id", "field", "inline(array(named_struct('kind', 'value', 'value', number), named_struct('kind', 'delta', 'value', delta)))").where("value is not null")
    return pair.groupBy("block_id", "field", "kind", "value").agg(F.count("*").alias("n"))


def char_mask(reads: DataFrame) -> DataFrame:
    """(block_id, field, pos, chars, fixed): for each position of a field how
    many characters occur and whether all titles agree with the first, over the
    first's length. Positions from the limit on share one bucket."""
    rows = fields(reads).withColumn("first", F.expr("first_value(value) over (partition by block_id, field order by read_id)"))
    cells = rows.selectExpr("block_id", "field", "first", "posexplode(filter(split(value, ''), c -> c <> '')) as (pos, c)")
    cells = cells.selectExpr("block_id", "field", f"least(pos, {MAX_TEXT_POSITIONS}) as pos", "c", "pos < length(first) and c <> substring(first, pos + 1, 1) as differs", "pos < length(first) as inside")
    return cells.groupBy("block_id", "field", "pos").agg(F.count_distinct("c").alias("chars"), F.bool_and(F.col("inside") & ~F.col("differs")).alias("fixed"))


def delta_decoded(reads: DataFrame) -> DataFrame:
    """Rebuild every numeric field by a running sum of its deltas; rows that
    come out wrong, by block and field."""
    rows = _numbers(reads)
    whole = rows.groupBy("block_id", "field").agg(F.bool_and(F.col("number").isNotNull()).alias("numeric")).where("numeric").select("block_id", "field")
    order = "over (partition by block_id, field order by read_id rows between unbounded preceding and current row)"
    back = rows.join(whole, ["block_id", "field"]).withColumn("back", F.expr(f"sum(coalesce(delta, number)) {order}"))
    return back.groupBy("block_id", "field").agg(F.count("*").alias("n"), F.count_if(F.col("back") != F.col("number")).alias("mismatches"))
