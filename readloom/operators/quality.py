"""The quality stream: statistics, scheme choice, histograms, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..schema import MAX_RUN, RLE_RATIO, TAIL_QUALITY, TRUNCATED_RATIO
from .dna import couple, positions
from .entropy import histogram_bits


def histogram(reads: DataFrame) -> DataFrame:
    return positions(reads).groupBy("block_id", "cq").agg(F.count("*").alias("n")).withColumnRenamed("cq", "quality")


def statistics(reads: DataFrame) -> DataFrame:
    """(block_id, raw, th, rle, min_length, max_length) over coded qualities.
    Computed within rows, so only sums are shuffled: rle counts changes of
    value in a read, less one for a read that ends in the tail quality; th adds
    the place of the last other value."""
    per = couple(reads).selectExpr(
        "block_id",
        "cast(size(coded) as bigint) as n",
        "cast(size(filter(coded, (v, i) -> i = 0 or v <> get(coded, i - 1))) as bigint) as changes",
        f"cast(coalesce(array_max(transform(coded, (v, i) -> if(v <> {TAIL_QUALITY}, i, 0))), 0) as bigint) as last",
        f"coalesce(get(coded, size(coded) - 1) = {TAIL_QUALITY}, false) as tail",
    )
    return per.groupBy("block_id").agg(
        F.sum("n").alias("raw"),
        F.sum("last").alias("th"),
        (F.sum("changes") - F.count_if("tail")).alias("rle"),
        F.min("n").alias("min_length"),
        F.max("n").alias("max_length"),
    )


def schemes(reads: DataFrame) -> DataFrame:
    rle = f"rle > 0 and cast(th as double) / rle > {RLE_RATIO}D"
    cut = f"th > 0 and cast(raw as double) / th > {TRUNCATED_RATIO}D"
    return statistics(reads).withColumn("scheme", F.expr(f"case when {rle} then 'RLE' when {cut} then 'TRUNCATED' else 'PLAIN' end"))


def trimmed_lengths(reads: DataFrame) -> DataFrame:
    return reads.selectExpr("block_id", "read_id", f"cast({X.trimmed_length()} as bigint) as trimmed")


def truncated_roundtrip(reads: DataFrame) -> DataFrame:
    """Cut each quality string to its trimmed length, refill it, compare."""
    cut = reads.selectExpr("block_id", "qual", f"substring(qual, 1, {X.trimmed_length()}) as prefix")
    return cut.groupBy("block_id").agg(F.sum(F.length("prefix")).cast("long").alias("kept"), F.count_if(F.expr("rpad(prefix, length(qual), '#') <> qual")).alias("mismatches"))


def dense_alphabet(reads: DataFrame) -> DataFrame:
    """(block_id, quality, dense): ascending dense ids of the values."""
    one = Window.partitionBy("block_id").orderBy("quality")
    return histogram(reads).select("block_id", "quality", (F.dense_rank().over(one) - 1).cast("long").alias("dense"))


def position_histogram(reads: DataFrame) -> DataFrame:
    return positions(reads).groupBy("block_id", "pos", F.col("cq").alias("quality")).agg(F.count("*").alias("n"))


def position_bits(reads: DataFrame) -> DataFrame:
    """Cost of one code tree for each position."""
    return histogram_bits(position_histogram(reads), ["block_id", "pos"], "quality", "n")


def runs(reads: DataFrame) -> DataFrame:
    """(block_id, run, symbol, length): runs of equal values over a whole
    block, across reads, of at most 255 values (length: values - 1). Runs are
    found within each read first; only those are ordered over a block, which is
    bounded, and joined where one read's last goes on in the next."""
    # lambda variables, so that neither array is computed once for each use
    ends = "filter(sequence(0, size(c) - 1), i -> i = size(c) - 1 or c[i] <> c[i + 1])"
    each = "transform(e, (i, k) -> named_struct('symbol', c[i], 'len', cast(i - if(k = 0, -1, e[k - 1]) as bigint)))"
    own = couple(reads).where("length(qual) > 0").selectExpr("block_id", "read_id", f"posexplode(transform(array(coded), c -> transform(array({ends}), e -> {each})[0])[0]) as (pos, x)")
    own = own.selectExpr("block_id", "read_id", "pos", "x.symbol as symbol", "x.len as len")
    order = "over (partition by block_id order by read_id, pos)"
    rows = own.withColumn("new", F.expr(f"cast(symbol is distinct from lag(symbol) {order} as int)")).withColumn("island", F.expr(f"sum(new) {order}"))
    isles = rows.groupBy("block_id", "island").agg(F.first("symbol").alias("symbol"), F.sum("len").alias("len"))
    part = f"explode(sequence(0, cast((len - 1) div {MAX_RUN} as int)))"
    cut = isles.selectExpr("block_id", "island", "symbol", "len", f"{part} as part")
    order = Window.partitionBy("block_id").orderBy("island", "part")
    return cut.select("block_id", (F.row_number().over(order) - 1).cast("long").alias("run"), "symbol", F.expr(f"cast(least({MAX_RUN}, len - {MAX_RUN} * part) - 1 as bigint)").alias("length"))


def run_roundtrip(reads: DataFrame) -> DataFrame:
    """Expand the runs of each block and compare with its stream."""
    back = runs(reads).groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("run", "symbol", "length"))).alias("r"))
    back = back.select("block_id", F.expr("flatten(transform(r, x -> array_repeat(x.symbol, cast(x.length + 1 as int))))").alias("values"), F.size("r").cast("long").alias("runs"))
    whole = couple(reads).groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("read_id", "coded"))).alias("w")).select("block_id", F.flatten(F.transform("w", lambda x: x["coded"])).alias("stream"))
    return back.join(whole, "block_id").selectExpr("block_id", "runs", "cast(size(stream) as bigint) as qualities", "values = stream as equal")


def run_contexts(reads: DataFrame) -> DataFrame:
    """(block_id, kind, context, value, n): run symbols by the symbol before
    (the block's smallest for the first) and run lengths by their own symbol."""
    return _contexts(runs(reads))


def _contexts(runs: DataFrame) -> DataFrame:
    prev = "coalesce(lag(symbol) over (partition by block_id order by run), min(symbol) over (partition by block_id))"
    rows = runs.selectExpr("block_id", "symbol", "length", f"{prev} as before")
    pair = rows.selectExpr("block_id", "inline(array(named_struct('kind', 'symbol', 'context', before, 'value', cast(symbol as bigint)), named_struct('kind', 'length', 'context', symbol, 'value', length)))")
    return pair.groupBy("block_id", "kind", "context", "value").agg(F.count("*").alias("n"))


def section_bytes(reads: DataFrame) -> DataFrame:
    """(block_id, scheme, bytes): stored size of the plain and RLE quality
    sections by closed form; TRUNCATED needs the trimmed prefixes' histogram."""
    plan = schemes(reads)
    alphabet = histogram(reads).groupBy("block_id").agg(F.count("*").alias("dense"))
    cut = couple(reads).selectExpr("block_id", "read_id", "coded", "greatest(1, coalesce(array_max(transform(coded, (v, i) -> if(v <> 2, i + 1, 0))), 0)) as keep")
    cut = cut.join(plan.select("block_id", "scheme", "max_length", "min_length"), "block_id")
    cells = cut.selectExpr("block_id", "read_id", "scheme", "posexplode(if(scheme = 'TRUNCATED', slice(coded, 1, keep), coded)) as (pos, cq)").where("scheme <> 'RLE'")
    bits = histogram_bits(cells.groupBy("block_id", "pos", "cq").agg(F.count("*").alias("n")), ["block_id", "pos"], "cq", "n")
    plain = bits.join(alphabet, "block_id").groupBy("block_id").agg(F.sum(F.expr(X.tree_bytes("symbols", "dense"))).alias("trees"), F.sum("bits").alias("bits"), F.count("*").alias("filled"))
    head = cut.groupBy("block_id").agg(F.count("*").alias("records"), F.sum(F.expr(f"if(keep < size(coded), if(min_length <> max_length, {X.bit_width('size(coded)')}, {X.bit_width('max_length')}), 0)")).alias("cut_bits"))
    every = runs(reads)
    ctx = _contexts(every)
    lens = every.groupBy("block_id").agg(F.count("*").alias("runs"), F.count_distinct("symbol").alias("qd"), F.count_distinct("length").alias("ld"))
    cost = histogram_bits(ctx, ["block_id", "kind", "context"], "value", "n").join(lens, "block_id")
    tree = F.expr(f"if(kind = 'symbol', {X.tree_bytes('symbols', 'qd')}, {X.tree_bytes('symbols', 'ld')})")
    rle = cost.groupBy("block_id").agg(F.sum(tree).alias("r_trees"), F.sum("bits").alias("r_bits"), F.count_if(F.col("kind") == "symbol").alias("with_next"))
    every = plan.join(plain, "block_id", "left").join(head, "block_id", "left").join(rle, "block_id", "left").join(lens, "block_id", "left").join(alphabet, "block_id", "left")
    empty = X.tree_bytes("0", "dense")
    return every.selectExpr(
        "block_id",
        "scheme",
        f"""cast(case scheme
          when 'PLAIN' then 1 + 4 + 32 + trees + ceil(bits / 8)
          when 'TRUNCATED' then 1 + 4 + 32 + trees + (max_length - filled) * {empty} + ceil((1 + records + cut_bits + bits) / 8)
          else if(qd = 1, 1 + 4 + 64 + if(ld = 2, 1, 0), 1 + 4 + 64 + r_trees + (qd - with_next) * {X.tree_bytes('0', 'qd')} + ceil(r_bits / 8)) end as bigint) as bytes""",
    )
