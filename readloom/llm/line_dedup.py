"""Line de-duplication by overlapping three-line windows.

The lines of a text that hold a word are its content lines. Every run of three
consecutive content lines is a window (all of them, where a text has fewer),
known by a 128-bit hash. Over the whole corpus the first occurrence of a window
in order of (doc_id, text hash, position) stays; the lines covered by a later
one go, covered positions being merged. Each distinct line keeps at least its
first occurrence.

Only DataFrame functions are used. A hot window is reduced by partial
aggregation and its occurrences are joined through a skew-splittable join.

Defined cases: null text stays null with no lines; a text without words is
returned as it is; a null id comes first in the order; repeated rows are one
document and share its result; documents of one id are told apart, and ordered,
by text hash; long texts are cut whole; an empty table gives an empty result;
other columns, whatever their names, pass through the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, digest_of, fresh, has_word, let, sized
from .quality_rules import without_lines

WINDOW = 3


def _windows(text: Column, width: int) -> Column:
    """Windows of a text: array of (k, p: line positions, h1, h2)."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("p"), x.alias("x"))), lambda e: has_word(e["x"]))

    def at(c: Column, k: Column) -> Column:
        part = F.slice(c, k + 1, width)
        held = [F.get(c, k + j)["x"] for j in range(width)]
        return F.struct(k.alias("k"), F.transform(part, lambda e: e["p"]).alias("p"), F.xxhash64(F.size(part), *held).alias("h1"), F.xxhash64(F.lit("window"), F.size(part), *held).alias("h2"))

    none = F.array().cast("array<struct<k:int,p:array<int>,h1:bigint,h2:bigint>>")
    return let(lines, lambda c: F.when(F.size(c) == 0, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - width, F.lit(0))), lambda k: at(c, k))))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(id, th, removed): line positions that later occurrences cover."""
    t = F.col(text_col)
    rows = docs.where(t.isNotNull()).select(F.col(id_col).alias("id"), digest_of(t).alias("th"), F.explode(_windows(t, width)).alias("w")).select("id", "th", "w.*")
    first = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "k")).alias("f")).where("n > 1").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "f")
    later = rows.join(first, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where(~F.struct("id", "th", "k").eqNullSafe(F.col("f")))
    return later.groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_set("p"))).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, removed_col: str | None = None) -> DataFrame:
    """docs with repeated lines cut from the text; same columns, and the
    number of lines cut where removed_col names a column for it."""
    gone = checkpoint(repeated_lines(docs, id_col, text_col, width))
    gone = sized(gone.select(F.col("id").alias("rl_id"), F.col("th").alias("rl_th"), F.col("removed").alias("rl_removed")))
    box = fresh(docs, "row")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(box), digest_of(docs[text_col]).alias("t_th"))
    whole = whole.join(gone, F.col(box)[id_col].eqNullSafe(F.col("rl_id")) & (F.col("t_th") == F.col("rl_th")), "left")
    text = without_lines(F.col(box)[text_col], F.col("rl_removed"))
    out = [text.alias(c) if c == text_col else F.col(box)[c].alias(c) for c in docs.columns]
    if removed_col:
        out.append(F.coalesce(F.size("rl_removed"), F.lit(0)).cast("long").alias(removed_col))
    return whole.select(*out)


SQL = rf"""
with ln as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null),
con as (select *, row_number() over (partition by doc_id order by pos) as k, count(*) over (partition by doc_id) as n from ln where regexp_matches(line, '[^\x20\x09-\x0D]')),
win as (select a.doc_id, a.k, a.line as l1, b.line as l2, c.line as l3, [a.pos, b.pos, c.pos] as p
  from con a left join con b on a.doc_id = b.doc_id and b.k = a.k + 1 left join con c on a.doc_id = c.doc_id and c.k = a.k + 2
  where a.k <= greatest(a.n - {WINDOW} + 1, 1)),
later as (select * from win qualify row_number() over (partition by l1, l2, l3 order by doc_id, k) > 1),
gone as (select distinct doc_id, pos from (select doc_id, unnest(p) as pos from later) where pos is not null),
out as (select ln.doc_id, string_agg(ln.line, chr(10) order by ln.pos) filter (g.pos is null) as t, count(g.pos) as r
  from ln left join gone g on ln.doc_id = g.doc_id and ln.pos = g.pos group by ln.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(t, '') end as text, cast(coalesce(r, 0) as bigint) as removed_lines
from documents d left join out on d.doc_id = out.doc_id
"""
