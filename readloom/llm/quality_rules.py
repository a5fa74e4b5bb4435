"""Quality rules: text statistics and cross-document line frequency.

Base rules look at one document. The method then hashes each normalised line
(ASCII and Unicode lower case, white space collapsed), counts the distinct
documents of each host that hold it, and removes a line above the limit, except
from the first document (smallest id) of that host. The limit is
``max_line_percent`` of the host's documents, but ``few_line_docs`` at least
and ``max_line_docs`` at most. A document that loses over ``max_removed_share``
of its words is rejected.

Only DataFrame functions are used. Hot lines and hosts are counted by partial
aggregation; no task sees all rows of one.

Defined cases: null text counts as no words, so it fails; a null host is a
host of its own; rows that repeat a document (id and text) are one document and
share its result; among documents of one id the first is that of the smallest
text hash; an empty table gives an empty result; texts are read whole, however
long; other columns, whatever their names, are kept by the filter and not read
(``chars_col`` names one to be set to the length of the text that is left).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, checkpoint, digest_of, fresh, has_word, let, sized, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LINE_DOCS = 30
FEW_LINE_DOCS = 4
MAX_LINE_PERCENT = 10
MAX_REMOVED_SHARE = 0.5
WINDOW = 3


def _covered(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""

    def of(s: Column) -> Column:
        at = lambda k: F.get(s, k)["h"]
        twice = F.filter(s, lambda e, k: e["h"].eqNullSafe(at(k + 1)) | ((k > 0) & e["h"].eqNullSafe(at(F.greatest(k - 1, F.lit(0))))))
        starts = F.array_sort(F.transform(twice, lambda e: e["i"]))
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, of))


def _word_stats(words: Column) -> Column:
    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    return let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(let(windows(w), _covered)).cast("long").alias("n_repeat_words"),
        ),
    )


def base_metrics(text: Column) -> dict[str, Column]:
    """Columns of the base rules for a text that may be null."""
    t = F.coalesce(text, F.lit(""))
    stats = _word_stats(words_of(t))
    lines = F.filter(F.split(t, "\n"), has_word)
    return {
        "stats": stats,
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def normal_line(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), SPACES, " "))


def over_frequent(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, host_col: str, max_line_docs: int, few_line_docs: int = FEW_LINE_DOCS, max_line_percent: int = MAX_LINE_PERCENT) -> DataFrame:
    """(o_host, o_lh, o_id, o_th): lines above their host's limit, and the
    first document that holds each. rows: as by _lines_of()."""
    document = F.struct("id", "th")
    held = rows.groupBy("host", "lh").agg(F.count_distinct(document).alias("n"), F.min(document).alias("first")).where(F.col("n") > few_line_docs)
    t = F.col(text_col)
    own = docs.where(t.isNotNull()).select(F.col(host_col).alias("h_host"), F.col(id_col).alias("id"), digest_of(t).alias("th"))
    sizes = checkpoint(own.groupBy("h_host").agg(F.count_distinct(document).alias("docs")))
    limit = F.least(F.lit(max_line_docs), F.greatest(F.lit(few_line_docs), F.expr(f"{max_line_percent} * docs div 100")))
    held = held.join(sized(sizes, 96), F.col("host").eqNullSafe(F.col("h_host"))).where(F.col("n") > limit)
    return checkpoint(held.select(F.col("host").alias("o_host"), F.col("lh").alias("o_lh"), F.col("first.id").alias("o_id"), F.col("first.th").alias("o_th")))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_line_docs: int = MAX_LINE_DOCS) -> DataFrame:
    """(id, th, removed_words, removed) for the documents that lose lines;
    removed: positions of those among the text's \\n-split lines, from 0."""
    rows = _lines_of(docs, id_col, text_col, host_col)
    over = over_frequent(docs, rows, id_col, text_col, host_col, max_line_docs)
    hit = rows.join(sized(over, 96), rows["host"].eqNullSafe(F.col("o_host")) & (rows["lh"] == F.col("o_lh")))
    hit = hit.where(~(F.col("id").eqNullSafe(F.col("o_id")) & (F.col("th") == F.col("o_th"))))
    lost = hit.groupBy("id", "th").agg(F.collect_set(F.struct("pos", "nw")).alias("s"))
    return lost.select("id", "th", F.aggregate("s", F.lit(0).cast("long"), lambda a, e: a + e["nw"]).alias("removed_words"), F.transform("s", lambda e: e["pos"]).alias("removed"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_line_docs: int = MAX_LINE_DOCS, max_removed_share: float = MAX_REMOVED_SHARE) -> DataFrame:
    """One row of figures and the verdict for each row of docs."""
    t = F.col(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), digest_of(t).alias("b_th"), *[c.alias(n) for n, c in base_metrics(t).items()])
    base = base.select("doc_id", "b_th", "stats.*", "n_symbols", "n_dup_lines")
    lost = removed_lines(docs, id_col, text_col, host_col, max_line_docs)
    out = base.join(lost, base["doc_id"].eqNullSafe(lost["id"]) & (base["b_th"] == lost["th"]), "left")
    out = out.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))).withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= max_removed_share * F.col("n_words")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def without_lines(text: Column, removed: Column) -> Column:
    """text without the \\n-split lines at the given positions (null: none)."""

    def cut(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return F.when(removed.isNull() | (F.size(removed) == 0), text).otherwise(let(F.split(text, "\n"), cut))


def _lines_of(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(id, th, host, lh, pos, nw) for each line with a word."""
    t = F.col(text_col)
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda e: has_word(e["line"]))
    rows = docs.where(t.isNotNull()).select(F.col(id_col).alias("id"), digest_of(t).alias("th"), F.col(host_col).alias("host"), F.explode(lines).alias("e"))
    return rows.select("id", "th", "host", F.xxhash64(normal_line(F.col("e.line"))).alias("lh"), F.col("e.pos").alias("pos"), F.size(words_of(F.col("e.line"))).alias("nw"))


def settled_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_line_docs: int = MAX_LINE_DOCS, max_removed_share: float = MAX_REMOVED_SHARE) -> DataFrame:
    """(id, th, host, depleted, removed) for documents with over-frequent lines
    that pass the base rules. Of the documents of a host that are kept, the
    first (smallest id) that holds such a line keeps it, the others lose it.

    Whether a document is kept depends on smaller ones alone, so all are settled
    whose smaller holders do not matter any more, round by round; a round
    settles at least the smallest of those left, most rounds nearly all."""
    rows = _lines_of(docs, id_col, text_col, host_col)
    over = over_frequent(docs, rows, id_col, text_col, host_col, max_line_docs).select("o_host", "o_lh")
    hit = checkpoint(rows.join(sized(over, 96), rows["host"].eqNullSafe(F.col("o_host")) & (rows["lh"] == F.col("o_lh"))).select(*rows.columns))
    some = checkpoint(hit.select(F.col("id").alias("s_id"), F.col("th").alias("s_th")).distinct())
    t = F.col(text_col)
    texts = docs.select(F.col(id_col).alias("v_id"), digest_of(t).alias("v_th"), t.alias("v_text"))
    texts = texts.join(sized(some, 48), F.col("v_id").eqNullSafe(F.col("s_id")) & (F.col("v_th") == F.col("s_th")))
    fair = texts.select("v_id", "v_th", base_metrics(F.col("v_text"))["stats"].alias("st")).where(~base_failed(F.col("st.n_words"), F.col("st.n_repeat_words")))
    fair = checkpoint(fair.groupBy("v_id", "v_th").agg((max_removed_share * F.min("st.n_words")).alias("may")))
    # lines of documents that pass: k orders the holders, w counts a line's words in the document
    own = hit.groupBy("id", "th", "host", "lh").agg(F.collect_set(F.struct("pos", "nw")).alias("at"))
    own = own.join(sized(fair, 64), F.col("id").eqNullSafe(F.col("v_id")) & (F.col("th") == F.col("v_th")))
    w = F.aggregate("at", F.lit(0).cast("long"), lambda a, e: a + e["nw"])
    state = checkpoint(own.select("id", "th", "host", "lh", F.struct("id", "th").alias("k"), w.alias("w"), F.transform("at", lambda e: e["pos"]).alias("pos"), "may", F.lit(None).cast("boolean").alias("kept")))

    def with_holders(s: DataFrame) -> DataFrame:
        first = s.groupBy("host", "lh").agg(F.min(F.when(F.col("kept"), F.col("k"))).alias("held"), F.min(F.when(F.col("kept").isNull(), F.col("k"))).alias("open"))
        first = checkpoint(first.select(F.col("host").alias("f_host"), F.col("lh").alias("f_lh"), "held", "open"))
        return s.join(sized(first, 128), s["host"].eqNullSafe(F.col("f_host")) & (s["lh"] == F.col("f_lh")))

    lost = F.coalesce(F.col("held") < F.col("k"), F.lit(False))
    while state.where("kept is null").limit(1).count():
        both = with_holders(state)
        maybe = lost | F.coalesce(F.col("open") < F.col("k"), F.lit(False))
        own = both.where("kept is null").groupBy("id", "th", "host").agg(F.sum(F.when(lost, F.col("w")).otherwise(0)).alias("least"), F.sum(F.when(maybe, F.col("w")).otherwise(0)).alias("most"), F.min("may").alias("may"))
        verdict = own.select(F.col("id").alias("u_id"), F.col("th").alias("u_th"), F.col("host").alias("u_host"), F.when(F.col("least") > F.col("may"), F.lit(False)).when(F.col("most") <= F.col("may"), F.lit(True)).alias("now")).where("now is not null")
        verdict = checkpoint(verdict)
        joined = state.join(sized(verdict, 96), F.col("id").eqNullSafe(F.col("u_id")) & (F.col("th") == F.col("u_th")) & F.col("host").eqNullSafe(F.col("u_host")), "left")
        state = checkpoint(joined.select(*[c for c in state.columns if c != "kept"], F.coalesce("kept", "now").alias("kept")))
    out = with_holders(state).groupBy("id", "th", "host").agg((~F.first("kept")).alias("depleted"), F.flatten(F.collect_list(F.when(lost, F.col("pos")))).alias("removed"))
    return out


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_line_docs: int = MAX_LINE_DOCS, max_removed_share: float = MAX_REMOVED_SHARE, chars_col: str | None = None) -> DataFrame:
    """docs without rejected rows and removed lines; same columns. Unlike the
    verdicts of quality(), which are those of its SQL, an over-frequent line
    stays in the first document that is kept, not in one that may be rejected."""
    lost = checkpoint(settled_lines(docs, id_col, text_col, host_col, max_line_docs, max_removed_share))
    lost = sized(lost.select(F.col("id").alias("rl_id"), F.col("th").alias("rl_th"), F.col("host").alias("rl_host"), F.col("depleted").alias("rl_depleted"), F.col("removed").alias("rl_removed")))
    t, box = docs[text_col], fresh(docs, "row")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(box), digest_of(t).alias("t_th"), base_metrics(t)["stats"].alias("t_stats"))
    whole = whole.where(~base_failed(F.col("t_stats.n_words"), F.col("t_stats.n_repeat_words")))
    whole = whole.join(lost, F.col(box)[id_col].eqNullSafe(F.col("rl_id")) & (F.col("t_th") == F.col("rl_th")) & F.col(box)[host_col].eqNullSafe(F.col("rl_host")), "left")
    whole = whole.where(~F.coalesce("rl_depleted", F.lit(False)))
    text = without_lines(F.col(box)[text_col], F.col("rl_removed"))
    return whole.select(*[text.alias(c) if c == text_col else F.length(text).cast(dict(docs.dtypes)[c]).alias(c) if c == chars_col else F.col(box)[c].alias(c) for c in docs.columns])


SQL = rf"""
with d as (select doc_id, source as host, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, string_split(t, chr(10)) as ls from d),
win as (select doc_id, i, w[i] as a, w[i+1] as b, w[i+2] as c from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, a, b, c) > 1),
cov as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep) group by doc_id),
ln as (select doc_id, host, t, pos, line, lower(regexp_replace(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '[\x20\x09-\x0D]+', ' ', 'g')) as nl,
  len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as nw
  from (select doc_id, host, t, unnest(ls) as line, generate_subscripts(ls, 1) as pos from w)),
con as (select * from ln where nw > 0),
dup as (select doc_id, count(*) - count(distinct line) as n_dup_lines from con group by doc_id),
hs as (select source as host, count(distinct doc_id) as docs from documents where text is not null group by source),
ov as (select l.host, nl, first from (select host, nl, min(doc_id) as first, count(distinct doc_id) as n from con group by host, nl) l join hs on l.host is not distinct from hs.host
  where n > least({MAX_LINE_DOCS}, greatest({FEW_LINE_DOCS}, {MAX_LINE_PERCENT} * docs // 100))),
lost as (select c.doc_id, sum(c.nw) as removed_words from con c join ov o on c.host is not distinct from o.host and c.nl = o.nl where c.doc_id <> o.first group by c.doc_id)
select *, not base_failed and removed_words <= {MAX_REMOVED_SHARE} * n_words as kept from (
select w.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
  cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
  cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
  len(w) < {MIN_WORDS} or 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * len(w) as base_failed,
  cast(coalesce(removed_words, 0) as bigint) as removed_words
from w left join cov on w.doc_id = cov.doc_id left join dup on w.doc_id = dup.doc_id left join lost on w.doc_id = lost.doc_id)
"""
