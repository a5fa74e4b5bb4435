"""License scan: phrases, and an exact set-similarity join with notices.

A text is lower-cased (A-Z only) and split into words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Base labels come from phrases whose
words stand consecutively. The method adds labels from notices (templates): a
block of a notice's 2m words, m being its length, holds the notice when it has
at least ``threshold`` of its distinct words, those that tell it from others
among them. Blocks start at every word.

Candidates come from an exact containment join. The words of the notices are
ordered by how many documents of the corpus hold them, rarest first (ties: by
word). With o = ceil(threshold * s) words needed of s:

* prefix filter: a block that fits holds one of the s - o + 1 rarest, so only
  the places of these are looked at, with the words up to 2m around them;
* positional filter: a block is looked at for its rarest word alone, so words
  before that in the order do not count there, and the word itself and those
  after it around it must be o distinct ones at least;
* length filter: the blocks are those that start at a word of the notice (any
  other holds no more than the next such), and must have o distinct words.

The notices and their prefix index are a fixed parameter, broadcast. Only
DataFrame functions are used.

Defined cases: null text is empty and has no label; a null id is kept; repeated
rows share a result; a label that several notices or phrases give is listed
once; an empty table gives an empty result; texts are read whole, however long;
only the id and text columns are read, so others cannot clash.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, digest_of, let, sized

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: (label, notice, words of it that must be there); words only, as the tokens of this module.
TEMPLATES = [
    ("mit", "released under the mit license", "mit"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "granted sublicense",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "fee",
    ),
    ("apache-2", "licensed under the apache license version 2 0", "apache 2"),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "apache compliance",
    ),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gnu general",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "binary retain",
    ),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "attribution"),
    ("all-rights-reserved", "all rights reserved no part may be reproduced without permission", "reserved"),
]
#: Words that make another licence of the one whose notice they stand in.
OTHERWISE = {"gpl-3": ["lesser", "affero", "library"], "gpl": ["lesser", "affero", "library"], "cc-by": ["noncommercial", "nc", "sharealike", "sa", "noderivatives", "noderivs", "nd"]}
THRESHOLD = 0.8
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def padded(text: Column) -> Column:
    """A text's words, each preceded by one space, and a space at the end."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(lower, NOT_WORD, " ")), F.lit(" "))


def _count(part: Column) -> Column:
    return F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))


def _hits(s: Column, phrases: dict[str, str]) -> Column:
    """For each phrase that occurs: (label, n, first, last)."""

    def one(phrase: str, label: str) -> Column:
        m = len(phrase.split())
        found = let(
            F.split(s, f" {phrase}(?= )"),
            lambda p: F.struct(
                F.lit(label).alias("label"),
                (F.size(p) - 1).cast("long").alias("n"),
                _count(F.get(p, F.lit(0))).cast("long").alias("first"),
                # what follows the last place: a space before each word, and one at the end
                (_count(s) - 1 - (_count(F.element_at(p, -1)) - 1) - m).cast("long").alias("last"),
            ),
        )
        return F.when(F.contains(s, F.lit(f" {phrase} ")), found)

    return F.array_compact(F.array(*[one(p, x) for p, x in phrases.items()]))


def template_labels(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, th, found: label -> best containment as pairs) of documents with a
    block that reaches the threshold. docs: (id, th, s), s as by padded()."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t, _ in templates for w in t.split()})
    held = docs.select(F.explode(F.array_intersect(F.split(F.btrim("s"), " "), F.array(*map(F.lit, vocabulary)))).alias("w"))
    freq = dict(held.groupBy("w").count().collect())  # a row for each word of the notices at most
    index, sets = [], []
    for k, (label, t, must) in enumerate(templates):
        tokens = sorted(set(t.split()), key=lambda w: (freq.get(w, 0), w))
        need = math.ceil(threshold * len(tokens) - 1e-9)
        sets.append((k, label, 2 * len(t.split()), tokens, need, [tokens.index(w) for w in must.split()], OTHERWISE.get(label, [])))
        index += [(w, k, place) for place, w in enumerate(tokens[: len(tokens) - need + 1])]
    prefix = sorted({w for w, _, _ in index})
    kinds = spark.createDataFrame(sets, "t_k int, label string, wide int, tokens array<string>, need int, must array<int>, other array<string>")
    index = spark.createDataFrame(index, "p_w string, k int, place int")

    words = F.split(F.btrim("s"), " ")
    some = docs.where(F.arrays_overlap(words, F.array(*map(F.lit, prefix)))).select("id", "th", words.alias("words"))
    keys = some.select("id", "th", "words", F.explode(F.array_intersect("words", F.array(*map(F.lit, prefix)))).alias("w"))
    pairs = keys.join(F.broadcast(index), F.col("w") == F.col("p_w")).join(F.broadcast(kinds), F.col("k") == F.col("t_k"))
    # the words around each place of the prefix word; c: where it is among them
    spots = pairs.withColumn("p", F.explode(F.expr("filter(transform(words, (x, i) -> if(x = w, i, -1)), i -> i >= 0)")))
    spots = spots.withColumn("c", F.least("p", F.col("wide") - 1))
    spots = spots.select("id", "th", "label", "wide", "tokens", "need", "must", "other", "place", "c", F.expr("slice(words, p - c + 1, c + wide)").alias("around"))
    # (i, g): place among them, and place of the word in the notice's order
    seen = "filter(transform(around, (x, i) -> named_struct('i', i, 'g', cast(array_position(tokens, x) as int) - 1)), y -> y.g >= place)"
    spots = spots.withColumn("seen", F.expr(seen)).where("size(array_distinct(transform(seen, y -> y.g))) >= need")
    held = "array_distinct(transform(filter(seen, y -> y.i >= x.i and y.i < x.i + wide), y -> y.g))"
    fits = "size(array_except(must, h)) = 0 and not exists(slice(around, x.i + 1, wide), o -> array_contains(other, o))"
    best = f"array_max(transform(filter(seen, y -> y.i <= c), x -> transform(array({held}), h -> if(size(h) >= need and {fits}, size(h), 0))[0]))"
    got = spots.select("id", "th", "label", "need", F.size("tokens").alias("of"), F.expr(best).alias("got")).where("got >= need")
    got = got.groupBy("id", "th", "label").agg(F.max(F.col("got") / F.col("of")).alias("score"))
    return got.groupBy("id", "th").agg(F.collect_list("label").alias("m_labels"), F.max("score").alias("m_score"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """For each row: base phrase places and labels, and the labels and best
    containment of the notices (score: 1 where a phrase stands)."""
    t = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), digest_of(t).alias("th"), padded(t).alias("s"))
    extra = checkpoint(template_labels(rows, templates, threshold))
    extra = sized(extra.select(F.col("id").alias("x_id"), F.col("th").alias("x_th"), "m_labels", "m_score"))
    base = rows.select("id", "th", F.when(F.length("s") > 2, _count(F.col("s")) - 1).otherwise(0).cast("long").alias("n_words"), let(_hits(F.col("s"), phrases), lambda h: h).alias("hits"))
    out = base.join(extra, base["id"].eqNullSafe(F.col("x_id")) & (base["th"] == F.col("x_th")), "left")
    own = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["label"])))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["n"]).alias("n_base"),
        F.array_min(F.transform("hits", lambda h: h["first"])).alias("first_word"),
        F.array_max(F.transform("hits", lambda h: h["last"])).alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("m_labels", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("hits") > 0, F.lit(1.0)).otherwise(F.coalesce("m_score", F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    low = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    phrases = " union all ".join(f"select '{x}' as label, {p.split()!r} as p" for p, x in PHRASES.items())
    notices = ", ".join(f"({k}, '{x}', {2 * len(t.split())}, {sorted(set(t.split()))!r}, {math.ceil(THRESHOLD * len(set(t.split())) - 1e-9)}, {m.split()!r}, {OTHERWISE.get(x, [])!r}::varchar[])" for k, (x, t, m) in enumerate(TEMPLATES))
    return f"""
with d as (select doc_id, {low} as w from documents),
ph as ({phrases}),
spot as (select doc_id, label, i - 1 as i from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d), ph where w[i] = p[1] and w[i : i + len(p) - 1] = p),
base as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from spot group by doc_id),
nt(k, label, wide, tokens, need, must, other) as (values {notices}),
bl as (select doc_id, label, tokens, need, must, other, w[i : i + wide - 1] as b
  from (select *, unnest(range(1, len(w) + 1)) as i from d, nt where len(list_intersect(w, tokens)) >= need) where list_contains(tokens, w[i])),
got as (select doc_id, label, max(len(list_intersect(b, tokens)) / len(tokens)) as score from bl
  where len(list_intersect(b, tokens)) >= need and list_has_all(b, must) and not list_has_any(b, other) group by doc_id, label),
lab as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from spot union select doc_id, label from got) group by doc_id),
top as (select doc_id, max(score) as score from got group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, cast(case when n_base > 0 then 1 else coalesce(score, 0) end as double) as score
from d left join base on d.doc_id = base.doc_id left join lab on d.doc_id = lab.doc_id left join top on d.doc_id = top.doc_id
"""


SQL = _sql()
