"""License scans: an exact set-similarity join between text blocks and license notices.

Notices are whole paragraphs of public licenses, and the one-line forms in use. A text is cut into overlapping blocks of words,
whose length follows from the notice: blocks begin every `stride` words and have twice as many, with the stride the power of two that
holds the longest notice of its family, so that every run of words as long as the notice stands in one block.

A block meets a notice when it holds at least a given share (containment) of the notice's distinct tokens, and as large a share, rounded
down but one at least, of its telling tokens, those that no notice of another label has. Tokens are ordered by their frequency in all documents, rarest first;
to meet a notice of m tokens with c in common, a block must hold one of the notice's first m - c + 1 tokens (prefix
filter), hold c tokens that occur in notices at all (length filter), and have enough tokens after a common one on
both sides (positional filter). What passes is compared in full, so that the join is exact.

Licenses quote one another: notices of two labels are of one family if one has the containment's share of the other's tokens. Of the
notices of a family that a block meets, one that another label's notice covers so gives way to that one, if the block holds more of the
other (a larger share, or as large a share of more tokens). So a notice is not named after its neighbours; a block that holds two licenses of a family in full gets
the label of the larger one, next to the base labels.

Next to that, fixed phrases are located word by word; they set the base labels, which always stay.

Texts are read once: what later steps need of them (counts, places of phrases, places of the notices' tokens) is kept in the shared folder.

Cases: null and empty texts have no words and no labels; very long texts give more blocks, never larger ones; rows that
repeat an id are told apart by their texts, and equal rows get equal results. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolake.llm import common

# The phrases of the base labels, and paragraphs of public license notices.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
NOTICES = [
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation either version 3 of the license or at your option any later version",
        "gpl",
    ),
    (
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl",
    ),
    ("you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
        "as published by the free software foundation either version 2 1 of the license or at your option any later version",
        "lgpl",
    ),
    (
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
        "lgpl",
    ),
    (
        "you should have received a copy of the gnu lesser general public license along with this library if not write to the "
        "free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa",
        "lgpl",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license "
        "as published by the free software foundation either version 3 of the license or at your option any later version",
        "agpl",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "apache",
    ),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing "
        "permissions and limitations under the license",
        "apache",
    ),
    ("licensed under the apache license version 2 0", "apache"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
        "to the following conditions",
        "mit",
    ),
    (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable "
        "for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection "
        "with the software or the use or other dealings in the software",
        "mit",
    ),
    ("released under the mit license", "mit"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met",
        "bsd",
    ),
    (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
        "the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    (
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not "
        "limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the "
        "copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
        "bsd",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    (
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential "
        "damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other "
        "tortious action arising out of or in connection with the use or performance of this software",
        "isc",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with "
        "this file you can obtain one at https mozilla org mpl 2 0",
        "mpl",
    ),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense",
    ),
]

#: What parts words; before letters are lower-cased, capitals are parts of words too.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8
#: Words from one block to the next, at least.
LEAST_STRIDE = 8


def words(text: Column, gap: str = GAP) -> Column:
    return F.filter(F.split(text, gap), lambda x: x != "")


def lowered(text: Column) -> Column:
    return F.translate(text, common.UPPER, common.LOWER)


def phrase_places(found: Column) -> Column:
    """Array of (start, label), in order, of all phrases in an array of words."""

    def at(word: Column, start: Column) -> Column:
        out = F.lit(None).cast("struct<start:bigint,label:string>")
        for phrase, label in PHRASES:
            first, *rest = phrase.split()
            same = word == first
            for k, w in enumerate(rest, 1):
                same = same & F.coalesce(F.get(found, start + k) == w, F.lit(False))
            out = F.when(same, F.struct(start.cast("long").alias("start"), F.lit(label).alias("label"))).otherwise(out)
        return out

    return F.filter(F.transform(found, at), lambda x: x.isNotNull())


class Notice(NamedTuple):
    n: int
    label: str
    tokens: frozenset[str]
    need: int
    telling: frozenset[str]
    need_telling: int
    stride: int
    covered_by: list[int]  # notices of other labels that hold `need` of its tokens


def _share(containment: float, size: int) -> int:
    return math.ceil(containment * size - 1e-9)


def prepared(notices: list[tuple[str, str]], containment: float) -> list[Notice]:
    sets = [frozenset(text.split()) for text, _ in notices]
    need = [max(1, _share(containment, len(own))) for own in sets]
    labels = [label for _, label in notices]
    others = range(len(notices))
    covered = [[b for b in others if labels[b] != labels[a] and len(sets[a] & sets[b]) >= need[a]] for a in others]
    family = list(others)
    for a in others:
        for b in covered[a]:
            old, new = family[a], family[b]
            family = [new if f == old else f for f in family]
    longest = [max(len(notices[b][0].split()) for b in others if family[b] == family[a]) for a in others]
    telling = [sets[a] - frozenset().union(*(sets[b] for b in others if labels[b] != labels[a])) for a in others]
    stride = [max(LEAST_STRIDE, 1 << (n - 1).bit_length()) for n in longest]
    return [Notice(a, labels[a], sets[a], need[a], telling[a], min(len(telling[a]), max(1, math.floor(containment * len(telling[a]) + 1e-9))), stride[a], covered[a]) for a in others]


def scanned(rows: DataFrame, tokens: list[str]) -> DataFrame:
    """rows (doc_id, text, key) without texts: doc_id, key, n_words, places of phrases, and hits: place and token of the notices' tokens."""
    found = words(lowered(F.col("text")))
    ends = sorted({p.split()[-1] for p, _ in PHRASES})
    hits = F.filter(F.transform("w", lambda x, k: F.struct(k.alias("pos"), x.alias("token"))), lambda h: h["token"].isin(tokens))
    some = F.arrays_overlap("w", F.array(*map(F.lit, ends)))
    return common.store(
        rows.select("doc_id", "key", found.alias("w")).select(
            "doc_id",
            "key",
            F.size("w").cast("long").alias("n_words"),
            F.when(some, phrase_places(F.col("w"))).otherwise(F.array()).alias("places"),
            hits.alias("hits"),
        ),
        "license-hits",
    )


def vocabulary(hits: DataFrame, tokens: list[str]) -> dict[str, int]:
    """The notices' tokens, each with its rank by frequency in all texts, rarest first. As many rows as the notices have tokens."""
    counted = hits.select(F.explode("hits.token").alias("w")).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in counted.collect()}
    return {w: k for k, w in enumerate(sorted(tokens, key=lambda w: (counts.get(w, 0), w)))}


def notice_matches(hits: DataFrame, notices: list[Notice], rank: dict[str, int]) -> DataFrame:
    """key, label and best containment of each label whose notice a block of the text meets. hits: key, hits."""
    spark = hits.sparkSession
    index, sets = [], []
    for x in notices:
        own = sorted(rank[w] for w in x.tokens)
        sets.append((x.n, x.label, x.stride, own, len(own), x.need, sorted(rank[w] for w in x.telling), x.need_telling, x.covered_by))
        index += [(x.stride, r, x.n, p) for p, r in enumerate(own[: len(own) - x.need + 1])]
    by_rank = sorted(rank, key=rank.get)
    leads = [by_rank[r] for r in sorted({r for _, r, _, _ in index})]
    least = min(x.need for x in notices)
    ranks = spark.createDataFrame(list(rank.items()), "token string, r int")
    strides = F.array(*[F.lit(k) for k in sorted({x.stride for x in notices})])
    tokens = (
        hits.where(F.arrays_overlap("hits.token", F.array(*map(F.lit, leads))) & (F.size(F.array_distinct("hits.token")) >= least))
        .select("key", F.explode("hits").alias("h"))
        .select("key", F.col("h.pos").alias("pos"), F.col("h.token").alias("token"))
        .join(F.broadcast(ranks), "token")
        .select("key", "r", "pos", F.explode(strides).alias("stride"))
        .select("key", "r", "stride", F.expr("cast(pos div stride as int)").alias("part"))
    )
    blocks = (
        tokens.select("key", "r", "stride", F.explode(F.array("part", F.col("part") - 1)).alias("block"))
        .where("block >= 0")
        .groupBy("key", "stride", "block")
        .agg(F.array_sort(F.collect_set("r")).alias("own"))
        .where(F.size("own") >= least)
    )
    index_df = spark.createDataFrame(index, "stride int, r int, notice int, p int")
    kinds = "notice int, label string, stride int, tokens array<int>, m int, need int, telling array<int>, need_telling int, over array<int>"
    sets_df = spark.createDataFrame(sets, kinds).drop("stride")
    met = (
        blocks.select("key", "stride", "block", "own", F.posexplode("own").alias("q", "r"))
        .join(F.broadcast(index_df), ["stride", "r"])
        .join(F.broadcast(sets_df), "notice")
        .where(F.size("own") >= F.col("need"))
        .where(F.least(F.col("m") - F.col("p"), F.size("own") - F.col("q")) >= F.col("need"))
        .withColumn("common", F.size(F.array_intersect("own", "tokens")))
        .where((F.col("common") >= F.col("need")) & (F.size(F.array_intersect("own", "telling")) >= F.col("need_telling")))
        .select("key", "stride", "block", "notice", "label", "over", "common", (F.col("common") / F.col("m")).alias("share"))
        .distinct()
    )
    # As many rows a block as there are notices at most.
    held = F.collect_list(F.struct("notice", "share", "common")).over(Window.partitionBy("key", "stride", "block"))

    def better(x: Column) -> Column:
        return F.array_contains("over", x["notice"]) & (F.struct(x["share"], x["common"]) > F.struct("share", "common"))

    kept = met.withColumn("held", held).where(~F.exists("held", better))
    return kept.groupBy("key", "label").agg(F.max("share").alias("containment"))


def license_scan(
    docs: DataFrame,
    notices: list[tuple[str, str]] = NOTICES,
    containment: float = CONTAINMENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (best containment; 1 with a phrase).

    notices: text (lower-case words of letters and digits, parted by spaces) and label of each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.xxhash64(text).alias("text"))
    known = prepared(notices, containment)
    tokens = sorted(frozenset().union(*(x.tokens for x in known)))
    rows = scanned(docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), key.alias("key")), tokens)
    matches = (
        notice_matches(rows.select("key", "hits"), known, vocabulary(rows, tokens))
        .groupBy("key")
        .agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    )
    joined = rows.drop("hits").join(matches, "key", "left")
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    return joined.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>"))))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(common.documents(spark, sf_dir))


def _oracle() -> str:
    """DuckDB SQL that holds every block against every notice."""
    gap = GAP
    cases = []
    for phrase, label in PHRASES:
        names = ["word", "w1", "w2", "w3"]
        same = " AND ".join(f"{n} = '{w}'" for n, w in zip(names, phrase.split()))
        cases.append(f"WHEN {same} THEN '{label}'")
    known = prepared(NOTICES, CONTAINMENT)
    rows = [
        f"({x.n}, '{x.label}', {x.stride}, {sorted(x.tokens)!r}, {len(x.tokens)}, {x.need}, {sorted(x.telling)!r}::VARCHAR[], {x.need_telling}, {x.covered_by}::INT[])"
        for x in known
    ]
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '{gap}'), lambda x: x <> '') AS w
  FROM documents
), t AS (
  SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d
), l AS (
  SELECT r, pos, CASE {' '.join(cases)} END AS label
  FROM (SELECT *, lead(word, 1) OVER p AS w1, lead(word, 2) OVER p AS w2, lead(word, 3) OVER p AS w3 FROM t WINDOW p AS (PARTITION BY r ORDER BY pos))
), base AS (
  SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS own FROM l WHERE label IS NOT NULL GROUP BY r
), notices(n, label, stride, tokens, m, need, telling, need_telling, over_by) AS (VALUES {', '.join(rows)}),
n AS (SELECT *, list_contains(telling, word) AS tells FROM (SELECT n, label, stride, m, need, telling, need_telling, over_by, unnest(tokens) AS word FROM notices)),
blocks AS (
  SELECT DISTINCT r, word, stride, block FROM (
    SELECT r, word, stride, pos // stride + unnest([0, -1]) AS block FROM t, (SELECT DISTINCT stride FROM notices) WHERE word IN (SELECT word FROM n)
  ) WHERE block >= 0
), met AS (
  SELECT r, stride, block, n, label, over_by, count(*) AS common, count(*) / m AS share FROM blocks JOIN n USING (word, stride)
  GROUP BY r, stride, block, n, label, over_by, m, need, need_telling HAVING count(*) >= need AND count(*) FILTER (tells) >= need_telling
), kept AS (
  SELECT * FROM met WHERE NOT EXISTS (
    SELECT 1 FROM met x WHERE x.r = met.r AND x.stride = met.stride AND x.block = met.block AND list_contains(met.over_by, x.n)
      AND (x.share > met.share OR x.share = met.share AND x.common > met.common)
  )
), more AS (
  SELECT r, list(DISTINCT label) AS labels, max(share) AS best FROM kept GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(array_to_string(own, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""


ORACLE_SQL = _oracle()
