"""License scans by diagonal voting, in DataFrame operations only.

Every pair of neighbouring words of every text is joined to the places of that pair in the license templates, which are
a fixed short list. A match of text place i and template place j votes for the diagonal i - j. A phrase stands where a
diagonal has all its template's votes. For the longer templates, the votes of a diagonal and of those up to ``SPREAD``
above it are merged, so that a few words put in or left out do not hide a license; a merged span is at most that much
longer than its template. It is verified by aligning the two: the longest chain of its votes in which both text place
and template place rise, as a share of the template's pairs, is its score. Votes spread over a longer stretch, or out of
order, make no license.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import word_count

# The phrases that the base labels ask for.
PHRASES = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}

# Sentences of well-known public licenses and notices, in small letters.
TEMPLATES = {
    "apache": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "gpl-notice": ["this work is licensed under the gnu general public license version 3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPREAD = 6  # words by which the diagonals of one span may differ: words put in less words left out


def _template_rows() -> list[tuple]:
    rows, number = [], 0
    for exact, group in ((True, {k: [v] for k, v in PHRASES.items()}), (False, TEMPLATES)):
        for label, texts in group.items():
            for text in texts:
                w = text.split(" ")
                rows += [(label, number, exact, len(w) - 1, at, *w[at : at + 2]) for at in range(len(w) - 1)]
                number += 1
    return rows


def _templates(spark: SparkSession) -> DataFrame:
    """label, number, exact (a phrase), pairs (in the template), at, gram and the two words: some hundred rows."""
    names = ("label", "number", "exact", "pairs", "at", "t0", "t1")
    structs = [F.struct(*(F.lit(v).alias(n) for v, n in zip(row, names, strict=True))) for row in _template_rows()]
    return spark.range(1).select(F.inline(F.array(*structs))).withColumn("gram", F.xxhash64("t0", "t1"))


_CHAIN = """bit_count(aggregate(merged, 0L, (s, v) -> if((s & shiftleft(1L, v.at)) <> 0, s,
    (s ^ ((s & -shiftleft(2L, v.at)) & -(s & -shiftleft(2L, v.at)))) | shiftleft(1L, v.at))))"""


def scan(docs: DataFrame, least_share: float = 0.8, piece: int = 1 << 16) -> DataFrame:
    """Licenses in every row of ``docs`` (doc_id, text; other columns are not read).

    Returns doc_id, n_words, n_base (places of phrases), first_word, last_word (the smallest and the largest start of a
    phrase, else null), base_labels, labels (with those of templates of which at least ``least_share`` is verified; both
    distinct, sorted, joined by commas, empty if there are none), score (the largest share of a template or phrase
    verified, 0 to 1). A null text is empty. Rows are numbered, so that repeated rows and null or shared doc_ids keep a
    row each. A long text is taken in pieces of about ``piece`` characters, which end with a word, so that no row holds
    all its words. An empty table gives an empty table.
    """
    small = F.translate(F.coalesce("text", F.lit("")), CAPITALS, SMALL)
    # every piece begins with a word, but for what separates it from the one before
    pieces = F.regexp_extract_all(small, F.lit(f"(?s){SEPARATOR}*+.{{1,{piece}}}{WORD}*+"), F.lit(0))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), pieces.alias("pieces"))
    counts = F.when(F.size("pieces") > 1, F.transform("pieces", lambda p: word_count(p, WORD))).otherwise(F.array(F.lit(0)))
    befores = F.aggregate("counts", F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))  # words before each piece, and all
    following = lambda k: F.coalesce(F.regexp_extract(F.get("pieces", k + 1), f"^{SEPARATOR}*+({WORD}++)", 1), F.lit(""))
    cut = base.withColumn("counts", counts).withColumn("befores", befores)
    whole = F.transform("pieces", lambda p, k: F.struct(k.alias("k"), F.get("befores", k).alias("before"), F.concat(p, F.lit(" "), following(k)).alias("said")))
    none = F.array(F.struct(F.lit(0).alias("k"), F.lit(0).alias("before"), F.lit("").alias("said")))
    parts = cut.select("doc_id", "row", F.when(F.size("pieces") > 1, F.element_at("befores", -1)).alias("n_words"), F.explode(F.when(F.size("pieces") > 0, whole).otherwise(none)).alias("part"))
    words = F.filter(F.split("part.said", f"{SEPARATOR}+"), lambda w: w != "")
    # a piece's words and, one further, its words again: pairs; before the first word of a text stands an entry for the document itself
    marked = parts.select("doc_id", "row", "n_words", "part.k", "part.before", words.alias("w")).select("doc_id", "row", F.coalesce("n_words", F.size("w")).alias("n_words"), "k", "before", F.concat(F.array(F.lit("")), "w").alias("w"))
    pairs = marked.select("doc_id", "row", "n_words", "k", "before", F.posexplode(F.arrays_zip(F.col("w").alias("w0"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(1))).alias("w1"))).alias("i", "p"))
    placed = pairs.where((F.col("i") > 0) | (F.col("k") == 0)).select("doc_id", "row", "n_words", F.when(F.col("i") > 0, F.col("i") - 1 + F.col("before")).otherwise(-1).alias("i"), F.col("p.w0").alias("w0"), F.col("p.w1").alias("w1"))
    grams = placed.withColumn("gram", F.when(F.col("i") < 0, F.lit(0)).otherwise(F.xxhash64("w0", "w1")))
    template = _templates(docs.sparkSession)
    own = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("label"), F.lit(-1).alias("number"), F.lit(True).alias("exact"), F.lit(0).alias("pairs"), F.lit(0).alias("at"), F.lit("").alias("t0"), F.lit("").alias("t1"), F.lit(0).cast("long").alias("gram"))
    votes = grams.join(F.broadcast(template.union(own)), "gram").where((F.col("i") < 0) == (F.col("number") < 0)).where((F.col("i") < 0) | ((F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1"))))
    key = ["row", "doc_id"]
    diagonals = votes.groupBy(*key, "number", (F.col("i") - F.col("at")).alias("diagonal")).agg(
        F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("pairs").alias("pairs"), F.max("n_words").alias("n_words"), F.collect_list(F.struct("i", (-F.col("at")).alias("back"), "at")).alias("votes"))
    # an exact phrase needs its own diagonal; a template's diagonal takes the votes of those near above it
    near = Window.partitionBy(*key, "number").orderBy("diagonal").rangeBetween(0, SPREAD)
    merged = F.when(F.col("exact"), F.col("votes")).otherwise(F.array_sort(F.flatten(F.collect_list("votes").over(near))))
    # The longest chain of votes in which i and at rise. Bit b of the state is set if, of the chains of some length, the one
    # with the smallest last place ends at place b; a vote's place takes that of the next bit above or makes a longer chain.
    spans = diagonals.withColumn("merged", merged).withColumn("aligned", F.when(F.col("exact"), F.size("votes")).otherwise(F.expr(_CHAIN)))
    share = F.col("aligned") / F.when(F.col("pairs") > 0, F.col("pairs"))
    place = F.col("exact") & (F.col("aligned") == F.col("pairs")) & (F.col("number") >= 0)
    held = place | (~F.col("exact") & (share >= least_share))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans.groupBy(*key).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("diagonal"))).cast("long").alias("last_word"),
        joined(F.when(place, F.col("label"))).alias("base_labels"),
        joined(F.when(held, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(place | ~F.col("exact"), share)), F.lit(0.0)).alias("score"),
    ).drop("row")


def oracle(least_share: float = 0.8) -> str:
    """The same scan in DuckDB's SQL."""
    values = ", ".join(f"('{label}', {number}, {str(exact).lower()}, {pairs}, {at}, '{t0}', '{t1}')" for label, number, exact, pairs, at, t0, t1 in _template_rows())
    above = "(s & -(2::BIGINT << b::INTEGER))"
    return rf"""WITH t(label, number, exact, pairs, tpos, t0, t1) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT row, unnest(range(len(ws) - 1)) AS i, unnest(ws[1:len(ws) - 1]) AS w0, unnest(ws[2:]) AS w1 FROM d WHERE len(ws) > 1),
g AS (SELECT row, number, label, exact, pairs, i - tpos AS diagonal, list({{'i': i, 'back': -tpos}}) AS votes FROM w JOIN t ON w0 = t0 AND w1 = t1 GROUP BY ALL),
m AS (SELECT *, CASE WHEN exact THEN votes ELSE list_sort(flatten(list(votes) OVER (PARTITION BY row, number ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {SPREAD} FOLLOWING))) END AS merged FROM g),
p AS (SELECT row, label, exact, pairs, diagonal, CASE WHEN exact THEN len(merged) ELSE bit_count(list_reduce(list_prepend(0::BIGINT, list_transform(merged, lambda v: (-v.back)::BIGINT)),
lambda s, b: CASE WHEN s & (1::BIGINT << b::INTEGER) <> 0 THEN s ELSE xor(s, {above} & -{above}) | (1::BIGINT << b::INTEGER) END)) END AS aligned FROM m),
h AS (SELECT *, exact AND aligned = pairs AS place, NOT exact AND aligned / pairs >= {least_share} AS near FROM p),
r AS (SELECT row, count(*) FILTER (place) AS n_base, min(diagonal) FILTER (place) AS first_word, max(diagonal) FILTER (place) AS last_word, array_to_string(list_sort(list_distinct(list(label) FILTER (place))), ',') AS base_labels,
array_to_string(list_sort(list_distinct(list(label) FILTER (place OR near))), ',') AS labels, max(aligned / pairs) FILTER (place OR NOT exact) AS score FROM h GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN r USING (row)"""
