"""License scans by a positional index of rare words.

Templates are short passages of licences with a label and a key phrase. Of each template the index holds the half of its words with the highest inverse document frequency,
RARE at most, with their places in the template. A file's words that the index knows are its rarest licence words; each occurrence, looked up,
votes for the place in the file where the template would begin (its own place less the posting's). Votes that fall into a window of 2 * SLACK words are one candidate, so
a word inserted or left out between them does no harm. A candidate is a match if it has LEAST of the template's postings and if the template's key phrase, word for
word, votes for the same window. The score is the share of postings found, the best one of the file's matches. Files without any key phrase cannot match, so their words
are not looked up.

Phrases of the base are templates too, whose key phrase is all of them; each of their places in a text counts, whatever the index says.

All expressions are built-in functions. Document frequencies cover all documents; what is collected is one number per word of the templates. Texts are read whole,
and only their hits (word and place) go on. A null text counts as empty and has no words, no places and score 0; repeated rows and ids are scanned row by row; tables
without rows give none. Ties in frequency go by the word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, query, table

RARE = 6
SLACK = 4
LEAST = 0.6
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (label, phrase).
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Fixed values: (label, passage, key phrase in it), as the licences and their usual notices have them, in lower case without punctuation.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "www apache org licenses"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "binary forms"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "without fee"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
]


def words(text: Column) -> Column:
    """The words of a whole text in order, A to Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def frequencies(found: DataFrame, wanted: set[str]) -> dict[str, int]:
    """Documents that have each of the wanted words; `found` has the words as `words`."""
    own = F.array_distinct(F.filter("words", lambda w: w.isin(sorted(wanted))))
    return {r.word: r.n for r in found.select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}


def postings(templates: list[tuple[str, str, str]], seen: dict[str, int], rare: int = RARE) -> list[tuple[str, int, int]]:
    """(word, template, place) of each template's rarest words in the corpus."""
    out = []
    for t, (_, passage, _) in enumerate(templates):
        w = passage.split()
        best = sorted(set(w), key=lambda x: (seen.get(x, 0), x))[:min(rare, (len(set(w)) + 1) // 2)]
        out += [(x, t, i) for i, x in enumerate(w) if x in best]
    return out


def hits(found: DataFrame, wanted: set[str]) -> Column:
    """Occurrences of the wanted words, in order."""
    return F.filter(F.transform("words", lambda w, i: F.when(w.isin(sorted(wanted)), F.struct(i.alias("place"), w.alias("word")))), lambda h: h.isNotNull())


def places(phrase: str) -> Column:
    """Where the words of a phrase stand one after another, from the column `hits`, which has all of them."""
    w = phrase.split()

    def start(h: Column, i: Column) -> Column:
        following = [(F.get("hits", i + k)["word"] == x) & (F.get("hits", i + k)["place"] == h["place"] + k) for k, x in enumerate(w) if k]
        return F.when(reduce(lambda a, b: a & b, following, h["word"] == w[0]), h["place"])
    return F.filter(F.transform("hits", start), lambda x: x.isNotNull())


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: list[tuple[str, str, str]] = TEMPLATES, base: list[tuple[str, str]] = BASE) -> DataFrame:
    """`keep`, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per document."""
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), words(F.col(f"`{text}`")).alias("words"))
    index = postings(templates, frequencies(found, {w for _, p, _ in templates for w in p.split()}))
    phrases = {w for _, p in base for w in p.split()} | {w for _, _, k in templates for w in k.split()}
    files = found.select(F.monotonically_increasing_id().alias("row"), "doc", F.size("words").cast("bigint").alias("n_words"), hits(found, phrases | {w for w, _, _ in index}).alias("hits"))


    def begins(t: int, passage: list[str], key: list[str]) -> Column:
        at = next(i for i in range(len(passage)) if passage[i:i + len(key)] == key)
        return F.transform(places(" ".join(key)), lambda p: F.struct(F.lit(t).alias("template"), (p - at).alias("begin")))
    keyed = F.concat(*[begins(t, passage.split(), key.split()) for t, (_, passage, key) in enumerate(templates)])
    files = cut(files.withColumn("keyed", F.when(F.size("hits") == 0, F.array().cast("array<struct<template:int,begin:int>>")).otherwise(keyed)))

    # votes of words and of key phrases for the place where a template begins
    total = [0] * len(templates)
    for _, t, _ in index:
        total[t] += 1
    entries = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(t).alias("template"), F.lit(at).alias("at")) for w, t, at in index])
    postings_df = docs.sparkSession.range(1).select(F.inline(entries))
    named = files.filter(F.size("keyed") > 0)
    votes = named.select("row", F.explode("hits").alias("hit")).select("row", "hit.*").join(postings_df, "word").select("row", "template", (F.col("place") - F.col("at")).alias("begin"), "at")
    keys = named.select("row", F.explode("keyed").alias("vote")).select("row", "vote.*", F.lit(None).cast("int").alias("at"))
    window = F.floor(F.col("begin") / SLACK)
    seen = votes.unionByName(keys).select("row", "template", "at", F.explode(F.array(window, window - 1)).alias("window"))
    sizes = F.element_at(F.array(*[F.lit(n) for n in total]), F.col("template") + 1)
    names = F.element_at(F.array(*[F.lit(label) for label, _, _ in templates]), F.col("template") + 1)
    # each posting once, so that repeats of a word in a window don't count twice
    single = seen.distinct().groupBy("row", "template", "window").agg(F.count("at").alias("n"), F.count_if(F.col("at").isNull()).alias("key")).filter("key > 0")
    matches = single.select("row", names.alias("label"), (F.col("n") / sizes).alias("share")).filter(F.col("share") >= LEAST).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))

    everywhere = F.concat(*[places(p) for _, p in base])
    labels = F.filter(F.array(*[F.when(F.size(places(p)) > 0, label) for label, p in base]), lambda x: x.isNotNull())
    own = files.select("row", "doc", "n_words", everywhere.alias("places"), labels.alias("base"))
    out = own.join(matches, "row", "left")
    text_of = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.select("doc.*", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min("places").cast("bigint").alias("first_word"), F.array_max("places").cast("bigint").alias("last_word"),
                      text_of(F.col("base")).alias("base_labels"), text_of(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
                      F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def scan_sql() -> str:
    values = ", ".join(f"({t}, '{a}', string_split('{b}', ' '), string_split('{c}', ' '))" for t, (a, b, c) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{a}', string_split('{b}', ' '))" for a, b in BASE)
    return f"""WITH t(template, label, words, key) AS (VALUES {values}), b(label, words) AS (VALUES {phrases}),
  d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
  x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM d),
  tw AS (SELECT template, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS seat FROM t),
  df AS (SELECT word, count(DISTINCT rid) AS n FROM x WHERE word IN (SELECT word FROM tw) GROUP BY word),
  best AS (SELECT template, word FROM (SELECT DISTINCT template, word FROM tw) LEFT JOIN df USING (word)
    QUALIFY row_number() OVER (PARTITION BY template ORDER BY coalesce(n, 0), word) <= least({RARE}, (count(*) OVER (PARTITION BY template) + 1) // 2)),
  post AS (SELECT template, word, seat FROM tw JOIN best USING (template, word)),
  sizes AS (SELECT template, count(*) AS n FROM post GROUP BY template),
  ph AS (SELECT 'b' || label AS name, words FROM b UNION ALL SELECT 't' || template, key FROM t),
  at_phrase AS (SELECT p.name, x.rid, x.place FROM x JOIN ph p ON x.word = p.words[1] JOIN d USING (rid) WHERE d.w[x.place + 1:x.place + len(p.words)] = p.words),
  votes AS (SELECT rid, template, place - seat AS begins, seat FROM x JOIN post USING (word) UNION ALL
    SELECT rid, template, place - (SELECT min(i) FROM range(0, len(t.words)) r(i) WHERE t.words[i + 1:i + len(t.key)] = t.key), NULL FROM at_phrase JOIN t ON name = 't' || template),
  win AS (SELECT DISTINCT rid, template, seat, CAST(floor(begins / {float(SLACK)}) AS BIGINT) - s AS w FROM votes, (VALUES (0), (1)) o(s)),
  cand AS (SELECT rid, template, count(seat) AS n FROM win GROUP BY rid, template, w HAVING count(*) > count(seat)),
  good AS (SELECT rid, label, CAST(c.n AS DOUBLE) / s.n AS share FROM cand c JOIN t USING (template) JOIN sizes s USING (template) WHERE CAST(c.n AS DOUBLE) / s.n >= {LEAST}),
  base AS (SELECT rid, substr(name, 2) AS label, place FROM at_phrase WHERE name LIKE 'b%'),
  bs AS (SELECT rid, count(*) AS n, min(place) AS f, max(place) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY rid),
  ls AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION SELECT rid, label FROM good) GROUP BY rid),
  sc AS (SELECT rid, max(share) AS share FROM good GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(bs.n, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word, coalesce(bs.labels, '') AS base_labels,
  coalesce(ls.labels, '') AS labels, CAST(CASE WHEN bs.n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN bs USING (rid) LEFT JOIN ls USING (rid) LEFT JOIN sc USING (rid)"""


@query("op13_license_index", scan_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
