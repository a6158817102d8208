"""License scans: an exact set-similarity join of text blocks with templates, in DataFrame operations only.

Blocks of 2 * step words begin at every step-th word, so that any passage of up to `step` words lies in one. A template's
step is the least power of two that is at least STEP and its number of words, so texts of any length are templates. A
template is found in a block of its step if the block holds at least `threshold` of the template's distinct words. Words
are ordered by the number of documents that hold them, rarest first, over the whole corpus. A block can only reach the
threshold if it shares one of the template's first |T| - need + 1 words (prefix filter), has `need` words that occur in
templates at all (length filter), and has enough words left behind the shared one (position filter). What passes is
counted exactly.

Each text is normalised and split once. What later steps need of it is written: the phrases' places, the template words
that it holds, and its words if it holds enough of those for any template.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

# The phrases of the plain scan and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices and texts of public licences, in lower-case words, and their labels.
TEMPLATES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.8
#: The least step between blocks.
STEP = 32
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spaced(text: str) -> Column:
    """The words of a text between single spaces.

    lower() also lowers letters beyond ASCII; of those only the Kelvin sign would become an ASCII word, so it goes.
    """
    plain = F.replace(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\uffff"))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(plain), _NOT_WORD, " ")), F.lit(" "))


def step_of(template: str) -> int:
    """The step of the blocks in which a template is looked for."""
    return max(STEP, 1 << (len(template.split()) - 1).bit_length())


def _needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def _phrase_places(words: Column) -> Column:
    """Where the phrases' words stand, as (place, label)."""
    def stands(p: list[str]):
        def here(i: Column) -> Column:
            return reduce(and_, [F.coalesce(F.get(words, i + j) == w, F.lit(False)) for j, w in enumerate(p)])

        return here

    def labelled(label: str):
        return lambda i: F.struct(i.cast("long").alias("place"), F.lit(label).alias("label"))

    places = F.sequence(F.lit(0), F.size(words) - 1)
    found = [F.transform(F.filter(places, stands(p.split())), labelled(x)) for p, x in PHRASES.items()]
    return F.flatten(F.array(*found))


def token_order(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """The templates' words by the number of texts (held) that hold them, rarest first, then by name."""
    counts = {r["token"]: r["count"] for r in texts.select(F.explode("held").alias("token")).groupBy("token").count().collect()}  # one row a word of the templates at most
    return {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (counts.get(t, 0), t)))}


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, templates) of each row of docs.

    Words are runs of ASCII digits, ASCII letters with A-Z lower-cased, and all characters beyond ASCII. n_base,
    first_word, last_word (counted from 0; null if there is none) and base_labels are of the plain phrases; labels
    adds those of the templates found; both are distinct, sorted and joined by commas. templates lists the numbers
    of those found. score is the largest share of a template's words in a block among those found, 1 if a phrase
    stands in the text, else 0.

    A null or empty text has no words. Null keys and rows that repeat pass through. Other columns are not read.
    A template without words is never found.
    """
    chosen = TEMPLATES if templates is None else templates
    sets = [sorted({w for w in t.split()}) for _, t in chosen]
    vocabulary = sorted({w for s in sets for w in s})
    needs = [_needed(len(s), threshold) for s in sets]
    spark = docs.sparkSession
    # A generator's output is computed once, where an alias would be put into each of its many uses.
    spaced = docs.select(F.col(f"`{key}`").alias("row_key"), F.explode(F.array(_spaced(text))).alias("spaced"))
    own = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    split = spaced.select("row_key", "spaced", F.explode(F.array(F.struct(F.split(F.trim("spaced"), " ").alias("words")))).alias("w"))
    held = split.select("row_key", "spaced", "w.words", F.explode(F.array(F.struct(F.array_intersect("w.words", own).alias("held")))).alias("h"))
    has_phrase = F.lit(False)
    for phrase in PHRASES:
        has_phrase = has_phrase | F.contains("spaced", F.lit(f" {phrase} "))
    n_words = F.when(F.trim("spaced") == "", 0).otherwise(F.size("words"))
    texts = materialise(
        held.select(
            "row_key",
            F.xxhash64("spaced").alias("row_hash"),
            n_words.cast("long").alias("n_words"),
            F.when(has_phrase, _phrase_places(F.col("words"))).alias("places"),
            F.col("h.held").alias("held"),
            F.when(F.size("h.held") >= min(needs, default=1), F.col("spaced")).alias("spaced"),
        ),
        "marks",
        "zstd",
    )
    order = token_order(texts, vocabulary) if vocabulary else {}
    ordered = [sorted(order[w] for w in s) for s in sets]
    names = sorted(order, key=order.get)
    prefix = []
    for i, (s, need) in enumerate(zip(ordered, needs, strict=True)):
        prefix += [(token, step_of(chosen[i][1]), i, len(s), place, need) for place, token in enumerate(s[: len(s) - need + 1])]
    first_words = F.array(*[F.lit(names[t]) for t in sorted({p[0] for p in prefix})]) if prefix else F.array().cast("array<string>")
    ranks = F.broadcast(spark.createDataFrame(list(order.items()), "token string, rank int"))  # words of the templates
    index = F.broadcast(spark.createDataFrame(prefix, "token int, step int, template int, size int, place int, need int"))
    bodies = F.broadcast(spark.createDataFrame(list(enumerate(ordered)), "template int, body array<int>"))
    may_hold = texts.where(F.col("spaced").isNotNull() & F.arrays_overlap("held", first_words))
    hits = may_hold.select("row_key", "row_hash", F.posexplode(F.split(F.trim("spaced"), " ")).alias("at", "token")).join(ranks, "token")
    spots = []
    for step in sorted({p[1] for p in prefix}):
        first = F.floor(F.col("at") / step).cast("int")
        spots += [F.struct(F.lit(step).alias("step"), spot.alias("block")) for spot in (first, first - 1)]
    spots = F.array(*spots) if spots else F.expr("array()").cast("array<struct<step:int,block:int>>")
    blocks = (
        hits.select("row_key", "row_hash", F.explode(spots).alias("b"), "rank")
        .where("b.block >= 0")
        .groupBy("row_key", "row_hash", "b")
        .agg(F.sort_array(F.collect_set("rank")).alias("held"))  # as many as a block has words at most
    )
    size = F.size("held")
    candidates = (
        blocks.select("row_key", "row_hash", "b.step", "b.block", "held", F.posexplode("held").alias("behind", "token"))
        .join(index, ["token", "step"])
        .where((size >= F.col("need")) & (1 + F.least(F.col("size") - F.col("place"), size - F.col("behind")) - 1 >= F.col("need")))
        .select("row_key", "row_hash", "step", "block", "held", "template", "size", "need")
        .distinct()
    )
    labels = F.element_at(F.array(*(F.lit(x) for x, _ in chosen)), F.col("template") + 1) if chosen else F.lit("")
    share = F.size(F.array_intersect("held", "body"))
    found = (
        candidates.join(bodies, "template")
        .where(share >= F.col("need"))
        .groupBy("row_key", "row_hash")
        .agg(F.sort_array(F.collect_set("template")).alias("templates"), F.collect_set(labels).alias("more"), F.max(share / F.col("size")).alias("share"))
    )
    m, f = texts.drop("held", "spaced").alias("m"), found.alias("f")
    both = m.join(f, F.col("m.row_key").eqNullSafe(F.col("f.row_key")) & (F.col("m.row_hash") == F.col("f.row_hash")), "left")
    places = F.coalesce("places", F.expr("array()").cast("array<struct<place:bigint,label:string>>"))
    at = F.transform(places, lambda x: x["place"])
    base = F.array_distinct(F.transform(places, lambda x: x["label"]))
    every = F.array_union(base, F.coalesce("more", F.expr("array()").cast("array<string>")))
    listed = lambda x: F.array_join(F.sort_array(x), ",")
    return both.select(
        F.col("m.row_key").alias(key),
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(every).alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        F.array_join(F.coalesce("templates", F.expr("array()").cast("array<int>")), ",").alias("templates"),
    )


def oracle_sql(table: str = "documents") -> str:
    """The same over the whole table in DuckDB: every block against every template."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    phrases = ", ".join(f"({quote(p)}, {len(p.split())}, {quote(x)})" for p, x in PHRASES.items())
    templates = ", ".join(f"({i}, {quote(x)}, {quote(' '.join(sorted(set(t.split()))))}, {step_of(t)})" for i, (x, t) in enumerate(TEMPLATES))
    steps = ", ".join(f"({n})" for n in sorted({step_of(t) for _, t in TEMPLATES}))
    return f"""
with w as (
  select doc_id, row_number() over () as r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words
  from {table}),
phrase(p, n, label) as (values {phrases}),
place as (
  select r, i.spot as spot, label from w, phrase,
    lateral (select unnest(range(0, len(words))) as spot) i
  where array_to_string(words[i.spot + 1 : i.spot + n], ' ') = p),
base as (select r, count(*) as n_base, min(spot) as first_word, max(spot) as last_word, list(distinct label) as own from place group by r),
template(t, label, body, step) as (values {templates}),
width(step) as (values {steps}),
block as (
  select r, step, list_distinct(words[b * step + 1 : b * step + 2 * step]) as held
  from w, width, lateral (select unnest(range(0, (len(words) + step - 1) // step)) as b) x),
hit as (
  select r, t, label, len(list_intersect(held, string_split(body, ' '))) / len(string_split(body, ' ')) as share
  from block join template using (step)),
more as (select r, list(distinct label) as more, list(distinct t) as ts, max(share) as share from hit where share >= {THRESHOLD} - 1e-9 group by r)
select doc_id, len(words) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(own, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ',') as labels,
  case when n_base > 0 then 1.0::double else coalesce(share, 0.0)::double end as score,
  coalesce(array_to_string(list_sort(ts), ','), '') as templates
from w left join base using (r) left join more using (r)"""
