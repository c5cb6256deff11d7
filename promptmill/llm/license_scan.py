"""License phrases and an exact set-similarity join of runs of words with license templates.

Only DataFrame functions. A template is looked for in runs of EXTENT times its own words, which go on
over line ends; texts are cut into overlapping blocks so that every such run lies in one. Template words are ordered
by how many documents have them, rarest first. A block is compared with a template only if one of its words is in the
template's prefix, and only while sizes and places in that order still allow the wanted containment;
what is left is verified on the full sets of the runs.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmill.llm.common import ALNUM_WORD, alnum_words, as_doc_id, doc_key
from promptmill.sources.storage import materialize

# Share of a template's distinct words that a run of words must have, and its length in lengths of the template.
THRESHOLD = 0.9
EXTENT = 2

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License notices as they are commonly worded, by the label they give.
TEMPLATES = [
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2.0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "released under the bsd license"),
    ("cc-by", "licensed under a creative commons attribution license"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("cc0", "this work is dedicated to the public domain"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-notice", "this work is licensed under the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("reserved-notice", "copyright all rights reserved"),
]


def template_words(templates: list[tuple[str, str]]) -> list[tuple[int, str, list[str]]]:
    """(number, label, distinct words) of each template."""
    java_free = ALNUM_WORD.encode().decode("unicode_escape")
    return [(k, label, sorted(set(re.findall(java_free, text.lower())))) for k, (label, text) in enumerate(templates)]


def _ordered_templates(spark: SparkSession, ranked: list[str], words: list[tuple[int, str, list[str]]], extents: list[int], threshold: float) -> DataFrame:
    """A row for each template: words in the global order, their number, how many are needed, the prefix, and the length of a run."""
    rows = []
    for (k, label, own), extent in zip(words, extents):
        order = sorted(own, key=ranked.index)
        need = math.ceil(threshold * len(order) - 1e-9)
        rows.append((k, label, order, len(order), need, order[: len(order) - need + 1], extent))
    return spark.createDataFrame(rows, "template int, label string, words array<string>, size int, need int, prefix array<string>, extent int")


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _phrase_places() -> str:
    """SQL for the places of all base phrases in the word array `w`, as (start, label); one scan by first word."""
    heads = sorted({p.split()[0] for p in PHRASES})
    tests = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        same = " and ".join(f"get(w, i + {k}) = '{p}'" for k, p in enumerate(parts))
        tests.append(f"when {same} then '{label}'")
    places = f"filter(sequence(0, size(w) - 1), i -> w[i] in ({_in(heads)}))"
    labelled = f"transform({places}, i -> struct(i as start, case {' '.join(tests)} end as label))"
    return f"if(size(w) > 0, filter({labelled}, x -> x.label is not null), cast(array() as array<struct<start: int, label: string>>))"


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """License phrases, template matches and labels of each document; reads `doc_id, text`.

    Returns one row per input row: `doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, matches`. matches has the containment of each template found, by its best run of words; line ends do not matter. score is 1
    with a base phrase, else the best containment, else 0. Null and empty texts have no words,
    empty labels and score 0. Rows that repeat doc_id and text get the same result, one row each; a null
    doc_id is a document like any other. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    words = template_words(templates)
    vocabulary = sorted({w for _, _, own in words for w in own})
    worded = docs.select(
        doc_key().alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_key"), alnum_words(F.col("text")).alias("w")
    )
    scanned = materialize(
        worded.select(
            "doc", "row_key", F.size("w").cast("long").alias("n_words"),
            F.expr(_phrase_places()).alias("places"),
            F.array_distinct(F.expr(f"filter(w, x -> x in ({_in(vocabulary)}))")).alias("known"),
        ),
        "license-words",
    )
    counted = scanned.select(F.explode("known").alias("word")).groupBy("word").count().collect()  # template words only
    frequency = {r["word"]: r["count"] for r in counted}
    ranked = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    java_free = ALNUM_WORD.encode().decode("unicode_escape")
    extents = [EXTENT * len(re.findall(java_free, text.lower())) for _, text in templates]
    matches = _template_matches(docs, _ordered_templates(spark, ranked, words, extents, threshold), ranked, max(extents))

    best = matches.groupBy("doc", "row_key").agg(
        F.array_sort(F.collect_set(F.struct("label", "containment"))).alias("matches"),
        F.max("containment").alias("best"), F.collect_set("label").alias("found"),
    )
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    joined = scanned.join(best, ["doc", "row_key"], "left")
    every = F.array_sort(F.array_distinct(F.concat(base, F.coalesce("found", F.expr("cast(array() as array<string>)")))))
    return joined.select(
        as_doc_id(F.col("doc")).alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").cast("long").alias("first_word"), F.array_max("places.start").cast("long").alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"), F.concat_ws(",", every).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        "matches",
    )


def _template_matches(docs: DataFrame, ordered: DataFrame, ranked: list[str], step: int) -> DataFrame:
    """`doc, row_key, label, containment` of every template that a run of words of a document contains; no run is longer than `step`."""
    prefix_words = sorted({w for row in ordered.select("prefix").collect() for w in row["prefix"]})  # of the templates
    texts = docs.select(doc_key().alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    # Texts without any prefix word are left before their words are cut out.
    possible = texts.where(F.expr(f"lower(text) rlike '{'|'.join(prefix_words)}'")).select("doc", "row_key", alnum_words(F.col("text")).alias("w"))
    # Block k holds all runs that begin at words k * step to (k + 1) * step - 1. Blocks without a prefix word are left out.
    hits = f"filter(sequence(0, size(w) - 1), i -> w[i] in ({_in(prefix_words)}))"
    numbers = f"array_distinct(flatten(transform({hits}, i -> array(i div {step}, greatest(i div {step} - 1, 0)))))"
    cut = f"if(size(w) > 0, transform({numbers}, k -> slice(w, cast(k * {step} + 1 as int), {2 * step - 1})), cast(array() as array<array<string>>))"
    runs = possible.select("doc", "row_key", F.explode(F.expr(cut)).alias("body"))
    blocks = runs.select("doc", "row_key", "body", F.array_intersect(F.array(*map(F.lit, ranked)), F.col("body")).alias("block"))
    prefixes = F.broadcast(ordered.select("template", F.explode("prefix").alias("word")))
    hit = blocks.select("doc", "row_key", "body", "block", F.explode("block").alias("word")).join(prefixes, "word")
    # Of several prefix words of a template in a block, the first one in the order stands for it.
    pairs = hit.join(F.broadcast(ordered), "template").where("word = element_at(array_intersect(prefix, block), 1)")
    # The first common word, at places p and q of both orders, leaves room for
    # 1 + min(size - p, length - q) common words.
    common = F.array_intersect("words", "block")
    first = F.element_at(common, 1)
    room = 1 + F.least(F.col("size") - F.array_position("words", first), F.size("block") - F.array_position("block", first))
    # The best run begins at a word of the template.
    begins = f"filter(sequence(0, least(size(body), {step}) - 1), i -> array_contains(words, body[i]))"
    best = f"array_max(transform({begins}, i -> size(array_intersect(words, slice(body, i + 1, extent)))))"
    return (
        pairs.where((F.size("block") >= F.col("need")) & (room >= F.col("need")))
        .where(F.size(common) >= F.col("need"))
        .withColumn("shared", F.expr(best))
        .where("shared >= need")
        .groupBy("doc", "row_key", "template", "label", "size").agg(F.max("shared").alias("shared"))
        .select("doc", "row_key", "label", (F.col("shared") / F.col("size")).alias("containment"))
    )
