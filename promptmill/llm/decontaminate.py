"""Benchmark decontamination by windows of benchmark words, with DataFrame functions only.

The hashes of all benchmark windows go to the tasks as one set, whose size is counted first. Each
document is read once: the windows of its words are looked up in the set, hits are verified on their
words, and hit words, items and the verdict follow per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.llm.common import alnum_words, as_doc_id, doc_key, free_names
from promptmill.sources.storage import materialize

WINDOW = 13

# Most windows that are sent to the tasks as a set; more are joined by their hash instead.
MOST_WINDOWS = 100_000

_HITS = "array<struct<start: int, words: array<string>>>"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`words, item_ids`: each window of `window` words, or the whole of a shorter item, once."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), alnum_words(F.col("text")).alias("w"))
    pieces = items.select(
        "item_id",
        F.explode(
            F.expr(
                f"if(size(w) > {window}, transform(sequence(1, size(w) - {window - 1}), i -> slice(w, i, {window})),"
                " filter(array(w), x -> size(x) > 0))"
            )
        ).alias("words"),
    )
    return pieces.groupBy("words").agg(F.collect_set("item_id").alias("item_ids"))


def _listed(values: list, text: bool) -> str:
    return ", ".join(f"'{v}'" if text else f"{v}L" for v in values)


def _hits_by_set(windows: DataFrame) -> str:
    """SQL for all windows of the word array `w` whose hash is one of the benchmark's, by window length."""
    rows = windows.select(
        F.size("words").alias("n"), F.expr("words[0]").alias("first"), F.expr("words[size(words) - 1]").alias("last"), F.xxhash64("words").alias("h")
    ).collect()  # no more than MOST_WINDOWS small rows
    found = []
    for n in sorted({r.n for r in rows}):
        own = [r for r in rows if r.n == n]
        firsts, lasts = sorted({r.first for r in own}), sorted({r.last for r in own})
        hashes = sorted({r.h for r in own})
        found.append(
            f"if(size(w) >= {n}, transform(filter(sequence(1, size(w) - {n - 1}), i -> w[i - 1] in ({_listed(firsts, True)})"
            f" and w[i + {n - 2}] in ({_listed(lasts, True)}) and xxhash64(slice(w, i, {n})) in ({_listed(hashes, False)})),"
            f" i -> struct(i as start, slice(w, i, {n}) as words)), cast(array() as {_HITS}))"
        )
    return f"concat({', '.join(found)})" if found else f"cast(array() as {_HITS})"


def _all_windows(lengths: list[int]) -> str:
    found = [
        f"if(size(w) >= {n}, transform(sequence(1, size(w) - {n - 1}), i -> struct(i as start, slice(w, i, {n}) as words)), cast(array() as {_HITS}))"
        for n in lengths
    ]
    return f"concat({', '.join(found)})"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """What of each document is benchmark text; reads `doc_id, text` and `item_id, text`.

    Returns one row per input row: `doc_id, row_key, n_words, n_hit, n_items, items, spans, contaminated`.
    spans holds the hit windows as (first word from 0, words); n_hit counts words in any of them.
    A null text has no words and is clean. Items without words are in no window; an item without
    item_id is looked for but not listed. Rows that repeat doc_id and text get the same result once for
    each row. A null doc_id is a document like any other. Other columns are not read. An empty
    benchmark leaves every document clean, an empty table gives no rows.
    """
    windows = materialize(benchmark_windows(benchmark, window), "benchmark-windows")
    by_set = windows.count() <= most_windows
    if by_set:
        hits = _hits_by_set(windows)
        windows = F.broadcast(windows)
    else:
        lengths = sorted(r[0] for r in windows.select(F.size("words")).distinct().collect())  # at most `window` numbers
        hits = _all_windows(lengths)
    worded = docs.select(
        doc_key().alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_key"), alnum_words(F.col("text")).alias("w")
    )
    # The first entry stands for the row itself. explode_outer: with explode, the look-up would also
    # run in a filter of its own.
    entries = f"concat(array(struct(0 as start, cast(null as array<string>) as words)), {hits})"
    seen = worded.select("doc", "row_key", F.size("w").alias("n_words"), F.explode_outer(F.expr(entries)).alias("hit"))
    seen = seen.select("doc", "row_key", "n_words", F.expr("hit.start").alias("start"), F.expr("hit.words").alias("words"))
    verified = seen.join(windows, "words", "left")
    place = F.when(F.col("item_ids").isNotNull(), F.struct((F.col("start") - 1).alias("first"), F.size("words").alias("size")))
    grouped = verified.groupBy("doc", "row_key", "n_words").agg(
        F.sum((F.col("start") == 0).cast("int")).alias("rows"),
        F.array_sort(F.collect_set(place)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"),
    )
    n_hit = F.size(F.array_distinct(F.flatten(F.expr("transform(spans, s -> sequence(s.first, s.first + s.size - 1))"))))
    counted = grouped.select("doc", "row_key", F.col("n_words").cast("long"), n_hit.cast("long").alias("n_hit"), "items", "spans", F.explode(F.expr("sequence(1, rows)")).alias("_row"))
    return counted.select(
        as_doc_id(F.col("doc")).alias("doc_id"), "row_key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def _flagged(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """The rows with a key of two columns, what was found by that key, and the names of both columns, which the caller does not use."""
    key = free_names(docs, "doc_key", "text_digest")
    found = contamination(docs, benchmark).select(doc_key().alias(key[0]), F.col("row_key").alias(key[1]), "spans", "contaminated")
    named = docs.withColumns(dict(zip(key, (doc_key(), F.xxhash64(F.coalesce("text", F.lit("")))))))
    return named, found.dropDuplicates(key), key


def remove_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that are not contaminated, with all their columns; rows without text are clean. An empty table gives no rows."""
    named, found, key = _flagged(docs, benchmark)
    return named.join(found.where("contaminated").select(*key), key, "left_anti").drop(*key)


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All rows; `clean_words` has the lower-cased words outside every hit window, in order, in place of a column of that name.

    A null text has none. An empty table gives no rows.
    """
    named, found, key = _flagged(docs, benchmark)
    spans, words, hit = free_names(named, "hit_spans", "all_words", "hit_places")
    worded = named.join(found.select(*key, F.col("spans").alias(spans)), key, "left").withColumn(words, alnum_words(F.col("text")))
    marked = worded.withColumn(hit, F.expr(f"array_distinct(flatten(transform({spans}, s -> sequence(s.first, s.first + s.size - 1))))"))
    clean = F.expr(f"filter({words}, (x, i) -> not coalesce(array_contains({hit}, i), false))")
    return marked.withColumn("clean_words", clean).drop(*key, spans, words, hit)
