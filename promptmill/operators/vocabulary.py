"""Vocabulary tables: building, looking up, and the reserved ids of prompt words."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptmill.functions.arrays import let, max_abs
from promptmill.functions.text import shuffle_key, tokens, unit_interval
from promptmill.operators.examples import require_unique
from promptmill.sources.storage import BROADCAST_BYTES, broadcast_if_small, fixed_table, materialize
from promptmill.tasks import IT_WAS, SENTIMENTS, TASKS, Task

# Fixed value: ids of a vocabulary, virtual ones included.
VOCAB_SIZE = 30522
# Ids at the tail kept free for virtual prompt tokens.
RESERVED_IDS = 64
# Sentiment prompt: three words, then three sentiment words, before a task's own ids start.
SENTIMENT_IDS = 6

SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")


class Specials(NamedTuple):
    pad: int = 0
    unk: int = 1
    cls: int = 2
    sep: int = 3
    mask: int = 4


def prompt_phrases(spark: SparkSession, tasks: Sequence[Task] = TASKS) -> DataFrame:
    """Every word sequence the prompts of some tasks use: task, section, position, phrase."""
    rows = []
    for t in tasks:
        rows += [(t.task, 0, i, p) for i, p in enumerate(t.pattern) if not p.startswith("[")]
        rows += [(t.task, 1, i, v) for i, v in enumerate(t.verbalizers)]
        rows += [(t.task, 2, i, p) for i, p in enumerate((IT_WAS, "."))]
        rows += [(t.task, 3, i, s) for i, s in enumerate(SENTIMENTS)]
    return fixed_table(spark, rows, "task string, section int, pos int, phrase string")


def token_counts(docs: DataFrame) -> DataFrame:
    """Occurrences of every token of a `tokens` column; counted before the shuffle.

    The outer form keeps Catalyst from adding a size check, which would tokenize every text twice.
    """
    each = docs.select(F.explode_outer("tokens").alias("token")).filter(F.col("token").isNotNull())
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent tokens, equal counts in token order.

    A histogram of the counts tells where the k-th place falls. Fewer than k tokens are above it; of those
    at that count, the first ones in token order fill up. No task sees all tokens.
    """
    stored = materialize(counts, "token_totals")
    # no more than k rows: every count belongs to a token
    tops = stored.groupBy("n").agg(F.count(F.lit(1)).alias("tokens")).orderBy(F.desc("n")).limit(k).collect()
    above, cut = 0, None
    for row in tops:
        if above + row["tokens"] >= k:
            cut = row["n"]
            break
        above += row["tokens"]
    if cut is None:
        return stored
    ties = stored.filter(F.col("n") == cut).orderBy("token").limit(k - above)
    return stored.filter(F.col("n") > cut).unionByName(ties)


def build_vocab(docs: DataFrame, size: int = VOCAB_SIZE, reserved: int = RESERVED_IDS) -> DataFrame:
    """token, id, n: specials, then prompt words, then corpus tokens by frequency.

    At most `size - reserved` rows, so the id window below never sees more.
    """
    spark = docs.sparkSession
    specials = fixed_table(
        spark, [(0, t, i) for i, t in enumerate(SPECIAL_TOKENS)], "part int, token string, place int"
    )
    prompt_words = (
        prompt_phrases(spark).select(F.explode(tokens(F.col("phrase"))).alias("token")).distinct()
    )
    room = size - reserved - len(SPECIAL_TOKENS)
    corpus = most_frequent(
        token_counts(docs).join(F.broadcast(prompt_words), "token", "left_anti"), room
    )
    place, never = F.lit(0).alias("place"), F.lit(0).cast("bigint")
    rows = (
        specials.select("part", "token", "place", never.alias("n"))
        .unionByName(prompt_words.select(F.lit(1).alias("part"), "token", place, never.alias("n")))
        .unionByName(corpus.select(F.lit(2).alias("part"), "token", place, "n"))
    )
    order = Window.partitionBy(F.lit(0)).orderBy("part", "place", F.desc("n"), "token")
    return (
        rows.withColumn("id", (F.row_number().over(order) - 1).cast("int"))
        .filter(F.col("id") < size - reserved)
        .select("token", "id", "n")
    )


def lookup_bytes(lookup: DataFrame) -> int:
    return lookup.agg(F.sum(F.octet_length("token") + 16).alias("nbytes")).first()["nbytes"] or 0


def lookup_ready(vocab: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A stored vocabulary as a lookup table, broadcast when its measured bytes allow it."""
    return broadcast_if_small(vocab.select("token", "id"), lookup_bytes(vocab), limit)


def ids_in_place(lookup: DataFrame, unk: int = Specials().unk) -> Callable[[Column], Column]:
    """Ids of a token column as a function of it, looked up where each row is read.

    For a vocabulary whose bytes were found to fit a broadcast.
    """
    found = lookup.select("token", "id").toArrow()
    table = (found.column("token").combine_chunks(), found.column("id").combine_chunks())
    shared = lookup.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, numbers = shared.value
        for batch in batches:
            at = pc.index_in(batch.flatten(), value_set=words)
            known = pc.fill_null(numbers.take(at), unk).cast(pa.int32())
            lengths = np.asarray(pc.fill_null(pc.list_value_length(batch), 0))
            offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), known)

    return ids


# Slices of the occurrences of one token when a vocabulary is too large to broadcast.
SALTS = 16
# Places of a token in the filter of known tokens, its bits per token, and its least and largest size as powers of two.
FILTER_PLACES, FILTER_BITS, LEAST_BITS, MOST_BITS = 4, 12, 13, 36


def _two_places(token: Column, bits: int) -> tuple[Column, Column]:
    """Where a token begins in the filter, and how far apart its places are."""
    return F.pmod(F.xxhash64(token), F.lit(bits)), F.pmod(F.xxhash64(token, F.lit(1)), F.lit(bits))


def known_filter(lookup: DataFrame, limit: int = BROADCAST_BYTES) -> np.ndarray:
    """A Bloom filter of all tokens of a lookup table, in words of 64 bits: as large as its tokens ask for, within the limit.

    Bits are set where the tokens are and joined by word, so the driver gets the filter, never the tokens.
    """
    wanted = (FILTER_BITS * max(1, lookup.count()) - 1).bit_length()
    allowed = min(MOST_BITS, max(LEAST_BITS, (8 * max(1, limit)).bit_length() - 1))
    bits = 1 << min(max(LEAST_BITS, wanted), allowed)
    begin, gap = _two_places(F.col("token"), bits)
    place = F.explode(F.array(*[(begin + i * gap) % bits for i in range(FILTER_PLACES)]))
    words = lookup.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word"))
    found = words.agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("mask")).toArrow()
    table = np.zeros(bits >> 6, np.int64)
    table[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return table


def maybe_known(lookup: DataFrame, limit: int = BROADCAST_BYTES) -> Callable[[Column], Column]:
    """A function of a token column: whether each token may be in the lookup table. Every known one may."""
    table = known_filter(lookup, limit)
    bits = len(table) << 6
    shared = lookup.sparkSession.sparkContext.broadcast(table)
    places = FILTER_PLACES

    @F.arrow_udf("array<boolean>")
    def found(begins: pa.Array, gaps: pa.Array) -> pa.Array:
        first, gap = begins.flatten().to_numpy(), gaps.flatten().to_numpy()
        there = np.ones(len(first), bool)
        for i in range(places):
            place = (first + i * gap) % bits
            there &= (shared.value[place >> 6] >> (place & 63)) & 1 == 1
        offsets = np.r_[0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(begins), 0)))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(there))

    return lambda words: found(
        F.transform(words, lambda t: _two_places(t, bits)[0]), F.transform(words, lambda t: _two_places(t, bits)[1])
    )


def _filled(unk: int) -> Callable[[Column, Column], Column]:
    """Ids of a row from its number of tokens and the (pos, id) that were found; all others are `unk`."""

    @F.arrow_udf("array<int>")
    def fill(sizes: pa.Array, placed: pa.Array) -> pa.Array:
        offsets = np.r_[0, np.cumsum(np.asarray(pc.fill_null(sizes, 0)))].astype(np.int64)
        out = np.full(offsets[-1], unk, np.int32)
        counts = np.asarray(pc.fill_null(pc.list_value_length(placed), 0))
        pairs = placed.flatten()
        if len(pairs):
            out[np.repeat(offsets[:-1], counts) + pairs.field("pos").to_numpy()] = pairs.field("id").to_numpy()
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))

    return fill


def same_key(left: DataFrame, right: DataFrame, keep: Sequence[str]) -> Column:
    """Equal in all key columns; nulls are equal."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keep])


def token_ids(
    docs: DataFrame, lookup: DataFrame, keep: list[str], unk: int = Specials().unk, column: str = "tokens", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Ids of a token column in reading order, as `ids`, beside the `keep` columns.

    A vocabulary that fits the limit is looked up in each row. Beyond it, a Bloom filter keeps unknown tokens where they are; the
    others are joined by shuffle, dealt into SALTS slices so that no stop word gathers in one task. `keep` must be unique then, which is checked.
    """
    if lookup_bytes(lookup) <= limit:
        return docs.select(*keep, ids_in_place(lookup, unk)(F.col(column)).alias("ids"))
    require_unique(docs, keep)
    marked = docs.select(*keep, column, maybe_known(lookup, limit)(F.col(column)).alias("maybe"))
    every = F.transform(column, lambda t, i: F.struct(i.alias("pos"), t.alias("token"), F.get("maybe", i).alias("maybe")))
    occurrences = marked.select(*keep, F.inline(F.filter(every, lambda e: e["maybe"]))).withColumn(
        "salt", F.pmod(F.xxhash64(*keep, "pos"), F.lit(SALTS))
    )
    salted = lookup.select("token", "id", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    found = occurrences.join(salted, ["token", "salt"]).groupBy(*keep).agg(F.collect_list(F.struct("pos", "id")).alias("placed"))
    sizes = docs.select(*keep, F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)).alias("n"))
    rows = sizes.join(found, same_key(sizes, found, keep), "left")
    return rows.select(*[sizes[k] for k in keep], _filled(unk)(F.col("n"), F.col("placed")).alias("ids"))


def prompt_tokens(
    spark: SparkSession, lookup: DataFrame, unk: int = Specials().unk, tasks: Sequence[Task] = TASKS
) -> DataFrame:
    """Tokens and ids of the prompt phrases: a small table of the tasks, whatever the corpus."""
    words = prompt_phrases(spark, tasks).select(
        "task", "section", "pos", F.posexplode(tokens(F.col("phrase"))).alias("tok_pos", "token")
    )
    return words.join(lookup, "token", "left").withColumn("id", F.coalesce("id", F.lit(unk)))


def reserved_ids(
    prompt: DataFrame, vocab_size: int = VOCAB_SIZE, first: int = 0, reserved: int = RESERVED_IDS
) -> DataFrame:
    """New ids, counted down from the end of the vocabulary, for pattern words then label words.

    `first` ids at the very end are left to the sentiment prompt. `reserved` is what the vocabulary was built with:
    a task that needs more ids fails the job, since they would meet ids of corpus tokens.
    """
    own = prompt.filter((F.col("section") == 0) | ((F.col("section") == 1) & (F.col("tok_pos") == 0)))
    order = Window.partitionBy("task").orderBy("section", "pos", "tok_pos")
    ordinal = F.row_number().over(order)
    taken = F.when(ordinal + first <= reserved, ordinal).otherwise(
        F.raise_error(f"a task needs more than the {reserved} reserved ids").cast("int")
    )
    return own.select(
        "task",
        F.when(F.col("section") == 0, "pattern").otherwise("label").alias("kind"),
        "token",
        F.col("id").alias("old_id"),
        taken.alias("ord"),
        (F.lit(vocab_size) - first - taken).cast("int").alias("new_id"),
    )


def sentiment_reserved_ids(vocab_size: int = VOCAB_SIZE) -> tuple[list[int], list[int]]:
    """New ids of `it`, `was`, `.` and of the three sentiment words; disjoint from all task ids."""
    ids = [vocab_size - 1 - i for i in range(SENTIMENT_IDS)]
    return ids[:3], ids[3:]


def remap_columns(reserved: DataFrame) -> DataFrame:
    """One row per task: the new pattern ids in order, and the new label ids in class order."""

    def collected(kind):
        rows = F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "new_id")))
        return F.transform(F.array_sort(rows), lambda r: r["new_id"])

    return reserved.groupBy("task").agg(
        collected("pattern").alias("pattern_new"), collected("label").alias("label_new")
    )


def checked_pairs(remap: DataFrame, reserved: int) -> list:
    """The id pairs; more of them than there are reserved ids is an error."""
    pairs = remap.select("old_id", "new_id").limit(reserved + 1).collect()
    if len(pairs) > reserved:
        raise ValueError(f"more than {reserved} id pairs")
    return pairs


def copy_rows(
    vectors: DataFrame, remap: DataFrame, id_column="vec_id", value="embedding", reserved: int = RESERVED_IDS
) -> DataFrame:
    """Give every `new_id` row the vector of its `old_id` row.

    `remap` holds at most `reserved` pairs, so both broadcasts are bounded and the vector table
    is scanned, never shuffled. A pair whose new id is another pair's old id would make the result
    depend on the order of copying, so it is refused.
    """
    pairs = checked_pairs(remap, reserved)
    if {p["old_id"] for p in pairs} & {p["new_id"] for p in pairs}:
        raise ValueError("an old id is also a new id")
    copies = vectors.join(F.broadcast(remap), F.col(id_column) == F.col("old_id")).select(
        F.col("new_id").alias(id_column), F.col(value).alias("copied")
    )
    columns = [F.coalesce("copied", value).alias(value) if c == value else F.col(c) for c in vectors.columns]
    return vectors.join(F.broadcast(copies), id_column, "left").select(*columns)


def randomize_rows(
    vectors: DataFrame, remap: DataFrame, seed: int, id_column="vec_id", value="embedding", reserved: int = RESERVED_IDS
) -> DataFrame:
    """Give every `new_id` row uniform values within its own largest absolute value.

    Few rows are drawn anew, so the hashes cost little; all others pass through.
    """
    checked_pairs(remap, reserved)
    chosen = remap.select(F.col("new_id").alias(id_column), F.lit(True).alias("chosen"))

    def drawn(bound):
        return F.transform(
            F.col(value),
            lambda x, i: ((unit_interval(shuffle_key(seed, F.col(id_column), i)) * 2 - 1) * bound).cast("float"),
        )

    fresh = F.when(F.col("chosen"), let(max_abs(F.col(value)), drawn)).otherwise(F.col(value))
    columns = [fresh.alias(value) if c == value else F.col(c) for c in vectors.columns]
    return vectors.join(F.broadcast(chosen), id_column, "left").select(*columns)
