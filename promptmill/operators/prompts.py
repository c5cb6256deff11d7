"""Prompts as text and as id arrays. All of it is row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptmill.functions.arrays import kept_lengths, let, repeat, total_int
from promptmill.functions.text import tokens
from promptmill.operators.vocabulary import (
    VOCAB_SIZE,
    Specials,
    ids_in_place,
    lookup_bytes,
    same_key,
    sentiment_reserved_ids,
    token_ids,
)
from promptmill.sources.storage import BROADCAST_BYTES
from promptmill.tasks import (
    FLAG_MASK,
    FLAG_PROMPT,
    FLAG_SENTIMENT,
    FLAG_SPECIAL,
    FLAG_TEXT,
    IT_WAS,
    MASK,
    SENTIMENT,
    SENTIMENTS,
    TEXT_A,
    TEXT_B,
)

# Positions the budget sets aside besides one more for a second text.
SET_ASIDE = 4


def sentiment_prompt(sentiment: Column) -> Column:
    """`It was <word> .`; null when the class is not one of the three."""
    word = F.get(F.array(*[F.lit(s) for s in SENTIMENTS]), sentiment)
    return F.when(word.isNotNull(), F.concat_ws(" ", F.lit(IT_WAS), word, F.lit(".")))


def prompt_text(pattern: Column, text_a: Column, sentiment: Column, text_b: Column | None = None) -> Column:
    """The whole prompt as one string, with the mask slot left visible.

    A slot without its value makes the prompt null, so that the row can be turned away.
    """
    second = F.lit(None).cast("string") if text_b is None else text_b
    filled = F.transform(
        pattern,
        lambda p: F.when(p == TEXT_A, text_a)
        .when(p == TEXT_B, second)
        .when(p == SENTIMENT, sentiment_prompt(sentiment))
        .otherwise(p),
    )
    return let(filled, lambda parts: F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, " ")))


def task_slots(prompt: DataFrame) -> DataFrame:
    """One row per task with the ids of its phrases: 17 rows, broadcast by the encoder."""
    phrases = (
        prompt.groupBy("task", "section", "pos")
        .agg(F.array_sort(F.collect_list(F.struct("tok_pos", "id"))).alias("placed"))
        .withColumn("ids", F.transform("placed", lambda p: p["id"]))
    )

    def section(number):
        rows = F.collect_list(F.when(F.col("section") == number, F.struct("pos", "ids")))
        return F.array_sort(rows)

    def ids_of(number):
        return F.transform(section(number), lambda p: p["ids"])

    return phrases.groupBy("task").agg(
        F.map_from_entries(section(0)).alias("literal_ids"),
        F.transform(ids_of(1), lambda ids: F.get(ids, F.lit(0))).alias("verbalizer_ids"),
        ids_of(2).alias("sentiment_frame_ids"),
        ids_of(3).alias("sentiment_word_ids"),
    )


def part_ids(sp: Specials = Specials()) -> Column:
    """Ids of every pattern part, from the columns of `task_slots` and the text ids."""
    frame, words = F.col("sentiment_frame_ids"), F.col("sentiment_word_ids")
    sentiment = F.concat(F.get(frame, F.lit(0)), F.get(words, F.col("senti_pre")), F.get(frame, F.lit(1)))
    return F.transform(
        "pattern",
        lambda p, i: F.when(p == TEXT_A, F.col("text_ids"))
        .when(p == TEXT_B, F.col("text_b_ids"))
        .when(p == SENTIMENT, sentiment)
        .when(p == MASK, F.array(F.lit(sp.mask)))
        .otherwise(F.try_element_at("literal_ids", i)),
    )


def budget(max_len: int) -> Column:
    """Ids that the parts may use together."""
    return F.lit(max_len - SET_ASIDE) - F.when(F.array_contains("pattern", TEXT_B), 1).otherwise(0)


def with_parts(df: DataFrame, max_len: int, sp: Specials = Specials()) -> DataFrame:
    """Add `parts`, their lengths, and the lengths that stay within the budget.

    When the one text part can absorb the whole cut, its length is plain arithmetic; the level
    search runs only where fixed parts are as long as what is left of the text.
    """
    sized = df.withColumn("parts", part_ids(sp)).withColumn("part_lengths", F.transform("parts", F.size))
    lengths = F.col("part_lengths")
    fixed = total_int(F.transform(lengths, lambda n, i: F.when(F.get(F.col("pattern"), i).isin(TEXT_A, TEXT_B), 0).otherwise(n)))
    widest_fixed = F.array_max(F.transform(lengths, lambda n, i: F.when(F.get(F.col("pattern"), i) == TEXT_A, 0).otherwise(n)))
    room = budget(max_len)
    one_text = (F.get(F.col("pattern"), F.lit(0)) == TEXT_A) & ~F.array_contains("pattern", TEXT_B)
    text_room = room - F.col("fixed_ids")
    short = total_int(lengths) <= room
    kept = (
        F.when(short, lengths)
        .when(
            one_text & (text_room >= widest_fixed),
            F.transform(lengths, lambda n, i: F.when(i == 0, text_room).otherwise(n)),
        )
        .otherwise(kept_lengths(lengths, room))
    )
    return sized.withColumn("fixed_ids", fixed).withColumn("kept", kept)


def too_tight(max_len: int) -> Column:
    """True when the fixed prompt parts alone exceed the budget; such rows are turned away."""
    return budget(max_len) < F.col("fixed_ids")


def assemble(df: DataFrame, sp: Specials = Specials()) -> DataFrame:
    """Unpadded `input_ids` and `pet_flags`, plus `first_segment`, the length of segment 0."""

    def slot_at(i):
        return F.get(F.col("pattern"), i)

    def ends_with_sep(i):
        return slot_at(i).isin(TEXT_A, SENTIMENT)

    def kept_part(part, i):
        # The mask stays even when its part was cut to nothing.
        return F.when(slot_at(i) == MASK, part).otherwise(F.slice(part, 1, F.get(F.col("kept"), i)))

    def ids_of(part, i):
        body = kept_part(part, i)
        return F.when(ends_with_sep(i), F.concat(body, F.array(F.lit(sp.sep)))).otherwise(body)

    def flags_of(part, i):
        slot = slot_at(i)
        flag = (
            F.when(slot.isin(TEXT_A, TEXT_B), FLAG_TEXT)
            .when(slot == MASK, FLAG_MASK)
            .when(slot == SENTIMENT, FLAG_SENTIMENT)
            .otherwise(FLAG_PROMPT)
        )
        body = F.transform(kept_part(part, i), lambda _: flag)
        return F.when(ends_with_sep(i), F.concat(body, F.array(F.lit(FLAG_SPECIAL)))).otherwise(body)

    with_ids = df.withColumn(
        "input_ids",
        F.concat(F.array(F.lit(sp.cls)), F.flatten(F.transform("parts", ids_of)), F.array(F.lit(sp.sep))),
    ).withColumn(
        "pet_flags",
        F.concat(
            F.array(F.lit(FLAG_SPECIAL)), F.flatten(F.transform("parts", flags_of)), F.array(F.lit(FLAG_SPECIAL))
        ),
    )
    # Segment 0 ends at the last separator before the closing one.
    n = F.size("input_ids")
    back = F.array_position(F.reverse(F.slice("input_ids", 1, n - 1)), sp.sep)
    return with_ids.withColumn("first_segment", F.when(back > 0, n - back).otherwise(0).cast("int"))


def pad(df: DataFrame, max_len: int, sp: Specials = Specials()) -> DataFrame:
    """Bring the four arrays to `max_len`; done only where a scorer wants fixed lengths."""
    n = F.size("input_ids")
    free = F.lit(max_len) - n
    first = F.col("first_segment")
    return (
        df.withColumn("attention_mask", F.concat(repeat(1, n), repeat(0, free)))
        .withColumn("token_type_ids", F.concat(repeat(0, first), repeat(1, n - first), repeat(0, free)))
        .withColumn("input_ids", F.concat("input_ids", repeat(sp.pad, free)))
        .withColumn("pet_flags", F.concat("pet_flags", repeat(FLAG_SPECIAL, F.lit(max_len) - F.size("pet_flags"))))
    )


def fitted(
    examples: DataFrame, slots: DataFrame, lookup: DataFrame, max_len: int, sp: Specials = Specials(), whole: bool = False, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Accepted examples, which carry their task columns, with the ids of all parts and the lengths that fit.

    Text ids are looked up in each row and nothing is shuffled while the vocabulary's measured bytes fit the limit; beyond it they come from
    `token_ids` and are joined by guid, which must be unique then. Tokens past `max_len` can never survive the cut,
    so they are dropped before the lookup unless the `whole` lengths are wanted. Second texts are
    encoded like first ones.
    """
    carried = ["guid", "task", "pattern", "label_id", "senti_pre"]
    none = F.lit(None).cast("array<int>")
    texts = [t for t in ("text_a", "text_b") if t in examples.columns]

    def words(column):
        found = tokens(F.col(column))
        return found if whole else F.slice(found, 1, max_len)

    if lookup_bytes(lookup) <= limit:
        ids = ids_in_place(lookup, sp.unk)
        found = {t: F.when(F.col(t).isNotNull(), ids(words(t))) if t == "text_b" else ids(words(t)) for t in texts}
        rows = examples.select(*carried, found["text_a"].alias("text_ids"), found.get("text_b", none).alias("text_b_ids"))
    else:
        rows = examples.select(*carried)
        for text, out in (("text_a", "text_ids"), ("text_b", "text_b_ids")):
            if text not in texts:
                rows = rows.withColumn(out, none)
                continue
            given = examples.select("guid", words(text).alias("tokens"))
            given = given.filter(F.col("tokens").isNotNull()) if text == "text_b" else given
            made = token_ids(given, lookup, ["guid"], sp.unk, limit=limit).withColumnRenamed("ids", out)
            rows = rows.join(made, same_key(rows, made, ["guid"]), "left").select(*[rows[c] for c in rows.columns], made[out])
    return with_parts(rows.join(F.broadcast(slots), "task"), max_len, sp)


def encode(
    examples: DataFrame, slots: DataFrame, lookup: DataFrame, max_len: int, sp: Specials = Specials(), limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Encode accepted examples that carry their task columns; any task whose phrases are in `slots`.

    Rows whose fixed prompt parts leave no room are in `encode_rejects`. `limit` as for `fitted`.
    """
    rows = fitted(examples, slots, lookup, max_len, sp, limit=limit).filter(~too_tight(max_len))
    return assemble(rows, sp).withColumn("pet_label", F.get("verbalizer_ids", F.col("label_id")))


def encode_rejects(
    examples: DataFrame, slots: DataFrame, lookup: DataFrame, max_len: int, sp: Specials = Specials(), limit: int = BROADCAST_BYTES
) -> DataFrame:
    """guid, task, reason of the accepted examples that cannot be encoded in `max_len` ids."""
    rows = fitted(examples, slots, lookup, max_len, sp, limit=limit).filter(too_tight(max_len))
    return rows.select("guid", "task", F.lit("prompt does not fit").alias("reason"))


def mask_position(flags: Column) -> Column:
    """0-based position of the mask, the one flag of its kind in a row."""
    return (F.array_position(flags, FLAG_MASK) - 1).cast("int")


def _replace_flagged(ids: Column, flags: Column, flag: int, new_ids: Column) -> Column:
    """Put `new_ids`, in order, at the positions that carry the flag."""
    positions = F.filter(F.sequence(F.lit(0), F.size(flags) - 1), lambda i: F.get(flags, i) == flag)
    return let(
        F.struct(positions.alias("at"), new_ids.alias("ids")),
        lambda b: F.transform(
            ids, lambda x, i: F.coalesce(F.get(b["ids"], (F.array_position(b["at"], i) - 1).cast("int")), x)
        ),
    )


def remap_first(encoded: DataFrame, remap: DataFrame) -> DataFrame:
    """Prompt words and label words get their virtual ids."""
    rows = encoded.join(F.broadcast(remap), "task")
    return (
        rows.withColumn("input_ids", _replace_flagged(F.col("input_ids"), F.col("pet_flags"), FLAG_PROMPT, F.col("pattern_new")))
        .withColumn("pet_label", F.get("label_new", F.col("label_id")))
        .drop("pattern_new", "label_new")
    )


def remap_second(encoded: DataFrame, remap: DataFrame, vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """As `remap_first`, and the sentiment prompt too: its third word is the row's own sentiment."""
    (it, was, stop), words = sentiment_reserved_ids(vocab_size)
    chosen = F.get(F.array(*[F.lit(w) for w in words]), F.col("senti_pre"))
    new_ids = F.array(F.lit(it), F.lit(was), chosen, F.lit(stop))
    rows = remap_first(encoded, remap)
    return rows.withColumn(
        "input_ids", _replace_flagged(F.col("input_ids"), F.col("pet_flags"), FLAG_SENTIMENT, new_ids)
    )


STRATEGIES = {"skip_first": remap_first, "skip_second": remap_second}


def get_strategy(name: str):
    """The id strategy of that name; an unknown name raises NotImplementedError."""
    if name not in STRATEGIES:
        raise NotImplementedError(f"unknown prompt strategy: {name}")
    return STRATEGIES[name]
