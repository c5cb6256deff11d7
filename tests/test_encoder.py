import random

import pytest
from pyspark.sql import functions as F

from promptmill.functions.arrays import kept_lengths
from promptmill.operators import prompts
from promptmill.operators.vocabulary import Specials
from promptmill.plans.queries import QUERIES
from promptmill.tasks import GROUP_QUESTION, IT_WAS, MASK, SENTIMENT, TEXT_A

TOY = Specials(pad=0, unk=9, cls=1, sep=2, mask=3)
QUESTION = [TEXT_A, SENTIMENT, GROUP_QUESTION, MASK, "."]
PLAIN = [TEXT_A, IT_WAS, MASK, "."]
GOLDEN = [
    (
        "fits", QUESTION, {2: [30, 31], 4: [13]}, [50, 51, 52], 18,
        "1 50 51 52 2 10 11 20 13 2 30 31 3 13 2 0 0 0",
        "1 0 0 0 1 3 3 3 3 1 2 2 -1 2 1 1 1 1", 15, 10,
    ),
    (
        "cut", QUESTION, {2: [30, 31], 4: [13]}, list(range(50, 62)), 18,
        "1 50 51 52 53 54 55 2 10 11 20 13 2 30 31 3 13 2",
        "1 0 0 0 0 0 0 1 3 3 3 3 1 2 2 -1 2 1", 18, 13,
    ),
    (
        "plain fits", PLAIN, {1: [10, 11], 3: [13]}, [50, 51], 12,
        "1 50 51 2 10 11 3 13 2 0 0 0",
        "1 0 0 1 2 2 -1 2 1 1 1 1", 9, 4,
    ),
    (
        "plain cut", PLAIN, {1: [10, 11], 3: [13]}, list(range(50, 60)), 12,
        "1 50 51 52 53 2 10 11 3 13 2 0",
        "1 0 0 0 0 1 2 2 -1 2 1 1", 11, 6,
    ),
]

SCHEMA = (
    "pattern array<string>, literal_ids map<int,array<int>>, text_ids array<int>, text_b_ids array<int>, "
    "senti_pre int, sentiment_frame_ids array<array<int>>, sentiment_word_ids array<array<int>>"
)


def toy_row(pattern, literals, text, second=None):
    return (pattern, literals, text, second, 0, [[10, 11], [13]], [[20], [21], [22]])


def ints(text):
    return [int(x) for x in text.split()]


@pytest.mark.parametrize("case", GOLDEN, ids=[g[0] for g in GOLDEN])
def test_golden_rows(spark, case):
    _, pattern, literals, text, max_len, ids, flags, real, first = case
    rows = spark.createDataFrame([toy_row(pattern, literals, text)], SCHEMA)
    got = prompts.pad(prompts.assemble(prompts.with_parts(rows, max_len, TOY), TOY), max_len, TOY).first()
    assert got["input_ids"] == ints(ids)
    assert got["pet_flags"] == ints(flags)
    assert got["attention_mask"] == [1] * real + [0] * (max_len - real)
    assert got["token_type_ids"] == [0] * first + [1] * (real - first) + [0] * (max_len - real)


def test_second_text_reserves_one_more_and_has_no_separator(spark):
    pattern = [TEXT_A, "[text_b]", MASK]
    rows = spark.createDataFrame([toy_row(pattern, {}, [50, 51, 52, 53], [60, 61, 62])], SCHEMA)
    got = prompts.assemble(prompts.with_parts(rows, 11, TOY), TOY).first()
    # Budget 11 - 5 = 6 of 8: the first text gives way, then the first of two equal ones.
    assert got["kept"] == [2, 3, 1]
    assert got["input_ids"] == [1, 50, 51, 2, 60, 61, 62, 3, 2]
    assert got["pet_flags"] == [1, 0, 0, 1, 0, 0, 0, -1, 1]


def pop_longest(lengths, budget):
    lengths = list(lengths)
    while sum(lengths) > budget:
        lengths[lengths.index(max(lengths))] -= 1
    return lengths


def test_truncation_equals_popping_from_the_longest(spark):
    rng = random.Random(5)
    cases = [([rng.randint(0, 12) for _ in range(rng.randint(1, 6))], rng.randint(0, 30)) for _ in range(600)]
    rows = spark.createDataFrame(cases, "ls array<int>, b int")
    for r in rows.select("ls", "b", kept_lengths(F.col("ls"), F.col("b")).alias("kept")).collect():
        assert r["kept"] == pop_longest(r["ls"], r["b"]), r


def test_short_cut_of_one_text_equals_the_general_rule(spark):
    rng = random.Random(6)
    rows = [
        toy_row(QUESTION, {2: [30] * rng.randint(1, 9), 4: [13]}, list(range(rng.randint(0, 40)))) for _ in range(300)
    ]
    df = prompts.with_parts(spark.createDataFrame(rows, SCHEMA), 20, TOY)
    for r in df.select("part_lengths", "kept").collect():
        assert r["kept"] == pop_longest(r["part_lengths"], 16)


def test_prompt_that_cannot_fit_is_turned_away(spark):
    rows = prompts.with_parts(spark.createDataFrame([toy_row(PLAIN, {1: [10, 11], 3: [13]}, [50])], SCHEMA), 7, TOY)
    assert rows.filter(prompts.too_tight(7)).count() == 1
    assert rows.filter(prompts.too_tight(8)).count() == 0


def test_encoded_rows_are_well_formed(spark, sf):
    rows = QUERIES["encode_padded"](spark, sf).collect()
    assert rows
    for r in rows:
        arrays = [ints(r[c]) for c in ("input_ids", "attention_mask", "token_type_ids", "pet_flags")]
        assert {len(a) for a in arrays} == {512}
        assert arrays[3].count(-1) == 1
        assert arrays[0][arrays[3].index(-1)] == Specials().mask


def test_unknown_strategy():
    with pytest.raises(NotImplementedError):
        prompts.get_strategy("skip_third")


def test_long_prompt_words_are_remapped_in_order_and_each_row_gets_its_own_sentiment(spark):
    encoded = spark.createDataFrame(
        [(1, "t", [7, 30, 31, 10, 11, 20, 13], [0, 2, 2, 3, 3, 3, 3], 1, 0), (2, "t", [30, 31, 10, 11, 22, 13], [2, 2, 3, 3, 3, 3], 0, 2)],
        "guid int, task string, input_ids array<int>, pet_flags array<int>, label_id int, senti_pre int",
    )
    remap = spark.createDataFrame([("t", [93, 92], [91, 90])], "task string, pattern_new array<int>, label_new array<int>")
    got = {r["guid"]: r for r in prompts.remap_second(encoded, remap, 100).collect()}
    assert got[1]["input_ids"] == [7, 93, 92, 99, 98, 96, 97]
    assert got[2]["input_ids"] == [93, 92, 99, 98, 94, 97]
    assert (got[1]["pet_label"], got[2]["pet_label"]) == (90, 91)
