import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptmill.operators import history, ordering, sampling
from promptmill.operators.subwords import INNER, Trie, subword_vocab, subwords


def runs(seed=1):
    """Three runs; one holds most of the rows."""
    rng = random.Random(seed)
    rows = []
    for run, n in ((1, 200), (2, 30), (3, 1)):
        steps = sorted(rng.sample(range(1, 1000), n))
        rows += [(run, s, float(rng.choice([-2, -1, 0, 1, 5, 9, rng.randint(0, 60)]))) for s in steps]
    return rows


def loop(rows, patience):
    best, streak, out = -1.0, 0, {}
    stop = None
    for step, value in rows:
        out[step] = (best, int(value > best))
        if value > best:
            best, streak = value, 0
        else:
            streak += 1
            if stop is None and patience > 0 and streak >= patience:
                stop = step
    return out, stop


@pytest.mark.parametrize("slice_rows", [7, 64, 1 << 17])
@pytest.mark.parametrize("patience", [0, 1, 3, 8])
def test_history_equals_a_loop(spark, monkeypatch, slice_rows, patience):
    monkeypatch.setattr(ordering, "SLICE_ROWS", slice_rows)
    rows = runs(patience)
    df = spark.createDataFrame(rows, "run int, step bigint, value double")
    judged = {(r["run"], r["step"]): (r["best_before"], r["improved"]) for r in history.best_so_far(df).collect()}
    stops = {r["run"]: (r["n_evals"], r["stop_step"]) for r in history.early_stop(df, patience).collect()}
    for run in (1, 2, 3):
        mine = [(s, v) for r, s, v in rows if r == run]
        want, stop = loop(mine, patience)
        assert {s: judged[run, s] for s, _ in mine} == want
        assert stops[run] == (len(mine), stop)


def test_best_checkpoint_takes_the_earliest(spark):
    df = spark.createDataFrame([(1, 3, 5.0), (1, 2, 5.0), (1, 1, 4.0)], "run int, step bigint, value double")
    assert tuple(history.best_checkpoint(df).first()) == (1, 2, 5.0)


def test_checkpoint_name(spark):
    df = spark.createDataFrame([(0.8765,)], "v double")
    assert df.select(history.checkpoint_name(F.col("v"), "out/")).first()[0] == "out/0.88/"


def test_batches_follow_sparse_and_clustered_ids(spark):
    ids = [*range(100), *[10**15 + i for i in range(50)], -5, 2**62]
    df = spark.createDataFrame([(i,) for i in ids], "guid bigint").repartition(5)
    got = {r["guid"]: (r["batch_id"], r["pos"]) for r in sampling.assign_batches(df, 16).collect()}
    assert got == {g: (i // 16, i % 16) for i, g in enumerate(sorted(ids))}


def test_batches_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([(4,)], "guid bigint")
    assert [tuple(r) for r in sampling.assign_batches(df, 16).collect()] == [(4, 0, 0)]
    assert sampling.assign_batches(df.limit(0), 16).count() == 0


def md5(*parts):
    return hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()


def test_shuffle_equals_sorting_by_key(spark):
    df = spark.range(500).withColumnRenamed("id", "guid")
    got = sampling.seeded_shuffle(df, 9, 2).collect()
    for epoch in (1, 2):
        want = sorted(range(500), key=lambda g: (md5(9, epoch, g), g))
        mine = sorted((r["shuffle_pos"], r["guid"]) for r in got if r["epoch"] == epoch)
        assert mine == list(enumerate(want, 1))


@pytest.mark.parametrize("k", [1, 20, 700])
def test_sample_is_the_head_of_the_shuffle(spark, k):
    df = spark.range(500).withColumnRenamed("id", "guid")
    got = sampling.few_shot(df, [9, 11], k).collect()
    for seed in (9, 11):
        want = sorted(range(500), key=lambda g: (md5(seed, g), g))[:k]
        assert [r["guid"] for r in sorted(got, key=lambda r: r["rank"]) if r["seed"] == seed] == want


def split_word(word, pieces, longest, unknown):
    out, at = [], 0
    while at < len(word):
        lead = INNER if at else ""
        for size in range(min(longest, len(word) - at), 0, -1):
            if lead + word[at : at + size] in pieces:
                out.append(lead + word[at : at + size])
                at += size
                break
        else:
            return [unknown]
    return out


def test_trie_equals_brute_force():
    r = np.random.RandomState(4)
    draw = lambda n: "".join(r.choice(list("abé日𝄞"), n))
    for round_ in range(30):
        pieces = sorted({("" if r.rand() < 0.5 else INNER) + draw(r.randint(1, 5)) for _ in range(r.randint(1, 40))})
        words = [draw(n) for n in r.randint(0, 12, 60)] + ["ab" * 150, "q", ""]
        found, first = Trie(pieces).split(pa.array(words, pa.string()), 4)
        got = [["[UNK]" if p < 0 else pieces[p] for p in found[a:b]] for a, b in zip(first, first[1:])]
        assert got == [split_word(w, frozenset(pieces), 4, "[UNK]") for w in words]


def test_subwords_of_nothing(spark):
    df = spark.createDataFrame([(1, ["ab", "c"]), (2, []), (3, None)], "guid bigint, tokens array<string>")
    none = spark.createDataFrame([], "piece string, n bigint")
    got = {r["guid"]: r["p"] for r in df.select("guid", subwords(F.col("tokens"), none).alias("p")).collect()}
    assert got == {1: ["[UNK]", "[UNK]"], 2: [], 3: []}


def test_subwords_equal_brute_force(spark):
    rows = [(1, ["abab", "ab", "abc"]), (2, ["zzz", "a"]), (3, [])]
    df = spark.createDataFrame(rows, "guid bigint, tokens array<string>")
    vocab = subword_vocab(df, 12, 3)
    pieces = {r["piece"]: r["n"] for r in vocab.collect()}
    assert len(pieces) == 12
    assert pieces["ab"] == 3 and pieces["a"] == 4 and pieces[INNER + "b"] == 4
    got = {r["guid"]: r["p"] for r in df.select("guid", subwords(F.col("tokens"), vocab, 3).alias("p")).collect()}
    assert got == {g: [p for w in ws for p in split_word(w, frozenset(pieces), 3, "[UNK]")] for g, ws in rows}
    assert split_word("abab", frozenset({"ab", "a", "##b", "##ab"}), 3, "[UNK]") == ["ab", "##ab"]
    assert split_word("abq", frozenset({"ab"}), 3, "[UNK]") == ["[UNK]"]


def test_words_of_any_length_are_cut(spark):
    word = "abc" * 100
    df = spark.createDataFrame([(1, [word, "abc"])], "guid bigint, tokens array<string>")
    vocab = subword_vocab(df, 40, 3)
    got = df.select(subwords(F.col("tokens"), vocab, 3).alias("p")).first()["p"]
    assert got == ["abc", *[INNER + "abc"] * 99, "abc"]


def test_many_rows_with_one_timestamp_are_spread(spark):
    df = spark.range(20000).selectExpr("1 AS at", "id AS event_id").repartition(3)
    sliced = ordering.range_slices(df, ["at", "event_id"])
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert slices > 1 and sliced.select("slice").distinct().count() == slices
    placed = ordering.row_index(sliced, ["at", "event_id"], "slice", [], "idx")
    assert placed.filter("idx <> event_id + 1").count() == 0
