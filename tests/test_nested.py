"""Scorers of nested samples against one scorer per cell."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptmill.operators import nested, scorer
from promptmill.plans import inputs, stages

SIZES, SEEDS, CLASSES = (2, 5, 9), (7, 1), 3


def _drawn():
    r = np.random.RandomState(2)
    words = [f"w{i}" for i in range(30)] + ["é", ""]
    return [
        (seed, rank, int(r.randint(0, CLASSES)), [words[k] for k in r.randint(0, len(words) - 1, r.randint(0, 12))])
        for seed in SEEDS for rank in range(1, 10)
    ]


@pytest.fixture(scope="module")
def drawn(spark):
    return spark.createDataFrame(_drawn(), "seed int, rank int, class int, tokens array<string>")


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(0, ["w1", "w2", "w2", "nowhere"]), (1, []), (2, ["nowhere"]), (3, [f"w{i}" for i in range(30)] * 40), (3, ["é"]), (4, [""])]
    return spark.createDataFrame(rows, "guid long, tokens array<string>")


def _units(model, texts):
    scored = texts.select("guid", nested.units_of_runs(model)(F.col("tokens")).alias("all_units"))
    runs = nested.each_run(scored, model, ["guid"]).join(model.runs(), "cell")
    return sorted((r["guid"], r["n"], r["seed"], list(r["units"])) for r in runs.collect())


def test_units_equal_those_of_a_scorer_per_cell(spark, drawn, texts):
    got = _units(nested.train_nested(drawn, SIZES, SEEDS, CLASSES), texts)
    want = []
    for n in SIZES:
        for seed in SEEDS:
            own = drawn.filter((F.col("seed") == seed) & (F.col("rank") <= n)).select(F.lit(0).alias("cell"), "class", "tokens")
            found = scorer.score_cells(texts, scorer.train(own, CLASSES)).collect()
            want += [(r["guid"], n, seed, list(r["units"])) for r in found]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert all(abs(a - b) <= 2000 for g, w in zip(got, sorted(want)) for a, b in zip(g[3], w[3]))  # 1200 tokens, each within a unit


def test_shares_change_nothing(monkeypatch, drawn, texts):
    whole = _units(nested.train_nested(drawn, SIZES, SEEDS, CLASSES), texts)
    monkeypatch.setattr(nested, "LEAST_SHARE", 1)
    model = nested.train_nested(drawn, SIZES, SEEDS, CLASSES, limit=600)
    assert len(model.shares) > 3 and _units(model, texts) == whole


def test_sizes_in_any_order_and_no_rows(spark, drawn, texts):
    assert _units(nested.train_nested(drawn, (9, 2, 5, 2), SEEDS, CLASSES), texts) == _units(nested.train_nested(drawn, SIZES, SEEDS, CLASSES), texts)
    none = nested.train_nested(drawn.filter("rank > 100"), SIZES, SEEDS, CLASSES)
    assert _units(none, texts) == []


def test_sweep_makes_no_row_per_token_and_run(spark, sf):
    rows = inputs.examples(spark, sf).withColumn("senti_pre", F.col("senti_gold"))
    plan = stages.sweep(rows, (16, 64), (9, 99))._jdf.queryExecution().executedPlan().toString()
    # the only generator makes a row per held-out row and run; tokens are summed where the rows are read
    assert plan.count("Generate inline(transform") == 1 and "Generate explode" not in plan


def test_a_long_text_is_added_up_in_little_memory(spark):
    sizes, seeds, classes = (16, 32, 64, 128, 256, 512, 1024), tuple(range(10)), 3
    slots = len(seeds) * len(sizes) * classes
    share = nested._Share(pa.array(["a", "b"]), np.array([0, slots, slots]), np.arange(slots, dtype=np.int32), np.ones(slots, np.int64))
    shape = (len(seeds), len(sizes), classes)
    own = nested.NestedScorer(spark, sizes, seeds, [SimpleNamespace(value=share)], np.full(shape, 9.0), np.ones(shape, np.int64))
    units = nested.units_of_runs(own).func
    (short,) = units(iter([pa.array([["a", "c"], [], ["a", "a", "a"]])]))
    one = np.array(short.to_pylist()) - 1
    assert (one[2] == 3 * one[0]).all() and not one[1].any() and one[0].any()
    tracemalloc.start()
    (long,) = units(iter([pa.array([["a", "c"] * 100_000, ["a"]])]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (np.array(long.to_pylist()) - 1 == [100_000 * one[0], one[0]]).all()
    assert peak < 100 << 20
