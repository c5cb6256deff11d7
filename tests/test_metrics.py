import random

import pytest
from pyspark.sql import functions as F

from promptmill.operators import metrics


def preds(spark, rows):
    return spark.createDataFrame(rows, "label int, pred int")


def test_binary_zero_denominators(spark):
    got = metrics.binary_metrics(preds(spark, [(0, 0), (0, 0)])).first()
    assert (got["precision"], got["accuracy"], got["f1_score"]) == (0.0, 1.0, 0.0)
    got = metrics.binary_metrics(preds(spark, [(1, 0), (0, 1)])).first()
    assert (got["precision"], got["accuracy"], got["f1_score"]) == (0.0, 0.0, 0.0)


def test_empty_split(spark):
    got = metrics.binary_metrics(preds(spark, [])).first()
    assert (got["n_rows"], got["precision"], got["accuracy"], got["f1_score"]) == (0, 0.0, 0.0, 0.0)
    assert metrics.binary_metrics(preds(spark, []).withColumn("split", F.lit("dev")), ["split"]).count() == 0


def test_macro_f1_counts_classes_of_labels_or_predictions(spark):
    rows = [(0, 0), (0, 2), (1, 1), (1, 0), (1, 1)]
    got = metrics.macro_metrics(preds(spark, rows)).first()
    assert got["n_rows"] == 5 and abs(got["accuracy"] - 3 / 5) < 1e-12
    assert abs(got["f1_score"] - (2 * 1 / 4 + 2 * 2 / 5 + 0) / 3) < 1e-12


def brute_auroc(rows, classes):
    aucs = []
    for c in classes:
        for o in classes:
            if o != c:
                pos = [p[c] for label, p in rows if label == c]
                neg = [p[c] for label, p in rows if label == o]
                wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
                aucs.append(wins / (len(pos) * len(neg)))
    return sum(aucs) / len(aucs)


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_auroc_equals_brute_force(spark, slices):
    rng = random.Random(slices)
    # A third of all rows share one score, so ties cross the slices.
    probs = lambda: [0.25, 0.25, 0.5] if rng.random() < 0.34 else [round(rng.random(), 2) for _ in range(3)]
    rows = [(rng.randint(0, 2), probs()) for _ in range(200)]
    df = spark.createDataFrame(rows, "label int, probs array<double>")
    got = metrics.auroc_ovo(df, (0, 1, 2), slices=slices).first()
    assert got["undefined_pairs"] == 0
    assert abs(got["AUROC_score"] - brute_auroc(rows, (0, 1, 2))) < 1e-12


def test_auroc_tells_near_ties_apart(spark):
    rows = [(0, [0.5 + 1e-14, 0.5 - 1e-14]), (1, [0.5, 0.5])]
    got = metrics.auroc_ovo(spark.createDataFrame(rows, "label int, probs array<double>"), (0, 1)).first()
    assert got["AUROC_score"] == 1.0


def test_auroc_by_group(spark):
    rng = random.Random(8)
    rows = [(g, rng.randint(0, 2), [round(rng.random(), 1) for _ in range(3)]) for g in "ab" for _ in range(60)]
    df = spark.createDataFrame(rows, "g string, label int, probs array<double>")
    for r in metrics.auroc_ovo(df, (0, 1, 2), by=["g"]).collect():
        mine = [(label, p) for g, label, p in rows if g == r["g"]]
        assert abs(r["AUROC_score"] - brute_auroc(mine, (0, 1, 2))) < 1e-12


def test_auroc_without_a_class_is_null(spark):
    df = spark.createDataFrame([(0, [0.7, 0.2, 0.1]), (1, [0.1, 0.8, 0.1])], "label int, probs array<double>")
    got = metrics.auroc_ovo(df, (0, 1, 2)).first()
    assert got["AUROC_score"] is None and got["undefined_pairs"] == 4


def test_cross_entropy_is_stable(spark):
    df = spark.createDataFrame([(0, [1000.0, 0.0]), (1, [1000.0, 0.0])], "label int, logits array<double>")
    assert [r["ce"] for r in metrics.with_cross_entropy(df, "label").orderBy("label").collect()] == [0.0, 1000.0]


def test_reported_loss_depends_on_batches_and_mean_does_not(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "batch_id bigint, ce double")
    got = metrics.reported_loss(metrics.batch_losses(df)).first()
    assert (got["loss"], got["mean_loss"]) == (7.0, 3.0)
