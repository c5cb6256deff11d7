import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptmill.operators import scorer
from promptmill.operators.classifier import BUCKETS, predict_logistic, train_logistic
from promptmill.plans import inputs, stages


def corpus_rows(n=120, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    # One word is in a third of all positions.
    pick = lambda: "hot" if rng.random() < 0.34 else rng.choice(words)
    return [(i, rng.randint(0, 2), [pick() for _ in range(rng.randint(0, 40))]) for i in range(n)]


def brute_force(train, rows, classes):
    counts, docs = [Counter() for _ in range(classes)], Counter()
    for _, label, tokens in train:
        counts[label].update(tokens)
        docs[label] += 1
    voc = set().union(*counts)
    out = {}
    for guid, _, tokens in rows:
        units = []
        for k in range(classes):
            u = round(math.log((docs[k] + 1) / (len(train) + classes)) * 1e9)
            for t in tokens:
                if t in voc:
                    u += round(math.log((counts[k][t] + 1) / (sum(counts[k].values()) + len(voc))) * 1e9)
            units.append(u)
        out[guid] = units
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "guid bigint, label int, tokens array<string>")


def scored(df, model, **kw):
    return {r["guid"]: list(r["units"]) for r in scorer.score_cells(df, model, **kw).collect()}


def test_scores_equal_brute_force_on_both_join_paths(spark, monkeypatch):
    train, test = corpus_rows(), corpus_rows(60, 4) + [(900, 0, []), (901, 0, ["never", "seen"])]
    model = scorer.train(scorer.one_model(frame(spark, train), "label", 3), 3)
    want = brute_force(train, test, 3)
    assert scored(frame(spark, test), model) == want
    assert scored(frame(spark, test), model, limit=0) == want
    assert scorer.hot_tokens(model, 500).count() == 5
    assert scored(frame(spark, test), model, limit=500) == want
    monkeypatch.setattr(scorer, "ADDED_AT_ONCE", 7)
    assert scored(frame(spark, test), model) == want
    assert scored(frame(spark, test).repartition(13), model, limit=0) == want
    assert scored(frame(spark, test).coalesce(1), model) == want


def test_repeated_tokens_within_a_row(spark):
    rows = frame(spark, [(1, 0, ["b", "a", "b", "", "a", "b"]), (2, 0, ["x"])])
    got = rows.select("guid", scorer.token_frequencies(F.col("tokens")).alias("f")).collect()
    assert {r["guid"]: [tuple(x) for x in r["f"]] for r in got} == {1: [("", 1), ("a", 2), ("b", 3)], 2: [("x", 1)]}


def test_repeated_keys_stay_apart_in_place_and_fail_a_join(spark):
    rows = frame(spark, [(1, 0, ["good", "good"]), (2, 1, ["bad"])])
    model = scorer.train(scorer.one_model(rows, "label", 2), 2)
    twice = frame(spark, [(7, 0, ["good"]), (7, 0, ["bad", "bad"])])
    assert sorted(r["pred"] for r in scorer.score(twice, model).collect()) == [0, 1]
    with pytest.raises(ValueError, match="share the key guid=7"):
        scorer.score(twice, model, limit=0)


def test_unknown_training_label_fails(spark):
    with pytest.raises(Exception, match="unknown label"):
        scorer.train(scorer.one_model(frame(spark, [(1, 0, ["a"]), (2, 5, ["b"])]), "label", 2), 2)


def test_cells_learn_apart(spark):
    rows = corpus_rows(90)
    cells = spark.createDataFrame(
        [(c, label, tokens) for g, label, tokens in rows for c in ([0, 2] if g < 40 else [2])],
        "cell int, class int, tokens array<string>",
    )
    model = scorer.train(cells, 3)
    test = corpus_rows(20, 8) + [(77, 0, [])]
    got = scorer.score_cells(frame(spark, test), model).collect()
    for cell, train in ((0, rows[:40]), (2, rows)):
        assert {r["guid"]: list(r["units"]) for r in got if r["cell"] == cell} == brute_force(train, test, 3)


def test_tied_logits_take_the_lowest_class(spark):
    rows = frame(spark, [(1, 0, ["a"]), (2, 1, ["a"])])
    model = scorer.train(scorer.one_model(rows, "label", 2), 2)
    assert [r["pred"] for r in scorer.score(rows, model).collect()] == [0, 0]


def test_class_without_rows(spark):
    rows = frame(spark, [(1, 0, ["a"]), (2, 0, ["b"])])
    model = scorer.train(scorer.one_model(rows, "label", 3), 3)
    assert {r["pred"] for r in scorer.score(rows, model).collect()} == {0}


def test_save_and_load(spark, tmp_path):
    rows = frame(spark, corpus_rows())
    model = scorer.train(scorer.one_model(rows, "label", 3), 3)
    scorer.save_scorer(model, str(tmp_path / "m"))
    again = scorer.load_scorer(spark, str(tmp_path / "m"))
    assert (again.classes, again.cell_bytes) == (model.classes, model.cell_bytes)
    assert scored(rows, again) == scored(rows, model)


def test_predictions_join_by_key_and_missing_ones_fail(spark):
    corpus = spark.createDataFrame([(2, "b"), (1, "a")], "guid bigint, text string")
    preds = spark.createDataFrame([(1, 0), (2, 2)], "guid bigint, pred int")
    assert {r["guid"]: r["senti_pre"] for r in scorer.append_predictions(corpus, preds, ["guid"]).collect()} == {1: 0, 2: 2}
    with pytest.raises(Exception, match="no prediction"):
        scorer.append_predictions(corpus, preds.filter("guid = 1"), ["guid"]).collect()


def dirty(spark, sf):
    rows = inputs.examples(spark, sf).withColumn("senti_pre", F.col("senti_gold"))
    return rows.withColumns(
        {
            "text_a": F.when(F.col("guid") % 13 != 0, F.col("text_a")),
            "label": F.when(F.col("guid") % 11 != 0, F.col("label")).otherwise(5),
            "senti_pre": F.when(F.col("guid") % 7 != 0, F.col("senti_pre")),
            "senti_gold": F.when(F.col("guid") % 5 != 0, F.col("senti_gold")).otherwise(9),
        }
    )


def test_no_row_is_lost_in_any_stage(spark, sf):
    rows = dirty(spark, sf)
    every = {r["guid"] for r in rows.select("guid").collect()}
    ids = lambda df: [r["guid"] for r in df.select("guid").collect()]
    held = {r["guid"] for r in rows.filter("split <> 'train'").select("guid").collect()}
    model = stages.learn_sentiment(rows)
    away = ids(stages.sentiment_rejects(rows))
    assert sorted(ids(stages.judge_sentiment(rows, model)) + [g for g in away if g in held]) == sorted(held)
    assert sorted(ids(stages.annotate(rows, model)) + ids(stages.annotate_rejects(rows))) == sorted(every)
    assert sorted(ids(stages.annotate(rows, model, limit=0))) == sorted(ids(stages.annotate(rows, model)))
    away = ids(stages.classify_rejects(rows))
    assert sorted(ids(stages.classify(rows, 16, 9)[1]) + [g for g in away if g in held]) == sorted(held)
    for job in (lambda: stages.annotate(rows, model, strict=True), lambda: stages.classify(rows, 16, 9, strict=True)[1]):
        with pytest.raises(Exception, match="null text|unknown label|sentiment out of range"):
            job().collect()


def test_models_from_outside(spark, sf):
    rows = inputs.examples(spark, sf)
    annotated = stages.annotate(rows, lambda text: (F.length(text) % 3).cast("int"))
    assert annotated.filter("senti_pre <> length(text_a) % 3").count() == 0
    constant = lambda df: df.withColumns({"pred": F.lit(1), "logits": F.array(F.lit(0.0), F.lit(1.0))})
    _, predicted = stages.classify(annotated, 16, 9, model=constant)
    assert predicted.filter("pred <> 1").count() == 0 and predicted.count() == rows.filter("split <> 'train'").count()


def test_in_place_annotation_moves_no_text(spark, sf):
    model = stages.learn_sentiment(inputs.examples(spark, sf))
    plan = stages.annotate(inputs.documents(spark, sf), model, ["guid"], "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1


def test_evaluation_labels_do_not_reach_predictions(spark, sf):
    rows = inputs.examples(spark, sf)
    annotated = stages.annotate(rows, stages.learn_sentiment(rows))
    held = F.col("split") != "train"
    flipped = annotated.withColumn("label", F.when(held, 1 - F.col("label")).otherwise(F.col("label")))
    want = {r["guid"]: r["pred"] for r in stages.classify(annotated, 32, 9)[1].collect()}
    assert {r["guid"]: r["pred"] for r in stages.classify(flipped, 32, 9)[1].collect()} == want


def test_sweep_by_shuffle_equals_one_broadcast(spark, sf):
    rows = inputs.examples(spark, sf).withColumn("senti_pre", F.col("senti_gold"))
    whole = stages.sweep(rows, (16, 64), (9, 99, 11))
    key = ["n", "seed", "split"]
    order = lambda df: [{k: round(v, 9) if k == "loss" else v for k, v in r.asDict().items()} for r in df.orderBy(*key).collect()]
    for limit in (1, 2_000_000):
        assert order(whole) == order(stages.sweep(rows, (16, 64), (9, 99, 11), limit=limit))
    single = stages.classify(rows, 64, 99)[1].filter("split = 'test'")
    right = single.filter("label = pred").count() / single.count()
    mine = whole.filter("n = 64 AND seed = 99 AND split = 'test'").first()
    assert abs(mine["accuracy"] - right) < 1e-12


def test_batch_hook_sees_every_row_once(spark):
    rows = spark.range(50).selectExpr(
        "id AS guid", "array(int(id), 1) AS input_ids", "array(1, 0) AS attention_mask", "array(0, 0) AS token_type_ids", "0 AS mask_pos"
    )

    def factory():
        return lambda batch: [[float((i * m).sum())] for i, m in zip(batch["input_ids"], batch["attention_mask"])]

    got = {r["guid"]: r["logits"] for r in scorer.score_batches(rows, factory).collect()}
    assert got == {i: [float(i)] for i in range(50)}


def test_logistic_trainer_separates_two_words(spark, tmp_path):
    rows = frame(spark, [(i, i % 2, ["yes" if i % 2 else "no", "hot"]) for i in range(40)])
    train_logistic(rows).write.parquet(str(tmp_path / "lr"))
    model = spark.read.parquet(str(tmp_path / "lr"))
    assert model.count() == BUCKETS + 1
    assert all(r["pred"] == r["label"] for r in predict_logistic(model, rows, ["guid", "label"]).collect())


def test_logistic_weights_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = frame(spark, [(i, rng.randint(0, 1), rng.choices(words, k=rng.randint(0, 9))) for i in range(90)])
    models = [sorted(map(tuple, train_logistic(r, steps=3).collect())) for r in (rows.coalesce(1), rows.repartition(7))]
    assert models[0] == models[1] and any(w for _, _, w in models[0])


def test_logistic_without_rows_or_tokens(spark):
    rows = spark.createDataFrame([(1, 1, None), (2, 0, []), (3, None, ["a"]), (4, 7, ["b"])], "guid bigint, label int, tokens array<string>")
    empty = train_logistic(rows.limit(0), steps=2)
    assert {r["weight"] for r in empty.collect()} == {0}
    scored = predict_logistic(train_logistic(rows, steps=2), rows, ["guid"]).collect()
    assert {r["guid"]: r["pred"] for r in scored}.keys() == {1, 2, 3, 4}


def test_batch_hook_keeps_any_key(spark):
    rows = spark.range(9).selectExpr(
        "id AS conv_id", "concat('t', id) AS turn", "array(int(id)) AS input_ids", "array(1) AS attention_mask", "array(0) AS token_type_ids", "0 AS mask_pos"
    )

    def factory():
        return lambda batch: [[float(i[0])] for i in batch["input_ids"]]

    got = scorer.score_batches(rows, factory, ["conv_id", "turn"]).collect()
    assert {(r["conv_id"], r["turn"], r["logits"][0]) for r in got} == {(i, f"t{i}", float(i)) for i in range(9)}


def test_rows_without_tokens_are_scored_whatever_the_limit(spark):
    model = scorer.train(scorer.one_model(frame(spark, [(i, i % 2, ["yes" if i % 2 else "no", f"w{i}"]) for i in range(20)]), "label", 2), 2)
    rows = spark.createDataFrame([(1, None), (2, []), (3, ["w3", "w3", "new", "yes", ""])], "guid bigint, tokens array<string>")
    whole = {r["guid"]: (r["pred"], r["logits"]) for r in scorer.score(rows, model).collect()}
    assert whole.keys() == {1, 2, 3}
    for limit in (0, 300):
        assert {r["guid"]: (r["pred"], r["logits"]) for r in scorer.score(rows, model, limit=limit).collect()} == whole


def test_runs_of_rows_hold_all_rows_and_few_elements():
    lists = pa.array([["a"] * n if n is not None else None for n in [3, 0, None, 9, 1, 1, 1, 1, 0]]).slice(1)
    runs = list(scorer.row_runs(lists, 3))
    assert [x for r in runs for x in r.to_pylist()] == lists.to_pylist()
    assert [len(r.flatten()) for r in runs] == [0, 9, 3, 1]
