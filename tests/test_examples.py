import pytest
from pyspark.sql import functions as F

from promptmill.operators.examples import accepted, rejected
from promptmill.sources import corpus, sinks, storage
from promptmill.tasks import TASKS, get_task, literal_parts, resolve_tasks


def test_task_table():
    assert len(TASKS) == 17
    assert sum(t.reads_sentiment for t in TASKS) == 8
    assert get_task("T4SA").verbalizers == ("negative", "neutral", "positive")
    with pytest.raises(NotImplementedError):
        get_task("unknown")


def test_unknown_task_fails_the_job(spark):
    rows = spark.createDataFrame([(1, "nope")], "guid bigint, task string")
    with pytest.raises(Exception, match="unknown task: nope"):
        resolve_tasks(rows).collect()


def test_literals(spark):
    rows = resolve_tasks(spark.createDataFrame([(1, "Sbic_V2_prompt_v3")], "guid bigint, task string"))
    assert rows.select(literal_parts(F.col("pattern")).alias("l")).first()["l"] == ["Hate speech?", "."]


def test_csv_edges(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(
        ',post,label,senti_pre\n7,"two ""words""\nand a line",1,2\n8,NA,0,1\n9,,0,0\n10,null,1,0\n', encoding="utf-8"
    )
    rows = {r["guid"]: r for r in corpus.read_examples(spark, str(path), "sbic_v2").collect()}
    assert rows[7]["text_a"] == 'two "words"\nand a line'
    assert rows[8]["text_a"] == "NA" and rows[10]["text_a"] == "null"
    assert rows[9]["text_a"] is None
    assert (rows[7]["label"], rows[7]["senti_pre"], rows[7]["idx"], rows[7]["meta"]) == (1, 2, -1, {})


def test_missing_column_raises(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(",text,label\n1,a,0\n")
    with pytest.raises(Exception, match="post"):
        corpus.read_examples(spark, str(path), "sbic").collect()


def test_written_csv_reads_back(spark, tmp_path):
    rows = [(1, 'a "b", c\\d'), (2, "x\ny"), (3, None), (4, '"'), (5, "\\")]
    sinks.write_csv(spark.createDataFrame(rows, "guid bigint, text string"), str(tmp_path / "out"))
    assert sorted(map(tuple, corpus.read_csv(spark, str(tmp_path / "out")).collect())) == rows


def test_rejects(spark):
    rows = [
        (1, "a", None, 1, 0, "sbic_v2"),
        (2, None, None, 1, 0, "sbic_v2"),
        (3, "a", None, 2, 0, "sbic_v2"),
        (4, "a", None, 1, 3, "sbic_v2"),
        (5, "a", None, 1, -1, "sbic_v2"),
        (6, "a", None, 1, None, "sbic_v2"),
        (7, "a", None, 2, None, "hatexplain_thr"),
        (8, "a", None, None, 0, "sbic"),
    ]
    schema = "guid bigint, text_a string, text_b string, label int, senti_pre int, task string"
    df = resolve_tasks(spark.createDataFrame(rows, schema))
    assert {r["guid"]: r["label_id"] for r in accepted(df).collect()} == {1: 1, 7: 2}
    assert {r["guid"]: r["reason"] for r in rejected(df).collect()} == {
        2: "null text",
        3: "unknown label",
        4: "sentiment out of range",
        5: "sentiment out of range",
        6: "sentiment out of range",
        8: "unknown label",
    }
    with pytest.raises(Exception, match="unknown label"):
        accepted(df.filter("guid = 3"), strict=True).collect()


def test_write_if_absent_writes_the_whole_set_or_nothing(spark, tmp_path):
    one = spark.range(1).withColumnRenamed("id", "guid")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert sinks.write_if_absent({a: one}, "parquet")
    assert sinks.write_if_absent({a: one.limit(0), b: one}, "parquet")
    assert spark.read.parquet(a).count() == 0
    assert not sinks.write_if_absent({a: one, b: one}, "parquet")
    (tmp_path / "a" / "_SUCCESS").unlink()
    (tmp_path / "a" / "_temporary").mkdir()
    assert sinks.write_if_absent({a: one, b: one}, "parquet")
    assert spark.read.parquet(a).count() == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_a_failed_move_leaves_the_old_set(spark, tmp_path, monkeypatch):
    one = spark.range(1).withColumnRenamed("id", "guid")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    sinks.write_if_absent({a: one, b: one}, "parquet")
    (tmp_path / "b" / "_SUCCESS").unlink()
    rename, moves = storage._rename, []

    def broken(session, source, path):
        moves.append(path)
        if len(moves) == 4:
            raise OSError("broken")
        rename(session, source, path)

    monkeypatch.setattr(storage, "_rename", broken)
    with pytest.raises(OSError, match="broken"):
        sinks.write_if_absent({a: one.limit(0), b: one.limit(0)}, "parquet")
    monkeypatch.setattr(storage, "_rename", rename)
    assert spark.read.parquet(a).count() == spark.read.parquet(b).count() == 1
    assert storage.is_finished(spark, a) and not storage.is_finished(spark, b)


def test_metrics_of_a_repeated_run_are_there_once(spark, tmp_path):
    schema, path = "run string, step bigint, split string, metric string, value double", str(tmp_path / "log")

    def append(*rows):
        sinks.append_metrics(spark.createDataFrame(list(rows), schema), path)

    append(("007", 1, "dev", "loss", 0.5), ("007", 2, "dev", "loss", 0.4), ("b", 1, "dev", "loss", 0.9))
    append(("007", 1, "dev", "loss", 0.5), ("007", 2, "dev", "loss", 0.4))
    append(("007", 2, "dev", "loss", 0.3), ("007", 3, "dev", "loss", 0.2), ("c", 1, "test", "loss", 1.0))
    got = spark.read.schema(schema).parquet(path).collect()
    assert sorted((r["run"], r["step"], r["value"]) for r in got) == [
        ("007", 1, 0.5), ("007", 2, 0.3), ("007", 3, 0.2), ("b", 1, 0.9), ("c", 1, 1.0),
    ]


def test_numbers_written_with_a_point(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(",post,label,senti_pre\n7,a,1.0,2\n8,b,x,0.5\n9,c,0,\n")
    rows = {r["guid"]: (r["label"], r["senti_pre"]) for r in corpus.read_examples(spark, str(path), "sbic_v2").collect()}
    assert rows == {7: (1, 2), 8: (None, None), 9: (0, None)}


def test_sweep_folders_are_pruned(spark, tmp_path):
    rows = spark.range(40).selectExpr("id AS guid", "int(id % 4) AS n", "int(id % 2) AS seed")
    corpus.write_sweep(rows, str(tmp_path / "s"))
    read = corpus.read_sweep(spark, str(tmp_path / "s"), 2, 0)
    assert read.count() == 10
    assert "PartitionFilters: [isnotnull(n" in read._jdf.queryExecution().toString()


def test_paths():
    assert corpus.sweep_file("d/", 16, 9) == "d/16/9.csv"
    assert corpus.sweep_file("d/", 16, 9, True) == "d/16/9_pp50_with_senti_pre.csv"
    assert corpus.sweep_output("o/", 16, 9) == "o/16/9/"
