"""CSV files cut into many blocks, against the reader that takes a file whole."""

import csv
import io
import random

import pytest

from promptmill.sources import corpus

CELLS = ["", "plain", "two\nlines", 'say ""no""'.replace('""', '"'), "a,b", "\n", "\n\n\n", '"', '",\n"', "x" * 300, "é\n中\n", "NA", "1.0"]


def rows_of(n, seed):
    rng = random.Random(seed)
    return [[str(i), rng.choice(CELLS), "".join(rng.choice(CELLS) for _ in range(rng.randint(0, 4))), rng.choice("ab")] for i in range(n)]


def written(path, rows, end="\n", last=True):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["", "text", "more\ntext", "label"])
    writer.writerows(rows)
    text = out.getvalue()
    path.write_bytes((text if last else text[: -len(end)]).encode())


def want(rows):
    return sorted((int(r[0]), *[c or None for c in r[1:]]) for r in rows)


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def set_to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield set_to
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size, end", [(300, "\n"), (300, "\r\n"), (1 << 20, "\n")])
def test_same_rows_for_any_blocks(spark, tmp_path, small_blocks, size, end):
    a, b = rows_of(50, 1), [[str(1000 + i), *r[1:]] for i, r in enumerate(rows_of(15, 2))]
    written(tmp_path / "a.csv", a, end)
    written(tmp_path / "b.csv", b, end, last=False)
    small_blocks(size)
    got = corpus.read_csv_split(spark, str(tmp_path))
    assert got.columns == ["guid", "text", "more\ntext", "label"]
    assert sorted(map(tuple, got.collect())) == want(a + b)


def test_equals_the_whole_reader_over_blocks(spark, tmp_path, small_blocks):
    written(tmp_path / "a.csv", rows_of(40, 3))
    whole = corpus.read_csv(spark, str(tmp_path / "a.csv"))
    expected = sorted(map(tuple, whole.collect()))
    small_blocks(300)
    assert sorted(map(tuple, corpus.read_csv_split(spark, str(tmp_path / "a.csv")).collect())) == expected


def test_a_cell_over_many_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f"line {i}, with \"quotes\"" for i in range(100))
    rows = [["0", "x", long, "a"], ["1", long, "", "b"], ["2", "y", "z", "a"]]
    written(tmp_path / "a.csv", rows)
    small_blocks(256)
    assert sorted(map(tuple, corpus.read_csv_split(spark, str(tmp_path / "a.csv")).collect())) == want(rows)


def test_join_beyond_the_broadcast_limit(spark, tmp_path, small_blocks, monkeypatch):
    from promptmill.sources import records

    monkeypatch.setattr(records, "broadcast_if_small", lambda df, nbytes: df.hint("merge"))
    rows = rows_of(30, 4)
    written(tmp_path / "a.csv", rows)
    small_blocks(300)
    assert sorted(map(tuple, corpus.read_csv_split(spark, str(tmp_path / "a.csv")).collect())) == want(rows)


def test_blank_lines_and_header_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n,text\n\n0,"a\n\nb"\n\n\n1,c\n\n')
    (tmp_path / "b.csv").write_text(",text\n")
    assert sorted(map(tuple, corpus.read_csv_split(spark, str(tmp_path / "a.csv")).collect())) == [(0, "a\n\nb"), (1, "c")]
    assert corpus.read_csv_split(spark, str(tmp_path / "b.csv")).count() == 0


@pytest.mark.parametrize("body", ['0,a "b" c\n', '0,"a" b\n', '0,a"b\n1,c"d\n', '0,"never closed\n1,x\n'])
def test_other_quotes_fail(spark, tmp_path, body):
    (tmp_path / "a.csv").write_text(",text\n" + body)
    with pytest.raises(Exception, match="a quote"):
        corpus.read_csv_split(spark, str(tmp_path / "a.csv")).collect()


def test_converted_once(spark, tmp_path, small_blocks):
    rows = rows_of(50, 5)
    (tmp_path / "in").mkdir()
    written(tmp_path / "in" / "a.csv", rows)
    small_blocks(500)
    with pytest.raises(Exception):
        corpus.to_parquet(spark, str(tmp_path / "missing"), str(tmp_path / "out"))
    corpus.to_parquet(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
