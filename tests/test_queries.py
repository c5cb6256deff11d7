"""All registered queries against a second engine, and the shape of their plans."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from promptmill.plans.oracles import statements
from promptmill.plans.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
ORACLES = statements()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    want = relation.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["guid", "split", "label", "senti_pre", "pred", "prob_yes"]


PLANNED = ["stage3_classify", "stage2_annotate", "sweep_metrics", "encode_padded", "auroc_ovo", "early_stop", "softmax_probs"]


@pytest.mark.parametrize("name", PLANNED)
def test_plans_have_no_all_pairs_join(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_text_is_read_only_where_it_is_used(spark, sf):
    plan = QUERIES["few_shot_sample"](spark, sf)._jdf.queryExecution().toString()
    scans = [line for line in plan.split("== Physical Plan ==")[1].splitlines() if "ReadSchema" in line]
    assert scans and all("text" not in line.split("ReadSchema:")[1] for line in scans)
