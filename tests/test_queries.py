"""Every registered query against its SQL, as the driver does, and what their plans must not contain."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from turnwise.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"int": "integer", "string": "varchar"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(contract.oracle_sql()[name])
    types = dict(zip(expected.columns, [str(t).lower() for t in expected.types]))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    got = ordered(tuple(row) for row in df.select(*columns).collect())
    assert got == ordered(expected.select(*[f'"{c}"' for c in columns]).fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Queries that compute in the JVM only, plan included; those that write or train have run by the time they return.
NATIVE = [n for n in QUERIES if n not in ("turn_embedding", "embedding_norm", "batch_infer", "evaluation_run")]


@pytest.mark.parametrize("name", ["answer_requests", "ctx_baseline", "eval_wide", "parse_qa_response", "extract_score"])
def test_no_python_in_native_plans(spark, name):
    assert name in NATIVE
    plan = plan_of(QUERIES[name](spark, SF))
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize(
    "name,columns",
    [
        ("role_alias", "conv_id:bigint,turn:bigint,role:string"),
        ("compression_ratio", "conv_id:bigint,role:string,text:string"),
        ("filter_counts", "conv_id:bigint,role:string,text:string"),
    ],
)
def test_scans_read_the_columns_they_need(spark, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan_of(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["context_stats", "corpus_stats", "position", "compression_ratio", "split_sizes"])
def test_no_conversation_is_put_together_for_counts(spark, name):
    assert "collect_list" not in plan_of(QUERIES[name](spark, SF))


def test_texts_of_a_contexts_table_are_shuffled_once(spark):
    plan = plan_of(QUERIES["answer_requests"](spark, SF))
    assert plan.count("Exchange hashpartitioning(conv_id") == 2  # the conversations, and the parts of long ones
    assert "GreaterThanOrEqual(turn,1024)" in plan
