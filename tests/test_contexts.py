import random

import pytest
from pyspark.sql import functions as F

from turnwise.operators import contexts, turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def conversations():
    """Conversations of every kind around a tail of five tokens."""
    rng = random.Random(5)
    rows = []
    for conv_id in range(60):
        for turn in range(rng.choice([1, 2, 3, 5, 9, 20])):
            text = rng.choice([" ", "\n", ""]).join(
                rng.choice(["a", "bb\n", "c\xa0d", "é"]) for _ in range(rng.choice([0, 1, 2, 4, 9]))
            )
            rows.append((conv_id, turn * 3, rng.choice(["human", "gpt", "System prompt", None]), text))
    return rows


def python_contexts(rows, n):
    """The full and the cut transcript of each conversation, restated."""
    lines = {}
    for conv_id, _, role, text in sorted(rows, key=lambda r: r[:2]):
        lines.setdefault(conv_id, []).append(f"{(role or 'unknown').capitalize()}: {text.strip()}")
    full = {k: "\n\n".join(v) for k, v in lines.items()}
    cut = {k: v if len(v.split()) <= n else " ".join(v.split()[-n:]) for k, v in full.items()}
    return full, cut


@pytest.mark.parametrize("n", [1, 2, 5, 30, 1000])
def test_contexts_agree_with_a_restatement(spark, n):
    rows = conversations()
    full, cut = python_contexts(rows, n)
    flat = spark.createDataFrame(rows, SCHEMA).repartition(5)
    long = contexts.contexts(turns.nest_turns(flat), contexts.default_strategies(n)).collect()
    got = {(r.conv_id, r.strategy): (r.context, r.n_tokens) for r in long}
    expected = {}
    for k in full:
        expected[k, "oracle"] = (full[k], len(full[k].split()))
        expected[k, "baseline"] = expected[k, "compressed"] = (cut[k], len(cut[k].split()))
    assert got == expected
    # The flat forms, which never hold a whole conversation.
    assert {r.conv_id: r.context for r in contexts.tail_contexts(flat, n).collect()} == cut
    sizes = {r.conv_id: (r.oracle_tokens, r.baseline_tokens) for r in contexts.context_sizes(flat, n).collect()}
    assert sizes == {k: (len(full[k].split()), len(cut[k].split())) for k in full}


def test_tail_contexts_of_long_enough_conversations(spark):
    rows = conversations()
    flat = spark.createDataFrame(rows, SCHEMA)
    _, cut = python_contexts(rows, 2)
    count = {}
    for r in rows:
        count[r[0]] = count.get(r[0], 0) + 1
    for least in (1, 3, 9, 21):
        got = {r.conv_id: r.context for r in contexts.tail_contexts(flat, 2, least).collect()}
        assert got == {k: v for k, v in cut.items() if count[k] >= least}


def test_only_the_last_turns_are_shuffled(spark, tmp_path):
    spark.createDataFrame(conversations(), SCHEMA).write.parquet(f"{tmp_path}/c")
    flat = spark.read.parquet(f"{tmp_path}/c")
    plan = contexts.tail_contexts(flat, 512)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("Partial") and plan.count("Exchange") == 1
    plan = contexts.context_sizes(flat)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("broadcast_rows", [1 << 20, 0])
def test_parts_before_the_tail_are_left_where_they_are(spark, broadcast_rows):
    """Long conversations among short ones; turns without a number, and parts of uneven sizes."""
    rows = [(c, t, "human", f"w{t}") for c in range(3) for t in range(0, (3, 2500, 9000)[c])]
    rows += [(3, None, "gpt", "none"), *[(3, t * 700, "gpt", "x y") for t in range(40)], *[(4, t, "gpt", "x") for t in range(1024, 1030)]]
    flat = spark.createDataFrame(rows, SCHEMA).repartition(4)
    _, cut = python_contexts([(c, -1 if t is None else t, r, x) for c, t, r, x in rows], 6)
    assert {r.conv_id: r.context for r in contexts.tail_contexts(flat, 6).collect()} == cut
    cuts = {r.conv_id: r.cut for r in contexts.tail_cuts(flat, 7).collect()}
    assert cuts == {1: 2, 2: 8, 3: 22}
    kept = contexts.recent_parts(flat, 7, broadcast_rows)
    assert kept.columns == flat.columns
    counts = {r.conv_id: r.n for r in kept.groupBy("conv_id").agg(F.count("*").alias("n")).collect()}
    # Of the conversation of 9,000 turns there are those of its last part.
    assert counts == {0: 3, 1: 2500 - 2048, 2: 9000 - 8192, 3: 7, 4: 6}


def test_turns_are_counted_without_their_texts(spark, tmp_path):
    spark.createDataFrame(conversations(), SCHEMA).write.parquet(f"{tmp_path}/c")
    plan = contexts.tail_cuts(spark.read.parquet(f"{tmp_path}/c"), 7)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "GreaterThanOrEqual(turn,1024)" in plan


def test_a_tail_needs_a_token(spark):
    with pytest.raises(ValueError):
        contexts.tail_contexts(spark.createDataFrame([], SCHEMA), 0)


def test_compression_ratio_of_nothing_is_zero(spark):
    sizes = spark.createDataFrame([(0, 0), (224, 7), (3, 3)], "oracle_tokens bigint, baseline_tokens bigint")
    got = contexts.with_compression_ratio(sizes).select("compression_ratio").collect()
    assert sorted(r[0] for r in got) == [0.0, 0.0312, 1.0]


def test_a_user_strategy_may_wrap_a_pandas_udf(spark):
    import pandas as pd

    @F.pandas_udf("string")
    def shout(text: pd.Series) -> pd.Series:
        return text.str.upper()

    strategies = contexts.default_strategies() | {"loud": lambda text, found: shout(text)}
    flat = spark.createDataFrame([(1, 0, "human", "a b"), (1, 1, "gpt", "c")], SCHEMA)
    got = {r.strategy: r.context for r in contexts.contexts(turns.nest_turns(flat), strategies).collect()}
    assert got["loud"] == "HUMAN: A B\n\nGPT: C" and got["oracle"] == "Human: a b\n\nGpt: c"
