import pytest
from pyspark.sql import functions as F

from turnwise.operators import contexts, turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ROWS = [
    (1, 0, "human", "hi"),
    (1, 1, "GPT", "  ok \n"),
    (1, 2, "system", "x"),
    (1, 3, "human", ""),
    (1, 4, "human", " \t"),
    (1, 5, "human", "\xa0"),
    (1, 6, "human", None),
    (1, 7, None, "x"),
    (2, 0, "system", "only"),
    (3, 0, "gpt", "one"),
]


@pytest.fixture
def flat(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_valid_turns_keep_role_and_text_as_they_are(flat):
    got = turns.valid_turns(flat).orderBy("conv_id", "turn").collect()
    assert [tuple(r) for r in got] == [ROWS[0], ROWS[1], ROWS[9]]


def test_clean_turns_is_valid_turns_inside_a_conversation(flat):
    inside = turns.flatten_turns(turns.clean_turns(turns.nest_turns(flat)))
    assert inside.exceptAll(turns.valid_turns(flat)).isEmpty()
    assert turns.valid_turns(flat).exceptAll(inside).isEmpty()


def test_length_filter_counts_valid_turns(flat):
    assert turns.filter_counts(flat, 2).first().asDict() == {"kept": 1, "discarded": 2}
    assert {tuple(r) for r in turns.discarded(flat, 2).collect()} == {(2, 0), (3, 1)}
    assert {r.conv_id for r in turns.kept_turns(flat, 2).collect()} == {1}
    nested = turns.at_least(turns.clean_turns(turns.nest_turns(flat)), 2)
    assert [r.conv_id for r in nested.collect()] == [1]
    assert turns.at_least(turns.clean_turns(turns.nest_turns(flat))).isEmpty()  # ten by default


def test_defaults(flat):
    got = turns.with_defaults(flat.filter("turn > 5")).orderBy("turn").collect()
    assert [(r.role, r.text) for r in got] == [("human", ""), ("unknown", "x")]


def test_roles_are_mapped_by_lower_case_and_others_stay(spark):
    df = spark.createDataFrame([(1, 0, "User", "a"), (1, 1, "GPT", "b"), (1, 2, "tool", "c")], SCHEMA)
    got = turns.map_roles(df, {"user": "human"}).orderBy("turn").collect()
    assert [r.role for r in got] == ["human", "GPT", "tool"]


def test_transcript_renders_stripped_text_and_capital_role(flat):
    nested = turns.nest_turns(turns.valid_turns(flat)).filter("conv_id = 1")
    assert nested.select(contexts.transcript(F.col("turns"))).first()[0] == "Human: hi\n\nGpt: ok"


def test_a_conversation_of_many_parts_is_nested_in_order(spark):
    n = 3 * turns.PART_TURNS + 17
    long = spark.range(n).select(
        F.lit(1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.lit("human").alias("role"),
        F.col("id").cast("string").alias("text"),
    )
    short = spark.createDataFrame([(2, 5, "gpt", "b"), (2, 3, "human", "a")], SCHEMA)
    mixed = long.unionByName(short).repartition(7, F.rand(1))
    got = {r.conv_id: r.turns for r in turns.nest_turns(mixed).collect()}
    assert [t.text for t in got[1]] == [str(i) for i in range(n)]
    assert [(t.turn, t.text) for t in got[2]] == [(3, "a"), (5, "b")]
    assert turns.kept_turns(mixed, 3).count() == n and turns.kept_turns(mixed, 2).count() == n + 2
    assert turns.kept_turns(mixed, n).count() == n and turns.kept_turns(mixed, n + 1).isEmpty()
    again = turns.flatten_turns(turns.nest_turns(mixed))
    assert again.exceptAll(mixed).isEmpty() and mixed.exceptAll(again).isEmpty()


def test_turns_without_a_number_and_with_equal_ones_are_kept_alike(spark):
    rows = [(1, None, "human", "x"), (1, None, "gpt", "y"), (1, 3, "human", "b"), (1, 3, "gpt", "a"), (1, 5000, "gpt", "z")]
    flat = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert turns.filter_counts(flat, 5).first().kept == 1
    assert turns.kept_turns(flat, 5).count() == 5
    nested = turns.nest_turns(flat).first().turns
    assert [(t.turn, t.text) for t in nested] == [(None, "y"), (None, "x"), (3, "a"), (3, "b"), (5000, "z")]
    placed = turns.with_position(flat).orderBy("position").collect()
    assert [(r.position, r.text) for r in placed] == [(i, t.text) for i, t in enumerate(nested)]
    for n in range(1, 12):
        tail = contexts.tail_contexts(flat, n).first().context
        strategies = contexts.default_strategies(n)
        whole = contexts.contexts(turns.nest_turns(flat), strategies).filter("strategy = 'baseline'").first().context
        assert tail == whole, n


def test_positions_are_numbered_without_a_whole_conversation(spark, tmp_path):
    n = turns.PART_TURNS + 5
    spark.range(n).selectExpr("1L AS conv_id", "id * 3 AS turn", "'gpt' AS role", "'t' AS text").write.parquet(f"{tmp_path}/t")
    placed = turns.with_position(spark.read.parquet(f"{tmp_path}/t"))
    assert [(r.turn, r.position) for r in placed.orderBy("turn").collect()] == [(3 * i, i) for i in range(n)]
    assert "collect_list" not in placed._jdf.queryExecution().executedPlan().toString()


def test_row_wise_steps_run_on_a_stream(spark, flat, tmp_path):
    flat.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    sink = turns.valid_turns(stream).writeStream.format("parquet")
    job = (
        sink.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    )
    assert job.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_conversations_that_do_not_fit_in_a_value_are_named(spark, tmp_path):
    rows = [(c, t, "human", "x" * 10 * c) for c in range(6) for t in range(3)] + [(9, 0, None, None)]
    flat = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    size = {c: 3 * (5 + 10 * c + 64) for c in range(6)}
    got = {r.conv_id: (r.n_turns, r.n_bytes) for r in turns.too_long(flat, size[3]).collect()}
    assert got == {c: (3, size[c]) for c in (4, 5)}
    assert turns.require_nestable(flat) is flat
    with pytest.raises(ValueError, match=rf"2 conversations are longer than {size[3]} bytes: 5 \(3 turns, {size[5]} bytes\), 4 "):
        turns.require_nestable(flat, size[3])
    flat.write.parquet(f"{tmp_path}/flat")
    plan = turns.too_long(spark.read.parquet(f"{tmp_path}/flat"), 1)._jdf.queryExecution().executedPlan().toString()
    exchange = plan[plan.index("Exchange") :]
    assert plan.count("Exchange") == 1 and "partial_sum" in exchange  # of numbers that were summed before
