from pyspark.sql import functions as F

from turnwise.operators import evaluation

SCORED = (
    "conv_id bigint, qa_idx int, question string, ground_truth string, strategy string, answer string, "
    "score double, n_tokens int"
)


def scored(spark):
    rows = []
    graded = [(1, 0, 8.0, 6.0, 224), (1, 1, 0.0, 5.0, 224), (2, 0, 3.0, 10.0, 0)]
    for conv_id, qa_idx, oracle, compressed, tokens in graded:
        tail = 7 if tokens else 0
        rows += [
            (conv_id, qa_idx, "q", "a", "oracle", "o", oracle, tokens),
            (conv_id, qa_idx, "q", "a", "baseline", None, 4.0, tail),
            (conv_id, qa_idx, "q", "a", "compressed", "c", compressed, tail),
        ]
    return spark.createDataFrame(rows, SCORED).repartition(4)


def test_wide_rows(spark):
    rows = evaluation.result_rows(evaluation.eval_wide(scored(spark))).orderBy("conversation_id", "qa_idx").collect()
    assert [r.recovery_rate for r in rows] == [0.75, 0.0, 3.3333]
    assert [r.compression_ratio for r in rows] == [0.0312, 0.0312, 0.0]  # 0.03125 is a tie, to even
    first = rows[0].asDict()
    assert (first["conversation_id"], first["oracle_answer"], first["baseline_answer"]) == ("1", "o", None)
    assert (first["oracle_tokens"], first["baseline_tokens"], first["baseline_score"]) == (224, 7, 4.0)


def test_the_own_identity_of_a_conversation_is_reported(spark):
    named = scored(spark).withColumn("conversation_id", F.lit("x"))
    rows = evaluation.result_rows(evaluation.eval_wide(named)).collect()
    assert [r.conversation_id for r in rows] == ["x"] * 3


def test_summary_averages_over_questions(spark):
    results = evaluation.result_rows(evaluation.eval_wide(scored(spark)))
    rows = [tuple(r) for r in evaluation.method_summary(results).collect()]
    ratio = (0.0312 + 0.0312 + 0.0) / 3
    assert [r[0] for r in rows] == ["baseline", "compressed", "oracle"]
    assert [(r[1], round(r[2], 12), r[3]) for r in rows] == [
        (4.0, round(ratio, 12), 3),
        (7.0, round(ratio, 12), 3),
        (11.0 / 3, 1.0, 3),
    ]


def test_summary_of_nothing_is_zeros(spark):
    empty = spark.createDataFrame([], evaluation.RESULT_SCHEMA)
    rows = [tuple(r) for r in evaluation.method_summary(empty).collect()]
    assert rows == [(m, 0.0, 0.0, 0) for m in ("baseline", "compressed", "oracle")]
    assert evaluation.eval_count(empty).first().n_results == 0
    metrics = evaluation.flat_metrics(evaluation.method_summary(empty)).collect()
    assert ("eval/oracle/n_samples", 0.0) in [tuple(r) for r in metrics] and len(metrics) == 9


def test_metrics_of_splits_count_missing_ones(spark):
    sizes = spark.createDataFrame([("train", 5)], "split string, n bigint")
    assert {tuple(r) for r in evaluation.split_metrics(sizes).collect()} == {
        ("data/train_size", 5.0),
        ("data/val_size", 0.0),
        ("data/test_size", 0.0),
    }


def test_texts_are_joined_once_and_not_sorted_in_groups(spark, tmp_path):
    scored(spark).write.parquet(f"{tmp_path}/scored")
    df = evaluation.eval_wide(spark.read.parquet(f"{tmp_path}/scored"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("ReadSchema") == 0 and plan.count("question:string") == 1  # one scan reads it
    assert plan.count("answer:string") == 3


def test_questions_without_a_row_of_the_first_strategy(spark):
    rows = scored(spark).filter("not (conv_id = 1 and qa_idx = 1 and strategy = 'oracle')")
    rows = rows.filter("not (conv_id = 2 and strategy in ('oracle', 'baseline'))")
    got = {(r.conv_id, r.qa_idx): r for r in evaluation.eval_wide(rows).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)}
    assert {(r.question, r.ground_truth) for r in got.values()} == {("q", "a")}
    assert got[2, 0].oracle_score is None and got[2, 0].compressed_answer == "c" and got[2, 0].baseline_answer is None
    assert got[1, 1].baseline_score == 4.0 and got[1, 1].recovery_rate == 0.0
