"""A whole evaluation from JSON files, against a restatement in Python."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from turnwise.plans.evaluation import Models, evaluate, generate_qa, prepare, run
from turnwise.settings import Settings
from turnwise.sources.conversations import land_conversations, read_raw

N = 40


def talks():
    """Forty conversations of one to nine turns; all ids are equal."""

    def turn(i, t):
        return {"from": ("human", "gpt")[t % 2], "value": f"w{i} " * (t + 1)}

    return [{"id": "same", "conversations": [turn(i, t) for t in range(1 + i % 9)]} for i in range(N)]


def models(folder):
    def counted(kind, reply):
        def make():
            def call(messages):
                import uuid

                open(f"{folder}/{kind}-{uuid.uuid4().hex}", "w").close()
                return reply(messages[-1]["content"])

            return call

        return make

    pair = '{"qa_pairs": [{"question": "first?", "answer": "x"}, {"question": "", "answer": "y"}, {"question": "z"}]}'
    return Models(
        qa=counted("qa", lambda text: pair),
        answer=counted("answer", lambda text: str(len(text.split()))),
        judge=counted("judge", lambda text: "Score: " + str(len(text.rsplit("\n", 1)[-1]) % 11)),
        concurrency=3,
    )


def test_whole_evaluation(spark, tmp_path):
    source, root, calls = tmp_path / "talks.json", str(tmp_path / "run"), tmp_path / "calls"
    source.write_text(json.dumps(talks()))
    calls.mkdir()
    small = {"vector_size": 4, "epochs": 1, "min_count": 1, "min_turns": 4}
    settings = Settings(train_ratio=0.2, val_ratio=0.5, truncation_tokens=9, n_samples=7, **small)
    landed = land_conversations(read_raw(spark, [str(source)]), f"{root}/conversations", 4)
    summary = run(landed, root, models(calls), "r", settings).collect()

    order = sorted(
        (hashlib.md5(f"42:{r.conv_id}".encode()).hexdigest(), [t.text for t in r.turns]) for r in landed.collect()
    )
    n_train, n_val = int(len(order) * 0.2), int(len(order) * 0.5)
    val = order[n_train : n_train + n_val]
    scores, ratios = {"oracle": [], "baseline": [], "compressed": []}, []
    for _, texts in val[:7]:
        n = sum(len(t.split()) + 1 for t in texts)
        for name in scores:
            kept = n if name == "oracle" else min(n, 9)
            answer = str(kept + 3)  # "Context:", "Question:" and "first?"
            scores[name].append(float(len("Given answer: " + answer) % 11))
        ratios.append(round(min(n, 9) / n, 4))
    got = {r.method: (r.avg_qa_score, r.avg_compression_ratio, r.n_samples) for r in summary}
    mean = sum(ratios) / 7
    assert got == {k: (sum(v) / 7, pytest.approx(1.0 if k == "oracle" else mean), 7) for k, v in scores.items()}

    results = spark.read.parquet(f"{root}/results").collect()
    assert {(r.conversation_id, r.qa_idx, r.run_id) for r in results} == {("same", 0, "r")} and len(results) == 7
    metrics = {r.metric: r.value for r in spark.read.parquet(f"{root}/metrics").collect()}
    assert metrics["data/train_size"] == n_train and metrics["data/val_size"] == n_val
    words = {w for _, texts in order for t in texts for w in t.split()}
    assert metrics["word2vec/vocab_size"] == len(words)
    assert metrics["eval/oracle/n_samples"] == 7 and metrics["eval/failed_calls"] == 0 and len(metrics) == 14

    def count():
        made = [f.name.split("-")[0] for f in calls.iterdir()]
        return {k: made.count(k) for k in ("qa", "answer", "judge")}

    assert count() == {"qa": n_val, "answer": 21, "judge": 21}
    # A rerun of the same run asks nobody and ends in the same rows.
    again = evaluate(spark, root, models(calls), settings, "r").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, results)) and count()["answer"] == 21


def test_another_corpus_under_the_same_root_gets_its_own_replies(spark, tmp_path):
    def echo():
        import json

        def call(messages):
            last = messages[-1]["content"].rsplit("\n", 1)[-1]
            return json.dumps({"qa_pairs": [{"question": "last?", "answer": last}]})

        return call

    root = str(tmp_path / "root")
    settings = Settings(train_ratio=0.0, val_ratio=1.0, min_turns=1)
    for name in ("a", "b"):
        path = tmp_path / f"{name}.json"
        rows = [{"id": str(i), "conversations": [{"from": "human", "value": f"{name}{i}"}]} for i in range(12)]
        path.write_text(json.dumps(rows))
        landed = land_conversations(read_raw(spark, [str(path)]), f"{root}/conversations-{name}", 1)
        prepare(landed, root, settings)
        generate_qa(spark, root, Models(echo, echo, echo), settings, "val")
        pairs = spark.read.parquet(f"{root}/qa").select("turns", "qa_pairs").collect()
        assert len(pairs) == 12
        assert all(r.qa_pairs[0].answer == f"Human: {r.turns[0].text}" for r in pairs)


def test_a_strategy_of_the_user_s_from_run_to_summary(spark, tmp_path):
    from turnwise.operators.contexts import default_strategies

    source, calls = tmp_path / "talks.json", tmp_path / "calls"
    source.write_text(json.dumps(talks()))
    calls.mkdir()
    settings = Settings(train_ratio=0.2, val_ratio=0.5, truncation_tokens=9, vector_size=4, epochs=1, min_count=1, min_turns=4)
    chosen = default_strategies(9) | {"mine": default_strategies(3)["baseline"]}
    landed = land_conversations(read_raw(spark, [str(source)]), f"{tmp_path}/run/conversations", 1)
    for _ in range(2):  # a rerun replaces the metrics
        summary = run(landed, str(tmp_path / "run"), models(calls), "r", settings, strategies=chosen).collect()
    assert [r.method for r in summary] == ["baseline", "compressed", "mine", "oracle"]
    by = {r.method: r for r in summary}
    assert by["mine"].n_samples == by["oracle"].n_samples > 0
    assert 0 < by["mine"].avg_compression_ratio < by["baseline"].avg_compression_ratio
    assert spark.read.parquet(f"{tmp_path}/run/metrics").count() == 17
    sizes = {r.metric: r.value for r in spark.read.parquet(f"{tmp_path}/run/metrics").collect()}
    assert sum(sizes[f"data/{s}_size"] for s in ("train", "val", "test")) == sum(1 + i % 9 >= 4 for i in range(N))


def test_the_test_split_a_dataset_and_failed_calls(spark, tmp_path):
    """Questions for the test split; then the same conversations as a dataset. Every third answer fails."""
    source, calls, root = tmp_path / "talks.json", tmp_path / "calls", str(tmp_path / "run")
    source.write_text(json.dumps(talks()))
    calls.mkdir()
    given = models(calls)

    def failing():
        from turnwise.operators.inference import ModelError

        def call(messages):
            n = len(messages[-1]["content"].split())
            if n % 3 == 0:
                raise ModelError("busy")
            return str(n)

        return call

    asked = Models(given.qa, failing, given.judge, in_flight=3, label="failing")
    settings = Settings(train_ratio=0.2, val_ratio=0.3, truncation_tokens=9, vector_size=4, epochs=1, min_count=1, min_turns=4)
    landed = land_conversations(read_raw(spark, [str(source)]), f"{root}/conversations", 4)
    summary = {tuple(r) for r in run(landed, root, asked, "t", settings, split="test").collect()}
    enriched = spark.read.parquet(f"{root}/qa")
    assert {r.split for r in enriched.select("split").distinct().collect()} == {"test"}
    n_test = enriched.count()
    assert n_test > 3 and {r[3] for r in summary} == {n_test}
    answers = spark.read.parquet(f"{root}/evaluations/t/answers").collect()
    failed = [r for r in answers if r.status == "api_error"]
    metrics = {r.metric: r.value for r in spark.read.parquet(f"{root}/metrics").collect()}
    assert 0 < len(failed) < len(answers) == 3 * n_test and metrics["eval/failed_calls"] == len(failed)
    again = run(landed, root, asked, "d", settings, dataset=f"{root}/qa/split=test").collect()
    assert {tuple(r) for r in again} == summary
    # Questions for another split leave those of the first.
    generate_qa(spark, root, asked, settings, "val")
    assert {r.split for r in spark.read.parquet(f"{root}/qa").select("split").distinct().collect()} == {"val", "test"}


def test_without_qa_pairs_there_are_no_results(spark, tmp_path):
    rows = evaluate(spark, str(tmp_path), models(tmp_path), Settings(), "r")
    assert rows.isEmpty() and "oracle_score" in rows.columns


def test_frequent_words_are_split_in_the_shuffle_join(spark):
    """A word in every turn must not make one task of the join by shuffle."""
    from turnwise.operators import vectors

    turns = spark.range(60000).select(
        F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.concat(F.lit("the w"), F.col("id")).alias("text")
    )
    words = spark.range(60000).select(F.concat(F.lit("w"), F.col("id")).alias("word"))
    words = words.union(spark.createDataFrame([("the",)], "word string")).withColumn("vector", F.array(F.lit(1.0)))
    changed = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        df = vectors.turn_embeddings(turns, words, 1, broadcast_bytes=0)
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 60000 and all(r.n_known == 2 and r.embedding == [1.0] for r in rows)
    assert "skew=true" in plan
