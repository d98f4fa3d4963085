"""Tables in buckets: joins by their key leave them where they are."""

import re

from pyspark.sql import functions as F

from turnwise.functions.parsing import QA_PAIRS_TYPE
from turnwise.operators import questions, requests, responses
from turnwise.plans import inputs
from turnwise.plans.evaluation import pending_requests
from turnwise.sources import buckets, tables
from turnwise.sources import splits as split_tables

SF = "/root/testdata/sf0.001"
RESPONSE = "request_id string, attempt int, status string, raw_text string, error string"


def exchanges(df):
    """What lies directly under each exchange of a plan, with its columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    found = []
    for i, line in enumerate(lines):
        if re.search(r"\bExchange ", line):
            depth = re.search(r"[A-Za-z*(]", line).start()
            below = [x for x in lines[i + 1 :]]
            part = []
            for x in below:
                at = re.search(r"[A-Za-z*(]", x)
                if not at or at.start() <= depth:
                    break
                part.append(x)
            found.append("\n".join(part))
    return found


def without_broadcasts(spark):
    """Joins as between large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_round_trip_and_layout(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("k"), F.array(F.struct("id")).alias("v"), (F.col("id") % 3).cast("int").alias("p"))
    for n in (4, 2):  # a rewritten table replaces the one before
        got = buckets.write_buckets(df.limit(90 + n), f"{tmp_path}/t", "k", n, "p")
        assert got.count() == 90 + n == spark.read.parquet(f"{tmp_path}/t").count()
    spark.sql(f"DROP TABLE {buckets._table_name(f'{tmp_path}/t')}")  # as another session sees it
    again = buckets.open_buckets(spark, f"{tmp_path}/t")
    assert sorted(map(str, again.select(df.columns).collect())) == sorted(map(str, df.limit(92).collect()))
    plan = again.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_no_prompt_is_moved_to_find_what_is_pending(spark, tmp_path):
    restore = without_broadcasts(spark)
    try:
        sent = tables.write_requests(inputs.answer_requests(spark, SF), f"{tmp_path}/requests")
        assert set(requests.answer_requests(inputs.with_qa(inputs.conversations(spark, SF))).columns) < set(sent.columns)
        replies = inputs.answer_responses(sent).withColumn("error", F.lit(None).cast("string"))
        tables.append_responses(replies.filter(F.col("request_id") < "8").select("request_id", F.col("attempt").cast("int"), "status", "raw_text", "error"), f"{tmp_path}/got")
        got = tables.read_responses(spark, f"{tmp_path}/got")
        ids = responses.unresolved(sent, got, F.col("status") == "ok").withColumn("chunk", tables.chunk_of())
        pending = pending_requests(sent, ids, 3, False)
        whole = pending_requests(sent, ids, 3, True)
        moved = exchanges(pending)
        assert moved and not any("messages" in x for x in moved)
        assert not exchanges(whole)
        expected = sent.filter("chunk = 3 and request_id >= '8'")
        assert sorted(r.request_id for r in pending.collect()) == sorted(r.request_id for r in expected.collect()) != []
        # Nor are questions, when outcomes are put beside requests.
        answers = responses.resolve_answers(sent.drop("kind", "messages", "chunk"), got)
        moved = exchanges(answers)
        assert moved and not any("question" in x for x in moved)
    finally:
        restore()


def test_no_conversation_is_moved_to_be_enriched(spark, tmp_path):
    restore = without_broadcasts(spark)
    try:
        split_tables.write_bucketed_splits(inputs.split_conversations(spark, SF), f"{tmp_path}/splits")
        conversations = split_tables.read_bucketed_split(spark, f"{tmp_path}/splits", "train")
        pairs = F.array(F.struct(F.lit("q").alias("question"), F.lit("a").alias("answer"))).cast(QA_PAIRS_TYPE)
        qa = spark.read.parquet(f"{tmp_path}/splits").filter("shuffle_key < '8'").select("conv_id", pairs.alias("qa_pairs"))
        enriched = questions.enrich(conversations, qa)
        moved = exchanges(enriched)
        assert len(moved) == 1 and "turns" not in moved[0]
        rows = enriched.collect()
        assert {r.split for r in rows} == {"train"} and {r.qa_pairs is not None for r in rows} == {True, False}
        assert all((r.qa_pairs is not None) == (r.shuffle_key < "8") for r in rows)
        assert split_tables.read_splits(spark, f"{tmp_path}/splits").count() == inputs.kept_ids(spark, SF).count()
    finally:
        restore()
