import json
import logging

import pytest
from pyspark.sql import functions as F

from turnwise.operators import splits
from turnwise.sources import conversations as sources
from turnwise.sources import scratch, tables
from turnwise.sources import splits as split_tables


def talk(conv_id, *turns):
    return {"id": conv_id, "conversations": [{"from": r, "value": t} for r, t in turns], "model": "m"}


@pytest.fixture
def files(tmp_path):
    """Two JSON arrays with equal ids, a missing id, bad turns and a conversation that is too short."""
    two = [("human", "hi"), ("system", "x"), ("gpt", "hé\n{1}")]
    first = [talk("a", *two), talk("a", *two), talk("", *two)]
    second = [{"conversations": talk("x", *two)["conversations"]}, talk("b", ("human", " "), ("gpt", "y")), {"id": "c"}]
    paths = []
    for i, content in enumerate((first, second)):
        path = tmp_path / f"part{i}.json"
        path.write_text(json.dumps(content, ensure_ascii=False, indent=2), encoding="utf-8")
        paths.append(str(path))
    return paths


def test_json_arrays_are_read_and_equal_ids_stay_apart(spark, files, tmp_path):
    raw = sources.read_source(spark, data_files=files)
    assert raw.columns == ["id", "conversations"] and raw.count() == 6
    landed = sources.land_conversations(raw, f"{tmp_path}/c", min_turns=2)
    rows = landed.collect()
    assert sorted(r.conversation_id for r in rows) == ["", "", "a", "a"]
    assert len({r.conv_id for r in rows}) == 4
    assert {tuple(t.text for t in r.turns) for r in rows} == {("hi", "hé\n{1}")}
    assert {tuple(t.turn for t in r.turns) for r in rows} == {(0, 2)}
    assert landed.count() == 4 and {r.conv_id for r in landed.collect()} == {r.conv_id for r in rows}
    assert splits.assign_splits(landed).groupBy("split").count().count() == 2  # three in train, one in test


def test_json_lines_and_tables(spark, files, tmp_path):
    raw = sources.read_raw(spark, files)
    raw.write.json(f"{tmp_path}/lines")
    lines = sources.read_source(spark, data_files=[f"{tmp_path}/lines"], json_lines=True)
    assert lines.exceptAll(raw).isEmpty() and lines.count() == 6
    raw.withColumn("split", F.when(F.col("id") == "a", "train").otherwise("rest")).createOrReplaceTempView("talks")
    assert sources.read_source(spark, table="talks").count() == 2
    assert sources.read_source(spark, table="talks", split="rest").count() == 4
    with pytest.raises(ValueError):
        sources.read_source(spark)


def test_splits_round_trip_overwrite_and_prune(spark, tmp_path):
    root = f"{tmp_path}/splits"
    rows = [(1, "é", "train"), (2, "b", "val"), (3, "c", "test")]
    df = spark.createDataFrame(rows, "conv_id int, t string, split string")
    split_tables.write_splits(df.withColumn("t", F.lit("old")), root)
    split_tables.write_splits(df, root)
    assert {tuple(r) for r in split_tables.read_splits(spark, root).collect()} == {tuple(r) for r in df.collect()}
    both = split_tables.read_split(spark, root)
    assert {r.conv_id for r in both.collect()} == {2, 3}
    assert {r.conv_id for r in split_tables.read_split(spark, root, "val").collect()} == {2}
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [split" in plan
    split_tables.write_splits(df, f"{tmp_path}/json", "json")
    assert "é" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "json" / "split=train").glob("*.json"))


def test_missing_splits_are_skipped_unless_all_are(spark, tmp_path, caplog):
    root = f"{tmp_path}/splits"
    with pytest.raises(FileNotFoundError):
        split_tables.read_splits(spark, root)
    df = spark.createDataFrame([(1, "train"), (3, "test")], "conv_id int, split string")
    split_tables.write_splits(df, root)
    with caplog.at_level(logging.WARNING):
        assert split_tables.read_splits(spark, root).count() == 2
    assert "split=val" in caplog.text
    nothing = split_tables.read_eval_dataset(spark, f"{root}/split=val")
    assert nothing.isEmpty() and "qa_pairs" in nothing.columns


def test_runs_replace_themselves_only(spark, tmp_path):
    path = f"{tmp_path}/results"
    tables.write_run(spark.range(3), path, "a")
    tables.write_run(spark.range(5), path, "b")
    tables.write_run(spark.range(2), path, "a")
    assert tables.read_run(spark, path, "a").count() == 2
    assert tables.read_run(spark, path, "b").count() == 5


def test_metrics_of_a_run_and_stage_replace_themselves(spark, tmp_path):
    path = f"{tmp_path}/metrics"
    for run_id, name, value in (("a", "s/m", 1.0), ("b", "s/m", 2.0), ("a", "t/m", 3.0), ("a", "s/m", 4.0)):
        tables.write_metrics(spark.createDataFrame([(name, value)], "metric string, value double"), path, run_id)
    got = [tuple(r) for r in spark.read.parquet(path).select("run_id", "metric", "value").collect()]
    assert sorted(got) == [("a", "s/m", 4.0), ("a", "t/m", 3.0), ("b", "s/m", 2.0)]


def test_conversations_have_the_same_ids_however_they_are_read(spark, tmp_path):
    """Repeated conversations too; with other files and partitions."""
    rows = [{"id": "same", "conversations": [{"from": "human", "value": f"text {i % 30}"}]} for i in range(200)]
    path = tmp_path / "talks.json"
    path.write_text("\n".join(map(json.dumps, rows)))
    once = spark.read.schema(sources.RAW_SCHEMA).json(str(path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    ids = sorted(r.conv_id for r in sources.nested(once).collect())
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        again = sorted(r.conv_id for r in sources.nested(spark.read.schema(sources.RAW_SCHEMA).json(str(path))).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert ids == again and len(set(ids)) == 200


def test_a_split_of_a_table_without_splits_is_an_error(spark):
    spark.range(1).createOrReplaceTempView("no_splits")
    assert sources.read_source(spark, table="no_splits").count() == 1
    with pytest.raises(ValueError, match="no column"):
        sources.read_source(spark, table="no_splits", split="train")


class Session:
    """What ``scratch_path`` asks of a session."""

    def __init__(self, configured, folder=None, master="local[2]"):
        self.configured, self.folder, self.master = configured, folder, master
        self.conf = self.sparkContext = self

    def get(self, name, default):
        return self.configured if name == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_scratch_is_in_the_folder_the_session_names():
    named = Session("hdfs://shared/checkpoints/")
    path = scratch.scratch_path(named, "x")
    assert path.startswith("hdfs://shared/checkpoints/turnwise/x-") and path != scratch.scratch_path(named, "x")
    assert named.folder is None
    assert scratch.scratch_path(Session(None, "hdfs://set"), "x").startswith("hdfs://set/turnwise/x-")
    unset = Session(None)
    path = scratch.scratch_path(unset, "x")
    assert unset.folder and path.startswith(unset.folder)
    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.scratch_path(Session(None, master="spark://host:7077"), "x")
