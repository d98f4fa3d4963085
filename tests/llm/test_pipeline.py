"""Every stage of the pipeline on odd rows, on clashing and nested columns, without labels or items, and on no rows at all."""

import collections

import corpus_pipeline
import helpers
import pytest

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    """The other tables the stages read."""
    path = tmp_path_factory.mktemp("tables")
    labels = [(i, i % 2, 0) for i in range(1, 17)] + [(None, 1, 1), (99, 0, 0), (7, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    passage = [r.text for r in odd.where("doc_id = 13").collect()][0].split(" ")[20:50]
    items = [("one", " ".join(passage)), ("two", "Five"), ("none", None), (None, " ")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    odd.write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def bare(spark, none, tmp_path_factory):
    """Tables without rows."""
    path = tmp_path_factory.mktemp("bare")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    none.write.parquet(f"{path}/documents.parquet")
    return str(path)


def rows_of(df):
    return collections.Counter(map(tuple, df.collect()))


def test_quality_stage(spark, odd, folder, bare):
    kept = STAGES["quality classifier"](spark, odd, folder)
    assert kept.columns == odd.columns
    assert not rows_of(kept) - rows_of(odd)
    # Without labels nothing is rejected: the share of label 1 is taken as a half.
    assert rows_of(STAGES["quality classifier"](spark, odd, bare)) == rows_of(odd)


def test_near_copies_stage(spark, odd, folder):
    left = STAGES["n-gram Jaccard join"](spark, odd, folder)
    assert left.columns == odd.columns
    assert not rows_of(left) - rows_of(odd)
    rows = odd.collect()
    pairs = helpers.links([r.text for r in rows])
    linked = {i for pair in pairs for i in pair}
    groups = {c for i, (c, _) in enumerate(helpers.classes([r.doc_id for r in rows], pairs)) if i in linked}
    assert left.count() == len(rows) - len(linked) + len(groups)


def test_benchmark_stage(spark, odd, folder, bare):
    left = STAGES["benchmark decontamination"](spark, odd, folder)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = odd.collect()
    expected = collections.Counter(tuple(r) for r, (_, n, _) in zip(rows, helpers.leaks([r.text for r in rows], items)) if not n)
    assert left.columns == odd.columns and rows_of(left) == expected
    assert 0 < sum(expected.values()) < len(rows)
    assert rows_of(STAGES["benchmark decontamination"](spark, odd, bare)) == rows_of(odd)


def test_mixing_stage(spark, odd, folder):
    docs = odd.withColumnRenamed("size", "n_chars")
    mixed = STAGES["mixing sources"](spark, docs, folder)
    assert mixed.dtypes == docs.dtypes
    size = {r.doc_id: len(helpers.words(r.text)) for r in docs.collect()}
    for r in mixed.collect():
        assert r.n_chars == len(r.text) and 0 < len(helpers.words(r.text)) <= size[r.doc_id]


def test_token_stage(spark, odd, folder):
    found = STAGES["token files"](spark, odd, folder).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(r.doc_id for r in odd.collect())
    assert sorted(r.start for r in found)[0] == 0


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_of_no_rows(spark, none, folder, bare, name):
    for tables in (folder, bare):
        assert STAGES[name](spark, none, tables).count() == 0


def test_run(spark, folder, bare):
    found = corpus_pipeline.run(spark, folder).collect()
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(found[0].asDict())
    start = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert corpus_pipeline.run(spark, bare).count() == 0
