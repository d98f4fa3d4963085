"""The registered queries on the given tables: against SQL, brute force, or held-out labels."""

import collections
import glob
import os
import random

import duckdb
import helpers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from turnwise.llm import perplexity
from turnwise.llm.queries import END, ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LABELLED = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


def test_all_are_registered():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(ORACLE[name]).select(*columns).fetchall()
    assert collections.Counter(tuple(r) for r in df.select(*columns).collect()) == collections.Counter(expected)


def test_ngram_join(spark, documents):
    pairs = helpers.links([r.text for r in documents])
    expected = helpers.classes([r.doc_id for r in documents], pairs)
    got = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op4_ngram_join"](spark, SF).collect()}
    assert got == {r.doc_id: e for r, e in zip(documents, expected)}


def test_quality_rules(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op5_quality_rules"](spark, SF).collect()}
    assert len(got) == len(documents)
    for r in documents:
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == helpers.base(r.text)
        assert not (g.kept and g.base_failed)


def test_quality_rules_keep_clean_documents(spark):
    labels = spark.read.parquet(f"{LABELLED}/labels.parquet").where("quality = 1")
    judged = QUERIES["op5_quality_rules"](spark, LABELLED).join(labels, "doc_id").where("not base_failed")
    assert judged.agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.97


def test_quality_rules_reject_texts_that_only_look_right(spark):
    """Shuffled words, salad of the vocabulary, and gibberish, among all documents; the clean ones stay."""
    rng = random.Random(5)
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text", "lang")
    good = {r.doc_id for r in spark.read.parquet(f"{LARGER}/labels.parquet").where("quality = 1").collect()}
    rows = [r for r in docs.where("text is not null").orderBy("doc_id").collect() if len(r.text.split()) >= 150]
    clean = [r for r in rows if r.doc_id in good]
    words = {lang: sorted({w for r in rows if r.lang == lang for w in r.text.split()}) for lang in {r.lang for r in rows}}
    made = []
    for i, r in enumerate(rng.sample(clean, 40)):
        own = r.text.split()
        shuffled = rng.sample(own, len(own))
        salad = rng.choices(words[r.lang], k=len(own))
        noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in own]
        made += [(-3 * i - k, " ".join(w), r.lang) for k, w in enumerate((shuffled, salad, noise), 1)]
    judged = perplexity.judge_quality(docs.unionAll(spark.createDataFrame(made, docs.schema)), keep=["doc_id"])
    got = {r.doc_id: r for r in judged.select("row.doc_id", "kept", "base_failed").collect()}
    for k, least in ((1, 0.95), (2, 1), (3, 1)):
        gone = [not got[-3 * i - k].kept for i in range(40)]
        assert sum(gone) >= least * len(gone), (k, sum(gone))
    stays = [got[r.doc_id].kept for r in clean if not got[r.doc_id].base_failed]
    assert sum(stays) >= 0.97 * len(stays)


def test_token_queries(spark, documents, tokenizer):
    library = Tokenizer.from_file(tokenizer)
    start, expected = 0, []
    for r in documents:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, END]
        expected.append((r.doc_id, start, len(ids), helpers.crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op7_token_files"](spark, SF).collect()) == expected
    counts = {r.doc_id: r.n_tokens for r in QUERIES["op6_token_counts"](spark, SF).collect()}
    library.encode_special_tokens = True
    assert counts == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in documents}


@pytest.mark.parametrize("name,label,limit,least", [("op1_toxicity", "toxic", 0.5, 0.95), ("op10_byte_cnn", "quality", 0.7, 0.93)])
def test_classifiers_on_held_out_labels(spark, name, label, limit, least):
    scored = QUERIES[name](spark, LABELLED)
    assert scored.count() == spark.read.parquet(f"{LABELLED}/documents.parquet").count()
    rows = scored.join(spark.read.parquet(f"{LABELLED}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.predicted == int(r.score >= limit) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r[label] for r in rows) / len(rows) > least


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    outputs = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        path = corpus_pipeline.scratch_path(spark, "test")
        docs = corpus_pipeline.land(docs, path)
        outputs.append(docs)
    good, single, clean, mixed = outputs
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert before.join(labels.where("quality = 1"), "doc_id").join(good, "doc_id", "left_anti").count() <= 3
    # One of each class stays, whole, and nothing else goes.
    rows = good.collect()
    expected = {c for c, _ in helpers.classes([r.doc_id for r in rows], helpers.links([r.text for r in rows]))}
    assert {r.doc_id for r in single.collect()} == expected
    assert single.exceptAll(good).count() == 0
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = single.collect()
    hit = {r.doc_id for r, (_, n, _) in zip(rows, helpers.leaks([r.text for r in rows], items)) if n}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows} - hit
    size = {r.doc_id: len(helpers.words(r.text)) for r in clean.collect()}
    taken = collections.Counter()
    for r in mixed.collect():
        taken[r.doc_id] += len(helpers.words(r.text))
    assert all(n <= 2 * size[d] for d, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < len(size)
    last = corpus_pipeline.STAGES[-1][1](spark, mixed, SF)
    assert last.count() == mixed.count()
