import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.functions.numbers import l2_norm
from turnwise.operators import vectors
from turnwise.plans import inputs
from turnwise.sources import vectors as files

SF = "/root/testdata/sf0.001"


def turns(spark):
    texts = ["a b", "a a b", "a zzz", "zzz", "…", "", None, "A, b! a's"]
    rows = [(i // 3, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")


def table(spark):
    return spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vector array<double>")


@pytest.mark.parametrize("broadcast_bytes", [vectors.BROADCAST_BYTES, 0, 100])
def test_mean_of_known_words_in_place_and_by_join(spark, broadcast_bytes):
    got = vectors.turn_embeddings(turns(spark), table(spark), 2, broadcast_bytes).orderBy("turn").collect()
    third = [pytest.approx(2 / 3), pytest.approx(1 / 3)]
    assert [r.embedding for r in got] == [[0.5, 0.5], third, [1, 0], [0, 0], [0, 0], [0, 0], [0, 0], [0.5, 0.5]]
    assert [r.n_tokens for r in got] == [2, 3, 2, 1, 0, 0, 0, 3]
    assert [r.n_known for r in got] == [2, 3, 1, 0, 0, 0, 0, 2]
    lookup = vectors.token_lookup(turns(spark), table(spark), broadcast_bytes).orderBy("turn").collect()
    assert [(r.n_tokens, r.n_known) for r in lookup] == [(r.n_tokens, r.n_known) for r in got]
    norms = [r[0] for r in spark.createDataFrame(got).orderBy("turn").select(l2_norm(F.col("embedding"))).collect()]
    assert norms[0] == pytest.approx(0.5**0.5) and norms[3] == 0.0


def test_every_limit_gives_equal_bits_on_real_turns(spark):
    """All vectors broadcast, none, those of the 30 or so most frequent words."""
    flat, words = inputs.kept_turns(spark, SF), inputs.word_vectors(spark, SF)
    limits = (1 << 28, 0, 30 * 64 * 8)
    ways = [vectors.turn_embeddings(flat, words, 64, b).orderBy("conv_id", "turn").collect() for b in limits]
    assert len(ways[0]) > 0 and any(r.n_known > 5 for r in ways[0])
    assert ways[0] == ways[1] == ways[2]
    # And they are the means, restated.
    known = {r.word: np.array(r.vector) for r in words.collect()}
    texts = flat.select("conv_id", "turn", vectors.words(F.col("text")).alias("tokens")).orderBy("conv_id", "turn").collect()
    for got, said in zip(ways[0], texts):
        found = [known[t] for t in said.tokens if t in known]
        assert got.embedding == pytest.approx(np.mean(found, axis=0) if found else [0] * 64, abs=1e-6)


def test_frequent_words_do_not_reach_the_join(spark):
    turns_ = spark.range(2000).select(
        F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.concat(F.lit("the w"), F.col("id")).alias("text")
    )
    table_ = spark.range(2000).select(F.concat(F.lit("w"), F.col("id")).alias("word"))
    table_ = table_.union(spark.createDataFrame([("the",)], "word string")).withColumn("vector", F.array(F.lit(0.1)))
    whole = vectors._embed_with_rest(turns_, table_.select("word", F.array(F.lit(1).cast("bigint")).alias("vector")), 1, 1.0, 1)
    assert {tuple(r.embedding) for r in whole.collect()} == {(1.0,)} and {r.n_known for r in whole.collect()} == {2}
    partial = [p for p in whole.inputFiles() if "/sums-" in p]
    missing = spark.read.parquet(*partial).select(F.inline("missing")).groupBy("word").agg(F.sum("n").alias("n"))
    assert missing.filter("word = 'the' or n > 1").isEmpty() and missing.count() == 2000


def test_values_that_are_no_numbers_are_an_error(spark):
    for value in (float("nan"), float("inf"), None):
        odd = spark.createDataFrame([("a", [1.0, value])], "word string, vector array<double>")
        with pytest.raises(ValueError):
            vectors.turn_embeddings(turns(spark), odd, 2)


@pytest.mark.parametrize("broadcast_bytes", [vectors.BROADCAST_BYTES, 0])
def test_ambiguous_vectors_are_an_error_at_any_size(spark, broadcast_bytes):
    twice = table(spark).unionAll(table(spark).limit(1))
    with pytest.raises(ValueError, match="2 vectors"):
        vectors.turn_embeddings(turns(spark), twice, 2, broadcast_bytes)
    with pytest.raises(ValueError, match="do not have 3"):
        vectors.turn_embeddings(turns(spark), table(spark), 3, broadcast_bytes)
    counts = vectors.token_lookup(turns(spark), twice, broadcast_bytes).orderBy("turn").collect()
    assert [(r.n_tokens, r.n_known) for r in counts][:3] == [(2, 2), (3, 3), (2, 1)]


def test_training_refuses_a_vocabulary_that_does_not_fit(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MODEL_BYTES", 10)
    with pytest.raises(ValueError, match="min_count"):
        vectors.train_word2vec(vectors.sentences(turns(spark)), min_count=1)


def two_kinds(spark, n=6000):
    """Sentences of two kinds: one of four names amid words that only occur with names of its kind."""
    import random

    rng = random.Random(1)
    names = (["red", "green", "blue", "pink"], ["cat", "dog", "cow", "pig"])
    rows = []
    for i in range(n):
        amid = [f"{'ab'[i % 2]}{rng.randrange(12)}" for _ in range(4)]
        rows.append((i, [*amid[:2], rng.choice(names[i % 2]), *amid[2:]]))
    return spark.createDataFrame(rows, "i int, tokens array<string>"), names


def test_similar_words_are_near(spark):
    """Names of one kind are nearer to each other than to any of the other, by a margin."""
    df, names = two_kinds(spark)
    got = {r.word: np.array(r.vector) for r in vectors.word_vectors(vectors.train_word2vec(df, vector_size=12)).collect()}

    def near(a, b):
        return got[a] @ got[b] / np.linalg.norm(got[a]) / np.linalg.norm(got[b])

    within = min(near(a, b) for kind in names for a in kind for b in kind)
    across = max(near(a, b) for a in names[0] for b in names[1])
    assert within > across + 0.4


def test_vectors_follow_from_data_and_seed_alone(spark):
    df, _ = two_kinds(spark, 900)

    def trained(df, seed=42):
        model = vectors.train_word2vec(df, vector_size=8, epochs=2, seed=seed, num_partitions=1)
        return {r.word: r.vector for r in vectors.word_vectors(model).collect()}

    once = trained(df.repartition(1))
    for n in (4, 8):
        assert trained(df.repartition(n)) == once
    assert trained(df.orderBy(F.desc("i")).coalesce(3)) == once
    assert trained(df, seed=1) != once


def test_frequent_words_are_left_out_now_and_then(spark):
    rows = [(["the"] * 3 + [f"w{i % 200}"],) for i in range(6000)]
    df = spark.createDataFrame(rows, "tokens array<string>")
    known = vectors.vocabulary(df)
    dealt = vectors.dealt_sentences(df, 4)
    kept = vectors.subsampled(dealt, known, 24000, 3, 0.1, 42).collect()
    counts = {}
    for r in kept:
        for t in r.tokens:
            counts[t] = counts.get(t, 0) + 1
    chance = (0.1 / 0.75) ** 0.5 + 0.1 / 0.75
    assert len(kept) == 6000 and counts["the"] == pytest.approx(18000 * chance, rel=0.05)
    assert all(counts[f"w{i}"] == 30 for i in range(200))
    assert vectors.subsampled(dealt, known, 24000, 3, 0.0, 42).count() == 6000
    # Few occurrences are never left out.
    monkey = vectors.subsampled(dealt, known, 24000, 10**6, 0.1, 42).select(F.size("tokens")).distinct().collect()
    assert [r[0] for r in monkey] == [4]


def test_no_vectors_at_all(spark):
    none = table(spark).limit(0)
    for broadcast_bytes in (1 << 20, 0):
        got = vectors.turn_embeddings(turns(spark), none, 2, broadcast_bytes).collect()
        assert len(got) == 8 and all(r.embedding == [0, 0] and r.n_known == 0 for r in got)


def test_sentences_leave_out_turns_without_words(spark):
    got = vectors.sentences(turns(spark)).orderBy("turn").collect()
    assert [r.tokens for r in got] == [["a", "b"], ["a", "a", "b"], ["a", "zzz"], ["zzz"], ["a", "b", "a's"]]
    assert {tuple(r) for r in vectors.vocabulary(vectors.sentences(turns(spark)), 3).collect()} == {("a", 5), ("b", 3)}


def test_training_has_the_vocabulary_and_repeats(spark, tmp_path):
    sentences = inputs.sentences(spark, SF)
    model = vectors.train_word2vec(sentences, vector_size=8, epochs=1, num_partitions=1)
    learned = vectors.word_vectors(model)
    expected = {r.word for r in vectors.vocabulary(sentences).collect()}
    got = {r.word: r.vector for r in learned.collect()}
    assert set(got) == expected and {len(v) for v in got.values()} == {8}
    files.save_word_vectors(model, f"{tmp_path}/w")
    assert {r.word: r.vector for r in files.load_word_vectors(spark, f"{tmp_path}/w").collect()} == got
    assert {r.word: r.vector for r in vectors.word_vectors(files.load_model(f"{tmp_path}/w")).collect()} == got
    again = vectors.train_word2vec(sentences.orderBy("conv_id", "turn"), vector_size=8, epochs=1, num_partitions=1)
    twice = vectors.train_word2vec(sentences.orderBy("conv_id", "turn"), vector_size=8, epochs=1, num_partitions=1)
    assert vectors.word_vectors(again).exceptAll(vectors.word_vectors(twice)).isEmpty()


def test_only_skip_gram(spark):
    with pytest.raises(ValueError):
        vectors.train_word2vec(vectors.sentences(turns(spark)), sg=0)
