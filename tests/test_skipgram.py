import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnwise.operators import skipgram, vectors


def sentences(spark, n=3000):
    rows = [(i, [f"a{i % 7}", f"b{i % 11}", f"a{i % 5}", f"b{i % 3}"] + [f"rare{i}"] * (3 * (i == 5))) for i in range(n)]
    return spark.createDataFrame(rows, "i int, tokens array<string>")


def test_vectors_of_several_parts_repeat_and_stay_out_of_the_driver(spark):
    """Whatever the input's order; every word has both vectors, one that a single part has too."""
    df = sentences(spark)
    before = spark.conf.get(skipgram.CLEANUP, None)

    def trained(rows):
        model = vectors.train_word2vec(rows, vector_size=6, epochs=2, num_partitions=4)
        assert model.table.inputFiles()  # a table, not rows that were fetched
        return {r.word: (r.n, r.vector, r.context) for r in model.table.collect()}

    once = trained(df)
    assert trained(df.orderBy(F.desc("i")).coalesce(3)) == once
    counts = {r.word: r.n for r in vectors.vocabulary(df).collect()}
    assert {w: n for w, (n, _, _) in once.items()} == counts and once["rare5"][0] == 3
    assert all(len(v) == len(c) == 6 and np.isfinite(v + c).all() and any(v) for _, v, c in once.values())
    assert spark.conf.get(skipgram.CLEANUP, None) == before


def test_a_vocabulary_without_words_is_an_error(spark):
    with pytest.raises(ValueError, match="min_count"):
        vectors.train_word2vec(sentences(spark, 2), min_count=1000)


def test_an_update_is_the_gradient_of_every_pair():
    """Restated pair by pair, with the words drawn and the reaches of the same generator."""
    rng = np.random.default_rng(3)
    tokens, sentence = rng.integers(0, 9, 70), np.repeat(np.arange(7), 10)
    n = np.bincount(tokens, minlength=9)
    first, second = [rng.normal(0, 0.5, (9, 4)).astype(np.float32) for _ in range(2)]
    inputs, outputs = first.copy(), second.copy()
    skipgram.learn(tokens, sentence, n, inputs, outputs, 2, [0.1, 0.1], np.random.default_rng(5))
    again = np.random.default_rng(5)
    reach = again.integers(1, 3, 70)
    chances = np.cumsum(n**0.75)
    x, y = first.astype(float), second.astype(float)
    per = int(np.clip(skipgram.ONCE * 70 / n.max() / skipgram.BLOCK, 1, skipgram.MOST_BLOCKS))
    for lo in range(0, 70, per * skipgram.BLOCK):
        blocks = range(lo, min(lo + per * skipgram.BLOCK, 96), skipgram.BLOCK)
        blocks = [b for b in blocks if b < 70]
        drawn = np.searchsorted(chances, again.random((len(blocks), skipgram.DRAWN)) * chances[-1], side="right")
        dx, dy, mx, my = np.zeros_like(x), np.zeros_like(y), np.zeros(9), np.zeros(9)
        for b, words in zip(blocks, drawn):
            for i in range(b, min(b + skipgram.BLOCK, 70)):
                for j in range(max(0, i - reach[i]), min(70, i + reach[i] + 1)):
                    if i == j or sentence[i] != sentence[j]:
                        continue
                    w, others = tokens[i], [z for z in words if z != tokens[i]]
                    scores = np.exp([x[tokens[j]] @ y[z] for z in [w, *others]])
                    told = -scores / scores.sum()
                    told[0] += 1
                    for z, t in zip([w, *others], told):
                        dx[tokens[j]] += t * y[z]
                        dy[z] += t * x[tokens[j]]
                    mx[tokens[j]] += 1 + len(others) / skipgram.DRAWN
                    my[w] += 1
                    np.add.at(my, others, 1 / skipgram.DRAWN)
        x += 0.1 * dx / np.maximum(mx / skipgram.STEADY, 1)[:, None]
        y += 0.1 * dy / np.maximum(my / skipgram.STEADY, 1)[:, None]
    assert inputs == pytest.approx(x, abs=1e-4) and outputs == pytest.approx(y, abs=1e-4)


def test_changes_are_averaged_by_how_often_a_part_has_the_word():
    half = lambda *v: np.array(v, dtype=np.float16).tobytes()
    whole = lambda *v: np.array(v, dtype=np.float32).tobytes()
    parts = [{"part": 0, "code": 4, "here": 3}, {"part": 2, "code": 1, "here": 1}]
    rows = [
        ("a", -1, 0, whole(1, 2), 9, parts),
        ("a", 0, 3, half(0.5, 0), None, None),
        ("a", 2, 1, half(0, 1), None, None),
        ("b", -1, 0, whole(5, 6), 3, None),
    ]
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), skipgram._MOVED)]
    batch = pa.RecordBatch.from_arrays(columns, names=skipgram._MOVED.names)
    cut = [batch.slice(i, 1) for i in range(4)]  # a word's rows may lie in several batches
    for batches in ([batch], cut):
        got = [r for b in skipgram.averaged(1)(iter(batches)) for r in b.to_pylist()]
        assert [(r["word"], r["n"], r["parts"]) for r in got] == [("a", 9, parts), ("b", 3, None)]
        assert [np.frombuffer(r["vec"], np.float32).tolist() for r in got] == [[1.375, 2.25], [5, 6]]


def test_sentences_are_cut_and_unknown_words_left_out():
    codes = np.array([-1, 3, 0, 3, 5, 3, -1, -1, 5, -2, 0], dtype=np.int32)
    tokens, sentence = skipgram._known_tokens(codes, np.array([3, 5]), 3)
    assert tokens.tolist() == [0, 0, 1, 0, 1]
    assert np.diff(sentence).tolist() == [0, 0, 1, 1]
