"""Word vectors: sentences, vocabulary, training, and turns as mean vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.functions import fixed
from turnwise.functions.text import has_words, words
from turnwise.operators import skipgram
from turnwise.sources.scratch import land, scratch_path

# Word vectors up to this size are sent to the tasks, where each Python worker holds them once; of larger ones, those of
# frequent words.
BROADCAST_BYTES = 256 * 1024 * 1024
# Words alone, of a vocabulary, are broadcast up to this size.
BROADCAST_WORD_BYTES = 64 * 1024 * 1024

TRAIN_PARTITIONS = 16
TOKENS_PER_PARTITION = 4_000_000  # of a training task, beyond that many partitions
LEAST_TOKENS = 25_000  # of a training task, up to that many: what parts learn is averaged, and few words teach a part little
MAX_SENTENCE_LENGTH = 10_000
SAMPLE = 1e-3  # share of all words above which a word is left out now and then in training
STAY = 100  # occurrences that stay at least of a word that is left out now and then
GRID = 32  # bits of a vector's values; the sums of 2 ** 30 words, more than a text can hold, stay below 2 ** 63
WORDS_AT_ONCE = 1 << 14  # whose vectors are added up at a time
MODEL_BYTES = 4 << 30


@dataclass(frozen=True)
class WordVectors:
    """Trained vectors: ``(word, n, vector, context)``, a word's count, its vector, and its vector as a word that is told."""

    table: DataFrame


def sentences(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, tokens)``: the words of each flat turn; turns without any are left out."""
    # Tested on the text: a filter on the words would find them a second time.
    worded = turns.filter(has_words(F.col("text")))
    return worded.select("conv_id", "turn", words(F.col("text")).alias("tokens"))


def word_counts(sentences: DataFrame) -> DataFrame:
    """``(word, n)``. Counted before the shuffle, so frequent words cost no more than others."""
    return sentences.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def vocabulary(sentences: DataFrame, min_count: int = fixed.MIN_COUNT) -> DataFrame:
    return word_counts(sentences).filter(F.col("n") >= min_count)


def with_known(counts: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(word, n, known)``: whether a word has a vector."""
    having = vectors.select("word").distinct().withColumn("known", F.lit(True))
    return counts.join(having, "word", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def corpus_stats(turns: DataFrame, assigned: DataFrame) -> DataFrame:
    """Conversations and sentences per split, from flat turns and ``(conv_id, split)``. Sentences are counted per
    conversation before anything is shuffled."""
    counts = turns.groupBy("conv_id").agg(F.count_if(has_words(F.col("text"))).alias("n"))
    return (
        assigned.select("conv_id", "split")
        .join(counts, "conv_id", "left")
        .groupBy("split")
        .agg(F.count("*").alias("n_conversations"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_sentences"))
    )


def train_word2vec(
    sentences: DataFrame,
    vector_size: int = fixed.VECTOR_SIZE,
    window: int = fixed.WINDOW,
    min_count: int = fixed.MIN_COUNT,
    epochs: int = fixed.EPOCHS,
    num_partitions: int | None = None,
    seed: int = fixed.SEED,
    sg: int = 1,
    max_sentence_length: int = MAX_SENTENCE_LENGTH,
    sample: float = SAMPLE,
) -> WordVectors:
    """Skip-gram vectors of the words in ``tokens``. Longer sentences are cut at ``max_sentence_length`` words.

    Sentences are dealt and ordered by their content, not by how the input is partitioned: ``TRAIN_PARTITIONS`` parts, fewer only
    below ``LEAST_TOKENS`` and more only beyond ``TOKENS_PER_PARTITION`` words in each. They are trained side by side, each with the vectors of its own words, and averaged after each
    epoch (``skipgram``), so vectors follow from the data, the seed and the number of parts. Words whose share of all words is above
    ``sample`` are left out of their windows now and then, as word2vec does; 0 keeps all.

    A part may have every word, so a vocabulary whose vectors would take more than ``MODEL_BYTES`` is refused before anything is
    trained: raise ``min_count``, or lower ``vector_size``."""
    if sg != 1:
        raise ValueError("only skip-gram (sg=1) is available")
    spark = sentences.sparkSession
    known = land(vocabulary(sentences, min_count), scratch_path(spark, "vocabulary"))
    n_words, n_tokens = known.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_words * vector_size * 8 > MODEL_BYTES:
        raise ValueError(
            f"{n_words} words of {vector_size} values do not fit a model of {MODEL_BYTES} bytes: raise min_count above {min_count}"
        )
    if not n_words:
        raise ValueError(f"no word occurs {min_count} times: lower min_count")
    if num_partitions is None:
        num_partitions = max(min(TRAIN_PARTITIONS, -(-n_tokens // LEAST_TOKENS)), -(-n_tokens // TOKENS_PER_PARTITION))
    dealt = dealt_sentences(sentences, num_partitions)
    thinned = subsampled(dealt, known, n_tokens, min_count, sample, seed).select("tokens")
    return WordVectors(skipgram.fit(thinned, known, vector_size, window, epochs, seed, max_sentence_length))


def dealt_sentences(sentences: DataFrame, num_partitions: int) -> DataFrame:
    """``(tokens, copy)``: the sentences in an order and a partitioning that depend on their content alone. Equal sentences are
    numbered by counting them, and their numbers scatter them like any others."""
    counted = sentences.groupBy("tokens").agg(F.count("*").alias("copies"))
    rows = counted.select("tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    mixed = rows.withColumn("key", F.xxhash64("tokens", "copy"))
    return mixed.repartition(num_partitions, "key").sortWithinPartitions("key", "tokens", "copy").select("tokens", "copy")


def subsampled(
    dealt: DataFrame, known: DataFrame, n_tokens: int, min_count: int, sample: float, seed: int
) -> DataFrame:
    """``tokens`` without some occurrences of frequent words. A word of share f stays with the chance sqrt(sample / f) + sample / f, drawn
    from the sentence, the place and the seed. Words of which fewer than ``STAY`` would be expected to stay keep all."""
    if not sample:
        return dealt
    often = known.filter(F.col("n") > sample * n_tokens).toArrow()  # 1 / sample rows at most
    share = often["n"].to_numpy() / max(n_tokens, 1)
    stays = np.sqrt(sample / share) + sample / share if len(share) else np.empty(0)
    stays[stays * often["n"].to_numpy() < max(STAY, 10 * min_count)] = 1.0
    shared = dealt.sparkSession.sparkContext.broadcast((often["word"].combine_chunks(), np.append(stays, 1.0)))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, stays = shared.value
        for batch in batches:
            tokens = batch["tokens"]
            sizes = pc.list_value_length(tokens).to_numpy()
            flat = tokens.flatten()
            word = pc.fill_null(pc.index_in(flat, value_set=frequent), len(frequent)).to_numpy()
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            draw = np.repeat(batch["draw"].to_numpy().view(np.uint64), sizes) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                draw = (draw ^ (draw >> np.uint64(shift))) * np.uint64(factor)
            stay = (draw >> np.uint64(11)) * 2.0**-53 < stays[word]
            ends = np.concatenate(([0], np.cumsum(stay)))[np.concatenate(([0], np.cumsum(sizes)))]
            kept = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.filter(pa.array(stay)))
            yield pa.RecordBatch.from_arrays([kept], names=["tokens"])

    drawn = dealt.select("tokens", F.xxhash64(F.lit(seed), "copy", "tokens").alias("draw"))
    return drawn.mapInArrow(thin, "tokens array<string>")


def word_vectors(model: WordVectors) -> DataFrame:
    """``(word, vector array<double>)``."""
    return model.table.select("word", F.col("vector").cast("array<double>").alias("vector"))


def _occurrences(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, word)``, a row per word; a turn without words keeps one row with a null word."""
    return turns.select("conv_id", "turn", F.explode_outer(words(F.col("text"))).alias("word"))


def _counted(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, word, n)``: occurrences counted per turn, for joins that shuffle them."""
    return _occurrences(turns).groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n"))


def token_lookup(turns: DataFrame, vectors: DataFrame, broadcast_bytes: int = BROADCAST_WORD_BYTES) -> DataFrame:
    """``(conv_id, turn, n_tokens, n_known)``: words of each turn, and those that have a vector.

    Words of up to ``broadcast_bytes`` are broadcast, and only two counts per turn are shuffled. Beyond, occurrences are
    counted per turn and joined by shuffle; adaptive execution splits the partitions of frequent words. A word that has
    several vectors is known once."""
    known = vectors.select("word").distinct().withColumn("known", F.lit(True))
    row = 64  # what a hashed row takes beside the word
    if (known.agg(F.sum(F.octet_length("word") + row)).first()[0] or 0) <= broadcast_bytes:
        joined = _occurrences(turns).withColumn("n", F.lit(1)).join(F.broadcast(known), "word", "left")
    else:
        joined = _counted(turns).join(known.hint("shuffle_merge"), "word", "left")
    return joined.groupBy("conv_id", "turn").agg(*_word_sums("known"))


def _word_sums(known: str) -> list[Column]:
    def total(of: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(of).isNotNull(), F.col("n"))), F.lit(0))

    return [total("word").alias("n_tokens"), total(known).alias("n_known")]


def turn_embeddings(
    turns: DataFrame, vectors: DataFrame, vector_size: int, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``(conv_id, turn, n_tokens, n_known, embedding array<float>)``: the mean vector of the known words of each
    flat turn, repeats counted; zeros where no word is known.

    Vectors of up to ``broadcast_bytes`` are sent to the tasks, and turns stay where they are. Of larger ones, those of the most frequent words
    are sent, as many as fit; only words that are not among them are joined by shuffle, and none of these is frequent. Values are rounded once to
    whole multiples of 2 ** -``GRID`` of the greatest, and whole numbers are added up: sums are the same in any order, so every result is
    equal bit by bit whatever the limit. Sizes are summed by Spark before anything is fetched. A word with two vectors, or a vector of
    another size or with a value that is no number, is an error either way."""
    vectors = vectors.select("word", "vector")
    size = F.size("vector")
    missing = F.exists("vector", lambda x: x.isNull())
    seen = vectors.agg(
        F.count("*").alias("n"),
        F.count_if((F.coalesce(size, F.lit(-1)) != vector_size) | F.coalesce(missing, F.lit(True))).alias("odd"),
        F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))).alias("most"),
        F.coalesce(F.max(F.octet_length("word")), F.lit(0)).alias("longest"),
        F.coalesce(F.sum(8 * size + F.octet_length("word")), F.lit(0)).alias("bytes"),
    ).first()
    if seen.odd:
        raise ValueError(f"{seen.odd} of {seen.n} vectors do not have {vector_size} values")
    if seen.most is not None and not math.isfinite(seen.most):
        raise ValueError("a vector has a value that is no finite number")
    twice = vectors.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1").first()
    if twice is not None:
        raise ValueError(f"the word {twice.word!r} has {twice.n} vectors")
    # A power of two, so that nothing but the rounding to whole numbers changes a value.
    scale = 2.0 ** min(GRID - math.frexp(seen.most or 1.0)[1], 1023)
    whole = vectors.select("word", F.transform("vector", lambda x: F.rint(x * scale).cast("bigint")).alias("vector"))
    if seen.bytes <= broadcast_bytes:
        return _embed(turns, whole.toArrow(), vector_size, scale, rest=False)
    return _embed_with_rest(turns, whole, vector_size, scale, broadcast_bytes // (8 * vector_size + seen.longest))


def _embed(turns: DataFrame, vectors: pa.Table, vector_size: int, scale: float, rest: bool) -> DataFrame:
    """With ``rest``, sums instead of means, and the words that were not found with how often a turn has each."""
    matrix = np.asarray(vectors["vector"].combine_chunks().flatten(), dtype=np.int64).reshape(-1, vector_size)
    shared = turns.sparkSession.sparkContext.broadcast((vectors["word"].combine_chunks(), matrix))
    schema = turns.select("conv_id", "turn").schema.add("n_tokens", "long").add("n_known", "long")
    if rest:
        counted = T.StructType().add("word", "string").add("n", "long")
        schema = schema.add("sums", T.ArrayType(T.LongType())).add("missing", T.ArrayType(counted))
    else:
        schema = schema.add("embedding", T.ArrayType(T.FloatType()))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, matrix = shared.value
        for batch in batches:
            tokens = batch["tokens"]
            sizes = pc.list_value_length(tokens).to_numpy()
            flat = tokens.flatten()
            rows = pc.fill_null(pc.index_in(flat, value_set=known_words), -1).to_numpy()
            turn = np.repeat(np.arange(len(tokens)), sizes)
            found, owner = rows[rows >= 0], turn[rows >= 0]
            n_known = np.bincount(owner, minlength=len(tokens)).astype(np.int64)
            sums = np.zeros((len(tokens), matrix.shape[1]), dtype=np.int64)
            # Some words at a time, so that the vectors of a long turn are never all in memory.
            for lo in range(0, len(found), WORDS_AT_ONCE):
                who = owner[lo : lo + WORDS_AT_ONCE]
                first = np.flatnonzero(np.diff(who, prepend=-1))
                sums[who[first]] += np.add.reduceat(matrix[found[lo : lo + WORDS_AT_ONCE]], first, axis=0)
            out = [batch["conv_id"], batch["turn"], pa.array(sizes.astype(np.int64)), pa.array(n_known)]
            if rest:
                out += [_fixed_lists(sums, pa.int64()), _counted_lists(flat, turn, rows < 0, len(tokens))]
            else:
                means = sums.astype(np.float64) / np.maximum(n_known, 1)[:, None] / scale
                out.append(_fixed_lists(means.astype(np.float32), pa.float32()))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    tokens = words(F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", tokens.alias("tokens")).mapInArrow(embed, schema)


def _fixed_lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(kind))


def _counted_lists(flat: pa.Array, turn: np.ndarray, chosen: np.ndarray, n_turns: int) -> pa.Array:
    """For each turn its chosen words, each once, and how often it has them."""
    coded = flat.filter(pa.array(chosen)).dictionary_encode()
    width = max(len(coded.dictionary), 1)
    keys, n = np.unique(turn[chosen] * width + coded.indices.to_numpy(), return_counts=True)
    items = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(keys % width)), pa.array(n.astype(np.int64))], ["word", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(keys, np.arange(n_turns + 1) * width).astype(np.int32)), items)


def _embed_with_rest(turns: DataFrame, vectors: DataFrame, vector_size: int, scale: float, room: int) -> DataFrame:
    """Vectors of the ``room`` most frequent words are broadcast, all others joined by shuffle."""
    spark = turns.sparkSession
    counts = word_counts(turns.select(words(F.coalesce("text", F.lit(""))).alias("tokens")))
    often = vectors.select("word").join(counts, "word").orderBy(F.desc("n"), "word").limit(room).select("word")
    often = land(often, scratch_path(spark, "frequent"))
    hot = vectors.join(often, "word", "left_semi").toArrow()
    rare = vectors.join(often, "word", "left_anti")
    partial = _embed(turns, hot, vector_size, scale, rest=True).withColumn("uid", F.monotonically_increasing_id())
    partial = land(partial, scratch_path(spark, "sums"))  # ids are fixed by being written
    sums = [F.sum(F.get("vector", F.lit(i)) * F.col("n")).alias(f"s{i}") for i in range(vector_size)]
    found = (
        partial.select("uid", F.inline("missing"))
        .join(rare.hint("shuffle_merge"), "word")
        .groupBy("uid")
        .agg(F.sum("n").alias("more"), *sums)
    )
    n_known = F.col("n_known") + F.coalesce("more", F.lit(0))

    def mean(i: int) -> Column:
        total = F.get("sums", F.lit(i)) + F.coalesce(f"s{i}", F.lit(0))
        return total.cast("double") / F.greatest(n_known, F.lit(1)) / scale

    embedding = F.array(*[mean(i) for i in range(vector_size)]).cast("array<float>")
    joined = partial.drop("missing").join(found, "uid", "left")
    return joined.select("conv_id", "turn", "n_tokens", n_known.alias("n_known"), embedding.alias("embedding"))
