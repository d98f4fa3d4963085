"""Skip-gram word vectors, trained in parts: the chance of a word next to another is a softmax against words that are drawn by their
counts. A part has its own sentences and the vectors of its own words;
after each pass what the parts have changed is averaged by word. Vectors go from table to task and back by shuffles only, so
nothing of the model is on the driver, and no task holds more of it than the words of its part."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.sources.scratch import land, scratch_path

POWER = 0.75  # of a word's count, in drawing
RATE, LEAST_RATE = 0.025, 0.0001  # first and last learning rate
BLOCK = 32  # words whose pairs are computed by one product of matrices
DRAWN = 16  # words drawn for a block, against each of its pairs
ONCE = 4  # expected occurrences of the most frequent word between two updates
MOST_BLOCKS = 64  # between two updates
STEADY = 64  # pairs of a word in one update that count in full; of more, their mean as often
ROWS = 4096  # of a batch of vectors
CODES = 1 << 18  # of a row of sentences
SENTENCE, NO_WORD = -1, -2  # among codes: a sentence begins; a null

MODEL = "word string, n bigint, parts array<struct<part:int,code:int,here:bigint>>, vec binary"
PLACED = "part int, code int, word string, here bigint, n bigint, vec binary"
MOVED = "word string, part int, here bigint, vec binary, n bigint, parts array<struct<part:int,code:int,here:bigint>>"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fit(
    tokens: DataFrame, known: DataFrame, vector_size: int, window: int, epochs: int, seed: int, max_sentence_length: int
) -> DataFrame:
    """``(word, n, vector, context)``: both vectors of each word of ``known``, ``(word, n)``. Partitions of ``tokens`` are the parts.

    The table holds values of four bytes. Between table and tasks, values and changes move as two bytes each."""
    spark = tokens.sparkSession
    with shuffles_dropped(spark):
        placed = land(in_parts(tokens), scratch_path(spark, "parts"))
        parts = (placed.agg(F.max("part")).first()[0] or 0) + 1
        chunks = placed.filter(F.col("word").isNull())
        folders = [scratch_path(spark, f"model{i}") for i in (0, 1)]  # the last pass's table and the next one's
        model = land(first_model(placed, known, vector_size, seed), folders[0])
        for epoch in range(epochs):
            sent = model.select("word", "n", "parts", "vec").mapInArrow(to_parts(vector_size), PLACED)
            trained = (
                sent.unionByName(chunks)
                .repartitionById(parts, "part")
                .mapInArrow(one_pass(vector_size, window, epoch, epochs, seed, max_sentence_length), MOVED)
            )
            old = model.withColumns({"part": F.lit(-1), "here": F.lit(0).cast("bigint")})
            moved = trained.unionByName(old).repartition("word").sortWithinPartitions("word", "part")
            model = land(moved.mapInArrow(averaged(vector_size), MODEL), folders[(epoch + 1) % 2])
        schema = "word string, n bigint, vector array<float>, context array<float>"
        return land(model.mapInArrow(unpacked(vector_size), schema), scratch_path(spark, "trained"))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Has Spark delete a job's shuffle files as soon as the job is done: every pass's are as large as the vectors of all parts."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def in_parts(tokens: DataFrame) -> DataFrame:
    """Rows of sentences, numbered by ``code``, with codes of words in ``vec``, and a row for each word of a part, with its code there
    and how often the part has it."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, int] = {}
        here = np.zeros(0, dtype=np.int64)
        part, rows = None, 0
        for batch in batches:
            if not len(batch):
                continue
            part = batch["part"][0].as_py()
            sizes = pc.fill_null(pc.list_value_length(batch["tokens"]), 0).to_numpy()
            coded = batch["tokens"].flatten().dictionary_encode()
            codes = [places.setdefault(w, len(places)) for w in coded.dictionary.to_pylist()]
            codes = np.array([*codes, NO_WORD], dtype=np.int32)[pc.fill_null(coded.indices, len(codes)).to_numpy()]
            here = np.pad(here, (0, len(places) - len(here))) + np.bincount(codes[codes >= 0], minlength=len(places))
            codes = np.insert(codes, np.cumsum(sizes) - sizes, SENTENCE).astype(np.int32)
            for lo in range(0, len(codes), CODES):
                row = [[part], [rows], [None], [None], [None], [codes[lo : lo + CODES].tobytes()]]
                yield _batch(row, _PLACED)
                rows += 1
        names = list(places)
        for lo in range(0, len(names), 1 << 16):
            some = names[lo : lo + (1 << 16)]
            code = np.arange(lo, lo + len(some), dtype=np.int32)
            none = [None] * len(some)
            yield _batch([np.full(len(some), part, dtype=np.int32), code, some, here[code], none, none], _PLACED)

    return tokens.select("tokens", F.spark_partition_id().alias("part")).mapInArrow(encode, PLACED)


def first_model(placed: DataFrame, known: DataFrame, vector_size: int, seed: int) -> DataFrame:
    """Every word of ``known`` with the parts that have it. Its first vector follows from the word and the seed, its second is zero."""
    words = placed.filter(F.col("word").isNotNull()).groupBy("word")
    places = words.agg(F.array_sort(F.collect_list(F.struct("part", "code", "here"))).alias("parts"))
    rows = known.filter(F.col("word").isNotNull()).join(places, "word", "left")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                some = batch.slice(lo, ROWS)
                key = some["key"].to_numpy().view(np.uint64)[:, None]
                draw = _mixed(key + np.arange(vector_size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                both = np.zeros((len(some), 2 * vector_size), dtype=np.float32)
                both[:, :vector_size] = ((draw >> np.uint64(11)) * 2.0**-53 - 0.5) / vector_size
                yield _batch([some["word"], some["n"], some["parts"], _packed(both)], _MODEL)

    return rows.select("word", "n", "parts", F.xxhash64(F.lit(seed), "word").alias("key")).mapInArrow(begin, MODEL)


def to_parts(vector_size: int):
    """Of the model, each word's vectors for every part that has it."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch["vec"], np.float32, vector_size).astype(np.float16)
            row = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(batch["parts"]), 0).to_numpy())
            part, code, here = batch["parts"].flatten().flatten()
            for lo in range(0, len(row), ROWS):
                some, own = row[lo : lo + ROWS], slice(lo, lo + ROWS)
                at = pa.array(some)
                out = [part[own], code[own], batch["word"].take(at), here[own], batch["n"].take(at), _packed(values[some])]
                yield _batch(out, _PLACED)

    return spread


def one_pass(vector_size: int, window: int, epoch: int, epochs: int, seed: int, max_sentence_length: int):
    """A part's pass over its sentences: what it changes of its words' vectors."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chunks, values, part = [], [], [], None
        for batch in batches:
            if not len(batch):
                continue
            part = batch["part"][0].as_py()
            told = pc.is_valid(batch["word"])
            of_words, of_texts = batch.filter(told), batch.filter(pc.invert(told))
            chunks += zip(of_texts["code"].to_pylist(), of_texts["vec"].to_pylist())
            if len(of_words):
                rows.append(of_words.drop_columns(["vec"]))
                values.append(_matrix(of_words["vec"], np.float16, vector_size))
        if not rows or not chunks:
            return
        words = pa.Table.from_batches(rows).combine_chunks()
        order = np.argsort(words["code"].to_numpy())
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        words, before, ends = words.take(pa.array(order)), np.empty((len(order), 2 * vector_size), dtype=np.float16), len(order)
        while values:  # each batch goes once it is copied
            own = values.pop()
            before[rank[ends - len(own) : ends]] = own
            ends -= len(own)
        codes = np.frombuffer(b"".join(x for _, x in sorted(chunks)), dtype=np.int32)
        tokens, sentence = _known_tokens(codes, words["code"].to_numpy(), max_sentence_length)
        inputs, outputs = before[:, :vector_size].astype(np.float32), before[:, vector_size:].astype(np.float32)
        rng = np.random.default_rng([abs(seed), int(seed < 0), epoch, part])
        rates = [RATE - (RATE - LEAST_RATE) * (epoch + x) / epochs for x in (0, 1)]
        if len(tokens):
            learn(tokens, sentence, words["n"].to_numpy(), inputs, outputs, window, rates, rng)
        for lo in range(0, len(words), ROWS):
            some = words.slice(lo, ROWS).combine_chunks()
            change = np.concatenate([inputs[lo : lo + ROWS], outputs[lo : lo + ROWS]], axis=1) - before[lo : lo + ROWS]
            none = [None] * len(some)
            word, here = some["word"].combine_chunks(), some["here"].combine_chunks()
            yield _batch([word, [part] * len(some), here, _packed(change.astype(np.float16)), none, none], _MOVED)

    return train


def _known_tokens(codes: np.ndarray, known: np.ndarray, max_sentence_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of known words (of the sorted codes ``known``), and the number of the sentence each is in; longer ones are cut."""
    sentence = np.cumsum(codes == SENTENCE)
    row = np.full(max(int(codes.max(initial=0)), int(known[-1])) + 1, -1)
    row[known] = np.arange(len(known))
    at = np.where(codes >= 0, row[codes], -1)
    tokens, sentence = at[at >= 0], sentence[at >= 0]
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    place = np.arange(len(tokens)) - np.repeat(first, np.diff(np.append(first, len(tokens))))
    begins = (np.diff(sentence, prepend=-1) != 0) | (place % max_sentence_length == 0)
    return tokens, np.cumsum(begins)


def learn(
    tokens: np.ndarray,
    sentence: np.ndarray,
    n: np.ndarray,
    inputs: np.ndarray,
    outputs: np.ndarray,
    window: int,
    rates: list[float],
    rng: np.random.Generator,
) -> None:
    """One pass, in place. Each word is told from words drawn by their counts, given each word up to ``window`` places off, a reach that is
    drawn anew for every word. The loss of a pair is that of a softmax over the word and those drawn, so scores need no common offset. Blocks of words are computed at once, and updates are added up for some blocks."""
    size, width = len(tokens), inputs.shape[1]
    block = max(BLOCK, 2 * window)
    blocks = -(-size // block)
    per = int(np.clip(ONCE * size / np.bincount(tokens).max() / block, 1, MOST_BLOCKS))
    tok, sen, reach = np.zeros(blocks * block + 2 * window, dtype=np.int64), np.full(blocks * block + 2 * window, -1), np.zeros(blocks * block, dtype=np.int64)
    tok[window : window + size], sen[window : window + size] = tokens, sentence
    reach[:size] = rng.integers(1, window + 1, size)
    chances = np.cumsum(n.astype(np.float64) ** POWER)
    apart = np.abs(np.arange(block + 2 * window)[:, None] - window - np.arange(block))
    apart[apart == 0] = window + 1  # a word is not its own context
    for lo in range(0, blocks, per):
        some = min(per, blocks - lo)
        rate = rates[0] + (rates[1] - rates[0]) * lo / blocks
        centre = np.arange(lo * block, (lo + some) * block).reshape(some, block)
        around = np.arange(lo, lo + some)[:, None] * block + np.arange(block + 2 * window)
        target = tok[centre + window]
        pairs = (apart <= reach[centre][:, None, :]) & (sen[around][:, :, None] == sen[centre + window][:, None, :])
        pairs = pairs.astype(np.float32)  # by block, context and word
        drawn = np.minimum(np.searchsorted(chances, rng.random((some, DRAWN)) * chances[-1], side="right"), len(n) - 1)
        other = (target[:, :, None] != drawn[:, None, :]).astype(np.float32)
        told = np.concatenate([target, drawn], axis=1)
        x, y = inputs[tok[around]], outputs[told]
        chance = np.exp(np.clip(x @ y.transpose(0, 2, 1), -30, 30))
        true, false = chance[:, :, :block], chance[:, :, block:]
        against = false @ other.transpose(0, 2, 1)
        each = pairs / (true + against)
        step = np.concatenate([each * against, -false * (each @ other)], axis=2)
        weight = np.concatenate([pairs, pairs @ other / np.float32(DRAWN)], axis=2)
        change = np.zeros((some * block + 2 * window, width), dtype=np.float32)
        amount = np.zeros(some * block + 2 * window, dtype=np.float32)
        for to, new in ((change, step @ y), (amount, weight.sum(axis=2))):
            # Blocks overlap by twice the window.
            to[: some * block] = new[:, :block].reshape(some * block, *to.shape[1:])
            for i in range(some):
                to[(i + 1) * block : (i + 1) * block + 2 * window] += new[i, block:]
        _add(inputs, tok[lo * block : (lo + some) * block + 2 * window], change, amount, rate)
        _add(outputs, told.ravel(), (step.transpose(0, 2, 1) @ x).reshape(-1, width), weight.sum(axis=1).ravel(), rate)


def _add(values: np.ndarray, rows: np.ndarray, change: np.ndarray, amount: np.ndarray, rate: float) -> None:
    """Add up changes by row. ``amount``: of how many pairs each is the sum."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    held = rate / np.maximum(np.add.reduceat(amount[order], first) / STEADY, 1)
    sums, times = change[order[first]], np.diff(np.append(first, len(rows)))
    many, seen = np.flatnonzero(times > 1), 1
    while len(many):  # as often as a row comes, a few times; faster than reduceat on rows
        sums[many] += change[order[first[many] + seen]]
        seen += 1
        many = many[times[many] > seen]
    values[rows[first]] += sums * held.astype(np.float32)[:, None]


def averaged(vector_size: int):
    """The next model from the last one's rows, each followed by its changes: their mean, by how often a part has the word."""

    def settle(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        part = rows["part"].to_numpy()
        first = np.flatnonzero(part < 0)
        owner = np.cumsum(part < 0) - 1
        changed = np.flatnonzero(part >= 0)
        here = rows["here"].to_numpy().astype(np.float64)
        share = here / np.maximum(np.add.reduceat(here, first), 1)[owner]
        sums = _matrix(rows["vec"].take(pa.array(first)), np.float32, vector_size).astype(np.float64)
        if len(changed):
            moved = _matrix(rows["vec"].take(pa.array(changed)), np.float16, vector_size) * share[changed][:, None]
            whose = np.flatnonzero(np.diff(owner[changed], prepend=-1))
            sums[owner[changed][whose]] += np.add.reduceat(moved, whose, axis=0)
        at = pa.array(first)
        yield _batch([rows["word"].take(at), rows["n"].take(at), rows["parts"].take(at), _packed(sums.astype(np.float32))], _MODEL)

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                some = batch.slice(lo, ROWS).select([f.name for f in _MOVED])
                rows = some if left is None else pa.concat_batches([left, some])
                # The last word's rows may go on.
                end = int(np.flatnonzero(rows["part"].to_numpy() < 0)[-1])
                left = rows.slice(end)
                if end:
                    yield from settle(rows.slice(0, end))
        if left is not None:
            yield from settle(left)

    return average


def unpacked(vector_size: int):
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch["vec"], np.float32, vector_size)
            both = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), vector_size) for x in (values[:, :vector_size], values[:, vector_size:])]
            lists = [x.cast(pa.list_(pa.float32())) for x in both]
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], *lists], names=["word", "n", "vector", "context"])

    return unpack


_PARTS = pa.list_(pa.struct([("part", pa.int32()), ("code", pa.int32()), ("here", pa.int64())]))
_PLACED = pa.schema([("part", pa.int32()), ("code", pa.int32()), ("word", pa.string()), ("here", pa.int64()), ("n", pa.int64()), ("vec", pa.binary())])
_MODEL = pa.schema([("word", pa.string()), ("n", pa.int64()), ("parts", _PARTS), ("vec", pa.binary())])
_MOVED = pa.schema([("word", pa.string()), ("part", pa.int32()), ("here", pa.int64()), ("vec", pa.binary()), ("n", pa.int64()), ("parts", _PARTS)])


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def _matrix(column: pa.Array, kind: type, vector_size: int) -> np.ndarray:
    """Both vectors of each row, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, 2 * vector_size)


def _packed(values: np.ndarray) -> pa.Array:
    """A row of values as bytes."""
    size = values.shape[1] * values.itemsize
    ends = np.arange(len(values) + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _mixed(draw: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        draw = (draw ^ (draw >> np.uint64(shift))) * np.uint64(factor)
    return draw
