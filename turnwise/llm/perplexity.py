"""Quality rules: base counts of a text, and n-gram perplexity under a modified Kneser-Ney model of its language.

The model is over bytes that run on from word to word: a text is the UTF-8 bytes of its words, an end mark after each, after start
marks. So it sees how words follow each other, capitals and stops included, not only how they are spelled. No text is scored
by its own counts: texts are in one of two folds by their hash, and each fold is scored by what the other one holds.

There are two perplexities of a text: that of all its bytes, and that of the bytes words begin with. The second one tells how
words follow each other, and little of how they are spelled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.lookups import look_up
from turnwise.llm.words import Words, arrow_bytes, chunks, find_words, run_hashes, scramble
from turnwise.sources.scratch import land, scratch_path

ORDER = 4
SHARED = 1 << 21  # grams, the most frequent ones, that are broadcast at most; all others are joined, with the same result
UNIT = float(1 << 24)  # log probabilities are added up in whole numbers of this part, so in any order
DEVIATIONS = 7.0  # bands end this many standard deviations of a text of that language and length away from the median: names and
START_DEVIATIONS = 4.5  # numbers weigh heavily among all bytes, and little among those that words begin with
BASE_WORDS = 20
BASE_REPEATED = 30
REPEAT_WINDOW = 8
_MARK = 0x20  # ends words and comes before the first, and never occurs in one
_PIECE = 1 << 20  # bytes of a text whose grams are taken at a time
_LEAD = 2  # words that reach back at least ORDER - 1 bytes, marks included
_FLUSH = 1 << 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def _sum_bytes(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[at])


def base_counts(column: pa.Array, words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """Code points in words, symbols, lines equal to an earlier one, and words in windows found twice."""
    lines = find_words(column, _LINE)  # non-empty lines; an empty one has no word
    _, at = arrow_bytes(column)
    data, n = words.data, len(words.offsets) - 1
    upto = np.concatenate(([0], np.cumsum(words.mask)))
    spoken = upto[lines.ends] > upto[lines.starts] if len(lines) else np.zeros(0, bool)
    owner = lines.text_of()[spoken]
    key = np.stack([owner.astype(np.uint64), lines.hashes()[spoken]], axis=1) if len(lines) else np.empty((0, 2), np.uint64)
    distinct = _distinct(key)
    dup = np.bincount(owner, minlength=n) - np.bincount(owner[distinct], minlength=n)

    runs = run_hashes(hashes, REPEAT_WINDOW)
    starts = np.flatnonzero(words.room()[: len(runs)] >= REPEAT_WINDOW)
    text = words.text_of()
    pair = scramble(runs[starts] ^ scramble(text[starts].astype(np.uint64)))
    _, inverse, seen = np.unique(pair, return_inverse=True, return_counts=True)
    twice = starts[seen[inverse] > 1]
    marks = np.zeros(len(words) + 1, np.int32)
    np.add.at(marks, twice, 1)
    np.add.at(marks, np.minimum(twice + REPEAT_WINDOW, len(words)), -1)
    covered = np.cumsum(marks[:-1]) > 0
    return {
        "word_chars": _sum_bytes(words.mask & ((data & 0xC0) != 0x80), at),
        "n_symbols": _sum_bytes(_SYMBOL[data], at),
        "n_dup_lines": dup,
        "n_repeat_words": np.diff(np.concatenate(([0], np.cumsum(covered)))[words.offsets]),
    }


def _distinct(key: np.ndarray) -> np.ndarray:
    """Indexes of the first row of each distinct (owner, hash)."""
    if not len(key):
        return np.empty(0, np.int64)
    return np.unique(scramble(key[:, 1] ^ scramble(key[:, 0].copy())), return_index=True)[1]


def spell(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of a chunk: grams (ORDER bytes as an integer, oldest byte highest), one for each byte to be predicted, and each one's text."""
    size = words.ends - words.starts + 1  # with the end mark
    upto = np.concatenate(([0], np.cumsum(size)))
    owner = words.text_of()
    lo = 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + _PIECE, "right")) - 1)
        text = owner[max(lo - _LEAD, 0) : hi]
        text = text[text >= owner[lo]]  # the lead is of the same text
        at = np.arange(hi - len(text), hi)
        lead = lo - at[0]
        # Start marks before each text; before a text's rest they stand for what the lead makes out of reach.
        begin = np.cumsum(size[at]) - size[at] + (ORDER - 1) * (text - text[0] + 1)
        flat = np.full(int(begin[-1] + size[at[-1]]), _MARK, np.uint64)
        letters = size[at] - 1
        inside = np.arange(int(letters.sum())) - np.repeat(np.cumsum(letters) - letters, letters)
        flat[np.repeat(begin, letters) + inside] = words.data[np.repeat(words.starts[at], letters) + inside]
        told, begin, text = size[at][lead:], begin[lead:], text[lead:]
        place = np.repeat(begin - (np.cumsum(told) - told), told) + np.arange(int(told.sum()))
        rolled = np.zeros(len(flat) - ORDER + 1, np.uint64)
        for k in range(ORDER):
            rolled = (rolled << np.uint64(8)) | flat[k : k + len(rolled)]
        yield rolled[place - (ORDER - 1)], np.repeat(text, told)
        lo = hi


def fold_of(text: Column) -> Column:
    """0 or 1, the same for equal texts."""
    return F.pmod(F.xxhash64(F.lit("fold"), text), F.lit(2))


def gram_counts(docs: DataFrame, text: str, language: Column) -> DataFrame:
    """``lang``, ``gram``, ``n0`` and ``n1``: how often each gram of the highest order occurs in all texts of either fold."""
    body = docs[f"`{text}`"]
    source = docs.select(language.alias("lang"), fold_of(body).alias("fold"), body.alias("text"))
    low = np.uint64(8 * ORDER)

    def run(batches):
        names: list[str] = []
        held: list[tuple] = []
        size = 0

        def merged():
            keys = np.concatenate([k for k, _ in held])
            weights = np.concatenate([w for _, w in held])
            distinct, inverse = np.unique(keys, return_inverse=True)
            return distinct, np.bincount(inverse, weights=weights).astype(np.int64)

        def out(distinct, counts):
            owner = (distinct >> low).astype(np.int64)
            lang = pa.DictionaryArray.from_arrays(pa.array(owner >> 1), pa.array(names, pa.string())).cast(pa.string())
            gram = (distinct & np.uint64((1 << 8 * ORDER) - 1)).astype(np.int64)
            both = [np.where(owner & 1 == fold, counts, 0) for fold in (0, 1)]
            return pa.RecordBatch.from_arrays([lang, pa.array(gram), *[pa.array(n) for n in both]], ["lang", "gram", "n0", "n1"])

        for batch in batches:
            for part in chunks(batch, "text"):
                code = part.column("lang").dictionary_encode()
                local = []
                for name in code.dictionary.to_pylist():
                    if name not in names:
                        names.append(name)
                    local.append(names.index(name))
                owner = np.array(local)[code.indices.to_numpy()] * 2 + part.column("fold").to_numpy()
                for grams, of in spell(find_words(part.column("text"))):
                    distinct, counts = np.unique((owner[of].astype(np.uint64) << low) | grams, return_counts=True)
                    held.append((distinct, counts))
                    size += len(distinct)
                if size > _FLUSH:
                    distinct, counts = merged()
                    held, size = [(distinct, counts)], len(distinct)
                    if size > _FLUSH // 2:
                        yield out(distinct, counts)
                        held, size = [], 0
        if held:
            yield out(*merged())

    counted = source.mapInArrow(run, "lang string, gram bigint, n0 bigint, n1 bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _discounts(grams: DataFrame) -> DataFrame:
    """Kneser-Ney discounts of a language by fold, for counts of 1, 2 and 3 or more, and ``grams``, its number of rows."""
    folds = (0, 1)
    seen = [F.sum((F.col(f"n{f}") == i).cast("double")).alias(f"s{f}{i}") for f in folds for i in range(1, 5)]

    def discount(f, i, usual):
        y = F.try_divide(F.col(f"s{f}1"), F.col(f"s{f}1") + 2 * F.col(f"s{f}2"))
        value = i - F.try_divide((i + 1) * y * F.col(f"s{f}{i + 1}"), F.col(f"s{f}{i}"))
        return F.when((value > 0) & (value < i), value).otherwise(usual).alias(f"d{f}{i}")

    found = grams.groupBy("lang").agg(F.count("*").alias("grams"), *seen)
    return found.select("lang", "grams", *[discount(f, i, usual) for f in folds for i, usual in ((1, 0.5), (2, 1.0), (3, 1.5))])


def train(counts: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``n``, ``p0`` and ``p1`` of every gram of the highest order: its count, and the probability of its last byte
    after the others by what fold 0 and fold 1 hold.

    The highest order takes counts; each lower one counts the distinct bytes found before its grams. Discounts are
    estimated for each language, fold and order. A gram has a row whichever fold holds it: the other fold's probability is
    what shorter contexts leave, down to 1/256 for a byte its language has not. Whoever scores a text of either fold finds
    all its grams."""
    spark = counts.sparkSession
    levels = {ORDER: land(counts, scratch_path(spark, f"grams-{ORDER}"))}
    for order in range(ORDER - 1, 0, -1):
        shorter = levels[order + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram"))
        distinct = [F.sum((F.col(f"n{f}") > 0).cast("long")).alias(f"n{f}") for f in (0, 1)]
        levels[order] = land(shorter.agg(*distinct), scratch_path(spark, f"grams-{order}"))
    below = None
    for order in range(1, ORDER + 1):
        # A language may have most of the grams.
        discounts = land(_discounts(levels[order]), scratch_path(spark, f"discounts-{order}"))
        grams = look_up(levels[order], discounts, "lang", "grams", levels[order].count())
        grams = grams.withColumn("context", F.shiftright("gram", 8))
        for f in (0, 1):
            n = F.col(f"n{f}")
            less = F.when(n == 0, 0.0).when(n == 1, F.col(f"d{f}1")).when(n == 2, F.col(f"d{f}2")).otherwise(F.col(f"d{f}3"))
            grams = grams.withColumn(f"less{f}", less)
        sums = [F.sum(f"{c}{f}").alias(f"{a}{f}") for c, a in (("n", "total"), ("less", "spared")) for f in (0, 1)]
        grams = grams.join(grams.groupBy("lang", "context").agg(*sums), ["lang", "context"])
        if below is None:
            grams = grams.withColumns({"q0": F.lit(1 / 256), "q1": F.lit(1 / 256)})
        else:
            grams = grams.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1)))
            shorter = below.select("lang", F.col("gram").alias("suffix"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
            grams = grams.join(shorter, ["lang", "suffix"])

        def probability(f):
            own = F.try_divide(F.col(f"n{f}") - F.col(f"less{f}") + F.col(f"spared{f}") * F.col(f"q{f}"), F.col(f"total{f}"))
            return F.coalesce(own, F.col(f"q{f}")).alias(f"p{f}")

        made = grams.select("lang", "gram", (F.col("n0") + F.col("n1")).alias("n"), probability(0), probability(1))
        below = land(made, scratch_path(spark, f"model-{order}"))
    return below


@dataclass
class Model:
    """Sorted 64-bit keys of (language, gram), and log probabilities by either fold in whole numbers of 1 / ``UNIT``.

    ``first`` tells where the keys of each prefix of ``64 - shift`` bits begin; there are more prefixes than keys, so few share one."""

    keys: np.ndarray
    said: np.ndarray
    first: np.ndarray
    shift: np.uint64

    @classmethod
    def of(cls, keys: np.ndarray, said: np.ndarray) -> Model:
        order = np.argsort(keys)
        keys = keys[order]
        bits = len(keys).bit_length() + 1
        shift = np.uint64(64 - bits)
        first = np.searchsorted(keys >> shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        return cls(keys, said[:, order], first, shift)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is, and whether it is there."""
        prefix = (keys >> self.shift).astype(np.int64)
        at, end = self.first[prefix].astype(np.int64), self.first[prefix + 1]
        found = np.zeros(len(keys), bool)
        todo = np.flatnonzero(at < end)
        while len(todo):
            hit = self.keys[at[todo]] == keys[todo]
            found[todo[hit]] = True
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return at, found


def gram_keys(seed: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Of one language, different for different grams; of several, equal with the chance of 64-bit hashes."""
    return scramble(gram ^ seed)


def begins_word(gram):
    """Whether the byte a gram predicts is a word's first one; for arrays and columns."""
    before = gram.bitwiseAND(F.lit(0xFF00)) if isinstance(gram, Column) else gram & np.uint64(0xFF00)
    return before == _MARK << 8


def _said(p: str) -> Column:
    return F.round(F.log(p) * UNIT).cast("long")


def model_of(trained: DataFrame) -> Model:
    """Fetches all rows it is given, of 32 bytes each on their way."""
    got = trained.select(F.xxhash64(F.lit("language"), "lang").alias("seed"), "gram", _said("p0").alias("said0"), _said("p1").alias("said1")).toArrow()
    seed, gram, *said = (got.column(c).to_numpy().astype(np.int64) for c in ("seed", "gram", "said0", "said1"))
    keys = gram_keys(seed.view(np.uint64), gram.astype(np.uint64))
    return Model.of(keys, np.stack(said))


def split_grams(trained: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """At most ``SHARED`` grams, those of the greatest counts, and the rest, if there is one."""
    bits = F.length(F.bin("n"))
    sizes = {r.bits: r.grams for r in trained.groupBy(bits.alias("bits")).agg(F.count("*").alias("grams")).collect()}  # 64 rows at most
    least, room = 65, SHARED
    for bit in sorted(sizes, reverse=True):
        if sizes[bit] > room:
            return trained.where(bits >= least), trained.where(bits < least)
        least, room = bit, room - sizes[bit]
    return trained, None


def _lists(pairs: np.ndarray, texts: int) -> list[pa.Array]:
    """For each text its distinct grams and how often it has each, from text and gram of every occurrence."""
    distinct, many = np.unique(pairs, return_counts=True)
    bounds = np.arange(texts + 1, dtype=np.uint64) << np.uint64(8 * ORDER)
    offsets = pa.array(np.searchsorted(distinct, bounds).astype(np.int32))
    grams = (distinct & np.uint64((1 << 8 * ORDER) - 1)).astype(np.int64)
    return [pa.ListArray.from_arrays(offsets, pa.array(grams)), pa.ListArray.from_arrays(offsets, pa.array(many.astype(np.int64)))]


def _with_rest(judged: DataFrame, rest: DataFrame) -> DataFrame:
    """Adds what the grams that were not broadcast say. Equal texts of a language share a key and are joined once."""
    once = judged.where(F.size("grams") > 0).groupBy("key").agg(*[F.first(c).alias(c) for c in ("lang", "fold", "grams", "many")])
    pairs = once.select("key", "lang", "fold", F.explode(F.arrays_zip("grams", "many")).alias("pair")).select("key", "lang", "fold", "pair.*")
    pairs = pairs.withColumnsRenamed({"grams": "gram", "many": "times"})
    each = F.when(F.col("fold") == 0, F.col("said1")).otherwise(F.col("said0"))
    rest = rest.select("lang", "gram", _said("p0").alias("said0"), _said("p1").alias("said1"))
    each = each * F.col("times")
    begins = F.when(begins_word(F.col("gram")), each)
    more = pairs.join(rest, ["lang", "gram"]).groupBy("key").agg(F.sum(each).alias("more"), F.sum(begins).alias("more_starts"))
    return judged.join(more, "key", "left").withColumns({c: F.col(c) + F.coalesce(more, F.lit(0)) for c, more in (("said", "more"), ("said_starts", "more_starts"))})


def _bands(judged: DataFrame, surprise: str, steps: str) -> DataFrame:
    """``lang``, ``texts``, and for a log perplexity of ``steps`` bytes ``middle`` (its median), ``noise`` (deviation of one byte's) and
    ``between`` (variance of texts' own means), named after it.

    The deviation of a text of n bytes is taken as sqrt(between + noise^2 / n). Noise comes from the shorter half of a
    language's texts, where it outweighs all else; what it leaves of the deviation of the longest quarter is between. All
    deviations are medians of distances, so bad texts do not widen the bands they are to be caught by."""
    spark = judged.sparkSession
    said = judged.where(F.col(surprise).isNotNull()).select("lang", F.col(surprise).alias("surprise"), F.col(steps).alias("steps"))
    usual = said.groupBy("lang").agg(
        F.count("*").alias("texts"),
        F.percentile_approx("surprise", 0.5, 10000).alias("middle"),
        F.percentile_approx("steps", [0.5, 0.75], 10000).alias("long"),
    )
    usual = land(usual, scratch_path(spark, "usual"))
    off = look_up(said, usual, "lang", "texts", judged.count()).withColumn("off", F.abs(F.col("surprise") - F.col("middle")) / 0.6745)
    short, longest = F.col("steps") <= F.col("long")[0], F.col("steps") >= F.col("long")[1]
    found = off.groupBy("lang").agg(
        F.percentile_approx(F.when(short, F.col("off") * F.sqrt("steps")), 0.5, 10000).alias("noise"),
        F.percentile_approx(F.when(longest, F.col("off")), 0.5, 10000).alias("all"),
        F.avg(F.when(longest, 1 / F.col("steps"))).alias("less"),
    )
    between = F.greatest(F.lit(0.0), F.col("all") * F.col("all") - F.col("noise") * F.col("noise") * F.col("less"))
    numbers = [F.col("middle").alias(f"{surprise}_middle"), F.col("noise").alias(f"{surprise}_noise"), between.alias(f"{surprise}_between")]
    return land(usual.join(found, "lang").select("lang", "texts", *numbers), scratch_path(spark, "bands"))


def judge_quality(
    docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None, deviations: tuple[float, float] = (DEVIATIONS, START_DEVIATIONS)
) -> DataFrame:
    """``row`` (struct of a document's columns), ``n_words``, the base counts, ``base_failed``, ``perplexity``, ``lower``, ``upper``,
    ``start_perplexity``, ``start_lower``, ``start_upper`` (of words' first bytes) and ``kept``: not base_failed, and both
    perplexities within their bands.

    The model is counted by Spark over all texts, by fold: tasks add up the grams of their chunks, and only sums are shuffled. A text is
    scored by the fold it is not in, so neither it nor its copies speak for it. The ``SHARED`` most frequent grams are
    broadcast, and if there are more, those of each text that are not among them are joined to the model. Sums are of
    whole numbers, the same either way. A language's bands are around its median log perplexities, ``deviations`` (of all bytes, and of
    words' first ones) wide on either side in standard deviations of a text of that length (see ``_bands``).
    A null language is one of its own. Null and empty texts have no words, no perplexity and fail the base rules. Repeated
    rows are judged alike, and count as often as they occur. An empty table gives an empty result. In a language of one fold only,
    every byte is as unlikely as any other. A task needs about 60 bytes for each byte of its longest word, or of a million."""
    spark = docs.sparkSession
    keep = list(docs.columns if keep is None else keep)
    language = F.concat(F.lit("="), F.col(f"`{lang}`"))  # distinct from the empty string that stands for null
    language = F.coalesce(language, F.lit(""))
    often, rest = split_grams(train(gram_counts(docs, text, language)))
    shared = spark.sparkContext.broadcast(model_of(often))
    body = F.col(f"`{text}`")
    key = F.struct(F.xxhash64(language, body).alias("one"), F.xxhash64(F.lit(7), language, body).alias("two")) if rest is not None else F.lit(0)
    source = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        language.alias("lang"),
        F.xxhash64(F.lit("language"), language).alias("seed"),
        fold_of(body).alias("fold"),
        key.alias("key"),
        body.alias("text"),
    )
    counted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    numbers = [F.lit(0).cast("long").alias(c) for c in [*counted, "steps", "said", "said_starts"]]
    lists = [F.array(F.lit(0).cast("long")).alias(c) for c in ("grams", "many")]
    schema = source.select("row", "lang", "fold", "key", *numbers, *lists).schema

    low = np.uint64(8 * ORDER)

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                column = part.column("text")
                words = find_words(column)
                base = base_counts(column, words, words.hashes())
                seeds, owner = np.unique(part.column("seed").to_numpy(), return_inverse=True)
                fold = part.column("fold").to_numpy()
                texts = len(words.offsets) - 1
                said, starts, steps = (np.zeros(texts, np.int64) for _ in range(3))
                missing = [np.empty(0, np.uint64)]
                for grams, of in spell(words):
                    at, found = model.find(gram_keys(seeds.view(np.uint64)[owner[of]], grams))
                    value = np.zeros(len(grams), np.int64)
                    value[found] = model.said[1 - fold[of[found]], at[found]]
                    # Whole numbers far below 2**53, so floats add them up exactly.
                    said += np.bincount(of, weights=value, minlength=texts).astype(np.int64)
                    first = begins_word(grams)
                    starts += np.bincount(of[first], weights=value[first], minlength=texts).astype(np.int64)
                    steps += np.bincount(of, minlength=texts)
                    if not found.all():
                        miss = ~found
                        missing.append((of[miss].astype(np.uint64) << low) | grams[miss])
                arrays = [pa.array(words.counts.astype(np.int64)), *[pa.array(base[c].astype(np.int64)) for c in counted[1:]]]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in ("row", "lang", "fold", "key")],
                        *arrays,
                        pa.array(steps),
                        pa.array(said),
                        pa.array(starts),
                        *_lists(np.concatenate(missing), texts),
                    ],
                    ["row", "lang", "fold", "key", *counted, "steps", "said", "said_starts", "grams", "many"],
                )

    judged = land(source.mapInArrow(run, schema), scratch_path(spark, "perplexity"))
    if rest is not None:
        judged = land(_with_rest(judged, rest), scratch_path(spark, "perplexity"))
    judged = judged.drop("grams", "many")
    kinds = {"surprise": ("said", "steps", ""), "start_surprise": ("said_starts", "n_words", "start_")}
    for surprise, (said, steps, _) in kinds.items():
        judged = judged.withColumn(surprise, -F.col(said) / UNIT / F.nullif(steps, F.lit(0)))
    bands = _bands(judged, "surprise", "steps").join(_bands(judged, "start_surprise", "n_words").drop("texts"), "lang")
    out = look_up(judged, land(bands, scratch_path(spark, "bands")), "lang", "texts", judged.count())
    inside, shown = F.lit(True), []
    for (surprise, (_, steps, prefix)), most in zip(kinds.items(), deviations):
        middle, noise, between = (F.col(f"{surprise}_{c}") for c in ("middle", "noise", "between"))
        reach = most * F.sqrt(between + noise * noise / F.nullif(steps, F.lit(0)))
        columns = {"perplexity": F.exp(surprise), "lower": F.exp(middle - reach), "upper": F.exp(middle + reach)}
        out = out.withColumns({prefix + c: value for c, value in columns.items()})
        shown += [prefix + c for c in columns]
        inside = inside & F.coalesce(F.col(prefix + "perplexity").between(F.col(prefix + "lower"), F.col(prefix + "upper")), F.lit(False))
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.select("row", *counted, "base_failed", *shown, (~F.col("base_failed") & inside).alias("kept"))
