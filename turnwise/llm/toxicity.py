"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, calibrated votes, evidence."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.decontaminate import Lookup
from turnwise.llm.labelled import labelled_texts
from turnwise.llm.tasks import annotate
from turnwise.llm.words import ALNUM, Words, chunks, find_words, signed

EXAMPLES = 2000  # labelled documents in the index at most, whole and with all their words
NEIGHBOURS = 16
BLOCK = 64  # examples that share a maximum
SHOWN = 5  # neighbours given as evidence
QUERIES = 16  # texts looked up at once; bounds the postings that are in memory
SLACK = 1e-6  # room for rounding in bounds


def spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, owner): the places first to first + size of each owner, one owner after another."""
    upto = np.cumsum(size)
    owner = np.repeat(np.arange(len(size)), size)
    return np.repeat(first - (upto - size), size) + np.arange(upto[-1] if len(size) else 0), owner


@dataclass
class Index:
    """Postings of all words of the examples, by word and then example. A segment is the part of a word's postings that lies in one block of
    examples, and has the greatest weight of it: word t has the segments ``word_at[t]`` to ``word_at[t + 1]``, segment g the postings
    ``segment_at[g]`` to ``segment_at[g + 1]``. Words are sorted hashes."""

    terms: np.ndarray
    idf: np.ndarray
    word_at: np.ndarray
    block: np.ndarray  # of each segment
    most: np.ndarray
    segment_at: np.ndarray
    example: np.ndarray  # of each posting
    weight: np.ndarray
    ids: np.ndarray  # doc_ids of examples
    labels: np.ndarray
    k: int
    size: int = BLOCK  # examples of a block
    slope: float = 1.0
    shift: float = 0.0
    nothing: float = 0.5  # score of a text without any of the words

    def rows(self, text: np.ndarray, term: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight) of normalised TF-IDF vectors, by text and term, from occurrences."""
        keys, counts = np.unique(text * len(self.terms) + term, return_counts=True)
        text, term = keys // len(self.terms), keys % len(self.terms)
        weight = (1 + np.log(counts)) * self.idf[term]
        return text, term, weight / np.sqrt(np.bincount(text, weight * weight, texts))[text]

    def nearest(self, text: np.ndarray, term: np.ndarray, weight: np.ndarray, texts: int, leave_out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(similarity, example) of the nearest examples of each text, most similar first; equals in order of examples.

        The bound of a block is the product of a text's weights and the block's maxima. The blocks of the highest bounds, enough to hold ``k`` examples, are looked at
        first; what the k-th of their similarities is not below the bound of cannot be nearer. All other blocks are looked at next. A block
        is looked at by its segments, in the order of words, so examples with equal words have equal similarities."""
        blocks = -(-len(self.ids) // self.size)
        best = np.zeros((texts, self.k))
        who = np.full((texts, self.k), len(self.ids))
        if not blocks or not len(text):
            return best, who
        segment, row = spread(self.word_at[term], np.diff(self.word_at)[term])
        cell = text[row] * blocks + self.block[segment]
        bound = np.bincount(cell, weight[row] * self.most[segment], texts * blocks).reshape(texts, blocks) * (1 + SLACK)
        found = np.zeros((texts, blocks * self.size))

        def look(chosen: np.ndarray) -> None:
            some = np.flatnonzero(chosen.reshape(-1)[cell])
            first, size = self.segment_at[segment[some]], np.diff(self.segment_at)[segment[some]]
            upto = np.cumsum(size)
            place = np.repeat(first - (upto - size), size)
            place += np.arange(len(place))
            at = np.repeat(text[row[some]] * found.shape[1], size)
            at += self.example[place]
            value = np.repeat(weight[row[some]], size)
            value *= self.weight[place]
            found.reshape(-1)[:] += np.bincount(at, value, found.size)

        first = min(blocks, -(-(self.k + 1) // self.size) + 1)
        edge = -np.partition(-bound, first - 1, axis=1)[:, first - 1 : first]
        seen = (bound >= edge) & (bound > 0)
        look(seen)
        if leave_out is not None:
            found[np.arange(texts), leave_out] = 0
        k = min(self.k, found.shape[1])
        least = -np.partition(-found, k - 1, axis=1)[:, k - 1 : k]
        look((bound >= least) & (bound > 0) & ~seen)
        if leave_out is not None:
            found[np.arange(texts), leave_out] = 0
        least = -np.partition(-found, k - 1, axis=1)[:, k - 1 : k]
        above, even = found > least, (found == least) & (found > 0)
        chosen = above | (even & (np.cumsum(even, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        at, example = np.nonzero(chosen)
        order = np.lexsort((example, -found[at, example], at))
        at, example = at[order], example[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        best[at, nth], who[at, nth] = found[at, example], example
        return best, who

    def votes(self, best: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Log odds of the neighbours' votes, each weighing its similarity over its distance."""
        weight = best / (1.1 - np.minimum(best, 1))
        toxic = (weight * np.append(self.labels, 0)[who]).sum(axis=1)
        return np.log((toxic + 0.5) / (weight.sum(axis=1) - toxic + 0.5))

    def chance(self, votes: np.ndarray, best: np.ndarray) -> np.ndarray:
        return np.where(best[:, 0] > 0, 1 / (1 + np.exp(-(self.slope * votes + self.shift))), self.nothing)


def fit_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (0 at least) and shift of a weighted logistic regression on one value, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        error, curve = weight * (p - y), weight * p * (1 - p) + 1e-9
        gradient = np.array([(error * x).sum() + 1e-2 * (a - 1), error.sum() + 1e-2 * b])
        hessian = np.array([[(curve * x * x).sum() + 1e-2, (curve * x).sum()], [(curve * x).sum(), curve.sum() + 1e-2]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 0.0), float(b)


def text_terms(words: Words, look: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of the occurrences of known words."""
    at, term = look.find(words.hashes())
    return words.text_of()[at], term


def example_words(texts: DataFrame) -> pa.Table:
    """(``doc_id``, ``label``, ``term``, ``n``): all distinct words of the examples, counted in tasks. Examples are bounded, and so is this."""

    def begin():
        def step(column):
            words = find_words(column, ALNUM, lower=True)
            known, term = np.unique(words.hashes(), return_inverse=True)
            keys, counts = np.unique(words.text_of() * max(len(known), 1) + term, return_counts=True)
            at = pa.array(np.searchsorted(keys, np.arange(len(words.offsets)) * max(len(known), 1)).astype(np.int32))
            items = [signed(known[keys % max(len(known), 1)]) if len(keys) else np.empty(0, np.int64), counts.astype(np.int64)]
            return [pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(i) for i in items], ["term", "n"]))]

        return step

    made = annotate(texts, "text", begin, "words array<struct<term: bigint, n: bigint>>", keep=["doc_id", "label"])
    return made.select("row.doc_id", "row.label", F.inline("words")).orderBy("label", "doc_id", "term").toArrow()


def relevance(term: np.ndarray, label: np.ndarray, examples: np.ndarray) -> np.ndarray:
    """Relevance frequency of each term: log2 of 2 and how many times as large its share of toxic examples is as that of clean ones, of which
    one at least is taken. It is 1 for a term without toxic examples, so no term is lost."""
    toxic = np.bincount(term, label) / max(examples.sum(), 1)
    clean = np.maximum(np.bincount(term, 1 - label), 1) / max((1 - examples).sum(), 1)
    return np.log2(2 + toxic / clean)


def build_index(docs: DataFrame, labels: DataFrame, learn: Column, examples: int = EXAMPLES, k: int = NEIGHBOURS, size: int = BLOCK) -> Index:
    """The index of at most ``examples`` labelled documents and its calibration.

    Every word of an example is a term, weighed by its count, its document frequency over all documents and its ``relevance``; vectors have the length one over all
    terms. Words that no example has are no terms. Spark counts the words of the examples and the documents that have them; the driver only lines the sums up. The calibration is
    a logistic regression on the votes for each example by the others, which tasks find in the index, weighted to the share of labels among all that may be
    learned from. Null and empty texts are no examples. Without both labels, or without an example that has words, every score is that share."""
    texts, counts = labelled_texts(docs, labels, "toxic", learn, examples)
    total = sum(counts.values())
    share = (counts.get(1, 0) + 0.5) / (total + 1)
    got = example_words(texts) if len(counts) == 2 else None
    empty = np.empty(0, np.int64)
    start = np.zeros(1, np.int64)
    if got is None or not got.num_rows or len(set(got.column("label").unique().to_pylist())) < 2:
        return Index(np.empty(0, np.uint64), empty, start, empty, empty, start, empty, empty, empty, empty, k, size, nothing=share)
    hashes, n = got.column("term").to_numpy().view(np.uint64), got.column("n").to_numpy()
    ids, who = np.unique(got.column("doc_id").to_numpy(), return_inverse=True)
    label = np.zeros(len(ids), np.int64)
    label[who] = got.column("label").to_numpy()
    terms, term = np.unique(hashes, return_inverse=True)
    frequency = document_frequencies(docs, terms)
    n_docs = frequency[-1]
    idf = np.log((1 + n_docs) / np.maximum(frequency[:-1], 1)) * relevance(term, label[who], label)
    weight = (1 + np.log(n)) * idf[term]
    weight /= np.sqrt(np.bincount(who, weight * weight))[who]
    # Examples that share their most usual word, and so a language and a kind, stand together: their blocks have low maxima for other words.
    usual = np.bincount(term)
    rank = np.lexsort((term, -usual[term], who))
    first = rank[np.searchsorted(who[rank], np.arange(len(ids)))]
    order = np.lexsort((np.arange(len(ids)), -usual[term[first]], term[first]))
    ids, label = ids[order], label[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    example = place[who]
    by = np.lexsort((example, term))
    term, example, weight = term[by], example[by], weight[by]
    block = example // size
    begin = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1]))))
    index = Index(
        terms,
        idf,
        np.searchsorted(term[begin], np.arange(len(terms) + 1)),
        block[begin],
        np.maximum.reduceat(weight, begin),
        np.append(begin, len(term)),
        example.astype(np.int32),
        weight,
        ids,
        label,
        k,
        size,
    )
    return calibrated(index, texts, share)


def calibrated(index: Index, texts: DataFrame, share: float) -> Index:
    """The index with slope, shift and the score of a text without neighbours, from each example's neighbours among the others."""
    got = looked_up(texts, index, "text", ["doc_id", "label"], leave_out=True).select("row.label", "votes", "near").toArrow()  # a row for each example
    votes, label, some = got.column("votes").to_numpy(), got.column("label").to_numpy(), got.column("near").to_numpy() > 0
    weight = np.where(label == 1, share / max(label.sum(), 1), (1 - share) / max((1 - label).sum(), 1)) * len(label)
    slope, shift = fit_line(votes[some], label[some], weight[some]) if some.any() else (1.0, 0.0)
    none = weight[~some]
    nothing = float((none[label[~some] == 1].sum() + 0.5 * share) / (none.sum() + 0.5))
    return replace(index, slope=slope, shift=shift, nothing=nothing)


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many documents each term occurs, and last, how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        known, texts = shared.value, 0
        look, counts = Lookup(known), np.zeros(len(known), np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                text, term = text_terms(find_words(part.column("text"), ALNUM, lower=True), look)
                pairs = np.unique(text * len(known) + term)
                counts += np.bincount(pairs % len(known), minlength=len(known))
                texts += part.num_rows
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, len(known))), pa.array(np.append(counts[seen], texts))], ["place", "n"])

    rows = docs.select("text").mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    got = rows.toArrow()  # a row for each term at most
    out = np.zeros(len(terms) + 1, np.int64)
    out[got.column("place").to_numpy()] = got.column("n").to_numpy()
    return out


EVIDENCE = "array<struct<doc_id: bigint, similarity: double, label: int>>"


def looked_up(docs: DataFrame, index: Index, text: str, keep: list[str] | None, leave_out: bool = False, shown: int = SHOWN) -> DataFrame:
    """``row``, ``score``, ``votes``, ``near`` (the greatest similarity, 0 without a neighbour) and ``evidence``. With ``leave_out``, docs are the examples
    themselves, ``doc_id`` says which, and none is its own neighbour."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    names = docs.columns if keep is None else keep
    own = F.col("doc_id") if leave_out else F.lit(None).cast("bigint")
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), own.alias("own"), F.col(f"`{text}`").alias("text"))
    schema = source.select("row", *[F.lit(0.0).alias(c) for c in ("score", "votes", "near")], F.expr(f"cast(null as {EVIDENCE})").alias("evidence")).schema
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        index = shared.value
        look = Lookup(index.terms)
        for batch in batches:
            for large in chunks(batch, "text"):
                for low in range(0, large.num_rows, QUERIES):
                    part = large.slice(low, QUERIES)
                    text, term = text_terms(find_words(part.column("text"), ALNUM, lower=True), look)
                    left = None
                    if leave_out:
                        left = np.argsort(index.ids)[np.searchsorted(np.sort(index.ids), part.column("own").to_numpy()) % len(index.ids)]
                    best, who = index.nearest(*index.rows(text, term, part.num_rows), part.num_rows, left)
                    votes = index.votes(best, who)
                    nearest, names = best[:, :shown], who[:, :shown]
                    some = nearest > 0
                    items = [pa.array(index.ids[names[some]], pa.int64()), pa.array(nearest[some]), pa.array(index.labels[names[some]].astype(np.int32))]
                    at = pa.array(np.concatenate(([0], np.cumsum(some.sum(axis=1)))).astype(np.int32))
                    evidence = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(items, fields=list(kind.value_type)))
                    numbers = [pa.array(x) for x in (index.chance(votes, best), votes, best[:, 0])]
                    yield pa.RecordBatch.from_arrays([part.column("row"), *numbers, evidence], schema.names)

    return source.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, index: Index, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of a document's columns), ``score`` (0 to 1) and ``evidence`` (the nearest examples' doc_id, similarity and label).

    The whole text is looked at, and every example that shares a word with it may be a neighbour. Null and empty texts, and texts without any word of the
    examples, get the share of toxic labels among such examples, and no evidence. Repeated rows are scored alike; an empty table gives an empty one. The index is
    broadcast: 12 bytes for each distinct word of each example."""
    return looked_up(docs, index, text, keep).select("row", "score", "evidence")
