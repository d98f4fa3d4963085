"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import helpers
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnwise.llm import periodic
from turnwise.llm.queries import QUERIES
from turnwise.llm.words import find_words

SF = "/root/testdata/sf0.001"


def runs(w, exponent=4, least=6):
    """All runs, by walking along every period."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            part = w[i : j + q]
            if length >= max(least, exponent * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    w = helpers.words(text)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    found = runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    milli = 1000 * best[1] // best[2] if found else None
    return (len(found), *best, milli, digest(lines), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert got == {r.doc_id: expected(r.doc_id, r.text) for r in docs}
    assert sum(g[0] > 0 for g in got.values()) > 10


def sequences():
    rng = random.Random(3)
    for n in [1, 2, 5, 6, 7, 8, 12, 24, 60] * 40:
        w = [rng.randint(0, rng.choice([0, 1, 2, 9])) for _ in range(n)]
        if rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 9)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        if rng.random() < 0.3:
            w[rng.randrange(n)] = 7
        yield w


def test_runs_of_sequences():
    for w in sequences():
        assert [tuple(map(int, r)) for r in periodic.runs_of(np.array(w))] == runs(w)


def test_no_text_with_a_run_is_turned_away():
    lists = list(sequences())
    words = find_words(pa.array([" ".join(f"w{x}" for x in w) for w in lists]))
    may = periodic.may_have_runs(words.hashes(), words)
    assert all(may[i] for i, w in enumerate(lists) if runs(w))
    assert not may[[i for i, w in enumerate(lists) if len(set(w)) == len(w)]].any()


def test_extension_is_the_length_of_the_common_prefix():
    rng = np.random.default_rng(5)
    for n, k in ((1, 1), (2, 1), (300, 1), (300, 2), (2000, 3)):
        s = np.append(rng.integers(1, k + 1, n), 0)
        lce = periodic.Extension(s)
        assert list(lce.ranks()) == list(np.argsort(sorted(range(n + 1), key=lambda i: s[i:].tolist())))
        i, j = (x[:, 0] for x in np.split(np.array([rng.choice(n + 1, 2, replace=False) for _ in range(200)]), 2, axis=1))
        for a, b, found in zip(i, j, lce.of(i, j)):
            equal = 0
            while max(a, b) + equal <= n and s[a + equal] == s[b + equal]:
                equal += 1
            assert found == equal


def test_odd_rows(odd, none):
    found = periodic.find_runs(odd)
    assert found.schema["row"].dataType == odd.select(F.struct("*")).schema[0].dataType
    got = sorted((str(r.row.text), r.row.size, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect())
    want = []
    for r in odd.collect():
        w = helpers.words(r.text)
        mine = runs(w) if len(w) < 5000 else []  # the very long text is of random words
        gone = {i for s, length, q in mine for i in range(s + q, s + length)}
        want.append((str(r.text), r.size, len(w), mine, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == sorted(want)
    assert periodic.find_runs(none).collect() == []


def test_a_long_period_in_a_long_text(spark):
    rng = random.Random(8)
    root = [f"w{rng.randrange(10**6)}" for _ in range(5000)]
    text = " ".join(["head"] + root * 4 + root[:77] + ["tail"])
    (row,) = periodic.find_runs(spark.createDataFrame([(text,)], "text string")).collect()
    assert [tuple(r) for r in row.runs] == [(1, 20077, 5000)]
    assert row.collapsed == " ".join(["head", *root, "tail"])


def test_shorter_runs_are_refused(none):
    with pytest.raises(ValueError):
        periodic.find_runs(none, exponent=3)


def test_greatest_is_exact(spark):
    rows = [([(0, 9, 2), (4, 9, 2), (1, 27, 6)],), ([(3, 8, 2), (5, 10**9 + 1, 10**8), (6, 10**9, 10**8)],), ([],)]
    df = spark.createDataFrame(rows, "runs array<struct<start: bigint, length: bigint, period: bigint>>")
    got = [r[0] and tuple(r[0]) for r in df.select(periodic.greatest(F.col("runs"))).collect()]
    assert got == [(0, 9, 2), (5, 10**9 + 1, 10**8), None]
