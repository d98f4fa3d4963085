"""SimHash against brute force."""

import random

import helpers
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from turnwise.llm import lookups, simhash
from turnwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def fingerprint(text, width=3):
    words = helpers.words(helpers.lowered(text))
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints, radius=2):
    """The least id each row reaches; None counts as greatest."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    prints = [fingerprint(r.text) for r in rows]
    expected = {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(rows, prints, components([r.doc_id for r in rows], prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op12_simhash"](spark, SF).collect()}
    assert got == expected
    assert any(r != e[1] for r, e in expected.items())


@pytest.mark.parametrize("parts, tile", [(None, 4096), (1, 2), (8, 3)])
def test_odd_rows(odd, parts, tile):
    rows = odd.collect()
    prints = [fingerprint(r.text) for r in rows]
    expected = sorted(zip([r.doc_id for r in rows], prints, components([r.doc_id for r in rows], prints)), key=str)
    found = simhash.link_fingerprints(odd, parts=parts, tile=tile)
    assert found.schema["row"].dataType == odd.select(F.struct("*")).schema[0].dataType
    assert sorted(((r.row.doc_id, r.fingerprint % 2**64, r.component_id) for r in found.collect()), key=str) == expected


def test_no_rows(none):
    assert simhash.link_fingerprints(none).collect() == []


@pytest.mark.parametrize("parts", [1, 2, 4, 8, 16])
@pytest.mark.parametrize("tile", [5, 4096])
def test_no_close_pair_is_skipped(spark, parts, tile):
    """Chains of fingerprints that differ by up to three bits, so that components hang on single links."""
    rng = random.Random(parts)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            prints.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                x ^= 1 << b
    prints = sorted(prints)
    nodes = spark.createDataFrame([(x - (x >> 63 << 64),) for x in prints], "fingerprint bigint")
    edges = simhash.links(nodes, len(prints), parts=parts, tile=tile).collect()
    known = {x: i for i, x in enumerate(prints)}
    a, b = ([known[e[k] % 2**64] for e in edges] for k in ("u", "v"))
    got = simhash.labels_of(len(prints), np.array(a, int), np.array(b, int))
    assert list(got) == components(list(range(len(prints))), prints)


def test_fingerprints_of_many_shingles_are_added_up_in_blocks(monkeypatch):
    import pyarrow as pa

    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (0, 1, 2, 3, 4, 50, 0, 900, 7)]
    monkeypatch.setattr(simhash, "BLOCK", 7)
    got = simhash.fingerprints(simhash.find_words(pa.array(texts), lower=True))
    assert [int(x) for x in got] == [fingerprint(t) for t in texts]


def test_hot_keys_are_looked_up_in_place(spark):
    rows = spark.createDataFrame([(1 if i % 3 else None if i == 0 else i, i) for i in range(9000)], "key bigint, i int")
    table = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("i").alias("least")).where("key <> 3")
    got = lookups.look_up(rows, table, "key", "n", 9000)
    least = {r.key: r.least for r in table.collect()}
    assert sorted((r.i, r.key, r.least) for r in got.collect()) == sorted(((r.i, r.key, least.get(r.key)) for r in rows.collect()), key=lambda r: r[0])
