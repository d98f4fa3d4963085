"""Every operator on odd rows (nulls, empty and very long texts, ties, repeated rows, clashing names) and on no rows at all."""

import collections
import math

import helpers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnwise.llm import byte_cnn, decontaminate, mixing, ngram_join, perplexity, separators, substrings, token_files, toxicity, url_rules
from turnwise.sources.scratch import scratch_path


def plain(df, *columns):
    """Rows in any order, ``row`` as (doc_id, text)."""
    got = df.select(F.col("row.doc_id"), F.col("row.text"), *columns).collect()
    return collections.Counter(tuple(r) for r in got)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def labels(spark):
    """Of ids that occur, do not occur, are null or have several labels."""
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(1, 17)] + [(1, 0, 0), (None, 1, 1), (99, 1, 1), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_repeats(odd, none):
    rows = texts_of(odd)
    found = substrings.find_repeats(odd)
    expected = collections.Counter((*r, *e) for r, e in zip(rows, helpers.repeats([t for _, t in rows])))
    assert plain(found, "n_words", "n_removed", "kept_sha256") == expected
    assert sum(e[3] for e in expected) > 15000
    assert set(found.columns) == {"row", "n_words", "n_removed", "spans", "kept_sha256"}
    same = substrings.kept_text(found).join(found.select("row", "kept_sha256"), "row").where(F.sha2("kept", 256) != F.col("kept_sha256"))
    assert same.count() == 0
    assert substrings.find_repeats(none).count() == 0


def test_repeats_within_one_text_and_other_lengths(spark):
    text = " ".join(map(str, range(12))) + " x " + " ".join(map(str, range(12)))
    docs = spark.createDataFrame([(1, text), (2, "a b c d e f")], "doc_id bigint, text string")
    got = {r.row.doc_id: (r.n_removed, r.spans) for r in substrings.find_repeats(docs, threshold=12, anchor=4).collect()}
    assert got == {1: (24, [[0, 12], [13, 25]]), 2: (0, [])}


@pytest.mark.parametrize("chunk", [1, 400, 1 << 20])
def test_repeats_of_common_windows(odd, spark, chunk, monkeypatch):
    """Windows of common anchors, dealt over salts, in chunks of any size: those found once by a salt are looked for in others."""
    monkeypatch.setattr(substrings, "COMMON", 1)
    monkeypatch.setattr(substrings, "SALTS", 5)
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
    shared, rest = " ".join(f"s{i}" for i in range(50)), " ".join(f"r{i}" for i in range(36))
    more = [(100 + i, f"a{i} b{i} {shared} c{i}" + f" {rest}" * (i in (3, 7))) for i in range(23)]
    docs = odd.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id bigint, text string"))
    rows = texts_of(docs)
    expected = collections.Counter((*r, *e) for r, e in zip(rows, helpers.repeats([t for _, t in rows])))
    assert plain(substrings.find_repeats(docs), "n_words", "n_removed", "kept_sha256") == expected


def test_mix(odd, none):
    rows = mixing.mix(mixing.measured(odd, odd.columns)).collect()
    assert len(rows) == odd.count()
    sizes = collections.Counter()
    for r in rows:
        assert r.size == len(helpers.words(r.row.text)) and r.source == r.row.source
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
    weights = dict(zip([*sorted(s for s in sizes if s is not None), None], [3, 1, 2, 3]))
    total, target = 1.5 * sum(sizes.values()), {}
    while True:
        left = total - sum(target.values())
        open_sources = [s for s in sizes if s not in target]
        part = {s: left * weights[s] / sum(weights[x] for x in open_sources) for s in open_sources}
        over = [s for s in open_sources if part[s] > 2 * sizes[s]]
        if not over:
            target.update(part)
            break
        target.update({s: 2.0 * sizes[s] for s in over})
    taken, n = collections.Counter(), collections.Counter(r.source for r in rows)
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
    for s in sizes:
        assert target[s] - n[s] - 1 <= taken[s] <= target[s]
    again = mixing.mix(mixing.measured(odd.repartition(7), odd.columns))
    assert collections.Counter((r.row, r.taken) for r in again.collect()) == collections.Counter((r.row, r.taken) for r in rows)
    assert mixing.mix(mixing.measured(none, none.columns)).count() == 0
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert sum(len(helpers.words(r.text)) for r in mixed.select("text").collect()) == sum(taken.values())
    assert mixing.mixed_documents(none).count() == 0


def test_mix_prefers_quality(spark):
    rows = [(i, ("word " if i % 2 else "wo&&rd## ") * 20, "a") for i in range(400)] + [(1000 + i, "y " * 20, "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(mixing.measured(docs, ["doc_id"]), share=0.25, weights=(1, 1)).where("source = 'a'").collect()
    taken = collections.Counter(r.row.doc_id % 2 for r in got if r.taken)
    assert taken[1] > 2 * taken[0] > 0


@pytest.mark.parametrize("text", ["#$% " * 9, "word " * 9, "wo#d word word "])
def test_mix_buckets_hold_little_of_a_source(spark, text):
    """One source, all of whose documents have the least, the greatest or a middle quality: no bucket has 1 % of them."""
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.lit("hot").alias("source"))
    rows = mixing.measured(docs, ["doc_id"]).select("key", "bucket")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most")).orderBy("bucket").collect()
    assert max(r.n for r in sizes) < 400 and sum(r.n for r in sizes) == 40_000
    assert all(a.most < b.least for a, b in zip(sizes, sizes[1:]))


def test_mix_is_the_same_in_any_buckets(odd):
    def taken(buckets):
        return collections.Counter((r.row, r.taken) for r in mixing.mix(mixing.measured(odd, odd.columns, buckets=buckets)).collect())

    assert taken(1) == taken(7) == taken(mixing.BUCKETS)


def test_links(odd, none):
    rows = texts_of(odd)
    pairs = helpers.links([t for _, t in rows])
    expected = collections.Counter((*r, *c) for r, c in zip(rows, helpers.classes([d for d, _ in rows], pairs)))
    assert plain(ngram_join.link_documents(odd), "class_id", "n_links") == expected
    assert len(pairs) >= 8
    assert ngram_join.link_documents(none).count() == 0


def test_one_of_each(odd, none):
    rows = texts_of(odd)
    left = ngram_join.one_of_each(odd)
    assert left.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect())
    pairs = helpers.links([t for _, t in rows])
    classes = helpers.classes([d for d, _ in rows], pairs)
    linked = {c for c, n in classes if n}
    alone = [(d is None, d or 0) for (d, _), (_, n) in zip(rows, classes) if not n]
    assert ids == sorted(alone + [(c is None, c or 0) for c in linked])
    equal = odd.where("doc_id = 8")
    assert ngram_join.one_of_each(equal.unionAll(equal.withColumn("size", F.lit(1)))).count() == 1
    copies = odd.where("doc_id = 7").limit(1)
    assert ngram_join.one_of_each(copies.unionAll(copies).unionAll(copies)).count() == 1
    assert ngram_join.one_of_each(none).count() == 0


def test_links_of_a_large_group_in_many_tiles(spark, monkeypatch):
    """Near copies of one text: groups are cut into several tiles, and every pair is counted once."""
    import random

    rng = random.Random(0)
    words = [str(rng.randint(0, 10**6)) for _ in range(100)]
    texts = []
    for _ in range(60):
        own = list(words)
        for place in rng.sample(range(100), rng.choice([0, 1, 2, 3])):
            own[place] = "e" + str(rng.randint(0, 10**6))
        texts.append(" ".join(own))
    monkeypatch.setattr(ngram_join, "TILE_SETS", 8)
    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", 900)
    monkeypatch.setattr(ngram_join, "LEAST_SIZE", 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.row.doc_id: (r.class_id, r.n_links) for r in ngram_join.link_documents(docs).collect()}
    pairs = helpers.links(texts)
    assert got == dict(enumerate(helpers.classes(list(range(60)), pairs)))
    assert 200 < len(pairs) < 1770


def test_links_of_few_texts_in_several_blocks(spark, monkeypatch):
    """Groups of two and three near copies, cut into more blocks than they have texts: an empty block adds no pairs."""
    import random

    rng = random.Random(1)
    texts = []
    for group in range(24):
        words = [str(rng.randint(0, 10**6)) for _ in range(100)]
        for copy in range(2 + group % 2):
            texts.append(" ".join([*words[:99], f"e{copy}"]))
    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", 60)
    monkeypatch.setattr(ngram_join, "LEAST_SIZE", 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.row.doc_id: (r.class_id, r.n_links) for r in ngram_join.link_documents(docs).collect()}
    assert got == dict(enumerate(helpers.classes(list(range(len(texts))), helpers.links(texts))))


def test_links_at_a_lower_threshold(spark):
    """Bands follow the threshold: pairs just above 0.5 are found too."""
    import random

    rng = random.Random(2)
    texts = []
    for _ in range(60):
        words = [str(rng.randint(0, 10**6)) for _ in range(100)]
        texts += [" ".join(words), " ".join(words[: 68 + len(texts) % 4] + [str(rng.randint(0, 10**6)) for _ in range(32 - len(texts) % 4)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.row.doc_id: (r.class_id, r.n_links) for r in ngram_join.link_documents(docs, threshold=0.5).collect()}
    pairs = helpers.links(texts, 0.5)
    assert got == dict(enumerate(helpers.classes(list(range(len(texts))), pairs)))
    assert len(pairs) >= 30
    assert ngram_join.bands_for(0.8) == (35, 5)
    for threshold in (0, 0.001, 1):
        with pytest.raises(ValueError):
            ngram_join.bands_for(threshold)


def test_quality_rules(odd, none):
    rows = texts_of(odd)
    judged = perplexity.judge_quality(odd)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert plain(judged, *columns) == collections.Counter((*r, *helpers.base(r[1])) for r in rows)
    for r in judged.collect():
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed
        inside = r.perplexity is not None and r.lower <= r.perplexity <= r.upper and r.start_lower <= r.start_perplexity <= r.start_upper
        assert r.kept == (not failed and inside)
        assert (r.perplexity is None) == (r.n_words == 0)
    assert perplexity.judge_quality(none).count() == 0


def test_model_is_modified_kneser_ney(spark):
    """Both folds' probabilities against a plain version on a small text."""
    texts = ["abba abab ba", "abc cab ab ab ab", "bcb a", "cab  ba\nab abba.", "c"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    folds = [r.fold for r in docs.orderBy("doc_id").select(perplexity.fold_of(F.col("text")).alias("fold")).collect()]
    assert set(folds) == {0, 1}
    made = {r.gram.to_bytes(perplexity.ORDER, "big").decode(): r for r in perplexity.train(perplexity.gram_counts(docs, "text", F.col("lang"))).collect()}
    n = perplexity.ORDER
    for fold in (0, 1):
        counts = {n: collections.Counter()}
        for text, its in zip(texts, folds):
            run = " " * (n - 1) + " ".join(text.split()) + " "
            if its == fold:
                counts[n].update(run[i : i + n] for i in range(len(run) - n + 1))
        for order in range(n - 1, 0, -1):
            counts[order] = collections.Counter(g[1:] for g in counts[order + 1])

        def discount(order, c):
            seen = collections.Counter(counts[order].values())
            k = min(c, 3)
            usual = {1: 0.5, 2: 1.0, 3: 1.5}[k]
            if not seen[1] + 2 * seen[2] or not seen[k]:
                return usual
            d = k - (k + 1) * seen[1] / (seen[1] + 2 * seen[2]) * seen[k + 1] / seen[k]
            return d if 0 < d < k else usual

        def probability(gram):
            if not gram:
                return 1 / 256
            order, lower = len(gram), probability(gram[1:])
            same = {g: x for g, x in counts[order].items() if g[:-1] == gram[:-1]}
            if not same:
                return lower
            c, total = counts[order][gram], sum(same.values())
            weight = sum(discount(order, x) for x in same.values()) / total
            return (c - discount(order, c) if c else 0) / total + weight * lower

        for gram, row in made.items():
            assert abs(row[f"p{fold}"] - probability(gram)) < 1e-12
        assert any(not counts[n][gram] for gram in made)
        context = collections.Counter(g[:-1] for g in counts[n]).most_common(1)[0][0]
        assert abs(sum(probability(context + chr(b)) for b in range(256)) - 1) < 1e-9
    assert sum(r.n for r in made.values()) == sum(len(" ".join(t.split())) + 1 for t in texts)


def test_grams_of_pieces_are_those_of_the_text(monkeypatch):
    import pyarrow as pa

    from turnwise.llm.words import find_words

    texts = ["ab c defg\nh i", "", None, "x", " y  zz ", "ü a b c d e f", "a" * 40 + " b"]
    expected = []
    for i, text in enumerate(texts):
        run = b" " * (perplexity.ORDER - 1) + b"".join(w.encode() + b" " for w in (text or "").split())
        expected += [(i, int.from_bytes(run[k : k + perplexity.ORDER], "big")) for k in range(len(run) - perplexity.ORDER + 1)]
    for piece in (1, 3, 7, 16, 1 << 20):
        monkeypatch.setattr(perplexity, "_PIECE", piece)
        pieces = list(perplexity.spell(find_words(pa.array(texts, pa.string()))))
        assert [(int(t), int(g)) for grams, of in pieces for t, g in zip(of, grams)] == expected


def test_absent_grams_are_not_found(spark):
    """Many grams of one language: none is taken for another, of its own or of another language."""
    import numpy as np

    n = 1 << 20
    p = 1 / (F.col("id") + 2)
    model = perplexity.model_of(spark.range(n).select(F.lit("en").alias("lang"), (F.col("id") * 2).alias("gram"), p.alias("p0"), (p / 2).alias("p1")))
    for lang in ("en", "de"):
        seed = spark.range(1).select(F.xxhash64(F.lit("language"), F.lit(lang)).alias("s")).first().s
        at, found = model.find(perplexity.gram_keys(np.array([seed]).view(np.uint64), np.arange(2 * n, dtype=np.uint64)))
        assert (found == ((np.arange(2 * n) % 2 == 0) & (lang == "en"))).all()
        if lang == "en":
            for fold in (0, 1):
                p = np.exp(model.said[fold, at[::2]] / perplexity.UNIT)
                assert np.allclose(p, 1 / (np.arange(n) + 2) / (1 + fold), rtol=1e-5)


def test_grams_that_are_not_broadcast_are_joined(odd, monkeypatch):
    columns = ["n_words", "kept", "perplexity", "lower", "upper", "start_perplexity", "start_lower", "start_upper"]
    expected = plain(perplexity.judge_quality(odd), *columns)
    for most in (0, 200):
        monkeypatch.setattr(perplexity, "SHARED", most)
        assert plain(perplexity.judge_quality(odd), *columns) == expected


def test_token_counts(odd, none, tokenizer, monkeypatch):
    monkeypatch.setattr(separators, "BLOCK_IDS", 64)  # many blocks a file, and documents over many blocks
    library = Tokenizer.from_file(tokenizer)
    library.encode_special_tokens = True
    got = separators.token_counts(odd, tokenizer, 49407)
    expected = collections.Counter((d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in texts_of(odd))
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got.collect()) == expected
    assert separators.token_counts(none, tokenizer, 49407).count() == 0


def test_scan_stitches_blocks(spark, tmp_path):
    """Separators at the ends of blocks, blocks without any, and ids after the last one."""
    import struct

    ids = [1, 9, 9, 2, 3, 4, 5, 6, 7, 9, 8, 9, 1, 1]
    blocks = [(0, k, struct.pack("<3H", *ids[i : i + 3]) if len(ids[i : i + 3]) == 3 else struct.pack("<2H", *ids[i:])) for k, i in enumerate(range(0, 14, 3))]
    path = str(tmp_path / "flat")
    spark.createDataFrame(blocks, "file int, block bigint, ids binary").write.parquet(path)
    got = sorted(tuple(r) for r in separators.scan(spark, path, 9, 2).collect())
    assert got == [(0, 0, 0, 1), (0, 1, 2, 0), (0, 2, 3, 6), (0, 3, 10, 1)]


def test_token_files(odd, none, tokenizer, spark, monkeypatch):
    monkeypatch.setattr(token_files, "PART_IDS", 20_000)  # several parts
    library = Tokenizer.from_file(tokenizer)
    path = scratch_path(spark, "test-files")
    token_files.write_token_files(odd, path, tokenizer, 2)
    got = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r.start)
    coded = {(d, t): [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts_of(odd)}
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((r.doc_id is not None, r.doc_id or 0) for r in got)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter(
        (d, len(coded[d, t]), helpers.crc(coded[d, t])) for d, t in texts_of(odd)
    )
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert sum(len(r.ids) for r in token_files.read_ids(spark, path).collect()) == start
    empty = scratch_path(spark, "test-files")
    token_files.write_token_files(none, empty, tokenizer, 2)
    assert token_files.read_documents(spark, empty).count() == 0


def test_token_files_of_few_parts_in_many_files(odd, tokenizer, spark, monkeypatch):
    monkeypatch.setattr(token_files, "PART_IDS", 5_000)
    few, many = scratch_path(spark, "few"), scratch_path(spark, "many")
    token_files.write_token_files(odd, many, tokenizer, 2)
    monkeypatch.setattr(token_files, "FILE_BLOCKS", 1)
    token_files.write_token_files(odd, few, tokenizer, 2, most_parts=2)
    blocks = spark.read.parquet(f"{few}/blocks")
    assert blocks.select("part").distinct().count() == 2 < spark.read.parquet(f"{many}/blocks").select("part").distinct().count()
    assert len(blocks.inputFiles()) == blocks.count() > 2
    read = [collections.Counter(map(tuple, token_files.read_documents(spark, path).collect())) for path in (few, many)]
    assert read[0] == read[1]


def test_url_rules(spark):
    rules = [
        ("com", "/", "allow"),
        ("example.com", "/en/", "block"),
        ("www.example.com", "/en/", "allow"),
        ("example.com", "/en/a/", "block"),
        ("EXAMPLE.com", "/en/", "allow"),
        ("net", "", "block"),
        (None, "/x", "block"),
    ]
    rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    urls = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "no scheme/en/": ("", "", None, "allow"),
        "http://Example.COM/en/b?q=/en/a/": ("example.com", "/en/b", "example.com/en/", "block"),
        "https://a.www.example.com/en/a/b#f": ("a.www.example.com", "/en/a/b", "www.example.com/en/", "allow"),
        "https://m.example.com/en/a/b": ("m.example.com", "/en/a/b", "example.com/en/a/", "block"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://example.com": ("example.com", "", None, "allow"),
        "http://example.com?x=/": ("example.com", "", None, "allow"),
        "http://sub.net#/a": ("sub.net", "", "net", "block"),
        "http://net/x": ("net", "/x", "net", "block"),
        "http://de/x/y": ("de", "/x/y", "/x", "block"),
        "://com/" + "z" * 50_000: ("com", "/" + "z" * 50_000, "com/", "allow"),
    }
    pages = spark.createDataFrame([(i % 5, u, "h", "p", "r") for i, u in enumerate([*urls, *urls])], "page_id bigint, url string, host string, path string, zone string")
    got = url_rules.judge_urls(pages, rules).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == urls[r.row.url], r.row.url
    # Any number of sorted runs gives the same; without rules or pages nothing fails.
    assert sorted(map(str, url_rules.judge_urls(pages, rules, salts=1).collect())) == sorted(map(str, got))
    assert {r.verdict for r in url_rules.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0


def test_url_rules_run_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string").select("page_id", "url")
    pages.write.mode("overwrite").parquet(path := scratch_path(spark, "pages"))
    rules = spark.range(1).select(F.lit("com").alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    plan = url_rules.judge_urls(spark.read.parquet(path), rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("block_windows", [1_000_000, 40])
def test_leaks(odd, none, spark, block_windows):
    texts = dict((d, t) for d, t in texts_of(odd) if d and t)
    long = texts[16].split(" ")
    items = [
        (1, " ".join(long[20000:20030]).upper()),
        (2, "One, TWO -- three!"),
        (2, "one two three"),
        (3, None),
        (4, " ,;"),
        (None, "be be be be be be be be be be be be"),
        (10, texts[10]),
        (7, " ".join(long[5:10])),
        (12, "never seen words in this one at all so there is nothing"),
    ]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = texts_of(odd)
    expected = collections.Counter((*r, n, hit, tuple(found)) for r, (n, hit, found) in zip(rows, helpers.leaks([t for _, t in rows], items)))
    got = decontaminate.find_leaks(odd, benchmark, block_windows=block_windows)
    found = collections.Counter((r.row.doc_id, r.row.text, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect())
    assert found == expected
    assert all(sum(b - a for a, b in r.spans) == r.n_hit for r in got.collect())
    if block_windows > 40:
        assert decontaminate.find_leaks(none, benchmark).count() == 0
        assert {r.n_hit for r in decontaminate.find_leaks(odd, benchmark.limit(0)).collect()} == {0}


def test_toxicity_on_odd_rows(odd, none, labels):
    index = toxicity.build_index(odd, labels, F.lit(True))
    scored = toxicity.score_toxicity(odd, index)
    assert plain(scored) == collections.Counter(texts_of(odd))
    assert all(0 <= r.score <= 1 for r in scored.collect())
    for docs, some in ((odd, labels.limit(0)), (none, labels), (odd, labels.withColumn("toxic", F.lit(1)))):
        index = toxicity.build_index(docs, some, F.lit(True))
        assert len({r.score for r in toxicity.score_toxicity(odd, index).collect()}) == 1
    assert toxicity.score_toxicity(none, index).count() == 0


def plain_cosines(texts, labels):
    """Similarities of all texts, over all their words, with the frequencies of words in all texts and in those of either label."""
    lists = [helpers.ALNUM.findall(helpers.lowered(t)) for t in texts]
    seen = collections.Counter(w for words in lists for w in set(words))
    toxic = collections.Counter(w for words, label in zip(lists, labels) if label for w in set(words))
    n = [sum(1 for words, label in zip(lists, labels) if words and label == side) for side in (0, 1)]

    def weight(word, times):
        share = toxic[word] / n[1] / (max(seen[word] - toxic[word], 1) / n[0])
        return (1 + math.log(times)) * math.log((1 + len(texts)) / seen[word]) * math.log2(2 + share)

    vectors = []
    for words in lists:
        v = {w: weight(w, times) for w, times in collections.Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / norm for w, x in v.items()})
    return [[sum(x * v.get(w, 0.0) for w, x in u.items()) for v in vectors] for u in vectors]


def test_nearest_examples_are_those_of_a_plain_cosine(spark):
    """All texts are examples, in many small blocks: neighbours, similarities and votes, with and without themselves."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").cache()
    rows = docs.orderBy("doc_id").collect()
    ids = [r.doc_id for r in rows]
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    index = toxicity.build_index(docs, labels, F.lit(True), k=7, size=8)
    assert sorted(index.ids) == [r.doc_id for r in rows if helpers.ALNUM.search(helpers.lowered(r.text))]
    cosines = plain_cosines([r.text for r in rows], [int(d % 3 == 0) for d in ids])
    got = {r.row.doc_id: r for r in toxicity.looked_up(docs, index, "text", ["doc_id"]).collect()}
    alone = {r.row.doc_id: r for r in toxicity.looked_up(docs, index, "text", ["doc_id"], leave_out=True, shown=7).collect()}
    for i, d in enumerate(ids):
        if not helpers.ALNUM.search(helpers.lowered(rows[i].text)):
            assert got[d].near == 0 and got[d].evidence == []
            continue
        assert got[d].near == pytest.approx(1.0)  # finds itself
        for r, others in ((got[d], range(len(ids))), (alone[d], [j for j in range(len(ids)) if j != i])):
            expected = sorted((cosines[i][j] for j in others), reverse=True)
            assert [e.similarity for e in r.evidence] == pytest.approx([x for x in expected[: len(r.evidence)]])
            assert all(e.similarity == pytest.approx(cosines[i][ids.index(e.doc_id)]) and e.label == int(e.doc_id % 3 == 0) for e in r.evidence)
        assert d not in [e.doc_id for e in alone[d].evidence]
        if len(alone[d].evidence) == 7:
            weight = [(e.similarity / (1.1 - min(e.similarity, 1)), e.label) for e in alone[d].evidence]
            toxic = sum(w * label for w, label in weight)
            assert alone[d].votes == pytest.approx(math.log((toxic + 0.5) / (sum(w for w, _ in weight) - toxic + 0.5)))
    docs.unpersist()


def test_blocks_that_cannot_be_nearer_are_skipped():
    """Without a look at every block, the nearest of random vectors are exact; ties go to the first examples."""
    import numpy as np

    rng = np.random.default_rng(3)
    n, terms, k = 700, 60, 9
    dense = rng.random((n, terms)) * (rng.random((n, terms)) < 0.1)
    dense[::7] = dense[0]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    term, example = np.nonzero(dense.T)
    weight, block = dense.T[term, example], example // toxicity.BLOCK
    begin = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1]))))
    at = np.searchsorted(term[begin], np.arange(terms + 1))
    index = toxicity.Index(
        np.arange(terms), np.ones(terms), at, block[begin], np.maximum.reduceat(weight, begin), np.append(begin, len(term)),
        example, weight, np.arange(n), np.zeros(n, int), k,
    )
    text, word = np.nonzero(dense[:50])
    best, who = index.nearest(text, word, dense[text, word], 50)
    everything = dense[:50] @ dense.T
    for q in range(50):
        order = np.lexsort((np.arange(n), -np.round(everything[q], 9)))[:k]
        assert best[q] == pytest.approx(everything[q][order])
        assert [w for w, s in zip(who[q], best[q]) if s > 0] == [o for o in order if everything[q][o] > 0]


def test_byte_network_on_odd_rows(odd, none, labels):
    network = byte_cnn.train(odd, labels, F.lit(True), updates=5)
    scored = byte_cnn.score_quality(odd, network)
    assert plain(scored) == collections.Counter(texts_of(odd))
    by_text = {}
    for r in scored.collect():
        assert 0 <= r.score <= 1
        assert by_text.setdefault(r.row.text or "", r.score) == r.score
    for docs, some in ((odd, labels.limit(0)), (none, labels), (odd, labels.withColumn("quality", F.lit(1)))):
        constant = byte_cnn.train(docs, some, F.lit(True), updates=5)
        assert len({r.score for r in byte_cnn.score_quality(odd, constant).collect()}) == 1
    assert byte_cnn.score_quality(none, network).count() == 0


def test_byte_network_scores_as_a_plain_forward_pass(odd, labels):
    network = byte_cnn.train(odd, labels, F.lit(True), updates=20)
    scored = byte_cnn.score_quality(odd, network).select("row.text", "score").collect()
    expected = [helpers.network_score(network, r.text) for r in scored]
    assert [r.score for r in scored] == pytest.approx(expected, abs=1e-4)
    assert max(expected) - min(expected) > 1e-3


def test_byte_network_learns_from_the_ends_of_long_texts(spark):
    """The only difference stands after 45,000 bytes."""
    import random

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(11_000))[:45_000] + ("" if i % 2 else " #%&|" * 100) for i in range(32)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    quality = spark.createDataFrame([(i, i % 2) for i in range(32)], "doc_id bigint, quality int")
    network = byte_cnn.train(docs, quality, F.lit(True), updates=100)
    score = {r.row.doc_id: r.score for r in byte_cnn.score_quality(docs, network).collect()}
    assert min(score[i] for i in range(1, 32, 2)) > max(score[i] for i in range(0, 32, 2)) + 0.5
