"""Alignment of two tokenizers against a plain version with the libraries."""

import collections
import hashlib

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnwise.llm import alignment
from turnwise.llm.queries import QUERIES, tokenizer_file
from turnwise.llm.tokens import _byte_letters

SF = "/root/testdata/sf0.001"
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def files():
    return tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def spans(ids, size_of):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(size_of(i)), i))
        at += len(size_of(i))
    return out


def plain(texts, files):
    """The query's columns for each text, by comparing all tokens of a text."""
    a = Tokenizer.from_file(files[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=files[1])
    byte = {letter: n for n, letter in _byte_letters().items()}

    def bytes_a(i):
        return bytes(byte[x] for x in a.id_to_token(i))

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    found = []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        expected = (" " + (text or "")).encode()
        if not text or b"".join(map(bytes_a, ids_a)) != expected or b"".join(map(bytes_b, ids_b)) != expected:
            found.append(([], [], [], []))
            continue
        x, y = spans(ids_a, bytes_a), spans(ids_b, bytes_b)
        links, low = [], 0
        for s, e, i in x:
            while y[low][1] <= s:
                low += 1
            for t, f, j in y[low:]:
                if t >= e:
                    break
                links.append((i, j))
        ends = sorted({e for _, e, _ in x} & {f for _, f, _ in y})
        groups, start = [], 0
        for end in ends:
            groups.append(tuple(",".join(str(i) for s, e, i in side if s >= start and e <= end) for side in (x, y)))
            start = end
        found.append((ids_a, ids_b, groups, links))
    count = collections.Counter(pair for f in found for pair in set(f[3]))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for ids_a, ids_b, groups, links in found:
        text = ";".join("|".join(g) for g in groups)
        out.append(
            (
                len(ids_a),
                len(ids_b),
                len(groups),
                len(links),
                sum(count[p] == best[p[0]] for p in links),
                sum(count[p] for p in links),
                hashlib.sha256(text.encode()).hexdigest() if text else "",
            )
        )
    return out


def test_query_equals_the_plain_version(spark, files):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 3000).orderBy("doc_id").collect()
    everything = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    assert len(rows) > 100
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_alignment"](spark, SF).collect()}
    expected = plain([r.text for r in everything], files) if len(everything) < 400 else None
    assert got == {r.doc_id: e for r, e in zip(everything, expected)}


HARD = [None, "", " ", "   x", "a", "a", "<|endoftext|> <s> </s> <unk> <0x41>", "▁x", "日本 語é ﬁ", "\x00 \r\n\t", "ab" * 9000, "🂡 Ᲊ x", "x\n\n  y 'll don't 12345"]


def rows_of(df):
    return sorted(((r.row.doc_id, *(r[c] for c in COLUMNS[:-1]), r.groups_sha256) for r in df.collect()), key=str)


def counted(docs, files):
    aligned = alignment.align_tokens(docs, *files)
    return alignment.count_links(aligned.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")), *files)


def test_hard_texts(spark, files):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id bigint, text string").repartition(3)
    expected = sorted(((i, *e) for i, e in enumerate(plain(HARD, files))), key=str)
    assert rows_of(counted(docs, files)) == expected
    assert sum(e[1] > 0 for e in expected) >= 6  # not all of them are left out


def test_pairs_that_are_not_broadcast_are_joined(odd, files, monkeypatch):
    whole = rows_of(counted(odd, files))
    monkeypatch.setattr(alignment, "SHARED", 40)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 50)
    assert rows_of(counted(odd, files)) == whole
    monkeypatch.setattr(alignment, "SHARED", 0)
    assert rows_of(counted(odd, files)) == whole


def test_columns_and_empty_tables(odd, none, files):
    made = alignment.align_tokens(odd, *files)
    assert made.schema["row"].dataType == odd.select(F.struct("*")).schema[0].dataType
    assert counted(none, files).collect() == []


def test_a_table_of_ranks_says_what_the_file_says(files):
    own = alignment.ByteTokenizer(files[0])
    assert own.fast is not None
    texts = [" " + t for t in HARD if t]
    fast = [list(x) for x in own.encode(texts)]
    assert fast == [e.ids for e in own.own.encode_batch(texts, add_special_tokens=False)]
