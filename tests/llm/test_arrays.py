"""The numpy parts, without Spark."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import odd_texts, words

from turnwise.llm import byte_cnn, ngram_join, rans, substrings
from turnwise.llm import words as W
from turnwise.llm.tokens import Encoder


def random_texts(n=400):
    rng = random.Random(1)
    return ["".join(rng.choice("ab c\n\té ") for _ in range(rng.randint(0, 30))) for _ in range(n)] + [None, ""]


def test_words_and_hashes():
    texts = random_texts()
    found = W.find_words(pa.array(["skipped", *texts])[1:])
    expected = [words(t) for t in texts]
    assert [[w.decode() for w in W.word_list(found, i)] for i in range(len(texts))] == expected
    flat = [w for ws in expected for w in ws]
    by_word = {}
    for word, value in zip(flat, found.hashes()):
        assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word)


@pytest.mark.parametrize("length", [1, 2, 5, 10, 35])
def test_run_hashes_depend_on_all_words_in_order(length):
    values = W.scramble(np.random.default_rng(0).integers(0, 3, 3000, dtype=np.uint64))
    runs = W.run_hashes(values, length)
    kinds = {}
    for i, value in enumerate(runs):
        assert kinds.setdefault(tuple(values[i : i + length]), value) == value
    assert len(set(kinds.values())) == len(kinds)


@pytest.mark.parametrize("width", [1, 2, 3, 26, 32])
def test_slide_min(width):
    values = np.random.default_rng(0).integers(0, 1000, 100)
    assert (W.slide_min(values, width) == [values[i : i + width].min() for i in range(101 - width)]).all()


def test_chunks_cover_a_batch():
    batch = pa.record_batch({"text": pa.array(["x" * n for n in (0, 5, 100, 3, 3, 3)])})
    parts = list(W.chunks(batch, "text", 10))
    assert [p.num_rows for p in parts] == [2, 1, 3]
    assert not list(W.chunks(batch.slice(0, 0), "text"))


def test_every_window_holds_an_anchor_and_equal_windows_equal_ones():
    rng = np.random.default_rng(2)
    values = W.scramble(rng.integers(0, 50, 2000, dtype=np.uint64))
    values[1500:1700] = values[100:300]
    room = len(values) - np.arange(len(values))
    places, _ = substrings.anchors(values, room, 35, 10)
    chosen = np.zeros(len(values), bool)
    chosen[places] = True
    assert all(chosen[s : s + 26].any() for s in range(len(values) - 34))
    # Inside the copied stretch, away from its ends, the same places are chosen.
    assert (chosen[1526:1664] == chosen[126:264]).all()


def test_equal_windows_have_equal_own_anchors():
    values = W.scramble(np.random.default_rng(2).integers(0, 50, 2000, dtype=np.uint64))
    values[1500:1700] = values[100:300]
    places, seeds, own = substrings.anchors_and_own(values, len(values) - np.arange(len(values)), 35, 10)
    assert len(own) == 2000 - 34 and set(own) == set(seeds)
    assert (own[1500:1666] == own[100:266]).all()


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 5000, rans.BLOCK, rans.BLOCK + 1, 3 * rans.BLOCK + 77])
def test_rans_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 49408).astype(np.uint32)
    table = rans.Table.of_counts(np.bincount(ids, minlength=5))
    blocks = rans.encode_blocks(ids, table)
    assert len(blocks) == -(-n // rans.BLOCK)
    decoded = rans.decode_blocks(blocks, table)
    assert [i for d in decoded for i in d.tolist()] == ids.tolist()
    for i, block in enumerate(blocks):  # each on its own
        assert (rans.decode_blocks([block], table)[0] == decoded[i]).all()


def test_rans_is_near_the_entropy():
    ids = (np.random.default_rng(0).zipf(1.3, 400_000) % 49408).astype(np.uint32)
    p = np.bincount(ids) / len(ids)
    bits = -(p[p > 0] * np.log2(p[p > 0])).sum()
    size = sum(map(len, rans.encode_blocks(ids, rans.Table.of_counts(np.bincount(ids)))))
    assert size * 8 / len(ids) < bits * 1.1


def test_rans_refuses_what_is_wrong():
    table = rans.Table.of_counts(np.array([5, 0, 3]))
    with pytest.raises(ValueError, match="frequency table"):
        rans.encode_blocks(np.array([1]), table)
    block = bytearray(rans.encode_blocks(np.array([0, 2] * 500), table)[0])
    block[-200] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.decode_blocks([bytes(block)], table)
    with pytest.raises(ValueError, match="format"):
        rans.decode_blocks([b"x" * 100], table)


def test_join_crc():
    import zlib

    for a, b in [(b"", b""), (b"abc", b""), (b"", b"abc"), (b"x" * 1000, b"yz" * 777)]:
        assert rans.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("plain_special", [False, True])
def test_pieces_give_the_library_s_ids(tokenizer, plain_special):
    rng = random.Random(3)
    parts = list("aBéÉß×÷'19& \n\t日İ́Σςﬁ—€\x1c\x85ÿŸǅ😀\x00ſ") + ["'s", "'ll", "<|endoftext|>", "<|", "|>", "!!", "K", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [t for _, t, *_ in odd_texts()]
    encoder = Encoder(tokenizer, plain_special)
    assert encoder.by_piece
    flat, at = encoder.encode(pa.array(texts, pa.string()), 2)
    for i, text in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], text


def test_other_vocabularies_are_encoded_whole():
    from turnwise.llm.queries import tokenizer_file

    encoder = Encoder(tokenizer_file("byte_bpe_50k.json"))
    assert not encoder.by_piece
    texts = ["two  words", None, "é\n"]
    flat, at = encoder.encode(pa.array(texts), 7)
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [
        [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for t in texts
    ]


def test_fewest_matches_keeps_pairs_over_the_threshold():
    for n in (25, 100, 175):
        m = ngram_join.fewest_matches(n, 0.8, 1e-7)
        below = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m))
        assert below < 1e-6 and m > 0.3 * n


def test_overlaps_both_ways():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 80, rng.integers(0, 40))).astype(np.uint64) for _ in range(12)]
    values, offsets = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    a, b = np.triu_indices(12, 1)
    expected = [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(a, b)]
    assert ngram_join.overlaps(values, offsets, a, b).tolist() == expected
    many = np.tile(a, 3), np.tile(b, 3)  # over the limit to dense products
    assert ngram_join.overlaps(values, offsets, *many).tolist() == expected * 3


def test_labels_of_components():
    assert ngram_join.labels_of(6, np.array([4, 1, 2]), np.array([5, 2, 4])).tolist() == [0, 1, 1, 3, 1, 1]


def test_network_gradients():
    rng = np.random.default_rng(0)
    network = byte_cnn.Network.fresh(rng)
    texts = [bytes(rng.integers(1, 256, k).astype(np.uint8)) for k in (0, 5, 300, 700, 1000)]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    label = np.array([0, 1, 0, 1, 1.0])

    def loss():
        p = network.score(data, at)
        return -(label * np.log(p) + (1 - label) * np.log(1 - p)).mean()

    flat, upto = byte_cnn.layout(data, at)
    for weight, gradient in zip(network.weights(), network.gradients(flat, upto, label)):
        place = np.unravel_index(np.argmax(np.abs(gradient)), gradient.shape)
        old = weight[place].copy()
        weight[place] = old + 1e-2
        above = loss()
        weight[place] = old - 1e-2
        below = loss()
        weight[place] = old
        assert abs((above - below) / 2e-2 - gradient[place]) < 0.05 * abs(gradient[place]) + 1e-4


def test_network_sees_the_end_of_a_long_text():
    network = byte_cnn.Network.fresh(np.random.default_rng(0))
    network.out[:] = 1  # every hidden value counts, and chunks can only add to it
    alone = b"a" * 50_000
    scores = network.score(np.frombuffer(alone + alone[:-400] + b"#%&|" * 100, np.uint8), np.array([0, 50_000, 100_000]))
    assert scores[0] != scores[1]
    assert network.score(np.empty(0, np.uint8), np.array([0, 0, 0])).shape == (2,)
