"""Odd rows to run operators on, and brute-force versions of their results, on Python lists."""

import collections
import hashlib
import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


SCHEMA = "doc_id bigint, text string, lang string, source string, size bigint, score string, node int, `row` string, `a.b` string"


def odd_texts():
    """Nulls, empty and blank texts, copies, near copies, shared and repeated passages, ties, one very long text."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage, long = prose(60), prose(30000)
    copied, near = prose(80), prose(150).split(" ")
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\n\x0b\x0c\r "),
        (4, "one"),
        (5, "one two three"),
        (6, "one two three"),
        (7, copied),
        (8, copied),
        (8, copied),
        (9, copied.replace(" ", "\n")),
        (10, " ".join(near)),
        (11, " ".join(near[:149] + ["other"])),
        (12, " ".join(near[:70] + ["x"] + near[71:])),
        (13, prose(20) + " " + passage + " " + prose(30)),
        (14, prose(11) + "\n" + passage + "\n" + prose(7)),
        (15, (prose(12) + "\n") * 6),
        (16, long),
        (17, long[: len(long) // 2] + " " + prose(40)),
        (18, "be " * 400),
        (None, prose(25)),
        (None, prose(25)),
        (20, "É´ ﬁ 日本 \x00 don't <|endoftext|> <|startoftext|>x !!"),
    ]
    return [(d, t, [None, "en", "de"][i % 3], [None, "a", "b", "hot", "hot"][i % 5]) for i, (d, t) in enumerate(rows)]


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def repeats(texts, n=35):
    """(n_words, n_removed, sha256) of each text."""
    lists = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[i : i + n]) for w in lists for i in range(len(w) - n + 1))
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingle_sets(texts, n=5):
    out = []
    for t in texts:
        w = words(t)
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def links(texts, threshold=0.8):
    """Pairs of positions whose similarity reaches the threshold."""
    sets = shingle_sets(texts)
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    both = collections.Counter((a, b) for h in holders.values() for x, a in enumerate(h) for b in h[x + 1 :])
    return {(a, b) for (a, b), n in both.items() if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9}


def classes(ids, pairs):
    """(class_id, n_links) of each position."""
    parent = list(range(len(ids)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    degree = collections.Counter()
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
        parent[top(a)] = top(b)
    least = {}
    for i, d in enumerate(ids):
        least[top(i)] = min([x for x in (least.get(top(i)), d) if x is not None], default=None)
    return [(least[top(i)], degree[i]) for i in range(len(ids))]


def base(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text, w = text or "", words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def leaks(texts, items, n=10):
    """(n_words, n_hit, items) of each text; ``items`` are (id, text)."""
    windows = collections.defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lowered(text))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[i : i + n])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for t in texts:
        w = ALNUM.findall(lowered(t))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out.append((len(w), len(hit), sorted(found)))
    return out


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def network_score(network, text, half=128, stride=2, width=6):
    """Of the byte network, window by window and chunk by chunk."""
    import numpy as np

    data = (text or "").encode()
    n = len(data) // half + 1
    data += bytes(n * half + width - len(data))
    halves = []
    for begin in range(0, n * half, half):
        windows = [np.concatenate([network.embed[b] for b in data[at : at + width]]) for at in range(begin, begin + half, stride)]
        values = np.maximum(np.array(windows, np.float64) @ network.filters + network.bias, 0)
        halves.append((values.max(axis=0), values.mean(axis=0)))
    hidden = []
    for i in range(max(1, n - 1)):
        a, b = halves[i], halves[min(i + 1, n - 1)]
        features = np.concatenate([np.maximum(a[0], b[0]), (a[1] + b[1]) / 2])
        hidden.append(np.maximum(features @ network.hidden + network.hidden_bias, 0))
    logit = np.max(hidden, axis=0) @ network.out + network.out_bias[0] + network.shift
    return float(1 / (1 + np.exp(-logit)))
