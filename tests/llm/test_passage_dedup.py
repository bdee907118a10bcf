import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import passage_dedup
from tidemark.llm import suffix_array as suffix_arrays
from tidemark.llm.passage_dedup import anchors, drop_repeats, repeated_in_shard, rolling_hashes
from tidemark.llm.suffix_array import permuted_prefixes, suffix_array


def removed(texts, window):
    """Per text its bytes that stay, and the number of runs removed."""
    counts = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - window + 1):
            if counts[t[i : i + window]] > 1:
                gone[i + 1 : i + 1 + window] = True
        out.append((bytes(np.frombuffer(t, np.uint8)[~gone[1:-1]]), int((gone[1:] & ~gone[:-1]).sum())))
    return out


def test_suffix_array():
    draw = np.random.default_rng(0)
    for case in range(150):
        text = draw.integers(1, 1 + draw.integers(1, 5), draw.integers(0, 70)).astype(np.uint8)
        if case % 3 == 0:
            text = np.tile(text[:5], 9)
        text = np.append(text, 0).astype(np.uint8)
        raw = text.tobytes()
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        order = suffix_array(text)
        assert order.tolist() == want
        before, shared = permuted_prefixes(text, order, np.array([0]), 10**6)
        for a, b in zip(want, want[1:], strict=False):
            same = next(n for n in range(len(raw)) if raw[a + n : a + n + 1] != raw[b + n : b + n + 1])
            assert (before[b], shared[b]) == (a, same)


@pytest.mark.parametrize("wave", [1, 5, 256])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.int32])
def test_suffix_array_of_reduced_strings(monkeypatch, kind, wave):
    """Strings that reduce several times, names of any width, and names that do not fit 16 bits."""
    monkeypatch.setattr(suffix_arrays, "WAVE", wave)
    draw = np.random.default_rng(2)
    words = ["a", "ab"]
    while len(words[-1]) < 700:
        words.append(words[-1] + words[-2])
    texts = [np.frombuffer(words[-1].encode(), np.uint8) - 96, np.ones(300), np.tile([3, 1, 2, 1], 90), np.arange(1, 200)]
    texts += [draw.integers(1, 1 + most, 600) for most in (2, 9, 200)]
    texts += [np.concatenate([draw.permutation(t) if i % 2 else t for i, t in enumerate([texts[-1][:50]] * 9)])]
    calls, sort = [], suffix_arrays.suffix_array
    monkeypatch.setattr(suffix_arrays, "suffix_array", lambda text: calls.append(len(text)) or sort(text))
    for text in texts:
        text = np.append(text, 0).astype(kind)
        raw = text.tolist()
        assert sort(text).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    assert len(calls) >= 12 and min(calls) < 10


def test_suffix_array_of_many_names():
    """More than 65,536 different names, some of them repeated."""
    draw = np.random.default_rng(3)
    text = np.append(np.tile(draw.integers(1, 255, 400_000).astype(np.uint8), 2)[:500_000], np.uint8(0))
    raw, order = text.tobytes(), suffix_array(text).tolist()
    assert sorted(order) == list(range(len(raw)))
    assert all(raw[a : a + 100_100] < raw[b : b + 100_100] for a, b in zip(order[::97], order[1::97], strict=False))


@pytest.mark.parametrize("length", [1, 2, 3, 7, 8, 64, 100, 200])
def test_rolling_hashes(length):
    raw = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint8)
    found = rolling_hashes(raw, length, passage_dedup.MULTIPLIERS[0])
    parts = [raw[i : i + length].tobytes() for i in range(400 - length + 1)]
    assert len(found) == len(parts)
    assert len(set(zip(parts, found.tolist(), strict=True))) == len(set(parts)) == len(set(found.tolist()))


def test_anchors(monkeypatch):
    """Equal windows have equal anchors, and runs cover each window once, whatever the pieces."""
    draw = random.Random(5)
    passage = bytes(draw.randrange(97, 101) for _ in range(500))
    text = bytes(draw.randrange(97, 101) for _ in range(777)) + passage + b"x" * 300 + passage + b"ab" * 200
    for piece in (1 << 20, 64):
        monkeypatch.setattr(passage_dedup, "PIECE", piece)
        hash_of = {}
        for first, last, hashes in anchors(text, 40, 16):
            for a, b, h in zip(first, last, hashes, strict=True):
                for start in range(a, b + 1):
                    assert start not in hash_of
                    hash_of[start] = int(h)
        assert sorted(hash_of) == list(range(len(text) - 39))
        by_window = {}
        for start, h in hash_of.items():
            assert by_window.setdefault(text[start : start + 40], h) == h


def test_shard():
    parts = [b"abcdefgh", b"xxcdefxx", b"cdef", b"only once", b"\xc3\xa9\xc3\xa9\xc3\xa9"]
    got = repeated_in_shard(parts, [1, 1, 1, 3, 1], 4)
    assert got == [[(2, 6)], [(2, 6)], [(0, 4)], [(0, 9)], [(0, 4), (2, 6)]]


@pytest.mark.parametrize("hot", [passage_dedup.HOT_SEGMENTS, 1])
def test_like_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(passage_dedup, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(passage_dedup, "SHARD_BYTES", 3000)
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(draw.randrange(5, 60))) for _ in range(8)]
    texts = [" ".join(draw.choice([word(), word(), draw.choice(passages)]) for _ in range(draw.randrange(0, 25))) for _ in range(60)]
    texts += [texts[3], texts[3] + "!", "ab" * 120, "z" * 39, "z" * 40, None, "", "é" * 90]
    window = 40
    rows = drop_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", window, 16).collect()
    want = removed([(t or "").encode() for t in texts], window)
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        kept, runs = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(raw), len(raw) - len(kept), runs, kept)


def test_awkward(awkward):
    rows = drop_repeats(awkward, "doc_id", "text").collect()
    texts = [(r.text or "").encode() for r in awkward.collect()]
    want = Counter(hashlib.md5(kept).digest() for kept, _ in removed([t for t in texts if len(t) < 10_000], 200))
    want[hashlib.md5(b"").digest()] += 2  # the two long texts are copies
    assert Counter(hashlib.md5(bytes(r.kept)).digest() for r in rows) == want
    assert drop_repeats(awkward.where("false"), "doc_id", "text").count() == 0
