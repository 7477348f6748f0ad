"""Hashes of words against plain splitting."""

import random

import numpy as np
from cartwright.llm import words
from cartwright.llm.exchange import as_id, as_number, bucket_of, packed, unpacked


def texts():
    rng = random.Random(1)
    alphabet = ["a", "bc", " ", "\n", "\t", "\x0b", "é", "日", "\x1c", " ", "  "]
    return ["", " ", "word"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(200)]


def test_words_are_those_of_bytes_split(monkeypatch):
    data = words.encoded(texts())
    whole = words.hashed_words(data)
    monkeypatch.setattr(words, "_PIECE", 16)
    pieces = words.hashed_words(data)
    for hashes, offsets, starts, ends in (whole, pieces):
        joined = b"\n".join(data)
        seen = {}
        for i, text in enumerate(data):
            own = slice(offsets[i], offsets[i + 1])
            assert [joined[s:e] for s, e in zip(starts[own], ends[own])] == text.split()
            for word, h in zip(text.split(), hashes[own].tolist()):
                assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)
    assert all((a == b).all() for a, b in zip(whole, pieces))


def test_hashes_alone(monkeypatch):
    for piece in (1 << 18, 16, 1):
        monkeypatch.setattr(words, "_PIECE", piece)
        for data in (words.encoded(texts()), [], [b""], [b"", b" ", b"a"], [b"one", b"", b"two words "]):
            for own, both in zip(words.word_hashes(data), words.hashed_words(data)):
                assert own.tolist() == both.tolist()


def test_grams_differ_by_order_and_length():
    hashes = words.hashed_words([b"a b a b c"])[0]
    two = words.gram_hashes(hashes, 2).tolist()
    assert two[0] == two[2] != two[1] and len(words.gram_hashes(hashes, 6)) == 0
    assert words.gram_hashes(hashes, 1)[0] != hashes[0]


def test_lower_changes_ascii_only():
    assert words.encoded(["ÀB", None], lower=True) == ["Àb".encode(), b""]


def test_packing_and_order():
    values = np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64)
    assert (unpacked(packed(values)) == values).all() and len(unpacked(packed(values[:0]))) == 0
    ids = np.array([-(2**63), -5, 0, 7, 2**63 - 1])
    assert (np.diff(as_number(ids).astype(object)) > 0).all() and (as_id(as_number(ids)) == ids).all()
    buckets = bucket_of(np.sort(values), 7)
    assert (np.diff(buckets.astype(np.int64)) >= 0).all() and set(buckets) == set(range(7))
