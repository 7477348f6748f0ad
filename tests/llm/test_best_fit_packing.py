"""Pieces against the library over whole texts; packings against what holds for any good one."""

import functools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from cartwright.llm import best_fit_packing as packing
from cartwright.llm.queries import QUERIES
from frames import documents, odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
    CONTENT = file.read()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(CONTENT)


def whole(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


ODD_TEXTS = [
    None, "", " \n\t ", "A", "Hello, World!! It's IT'S they'll o'neil's 'tis", "x\x1cy\x1d z\x85w\xa0v u", "straße GROSS ΣΊΣΥΦΟΣ. ΟΔΟΣ İIı ǅ",
    "é é. .́ a.́b 12́. ½. x²; Ⅷ! 10,000.5 a_b __init__ a--b (c) [d].", "日本語。テキスト! 한국어. ไทย",
    "<|endoftext|> a<|startoftext|>. b <|ENDOFTEXT|>! <|endoftext", "\U0001f600! \U0001f468‍\U0001f469. �", "'s 't ''' '.' d'.", "\x00 a\x00. \x0b\x0c",
    "Å Å. ﬁ. ﬁ! Ａ. ａ", "don't. DON'T! (can't)", "no.break space.",
]


def test_ids_are_the_librarys(library):
    texts = [*ODD_TEXTS, *[r[1] for r in odd_rows()], " ".join(t or "" for t in ODD_TEXTS)]
    encoder = packing.Encoder(packing.Vocabulary.of(CONTENT), 1)
    for text, ids in zip(texts, encoder.ids(texts)):
        assert ids.tolist() == whole(library, text), text


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,!'́_-<|>aAsStTİΣςé²5½\x1c\x85"), st.characters(codec="utf-8")), max_size=40))
def test_ids_of_any_text(text):
    encoder = shared_encoder()
    encoder.known = {}
    assert next(iter(encoder.ids([text]))).tolist() == whole(encoder.library, text)


@functools.cache
def shared_encoder():
    return packing.Encoder(packing.Vocabulary.of(CONTENT), 1)


def check(rows, capacity):
    """Gapless offsets, nothing over capacity; gives the number of sequences."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by_sequence)


def best_fit(lengths, capacity):
    """Sequences that plain best fit by falling length takes."""
    room = Counter()
    used = 0
    for length in sorted(lengths, reverse=True):
        gap = min((g for g, n in room.items() if n and g >= length), default=None)
        if gap is None:
            used, gap = used + 1, capacity
        else:
            room[gap] -= 1
        room[gap - length] += 1
    return used


def packed_by_plan(lengths, capacity, **more):
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.plan(values, counts, capacity, **more)
    falling = np.sort(lengths)[::-1]
    where = plan.of(np.arange(len(falling)))
    assert np.bincount(where, falling, plan.sequences).max() <= capacity
    assert len(np.unique(where)) == plan.sequences
    for value in values:
        assert (falling[plan.before[value]:] <= value).all() and falling[plan.before[value]] == value
    return plan


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=300))
def test_any_lengths_fit(lengths):
    plan = packed_by_plan(np.array(lengths), 60, groups=(3, 8))
    assert plan.sequences >= -(-sum(lengths) // 60)
    assert plan.sequences <= 1.25 * best_fit(lengths, 60) + 3


@pytest.mark.parametrize("kind", ["even", "large", "small", "one", "full", "pairs"])
def test_as_good_as_best_fit(kind):
    rng = np.random.default_rng(3)
    lengths = {
        "even": rng.integers(1, 4097, 4000), "large": rng.integers(1500, 4097, 4000), "small": rng.integers(1, 300, 4000),
        "one": np.full(3000, 1366), "full": np.full(50, 4096), "pairs": np.concatenate([(a := rng.integers(1400, 2600, 1500)), 4096 - a]),
    }[kind]
    plan = packed_by_plan(lengths, 4096)
    assert plan.sequences <= 1.01 * best_fit(lengths, 4096) + 1


def test_a_plan_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(5)
    values, counts = np.unique(rng.integers(1, 4097, 20_000), return_counts=True)
    few, many = packing.plan(values, counts), packing.plan(values, counts * 10**8)
    assert len(many.first) <= 2 * len(few.first) + 4096
    assert many.sequences <= few.sequences * 10**8


def test_packed_documents(spark, library):
    rows = [*odd_rows(), *[(100 + i, t) for i, t in enumerate(ODD_TEXTS)], *[(None, prose(3, 30))] * 40, (7, prose(8, 9000))]
    frame = documents(spark, rows).withColumnRenamed("lang", "length").withColumnRenamed("source", "part")
    out = packing.packed(frame, CONTENT, with_ids=True).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = whole(library, text)
        for piece, lo in enumerate(range(0, len(ids), 4096)):
            want[doc_id, piece, lo, tuple(ids[lo : lo + 4096])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in out) == want
    assert all(r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in out)
    lengths = [r["length"] for r in out]
    assert check(out, 4096) <= best_fit(lengths, 4096) + 1
    sequences = {r["sequence_id"]: r["ids"] for r in packing.sequences(spark.createDataFrame(out)).collect()}
    assert sum(map(len, sequences.values())) == sum(lengths)
    for r in out:
        assert sequences[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]


def test_query_and_empty_table(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = QUERIES["op13_best_fit_packing"](spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = out.collect()
    sizes = {r["doc_id"]: len(whole(library, r["text"])) for r in docs.collect()}
    assert sum(r["length"] for r in rows) == sum(sizes.values()) and {r["doc_id"] for r in rows} == set(sizes)
    assert check(rows, 4096) <= -(-sum(sizes.values()) // 4096) + 2
    empty = packing.packed(docs.where("false"), CONTENT)
    assert empty.collect() == [] and empty.columns == out.columns
