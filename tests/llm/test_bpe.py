"""Token ids against the public library and against merging by rank."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from cartwright.llm import bpe
from frames import documents, odd_rows

PATHS = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]


@pytest.fixture(scope="module", params=PATHS)
def pair(request):
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path(request.param))
    ranks = {t: i for i, t in enumerate(vocabulary.tokens)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return vocabulary, bpe.Encoder(vocabulary), library


def random_texts(n):
    rng = random.Random(3)
    kinds = ["abc", "aaaab  \n\t\x1c\x85 ", "日本語тестΑβγ", "🙂👩‍👧éé̈", "0123456789", "!?#$%&'\"", "ا ب ت", "'s'll're", " 　﻿", "<|endoftext|>"]
    return ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_same_ids_as_the_library(pair):
    _, encoder, library = pair
    texts = [*random_texts(3000), "a" * 5000, "ab" * 3000, " " * 300]
    parts = list(bpe._parts(texts))
    assert sum(parts, []) == texts
    for text, ids in zip(texts, sum(map(encoder.texts, parts), []), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert encoder.decoded(ids) == text.encode()


def test_forgetting_changes_nothing(pair, monkeypatch):
    vocabulary, _, library = pair
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "TOGETHER", 300)
    encoder = bpe.Encoder(vocabulary)
    encoder.all_fit = bpe._Numbers(4)
    texts = random_texts(400)
    parts = list(bpe._parts(texts))
    assert sum(parts, []) == texts
    for text, ids in zip(texts, sum(map(encoder.texts, parts), []), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)


def test_every_prefix_and_edits(pair):
    vocabulary, encoder, _ = pair
    ranks = {t: i for i, t in enumerate(vocabulary.tokens)}
    rng = random.Random(4)
    for _ in range(150):
        old = bytes(rng.choice(b"abaabthingio n\xc3\xa9") for _ in range(rng.randint(0, 150)))
        draft = bpe.Draft(encoder, old)
        start = rng.randint(0, len(old))
        end, new = rng.randint(start, len(old)), bytes(rng.choice(b"abth") for _ in range(rng.randint(0, 5)))
        draft.replace(start, end, new)
        draft.append(b"xyz")
        text = old[:start] + new + old[end:] + b"xyz"
        assert draft.bytes == text and draft.last == bpe.Draft(encoder, text).last
        if text not in ranks:
            assert list(draft.ids()) == [ranks[t] for t in bpe.merged_by_rank(text, ranks, len(ranks))]


def test_edits_of_long_pieces_stop_early(pair):
    encoder = pair[1]
    draft = bpe.Draft(encoder, b"thing" * 2000)
    assert draft.replace(10, 11, b"q") < 3 * encoder.longest


def test_documents(spark, pair):
    vocabulary, _, library = pair
    rows = odd_rows()
    docs = documents(spark, rows).withColumnRenamed("lang", "ids")
    assert bpe.with_ids(docs, vocabulary).columns == docs.columns
    both = bpe.with_ids(docs, vocabulary, decode=True).collect()
    assert len(both) == len(rows)
    for row in both:
        assert row["ids"] == library.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
    assert bpe.with_ids(documents(spark, []), vocabulary).count() == 0


def test_gaps_and_missing_bytes_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary.of({b"a": 0, b"b": 2})
    with pytest.raises(ValueError):
        bpe.Vocabulary.of({b"a": 0, b"b": 1})


def test_query_digests(spark):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.001"
    ranks = bpe.Vocabulary.read(public_tokenizers.path(PATHS[0])).tokens
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={}
    )
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = entry.queries()["op10_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row["doc_id"]]
        ids = library.encode_ordinary(text)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
