"""Stupid-backoff scores against dictionaries of counts."""

import math
import re
from collections import Counter

import pytest
from cartwright.llm import lm_scoring
from frames import documents, odd_rows, prose


def brute(rows, order):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    grams = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in words]
    total, size = sum(grams, Counter()), sum(map(len, words))
    out = []
    for row, w, own in zip(rows, words, grams):
        others = size - len(w)

        def count(gram, own=own):
            return total[gram] - own[gram]

        def share(gram, others=others):
            if len(gram) == 1:
                return count(gram) / others if count(gram) else 0.4 / others
            return count(gram) / count(gram[:-1]) if count(gram) else 0.4 * share(gram[1:])

        known = w and others
        logs = [math.log10(share(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w))] if known else []
        out.append((str(row[0]), len(w), round(sum(logs), 6) if known else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, order):
    rows = [(i, prose(i % 7, 30 + i)) for i in range(25)]
    frame = lm_scoring.scored(documents(spark, rows), order, chunk_bytes=500)
    found = sorted(((str(r["doc_id"]), r["n_words"], r["log10_score"]) for r in frame.collect()), key=str)
    for got, want in zip(found, brute(rows, order), strict=True):
        assert got[:2] == want[:2] and got[2] == pytest.approx(want[2], abs=1e-5)


def test_odd_rows(spark):
    rows = odd_rows()
    docs = documents(spark, rows).withColumnRenamed("lang", "n_words")
    found = sorted(((str(r["doc_id"]), r["n_words"], r["log10_score"]) for r in lm_scoring.scored(docs).collect()), key=lambda r: str(r[:2]))
    for got, want in zip(found, sorted(brute(rows, 2), key=lambda r: str(r[:2])), strict=True):
        assert got[:2] == want[:2] and (got[2] == want[2] or got[2] == pytest.approx(want[2], rel=1e-9, abs=1e-5))


def test_alone_and_empty(spark):
    assert lm_scoring.scored(documents(spark, [(1, "a b c")])).first()["log10_score"] is None
    assert lm_scoring.scored(documents(spark, [])).count() == 0
