"""Best inner products against all pairs."""

import math
import random

import pytest
from cartwright.llm import exact_topk


def brute(rows, every=50, top=5):
    whole = [
        (i, [math.floor(256 * x) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, (q, u) in enumerate(whole):
        if q % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(u, v)), i) for n, (i, v) in enumerate(whole) if n != at)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:top], 1)]
    return sorted(out)


def result(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = exact_topk.top_k(frame.selectExpr("*", "1 AS score", "2 AS rank"))
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())


def as_float32(rows):
    import numpy as np

    return [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(exact_topk, "BLOCK", 50)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 3)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) * math.exp(rng.gauss(0, spread)) for _ in range(24)]) for i in range(600)]
    rows = as_float32(rows)
    assert result(spark, rows) == brute(rows)


def test_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 40)
    rows = [(i, [1.0, 0.5, -0.25]) for i in range(300)] + [(300 + i, [0.5, 0.5, 0.5]) for i in range(20)]
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = as_float32([
        (0, [0.1, 0.2]), (1, None), (2, [None, 0.5]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [9.0, 9.0]),
        (50, [0.0, 0.0]), (100, [1e6, -1e6]), (101, [3e4, 1e6]), (101, [3e4, 1e6]), (-50, [-0.5, 0.3]),
    ])
    assert result(spark, rows) == brute(rows)
    assert result(spark, [(1, [1.0])]) == [] and result(spark, [(50, [1.0])]) == [] and result(spark, []) == []
    assert result(spark, [(50, []), (1, [])]) == [(50, 1, 1, 0)]


def test_rows_of_one_id_are_queries_and_candidates_of_their_own(spark):
    rows = as_float32([(50, [0.5, 0.25]), (50, [0.25, 1.0]), (50, [0.5, 0.25]), (0, [1.0, 1.0]), (3, [0.1, 0.9]), (3, [0.9, 0.1]), (4, [0.2, 0.2])])
    found = result(spark, rows)
    assert found == brute(rows) and sum(r[0] == 50 for r in found) == 15


def test_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 30)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(exact_topk, "LEAST_TILE", 1000)
    rng = random.Random(4)
    rows = as_float32([(i, [rng.gauss(0, 0.2) * math.exp(rng.gauss(0, 1)) for _ in range(12)]) for i in range(0, 700, 2)])
    assert result(spark, rows) == brute(rows)


def test_blocks_out_of_reach_are_not_sent(spark, monkeypatch):
    """One long block answers all queries; blocks of short vectors meet no task of theirs."""
    monkeypatch.setattr(exact_topk, "BLOCK", 64)
    rng = random.Random(5)
    rows = [(i, [rng.uniform(5, 9) for _ in range(8)]) for i in range(64)] + [(i, [rng.uniform(0, 0.01) for _ in range(8)]) for i in range(64, 2000)]
    rows = as_float32(rows)
    assert result(spark, rows) == brute(rows)
