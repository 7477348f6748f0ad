"""Hard negatives against all scores; bounds along the tree on vectors that lie in clusters."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from cartwright.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, every, positives=5, negatives=10, least=30, most=90):
    usable = [
        (i, np.floor(np.asarray(v, np.float32).astype(float) * 256).astype(np.int64), k)
        for i, v, k in rows
        if i is not None and k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    width = max((len(v) for _, v, _ in usable), default=0)
    m = np.array([np.pad(v, (0, width - len(v))) for _, v, _ in usable]).reshape(len(usable), width)
    scores = m @ m.T
    out = Counter()
    for a, (anchor, _, label) in enumerate(usable):
        if anchor % every:
            continue
        ranked = sorted((-int(s), i, j) for j, (s, (i, _, _)) in enumerate(zip(scores[a], usable)) if j != a)
        for score, positive, j in [r for r in ranked if usable[r[2]][2] == label][:positives]:
            fits = [(s, i) for s, i, o in ranked if usable[o][2] != label and least * -score <= 100 * -s <= most * -score]
            for rank, (s, i) in enumerate(fits[:negatives], 1):
                out[anchor, positive, rank, i, -score, -s] += 1
    return out


def found(spark, rows, every, **more):
    return Counter(map(tuple, hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), every, **more).collect()))


def clustered(seed, n, width=16, clusters=6, spread=0.05, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    v = centres[rng.integers(clusters, size=n)] + spread * rng.normal(size=(n, width))
    return [(i, v[i].tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("seed, spread", [(1, 0.02), (2, 0.3), (3, 3.0)])
def test_against_all_scores(spark, seed, spread):
    rows = clustered(seed, 700, spread=spread)
    got = found(spark, rows, 10)
    assert got == expected(rows, 10) and got


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.9, 0.1], 2), (10, [0.0, 0.0], 1), (20, [-1.0, -1.0], 1),
        (None, [1.0, 1.0], 1), (30, None, 1), (40, [1.0, None], 2), (50, [nan, 1.0], 2), (60, [inf, 0.0], 2), (70, [], 2),
        (80, [0.5], 2), (90, [0.4, 0.4, 0.4], 1), (5, [0.5, 0.5], None), (6, [0.5, 0.5], 2), (6, [0.5, 0.5], 2), (7, [0.25, 0.25], 3),
        (-10, [0.7, 0.1], 3),
    ]
    assert found(spark, rows, 10) == expected(rows, 10)
    wide = [(c[0], [x * 3e7 for x in c[1]] if c[1] else c[1], c[2]) for c in rows if c[1] and None not in c[1]]
    assert found(spark, wide, 10) == expected(wide, 10)


def test_ties_and_copies(spark):
    rows = [(i, [0.5, 0.5], i % 2) for i in range(200)] + [(i, [0.25, 0.5], i % 3) for i in range(200, 300)]
    rows += [(i, [0.5, 0.5], 1) for i in range(0, 50, 10)]
    assert found(spark, rows, 10) == expected(rows, 10)


def test_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(hn, "LEAST_TILE", 4000)
    monkeypatch.setattr(hn, "BLOCK", 50)
    monkeypatch.setattr(hn, "GROUP", 7)
    rows = clustered(8, 900)
    assert found(spark, rows, 9) == expected(rows, 9)


def test_nothing_to_do(spark):
    for rows in ([], [(1, [0.5], 1)], [(0, [0.5], 1)], [(0, [0.5], 1), (1, [0.5], 1)], [(0, None, 1)]):
        assert found(spark, rows, 10) == Counter()


def test_the_tree_is_least_and_parents_come_first():
    rng = np.random.default_rng(4)
    points = rng.integers(-500, 500, (60, 5))
    order, parent, edge = hn.spanning_tree(points)
    met = [order[0]]
    for a in order[1:]:
        assert parent[a] in met
        gaps = np.sqrt(((points[met] - points[a]) ** 2).sum(1))
        assert gaps.min() <= edge[a] <= gaps.min() + 1e-3
        met.append(a)
    assert sorted(order) == list(range(60))


def _sides(rows, every):
    anchors = [r for r in rows if r[0] % every == 0]

    def made(kind, side):
        numbers = np.floor(np.array([v for _, v, _ in side]) * 256).astype(np.int64)
        order, parent, edge = hn.spanning_trees(numbers, np.array([r[2] for r in side]))
        fields = {
            "ids": np.array([r[0] for r in side]).tobytes(), "rows": np.array([r[0] for r in side]).tobytes(),
            "labels": np.array([r[2] for r in side]).tobytes(), "numbers": numbers.tobytes(),
            "order": order.tobytes(), "parent": parent.tobytes(), "edge": edge.tobytes(),
        }
        return kind(next(pd.DataFrame([fields]).itertuples()), numbers.shape[1])

    return made(hn.Block, rows), made(hn.Group, anchors)


def test_bounds_spare_most_products_in_clusters():
    block, group = _sides(clustered(5, 4000, clusters=8, spread=0.01), 20)
    asked, multiplied = hn.search(block, group, [[hn.Best(5, 600_000.0)] for _ in group.ids], True)
    assert multiplied < 0.5 * asked


def test_intervals_hold_every_score():
    block, group = _sides(clustered(6, 500, spread=0.2), 5)
    scores = group.numbers @ block.numbers.T
    for window in ((-np.inf, np.inf), (500, 900), (2000, 2500), (10**9, 10**9)):
        windows = [[hn.Best(10**6, *window)] for _ in group.ids]
        hn.search(block, group, windows, False)
        for a, (best,) in enumerate(windows):
            fits = (block.labels != group.labels[a]) & (scores[a] >= window[0]) & (scores[a] <= window[1])
            assert sorted(best.rows.tolist()) == sorted(block.rows[fits].tolist())
