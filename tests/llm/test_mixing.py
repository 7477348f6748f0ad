"""Targets, streams and the training order."""

import re
from collections import defaultdict

import pytest
from cartwright.llm import mixing
from frames import documents, odd_rows, prose


def poured(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by handing the excess round until none is left."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if most * sizes[n] <= level * weight[n]}
        if not full:
            return target | {n: level * weight[n] for n in open_}
        for n in full:
            target[n] = most * sizes[n]
            left -= target[n]
        open_ -= full
    return target


@pytest.fixture(scope="module")
def rows():
    hot = [(i, prose(i, 5 + i % 40), "en", "hot") for i in range(150)]
    return hot + [(200 + i, prose(i, 3 + i % 60), "en", f"s{i % 7}") for i in range(120)] + [
        (400 + i, prose(i, 10), "en", None) for i in range(9)
    ]


def test_targets_and_budgets(spark, rows):
    found = mixing.mixed(documents(spark, rows)).collect()
    sizes, taken, target, longest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in found:
        sizes[r["source"]] += r["size"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    want = poured(sizes)
    for name, size in sizes.items():
        assert target[name] == pytest.approx(want[name]) and abs(taken[name] - want[name]) <= longest[name] / 2 + 0.5
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = mixing.mixed(documents(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_training_order_follows_the_schedule(spark, rows):
    recipe = mixing.Recipe()
    mixed = mixing.mixed(documents(spark, rows), recipe)
    placed = mixing.placements(mixed, recipe).collect()
    positions = [p["position"] for p in placed]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    hot = [p for p in placed if p["source"] == "hot"]  # weight 5: from 1.5 down to 0.5
    early = sum(p["words"] for p in hot if p["position"] < 0.5)
    assert early / sum(p["words"] for p in hot) == pytest.approx(0.625, abs=0.05)
    words = defaultdict(int)
    for p in placed:
        words[p["doc_id"]] += p["words"]
    assert {r["doc_id"]: r["taken"] for r in mixed.collect() if r["taken"]} == words


def test_documents_as_taken(spark, rows):
    docs = documents(spark, rows).withColumnRenamed("n_chars", "words")
    taken = mixing.training_order(docs)
    assert taken.columns == docs.columns
    words = defaultdict(int)
    texts = {r[0]: r[1] for r in rows}
    for r in taken.collect():
        words[r["doc_id"]] += len(re.findall(mixing.WORD, r["text"]))
        assert texts[r["doc_id"]] == r["text"]
    want = {r["doc_id"]: r["taken"] for r in mixing.mixed(docs).collect() if r["taken"]}
    assert words == want


def test_missing_and_repeated_ids_are_documents_of_their_own(spark):
    rows = [(i if i % 3 else None, prose(i, 30), "en", "a") for i in range(30)]
    rows += [(5, prose(i, 30), "en", "a") for i in range(40, 50)] + [(6, prose(60, 30), "en", "a")] * 3
    recipe = mixing.Recipe(share=2.0)  # one source at its cap: all rows twice, none cut
    taken = mixing.training_order(documents(spark, rows), recipe).collect()
    assert sorted(r["text"] for r in taken) == sorted(2 * [r[1] for r in rows])


def test_whole_texts_of_many_small_sources(spark):
    """Sources of one or two documents: each text is taken whole or not at all."""
    rows = [(i, prose(i, 20 + i), "en", f"host{i // 2}") for i in range(60)]
    taken = mixing.training_order(documents(spark, rows)).collect()
    texts = {r[0]: r[1] for r in rows}
    assert taken and all(texts[r["doc_id"]] == r["text"] for r in taken)


def test_a_third_of_the_rows_under_one_id(spark):
    """Neither rows without id nor equal rows share a part of the stream."""
    rows = [(None, prose(i, 8), "en", "a") for i in range(1500)] + [(1, "same words here", "en", "a")] * 1500
    rows += [(i, prose(i, 8), "en", "a") for i in range(2, 1500)]
    found = mixing.mixed(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    starts = sorted((r["start"], r["size"]) for r in found)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    same = [r["start"] for r in found if r["doc_id"] == 1]
    assert max(same) - min(same) > 0.9 * found[0]["source_size"]  # spread over the whole stream


def test_odd_rows(spark):
    rows = odd_rows()
    found = mixing.mixed(documents(spark, rows).withColumnRenamed("lang", "size")).collect()
    assert len(found) == len(rows)
    assert sorted(r["size"] for r in found) == sorted(len(re.findall(mixing.WORD, r[1] or "")) for r in rows)
    assert mixing.mixed(documents(spark, [])).count() == 0
    nothing = mixing.mixed(documents(spark, [(1, None, "en", "a"), (2, "", "en", "b")])).collect()
    assert [(r["taken"], r["target"]) for r in nothing] == [(0, 0.0)] * 2
    assert mixing.training_order(documents(spark, [(1, None, "en", "a")])).count() == 0
