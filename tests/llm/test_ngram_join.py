"""Near copies against all pairs."""

import re
from itertools import combinations

import pytest
from cartwright.llm import ngram_join
from cartwright.llm.components import components
from frames import documents, mutated, odd_rows, prose


def sets(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(doc_id, size, component) by comparing all rows with all."""
    grams = [sets(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if rows[i][0] == rows[j][0] or 100 * len(grams[i] & grams[j]) >= 75 * len(grams[i] | grams[j]) > 0:
            parent[root(i)] = root(j)
    smallest = {}
    for i, row in enumerate(rows):
        smallest[root(i)] = min(smallest.get(root(i), row[0]), row[0])
    return sorted((row[0], len(grams[i]), smallest[root(i)]) for i, row in enumerate(rows))


def result(frame):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in frame.collect())


@pytest.mark.parametrize("changes", [2, 5])
def test_families_of_near_copies(spark, changes):
    rows, number = [], 0
    for family in range(6):
        base = prose(family, 80 + 10 * family)
        for copy in range(12):
            rows.append((number, mutated(base, number, copy % (changes + 1))))
            number += 1
    rows += [(1000 + i, prose(100 + i, 50)) for i in range(20)]
    # A passage in all of them makes frequent columns.
    passage = prose(77, 15)
    rows = [(i, f"{text}\n{passage}") for i, text in rows]
    assert result(ngram_join.near_copies(documents(spark, rows), chunk_bytes=4000)) == brute(rows)


def test_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    assert result(ngram_join.near_copies(documents(spark, rows))) == brute(rows)


def test_missing_id_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(None, "a b c d e f", 1, 2), (3, "a b c d e f", 1, 2), (4, "g h", 1, 2)],
        "doc_id long, text string, component_id long, size long",
    )
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.near_copies(docs).collect()}
    assert found == {None: None, 3: None, 4: 4}
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None, 4}


def test_missing_and_repeated_ids_keep_distinct_texts(spark):
    """Rows without id, and rows of one id, link by their texts only."""
    first, second = prose(1, 80), prose(2, 80)
    rows = [
        (None, first), (None, second), (None, prose(3, 80)), (None, prose(4, 80)), (None, ""), (None, ""),
        (7, mutated(first, 7, 1)), (9, mutated(second, 9, 1)),
        (20, prose(5, 90)), (20, prose(6, 90)), (21, mutated(prose(5, 90), 1, 2)), (22, mutated(prose(6, 90), 2, 2)),
        (19, mutated(prose(6, 90), 3, 2)), (30, prose(8, 40)), (30, prose(9, 40)), (31, prose(10, 40)), (31, prose(10, 40)),
    ]
    docs = documents(spark, rows)
    found = sorted((r["doc_id"] or -1, r["component_id"]) for r in ngram_join.near_copies(docs).collect() if r["doc_id"])
    assert found == [
        (7, None), (9, None), (19, 19), (20, 19), (20, 20), (21, 20), (22, 19), (30, 30), (30, 30), (31, 31), (31, 31)
    ]
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in ngram_join.one_of_each(docs).collect())
    want = [*rows[:6], rows[8], rows[12], *rows[13:16]]
    assert kept == sorted((i or -1, text) for i, text in want)


def test_empty_table(spark):
    assert ngram_join.near_copies(documents(spark, [])).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (50, 40), (40, 50)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}, 40: 40, 50: 40}
