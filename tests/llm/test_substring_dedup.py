"""Repeated passages against a dictionary of all windows."""

import re

import pytest
from cartwright.llm import substring_dedup
from frames import documents, odd_rows, prose


def brute(rows, width=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    ids = [-(2**63) if r[0] is None else r[0] for r in rows]
    first = {}
    for own, w in zip(ids, words):
        for i in range(len(w) - width + 1):
            edge = tuple(w[i : i + width])
            first[edge] = min(first.get(edge, own), own)
    out = []
    for row, own, w in zip(rows, ids, words):
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < own for j in range(i, i + width)}
        out.append((str(row[0]), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def result(frame):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in frame.collect())


@pytest.fixture(scope="module")
def passages():
    shared = [prose(i, 20 + 7 * i) for i in range(4)]
    rows = [(i, f"{prose(50 + i, 30)}\n{shared[i % 4]} {prose(90 + i, 25)} {shared[(i + 1) % 4]}") for i in range(30)]
    return [*rows, (31, rows[3][1]), (32, prose(9, 12)), (33, prose(9, 12)), (34, prose(8, 13)), (35, prose(8, 13))]


def test_passages(spark, passages):
    frame = substring_dedup.without_repeats(documents(spark, passages), chunk_bytes=1500)
    assert result(frame) == brute(passages)


def test_paths_are_found_at_their_source(spark, passages):
    docs = documents(spark, passages)
    rows = substring_dedup.without_repeats(docs, chunk_bytes=1500)
    texts = {i: t.split() for i, t in passages}
    found = substring_dedup.checked(docs, rows).collect()
    assert len(found) > 30
    for path in found:
        own = texts[path["doc_id"]][path["start"] : path["start"] + path["words"]]
        at = path["source_start"]
        assert path["source_id"] < path["doc_id"] and own == texts[path["source_id"]][at : at + path["words"]]


def test_odd_rows(spark):
    rows = odd_rows()
    docs = documents(spark, rows).withColumnsRenamed({"lang": "kept", "source": "paths"})
    assert result(substring_dedup.without_repeats(docs)) == brute(rows)
    assert substring_dedup.without_repeats(documents(spark, [])).count() == 0
