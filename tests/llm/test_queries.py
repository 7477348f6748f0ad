"""Every query against DuckDB, and the pipeline's rules."""

import re
import sys
from collections import Counter
from pathlib import Path

import compare
import public_tokenizers
import pytest
import tiktoken
from cartwright.llm import bpe, mixing, ngram_join, pii
from cartwright.llm.oracle import ORACLE
from cartwright.llm.queries import QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


def test_numbers_and_sql():
    assert [re.match(r"op(\d+)_", name)[1] for name in QUERIES] == [str(n) for n in range(1, 14)]
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_rows(spark, duck, name):
    duck.execute(f"CREATE OR REPLACE VIEW oracle_{name} AS {ORACLE[name]}")
    result = QUERIES[name](spark, SF_DIR)
    assert compare.spark_types(result) == compare.duck_types(duck, ORACLE[name])
    assert compare.spark_rows(result) == compare.duck_rows(duck, ORACLE[name])


def test_pii_query_keeps_clean_texts(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op5_pii"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    given = {}
    for row in rows:
        old, new = pii.entities(texts[row["doc_id"]]), pii.entities(row["text"])
        assert row["n_replaced"] == len(old)
        if not old:
            assert row["text"] == texts[row["doc_id"]]
        for a, b in zip(old, new):
            assert a.kind == b.kind and given.setdefault((a.kind, a.canonical), b.canonical) == b.canonical
    assert len(set(given.values())) == len(given)


def test_pipeline(spark):
    """The stages one by one give run()'s rows; each stage's decisions hold in the next."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR))
        assert docs.columns == columns
        kept.append(docs.collect())
    known, single, clean, taken = kept
    assert all(any(c.isalpha() for c in r["text"]) for r in known)
    groups = {r["component_id"] for r in ngram_join.near_copies(spark.createDataFrame(known, docs.schema)).collect()}
    assert {r["doc_id"] for r in single} == groups and len(single) == len(groups)
    assert [r["doc_id"] for r in sorted(clean)] == [r["doc_id"] for r in sorted(single)]
    private = {e.canonical for r in single for e in pii.entities(r["text"])}
    assert private and not any(p in (r["text"] or "").lower() for r in clean for p in private)
    words = Counter()
    for r in taken:
        words[r["doc_id"]] += len(re.findall(mixing.WORD, r["text"]))
    sizes = {r["doc_id"]: len(re.findall(mixing.WORD, r["text"])) for r in clean}
    longest = {}
    for r in clean:
        longest[r["source"]] = max(longest.get(r["source"], 0), sizes[r["doc_id"]])
    assert abs(sum(words.values()) - 1.5 * sum(sizes.values())) <= sum(longest.values()) / 2 + len(longest)
    assert all(n in (sizes[i], 2 * sizes[i]) for i, n in words.items())
    whole = {r["doc_id"]: r["text"] for r in clean}
    assert all(r["text"] == whole[r["doc_id"]] for r in taken)
    ranks = bpe.Vocabulary.read(corpus_pipeline.RANKS).tokens
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={}
    )
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    want = Counter((r["doc_id"], tuple(library.encode_ordinary(r["text"]))) for r in taken)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables(spark, name, stage):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("false")
    assert stage(spark, docs, SF_DIR).count() == 0
