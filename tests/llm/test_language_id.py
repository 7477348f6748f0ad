"""Languages of texts that were not learned from."""

import numpy as np
import pytest
from cartwright.llm import language_id
from frames import documents, odd_rows

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language_id.learn(docs.where(~language_id.held_out()))


def test_held_out_accuracy(docs, model):
    found = language_id.predict(docs, model).where(language_id.held_out()).collect()
    assert len(found) > 200 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.99 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_prediction_reads_the_text_only(spark, model):
    texts = [(1, "the thing of the and that", None, None), (2, "the thing of the and that", "fr", "x")]
    found = language_id.predict(documents(spark, texts), model).collect()
    assert found[0]["lang_pred"] == found[1]["lang_pred"] and found[0]["score"] == found[1]["score"]


def test_no_false_negatives_and_known_fill(model):
    text = "nicht einen ungern schönen Tag"
    for _, hashes in language_id._gram_pieces(text):
        masks = model.masks(hashes)
        for bit in range(len(model.languages)):
            assert (masks >> bit & 1).mean() >= 0
    for bit in range(len(model.languages)):
        assert model.fill[bit] == pytest.approx(((model.words >> bit) & 1).mean())
        assert model.fill[bit] ** language_id.PROBES < 0.05


def test_against_exact_ngram_sets(spark, docs, model):
    """Shares and decisions of the filter against sets of the very n-grams each language was given."""
    frequent = {}
    train = docs.where(~language_id.held_out()).where("lang is not null and text is not null").collect()
    assert len(train) < language_id.TRAIN_DOCS  # all are learned from
    counts = {}
    for r in train:
        for n, hashes in language_id._gram_pieces(r["text"]):
            mine = counts.setdefault((r["lang"], n), {})
            for h in hashes.tolist():
                mine[h] = mine.get(h, 0) + 1
    shares = {}
    for (lang, n), mine in counts.items():
        total = sum(mine.values())
        for h, times in mine.items():
            if times / total >= language_id.SHARE:
                shares.setdefault(h, {})[lang] = times / total
    for h, by_lang in shares.items():
        for lang, share in by_lang.items():
            if share >= language_id.RELATIVE * max(by_lang.values()):
                frequent.setdefault(lang, set()).add(h)
    assert tuple(sorted(frequent)) == model.languages
    agree, some = 0, docs.where(language_id.held_out()).limit(150).collect()
    for r in some:
        grams = [h for _, hashes in language_id._gram_pieces(r["text"] or "") for h in hashes.tolist()]
        lang, score = model.decide(r["text"])
        if not grams:
            assert lang == "und"
            agree += 1
            continue
        exact = {k: sum(h in held for h in grams) / len(grams) for k, held in frequent.items()}
        agree += exact[lang] == max(exact.values())
        assert abs(score - exact[lang]) < 0.05
    assert agree >= 0.98 * len(some)
    for lang, held in frequent.items():  # no false negatives
        bit = model.languages.index(lang)
        masks = model.masks(np.fromiter(held, np.uint64, len(held)))
        assert ((masks[bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)).all()


def test_marks_alone_are_no_letters(model):
    for text in ("\u0301\u0301", "\u0301 12 \u0308!", "\u093e"):
        assert model.decide(text) == ("und", 0.0) and not model.knows(text)
    assert model.decide("e\u0301")[0] != "und"


def test_many_rows_without_id_are_sampled_like_others(spark, monkeypatch):
    """Rows without id are drawn one by one: neither none of a language nor all of it."""
    monkeypatch.setattr(language_id, "TRAIN_DOCS", 200)
    texts = [(None, f"words number {i} of the text", "en", "a") for i in range(2000)]
    rows = documents(spark, texts + [(5, f"wörter nummer {i} im text", "de", "a") for i in range(2000)])
    drawn = {r["lang"]: r["count"] for r in language_id._sampled(rows).groupBy("lang").count().collect()}
    assert set(drawn) == {"en", "de"} and all(120 < n < 300 for n in drawn.values())


def test_odd_rows(spark, model):
    rows = [*odd_rows(), (20, "1234 !!! 99", "en", "a"), (21, "日本語のテキスト", "en", "a"), (22, "a", "en", "a")]
    docs = documents(spark, rows).withColumnRenamed("source", "lang_pred")
    found = language_id.predict(docs, model).collect()
    assert len(found) == len(rows)
    for r in found:
        letters = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] != "und") == letters and 0 <= r["score"] <= 1
    assert language_id.predict(documents(spark, []), model).count() == 0


def test_long_texts_are_read_whole(model, monkeypatch):
    text = "the thing and that of " * 500 + "nicht einen ungern " * 5000
    whole = model.decide(text)
    monkeypatch.setattr(language_id, "_PIECE", 1000)
    assert model.decide(text) == whole and whole[0] == "de"


def test_nothing_to_learn_from(spark):
    model = language_id.learn(documents(spark, [(1, None, "en", "a"), (2, "text", None, "a")]))
    assert model.languages == () and model.decide("text") == ("und", 0.0)


def test_held_out_rows(spark):
    from zlib import crc32

    rows = documents(spark, [(i, "x") for i in range(50)] + [(None, "x")]).select("doc_id", language_id.held_out().alias("h"))
    assert all(r["h"] == (r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows.collect())


def test_more_languages_than_bits_of_a_word(spark):
    """Each label has letters of its own; those after the 64th are learned like the first."""
    import random

    rng, rows = random.Random(3), []
    for i in range(130):
        letters = [chr(0x4E00 + 30 * i + j) for j in range(20)]
        text = " ".join("".join(rng.choices(letters, k=4)) for _ in range(30))
        rows += [(1000 * i + j, text, f"l{i:03}", "x") for j in range(1 + (i < 64))]
    docs = documents(spark, rows)
    model = language_id.learn(docs)
    assert len(model.languages) == 130 and model.words.shape == (3, language_id.SLOTS)
    found = language_id.predict(docs, model).collect()
    assert len(found) == len(rows) and all(r["lang_pred"] == r["lang"] and r["score"] > 0.9 for r in found)


def test_the_language_stage_acts_on_the_decision(spark, docs):
    import corpus_pipeline

    clean = [r["text"] for r in docs.where("lang is not null and n_chars > 200").limit(40).collect()]
    junk = ["日本語のテキストです。" * 20, "ქართული ენა არის " * 20, "ཨ་ཨ་", "1234 !!! 99", "", None]
    planted = documents(spark, [(10**9 + i, t) for i, t in enumerate(clean + junk)])
    table = docs.select(*planted.columns).union(planted)
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, table, SF_DIR).collect()}
    assert {i - 10**9 for i in kept if i >= 10**9} == set(range(len(clean)))


def test_without_labels_texts_with_letters_stay(spark):
    import corpus_pipeline

    rows = documents(spark, [(1, "some text", None, "a"), (2, "日本語", None, "a"), (3, "123", None, "a"), (4, None)])
    assert sorted(r["doc_id"] for r in corpus_pipeline.known_language(spark, rows, SF_DIR).collect()) == [1, 2]
