"""Small tables for the operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, schema=SCHEMA):
    """Rows of (doc_id, text[, lang, source]) as a table like ``documents``."""
    full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, schema)


def prose(seed, n, words=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(n or words))


def mutated(text, seed, changes):
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = "x" + str(rng.randrange(10**6))
    return " ".join(words)


def odd_rows():
    """Nulls, empty and blank texts, few words, repeated rows, a long text, odd blanks."""
    long_text = prose(5, 30_000)
    return [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "one two", "en", "b"),
        (5, "One TWO", "fr", "b"), (6, "é\x0bñ ünï\x0c日本 words\r\nhere now", "fr", "c"), (7, long_text, "en", "c"),
        (8, long_text + " tail", "en", "c"), (9, "same same " * 40, "en", "a"), (9, "same same " * 40, "en", "a"),
        (None, "no id but some words here", "en", "a"), (11, prose(1, 40), "en", "a"), (12, prose(1, 40), "de", None),
    ]
