"""Passages that repeat across documents, removed from all but the first.

The graph's edges are windows of ``width`` words between nodes of one word less. Which document
holds an edge first is asked of the whole corpus at once (``exchange``: edges are joined by hash, a
chunk asks once for each). Along a document, edges that follow each other and have the same
first holder form one path without a branch; it becomes one row with its coordinates, so a repeated
passage costs a row and not a row for each of its windows. ``checked`` compares a path's words with
those at its source.
"""

from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.llm.exchange import (
    CHUNK_BYTES, as_id, as_number, ask_corpus, in_chunks, with_null_id,
)
from cartwright.llm.words import encoded, gram_hashes, text_of_word, word_hashes

WIDTH = 13
_SCHEMA = (
    "doc_id long, n_words long, n_removed long, kept string, "
    "paths array<struct<start: long, words: long, source_id: long>>"
)


def _edges(group: pd.DataFrame, width: int):
    """(texts, word offsets, edges, their first words, the documents of these as numbers)."""
    texts = encoded(group["text"])
    hashes, offsets = word_hashes(texts)
    owner = text_of_word(offsets)
    grams = gram_hashes(hashes, width)
    at = np.flatnonzero(owner[: len(grams)] == owner[width - 1 :]) if len(grams) else np.zeros(0, np.int64)
    numbers = as_number(group["doc_id"].to_numpy())
    return texts, offsets, grams[at], at, numbers[owner[at]]


def _paths(at: np.ndarray, sources: np.ndarray, begin: int, width: int) -> list[tuple[int, int, int]]:
    """Runs of a document's repeated edges with one source: (first word, words, source)."""
    if not len(at):
        return []
    breaks = np.flatnonzero((np.diff(at) != 1) | (sources[1:] != sources[:-1])) + 1
    lows, highs = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(at)]))
    ids = as_id(sources[lows])
    return [
        (int(at[lo] - begin), int(at[hi - 1] - at[lo] + width), int(i)) for lo, hi, i in zip(lows, highs, ids)
    ]


def without_repeats(
    docs: DataFrame, width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, paths): a row for every document.

    A word goes if some window of ``width`` words of its document that covers it also starts in a
    document with a smaller doc_id; windows are taken from the texts as they came. ``kept`` has the
    words left, joined by one space. ``paths`` has the first word, the number of words and the
    source of each path. Null and empty texts have no words; a missing doc_id is smaller than any;
    rows of one doc_id don't remove from each other; other columns are not read; an empty table
    gives no rows. Windows are compared by 64-bit hashes.
    """

    def ask(group: pd.DataFrame):
        _, _, edges, _, owners = _edges(group, width)
        order = np.argsort(edges, kind="stable")
        edges, owners = edges[order], owners[order]
        if not len(edges):
            return edges, owners
        starts = np.flatnonzero(np.concatenate(([True], edges[1:] != edges[:-1])))
        return edges[starts], np.minimum.reduceat(owners, starts)

    def first(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(numbers, starts)

    def answer(group: pd.DataFrame, keys: np.ndarray, firsts: np.ndarray) -> pd.DataFrame:
        texts, offsets, edges, at, owners = _edges(group, width)
        sources = firsts[np.searchsorted(keys, edges)]
        repeated = sources < owners
        at, sources = at[repeated], sources[repeated]
        turns = np.zeros(offsets[-1] + 1, np.int64)
        np.add.at(turns, at, 1)
        np.add.at(turns, at + width, -1)
        keep = np.cumsum(turns)[:-1] == 0
        cuts = np.searchsorted(at, offsets)
        rows = []
        for i, (doc_id, text) in enumerate(zip(group["doc_id"], texts)):
            lo, hi = offsets[i], offsets[i + 1]
            words, own = text.split(), keep[lo:hi]
            kept = words if own.all() else list(compress(words, own))
            paths = _paths(at[cuts[i] : cuts[i + 1]], sources[cuts[i] : cuts[i + 1]], lo, width)
            rows.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace"), paths))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept", "paths"])

    dealt, chunks, partitions = in_chunks(docs, chunk_bytes)
    return with_null_id(ask_corpus(dealt, chunks, partitions, ask, first, answer, _SCHEMA), "doc_id")


def checked(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, start, words, source_id, source_start) of the paths of ``rows``.

    The path's words are looked up in the source's text; ``source_start`` is where they stand, or
    null if they stand there in parts only, with a branch between. Equal requests to one source are
    made once.
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x09-\x0D ]+"), lambda w: w != "")
    worded = docs.select("doc_id", F.array_join(words, " ").alias("line"), words.alias("list"))
    paths = rows.select("doc_id", F.explode("paths").alias("path")).select("doc_id", "path.*")
    lines = paths.join(worded.select("doc_id", "list"), "doc_id").select(
        "doc_id", "start", "words", "source_id",
        F.array_join(F.slice("list", (F.col("start") + 1).cast("int"), F.col("words").cast("int")), " ").alias("passage"),
    )
    asked = lines.select("source_id", "passage").distinct()
    source = worded.select(F.col("doc_id").alias("source_id"), F.concat(F.lit(" "), "line", F.lit(" ")).alias("line"))
    padded = F.concat(F.lit(" "), F.col("passage"), F.lit(" "))
    found = asked.join(source, "source_id").withColumn("padded", padded).where(F.col("line").contains(F.col("padded")))
    spots = found.select(
        "source_id", "passage",
        F.regexp_count(F.expr("left(line, locate(padded, line) - 1)"), F.lit("[^ ]+")).cast("bigint").alias("source_start"),
    )
    return lines.join(spots, ["source_id", "passage"], "left").select(
        "doc_id", "start", "words", "source_id", "source_start"
    )
