"""Stupid-backoff scores of all documents under the n-gram counts of all other documents.

The count table of all orders is partitioned by hash of the n-gram. A chunk of documents sends each
of its n-grams once, with how often it has it (``exchange``); the table's partition sums these and
hands the sums back; the chunk joins them to the n-grams of its documents in order and sums the
logarithms per document. A document's own n-grams are taken off the counts, so a word counts as
known only if others use it.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cartwright.llm.exchange import CHUNK_BYTES, ask_corpus, in_chunks, with_null_id
from cartwright.llm.words import encoded, gram_hashes, text_of_word, word_hashes

#: The key under which every chunk tells its number of words.
_ALL_WORDS = np.uint64(2**64 - 1)


def _grams(group: pd.DataFrame, order: int):
    """Word offsets, the words' texts, and for each length the n-grams with their first words."""
    hashes, offsets = word_hashes(encoded(group["text"]))
    owner = text_of_word(offsets)
    found = []
    for n in range(1, order + 1):
        grams = gram_hashes(hashes, n)
        at = np.flatnonzero(owner[: len(grams)] == owner[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
        found.append((grams[at], at))
    return offsets, owner, found


def _own_counts(owner: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """For each n-gram, how often its own document has it."""
    order = np.lexsort((ranks, owner))
    o, r = owner[order], ranks[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (r[1:] != r[:-1])
    group = np.cumsum(new) - 1
    own = np.empty(len(o), np.int64)
    own[order] = np.bincount(group)[group] if len(o) else 0
    return own


def scored(
    docs: DataFrame, order: int = 2, backoff: float = 0.4, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """(doc_id, n_words, log10_score, mean_log10): a row for every document.

    The score of a word after others is the count of the longest n-gram that ends with it and that
    other documents have, over the count of what stands before it; each shorter length costs
    ``backoff`` once more. A single word's count is taken over all words of other documents; a word
    that no other document has counts as one seen once, at one more backoff. A document without
    words, or without others that have words, has null scores. Rows of one doc_id are documents of
    their own, null ids come back as null, other columns are not read, an empty table gives no rows.
    """

    def ask(group: pd.DataFrame):
        offsets, _, found = _grams(group, order)
        keys, counts = np.unique(np.concatenate([g for g, _ in found]), return_counts=True)
        return np.append(keys[keys != _ALL_WORDS], _ALL_WORDS), np.append(counts[keys != _ALL_WORDS], offsets[-1])

    def total(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(numbers, starts)

    def answer(group: pd.DataFrame, keys: np.ndarray, totals: np.ndarray) -> pd.DataFrame:
        offsets, owner, found = _grams(group, order)
        sizes = np.diff(offsets)
        others = (int(totals[-1]) - sizes)[owner] if len(owner) else np.zeros(0, np.int64)
        # for each length: how often others have the n-gram that starts at a word; 0 where none does
        counts = []
        for grams, at in found:
            ranks = np.searchsorted(keys, grams)
            all_ = np.zeros(len(owner), np.int64)
            all_[at] = totals[ranks].astype(np.int64) - _own_counts(owner[at], ranks)
            counts.append(all_)
        with np.errstate(divide="ignore", invalid="ignore"):
            # from unknown words up to the longest n-gram; index is the last word
            share = np.where(counts[0] > 0, counts[0] / others, backoff / others) if len(owner) else np.zeros(0)
            place = np.arange(len(owner)) - offsets[owner]
            for n in range(2, order + 1):
                longer = np.zeros(len(owner))
                has = np.zeros(len(owner), bool)
                ends = slice(n - 1, None)
                longer[ends] = counts[n - 1][: len(owner) - n + 1] / counts[n - 2][: len(owner) - n + 1]
                has[ends] = counts[n - 1][: len(owner) - n + 1] > 0
                possible = place >= n - 1
                share = np.where(possible & has, longer, np.where(possible, backoff * share, share))
            logs = np.log10(share)
        sums = np.bincount(owner, logs, minlength=len(sizes)) if len(owner) else np.zeros(len(sizes))
        known = (sizes > 0) & (int(totals[-1]) - sizes > 0)
        return pd.DataFrame(
            {
                "doc_id": group["doc_id"],
                "n_words": sizes,
                "log10_score": pd.Series(np.where(known, sums, None), dtype=object),
                "mean_log10": pd.Series(np.where(known, sums / np.maximum(sizes, 1), None), dtype=object),
            }
        )

    dealt, chunks, partitions = in_chunks(docs, chunk_bytes)
    schema = "doc_id long, n_words long, log10_score double, mean_log10 double"
    return with_null_id(ask_corpus(dealt, chunks, partitions, ask, total, answer, schema), "doc_id")
