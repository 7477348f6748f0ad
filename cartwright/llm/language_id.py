"""Language identification with bit-sliced Bloom filters of character n-grams.

A learned model is an array of 64-bit words for every 64 languages. A language is a bit, so one look
at an n-gram's positions, and'ed, names every language that has it. Each language's bits form an ordinary Bloom
filter; how full that slice is gives its rate of false positives, by which the counts of a text's
hits are corrected before they decide.
"""

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartwright.llm.tables import Scratch
from cartwright.llm.words import mixed

#: n-grams of these lengths; a word has one space on either side.
LENGTHS = (2, 3, 4)
#: Bits of a language's slice, and positions of an n-gram.
SLOTS, PROBES = 1 << 20, 3
#: An n-gram belongs to a language if it is at least so frequent among the n-grams of its length.
SHARE = 2e-5
#: ... and at least this part as frequent as in the language where it is most frequent.
RELATIVE = 0.2
#: At most so many labelled documents of a language are learned from (in expectation).
TRAIN_DOCS = 20_000
#: A task hands on its counts when it holds so many n-grams.
HELD_GRAMS = 1_000_000
#: A language is a bit of a word; there are as many words a slot as the languages need.
WORD_BITS = 64
UNKNOWN = "und"
#: A text is in a learned language if its distinct n-grams' hits exceed the expected false positives by more than one
#: and so many standard deviations.
DEVIATIONS = 3
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 19


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point: 2 for a letter, 1 for a mark, which belongs to one, 0 for all else."""
    kinds = {"L": 2, "M": 1}
    return np.fromiter((kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)), np.uint8, 0x110000)


def _gram_pieces(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hashes) of the text's n-grams: letters in lower case, all else as one space.

    A long text is read in pieces that overlap by what an n-gram needs.
    """
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _letters()[points]
    if not (kinds == 2).any():
        return
    letter = kinds > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of each run of others stays, as a space
    kept = np.where(letter, points, 32)[keep].astype(np.uint64)
    kept = np.concatenate(([32] if kept[0] != 32 else [], kept, [32] if kept[-1] != 32 else [])).astype(np.uint64)
    for at in range(0, len(kept), _PIECE):
        for n in LENGTHS:
            part = kept[at : at + _PIECE + n - 1]
            count = max(len(part) - n + 1, 0)
            h = np.full(count, n, np.uint64)
            for j in range(n):
                h = h * _STEP + part[j : j + count]
            yield n, mixed(h)


@dataclass(frozen=True)
class Model:
    """Languages in their order (bit 0 of word 0 first), the words of bits (a row for every 64
    languages, a column a slot), and each slice's fill."""

    languages: tuple[str, ...]
    words: np.ndarray
    fill: np.ndarray

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """For each n-gram (column) the set of languages that have it, as bits of the words (rows)."""
        found = np.full((len(self.words), len(hashes)), 2**64 - 1, np.uint64)
        for spot in _positions(hashes):
            found &= self.words[:, spot]
        return found

    def decide(self, text) -> tuple[str, float]:
        """(language, share of the text's n-grams that it has, corrected for false positives)."""
        total, hits = self._hits(h for _, h in _gram_pieces(text)) if isinstance(text, str) else (0, None)
        if not total or not self.languages:
            return UNKNOWN, 0.0
        false = self._false()
        real = np.clip((hits - total * false) / (1 - false), 0, total)
        best = int(np.argmax(real))  # the first of equals
        return self.languages[best], float(real[best] / total)

    def knows(self, text) -> bool:
        """Whether some language has more of the text's distinct n-grams than false positives explain.

        Without learned languages every text with a letter is known: there is nothing to judge by.
        """
        pieces = [np.unique(h) for _, h in _gram_pieces(text)] if isinstance(text, str) else []
        total, hits = self._hits([np.unique(np.concatenate(pieces))] if pieces else [])
        if not total or not self.languages:
            return total > 0
        false = self._false()
        chance = total * false + 1 + DEVIATIONS * np.sqrt(total * false * (1 - false))
        return bool((hits > chance).any())

    def _false(self) -> np.ndarray:
        return np.minimum(self.fill**PROBES, 0.999999)

    def _hits(self, pieces: Iterable[np.ndarray]) -> tuple[int, np.ndarray]:
        """How many n-grams there are, and how many of them each language seems to have."""
        total, hits = 0, np.zeros(len(self.languages))
        for hashes in pieces:
            masks = self.masks(hashes)
            total += len(hashes)
            for i in range(len(self.languages)):
                word, bit = divmod(i, WORD_BITS)
                hits[i] += np.count_nonzero(masks[word] & np.uint64(1 << bit))
        return total, hits


def _positions(hashes: np.ndarray) -> Iterator[np.ndarray]:
    for probe in range(PROBES):
        yield (hashes >> np.uint64(20 * probe)) & np.uint64(SLOTS - 1)


def _sampled(rows: DataFrame) -> DataFrame:
    """All labelled documents of a language, or about TRAIN_DOCS of them, picked by id and text."""
    counts = rows.groupBy("lang").agg(F.count("*").alias("docs"))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(F.broadcast(counts), "lang").where(draw * F.col("docs") < TRAIN_DOCS)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all parts and their summed counts."""
    grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64)


def _rows(sums: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
    for (lang, n), (grams, times) in sums.items():
        yield pd.DataFrame({"lang": lang, "n": n, "gram": grams.view(np.int64), "times": times})


def learn(rows: DataFrame) -> Model:
    """A model of the labelled rows (doc_id, text, lang).

    Texts are counted whole. An n-gram is used if it is frequent enough, which holds for at most
    ``1 / SHARE`` a language and length; what reaches the driver is the words that are not zero, at
    most ``SLOTS`` for every 64 languages. Rows without lang or text teach nothing.
    """
    rows = rows.select("doc_id", "lang", "text").where("lang is not null and text is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            found: dict[tuple[str, int], list] = {key: [s] for key, s in sums.items()}
            for lang, text in zip(batch["lang"], batch["text"]):
                for n, hashes in _gram_pieces(text):
                    found.setdefault((lang, n), []).append(np.unique(hashes, return_counts=True))
            sums = {key: _merged(parts) for key, parts in found.items()}
            if sum(len(grams) for grams, _ in sums.values()) > HELD_GRAMS:
                yield from _rows(sums)
                sums = {}
        yield from _rows(sums)

    scratch = Scratch(rows.sparkSession)
    counted = scratch.stored(
        _sampled(rows)
        .mapInPandas(count, "lang string, n long, gram long, times long")
        .groupBy("lang", "n", "gram")
        .agg(F.sum("times").alias("times"))
    )
    totals = counted.groupBy("lang", "n").agg(F.sum("times").alias("all"))
    shares = counted.join(F.broadcast(totals), ["lang", "n"]).select(
        "lang", "gram", (F.col("times") / F.col("all")).alias("share")
    ).where(F.col("share") >= SHARE)
    most = F.max("share").over(Window.partitionBy("gram"))
    frequent = scratch.stored(
        shares.withColumn("most", most).where(F.col("share") >= RELATIVE * F.col("most")).select("lang", "gram")
    )
    languages = tuple(sorted(r["lang"] for r in frequent.select("lang").distinct().collect()))
    words = np.zeros((max(1, -(-len(languages) // WORD_BITS)), SLOTS), np.uint64)
    if languages:
        numbers = rows.sparkSession.createDataFrame(list(enumerate(languages)), "number int, lang string")
        spots = [
            F.shiftrightunsigned("gram", 20 * probe).bitwiseAND(F.lit(SLOTS - 1)) for probe in range(PROBES)
        ]
        bit = F.expr(f"shiftleft(1L, number % {WORD_BITS})")
        cells = frequent.join(F.broadcast(numbers), "lang").select(
            F.floor(F.col("number") / WORD_BITS).alias("word"), bit.alias("bit"), F.explode(F.array(*spots)).alias("spot")
        ).groupBy("word", "spot").agg(F.bit_or("bit").alias("bits")).toPandas()
        words[cells["word"].to_numpy(), cells["spot"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    scratch.remove()
    places = (divmod(i, WORD_BITS) for i in range(len(languages)))
    fill = np.array([np.count_nonzero(words[w] & np.uint64(1 << b)) / SLOTS for w, b in places])
    return Model(languages, words, fill)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents set aside: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with ``lang_pred`` and ``score``, from their whole texts alone.

    A text that is null or has no letter is ``und`` with score 0. Any other gets a learned
    language, the first by name among equals; its score is the share of n-grams that language has.
    Other columns pass through; ``lang_pred`` and ``score`` of the input are replaced.
    """
    learned = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB for every 64 languages

    @F.pandas_udf("lang_pred string, score double")
    def decide(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([learned.value.decide(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn("_decision", decide("text")).withColumns(
        {"lang_pred": F.col("_decision.lang_pred"), "score": F.col("_decision.score")}
    ).drop("_decision")


def known(docs: DataFrame, model: Model) -> DataFrame:
    """The documents in a learned language (``Model.knows``), with their columns."""
    learned = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def knows(texts: pd.Series) -> pd.Series:
        return pd.Series([learned.value.knows(t) for t in texts], dtype=bool)

    return docs.where(knows("text"))


def identified(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents that are not held out, then predict all documents."""
    return predict(docs, learn(docs.where(~held_out())))
