"""Documents as tokens, packed into sequences of a fixed length.

Lengths are small whole numbers, so that a histogram of them, a few thousand counts whatever the
corpus, is all that planning needs. Pieces in falling order of length are numbered from 0; the plan
says which run of numbers goes to which run of sequences:

- pieces as long as a sequence fill one each;
- large ones fall into groups of equal cardinality and count as the longest of their group. For these few
  sizes the configurations of a sequence are optimised by column generation; the group's actual
  documents take the places of its size, which leaves known gaps;
- what rounding down leaves of the configurations, and the small ones, go by falling length to the sequence
  with the least gap that holds them, many of one length at once; else to a new sequence.

Spark numbers the pieces, looks up their runs and sums the offsets in each sequence.
"""

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from cartwright.llm.memory import released_batches
from cartwright.llm.tables import Scratch, stored

CAPACITY = 4096
#: Pieces longer than the sequence over this are large; smaller ones fill what these leave.
LARGE = 3
#: Groups of large pieces, and so sizes of the configurations: few leave more even gaps, many round up
#: less. All are planned, and the plan of the fewest sequences is taken.
GROUPS = (24, 96, 300)
#: Words whose ids a task keeps at once.
KNOWN_WORDS = 400_000
#: Characters of text whose new words are encoded together.
TOGETHER = 1 << 20


# ---- tokens ---------------------------------------------------------------------------------

#: ASCII that is neither letter, digit, blank nor apostrophe, as a class of characters.
_SIGNS = r"!-&(-/:-@\[-`{-~"
#: Signs that may belong to what stands beside them, as that is neither letter nor digit nor blank.
_BESIDE = rf"(?:[^\w\s{_SIGNS}]|[\x1c-\x1f])"
_ATTACHED = re.compile(rf"[{_SIGNS}](?:(?={_BESIDE})|(?<={_BESIDE}[{_SIGNS}]))")
_PARTS = re.compile(rf"[^\x09-\x0d {_SIGNS}]+|[{_SIGNS}]+".encode())
#: How a token that ends a word is marked.
_WORD_END = "</w>"


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer's file, which of its ids end a word, and its special tokens."""

    content: str
    ends: np.ndarray
    special: tuple[bytes, ...]

    @classmethod
    def of(cls, content: str) -> "Vocabulary":
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(content)
        ids = library.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(ids.values()) + 1, bool)
        ends[[i for token, i in ids.items() if token.endswith(_WORD_END)]] = True
        return cls(content, ends, tuple(t.content.encode() for t in library.get_added_tokens_decoder().values()))


class Encoder:
    """Ids of whole texts by a tokenizer that never joins text across white space or between a letter and
    a sign beside it, and that takes A to Z as a to z: what files with word ends and lower case do.

    Each distinct word, without the signs around it, is encoded once; a text's ids are those of its words
    and signs. Texts whose signs may belong to what stands beside them are cut at white space only.
    """

    def __init__(self, vocabulary: Vocabulary, end: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary.content)
        self.ends = vocabulary.ends
        self.special = re.compile(b"|".join(map(re.escape, vocabulary.special)) or rb"(?!)")
        self.end = np.array([end], "<u4").tobytes()
        self.known: dict[bytes, bytes] = {}

    def _encode(self, parts: list[bytes]) -> None:
        """Words of letters are encoded many at once, and told apart by the tokens that end a word."""
        letters, others = [], []
        for part in parts:
            text = part.decode()
            (letters if text.isalpha() else others).append((part, text))
        for lo in range(0, len(letters), 400):
            some = letters[lo : lo + 400]
            line = self.library.encode_batch_fast([" ".join(t for _, t in some)], add_special_tokens=False)[0]
            ids = np.array(line.ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(some):
                others += some
                continue
            content, at = ids.tobytes(), 0
            for (part, _), to in zip(some, cuts.tolist()):
                self.known[part] = content[at:to]
                at = to
        for lo in range(0, len(others), 4096):
            some = others[lo : lo + 4096]
            found = self.library.encode_batch_fast([t for _, t in some], add_special_tokens=False)
            for (part, _), encoding in zip(some, found):
                self.known[part] = np.array(encoding.ids, "<u4").tobytes()

    def _parts(self, text) -> list[bytes]:
        if not isinstance(text, str) or not text:
            return []
        content = text.encode("utf-8", "replace")
        if _ATTACHED.search(text) or self.special.search(content):
            return content.split()
        return _PARTS.findall(content.lower())

    def ids(self, texts: list) -> Iterator[np.ndarray]:
        """Little-endian unsigned 32-bit ids of each text, and the id that ends a document."""
        at = 0
        while at < len(texts):
            some, size = [], 0
            while at < len(texts) and (not some or size < TOGETHER):
                size += len(texts[at]) if isinstance(texts[at], str) else 0
                some.append(self._parts(texts[at]))
                at += 1
            if len(self.known) > KNOWN_WORDS:
                self.known = {}
            self._encode(list(set().union(*some).difference(self.known)))
            get = self.known.__getitem__
            for parts in some:
                yield np.frombuffer(b"".join(map(get, parts)) + self.end, "<u4")


def pieces(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], part, nth): documents as pieces of tokens.

    ``tokenizer`` is the content of a tokenizer's file. Each document's ids end with ``end``, so that a
    null or empty text has one; only longer ones than ``capacity`` are cut. Rows of equal or no doc_id are
    documents of their own; other columns are not read. ``nth`` counts the pieces of one length in
    a task, ``part`` is its number. Columns other than doc_id and text are not read.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "part", "nth"]
    vocabulary = Vocabulary.of(tokenizer)

    @released_batches
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder = Encoder(vocabulary, end)
        part, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch["doc_id"].tolist(), encoder.ids(batch["text"].tolist())):
                for piece, lo in enumerate(range(0, len(ids), capacity)):
                    here = ids[lo : lo + capacity]
                    row = [doc_id, piece, lo, len(here), zlib.crc32(here)]
                    out.append((*row, *[here.astype(np.int64)] * with_ids, part, int(met[len(here)])))
                    met[len(here)] += 1
                if with_ids and len(out) >= 200:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    columns = "doc_id string, piece int, start long, length long, ids_crc32 long"
    columns += ", ids array<long>" * with_ids + ", part int, nth long"
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, columns)
    return rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


# ---- plan -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Plan:
    """Runs of pieces: those from ``first[i]`` on go to the sequences from ``sequence[i]`` on,
    ``each[i]`` to a sequence. ``before[l]`` is the number of pieces longer than l."""

    before: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    sequences: int

    def of(self, numbers: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.first, numbers, "right") - 1
        return self.sequence[run] + (numbers - self.first[run]) // self.each[run]


def _fullest(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the highest value that fits (a knapsack without limits)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for item, (size, value) in enumerate(zip(sizes.tolist(), values.tolist())):
        for lo in range(size, capacity + 1, size):  # rooms lo to lo + size build on those one size less
            hi = min(lo + size, capacity + 1)
            gains = best[lo - size : hi - size] + value
            better = gains > best[lo:hi] + 1e-12
            best[lo:hi][better], last[lo:hi][better] = gains[better], item
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while last[room] >= 0:
        counts[last[room]] += 1
        room -= int(sizes[last[room]])
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(configuration, times): how many of each size share a sequence, so that few sequences hold
    ``counts`` of the sizes; rounded down, so that some of each size are left.

    Column generation: prices of the sizes come from the configurations in use; the one worth most
    at these prices enters as long as it is worth more than the sequence it takes.
    """
    k = len(sizes)
    base = np.diag(np.maximum(capacity // sizes, 1)).astype(float)
    times = counts / base.diagonal()
    for _ in range(40 * k):
        prices = np.linalg.solve(base.T, np.ones(k))
        worth, entering = _fullest(sizes, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        column = np.linalg.solve(base, entering.astype(float))
        ratios = np.full(k, np.inf)
        np.divide(times, column, out=ratios, where=column > 1e-9)
        leaving = int(ratios.argmin())
        step = ratios[leaving]
        if not np.isfinite(step):
            break
        times = np.maximum(times - step * column, 0)
        times[leaving], base[:, leaving] = step, entering
    whole = np.floor(times + 1e-9).astype(np.int64)
    used = [[base[:, j].astype(np.int64), int(whole[j])] for j in range(k) if whole[j]]
    left = counts - sum((c * n for c, n in used), np.zeros(k, np.int64))
    for config in used:  # rounding may ask for one too many
        while (left < 0).any() and config[1] and (config[0][left < 0] > 0).any():
            config[1] -= 1
            left = left + config[0]
    return [(c, n) for c, n in used if n]


def plan(
    lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS
) -> Plan:
    """Where to put ``counts`` pieces of ``lengths`` (1 to capacity): the best of one plan for each
    number of groups. Work and size depend on the number of distinct lengths, not on the counts."""
    return min((_planned(lengths, counts, capacity, n) for n in groups), key=lambda p: p.sequences)


def _planned(lengths: np.ndarray, counts: np.ndarray, capacity: int, groups: int) -> Plan:
    of_length = np.zeros(capacity + 2, np.int64)
    of_length[lengths] = counts
    longer = np.concatenate((np.cumsum(of_length[::-1])[::-1][1:], [0]))  # [l]: pieces longer than l
    ends = longer[:-1] + of_length[: capacity + 1]  # [l]: pieces of at least l

    def length_at(number: int) -> int:
        """The length of a piece by its number: the least l with more than so many at least as long."""
        return capacity - int(np.searchsorted(ends[::-1], number, "right"))

    runs: list[tuple[int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_gaps: list[int] = []
    sequences = int(of_length[capacity])
    if sequences:
        runs.append((0, 0, 1))

    def add_gap(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((sequence, n))

    # large pieces: groups of equal cardinality, each counted as its longest
    lo, hi = sequences, int(longer[capacity // LARGE])
    starts = np.unique(np.linspace(lo, hi, min(groups, max(hi - lo, 1)) + 1).astype(np.int64)) if hi > lo else np.array([lo])
    left, by_size = [], {}
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        span = by_size.setdefault(length_at(a), [a, b])  # groups of one size are neighbours
        span[1] = b
    sizes, spans = np.array(list(by_size), np.int64), list(by_size.values())
    if len(sizes):
        for config, times in configurations(sizes, np.array([b - a for a, b in spans]), capacity):
            slots = []
            for group in np.flatnonzero(config):
                for _ in range(int(config[group])):
                    slots.append(spans[group][0])
                    runs.append((spans[group][0], sequences, 1))
                    spans[group][0] += times
            # lengths of the actual documents in each slot change at few places
            cuts = {0}
            for at in slots:
                inner = ends[(ends > at) & (ends < at + times)] - at
                cuts.update(inner.tolist())
            cuts = [*sorted(cuts), times]
            for a, b in zip(cuts, cuts[1:]):
                add_gap(capacity - sum(length_at(at + a) for at in slots), sequences + a, b - a)
            sequences += times
    for a, b in spans:
        if b > a:
            left.append((a, b))
    if hi < int(longer[0]):
        left.append((hi, int(longer[0])))

    # best fit, by falling length
    for begin, end in left:
        at = begin
        while at < end:
            length = length_at(at)
            until = min(end, int(ends[length]))
            while at < until:
                n = until - at
                where = bisect_left(open_gaps, length)
                if where == len(open_gaps):
                    fresh = -(-n // (capacity // length))
                    add_gap(capacity, sequences, fresh)
                    sequences += fresh
                    continue
                gap = open_gaps[where]
                sequence, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    open_gaps.pop(where)
                each = gap // length
                used = min(count, n // each)
                if not used:
                    used, each = 1, n
                runs.append((at, sequence, each))
                at += used * each
                add_gap(gap, sequence + used, count - used)
                add_gap(gap - each * length, sequence, used)
    runs.sort()
    first, sequence, each = (np.array(c, np.int64) for c in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 3
    return Plan(longer[: capacity + 1], first, sequence, each, sequences)


# ---- packing --------------------------------------------------------------------------------

def placed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` of ``pieces`` from a stored table, with sequence_id and offset instead of part and nth.

    The driver gets the histogram of lengths, at most ``capacity`` rows. A piece's number is that of its
    length, plus those of its length in earlier parts, plus ``nth``; so that no length, however
    frequent, is sorted in one task.
    """
    by_part = rows.groupBy("length", "part").agg((F.max("nth") + 1).alias("n"))
    by_part = by_part.withColumn(
        "earlier", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    )
    histogram = rows.groupBy("length").count().toPandas()
    if histogram.empty:
        return rows.drop("part", "nth").withColumns(
            {"sequence_id": F.lit(None).cast("bigint"), "offset": F.lit(None).cast("bigint")}
        )
    planned = plan(histogram["length"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64), capacity)

    @F.pandas_udf(LongType())
    def number(lengths: pd.Series, nth: pd.Series) -> pd.Series:
        return pd.Series(planned.before[lengths.to_numpy()] + nth.to_numpy())

    @F.pandas_udf(LongType())
    def sequence(numbers: pd.Series) -> pd.Series:
        return pd.Series(planned.of(numbers.to_numpy()))

    keys = by_part.select(F.col("length").alias("of_length"), F.col("part").alias("of_part"), "earlier")
    numbered = rows.join(keys, (F.col("length") == F.col("of_length")) & (F.col("part") == F.col("of_part")))
    numbered = numbered.withColumn("number", number("length", F.col("earlier") + F.col("nth")))
    numbered = numbered.withColumn("sequence_id", sequence("number"))
    inside = Window.partitionBy("sequence_id").orderBy("number")  # at most ``capacity`` pieces
    offset = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return numbered.withColumn("offset", offset).drop("part", "nth", "of_length", "of_part", "earlier", "number")


def packed(
    docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): every piece's place.

    See ``pieces`` for what becomes of nulls, long texts and repeated rows; an empty table gives no
    rows. The pieces are written once, so that numbers hold when tasks run again.
    """
    scratch = Scratch(docs.sparkSession)
    result = stored(placed(scratch.stored(pieces(docs, tokenizer, end, capacity, with_ids)), capacity))
    scratch.remove()
    return result


def sequences(rows: DataFrame) -> DataFrame:
    """(sequence_id, ids): the training sequences, from ``packed`` rows with ids."""
    sorted_pieces = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(sorted_pieces, lambda p: p["ids"])).alias("ids"))
