"""Byte-level BPE by dynamic programming over prefixes.

The encoding of a prefix is fixed by its last token: what stands before it is the encoding of a
shorter prefix. A token can be the last one if it ends the prefix and fits the last token of the
prefix before it, that is, if merging the two tokens' bytes in rank order would give back just these
two; exactly one token does. So one number a prefix is all the state: appending bytes goes on from
the last prefix, and an edit is re-encoded until the numbers meet the old ones again. The new words
of many texts go forward together, a byte a step.
"""

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Splits text before encoding: the pattern of the rank files, with the commonest kinds first.
PATTERN = r""" ?\p{L}++| ?\p{N}++|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"""
#: Runs of non-blanks and pairs of tokens a worker remembers; it forgets all when it has more. Results
#: don't depend on it.
REMEMBERED = 200_000
#: Longer pieces go forward on their own.
LONG_PIECE = 64
#: Characters of texts that are worked on together.
TOGETHER = 2_000_000
_SPLIT = regex.compile(PATTERN).findall
#: The same cut, less fine: no piece goes on after a run of non-blanks, which has at most one space
#: before it.
_RUNS = regex.compile(r" ?\S++|\s+(?!\S)|\s+").findall


def merged_by_rank(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The piece after all merges of ranks under ``below``, lowest first, leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        ranked = [(ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(ranked, default=(below, 0))
        if rank >= below:
            return parts
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@dataclass(frozen=True)
class Vocabulary:
    """Ranked tokens, and for each the two tokens that its last merge joins (-1: a single byte,
    -2: merges never make it, so that it can only be a whole piece)."""

    tokens: tuple[bytes, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> "Vocabulary":
        tokens = tuple(sorted(ranks, key=ranks.__getitem__))
        if [ranks[t] for t in tokens] != list(range(len(tokens))):
            raise ValueError("ranks must count from 0 without gaps")
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte must be a token")
        left, right = [], []
        for rank, token in enumerate(tokens):
            parts = merged_by_rank(token, ranks, rank) if len(token) > 1 else []
            two = [ranks[p] for p in parts] if len(parts) == 2 else [-1 if len(token) == 1 else -2] * 2
            left.append(two[0])
            right.append(two[1])
        return cls(tokens, tuple(left), tuple(right))

    @classmethod
    def read(cls, path: str) -> "Vocabulary":
        """From a rank file: base64 of the token and its rank on each line."""
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls.of({base64.b64decode(token): int(rank) for token, rank in pairs})


class _Numbers:
    """Whole numbers by whole-number keys, looked up many at a time."""

    def __init__(self, bits: int):
        self.bits, self.size = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int64)

    def _spots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers, -1 for keys that have none."""
        spots = self._spots(keys)
        found = self.keys[spots]
        out = np.where(found == keys, self.values[spots], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):  # the next spot, until the key or a free one
            spots[open_] = (spots[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[spots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[spots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def has_room(self, more: int) -> bool:
        """Whether the table stays at most half full."""
        return (self.size + more) * 2 <= 1 << self.bits

    def add(self, keys: list[int], values: list[int]) -> None:
        """New keys and their numbers; there has to be room for them."""
        self.size += len(keys)
        mask = (1 << self.bits) - 1
        for key, value, spot in zip(keys, values, self._spots(np.array(keys, np.int64)).tolist()):
            while self.keys[spot] >= 0:
                spot = (spot + 1) & mask
            self.keys[spot], self.values[spot] = key, value


class Encoder:
    """Encodes texts; remembers runs of non-blanks, and which tokens fit."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens, self.left, self.right = vocabulary.tokens, vocabulary.left, vocabulary.right
        self.joined = {
            (a, b): t for t, (a, b) in enumerate(zip(self.left, self.right)) if a >= 0
        }
        self.only_whole = {t: i for i, t in enumerate(self.tokens) if self.left[i] == -2}
        self.longest = max(map(len, self.tokens))
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        # The tokens read backwards, as a tree: 0 is the root; of each node the token that ends here.
        nodes: dict[int, int] = {}
        self.token_of = [-1]
        for i, token in enumerate(self.tokens):
            at = 0
            for byte in reversed(token):
                step = at << 8 | byte
                if step not in nodes:
                    nodes[step] = len(self.token_of)
                    self.token_of.append(-1)
                at = nodes[step]
            if self.left[i] != -2:
                self.token_of[at] = i
        self.steps = nodes
        self.all_steps = _Numbers((4 * len(nodes)).bit_length())
        self.all_steps.add(list(nodes), list(nodes.values()))
        self.all_token_of = np.array(self.token_of, np.int64)
        self.fit: dict[int, bool] = {}
        self.all_fit = _Numbers(20)
        self.runs: dict[str, bytes] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b, side by side, come out of the merges as they are.

        Their merges are undone one by one, the later first; if at any time a token across the border
        could have been merged before what was undone last, it would have been. Of equal ranks the
        left merge comes first.
        """
        pair = a << 32 | b
        known = self.fit.get(pair)
        if known is not None:
            return known
        x, y, limit = a, b, len(self.tokens)
        while True:
            across = self.joined.get((x, y))
            if across is not None and across < limit:
                answer = False
                break
            if self.left[x] < 0 and self.left[y] < 0:
                answer = True
                break
            if self.left[y] < 0 or (self.left[x] >= 0 and x > y):
                limit, x = x, self.right[x]
            else:
                limit, y = y + 1, self.left[y]
        if len(self.fit) >= REMEMBERED:
            self.fit.clear()
        self.fit[pair] = answer
        return answer

    def last_token(self, piece: bytes, end: int, last) -> int:
        """The last token of piece[:end], with ``last(i)`` that of piece[:i] for 0 < i < end."""
        at = 0
        for start in range(end - 1, -1, -1):
            at = self.steps.get(at << 8 | piece[start], -1)
            if at < 0:
                break
            token = self.token_of[at]
            if token >= 0 and (start == 0 or self.fits(last(start), token)):
                return token
        raise AssertionError("every prefix has a last token")

    def _all_fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pairs fit, as booleans."""
        keys = a << 32 | b
        known = self.all_fit.get(keys)
        new = np.unique(keys[known < 0])
        if len(new):
            if not self.all_fit.has_room(len(new)):  # forget all but what is asked now
                new = np.unique(keys)
                self.all_fit = _Numbers(max(self.all_fit.bits, (4 * len(new)).bit_length()))
            self.all_fit.add(new.tolist(), [int(self.fits(k >> 32, k & 0xFFFFFFFF)) for k in new.tolist()])
            known = self.all_fit.get(keys)
        return known == 1

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, 4 bytes an id; all pieces go forward together, longest first."""
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        sizes = np.array([len(pieces[i]) for i in order], np.int64)
        data = np.frombuffer(b"".join(pieces[i] for i in order), np.uint8).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        last = np.full(len(data), -1, np.int64)
        for end in range(1, int(sizes.max(initial=0)) + 1):
            spots = starts[: np.searchsorted(-sizes, -end, side="right")] + end - 1
            nodes = np.zeros(len(spots), np.int64)
            for back in range(1, end + 1):
                nodes = self.all_steps.get(nodes << 8 | data[spots - back + 1])
                alive = nodes >= 0
                if not alive.all():
                    raise AssertionError("every prefix has a last token")
                tokens = self.all_token_of[nodes]
                right = tokens >= 0
                if back < end:
                    some = np.flatnonzero(right)
                    right[some] = self._all_fit(last[spots[some] - back], tokens[some])
                last[spots[right]] = tokens[right]
                spots, nodes = spots[~right], nodes[~right]
                if not len(spots):
                    break
        # Back from each piece's end, a token a step.
        ends, steps = starts + sizes, []
        open_ = np.flatnonzero(sizes > 0)
        while len(open_):
            ids = last[ends[open_] - 1]
            steps.append((open_, ids))
            ends[open_] -= self.lengths[ids]
            open_ = open_[ends[open_] > starts[open_]]
        counts = np.zeros(len(sizes), np.int64)
        for found, _ in steps:
            counts[found] += 1
        stops = np.cumsum(counts)
        flat = np.empty(int(counts.sum()), np.int32)
        for back, (found, ids) in enumerate(steps, 1):
            flat[stops[found] - back] = ids
        whole = flat.tobytes()
        out = [b""] * len(pieces)
        for i, stop, count in zip(order, stops.tolist(), counts.tolist()):
            out[i] = whole[4 * (stop - count) : 4 * stop]
        return out

    def encode_bytes(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece, by going forward on its own."""
        if piece in self.only_whole:
            return (self.only_whole[piece],)
        found = [0] * (len(piece) + 1)
        for end in range(1, len(piece) + 1):
            found[end] = self.last_token(piece, end, found.__getitem__)
        return self.walked_back(found)

    def _learn(self, runs: list[str]) -> None:
        """Encode new runs and remember them."""
        cut = []
        for run in runs:
            # letters, with or without a space before, are one piece
            alone = run.isalpha() or run[0] == " " and run[1:].isalpha()
            cut.append([run] if alone else _SPLIT(run))
        known: dict[str, bytes] = {}
        together: dict[str, bytes] = {}
        for pieces in cut:
            for piece in pieces:
                if piece not in known and piece not in together:
                    data = piece.encode("utf-8", "surrogatepass")
                    if len(data) > LONG_PIECE or data in self.only_whole:
                        known[piece] = np.array(self.encode_bytes(data), np.int32).tobytes()
                    else:
                        together[piece] = data
        known.update(zip(together, self.encode_all(list(together.values()))))
        for run, pieces in zip(runs, cut):
            self.runs[run] = known[pieces[0]] if len(pieces) == 1 else b"".join([known[p] for p in pieces])

    def walked_back(self, last: list[int]) -> tuple[int, ...]:
        ids, end = [], len(last) - 1
        while end:
            ids.append(last[end])
            end -= len(self.tokens[last[end]])
        return tuple(reversed(ids))

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, special tokens taken as plain text."""
        cut = [_RUNS(text) for text in texts]
        if len(self.runs) > REMEMBERED:
            self.runs.clear()
        known = self.runs
        self._learn(list({run for runs in cut for run in runs if run not in known}))
        return [np.frombuffer(b"".join(map(known.__getitem__, runs)), np.int32) for runs in cut]

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class Draft:
    """A piece under change: its bytes and the last token of each of its prefixes."""

    def __init__(self, encoder: Encoder, piece: bytes = b""):
        self.encoder, self.bytes, self.last = encoder, b"", [0]
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Go on from the last prefix; nothing before changes."""
        self.bytes += more
        for end in range(len(self.last), len(self.bytes) + 1):
            self.last.append(self.encoder.last_token(self.bytes, end, self.last.__getitem__))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` for bytes start to end; gives the number of prefixes read again.

        A prefix looks back as far as the longest token. Once so many in a row are as before, all
        that follow are.
        """
        old, shift = self.last, len(new) - (end - start)
        self.bytes = self.bytes[:start] + new + self.bytes[end:]
        self.last = old[: start + 1]
        same = 0
        for at in range(start + 1, len(self.bytes) + 1):
            token = self.encoder.last_token(self.bytes, at, self.last.__getitem__)
            before = at - shift
            beyond = at - self.encoder.longest >= start + len(new)
            same = same + 1 if beyond and 0 < before < len(old) and old[before] == token else 0
            self.last.append(token)
            if same >= self.encoder.longest:
                self.last += old[before + 1 :]
                return at - start
        return len(self.bytes) - start

    def ids(self) -> tuple[int, ...]:
        if self.bytes in self.encoder.only_whole:
            return (self.encoder.only_whole[self.bytes],)
        return self.encoder.walked_back(self.last)


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, a part at a time: as many as are worked on together."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > TOGETHER:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def with_ids(docs: DataFrame, vocabulary: Vocabulary, decode: bool = False) -> DataFrame:
    """The documents with the token ids of their whole texts in ``ids``.

    Special tokens are taken as plain text. With ``decode`` there is ``decoded`` as well, the bytes that
    the ids stand for. Null and empty texts have no ids. All other columns pass through, columns named
    like the new ones are replaced; rows keep their number and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file

    @F.pandas_udf("ids array<int>, decoded binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)  # goes with the task, and with it what it remembers
        for texts in batches:
            for part in _parts([t if isinstance(t, str) else "" for t in texts]):
                ids = encoder.texts(part)
                back = [encoder.decoded(x) if decode else None for x in ids]
                yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(back, dtype=object)})

    rows = docs.withColumn("ids", encode("text"))
    if decode:
        return rows.withColumns({"ids": F.col("ids.ids"), "decoded": F.col("ids.decoded")})
    return rows.withColumn("ids", F.col("ids.ids"))
