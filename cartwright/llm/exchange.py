"""Ask the whole corpus about every n-gram of a text, at a few bytes an n-gram.

Texts are dealt to chunks of some megabytes by a hash of their id. Each chunk asks once for each
of its distinct keys, so a key costs at most one entry a chunk however often it occurs: a key that
a third of all documents hold is no hot key. Keys go to buckets by their value, as sorted
differences; a bucket's task combines what all chunks say about a key and answers each chunk in the
order of its keys. The chunk's task reads its texts again with the answers at hand. Chunks and
buckets grow in number with the input and stay the same in size.

The texts are shuffled once: both readings share the exchange.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.llm.memory import released, released_pair
from cartwright.llm.tables import text_bytes

CHUNK_BYTES = 4 << 20
#: A partition is a chunk, or up to so many bytes of chunks where there are more than 200.
PARTITION_BYTES = 128 << 20


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers in planes of bytes: planes of zeros cost next to nothing when compressed."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(planes: bytes) -> np.ndarray:
    bytes_ = np.frombuffer(planes, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(bytes_.T).view(np.uint64).ravel()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the keys' values; rising with the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def chunk_of(doc_id: str, chunks: int):
    return F.pmod(F.xxhash64(F.col(doc_id)), F.lit(chunks))


#: Stands for a missing id inside the operators; the results hold null again.
NO_ID = -(2**63)
_SIGN = np.uint64(1 << 63)


def as_number(ids: np.ndarray) -> np.ndarray:
    """Ids as unsigned numbers of the same order."""
    return np.asarray(ids, np.int64).view(np.uint64) ^ _SIGN


def as_id(numbers: np.ndarray) -> np.ndarray:
    return (numbers ^ _SIGN).view(np.int64)


def in_chunks(
    docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, key: str | None = None
) -> tuple[DataFrame, int, int]:
    """(chunk, doc_id, text) of all documents dealt to chunks, the number of chunks, and of partitions.

    Documents are dealt by their id, or by the column ``key``, which then is in the result as well.
    """
    size = text_bytes(docs)
    chunks = max(1, -(-size // chunk_bytes))
    partitions = max(min(chunks, 200), -(-size // PARTITION_BYTES))
    known = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    more = [key] if key else []
    dealt = docs.select(known.alias("doc_id"), *more, F.col("text").cast("string"))
    dealt = dealt.select(chunk_of(key or "doc_id", chunks).alias("chunk"), "doc_id", *more, "text")
    return dealt.repartition(partitions, "chunk"), chunks, partitions


def with_null_id(rows: DataFrame, *names: str) -> DataFrame:
    """The rows with null where an id was missing."""
    return rows.withColumns({n: F.nullif(F.col(n), F.lit(NO_ID)) for n in names})


def ask_corpus(
    dealt: DataFrame,
    buckets: int,
    partitions: int,
    ask: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]],
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray],
    answer: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Rows made of each chunk's texts and the corpus' answers to its keys.

    ``ask`` gives a chunk's distinct keys, rising, and a number for each; ``combine`` makes one
    number of a key's numbers (sorted by key, with the starts of the keys); ``answer`` gets the
    texts, the keys and the combined numbers and returns rows of ``schema``.
    """

    @released
    def question(group: pd.DataFrame) -> pd.DataFrame:
        keys, values = ask(group)
        cuts = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
        rows = [
            (int(group["chunk"].iat[0]), b, packed(np.diff(keys[lo:hi], prepend=np.uint64(0))), packed(values[lo:hi]))
            for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:]))
            if hi > lo
        ]
        return pd.DataFrame(rows, columns=["chunk", "bucket", "keys", "numbers"])

    @released
    def reply(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.cumsum(unpacked(k), dtype=np.uint64) for k in group["keys"]]
        keys = np.concatenate(parts)
        numbers = np.concatenate([unpacked(v) for v in group["numbers"]])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        combined = combine(numbers[order], np.flatnonzero(first))
        back = np.empty(len(keys), np.uint64)
        back[order] = combined[np.cumsum(first) - 1]
        ends = np.cumsum([len(p) for p in parts])
        replies = [packed(back[e - len(p) : e]) for p, e in zip(parts, ends)]
        return pd.DataFrame({"chunk": group["chunk"], "bucket": group["bucket"], "numbers": replies})

    @released_pair
    def read_again(texts: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        replies = replies.sort_values("bucket")
        numbers = [unpacked(v) for v in replies["numbers"]] or [np.zeros(0, np.uint64)]
        return answer(texts, ask(texts)[0], np.concatenate(numbers))

    questions = dealt.groupBy("chunk").applyInPandas(
        question, "chunk long, bucket long, keys binary, numbers binary"
    )
    replies = questions.repartition(partitions, "bucket").groupBy("bucket").applyInPandas(
        reply, "chunk long, bucket long, numbers binary"
    )
    return dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(read_again, schema)
