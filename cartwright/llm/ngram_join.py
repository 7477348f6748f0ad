"""Near copies by exact Jaccard similarity of word n-gram sets.

The similarity of all documents is the product of the sparse incidence matrix (documents by
n-grams) with its transpose. It is never formed whole:

1. Columns with one document add nothing. Every document asks the corpus how many documents hold
   each of its n-grams (``exchange``); where fewer than the similarity's share of its set are held
   elsewhere, no partner can exist. What is left are the copies and near copies.
2. Equal sets become one row, which stands for all its documents.
3. Columns are ordered from rare to frequent. Whatever two partners share begins with some first
   column, after which both must have enough columns left for the bound below. Only that part of the
   matrix makes candidate pairs, in rounds: each column pairs its documents with one of them, and
   documents known to be connected are not paired again; at last each column pairs what is still
   unconnected.
4. Candidates are multiplied block by block of columns; the overlap adds up, and a pair goes as
   soon as overlap and columns to come can't reach the bound ``s / (1 + s) * (|x| + |y|)``.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartwright.llm.components import components
from cartwright.llm.exchange import CHUNK_BYTES, ask_corpus, in_chunks, with_null_id
from cartwright.llm.tables import Scratch, stored
from cartwright.llm.words import encoded, gram_hashes, text_of_word, word_hashes

BLOCKS = 3
ROUNDS = 2
#: A row's own key: ids may be missing or repeat.
KEY = "_row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a digest of id and text, so that rows of one key are the same document."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")]
    return docs.withColumn(KEY, F.md5(F.concat(parts[0], F.lit("\x1f"), parts[1]).cast("binary")))


def _incidence(texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram, number of the text), each pair once, sorted by gram and text."""
    hashes, offsets = word_hashes(encoded(texts, lower=True))
    grams = gram_hashes(hashes, n)
    owners = text_of_word(offsets)
    whole = owners[: len(grams)] == owners[n - 1 :] if len(grams) else np.zeros(0, bool)
    short = [i for i, k in enumerate(np.diff(offsets)) if 0 < k < n]
    alone = [gram_hashes(hashes[offsets[i] : offsets[i + 1]], int(offsets[i + 1] - offsets[i])) for i in short]
    del hashes
    grams = np.concatenate([grams[whole], *alone])
    owners = np.concatenate([owners[: len(whole)][whole], np.asarray(short, np.int32)])
    # texts stand in order, and those of few words share no gram with others: the sort keeps them so
    order = np.argsort(grams, kind="stable")
    grams, owners = grams[order], owners[order]
    del order
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    return grams[new], owners[new]


def _starts(grams: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)


def shared_sets(docs: DataFrame, n: int, percent: int, chunk_bytes: int) -> DataFrame:
    """(doc_id, key, size, signature, grams): the row's key, the set's size and a digest of it; its
    grams that other documents hold as well, where they are enough for a partner to exist, else null."""

    def ask(group: pd.DataFrame):
        grams, _ = _incidence(group["text"], n)
        starts = _starts(grams)
        return grams[starts], np.diff(np.append(starts, len(grams)))

    def total(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(numbers, starts)

    def answer(group: pd.DataFrame, keys: np.ndarray, holders: np.ndarray) -> pd.DataFrame:
        grams, owners = _incidence(group["text"], n)
        held = holders[np.searchsorted(keys, grams)]
        by_text = np.argsort(owners, kind="stable")
        grams, held = grams[by_text], held[by_text]
        sizes = np.bincount(owners, minlength=len(group))
        ends = np.cumsum(sizes)
        rows = []
        for doc_id, key, size, end in zip(group["doc_id"], group[KEY], sizes, ends):
            own, often = grams[end - size : end], held[end - size : end] >= 2
            if size and 100 * int(often.sum()) >= percent * int(size):
                digest = hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest()
                rows.append((doc_id, key, int(size), digest, own[often].view(np.int64)))
            else:
                rows.append((doc_id, key, int(size), None, None))
        return pd.DataFrame(rows, columns=["doc_id", "key", "size", "signature", "grams"])

    dealt, chunks, partitions = in_chunks(_keyed(docs), chunk_bytes, KEY)
    return ask_corpus(
        dealt, chunks, partitions, ask, total, answer,
        "doc_id long, key string, size long, signature string, grams array<long>",
    )


def _may_reach(percent: int) -> Column:
    """Whether two sets that share a column, and none before it, can share enough."""
    most = (100 + percent) * F.least("room", "other_room")
    return most >= percent * (F.col("size") + F.col("other_size"))


def _similar(pairs: DataFrame, blocks: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity, multiplied block by block."""
    for side in "ab":
        own = sizes.select(F.col("doc").alias(side), F.col("size").alias(f"size_{side}"), F.col("shared").alias(f"left_{side}"))
        pairs = pairs.join(own, side)
    # both sides of a product have to be exact whole numbers, so that no rounding decides
    reach = (100 + percent) * F.col("overlap") >= percent * (F.col("size_a") + F.col("size_b"))
    hope = (100 + percent) * (F.col("overlap") + F.least("left_a", "left_b")) >= percent * (
        F.col("size_a") + F.col("size_b")
    )
    pairs = pairs.withColumn("overlap", F.lit(0).cast("bigint")).where(hope)
    for block in range(BLOCKS):
        part = blocks.where(F.col("block") == block)
        for side in "ab":
            own = part.select(F.col("doc").alias(side), F.col("grams").alias(f"grams_{side}"))
            pairs = pairs.join(own, side, "left")
        none = F.array().cast("array<bigint>")
        count = lambda side: F.size(F.coalesce(F.col(f"grams_{side}"), none))
        both = F.size(F.array_intersect(F.coalesce("grams_a", none), F.coalesce("grams_b", none)))
        pairs = pairs.select(
            "a", "b", "size_a", "size_b",
            (F.col("left_a") - count("a")).alias("left_a"),
            (F.col("left_b") - count("b")).alias("left_b"),
            (F.col("overlap") + both).alias("overlap"),
        ).where(hope)
    return pairs.where(reach).select("a", "b")


def near_copies(
    docs: DataFrame, n: int = 5, percent: int = 75, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    A set holds the text's distinct runs of ``n`` words, A to Z in lower case; a shorter text is
    one run; a null or empty text has none and no link. Documents link when 100 times the overlap is
    at least ``percent`` times the union. ``component_id`` is the smallest doc_id reachable, null
    being the smallest of all. Every row is a document of its own, also where ids are missing or
    repeat: only texts link. Other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    sets, groups = _grouped(docs, n, percent, chunk_bytes, scratch)
    result = sets.select("doc_id", "size", "signature").join(
        groups.select("signature", "component_id"), "signature", "left"
    )
    result = stored(with_null_id(
        result.select(
            "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
        ),
        "doc_id", "component_id",
    ))
    scratch.remove()
    return result


def _grouped(
    docs: DataFrame, n: int, percent: int, chunk_bytes: int, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """The rows' sets, and (signature, component_id, kept_key) of each set that may have partners:
    the smallest doc_id of its component, and of that id's rows there the smallest key."""
    stored = scratch.stored
    sets = stored(shared_sets(docs, n, percent, chunk_bytes))
    near = sets.where("grams is not null")
    # Equal sets: one row of the smallest id and key stands for all, under a number of the set's own.
    lowest = near.groupBy("signature").agg(F.min(F.struct("doc_id", "key")).alias("low"))
    classes = stored(lowest.withColumn("doc", F.monotonically_increasing_id()))
    first = near.select("signature", "key", "size", "grams").join(
        classes.select("signature", F.col("low.key").alias("key"), "doc"), ["signature", "key"]
    ).dropDuplicates(["signature"])
    cells = first.select("doc", "size", F.explode("grams").alias("gram"))
    cells = stored(cells)
    columns = cells.groupBy("gram").agg(F.count("*").alias("holders")).where("holders >= 2")
    entries = cells.join(columns, "gram")
    rows = entries.groupBy("doc", "size").agg(F.count("*").alias("shared")).where(
        F.col("shared") * 100 >= F.col("size") * percent
    )
    rows = stored(rows)
    entries = stored(entries.join(rows.select("doc", "shared"), "doc"))
    blocks = stored(
        entries.groupBy("doc", F.pmod("gram", F.lit(BLOCKS)).alias("block")).agg(
            F.collect_list("gram").alias("grams")
        )
    )

    # ``room``: the most that two sets can share if this column is the first they share
    ranked = entries.withColumn(
        "place", F.row_number().over(Window.partitionBy("doc").orderBy("holders", "gram"))
    ).withColumn("room", F.col("shared") - F.col("place") + 1)
    head = stored(
        ranked.where(F.col("room") * 100 >= F.col("size") * percent).select("gram", "doc", "size", "room")
    )
    links = None
    tested = None
    for turn in range(ROUNDS + 1):
        members = head.withColumn("component", F.col("doc"))
        if links is not None:
            known = components(links, scratch).withColumnsRenamed({"node": "doc", "component": "known"})
            members = head.join(known, "doc", "left").withColumn(
                "component", F.coalesce("known", "doc")
            )
        # a column's pivot: first the document with most in common with others, then any
        choice = -F.col("room") if turn == 0 else F.xxhash64("doc", F.lit(turn))
        open_grams = members.groupBy("gram").agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.min_by(
                F.struct(
                    F.col("doc").alias("other"), F.col("size").alias("other_size"),
                    F.col("room").alias("other_room"), F.col("component").alias("other_component"),
                ),
                F.struct(choice, "doc"),
            ).alias("pivot"),
        ).where("low <> high")
        members = stored(members.join(open_grams.select("gram", "pivot"), "gram"))
        if turn < ROUNDS:
            pairs = members.select("doc", "size", "room", "component", "pivot.*").where(
                "component <> other_component"
            )
        else:
            # components that may hold a pair, by their largest rooms and smallest sizes
            kinds = stored(
                members.groupBy("gram", "component").agg(F.max("room").alias("room"), F.min("size").alias("size"))
            )
            other = kinds.withColumnsRenamed(
                {"component": "other_component", "room": "other_room", "size": "other_size"}
            )
            met = kinds.join(other, "gram").where(F.col("component") < F.col("other_component")).where(
                _may_reach(percent)
            ).select("gram", "component", "other_component", "other_size", "other_room")
            left = members.select("gram", "component", "doc", "size", "room")
            right = left.withColumnsRenamed(
                {"component": "other_component", "doc": "other", "size": "other_size", "room": "other_room"}
            )
            # a member has to reach the other component before it meets its members
            able = met.join(left, ["gram", "component"]).where(_may_reach(percent))
            pairs = able.drop("other_size", "other_room").join(right, ["gram", "other_component"])
        fits = F.least("size", "other_size") * 100 >= F.greatest("size", "other_size") * percent
        pairs = pairs.where(fits & _may_reach(percent)).select(
            F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")
        ).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        tested = pairs if tested is None else tested.union(pairs)
        found = stored(_similar(pairs, blocks, rows, percent))
        links = found if links is None else links.union(found)
    groups = components(links, scratch).withColumnsRenamed({"node": "doc", "component": "group"})
    of_set = stored(classes.join(groups, "doc", "left").select(
        "signature", F.coalesce("group", "doc").alias("component"), "low"
    ))
    lows = of_set.groupBy("component").agg(F.min("low").alias("low"))
    return sets, stored(of_set.drop("low").join(lows, "component").select(
        "signature", F.col("low.doc_id").alias("component_id"), F.col("low.key").alias("kept_key")
    ))


def one_of_each(
    docs: DataFrame, n: int = 5, percent: int = 75, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """One row of each group of near copies, of its smallest id, with all columns.

    Rows without partners all stay, whatever their ids; of rows with one id and text one stays,
    unless the text has no word.
    """
    scratch = Scratch(docs.sparkSession)
    sets, groups = _grouped(docs, n, percent, chunk_bytes, scratch)
    near = sets.where("grams is not null").select(F.col("key").alias(KEY))
    kept = groups.select(F.col("kept_key").alias(KEY)).distinct()
    gone = stored(near.join(kept, KEY, "left_anti").distinct())
    scratch.remove()
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    single = _keyed(docs.where(worded)).dropDuplicates([KEY]).join(gone, KEY, "left_anti")
    return single.select(*docs.columns).union(docs.where(~worded))
