"""Exact nearest vectors by inner product.

Vectors are kept in blocks of falling length. The first block against all queries gives each query a
score to beat. By Cauchy-Schwarz a block whose longest vector can't reach it is not even sent to the
query's task; in the blocks that are, components rotated by the vectors' singular directions put most
of the length into the first few, so a partial sum plus the product of what is left of both lengths
bounds the score, and only pairs whose bound reaches the score to beat are multiplied whole, in whole
numbers.

Queries that need about the same length lie in one lot, blocks in bundles; a bundle and a lot are the
work of a task. Both grow with the vectors up to a bound, their number with the square of the input over it.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartwright.llm.tables import Scratch, stored

BLOCK, QUERY_BLOCK = 4096, 256
#: Bytes of vectors in a bundle of blocks, and in a lot of queries.
LEAST_TILE, LARGEST_TILE = 1 << 20, 64 << 20
#: Rotated components summed before a pair may be dropped.
LEADING = 16
_EXACT = 2**53


def whole_numbers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, vector, norm2): components as floor(scale * x) of x as a double.

    Rows without id or vector, or with null or non-finite components, are left out.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select(
        F.col("vec_id").cast("bigint"), F.transform(x, lambda c: F.floor(c * scale)).alias("vector")
    )
    norm2 = F.aggregate("vector", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    return rows.withColumn("norm2", norm2)


def _matrix(vectors, width: int) -> np.ndarray:
    """The vectors as rows, shorter ones filled with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all vectors, strongest first.

    Every batch gives its sums of products; the driver gets ``width`` squared numbers in all.
    """

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch["vector"], width).astype(np.float64)
            total += m.T @ m
        yield pd.DataFrame({"cell": np.arange(width * width), "total": total.ravel()})

    cells = rows.select("vector").mapInPandas(products, "cell long, total double")
    sums = cells.groupBy("cell").agg(F.sum("total").alias("total")).toPandas()
    gram = np.zeros(width * width)
    gram[sums["cell"].to_numpy()] = sums["total"].to_numpy()
    _, directions = np.linalg.eigh(gram.reshape(width, width))
    return np.ascontiguousarray(directions[:, ::-1])


class _Queries:
    """A group of queries with their best so far."""

    def __init__(self, packed, width: int, top: int):
        self.rows = np.frombuffer(packed.query_rows, np.int64)
        self.vectors = np.frombuffer(packed.query_numbers, np.int64).reshape(len(self.rows), width)
        self.floors = np.frombuffer(packed.floors, np.float64).copy()
        self.top = top
        # the number of the query, and the candidate's score, id and row
        self.best = np.zeros((0, 4), np.int64)

    def least_length(self) -> float:
        """What a candidate has to be long to reach some query's score to beat."""
        norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1))
        return float(np.divide(self.floors, norms, out=np.full(len(norms), -np.inf), where=norms > 0).min())

    def add(self, found: np.ndarray) -> None:
        all_ = np.concatenate([self.best, found])
        all_ = all_[np.lexsort((all_[:, 3], all_[:, 2], -all_[:, 1], all_[:, 0]))]
        place = np.arange(len(all_)) - np.searchsorted(all_[:, 0], all_[:, 0])
        self.best = all_[place < self.top]
        counts = np.bincount(self.best[:, 0], minlength=len(self.rows))
        last = np.cumsum(counts)[counts == self.top] - 1
        full = np.flatnonzero(counts == self.top)
        self.floors[full] = np.maximum(self.floors[full], self.best[last, 1])


def _search(queries: _Queries, ids, rows, vectors, turn, leading: int) -> None:
    """Adds the pairs of a block that may reach the queries' scores to beat, whole."""
    q, v = queries.vectors.astype(np.float64), vectors.astype(np.float64)
    rq, rv = q @ turn, v @ turn
    rest_q = np.sqrt((rq[:, leading:] ** 2).sum(1))
    rest_v = np.sqrt((rv[:, leading:] ** 2).sum(1))
    bound = rq[:, :leading] @ rv[:, :leading].T + np.outer(rest_q, rest_v)
    slack = 1e-9 * np.outer(np.sqrt((q**2).sum(1)), np.sqrt((v**2).sum(1))) + 1e-6
    open_ = (bound + slack >= queries.floors[:, None]) & (queries.rows[:, None] != rows[None, :])
    at_q, at_v = np.nonzero(open_)
    large = (q**2).sum(1).max(initial=0) * (v**2).sum(1).max(initial=0) >= float(_EXACT) ** 2
    if large or len(at_q) * 8 < open_.size:  # few pairs: one by one; whole numbers in any case
        scores = np.empty(len(at_q), np.int64)
        for lo in range(0, len(at_q), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            scores[part] = np.einsum("ij,ij->i", queries.vectors[at_q[part]], vectors[at_v[part]])
    else:  # every product and sum is below 2**53, so doubles are exact
        scores = (q @ v.T)[at_q, at_v].astype(np.int64)
    queries.add(np.column_stack([at_q, scores, ids[at_v], rows[at_v]]))


def top_k(vectors: DataFrame, every: int = 50, top: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` highest inner products of each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but the
    query's own, also those of the same vec_id. Ties go to the smaller vec_id. Vectors of different
    widths are filled up with zeros. Rows without id, or whose vector is null or holds null or
    non-finite components, take no part; other columns are not read; with no query or candidate
    there are no rows.
    """
    scratch = Scratch(vectors.sparkSession)
    result = stored(_top_k(vectors, every, top, scale, scratch))
    scratch.remove()
    return result


def _top_k(vectors: DataFrame, every: int, top: int, scale: int, scratch: Scratch) -> DataFrame:
    spark, stored = vectors.sparkSession, scratch.stored
    rows = stored(whole_numbers(vectors, scale).withColumn("row", F.monotonically_increasing_id()))
    shape = rows.agg(
        F.count("*").alias("n"), F.max(F.size("vector")).alias("width"),
        F.count_if(F.col("vec_id") % every == 0).alias("queries"),
    ).first()
    width = shape["width"] or 0
    if not shape["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = rotation(rows, width) if width else np.zeros((0, 0))
    leading = min(LEADING, width)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values("norm2", ascending=False, kind="stable")
            for lo in range(0, len(batch), BLOCK):
                part = batch.iloc[lo : lo + BLOCK]
                yield pd.DataFrame(
                    {
                        "longest": [float(part["norm2"].iloc[0])],
                        "ids": [part["vec_id"].to_numpy(np.int64).tobytes()],
                        "rows": [part["row"].to_numpy(np.int64).tobytes()],
                        "numbers": [_matrix(part["vector"], width).tobytes()],
                    }
                )

    # vectors of one length are told apart by row, so that many copies of one spread as well
    fallen = rows.repartitionByRange(-(-shape["n"] // BLOCK), F.desc("norm2"), F.xxhash64("row"))
    packed = stored(
        fallen.mapInPandas(pack, "longest double, ids binary, rows binary, numbers binary").withColumn(
            "block", F.monotonically_increasing_id()
        )
    )
    tile = min(max(shape["n"] * width * 8 // 64, LEAST_TILE), LARGEST_TILE)
    bundles, lots = (max(1, -(-n * width * 8 // tile)) for n in (shape["n"], shape["queries"]))

    def pack_queries(lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values("needed")
        parts = [lot.iloc[lo : lo + QUERY_BLOCK] for lo in range(0, len(lot), QUERY_BLOCK)]
        return pd.DataFrame(
            {
                "lot": [int(p["lot"].iat[0]) for p in parts],
                "query_rows": [p["row"].to_numpy(np.int64).tobytes() for p in parts],
                "query_numbers": [_matrix(p["vector"], width).tobytes() for p in parts],
                "floors": [p["floor"].fillna(-np.inf).to_numpy(np.float64).tobytes() for p in parts],
            }
        )

    def tile_of(blocks: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((0, 4), np.int64)]
        blocks = blocks.sort_values("longest", ascending=False)
        for packed_group in groups.itertuples():
            queries = _Queries(packed_group, width, top)
            for block in blocks.itertuples():
                if np.sqrt(block.longest) * (1 + 1e-9) + 1e-6 < queries.least_length():
                    break
                ids = np.frombuffer(block.ids, np.int64)
                numbers = np.frombuffer(block.numbers, np.int64).reshape(len(ids), width)
                _search(queries, ids, np.frombuffer(block.rows, np.int64), numbers, turn, leading)
            best = queries.best
            found.append(np.column_stack([queries.rows[best[:, 0]], best[:, 1:]]))
        return pd.DataFrame(np.concatenate(found), columns=["query", "score", "vec_id", "row"])

    def searched(blocks: DataFrame, asked: DataFrame) -> DataFrame:
        """The best of each bundle for each query of ``asked`` (with ``floor`` and ``needed``).

        Which lots a block may reach is told by two numbers, a block's longest and a lot's least need,
        before any vector is sent; lots are as few as the bytes of the queries over a tile's.
        """
        # queries of about the same need lie in one lot
        ranges = asked.repartitionByRange(lots, "needed", "row")
        dealt = stored(ranges.withColumn("lot", F.spark_partition_id()))
        needs = dealt.groupBy("lot").agg(F.min("needed").alias("needed")).collect()
        reached = F.sqrt("longest") * (1 + 1e-9) + 1e-6
        open_lots = F.array(*[F.when(reached >= float(r["needed"]), F.lit(int(r["lot"]))) for r in needs])
        left = blocks.withColumn("lot", F.explode(F.array_compact(open_lots))).withColumn(
            "bundle", F.pmod(F.xxhash64("block"), F.lit(bundles))
        )
        groups = dealt.groupBy("lot").applyInPandas(
            pack_queries, "lot int, query_rows binary, query_numbers binary, floors binary"
        )
        every_bundle = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bundles - 1).cast("bigint")))
        right = groups.withColumn("bundle", every_bundle)
        return left.groupBy("bundle", "lot").cogroup(right.groupBy("bundle", "lot")).applyInPandas(
            tile_of, "query long, score long, vec_id long, row long"
        )

    columns = ("row", "vec_id", "vector", "norm2")
    queries = rows.where(F.col("vec_id") % every == 0).select(*columns)
    nothing = F.lit(float("-inf"))
    head = packed.agg(F.max_by("block", "longest").alias("head")).first()["head"]
    first = stored(
        searched(
            packed.where(F.col("block") == head),
            queries.withColumns({"floor": F.lit(None).cast("double"), "needed": nothing}),
        )
    )
    beaten = first.groupBy("query").agg(F.when(F.count("*") >= top, F.min("score")).cast("double").alias("floor"))
    needed = F.when(F.col("norm2") > 0, F.col("floor") / F.sqrt("norm2"))
    asked = queries.join(beaten, F.col("row") == F.col("query"), "left").drop("query")
    others = searched(
        packed.where(F.col("block") != head), asked.withColumn("needed", F.coalesce(needed, nothing))
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    found = first.unionByName(others).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ids = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return found.join(ids, "query").select("query_id", "rank", "vec_id", "score")
