"""Hard negatives by inner product, with bounds along a spanning tree of the anchors.

Anchors of one label that lie close together share a group and are joined by a minimum spanning tree. For a candidate
v the scores of two anchors a and b differ by at most |a - b| |v|, so what is known of the parent's
score, exactly or as an interval, gives an interval for the child. Only candidates whose interval meets
a window that is still open are multiplied: for positives the scores from the least of the best so far
up, for negatives the scores between the shares of a positive's, again from the least of the best so far.

Candidates lie in blocks, anchors in groups; tiles of some blocks and some groups are the tasks'
work. Tiles grow with the vectors up to a bound, and their number with the square of the input over it.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartwright.llm.exact_topk import rotation
from cartwright.llm.tables import Scratch, stored

BLOCK, GROUP = 4096, 256
#: Bytes of vectors on each side of a tile.
LEAST_TILE, LARGEST_TILE = 1 << 20, 64 << 20
#: Leading directions whose signs tell which anchors lie close together.
DIRECTIONS = 10
_EXACT = 2.0**53


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(row, vec_id, label, vector, norm2): the rows that take part, numbered, components as
    floor(scale * x) of x as a double."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    ).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.transform(x, lambda c: F.floor(c * scale)).alias("vector"),
    )
    norm2 = F.aggregate("vector", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    return rows.withColumn("norm2", norm2).withColumn("row", F.monotonically_increasing_id())


def _matrix(vectors, width: int) -> np.ndarray:
    """The vectors as rows, shorter ones filled with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _bytes(numbers: np.ndarray) -> bytes:
    """In four bytes each where that is enough."""
    small = numbers.astype(np.int32)
    return (small if np.array_equal(small, numbers) else numbers).tobytes()


def _numbers(content: bytes, n: int, width: int) -> np.ndarray:
    wide = len(content) > 4 * n * width
    return np.frombuffer(content, np.int64 if wide else np.int32).reshape(n, width).astype(np.int64)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree: parents come before their children, the
    first is its own parent; edges are rounded up."""
    n = len(points)
    p = points.astype(np.float64)
    near, parent = np.full(n, np.inf), np.zeros(n, np.int64)
    order, edge, out = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
    at = 0
    for step in range(n):
        order[step], out[at] = at, True
        gap = np.sqrt(((p - p[at]) ** 2).sum(1))
        closer = ~out & (gap < near)
        near[closer], parent[closer] = gap[closer], at
        near[at] = np.inf
        if step + 1 < n:
            at = int(near.argmin())
            edge[at] = near[at] * (1 + 1e-9) + 1e-6
    return order, parent, edge


def spanning_trees(points: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree for each label: anchors of one label ask for the same candidates."""
    order, parent, edge = [], np.zeros(len(points), np.int64), np.zeros(len(points))
    for label in np.unique(labels):
        at = np.flatnonzero(labels == label)
        its_order, its_parent, its_edge = spanning_tree(points[at])
        order.append(at[its_order])
        parent[at], edge[at] = at[its_parent], its_edge
    return np.concatenate(order), parent, edge


class Block:
    """Candidates sorted by label."""

    def __init__(self, row, width: int):
        self.ids = np.frombuffer(row.ids, np.int64)
        self.rows = np.frombuffer(row.rows, np.int64)
        self.labels = np.frombuffer(row.labels, np.int64)
        self.numbers = _numbers(row.numbers, len(self.ids), width)
        self.norms = np.sqrt((self.numbers.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        self.floats = self.numbers.astype(np.float64)


class Group:
    """Anchors along the spanning trees of their labels."""

    def __init__(self, row, width: int):
        self.ids = np.frombuffer(row.ids, np.int64)
        self.rows = np.frombuffer(row.rows, np.int64)
        self.labels = np.frombuffer(row.labels, np.int64)
        self.numbers = _numbers(row.numbers, len(self.ids), width)
        self.order = np.frombuffer(row.order, np.int64)
        self.parent = np.frombuffer(row.parent, np.int64)
        self.edge = np.frombuffer(row.edge, np.float64)
        self.floats = self.numbers.astype(np.float64)
        self.norms = np.sqrt((self.floats**2).sum(1)) * (1 + 1e-9)


class Best:
    """The best so far of a window of scores ``low`` to ``high``: highest first, ties by id."""

    def __init__(self, most: int, low: float = -np.inf, high: float = np.inf):
        self.most, self.floor, self.high = most, low, high
        self.scores, self.ids, self.rows = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        inside = (scores >= self.floor) & (scores <= self.high)
        if not inside.any():
            return
        scores = np.concatenate([self.scores, scores[inside]])
        ids, rows = np.concatenate([self.ids, ids[inside]]), np.concatenate([self.rows, rows[inside]])
        keep = np.lexsort((rows, ids, -scores))[: self.most]
        self.scores, self.ids, self.rows = scores[keep], ids[keep], rows[keep]
        if len(keep) == self.most:
            self.floor = max(self.floor, int(self.scores[-1]))


def search(block: Block, group: Group, windows: list[list[Best]], alike: bool) -> tuple[int, int]:
    """Adds a block's candidates to each anchor's windows: rows of the anchor's label, itself left out,
    if ``alike``, else rows of other labels. Gives the pairs in question, and those multiplied."""
    whole = block.norms.max(initial=0) * group.norms.max(initial=0) < _EXACT  # then doubles are exact
    asked = multiplied = 0
    for root in np.flatnonzero(group.parent == np.arange(len(group.parent))):
        label = group.labels[root]
        among = np.flatnonzero((block.labels == label) == alike)
        if not len(among):
            continue
        tree = group.order[group.labels[group.order] == label]
        place = {a: i for i, a in enumerate(tree.tolist())}
        norms, numbers, floats = block.norms[among], block.numbers[among], block.floats[among]
        ids, rows = block.ids[among], block.rows[among]
        slack = 1e-6 + 1e-12 * group.norms.max(initial=0) * norms
        low, high = np.empty((len(tree), len(among))), np.empty((len(tree), len(among)))
        for i, a in enumerate(tree.tolist()):
            reach = group.norms[a] * norms + slack
            if a == root:
                low[i], high[i] = -reach, reach
                needed = np.full(len(among), bool(windows[a]))
            else:
                parent, step = place[group.parent[a]], group.edge[a] * norms + slack
                np.maximum(low[parent] - step, -reach, out=low[i])
                np.minimum(high[parent] + step, reach, out=high[i])
                needed = np.zeros(len(among), bool)
                for best in windows[a]:
                    needed |= (high[i] >= best.floor) & (low[i] <= best.high)
            at = np.flatnonzero(needed)
            asked, multiplied = asked + len(among), multiplied + len(at)
            if not len(at):
                continue
            if not whole:
                scores = (numbers[at] * group.numbers[a]).sum(1)
            elif 4 * len(at) > len(among):
                scores = (floats @ group.floats[a])[at].astype(np.int64)
            else:
                scores = (floats[at] @ group.floats[a]).astype(np.int64)
            low[i, at] = high[i, at] = scores
            if alike:
                other = rows[at] != group.rows[a]
                at, scores = at[other], scores[other]
            for best in windows[a]:
                best.add(scores, ids[at], rows[at])
    return asked, multiplied


def share_of(score: int, least: int, most: int) -> tuple[int, int]:
    """The whole numbers n with least * score <= 100 * n <= most * score."""
    return -(-least * score // 100), most * score // 100


def _packed_blocks(rows: DataFrame, width: int) -> DataFrame:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                part = batch.iloc[lo : lo + BLOCK].sort_values("label", kind="stable")
                yield pd.DataFrame(
                    {
                        "ids": [part["vec_id"].to_numpy(np.int64).tobytes()],
                        "rows": [part["row"].to_numpy(np.int64).tobytes()],
                        "labels": [part["label"].to_numpy(np.int64).tobytes()],
                        "numbers": [_bytes(_matrix(part["vector"], width))],
                    }
                )

    columns = "ids binary, rows binary, labels binary, numbers binary"
    packs = rows.select("vec_id", "row", "label", "vector").mapInPandas(pack, columns)
    return packs.withColumn("block", F.monotonically_increasing_id())


def _packed_anchors(anchors: DataFrame, groups: int, width: int) -> DataFrame:
    """Groups of anchors of one label, or few, that lie close together, with their trees."""
    turn = rotation(anchors, width)[:, :DIRECTIONS] if width else np.zeros((0, 0))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            signs = _matrix(batch["vector"], width) @ turn >= 0
            code = np.bitwise_xor.accumulate(signs, axis=1) @ (1 << np.arange(signs.shape[1])[::-1])
            yield batch.assign(code=code.astype(np.int64))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), GROUP):
                part = batch.iloc[lo : lo + GROUP]
                numbers = _matrix(part["vector"], width)
                labels = part["label"].to_numpy(np.int64)
                order, parent, edge = spanning_trees(numbers, labels)
                yield pd.DataFrame(
                    {
                        "ids": [part["vec_id"].to_numpy(np.int64).tobytes()],
                        "rows": [part["row"].to_numpy(np.int64).tobytes()],
                        "labels": [labels.tobytes()],
                        "numbers": [_bytes(numbers)], "order": [order.tobytes()],
                        "parent": [parent.tobytes()], "edge": [edge.tobytes()],
                    }
                )

    near = anchors.select("vec_id", "row", "label", "vector").mapInPandas(
        coded, "vec_id long, row long, label long, vector array<long>, code long"
    )
    near = near.repartitionByRange(groups, "label", "code", "row").sortWithinPartitions("label", "code", "row")
    columns = "ids binary, rows binary, labels binary, numbers binary, `order` binary, parent binary, edge binary"
    return near.mapInPandas(pack, columns).withColumn("group", F.monotonically_increasing_id())


def _tiled(side: DataFrame, key: str, own: str, parts: int, other: str, others: int) -> DataFrame:
    """Each block or group in its part, once for every part of the other side."""
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint")))
    return side.withColumn(own, F.pmod(F.xxhash64(key), F.lit(parts))).withColumn(other, every)


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10,
    least: int = 30, most: int = 90, scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` have vec_id, embedding and label; other columns are not read. Anchors are the rows whose
    vec_id is divisible by ``every``. Scores are whole inner products; higher ones come first, ties by
    smaller vec_id. An anchor's positives are its first ``positives`` other rows of its label; for each of them
    come the first ``negatives`` rows of another label whose score is between ``least`` and ``most`` percent
    of the positive's. Rows without vec_id, label or vector, or with null or non-finite components,
    take no part. Every row counts, also where vec_ids repeat: only an anchor's own row is not its
    positive. Vectors of different widths are filled up with zeros. Without anchors there are no rows.
    """
    scratch = Scratch(vectors.sparkSession)
    result = stored(_hard_negatives(vectors, every, positives, negatives, least, most, scale, scratch))
    scratch.remove()
    return result


def _hard_negatives(vectors, every, positives, negatives, least, most, scale, scratch: Scratch) -> DataFrame:
    spark, stored = vectors.sparkSession, scratch.stored
    rows = stored(usable(vectors, scale))
    shape = rows.agg(
        F.count("*").alias("n"), F.max(F.size("vector")).alias("width"),
        F.count(F.when(F.col("vec_id") % every == 0, True)).alias("anchors"),
    ).first()
    if not shape["anchors"]:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    width = shape["width"]
    blocks = stored(_packed_blocks(rows, width))
    anchors = rows.where(F.col("vec_id") % every == 0)
    groups = stored(_packed_anchors(anchors, -(-shape["anchors"] // GROUP), width))
    tile = min(max(shape["n"] * width * 4 // 64, LEAST_TILE), LARGEST_TILE)
    bundles, lots = (max(1, -(-n * width * 4 // tile)) for n in (shape["n"], shape["anchors"]))

    def met(anchor_packs: DataFrame, windows_of, same_label: bool) -> DataFrame:
        left = _tiled(blocks, "block", "bundle", bundles, "lot", lots).groupBy("bundle", "lot")
        right = _tiled(anchor_packs, "group", "lot", lots, "bundle", bundles).groupBy("bundle", "lot")

        def tile_of(some_blocks: pd.DataFrame, some_groups: pd.DataFrame) -> pd.DataFrame:
            found = [np.zeros((0, 5), np.int64)]
            for packed_group in some_groups.itertuples():
                group = Group(packed_group, width)
                windows = windows_of(packed_group, group)
                if not any(windows):
                    continue
                for packed_block in some_blocks.itertuples():
                    search(Block(packed_block, width), group, windows, same_label)
                for anchor, of_anchor in zip(group.rows.tolist(), windows):
                    for number, best in enumerate(of_anchor):
                        found.append(np.column_stack([
                            np.full(len(best.ids), anchor), np.full(len(best.ids), number), best.ids, best.rows, best.scores
                        ]))
            return pd.DataFrame(np.concatenate(found), columns=["anchor", "number", "vec_id", "row", "score"])

        return left.cogroup(right).applyInPandas(
            tile_of, "anchor long, number long, vec_id long, row long, score long"
        )

    def alike(packed_group, group: Group) -> list[list[Best]]:
        return [[Best(positives)] for _ in group.ids]

    def unlike(packed_group, group: Group) -> list[list[Best]]:
        scores = np.frombuffer(packed_group.scores, np.int64)
        cuts = np.frombuffer(packed_group.cuts, np.int64)
        return [
            [Best(negatives, *share_of(int(s), least, most)) for s in scores[lo:hi]] for lo, hi in zip(cuts, cuts[1:])
        ]

    order = (F.desc("score"), "vec_id", "row")
    best = Window.partitionBy("anchor").orderBy(*order)
    chosen = met(groups, alike, True).withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    chosen = stored(chosen.select("anchor", F.col("vec_id").alias("positive_id"), "row", F.col("score").alias("positive_score")))

    # windows of one score are one; a negative score has none
    open_scores = chosen.where("positive_score >= 0").groupBy("anchor").agg(
        F.array_sort(F.collect_set("positive_score")).alias("scores")
    )
    numbered = stored(open_scores.select("anchor", F.posexplode("scores").alias("number", "positive_score")))
    in_groups = groups.select("group", "rows").mapInPandas(_members, "group long, place long, anchor long")
    lists = in_groups.join(open_scores, "anchor", "left").groupBy("group").agg(
        F.array_sort(F.collect_list(F.struct("place", "scores"))).alias("members")
    )
    asked = stored(groups.join(lists.mapInPandas(_windows, "group long, scores binary, cuts binary"), "group"))
    best = Window.partitionBy("anchor", "number").orderBy(*order)
    found = met(asked, unlike, False).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    found = found.select("anchor", "number", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    joined = chosen.join(numbered, ["anchor", "positive_score"]).join(found, ["anchor", "number"]).join(ids, "anchor")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The anchors of packed groups as rows."""
    for batch in batches:
        for group, content in zip(batch["group"], batch["rows"]):
            rows = np.frombuffer(content, np.int64)
            yield pd.DataFrame({"group": group, "place": np.arange(len(rows)), "anchor": rows})


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Scores of each group's anchors in one array, and where each anchor's begin."""
    for batch in batches:
        out = []
        for group, members in zip(batch["group"], batch["members"]):
            scores = [np.asarray(m["scores"] if m["scores"] is not None else [], np.int64) for m in members]
            cuts = np.concatenate(([0], np.cumsum([len(s) for s in scores])))
            out.append((group, np.concatenate(scores).astype(np.int64).tobytes(), cuts.astype(np.int64).tobytes()))
        yield pd.DataFrame(out, columns=["group", "scores", "cuts"])
