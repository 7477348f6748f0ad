"""Mixing sources to target weights along a curriculum.

Targets are poured like water: every source rises with its weight until its cap. A source's documents
form a stream in an order that depends on their ids and texts alone; as many whole documents are taken
from that stream as come nearest to the target, and it may run more than once. A source's share of the training changes over time by a schedule; its
integral is the source's cumulative demand, whose inverse gives the training position at which a
place of the stream is due. Sorting by position over all sources gives the training order.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartwright.llm.tables import stored

WORD = r"[^\x20\x09-\x0D]+"
#: A source's stream is cut into 16 ** BUCKET_DIGITS parts, each summed and ordered on its own.
BUCKET_DIGITS = 3


@dataclass(frozen=True)
class Recipe:
    """Weights go round the sources in the order of their names. ``schedule`` has, for each weight,
    the relative demand at the start and at the end of the training; it changes evenly between.
    ``share`` is the mix's size as a multiple of all sizes, ``most`` the most of a source or document."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: int = 2
    schedule: tuple[tuple[float, float], ...] = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def _of_turn(values: tuple[float, ...], turn: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (turn + 1).cast("int"))


def targets(sizes: DataFrame, recipe: Recipe) -> DataFrame:
    """(source, place, turn, source_size, target) from rows of (source, size): a row a source.

    Sorted by cap per weight, the sources up to some place are at their caps, and all others share
    what is left by weight. The windows run over one row a source.
    """
    whole = F.lit(recipe.share) * F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sums.withColumn("place", F.row_number().over(named) - 1)
    sources = sources.withColumn("turn", F.col("place") % len(recipe.weights))
    sources = sources.withColumn("weight", _of_turn(recipe.weights, F.col("turn"))).withColumn(
        "cap", F.col("source_size") * recipe.most
    )
    poured = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = F.coalesce(F.sum("cap").over(poured.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(poured.rowsBetween(0, Window.unboundedFollowing))
    levels = sources.withColumn("level", (whole - before) / rest)
    open_level = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))
    final = F.first(open_level, ignorenulls=True).over(
        poured.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    levels = levels.withColumn("final", final)
    target = F.when(
        F.col("final").isNull() | (F.col("cap") <= F.col("level") * F.col("weight")), F.col("cap")
    ).otherwise(F.col("final") * F.col("weight"))
    return levels.select("source", "place", "turn", "source_size", target.cast("double").alias("target"))


def mixed(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """(doc_id, source, size, source_size, target, budget, start, taken, turn): a row a document.

    ``size`` is the text's words (null: 0). ``start`` is the document's place in its source's
    stream, in words; ``budget`` the target in whole words; ``taken`` the words the mix takes:
    every full run of the stream, and of the last run the documents of which more than half lies
    before its end. Documents are taken whole, so a source misses its budget by half a document at
    most. A null source is a source, the last one; rows of one doc_id, or without, are documents of
    their own. An empty table gives no rows; where no text has a word all is 0. Other columns
    are not read.
    """
    return _mixed(docs, recipe)


def _mixed(docs: DataFrame, recipe: Recipe, *more: str) -> DataFrame:
    """The rows of ``mixed`` with the columns ``more``.

    The place in the stream follows from a digest of id and text and, among equal rows, of their
    count, so that no id and no text, however frequent, makes a part of the stream long.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    id_and_text = F.concat_ws(
        "\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")]
    )
    equal = docs.select("doc_id", "source", *more, size.alias("size"), F.md5(id_and_text.cast("binary")).alias("key"))
    equal = equal.groupBy("doc_id", "source", *more, "size", "key").agg(F.count("*").alias("n"))
    each = equal.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    key = F.md5(F.concat("key", F.col("copy").cast("string")).cast("binary"))
    sizes = stored(each.withColumn("key", key).drop("n", "copy"))
    rows = sizes.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sources = stored(targets(sizes, recipe))
    # where each part of a stream starts: a row a source and part
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    parts = parts.select(
        F.col("source").alias("part_source"), F.col("bucket").alias("part_bucket"),
        (F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")).alias("offset"),
    )
    starts = parts.join(sources, F.col("part_source").eqNullSafe(F.col("source"))).drop("source")
    placed = rows.join(
        starts,
        F.col("source").eqNullSafe(F.col("part_source")) & (F.col("bucket") == F.col("part_bucket")),
    )
    inside = Window.partitionBy("place", "bucket").orderBy("key", "doc_id", "size", *more).rowsBetween(
        Window.unboundedPreceding, 0
    )
    placed = placed.withColumn("start", F.col("offset") + F.sum("size").over(inside) - F.col("size"))
    budget = F.floor(F.col("target") + 0.5)
    runs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    last = budget - runs * F.col("source_size") - F.col("start")
    taken = (runs + F.when(2 * last > F.col("size"), 1).otherwise(0)) * F.col("size")
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", budget.alias("budget"), "start",
        taken.cast("bigint").alias("taken"), "turn", *more,
    )


def due(words: Column, budget: Column, turn: Column, recipe: Recipe) -> Column:
    """The training time, 0 to 1, at which a source's cumulative demand reaches so many words.

    With demand changing evenly from a to b its integral over 0 to t is (a t + (b - a) t^2 / 2),
    and this is the integral's inverse.
    """
    a = _of_turn(tuple(s for s, _ in recipe.schedule), turn)
    b = _of_turn(tuple(e for _, e in recipe.schedule), turn)
    part = words / budget
    return part * (a + b) / (a + F.sqrt(a * a + (b * b - a * a) * part))


def placements(rows: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """(doc_id, source, copy, words, position) of each time a document is taken, in training order.

    ``rows`` come from ``mixed``. Ties are ordered by source, doc_id and copy.
    """
    return _placements(rows, recipe).orderBy("position", "source", "doc_id", "copy")


def _placements(rows: DataFrame, recipe: Recipe, *more: str) -> DataFrame:
    """The rows of ``placements`` in no order, with the columns ``more``."""
    copies = F.expr("taken div size")
    each = rows.where("taken > 0").select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)).alias("copy")
    )
    begin = F.col("start") + F.col("copy") * F.col("source_size")
    return each.select(
        "doc_id", "source", "copy", F.col("size").alias("words"),
        due(begin, F.col("budget"), F.col("turn"), recipe).alias("position"), *more,
    )


def training_order(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """The documents as the mix takes them: a row for each copy, all columns, sorted by position.

    Every row is a document of its own, also where ids are missing or repeat, and always whole.
    """
    fields = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # a column may be named like ours
    # equal rows have one key: one of them is joined to the places of all of them
    keyed = docs.select(fields.alias("doc"), F.md5(F.to_json(fields).cast("binary")).alias("row_key"))
    rows = _mixed(keyed.select("doc.doc_id", "doc.source", "doc.text", "row_key"), recipe, "row_key")
    taken = _placements(rows, recipe, "row_key").select(
        "row_key", F.col("doc_id").alias("taken_id"), F.col("source").alias("taken_source"), "copy", "position",
    )
    joined = keyed.dropDuplicates(["row_key"]).join(taken, "row_key")
    ordered = joined.orderBy("position", "taken_source", "taken_id", "row_key", "copy")
    return ordered.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
