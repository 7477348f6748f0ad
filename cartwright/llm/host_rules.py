"""Quality rules, judged for documents and for the hosts they come from.

Everything here is made of Spark's own functions. A document's counts come from its text alone, without
a shuffle; hosts are a small aggregate, whose verdicts are joined back to narrow rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.llm.tables import stored

#: Fixed values of the base rule.
WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 8, 20, 30
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\f\r"
#: A host is given up if its shrunk rate of failures is above this.
MOST_FAILED = 0.5
#: Least and most strength of the prior, in documents.
WEAKEST, STRONGEST = 1.0, 1e6


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def counts(docs: DataFrame) -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Words are runs of anything but the six ASCII blanks; a null text has none. ``n_repeat_words`` are
    the words covered by windows of 8 words that the text has twice or more. Windows are compared by
    64-bit hashes, sorted together with their places, so that a text of one repeated word costs no
    more than any other of its length.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x09-\x0D ]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x09-\x0D ]"))
    rows = docs.withColumns(
        {
            "hashes": F.transform(words, lambda w: F.xxhash64(w)),
            "word_chars": F.length(_without(text, _BLANKS)).cast("bigint"),
            "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("bigint"),
            "lines": lines,
        }
    )
    rows = rows.withColumn("n_words", F.size("hashes").cast("bigint")).withColumn(
        "n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint")
    )
    places = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)))
    windows = F.transform(places, lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))
    rows = rows.withColumn("windows", F.coalesce(windows, F.array().cast("array<bigint>")))
    # almost no text repeats a window; only those that do are sorted
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.transform("windows", lambda h, i: F.struct(h.alias("hash"), i.alias("place")))
    rows = rows.withColumn("sorted", F.when(repeats, F.array_sort(pairs)))

    def twice(x: Column, i: Column) -> Column:
        before = F.get("sorted", i - 1)["hash"]
        after = F.get("sorted", i + 1)["hash"]
        return F.coalesce(before == x["hash"], F.lit(False)) | F.coalesce(after == x["hash"], F.lit(False))

    spots = F.array_sort(F.transform(F.filter("sorted", twice), lambda x: x["place"]))
    covered = F.aggregate(
        spots,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("words")),
        lambda seen, at: F.struct(
            at.alias("last"), (seen["words"] + F.least(F.lit(WINDOW), at - seen["last"])).alias("words")
        ),
        lambda seen: seen["words"],
    )
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint")))
    return rows.drop("hashes", "lines", "windows", "sorted")


def base_failed() -> Column:
    """Too few words, or more than 30 % of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )


def hosts(rows: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, n_docs, n_failed, rate): each host's rate of failures, shrunk to that of all.

    The prior is a beta distribution with the mean of all documents; its strength comes from how much
    the hosts' own rates vary (moments), between one and a million documents. A host of few
    documents stays near the mean, one of many keeps its own rate. Null is a host.
    """
    own = rows.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("bigint")).alias("n_failed")
    )
    own = stored(own)
    sums = own.agg(
        F.sum("n_failed").alias("failed"), F.sum("n_docs").alias("docs"), F.count("*").alias("hosts")
    ).first()
    mean = (sums["failed"] or 0) / sums["docs"] if sums["docs"] else 0.0
    spread = own.agg(F.sum(F.pow(F.col("n_failed") / F.col("n_docs") - F.lit(mean), 2)).alias("s")).first()["s"]
    variance = (spread or 0.0) / (sums["hosts"] - 1) if sums["hosts"] > 1 else 0.0
    strength = mean * (1 - mean) / variance - 1 if variance > 0 else STRONGEST
    strength = min(max(strength, WEAKEST), STRONGEST)
    rate = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return own.withColumn("rate", rate)


def judged(docs: DataFrame, host: str = "source", most_failed: float = MOST_FAILED) -> DataFrame:
    """(doc_id, host, the counts, base_failed, host_rate, kept): a row for every document.

    A document is kept if it passes the base rule and its host's shrunk rate of failures is at most
    ``most_failed``. Repeated rows and rows without doc_id count as documents of their own; a null
    host is a host; null and empty texts fail; other columns are not read, and an empty table
    gives no rows.
    """
    read = docs.select("doc_id", F.col(host).alias("host"), "text")
    rows = stored(counts(read).drop("text").withColumn("base_failed", base_failed()))
    verdicts = hosts(rows, "host", "base_failed").select(F.col("host").alias("judged"), F.col("rate").alias("host_rate"))
    joined = rows.join(verdicts, F.col("host").eqNullSafe(F.col("judged"))).drop("judged")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= most_failed))
