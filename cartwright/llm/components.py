"""Connected components by smallest labels and pointer jumping."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwright.llm.tables import Scratch


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node of the links (a, b): the smallest node reachable.

    Each round takes the smallest label among a node's own and its neighbours', then the label of
    that label. Rows stay as many as nodes and links; a hub's links are reduced before shuffles.
    """
    stored = (scratch or Scratch(links.sparkSession)).stored
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
        "node", F.least("node", "low").alias("component")))
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("component").alias("low"))
        )
        lower = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("component").alias("was"), F.least("component", "low").alias("component")
        )
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("root"))
        after = stored(
            lower.join(jump, F.col("component") == F.col("via"), "left").select(
                "node", "was", F.least("component", "root").alias("component")
            )
        )
        labels = after.select("node", "component")
        if after.where("was <> component").isEmpty():
            return labels
