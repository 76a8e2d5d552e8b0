"""Connected components of an edge table by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, wide_join


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, label): label is the smallest node that can be reached.

    Every round each node points at its smallest neighbour, pointers are shortened, and the edges
    between the groups so found form the next graph, of at most half the nodes. Nulls and self-loops are
    ignored; an empty table gives no rows. Hub nodes' rows are split by adaptive joins; nothing
    reaches the driver.
    """
    e = materialize(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
        low2 = low.select(F.col("node").alias("label"), F.col("label").alias("top"))
        up = materialize(wide_join(low, low2, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "up")
        step = up.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = up if labels is None else wide_join(labels, step, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
        ua, ub = up.select(F.col("node").alias("a"), F.col("label").alias("la")), up.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        nxt = wide_join(wide_join(e, ua, "a"), ub, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
        e, last = materialize(nxt.distinct(), "edges"), e
        drop_scratch(last)
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return materialize(labels, "labels")
