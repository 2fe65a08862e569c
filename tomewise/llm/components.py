"""Connected components over tables of edges, by smallest neighbour labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewise.llm.common import join_salted, materialize


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for each node of ``edges`` (a long, b long): root is the smallest node of its component. ``rows``: edges, about, if known.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one round at most. Hubs, and roots that
    many nodes have reached, are salted in the joins. Self-loops and repeated edges do no harm; without edges the result is empty."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", rows=rows)
    number = both.count()
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root"), F.count("*").alias("degree")), "labels", rows=number)
    nodes = labels.count()
    while True:
        near = join_salted(both, labels.select(F.col("node").alias("b"), "root", "degree"), ["b"], "degree", number).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = materialize(labels.join(near, "node").select("node", F.least("root", "near").alias("low"), F.col("root").alias("was"), "degree"), "lower", rows=nodes)
        if lower.where("low <> was").isEmpty():  # every node has the root of all its neighbours
            return labels.select("node", "root")
        jump = lower.groupBy("low").agg(F.count("*").alias("n")).join(labels.select(F.col("node").alias("low"), F.col("root").alias("further")), "low")
        labels = materialize(join_salted(lower, jump, ["low"], "n", nodes).select("node", F.least("low", "further").alias("root"), "degree"), "labels", rows=nodes)
