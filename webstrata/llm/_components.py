"""Connected components of a graph given as edges, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm._io import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every end of an edge (a, b): comp is the smallest id of its component.

    Every round the labels of two ends meet: the larger label learns of the smaller, and
    every id takes the label of its label. Hubs cost one row per edge, as sums are formed
    before the shuffle. Rounds grow with the logarithm of the longest path; each is a
    small plan over stored tables.
    """
    edges = edges.select("a", "b").where("a <> b")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")))
    while True:
        # edges between the labels of their ends, as far as they differ
        ends = edges.join(labels.select(F.col("id").alias("a"), F.col("comp").alias("x")), "a").join(labels.select(F.col("id").alias("b"), F.col("comp").alias("y")), "b")
        open_ = stored(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if open_.limit(1).count() == 0 and labels.join(labels.select(F.col("id").alias("comp"), F.col("comp").alias("up")), "comp").where("up <> comp").limit(1).count() == 0:
            return labels
        learn = open_.groupBy("b").agg(F.min("a").alias("to")).select(F.col("b").alias("id"), "to")
        roots = labels.join(learn, "id", "left").select("id", F.least("comp", F.coalesce("to", "comp")).alias("comp"))
        hop = roots.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        labels = stored(roots.join(hop, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp")))
