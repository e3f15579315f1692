"""Connected components of a table of links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node in links (a, b); comp is the smallest node reachable.

    Each round every component points to its smallest neighbour, chains of pointers are halved until they end, and links
    are renamed by their components; a round at least halves the components that still have links.
    """
    edges = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("comp"))
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("x"))
        parent = materialize(both.groupBy("x.node").agg(F.least(F.min("x.to"), F.col("node")).alias("to")), "parent")
        while True:
            up = parent.select(F.col("node").alias("to"), F.col("to").alias("top"))
            jumped = materialize(parent.join(up, "to", "left").select("node", "to", F.coalesce("top", "to").alias("top")), "jumped")
            moved = not jumped.where("to <> top").isEmpty()
            parent = jumped.select("node", F.col("top").alias("to"))
            if not moved:
                break
        named = parent.select(F.col("node").alias("comp"), F.col("to").alias("top"))
        labels = materialize(labels.join(named, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "labels")
        ends = edges.join(parent.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(parent.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = materialize(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels
