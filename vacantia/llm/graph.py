"""Connected components of an edge table, by least labels, hooks on the labels' nodes, and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, label): of every node in edges (a, b) the least node that it is connected with.

    In each round a node learns the least label among its neighbours, passes it on to the node that its
    own label names, and then takes that node's label. Labels only fall, and the rounds end when none
    does; their number grows about as the log of a component's width, chains included. Rounds are
    written to the shared folder. Nodes of any orderable type; edges with a null or to itself go.
    """
    edges = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()
    edges = common.cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = common.cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other")).select("node", F.least("node", "other").alias("label")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("least"))
        told = labels.join(near, F.col("node") == F.col("a"))
        told = told.select("node", "least").union(told.select(F.col("label").alias("node"), "least"))
        told = told.groupBy(F.col("node").alias("__node")).agg(F.min("least").alias("least"))
        lower = labels.join(told, F.col("node") == F.col("__node")).select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        lower = common.cut(lower, "labels")
        jump = lower.select(F.col("node").alias("__at"), F.col("label").alias("__to"))
        following = lower.join(jump, F.col("label") == F.col("__at")).select("node", "old", F.least("label", "__to").alias("label"))
        following = common.cut(following, "labels")
        moved = following.filter(F.col("label") != F.col("old")).limit(1).count()
        labels = following.select("node", "label")
        if not moved:
            return labels
