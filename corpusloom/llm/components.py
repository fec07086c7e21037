"""Connected components of an edge table, as joins and aggregations over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b); component is the smallest node that links reach.

    Each round takes the smallest label among a node and its neighbours and then the label of that label, so labels
    travel twice as far each time; rounds end when nothing changes. Aggregations combine on the map side and every
    join's inputs are plain exchanges, which Spark can split when a node has very many links. Null ends are ignored.
    """
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    e = materialize(e.union(e.select("b", "a")).distinct())
    labels = materialize(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = e.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = materialize(step)
        up = step.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = materialize(step.join(up, "label").select("node", F.least("label", "above").alias("label"), (F.least("label", "above") < F.col("old")).alias("moved")))
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
