"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, join_skewed


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, keep: Scratch | None = None) -> DataFrame:
    """(node, component_id) for every node of links; the component is known by its least node.

    In each round a node takes the least label of its neighbours, then the label of its label (pointer jumping), so
    the rounds grow with the logarithm of a component's diameter. A round ends in a written table, so lost executors
    cost one round at most. Links may repeat, run either way or lead to the node itself; null ends are left out.
    The result is a written table, one of keep's where that is given.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    with Scratch(links.sparkSession) as tables:
        both = tables.cut(ends.union(ends.select("b", "a")).distinct(), "edges")
        labels = tables.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
        before = None
        for _ in range(most_rounds):
            now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
            if now == before:
                return (keep.cut if keep else cut)(labels.select("node", F.col("label").alias("component_id")), "components")
            before = now
            heard = join_skewed(both.withColumnRenamed("a", "node"), labels, "node").select(F.col("b").alias("node"), "label")
            near = tables.cut(labels.union(heard).groupBy("node").agg(F.min("label").alias("label")), "near")
            jump = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = tables.cut(join_skewed(near, jump, "label").select("node", F.least("label", "next").alias("label")), "labels")
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
