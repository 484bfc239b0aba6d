"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calyx.llm.common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): comp is the smallest node reachable; only nodes that have an edge are listed.

    Each round every node takes the smallest label among its neighbours and then its label's label, so the rounds
    grow with the logarithm of a component's diameter.  Each round is written to the shared folder; a node with very
    many edges sums them up before the shuffle.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node != other")
    both = written(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.min("other").alias("m"))
                     .select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "other"), "other")
                .groupBy("node").agg(F.min("comp").alias("near")))
        # A root hears of the smaller labels that its members have heard of.
        heard = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        heard = written(heard, "heard")
        roots = heard.groupBy("comp").agg(F.min("low").alias("root_low"))
        roots = written(roots, "roots")
        moved = heard.join(roots, "comp").select("node", "comp", F.least("low", "root_low").alias("next"))
        moved = written(moved, "moved")
        jump = moved.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        labels = written(moved.join(jump, "next", "left")
                         .select("node", F.least("next", F.coalesce("jump", "next")).alias("comp"),
                                 (F.least("next", F.coalesce("jump", "next")) != F.col("comp")).alias("changed")), "labels")
        if labels.where("changed").limit(1).count() == 0:
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")
