"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of undirected edges (src, dst: long): node, label = the least node that can be reached.

    A forest of parents. In a round each node sees the grandparents of its neighbours, and the least of them becomes
    a parent of the node and of the node's parent (roots hook as well, so whole trees merge), while paths are halved.
    Rounds follow the logarithm of a component's width: paths of 4,096 and 262,144 nodes take 15 and 20 at most, in
    any order of numbers. A round's table is written to the shared folder and the one before deleted; nothing reaches
    the driver but a flag. Empty edges: no rows. Self-loops and repeated edges do no harm; nulls are dropped.
    """
    edges = edges.where("src is not null and dst is not null")
    both = written(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = written(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label")).withColumnRenamed("src", "node"))
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        own = labels.select("node", "label").join(up, "label")
        seen = both.join(own.select(F.col("node").alias("dst"), F.col("top").alias("near")), "dst").groupBy("src").agg(F.min("near").alias("near"))
        met = own.join(seen, F.col("node") == F.col("src"))
        said = F.explode(F.array(F.struct("node", F.col("label").alias("was"), F.least("top", "near").alias("label")), F.struct(F.col("label").alias("node"), F.lit(None).cast("long").alias("was"), F.col("near").alias("label"))))
        new = written(met.select(said.alias("s")).select("s.*").groupBy("node").agg(F.max("was").alias("was"), F.min("label").alias("label")))
        discard(labels)
        labels = new
        if not labels.where("label <> was").head(1):
            discard(both)
            return labels.select("node", "label")
