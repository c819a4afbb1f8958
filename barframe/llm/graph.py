"""Connected components over edge tables, without leaving Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import hubs, in_all_parts, in_part, spread_join
from .storage import discard, materialize


def _hook(edges: DataFrame, labels: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """(node, label, settled): the least label among a node's own and its neighbours', and whether those were all one."""
    far = in_all_parts(labels.select(F.col("node").alias("b"), "label"), "b", heavy)
    near = edges.join(far, ["b", "part"]).groupBy(F.col("a").alias("node"))
    return near.agg(F.min("label").alias("label"), (F.min("label") == F.max("label")).alias("settled"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): each node of ``edges`` (a, b) with the least node it can reach.

    Minimum-label propagation, two hops and a pointer jump a round: chains shorten by
    more than half in each, and stars settle in the first. The edges of a node with very
    many are dealt in parts, and so are the nodes of a label with very many; what they look
    up is sent to each part. Every round is written to the shared folder, so lineage
    stays short and a lost executor costs one round at most. Nodes without an edge are
    not in the result.
    """
    spark = edges.sparkSession
    ways = edges.where("a <> b").select(F.explode(F.expr("array(struct(a AS a, b AS b), struct(b AS a, a AS b), struct(a AS a, a AS b), struct(b AS a, b AS b))")).alias("e"))
    both = materialize(spark, ways.select("e.a", "e.b").distinct(), "edges")
    total = both.count()
    heavy = hubs(both.groupBy("b").agg(F.count("*").alias("size")), "b", total)
    dealt = in_part(both, "b", "a", heavy)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    for n in range(max_rounds):
        new = materialize(spark, _hook(dealt, _hook(dealt, labels, heavy), heavy), "labels")
        if n:
            discard(written)
        written = new
        if new.where("NOT settled").isEmpty():
            discard(both)
            return new.select("node", "label")
        roots = new.select(F.col("node").alias("label"), F.col("label").alias("root"))
        sizes = new.groupBy("label").agg(F.count("*").alias("size"))
        labels = spread_join(new.select("node", "label"), roots, "label", "node", sizes, total).select("node", F.least("label", "root").alias("label"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
