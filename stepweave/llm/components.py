"""Connected components of an edge table, by contraction.

Each round every node points to the smallest of itself and its neighbours in a random order, pointers
are followed twice, and edges are rewritten between the nodes pointed to. Edges within a contracted
node vanish, so tables shrink by a constant factor a round. Nothing is collected: minima are partial
aggregates, pointers are joined, and every round is stored in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.shared import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (smallest node of the component) for every node of an edge.

    Ids are long; null ends and loops count as no edge; direction and repeats don't matter.
    """
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    member = stored(nodes.select("node", F.col("node").alias("at")), "members")
    while not edges.isEmpty():
        ends = edges.union(edges.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        points = ends.groupBy(F.col("a").alias("u")).agg(F.min(order("b")).alias("m"))
        points = stored(points.select("u", F.least("m", order("u"))["n"].alias("p")), "points")
        for _ in range(2):
            nxt = points.select(F.col("u").alias("p"), F.col("p").alias("q"))
            points = points.join(nxt, "p").select("u", F.col("q").alias("p"))
        points = stored(points, "points")
        left = points.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        right = points.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(left, "a").join(right, "b").where("pa <> pb")
        moved = moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        edges = stored(moved, "edges")
        to = points.select(F.col("u").alias("at"), "p")
        member = stored(
            member.join(to, "at", "left").select("node", F.coalesce("p", "at").alias("at")), "members"
        )
    least = stored(member.groupBy("at").agg(F.min("node").alias("component")), "least")
    return member.join(least, "at").select("node", "component")
