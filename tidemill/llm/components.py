"""Connected components of a graph given as a table of edges.

Alternates the large-star and small-star rewirings (Kiveris et al., 2014)
until no edge changes: every node then points at the smallest node of its
component.  Each step is a map-side combined minimum and a join with one row per
node; a node with very many edges makes a large partition of that join, which
adaptive execution splits, and no neighbourhood is ever held as a list.  Each
round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, staged

MAX_ROUNDS = 50


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One rewiring of edges (a, b); a and b differ."""
    if large:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = near.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each node of edges (a long, b long); component is the smallest id.

    Loops and repeated edges do no harm; an edge with a null end is ignored; no edges give no rows.
    """
    edges = staged(
        edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "edges"
    )
    seen = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        after = staged(_star(_star(edges, True), False), "edges")
        drop(edges.sparkSession, edges)
        edges, now = after, _state(after)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no fixed point after {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
