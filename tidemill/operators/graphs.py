"""Depths of a large graph of tasks, by joins: no part of it comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dag import CycleError
from ..sources.shared import Files, shared_path

#: rounds, at most: the depth of the deepest task plus one
MOST_ROUNDS = 10_000


def depths(needs: DataFrame, tasks: DataFrame | None = None, *, cyclic: str = "raise") -> DataFrame:
    """(id, depth) of each task: 0 without needs, else one more than its deepest need.

    needs: id, needs (the id of another task).  tasks: id, of tasks that may be in no need.  Each round places the tasks
    whose needs are all placed and takes their edges away; what is left is written anew, so that plans stay
    short and a lost executor costs a round.  When a round places none, the rest waits for a cycle: that raises
    CycleError, or (cyclic="null") gives those tasks a null depth.

    Repeated edges count once; an edge with a null end is none; a task that needs itself is a cycle.  No tasks give no rows.
    """
    spark = needs.sparkSession
    root = shared_path(spark, "depths")
    files = Files(spark, root)
    made = 0

    def kept(df: DataFrame, name: str) -> DataFrame:
        nonlocal made
        made += 1
        path = f"{root}/{name}-{made}"
        df.write.mode("error").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    edges = kept(needs.where("id is not null and needs is not null").select("id", "needs").distinct(), "edges")
    named = edges.select("id").union(edges.select(F.col("needs").alias("id")))
    named = named if tasks is None else named.union(tasks.where("id is not null").select("id"))
    left, out = kept(named.distinct(), "left"), None
    for depth in range(MOST_ROUNDS):
        if left.isEmpty():
            break
        ready = kept(left.join(edges.select("id").distinct(), "id", "left_anti"), "ready")
        if ready.isEmpty():
            if cyclic == "raise":
                raise CycleError(f"{left.count()} tasks wait for a cycle")
            ready, depth = left, None
        placed = ready.withColumn("depth", F.lit(depth).cast("int"))
        out = placed if out is None else out.union(placed)
        if depth is None:
            break
        # tasks that still wait are those with an edge left: the others of this round are placed
        left = kept(left.join(ready, "id", "left_anti"), "left")
        before, edges = edges, kept(edges.join(ready.select(F.col("id").alias("needs")), "needs", "left_anti").select("id", "needs"), "edges")
        files.delete(before.inputFiles()[0].rsplit("/", 1)[0]) if before.inputFiles() else None
    else:
        raise RuntimeError(f"deeper than {MOST_ROUNDS}")
    return out if out is not None else left.withColumn("depth", F.lit(None).cast("int"))
