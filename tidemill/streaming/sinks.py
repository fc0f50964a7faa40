"""A sink that publishes each notification once, through restarts and replays.

A micro-batch is written to a folder named by its id and counts only when a marker beside it exists; the marker is
created when the folder is whole.  A batch that is replayed after its marker is there writes nothing; one that failed
before is written over.  A notification whose dedup key was published by an earlier batch, or stands twice in its
own, is left out.  Keys are compared within `days` of the day of a notification: its day is a folder, so that only
folders of those days are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import Files

KEYS = ("user_id", "dedup_key")


class OnceSink:
    """Notifications (user_id, dedup_key, at and other columns) under a path that driver and executors share.

    `deliver` gets the rows of each batch once they count; what it raises is kept in `failed` and stops nothing: the rows
    are stored, and a reader finds them.
    """

    def __init__(self, spark: SparkSession, path: str, *, days: int = 2, deliver: Callable[[DataFrame, int], None] | None = None):
        self.spark, self.path, self.days, self.deliver = spark, path.rstrip("/"), days, deliver
        self.files = Files(spark, path)
        self.failed: list[tuple[int, Exception]] = []

    def batches(self) -> list[int]:
        return sorted(int(n) for n in self.files.names(f"{self.path}/published") if n.isdigit())

    def _folder(self, batch: int) -> str:
        return f"{self.path}/batches/batch={batch}"

    def published(self, without: int | None = None) -> DataFrame | None:
        """All that counts, with `batch` and `day`; None before a batch with rows."""
        paths = [p for b in self.batches() if b != without for p in [self._folder(b)] if any(n.startswith("day=") for n in self.files.names(p))]
        return self.spark.read.options(basePath=f"{self.path}/batches", mergeSchema=True).parquet(*paths) if paths else None

    def publish(self, rows: DataFrame, batch: int) -> None:
        """For `foreachBatch`."""
        if batch in self.batches():
            return
        first = F.row_number().over(Window.partitionBy(*KEYS).orderBy("at", F.xxhash64(*rows.columns)))
        fresh = rows.withColumn("day", F.to_date("at")).withColumn("_first", first).where("_first = 1").drop("_first")
        span = rows.agg(F.min(F.to_date("at")), F.max(F.to_date("at"))).first()
        earlier = self.published(without=batch)
        if earlier is not None and span[0] is not None:
            near = earlier.where(F.col("day").between(F.date_sub(F.lit(span[0]), self.days), F.date_add(F.lit(span[1]), self.days)))
            near = near.select(*KEYS, F.col("day").alias("_day"))
            apart = F.abs(F.datediff("day", "_day")) <= self.days
            fresh = fresh.alias("f").join(near.alias("n"), [F.col(f"f.{k}").eqNullSafe(F.col(f"n.{k}")) for k in KEYS] + [apart], "left_anti")
        fresh.write.mode("overwrite").partitionBy("day").parquet(self._folder(batch))
        self._mark(batch)
        if self.deliver is not None:
            try:
                self.deliver(self.spark.read.schema(fresh.schema).parquet(self._folder(batch)), batch)
            except Exception as e:  # noqa: BLE001 - live delivery is best effort, what is stored counts
                self.failed.append((batch, e))

    def _mark(self, batch: int) -> None:
        self.files.create(f"{self.path}/published/{batch}", "")
