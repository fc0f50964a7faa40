"""Best-fit packing of documents into fixed-size sequences, with conflicts.

A document of n words takes n // capacity bins of its own and one rest of
n % capacity words.  Rests are packed best-fit decreasing: bins are ordered by
residual, and the search starts at the least residual that is large enough and
goes on, through bins of equal and then larger residuals, until a bin is
compatible; that is the tightest compatible bin.  A bin carries one bitmap of
the duplicate clusters in it and `per_source` bitmaps of its sources (plane k:
sources with more than k members).  A bin is incompatible if it holds the
document's cluster, or `per_source` documents of its source, already.

Rests are dealt by a hash of their id and text to groups of about `group_rows`,
each packed by one task, so that memory and time of a task are bounded; a group
wastes at most about a bin.  Rows of one id and text of which there are more than
`group_rows` / 8 are dealt by row, so that no group is theirs alone.  Bits are
dense numbers of the sources and clusters of the group: bitmaps are exact.  Of
bins with equal residuals the one that has had it longest is tried first.

Nulls and empties: a document without words (or null) has one row with piece
0, no words and no bin.  A null doc_id is an id as any other; a null source is a
source of its own.  Repeated rows are packed as often as they occur, in different
bins as they share a cluster.  An empty table gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import staged

CAPACITY = 2048
PER_SOURCE = 2
GROUP_ROWS = 2048


class Bins:
    """Bins by residual: a bitmap of the residuals in use, and the bins of each."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.used = 0
        self.of: dict[int, list[int]] = {}
        self.sources: list[list[int]] = []
        self.clusters: list[int] = []

    def _fits(self, b: int, source: int, cluster: int) -> bool:
        return not (self.clusters[b] >> cluster & 1) and not (self.sources[b][-1] >> source & 1)

    def _successor(self, residual: int) -> int:
        """The least residual in use that is at least this one, or -1."""
        above = self.used >> residual
        return residual + (above & -above).bit_length() - 1 if above else -1

    def place(self, size: int, source: int, cluster: int) -> int:
        residual = self._successor(size)
        while residual >= 0:
            for at, b in enumerate(self.of[residual]):
                if self._fits(b, source, cluster):
                    del self.of[residual][at]
                    if not self.of[residual]:
                        self.used &= ~(1 << residual)
                    self._put(b, residual - size, source, cluster)
                    return b
            residual = self._successor(residual + 1)
        self.sources.append([0] * self.per_source)
        self.clusters.append(0)
        b = len(self.clusters) - 1
        self._put(b, self.capacity - size, source, cluster)
        return b

    def _put(self, b: int, residual: int, source: int, cluster: int) -> None:
        self.clusters[b] |= 1 << cluster
        for k, plane in enumerate(self.sources[b]):
            if not plane >> source & 1:
                self.sources[b][k] |= 1 << source
                break
        if residual:
            self.of.setdefault(residual, []).append(b)
            self.used |= 1 << residual


def pack(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> np.ndarray:
    """A bin for each item, in the order given."""
    bins = Bins(capacity, per_source)
    return np.array([bins.place(*item) for item in zip(sizes.tolist(), sources.tolist(), clusters.tolist(), strict=True)], np.int64)


def _pack_group(capacity: int, per_source: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        sources, clusters = (group[c].combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in ("source", "cluster"))
        bins = pack(group["n_words"].to_numpy(), sources, clusters, capacity, per_source)
        return group.select(["doc_id", "piece", "start", "n_words", "group"]).append_column("bin", pa.array(bins))

    return run


def _salted(items: DataFrame, most: int) -> DataFrame:
    """items with a salt: 0, or a number of its own for a row of which more than `most` repeat the id and cluster."""
    repeated = items.groupBy("doc_id", "cluster").agg(F.count("*").alias("n")).where(f"n > {most}")
    repeated = staged(repeated.select(F.col("doc_id").alias("again_id"), F.col("cluster").alias("again")), "repeated")
    if repeated.isEmpty():
        return items.withColumn("salt", F.lit(0).cast("long"))
    return items.join(repeated, items["doc_id"].eqNullSafe(repeated["again_id"]) & (items["cluster"] == repeated["again"]), "left").withColumn(
        "salt", F.when(F.col("again").isNull(), 0).otherwise(F.col("row"))
    )


def packed(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(doc_id, piece, start, n_words, bin_id) for each piece of each row of docs.

    cluster_col names the duplicate cluster; without it equal texts are a cluster.
    """
    rows = docs.count()
    groups = max(1, -(-rows // group_rows))
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.md5(text.cast("binary"))
    items = staged(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            cluster.alias("cluster"),
            F.size(words).cast("long").alias("words"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "items",
    ).withColumn("full", F.floor(F.col("words") / capacity))
    items = _salted(items, max(1, group_rows // 8))
    rest = items.where(f"words % {capacity} > 0 ").select(
        "doc_id",
        F.col("full").alias("piece"),
        (F.col("full") * capacity).alias("start"),
        (F.col("words") % capacity).alias("n_words"),
        "source",
        "cluster",
        F.pmod(F.xxhash64("doc_id", "cluster", "salt", F.lit(17)), F.lit(groups)).alias("group"),
    )
    placed = rest.groupBy("group").applyInArrow(_pack_group(capacity, per_source), "doc_id long, piece long, start long, n_words long, group long, bin long")
    whole = items.where("full > 0").select(
        "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"), F.lit(capacity).cast("long").alias("n_words"), "cluster"
    )
    none = items.where("words = 0").select("doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("string").alias("bin_id"))
    return (
        placed.select("doc_id", "piece", "start", "n_words", F.concat_ws("-", F.lit("g"), "group", "bin").alias("bin_id"))
        .union(
            whole.select(
                "doc_id",
                "piece",
                (F.col("piece") * capacity).alias("start"),
                "n_words",
                F.concat_ws("-", F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "piece", F.substring("cluster", 1, 12)).alias("bin_id"),
            )
        )
        .union(none)
    )
