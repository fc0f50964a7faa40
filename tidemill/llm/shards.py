"""Proportional stratified interleaving of documents into shards.

Law: `rows`.  Within each source the rows are put in a seeded random order; the
row of rank r (from 1) of n gets the fraction (2r - 1) / 2n; all rows are sorted
by fraction and the order is cut into shards whose counts differ by one at most.
A shard so holds the same range of fractions of each source: its mixture is that
of all documents, to within a row per source.

DataFrame functions only.  Neither order is ever made in one task: rows are
ranked in small buckets of their order (a prefix of the random key, or a range
of fractions), and bucket counts, which are one row per bucket, give each
bucket's offset.  A source with a third of all rows spreads over all buckets.

Groups: equal texts.  The law `rows` has no place for them (one group may be
larger than a shard), so rows of equal texts are dealt as rows.

Nulls and empties: a null source is a stratum of its own; a null text has no
bytes (size 1, crc32 0); a null doc_id is ordered as an empty string.  Repeated
rows each get a slot; the seeded order is that of a hash of doc_id and text.  An
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import staged

SHARDS = 8
#: rows of a bucket, on average
BUCKET_ROWS = 4096


def _offsets(counts: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """With `before` (rows of earlier buckets) and `of` (all rows) within `by`."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return counts.withColumn("before", F.sum("n").over(part.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))).select(
        *by, bucket, F.coalesce("before", F.lit(0)).alias("before"), F.sum("n").over(part).alias("of")
    )


def shard_of(position: Column, rows: int, shards: int) -> Column:
    """The shard of a place in the order; shard s begins at floor(s * rows / shards)."""
    return F.floor((shards * (position + 1) - 1) / F.lit(rows).cast("decimal(20,0)")).cast("int")


def interleaved(
    docs: DataFrame, *, shards: int = SHARDS, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs."""
    rows = docs.count()
    digits = 2
    while rows > bucket_rows * 16**digits:
        digits += 1
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    # the text's sum spreads rows that share an id, or have none
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.crc32(text).cast("string")).cast("binary"))
    source = F.col(source_col).cast("string")
    stratum = [F.coalesce(source, F.lit("")).alias("source"), source.isNull().alias("no_source")]
    keyed = docs.select(*stratum, key.alias("key"), F.substring(key, 1, digits).alias("bucket"))
    full = docs.select(F.col(id_col).alias("doc_id"), *stratum, key.alias("key"), F.substring(key, 1, digits).alias("bucket"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))

    by = ["source", "no_source"]
    first = _offsets(keyed.groupBy(*by, "bucket").agg(F.count("*").alias("n")), by, "bucket")
    ranked = full.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("key", "text_crc32"))).join(first, [*by, "bucket"])
    twice = 2 * (F.col("before") + F.col("rank")) - 1
    buckets = max(256, rows // bucket_rows + 1)
    fraction = staged(
        ranked.select("doc_id", "size", "text_crc32", *by, "key", (twice / (2 * F.col("of"))).cast("double").alias("fraction"), F.floor(twice * buckets / (2 * F.col("of"))).alias("range")),
        "fractions",
    )

    second = _offsets(fraction.groupBy("range").agg(F.count("*").alias("n")), [], "range")
    order = Window.partitionBy("range").orderBy("fraction", "no_source", "source", "key", "text_crc32")
    placed = fraction.withColumn("position", F.row_number().over(order) - 1).join(second, "range").withColumn("position", F.col("before") + F.col("position"))
    shard = shard_of(F.col("position"), max(rows, 1), shards)
    out = placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), "position")
    begin = F.floor(F.col("shard").cast("decimal(20,0)") * rows / shards).cast("long")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("position") - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
