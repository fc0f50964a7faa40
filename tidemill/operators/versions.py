"""Versions of documents with their chunks, written so that a reader sees all of a write or nothing of it.

A write stages its rows as Parquet in a folder of its own; the last thing it does is to create one small file, the
next head, which names the folders that count.  A reader takes the newest head.  A write that fails, or whose tasks
are run again, leaves folders that no head names.  Of two writers that started from the same head one creates the
next; the other finds it there, numbers its versions anew, derives the ids of its documents and chunks again (an
id holds its version, so that the first attempt's ids would collide) and tries once more.

Documents: logical_document_id, content_hash and any other columns.  Chunks: logical_document_id, level
(0 parents, 1 children), chunk_index (of a parent among parents, of a child in its document), parent_index (a
child's parent), heading_path (array), first_block, last_block, content_hash and any other columns.

Nulls and repeats: a document without logical_document_id is not written; of rows that repeat one, that of the greatest
content_hash is (one version of a document a write); chunks without a document in the same write are not written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ids import stable_id
from ..sources.shared import Files

#: how often a write that lost against others starts again
ATTEMPTS = 10
KEY = "logical_document_id"


class Conflict(RuntimeError):
    """Other writers were faster ATTEMPTS times."""


def document_id(logical: Column, version: Column) -> Column:
    return stable_id("doc-", logical, version)


def rederived(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunks with document_id, chunk_id and parent_id for the versions in documents; a chunk's id holds its document's."""
    own = chunks.drop("document_id", "chunk_id", "parent_id").join(documents.select(KEY, "document_id"), KEY)
    path = F.array_join("heading_path", "\x1f")
    parent = lambda index: stable_id("par-", F.col("document_id"), index)
    parents = own.where("level = 0")
    parents = parents.withColumn("chunk_id", stable_id("par-", "document_id", path, "first_block", "last_block", "chunk_index"))
    named = parents.select("document_id", F.col("chunk_index").alias("parent_index"), F.col("chunk_id").alias("parent_id"))
    children = own.where("level = 1").join(named, ["document_id", "parent_index"], "left")
    # a child whose parent is not there still has an id of its own
    of = F.coalesce("parent_id", parent(F.col("parent_index")))
    children = children.withColumn("chunk_id", stable_id("chl-", of, "first_block", "last_block", "chunk_index", "content_hash"))
    return parents.withColumn("parent_id", F.lit(None).cast("string")).unionByName(children)


class VersionStore:
    """Documents and chunks by version under one path, which driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    # heads

    def _head(self) -> tuple[int, list[dict]]:
        heads = [n for n in self.files.names(f"{self.path}/heads") if n.endswith(".json")]
        return (int(heads[-1].removesuffix(".json")), json.loads(self.files.read(f"{self.path}/heads/{heads[-1]}"))) if heads else (0, [])

    def _swap(self, seen: int, parts: list[dict]) -> bool:
        """Make parts what counts, if no other writer came in between: a whole file is moved to the next head's name, which has to be free."""
        staged = f"{self.path}/staged-heads/{uuid.uuid4().hex}"
        self.files.create(staged, json.dumps(parts))
        if self.files.moved(staged, f"{self.path}/heads/{seen + 1:012d}.json"):
            return True
        self.files.delete(staged)
        return False

    # reading

    def _read(self, parts: list[dict], kind: str) -> DataFrame | None:
        paths = [f"{self.path}/{p[kind]}" for p in parts if p.get(kind)]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def documents(self, at: int | None = None) -> DataFrame | None:
        """All versions with `is_active` and `status` (active, archived, deleted), of the newest head or an earlier one; None before a write."""
        parts = self._head()[1] if at is None else json.loads(self.files.read(f"{self.path}/heads/{at:012d}.json"))
        return self._with_status(self._read(parts, "documents"))

    @staticmethod
    def _with_status(rows: DataFrame | None) -> DataFrame | None:
        if rows is None:
            return None
        last = F.col("version_number") == F.max("version_number").over(Window.partitionBy(KEY))
        gone = F.max(F.when(F.col("deleted"), F.col("version_number"))).over(Window.partitionBy(KEY)) >= F.col("version_number")
        marked = rows.withColumns({"_last": last, "_gone": F.coalesce(gone, F.lit(False))}).where(~F.col("deleted"))
        status = F.when(F.col("_gone"), "deleted").when(F.col("_last"), "active").otherwise("archived")
        return marked.withColumns({"is_active": F.col("_last") & ~F.col("_gone"), "status": status}).drop("_last", "_gone", "deleted")

    def chunks(self, active: bool = True) -> DataFrame | None:
        """The chunks of active documents, or of all versions."""
        parts = self._head()[1]
        rows = self._read(parts, "chunks")
        if rows is None or not active:
            return rows
        return rows.join(self._with_status(self._read(parts, "documents")).where("is_active").select("document_id"), "document_id", "left_semi")

    # writing

    def _committed(self, made: Callable[[list[dict]], dict | None]) -> dict | None:
        for _ in range(ATTEMPTS):
            seen, parts = self._head()
            part = made(parts)
            if part is None:
                return None
            if self._swap(seen, [*parts, part]):
                return part
            for kind in ("documents", "chunks"):
                if part.get(kind):
                    self.files.delete(f"{self.path}/{part[kind]}")
        raise Conflict(f"{ATTEMPTS} writes were lost against others")

    def persist(self, documents: DataFrame, chunks: DataFrame, *, force: bool = False) -> DataFrame | None:
        """Write new versions of the documents whose content is not that of their active version, or of all (force).

        Returns those versions, None if there are none.
        """
        once = Window.partitionBy(KEY).orderBy(F.desc_nulls_last("content_hash"))
        candidates = documents.where(F.col(KEY).isNotNull()).withColumn("_place", F.row_number().over(once)).where("_place = 1").drop("_place")

        def made(parts: list[dict]) -> dict | None:
            old = self._read(parts, "documents")
            fresh = candidates.withColumn("version_number", F.lit(1).cast("long"))
            if old is not None:
                # tombstones count as versions, and what they end may come again
                last = old.groupBy(KEY).agg(F.max("version_number").alias("_last"), F.max_by(F.when(~F.col("deleted"), F.col("content_hash")), "version_number").alias("_hash"))
                same = F.coalesce(F.col("_hash") == F.col("content_hash"), F.lit(False))
                fresh = candidates.join(last, KEY, "left").where(F.lit(force) | ~same)
                fresh = fresh.withColumn("version_number", F.coalesce("_last", F.lit(0)) + 1).drop("_last", "_hash")
            name = uuid.uuid4().hex
            part = {"documents": f"data/{name}/documents", "chunks": f"data/{name}/chunks"}
            numbered = fresh.withColumns({"document_id": document_id(F.col(KEY).cast("string"), F.col("version_number").cast("string")), "deleted": F.lit(False)})
            numbered.write.mode("error").parquet(f"{self.path}/{part['documents']}")
            kept = self.spark.read.parquet(f"{self.path}/{part['documents']}")
            if kept.isEmpty():
                self.files.delete(f"{self.path}/data/{name}")
                return None
            rederived(chunks, kept).write.mode("error").parquet(f"{self.path}/{part['chunks']}")
            return part

        part = self._committed(made)
        return None if part is None else self.spark.read.parquet(f"{self.path}/{part['documents']}").drop("deleted")

    def delete(self, logical_ids: DataFrame) -> None:
        """No version of these documents stays active; their rows stay."""

        def made(parts: list[dict]) -> dict | None:
            old = self._read(parts, "documents")
            if old is None:
                return None
            last = old.join(logical_ids.select(KEY).distinct(), KEY, "left_semi").groupBy(KEY).agg(F.max("version_number").alias("v"), F.max_by("deleted", "version_number").alias("gone"))
            name = f"data/{uuid.uuid4().hex}/documents"
            rows = last.where("not gone").select(KEY, (F.col("v") + 1).alias("version_number"), F.lit(True).alias("deleted"))
            rows.write.mode("error").parquet(f"{self.path}/{name}")
            return None if self.spark.read.parquet(f"{self.path}/{name}").isEmpty() else {"documents": name}

        self._committed(made)

    def compact(self) -> None:
        """Gather what counts in one folder, so that heads stay short; readers of earlier heads are not disturbed."""
        seen, parts = self._head()
        if len(parts) < 2:
            return
        name = uuid.uuid4().hex
        part = {}
        for kind in ("documents", "chunks"):
            rows = self._read(parts, kind)
            if rows is not None:
                part[kind] = f"data/{name}/{kind}"
                rows.write.mode("error").parquet(f"{self.path}/{part[kind]}")
        if not self._swap(seen, [part]):
            self.files.delete(f"{self.path}/data/{name}")
