import pytest
from pyspark.sql import functions as F

from tidemill.operators import versions
from tidemill.sources.shared import shared_path

DOCS = "logical_document_id string, content_hash string, title string"
CHUNKS = "logical_document_id string, level int, chunk_index int, parent_index int, heading_path array<string>, first_block string, last_block string, content_hash string"


def docs(spark, *rows):
    return spark.createDataFrame([(*r, f"t{r[1]}") for r in rows], DOCS)


def chunks(spark, *logical):
    rows = [r for k in logical for r in ((k, 0, 0, None, ["a"], "b0", "b9", "p"), (k, 1, 0, 0, ["a"], "b0", "b4", "c0"), (k, 1, 1, 0, ["a"], "b5", "b9", "c1"))]
    return spark.createDataFrame(rows, CHUNKS)


@pytest.fixture
def store(spark):
    return versions.VersionStore(spark, shared_path(spark, "versions"))


def seen(store):
    return {(r["logical_document_id"], r["version_number"]): r["status"] for r in store.documents().collect()}


def test_versions_and_chunks(spark, store):
    assert store.documents() is None and store.chunks() is None
    store.persist(docs(spark, ("x", "1"), ("y", "1"), (None, "1")), chunks(spark, "x", "y", "lost"))
    assert seen(store) == {("x", 1): "active", ("y", 1): "active"}
    assert store.persist(docs(spark, ("x", "1")), chunks(spark, "x")) is None
    new = store.persist(docs(spark, ("x", "2"), ("y", "1"), ("z", "1"), ("z", "3")), chunks(spark, "x", "y", "z"))
    assert {(r["logical_document_id"], r["version_number"], r["content_hash"]) for r in new.collect()} == {("x", 2, "2"), ("z", 1, "3")}
    assert seen(store) == {("x", 1): "archived", ("x", 2): "active", ("y", 1): "active", ("z", 1): "active"}
    every = store.chunks(active=False)
    assert every.count() == every.select("chunk_id").distinct().count() == 12
    assert store.chunks().count() == 9
    # each child's parent is a chunk of its own version
    of = every.where("level = 1").join(every.where("level = 0").select(F.col("chunk_id").alias("parent_id"), F.col("document_id").alias("own")), "parent_id")
    assert of.where("document_id = own").count() == 8
    assert store.persist(docs(spark, ("y", "1")), chunks(spark, "y"), force=True).first()["version_number"] == 2
    before = store.documents(at=1)
    store.compact()
    assert {(r[0], r[1]) for r in before.select("logical_document_id", "version_number").collect()} == {("x", 1), ("y", 1)}
    assert store.chunks(active=False).count() == 15 and len(store._head()[1]) == 1


def test_deleted_documents_come_back_as_new_versions(spark, store):
    store.persist(docs(spark, ("x", "1"), ("y", "1")), chunks(spark, "x", "y"))
    store.delete(docs(spark, ("x", "1"), ("nobody", "1")))
    store.delete(docs(spark, ("x", "1")))
    assert seen(store) == {("x", 1): "deleted", ("y", 1): "active"}
    assert {r[0] for r in store.chunks().select("logical_document_id").distinct().collect()} == {"y"}
    store.persist(docs(spark, ("x", "1")), chunks(spark, "x"))
    assert seen(store) == {("x", 1): "deleted", ("x", 3): "active", ("y", 1): "active"}


def test_a_write_that_fails_is_not_seen(spark, store, monkeypatch):
    store.persist(docs(spark, ("x", "1")), chunks(spark, "x"))
    broken = chunks(spark, "x").withColumn("content_hash", F.raise_error(F.lit("disk full")).cast("string"))
    with pytest.raises(Exception, match="disk full"):
        store.persist(docs(spark, ("x", "2")), broken)
    assert seen(store) == {("x", 1): "active"} and store.chunks().count() == 3
    monkeypatch.setattr(versions.VersionStore, "_swap", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        store.persist(docs(spark, ("x", "2")), chunks(spark, "x"))
    monkeypatch.undo()
    assert seen(store) == {("x", 1): "active"}
    store.persist(docs(spark, ("x", "2")), chunks(spark, "x"))
    assert seen(store) == {("x", 1): "archived", ("x", 2): "active"}


def test_writers_that_start_from_the_same_head(spark, store):
    """The slower one numbers its version anew and derives its ids again."""
    store.persist(docs(spark, ("x", "1")), chunks(spark, "x"))
    other, swap, tries = versions.VersionStore(spark, store.path), store._swap, []

    def late(seen, parts):
        if not tries:
            other.persist(docs(spark, ("x", "2")), chunks(spark, "x"))
        tries.append(seen)
        return swap(seen, parts)

    store._swap = late
    store.persist(docs(spark, ("x", "3")), chunks(spark, "x"))
    assert tries == [1, 2]
    assert seen(store) == {("x", 1): "archived", ("x", 2): "archived", ("x", 3): "active"}
    every = store.chunks(active=False)
    assert every.count() == every.select("chunk_id").distinct().count() == 9
    store._swap = lambda *a: False
    with pytest.raises(versions.Conflict):
        store.persist(docs(spark, ("x", "4")), chunks(spark, "x"))
    assert ("x", 4) not in seen(other)
