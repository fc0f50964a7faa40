import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import ann, retrieval
from tidemill.sources.shared import shared_path


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 24))
    rows = [(f"c{i}", f"d{i % 50}", (centres[i % 30 if i % 3 else 0] + 0.3 * rng.normal(size=24)).tolist()) for i in range(1500)]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, embedding array<float>").repartition(4).cache()


def asked(chunks):
    return chunks.where(F.substring("chunk_id", 2, 9).cast("int") % 20 == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))


def test_finds_what_the_exact_search_finds(spark, chunks):
    path = shared_path(spark, "test")
    coarse = ann.build_index(chunks, path)
    assert coarse.probes < len(coarse.centroids)
    assert spark.read.parquet(f"{path}/lists").count() == 1500
    found, exact = ann.ann(asked(chunks), path), retrieval.dense(asked(chunks), chunks)
    assert found.columns == exact.columns
    assert ann.recall_against(found, exact).agg(F.avg("recall")).first()[0] >= 0.95
    # scores are exact, and the query's own vector comes first
    both = found.join(exact.select("query_id", "chunk_id", F.col("score").alias("want")), ["query_id", "chunk_id"])
    assert both.where(F.abs(F.col("score") - F.col("want")) > 1e-9).count() == 0
    assert found.where("dense_rank = 1 and query_id <> chunk_id").count() == 0
    codes = ann.ann(asked(chunks), path, exact=False)
    assert ann.recall_against(codes, exact).agg(F.avg("recall")).first()[0] >= 0.85
    everything = ann.ann(asked(chunks), path, probes=len(coarse.centroids))
    assert ann.recall_against(everything, exact).agg(F.min("recall")).first()[0] == 1


def test_reads_probed_folders_and_codes_only(spark, chunks):
    path = shared_path(spark, "test")
    ann.build_index(chunks, path)
    one = asked(chunks).limit(1)
    plan = ann.ann(one, path, probes=1, exact=False)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "code" in line]
    assert scans and all("list#" in line.split("PartitionFilters: ")[1].split("]")[0] for line in scans)
    assert all("embedding" not in line.split("ReadSchema")[1] for line in scans)


def test_blocks_of_queries(spark, chunks, monkeypatch):
    path = shared_path(spark, "test")
    ann.build_index(chunks, path, lists=8)
    whole = {tuple(r) for r in ann.ann(asked(chunks), path, 5).collect()}
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    assert {tuple(r) for r in ann.ann(asked(chunks), path, 5).collect()} == whole


def test_awkward_vectors(spark):
    rows = [("a", "d", [1.0, 0.0]), ("b", "d", [0.0, 2.0]), ("z", "d", [0.0, 0.0]), ("n", "d", None), ("i", "d", [1.0, float("inf")]), ("w", "d", [1.0] * 3), ("h", "d", [None, 1.0]), ("e", "d", [])]
    df = spark.createDataFrame(rows, "chunk_id string, document_id string, embedding array<float>")
    path = shared_path(spark, "test")
    ann.build_index(df, path)
    q = spark.createDataFrame([(1, [2.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [1.0])], "query_id long, vector array<float>")
    got = [(r["query_id"], r["chunk_id"], r["dense_rank"]) for r in ann.ann(q, path, probes=2).orderBy("query_id", "dense_rank").collect()]
    assert got == [(1, "a", 1), (1, "b", 2)]
    assert ann.ann(q.where("query_id > 1"), path).count() == 0
    assert ann.build_index(df.where("chunk_id in ('z', 'n')"), shared_path(spark, "test")) is None


def test_narrow_vectors_are_searched_in_one_block(spark, chunks, monkeypatch):
    """A block is as many bytes whatever the width: 75 queries of 24 components are no four searches of 20."""
    path = shared_path(spark, "test")
    ann.build_index(chunks, path, lists=8)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 20)
    plan = ann.ann(asked(chunks), path)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation") == 1
