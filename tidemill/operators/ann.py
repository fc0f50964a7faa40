"""Approximate nearest neighbours: a stored inverted-file index of chunk embeddings.

Building.  Coarse centroids come from k-means over a bounded sample (`sample`
rows, drawn by a hash of the id); every chunk is then put into the list of its
nearest centroid, as a code of one byte for each component of the residual, beside
its vector.  Lists are folders; they are written by ranges of (list, hash of the
id), so that a list with many chunks is many files of many tasks.  How many
lists a search has to probe is found on the sample: the least number with which
its own vectors' neighbours are found at the wanted recall.

Searching.  A query probes the lists of its nearest centroids; only their
folders are read (partition pruning), and of them only the codes.  Each task
keeps the best of each query that probes its lists, so that the codes are never
shuffled; the candidates are then measured exactly.  Queries go out in blocks.

Chunks without a direction (null, zero, non-finite, another dimension than the
index) are not in it; queries without one find nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import dot, norm
from .retrieval import QUERY_BLOCK, SCORES, WIDEST, Best, best, few

SAMPLE = 20_000
LISTS = 1024
ROUNDS = 10
RECALL = 0.97
#: sample vectors whose neighbours tell how many lists to probe
TRIED = 200
#: candidates for each of the k results
REFINE = 4
LEVELS = 127


@dataclass(frozen=True)
class Coarse:
    """centroids [list, component], of length 1; probes: lists that a search reads."""

    centroids: np.ndarray
    probes: int


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _clean(df: DataFrame, vector: str, dim: int | None) -> DataFrame:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(fine, F.lit(False)) & ((F.size(v) == dim) if dim else F.lit(True)))


def fit_coarse(vectors: np.ndarray, lists: int, recall: float = RECALL, k: int = 10, seed: int = 3) -> Coarse:
    """Centroids of unit vectors by k-means, and the probes that reach the recall among them."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(vectors)))
    centroids = vectors[np.sort(rng.choice(len(vectors), lists, replace=False))].copy()
    for _ in range(ROUNDS):
        own = _nearest(vectors, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, vectors)
        full = np.linalg.norm(sums, axis=1) > 0
        centroids[full] = _units(sums[full])
    own = _nearest(vectors, centroids)
    tried = np.sort(rng.choice(len(vectors), min(TRIED, len(vectors)), replace=False))
    near = vectors[tried] @ vectors.T
    near[np.arange(len(tried)), tried] = -np.inf
    top = np.argsort(-near, axis=1)[:, : min(k, max(1, len(vectors) - 1))]
    rank = np.argsort(np.argsort(-(vectors[tried] @ centroids.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[top], axis=1).ravel()) + 1
    return Coarse(centroids, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]))


def _nearest(vectors: np.ndarray, centroids: np.ndarray, step: int = 4096) -> np.ndarray:
    return np.concatenate([(vectors[i : i + step] @ centroids.T).argmax(1) for i in range(0, len(vectors), step)]) if len(vectors) else np.zeros(0, np.int64)


def _encode(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            unit = _units(_matrix(batch.column("embedding"), centroids.shape[1]))
            own = _nearest(unit, centroids)
            rest = unit - centroids[own]
            scale = np.maximum(np.abs(rest).max(axis=1, initial=0), 1e-12) / LEVELS
            codes = np.rint(rest / scale[:, None]).astype(np.int8)
            more = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale.astype(np.float32)), pa.array(own.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "code", "scale", "list"])

    return run


def build_index(chunks: DataFrame, path: str, *, lists: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> Coarse | None:
    """Write the index of chunks (chunk_id, document_id, embedding) to a new path; None without a chunk that has a direction."""
    spark = chunks.sparkSession
    own = _clean(chunks.select("chunk_id", "document_id", "embedding"), "embedding", None)
    dim = own.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if dim is None:
        return None
    own = own.where(F.size("embedding") == dim["dim"])
    share = min(1.0, sample / dim["n"])
    drawn = own.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20)))).select("chunk_id", "embedding").limit(2 * sample).toArrow().sort_by("chunk_id")
    coarse = fit_coarse(_units(_matrix(drawn["embedding"].combine_chunks(), dim["dim"])), lists or min(LISTS, max(1, round(dim["n"] ** 0.5))), recall)
    shared = spark.sparkContext.broadcast(coarse.centroids)
    schema = T.StructType([*own.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("scale", T.FloatType()), T.StructField("list", T.IntegerType())])
    coded = own.mapInArrow(_encode(shared), schema)
    coded.repartitionByRange("list", F.xxhash64("chunk_id")).sortWithinPartitions("list", "chunk_id").write.mode("error").partitionBy("list").parquet(f"{path}/lists")
    rows = [(i, c.tolist(), coarse.probes) for i, c in enumerate(coarse.centroids)]
    spark.createDataFrame(rows, "list int, centroid array<double>, probes int").coalesce(1).write.mode("error").parquet(f"{path}/coarse")
    return coarse


def read_coarse(spark: SparkSession, path: str) -> Coarse:
    """Centroids and probes of a stored index; as many rows as it has lists."""
    rows = sorted(spark.read.parquet(f"{path}/coarse").collect(), key=lambda r: r["list"])
    return Coarse(np.array([r["centroid"] for r in rows]), rows[0]["probes"])


def _scored(shared, k: int, types: dict[str, pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best codes of a task for each query (by its place in the block) that probes their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, asked, centroids = shared.value
        best, ids, seen = Best(len(queries), k), [], 0
        for batch in batches:
            if not len(batch):
                continue
            own = batch.column("list").to_numpy(zero_copy_only=False)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(len(own), -1)
            scale = batch.column("scale").to_numpy(zero_copy_only=False)
            for at in np.unique(own):
                rows = np.flatnonzero(own == at)
                vectors = (code[rows] * scale[rows, None] + centroids[at]).T
                step = max(1, SCORES // len(rows))
                probing = asked.get(int(at), ())
                for i in range(0, len(probing), step):
                    who = probing[i : i + step]
                    near = queries[who] @ vectors
                    row, column = few(near, best.score[who, k - 1], k)
                    best.add(who[row], near[row, column], seen + rows[column])
            ids.append(batch.select(list(types)))
            seen += len(own)
        if ids:
            q, rank = np.nonzero(best.place >= 0)
            chunks = pa.Table.from_batches(ids).take(pa.array(best.place[q, rank]))
            columns = [pa.array(q.astype(np.int32)), pa.array(best.score[q, rank]), *(pa.concat_arrays(chunks[c].chunks) if chunks[c].num_chunks else pa.array([], types[c]) for c in types)]
            yield pa.RecordBatch.from_arrays(columns, names=["place", "near", *types])

    return run


def ann(queries: DataFrame, path: str, k: int = 10, *, probes: int | None = None, exact: bool = True) -> DataFrame:
    """(query_id, chunk_id, document_id, score, dense_rank) like `dense`, from the index at a path.

    queries: query_id, vector.  probes: lists to read for a query, as calibrated when left out.  Not exact: scores are
    those of the codes, and no vector is read.
    """
    spark = queries.sparkSession
    coarse = read_coarse(spark, path)
    dim = coarse.centroids.shape[1]
    own = _clean(queries.select("query_id", "vector"), "vector", dim)
    index = spark.read.parquet(f"{path}/lists")
    blocks = max(1, -(-own.count() // (QUERY_BLOCK * max(1, WIDEST // dim))))
    kinds = {f.name: f.dataType for f in index.schema.fields}
    types = {c: to_arrow_type(kinds[c]) for c in ("chunk_id", "document_id", "list")}
    out = None
    for block in range(blocks):
        part = (own if blocks == 1 else own.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).toArrow()
        vectors = _units(_matrix(part["vector"].combine_chunks(), dim)) if part.num_rows else np.zeros((0, dim))
        order = np.argsort(-(vectors @ coarse.centroids.T), axis=1, kind="stable")[:, : probes or coarse.probes]
        asked = {int(at): np.flatnonzero((order == at).any(axis=1)) for at in np.unique(order)}
        shared = spark.sparkContext.broadcast((vectors, asked, coarse.centroids))
        ids = spark.createDataFrame(pa.table({"place": pa.array(np.arange(part.num_rows, dtype=np.int32)), "query_id": part["query_id"], "vector": part["vector"]}))
        probed = index.where(F.col("list").isin(*asked))
        schema = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("near", T.DoubleType()), *(T.StructField(c, kinds[c]) for c in types)])
        found = probed.select("chunk_id", "document_id", "list", "code", "scale").mapInArrow(_scored(shared, REFINE * k if exact else k, types), schema)
        found = found.withColumnRenamed("place", "query_id")
        found = best(found, "near", "near_rank", REFINE * k if exact else k).withColumnRenamed("query_id", "place")
        if exact:
            # candidates are REFINE * k for each query of the block; their queries' vectors come apart from them
            measured = probed.select("list", "chunk_id", "embedding").join(found.select("list", "chunk_id", "document_id", "place"), ["list", "chunk_id"])
            found = measured.join(F.broadcast(ids), "place").withColumn("score", F.try_divide(dot("vector", "embedding"), norm("vector") * norm("embedding")))
        else:
            found = found.join(F.broadcast(ids), "place").withColumn("score", F.col("near"))
        found = found.select("query_id", "chunk_id", "document_id", "score")
        out = found if out is None else out.union(found)
    return best(out, "score", "dense_rank", k)


def recall_against(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of each query's exact results that were found."""
    hits = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
