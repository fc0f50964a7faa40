"""Near-duplicate embeddings with a forest of random-projection trees.

Each tree splits the vectors recursively by their projection on a random
direction.  Of several directions and places between the 30th and 70th
percentile the split is taken that the fewest vectors lie near; vectors within
the margin go to both sides (spill).  A linked pair (cosine >= c) differs by
about sqrt((2 - 2c) / dimensions) on a random direction, which sets the margin.
A group that no split divides well is left whole.  All pairs within a leaf are
compared, exactly, in double precision; pairs linked in any tree are united.

The upper part of each tree is fitted on a bounded sample of the vectors
(`sample`, by a hash of the id; at most SAMPLE_BYTES) and routes every vector to
cells of about `cell_rows`; the lower part is grown by the task that has the
cell's vectors.  A vector's leaves are then listed beside it, and a pair counts in
the first of its common leaves only: link counts are sums per vector, no pair is
ever written.  A cell that the sample could not divide and that is larger than
WIDE cells is a leaf as it is, and a leaf of more than WIDE * leaf_rows vectors is
cut into blocks, whose pairs are compared by tasks of their own: no task holds a
dense cluster whole.  Equal vectors are collapsed first and counted by their
number.  Vectors travel in the precision they came in.

A vector that is null, zero, empty, or holds null or non-finite components links
with nothing, nor do vectors of different dimensions.  A null vec_id links with
nothing and has a null component.  Each row is a vector of its own: where a vec_id
occurs with different vectors, each row has its own links, and its component is
the smallest vec_id that they lead to.  An empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import staged

COSINE = 0.95
TREES = 5
LEAF_ROWS = 256
CELL_ROWS = 8192
SAMPLE = 20_000
SAMPLE_BYTES = 64 << 20
#: times its intended size at which a leaf or cell is cut into blocks
WIDE = 8
DIRECTIONS = 4
#: a split that leaves more than this share of a node's vectors on one side is no split
WORST = 0.8


def _unit(v: np.ndarray) -> np.ndarray | None:
    v = v.astype(np.float64)
    biggest = np.abs(v).max() if len(v) else 0.0
    if not (np.isfinite(biggest) and biggest > 0):
        return None
    v = v / biggest
    return v / np.linalg.norm(v) + 0.0


def _prints(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, fingerprint of the unit vector and components as bytes (null where a vector cannot link)."""
    for part in parts:
        prints, raw = [], []
        for x in part.column(1):
            v = x.values.to_numpy(zero_copy_only=False) if x.is_valid and x.values.null_count == 0 else np.zeros(0)
            unit = _unit(v)
            prints.append(None if unit is None else hashlib.blake2b(unit.tobytes(), digest_size=16).digest())
            raw.append(None if unit is None else v.tobytes())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "print", "raw"])


def _matrix(raw, kind: str) -> np.ndarray:
    """Unit vectors in double precision."""
    rows = [np.frombuffer(u.as_buffer(), kind) for u in raw]
    if not rows:
        return np.zeros((0, 1))
    x = np.stack(rows).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def margin_of(cosine: float, dimensions: int) -> float:
    return 0.5 * np.sqrt(max(0.0, 2 - 2 * cosine) / dimensions)


def split(x: np.ndarray, margin: float, rng: np.random.Generator) -> tuple[np.ndarray, float] | None:
    """Direction and place of the split with the fewest vectors in its margin; None if none divides x."""
    best, out = len(x) + 1, None
    for _ in range(DIRECTIONS):
        direction = rng.normal(size=x.shape[1])
        direction /= np.linalg.norm(direction)
        p = np.sort(x @ direction)
        for q in np.linspace(0.3, 0.7, 17):
            at = p[int(q * (len(p) - 1))]
            left, right = np.searchsorted(p, at + margin, side="right"), len(p) - np.searchsorted(p, at - margin, side="left")
            near = left + right - len(p)
            if near < best and max(left, right) <= WORST * len(p):
                best, out = near, (direction, float(at))
    return out


def _seed(*of) -> np.random.Generator:
    return np.random.default_rng(list(hashlib.blake2b(repr(of).encode(), digest_size=16).digest()))


def leaves(x: np.ndarray, rows: int, margin: float, name: tuple) -> Iterator[tuple[tuple, np.ndarray]]:
    """(name, members) of the leaves under a node."""
    todo = [(name, np.arange(len(x)))]
    while todo:
        name, own = todo.pop()
        found = split(x[own], margin, _seed(*name)) if len(own) > rows else None
        if found is None:
            yield name, own
            continue
        p = x[own] @ found[0] - found[1]
        todo += [((*name, 0), own[p <= margin]), ((*name, 1), own[p >= -margin])]


class Tree:
    """The upper part of a tree, fitted on a sample."""

    def __init__(self, sample: np.ndarray, rows: int, margin: float, name: tuple):
        self.margin, self.name = margin, name
        self.nodes: dict[tuple, tuple[np.ndarray, float]] = {}
        todo = [(name, sample)]
        while todo:
            at, x = todo.pop()
            found = split(x, margin, _seed("upper", *at)) if len(x) > rows else None
            if found is not None:
                self.nodes[at] = found
                p = x @ found[0] - found[1]
                todo += [((*at, 0), x[p <= margin]), ((*at, 1), x[p >= -margin])]

    def cells(self, x: np.ndarray) -> Iterator[tuple[tuple, np.ndarray]]:
        todo = [(self.name, np.arange(len(x)))]
        while todo:
            at, own = todo.pop()
            if at not in self.nodes:
                if len(own):
                    yield at, own
                continue
            direction, place = self.nodes[at]
            p = x[own] @ direction - place
            todo += [((*at, 0), own[p <= self.margin]), ((*at, 1), own[p >= -self.margin])]


def _number(name: tuple) -> int:
    return int.from_bytes(hashlib.blake2b(repr(name).encode(), digest_size=8).digest(), "little", signed=True)


def _routed(shared, kind: str, carry: bool):
    """(cell, rep, components) of each vector and cell; without carry only the cells."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            widths = np.array([u.as_buffer().size for u in part.column(1)], np.int64) if part.num_rows else np.zeros(0, np.int64)
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                own = part.take(pa.array(rows))
                x = _matrix(own.column(1), kind)
                for tree in shared.value[int(width)]:
                    for name, at in tree.cells(x):
                        cell = pa.array(np.full(len(at), _number(name)))
                        if not carry:
                            yield pa.RecordBatch.from_arrays([cell, own.column(0).take(pa.array(at))], names=["leaf", "rep"])
                            continue
                        taken = own.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([cell, taken.column(0), taken.column(1)], names=["cell", "rep", "raw"])

    return run


def _leaves_of_cell(leaf_rows: int, cosine: float, kind: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        x = _matrix(table["raw"], kind)
        reps, cell = table["rep"].to_numpy(), table["cell"][0].as_py()
        names, members = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for name, own in leaves(x, leaf_rows, margin_of(cosine, x.shape[1]), (cell,)):
            names.append(np.full(len(own), _number(name)))
            members.append(reps[own])
        return pa.table({"leaf": np.concatenate(names), "rep": np.concatenate(members)})

    return run


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that both rows of two sorted, padded lists have."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for k in range(a.shape[1]):
        has = (b == a[:, k : k + 1]).any(axis=1)
        np.minimum(out, np.where(has, a[:, k], out), out=out)
    return out


def _compare(cosine: float, kind: str):
    """Links of a leaf's members, or of those between two blocks of it (numbers `one` and `two`; a member's is `block`)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        x = _matrix(table["raw"], kind)
        leaf, one, two = (table[c][0].as_py() for c in ("leaf", "one", "two"))
        reps, copies, block = table["rep"].to_numpy(), table["copies"].to_numpy(), table["block"].to_numpy()
        lists = table["leaves"].combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        own = np.full((len(sizes), sizes.max()), np.iinfo(np.int64).max)
        own[np.arange(own.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
        links, label = np.zeros(len(x), np.int64), np.arange(len(x))
        for at in range(0, len(x), 512):
            i, j = np.nonzero(x[at : at + 512] @ x[at:].T >= cosine)
            i, j = i + at, j + at
            wanted = (i < j) & ((one == two) | (block[i] != block[j]))
            i, j = i[wanted], j[wanted]
            _unite(label, i, j)
            for k in range(0, len(i), 50_000):
                a, b = i[k : k + 50_000], j[k : k + 50_000]
                first = _first_common(own[a], own[b]) == leaf
                links += np.bincount(a[first], weights=copies[b[first]], minlength=len(x)).astype(np.int64)
                links += np.bincount(b[first], weights=copies[a[first]], minlength=len(x)).astype(np.int64)
        used = np.flatnonzero((links > 0) | (label != np.arange(len(x))))
        return pa.table({"rep": reps[used], "links": links[used], "to": reps[label[used]]})

    return run


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Lower the labels of linked members until both ends of each link agree."""
    while True:
        least = np.minimum(label[i], label[j])
        if (label[i] == least).all() and (label[j] == least).all():
            return
        for end in (label[i], label[j], i, j):
            np.minimum.at(label, end, least)
        label[:] = label[label]


def linked_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    cell_rows: int = CELL_ROWS,
    sample: int = SAMPLE,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors."""
    spark = vectors.sparkSession
    kind, single = ("<f4", "array<float>") if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else ("<f8", "array<double>")
    item = int(kind[-1])
    columns = [F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(single).alias("v")]
    rows = staged(vectors.select(*columns).mapInArrow(_prints, "vec_id long, print binary, raw binary"), "vectors")
    reps = rows.where("print is not null and vec_id is not null").groupBy("print").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
    reps = staged(reps.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    total, widest = reps.agg(F.count("*"), F.coalesce(F.max(F.length("raw")), F.lit(item))).first()
    sample = min(sample, max(1, SAMPLE_BYTES // (widest // item * 8)))
    part = F.pmod(F.xxhash64("least", "print", F.lit(19)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(total, 1))) + 1
    drawn = reps.where(part).select("print", "raw").toArrow().sort_by("print")["raw"]
    widths = [r[0] for r in reps.select(F.length("raw")).distinct().collect()]
    forest = {}
    for width in widths:
        x = _matrix([u for u in drawn if u.as_buffer().size == width], kind)
        own = max(64, int(cell_rows * len(drawn) / max(total, 1)))
        forest[width] = [Tree(x, own, margin_of(cosine, width // item), (width, t)) for t in range(trees)]
    shared = spark.sparkContext.broadcast(forest)
    if total > WIDE * cell_rows:  # else no cell is that large
        cells = staged(reps.select("rep", "raw").mapInArrow(_routed(shared, kind, False), "leaf long, rep long"), "cells")
        wide = staged(cells.groupBy("leaf").agg(F.count("*").alias("n")).where(f"n > {WIDE * cell_rows}").select("leaf"), "wide")
        routed = reps.select("rep", "raw").mapInArrow(_routed(shared, kind, True), "cell long, rep long, raw binary")
        narrow = routed.join(wide.withColumnRenamed("leaf", "cell"), "cell", "left_anti")
        found = narrow.groupBy("cell").applyInArrow(_leaves_of_cell(leaf_rows, cosine, kind), "leaf long, rep long").union(cells.join(wide, "leaf", "left_semi"))
    else:
        routed = reps.select("rep", "raw").mapInArrow(_routed(shared, kind, True), "cell long, rep long, raw binary")
        found = routed.groupBy("cell").applyInArrow(_leaves_of_cell(leaf_rows, cosine, kind), "leaf long, rep long")
    found = staged(found, "leaves")
    most = WIDE * leaf_rows
    blocks = staged(found.groupBy("leaf").agg(F.count("*").alias("n")).where(f"n > {most}").select("leaf", F.ceil(F.col("n") / (most // 2)).cast("int").alias("blocks")), "blocks")
    listed = found.groupBy("rep").agg(F.array_sort(F.collect_set("leaf")).alias("leaves")).join(reps.select("rep", "copies", "raw"), "rep")
    each = listed.select("rep", "copies", "raw", "leaves", F.explode("leaves").alias("leaf"))
    if blocks.isEmpty():
        each = each.withColumns({c: F.lit(0) for c in ("block", "one", "two")})
    else:
        each = each.join(blocks, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        each = each.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(23)), F.col("blocks")).cast("int"))
        each = each.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        each = each.withColumns({"one": F.least("block", "with"), "two": F.greatest("block", "with")}).drop("blocks", "with")
    compared = each.groupBy("leaf", "one", "two").applyInArrow(_compare(cosine, kind), "rep long, links long, to long")
    compared = staged(compared, "links")
    groups = components(compared.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    counted = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    named = reps.select("print", "rep", "least", "copies").join(counted, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    named = staged(
        named.select("print", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "named"
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("print", "links", "component_id")
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("print")).alias("print")).join(named, "print", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
