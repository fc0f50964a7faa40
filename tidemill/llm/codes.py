"""Product codes of vectors: each part of a vector becomes the number of an entry of that part's codebook.

Components become integers, floor(scale * x), and a vector is cut into equal
parts.  A part's codebook starts as that part of the vectors with the smallest
ids and is improved by Lloyd's rounds over all vectors, in integers, so that the
result does not depend on how the rows are partitioned.

Yinyang Lloyd (Ding et al., 2015): the entries of a codebook are clustered into
groups.  A row keeps, for each part, the number of its entry and one lower bound
for each group on the distance to the group's other entries.  When the entries
have moved, a bound is lowered by the largest move of its group, and the group
is scanned only if its bound is not above the distance to the best entry known;
that distance and those of scanned entries are exact integers, so that ties are
decided among integers (lower number first).  Bounds are compared with a margin
for their rounding.

One round is one pass that reads a staged table and writes the next one: rows
with new bounds and, as the last row of each task, the task's sums.  Those are
added up in 64 groups before the driver gets them, so that it gets 64 rows.
Nothing is grouped by entry or by label before it is summed, and a lost
executor costs the tasks of one pass.

Nulls, empties and widths: a vector that is null, empty or has null or
non-finite components is left out, as is one of a width that the parts do not
divide or another width than that of the smallest id left, or with a component of
2^26 or more after scaling (squares of such leave 64 bits).  Rows of a null id
are encoded, but come last as seeds; rows that repeat an id are rows of their
own, seeds among equal ids go by their components.  With fewer rows than entries
the codebooks have as many entries as rows.  An empty table gives no rows.
Columns of other names are not read and can have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .storage import drop, staged

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: entries of a group, on average
GROUP_ENTRIES = 4
#: scaled components have to be below this
LIMIT = 1 << 26
#: rows of sums that the driver adds up
SUM_ROWS = 64
#: bounds have to be clear of a distance by this part of it
MARGIN = 1e-9


@dataclass(frozen=True)
class Codebooks:
    """entries: integers [part, entry, position]; groups: the group of each entry [part, entry]."""

    entries: np.ndarray
    groups: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def grouped_entries(entries: np.ndarray, size: int = GROUP_ENTRIES, rounds: int = 5) -> np.ndarray:
    """The group of each entry, by a few rounds of k-means among the entries of a part."""
    parts, k, _ = entries.shape
    n = max(1, k // size)
    out = np.zeros((parts, k), np.int64)
    for p, own in enumerate(entries.astype(np.float64)):
        centres = own[np.linspace(0, k - 1, n).astype(int)].copy()
        for _ in range(rounds):
            out[p] = ((own[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
            for g in range(n):
                if (out[p] == g).any():
                    centres[g] = own[out[p] == g].mean(0)
    return out


def reassigned(x: np.ndarray, code: np.ndarray, low: np.ndarray, entries: np.ndarray, groups: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code, low, exact squared distances, entries scanned) of some vectors' parts of one position.

    x: [row, position]; low: [row, group]; entries: [entry, position]; moved: the largest move in each group.
    A new row has a code of any entry and bounds of -inf.
    """
    before = code
    own = ((x - entries[before]) ** 2).sum(1)
    low = low - moved
    best, code, scanned = own.copy(), before.copy(), 0
    looked: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for g in range(low.shape[1]):
        members = np.flatnonzero(groups == g)
        rows = np.flatnonzero(low[:, g] * (1 - MARGIN) <= np.sqrt(best) * (1 + MARGIN)) if len(members) else np.zeros(0, np.int64)
        if not len(rows):
            continue
        scanned += len(rows) * len(members)
        far = ((x[rows, None, :] - entries[members]) ** 2).sum(-1)
        order = far.argsort(1, kind="stable")
        first = far[np.arange(len(rows)), order[:, 0]]
        second = far[np.arange(len(rows)), order[:, 1]].astype(np.float64) if len(members) > 1 else np.full(len(rows), np.inf)
        nearest = members[order[:, 0]]
        better = (first < best[rows]) | ((first == best[rows]) & (nearest < code[rows]))
        best[rows[better]], code[rows[better]] = first[better], nearest[better]
        looked.append((g, rows, nearest, first, second))
    left = np.flatnonzero(code != before)  # the old entry now counts in its group's bound
    at = groups[before[left]]
    low[left, at] = np.minimum(low[left, at], np.sqrt(own[left]))
    for g, rows, nearest, first, second in looked:
        low[rows, g] = np.where(code[rows] == nearest, np.sqrt(second), np.sqrt(first))
    return code, low, best, scanned


def _step(books: Codebooks, moved: np.ndarray, first: bool, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass: rows with codes and bounds for these codebooks, then a row with the task's sums."""
    parts, k, width = books.entries.shape
    n_groups = int(books.groups.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, scanned = np.zeros((parts, k, width + 1), np.int64), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("ints").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts, width)
            if first:
                code, low = np.zeros((n, parts), np.int64), np.full((n, parts, n_groups), -np.inf)
            else:
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                low = batch.column("low").flatten().to_numpy(zero_copy_only=False).reshape(n, parts, n_groups)
            low, error = low.copy(), np.zeros(n, np.int64)
            for p in range(parts):
                code[:, p], low[:, p], off, seen = reassigned(x[:, p], code[:, p], low[:, p], books.entries[p], books.groups[p], moved[p])
                error += off
                scanned += seen
                np.add.at(sums[p, :, :width], code[:, p], x[:, p])
                sums[p, :, width] += np.bincount(code[:, p], minlength=k)
            codes = code.astype(np.uint8)
            own = {
                "code": pa.array([row.tobytes() for row in codes], pa.binary()),
                "low": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * parts * n_groups, pa.int32()), pa.array(low.ravel())),
                "error": pa.array(error),
                "sums": pa.nulls(n, pa.binary()),
                "task": pa.nulls(n, pa.int32()),
                "scanned": pa.nulls(n, pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([(own[f.name] if f.name in own else batch.column(f.name)).cast(f.type) for f in schema], schema=schema)
        if sums[:, :, width].any():
            last = {"sums": sums.tobytes(), "task": TaskContext.get().partitionId(), "scanned": scanned}
            yield pa.RecordBatch.from_arrays([pa.array([last.get(f.name)], f.type) for f in schema], schema=schema)

    return run


def _added(shape: tuple[int, ...]) -> Callable[[pa.Table], pa.Table]:
    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(shape, np.int64)
        for blob in table.column("sums").to_pylist():
            total += np.frombuffer(blob, np.int64).reshape(shape)
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary()), "scanned": pa.array([sum(table.column("scanned").to_pylist())], pa.int64())})

    return add


def _totals(state: DataFrame, shape: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """Sums and counts by entry, and the entries scanned, of one pass."""
    rows = state.where(F.col("sums").isNotNull()).select("sums", "scanned", (F.col("task") % SUM_ROWS).alias("bucket"))
    got = rows.groupBy("bucket").applyInArrow(_added(shape), "sums binary, scanned long").collect()
    return sum((np.frombuffer(r["sums"], np.int64).reshape(shape) for r in got), np.zeros(shape, np.int64)), sum(r["scanned"] for r in got)


def integers(df: DataFrame, *, parts: int = PARTS, scale: int = SCALE, vector_col: str = "embedding", id_col: str = "vec_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, ints) of the rows that can be encoded but for their width."""
    v = F.col(vector_col)
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LIMIT))
    return df.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).alias("__id"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(keep)), ints.alias("ints")
    )


def compressed(
    df: DataFrame,
    *,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    keep: tuple[str, ...] = (),
    scans: list[int] | None = None,
) -> tuple[DataFrame, Codebooks | None]:
    """(id, kept columns, code binary, error long) of each encoded row, and the codebooks (None without rows).

    A code has a byte for each part; error is the squared distance to what the code stands for.
    `scans` gets the number of entries that each pass looked at.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code's byte holds one of 1 to 256 entries")
    names = [id_col, *keep]
    rows = integers(df, parts=parts, scale=scale, id_col=id_col, vector_col=vector_col, keep=keep)
    order = [F.col("__id").asc_nulls_last(), F.col("ints")]
    smallest = lambda rows: [r[0] for r in rows.orderBy(*order).limit(entries).select("ints").collect()]
    top = smallest(rows)
    if not top:
        empty = rows.select("*", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")).drop("ints").limit(0)
        return empty.toDF(*names, "code", "error"), None
    rows = rows.where(F.size("ints") == len(top[0]))
    seeds = np.array(top if len({len(v) for v in top}) == 1 else smallest(rows), np.int64)
    width = len(top[0]) // parts
    books = seeds.reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    groups = grouped_entries(books)
    n_groups = int(groups.max()) + 1
    moved = np.zeros((parts, n_groups))
    state, shape = rows, (parts, len(seeds), width + 1)
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string("code binary, low array<double>, error long, sums binary, task int, scanned long").fields])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    arrow = to_arrow_schema(schema)
    for r in range(rounds + 1):
        live = state if r == 0 else state.where(F.col("sums").isNull()).select(*rows.columns, "code", "low")
        after = staged(live.mapInArrow(_step(Codebooks(books, groups), moved, r == 0, arrow), schema), "codes")
        if r:
            drop(df.sparkSession, state)
        state = after
        if r == rounds:
            if scans is not None:
                scans.append(_totals(state, shape)[1])
            break
        total, seen = _totals(state, shape)
        if scans is not None:
            scans.append(seen)
        count = total[:, :, width]
        new = np.where(count[:, :, None] > 0, np.floor_divide(total[:, :, :width], np.maximum(count, 1)[:, :, None]), books)
        shift = np.sqrt(((new - books) ** 2).sum(-1).astype(np.float64))
        moved = np.array([[shift[p][groups[p] == g].max(initial=0.0) for g in range(n_groups)] for p in range(parts)])
        books = new
    kept = [c for c in rows.columns if c != "ints"]
    out = state.where(F.col("sums").isNull()).select(*kept, "code", "error").toDF(*names, "code", "error")
    return out, Codebooks(books, groups)


def reconstructed(df: DataFrame, books: Codebooks, *, scale: int = SCALE, code_col: str = "code", out_col: str = "vector") -> DataFrame:
    """df with the vector that each code stands for (its entries' cells' middles); null for a null code."""
    values = (books.entries + 0.5) / scale
    parts = len(values)

    @F.arrow_udf("array<double>")
    def decode(codes: pa.Array) -> pa.Array:
        return pa.array([None if c is None else np.concatenate([values[p][c[p]] for p in range(parts)]) for c in codes.to_pylist()], pa.list_(pa.float64()))

    return df.withColumn(out_col, decode(F.col(code_col)))


def vector_codes(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **how) -> DataFrame:
    """(id, code in hex, error, label_error, codebooks_sha256): label_error sums error over equal labels, null ones together."""
    codes, books = compressed(df, id_col=id_col, vector_col=vector_col, keep=(label_col,), **how)
    codes = codes.toDF("__id", "__label", "code", "error")
    by_label = codes.groupBy("__label").agg(F.sum("error").alias("label_error")).withColumnRenamed("__label", "__of")
    joined = codes.join(by_label, codes["__label"].eqNullSafe(by_label["__of"]), "left")
    digest = F.lit(books.digest() if books else hashlib.sha256(b"").hexdigest())
    return joined.select(F.col("__id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))
