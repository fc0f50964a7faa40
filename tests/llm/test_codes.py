import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import codes
from tidemill.llm.queries import op13_vector_codes


def lloyd(x, parts=8, entries=16, rounds=6):
    """Plain integer Lloyd over rows in the order of their ids: (codes, errors, codebooks)."""
    n, width = len(x), x.shape[1] // parts
    cut = x.reshape(n, parts, width)
    books = cut[:entries].transpose(1, 0, 2).copy()

    def nearest():
        far = ((cut[:, :, None, :] - books[None]) ** 2).sum(-1)
        return far.argmin(-1), far.min(-1).sum(1)

    for _ in range(rounds):
        code, _ = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = cut[code[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(0) // len(own)
    return (*nearest(), books)


def made(spark, rows, schema="vec_id long, embedding array<float>, label int"):
    return spark.createDataFrame(rows, schema)


def check(spark, df, x, ids, labels, **how):
    scans = []
    got = {r["vec_id"]: r for r in codes.vector_codes(df, scans=scans, **how).collect()}
    want, errors, books = lloyd(x, **how)
    assert set(got) == set(ids)
    by_label = {}
    for label, e in zip(labels, errors):
        by_label[label] = by_label.get(label, 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    for k, i in enumerate(ids):
        assert got[i]["code"] == "".join(f"{c:02x}" for c in want[k])
        assert got[i]["error"] == errors[k]
        assert got[i]["label_error"] == by_label[labels[k]]
        assert got[i]["codebooks_sha256"] == digest
    return scans


@pytest.mark.parametrize("kind", ["clusters", "ties", "copies"])
def test_equals_plain_lloyd(spark, kind):
    rng = np.random.default_rng(5)
    n = 700
    if kind == "clusters":
        v = rng.normal(size=(12, 32))[rng.integers(0, 12, n)] + rng.normal(size=(n, 32)) * 0.05
    elif kind == "ties":
        v = rng.integers(-2, 3, (n, 32)) / 4096
    else:
        v = np.where(rng.random((n, 1)) < 0.4, 0.25, rng.normal(size=(n, 32)))
    v = v.astype(np.float32)
    labels = [None if i % 3 == 0 else i % 4 for i in range(n)]
    df = made(spark, [(i, row.tolist(), l) for i, (row, l) in enumerate(zip(v, labels))]).repartition(5)
    scans = check(spark, df, np.floor(4096 * v.astype(np.float64)).astype(np.int64), range(n), labels)
    assert scans[0] == n * 8 * 16
    if kind == "clusters":  # bounds leave out most entries once the codebooks settle
        assert scans[-1] < 0.5 * scans[0]


def test_bounds_hold_for_each_group(spark):
    rng = np.random.default_rng(1)
    x, books = rng.integers(-50, 50, (300, 4)), rng.integers(-50, 50, (12, 4))
    groups = codes.grouped_entries(books[None])[0]
    n = groups.max() + 1
    code, low = np.zeros(300, np.int64), np.full((300, n), -np.inf)
    moved = np.zeros(n)
    for _ in range(5):
        code, low, own, _ = codes.reassigned(x, code, low, books, groups, moved)
        far = ((x[:, None] - books) ** 2).sum(-1)
        assert (code == far.argmin(1)).all() and (own == far.min(1)).all()
        far = np.sqrt(far.astype(float))
        far[np.arange(300), code] = np.inf
        for g in range(n):
            assert (low[:, g] <= far[:, groups == g].min(1) * (1 + 1e-9)).all()
        new = books + rng.integers(-3, 4, books.shape)
        shift = np.sqrt(((new - books) ** 2).sum(1))
        moved, books = np.array([shift[groups == g].max() for g in range(n)]), new


def test_awkward_rows(spark):
    fine = [[0.1 * k] * 8 for k in range(4)]
    rows = [(9, fine[0], None), (3, fine[1], 1), (3, fine[1], 1), (None, fine[2], None)]
    bad = [(1, None, 1), (2, [], 1), (4, [0.5] * 7 + [None], 1), (5, [0.5] * 7 + [float("nan")], 1), (6, [float("inf")] * 8, 1), (7, [0.5] * 9, 1), (8, [0.5] * 16, 1), (10, [1e30] * 8, 1)]
    out = codes.vector_codes(made(spark, rows + bad)).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in out] == [None, 3, 3, 9]
    assert {r["error"] for r in out} == {0}
    # three of the four rows are distinct seeds; repeated rows take the lower number
    assert [r["code"] for r in out] == ["03" * 8, "00" * 8, "00" * 8, "02" * 8]
    assert codes.vector_codes(made(spark, [])).count() == 0
    assert codes.vector_codes(made(spark, bad[:3])).count() == 0
    clash = made(spark, rows[:2]).withColumns({"code": F.lit("x"), "error": F.lit("y"), "ints": F.lit(1), "__id": F.lit(2)})
    assert codes.vector_codes(clash).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes.vector_codes(clash).count() == 2


def test_reconstruction(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 16))
    df = made(spark, [(i, r.tolist(), 0) for i, r in enumerate(v)])
    out, books = codes.compressed(df, entries=64)
    got = {r["vec_id"]: r["vector"] for r in codes.reconstructed(out, books).collect()}
    off = np.mean([np.sum((np.array(got[i]) - v[i]) ** 2) for i in range(300)])
    assert off < 0.25 * np.mean((v**2).sum(1))


def test_partitioning_does_not_matter(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    one = {tuple(r) for r in codes.vector_codes(df.coalesce(1)).collect()}
    assert one == {tuple(r) for r in codes.vector_codes(df.repartition(7)).collect()}
    assert len(one) == op13_vector_codes(spark, "/root/testdata/sf0.001").count()
