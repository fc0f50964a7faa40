"""Vectors and rankings as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, col


def dot(a: C, b: C) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: C) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: C, b: C) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def valid_vector(a: C, dimensions: int) -> Column:
    """Of the right length, all components finite."""
    ok = (F.size(col(a)) == dimensions) & F.forall(col(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok, F.lit(False))


def unit(a: C) -> Column:
    """Divided by its length; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(col(a), lambda x: x / n))


def recall_at(found: C, expected: C, k: int = 10) -> Column:
    """Share of the expected among the first k; with none expected, 1 only if none was found."""
    found, expected = F.slice(col(found), 1, k), col(expected)
    hits = F.size(F.filter(expected, lambda e: F.array_contains(found, e)))
    return F.when(F.size(expected) == 0, (F.size(found) == 0).cast("double")).otherwise(F.bround(hits / F.size(expected), 4))


def reciprocal_rank(found: C, expected: C) -> Column:
    found, expected = col(found), col(expected)
    places = F.filter(F.transform(found, lambda f, i: F.when(F.array_contains(expected, f), i + 1)), lambda p: p.isNotNull())
    first = F.array_min(places)
    return F.when(F.size(expected) == 0, (F.size(found) == 0).cast("double")).otherwise(F.coalesce(F.bround(1 / first, 4), F.lit(0.0)))


def ndcg_at(found: C, expected: C, k: int = 10, gains: C | None = None) -> Column:
    """Gain 2 ** relevance - 1, discounted by log2(rank + 1); gains is a map of graded relevances, else 1 each."""
    found, expected = F.slice(col(found), 1, k), col(expected)

    def rel(e: Column, absent: float) -> Column:
        if gains is None:
            return F.lit(1.0) if absent else F.when(F.array_contains(expected, e), 1.0).otherwise(0.0)
        return F.coalesce(F.try_element_at(col(gains), e), F.lit(absent))

    def total(values: Column) -> Column:
        return F.aggregate(F.transform(values, lambda r, i: F.when(r > 0, (F.pow(F.lit(2.0), r) - 1) / F.log2(i + 2)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)

    ideal = total(F.slice(F.sort_array(F.transform(expected, lambda e: rel(e, 1.0)), asc=False), 1, k))
    reached = total(F.transform(found, lambda f: rel(f, 0.0)))
    score = F.when((F.size(found) == 0) | (ideal <= 0), 0.0).otherwise(F.bround(reached / ideal, 4))
    return F.when(F.size(expected) == 0, (F.size(found) == 0).cast("double")).otherwise(score)


def sigmoid(x: C) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def overlap_score(tokens: C, text: C, importance: C) -> Column:
    """0.7 * share of tokens in the text + 0.3 * importance."""
    hits = F.size(F.filter(col(tokens), lambda t: F.contains(col(text), t)))
    return F.try_divide(hits, F.size(col(tokens))) * 0.7 + col(importance) * 0.3
