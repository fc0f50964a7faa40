"""Near-duplicate documents by MinHash with tensored banding.

Sets are distinct five-word shingles (a shorter document is one shingle).  Two
documents are linked when 100 * |A & B| >= threshold * |A | B|; a document's
component is the smallest doc_id that links lead to.

Tensored banding: instead of `collections ** 2` independent tables, two lists
of `collections` small keys U_i and V_j are hashed, each from `width` minima,
and table (i, j) is keyed by the pair (U_i, V_j).  That takes
2 * collections * width hash functions where independent tables of the same
selectivity would take collections ** 2 * 2 * width.  With the defaults
(16, 3) a pair at similarity 0.75 meets in a table with probability
(1 - (1 - 0.75 ** 3) ** 16) ** 2 > 0.9996, one at 0.3 with 0.13.

Steps, none of which gathers a group in one task or emits all pairs of a group:

1. one pass over the texts gives set size, 128-bit set fingerprint (sums of two
   independent hashes of the shingles), U and V; equal sets are collapsed to one
   set, which gets a number of its own: a doc_id may occur with several texts;
2. a U_i (V_j) that no other set has drops out; the remaining keys of a set
   (at most 2 * collections) are combined in pairs to table keys;
3. the shingles of these sets are counted.  A set's overlap with any other is
   at most the number of its shingles that another set has too, which bounds
   the sizes of the sets that it may be linked with; a set that this leaves no
   size for drops out.  The bound is exact: no link is lost;
4. each set is compared with one leader, the member of its tables that meets
   most others; verified pairs are linked;
5. in each table whose members then lie in several components, the members
   outside its largest component are paired with all members of others that
   the bounds allow, so that no link between components is lost.  The join's
   condition also bounds the overlap by parity bitmaps (two sets differ in at
   least as many shingles as their bitmaps differ in bits), and makes a pair in
   the first of the tables that it shares only;
6. every comparison is made on the full shingle sets of the two texts, and a
   link must hold under both of two independent 64-bit hashes of the shingles.

Nulls, empties, repeats: a null or empty text, or one without words, has an
empty set, is its own component and is kept.  Each row is a document of its own:
where a doc_id occurs with different texts, each row has the component that its
own text's links lead to.  A null doc_id is linked with nothing, has a null
component and is kept.  An empty table gives no rows.  Other columns of the
input are ignored.

`deduplicated` keeps one row of each component: that of the smallest doc_id (and
of the smaller text hash, where that id has several texts), and one only of rows
that repeat it; any of those that differ in other columns.  Rows without words
or without a doc_id all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import drop, staged
from .textkit import WORDS_SPACE, Words, batches, mix, shingle_hashes

SHINGLE = 5
THRESHOLD = 75
COLLECTIONS = 16
WIDTH = 3
#: shingles hashed at once, which bounds memory on long texts
BLOCK = 8192
#: longs of a set's parity bitmap
BITMAP = 16


def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), BLOCK):
        np.minimum(least, (multipliers[:, None] * shingles[None, at : at + BLOCK]).min(axis=1), out=least)
    return least


def small_keys(least: np.ndarray, width: int) -> np.ndarray:
    """Keys of `width` minima each; the first half of them are U, the rest V."""
    rows = least.reshape(-1, width)
    out = np.zeros(len(rows), dtype=np.uint64)
    for k in range(width):
        out = mix(out + rows[:, k] + np.uint64(0x9E3779B97F4A7C15 + k))
    return out


def _signatures(collections: int, width: int, size: int, seed: int):
    multipliers = _multipliers(2 * collections * width, seed)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, words in batches(part.column(2), WORDS_SPACE):
                n = len(words.bounds) - 1
                count = np.zeros(n, np.int64)
                prints = np.zeros((n, 2), np.uint64)
                keys: list[np.ndarray | None] = [None] * n
                for i, (one, two) in enumerate(_both_sets(words, size)):
                    if len(one):
                        count[i] = len(one)
                        prints[i] = one.sum(dtype=np.uint64), two.sum(dtype=np.uint64)
                        keys[i] = small_keys(minima(one, multipliers), width).view(np.int64)
                prints = prints.view(np.int64)
                own = part.slice(row, n)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(count), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "n_shingles", "print_a", "print_b", "keys"],
                )

    return run


def _both_sets(words: Words, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each document's distinct shingles under two independent hashes."""
    one, two, bounds = words.hashes(), words.hashes(1), words.bounds
    for i in range(len(bounds) - 1):
        own = slice(bounds[i], bounds[i + 1])
        yield np.unique(shingle_hashes(one[own], size)), np.unique(shingle_hashes(two[own], size))


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether the number of a set's shingles in each of 64 * BITMAP classes is odd, as bits of longs."""
    odd = np.bincount((shingles % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(size: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, words in batches(part.column(1), WORDS_SPACE):
                found = list(_both_sets(words, size))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0)[row : row + len(found)],
                        *(pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1)),
                        pa.array([parities(f[0]) for f in found], pa.list_(pa.int64())),
                    ],
                    names=["id", "shingles", "seconds", "parity"],
                )

    return run


def _each_shingle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for i in range(0, part.num_rows, 256):
            own = part.slice(i, 256)
            found = [np.frombuffer(x.as_buffer(), np.int64) for x in own.column(1)]
            ids = np.repeat(own.column(0).to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(found))], names=["id", "shingle"])


def size_bounds(sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(id, size, most) of the sets that may be linked at all; most is the greatest size of a partner.

    With s shingles that other sets have too, an overlap o <= s must reach
    (100 + t) * o >= t * (own size + partner's size).
    """
    each = sets.select("id", "shingles").mapInArrow(_each_shingle, "id long, shingle long")
    own = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").groupBy("id").agg(F.count("*").alias("unique"))
    size = F.floor(F.length("shingles") / 8)
    out = sets.select("id", size.alias("size")).join(own, "id", "left")
    shared = F.col("size") - F.coalesce("unique", F.lit(0))
    most = F.floor(((100 + threshold) * shared - threshold * F.col("size")) / threshold)
    return out.select("id", "size", most.alias("most")).where(f"100 * most >= {threshold} * size")


def _allowed(x: str, y: str) -> str:
    """SQL: two members' bounds allow a link."""
    return f"{x}_size <= {y}_most and {y}_size <= {x}_most"


def _similar(x: pa.Scalar, y: pa.Scalar, threshold: int) -> bool:
    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return 100 * both >= threshold * (len(x) + len(y) - both)


def _linked(threshold: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = [_similar(x, y, threshold) and _similar(x2, y2, threshold) for x, y, x2, y2 in zip(*part.columns[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose full sets (id, shingles, seconds) are similar enough under both hashes."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"), F.col("seconds").alias("x2"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"), F.col("seconds").alias("y2"))
    both = pairs.join(left, "a").join(right, "b").where(
        100 * F.least(F.length("x"), F.length("y")) >= threshold * F.greatest(F.length("x"), F.length("y"))
    )
    return both.select("a", "b", "x", "y", "x2", "y2").mapInArrow(_linked(threshold), "a long, b long")


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: int, collections: int, width: int, seed: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, first) of each row; first: it is the row that stays of its component."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    signed = staged(
        texts.mapInArrow(_signatures(collections, width, size, seed), "doc_id long, text_hash long, n_shingles long, print_a long, print_b long, keys array<long>"),
        "minhash",
    )
    exact = ["n_shingles", "print_a", "print_b"]
    made: list[DataFrame] = []

    def hold(df: DataFrame, tag: str) -> DataFrame:
        made.append(staged(df, tag))
        return made[-1]

    row = F.struct("doc_id", "text_hash")
    reps = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*exact).agg(F.min(row).alias("row"), F.min_by("keys", row).alias("keys"))
    reps = hold(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")

    # small keys that at least two sets share
    small = reps.select(F.col("rep").alias("id"), F.posexplode("keys").alias("place", "key"))
    shared = small.groupBy("place", "key").agg(F.count("*").alias("n")).where("n > 1").select("place", "key")
    left = (
        small.join(shared, ["place", "key"], "left_semi")
        .groupBy("id")
        .agg(F.collect_list(F.struct("place", "key")).alias("keys"))
    )
    tables = (
        left.select(
            "id",
            F.explode(F.filter("keys", lambda k: k["place"] < collections)).alias("u"),
            F.filter("keys", lambda k: k["place"] >= collections).alias("vs"),
        )
        .select("id", "u", F.explode("vs").alias("v"))
        .select("id", F.xxhash64("u.place", "u.key", "v.place", "v.key").alias("key"))
    )
    tables = hold(tables, "tables")
    sized = hold(tables.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "tables")
    members = hold(tables.join(sized.select("key"), "key", "left_semi"), "members")

    # exact sets of the texts that share a table
    inside = reps.join(members.select(F.col("id").alias("rep")).distinct(), "rep", "left_semi").select("row.*", "rep")
    sets = texts.join(inside, ["doc_id", "text_hash"]).select("rep", "text").mapInArrow(_sets(size), "id long, shingles binary, seconds binary, parity array<long>")
    sets = hold(sets.groupBy("id").agg(*(F.first(c).alias(c) for c in ("shingles", "seconds", "parity"))), "sets")

    bounds = hold(size_bounds(sets, threshold), "bounds")
    members = members.select("key", "id").join(bounds, "id")
    members = hold(members.join(members.groupBy("key").agg(F.count("*").alias("n"), F.min("size").alias("least")).where("n > 1"), "key").where("least <= most"), "members")

    # one leader for each set: of its tables' members, the one that meets most others
    degree = members.groupBy("id").agg(F.sum("n").alias("degree"))
    ranked = members.join(degree, "id").select("key", F.struct("degree", (-F.col("id")).alias("id"), "size", "most").alias("rank"))
    leaders = hold(ranked.groupBy("key").agg(F.max("rank").alias("rank")), "leaders")
    first = (
        members.join(leaders, "key")
        .where("id <> -rank.id")
        .groupBy("id")
        .agg(F.max("rank").alias("rank"), F.first("size").alias("a_size"), F.first("most").alias("a_most"))
        .select(F.col("id").alias("a"), (-F.col("rank.id")).alias("b"), "a_size", "a_most", F.col("rank.size").alias("b_size"), F.col("rank.most").alias("b_most"))
        .where(_allowed("a", "b"))
    )
    first = hold(first.select("a", "b"), "pairs")
    links = hold(verified(first, sets, threshold=threshold), "links")
    groups = hold(components(links), "groups")

    # what still lies in several components of a table
    named = members.select("key", "id", "size", "most").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = hold(sizes.groupBy("key").agg(F.max_by("component", "n").alias("largest"), F.count("*").alias("parts")).where("parts > 1").drop("parts"), "mixed")
    known = sets.select("id", *(F.col("parity")[k].alias(f"p{k}") for k in range(BITMAP))).join(reps.select(F.col("rep").alias("id"), F.col("keys").alias("small")), "id")
    # only members of such tables get what the join's condition asks for
    placed = hold(named.join(mixed.select("key"), "key", "left_semi").join(known, "id"), "placed")
    others = hold(placed.join(mixed, "key").where("component <> largest"), "others")
    carried = ("component", "size", "most", "small", *(f"p{k}" for k in range(BITMAP)))

    def side(of: DataFrame, name: str) -> DataFrame:
        return of.select("key", F.col("id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in carried))

    # of a + b shingles, d that only one set has leave (a + b - d) / 2 that both have
    differ = " + ".join(f"bit_count(a_p{k} ^ b_p{k})" for k in range(BITMAP))
    enough = f"{100 + threshold} * (a_size + b_size - ({differ})) >= {2 * threshold} * (a_size + b_size)"
    # two sets meet in many tables: a pair is made in the first of them, that of their first common U and V
    u, v = (f"int(array_position(zip_with(slice(a_small, {at}, {collections}), slice(b_small, {at}, {collections}), (x, y) -> x = y), true))" for at in (1, collections + 1))
    first_met = f"key = xxhash64({u} - 1, element_at(a_small, {u}), {collections} + {v} - 1, element_at(a_small, {collections} + {v}))"
    pairs = (
        side(others, "a")
        .join(side(placed, "b"), "key")
        .where(f"a_component <> b_component and {_allowed('a', 'b')} and {enough} and {first_met}")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = hold(verified(pairs.join(tried, ["a", "b"], "left_anti"), sets, threshold=threshold), "links")
    # one edge for each member is enough of what is known already
    edges = more.union(groups.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")))
    groups = hold(components(edges).select(F.col("id").alias("rep"), "component"), "groups")

    ended = hold(reps.join(groups, "rep", "left").select(*exact, "row", F.coalesce("component", "rep").alias("component")), "ended")
    least = ended.groupBy("component").agg(F.min("row").alias("least"))
    named = staged(ended.drop("row").join(least, "component").drop("component"), "named")
    drop(docs.sparkSession, *made)
    out = signed.select("doc_id", "text_hash", *exact).join(named, exact, "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(linked, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked, row == F.col("least")).otherwise(True).alias("first"),
    )


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    threshold: int = THRESHOLD,
    collections: int = COLLECTIONS,
    width: int = WIDTH,
    seed: int = 1,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs; kept is doc_id = component_id."""
    out = _classes(docs, id_col, text_col, size, threshold, collections, width, seed)
    return out.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    threshold: int = THRESHOLD,
    collections: int = COLLECTIONS,
    width: int = WIDTH,
    seed: int = 1,
) -> DataFrame:
    """docs without the near copies: one row of each component stays."""
    rows = staged(_classes(docs, id_col, text_col, size, threshold, collections, width, seed), "classes")

    def at(keys: DataFrame):
        keys = keys.select(F.col("doc_id").alias("__tidemill_id"), F.col("text_hash").alias("__tidemill_hash"))
        return keys, (docs[id_col].cast("long") == keys["__tidemill_id"]) & (F.xxhash64(docs[text_col]) == keys["__tidemill_hash"])

    gone = rows.where("not first").select("doc_id", "text_hash").distinct()
    again = staged(rows.where("first and n_shingles > 0 and doc_id is not null").groupBy("doc_id", "text_hash").count().where("count > 1"), "repeated")
    kept = docs.join(*at(gone), "left_anti")
    if not again.isEmpty():
        once = docs.join(*at(again), "left_semi").dropDuplicates([id_col, text_col])
        kept = kept.join(*at(again), "left_anti").unionByName(once)
    return kept.select(*docs.columns)
