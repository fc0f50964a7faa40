"""The prefix trie of conversations, from their sorted order.

A node of depth d is a distinct sequence of the first d turns.  It is never
built turn by turn: conversations are sorted by their turns, each gets the
length L of the prefix that it shares with the one before, and the nodes are the
intervals of the Cartesian tree over L.

Sorting.  A turn is a symbol (the SHA-256 of its role and text), so that equal
turns are equal symbols.  A conversation of up to 64 turns is sorted by the
array of its symbols.  Of longer ones, pieces of 64 symbols are named by their
rank among all distinct pieces, and the names are pieces in turn, so that no sort
key has more than 64 elements however long a conversation is; L of two
neighbours is found by descending from the first names that differ.  Ranges are
cut by (symbols, conv_id), so that a large group of copies spreads over many.

All nearest smaller values.  The order is cut into blocks of equal size, of
which there are 65,536 at most.  A block finds most of its values' nearest
smaller ones on its own, with a stack.  For a value that is smaller than all
before (or after) it in its block, the minima of the blocks (a bounded table)
tell the block that holds its nearest smaller value; that block is asked once
for each value, however often the value occurs.  Sums over an interval are
differences of running sums; the smallest conv_id comes from the parts of the
two outer blocks and the minima of those between.

Nodes.  Values of equal L in one interval are one node: the first of them
speaks for it.  A node that is a depth below its parent by more than one stands
for a chain; the chain's nodes are expanded from the turns of its smallest
member, in pieces of 64.  A node's number of children is that of its values plus
one, less the members that end in it.

A conversation's ids that end at a node are joined within blocks and hashed as
one stream in their order (a digest can't be computed in parts); no list of them
is held.

Nulls, ties and empties: turns go by `turn` (null first), equal ones by their
symbol; a null role or text is empty; rows of a null conv_id belong to no
conversation; rows that repeat are turns of their own.  No conversations give no
nodes, not even a root.  Columns of other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .storage import drop, staged

#: symbols of a sort key
PIECE = 64
#: conversations of a block, at least
BLOCK = 512
#: blocks, at most: their minima are what the driver gets and sends out
BLOCKS = 1 << 16

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _numbered(df: DataFrame, keys: list[Column], sums: tuple[str, ...] = (), tag: str = "numbered") -> DataFrame:
    """df in the order of its keys with `place` (from 0), and running sums `upto_x` (x included) of some columns."""
    passed = [f for f in df.schema.fields]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in passed] + [T.StructField(n, T.LongType()) for n in ("part", "index", *(f"within_{s}" for s in sums))])
    arrow = to_arrow_schema(schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, total = TaskContext.get().partitionId(), 0, dict.fromkeys(sums, 0)
        for batch in batches:
            rows = batch.num_rows
            cols = [batch.column(f.name) for f in passed] + [pa.array(np.full(rows, part, np.int64)), pa.array(np.arange(n, n + rows))]
            for s in sums:
                run = np.cumsum(batch.column(s).to_numpy(zero_copy_only=False)) + total[s]
                cols.append(pa.array(run.astype(np.int64)))
                total[s] = int(run[-1]) if rows else total[s]
            n += rows
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    rows = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(number, schema), tag)
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("part").agg(F.count("*").alias("n"), *(F.sum(s).alias(f"all_{s}") for s in sums))
    offsets = counts.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in ("n", *(f"all_{s}" for s in sums))))
    return rows.join(offsets, "part").select(
        *(f.name for f in passed), (F.col("before_n") + F.col("index")).alias("place"), *((F.col(f"before_all_{s}") + F.col(f"within_{s}")).alias(f"upto_{s}") for s in sums)
    )


def turns_of(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth from 1, symbol, size, upto): the turns in order; size are a text's bytes, upto those up to here."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    symbol = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), symbol.alias("symbol"), F.octet_length(text).cast("long").alias("size")
    )
    placed = _numbered(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("symbol")], ("size",), "turns")
    first = placed.groupBy("conv_id").agg(F.min("place").alias("first"), F.min(F.col("upto_size") - F.col("size")).alias("before"))
    return placed.join(first, "conv_id").select(
        "conv_id", (F.col("place") - F.col("first") + 1).alias("depth"), "symbol", "size", (F.col("upto_size") - F.col("before")).alias("upto")
    )


def lengths_of(turns: DataFrame) -> DataFrame:
    """(conv_id, n) of conversations that have turns."""
    return turns.groupBy("conv_id").agg(F.max("depth").alias("n"))


def with_shared_starts(turns: DataFrame, *, every: int = 5, longest: int = 8) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of conversations c that begin with the first h turns of c - c % every, h = crc32(c) % (longest + 1).

    Their own turns after the first h follow.  A start that isn't there is empty; lengths holds turnless ones.
    """
    head = F.struct("depth", "symbol", "size", "upto")
    convs = turns.groupBy("conv_id").agg(F.max("depth").alias("own"), F.sort_array(F.collect_list(F.when(F.col("depth") <= longest, head))).alias("heads"))
    c, h = F.col("conv_id"), F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)
    donors = convs.select(F.col("conv_id").alias("donor"), F.col("heads").alias("start"))
    plan = convs.withColumns({"h": h, "donor": c - c % every}).join(donors, "donor", "left")
    start = F.slice(F.coalesce("start", F.array().cast(convs.schema["heads"].dataType)), F.lit(1), F.col("h").cast("int"))
    plan = plan.select("conv_id", "h", "own", "heads", start.alias("start"))
    upto = lambda col, n: F.coalesce(F.get(F.col(col), n.cast("int") - 1)["upto"], F.lit(0))
    given = F.size("start").cast("long")
    plan = staged(plan.select("conv_id", "h", "start", given.alias("given"), (given + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"), (upto("start", given) - upto("heads", F.col("h"))).alias("shift")), "plan")
    lent = plan.select("conv_id", F.inline("start"))
    kept = turns.join(plan.select("conv_id", "h", "given", "shift"), "conv_id").where("depth > h")
    kept = kept.select("conv_id", (F.col("depth") - F.col("h") + F.col("given")).alias("depth"), "symbol", "size", (F.col("upto") + F.col("shift")).alias("upto"))
    return lent.unionByName(kept), plan.select("conv_id", "n")


def _pieces(symbols: DataFrame, name: str) -> DataFrame:
    """(conv_id, k, piece): arrays of up to PIECE neighbours of (conv_id, k, name)."""
    whole = F.sort_array(F.collect_list(F.struct("k", name)))
    return symbols.groupBy("conv_id", F.floor(F.col("k") / PIECE).alias("k")).agg(whole.alias("piece")).select("conv_id", "k", F.col(f"piece.{name}").alias("piece"))


def _differ(a: Column, b: Column) -> Column:
    """The first place (from 0) where arrays differ, one that ends before the other included; -1 if none."""
    return F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False) - 1


def _sorted(turns: DataFrame, lengths: DataFrame, longest: int) -> tuple[DataFrame, list[DataFrame]]:
    """(conv_id, n, key, place) in the order of turns, and the pieces that names in keys stand for, level by level."""
    levels: list[DataFrame] = []
    pieces = _pieces(turns.select("conv_id", (F.col("depth") - 1).alias("k"), "symbol"), "symbol")
    while longest > PIECE:
        names = staged(_numbered(pieces.select("piece").distinct(), [F.col("piece")], tag="names"), "names")
        levels.append(names.select(F.col("place").alias("name"), "piece"))
        pieces = _pieces(pieces.join(names, "piece").select("conv_id", "k", F.col("place").alias("name")), "name")
        longest = -(-longest // PIECE)
    empty = F.array().cast(pieces.schema["piece"].dataType)
    keyed = lengths.join(pieces.select("conv_id", "piece"), "conv_id", "left").select("conv_id", "n", F.coalesce("piece", empty).alias("key"))
    return _numbered(keyed, [F.col("key"), F.col("conv_id")], tag="order"), levels


def _shared(order: DataFrame, levels: list[DataFrame], block: int) -> DataFrame:
    """(place, block, conv_id, n, n_before, shared): shared turns with the conversation before; -1 for the first."""
    own = F.floor(F.col("place") / block)
    again = F.when((F.col("place") + 1) % block == 0, F.array(own, own + 1)).otherwise(F.array(own))  # the next block's neighbour
    by = Window.partitionBy("block").orderBy("place")
    near = order.withColumn("block", F.explode(again)).withColumns({"before": F.lag("key").over(by), "n_before": F.lag("n").over(by)}).where(own == F.col("block"))
    at = _differ(F.col("key"), F.col("before"))
    most = F.least("n", "n_before")
    state = near.select(
        "place", "block", "conv_id", "n", "n_before",
        F.when(F.col("before").isNull(), -1).when(at < 0, F.col("n")).otherwise(at * PIECE ** len(levels)).alias("shared"),
        F.when(at >= 0, F.get("key", at.cast("int"))).alias("x"), F.when(at >= 0, F.get("before", at.cast("int"))).alias("y"), (at >= 0).alias("open"),
    )
    for k, names in reversed(list(enumerate(levels))):
        one, two = (names.select(F.col("name").alias(c), F.col("piece").alias(f"{c}_piece")) for c in "xy")
        both = state.join(one, "x", "left").join(two, "y", "left")
        deeper = F.coalesce(F.col("open"), F.lit(False)) & F.col("x").isNotNull() & F.col("y").isNotNull()
        at = _differ(F.col("x_piece"), F.col("y_piece"))
        state = both.select(
            "place", "block", "conv_id", "n", "n_before",
            F.when(deeper, F.col("shared") + at * PIECE**k).when(F.col("open"), most).otherwise(F.col("shared")).alias("shared"),
            F.when(deeper, F.get("x_piece", at.cast("int"))).alias("x"), F.when(deeper, F.get("y_piece", at.cast("int"))).alias("y"), deeper.alias("open"),
        )
    return state.select("place", "block", "conv_id", "n", "n_before", F.when(F.col("open"), F.least("shared", most)).otherwise(F.col("shared")).alias("shared"))


def nearest_smaller(values: list[int]) -> tuple[list[int], list[int], list[bool]]:
    """For each value the nearest strictly smaller one's index to the left (-1: none) and right (len: none), and whether an equal one comes before it after the left one."""
    n = len(values)
    left, right, again, stack = [-1] * n, [n] * n, [False] * n, []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = i
        if stack:
            top = stack[-1]
            again[i] = values[top] == v
            left[i] = left[top] if again[i] else top
        stack.append(i)
    return left, right, again


class Blocks:
    """What is known of each block: smallest value and how often, first value, smallest id, sums before, last new sequence before."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["block"])
        get = lambda name: np.array([r[name] for r in rows], np.int64)
        self.low, self.lows, self.first, self.conv = get("low"), get("lows"), get("first"), get("conv")
        self.saved, self.leaves = (np.concatenate([[0], np.cumsum(get(n))]) for n in ("saved", "leaves"))
        news = np.maximum.accumulate(np.array([-1 if r["new"] is None else r["new"] for r in rows], np.int64)) if rows else np.zeros(0, np.int64)
        self.new = np.concatenate([[-1], news])
        self.places = int(sum(r["rows"] for r in rows))

    def smaller(self, block: int, value: int, side: int) -> int:
        """The nearest block before (side 0) or after (1) this one with a smaller value; -1: none."""
        found = np.flatnonzero(self.low[:block] < value) if side == 0 else np.flatnonzero(self.low[block + 1 :] < value)
        return -1 if not len(found) else int(found[-1]) if side == 0 else block + 1 + int(found[0])

    def between(self, a: int, b: int, value: int) -> tuple[int, int | None]:
        """How often a value that none is below occurs in the blocks from a on before b, and their smallest id."""
        if a >= b:
            return 0, None
        low = self.low[a:b] == value
        return int(self.lows[a:b][low].sum()), int(self.conv[a:b].min())


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    table = table.sort_by("place")
    return {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("place", "conv_id", "n", "shared", "saved", "leaf", "new")}


def _open_ends(rows: dict[str, np.ndarray], left: list[int], right: list[int], block: int) -> set[tuple[int, int]]:
    """(side, value) of the values whose nearest smaller one is not in their block."""
    out = {(0, int(v)) for v, at in zip(rows["shared"], left) if at < 0 and block}
    return out | {(1, int(v)) for v, at in zip(rows["shared"], right) if at == len(left) and v >= 0}


ASKED = "block long, target long, side int, value long"
ANSWER = "target long, side int, value long, at long, shared long, saved long, own_saved long, leaves long, equal long, conv long"
FOUND = "kind int, at long, depth long, above long, parent long, convs long, conv long, splits long, saved long, leaves long, block long, ids string"


def _ask(shared) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        rows, block = _columns(table), int(table.column("block")[0].as_py())
        left, right, _ = nearest_smaller(rows["shared"].tolist())
        asked = [(block, shared.value.smaller(block, v, side), side, v) for side, v in sorted(_open_ends(rows, left, right, block))]
        return pa.table({n: pa.array([a[i] for a in asked], pa.int32() if n == "side" else pa.int64()) for i, n in enumerate(("block", "target", "side", "value"))})

    return run


def _answer(shared) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each (side, value) that a block is asked: its nearest smaller value and what lies on the way to it."""

    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if table.num_rows and asked.num_rows:
            rows, block = _columns(table), int(table.column("block")[0].as_py())
            saved = shared.value.saved[block] + np.cumsum(rows["saved"])
            leaves = shared.value.leaves[block] + np.cumsum(rows["leaf"])
            for side, value in zip(asked.column("side").to_pylist(), asked.column("value").to_pylist()):
                at = int(np.flatnonzero(rows["shared"] < value)[-1 if side == 0 else 0])
                way = slice(at + 1, None) if side == 0 else slice(0, at)
                ids = rows["conv_id"][at:] if side == 0 else rows["conv_id"][:at]
                equal = int((rows["shared"][way] == value).sum())
                out.append((block, side, value, *(int(x[at]) for x in (rows["place"], rows["shared"], saved, rows["saved"], leaves)), equal, int(ids.min()) if len(ids) else None))
        names = [c.split()[0] for c in ANSWER.split(", ")]
        return pa.table({n: pa.array([o[i] for o in out], pa.int32() if n == "side" else pa.int64()) for i, n in enumerate(names)})

    return run


def _nodes(shared) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's nodes (kind 1), its values' smallest members (kind 0) and its ids by last node (kind 2)."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in FOUND.split(", ")]
        out: dict[str, list] = {n: [] for n in names}
        if table.num_rows:
            for row in _block_nodes(_columns(table), int(table.column("block")[0].as_py()), shared.value, answers):
                for n, v in zip(names, row, strict=True):
                    out[n].append(v)
        return pa.table({n: pa.array(v, pa.int32() if n == "kind" else pa.string() if n == "ids" else pa.int64()) for n, v in out.items()})

    return run


def _block_nodes(rows: dict[str, np.ndarray], block: int, blocks: Blocks, answers: pa.Table) -> Iterator[tuple]:
    values, conv, length = rows["shared"].tolist(), rows["conv_id"], rows["n"].tolist()
    left, right, again = nearest_smaller(values)
    n, base = len(values), int(rows["place"][0])
    saved = blocks.saved[block] + np.cumsum(rows["saved"])
    leaves = blocks.leaves[block] + np.cumsum(rows["leaf"])
    told = {(r["side"], r["value"]): r for r in answers.to_pylist()}
    end = {"at": blocks.places, "shared": -1, "saved": int(blocks.saved[-1]), "own_saved": 0, "leaves": int(blocks.leaves[-1]) + 1}
    equal_in = _running_counts(values)
    least = _RangeMin(conv)

    def inside(at: int) -> dict:
        return {"at": base + at, "shared": values[at], "saved": int(saved[at]), "own_saved": int(rows["saved"][at]), "leaves": int(leaves[at])}

    seen: dict[tuple[int, int, int], tuple] = {}
    for i, v in enumerate(values):
        if v < 0:
            continue  # the first conversation of all has none before it
        key = (left[i], right[i], v)
        if key not in seen:
            splits, first_here, smallest = equal_in(v, left[i] + 1, right[i]), True, [least(max(left[i], 0), right[i])]
            if left[i] >= 0:
                lo = inside(left[i])
            else:
                lo = told[0, v]
                more, low = blocks.between(lo["target"] + 1, block, v)
                splits, first_here = splits + lo["equal"] + more, not (lo["equal"] or more)
                smallest += [lo["conv"], low]
            if right[i] < n:
                hi = inside(right[i])
            else:
                hi = told.get((1, v))
                target = hi["target"] if hi else len(blocks.low)
                more, low = blocks.between(block + 1, target, v)
                splits += more + (hi["equal"] if hi else 0)
                smallest += [low, hi["conv"] if hi else None]
                hi = hi or end
            seen[key] = (lo, hi, splits, first_here, min(s for s in smallest if s is not None))
        lo, hi, splits, first_here, smallest = seen[key]
        yield (0, base + i, None, None, None, None, smallest, None, None, None, None, None)
        if first_here and not again[i]:
            above = max(lo["shared"], hi["shared"])
            parent = None if above < 0 else lo["at"] if lo["shared"] == above else hi["at"]
            yield (1, lo["at"], v, above, parent, hi["at"] - lo["at"], smallest, splits, hi["saved"] - hi["own_saved"] - lo["saved"], hi["leaves"] - lo["leaves"], None, None)
    after = [*values[1:], int(blocks.first[block + 1]) if block + 1 < len(blocks.first) else -1]
    for i, (v, w) in enumerate(zip(values, after)):
        above = max(v, w)
        if length[i] > above:
            parent = None if above < 0 else base + i if v == above else base + i + 1
            yield (1, base + i, length[i], above, parent, 1, int(conv[i]), 0, 0, 1, None, None)
    start = np.maximum.accumulate(np.where(rows["new"], rows["place"], blocks.new[block]))
    cuts = np.flatnonzero(np.diff(start, prepend=-2))
    for a, b in zip(cuts, [*cuts[1:], n]):
        yield (2, int(start[a]), length[a], None, None, int(b - a), None, None, None, None, block, ",".join(map(str, conv[a:b].tolist())))


def _running_counts(values: list[int]) -> Callable[[int, int, int], int]:
    """How often a value occurs in a range of indexes."""
    at: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        at.setdefault(v, []).append(i)
    places = {v: np.array(p) for v, p in at.items()}
    return lambda v, a, b: int(np.searchsorted(places[v], b) - np.searchsorted(places[v], a))


class _RangeMin:
    """The smallest of a range, from minima over runs of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (step := 1 << (len(self.levels) - 1)) * 2 <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, a: int, b: int) -> int:
        k = (b - a).bit_length() - 1
        return int(min(self.levels[k][a], self.levels[k][b - (1 << k)]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, depth, ends, sha) of runs of rows of one `at`, whose ids are one stream."""
    now, digest, ends, depth = None, hashlib.sha256(), 0, 0
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        cols = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        done.clear()
        return pa.RecordBatch.from_arrays(cols, names=["at", "depth", "ends", "sha"])

    for batch in batches:
        for at, d, n, ids in zip(*(batch.column(c).to_pylist() for c in ("at", "depth", "convs", "ids"))):
            if at != now:
                if now is not None:
                    done.append((now, depth, ends, digest.hexdigest()))
                now, digest, ends, depth = at, hashlib.sha256(), 0, d
            else:
                digest.update(b",")
            digest.update(ids.encode())
            ends += n
        if done:
            yield out()
    if now is not None:
        done.append((now, depth, ends, digest.hexdigest()))
        yield out()


def prefix_trie(turns: DataFrame, lengths: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """The nodes of conversations: `turns` as of `turns_of`, `lengths` (conv_id, n) with a row for each, turnless ones too.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a node is named by its
    smallest member and its depth.
    """
    spark = turns.sparkSession
    turns, lengths = staged(turns.select("conv_id", "depth", "symbol", "size", "upto"), "turns"), staged(lengths.select("conv_id", "n"), "lengths")
    convs, longest = lengths.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    block = max(block, -(-convs // BLOCKS))
    order, levels = _sorted(turns, lengths, longest)
    near = _shared(order, levels, block)
    # what a conversation shares with the one before is saved once
    lent = turns.select("conv_id", F.col("depth").alias("shared"), F.col("upto").alias("saved"))
    new = ~((F.col("shared") == F.col("n")) & (F.col("n") == F.col("n_before")))
    values = staged(
        near.join(lent, ["conv_id", "shared"], "left").select(
            "place", "block", "conv_id", "n", "shared", F.coalesce("saved", F.lit(0)).alias("saved"),
            F.coalesce(F.col("shared") < F.col("n_before"), F.lit(False)).cast("long").alias("leaf"), F.coalesce(new, F.lit(True)).alias("new"),
        ),
        "values",
    )
    low = values.groupBy("block", "shared").agg(F.count("*").alias("k"))
    low = low.groupBy("block").agg(F.min("shared").alias("low"), F.min_by("k", "shared").alias("lows"))
    rest = values.groupBy("block").agg(
        F.min_by("shared", "place").alias("first"), F.min("conv_id").alias("conv"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"), F.max(F.when(F.col("new"), F.col("place"))).alias("new"), F.count("*").alias("rows")
    )
    known = spark.sparkContext.broadcast(Blocks(low.join(rest, "block").collect()))
    asked = staged(values.groupBy("block").applyInArrow(_ask(known), ASKED), "asked")
    wanted = asked.where("target >= 0").select(F.col("target").alias("block"), "side", "value").distinct()
    answers = values.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_answer(known), ANSWER)
    told = asked.join(answers, ["target", "side", "value"])
    found = staged(values.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_nodes(known), FOUND), "nodes")

    ids = found.where("kind = 2").select("at", "depth", "block", "convs", "ids")
    ends = ids.repartition("at").sortWithinPartitions("at", "block").mapInArrow(_hashed, "at long, depth long, ends long, sha string")
    members = found.where("kind = 0").select(F.col("at").alias("parent"), F.col("conv").alias("parent_conv"))
    nodes = found.where("kind = 1").join(ends, ["at", "depth"], "left").join(members, "parent", "left")
    nodes = staged(
        nodes.select("conv", "depth", "above", "parent_conv", "convs", "saved", "leaves", (F.col("splits") + 1 - F.coalesce("ends", F.lit(0))).alias("children"), F.coalesce("sha", F.lit(EMPTY_SHA)).alias("sha")),
        "nodes",
    )
    last, top = F.col("d") == F.col("depth"), F.col("d") == F.col("above") + 1

    def result(rows: DataFrame) -> DataFrame:
        return rows.select(
            F.col("conv").alias("conv_id"),
            F.col("d").alias("depth"),
            F.when(F.col("d") == 0, F.lit(None)).when(top, F.col("parent_conv")).otherwise(F.col("conv")).cast("long").alias("parent_conv_id"),
            F.col("convs").alias("n_convs"),
            F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            (F.col("saved") - (F.col("convs") - 1) * F.col("above_bytes")).alias("saved_tokens"),
            F.when(last, F.col("sha")).otherwise(EMPTY_SHA).alias("ends_sha256"),
        )

    root = nodes.where("above < 0").withColumns({"d": F.lit(0).cast("long"), "above_bytes": F.lit(0).cast("long")})
    piece = lambda d: F.floor((d - 1) / PIECE)
    chains = nodes.where("depth > 0").withColumn("piece", F.explode(F.sequence(piece(F.greatest(F.col("above") + 1, F.lit(1))), piece(F.col("depth")))))
    steps = turns.select(F.col("conv_id").alias("conv"), F.col("depth").alias("d"), piece(F.col("depth")).alias("piece"), (F.col("upto") - F.col("size")).alias("above_bytes"))
    chains = chains.join(steps, ["conv", "piece"]).where((F.col("d") > F.col("above")) & (F.col("d") <= F.col("depth")))
    drop(spark, asked)
    return result(root).unionByName(result(chains))
