"""Benchmark decontamination by a prefix-filtered set join with exact verification.

A window is `window` consecutive words of a benchmark item; an item of fewer
words, but not none, is one window.  A window is the set of its shingles (runs
of `shingle` words).  Exact containment needs every shingle, so by the prefix
principle the rarest one is enough to find all candidates: shingles are ordered
by how often they occur in all documents (counted in a first pass), each window
is indexed under its rarest shingle and that shingle's place in the window, and
a document's occurrences of the indexed shingles are joined with the index.  A
candidate must begin and end inside the document (positional and length
bounds); its words are then compared with the window's, byte for byte.

The benchmark's distinct windows are made and numbered by Spark and dealt by hash
to blocks of about `block_windows` windows and BLOCK_BYTES bytes, which bounds
what is broadcast, and what the driver holds, whatever the benchmark's size.  One
block is alive at a time: if there are several, the documents get row numbers in
the shared folder, each block's hits are written there, its broadcast is
destroyed, and the hits are united by row number in the end.

Nulls and empties: a null text has no words; a document or item without words
has no hits.  A null item_id is no item; ids may be of any type that can be
ordered.  An empty benchmark gives no hits.  Repeated items count once by item_id;
repeated documents are judged row by row, and a null doc_id is no matter.  Other
columns are kept; one that is named as `out_col` is replaced (`decontaminated`
keeps all columns as they are).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .storage import staged
from .textkit import WORDS_ALNUM, Words, batches, shingle_hashes

WINDOW = 10
SHINGLE = 3
#: distinct windows in a block, and their bytes
BLOCK_WINDOWS = 200_000
BLOCK_BYTES = 32 << 20


class Block:
    """Distinct windows (tuples of words) and the items that have them."""

    def __init__(self, windows: list[tuple[tuple[bytes, ...], list]]):
        self.windows = windows
        by_width = defaultdict(list)
        for k, (words, _) in enumerate(self.windows):
            by_width[min(SHINGLE, len(words))].append(k)
        flat = pa.array([b" ".join(words).decode() for words, _ in self.windows], pa.string())
        hashes: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(self.windows)
        for row, found in batches(flat, WORDS_ALNUM):
            h, bounds = found.hashes(), found.bounds
            for i in range(len(bounds) - 1):
                hashes[row + i] = shingle_hashes(h[bounds[i] : bounds[i + 1]], SHINGLE)
        self.hashes = hashes
        self.widths = sorted(by_width)
        self.keys = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        self.index: dict[int, list[tuple[int, int]]] = {}

    def order(self, counts: dict[int, int]) -> None:
        """Index each window under its rarest shingle."""
        index = defaultdict(list)
        for k, h in enumerate(self.hashes):
            at = min(range(len(h)), key=lambda i: (counts.get(int(h[i]), 0), int(h[i])))
            index[int(h[at])].append((k, at))
        self.index = dict(index)
        self.keys = np.array(sorted(index), np.uint64)
        self.filter = None
        del self.hashes

    def matches(self, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(width, places, keys) of the indexed shingles in a list of word hashes."""
        table = getattr(self, "filter", None)
        if table is None:  # one bit for each hash of 24 bits: most shingles need no search
            table = np.zeros(1 << 24, bool)
            table[self.keys >> np.uint64(40)] = True
            self.filter = table
        for width in self.widths:
            if len(hashes) < width:
                continue
            found = shingle_hashes(hashes, width)
            at = np.flatnonzero(table[found >> np.uint64(40)])
            at = at[np.isin(found[at], self.keys, kind="sort")] if len(at) else at
            yield width, at, found[at]


def _windows(window: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, found in batches(part.column(1), WORDS_ALNUM):
                for i in range(len(found.bounds) - 1):
                    words = [found.word(k).decode() for k in range(found.bounds[i], found.bounds[i + 1])]
                    own = sorted({" ".join(words[at : at + window]) for at in range(max(1, len(words) - window + 1))}) if words else []
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.repeat(part.column(0)[row + i], len(own))], names=["window", "item"])

    return run


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(window, items): distinct windows, words joined by spaces, with the sorted ids of their items."""
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("item is not null")
    made = items.mapInArrow(_windows(window), f"window string, item {items.schema['item'].dataType.simpleString()}")
    return staged(made.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items")), "windows")


def _block(windows: DataFrame, number: int, blocks: int) -> Block:
    own = windows.where(F.pmod(F.xxhash64("window", F.lit(29)), F.lit(blocks)) == number) if blocks > 1 else windows
    table = own.toArrow().sort_by("window")
    return Block([(tuple(w.encode().split(b" ")), items) for w, items in zip(table["window"].to_pylist(), table["items"].to_pylist(), strict=True)])


def _counts(docs: DataFrame, text_col: str, shared) -> dict[int, int]:
    """In how many places of all documents each of a block's shingles occurs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        total = np.zeros(len(block.keys), np.int64)
        for part in parts:
            for _, words in batches(part.column(0), WORDS_ALNUM):
                for _, _, keys in block.matches(words.hashes()):
                    total += np.bincount(np.searchsorted(block.keys, keys), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(block.keys[used].view(np.int64)), pa.array(total[used])], names=["key", "n"])

    counted = docs.select(text_col).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return {row[0] & (1 << 64) - 1: row[1] for row in counted.toLocalIterator()}


def _hits(block: Block, words: Words) -> tuple[list[list[tuple[int, int]]], list[set]]:
    """Spans and items of each document of a step."""
    hashes, bounds = words.hashes(), words.bounds
    n = len(bounds) - 1
    hit: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    having: list[set] = [set() for _ in range(n)]
    for _, places, keys in block.matches(hashes) if len(hashes) else ():
        of = np.searchsorted(bounds, places, side="right") - 1
        for place, key, doc in zip(places.tolist(), keys.tolist(), of.tolist(), strict=True):
            for k, at in block.index[key]:
                window, ids = block.windows[k]
                start = place - at
                if start < bounds[doc] or start + len(window) > bounds[doc + 1]:
                    continue
                if all(words.word(start + i) == w for i, w in enumerate(window)):
                    hit[doc].append((start - int(bounds[doc]), start - int(bounds[doc]) + len(window)))
                    having[doc].update(ids)
    return hit, having


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _span_rows(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in merged(spans)]


def _finder(shared, item_type: pa.DataType):
    """n_words, spans and item_ids of each text."""

    def find(texts: pa.Array) -> pa.Array:
        n_words, spans, items = [], [], []
        for _, words in batches(texts, WORDS_ALNUM):
            hit, having = _hits(shared.value, words)
            n_words += np.diff(words.bounds).tolist()
            spans += map(_span_rows, hit)
            items += map(sorted, having)
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(item_type))], names=["n_words", "spans", "item_ids"])

    return find


def _hit_rows(shared, item_type: pa.DataType):
    """(row, spans, item_ids) of the texts with hits."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, words in batches(part.column(1), WORDS_ALNUM):
                hit, having = _hits(shared.value, words)
                at = [i for i, h in enumerate(hit) if h]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array([row + i for i in at], pa.int64())), pa.array([_span_rows(hit[i]) for i in at], SPANS), pa.array([sorted(having[i]) for i in at], pa.list_(item_type))],
                    names=["row", "spans", "item_ids"],
                )

    return run


def _word_counts(texts: pa.Array) -> pa.Array:
    return pa.array([n for _, words in batches(texts, WORDS_ALNUM) for n in np.diff(words.bounds).tolist()], pa.int64())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans, united, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _united(item: str, item_type: pa.DataType):
    """One list of spans and one of items, of the lists of several blocks."""

    @F.arrow_udf(SPAN_TYPE)
    def spans(found: pa.Array) -> pa.Array:
        return pa.array([_span_rows([(s["start"], s["end"]) for own in row for s in own]) for row in found.to_pylist()], SPANS)

    @F.arrow_udf(f"array<{item}>")
    def items(found: pa.Array) -> pa.Array:
        return pa.array([sorted({i for own in row for i in own}) for row in found.to_pylist()], pa.list_(item_type))

    return spans, items


SPAN_TYPE = "array<struct<start: bigint, end: bigint>>"


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
    out_col: str = "contamination",
) -> DataFrame:
    """docs with a column: n_words, the word spans that benchmark windows hit, and the items hit."""
    windows = benchmark_windows(benchmark, item_id_col, item_text_col, window)
    item = benchmark.schema[item_id_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_id_col].dataType)
    n, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    blocks = max(1, -(-n // block_windows), -(-size // BLOCK_BYTES))
    if blocks == 1:
        shared = _indexed(docs, text_col, _block(windows, 0, 1))
        return docs.withColumn(out_col, F.arrow_udf(_finder(shared, item_type), f"struct<n_words: bigint, spans: {SPAN_TYPE}, item_ids: array<{item}>>")(F.col(text_col)))
    numbered = staged(docs.withColumn("__tidemill_row", F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col("__tidemill_row").alias("row"), F.col(text_col).alias("text"))
    hits = None
    for k in range(blocks):
        shared = _indexed(texts, "text", _block(windows, k, blocks))
        found = staged(texts.mapInArrow(_hit_rows(shared, item_type), f"row long, spans {SPAN_TYPE}, item_ids array<{item}>"), "hits")
        shared.destroy()
        hits = found if hits is None else hits.union(found)
    spans, items = _united(item, item_type)
    hits = hits.groupBy("row").agg(F.collect_list("spans").alias("spans"), F.collect_list("item_ids").alias("items"))
    hits = hits.select(F.col("row").alias("__tidemill_row"), spans("spans").alias("__tidemill_spans"), items("items").alias("__tidemill_items"))
    found = F.struct(
        F.arrow_udf(_word_counts, "bigint")(F.col(text_col)).alias("n_words"),
        F.coalesce("__tidemill_spans", F.array().cast(SPAN_TYPE)).alias("spans"),
        F.coalesce("__tidemill_items", F.array().cast(f"array<{item}>")).alias("item_ids"),
    )
    return numbered.join(hits, "__tidemill_row", "left").withColumn(out_col, found).drop("__tidemill_row", "__tidemill_spans", "__tidemill_items")


def _indexed(docs: DataFrame, text_col: str, block: Block):
    """The block, its windows indexed by their rarest shingles in docs, as a broadcast."""
    context = docs.sparkSession.sparkContext
    counts = {}
    if block.windows:
        keys = context.broadcast(block)
        counts = _counts(docs, text_col, keys)
        keys.destroy()
    block.order(counts)
    return context.broadcast(block)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold a benchmark window."""
    found = find_contamination(docs, benchmark, **options, out_col="__tidemill_found")
    return found.where(F.size("__tidemill_found.item_ids") == 0).select(*docs.columns)
