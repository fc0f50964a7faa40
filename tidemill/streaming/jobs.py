"""Incremental jobs as Structured Streaming transformations.

Each is a DataFrame to DataFrame function over a stream (or, where it says so,
a batch): the caller names source, trigger and sink.  `run_available` reads what
there is and stops, which is what a periodic tick does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..functions.text import fold_or_empty
from ..operators.sizes import BROADCAST_BYTES, broadcast_if_small


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Give every micro-batch of what is there to `each`, then stop; offsets are kept in the checkpoint."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, ts: str, keys: list[str], window: str = "1 hour", late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts (and sums) by tumbling window; events later than the watermark are dropped."""
    measures = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), *keys).agg(*measures).select(F.col("window.start").alias("window_start"), *keys, *[m for m in (["n"] + (["total"] if value else []))])


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Bursts of events with no gap larger than this."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def since(events: DataFrame, ts: str, last_checked: Column) -> DataFrame:
    """What came after the last check; anything at or before it is late and dropped."""
    return events.where(F.col(ts) > last_checked)


def once(events: DataFrame, key: Column, ts: str, late: str = "2 days") -> DataFrame:
    """Each dedup key once within the watermark."""
    return events.withColumn("dedup_key", key).withWatermark(ts, late).dropDuplicatesWithinWatermark(["dedup_key"])


def rule_matches(events: DataFrame, rules: DataFrame, text: str, ts: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Events (stream or batch) with the active, unexpired rules whose words are all in the folded text.

    rules: rule_id, target, active, expires_at: a static table, joined by its rarest-looking (longest)
    word, then checked for all words, so that no event is compared with every rule.  The rules are the side
    that is sent out, if their counted bytes allow it; the events then stay where they are.
    """
    words = F.filter(F.split(fold_or_empty("target"), " "), lambda w: w != "")
    # the longest word; of equal ones the first
    rarest = F.reduce(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    static, _ = broadcast_if_small(rules.where("active").select("rule_id", "expires_at", words.alias("_words"), rarest.alias("_word")).where("_word <> ''"), broadcast_bytes)
    tokens = F.array_distinct(F.split(fold_or_empty(text), r"[^\p{L}\p{N}]+"))
    keyed = events.withColumn("_tokens", tokens).withColumn("_word", F.explode("_tokens"))
    hit = keyed.join(static, "_word").where(F.col("expires_at").isNull() | (F.col(ts) < F.col("expires_at")))
    return hit.where(F.size(F.array_except("_words", "_tokens")) == 0).drop("_word", "_words", "_tokens")


def anchored_limit(events: DataFrame, key: str, ts: str, most: int = 5, seconds: int = 900, late: str = "1 minute") -> DataFrame:
    """(key, ts, n, allowed): hits counted in a fixed window that begins at the first event after the last one's end.

    State is a window's begin and count for each key; it goes once the watermark is past the window's end.
    """

    def count(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        whole = pd.concat(parts).sort_values(ts)
        rows = []
        for at in whole[ts]:
            ms = at.value // 1_000_000
            if start is None or ms >= start + seconds * 1000:
                start, n = ms, 0
            n += 1
            rows.append((name[0], at, n, n <= most))
        state.update((start, n))
        state.setTimeoutTimestamp(max(start + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[key, ts, "n", "allowed"])

    kind = dict(events.dtypes)
    return events.select(key, ts).withWatermark(ts, late).groupBy(key).applyInPandasWithState(
        count, f"{key} {kind[key]}, {ts} {kind[ts]}, n long, allowed boolean", "start long, n long", "append", GroupStateTimeout.EventTimeTimeout
    )


def anchored_limit_batch(events: DataFrame, key: str, ts: str, most: int = 5, seconds: int = 900) -> DataFrame:
    """The same over a batch.

    A pause as long as the window always begins a new one, so that runs of events without such a
    pause are counted by themselves: a key's events are no group of one task.
    """
    by = Window.partitionBy(key).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    timed = events.select(key, ts, micros.alias("_at"))
    fresh = F.coalesce(F.col("_at") - F.lag("_at").over(by) >= seconds * 1_000_000, F.lit(True))
    runs = timed.withColumn("_new", fresh.cast("int")).withColumn("_run", F.sum("_new").over(by))

    kinds = {f.name: f.dataType for f in runs.schema.fields}
    schema = T.StructType([T.StructField(key, kinds[key]), T.StructField(ts, kinds[ts]), T.StructField("n", T.LongType()), T.StructField("allowed", T.BooleanType())])
    ordered = runs.select(key, ts, "_run", "_at").repartition(key, "_run").sortWithinPartitions(key, "_run", "_at")
    return ordered.mapInArrow(_counted(key, ts, most, seconds * 1_000_000), schema)


def window_places(at: np.ndarray, run: np.ndarray, span: int, begun: int | None = None, n: int = 0) -> tuple[np.ndarray, int]:
    """(number of each event in its window, begin of the last event's window) for events in order of (run, time).

    A window begins at the first event after the last one's end, anew in each run.  The first run may go on
    from a window with its begin and number of events so far.
    """
    first = np.flatnonzero(np.diff(run, prepend=run[0] - 1))
    ends = np.append(first[1:], len(at))
    # a time that grows over all runs: one search finds the end of every run's window
    gap = int(at.max() - at.min()) + span + 1
    line = at - at.min() + (np.cumsum(np.diff(run, prepend=run[0]) != 0)) * gap
    out, start = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    begin = first.copy()
    if begun is not None:
        own = min(int(np.searchsorted(at[: ends[0]], begun + span)), int(ends[0]))
        out[:own], start[:own] = n + np.arange(1, own + 1), begun
        begin[0] = own
    live = begin < ends
    while live.any():
        at_begin, at_end = begin[live], np.minimum(np.searchsorted(line, line[begin[live]] + span), ends[live])
        sizes = at_end - at_begin
        rows = np.repeat(at_begin, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[rows], start[rows] = rows - np.repeat(at_begin, sizes) + 1, np.repeat(at[at_begin], sizes)
        begin[live] = at_end
        live = begin < ends
    return out, int(start[-1])


def _counted(key: str, ts: str, most: int, span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of a sorted partition; the window that a batch ends in goes on in the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begun, n = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            same = pc.fill_null(pc.equal(keys[:-1], keys[1:]), False).to_numpy(zero_copy_only=False) if len(keys) > 1 else np.zeros(0, bool)
            null = keys.is_null().to_numpy(zero_copy_only=False)
            number = batch.column("_run").to_numpy(zero_copy_only=False)
            runs = np.concatenate([[0], np.cumsum(~(same | (null[:-1] & null[1:])) | (np.diff(number) != 0))])
            goes_on = last == (keys[0].as_py(), int(number[0]))
            counts, begun = window_places(batch.column("_at").to_numpy(zero_copy_only=False), runs, span, begun if goes_on else None, n)
            last, n = (keys[-1].as_py(), int(number[-1])), int(counts[-1])
            yield pa.RecordBatch.from_arrays([keys, batch.column(ts), pa.array(counts), pa.array(counts <= most)], names=[key, ts, "n", "allowed"])

    return run


def due_steps(goals: DataFrame, today: Column) -> DataFrame:
    """Goals with the steps that are open and due; a step whose date does not parse is dropped.

    goals: goal_id, steps (array of struct title, due, done).
    """
    due = F.filter("steps", lambda s: ~F.coalesce(s["done"], F.lit(False)) & (F.try_to_date(s["due"], "yyyy-MM-dd") <= today))
    return goals.withColumn("due_steps", due).where(F.size("due_steps") > 0)


def newest(events: DataFrame, ts: str, now: Column, minutes: int, most: int = 5) -> DataFrame:
    """The newest events within the age limit."""
    return events.where(F.col(ts) >= now - F.make_interval(mins=F.lit(minutes))).orderBy(F.desc(ts)).limit(most)


