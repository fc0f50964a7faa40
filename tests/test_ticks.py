import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.sources.shared import shared_path
from tidemill.streaming import sinks, ticks

pytest.importorskip("google.protobuf")
T0 = dt.datetime(2024, 1, 1)
MINUTE = dt.timedelta(minutes=1)


def job(user, name, at):
    """u1's mail fails in the first 20 minutes, u2's always, others never."""
    minute = (at - 1_704_067_200_000) // 60_000
    if (user, name) == ("u1", "mail") and minute < 20 or user == "u2":
        raise ValueError(f"down at {minute}")
    return minute % 3


def files_of(spark, folder, parts):
    for k, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "user_id string, job string, at timestamp").coalesce(1)
        df.write.mode("append").json(f"{folder}/{k}")


def streamed(spark, tmp_path, parts, name):
    files_of(spark, f"{tmp_path}/{name}", parts)
    stream = spark.readStream.schema("user_id string, job string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{tmp_path}/{name}")
    query = ticks.run_jobs(stream, job, late="0 seconds").writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return {tuple(r) for r in spark.table(name).collect()}


def test_stream_equals_fold(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ticks.PROVIDER)
    every = [(u, j, T0 + k * 4 * MINUTE) for k in range(9) for u in ("u1", "u2", "u3") for j in ("mail", "goals")]
    late = [("u9", "mail", T0 + 40 * MINUTE)]
    parts = [every[:18], every[18:36], every[36:], late]
    try:
        got = streamed(spark, tmp_path, parts, "ticks_one")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    end = int((T0 + 40 * MINUTE).replace(tzinfo=dt.UTC).timestamp() * 1000)
    df = spark.createDataFrame(every + late, "user_id string, job string, at timestamp")
    want = {tuple(r) for r in ticks.fold_jobs(df, job, until=end).collect()}
    # the watermark reaches the last tick, so that timers up to it have run
    assert {r for r in got if r[2] < T0 + 40 * MINUTE} == {r for r in want if r[2] < T0 + 40 * MINUTE}
    assert {r[0] for r in got if r[6] is None} == {"u1", "u3", "u9"}
    fails = sorted(r for r in got if r[0] == "u2" and r[1] == "mail")
    assert [r[4] for r in fails] == list(range(1, len(fails) + 1)) and len(fails) > 5
    assert [(b[2] - a[2]).total_seconds() for a, b in zip(fails, fails[1:])][:4] == [60, 120, 240, 300]


def test_backoff():
    assert [ticks.Backoff()(n) for n in (1, 2, 3, 4, 40)] == [60_000, 120_000, 240_000, 300_000, 300_000]
    assert ticks.Backoff(1000, 1000)(7) == 1000


ROWS = "user_id string, dedup_key string, at timestamp, title string"


def notes(spark, *rows):
    return spark.createDataFrame([(u, k, T0 + d * dt.timedelta(days=1), t) for u, k, d, t in rows], ROWS)


def test_sink_publishes_once(spark):
    sink = sinks.OnceSink(spark, shared_path(spark, "sink"))
    assert sink.published() is None
    one, two = notes(spark, ("u", "a", 0, "x"), ("u", "a", 0, "y"), ("v", "a", 0, "x"), (None, None, 0, "n")), notes(spark, ("u", "a", 1, "z"), ("u", "b", 1, "x"), (None, None, 1, "n"))
    sink.publish(one, 0)
    sink.publish(two, 1)
    sink.publish(two, 1)
    sink.publish(one, 0)
    got = sorted((r["user_id"] or "", r["dedup_key"] or "", r["batch"]) for r in sink.published().collect())
    assert got == [("", "", 0), ("u", "a", 0), ("u", "b", 1), ("v", "a", 0)]
    sink.publish(notes(spark, ("u", "a", 9, "later")), 2)  # beyond the days in which a key counts
    assert sink.published().where("batch = 2").count() == 1


def test_sink_after_a_crash(spark, tmp_path, monkeypatch):
    """A batch whose folder was written, but not marked, is replayed by the restarted stream and counts once."""
    for k, rows in enumerate(([("u", "a", 0, "x")], [("u", "a", 0, "x"), ("u", "b", 0, "x")], [("u", "c", 0, "x")])):
        notes(spark, *rows).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{k}")
    path, told = shared_path(spark, "sink"), []

    def run(sink):
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{tmp_path}/in")
        q = stream.writeStream.foreachBatch(sink.publish).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    mark = sinks.OnceSink._mark

    def crash(self, batch):
        if batch == 1:
            raise OSError("killed")
        mark(self, batch)

    monkeypatch.setattr(sinks.OnceSink, "_mark", crash)
    with pytest.raises(Exception, match="killed"):
        run(sinks.OnceSink(spark, path))
    assert sinks.OnceSink(spark, path).published().count() == 1
    monkeypatch.undo()
    sink = sinks.OnceSink(spark, path, deliver=lambda rows, batch: told.append((batch, rows.count())) if batch != 2 else 1 / 0)
    run(sink)
    assert sorted(r["dedup_key"] for r in sink.published().collect()) == ["a", "b", "c"]
    assert told == [(1, 1)] and [b for b, _ in sink.failed] == [2]
    assert sink.published().select(F.countDistinct("dedup_key")).first()[0] == 3
