"""Jobs of users by ticks: each (user, job) on its own, with a pause after a failure and a new attempt when it ends.

`run_jobs` is a stateful stream: state is the number of failures in a row and the time of the next attempt, for each
(user, job).  A tick at or after that time (or without one) is an attempt.  A job that raises fails for its user only:
its attempt is a row with the error, the failures are counted, and a timer brings the next attempt when the pause is
over, whether a tick comes or not.  Attempts that fell due before a tick are made before it, so that the rows do not
depend on how the ticks are cut into batches; `fold_jobs` gives the same rows for a batch of all ticks.

Times are event times; ticks that come after the watermark are dropped.  Ticks of a null time are no attempts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (user, job, time in ms) to the number of notifications made; raises if the job fails
Job = Callable[[str, str, int], int]
ATTEMPT = "user_id string, job string, at timestamp, made long, failures int, next_at timestamp, error string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Backoff:
    """The pause after n failures in a row, in ms: doubled each time, from `first` up to `most`."""

    first: int = 60_000
    most: int = 300_000

    def __call__(self, failures: int) -> int:
        return min(self.most, self.first << min(failures - 1, 30))


@dataclass
class Run:
    """What is kept for a (user, job), and its next attempts."""

    job: Job
    backoff: Backoff
    failures: int = 0
    next_at: int | None = None

    def attempt(self, user: str, name: str, at: int) -> tuple:
        try:
            made, error = self.job(user, name, at), None
            self.failures, self.next_at = 0, None
        except Exception as e:  # noqa: BLE001 - whatever a user's job raises must not stop the others
            made, error = 0, f"{type(e).__name__}: {e}"
            self.failures += 1
            self.next_at = at + self.backoff(self.failures)
        return user, name, at, made, self.failures, self.next_at, error

    def until(self, user: str, name: str, end: int) -> Iterator[tuple]:
        """The attempts that fall due before a time."""
        while self.next_at is not None and self.next_at < end:
            yield self.attempt(user, name, self.next_at)

    def tick(self, user: str, name: str, at: int) -> Iterator[tuple]:
        yield from self.until(user, name, at)
        if self.next_at is None or at >= self.next_at:
            yield self.attempt(user, name, at)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["user_id", "job", "at", "made", "failures", "next_at", "error"])
    return df.assign(at=pd.to_datetime(df["at"], unit="ms"), next_at=pd.to_datetime(df["next_at"].astype("Int64"), unit="ms"))


def _ticks(df: DataFrame) -> DataFrame:
    return df.where(F.col("at").isNotNull()).select("user_id", "job", F.col("at").cast("timestamp").alias("at"))


def run_jobs(ticks: DataFrame, job: Job, *, backoff: Backoff = Backoff(), late: str = "1 minute") -> DataFrame:
    """The attempts (`ATTEMPT`) of a stream of ticks (user_id, job, at); needs RocksDB as the state store (`PROVIDER`)."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Processor(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.kept = handle.getValueState("kept", "failures int, next_at long, timer long")

        def _load(self) -> tuple[Run, int | None]:
            kept = self.kept.get() if self.kept.exists() else (0, None, None)
            return Run(job, backoff, kept[0], kept[1]), kept[2]

        def _store(self, run: Run, timer: int | None) -> None:
            if timer is not None and timer != run.next_at:
                self.handle.deleteTimer(timer)
            if run.next_at is None:
                self.kept.clear()
                return
            if timer != run.next_at:
                self.handle.registerTimer(run.next_at)
            self.kept.update((run.failures, run.next_at, run.next_at))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            run, timer = self._load()
            times = pd.concat(list(rows))["at"].astype("datetime64[ms]").astype("int64").sort_values()
            out = [r for at in times for r in run.tick(*key, int(at))]
            self._store(run, timer)
            if out:
                yield _frame(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            run, _ = self._load()
            due = expiredTimerInfo.getExpiryTimeInMs()
            if run.next_at != due:
                return
            out = [run.attempt(*key, due)]
            self._store(run, None)
            yield _frame(out)

        def close(self) -> None:
            pass

    return _ticks(ticks).withWatermark("at", late).groupBy("user_id", "job").transformWithStateInPandas(Processor(), ATTEMPT, "Append", "EventTime")


def fold_jobs(ticks: DataFrame, job: Job, *, backoff: Backoff = Backoff(), until: int | None = None) -> DataFrame:
    """The same attempts over a batch of all ticks; those that fall due after a (user, job)'s last tick are made up to `until` (ms)."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        run = Run(job, backoff)
        times = rows["at"].astype("datetime64[ms]").astype("int64").sort_values()
        out = [r for at in times for r in run.tick(*key, int(at))]
        return _frame(out + ([] if until is None else list(run.until(*key, until))))

    return _ticks(ticks).groupBy("user_id", "job").applyInPandas(fold, ATTEMPT)
