"""The job queue as a stream in which leases end on their own: a state for each job, and a timer for each lease."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from pagelathe.streaming.jobs import FIELDS, OUTCOME, Job, _event, _outcome, forget, step, sweep

#: The state store that map states and timers need.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
VALUE = "created_seq long, status string, attempt int, max_attempts int, lease_owner string, lease_us long, progress_current int, progress_total int, started_us long, finished_us long, error string"
COLUMNS = [x.split()[0] for x in OUTCOME.split(", ")]
EPOCH, TICK = datetime(1970, 1, 1), timedelta(microseconds=1)


def _micros(t: datetime | None) -> int | None:
    return None if t is None else (t - EPOCH) // TICK


def _time(us: int | None) -> datetime | None:
    return None if us is None else EPOCH + us * TICK


class Leases(StatefulProcessor):
    """A queue key's jobs, each in a row of state of its own: an event rewrites the jobs that it changes."""

    def __init__(self, recover_cancelled: bool = False) -> None:
        self.recover_cancelled = recover_cancelled

    def init(self, handle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_id string", VALUE)

    def _load(self) -> dict[str, Job]:
        found = {}
        for (job_id,), (seq, status, attempt, most, owner, lease, now, all_, started, finished, error) in self.jobs.iterator():
            found[job_id] = Job(job_id, seq, status, attempt, most, owner, _time(lease), now, all_, _time(started), _time(finished), error)
        return found

    def _store(self, before: dict[str, Job], after: dict[str, Job]) -> None:
        for k in before.keys() - after.keys():
            self.jobs.removeKey((k,))
        for k, j in after.items():
            if before.get(k) != j:
                self.jobs.updateValue((k,), (j.created_seq, j.status, j.attempt, j.max_attempts, j.lease_owner, _micros(j.lease_expires_at), j.progress_current, j.progress_total, _micros(j.started_at), _micros(j.finished_at), j.error))
        ends = ("running", "cancel_requested") if self.recover_cancelled else ("running",)
        # A lease ends behind its last moment: at the next whole millisecond.
        want = {_micros(j.lease_expires_at) // 1000 + 1 for j in after.values() if j.lease_expires_at and j.status in ends}
        have = set(self.handle.listTimers())
        for t in want - have:
            self.handle.registerTimer(t)
        for t in have - want:
            self.handle.deleteTimer(t)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self._load()
        jobs, out = dict(before), []
        for row in sorted((r for frame in rows for r in frame.to_dict("records")), key=lambda r: r["seq"]):
            e = _event(row)
            jobs, job, ok, detail = step(jobs, e, self.recover_cancelled)
            out.append(_outcome(key[0], e, job, ok, detail))
            forget(jobs)
        self._store(before, jobs)
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = _time(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        before = self._load()
        jobs = {k: sweep(j, now, self.recover_cancelled) for k, j in before.items()}
        out = [(key[0], None, "lease_end", k, True, "swept", j.status, j.attempt, j.lease_owner) for k, j in jobs.items() if j != before[k]]
        self._store(before, jobs)
        yield pd.DataFrame(out, columns=COLUMNS).astype({"seq": object})


def stream(events: DataFrame, recover_cancelled: bool = False, delay: str = "0 seconds") -> DataFrame:
    """Outcomes as events come, and a row of event lease_end (seq null) when the clock passes the end of a job's lease without one.

    The clock is the stream's watermark: the latest ts of all keys, less delay. The session needs the state store ROCKSDB.
    """
    spark = events.sparkSession
    for k, v in ROCKSDB.items():
        if spark.conf.get(k, None) != v:
            raise ValueError(f"timers need {k}={v}")
    clock = events.select(*FIELDS, F.col("ts").cast("timestamp").alias("clock")).withWatermark("clock", delay)
    return clock.groupBy("queue_key").transformWithStateInPandas(Leases(recover_cancelled), OUTCOME, "update", "eventTime")
