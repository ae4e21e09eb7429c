"""The leased job queue as a fold over events: one transition function, in batch and as a stream.

Events: queue_key (what a job is queued under), seq (order of appending), ts, event, job_id, worker, and what the event
needs. A lease ends at a time that later events or ticks tell; the clock is the events' own, so a replay gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.operators.numbering import number_rows

ACTIVE = ("queued", "running", "cancel_requested")
OWNED = ("running", "cancel_requested")
EVENT = "queue_key string, seq long, ts timestamp_ntz, event string, job_id string, worker string, lease_seconds int, retryable boolean, progress_current int, progress_total int, max_attempts int"
OUTCOME = "queue_key string, seq long, event string, job_id string, accepted boolean, detail string, status string, attempt int, lease_owner string"
JOB = "queue_key string, job_id string, status string, attempt int, max_attempts int, lease_owner string, lease_expires_at timestamp_ntz, progress_current int, progress_total int, created_seq long, started_at timestamp_ntz, finished_at timestamp_ntz, error string"


@dataclass(frozen=True)
class Job:
    job_id: str
    created_seq: int
    status: str = "queued"
    attempt: int = 0
    max_attempts: int = 3
    lease_owner: str | None = None
    lease_expires_at: datetime | None = None
    progress_current: int = 0
    progress_total: int = 0
    started_at: datetime | None = None
    finished_at: datetime | None = None
    error: str | None = None


@dataclass(frozen=True)
class Event:
    seq: int
    ts: datetime
    event: str
    job_id: str | None = None
    worker: str | None = None
    lease_seconds: int = 120
    retryable: bool = False
    progress_current: int | None = None
    progress_total: int | None = None
    max_attempts: int = 3


def sweep(job: Job, now: datetime, recover_cancelled: bool = False) -> Job:
    """A job whose lease ran out waits again, or has failed after its last attempt.

    One that was asked to stop keeps waiting for its worker, unless recover_cancelled: then it is cancelled.
    """
    if job.lease_expires_at is None or job.lease_expires_at >= now:
        return job
    free = replace(job, lease_owner=None, lease_expires_at=None)
    if job.status == "cancel_requested":
        return replace(free, status="cancelled", finished_at=now) if recover_cancelled else job
    if job.status != "running":
        return job
    if job.attempt < job.max_attempts:
        return replace(free, status="queued")
    return replace(free, status="failed", error="lease_expired", finished_at=now)


def step(jobs: dict[str, Job], e: Event, recover_cancelled: bool = False) -> tuple[dict[str, Job], Job | None, bool, str]:
    """The jobs of one queue key after an event (jobs itself, changed); the job it met, whether it took effect, and why not."""
    if e.event == "enqueue":
        for job in jobs.values():
            if job.status in ACTIVE:
                return jobs, job, False, "active job"
        job = jobs[e.job_id] = Job(e.job_id, e.seq, max_attempts=e.max_attempts)
        return jobs, job, True, "created"
    if e.event in ("claim", "tick"):
        jobs.update({k: sweep(j, e.ts, recover_cancelled) for k, j in jobs.items() if j.lease_expires_at is not None})
        if e.event == "tick":
            return jobs, None, True, "swept"
        job = min((j for j in jobs.values() if j.status == "queued"), key=lambda j: j.created_seq, default=None)
        if job is None:
            return jobs, None, False, "nothing queued"
        job = replace(job, status="running", attempt=job.attempt + 1, lease_owner=e.worker, lease_expires_at=e.ts + timedelta(seconds=e.lease_seconds), started_at=job.started_at or e.ts)
    else:
        # Without an id an event is about the newest job of its key.
        job = jobs.get(e.job_id) if e.job_id else max(jobs.values(), key=lambda j: j.created_seq, default=None)
        if job is None:
            return jobs, None, False, "unknown job"
        mine = job.lease_owner == e.worker and e.worker is not None
        held = mine and job.status in OWNED
        if e.event == "cancel":
            if job.status == "queued":
                job = replace(job, status="cancelled", finished_at=e.ts)
            elif job.status == "running":
                job = replace(job, status="cancel_requested")
            else:
                return jobs, job, False, "not cancellable"
        elif e.event == "heartbeat":
            if not held:
                return jobs, job, False, "no lease"
            now, all_ = e.progress_current, e.progress_total
            job = replace(job, lease_expires_at=e.ts + timedelta(seconds=e.lease_seconds), progress_current=job.progress_current if now is None else now, progress_total=job.progress_total if all_ is None else all_)
        elif e.event in ("complete", "stop"):
            if not held:
                return jobs, job, False, "no lease"
            job = replace(job, status="succeeded" if e.event == "complete" else "cancelled", lease_owner=None, lease_expires_at=None, finished_at=e.ts)
        elif e.event == "fail":
            if not mine:
                return jobs, job, False, "ignored"
            again = e.retryable and job.attempt < job.max_attempts
            job = replace(job, status="queued" if again else "failed", lease_owner=None, lease_expires_at=None, finished_at=None if again else e.ts, error="failed")
        else:
            return jobs, job, False, "unknown event"
    jobs[job.job_id] = job
    return jobs, job, True, ""


def forget(jobs: dict[str, Job]) -> None:
    """Drop finished jobs but the newest job: of a key at most one job is active, so what is held doesn't grow with its history.

    A later event about a dropped job meets an unknown one; on a finished job it would have had no effect either.
    """
    newest = max((j.created_seq for j in jobs.values()), default=0)
    for k in [k for k, j in jobs.items() if j.status not in ACTIVE and j.created_seq < newest]:
        del jobs[k]


FIELDS = [x.split()[0] for x in EVENT.split(", ")]


def _event(row: dict) -> Event:
    clean = {k: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v for k, v in row.items()}
    whole = lambda k, default: default if clean.get(k) is None else int(clean[k])
    return Event(
        int(clean["seq"]), pd.Timestamp(clean["ts"]).to_pydatetime(), clean["event"], clean.get("job_id"), clean.get("worker"), whole("lease_seconds", 120), bool(clean.get("retryable") or False),
        whole("progress_current", None), whole("progress_total", None), whole("max_attempts", 3),
    )


def _outcome(key: str, e: Event, job: Job | None, ok: bool, detail: str) -> tuple:
    return key, e.seq, e.event, job.job_id if job else e.job_id, ok, detail, job.status if job else None, job.attempt if job else None, job.lease_owner if job else None


def fold(events: DataFrame, recover_cancelled: bool = False) -> DataFrame:
    """Every event's outcome, the events of each key applied in order of seq. A key's events stream through in bounded batches of pandas rows."""
    columns = [x.split()[0] for x in OUTCOME.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by key and seq: only the jobs of the key at hand are held.
        key, jobs = None, {}
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                if row["queue_key"] != key:
                    key, jobs = row["queue_key"], {}
                e = _event(row)
                jobs, job, ok, detail = step(jobs, e, recover_cancelled)
                out.append(_outcome(key, e, job, ok, detail))
                forget(jobs)
            yield pd.DataFrame(out, columns=columns)

    return events.select(*FIELDS).repartition("queue_key").sortWithinPartitions("queue_key", "seq").mapInPandas(run, OUTCOME)


def final_jobs(events: DataFrame, recover_cancelled: bool = False) -> DataFrame:
    """The jobs of every key after all events."""
    columns = [x.split()[0] for x in JOB.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, jobs = None, {}
        rows = lambda: pd.DataFrame([{"queue_key": key, **asdict(j)} for j in jobs.values()], columns=columns).astype({"lease_expires_at": "datetime64[ns]", "started_at": "datetime64[ns]", "finished_at": "datetime64[ns]"})
        for frame in frames:
            for row in frame.to_dict("records"):
                if row["queue_key"] != key:
                    if jobs:
                        yield rows()
                    key, jobs = row["queue_key"], {}
                jobs, *_ = step(jobs, _event(row), recover_cancelled)
        if jobs:
            yield rows()

    return events.select(*FIELDS).repartition("queue_key").sortWithinPartitions("queue_key", "seq").mapInPandas(run, JOB)


STATE = "jobs string"


def stream(events: DataFrame, recover_cancelled: bool = False) -> DataFrame:
    """The fold as a stateful stream: outcomes as events come. Within a micro-batch a key's events are applied by seq."""
    import json

    columns = [x.split()[0] for x in OUTCOME.split(", ")]
    times = ("lease_expires_at", "started_at", "finished_at")

    def load(text: str) -> dict[str, Job]:
        each = [{k: datetime.fromisoformat(v) if k in times and v else v for k, v in x.items()} for x in json.loads(text)]
        return {x["job_id"]: Job(**x) for x in each}

    def run(key, frames, state):
        jobs = load(state.get[0]) if state.exists else {}
        rows = sorted((r for f in frames for r in f.to_dict("records")), key=lambda r: r["seq"])
        out = []
        for row in rows:
            e = _event(row)
            jobs, job, ok, detail = step(jobs, e, recover_cancelled)
            out.append(_outcome(key[0], e, job, ok, detail))
            forget(jobs)
        state.update((json.dumps([asdict(j) for j in jobs.values()], default=lambda t: t.isoformat()),))
        yield pd.DataFrame(out, columns=columns)

    return events.select(*FIELDS).groupBy("queue_key").applyInPandasWithState(run, OUTCOME, STATE, "append", "NoTimeout")


def enqueue_absent(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Batch form of queueing: requests (aggregate_id, kind, input_version, seq) that no active job answers, the first of equal ones."""
    keys = ["aggregate_id", "kind", "input_version"]
    first = requests.groupBy(*keys).agg(F.min("seq").alias("seq"))
    return first.join(jobs.filter(F.col("status").isin(*ACTIVE)).select(*keys).distinct(), keys, "left_anti")


def claim(jobs: DataFrame, claims: DataFrame, now, lease_seconds: int = 120) -> DataFrame:
    """The whole job table after some workers' claims at one time: leases that ran out are swept first, then the oldest queued jobs of all go to the claims in their order.

    jobs: id, status, attempt, max_attempts, lease_owner, lease_expires_at, created_at, started_at, finished_at, error_json.
    claims: seq, worker. Adds claimed: whether a claim of this call got the job.
    """
    now = F.lit(now).cast("timestamp_ntz")
    out = (F.col("status") == "running") & (F.col("lease_expires_at") < now)
    again = F.col("attempt") < F.col("max_attempts")
    none = lambda c: F.when(~F.coalesce(out, F.lit(False)), F.col(c))
    swept = jobs.withColumns({
        "status": F.when(out & again, "queued").when(out, "failed").otherwise(F.col("status")), "lease_owner": none("lease_owner"), "lease_expires_at": none("lease_expires_at"),
        "error_json": F.when(out & ~again, F.lit('{"code":"lease_expired"}')).otherwise(F.col("error_json")), "finished_at": F.when(out & ~again, now).otherwise(F.col("finished_at")),
    })
    # The queue and the claims are numbered in their orders and meet by number; neither is brought to one place.
    queue = number_rows(swept.filter("status = 'queued'").select("id", "created_at"), ["created_at", "id"], "_n").select("id", "_n")
    taken = queue.join(number_rows(claims.select("seq", F.col("worker").alias("_worker")), ["seq"], "_n"), "_n").select("id", "_worker")
    df = swept.join(taken, "id", "left").withColumn("claimed", F.col("_worker").isNotNull())
    got = lambda new, old: F.when(F.col("claimed"), new).otherwise(F.col(old))
    return df.withColumns({
        "status": got(F.lit("running"), "status"), "lease_owner": got(F.col("_worker"), "lease_owner"), "lease_expires_at": got(now + F.make_dt_interval(secs=F.lit(lease_seconds)), "lease_expires_at"),
        "attempt": got(F.col("attempt") + 1, "attempt"), "started_at": got(F.coalesce("started_at", now), "started_at"),
    }).drop("_worker")
