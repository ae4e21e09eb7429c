from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from pagelathe.streaming import jobs
from pagelathe.streaming.jobs import Event, Job, step

T0 = datetime(2026, 1, 1)


def play(*events, **options):
    state, out = {}, []
    for i, (at, name, extra) in enumerate(events):
        e = Event(i, T0 + timedelta(seconds=at), name, **extra)
        state, job, ok, detail = step(state, e, **options)
        out.append((job.status if job else None, ok, detail))
    return state, out


def test_same_submission_twice():
    state, out = play((0, "enqueue", {"job_id": "a"}), (1, "enqueue", {"job_id": "b"}))
    assert list(state) == ["a"] and out[1] == ("queued", False, "active job")


def test_key_is_free_after_the_end():
    state, _ = play((0, "enqueue", {"job_id": "a"}), (1, "claim", {"worker": "w"}), (2, "complete", {"worker": "w"}), (3, "enqueue", {"job_id": "b"}))
    assert [j.status for j in state.values()] == ["succeeded", "queued"]


def test_two_workers_and_expiry():
    state, out = play((0, "enqueue", {"job_id": "a"}), (1, "claim", {"worker": "w", "lease_seconds": 10}), (2, "claim", {"worker": "x"}), (20, "claim", {"worker": "x"}))
    assert out[2] == (None, False, "nothing queued")
    assert (state["a"].attempt, state["a"].lease_owner, state["a"].started_at) == (2, "x", T0 + timedelta(seconds=1))


def test_last_lease_fails():
    claims = [(20 * i, "claim", {"worker": "w", "lease_seconds": 10}) for i in range(1, 4)]
    state, _ = play((0, "enqueue", {"job_id": "a"}), *claims, (100, "tick", {}))
    assert (state["a"].status, state["a"].error) == ("failed", "lease_expired")


def test_cancel():
    state, out = play((0, "enqueue", {"job_id": "a"}), (1, "cancel", {"job_id": "a"}), (2, "claim", {"worker": "w"}))
    assert state["a"].status == "cancelled" and out[2][1] is False
    events = [(0, "enqueue", {"job_id": "a"}), (1, "claim", {"worker": "w", "lease_seconds": 5}), (2, "cancel", {}), (60, "tick", {})]
    # A lost worker's job that was asked to stop stays so, unless that is asked for.
    assert play(*events)[0]["a"].status == "cancel_requested"
    assert play(*events, recover_cancelled=True)[0]["a"].status == "cancelled"
    assert play(*events[:3], (3, "stop", {"worker": "w"}))[0]["a"].status == "cancelled"


def test_leases_guard():
    state, out = play((0, "enqueue", {"job_id": "a"}), (1, "claim", {"worker": "w"}), (2, "heartbeat", {"worker": "x"}), (3, "heartbeat", {"worker": "w", "progress_current": 1, "progress_total": 4}), (4, "fail", {"worker": "x"}), (5, "complete", {"worker": "x"}), (6, "fail", {"worker": "w", "retryable": True}))
    assert [o[1] for o in out] == [True, True, False, True, False, False, True]
    assert state["a"].status == "queued" and (state["a"].progress_current, state["a"].progress_total) == (1, 4)


def events(spark):
    rows = []
    for key in ("k1", "k2", "k3"):
        names = ["enqueue", "claim", "heartbeat", "fail", "claim", "complete", "enqueue", "cancel", "claim", "tick"]
        rows += [(key, i, T0 + timedelta(seconds=i), n, f"{key}-{i}" if n == "enqueue" else None, "w", 100, n == "fail", None, None, 3) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, jobs.EVENT)


def test_fold_and_final_jobs(spark):
    out = jobs.fold(events(spark)).orderBy("queue_key", "seq").collect()
    assert [r["accepted"] for r in out[:10]] == [True] * 8 + [False, True]
    final = {(r["job_id"], r["status"], r["attempt"]) for r in jobs.final_jobs(events(spark)).collect()}
    assert final == {x for k in ("k1", "k2", "k3") for x in ((f"{k}-0", "succeeded", 2), (f"{k}-6", "cancelled", 0))}


def test_stream_agrees_with_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    e = events(spark)
    # Two files: the keys' state goes over from one micro-batch to the next.
    e.filter("seq < 5").coalesce(1).write.mode("append").parquet(src)
    e.filter("seq >= 5").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    q = jobs.stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    want = sorted(map(tuple, jobs.fold(e).collect()))
    # The files may come in either order; state and seq make the outcome the same where they come in order.
    assert {r[:3] for r in got} == {r[:3] for r in want}


def test_enqueue_absent(spark):
    old = spark.createDataFrame([("d", "parse", "v1", "running"), ("d", "parse", "v2", "succeeded")], "aggregate_id string, kind string, input_version string, status string")
    new = spark.createDataFrame([("d", "parse", "v1", 1), ("d", "parse", "v2", 2), ("d", "parse", "v2", 3)], "aggregate_id string, kind string, input_version string, seq int")
    assert [(r["input_version"], r["seq"]) for r in jobs.enqueue_absent(old, new).collect()] == [("v2", 2)]


def test_job_defaults():
    assert Job("a", 1).max_attempts == 3 and pd.isna(pd.NaT) and F is not None


def test_held_jobs_stay_few():
    state = {}
    for i in range(0, 300, 3):
        for k, (name, extra) in enumerate((("enqueue", {"job_id": f"j{i}"}), ("claim", {"worker": "w"}), ("complete", {"worker": "w"}))):
            state, _, ok, _ = step(state, Event(i + k, T0 + timedelta(seconds=i + k), name, **extra))
            jobs.forget(state)
            assert ok and len(state) <= 2
    assert [j.status for j in state.values()] == ["succeeded"]


def test_global_claim_by_brute_force(spark):
    """One worker after the other, over the whole table, as a row-by-row program would claim."""
    import random

    rng = random.Random(3)
    now = T0 + timedelta(hours=1)
    rows = []
    for i in range(80):
        status = rng.choice(["queued", "running", "running", "succeeded", "cancel_requested"])
        lease = T0 + timedelta(minutes=rng.choice([10, 60, 90])) if status in ("running", "cancel_requested") else None
        rows.append({"id": i, "status": status, "attempt": rng.randrange(4), "max_attempts": 3, "lease_owner": "old" if lease else None, "lease_expires_at": lease, "created_at": T0 + timedelta(seconds=rng.randrange(20)), "started_at": lease and T0, "finished_at": None, "error_json": None})
    schema = "id long, status string, attempt int, max_attempts int, lease_owner string, lease_expires_at timestamp_ntz, created_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, error_json string"
    for workers in (0, 1, 7, 200):
        table = {r["id"]: dict(r, claimed=False) for r in rows}
        for w in range(workers):
            for r in table.values():
                if r["status"] == "running" and r["lease_expires_at"] < now:
                    again = r["attempt"] < r["max_attempts"]
                    r.update(status="queued" if again else "failed", lease_owner=None, lease_expires_at=None, error_json=None if again else '{"code":"lease_expired"}', finished_at=None if again else now)
            waiting = sorted((r for r in table.values() if r["status"] == "queued"), key=lambda r: (r["created_at"], r["id"]))
            if waiting:
                waiting[0].update(status="running", lease_owner=f"w{w:03d}", lease_expires_at=now + timedelta(seconds=30), attempt=waiting[0]["attempt"] + 1, started_at=waiting[0]["started_at"] or now, claimed=True)
        claims = spark.createDataFrame([(w, f"w{w:03d}") for w in range(workers)], "seq long, worker string")
        got = {r["id"]: r.asDict() for r in jobs.claim(spark.createDataFrame([tuple(r.values()) for r in rows], schema), claims, now, 30).collect()}
        if workers:
            assert got == table
        assert sum(r["claimed"] for r in got.values()) == sum(r["claimed"] for r in table.values())
