"""Numbering, versioned tables, claims in micro-batches, leases that end on their own, pruning with a log."""

import json
import os
import random
import shutil
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from support import DATA

from pagelathe.operators import evaluate, knowledge, numbering, prune_log, provider
from pagelathe.operators.prune_log import PruneLog
from pagelathe.plans.queries import QUERIES
from pagelathe.plans.store_queries import PART, RUN
from pagelathe.sources import readers, sinks, versions
from pagelathe.sources.versions import VersionedTable
from pagelathe.streaming import claims, jobs, timers

T0 = datetime(2024, 1, 1)


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(40), f"x{i}") for i in range(300)] + [(None, "n")] * 3
    df = spark.createDataFrame(rows, "a int, b string").repartition(7)
    got = sorted((r["n"], r["a"], r["b"]) for r in numbering.number_rows(df, [F.desc("a"), "b"], "n", after=10).collect())
    assert [n for n, *_ in got] == list(range(11, 314))
    assert [x[1:] for x in got] == sorted(rows, key=lambda r: (-r[0] if r[0] is not None else 99, r[1]))
    assert numbering.number_rows(df.limit(0), ["a"]).count() == 0
    plan = numbering.number_rows(df, ["a"])._jdf.queryExecution().executedPlan().toString()
    # One window, over a row a range.
    assert plan.count("Window [") <= 2 and "windowspecdefinition(a" not in plan


# ------------------------------------------------------------------ versions

ROW = "id long, v string"


def rows_of(table):
    return sorted((r["id"], r["v"]) for r in table.read().collect())


def test_versions_by_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(VersionedTable, "FOLDERS", 3)
    t, want, rng = VersionedTable(spark, str(tmp_path / "t"), ROW), {}, random.Random(4)
    assert t.latest()[0] == -1 and rows_of(t) == []
    for version in range(-1, 9):
        new = {rng.randrange(12): f"{version}-{k}" for k in range(3)}
        gone = [k for k in range(12) if k not in new and rng.random() < 0.2]
        t.commit(version, spark.createDataFrame(list(new.items()), ROW), spark.createDataFrame([(k,) for k in gone], "id long") if gone else None)
        want = {k: v for k, v in (want | new).items() if k not in gone}
        assert rows_of(t) == sorted(want.items())
    assert t.latest()[0] == 9 and len(t.latest()[1]["folders"]) <= 3
    with pytest.raises(FileExistsError):
        t.commit(3, spark.createDataFrame([(1, "late")], ROW))
    assert rows_of(t) == sorted(want.items())


def test_rows_in_buckets_by_brute_force(spark, tmp_path, monkeypatch):
    """As without buckets, from another session's catalog too; what is put aside, put back and counted is not moved."""
    monkeypatch.setattr(VersionedTable, "FOLDERS", 4)
    schema, rng, want = "id long, run long, v string", random.Random(5), {}
    t = VersionedTable(spark, str(tmp_path / "t"), schema, near="run")
    for version in range(-1, 8):
        new = {k: f"{version}-{k}" for k in rng.sample(range(60), 25)}
        gone = [k for k in range(60) if k not in new and rng.random() < 0.2]
        t.commit(version, spark.createDataFrame([(k, k % 7, v) for k, v in new.items()], schema), spark.createDataFrame([(k, k % 7) for k in gone], "id long, run long"))
        want = {k: v for k, v in (want | new).items() if k not in gone}
        assert rows_of(t) == sorted(want.items())
        counts = {r["run"]: r["n"] for r in t.count_near(str(tmp_path / f"n{version}")).collect()}
        assert counts == {r: n for r in range(7) if (n := sum(k % 7 == r for k in want))}
    aside = str(tmp_path / "aside")
    t.put(spark.createDataFrame([(2,), (5,), (5,), (99,)], "id long"), aside)
    held = {k: v for k, v in want.items() if k % 7 in (2, 5)}
    assert sorted((r["id"], r["v"]) for r in t.got(aside).collect()) == sorted(held.items())
    for r in spark.catalog.listTables():
        if r.name.startswith("lying_"):
            spark.sql(f"DROP TABLE {r.name}")
    t = VersionedTable(spark, t.root, schema, near="run")
    t.commit_once("purge", True, lambda _: (None, t.got(aside)), dealt=True)
    assert rows_of(t) == sorted((want.items() - held.items()))
    anew = min(held)
    t.commit(t.latest()[0], spark.createDataFrame([(anew, anew % 7, "anew")], schema))
    plan = t._absent(aside, t.latest()[1])
    with t._by_near():
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert t.put_back_once("back", True, aside) and not t.put_back_once("back", True, aside)
    assert rows_of(t) == sorted((want | {anew: "anew"}).items())
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_of_two_writers_both_count(spark, tmp_path, monkeypatch):
    """Both read the same version; the one whose commit comes second makes it again."""
    t = VersionedTable(spark, str(tmp_path / "t"), ROW)
    t.commit(-1, spark.createDataFrame([(1, "")], ROW))
    gate, publish, tries = threading.Barrier(2), versions.publish, []

    def slow(*a):
        if len(tries) < 2:
            tries.append(1)
            gate.wait(60)
        publish(*a)

    monkeypatch.setattr(versions, "publish", slow)
    add = lambda name: t.commit_once(name, 1, lambda held: (held.withColumn("v", F.concat("v", F.lit(name))), None))
    both = [threading.Thread(target=add, args=(n,)) for n in "ab"]
    [x.start() for x in both]
    [x.join() for x in both]
    assert rows_of(t) in ([(1, "ab")], [(1, "ba")]) and t.latest()[0] == 2
    assert not add("a") and t.latest()[0] == 2


# -------------------------------------------------------------------- claims


def queue(spark, n):
    none = None
    return spark.createDataFrame([(i, "queued", 0, 3, none, none, T0 + timedelta(seconds=i % 7), none, none, none) for i in range(n)], claims.TABLE)


def claimers(spark, lo, hi, at):
    return spark.createDataFrame([(i, f"w{i}", T0 + timedelta(minutes=at)) for i in range(lo, hi)], "seq long, worker string, ts timestamp_ntz")


def held(table):
    return {r["id"]: (r["status"], r["attempt"], r["lease_owner"]) for r in table.read().collect()}


def test_a_repeated_batch_claims_nothing_twice(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), claims.TABLE)
    t.commit(-1, queue(spark, 20))
    assert claims.claim_batch(t, claimers(spark, 0, 5, 0), 0, "q")
    once = held(t)
    oldest = sorted(range(20), key=lambda i: (i % 7, i))
    assert {i: x for i, x in once.items() if x[0] == "running"} == {i: ("running", 1, f"w{n}") for n, i in enumerate(oldest[:5])}
    assert not claims.claim_batch(t, claimers(spark, 0, 5, 0), 0, "q") and held(t) == once
    assert not claims.claim_batch(t, claimers(spark, 0, 0, 0), 1, "q")
    # Another query has batches of its own; leases of the first have run out by then, and go to the front again.
    assert claims.claim_batch(t, claimers(spark, 7, 8, 10), 0, "other")
    again = held(t)
    assert again[oldest[0]] == ("running", 2, "w7") and again[oldest[1]] == ("queued", 1, None)
    # Only what changed is written.
    last = t.latest()[1]["folders"][-1]
    assert spark.read.parquet(f"{tmp_path}/t/data/{last}").count() == 5


def test_claims_of_a_stream(spark, tmp_path):
    """A stream that lost its checkpoint behind the table's commit applies the batch once all the same."""
    t = VersionedTable(spark, str(tmp_path / "t"), claims.TABLE)
    t.commit(-1, queue(spark, 9))
    source = str(tmp_path / "in")
    claimers(spark, 0, 2, 0).coalesce(1).write.json(source)
    stream = lambda: readers.stream_events(spark, source, "seq long, worker string, ts timestamp_ntz")
    claims.start(stream(), t, str(tmp_path / "c1"), "q", 3600).awaitTermination()
    one = held(t)
    claims.start(stream(), t, str(tmp_path / "c2"), "q", 3600).awaitTermination()
    assert held(t) == one and sum(x[0] == "running" for x in one.values()) == 2
    claimers(spark, 2, 4, 1).coalesce(1).write.mode("append").json(source)
    claims.start(stream(), t, str(tmp_path / "c1"), "q", 3600).awaitTermination()
    assert sum(x[0] == "running" for x in held(t).values()) == 4 and all(held(t)[i] == x for i, x in one.items() if x[0] == "running")


# -------------------------------------------------------------------- timers


def event(seq, key, at, name, **more):
    base = {"queue_key": key, "seq": seq, "ts": T0 + timedelta(seconds=at), "event": name, "job_id": None, "worker": "w", "lease_seconds": 60, "retryable": True, "progress_current": None, "progress_total": None, "max_attempts": 2}
    return base | more


def test_a_lease_ends_without_an_event(spark, tmp_path):
    """The outcomes are the batch fold's, with a tick at the moment that each lease ends."""
    batches = [
        [event(1, "k", 0, "enqueue", job_id="a"), event(2, "k", 1, "claim"), event(3, "m", 2, "enqueue", job_id="b"), event(4, "m", 3, "claim", lease_seconds=1000)],
        [event(5, "other", 90, "enqueue", job_id="c")],
        [event(6, "other", 95, "tick")],
        [event(7, "k", 100, "claim", worker="v"), event(8, "m", 101, "heartbeat", lease_seconds=1000)],
        [event(9, "other", 300, "tick")],
        [event(10, "other", 301, "tick")],
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    old = {k: spark.conf.get(k, None) for k in timers.ROCKSDB}
    try:
        with pytest.raises(ValueError):
            spark.conf.unset(next(iter(timers.ROCKSDB)))
            timers.stream(spark.createDataFrame([], jobs.EVENT))
        for k, v in timers.ROCKSDB.items():
            spark.conf.set(k, v)
        for batch in batches:
            spark.createDataFrame(batch, jobs.EVENT).coalesce(1).write.mode("append").json(source)
            q = timers.stream(readers.stream_events(spark, source, jobs.EVENT)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c"))
            q.foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = sorted((r["queue_key"], r["event"], r["job_id"], r["status"], r["attempt"], r["lease_owner"]) for r in spark.read.parquet(out).collect())
    ends = [r for r in got if r[1] == "lease_end"]
    assert ends == [("k", "lease_end", "a", "failed", 2, None), ("k", "lease_end", "a", "queued", 1, None)]
    ticks = [event(2.5, "k", 61.001, "tick"), event(7.5, "k", 160.001, "tick")]
    every = sorted([e for b in batches for e in b] + ticks, key=lambda e: e["seq"])
    folded = spark.createDataFrame([e | {"seq": n} for n, e in enumerate(every)], jobs.EVENT)
    rows = jobs.fold(folded).filter("NOT (event = 'tick' AND queue_key = 'k')").collect()
    assert sorted((r["queue_key"], r["event"], r["job_id"], r["status"], r["attempt"], r["lease_owner"]) for r in rows) == [r for r in got if r[1] != "lease_end"]


def test_job_fold_by_brute_force(spark):
    """Every row of the registered query, by stepping through the events of each key in plain Python."""
    kinds = ("enqueue", "claim", "heartbeat", "fail", "complete", "cancel", "tick")
    want, state = [], {}
    for r in sorted(spark.read.parquet(f"{DATA}/events.parquet").collect(), key=lambda r: r["event_id"]):
        n, key = r["event_id"], str(r["user_id"])
        e = jobs.Event(n, r["ts"], kinds[n % 7], f"j{n}" if n % 7 == 0 else None, "w1", 3600, n % 2 == 0, 1, 2, 3)
        state[key], job, ok, detail = jobs.step(state.get(key, {}), e)
        want.append((key, n, e.event, job.job_id if job else e.job_id, ok, detail, job.status if job else None, job.attempt if job else None, job.lease_owner if job else None))
    assert sorted(map(tuple, QUERIES["job_fold"](spark, DATA).collect())) == sorted(want)


# --------------------------------------------------------------------- pruning


def at(spark, root, near=None):
    return PruneLog(spark, f"{root}/log", *(VersionedTable(spark, f"{root}/{n}", s, near=by) for n, s, by in (("runs", RUN, None), ("pages", PART, near), ("artifacts", PART, near))))


def tables(spark, root, near=None):
    log = at(spark, root, near)
    runs, pages, parts = log.runs, log.pages, log.artifacts
    runs.commit(-1, spark.createDataFrame([(i, 1, "parsed", "available", None) for i in range(4)], RUN))
    each = [(f"{i}-{p}", i, "needs_review", p, "page", "h", 10 + p) for i in range(4) for p in range(3)]
    pages.commit(-1, spark.createDataFrame(each, PART))
    parts.commit(-1, spark.createDataFrame(each, PART))
    return log


def plan(spark):
    return spark.createDataFrame([(0, 1, None, 33), (1, 2, None, 33), (2, 3, "kept", 0)], "pos long, id long, refusal string, reclaimable_bytes long")


def look(log):
    runs = {r["id"]: (r["artifact_state"], json.loads(r["prune_summary"]) if r["prune_summary"] else None) for r in log.runs.read().collect()}
    return runs, sorted(r["id"] for r in log.pages.read().collect()), sorted(r["id"] for r in log.artifacts.read().collect())


class Stop(BaseException):
    pass


def test_prune_and_roll_back(spark, tmp_path):
    log = tables(spark, str(tmp_path))
    before = look(log)
    told = log.plan("op1", plan(spark), "doc", "0")
    assert (told["state"], told["runs"], told["bytes"]) == ("planned", 2, 66) and look(log) == before
    for wrong in (("op1", "other", "0"), ("op1", "doc", "9")):
        with pytest.raises(ValueError):
            log.run(*wrong)
    for bad in ("", "a/b", ".x", "_y"):
        with pytest.raises(ValueError):
            log.record(bad)
    with pytest.raises(KeyError):
        log.run("none", "doc", "0")
    with pytest.raises(FileExistsError):
        log.plan("op1", plan(spark), "doc", "0")
    assert log.run("op1", "doc", "0") == "purged" and log.operations() == ["op1"]
    runs, pages, parts = look(log)
    assert pages == parts == [f"{i}-{p}" for i in (0, 3) for p in range(3)]
    assert [runs[i][0] for i in range(4)] == ["available", "pruned", "pruned", "available"] and runs[1][1]["page_count"] == 3 and runs[1][1]["artifact_bytes"] == 33
    assert log.run("op1", "doc", "0") == "purged" and look(log) == (runs, pages, parts)
    assert log.roll_back("op1", "doc", "0") == "rolled_back" and look(log) == before
    assert log.run("op1", "doc", "0") == "rolled_back" and look(log) == before
    log.plan("op2", plan(spark), "doc", "0")
    assert log.roll_back("op2", "doc", "0") == "rolled_back" and look(log) == before


def test_prune_and_roll_back_in_buckets(spark, tmp_path):
    """As without them, with pages that come between the backup and the purge, and others behind it."""
    looks = []
    for near in (None, "run_id"):
        log = tables(spark, str(tmp_path / str(near)), near)
        before = look(log)
        log.plan("op1", plan(spark), "doc", "0")
        log._stage("op1")
        extra = lambda name: spark.createDataFrame([(name, 1, "needs_review", 9, "page", "h", 1)], PART)  # noqa: E731, B023
        log.pages.commit(log.pages.latest()[0], extra("between"))
        assert log.run("op1", "doc", "0") == "purged"
        log.pages.commit(log.pages.latest()[0], extra("1-2"))
        looks.append(look(log))
        assert log.roll_back("op1", "doc", "0") == "rolled_back"
        looks.append(look(log))
        assert looks[-1][0] == before[0] and looks[-1][1] == sorted([*before[1], "between"]) and looks[-1][2] == before[2]
    assert looks[:2] == looks[2:]


def test_a_stop_after_every_step_recovers(spark, tmp_path, monkeypatch):
    """Stopped ahead of, and right behind, the k-th thing that is published (records and versions of tables alike)."""
    pub = prune_log.publish
    base = tables(spark, str(tmp_path / "False"))
    before = look(base)
    base.plan("op", plan(spark), "doc", "0")
    shutil.copytree(tmp_path / "False", tmp_path / "True")
    done = at(spark, str(tmp_path / "True"))
    done.run("op", "doc", "0")
    purged = look(done)
    for back in (False, True):
        k = 0
        while True:
            # Ready to be purged, or purged already.
            shutil.copytree(tmp_path / str(back), tmp_path / f"{back}{k}")
            log = at(spark, str(tmp_path / f"{back}{k}"))
            seen = []

            def stopping(*a, k=k, seen=seen):
                seen.append(a)
                if len(seen) - 1 == k // 2:
                    if k % 2:
                        pub(*a)
                    raise Stop
                pub(*a)

            monkeypatch.setattr(prune_log, "publish", stopping)
            monkeypatch.setattr(versions, "publish", stopping)
            stopped = False
            try:
                log.roll_back("op", "doc", "0") if back else log.run("op", "doc", "0")
            except Stop:
                stopped = True
            monkeypatch.setattr(prune_log, "publish", pub)
            monkeypatch.setattr(versions, "publish", pub)
            fresh = PruneLog(spark, log.root, log.runs, log.pages, log.artifacts)
            asked = fresh.record("op", "rolling") is not None
            assert fresh.recover("op") == ("rolled_back" if asked else "purged")
            assert look(fresh) == (before if asked else purged)
            if not stopped:
                break
            k += 1
        assert k >= 10


# ----------------------------------------------------------------------- sinks


def test_sinks(spark, tmp_path):
    answers = spark.createDataFrame([("r", 1, 1, "text", "bad", "retry"), ("r", 1, 2, "{}", None, "ok"), ("q", 2, 1, None, "gone", "failed"), ("q", 3, 1, None, "call budget", "budget")], "run_id string, page_no int, attempt int, response string, error string, outcome string")
    sinks.write_failures(answers, str(tmp_path / "f"))
    kept = spark.read.json(str(tmp_path / "f"))
    assert sorted((r["run_id"], r["page_no"], r["attempt"], r["response"], r["error"]) for r in kept.collect()) == [("q", 2, 1, None, "gone"), ("r", 1, 1, "text", "bad")]
    for run in ("a", "b"):
        sinks.append_rows(spark.createDataFrame([(1,), (2,)], "n int"), str(tmp_path / "rows"), run_id=run, version=1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "rows")).collect())) == [(n, run, 1) for n in (1, 2) for run in ("a", "b")]
    for score in (1, 2):
        sinks.write_report(spark.createDataFrame([("r", score)], "report_id string, score int"), str(tmp_path / "rep"))
    (r,) = spark.read.parquet(str(tmp_path / "rep")).collect()
    assert json.loads(r["json"]) == {"report_id": "r", "score": 2}
    assert os.path.isdir(tmp_path / "f" / "run_id=q")


def test_contracts_waits_and_releases(spark):
    manifest = {"document_hash": "h", "page_start": 3, "page_end": 12, "model": "m", "params": {"t": 0}}
    run = manifest | {"budget": 30}
    assert evaluate.run_contract_flaws(manifest, run, 60, 3) == [] and evaluate.run_contract_flaws(manifest, run | {"budget": 20}, 20, 3) == []
    assert evaluate.run_contract_flaws(manifest, run | {"model": "n", "page_end": 9, "budget": 60}, 60, 3) == ["page_end", "model", "budget"]
    assert [provider.is_retryable_status(s) for s in (None, 429, 500, 503, 400, 404, 200)] == [True, True, True, True, False, False, False]
    assert [provider.backoff_seconds(1.5, n) for n in range(3)] == [1.5, 3.0, 6.0]
    rows = [("d", "published", 1, "a"), ("d", "published", 2, "b"), ("d", "published", 2, "c"), ("d", "withdrawn", 9, "z"), ("e", "withdrawn", 1, "y")]
    got = knowledge.newest_release(spark.createDataFrame(rows, "document_id string, status string, created_at int, id string"))
    assert [r["id"] for r in got.collect()] == ["c"]
