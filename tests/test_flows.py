import json

from pyspark.sql import functions as F
from test_pages import sample

from pagelathe.operators import pages, provider
from pagelathe.plans import flows

RASTER = "run_id string, document_id string, page_no int, width double, height double, ink_ratio double, raw_text string, raw array<struct<text:string,bbox:array<double>>>"


def raster(spark, n=3, run="r"):
    df = spark.createDataFrame([(run, "d", i, 595.0, 842.0, 0.1, f"words of page {i}", [(f"words of page {i}", [1.0, 2.0, 3.0, 4.0])]) for i in range(1, n + 1)], RASTER)
    return df.withColumn("native", pages.native_blocks(F.col("raw"))).withColumn("image", F.lit(None).cast("binary"))


def parser(image, raw, page_no):
    if page_no == 1:
        return json.dumps({"markdown": "1.1 Title\n\nBody", "odd": 1})
    if page_no == 2:
        return '```json\n{"page_kind": "content", "markdown": "a", "blocks": [{"kind": "formula", "content": "\\alpha"}]}\n```'
    return "no json"


def test_parse_resume_and_facts(spark):
    r = raster(spark)
    none = spark.createDataFrame([], "run_id string, page_no int")
    first = spark.createDataFrame(flows.parse_run(r, none, spark.createDataFrame([], provider.ANSWERS), parser, provider.Limits()).collect(), provider.ANSWERS)
    facts = {x["page_no"]: x for x in flows.page_facts(r, first).collect()}
    assert [b["kind"] for b in facts[1]["blocks"]] == ["heading", "paragraph"]
    assert facts[2]["blocks"][0]["content"] == "\\alpha"
    assert facts[3]["markdown"] == "words of page 3" and facts[3]["quality"]["issues"] and facts[3]["error"] is None
    read = {x["page_no"]: x for x in flows.read_answers(first).collect()}
    assert (read[1]["schema_tag"], read[2]["repaired"], read[3]["parser_error"]) == ("markdown_only", True, "page_kind")
    # Pages 1 and 2 are stored: only page 3 is asked for again, from what is left of the budget.
    done = spark.createDataFrame([("r", 1), ("r", 2)], "run_id string, page_no int")
    again = flows.parse_run(r, done, first, parser, provider.Limits(calls=4)).collect()
    assert [(x["page_no"], x["attempt"]) for x in again] == [(3, 1)]


def test_a_budget_of_60_reaches_60_pages(spark, tmp_path):
    none, no_answers = spark.createDataFrame([], "run_id string, page_no int"), spark.createDataFrame([], provider.ANSWERS)
    out = flows.parse_run(raster(spark, 70), none, no_answers, lambda image, raw, page_no: raw, provider.Limits(attempts=3, calls=60), str(tmp_path / "a")).collect()
    assert sorted((x["page_no"], x["outcome"]) for x in out) == [(p, "ok" if p <= 60 else "budget") for p in range(1, 71)]


def plain_rounds(pages, used, limits, outcome):
    """Rounds of one run: the first open pages get a call each while calls are left."""
    left, calls, done = limits.calls - used, dict.fromkeys(pages, 0), {}
    for _ in range(limits.attempts):
        todo = [p for p in sorted(pages) if p not in done][: max(0, left)]
        for p in todo:
            calls[p], left, got = calls[p] + 1, left - 1, outcome(p)
            if got != "retry" or calls[p] == limits.attempts:
                done[p] = "failed" if got == "retry" else got
    return sorted((p, calls[p], done.get(p, "budget")) for p in pages)


def test_rounds_by_brute_force(spark, tmp_path):
    kinds = ["ok", "retry", "failed", "ok", "retry"]
    outcome = lambda p: kinds[p * 7 % 5]

    def answer(image, raw, page_no):
        if outcome(page_no) == "retry":
            raise provider.Retryable("busy")
        if outcome(page_no) == "failed":
            raise ValueError("broken")
        return "{}"

    sizes = {f"r{i}": (3 * i + 1, i % 4) for i in range(9)}
    df = spark.createDataFrame([(r, p, None, "") for r, (n, _) in sizes.items() for p in range(1, n + 1)], "run_id string, page_no int, image binary, raw_text string")
    made = spark.createDataFrame([(r, k, 1, None, None, "ok") for r, (_, used) in sizes.items() for k in range(used)] + [("r3", 9, 1, None, None, "budget")], provider.ANSWERS)
    limits = provider.Limits(attempts=3, calls=11)
    want = sorted((r, *x) for r, (n, used) in sizes.items() for x in plain_rounds(range(1, n + 1), used, limits, outcome))

    def told(answers):
        rows = answers.groupBy("run_id", "page_no").agg(F.count_if(F.col("outcome") != "budget").alias("calls")).join(provider.final_answers(answers), ["run_id", "page_no"])
        return sorted((r["run_id"], r["page_no"], r["calls"], r["outcome"]) for r in rows.collect())

    assert told(provider.call_in_rounds(df, made, answer, limits, str(tmp_path / "whole"))) == want
    # Cut off behind its first round, a request goes on where it stood; done, it makes no call again.
    first = provider.call_parser(provider.grant(df.withColumn("attempt", F.lit(1)), made, limits), answer, limits)
    first.write.parquet(str(tmp_path / "cut"))
    assert told(provider.call_in_rounds(df, made, answer, limits, str(tmp_path / "cut"))) == want

    def never(image, raw, page_no):
        raise AssertionError(page_no)

    assert told(provider.call_in_rounds(df, made, never, limits, str(tmp_path / "cut"))) == want


def test_replay_is_stable(spark):
    frozen = spark.createDataFrame([("r", p["page_no"], json.dumps({k: p[k] for k in ("page_kind", "markdown", "blocks")})) for p in sample()], "run_id string, page_no int, response string")
    r = raster(spark, 4)
    one, two = (sorted(map(str, flows.page_facts(r, flows.replay(frozen)).collect())) for _ in range(2))
    assert one == two and len(one) == 4 and all("error=None" in x for x in one)


def test_extract_and_publish(spark):
    docs = spark.createDataFrame([("d", "r")], "id string, current_parse_run_id string")
    p = spark.createDataFrame([("d", "r", 1, "content", "accepted", "alpha"), ("d", "r", 2, "reference", "accepted", "list"), ("d", "r", 3, "content", "rejected", "no"), ("d", "q", 1, "content", "accepted", "old")], "document_id string, run_id string, page_no int, page_kind string, review_status string, markdown string")

    def extractor(text):
        assert text == "## 第 1 页\nalpha"
        return {"nodes": [{"title": "A", "evidence_quote": "alpha"}, {"title": "B"}], "edges": [{"source_title": "A", "target_title": "B", "relation": "DEFINES"}]}

    nodes, edges = flows.extract_candidates(docs, p, extractor, "x1")
    assert nodes.count() == 2 and edges.first()["relation"] == "DEFINES"
    done, flaws = flows.publish(nodes, edges)
    assert done.count() == 0 and flaws.count() == 2
    yes = lambda df: df.withColumn("review_status", F.lit("accepted"))
    runs = spark.createDataFrame([("x1", "d", "succeeded", 1), ("x0", "d", "succeeded", 0)], "id string, document_id string, status string, created_at int")
    n, e = flows.knowledge_snapshot(yes(nodes), yes(edges), runs)
    done, flaws = flows.publish(n, e)
    assert done.count() == 1 and flaws.count() == 0


def test_freeze_assess_compare(spark):
    r = spark.createDataFrame([("r1", "s1", "c", "l", "h", 2, "main", False, "parsed", None), ("r2", "s2", "c", "l", "h", 2, "x", True, "parsed", None), ("r3", "s3", "c", "l", "h", 2, "x", True, "failed", None)], "id string, snapshot_id string, case_id string, label string, document_hash string, model_calls int, branch string, dirty boolean, status string, artifact_state string")
    p = spark.createDataFrame([("r1", 1), ("r2", 1)], "run_id string, page_no int")
    a = spark.createDataFrame([(x, k, n) for x in ("r1", "r2") for k, n in (("parse_manifest", None), ("page_json", 1))], "run_id string, kind string, page_no int")
    cases = spark.createDataFrame([("h",)], "content_hash string")
    snaps, flaws = flows.freeze(r, p, a, cases)
    assert sorted(x["flaw"] for x in flaws.collect()) == ["no manifest", "no pages", "status"]
    facts = sample()
    from test_pages import PAGE

    page = PAGE.split("page struct")[1]
    sp = spark.createDataFrame([("s1", 1, facts[0]), ("s2", 1, {**facts[0], "markdown": "other"})], f"snapshot_id string, page_no int, page struct{page}")
    wanted = spark.createDataFrame([("c1", "s1", "s2"), ("c2", "s2", "s1")], "comparison_id string, baseline_id string, candidate_id string")
    out, refused = flows.compare(snaps, wanted, sp)
    assert out.first()["changed_dimensions"] == ["text"] and refused.first()["flaw"] == "baseline"
    entries = spark.createDataFrame([("a", "1")], "path string, sha256 string")
    images = spark.createDataFrame([("s1", 1)], "run_id string, page_no int")
    state, checks, status = flows.assess(entries, entries, sp.withColumnRenamed("snapshot_id", "run_id"), images)
    assert state.first()["state"] == "ok" and {x["run_id"]: x["execution_status"] for x in status.collect()} == {"s1": "complete", "s2": "incomplete"}
