import pytest
from pyspark.sql import functions as F

from pagelathe.operators import evaluate, knowledge, maintenance, reviews, runs
from pagelathe.sources import readers, sinks, workbook
from pagelathe.sources.schemas import EVIDENCE

BLOCK = "kind:string,content:string,latex:string,quote:string,order_no:int,bbox:array<double>,confidence:double,source:string"
PAGE = f"struct<markdown:string,page_kind:string,blocks:array<struct<{BLOCK}>>,evidence:array<{EVIDENCE}>,content_images:array<string>>"


def fact(text="Text", formula="x", n=1):
    blocks = [("paragraph", text, None, text, 0, None, 1.0, "v"), ("formula", formula, formula, formula, 1, None, 1.0, "v")]
    return (f"{text}\n\n${formula}$", "content", blocks, [("text_quote", n, text, [1.0, 1.0, 2.0, 2.0])], [])


def side(spark, *pages):
    return spark.createDataFrame([("c", n, p) for n, p in pages], f"comparison_id string, page_no int, page {PAGE}")


def test_compare_pages(spark):
    b = side(spark, (1, fact()), (2, fact(n=2)))
    c = side(spark, (1, fact("Other", "y")), (2, fact(n=2)))
    wanted = spark.createDataFrame([("c", 1), ("c", 2), ("c", 3)], "comparison_id string, page_no int")
    out = {r["page_no"]: r for r in evaluate.compare_pages(wanted, b, c, nfc_form=True).collect()}
    assert {"text", "formulas"} <= set(out[1]["changed_dimensions"]) and out[1]["review_status"] == "pending"
    assert "-Text" in out[1]["text_diff"] and "+Other" in out[1]["text_diff"]
    assert out[2]["changed"] is False and out[2]["review_status"] == "not_required"
    assert out[3]["changed_dimensions"] == ["availability"]
    compared = evaluate.compare_pages(wanted.filter("page_no < 3"), b, c)
    none = spark.createDataFrame([], "comparison_id string, page_no int, verdict string, seq int")
    assert evaluate.comparison_conclusion(compared, none).first()["conclusion"] == "review_required"
    done = spark.createDataFrame([("c", 1, "needs_review", 1), ("c", 1, "equivalent", 2)], "comparison_id string, page_no int, verdict string, seq int")
    assert evaluate.comparison_conclusion(compared, done).first()["conclusion"] == "changed"
    same = evaluate.compare_pages(wanted.filter("page_no = 2"), b, c)
    assert evaluate.comparison_conclusion(same, none).first()["conclusion"] == "no_regression_detected"


def snapshot(i, eligible=True, pages=(1, 2), h="h"):
    return (i, eligible, h, list(pages))


@pytest.mark.parametrize(
    ("b", "c", "flaw"),
    [(snapshot("a"), snapshot("b"), None), (snapshot("a"), snapshot("a"), "same snapshot"), (snapshot("a", False), snapshot("b"), "baseline"), (snapshot("a"), snapshot("b", pages=(2, 1)), "pages"), (snapshot("a"), snapshot("b", h="x"), "document")],
)
def test_compare_guards(spark, b, c, flaw):
    s = "struct<snapshot_id:string,baseline_eligible:boolean,document_hash:string,page_numbers:array<int>>"
    assert spark.createDataFrame([(b, c)], f"b {s}, c {s}").select(evaluate.compare_flaw().alias("f")).first()["f"] == flaw


def test_snapshots(spark):
    r = spark.createDataFrame([("r1", "s1", "k", "l", "h", 2, "main", False), ("r2", "s2", "k", "l", "h", 2, "main", True)], "id string, snapshot_id string, case_id string, label string, document_hash string, model_calls int, branch string, dirty boolean")
    p = spark.createDataFrame([("r1", 2), ("r1", 1), ("r2", 1)], "run_id string, page_no int")
    out = {x["snapshot_id"]: x for x in evaluate.snapshot_rows(r, p).collect()}
    assert out["s1"]["baseline_eligible"] and not out["s2"]["baseline_eligible"] and out["s1"]["page_numbers"] == [1, 2]


REVIEW = "assessment_id string, page_no int, verdict string, scores map<string,int>, critical_errors array<string>, seq int"
ASSESS = "assessment_id string, profile string, pages array<int>, minimum_average double"


def card(spark, profile, pages, *rows):
    return evaluate.scorecard(spark.createDataFrame([("a", profile, pages, 1.5)], ASSESS), spark.createDataFrame(list(rows), REVIEW)).first()


def test_scorecard(spark):
    assert card(spark, "engineering_chain", [1, 2], ("a", 1, "pass", None, None, 1))["pending_review_pages"] == [2]
    assert card(spark, "engineering_chain", [1, 2], ("a", 1, "pass", None, None, 1), ("a", 2, "pass", None, None, 2), ("a", 2, "failed", None, None, 3))["quality_status"] == "failed"
    r = card(spark, "formal_scorecard", [1], ("a", 1, "pass", {"text": 2, "formula": 0, "source_evidence": 2}, [], 1))
    assert (r["quality_status"], r["critical_failures"], r["average_score"]) == ("failed", ["page-1: formula=0"], 1.333)
    assert card(spark, "formal_scorecard", [1], ("a", 1, "pass", {"text": 1, "source_evidence": 2}, None, 1))["quality_status"] == "passed"
    assert card(spark, "formal_scorecard", [1], ("a", 1, "needs_review", {"text": 2, "source_evidence": 2}, None, 1))["quality_status"] == "review_required"


def test_rounding_is_pythons(spark):
    values = [2.6675, 0.0005, 1.0005, 2.5, 1 / 3]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", evaluate.python_round(F.col("x"), 3).alias("y"))
    assert all(r["y"] == round(r["x"], 3) for r in df.collect())


def test_assessment_manifests():
    good = {"profile": "engineering_chain", "experiment_id": "e", "budget": {"max_model_calls": 4}, "manual_review": {"pages": [1], "criteria": ["clear"]}}
    assert evaluate.read_assessment(good, [1, 2], 3).pages == [1]
    for change in ({"profile": "x"}, {"experiment_id": " "}, {"budget": {"max_model_calls": 2}}, {"manual_review": {"pages": [1, 1], "criteria": ["c"]}}, {"manual_review": {"pages": [9], "criteria": ["c"]}}, {"manual_review": {"pages": [1], "criteria": [" "]}}):
        with pytest.raises(ValueError):
            evaluate.read_assessment(good | change, [1, 2], 3)
    formal = {"profile": "formal_scorecard", "experiment_id": "e", "budget": {"max_model_calls": 36}, "pages": [{"page_no": i, "dimensions": ["text", "source_evidence"]} for i in range(1, 13)]}
    assert evaluate.read_assessment(formal, list(range(1, 20)), 3).minimum_average == 1.5
    with pytest.raises(ValueError):
        evaluate.read_assessment(formal | {"pages": formal["pages"][:11]}, list(range(1, 20)), 3)
    with pytest.raises(ValueError):
        evaluate.read_assessment(formal | {"budget": {"max_model_calls": 37}}, list(range(1, 20)), 3)


def test_report_markdown(spark):
    r = spark.createDataFrame([("c", "changed")], "comparison_id string, conclusion string")
    v = spark.createDataFrame([("c", 2, "equivalent", "same"), ("c", 1, "needs_review", None)], "comparison_id string, page_no int, verdict string, reason string")
    text = evaluate.report_markdown(r, v, "Comparison", {"Conclusion": "conclusion"}, "comparison_id").first()["markdown"]
    assert text.startswith("# Comparison\n\n- Conclusion: `changed`\n") and text.index("Page 1") < text.index("Page 2")


def graph(spark):
    ev = [("text_quote", 1, "q", None)]
    nodes = spark.createDataFrame([("n1", "d", "concept", "A", "", ev, "accepted"), ("n2", "d", "concept", "B", "", ev, "accepted")], f"id string, document_id string, kind string, title string, content string, evidence array<{EVIDENCE}>, review_status string")
    edges = spark.createDataFrame([("e1", "d", "n1", "n2", "DEFINES", ev, "accepted")], f"id string, document_id string, source_id string, target_id string, relation string, evidence array<{EVIDENCE}>, review_status string")
    return nodes, edges


def test_extraction_to_release(spark):
    pages = spark.createDataFrame([("d", 1, "alpha words"), ("d", 2, "beta words")], "document_id string, page_no int, markdown string")
    found = [{"title": " A ", "evidence_quote": "beta"}, {"title": "B", "kind": "theorem", "evidence_quote": "nowhere"}, {"title": "A", "content": "again"}, {"title": ""}]
    x = [("d", [(n.get("kind"), n["title"], n.get("content"), n.get("evidence_quote")) for n in found], [("A", "B", "DEFINES", ""), ("A", "Z", "USES", ""), ("B", "A", "ODD", "alpha")])]
    df = spark.createDataFrame(x, "document_id string, nodes array<struct<kind:string,title:string,content:string,evidence_quote:string>>, edges array<struct<source_title:string,target_title:string,relation:string,evidence_quote:string>>")
    nodes, edges = knowledge.candidates_of(df, pages, "run")
    got = {r["title"]: r for r in nodes.collect()}
    assert set(got) == {"A", "B"} and got["A"]["evidence"][0]["page_no"] == 2 and got["A"]["kind"] == "concept"
    assert (got["B"]["evidence"][0]["kind"], got["B"]["evidence"][0]["page_no"], got["B"]["evidence"][0]["quote"]) == ("page_context", 1, "nowhere")
    assert sorted(r["relation"] for r in edges.collect()) == ["DEFINES", "RELATED_TO"]
    assert knowledge.publish_flaws(nodes, edges).count() == 2
    n, e = graph(spark)
    assert knowledge.publish_flaws(n, e).count() == 0
    assert '"relation":"DEFINES"' in knowledge.release(n, e).first()["snapshot_json"]
    assert knowledge.dangling_edges(n.filter("id = 'n1'"), e).count() == 1


def test_workbook_round_trip(spark, tmp_path):
    n, e = graph(spark)
    path = tmp_path / "draft.xlsx"
    path.write_bytes(workbook.export_workbook("d", n, e))
    spark.dataSource.register(workbook.WorkbookSource)
    for rows in (spark.read.format("workbook").load(f"file://{path}"), workbook.read_workbooks(spark, str(tmp_path))):
        nodes, edges, errors = workbook.import_workbook(rows, "d")
        assert errors.count() == 0
        assert sorted(map(tuple, nodes.select("id", "title", "review_status").collect())) == [("n1", "A", "accepted"), ("n2", "B", "accepted")]
        assert edges.first()["relation"] == "DEFINES" and edges.first()["evidence"][0]["page_no"] == 1
    assert [r["error"] for r in workbook.import_workbook(rows, "other")[2].collect()] == ["document_id"]
    bad = workbook.render({"documents": [["document_id"], ["d"]], "knowledge_nodes": [["id"], ["n", None, " ", None, "[]", "odd"]], "knowledge_edges": [["id"], ["e", "n", "zz", "BAD", '[{"page_no": 1}]']], "sections": [["page_no"]]})
    sheets = workbook.parse(bad)
    df = spark.createDataFrame([(s, i, r) for s, rs in sheets.items() for i, r in enumerate(rs)], "sheet string, row_no int, cells array<string>")
    assert sorted(r["error"] for r in workbook.import_workbook(df, "d")[2].collect()) == ["endpoint", "evidence", "missing sheet", "relation", "review_status", "title"]


def test_reviews(spark):
    targets = spark.createDataFrame([("p", "needs_review", ""), ("q", "needs_review", "")], "id string, review_status string, review_reason string")
    log = spark.createDataFrame([], "target_type string, target_id string, status string, reason string, seq long")
    new = spark.createDataFrame([("page", "p", "accepted", "a", 1), ("page", "p", "rejected", None, 2), ("node", "q", "accepted", "x", 3)], "target_type string, target_id string, status string, reason string, place int")
    log = reviews.append_review(log, new)
    assert [r["seq"] for r in log.orderBy("seq").collect()] == [1, 2, 3]
    assert {r["id"]: r["review_status"] for r in reviews.current_state(targets, log, "page").collect()} == {"p": "rejected", "q": "needs_review"}


def test_prune_stage_and_roll_back(spark):
    r = spark.createDataFrame([("r1", "d", "parsed", None, None), ("r2", "d", "parsed", None, None)], "id string, document_id string, status string, artifact_state string, prune_summary string")
    p = spark.createDataFrame([("p1", "r1", 1, "accepted"), ("p2", "r2", 1, "rejected")], "id string, run_id string, page_no int, review_status string")
    a = spark.createDataFrame([(f"a{i}", "r1", "parse_manifest" if i == 0 else "page_json", "h", 10) for i in range(5)], "id string, run_id string, kind string, content_hash string, size_bytes long")
    hit = spark.createDataFrame([("r1",)], "id string")
    staged, gone_p, gone_a = maintenance.stage_prune(hit, r, p, a)
    assert gone_p.count() == 1 and gone_a.count() == 5
    docs = spark.createDataFrame([("d", "r2")], "id string, current_parse_run_id string")
    s = runs.run_summaries(staged.withColumn("created_at", F.lit(1)), docs, maintenance.drop_rows(p, gone_p), maintenance.drop_rows(a, gone_a)).filter("id = 'r1'").first()
    assert (s["page_count"], s["artifact_count"], s["artifact_bytes"], s["manifest_hash"], s["is_current"]) == (1, 5, 50, "h", False)
    back, pages = maintenance.roll_back(staged, hit, maintenance.drop_rows(p, gone_p), gone_p)
    assert pages.count() == 2 and back.filter("id = 'r1'").first()["artifact_state"] == "available"


def test_recover_and_select(spark):
    r = spark.createDataFrame([("r1", "d", "parsing"), ("r2", "e", "parsed")], "id string, document_id string, status string")
    d = spark.createDataFrame([("d", "parsing"), ("e", "needs_review")], "id string, status string")
    got_r, got_d = runs.recover_interrupted(r, d)
    assert {x["id"]: x["status"] for x in got_r.collect()} == {"r1": "interrupted", "r2": "parsed"}
    assert {x["id"]: x["status"] for x in got_d.collect()} == {"d": "failed", "e": "needs_review"}
    t = spark.createDataFrame([("1", "b"), ("2", "A"), ("3", "é"), ("4", "a")], "id string, title string")
    assert [x["title"] for x in runs.by_title(t).collect()] == ["A", "a", "b", "é"]


def test_sinks_and_readers(spark, tmp_path):
    log = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, v string")
    sinks.append_events(log, str(tmp_path / "log"))
    sinks.append_events(log, str(tmp_path / "log"))
    assert readers.read_events(spark, str(tmp_path / "log"), "seq long, v string").count() == 4
    sinks.write_snapshot(log, str(tmp_path / "snap"), "s1")
    with pytest.raises(Exception, match="already exists"):
        sinks.write_snapshot(log, str(tmp_path / "snap"), "s1")
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"schema_version": 1, "x": "y"}')
    (tmp_path / "j" / "b.json").write_text('{"schema_version": 3, "x": "z"}')
    schema = "schema_version int, x string"
    assert [r["x"] for r in readers.list_resources(spark, str(tmp_path / "j"), schema).collect()] == ["y", "z"]
    with pytest.raises(Exception, match="unsupported schema version"):
        readers.read_json(spark, str(tmp_path / "j"), schema, version=1).collect()
    (tmp_path / "j" / "c.json").write_text("{broken")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        readers.read_json(spark, str(tmp_path / "j"), schema).collect()
