import copy

from pyspark.sql import functions as F

from pagelathe.operators import manifest, pages, provider, regression
from pagelathe.operators.provider import InvalidPage, Limits
from pagelathe.sources.schemas import BLOCK, EVIDENCE

W, H = 595.0, 842.0
PAGE = f"page_no int, width double, height double, page struct<schema_version:int,page_no:int,page_kind:string,markdown:string,blocks:array<{BLOCK}>,evidence:array<{EVIDENCE}>,content_images:array<string>>"


def block(kind, content, n, latex=None):
    return {"kind": kind, "content": content, "latex": latex, "quote": content[:240], "order_no": n, "bbox": [50.0, 50.0 + 40 * n, 500.0, 80.0 + 40 * n], "confidence": 1.0, "source": "gold"}


#: Kinds of blocks of four pages of a mathematics text.
KINDS = [
    ["heading", "paragraph", "paragraph", "formula"], ["heading", "heading", "paragraph", "heading", "paragraph", "list", "formula"],
    ["heading", "paragraph", "table", "figure"], ["heading", "heading", "paragraph", "paragraph", "heading", "paragraph", "paragraph"],
]


def sample():
    out = []
    for no, kinds in enumerate(KINDS, 1):
        blocks = [block(k, "| a | b |\n|---|---|\n| 1 | 2 |" if k == "table" else f"{k} number {i} of page {no}", i, "x^2 + y" if k == "formula" else None) for i, k in enumerate(kinds)]
        first = blocks[0]
        evidence = [{"kind": "text_quote", "page_no": no, "quote": first["content"], "bbox": first["bbox"]}]
        out.append({"schema_version": 1, "page_no": no, "page_kind": "content", "markdown": "\n\n".join(b["content"] for b in blocks), "blocks": blocks, "evidence": evidence, "content_images": ["i1.png", "i2.png"] if no == 3 else []})
    return out


def frame(spark, facts):
    return spark.createDataFrame([(p["page_no"], W, H, p) for p in facts], PAGE)


def failing(spark, actual):
    checks = regression.compare_pages(frame(spark, sample()), frame(spark, actual), nfc_form=True)
    return {r["name"] for r in checks.filter("NOT passed").collect()}


def test_unchanged_pages_pass(spark):
    checks = regression.compare_pages(frame(spark, sample()), frame(spark, sample()))
    r = regression.report(checks).first()
    assert r["passed"] and r["n_failed"] == 0
    # Four fields and two counts a page; blocks: order, kind, content and two of the box (and formula or table); evidence: three and two.
    assert checks.count() == 4 * 6 + 22 * 5 + 2 + 1 + 4 * 5


def test_mutations_fail_by_name(spark):
    a = copy.deepcopy(sample())
    a[0]["markdown"] = a[0]["markdown"].replace("number", "mumber", 1)
    a[0]["blocks"][3]["latex"] = "x^3"
    assert failing(spark, a) == {"page-0001.markdown", "page-0001.block-04.latex"}
    a = copy.deepcopy(sample())
    a[2]["blocks"][2]["content"] = a[2]["blocks"][2]["content"].replace("2", "3")
    a[2]["evidence"][0]["bbox"] = [300.0, 400.0, 500.0, 500.0]
    assert failing(spark, a) == {"page-0003.block-03.content", "page-0003.block-03.table", "page-0003.evidence-01.bbox.iou"}
    a = copy.deepcopy(sample())
    a[3]["blocks"][0]["bbox"] = [-1.0, 50.0, 500.0, 80.0]
    assert failing(spark, a) == {"page-0004.block-01.bbox.bounds", "page-0004.block-01.bbox.iou"}
    a = copy.deepcopy(sample())
    a[1]["blocks"] = a[1]["blocks"][:-1]
    assert failing(spark, a) == {"page-0002.blocks.count"}
    assert failing(spark, sample()[:3]) == {"page-0004.json"}


def test_missing_image_and_tampered_manifest(spark):
    e = spark.createDataFrame([(3, 0, "h1"), (3, 1, "h2")], "page_no int, pos int, sha256 string")
    a = spark.createDataFrame([(3, 0, "h1"), (3, 1, None)], "page_no int, pos int, sha256 string")
    assert [r["name"] for r in regression.compare_images(e, a).filter("NOT passed").collect()] == ["page-0003.content-images.2"]
    entries = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    files = spark.createDataFrame([("a", "1"), ("b", "x")], "path string, sha256 string")
    assert [r["name"] for r in regression.compare_manifest(entries, files, [1], [1]).filter("NOT passed").collect()] == ["actual.manifest.integrity"]
    states = {r["path"]: r["state"] for r in manifest.verify(entries.union(spark.createDataFrame([("../c", "3"), ("d", "4")])), files).collect()}
    assert states == {"a": "ok", "b": "mismatch", "../c": "unsafe", "d": "missing"}


MODEL = f"struct<page_kind:string,markdown:string,blocks:array<{pages.MODEL_BLOCK}>>"
PARSED = f"run_id string, document_id string, page_no int, width double, height double, ink_ratio double, raw_text string, raw array<struct<text:string,bbox:array<double>>>, model {MODEL}, parser_error string"


def parsed(spark, **change):
    row = {"run_id": "r", "document_id": "d", "page_no": 1, "width": W, "height": H, "ink_ratio": 0.1, "raw_text": "native words", "raw": [("  native words  ", [1.0, 2.0, 3.0, 4.0]), (" ", None)], "model": None, "parser_error": None} | change
    df = spark.createDataFrame([tuple(row.values())], PARSED)
    return pages.page_facts(df.withColumn("native", pages.native_blocks(F.col("raw")))).first()


def test_page_facts(spark):
    m = ("content", "words", [(None, "native words and more", None, None, None, 0.0, None), (None, " ", None, None, None, None, None), ("formula", "z", "z", None, [0.0, 0.0, 500.0, 500.0], 0.9, "m")])
    r = parsed(spark, model=m)
    assert r["error"] is None and [b["order_no"] for b in r["blocks"]] == [0, 2]
    assert (r["blocks"][0]["kind"], r["blocks"][0]["confidence"], r["blocks"][0]["source"]) == ("paragraph", 0.5, "vision")
    assert r["blocks"][0]["bbox"] is None and r["blocks"][1]["bbox"] == [0.0, 0.0, 297.5, 421.0]
    assert r["evidence"][0]["quote"] == "native words" and r["evidence"][0]["bbox"] == [1.0, 2.0, 3.0, 4.0]
    assert r["quality"]["status"] == "needs_review" and r["quality"]["issues"] == []
    # The text layer stands in for a parser that failed; without one the page fails; almost no ink is a blank page.
    r = parsed(spark, parser_error="timeout")
    assert r["error"] is None and r["markdown"] == "native words" and r["blocks"][0]["source"] == "pymupdf" and r["quality"]["issues"] == [pages.DEGRADED + "timeout"]
    assert parsed(spark, raw_text="", raw=[], parser_error="timeout")["error"] == "timeout"
    r = parsed(spark, raw_text="", raw=[], model=("content", "", []), ink_ratio=0.001)
    assert (r["page_kind"], r["error"]) == ("blank", None) and r["evidence"][0]["kind"] == "page_image"
    assert parsed(spark, raw_text="", raw=[], model=("content", "", []))["error"] == "empty text"
    assert parsed(spark, raw_text="", raw=[], model=("odd", "text", []))["error"] == "no blocks"


def test_resume_calls_only_what_is_missing(spark):
    wanted = spark.createDataFrame([("r", 1), ("r", 2)], "run_id string, page_no int")
    done = spark.createDataFrame([("r", 1)], "run_id string, page_no int")
    assert [r["page_no"] for r in pages.pending_pages(wanted, done).collect()] == [2]


def test_provider_attempts_and_budget(spark, tmp_path):
    def parser(image, raw, page_no):
        if page_no == 1:
            return "ok"
        raise InvalidPage("nested", "text") if page_no == 2 else ValueError("no")

    df = spark.createDataFrame([("r", p, None, "") for p in (1, 2, 3)] + [("q", 4, None, "")], "run_id string, page_no int, image binary, raw_text string")
    made = spark.createDataFrame([("q", 9, 1, None, "x", "failed")], provider.ANSWERS)
    out = provider.call_in_rounds(df, made, parser, Limits(attempts=3, calls=5), str(tmp_path / "a")).filter("run_id = 'r'").unionByName(provider.call_in_rounds(df.filter("run_id = 'q'"), made, parser, Limits(calls=1), str(tmp_path / "b"))).collect()
    got = sorted((r["page_no"], r["attempt"], r["outcome"]) for r in out)
    assert got == [(1, 1, "ok"), (2, 1, "retry"), (2, 2, "retry"), (2, 3, "failed"), (3, 1, "failed"), (4, 1, "budget")]
    answers = spark.createDataFrame(out, provider.ANSWERS)
    assert provider.calls_made(answers).first()["model_calls"] == 5
    assert provider.final_answers(answers).filter("page_no = 2").first()["outcome"] == "failed"


def test_document_text_and_fanout(spark):
    df = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a")], "document_id string, page_no int, markdown string")
    assert pages.document_text(df, "document_id").first()["text"] == "## 第 1 页\n\na\n\n## 第 2 页\n\nb"


def test_replay_gives_the_same_manifest(spark):
    files = lambda run: spark.createDataFrame([(run, "pages/2.md", "h2", 5, "text/markdown"), (run, "pages/1.md", "h1", 4, "text/markdown")], "run_id string, path string, sha256 string, size_bytes long, mime_type string")
    assets = spark.createDataFrame([], "run_id string, kind string, path string, sha256 string, size_bytes long, mime_type string, metadata map<string,string>")
    runs = lambda run: spark.createDataFrame([(run, "d", [2, 1], "p")], "run_id string, document_hash string, page_numbers array<int>, provider string")
    made = [manifest.build_manifest(files(r), assets, runs(r)) for r in ("a", "b")]
    assert made[0].first()["files"][0]["path"] == "pages/1.md" and made[0].first()["page_numbers"] == [1, 2]
    assert len({manifest.manifest_hash(m).first()["manifest_hash"] for m in made}) == 1
