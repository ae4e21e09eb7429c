"""Workbooks of five sheets as an XLSX source and sink, over zip and XML only."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagelathe.functions.text import or_default, strip
from pagelathe.sources.schemas import EVIDENCE, RELATIONS, REVIEW_STATES

#: Sheets and headers.
SHEETS = {
    "documents": ["document_id"],
    "knowledge_nodes": ["id", "kind", "title", "content", "evidence_json", "review_status"],
    "knowledge_edges": ["id", "source_id", "target_id", "relation", "evidence_json", "review_status"],
    "sections": ["page_no", "title"],
    "review_notes": ["target_id", "note"],
}
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _letters(i: int) -> str:
    return (_letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


def parse(content: bytes) -> dict[str, list[list[str | None]]]:
    """Sheet name to rows of cell texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{MAIN}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet"):
            target = targets[sheet.get(f"{{{REL}}}id")]
            rows = []
            for row in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{{{MAIN}}}row"):
                cells: list[str | None] = []
                for c in row.iter(f"{{{MAIN}}}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    v, kind = c.find(f"{{{MAIN}}}v"), c.get("t")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{{{MAIN}}}t"))
                    elif v is not None:
                        cells[at] = shared[int(v.text)] if kind == "s" else v.text
                rows.append(cells)
            out[sheet.get("name")] = rows
        return out


def render(sheets: dict[str, list[list[str | None]]]) -> bytes:
    """An XLSX file of text cells."""
    names = list(sheets)

    def sheet(rows: list[list[str | None]]) -> str:
        body = "".join(
            f'<row r="{i}">' + "".join(f'<c r="{_letters(j)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for j, v in enumerate(row) if v is not None) + "</row>"
            for i, row in enumerate(rows, 1)
        )
        return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>'

    form = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{form}.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{form}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        + "</Types>",
        "_rels/.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>",
    }
    parts |= {f"xl/worksheets/sheet{i}.xml": sheet(sheets[n]) for i, n in enumerate(names, 1)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.sheet = options["path"], options.get("sheet")

    def partitions(self):
        return [InputPartition(self.path)]

    def read(self, partition):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(partition.value)
        with where.open_input_stream(path) as f:
            for sheet, rows in parse(f.read()).items():
                if self.sheet in (None, sheet):
                    for i, row in enumerate(rows):
                        yield sheet, i, row


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").load(path)``: sheet, row_no (0: header), cells."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "sheet string, row_no int, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Many workbooks at once, through Spark's own file reader: path, sheet, row_no, cells."""

    def cells(batches):
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(p, s, i, r) for s, rs in parse(content).items() for i, r in enumerate(rs)]
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.string()))], names=["path", "sheet", "row_no", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInArrow(cells, "path string, sheet string, row_no int, cells array<string>")


def import_workbook(rows: DataFrame, document_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows of one workbook (sheet, row_no, cells) to nodes, edges and errors; all or nothing: use nodes and edges only where errors is empty."""
    cell = lambda i: F.get("cells", F.lit(i))
    evidence = F.from_json(or_default(cell(4), "[]"), f"array<{EVIDENCE}>")
    base = F.col("row_no") > 0
    filled = base & (F.coalesce(cell(0), F.lit("")) != "")
    nodes = rows.filter((F.col("sheet") == "knowledge_nodes") & filled).select(
        cell(0).alias("id"), or_default(cell(1), "concept").alias("kind"), strip(F.coalesce(cell(2), F.lit(""))).alias("title"), F.coalesce(cell(3), F.lit("")).alias("content"), evidence.alias("evidence"), or_default(cell(5), "accepted").alias("review_status")
    )
    edges = rows.filter((F.col("sheet") == "knowledge_edges") & filled).select(
        cell(0).alias("id"), cell(1).alias("source_id"), cell(2).alias("target_id"), or_default(cell(3), "RELATED_TO").alias("relation"), evidence.alias("evidence"), or_default(cell(5), "accepted").alias("review_status")
    )
    flaw = lambda cond, what: F.when(cond, F.lit(what))
    no_evidence = F.coalesce(F.size("evidence") == 0, F.lit(True)) | F.exists(F.coalesce("evidence", F.array().cast(f"array<{EVIDENCE}>")), lambda e: e["page_no"].isNull())
    shared = [flaw(~F.col("review_status").isin(*REVIEW_STATES), "review_status"), flaw(no_evidence, "evidence")]
    bad_nodes = nodes.select("id", F.explode(F.array_compact(F.array(flaw(F.col("title") == "", "title"), *shared))).alias("error"))
    bad_edges = edges.select("id", F.explode(F.array_compact(F.array(flaw(~F.col("relation").isin(*RELATIONS), "relation"), *shared))).alias("error"))
    ids = nodes.select(F.col("id").alias("node_id")).distinct()
    ends = edges.select("id", F.explode(F.array("source_id", "target_id")).alias("node_id"))
    loose = edges.select("id", "source_id", "target_id").filter("source_id IS NULL OR target_id IS NULL").select("id")
    loose = loose.union(ends.filter("node_id IS NOT NULL").join(ids, "node_id", "left_anti").select("id")).distinct().withColumn("error", F.lit("endpoint"))
    have = rows.agg(F.collect_set("sheet").alias("have"))
    sheets = have.select(F.explode(F.array_except(F.array(*map(F.lit, SHEETS)), "have")).alias("id"), F.lit("missing sheet").alias("error"))
    own = rows.filter((F.col("sheet") == "documents") & base).agg(F.count(F.lit(1)).alias("n"), F.max(cell(0)).alias("d"))
    own = own.filter((F.col("n") != 1) | ~F.col("d").eqNullSafe(F.lit(document_id))).select(F.lit(document_id).alias("id"), F.lit("document_id").alias("error"))
    return nodes, edges, bad_nodes.unionByName(bad_edges).unionByName(loose).unionByName(sheets).unionByName(own)


def export_workbook(document_id: str, nodes: DataFrame, edges: DataFrame) -> bytes:
    """One document's accepted snapshot as a workbook; it is made for people, so its rows pass through the driver."""
    as_rows = lambda df, cols: [list(r) for r in df.select(*cols).orderBy("id").toLocalIterator()]
    node_cols = ["id", "kind", "title", "content", F.to_json("evidence").alias("evidence_json"), "review_status"]
    edge_cols = ["id", "source_id", "target_id", "relation", F.to_json("evidence").alias("evidence_json"), "review_status"]
    rows = {"documents": [[document_id]], "knowledge_nodes": as_rows(nodes, node_cols), "knowledge_edges": as_rows(edges, edge_cols)}
    return render({name: [header, *rows.get(name, [])] for name, header in SHEETS.items()})
