"""Schemas of the tables and nested facts, as DDL. Everything is read with an explicit schema; nothing is inferred."""

from __future__ import annotations

BOX = "array<double>"
BLOCK = f"struct<kind:string,content:string,latex:string,quote:string,order_no:int,bbox:{BOX},confidence:double,source:string>"
EVIDENCE = f"struct<kind:string,page_no:int,quote:string,bbox:{BOX}>"
QUALITY = "struct<status:string,issues:array<string>,page_kind:string,native_text_chars:int,ink_ratio:double,provider:string>"
FILE = "struct<path:string,sha256:string,size_bytes:bigint,mime_type:string>"
ASSET = "struct<kind:string,path:string,sha256:string,size_bytes:bigint,mime_type:string,metadata:map<string,string>>"

#: Page fact, schema version 1.
PAGE = (
    f"schema_version int, page_no int, page_kind string, markdown string, blocks array<{BLOCK}>, evidence array<{EVIDENCE}>, quality {QUALITY}, page_image string, content_images array<string>"
)
MANIFEST = (
    f"schema_version int, run_id string, document_hash string, page_count int, page_numbers array<int>, provider string, files array<{FILE}>, shared_assets array<{ASSET}>"
)

#: Tables. JSON of no fixed shape stays text; timestamps are UTC without a zone.
TABLES = {
    "documents": "id string, filename string, content_hash string, source_path string, page_count int, status string, created_at timestamp_ntz, current_parse_run_id string",
    "parse_runs": "id string, document_id string, status string, provider_summary string, model_calls int, created_at timestamp_ntz, job_id string, finished_at timestamp_ntz, error_json string, artifact_state string, prune_summary string, pruned_at timestamp_ntz",
    "pages": f"id string, run_id string, document_id string, page_no int, markdown string, blocks array<{BLOCK}>, evidence array<{EVIDENCE}>, quality {QUALITY}, image_path string, page_kind string, review_status string, review_reason string",
    "content_blocks": "id string, page_id string, kind string, content string, latex string, order_no int, confidence float, source string",
    "source_spans": f"id string, block_id string, page_no int, bbox {BOX}, quoted_text string",
    "quality_reports": "id string, page_id string, status string, issues array<string>, metrics string, created_at timestamp_ntz",
    "candidates": f"id string, document_id string, kind string, title string, content string, evidence array<{EVIDENCE}>, review_status string, review_reason string, extraction_run_id string",
    "edges": f"id string, document_id string, source_id string, target_id string, relation string, evidence array<{EVIDENCE}>, review_status string, extraction_run_id string",
    "workbook_revisions": "id string, document_id string, path string, snapshot_json string, status string, created_at timestamp_ntz",
    "releases": "id string, document_id string, revision_id string, snapshot_json string, status string, created_at timestamp_ntz",
    "jobs": "id string, kind string, aggregate_id string, input_version string, status string, payload_json string, result_json string, error_json string, progress_current int, progress_total int, attempt int, max_attempts int, lease_owner string, lease_expires_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz",
    "extraction_runs": "id string, document_id string, parse_run_id string, job_id string, status string, provider_summary string, model_calls int, error_json string, created_at timestamp_ntz, finished_at timestamp_ntz",
    "review_events": "id string, target_type string, target_id string, status string, reason string, created_at timestamp_ntz, seq bigint",
    "artifacts": "id string, document_id string, run_id string, kind string, path string, content_hash string, created_at timestamp_ntz, mime_type string, size_bytes bigint, metadata string",
    "parse_run_selections": "id string, document_id string, previous_run_id string, selected_run_id string, reason string, created_at timestamp_ntz",
}

#: Fixed values.
PAGE_KINDS = ("content", "reference", "blank")
BLOCK_KINDS = ("heading", "paragraph", "formula", "table", "figure", "reference", "list")
RELATIONS = ("CONTAINS", "PREREQUISITE_OF", "DEFINES", "PROVES", "USES", "ILLUSTRATES", "RELATED_TO")
REVIEW_STATES = ("accepted", "rejected", "needs_review")
ACTIVE_JOB_STATES = ("queued", "running", "cancel_requested")
