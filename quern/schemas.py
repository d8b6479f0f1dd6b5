"""Schemas of the tables that pass between operators."""

from __future__ import annotations

# Kinds of blocks and states of a job.
BLOCK_TYPES = ("text", "paragraph", "heading", "list", "table", "image", "caption")
JOB_STATES = ("queued", "downloading", "extracting", "partially_searchable", "completed", "failed")

BLOCK = "struct<block_type:string,text:string,section_path:array<string>,bbox:array<double>,metadata:map<string,string>>"
ASSET = "struct<data:binary,extension:string,content_type:string,digest:string>"
UNITS = f"path string, reader string, unit int, label string, blocks array<{BLOCK}>, assets array<{ASSET}>, error string"

UPLOAD_EVENT = "schema_version int, doc_id string, user_id string, source_name string, storage_key string, content_type string, job_id string, size_bytes bigint"
CHUNK = "chunk_id string, doc_id string, user_id string, text string, embed_text string, source_name string, lesson_title string, page int, chunk_index int, token_count int, block_type string, section_path array<string>, bbox array<double>, extra map<string,string>"
