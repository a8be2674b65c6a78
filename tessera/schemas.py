"""Tables of a knowledge base, as DDL; `empty` makes one, `conform` brings an older layout to the present one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES: dict[str, str] = {
    "files": "path string, length bigint, content binary",
    "symbols": "file_path string, ordinal int, name string, symbol_type string, start_line int, end_line int, docstring string, signature string, decorators array<string>, parent string, raises array<string>, mutates array<string>, error_strings array<string>",
    "refs": "file_path string, ordinal int, source string, target string, reference_type string, confidence double, line int, target_resolved boolean",
    "nodes": "id string, name string, type string, file_path string, line_start int, line_end int, docstring string, signature string, parent string",
    "edges": "source string, target string, type string, confidence double, line int",
    "code_index": "id bigint, file_path string, symbol_name string, symbol_type string, line_start int, line_end int, signature string, docstring string, calls array<string>, called_by array<string>, raises array<string>, mutates array<string>, error_strings array<string>, source_hash string",
    "chunks": "chunk_id string, path string, title string, type string, section_header string, chunk_index int, token_count int, content string, layer string, symbols array<string>, imports array<string>, entry_points array<string>",
    "vectors": "id string, embedding array<float>, document string, type string, path string, title string",
    "issues": "id string, file_path string, category string, severity string, title string, content string, line_start int, line_end int",
    "file_summaries": "file_path string, purpose string, layer string, key_abstractions array<string>, internal_deps array<string>, external_deps array<string>",
    "directory_summaries": "directory_path string, purpose string, contains array<string>, role string",
    "pages": "path string, type string, target string, content string, source_hash string, metadata string, generated_at timestamp, status string",
    "notes": "scope string, target string, content string, author string, updated_at timestamp, seq bigint",
    "jobs": "id string, type string, status string, started_at timestamp, completed_at timestamp, current_phase string, total_phases int, current_step int, total_steps int, error_message string, changes_made boolean, seq bigint",
    "citations": "page_path string, source_path string, line_start int, line_end int",
    "repos": "id bigint, origin_url string, source_type string, local_path string, display_name string, head_commit string, branch string, created_at timestamp, last_generated timestamp, status string",
    "parsed": "file_path string",
    "counts": "type string, deleted bigint",
    "embedding_model": "provider string, model string, indexed_at timestamp",
    "settings": "key string, value string, seq bigint",
    "llm_log": "timestamp string, request struct<system_prompt:string,prompt:string,temperature:double,max_tokens:int>, response string, duration_ms bigint, error string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with the columns of a table in order: missing ones null, others cast, surplus ones dropped."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)))
