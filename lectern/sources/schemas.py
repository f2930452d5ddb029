"""Declared schemas of the library tables, and conformance to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MULTI_VECTOR = "array<array<float>>"

SCHEMAS: dict[str, str] = {
    "projects": "project_id string, name string, description string, created_at timestamp, metadata string",
    "documents": "doc_id string, project_id string, filename string, format string, num_pages bigint, markdown string, metadata string, enrichment string, created_at timestamp",
    "pages": f"id string, doc_id string, page_num bigint, image binary, thumb binary, embedding {MULTI_VECTOR}, structure string, enrichment string, width bigint, height bigint",
    "chunks": f"id string, doc_id string, page_num bigint, text string, embedding {MULTI_VECTOR}, context string, enrichment string, word_count bigint, start_time double, end_time double",
    "doc_relations": "src_doc_id string, dst_doc_id string, relation_type string, metadata string",
    "processing_jobs": "doc_id string, filename string, file_path string, project_id string, status string, progress double, stage string, error string, queued_at timestamp, started_at timestamp, completed_at timestamp",
}

KEYS = {
    "projects": ["project_id"],
    "documents": ["doc_id"],
    "pages": ["id"],
    "chunks": ["id"],
    "doc_relations": ["src_doc_id", "dst_doc_id", "relation_type"],
    "processing_jobs": ["doc_id"],
}

REQUIRED = {"pages": ["id", "doc_id", "page_num"], "chunks": ["id", "doc_id", "page_num", "text"]}

CONTEXT = "parent_heading string, parent_heading_level int, section_path string, element_type string, related_tables array<string>, related_pictures array<string>, page_nums array<int>, is_page_boundary boolean"

STRUCTURE = (
    "headings array<struct<text: string, level: int, page: int, section_path: string, bbox: array<double>>>,"
    "tables array<struct<page: int, caption: string, rows: int, cols: int, has_header: boolean, table_id: string, bbox: array<double>>>,"
    "pictures array<struct<page: int, type: string, caption: string, confidence: double, picture_id: string, bbox: array<double>>>,"
    "code_blocks array<struct<page: int, language: string, lines: int, bbox: array<double>>>,"
    "formulas array<struct<page: int, latex: string, bbox: array<double>>>,"
    "summary struct<total_sections: int, max_depth: int, has_toc: boolean>"
)


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the declared columns of ``table`` in order: missing ones null, structs for text columns as JSON, others cast."""
    out = []
    for f in schema(table):
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.StringType) and isinstance(df.schema[f.name].dataType, (T.StructType, T.MapType, T.ArrayType)):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*out)


def schema_differences(df: DataFrame, table: str) -> dict[str, str]:
    """Columns of ``table`` that ``df`` lacks ('missing') or holds with another type ('was ...')."""
    have = dict(df.dtypes)
    want = {f.name: f.dataType.simpleString() for f in schema(table)}
    return {c: "missing" if c not in have else f"was {have[c]}" for c, t in want.items() if have.get(c) != t}
