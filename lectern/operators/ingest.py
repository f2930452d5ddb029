"""Ingest mapping (I): parser output rows to library rows.

Parser rows hold (doc_id, filename, markdown, metadata map, visual_embeddings, text_embeddings, chunks, enrichment) with
chunks array<struct<id, content, page, word_count, ...>> and enrichment struct<document_summary, semantic_metadata,
figures, code_blocks, formulas>.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.library import checked_relations, extension
from lectern.sources.derived import padded

ENRICHMENT = (
    "document_summary struct<summary: string, key_points: array<string>, document_type: string>,"
    "semantic_metadata struct<topics: array<string>, entities: array<map<string, string>>, key_terms: array<string>>,"
    "figures array<struct<figure_id: string, description: string, classification: string, confidence: double>>,"
    "code_blocks array<struct<block_index: int, language: string, purpose: string, summary: string>>,"
    "formulas array<struct<formula_index: int, plain_text: string, interpretation: string>>"
)
VALUE_LIMIT = 1000


def document_record(parsed: DataFrame) -> DataFrame:
    """doc_id, filename, format, num_pages (explicit, else the number of page embeddings) (I-01)."""
    pages = F.coalesce("num_pages", F.when(F.size("visual_embeddings") > 0, F.size("visual_embeddings").cast("long")))
    return parsed.select("doc_id", "filename", extension("filename").alias("format"), pages.alias("num_pages"))


def page_id(page: Column) -> Column:
    return F.concat(F.col("doc_id"), F.lit("-page"), padded(page, 3))


def page_records(parsed: DataFrame) -> DataFrame:
    """One page row for each page embedding, numbered from 1, with the image and structure of its position (I-02)."""
    at = lambda name: F.get(F.col(name), F.col("__i")) if name in parsed.columns else F.lit(None)
    p = parsed.select("*", F.posexplode("visual_embeddings").alias("__i", "embedding"))
    number = F.col("__i") + 1
    return p.select(page_id(number).alias("id"), "doc_id", number.cast("long").alias("page_num"), "embedding", at("images").cast("binary").alias("image"), at("structures").cast("string").alias("structure"))


def page_figures(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc_id, page_num, figures): described figures in the order in which the page's chunks first name them (I-03); chunks(doc_id, page_num, pos, related_pictures)."""
    named = chunks.select("doc_id", "page_num", "pos", F.posexplode("related_pictures").alias("__j", "figure_id"))
    first = named.groupBy("doc_id", "page_num", "figure_id").agg(F.min(F.struct("pos", "__j")).alias("at"))
    held = first.join(figures.where("description is not null and description <> ''"), ["doc_id", "figure_id"])
    return held.groupBy("doc_id", "page_num").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "figure_id"))), lambda x: x["figure_id"]).alias("figures"))


def chunk_records(parsed: DataFrame) -> DataFrame:
    """Chunk rows with page 1 by default and the embedding of their position, if there is one (I-04)."""
    at = F.transform("chunks", lambda c, i: F.struct(c.alias("c"), F.get(F.col("text_embeddings"), i).alias("e")))
    x = parsed.select("doc_id", F.posexplode(at).alias("pos", "x"))
    return x.select("x.c.id", "doc_id", F.coalesce("x.c.page", F.lit(1)).cast("long").alias("page_num"), F.col("x.c.content").alias("text"), F.col("x.e").alias("embedding"), "pos", F.col("x.c.word_count").cast("long").alias("word_count"))


def length_mismatches(parsed: DataFrame) -> DataFrame:
    """Documents whose chunks and embeddings differ in number (I-05)."""
    c, e = F.greatest(F.size("chunks"), F.lit(0)), F.greatest(F.size("text_embeddings"), F.lit(0))
    return parsed.where(c != e).select("doc_id", c.alias("chunks"), e.alias("embeddings"))


def none_if_empty(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def document_enrichment(e: str = "enrichment") -> Column:
    """The document part of an enrichment in one struct, null where both sources are absent (I-06)."""
    s, m = F.col(f"{e}.document_summary"), F.col(f"{e}.semantic_metadata")
    flat = F.struct(
        F.when(s["summary"] != "", s["summary"]).alias("summary"),
        none_if_empty(s["key_points"]).alias("key_points"),
        F.when(s["document_type"] != "", s["document_type"]).alias("document_type"),
        none_if_empty(m["topics"]).alias("topics"),
        none_if_empty(m["entities"]).alias("entities"),
        none_if_empty(m["key_terms"]).alias("key_terms"),
    )
    return F.when(s.isNotNull() | m.isNotNull(), flat)


def chunk_figures(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """(id, figures): the described figures a chunk refers to, in its order (I-07)."""
    named = chunks.select("id", "doc_id", F.posexplode("related_figures").alias("__j", "figure_id"))
    held = named.join(figures.where("description is not null and description <> ''"), ["doc_id", "figure_id"])
    return held.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("__j", "figure_id", "description", "classification", "confidence"))), lambda x: F.struct(x["figure_id"].alias("figure_id"), x["description"].alias("description"), x["classification"].alias("classification"), x["confidence"].alias("confidence"))).alias("figures"))


def _synthetic(doc: Column, name: Column, text: Column, page: Column, source: str) -> list[Column]:
    return [F.concat(doc, F.lit(":enrichment-"), name).alias("id"), doc.alias("doc_id"), text.alias("text"), page.cast("long").alias("page_num"), F.lit(source).alias("source")]


def summary_chunks(parsed: DataFrame) -> DataFrame:
    """I-08."""
    s, m = "enrichment.document_summary", "enrichment.semantic_metadata"
    parts = F.concat_ws(
        "\n\n",
        F.when(F.col(f"{s}.summary") != "", F.col(f"{s}.summary")),
        F.when(F.size(f"{s}.key_points") > 0, F.concat(F.lit("Key points: "), F.array_join(f"{s}.key_points", "; "))),
        F.when(F.size(f"{m}.topics") > 0, F.concat(F.lit("Topics: "), F.array_join(f"{m}.topics", ", "))),
    )
    return parsed.select(*_synthetic(F.col("doc_id"), F.lit("summary"), parts, F.lit(1), "document_summary")).where("text <> ''")


def figure_chunks(parsed: DataFrame, pages: DataFrame) -> DataFrame:
    """I-09; pages(doc_id, figure_id, page_num) of the first chunk that names a figure."""
    f = parsed.select("doc_id", F.explode("enrichment.figures").alias("f")).where("f.figure_id <> '' and f.description <> ''")
    kind = F.coalesce(F.when(F.col("f.classification") != "", F.col("f.classification")), F.lit("figure"))
    named = F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substr(kind, F.lit(2))), F.lit(": "), F.col("f.description"))
    placed = f.withColumn("figure_id", F.col("f.figure_id")).join(pages, ["doc_id", "figure_id"], "left")
    return placed.select(*_synthetic(F.col("doc_id"), F.concat(F.lit("figure-"), F.col("figure_id")), named, F.coalesce("page_num", F.lit(1)), "figure_caption"))


def code_chunks(parsed: DataFrame) -> DataFrame:
    """I-10."""
    c = parsed.select("doc_id", F.explode("enrichment.code_blocks").alias("c")).where("c.summary <> ''")
    head = F.when(F.col("c.language") != "", F.concat("c.language", F.lit(" code block"))).otherwise("Code block")
    body = F.concat_ws(" ", F.when(F.col("c.purpose") != "", F.concat(F.lit("Purpose: "), "c.purpose")), F.concat(F.lit("Summary: "), "c.summary"))
    return c.select(*_synthetic(F.col("doc_id"), F.concat(F.lit("code-"), F.coalesce("c.block_index", F.lit(0)).cast("string")), F.concat(head, F.lit(". "), body), F.lit(1), "code_block"))


def formula_chunks(parsed: DataFrame) -> DataFrame:
    """I-11."""
    f = parsed.select("doc_id", F.explode("enrichment.formulas").alias("f")).where("f.interpretation <> ''")
    text = F.when(F.col("f.plain_text") != "", F.concat(F.lit("Formula: "), "f.plain_text", F.lit(". Interpretation: "), "f.interpretation")).otherwise(F.concat(F.lit("Formula interpretation: "), "f.interpretation"))
    return f.select(*_synthetic(F.col("doc_id"), F.concat(F.lit("formula-"), F.coalesce("f.formula_index", F.lit(0)).cast("string")), text, F.lit(1), "formula"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")).cast("long")


def synthetic_chunks(parsed: DataFrame, figure_pages: DataFrame) -> DataFrame:
    """All synthetic chunks with their word counts (I-12)."""
    parts = [summary_chunks(parsed), figure_chunks(parsed, figure_pages), code_chunks(parsed), formula_chunks(parsed)]
    return reduce(DataFrame.unionByName, parts).withColumn("word_count", word_count(F.col("text")))


def ingest_relations(parsed: DataFrame, documents: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations to store, failures with a reason) of parser rows, the source being the row's document by default (I-13)."""
    r = parsed.select("doc_id", F.explode("relations").alias("r"))
    named = r.select(F.coalesce("r.src_doc_id", "doc_id").alias("src_doc_id"), "r.dst_doc_id", "r.relation_type", "r.metadata").where("dst_doc_id is not null and relation_type is not null")
    checked = checked_relations(named, documents, existing)
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def unpack_vectors(blob: Column) -> Column:
    """A column of packed multi-vectors (u32 tokens, u32 dimension, f32 row-major, little-endian) as arrays; null where the length is wrong (I-14)."""

    def one(b: bytes | None) -> list | None:
        if b is None or len(b) < 8:
            return None
        n, d = struct.unpack_from("<II", b)
        return np.frombuffer(b, "<f4", n * d, 8).reshape(n, d).tolist() if len(b) == 8 + 4 * n * d else None

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
    def of(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in blobs:
            yield pd.Series([one(b) for b in part], dtype=object)

    return of(blob)


def pack_vectors(tokens: Column) -> Column:
    """Arrays as packed multi-vectors; null where rows differ in length (I-14)."""

    def one(rows) -> bytes | None:
        if rows is None or len({len(r) for r in rows}) > 1:
            return None
        m = np.array([list(r) for r in rows], "<f4").reshape(len(rows), -1)
        return struct.pack("<II", m.shape[0], m.shape[1] if len(rows) else 0) + m.tobytes()

    @F.pandas_udf(T.BinaryType())
    def of(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in values:
            yield pd.Series([one(v) for v in part], dtype=object)

    return of(tokens)


def storage_sizes(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, text_bytes, visual_bytes): embedding and UTF-8 text bytes of chunks, embedding and image bytes of pages (I-15).

    chunks(doc_id, text, blob), pages(doc_id, image, blob).
    """
    of = lambda *names: F.sum(sum((F.coalesce(F.octet_length(n), F.lit(0)) for n in names), F.lit(0)))
    text = chunks.groupBy("doc_id").agg(of("text", "blob").alias("text_bytes"))
    visual = pages.groupBy("doc_id").agg(of("image", "blob").alias("visual_bytes"))
    return text.join(visual, "doc_id", "full").fillna(0, ["text_bytes", "visual_bytes"])


def filtered_metadata(values: Column, dropped: list[str]) -> Column:
    """A map without listed keys and long values (I-17)."""
    return F.map_filter(values, lambda k, v: ~k.isin(dropped) & (F.length(v) <= VALUE_LIMIT))


def audio_metadata(values: Column) -> Column:
    """Audio tags with their prefix, nulls dropped, the comment cut to 1000 characters (I-18)."""
    held = F.map_filter(values, lambda k, v: v.isNotNull() & (v != ""))
    cut = F.transform_values(held, lambda k, v: F.when(k == "comment", F.substring(v, 1, VALUE_LIMIT)).otherwise(v))
    return F.transform_keys(cut, lambda k, v: F.concat(F.lit("audio_"), k))


def slug(name: Column) -> Column:
    """Project slug: lower case, unsafe runs to '-', trimmed, at most 128, else 'project' (I-19)."""
    safe = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9_-]+", "-"), r"^-+|-+$", "")
    cut = F.substring(safe, 1, 128)
    return F.coalesce(F.when(cut != "", cut), F.lit("project"))


def parsed_enrichment(json: Column) -> Column:
    """An enrichment from JSON text; malformed input becomes one without content (I-20)."""
    parsed = F.from_json(json, ENRICHMENT)
    return F.coalesce(parsed, F.from_json(F.lit("{}"), ENRICHMENT))


def first_figure_pages(chunks: DataFrame) -> DataFrame:
    """(doc_id, figure_id, page_num) of the first chunk that names each figure."""
    named = chunks.select("doc_id", "page_num", "pos", F.explode("related_pictures").alias("figure_id"))
    n = F.row_number().over(Window.partitionBy("doc_id", "figure_id").orderBy("pos"))
    return named.withColumn("__n", n).where("__n = 1").select("doc_id", "figure_id", "page_num")
