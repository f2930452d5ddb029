"""Remaining reads (F, V, G) that shape rows of other tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import context, enrich, graph, ingest, library, vectors
from lectern.plans.registry import query
from lectern.sources.schemas import CONTEXT, schema
from lectern.sources.shared import shared_folder
from lectern.streaming import streams


@query("F08_page_and_chunk_by_id", "SELECT id, doc_id, 'chunk' AS kind, parent_heading AS told FROM lib_chunks WHERE pos = 1 UNION ALL SELECT id, doc_id, 'page', CAST(n_chunks AS VARCHAR) FROM lib_pages WHERE page_num = 1 UNION ALL SELECT 'none', NULL, 'page', NULL")
def _(lib):
    chunks = lib.chunks.select("id", "doc_id", F.to_json(F.struct("parent_heading")).alias("context"))
    c = library.lookup(chunks, lib.chunks.where("pos = 1"), "id", {"context": CONTEXT}).select("id", "doc_id", F.lit("chunk").alias("kind"), F.col("context.parent_heading").alias("told"))
    pages = lib.pages.select("id", "doc_id", F.to_json(F.struct("n_chunks")).alias("structure"))
    absent = lib.spark.range(1).select(F.lit("none").alias("id"))
    asked = lib.pages.where("page_num = 1").select("id").unionByName(absent)
    p = library.lookup(pages, asked, "id", {"structure": "n_chunks string"}).select("id", "doc_id", F.lit("page").alias("kind"), F.col("structure.n_chunks").alias("told"))
    return c.unionByName(p)


@query("F09_page_image", "SELECT doc_id, page_num, md5(id) AS image_md5 FROM lib_pages WHERE page_num = 2 AND n_chunks > 1")
def _(lib):
    asked = lib.pages.where("page_num = 2").select("doc_id", "page_num")
    held = lib.pages.withColumn("image", F.when(F.col("n_chunks") > 1, F.encode("id", "UTF-8")))
    return library.page_images(held, asked).select("doc_id", "page_num", F.md5("image").alias("image_md5"))


MODES = {"newest_first": "created_at DESC", "oldest_first": "created_at", "name_asc": "lower(filename)", "name_desc": "lower(filename) DESC"}


@query("F12_sort_modes", " UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS mode, doc_id, row_number() OVER (ORDER BY {o}, doc_id) AS n FROM lib_documents ORDER BY n LIMIT 100)" for m, o in MODES.items()))
def _(lib):
    tops = []
    for mode in MODES:
        top = library.sorted_documents(lib.documents, mode).limit(100)
        way, column = library.SORTS[mode]
        by = way(F.lower(column) if column == "filename" else F.col(column))
        tops.append(top.select(F.lit(mode).alias("mode"), "doc_id", F.row_number().over(vectors.Window.orderBy(by, "doc_id")).cast("long").alias("n")))
    return reduce(DataFrame.unionByName, tops)


@query("V06_scores", "SELECT event_id, round(1 / (1 + value), 9) AS score FROM events")
def _(lib):
    return lib.given("events").select("event_id", F.round(vectors.score(F.col("value")), 9).alias("score"))


@query("V08_result_names", "SELECT DISTINCT CAST(t.doc AS VARCHAR) AS doc_id, l.filename, l.format FROM lib_tokens t LEFT JOIN lib_documents l ON CAST(t.doc AS VARCHAR) = l.doc_id")
def _(lib):
    hits = lib.vectors.select(F.col("doc").cast("string").alias("doc_id")).distinct()
    return hits.join(lib.documents.select("doc_id", "filename", "format"), "doc_id", "left")


@query("V09_result_shape", "SELECT id, parent_heading AS heading, section_path AS section, page_num FROM lib_chunks")
def _(lib):
    held = lib.chunks.withColumn("context", F.to_json(F.struct("parent_heading", "section_path")))
    parsed = F.from_json("context", "parent_heading string, section_path string")
    return held.select("id", parsed["parent_heading"].alias("heading"), parsed["section_path"].alias("section"), "page_num")


META = ", m AS (SELECT doc_id, CASE WHEN num % 3 = 0 THEN num / 1000.0 END AS pr FROM lib_documents)"


@query("V12_cached_pagerank", META + " SELECT doc_id, pr FROM m")
def _(lib):
    graph = F.when(F.col("num") % 3 == 0, F.to_json(F.struct(F.struct((F.col("num") / 1000.0).alias("pagerank_score")).alias("graph"))))
    return lib.documents.select("doc_id", graph.alias("metadata")).select("doc_id", F.expr("try_variant_get(try_parse_json(metadata), '$.graph.pagerank_score', 'double')").alias("pr"))


@query("G16_overview_nodes", META + " SELECT doc_id, coalesce(pr, 0.0) AS pagerank, 0 AS hub_score FROM m")
def _(lib):
    graph = F.when(F.col("num") % 3 == 0, F.to_json(F.struct(F.struct((F.col("num") / 1000.0).alias("pagerank_score")).alias("graph"))))
    v = lib.documents.select("doc_id", F.expr("1").alias("one"), graph.alias("metadata"))
    get = lambda field, kind, default: F.coalesce(F.expr(f"try_variant_get(try_parse_json(metadata), '$.graph.{field}', '{kind}')"), F.lit(default))
    return v.select("doc_id", get("pagerank_score", "double", 0.0).alias("pagerank"), get("hub_score", "int", 0).alias("hub_score"))


@query("S03_batch_append", "SELECT doc_id, filename, format FROM lib_documents")
def _(lib):
    path = f"{shared_folder(lib.spark)}/lectern-append-{uuid.uuid4().hex}"
    for part in (0, 1):
        library.append(lib.documents.where(F.col("num") % 2 == part).select("doc_id", "filename", "format"), "documents", path)
    return lib.spark.read.schema(schema("documents")).parquet(path).select("doc_id", "filename", "format")


@query("C10_token_estimate", "SELECT id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM lib_chunks")
def _(lib):
    return lib.chunks.select("id", context.tokens(F.col("text")).alias("tokens"))


@query("C16_citation_map", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY num % 97, doc_id) AS INTEGER) AS number FROM lib_documents QUALIFY number <= 10")
def _(lib):
    hits = lib.documents.select(F.col("project_id").alias("query_id"), "doc_id", F.lit(1).alias("page_num"), F.struct(F.col("doc_id")).alias("pos"), (-(F.col("num") % 97)).alias("score"))
    return context.ranked_hits(hits).select("doc_id", F.col("rank").alias("number"))


@query("C24_numbered_listing", "SELECT doc_id, md5(string_agg('[' || (pos + 1) || '] ' || text, chr(10) || chr(10) ORDER BY pos)) AS listing_md5 FROM lib_chunks GROUP BY doc_id")
def _(lib):
    return context.numbered_listing(lib.chunks, "doc_id").select("doc_id", F.md5("listing").alias("listing_md5"))


@query("E09_tolerant_edges", "SELECT DISTINCT src_doc_id, dst_doc_id, relation_type FROM lib_relations")
def _(lib):
    twice = lib.relations.unionByName(lib.relations)
    checked = library.checked_relations(twice, lib.documents, lib.relations.where("false"))
    return checked.where("reason is null").select("src_doc_id", "dst_doc_id", "relation_type")


@query("I08_summary_chunks", "SELECT doc_id || ':enrichment-summary' AS id, filename || chr(10) || chr(10) || 'Topics: ' || lang AS text FROM lib_documents")
def _(lib):
    e = F.to_json(F.struct(F.struct(F.col("filename").alias("summary")).alias("document_summary"), F.struct(F.array("lang").alias("topics")).alias("semantic_metadata")))
    return ingest.summary_chunks(lib.documents.select("doc_id", ingest.parsed_enrichment(e).alias("enrichment"))).select("id", "text")


@query("T07_session_sources", "SELECT conv_id AS key, count(*) AS turns, count(*) FILTER (WHERE role = 'assistant') AS answers, string_agg(DISTINCT md5(text), ',' ORDER BY md5(text)) FILTER (WHERE role = 'assistant') AS sources FROM conversations GROUP BY conv_id")
def _(lib):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("turn").cast("int"))
    turns = lib.given("conversations").select(F.col("conv_id").alias("key"), at.alias("ts"), "role", F.md5("text").alias("source"))
    joined = F.array_join("sources", ",")
    return streams.sessions(turns).select("key", "turns", "answers", F.when(joined != "", joined).alias("sources"))


@query(
    "T10_periodic_enrichment",
    """, h AS (SELECT doc_id, count(*) AS hub FROM (SELECT src_doc_id AS doc_id FROM lib_relations UNION ALL SELECT dst_doc_id FROM lib_relations) GROUP BY 1)
SELECT d.doc_id, coalesce(h.hub, 0) AS hub_score, d.lang AS kept FROM lib_documents d LEFT JOIN h ON d.doc_id = h.doc_id""",
)
def _(lib):
    """Each batch of arriving documents is added to the library, which is then enriched in all four steps and stored; edges by
    similarity and by topic are computed for the batch's documents only.

    A batch and its run are written under the batch's number, so a repeated batch changes nothing.
    """
    path = f"{shared_folder(lib.spark)}/lectern-enriched-{uuid.uuid4().hex}"
    known = lib.documents.withColumn("metadata", F.to_json(F.struct("lang")))
    vectors = lib.vectors.select(F.col("chunk").alias("id"), "doc", F.lit(1).alias("word_count"), "tokens")

    def run(batch, epoch):
        batch.select(F.col("doc_id").cast("string").alias("doc_id")).write.mode("overwrite").parquet(f"{path}/arrived/batch={epoch}")
        arrived = lib.spark.read.schema("doc_id string, batch int").option("basePath", f"{path}/arrived").parquet(f"{path}/arrived/batch=*").where(F.col("batch") <= epoch).select("doc_id").distinct()
        documents = known.join(arrived, "doc_id", "left_semi")
        own = vectors.join(arrived, vectors["doc"].cast("string") == arrived["doc_id"], "left_semi")
        enrich.stored_run(documents, graph.edge_set(lib.relations, arrived), lib.chunks.join(arrived, "doc_id", "left_semi"), own, enrich.Settings(), path, run=epoch, batch=batch)

    streams.enriched_periodically(streams.table_stream(lib.spark, f"{lib.dir}/documents.parquet"), run)
    told = F.from_json("metadata", "lang string, graph struct<hub_score: long, enriched_at: string>")
    return enrich.stored_metadata(lib.spark, path).select("doc_id", told.alias("m")).where("m.graph.enriched_at is not null").select("doc_id", F.col("m.graph.hub_score").alias("hub_score"), F.col("m.lang").alias("kept"))
