"""Registered ingest queries (I): parser rows are made from the library's documents and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import ingest as ops
from lectern.plans.registry import query


def _parsed(lib):
    """Parser rows: nested chunks with positional embeddings, one short where the document number is divisible by 7."""
    c = lib.chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", F.col("text").alias("content"), F.when(F.col("pos") % 4 != 3, F.col("page_num")).alias("page"), "word_count"))).alias("c"))
    d = lib.documents.join(c, "doc_id")
    vector = F.transform("c", lambda x: F.array(x["pos"].cast("float"), x["word_count"].cast("float")))
    short = F.when(F.col("num") % 7 == 0, F.slice(vector, 1, F.greatest(F.size(vector) - 1, F.lit(0)))).otherwise(vector)
    figure = F.struct(F.concat(F.lit("f"), F.col("doc_id")).alias("figure_id"), F.element_at(F.split("filename", "_"), 1).alias("description"), F.when(F.col("num") % 2 == 0, F.lit("chart")).alias("classification"), F.lit(0.5).cast("double").alias("confidence"))
    summary = F.struct(F.col("filename").alias("summary"), F.when(F.col("num") % 3 == 0, F.array("format", "lang")).otherwise(F.array().cast("array<string>")).alias("key_points"), F.lit("report").alias("document_type"))
    meta = F.struct(F.array("lang", "project_id").alias("topics"), F.array().cast("array<map<string,string>>").alias("entities"), F.array().cast("array<string>").alias("key_terms"))
    code = F.array(F.struct(F.lit(0).alias("block_index"), F.when(F.col("num") % 2 == 1, F.lit("python")).otherwise("").alias("language"), F.col("lang").alias("purpose"), F.col("format").alias("summary")))
    formula = F.array(F.struct(F.lit(1).alias("formula_index"), F.when(F.col("num") % 2 == 1, F.lit("x")).otherwise("").alias("plain_text"), F.col("lang").alias("interpretation")))
    return d.select(
        "doc_id", "num", "filename", "markdown", "format", "lang", "project_id", F.lit(None).cast("long").alias("num_pages"), vector.alias("visual_embeddings"), short.alias("text_embeddings"),
        F.transform("c", lambda x: F.struct(x["id"].alias("id"), x["content"].alias("content"), x["page"].alias("page"), x["word_count"].alias("word_count"))).alias("chunks"),
        F.struct(summary.alias("document_summary"), meta.alias("semantic_metadata"), F.array(figure).alias("figures"), code.alias("code_blocks"), formula.alias("formulas")).alias("enrichment"),
        F.array(F.struct(F.lit(None).cast("string").alias("src_doc_id"), F.concat("doc_id", F.lit("x")).alias("dst_doc_id"), F.lit("cites").alias("relation_type"), F.lit(None).cast("string").alias("metadata"))).alias("relations"),
    )


def _named(lib):
    return lib.chunks.select("id", "doc_id", "page_num", "pos", F.when(F.col("pos") % 2 == 1, F.array(F.concat(F.lit("f"), F.col("doc_id")))).otherwise(F.array().cast("array<string>")).alias("related_pictures"))


def _figures(lib):
    return lib.documents.select("doc_id", F.concat(F.lit("f"), "doc_id").alias("figure_id"), F.when(F.col("num") % 5 != 0, F.col("filename")).alias("description"), F.lit("chart").alias("classification"), F.lit(0.5).alias("confidence"))


HELD = "WHERE doc_id IN (SELECT doc_id FROM lib_chunks)"


@query("I01_document_record", "SELECT d.doc_id, d.filename, d.format, count(*) AS num_pages FROM lib_documents d JOIN lib_chunks c ON d.doc_id = c.doc_id GROUP BY ALL")
def _(lib):
    return ops.document_record(_parsed(lib))


@query("I02_page_records", """SELECT doc_id || '-page' || lpad(CAST(pos + 1 AS VARCHAR), greatest(3, CAST(length(CAST(pos + 1 AS VARCHAR)) AS INTEGER)), '0') AS id, doc_id, pos + 1 AS page_num,
CASE WHEN pos % 2 = 0 THEN md5(id) END AS image_md5, CASE WHEN pos % 3 = 0 THEN parent_heading END AS heading FROM lib_chunks""")
def _(lib):
    p = _parsed(lib)
    images = F.transform("chunks", lambda c, i: F.when(i % 2 == 0, F.encode(c["id"], "UTF-8")))
    structures = F.transform("chunks", lambda c, i: F.when(i % 3 == 0, F.to_json(F.struct(F.element_at(F.split(c["content"], " "), 1).alias("heading")))))
    r = ops.page_records(p.withColumn("images", images).withColumn("structures", structures))
    return r.select("id", "doc_id", "page_num", F.md5("image").alias("image_md5"), F.from_json("structure", "heading string")["heading"].alias("heading"))


@query("I03_page_figures", "SELECT DISTINCT c.doc_id, c.page_num, 'f' || c.doc_id AS figures FROM lib_chunks c JOIN lib_documents d ON c.doc_id = d.doc_id WHERE c.pos % 2 = 1 AND d.num % 5 <> 0")
def _(lib):
    return ops.page_figures(_named(lib), _figures(lib)).select("doc_id", "page_num", F.array_join("figures", ",").alias("figures"))


@query("I04_chunk_records", "SELECT c.id, c.doc_id, CASE WHEN c.pos % 4 = 3 THEN 1 ELSE c.page_num END AS page_num, NOT (d.num % 7 = 0 AND c.pos = max(c.pos) OVER (PARTITION BY c.doc_id)) AS embedded FROM lib_chunks c JOIN lib_documents d ON c.doc_id = d.doc_id")
def _(lib):
    return ops.chunk_records(_parsed(lib)).select("id", "doc_id", "page_num", F.col("embedding").isNotNull().alias("embedded"))


@query("I05_length_mismatches", "SELECT d.doc_id, CAST(count(*) AS INTEGER) AS chunks, CAST(count(*) - 1 AS INTEGER) AS embeddings FROM lib_documents d JOIN lib_chunks c ON d.doc_id = c.doc_id WHERE d.num % 7 = 0 GROUP BY ALL")
def _(lib):
    return ops.length_mismatches(_parsed(lib))


@query("I06_document_enrichment", f"SELECT doc_id, filename AS summary, CASE WHEN num % 3 = 0 THEN format || ',' || lang END AS key_points, lang || ',' || project_id AS topics FROM lib_documents {HELD}")
def _(lib):
    e = _parsed(lib).select("doc_id", ops.document_enrichment().alias("e"))
    return e.select("doc_id", "e.summary", F.array_join("e.key_points", ",").alias("key_points"), F.array_join("e.topics", ",").alias("topics"))


@query("I07_chunk_figures", "SELECT c.id, d.filename AS description FROM lib_chunks c JOIN lib_documents d ON c.doc_id = d.doc_id WHERE c.pos % 2 = 1 AND d.num % 5 <> 0")
def _(lib):
    f = ops.chunk_figures(_named(lib).withColumnRenamed("related_pictures", "related_figures"), _figures(lib))
    return f.select("id", F.array_join(F.transform("figures", lambda x: x["description"]), ",").alias("description"))


@query(
    "I12_synthetic_chunks",
    f"""SELECT doc_id || ':enrichment-summary' AS id, filename || CASE WHEN num % 3 = 0 THEN '\n\nKey points: ' || format || '; ' || lang ELSE '' END || '\n\nTopics: ' || lang || ', ' || project_id AS text, 1 AS page_num FROM lib_documents {HELD}
UNION ALL SELECT doc_id || ':enrichment-figure-f' || doc_id, CASE WHEN num % 2 = 0 THEN 'Chart' ELSE 'Figure' END || ': Doc', CASE WHEN doc_id IN (SELECT doc_id FROM lib_chunks WHERE pos = 1) THEN 1 ELSE 1 END FROM lib_documents {HELD}
UNION ALL SELECT doc_id || ':enrichment-code-0', CASE WHEN num % 2 = 1 THEN 'python code block' ELSE 'Code block' END || '. Purpose: ' || lang || ' Summary: ' || format, 1 FROM lib_documents {HELD}
UNION ALL SELECT doc_id || ':enrichment-formula-1', CASE WHEN num % 2 = 1 THEN 'Formula: x. Interpretation: ' ELSE 'Formula interpretation: ' END || lang, 1 FROM lib_documents {HELD}""",
)
def _(lib):
    s = ops.synthetic_chunks(_parsed(lib), ops.first_figure_pages(_named(lib)))
    return s.select("id", "text", F.col("page_num").cast("int").alias("page_num"))


@query(
    "I13_ingest_relations",
    f"""SELECT d.doc_id AS src_doc_id, CAST(d.num + 1 AS VARCHAR) AS dst_doc_id, 'cites' AS relation_type, CASE WHEN t.doc_id IS NULL THEN 'target missing' WHEN d.num % 5 = 0 THEN 'edge exists' END AS reason
FROM (SELECT * FROM lib_documents {HELD}) d LEFT JOIN lib_documents t ON CAST(d.num + 1 AS VARCHAR) = t.doc_id""",
)
def _(lib):
    next_one = (F.col("num") + 1).cast("string")
    cites = F.array(F.struct(F.lit(None).cast("string").alias("src_doc_id"), next_one.alias("dst_doc_id"), F.lit("cites").alias("relation_type"), F.lit(None).cast("string").alias("metadata")))
    known = lib.documents.where("num % 5 = 0").select(F.col("doc_id").alias("src_doc_id"), next_one.alias("dst_doc_id"), F.lit("cites").alias("relation_type"))
    stored, failed = ops.ingest_relations(_parsed(lib).withColumn("relations", cites), lib.documents, known)
    return stored.withColumn("reason", F.lit(None).cast("string")).unionByName(failed).select("src_doc_id", "dst_doc_id", "relation_type", "reason")


@query("I14_vector_blobs", "SELECT chunk, CAST(8 + 4 * sum(len(embedding)) AS BIGINT) AS bytes, count(*) AS tokens, true AS same FROM lib_tokens GROUP BY chunk")
def _(lib):
    packed = lib.vectors.withColumn("blob", ops.pack_vectors(F.col("tokens")))
    back = packed.withColumn("back", ops.unpack_vectors(F.col("blob")))
    return back.select("chunk", F.octet_length("blob").cast("long").alias("bytes"), F.size("tokens").cast("long").alias("tokens"), (F.col("back") == F.col("tokens")).alias("same"))


@query("I15_storage_sizes", """SELECT c.doc_id, c.n AS text_bytes, p.n AS visual_bytes FROM (SELECT doc_id, CAST(sum(strlen(text) + strlen(id)) AS BIGINT) AS n FROM lib_chunks GROUP BY doc_id) c
JOIN (SELECT doc_id, CAST(sum(strlen(id) + CASE WHEN page_num % 2 = 0 THEN 5 ELSE 0 END) AS BIGINT) AS n FROM lib_pages GROUP BY doc_id) p ON c.doc_id = p.doc_id""")
def _(lib):
    pages = lib.pages.select("doc_id", F.when(F.col("page_num") % 2 == 0, F.encode(F.lit("image"), "UTF-8")).alias("image"), F.encode("id", "UTF-8").alias("blob"))
    return ops.storage_sizes(lib.chunks.select("doc_id", "text", F.encode("id", "UTF-8").alias("blob")), pages).select("doc_id", "text_bytes", "visual_bytes")


@query("I16_word_windows", "SELECT id, md5(text) AS text_md5, word_count FROM lib_chunks")
def _(lib):
    return lib.chunks.select("id", F.md5("text").alias("text_md5"), "word_count")


@query("I17_filtered_metadata", "SELECT doc_id, CASE WHEN length(markdown) <= 1000 THEN 2 ELSE 1 END AS n FROM lib_documents")
def _(lib):
    m = F.create_map(F.lit("title"), F.col("filename"), F.lit("body"), F.col("markdown"), F.lit("secret"), F.col("format"))
    return lib.documents.select("doc_id", F.size(ops.filtered_metadata(m, ["secret"])).alias("n"))


@query("I18_audio_metadata", "SELECT doc_id, filename AS title, length(left(markdown, 1000)) AS comment FROM lib_documents WHERE format = 'mp3'")
def _(lib):
    m = F.create_map(F.lit("title"), F.col("filename"), F.lit("comment"), F.col("markdown"), F.lit("album"), F.lit(None).cast("string"))
    return lib.documents.where("format = 'mp3'").select("doc_id", ops.audio_metadata(m).alias("m")).select("doc_id", F.col("m")["audio_title"].alias("title"), F.length(F.col("m")["audio_comment"]).cast("long").alias("comment"))


@query("I19_slug", "SELECT id, coalesce(nullif(left(regexp_replace(regexp_replace(lower(section_path), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 128), ''), 'project') AS slug FROM lib_chunks")
def _(lib):
    return lib.chunks.select("id", ops.slug(F.col("section_path")).alias("slug"))


@query("I19_slug_all")
def _(lib):
    return lib.chunks.select("id", ops.slug(F.col("section_path")).alias("slug"))


@query("I20_parsed_enrichment", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS summary FROM events")
def _(lib):
    good = F.to_json(F.struct(F.struct(F.col("event_type").alias("summary")).alias("document_summary")))
    e = lib.given("events").select("event_id", ops.parsed_enrichment(F.when(F.col("event_id") % 2 == 0, good).otherwise("{broken")).alias("e"))
    return e.select("event_id", "e.document_summary.summary")
