"""Registered maintenance and read queries (S, F)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import library as ops
from lectern.plans.registry import query
from lectern.sources.derived import FORMATS
from lectern.sources.schemas import conform
from lectern.sources.shared import shared_folder


@query("S01_table_scan", "SELECT 'documents' AS t, count(*) AS n FROM lib_documents UNION ALL SELECT 'pages', count(*) FROM lib_pages UNION ALL SELECT 'chunks', count(*) FROM lib_chunks UNION ALL SELECT 'doc_relations', count(*) FROM lib_relations UNION ALL SELECT 'processing_jobs', count(*) FROM lib_jobs UNION ALL SELECT 'projects', count(*) FROM lib_projects")
def _(lib):
    named = [("documents", lib.documents), ("pages", lib.pages), ("chunks", lib.chunks), ("doc_relations", lib.relations), ("processing_jobs", lib.jobs), ("projects", lib.projects)]
    out = None
    for name, df in named:
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("S02_parameterised_sql", "SELECT format, count(*) AS n FROM lib_documents WHERE project_id > 'src1' AND lang = 'en' GROUP BY format")
def _(lib):
    return lib.spark.sql("SELECT format, count(*) AS n FROM {docs} WHERE project_id > :low AND lang = :lang GROUP BY format", args={"low": "src1", "lang": "en"}, docs=lib.documents)


@query("S04_page_append", "SELECT id, doc_id, page_num, CAST(NULL AS BIGINT) AS width FROM lib_pages WHERE page_num IS NOT NULL")
def _(lib):
    good, _ = ops.with_rejects(lib.pages, "pages")
    return good.select("id", "doc_id", "page_num", "width")


@query("S05_chunk_append", "SELECT id, doc_id, page_num, md5(text) AS text_md5, word_count FROM lib_chunks")
def _(lib):
    good, _ = ops.with_rejects(lib.chunks, "chunks")
    return good.select("id", "doc_id", "page_num", F.md5("text").alias("text_md5"), "word_count")


@query("S06_create_documents", "SELECT filename, CASE WHEN num % 3 = 0 THEN 'key exists' END AS reason FROM lib_documents")
def _(lib):
    d = lib.documents
    fresh, held = ops.split_new(d.select("doc_id", "filename"), d.where("num % 3 = 0"), ["doc_id"])
    return fresh.select("filename", F.lit(None).cast("string").alias("reason")).unionByName(held.select("filename", "reason"))


@query("S07_create_projects", "SELECT project_id, regexp_matches(project_id, '^[a-z0-9][a-z0-9_-]{0,127}$') AS valid FROM lib_projects")
def _(lib):
    return lib.projects.select("project_id", ops.valid_slug().alias("valid"))


@query(
    "S08_create_relations",
    """SELECT r.src_doc_id, r.dst_doc_id, r.relation_type, CASE WHEN s.num % 7 = 0 THEN 'source missing' WHEN d.num % 7 = 0 THEN 'target missing' WHEN r.relation_type = 'series_member' THEN 'edge exists' END AS reason
FROM lib_relations r JOIN lib_documents s ON r.src_doc_id = s.doc_id JOIN lib_documents d ON r.dst_doc_id = d.doc_id""",
)
def _(lib):
    return ops.checked_relations(lib.relations, lib.documents.where("num % 7 <> 0"), lib.relations.where("relation_type = 'series_member'")).select("src_doc_id", "dst_doc_id", "relation_type", "reason")


@query("S09_update_documents", "SELECT doc_id, CASE WHEN num % 4 = 0 THEN 'renamed-' || doc_id ELSE filename END AS filename, format FROM lib_documents")
def _(lib):
    patch = lib.documents.where("num % 4 = 0").select("doc_id", F.concat(F.lit("renamed-"), "doc_id").alias("filename"), F.lit("x").alias("format"))
    return ops.patched(lib.documents, patch, ["doc_id"], ["filename"]).select("doc_id", "filename", "format")


@query("S10_update_projects", "SELECT project_id, CASE WHEN project_id < 'src15' THEN 'Renamed' ELSE name END AS name FROM lib_projects")
def _(lib):
    patch = lib.projects.where("project_id < 'src15'").select("project_id", F.lit("Renamed").alias("name"))
    return ops.patched(lib.projects, patch, ["project_id"], ["name"]).select("project_id", "name")


@query(
    "S11_cascade_delete",
    """, k AS (SELECT doc_id FROM lib_documents WHERE num % 2 = 1)
SELECT 'documents' AS t, count(*) AS n FROM k UNION ALL SELECT 'chunks', count(*) FROM lib_chunks WHERE doc_id IN (FROM k)
UNION ALL SELECT 'pages', count(*) FROM lib_pages WHERE doc_id IN (FROM k)
UNION ALL SELECT 'doc_relations', count(*) FROM lib_relations WHERE src_doc_id IN (FROM k) AND dst_doc_id IN (FROM k)""",
)
def _(lib):
    tables = {"documents": lib.documents, "pages": lib.pages, "chunks": lib.chunks, "doc_relations": lib.relations}
    left = ops.cascade_delete(tables, lib.documents.where("num % 2 = 0"))
    out = None
    for name, df in left.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("S12_delete_project", "SELECT project_id, count(*) AS n FROM lib_documents WHERE project_id <> 'src3' GROUP BY project_id")
def _(lib):
    left, _ = ops.delete_project({"documents": lib.documents}, "src3")
    return left["documents"].where("project_id is not null").groupBy("project_id").agg(F.count("*").alias("n"))


@query("S13_delete_relation", "SELECT src_doc_id, dst_doc_id, relation_type FROM lib_relations WHERE NOT (relation_type = 'same_author' AND src_doc_id < dst_doc_id)")
def _(lib):
    return ops.without_relation(lib.relations, lib.relations.where("relation_type = 'same_author' and src_doc_id < dst_doc_id"))


@query(
    "S14_replace_type",
    """, r AS (SELECT relation_type FROM lib_relations WHERE relation_type <> 'same_author' UNION ALL SELECT 'same_author' FROM lib_relations WHERE relation_type = 'series_member')
SELECT relation_type, count(*) AS n, count(*) AS stored, (SELECT count(*) FROM lib_relations WHERE relation_type = 'same_author') AS deleted FROM r GROUP BY relation_type""",
)
def _(lib):
    fresh = lib.relations.where("relation_type = 'series_member'").withColumn("relation_type", F.lit("same_author"))
    left, deleted = ops.replace_type(lib.relations, "same_author", fresh)
    path = f"{shared_folder(lib.spark)}/lectern-relations-{uuid.uuid4().hex}"
    for part in (lib.relations, fresh):  # the second overwrites the partition of its type alone
        ops.write_relations(part, path)
    stored = lib.spark.read.schema("src_doc_id string, dst_doc_id string, relation_type string").parquet(path).groupBy("relation_type").agg(F.count("*").alias("stored"))
    return left.groupBy("relation_type").agg(F.count("*").alias("n")).join(stored, "relation_type").crossJoin(deleted)


@query("S15_delete_where", "SELECT count(*) FILTER (WHERE word_count < 100) AS deleted FROM lib_chunks")
def _(lib):
    return ops.delete_where(lib.chunks, F.col("word_count") < 100)[1]


@query("S16_conformance", "SELECT doc_id, filename, CAST(NULL AS VARCHAR) AS metadata, CAST(NULL AS BIGINT) AS num_pages FROM lib_documents")
def _(lib):
    return conform(lib.documents, "documents").select("doc_id", "filename", "metadata", "num_pages")


@query("S17_seed_default", "SELECT project_id FROM lib_projects UNION SELECT 'default'")
def _(lib):
    return ops.seeded_projects(conform(lib.projects, "projects")).select("project_id")


@query("S18_content_hash", "SELECT sha256(html) AS doc_id, strlen(html) AS size_bytes, strlen(html) > 3000 AS too_large FROM pages")
def _(lib):
    p = lib.given("pages").select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"), F.lit(None).cast("timestamp").alias("modificationTime"))
    return ops.intake(p.withColumn("length", F.octet_length("content").cast("long")), 3000).select("doc_id", "size_bytes", "too_large")


@query(
    "S19_name_suffix",
    """, u AS (SELECT user_id, event_id, event_type || '.txt' AS filename, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n, event_type AS stem FROM events)
SELECT event_id, CASE WHEN n = 0 THEN filename ELSE stem || '_' || n || '.txt' END AS stored_name FROM u""",
)
def _(lib):
    up = lib.given("events").select("event_id", "ts", F.concat("event_type", F.lit(".txt")).alias("filename"))
    return ops.suffixed_names(up, ["ts", "event_id"]).select("event_id", "stored_name")


@query(
    "S20_upload_check",
    """SELECT doc_id, format IN ('pdf', 'md', 'docx') AND NOT coalesce(strlen(markdown) > 1048576, false) AS ok,
CASE WHEN format NOT IN ('pdf', 'md', 'docx') THEN 'Unsupported format: .' || format WHEN strlen(markdown) > 1048576 THEN 'File too large: ' || strlen(markdown) || ' bytes (max 1MB)' ELSE '' END AS message FROM lib_documents""",
)
def _(lib):
    d = lib.documents.withColumn("size", F.octet_length("markdown"))
    return d.select("doc_id", ops.upload_check("filename", "size", ["pdf", "md", "docx"], 1).alias("c")).select("doc_id", "c.ok", "c.message")


@query(
    "S20_upload_check_small_cap",
    """, u AS (SELECT url, strlen(html) AS n, page_id % 3 = 0 AS known FROM pages) SELECT url, n AS size, CASE WHEN NOT known THEN 'Unsupported format: .bin' WHEN n > 2097152 THEN 'File too large: ' || n || ' bytes (max 2MB)' ELSE '' END AS message FROM (SELECT url, n * 1000 AS n, known FROM u)""",
)
def _(lib):
    p = lib.given("pages").select("url", (F.octet_length("html") * 1000).cast("long").alias("size"), F.when(F.col("page_id") % 3 == 0, "a.html").otherwise("a.bin").alias("filename"))
    return p.select("url", "size", ops.upload_check("filename", "size", ["html"], 2)["message"].alias("message"))


@query("S21_row_json", "SELECT CAST(json_object('id', id, 'doc_id', doc_id, 'page_num', page_num) AS VARCHAR) AS j FROM lib_pages")
def _(lib):
    p = lib.pages.select("id", "doc_id", "page_num", F.encode("id", "UTF-8").alias("thumb"))
    return p.select(ops.as_json(p).alias("j"))


@query("S22_orphans", "SELECT doc_id FROM lib_documents WHERE num % 5 <> 2 AND num % 2 = 0")
def _(lib):
    files = lib.documents.where("num % 5 = 2 or num % 2 = 1").select("filename")
    return lib.documents.join(files, "filename", "left_anti").select("doc_id")


@query("S23_old_files", "SELECT doc_id, filename FROM lib_documents WHERE created_at < TIMESTAMP '2024-01-01 08:00:00'")
def _(lib):
    return lib.documents.where(F.col("created_at") < F.lit("2024-01-01 08:00:00").cast("timestamp")).select("doc_id", "filename")


@query(
    "S24_deletion_impact",
    """, e AS (SELECT src_doc_id AS doc_id FROM lib_relations UNION ALL SELECT dst_doc_id FROM lib_relations WHERE src_doc_id <> dst_doc_id)
SELECT d.doc_id, (SELECT count(*) FROM lib_pages p WHERE p.doc_id = d.doc_id) AS pages, (SELECT count(*) FROM lib_chunks c WHERE c.doc_id = d.doc_id) AS chunks,
 (SELECT count(*) FROM e WHERE e.doc_id = d.doc_id) AS relations FROM lib_documents d WHERE d.format = 'pdf'""",
)
def _(lib):
    return ops.impact(lib.documents.where("format = 'pdf'"), {"pages": lib.pages, "chunks": lib.chunks, "doc_relations": lib.relations})


@query(
    "S25_duplicate_names",
    """, u AS (SELECT user_id, 'Doc_' || user_id || '.pdf' AS filename, strftime(min(ts), '%Y-%m-%d') AS registered_at, count(*) AS size_bytes FROM events GROUP BY user_id)
SELECT u.user_id, sha256(u.filename || '_' || registered_at || '_' || size_bytes) AS registration_id, d.doc_id AS existing_doc_id, d.doc_id IS NOT NULL AS is_duplicate, false AS forced FROM u LEFT JOIN lib_documents d ON u.filename = d.filename""",
)
def _(lib):
    up = lib.given("events").groupBy("user_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("registered_at"), F.count("*").alias("size_bytes")).withColumn("filename", F.concat(F.lit("Doc_"), F.col("user_id").cast("string"), F.lit(".pdf")))
    forced = ops.duplicate_names(up, lib.documents, force=True).select("user_id", F.col("is_duplicate").alias("forced"))
    return ops.duplicate_names(up, lib.documents).join(forced, "user_id").select("user_id", "registration_id", "existing_doc_id", "is_duplicate", "forced")


@query("F01_document_by_id", "SELECT k.doc_id, d.filename, d.lang, d.format AS kind FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS doc_id FROM events) k LEFT JOIN lib_documents d ON k.doc_id = d.doc_id")
def _(lib):
    keys = lib.given("events").select(F.col("user_id").cast("string").alias("doc_id"))
    stored = lib.documents.select("doc_id", "filename", F.to_json(F.struct("lang", F.struct("format").alias("file"))).alias("metadata"))
    found = ops.lookup(stored, keys, "doc_id", {"metadata": "lang string, file struct<format: string>"})
    return found.select("doc_id", "filename", "metadata.lang", F.col("metadata.file.format").alias("kind"))


@query("F02_markdown", "SELECT doc_id, md5(markdown) AS markdown_md5 FROM lib_documents")
def _(lib):
    return lib.documents.select("doc_id", F.md5("markdown").alias("markdown_md5"))


@query("F03_document_list", "SELECT doc_id, filename, created_at FROM lib_documents WHERE format IN ('pdf', 'md') AND project_id = 'src0'")
def _(lib):
    return ops.listed(lib.documents, ["pdf", "md"], "src0").select("doc_id", "filename", "created_at")


@query("F04_project_list", "SELECT project_id, name, created_at FROM lib_projects ORDER BY created_at DESC, project_id LIMIT 10")
def _(lib):
    return lib.projects.orderBy(F.desc("created_at"), "project_id").limit(10).select("project_id", "name", "created_at")


@query("F05_project_counts", "SELECT p.project_id, count(d.doc_id) AS document_count FROM lib_projects p LEFT JOIN lib_documents d ON p.project_id = d.project_id GROUP BY p.project_id")
def _(lib):
    return ops.project_counts(lib.projects, lib.documents).select("project_id", "document_count")


@query("F06_pages_of_document", "SELECT id, doc_id, page_num, n_chunks FROM lib_pages WHERE doc_id IN (SELECT doc_id FROM lib_documents WHERE format = 'md')")
def _(lib):
    return lib.pages.join(lib.documents.where("format = 'md'"), "doc_id", "left_semi").select("id", "doc_id", "page_num", "n_chunks")


@query("F07_chunks_of_document", "SELECT id, doc_id, page_num, word_count FROM lib_chunks WHERE doc_id IN (SELECT doc_id FROM lib_documents WHERE format = 'mp3')")
def _(lib):
    return lib.chunks.join(lib.documents.where("format = 'mp3'"), "doc_id", "left_semi").select("id", "doc_id", "page_num", "word_count")


@query("F10_name_search", "SELECT doc_id, filename FROM lib_documents WHERE contains(lower(filename), 'c_1')")
def _(lib):
    return ops.name_contains(lib.documents, "C_1").select("doc_id", "filename")


@query("F11_group_filter", "SELECT doc_id, filename FROM lib_documents WHERE format IN ('doc', 'docx', 'pptx', 'xlsx')")
def _(lib):
    return ops.of_group(lib.documents, "office").select("doc_id", "filename")


@query("F13_page_with_total", "SELECT doc_id, filename, (SELECT count(*) FROM lib_documents) AS total FROM lib_documents ORDER BY lower(filename) DESC, doc_id LIMIT 25 OFFSET 25")
def _(lib):
    return ops.page_with_total(lib.documents, "name_desc", 25, 25).select("doc_id", "filename", "total")


@query(
    "F14_listing_rollup",
    """SELECT d.doc_id, coalesce(p.n, 0) AS page_count, coalesce(c.n, 0) AS chunk_count, coalesce(p.n, 0) > 0 AS has_images FROM lib_documents d
LEFT JOIN (SELECT doc_id, count(*) n FROM lib_pages GROUP BY 1) p ON d.doc_id = p.doc_id LEFT JOIN (SELECT doc_id, count(*) n FROM lib_chunks GROUP BY 1) c ON d.doc_id = c.doc_id""",
)
def _(lib):
    return ops.roll_up(lib.documents, lib.pages, lib.chunks).select("doc_id", "page_count", "chunk_count", "has_images")


@query(
    "F15_document_detail",
    """SELECT d.doc_id, CASE WHEN EXISTS (SELECT 1 FROM lib_chunks c WHERE c.doc_id = d.doc_id) THEN 'visual,text' ELSE '' END AS collections,
num % 3 = 0 AS vtt_available, coalesce(num % 3 = 0 AND lang = 'en', false) AS markdown_available, false AS has_timestamps FROM lib_documents d""",
)
def _(lib):
    told = F.when(F.col("num") % 3 == 0, F.to_json(F.struct(F.lit(True).alias("vtt_available"), (F.col("lang") == "en").alias("markdown_available"))))
    d = ops.detail(lib.documents.withColumn("metadata", told), lib.pages, lib.chunks)
    return d.select("doc_id", F.array_join("collections", ",").alias("collections"), "vtt_available", "markdown_available", "has_timestamps")


@query("F15_collections", "SELECT d.doc_id, CASE WHEN EXISTS (SELECT 1 FROM lib_chunks c WHERE c.doc_id = d.doc_id) THEN 'visual,text' ELSE '' END AS collections FROM lib_documents d")
def _(lib):
    return ops.roll_up(lib.documents, lib.pages, lib.chunks).select("doc_id", F.array_join("collections", ",").alias("collections"))


PAD = "lpad(CAST(page_num AS VARCHAR), greatest(3, CAST(length(CAST(page_num AS VARCHAR)) AS INTEGER)), '0')"


@query("F16_page_paths", f"SELECT id, '/images/' || doc_id || CASE WHEN page_num % 2 = 0 THEN '/p' || page_num ELSE '/page' || {PAD} END || '.png' AS image_path, '/images/' || doc_id || '/page' || {PAD} || '_thumb.jpg' AS thumb_path FROM lib_pages")
def _(lib):
    stored = F.concat(F.lit("data/page_images/"), "doc_id", F.lit("/p"), F.col("page_num").cast("string"), F.lit(".png"))
    told = F.when(F.col("page_num") % 2 == 0, F.to_json(F.struct(stored.alias("image_path"))))
    return ops.page_info(lib.pages.withColumn("structure", told)).select("id", "image_path", "thumb_path")


@query("F17_chunk_info", "SELECT id, start_time IS NOT NULL AS has_timestamps, word_count FROM lib_chunks")
def _(lib):
    return lib.chunks.select("id", F.col("start_time").isNotNull().alias("has_timestamps"), "word_count")


@query(
    "F18_first_thumbnail",
    """SELECT d.doc_id, CASE WHEN num % 4 < 2 THEN '/images/' || d.doc_id || '/page001.png' WHEN num % 4 = 2 THEN '/images/' || d.doc_id || '/t.jpg' END AS thumbnail
FROM lib_documents d WHERE EXISTS (SELECT 1 FROM lib_pages p WHERE p.doc_id = d.doc_id)""",
)
def _(lib):
    p = lib.pages.join(lib.documents.select("doc_id", "num"), "doc_id")
    body, kind = F.encode("id", "UTF-8"), F.col("num") % 4
    held = p.select("doc_id", "page_num", F.when(kind == 0, body).alias("thumb"), F.when(kind == 1, body).alias("image"), F.when(kind == 2, F.concat(F.lit("data/"), "doc_id", F.lit("/t.jpg"))).alias("thumb_path"))
    return ops.first_page(held).select("doc_id", "thumbnail")


JOBS = """, j AS (SELECT doc_id, status, changes, queued_at, list_extract(['pdf', 'md', 'mp3', 'docx', 'png'], CAST(changes % 5 AS INTEGER) + 1) AS f,
CASE status WHEN 'completed' THEN 'completed' WHEN 'failed' THEN 'error' ELSE 'processing' END AS state FROM lib_jobs)"""


def _job_records(lib):
    kind = F.element_at(F.array(*[F.lit(f) for f in FORMATS]), (F.col("changes") % 5 + 1).cast("int"))
    told = F.struct(kind.alias("format"), (F.col("changes") * 100).alias("file_size"), F.when(F.col("changes") % 2 == 0, F.col("changes")).alias("text_chunks"))
    error = F.when(F.col("status") == "failed", F.concat(F.lit("failed after "), F.col("changes").cast("string")))
    jobs = lib.jobs.select("doc_id", F.concat("doc_id", F.lit("."), kind).alias("filename"), "status", F.lit(0.5).alias("progress"), F.col("status").alias("stage"), error.alias("error"), F.col("queued_at").alias("started_at"), F.when(F.col("status") == "completed", F.col("updated_at")).alias("completed_at"), F.to_json(told).alias("metadata"))
    return ops.status_records(jobs)


@query("F19_status_list", JOBS + " SELECT doc_id AS id, state AS status, upper(f) AS file_type FROM j WHERE state IN ('completed', 'error') AND f IN ('pdf', 'md') ORDER BY lower(doc_id || '.' || f), doc_id LIMIT 50 OFFSET 5")
def _(lib):
    return ops.status_list(_job_records(lib), "completed, Error", "pdf,MD", "name", "asc", 50, 5).select("id", "status", "file_type")


@query("F19_status_orders", JOBS + """, a AS (SELECT 'date' AS mode, doc_id AS id FROM j ORDER BY queued_at DESC, doc_id LIMIT 20), b AS (SELECT 'status' AS mode, doc_id AS id FROM j ORDER BY state, doc_id LIMIT 20), c AS (SELECT 'name' AS mode, doc_id AS id FROM j ORDER BY lower(doc_id || '.' || f) DESC, doc_id LIMIT 20), d AS (SELECT 'oldest' AS mode, doc_id AS id FROM j ORDER BY queued_at, doc_id LIMIT 20)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d""")
def _(lib):
    r = _job_records(lib)
    modes = (("date", "date", "desc"), ("status", "status", "asc"), ("name", "name", "desc"), ("oldest", "date", "asc"))
    pages = [ops.status_list(r, sort_by=by, sort_order=way, limit=20).select(F.lit(mode).alias("mode"), "id") for mode, by, way in modes]
    return reduce(DataFrame.unionByName, pages)


@query(
    "F21_status_records",
    JOBS + """ SELECT doc_id AS id, state AS status, upper(f) AS file_type, changes * 100 AS size_bytes, CASE WHEN state = 'completed' AND changes % 2 = 0 THEN changes END AS chunk_count,
CASE WHEN state <> 'completed' THEN status END AS stage, CASE WHEN state = 'error' THEN 'failed after ' || changes END AS error FROM j""",
)
def _(lib):
    return _job_records(lib).select("id", "status", "file_type", "metadata.size_bytes", "embeddings.chunk_count", F.col("processing.current_stage").alias("stage"), F.col("processing.error_message").alias("error"))


@query("F20_interface_state", "SELECT doc_id, CASE status WHEN 'completed' THEN 'completed' WHEN 'failed' THEN 'error' ELSE 'processing' END AS state FROM lib_jobs")
def _(lib):
    return lib.jobs.select("doc_id", ops.interface_state("status").alias("state"))


@query("F22_totals", "SELECT (SELECT count(*) FROM lib_documents) AS documents, (SELECT count(*) FROM lib_pages) AS pages, (SELECT count(*) FROM lib_chunks) AS chunks")
def _(lib):
    return ops.totals(lib.documents, lib.pages, lib.chunks)


@query("F23_id_check", "SELECT id, regexp_full_match(id, '[a-zA-Z0-9\\-]{8,64}') AS ok FROM lib_chunks")
def _(lib):
    return lib.chunks.select("id", ops.id_check("id").alias("ok"))


@query("F24_chunk_id", "SELECT id, CASE WHEN pos < 10000 THEN doc_id END AS parsed_doc, CASE WHEN pos < 10000 THEN CAST(pos AS INTEGER) END AS number FROM lib_chunks")
def _(lib):
    return lib.chunks.select("id", ops.parsed_chunk_id("id").alias("p")).select("id", F.col("p.doc_id").alias("parsed_doc"), "p.number")


@query("F25_chunk_consistency", "SELECT id, doc_id FROM (SELECT id, CASE WHEN pos % 2 = 1 THEN doc_id || 'x' ELSE doc_id END AS doc_id, pos FROM lib_chunks) WHERE pos % 2 = 1 OR pos >= 10000")
def _(lib):
    moved = lib.chunks.withColumn("doc_id", F.when(F.col("pos") % 2 == 1, F.concat("doc_id", F.lit("x"))).otherwise(F.col("doc_id")))
    return ops.inconsistent_chunks(moved).select("id", "doc_id")


@query("F26_path_url", "SELECT page_id, CASE WHEN contains(url, '/') THEN '/images/' || array_to_string(list_slice(string_split(url, '/'), -2, -1), '/') ELSE url END AS u FROM pages")
def _(lib):
    return lib.given("pages").select("page_id", ops.path_to_url("url").alias("u"))


@query("F27_details_url", "SELECT id, '/details/' || doc_id || '?page=' || page_num || '&chunk=' || id AS u FROM lib_chunks")
def _(lib):
    return lib.chunks.select("id", ops.details_url("doc_id", F.col("page_num"), F.col("id")).alias("u"))


@query("F28_file_kind", "SELECT doc_id, CASE WHEN format IN ('mp3', 'wav') THEN 'audio' ELSE 'document' END AS kind FROM lib_documents")
def _(lib):
    return lib.documents.select("doc_id", ops.file_kind("filename").alias("kind"))


@query("F29_header_safe")
def _(lib):
    return lib.chunks.select("id", ops.header_safe("section_path").alias("safe"))


@query("F30_download_name", "SELECT doc_id, 'Doc_' || doc_id AS name FROM lib_documents")
def _(lib):
    return lib.documents.select("doc_id", ops.download_name("filename").alias("name"))


@query("F31_format_dimension", "SELECT * FROM (VALUES ('pdf', '.pdf'), ('audio', '.mp3'), ('office', '.docx'), ('text', '.md'), ('images', '.png')) t(group_name, extensions) WHERE (SELECT count(DISTINCT format) FROM lib_documents) = 5")
def _(lib):
    return ops.format_dimension(lib.spark, lib.documents)
