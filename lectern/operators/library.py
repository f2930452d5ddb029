"""Table maintenance (S) and reads (F) of the document library as DataFrame functions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.graph import numbered
from lectern.sources.derived import padded
from lectern.sources.schemas import KEYS, REQUIRED, conform

# Fixed values of the library: extension groups, interface states, identifier patterns.
GROUPS = {
    "pdf": [".pdf"],
    "audio": [".mp3", ".wav"],
    "office": [".doc", ".docx", ".pptx", ".xlsx"],
    "text": [".md", ".asciidoc", ".csv", ".vtt", ".html", ".xhtml"],
    "images": [".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".webp"],
}
INTERFACE_STATES = {"completed": "completed", "failed": "error"}
DOC_ID = r"^[a-zA-Z0-9\-]{8,64}$"
CHUNK_ID = r"^(.+)-chunk(\d{4})$"
SLUG = r"^[a-z0-9][a-z0-9_-]{0,127}$"
DEFAULT_PROJECT = "default"


# ---- maintenance -------------------------------------------------------------------------------------------------


def with_rejects(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(rows conforming to ``table``, rows that lack a required column) (S-04, S-05)."""
    bad = reduce(Column.__or__, [F.col(c).isNull() for c in REQUIRED.get(table, KEYS[table])])
    return conform(df.where(~bad), table), df.where(bad).withColumn("reason", F.lit("missing required value"))


def split_new(incoming: DataFrame, existing: DataFrame, key: list[str], order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is new, duplicates with a reason); of equal keys in one batch the first counts (S-06, S-07)."""
    first = Window.partitionBy(*key).orderBy(*(order or [F.col(c) for c in incoming.columns if c not in key] or [F.lit(1)]))
    numbered = incoming.withColumn("__n", F.row_number().over(first))
    known = existing.select(*key).distinct()
    fresh = numbered.where("__n = 1").join(known, key, "left_anti").drop("__n")
    held = numbered.where("__n = 1").join(known, key, "left_semi").drop("__n").withColumn("reason", F.lit("key exists"))
    again = numbered.where("__n > 1").drop("__n").withColumn("reason", F.lit("repeated in batch"))
    return fresh, held.unionByName(again)


def valid_slug(name: str = "project_id") -> Column:
    return F.col(name).rlike(SLUG)


def checked_relations(incoming: DataFrame, documents: DataFrame, existing: DataFrame) -> DataFrame:
    """``incoming`` with a reason (null: to be stored): both ends must exist and the edge be new (S-08, E-09)."""
    key = KEYS["doc_relations"]
    ids = documents.select("doc_id").distinct()
    first = Window.partitionBy(*key).orderBy(*key)
    return (
        incoming.withColumn("__n", F.row_number().over(first))
        .join(ids.select(F.col("doc_id").alias("src_doc_id"), F.lit(True).alias("__s")), "src_doc_id", "left")
        .join(ids.select(F.col("doc_id").alias("dst_doc_id"), F.lit(True).alias("__d")), "dst_doc_id", "left")
        .join(existing.select(*key).distinct().withColumn("__e", F.lit(True)), key, "left")
        .withColumn("reason", F.when(F.col("__s").isNull(), "source missing").when(F.col("__d").isNull(), "target missing").when(F.col("__e") | (F.col("__n") > 1), "edge exists"))
        .drop("__n", "__s", "__d", "__e")
    )


def patched(table: DataFrame, patch: DataFrame, key: list[str], allowed: list[str], order: Column | None = None) -> DataFrame:
    """``table`` with the values of ``patch`` in allowed columns; ids that are not in it are a no-op (S-09, S-10).

    A null of the patch leaves the value alone; columns that its array ``cleared`` names are set to null. Of patch rows that
    repeat an id the last by ``order`` counts, without it the one of the greatest values.
    """
    take = [c for c in allowed if c in patch.columns]
    none = F.array().cast("array<string>")
    values = [(F.to_json(c) if isinstance(patch.schema[c].dataType, (T.StructType, T.MapType)) else F.col(c)).alias(c) for c in take]
    row = F.struct(*values, (F.coalesce("cleared", none) if "cleared" in patch.columns else none).alias("cleared"))
    p = patch.groupBy(*key).agg(F.max_by(row, order if order is not None else row).alias("__p"))

    def value(c: str) -> Column:
        given = F.coalesce(F.col(f"__p.{c}"), F.col(c)) if c in take else F.col(c)
        return F.when(F.array_contains("__p.cleared", c), None).otherwise(given).alias(c)

    return table.join(p, key, "left").select(*[value(c) if c in allowed else F.col(c) for c in table.columns])


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the documents ``gone(doc_id)``, their pages and chunks, and relations on either end (S-11)."""
    ids = gone.select("doc_id").distinct()
    out = {t: df.join(ids, "doc_id", "left_anti") for t, df in tables.items() if t in ("documents", "pages", "chunks")}
    if "doc_relations" in tables:
        ends = [ids.select(F.col("doc_id").alias(c)) for c in ("src_doc_id", "dst_doc_id")]
        out["doc_relations"] = tables["doc_relations"].join(ends[0], "src_doc_id", "left_anti").join(ends[1], "dst_doc_id", "left_anti").select(*tables["doc_relations"].columns)
    return {**tables, **out}


def delete_project(tables: dict[str, DataFrame], project_id: str) -> tuple[dict[str, DataFrame], int]:
    """(tables without a project and all its documents, number of documents); the default project stays (S-12)."""
    if project_id == DEFAULT_PROJECT:
        raise ValueError("the default project can't be deleted")
    gone = tables["documents"].where(F.col("project_id") == project_id).select("doc_id")
    out = cascade_delete(tables, gone)
    if "projects" in tables:
        out["projects"] = tables["projects"].where(F.col("project_id") != project_id)
    return out, gone.count()


def without_relation(relations: DataFrame, gone: DataFrame) -> DataFrame:
    """Relations but for the given (src, dst, type) (S-13)."""
    return relations.join(gone.select(*KEYS["doc_relations"]).distinct(), KEYS["doc_relations"], "left_anti")


def replace_type(relations: DataFrame, relation_type: str, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations with those of one type replaced, one-row count of the rows deleted) (S-14)."""
    kept, deleted = delete_where(relations, F.col("relation_type") == relation_type)
    return kept.unionByName(fresh, allowMissingColumns=True), deleted


def write_relations(relations: DataFrame, path: str) -> None:
    """Overwrites only the relation types that ``relations`` holds: one partition folder a type (S-14)."""
    relations.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("relation_type").parquet(path)


def delete_where(table: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one-row count of rows deleted); a null condition keeps its row (S-15)."""
    hit = F.coalesce(condition, F.lit(False))
    return table.where(~hit), table.agg(F.count_if(hit).alias("deleted"))


def seeded_projects(projects: DataFrame) -> DataFrame:
    """Projects with the default one added if absent (S-17)."""
    seed = conform(projects.sparkSession.range(1).select(F.lit(DEFAULT_PROJECT).alias("project_id"), F.lit("Default").alias("name")), "projects")
    return projects.unionByName(seed.join(projects, "project_id", "left_anti").select(*seed.columns), allowMissingColumns=True)


def intake(files: DataFrame, cap: int) -> DataFrame:
    """Files of a binaryFile source with doc_id (content hash), and whether they exceed the size cap (S-18)."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.sha2("content", 256).alias("doc_id"), name.alias("filename"), F.col("length").alias("size_bytes"), (F.col("length") > cap).alias("too_large"), "modificationTime")


def suffixed_names(uploads: DataFrame, order: list[str]) -> DataFrame:
    """Uploads with stored_name: the second of a name gets _1, the third _2 (S-19). A frequent name spreads over tasks."""
    stem, ext = F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 2)
    n = F.col("__n") - 1
    name = F.when(n == 0, F.col("filename")).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext))
    return numbered(uploads, order, "__n", within="filename").withColumn("stored_name", name).drop("__n")


def extension(name: str | Column) -> Column:
    """Lower-case extension without its dot, empty if there is none."""
    return F.lower(F.regexp_extract(F.col(name) if isinstance(name, str) else name, r"\.([^./]*)$", 1))


def upload_check(name: str, size: str, supported: list[str], max_mb: int) -> Column:
    """struct(ok, message) for a file name and size (S-20)."""
    ext = extension(name)
    message = F.when(~ext.isin(supported), F.concat(F.lit("Unsupported format: ."), ext)).when(
        F.col(size) > max_mb * 1024 * 1024, F.concat(F.lit("File too large: "), F.col(size).cast("string"), F.lit(f" bytes (max {max_mb}MB)"))
    )
    return F.struct(message.isNull().alias("ok"), F.coalesce(message, F.lit("")).alias("message"))


def as_json(df: DataFrame) -> Column:
    """A row as JSON without its binary columns (S-21)."""
    return F.to_json(F.struct(*[F.col(f.name) for f in df.schema if not isinstance(f.dataType, T.BinaryType)]))


def impact(gone: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per child table for each document to be deleted (S-24)."""
    out = gone.select("doc_id").distinct()
    for name in ("pages", "chunks"):
        counted = tables[name].join(out, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias(name))
        out = out.join(counted, "doc_id", "left")
    r = tables["doc_relations"]
    ends = r.select(F.col("src_doc_id").alias("doc_id")).unionByName(r.where("src_doc_id <> dst_doc_id").select(F.col("dst_doc_id").alias("doc_id")))
    return out.join(ends.groupBy("doc_id").agg(F.count("*").alias("relations")), "doc_id", "left").fillna(0, ["pages", "chunks", "relations"])


def duplicate_names(uploads: DataFrame, documents: DataFrame, force: bool = False) -> DataFrame:
    """Uploads (filename, registered_at, size_bytes) with the newest document of their name and a registration id (S-25).

    ``force`` takes every upload for new.
    """
    newest = documents.groupBy("filename").agg(F.max_by("doc_id", F.struct("created_at", "doc_id")).alias("existing_doc_id"))
    held = uploads.withColumn("registration_id", registration_id("filename", "registered_at", "size_bytes"))
    if force:
        return held.withColumn("existing_doc_id", F.lit(None).cast("string")).withColumn("is_duplicate", F.lit(False))
    return held.join(newest, "filename", "left").withColumn("is_duplicate", F.col("existing_doc_id").isNotNull())


def registration_id(name: str, time: str, size: str) -> Column:
    return F.sha2(F.concat_ws("_", F.col(name), F.col(time).cast("string"), F.col(size).cast("string")), 256)


# ---- reads -------------------------------------------------------------------------------------------------------


def lookup(table: DataFrame, keys: DataFrame, key: str, parsed: dict[str, str]) -> DataFrame:
    """One row for each key, its values null where the table has none, JSON columns read by their schemas (F-01, F-08)."""
    joined = keys.select(key).distinct().join(table, key, "left")
    return joined.withColumns({c: F.from_json(c, kind) for c, kind in parsed.items()})


def page_images(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, page_num, image) of the asked pages that hold an image (F-09)."""
    return pages.join(asked.select("doc_id", "page_num").distinct(), ["doc_id", "page_num"], "left_semi").where(_held("image", pages)).select("doc_id", "page_num", "image")


def _held(column: str, df: DataFrame) -> Column:
    """Whether a binary column is there and not empty."""
    return F.coalesce(F.octet_length(column) > 0, F.lit(False)) if column in df.columns else F.lit(False)


def listed(documents: DataFrame, formats: list[str] | None = None, project_id: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Newest first, with optional format and project (F-03)."""
    if formats:
        documents = documents.where(F.col("format").isin(formats))
    if project_id:
        documents = documents.where(F.col("project_id") == project_id)
    ordered = documents.orderBy(F.desc("created_at"), "doc_id")
    return ordered.offset(offset).limit(limit) if limit is not None else ordered


def project_counts(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """Projects with their number of documents (F-05)."""
    n = documents.groupBy("project_id").agg(F.count("*").alias("document_count"))
    return projects.join(n, "project_id", "left").withColumn("document_count", F.coalesce("document_count", F.lit(0)))


def roll_up(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with page_count, chunk_count and collections: visual if pages, text if chunks (F-14, F-15)."""
    p = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    c = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    joined = documents.join(p, "doc_id", "left").join(c, "doc_id", "left").fillna(0, ["page_count", "chunk_count"])
    kinds = F.array_compact(F.array(F.when(F.col("page_count") > 0, F.lit("visual")), F.when(F.col("chunk_count") > 0, F.lit("text"))))
    return joined.withColumn("has_images", F.col("page_count") > 0).withColumn("collections", kinds)


FLAGS = "vtt_available boolean, markdown_available boolean, has_word_timestamps boolean"


def detail(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """``roll_up`` with the flags of the documents' metadata, false where it doesn't tell (F-15)."""
    told = F.from_json("metadata", FLAGS)
    flags = {name: F.coalesce(told[name], F.lit(False)) for name in ("vtt_available", "markdown_available", "has_word_timestamps")}
    return roll_up(documents, pages, chunks).withColumns(flags).withColumnRenamed("has_word_timestamps", "has_timestamps")


def name_contains(documents: DataFrame, text: str) -> DataFrame:
    """Case-insensitive literal substring of the file name (F-10)."""
    return documents.where(F.lower("filename").contains(text.lower()))


def of_group(documents: DataFrame, group: str) -> DataFrame:
    """Documents of an extension group; ``all`` and unknown groups keep every one (F-11)."""
    if group not in GROUPS:
        return documents
    return documents.where(F.concat(F.lit("."), extension("filename")).isin(GROUPS[group]))


SORTS = {
    "newest_first": [F.desc, "created_at"],
    "oldest_first": [F.asc, "created_at"],
    "name_asc": [F.asc, "filename"],
    "name_desc": [F.desc, "filename"],
}


def sorted_documents(documents: DataFrame, mode: str) -> DataFrame:
    way, column = SORTS[mode]
    return documents.orderBy(way(F.lower(column) if column == "filename" else F.col(column)), "doc_id")


def page_with_total(documents: DataFrame, mode: str, limit: int, offset: int = 0) -> DataFrame:
    """One page of a sorted list, each row with the total before paging (F-13)."""
    total = documents.agg(F.count("*").alias("total"))
    return sorted_documents(documents, mode).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def interface_state(status: str) -> Column:
    """Four-state view of a job status; unknown ones are processing (F-20)."""
    return F.coalesce(*[F.when(F.col(status) == k, F.lit(v)) for k, v in INTERFACE_STATES.items()], F.lit("processing"))


JOB_METADATA = "format string, file_size long, author string, published string, pages long, visual_embeddings long, text_embeddings long, text_chunks long"


def status_records(jobs: DataFrame) -> DataFrame:
    """Interface records of jobs (F-21).

    The type is in upper case; embedding counts are told of completed jobs that have any, progress of unfinished and failed
    ones, the error of failed ones only. Empty metadata is null.
    """
    m, state = F.from_json("metadata", JOB_METADATA), interface_state("status")
    said = lambda c: F.when(c != "", c)
    some = lambda c: F.when(c > 0, c)
    pages = F.coalesce(some(m["pages"]), some(F.col("total_pages")) if "total_pages" in jobs.columns else F.lit(None))
    told = F.struct(said(m["author"]).alias("author"), said(m["published"]).alias("published"), pages.cast("long").alias("pages"), some(m["file_size"]).alias("size_bytes"))
    counts = {k: F.coalesce(m[f], F.lit(0)) for k, f in (("visual_count", "visual_embeddings"), ("text_count", "text_embeddings"), ("chunk_count", "text_chunks"))}
    embeddings = F.struct(*[c.alias(k) for k, c in counts.items()])
    error = F.when(state == "error", F.col("error"))
    return jobs.select(
        F.col("doc_id").alias("id"),
        F.col("filename").alias("title"),
        state.alias("status"),
        F.upper(F.coalesce(m["format"], F.lit("unknown"))).alias("file_type"),
        F.when(F.coalesce(told["author"], told["published"], told["pages"].cast("string"), told["size_bytes"].cast("string")).isNotNull(), told).alias("metadata"),
        F.when((state == "completed") & (F.greatest(*counts.values()) > 0), embeddings).alias("embeddings"),
        F.when(state != "completed", F.struct("progress", F.col("stage").alias("current_stage"), error.alias("error_message"))).alias("processing"),
        F.col("started_at").alias("created_at"),
        F.col("completed_at").alias("processed_at"),
    )


def status_list(records: DataFrame, status: str | None = None, file_type: str | None = None, sort_by: str = "date", sort_order: str = "desc", limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of ``status_records`` by comma-separated states and types, sorted by date, name or status (F-19)."""
    listed_in = lambda text, case: [case(x.strip()) for x in text.split(",")]
    if status:
        records = records.where(F.col("status").isin(listed_in(status, str.lower)))
    if file_type:
        records = records.where(F.col("file_type").isin(listed_in(file_type, str.upper)))
    by = {"name": F.lower("title"), "status": F.col("status")}.get(sort_by, F.col("created_at"))
    return records.orderBy(by.desc() if sort_order.lower() == "desc" else by.asc(), "id").offset(offset).limit(limit)


def totals(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, pages and chunks (F-22)."""
    counts = [df.agg(F.count("*").alias(n)) for n, df in (("documents", documents), ("pages", pages), ("chunks", chunks))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


def id_check(column: str, pattern: str = DOC_ID) -> Column:
    return F.coalesce(F.col(column).rlike(pattern), F.lit(False))


def parsed_chunk_id(column: str = "id") -> Column:
    """struct(doc_id, number) of a chunk id, null if it is none (F-24)."""
    ok = F.col(column).rlike(CHUNK_ID)
    return F.when(ok, F.struct(F.regexp_extract(column, CHUNK_ID, 1).alias("doc_id"), F.regexp_extract(column, CHUNK_ID, 2).cast("int").alias("number")))


def inconsistent_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks whose id names another document (F-25)."""
    parsed = parsed_chunk_id("id")
    return chunks.where(parsed.isNull() | (parsed["doc_id"] != F.col("doc_id")))


def page_path(suffix: str) -> Column:
    """The conventional address of a page's picture."""
    return F.concat(F.lit("/images/"), F.col("doc_id"), F.lit("/page"), padded(F.col("page_num"), 3), F.lit(suffix))


def page_info(pages: DataFrame) -> DataFrame:
    """Image and thumbnail addresses of pages: what their structure names, else the conventional ones (F-16)."""
    told = F.from_json("structure" if "structure" in pages.columns else F.lit(None).cast("string"), "image_path string, thumb_path string")
    return pages.withColumns({c: F.coalesce(path_to_url(told[c]), page_path(end)) for c, end in (("image_path", ".png"), ("thumb_path", "_thumb.jpg"))})


def first_page(pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, thumbnail) of each document's first page (F-18).

    A page that holds a thumbnail or an image is served under its conventional address; else the last two parts of a stored
    thumbnail path; else there is none.
    """
    legacy = F.split(F.col("thumb_path") if "thumb_path" in pages.columns else F.lit(None).cast("string"), "/")
    address = F.when(_held("thumb", pages) | _held("image", pages), page_path(".png")).when(F.size(legacy) >= 2, F.concat(F.lit("/images/"), F.array_join(F.slice(legacy, -2, 2), "/")))
    return pages.groupBy("doc_id").agg(F.min("page_num").alias("page_num"), F.min_by(F.struct(address.alias("t")), "page_num")["t"].alias("thumbnail"))


def path_to_url(path: str | Column) -> Column:
    """Address of a stored picture by the last two parts of its path; a name without folders and null stay (F-26)."""
    given = F.col(path) if isinstance(path, str) else path
    parts = F.split(given, "/")
    return F.when(F.size(parts) < 2, given).otherwise(F.concat(F.lit("/images/"), F.array_join(F.slice(parts, -2, 2), "/")))


def details_url(doc_id: str, page: Column | None = None, chunk: Column | None = None, base: str = "") -> Column:
    """/details/<doc>?page=..&chunk=..; pages below 1 and blank chunks are left out (F-27)."""
    parts = []
    if page is not None:
        parts.append(F.when(page >= 1, F.concat(F.lit("page="), page.cast("string"))))
    if chunk is not None:
        parts.append(F.when(F.trim(chunk) != "", F.concat(F.lit("chunk="), F.url_encode(F.trim(chunk)))))
    query = F.concat_ws("&", *parts) if parts else F.lit("")
    path = F.concat(F.lit(base + "/details/"), F.col(doc_id))
    return F.when(query != "", F.concat(path, F.lit("?"), query)).otherwise(path)


def file_kind(name: str) -> Column:
    """audio or document by extension (F-28)."""
    return F.when(extension(name).isin("mp3", "wav"), "audio").otherwise("document")


def header_safe(name: str) -> Column:
    """ASCII file name for a header: compatibility forms decomposed, other characters dropped, spaces single (F-29)."""
    @F.pandas_udf(T.StringType())
    def of(names: pd.Series) -> pd.Series:
        return names.map(lambda s: s if s is None else " ".join(unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().split()))

    return of(F.col(name))


def download_name(name: str) -> Column:
    """Base name without extension and reserved characters, at most 200, else 'document' (F-30)."""
    stem = F.regexp_replace(F.element_at(F.split(F.col(name), "/"), -1), r"(?<=.)\.[^.]*$", "")
    clean = F.regexp_replace(stem, r'[\x00-\x1F<>:"|?*\\/]', "")
    trimmed = F.substring(F.regexp_replace(clean, r"^[. ]+|[. ]+$", ""), 1, 200)
    return F.coalesce(F.when(trimmed != "", trimmed), F.lit("document"))


def format_dimension(spark, supported: DataFrame) -> DataFrame:
    """Groups with their supported extensions, empty groups dropped (F-31)."""
    rows = [(g, e) for g, es in GROUPS.items() for e in es]
    groups = spark.createDataFrame(rows, "group_name string, extension string")
    held = supported.select(F.concat(F.lit("."), F.col("format")).alias("extension")).distinct()
    return groups.join(held, "extension", "left_semi").groupBy("group_name").agg(F.array_join(F.sort_array(F.collect_list("extension")), ",").alias("extensions"))


def append(df: DataFrame, table: str, path: str) -> None:
    """Appends rows that conform to ``table`` to its Parquet folder (S-03)."""
    conform(df, table).write.mode("append").parquet(path)
