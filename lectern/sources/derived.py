"""The library tables as views over the given tables, once for Spark and once as SQL text.

``library(spark, sf_dir)`` offers them as lazy DataFrames; ``with_views(body)`` puts the SQL of those that ``body``
names before it.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Formats by doc_id modulo 5, job states by event type, window and step in words.
FORMATS = ["pdf", "md", "mp3", "docx", "png"]
STATES = {"signup": "queued", "view": "parsing", "click": "embedding_text", "purchase": "completed", "error": "failed"}
WINDOW, STEP, PER_PAGE = 250, 200, 3


def words(text: str):
    """Words between runs of space, tab and line ends."""
    return F.filter(F.split(F.col(text), "[ \\t\\r\\n]+"), lambda w: w != "")


def word_windows(df: DataFrame, text: str = "text", size: int = WINDOW, step: int = STEP, first: int = 0) -> DataFrame:
    """Adds (pos, chunk_text, word_count): overlapping windows of ``size`` words every ``step`` (I-16); with ``first`` also that many first words."""
    split = df.where(F.col(text).rlike("[^ \\t\\r\\n]")).withColumn("__w", words(text))  # has a word; counting them here would split each text twice
    starts = F.sequence(F.lit(0), F.size("__w") - 1, F.lit(step))
    exploded = split.select("*", F.posexplode(starts).alias("pos", "__s")).withColumn("__p", F.slice("__w", F.col("__s") + 1, F.lit(size)))
    if first:
        exploded = exploded.withColumn("first_words", F.slice("__w", F.col("__s") + 1, F.lit(first)))
    return exploded.withColumn("chunk_text", F.array_join("__p", " ")).withColumn("word_count", F.size("__p").cast("long")).drop("__w", "__s", "__p")


def padded(number: Column, width: int) -> Column:
    """Digits with leading zeros; longer numbers stay whole, which lpad alone would cut."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), "0")


def following(df: DataFrame, group: list[str], order: str, value: str, per_bucket: int = 100_000) -> DataFrame:
    """(value, o): the value of the next row in the group by a number, which must not repeat.

    Rows meet in buckets of the number only; a bucket's last row is followed by the first of the group's next one, so a
    frequent group spreads over tasks.
    """
    key = F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("none")) for c in group])
    d = df.select(value, order, key.alias("k"), F.floor(F.col(order) / per_bucket).alias("b"))
    firsts = d.groupBy("k", "b").agg(F.min_by(value, order).alias("f"))
    ahead = firsts.select("k", "b", F.lead("f").over(Window.partitionBy("k").orderBy("b")).alias("f"))  # one row a bucket
    inside = F.lead(value).over(Window.partitionBy("k", "b").orderBy(order))
    return d.withColumn("o", inside).join(ahead, ["k", "b"]).select(value, F.coalesce("o", "f").alias("o"))


class Library:
    """Library tables derived from one folder of given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        d = self.given("documents")
        kind = F.element_at(F.array(*[F.lit(f) for f in FORMATS]), (F.col("doc_id") % 5 + 1).cast("int"))
        return d.select(
            F.col("doc_id").cast("string").alias("doc_id"),
            F.col("doc_id").alias("num"),
            F.col("source").alias("project_id"),
            kind.alias("format"),
            F.concat(F.lit("Doc_"), F.col("doc_id").cast("string"), F.lit("."), kind).alias("filename"),
            (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("doc_id").cast("int"))).alias("created_at"),
            F.col("text").alias("markdown"),
            "lang",
        )

    @cached_property
    def chunks(self) -> DataFrame:
        d = self.documents
        c = word_windows(d.select("doc_id", "project_id", "format", "filename", "markdown"), "markdown", first=2)
        timed = F.col("format") == "mp3"
        return c.select(
            F.concat("doc_id", F.lit("-chunk"), padded(F.col("pos"), 4)).alias("id"),
            "doc_id",
            F.floor(F.col("pos") / PER_PAGE + 1).alias("page_num"),
            F.col("pos").cast("long").alias("pos"),
            F.col("chunk_text").alias("text"),
            "word_count",
            F.when(timed, F.col("pos") * 10.0).alias("start_time"),
            F.when(timed, F.col("pos") * 10.0 + 10.0).alias("end_time"),
            F.element_at("first_words", 1).alias("parent_heading"),
            F.array_join("first_words", " > ").alias("section_path"),
        )

    @cached_property
    def pages(self) -> DataFrame:
        return self.chunks.groupBy("doc_id", "page_num").agg(F.count("*").alias("n_chunks"), F.sum("word_count").alias("words")).select(
            F.concat("doc_id", F.lit("-page"), padded(F.col("page_num"), 3)).alias("id"), "doc_id", "page_num", "n_chunks", "words"
        )

    @cached_property
    def projects(self) -> DataFrame:
        return self.documents.where("project_id is not null").groupBy("project_id").agg(F.min("created_at").alias("created_at")).select(
            "project_id", F.initcap("project_id").alias("name"), "created_at"
        )

    @cached_property
    def vectors(self) -> DataFrame:
        """(chunk, doc, tokens): multi-vectors of four tokens."""
        e = self.given("embeddings").where("embedding is not null")
        at = F.floor(F.col("vec_id") / 4)
        return e.groupBy(at.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("t")).select(
            "chunk", F.floor(F.col("chunk") / 5).alias("doc"), F.transform("t", lambda x: x["embedding"]).alias("tokens")
        )

    @cached_property
    def relations(self) -> DataFrame:
        """series_member: next document of the source; same_author: next of the same source and language, both ways."""
        d = self.documents.where("project_id is not null")
        series = following(d, ["project_id"], "num", "doc_id")
        author = following(d, ["project_id", "lang"], "num", "doc_id")
        one = series.where("o is not null").select(F.col("doc_id").alias("src_doc_id"), F.col("o").alias("dst_doc_id"), F.lit("series_member").alias("relation_type"))
        pair = author.where("o is not null").select(F.explode(F.array(F.struct(F.col("doc_id").alias("src_doc_id"), F.col("o").alias("dst_doc_id")), F.struct(F.col("o").alias("src_doc_id"), F.col("doc_id").alias("dst_doc_id")))).alias("p"))
        return one.unionByName(pair.select("p.*", F.lit("same_author").alias("relation_type")))

    @cached_property
    def transitions(self) -> DataFrame:
        """Directed edges between event types that follow each other for a user (cyclic)."""
        e = self.given("events")
        after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
        return e.select(F.col("event_type").alias("src"), after.alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("weight"))

    @cached_property
    def job_events(self) -> DataFrame:
        """(seq, doc_id, status, ts): one state change for each event, keyed by user."""
        e = self.given("events")
        status = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in STATES.items()], F.lit("storing"))
        return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("doc_id"), status.alias("status"), "ts", "value")

    @cached_property
    def jobs(self) -> DataFrame:
        """Current state: the latest change of each job, with when it was first seen and last changed."""
        e = self.job_events
        return e.groupBy("doc_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.min("ts").alias("queued_at"), F.max("ts").alias("updated_at"), F.count("*").alias("changes"))

    @cached_property
    def elements(self) -> DataFrame:
        """Page elements: page, element and box from line items."""
        li = self.given("lineitem")
        x1, y1 = F.col("l_quantity"), F.col("l_linenumber") * F.lit(20.0)
        return li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("element"), x1.alias("x1"), y1.alias("y1"), (x1 + 30).alias("x2"), (y1 + 25).alias("y2"))

    @cached_property
    def answers(self) -> DataFrame:
        """Assistant turns with a marker before each full stop; three sources each."""
        c = self.given("conversations").where("role = 'assistant' and text is not null")
        parts = F.split("text", "\\.")
        marked = F.array_join(
            F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit(" ["), (F.lit(1) + (F.col("conv_id") + i) % 4).cast("string"), F.lit("]"))).otherwise(p)), "."
        )
        return c.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("answer_id"), marked.alias("text"), F.lit(3).alias("num_sources"))


def library(spark: SparkSession, sf_dir: str) -> Library:
    return Library(spark, sf_dir)


VIEWS = {
    "lib_documents": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS num, source AS project_id, f AS format, concat('Doc_', doc_id, '.', f) AS filename,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at, text AS markdown, lang
  FROM (SELECT *, list_extract(['pdf', 'md', 'mp3', 'docx', 'png'], CAST(doc_id % 5 AS INTEGER) + 1) AS f FROM documents)""",
    "lib_windows": """SELECT doc_id, project_id, format, filename, pos, w[pos * 200 + 1 : pos * 200 + 250] AS p FROM (
  SELECT *, unnest(range(CAST(ceil(len(w) / 200.0) AS BIGINT))) AS pos FROM (
    SELECT doc_id, project_id, format, filename, [x FOR x IN regexp_split_to_array(markdown, '[ \\t\\r\\n]+') IF x <> ''] AS w FROM lib_documents) WHERE len(w) > 0)""",
    "lib_chunks": """SELECT doc_id || '-chunk' || lpad(CAST(pos AS VARCHAR), greatest(4, CAST(length(CAST(pos AS VARCHAR)) AS INTEGER)), '0') AS id, doc_id, pos // 3 + 1 AS page_num, pos, array_to_string(p, ' ') AS text,
  CAST(len(p) AS BIGINT) AS word_count, CASE WHEN format = 'mp3' THEN pos * 10.0 END AS start_time, CASE WHEN format = 'mp3' THEN pos * 10.0 + 10.0 END AS end_time,
  p[1] AS parent_heading, array_to_string(p[1:2], ' > ') AS section_path FROM lib_windows""",
    "lib_pages": """SELECT doc_id || '-page' || lpad(CAST(page_num AS VARCHAR), greatest(3, CAST(length(CAST(page_num AS VARCHAR)) AS INTEGER)), '0') AS id, doc_id, page_num, count(*) AS n_chunks, CAST(sum(word_count) AS BIGINT) AS words
  FROM lib_chunks GROUP BY doc_id, page_num""",
    "lib_projects": """SELECT project_id, upper(project_id[1]) || lower(project_id[2:]) AS name, min(created_at) AS created_at FROM lib_documents WHERE project_id IS NOT NULL GROUP BY project_id""",
    "lib_tokens": """SELECT vec_id // 4 AS chunk, vec_id // 20 AS doc, vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL""",
    "lib_relations": """SELECT * FROM (
  SELECT doc_id AS src_doc_id, lead(doc_id) OVER (PARTITION BY project_id ORDER BY num) AS dst_doc_id, 'series_member' AS relation_type FROM lib_documents WHERE project_id IS NOT NULL
  UNION ALL SELECT doc_id, lead(doc_id) OVER (PARTITION BY project_id, lang ORDER BY num), 'same_author' FROM lib_documents WHERE project_id IS NOT NULL
  UNION ALL SELECT lead(doc_id) OVER (PARTITION BY project_id, lang ORDER BY num), doc_id, 'same_author' FROM lib_documents WHERE project_id IS NOT NULL)
  WHERE src_doc_id IS NOT NULL AND dst_doc_id IS NOT NULL""",
    "lib_transitions": """SELECT src, dst, count(*) AS weight FROM (
  SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY src, dst""",
    "lib_job_events": """SELECT event_id AS seq, 'job-' || CAST(user_id AS VARCHAR) AS doc_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'parsing'
  WHEN 'click' THEN 'embedding_text' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'storing' END AS status, ts, value FROM events""",
    "lib_jobs": """SELECT doc_id, arg_max(status, (ts, seq)) AS status, min(ts) AS queued_at, max(ts) AS updated_at, count(*) AS changes FROM lib_job_events GROUP BY doc_id""",
    "lib_elements": """SELECT l_orderkey AS page, l_linenumber AS element, l_quantity AS x1, CAST(l_linenumber * 20 AS DOUBLE) AS y1, l_quantity + 30 AS x2, CAST(l_linenumber * 20 + 25 AS DOUBLE) AS y2 FROM lineitem""",
    "lib_answers": """SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS answer_id,
  array_to_string([CASE WHEN i < len(p) THEN p[i] || ' [' || CAST(1 + (conv_id + i - 1) % 4 AS VARCHAR) || ']' ELSE p[i] END FOR i IN range(1, len(p) + 1)], '.') AS text, 3 AS num_sources
  FROM (SELECT conv_id, turn, string_split(text, '.') AS p FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)""",
}


def with_views(body: str) -> str:
    """``body`` (a SELECT, or CTEs beginning with a comma and a SELECT) after the views that it needs."""
    need: set[str] = set()
    ask = [body]
    while ask:
        text = ask.pop()
        for v in VIEWS:
            if v not in need and re.search(rf"\b{v}\b", text):
                need.add(v)
                ask.append(VIEWS[v])
    if not need:
        return body.removeprefix(", ") if not body.startswith(", ") else "WITH " + body[2:]
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in need) + "\n" + body
