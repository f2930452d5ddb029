"""Registered streaming queries (T): streams over the given tables, drained to a table."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from lectern.plans.registry import query
from lectern.sources.derived import STATES
from lectern.sources.shared import shared_folder
from lectern.streaming import streams as ops


def _state_stream(lib):
    e = ops.table_stream(lib.spark, f"{lib.dir}/events.parquet")
    status = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in STATES.items()], F.lit("storing"))
    return _with_progress(e.select(F.col("event_id").alias("seq"), F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("doc_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts")))


def _with_progress(events):
    """Progress goes up by a half every other event, so a status often comes again with another progress."""
    step = (F.floor(F.col("seq") / 2) % 2).cast("double") / 2
    return events.withColumns({"progress": step, "stage": F.when(F.col("status") == "storing", F.lit("last")).otherwise(F.col("status"))})


FOLDER = 10_000  # files of a folder, about; the driver lists a folder and remembers its files


@query("T01_file_intake", "SELECT DISTINCT sha256(html || chr(10)) AS doc_id FROM pages WHERE html IS NOT NULL")
def _(lib):
    """Files written from the pages' bodies, into the first folder in two batches: its stream goes on where it stopped. Each content is a job once.

    A stream of files keeps every file it has seen on the driver, so a folder has a bounded number and a stream of its own,
    which tells the hashes of its files; one stream over what they tell makes the jobs.
    """
    base = f"{shared_folder(lib.spark)}/lectern-intake-{uuid.uuid4().hex}"
    pages = lib.given("pages").where("html is not null").select("page_id", F.col("html").alias("value"))
    folders = max(1, math.ceil(pages.count() / FOLDER))
    dealt = pages.withColumn("folder", F.pmod(F.xxhash64("page_id", "value"), F.lit(folders)).cast("int"))
    dealt = dealt.select("value", "folder", F.when(F.col("folder") == 0, F.coalesce(F.pmod("page_id", F.lit(2)), F.lit(0))).otherwise(0).cast("int").alias("part"))
    dealt.write.partitionBy("folder", "part").parquet(f"{base}/dealt")  # read a folder and batch at a time
    for folder in range(folders):
        into = f"{base}/in" if not folder else f"{base}/in-{folder}"
        for part in (0,) if folder else (0, 1):
            own = lib.spark.read.schema("value string, folder int, part int").parquet(f"{base}/dealt").where(f"folder = {folder} and part = {part}")
            spread = own.select("value").repartition(lib.spark.sparkContext.defaultParallelism)  # a file a page: all cores write
            # tasks move their files themselves; what a task tried twice may leave is the same content, which is one job
            spread.write.mode("append").option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(into)
            with ops.small_files(lib.spark):
                ops.drained(ops.hashed(ops.files(lib.spark, into, "*.txt")), base=f"{base}/arrived/{folder}")
    told = lib.spark.readStream.schema("doc_id string, filename string, queued_at timestamp").option("pathGlobFilter", "*.parquet").parquet(f"{base}/arrived/*/out/*")
    return ops.drained(ops.jobs_once(told), base=f"{base}/stream").select("doc_id")


@query("T02_jobs_by_content", "SELECT DISTINCT sha256(html) AS doc_id FROM pages")
def _(lib):
    p = ops.table_stream(lib.spark, f"{lib.dir}/pages.parquet")
    files = p.select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modificationTime"))
    return ops.drained(ops.intake_jobs(files)).select("doc_id")


CHANGES = """, s AS (SELECT *, CAST(seq // 2 % 2 AS DOUBLE) / 2 AS progress, CASE WHEN status = 'storing' THEN 'last' ELSE status END AS stage FROM lib_job_events),
c AS (SELECT *, lag((status, progress, stage)) OVER (PARTITION BY doc_id ORDER BY ts, seq) AS b FROM s) SELECT seq, doc_id, status, progress, stage FROM c WHERE b IS NULL OR b <> (status, progress, stage)"""


@query("T03_changes_stream", CHANGES)
def _(lib):
    return ops.drained(ops.changes(_state_stream(lib))).select("seq", "doc_id", "status", "progress", "stage")


@query("T03_changes_batch", CHANGES)
def _(lib):
    return ops.changes_batch(_with_progress(lib.job_events)).select("seq", "doc_id", "status", "progress", "stage")


@query("T04_latest_state", "SELECT doc_id, arg_max(status, (ts, seq)) AS status FROM lib_job_events GROUP BY doc_id")
def _(lib):
    out = ops.drained(ops.latest(_state_stream(lib)), "update")
    return out.groupBy("doc_id").agg(F.max_by("status", "__epoch").alias("status"))


@query(
    "T05_abandoned_uploads",
    """, r AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), u AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')
SELECT r.event_id AS upload_id FROM r WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.user_id = r.user_id AND u.ts >= r.ts AND u.ts <= r.ts + INTERVAL 10 MINUTE)""",
)
def _(lib):
    """Two streams over the events; one far later event, a key of its own, moves the watermarks past all others."""
    base = f"{shared_folder(lib.spark)}/lectern-uploads-{uuid.uuid4().hex}"
    e = lib.given("events").select("event_id", F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_type").where("ts is not null")
    late = e.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    for n, part in enumerate((e, late.select(F.lit(None).cast("long").alias("event_id"), F.lit("end").alias("key"), "ts", F.explode(F.array(F.lit("view"), F.lit("purchase"))).alias("event_type")))):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in/part={n}")
    stream = lambda kind: ops.table_stream(lib.spark, f"{base}/in/part=0", 1, f"{base}/in/*").where(F.col("event_type") == kind)
    found = ops.drained(ops.abandoned(stream("view").withColumnRenamed("event_id", "upload_id"), stream("purchase")))
    return found.where("upload_id is not null").select("upload_id")


SESSIONS = """, m AS (SELECT user_id, event_type, event_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM m)
SELECT user_id AS key, min(ts) AS started, count(*) AS turns, count(*) FILTER (WHERE event_type = 'view') AS answers FROM s GROUP BY user_id, n"""


def _turns(e):
    return e.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "view", "assistant").otherwise("user").alias("role"), F.col("event_type").alias("source"))


@query("T06_sessions", SESSIONS)
def _(lib):
    """By the built-in session window; a later row without a key closes the last sessions."""
    path = f"{shared_folder(lib.spark)}/lectern-turns-{uuid.uuid4().hex}"
    e = ops.with_end(_turns(ops.table_stream(lib.spark, f"{lib.dir}/events.parquet")), _turns(lib.given("events")), path)
    out = ops.drained(ops.sessions(e, "0 seconds").select("key", "started", "turns", "answers"))
    return out.where("key is not null").select("key", F.col("started").cast("timestamp_ntz").alias("started"), "turns", "answers")


@query("T06_closed_sessions", SESSIONS)
def _(lib):
    """By keyed state and timers."""
    path = f"{shared_folder(lib.spark)}/lectern-turns-{uuid.uuid4().hex}"
    e = ops.with_end(_turns(ops.table_stream(lib.spark, f"{lib.dir}/events.parquet")), _turns(lib.given("events")), path)
    out = ops.drained(ops.closed_sessions(e, "0 seconds"))
    return out.where("key is not null").select("key", F.col("started").cast("timestamp_ntz").alias("started"), "turns", "answers")


@query("T08_history", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS n, role, md5(text) AS content_md5, CASE WHEN role = 'assistant' THEN 's' || turn END AS sources FROM conversations")
def _(lib):
    turns = lib.given("conversations").withColumn("sources", F.array(F.concat(F.lit("s"), F.col("turn").cast("string"))))
    return ops.history(turns).select("conv_id", "turn", "n", "role", F.md5("content").alias("content_md5"), F.array_join("sources", ",").alias("sources"))


@query("T09_recent_sessions", "SELECT user_id AS key, max(ts) + INTERVAL 1800 SECOND AS ended FROM events GROUP BY user_id ORDER BY ended DESC, key LIMIT 50")
def _(lib):
    e = lib.given("events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.lit("user").alias("role"), F.lit(None).cast("string").alias("source"))
    last = ops.sessions(e).groupBy("key").agg(F.max("ended").alias("ended"))
    return ops.recent_sessions(last).select("key", F.col("ended").cast("timestamp_ntz").alias("ended"))
