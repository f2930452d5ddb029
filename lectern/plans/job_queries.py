"""Registered job queries (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import jobs as ops
from lectern.operators import library
from lectern.plans.registry import query


@query("J01_create_job", "SELECT doc_id, arg_min(ts, (ts, seq)) AS queued_at FROM lib_job_events WHERE status = 'queued' GROUP BY doc_id")
def _(lib):
    up = lib.job_events.where("status = 'queued'").select("doc_id", "ts", "seq")
    fresh, _ = library.split_new(up, lib.job_events.where("false"), ["doc_id"], [F.col("ts"), F.col("seq")])
    return fresh.select("doc_id", F.col("ts").alias("queued_at"))


@query("J02_queue_order", "SELECT doc_id, queued_at FROM lib_jobs WHERE status = 'queued' ORDER BY queued_at, doc_id LIMIT 20")
def _(lib):
    return ops.queue_order(lib.jobs, 20).select("doc_id", "queued_at")


@query("J03_current_state", "SELECT doc_id, arg_max(status, (ts, seq)) AS status, max(ts) AS ts FROM lib_job_events GROUP BY doc_id")
def _(lib):
    return ops.current_state(lib.job_events).select("doc_id", "status", "ts")


@query("J04_jobs_by_status", "SELECT doc_id, queued_at FROM lib_jobs WHERE status = 'failed' ORDER BY queued_at DESC, doc_id LIMIT 50")
def _(lib):
    return lib.jobs.where("status = 'failed'").orderBy(F.desc("queued_at"), "doc_id").limit(50).select("doc_id", "queued_at")


#: Every third job has no completion time, every seventh no status.
ENDED = "SELECT doc_id, CASE WHEN changes % 7 <> 0 THEN status END AS status, CASE WHEN changes % 3 <> 0 THEN updated_at END AS completed_at FROM lib_jobs"
OVER = "coalesce(status IN ('completed', 'failed') AND completed_at < TIMESTAMP '2024-01-20 00:00:00', false)"


def _purged(lib):
    jobs = lib.jobs.withColumns({"status": F.when(F.col("changes") % 7 != 0, F.col("status")), "completed_at": F.when(F.col("changes") % 3 != 0, F.col("updated_at"))})
    return ops.purge(jobs, F.lit("2024-01-20 00:00:00").cast("timestamp"))


@query("J05_purge", f"SELECT doc_id, status FROM ({ENDED}) WHERE NOT {OVER}")
def _(lib):
    return _purged(lib)[0].select("doc_id", "status")


@query("J05_purged_count", f"SELECT count(*) FILTER (WHERE {OVER}) AS deleted FROM ({ENDED})")
def _(lib):
    return _purged(lib)[1]


@query("J06_queue_summary", "SELECT count(*) FILTER (WHERE status IN ('queued', 'processing')) AS active, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS total FROM lib_jobs")
def _(lib):
    return ops.queue_summary(lib.jobs)


@query(
    "J07_queue_items",
    """SELECT doc_id, CASE WHEN changes % 5 = 4 THEN 'queued' ELSE status END AS status, CASE WHEN changes % 3 = 0 THEN 0.0 ELSE epoch(TIMESTAMP '2024-03-01 00:00:00') - epoch(queued_at) END AS elapsed,
CASE WHEN changes % 2 = 0 THEN queued_at ELSE TIMESTAMP '2024-03-01 00:00:00' END AS timestamp FROM lib_jobs""",
)
def _(lib):
    """Some jobs have an unknown status, a start that is no time, or a broken queue time."""
    now, text = F.lit("2024-03-01 00:00:00").cast("timestamp"), F.col("queued_at").cast("string")
    odd = {"status": F.when(F.col("changes") % 5 == 4, "paused").otherwise(F.col("status")), "started_at": F.when(F.col("changes") % 3 == 0, "soon").otherwise(text), "queued_at": F.when(F.col("changes") % 2 == 0, text).otherwise("broken")}
    return ops.queue_items(lib.jobs.withColumns(odd), now).select("doc_id", "status", F.round("elapsed", 6).alias("elapsed"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


@query("J08_status_counts", "SELECT count(*) FILTER (WHERE status NOT IN ('completed', 'failed')) AS active, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed FROM lib_jobs")
def _(lib):
    return ops.status_counts(lib.jobs)


@query("J09_active_list", "SELECT doc_id, updated_at FROM lib_jobs WHERE status NOT IN ('completed', 'failed') ORDER BY updated_at DESC, doc_id LIMIT 50")
def _(lib):
    return lib.jobs.where("status not in ('completed', 'failed')").orderBy(F.desc("updated_at"), "doc_id").limit(50).select("doc_id", "updated_at")


@query(
    "J10_stage_progress",
    """SELECT seq, CASE status WHEN 'queued' THEN 'Queued for processing' WHEN 'parsing' THEN 'Parsing document' WHEN 'embedding_text' THEN 'Generating text embeddings' WHEN 'completed' THEN 'Completed successfully'
 WHEN 'failed' THEN 'Processing failed' ELSE 'Storing in database' END AS description,
 round(CASE status WHEN 'queued' THEN 0.0 WHEN 'parsing' THEN 0.05 WHEN 'embedding_text' THEN 0.6 + (seq % 10) / 10.0 * 0.3 WHEN 'completed' THEN 1.0 WHEN 'failed' THEN 0.0 ELSE 0.95 END, 6) AS progress FROM lib_job_events""",
)
def _(lib):
    e = lib.job_events.withColumn("chunk", F.col("seq") % 10).withColumn("chunks", F.lit(10)).withColumn("page", F.lit(None).cast("int")).withColumn("pages", F.lit(None).cast("int"))
    return e.select("seq", ops.stage_description("status").alias("description"), F.round(ops.stage_progress("status", "page", "pages", "chunk", "chunks"), 6).alias("progress"))


@query(
    "J11_consistency",
    """SELECT seq, rule FROM (SELECT seq, 'progress between 0 and 1' AS rule FROM lib_job_events WHERE value / 50 > 1 UNION ALL SELECT seq, 'page not above total' FROM lib_job_events WHERE seq % 7 > 5
UNION ALL SELECT seq, 'completed has a time' FROM lib_job_events WHERE status = 'completed' AND seq % 2 = 1 UNION ALL SELECT seq, 'failed has an error' FROM lib_job_events WHERE status = 'failed')""",
)
def _(lib):
    e = lib.job_events.select("seq", "status", (F.col("value") / 50).alias("progress"), (F.col("seq") % 7).alias("page"), F.lit(5).alias("total_pages"), F.when(F.col("seq") % 2 == 0, F.col("ts")).alias("completed_at"), F.lit(None).cast("string").alias("error"))
    return ops.violations(e, ["seq"], ops.consistency_rules())
