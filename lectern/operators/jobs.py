"""Job table analytics (J)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.library import delete_where

# Stages with their descriptions and progress.
STAGES = {
    "queued": ("Queued for processing", 0.0),
    "parsing": ("Parsing document", 0.05),
    "enriching": ("Enriching with VLM (captions, summary)", 0.15),
    "embedding_visual": ("Generating visual embeddings", 0.40),
    "embedding_text": ("Generating text embeddings", 0.75),
    "storing": ("Storing in database", 0.95),
    "completed": ("Completed successfully", 1.0),
    "failed": ("Processing failed", 0.0),
}


def queue_order(jobs: DataFrame, n: int) -> DataFrame:
    """The next n queued jobs, oldest first (J-02)."""
    return jobs.where("status = 'queued'").orderBy("queued_at", "doc_id").limit(n)


def current_state(events: DataFrame) -> DataFrame:
    """The latest change of each job (J-03)."""
    return events.groupBy("doc_id").agg(F.max_by(F.struct("status", "ts", "seq"), F.struct("ts", "seq")).alias("s")).select("doc_id", "s.*")


def purge(jobs: DataFrame, cutoff: Column, at: str = "completed_at") -> tuple[DataFrame, DataFrame]:
    """(jobs without those that completed or failed before the cutoff, one-row count of those) (J-05).

    A job without a status or a completion time stays.
    """
    return delete_where(jobs, F.col("status").isin("completed", "failed") & (F.col(at) < cutoff))


def queue_summary(jobs: DataFrame) -> DataFrame:
    """active (queued or processing), completed, failed, total (J-06)."""
    s = F.col("status")
    return jobs.agg(F.count_if(s.isin("queued", "processing")).alias("active"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"), F.count("*").alias("total"))


def queue_items(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs with known status (else queued), elapsed seconds since they started, and when they were queued (J-07).

    A start that is no time gives no elapsed time; a missing or broken queue time counts as ``now``.
    """
    known = F.when(F.col("status").isin(*STAGES), F.col("status")).otherwise("queued")
    time = lambda c: F.col(c).cast("string").try_cast("timestamp")
    elapsed = F.coalesce(now.cast("timestamp").cast("double") - time("started_at").cast("double"), F.lit(0.0))
    return jobs.withColumns({"status": known, "elapsed": elapsed, "timestamp": F.coalesce(time("queued_at"), now.cast("timestamp"))})


def status_counts(jobs: DataFrame) -> DataFrame:
    """Counts where active means neither completed nor failed (J-08)."""
    done = F.col("status").isin("completed", "failed")
    return jobs.agg(F.count_if(~done).alias("active"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))


def stage_description(status: str) -> Column:
    return F.coalesce(*[F.when(F.col(status) == k, F.lit(v[0])) for k, v in STAGES.items()], F.lit("Unknown status"))


def stage_progress(status: str, page: str, pages: str, chunk: str, chunks: str) -> Column:
    """Progress of a stage, refined by page or chunk counters (J-10)."""
    s = F.col(status)
    known = lambda a, b: F.col(a).isNotNull() & (F.col(b) > 0)
    visual = F.when(known(page, pages), F.lit(0.20) + F.col(page) / F.col(pages) * 0.40)
    text = F.when(known(chunk, chunks), F.lit(0.60) + F.col(chunk) / F.col(chunks) * 0.30)
    return F.coalesce(F.when(s == "embedding_visual", visual), F.when(s == "embedding_text", text), *[F.when(s == k, F.lit(v[1])) for k, v in STAGES.items()], F.lit(0.0))


def violations(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every row that breaks a rule (a rule that is null holds) (J-11, B-08, B-09)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(*key, F.explode(broken).alias("rule"))


def consistency_rules() -> dict[str, Column]:
    return {
        "progress between 0 and 1": F.col("progress").between(0, 1),
        "page not above total": F.col("page") <= F.col("total_pages"),
        "completed has a time": (F.col("status") != "completed") | F.col("completed_at").isNotNull(),
        "failed has an error": (F.col("status") != "failed") | F.col("error").isNotNull(),
    }
