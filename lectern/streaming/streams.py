"""Structured Streaming jobs (T): intake, job state, sessions, periodic enrichment.

Each function builds a streaming (or batch) DataFrame from its input; ``drained`` runs one to the end of what is there
and returns the sink's table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.sources.shared import shared_folder

FILES = "path string, modificationTime timestamp, length bigint, content binary"
IDLE = "1800 seconds"


def drained(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """What a stream makes of the input that is there now, as a Parquet table in the shared folder.

    With ``base`` a later call goes on where the last one stopped and returns all that came out so far.
    """
    spark = stream.sparkSession
    base = base or f"{shared_folder(spark)}/lectern-stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("__epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/out/batch={epoch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("__epoch", T.IntegerType())])
    try:
        return spark.read.schema(schema).parquet(f"{base}/out/batch=*")
    except Exception as e:  # nothing came in: no batch was written
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def files(spark: SparkSession, folder: str, names: str = "*") -> DataFrame:
    """Stream of files in a folder (T-01)."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", names).load(folder)


def intake_jobs(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """One job for each content hash (T-02)."""
    return jobs_once(hashed(stream), late)


def hashed(stream: DataFrame) -> DataFrame:
    """(doc_id, filename, queued_at) of each file, named by its content (T-02)."""
    return stream.select(F.sha2("content", 256).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("modificationTime").alias("queued_at"))


def jobs_once(arrived: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first of each content hash in a stream of ``hashed`` (T-02)."""
    return arrived.withWatermark("queued_at", late).dropDuplicatesWithinWatermark(["doc_id"])


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Many small files go into a task, not three or four, and are looked up by a hundred tasks, not one each; the driver keeps a record of each task."""
    few = {"spark.sql.files.openCostInBytes": 64 * 1024, "spark.sql.sources.parallelPartitionDiscovery.parallelism": 100}
    before = {name: spark.conf.get(name) for name in few}
    try:
        for name, value in few.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def table_stream(spark: SparkSession, path: str, per_trigger: int | None = None, folders: str | None = None) -> DataFrame:
    """Stream over the Parquet files of a table, or of ``folders`` with its schema."""
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    if folders:
        return reader.option("pathGlobFilter", "*.parquet").parquet(folders)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", "*.parquet").parquet(path) if not _is_file(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm.org.apache.hadoop.fs
    p = jvm.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


TRIPLE = ["status", "progress", "stage"]
CHANGED = "doc_id string, status string, progress double, stage string, ts timestamp, seq long"


def changes(events: DataFrame, late: str = "1 day", forget: str = "7 days") -> DataFrame:
    """Only events whose (status, progress, stage) differs from the job's last, by keyed state (T-03); events(doc_id, status, progress, stage, ts, seq).

    A job of which nothing was heard for ``forget`` of event time is forgotten; its next event counts as changed.
    """
    idle = int(pd.Timedelta(forget).total_seconds() * 1000)

    def emit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        kept, seen = [], state.getCurrentWatermarkMs()
        for row in pd.concat(list(frames)).sort_values(["ts", "seq"]).itertuples(index=False):
            now = tuple(None if pd.isna(x) else x for x in (row.status, row.progress, row.stage))
            if last is None or now != tuple(last):
                kept.append(row)
            last, seen = now, max(seen, 0 if pd.isna(row.ts) else row.ts.value // 10**6)
        state.update(last)
        state.setTimeoutTimestamp(seen + idle)
        yield pd.DataFrame(kept, columns=["doc_id", *TRIPLE, "ts", "seq"])

    given = events.select("doc_id", *TRIPLE, "ts", "seq").withWatermark("ts", late)
    return given.groupBy("doc_id").applyInPandasWithState(emit, CHANGED, "status string, progress double, stage string", "append", GroupStateTimeout.EventTimeTimeout)


def changes_batch(events: DataFrame) -> DataFrame:
    """The batch twin of ``changes``."""
    now = F.struct(*TRIPLE)
    before = F.lag(now).over(Window.partitionBy("doc_id").orderBy("ts", "seq"))
    return events.withColumn("__b", before).where(~now.eqNullSafe(F.col("__b"))).select("doc_id", *TRIPLE, "ts", "seq")


def latest(events: DataFrame) -> DataFrame:
    """Latest state of each job (T-04); in update mode on a stream."""
    return events.groupBy("doc_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("ts"))


def abandoned(registrations: DataFrame, uploads: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Registrations (upload_id, key, ts) without an upload (key, ts) of their key in time (T-05).

    On streams this is an outer join with watermarks on both sides: a registration comes out once no upload can match it.
    """
    r = registrations.select("upload_id", "key", F.col("ts").alias("registered_at")).withWatermark("registered_at", within)
    u = uploads.select(F.col("key").alias("done_key"), F.col("ts").alias("uploaded_at")).withWatermark("uploaded_at", within)
    on = F.expr(f"key = done_key AND uploaded_at >= registered_at AND uploaded_at <= registered_at + INTERVAL {within}")
    return r.join(u, on, "leftOuter").where("done_key is null").select("upload_id", "registered_at")


def sessions(turns: DataFrame, late: str | None = None) -> DataFrame:
    """Sessions that end after 1800 idle seconds, with their turns and sources (T-06, T-07); turns(key, ts, role, source)."""
    t = turns.withWatermark("ts", late) if late else turns
    grouped = t.groupBy("key", F.session_window("ts", IDLE).alias("w"))
    return grouped.agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), F.sort_array(F.collect_set(F.when(F.col("role") == "assistant", F.col("source")))).alias("sources")).select(
        "key", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "turns", "answers", "sources"
    )


IDLE_US = 1_800_000_000
OPEN = "first long, last long, turns long, answers long, sources array<string>"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OpenSessions(StatefulProcessor):
    """A key's sessions that may still grow, as a list state; a timer a key, at the first time at which one of them closes.

    What it closes are all sessions that no turn in time can join any more, so a key's sessions are read and written once a
    batch and not once for each of them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", OPEN)

    @staticmethod
    def _closes(session: tuple) -> int:
        """The first millisecond at which a turn is later than 1800 s after the session's last."""
        return (session[1] + IDLE_US) // 1000 + 1

    def _keep(self, sessions: list[tuple], due: int | None) -> None:
        """Sessions in order of time; ``due`` is when the timer that is set goes off, if any."""
        if sessions:
            self.open.put(sessions)
        else:
            self.open.clear()
        fresh = self._closes(sessions[0]) if sessions else None
        if fresh != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if fresh is not None:
                self.handle.registerTimer(fresh)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(x) for x in self.open.get()]
        joined = before
        for frame in rows:
            said = frame["role"] == "assistant"
            fresh = [(at, at, 1, int(a), [s] if a and isinstance(s, str) else []) for at, a, s in zip(frame["at"].tolist(), said.tolist(), frame["source"].tolist())]
            joined, parts = [], sorted([*joined, *fresh], key=lambda x: x[:2])
            for first, last, turns, answers, sources in parts:
                if joined and first <= joined[-1][1] + IDLE_US:
                    f, l, t, a, s = joined[-1]
                    joined[-1] = (f, max(l, last), t + turns, a + answers, sorted({*s, *sources}) if sources else s)
                else:
                    joined.append((first, last, turns, answers, list(sources)))
        self._keep(joined, self._closes(before[0]) if before else None)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = [tuple(x) for x in self.open.get()]
        done = [x for x in held if self._closes(x) <= now]
        self._keep([x for x in held if self._closes(x) > now], None)  # the timer that went off is gone
        if done:
            out = pd.DataFrame(done, columns=["first", "last", "turns", "answers", "sources"])
            out.insert(0, "id", key[0])
            yield out

    def close(self) -> None:
        pass


def closed_sessions(turns: DataFrame, late: str) -> DataFrame:
    """The sessions of ``sessions``, each once it has ended, in append mode with keyed state and timers (T-06); turns is a stream.

    A session is given out and its state dropped when the watermark is more than 1800 s past its last turn; a gap of just
    1800 s is bridged. Turns later than the watermark, and those without a time, are left out, as in ``sessions``. The state
    of a key is its open sessions, not their turns. Keys are written as text for the state, so that null is a key like any
    other. Keyed state with timers needs the RocksDB store, which this sets.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kind = T.StructType([T.StructField("key", turns.schema["key"].dataType)])
    given = turns.where("ts is not null").select(F.to_json(F.struct("key")).alias("id"), F.col("role").cast("string").alias("role"), F.col("source").cast("string").alias("source"), F.unix_micros("ts").alias("at"), "ts").withWatermark("ts", late)
    found = given.groupBy("id").transformWithStateInPandas(OpenSessions(), f"id string, {OPEN}", "Append", "EventTime")
    ended = F.timestamp_micros(F.col("last") + IDLE_US)
    return found.select(F.from_json("id", kind)["key"].alias("key"), F.timestamp_micros("first").alias("started"), ended.alias("ended"), "turns", "answers", "sources")


def with_end(stream: DataFrame, batch: DataFrame, path: str, days: int = 2) -> DataFrame:
    """``stream`` and one row of nulls ``days`` after the last ``ts`` of ``batch``, which moves the watermark past all others.

    All of it must come in one trigger (no limit of files), since what comes after that row is late.
    """
    last = batch.agg((F.max("ts") + F.make_interval(days=F.lit(days))).alias("ts"))
    row = last.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields])
    row.write.parquet(path)
    return stream.unionByName(stream.sparkSession.readStream.schema(stream.schema).parquet(path))


def history(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, n, role, content, sources): turns in order with what was said; sources of assistant turns only (T-08)."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    sources = F.when(F.col("role") == "assistant", F.col("sources")) if "sources" in turns.columns else F.lit(None).cast("array<string>")
    return turns.select("conv_id", "turn", n.alias("n"), "role", F.col("text").alias("content"), sources.alias("sources"))


def recent_sessions(found: DataFrame, n: int = 50) -> DataFrame:
    """The n sessions that ended last (T-09)."""
    return found.orderBy(F.desc("ended"), "key").limit(n)


def enriched_periodically(stream: DataFrame, enrich: Callable[[DataFrame, int], None], every: str | None = None) -> None:
    """Calls ``enrich(batch, epoch)`` for what came in; every so often, or once for what is there (T-10)."""
    spark = stream.sparkSession
    writer = stream.writeStream.foreachBatch(enrich).option("checkpointLocation", f"{shared_folder(spark)}/lectern-enrich-{uuid.uuid4().hex}")
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    if not every:
        query.awaitTermination()
