"""Plumbing shared by the operators: the shared folder, bucketed running totals, components, blocked links."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.sources.shared import cut, shared_folder


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends there and lost executors re-read it."""
    path = f"{shared_folder(df.sparkSession)}/lectern-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_start(df: DataFrame, group: list[str], key: list[str], value: str, out: str, rows: int, per_bucket: int = 50_000) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one within ``group``.

    Rows are ordered by a hash bucket of ``key``, then by ``key``. Only bucket sums meet in one ordered window; the rows
    themselves are summed inside their bucket, so a hot group spreads over as many tasks as it has buckets.
    ``group`` must hold no null. ``rows`` is the row count, which sets the number of buckets.
    """
    buckets = max(1, math.ceil(rows / per_bucket))
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    sums = dealt.groupBy(*group, "__bucket").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*group, "__bucket").orderBy(*key, value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.join(base, [*group, "__bucket"])
        .withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("__bucket", "__base")
    )


def ordered_start(df: DataFrame, step: str, key: list[str], value: str, out: str, per_bucket: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before this one in the order of ``step``, then ``key``.

    ``step`` is a number whose every value holds few rows. Sums of ``per_bucket`` steps, and of 4,096 such buckets, meet
    in the ordered windows; the rows themselves are summed inside their bucket.
    """
    dealt = df.withColumn("__bucket", F.floor(F.col(step) / per_bucket))
    sums = dealt.groupBy("__bucket").agg(F.sum(value).alias("__sum")).withColumn("__group", F.floor(F.col("__bucket") / 4096))
    groups = sums.groupBy("__group").agg(F.sum("__sum").alias("__sum"))
    ahead = Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)  # one row for 4,096 buckets
    within = Window.partitionBy("__group").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    bases = groups.select("__group", F.coalesce(F.sum("__sum").over(ahead), none).alias("__ahead"))
    base = sums.join(bases, "__group").select("__bucket", (F.col("__ahead") + F.coalesce(F.sum("__sum").over(within), none)).alias("__base"))
    inside = Window.partitionBy("__bucket").orderBy(step, *key).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(base, "__bucket").withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(inside), none)).drop("__bucket", "__base")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Alternating large-star and small-star rounds, each checkpointed; only a count and a checksum of the edges reach the
    driver. Each round's minimum is a partial aggregate and its join can be split by AQE, so hubs don't bind one task.
    """
    kind = edges.schema["a"].dataType
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(small_low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").cast(kind).alias("node"), F.col("v").alias("component")).unionByName(roots)


def runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole key groups of frames sorted by ``keys``: (frame, bounds), group i being rows bounds[i] to bounds[i + 1]."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        fresh = np.zeros(len(frame), dtype=bool)
        for k in keys:
            x = frame[k].to_numpy()
            fresh[1:] |= x[1:] != x[:-1]
        if held:
            fresh[0] = any(held[-1][k].iloc[-1] != frame[k].iloc[0] for k in keys)
        starts = np.flatnonzero(fresh)
        if held and not len(starts):
            held.append(frame)
            continue
        last = int(starts[-1]) if len(starts) else 0
        if held or last:
            whole = pd.concat([*held, frame.iloc[:last]], ignore_index=True) if held else frame.iloc[:last]
            before = sum(map(len, held))
            inner = [before + int(s) for s in starts if before + int(s) > 0]
            yield whole, np.array([0, *[s for s in inner if s < len(whole)], len(whole)])
        held = [frame.iloc[last:]]
    if held:
        whole = pd.concat(held, ignore_index=True)
        fresh = np.zeros(len(whole), dtype=bool)
        for k in keys:
            x = whole[k].to_numpy()
            fresh[1:] |= x[1:] != x[:-1]
        yield whole, np.array([0, *np.flatnonzero(fresh).tolist(), len(whole)])


def blocked_links(members: DataFrame, keys: list[str], ident: str, link: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], block: int) -> DataFrame:
    """Links (a, b) within groups of ``members`` that share ``keys``, found without emitting pairs.

    ``link(frame, bounds)`` returns star edges of each group's linked members. A group of more than ``block`` members is
    dealt into hash blocks and every pair of blocks meets in one task, so each pair of members is compared exactly once
    or more, memory stays within two blocks, and a hot group spreads over many tasks.
    """
    sizes = members.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
    parts = F.ceil(F.col("__n") / F.lit(block)).cast("int")
    met = (
        members.join(sizes, keys)
        .withColumn("__parts", parts)
        .withColumn("__own", F.pmod(F.xxhash64(ident), F.col("__parts")).cast("int"))
        .withColumn("__other", F.explode(F.when(F.col("__parts") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("__parts") - 1), F.col("__own")))))
        .withColumn("__lo", F.least("__own", "__other"))
        .withColumn("__hi", F.greatest("__own", "__other"))
        .drop("__n", "__parts", "__own", "__other")
    )
    by = [*keys, "__lo", "__hi"]
    kind = members.schema[ident].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def inside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in runs(frames, by):
            yield link(frame, bounds)

    return met.repartition(*by).sortWithinPartitions(*by, ident).mapInPandas(inside, schema).distinct()


def star(near: np.ndarray) -> np.ndarray:
    """Component label (smallest index) of each row of a symmetric boolean matrix."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(np.where(near, label[None, :], len(near)).min(axis=1), label)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    mark = "__"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def bytes_of(text: str | Column) -> Column:
    """UTF-8 bytes of a text, null as none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
