"""Exact top-k search (7): tiled integer matrix products, partial selection in each tile, tree-merged top lists.

Vectors are dealt by a hash of their id into shards of bounded size and queries into blocks of bounded size; a shard and
a block of one grid cell meet as two packed rows, so a task multiplies one block by one shard at a time. Each tile keeps
its k best a query, each cell of the grid k of those, and the last merge k of the cells' lists. A cell is up to 16 shards
and 64 query blocks. Shuffled are the vectors once for 64 query blocks and the queries once for 16 shards, in the
narrowest integers that hold a block; there is no cap on candidates.

Defined cases: components become floor(1024 * x) as doubles, held in 64 bits, to which larger ones and larger scores are cut; vectors that are null, empty, or hold a
null or non-finite component take no part, nor do rows without an id; vectors of different lengths don't meet; repeated
rows are candidates each, and a repeated query id is asked once, with its smallest vector; rows with the query's id are
its own; equal scores go to the smaller id; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut, runs

PACKED = "cell int, dim int, at int, ids binary, kind string, body binary"


def whole_components(embedding: str) -> Column:
    """floor(1024 * x) of each component; null where the vector takes no part."""
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound & (F.size(embedding) > 0), F.transform(embedding, lambda x: F.floor(F.lit(1024.0) * x.cast("double"))))


def packed(rows: DataFrame, at: Column) -> DataFrame:
    """Rows (vec_id, parts) gathered by (dim, at) into one row each, ids ascending."""
    dealt = rows.select("vec_id", "parts", F.size("parts").alias("dim"), at.cast("int").alias("at"), "cell")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in runs(frames, ["cell", "dim", "at"]):
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                part = frame.iloc[s:e]
                ids = part["vec_id"].to_numpy(np.int64)
                body = np.array(part["parts"].tolist(), np.int64)
                kind = np.promote_types(np.min_scalar_type(min(body.min(), -1)), np.min_scalar_type(min(-1, -1 - body.max())))
                yield pd.DataFrame({"cell": [part["cell"].iloc[0]], "dim": [part["dim"].iloc[0]], "at": [part["at"].iloc[0]], "ids": [ids.tobytes()], "kind": [kind.str], "body": [body.astype(kind).tobytes()]})

    return dealt.repartition("cell", "dim", "at").sortWithinPartitions("cell", "dim", "at", "vec_id", "parts").mapInPandas(pack, PACKED)


def products(asked: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Exact inner products; by floating point where every sum fits 53 bits."""
    top = float(np.abs(asked.astype(np.float64)).max(initial=0)) * float(np.abs(held.astype(np.float64)).max(initial=0)) * asked.shape[1]
    if top < 2**53:
        return (asked.astype(np.float64) @ held.astype(np.float64).T).astype(np.int64)
    exact = asked.astype(object) @ held.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def tile_best(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, candidate column) of each query's k best, ties to the left; ``own`` marks what to leave out."""
    n = scores.shape[1]
    order = np.arange(n - 1, -1, -1, dtype=np.int64)
    if np.abs(scores).max(initial=0) < 2**62 // max(n, 1):
        rank = scores * n + order
    else:
        rank = np.empty_like(scores)
        for q in range(len(scores)):
            rank[q, np.lexsort((-order, scores[q]))] = np.arange(n)
    rank[own] = np.iinfo(np.int64).min
    best = np.argpartition(rank, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), scores.shape)
    rows = np.repeat(np.arange(len(scores)), best.shape[1])
    columns = best.ravel()
    kept = ~own[rows, columns]
    return rows[kept], columns[kept]


def exact_topk(vectors: DataFrame, asked: Column, k: int = 10, shard: int = 4096, block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best inner products for every row where ``asked`` holds."""
    rows = cut(vectors.select("vec_id", whole_components("embedding").alias("parts")).where("vec_id is not null and parts is not null"))
    queries = rows.where(asked).groupBy("vec_id").agg(F.min("parts").alias("parts"))
    n, n_asked = rows.count(), queries.count()
    shards, blocks = max(1, math.ceil(n / shard)), max(1, math.ceil(n_asked / block))
    cells = max(1, min(shards, max(12, math.ceil(shards / 16))))
    held = packed(rows.withColumn("cell", F.pmod(F.pmod(F.xxhash64("vec_id"), F.lit(shards)), F.lit(cells)).cast("int")), F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    turned = queries.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    bands = math.ceil(blocks / 64)
    posed = packed(turned, F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).select("cell", "dim", F.pmod("at", F.lit(bands)).alias("band"), F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("body").alias("q_body"))
    tiles = held.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))).join(posed, ["cell", "dim", "band"])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                ids, q_ids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                scores = products(np.frombuffer(r.q_body, r.q_kind).reshape(-1, r.dim), np.frombuffer(r.body, r.kind).reshape(-1, r.dim))
                q, c = tile_best(scores, q_ids[:, None] == ids[None, :], k)
                yield pd.DataFrame({"cell": r.cell, "query_id": q_ids[q], "vec_id": ids[c], "score": scores[q, c]})

    found = tiles.mapInPandas(search, "cell int, query_id long, vec_id long, score long")
    order = [F.col("score").desc(), F.col("vec_id")]
    of_cell = found.withColumn("__r", F.row_number().over(Window.partitionBy("query_id", "cell").orderBy(*order))).where(F.col("__r") <= k).drop("__r")
    return (
        of_cell.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op7_exact_topk(spark, sf_dir: str) -> DataFrame:
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, k=10)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS parts
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.parts, c.parts) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 AND len(q.parts) = len(c.parts)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
