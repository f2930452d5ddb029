"""Multi-vector search (V): MaxSim scores, top-k lists, hybrid merge, graph boost and PageRank blend.

A multi-vector is a list of token vectors. MaxSim of a query and a document is the mean over query tokens of the best
cosine to any document token; distance is 1 - MaxSim and the score 1 / (1 + distance). Batch search deals queries into
blocks and the corpus into shards of bounded size. Up to 64 blocks are a band and up to 16 shards a cell; a band and a cell
meet in one task, so a shard is shuffled once for 64 blocks and a block once for 16 shards, in the components' own width.
A cell keeps the k best of its rows for a query, and a last window k of the cells'. No vector passes the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.shared import cut

# Boost of a result for each edge to another result, by relation type.
BOOSTS = {
    "similar_to": 0.04,
    "same_topic": 0.03,
    "overlaps_topic": 0.02,
    "series_member": 0.03,
    "same_author": 0.02,
    "same_genre": 0.01,
    "references": 0.05,
    "version_of": 0.05,
}
MODES = {"visual_only", "text_only", "hybrid"}
MODE_NAMES = {"visual": "visual_only", "text": "text_only"}


def unit(vector: Column) -> Column:
    """A vector as doubles of length 1; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def maxsim(query: str, document: str) -> Column:
    """MaxSim as built-in expressions: the defining form, for single pairs and tests."""
    q, d = F.transform(query, unit), F.transform(document, unit)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    best = F.transform(q, lambda t: F.array_max(F.transform(d, lambda u: dot(t, u))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(query)


def score(distance: Column) -> Column:
    """1 / (1 + distance), 0 if there is none (V-06)."""
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + distance), F.lit(0.0))


#: Blocks of a band and shards of a cell; query vectors whose products with a shard are held at a time.
BAND, CELL, STRIP = 64, 16, 256


def _unit_rows(body: bytes, kind: str, part: int) -> np.ndarray:
    m = np.frombuffer(body, np.dtype(kind)).reshape(-1, part).astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _packed(rows: DataFrame, names: list[str], out: str) -> DataFrame:
    """Rows (at, part, tokens) of one (at, part) gathered: their names as lists, their vectors end to end as they are stored, and how many each has."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    width = np.dtype(np.float32 if kinds["tokens"] == "array<array<float>>" else np.float64)
    schema = f"at int, part int, {', '.join(f'{n}s array<{kinds[n]}>' for n in names)}, {out}_body binary, {out}_sizes array<int>"

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        held = [np.array([np.asarray(v, width) for v in t]) for t in frame["tokens"]]
        made = {"at": [frame["at"].iloc[0]], "part": [frame["part"].iloc[0]]} | {f"{n}s": [frame[n].tolist()] for n in names}
        return pd.DataFrame(made | {f"{out}_body": [np.concatenate(held).tobytes()], f"{out}_sizes": [[len(u) for u in held]]})

    return rows.groupBy("at", "part").applyInPandas(gather, schema).withColumn(f"{out}_kind", F.lit(width.str))


def _distances(asked: np.ndarray, asked_sizes: np.ndarray, held: np.ndarray, held_sizes: np.ndarray) -> np.ndarray:
    """1 - MaxSim of each query (row) and document (column)."""
    best = np.maximum.reduceat(asked @ held.T, np.cumsum([0, *held_sizes[:-1]]), axis=1)
    return np.round(1 - np.add.reduceat(best, np.cumsum([0, *asked_sizes[:-1]]), axis=0) / asked_sizes[:, None], 12)


def _by_place(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, layers): items from most to fewest rows, and the first rows of all of them, the second ones of those that have one, and so on, as floats of four bytes."""
    order, start = np.argsort(-sizes, kind="stable"), np.cumsum([0, *sizes[:-1]])
    return order, [rows[start[order[: np.count_nonzero(sizes > i)]] + i].astype(np.float32) for i in range(max(sizes, default=0))]


def _may_be_near(asked: tuple, asked_sizes: np.ndarray, held: tuple, within: float) -> np.ndarray:
    """Whether each query (row) and document (column) of ``_by_place`` may be within a distance: by half the width and whole layers at a time, with room for its error."""
    (rows, queries), (columns, layers) = asked, held
    total = np.zeros((len(rows), len(columns)), np.float32)
    for q in queries:
        best = q @ layers[0].T
        for layer in layers[1:]:
            n = len(layer)
            np.maximum(best[:, :n], q @ layer.T, out=best[:, :n])
        total[: len(q)] += best
    width = layers[0].shape[1]
    least = (1 - within - (width + 8) * 2.0**-22) * asked_sizes[rows] - len(queries) * 2.0**-22 * asked_sizes[rows]
    near = np.zeros(total.shape, bool)
    near[np.ix_(rows, columns)] = total >= least[:, None].astype(np.float32)
    return near


def _strips(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of queries of about STRIP vectors together."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + STRIP, side="right")))
        yield first, last
        first = last


def _nearest(row: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest, ties to the smaller name."""
    if len(row) > k:
        near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1])
        return near[np.lexsort((names[near], row[near]))[:k]]
    return np.arange(len(row))


def grid(blocks: int, shards: int) -> tuple[int, int]:
    """(bands, cells) of a grid; there are at least 12 cells where there are as many shards, so that few queries use all cores too."""
    return math.ceil(blocks / BAND), min(shards, max(12, math.ceil(shards / CELL)))


def search(corpus: DataFrame, queries: DataFrame, k: int, ident: str = "chunk", group: str = "doc", block: int = 2048, shard: int = 8192, within: float | None = None) -> DataFrame:
    """(query_id, <ident>, <group>, distance, rank): the k nearest of ``corpus(ident, group, tokens)`` for each ``queries(query_id, tokens)`` (V-02, V-03, V-07).

    Ties go to the smaller ident. Rows without vectors take no part, nor do those farther than ``within`` where it is set. A
    block has about ``block`` query vectors and a shard about ``shard`` corpus vectors; a task holds the packed vectors of
    one band and one cell, and the products of a strip of one block with one shard at a time. With ``within`` products in half the
    width rule out what is farther beyond doubt, and only the rest is compared in full.
    """
    held = corpus.select(F.col(ident).alias("name"), F.col(group).alias("owner"), "tokens").where("size(tokens) > 0")
    asked = queries.select("query_id", "tokens").where("size(tokens) > 0")
    kinds = [queries.schema["query_id"].dataType.simpleString(), corpus.schema[ident].dataType.simpleString(), corpus.schema[group].dataType.simpleString()]
    blocks, shards = (max(1, math.ceil((rows.agg(F.sum(F.size("tokens"))).first()[0] or 0) / most)) for rows, most in ((asked, block), (held, shard)))
    bands, cells = grid(blocks, shards)
    dealt = lambda rows, key, parts: rows.withColumns({"at": F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"), "part": F.size(F.get("tokens", F.lit(0)))})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = _packed(dealt(asked, "query_id", blocks), ["query_id"], "q").withColumns({"band": F.col("at") % bands, "cell": every(cells)}).drop("at")
    right = _packed(dealt(held, "name", shards), ["name", "owner"], "c").withColumns({"cell": F.col("at") % cells, "band": every(bands)}).drop("at")
    columns = ["cell", "query_id", "name", "owner", "distance"]

    def score_cell(key: tuple, some: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        made = [pd.DataFrame(columns=columns)]
        for q in some.itertuples():
            ids, sizes, asked = np.asarray(q.query_ids), np.asarray(q.q_sizes), _unit_rows(q.q_body, q.q_kind, q.part)
            start = np.cumsum([0, *sizes])
            found = []
            for c in rows.itertuples():
                names, owners, unit_rows, lengths = np.asarray(c.names), np.asarray(c.owners), _unit_rows(c.c_body, c.c_kind, c.part), np.asarray(c.c_sizes)
                laid, ends = _by_place(unit_rows, lengths) if within is not None else None, np.cumsum([0, *lengths])
                for first, last in _strips(sizes):
                    own, rows_at, columns_at, held = asked[start[first] : start[last]], np.arange(last - first), np.arange(len(names)), unit_rows
                    if within is not None:
                        near = _may_be_near(_by_place(own, sizes[first:last]), sizes[first:last], laid, within)
                        rows_at, columns_at = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                        if not len(rows_at):
                            continue
                        own = np.concatenate([asked[start[first + i] : start[first + i + 1]] for i in rows_at])
                        held = np.concatenate([unit_rows[ends[i] : ends[i + 1]] for i in columns_at])
                    distance = _distances(own, sizes[first + rows_at], held, lengths[columns_at])
                    keep = [_nearest(row, names[columns_at], k) for row in distance]
                    at, n = np.concatenate(keep), np.repeat(np.arange(len(rows_at)), [len(x) for x in keep])
                    if within is not None:
                        near = distance[n, at] <= within
                        at, n = at[near], n[near]
                    to = columns_at[at]
                    found.append(pd.DataFrame({"cell": key[0], "query_id": ids[first + rows_at[n]], "name": names[to], "owner": owners[to], "distance": distance[n, at]}))
            if found:
                best = pd.concat(found, ignore_index=True)
                made.append(best.sort_values(["distance", "name"]).groupby("query_id", sort=False).head(k) if len(rows) > 1 else best)
        return pd.concat([x for x in made if len(x)] or made, ignore_index=True)

    keys = ["cell", "band", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score_cell, f"cell int, query_id {kinds[0]}, name {kinds[1]}, owner {kinds[2]}, distance double")
    nearest = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("distance", "name"))).where(F.col("rank") <= k)
    best = nearest(found, "query_id")
    return best.select("query_id", F.col("name").alias(ident), F.col("owner").alias(group), "distance", "rank")


#: Bits of the sketch by which the pairs of a bucket are sifted, and how many of its spreads a pair that is near enough may stand out.
SKETCH, SPREADS = 128, 3.3


def index_size(vectors: int, similarity: float, recall: float, per_bucket: int = 256) -> tuple[int, int]:
    """(bits, tables) of a hyperplane index: buckets of about ``per_bucket`` spread vectors, and as many tables as find two vectors of that cosine with that chance."""
    bits = max(8, math.ceil(math.log2(max(vectors, 1) / per_bucket)))
    same = (1 - math.acos(similarity) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def index_pays(vectors: int, similarity: float, recall: float, ratio: int = 1000) -> bool:
    """Whether the index brings up so few of all pairs that they cost less than the exact grid, which moves no pair; a pair moved costs about ``ratio`` products."""
    bits, tables = index_size(vectors, similarity, recall)
    return tables * ratio < 2**bits


def sketch_bits(similarity: float) -> int:
    """Bits of the sketch in which two vectors of that cosine differ at most, but for less than one pair in a thousand."""
    p = math.acos(similarity) / math.pi
    return math.floor(SKETCH * p + SPREADS * math.sqrt(SKETCH * p * (1 - p)))


def signatures(rows: DataFrame, name: str, bits: int, tables: int, seed: int = 17) -> DataFrame:
    """(name, bucket, s0, s1): the sides of ``bits`` random hyperplanes on which each token vector lies, table by table, as a bucket, and its sides of SKETCH others.

    A bucket is made of the vectors' width, the table and the sides.
    """
    kind = rows.schema[name].dataType.simpleString()
    weights = 1 << np.arange(bits, dtype=np.int64)

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for frame in frames:
            widths = frame["tokens"].map(lambda t: len(t[0]))
            for width, some in frame.groupby(widths):
                if width not in planes:
                    r = np.random.default_rng((seed, width))
                    planes[width] = np.concatenate([r.standard_normal((width, tables * bits)), r.standard_normal((width, SKETCH))], axis=1)
                for begin in range(0, len(some), 256):
                    part = some.iloc[begin : begin + 256]
                    m = np.array([np.asarray(v, np.float64) for t in part["tokens"] for v in t])
                    side = m @ planes[width] > 0
                    signs = (side[:, :-SKETCH].reshape(len(m), tables, bits) * weights).sum(axis=2)
                    bucket = ((width << 48) + (np.arange(tables) << 32) + signs).ravel()
                    sketch = np.packbits(side[:, -SKETCH:], axis=1).view(np.int64).repeat(tables, axis=0)
                    names = np.repeat(part[name].to_numpy(), part["tokens"].map(len) * tables)
                    yield pd.DataFrame({"name": names, "bucket": bucket, "s0": sketch[:, 0], "s1": sketch[:, 1]})

    return rows.select(name, "tokens").where("size(tokens) > 0").mapInPandas(sign, f"name {kind}, bucket long, s0 long, s1 long")


def search_near(corpus: DataFrame, queries: DataFrame, k: int, similarity: float = 0.7, recall: float = 0.95, most: int = 2048, ident: str = "chunk", group: str = "doc") -> DataFrame:
    """Like ``search``, among rows of at least ``similarity`` to the query: a hyperplane index over the token vectors brings up candidates, which are scored exactly (E-02).

    MaxSim is a mean over the query's tokens, so at least one of them has the mean's cosine to a token of the document; two
    such vectors share a bucket with the chance ``recall``, more tokens only add to it. Pairs of a bucket are sifted by
    sketches of their vectors where they meet, so that what is moved and scored grows with the near pairs and not with the
    buckets. Equal rows count as one up to the k that can be among a query's nearest; a bucket of more than ``most`` vectors is
    not paired: its rows and queries meet in the exact grid instead, so nothing is cut.
    """
    order = Window.partitionBy("tokens").orderBy(ident)
    held = cut(corpus.select(ident, group, "tokens").where("size(tokens) > 0").withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n"))
    asked = cut(queries.select("query_id", "tokens").where("size(tokens) > 0"))
    bits, tables = index_size(held.agg(F.sum(F.size("tokens"))).first()[0] or 0, similarity, recall)
    ours = cut(signatures(held, ident, bits, tables).withColumnRenamed("name", ident))
    sizes = ours.groupBy("bucket").agg(F.count("*").alias("n"))
    crowded = cut(sizes.where(F.col("n") > most).select("bucket"))
    theirs = signatures(asked, "query_id", bits, tables).withColumnRenamed("name", "query_id")
    differ = F.bit_count(F.col("t0").bitwiseXOR(F.col("s0"))) + F.bit_count(F.col("t1").bitwiseXOR(F.col("s1")))
    met = theirs.withColumnsRenamed({"s0": "t0", "s1": "t1"}).join(ours, "bucket").where(differ <= sketch_bits(similarity))
    within = 1 - similarity + 1e-9
    if not crowded.limit(1).count():
        both = score_pairs(met.select("query_id", ident).distinct(), asked, held, ident, group)
    else:
        pairs = met.join(crowded, "bucket", "left_anti").select("query_id", ident).distinct()
        grid_corpus = held.join(ours.join(crowded, "bucket", "left_semi").select(ident).distinct(), ident, "left_semi")
        grid_queries = asked.join(theirs.join(crowded, "bucket", "left_semi").select("query_id").distinct(), "query_id", "left_semi")
        rest = search(grid_corpus, grid_queries, k, ident, group, within=within).drop("rank")
        both = score_pairs(pairs, asked, held, ident, group).unionByName(rest).dropDuplicates(["query_id", ident])
    near = both.where(F.col("distance") <= within)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", ident))).where(F.col("rank") <= k)
    return best.select("query_id", ident, group, "distance", "rank")


def score_pairs(pairs: DataFrame, asked: DataFrame, held: DataFrame, ident: str, group: str) -> DataFrame:
    """(query_id, ident, group, distance) of given pairs, exactly."""
    kinds = [asked.schema["query_id"].dataType.simpleString(), held.schema[ident].dataType.simpleString(), held.schema[group].dataType.simpleString()]
    met = pairs.join(asked.withColumnRenamed("tokens", "__q"), "query_id").join(held.withColumnRenamed("tokens", "__d"), ident).select("query_id", ident, group, "__q", "__d")

    def score_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = lambda t: _unit_rows(np.array([np.asarray(v, np.float64) for v in t]).tobytes(), "<f8", len(t[0]))
        fits = lambda q, d: len(q) and len(d) and len(q[0]) == len(d[0])
        for frame in frames:
            distance = [round(1 - float((unit(q) @ unit(d).T).max(axis=1).mean()), 12) if fits(q, d) else None for q, d in zip(frame["__q"], frame["__d"])]
            yield frame.drop(columns=["__q", "__d"]).assign(distance=distance)

    return met.mapInPandas(score_rows, f"query_id {kinds[0]}, `{ident}` {kinds[1]}, `{group}` {kinds[2]}, distance double")


def hybrid(visual: DataFrame, text: DataFrame, k: int) -> DataFrame:
    """Best of both sides for each (query, doc, page); visual wins ties (V-04). Sides hold (query_id, doc_id, page_num, distance)."""
    both = visual.withColumn("__side", F.lit(0)).unionByName(text.withColumn("__side", F.lit(1)))
    best = both.groupBy("query_id", "doc_id", "page_num").agg(F.min(F.struct("distance", "__side")).alias("b"))
    order = Window.partitionBy("query_id").orderBy("distance", "__side", "doc_id", "page_num")
    return (
        best.select("query_id", "doc_id", "page_num", F.col("b.distance").alias("distance"), F.col("b.__side").alias("__side"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .withColumn("source", F.when(F.col("__side") == 0, "visual").otherwise("text"))
        .drop("__side")
    )


def scoped(corpus: DataFrame, documents: DataFrame, project_id: str, group: str = "doc") -> DataFrame:
    """Corpus rows of one project's documents, filtered before the search (V-05)."""
    ids = documents.where(F.col("project_id") == project_id).select(F.col("doc_id").alias(group))
    return corpus.join(ids, group, "left_semi")


def nearest_documents(hits: DataFrame, k: int, group: str = "doc") -> DataFrame:
    """Best distance of each (query, document) among the hits, k documents a query (V-15)."""
    best = hits.groupBy("query_id", group).agg(F.min("distance").alias("distance"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", group))).where(F.col("rank") <= k)


def relation_weights(relation_type: str) -> Column:
    return F.coalesce(*[F.when(F.col(relation_type) == t, F.lit(w)) for t, w in BOOSTS.items()], F.lit(0.0))


def graph_boost(results: DataFrame, relations: DataFrame) -> DataFrame:
    """``results(query_id, doc_id, score)`` with boosted score: each edge, in either direction, to another result's document adds its weight; at most 1 (V-10)."""
    held = results.select("query_id", "doc_id").distinct()
    ends = relations.select(F.col("src_doc_id").alias("doc_id"), F.col("dst_doc_id").alias("other"), "relation_type").unionByName(
        relations.select(F.col("dst_doc_id").alias("doc_id"), F.col("src_doc_id").alias("other"), "relation_type")
    )
    near = held.join(ends, "doc_id").join(held.withColumnRenamed("doc_id", "other"), ["query_id", "other"])
    gain = near.groupBy("query_id", "doc_id").agg(F.sum(relation_weights("relation_type")).alias("gain"))
    return results.join(gain, ["query_id", "doc_id"], "left").withColumn("boosted", F.least(F.lit(1.0), F.col("score") + F.coalesce("gain", F.lit(0.0)))).drop("gain")


def pagerank_blend(results: DataFrame, ranks: DataFrame, weight: float = 0.1) -> DataFrame:
    """blended = (1 - w) * score + w * pr / max pr of the query's results; unchanged where there is no positive pr (V-11)."""
    joined = results.join(ranks.select("doc_id", "pagerank"), "doc_id", "left")
    top = F.max("pagerank").over(Window.partitionBy("query_id"))
    return joined.withColumn("__top", top).withColumn(
        "blended", F.when(F.col("__top") > 0, (1 - weight) * F.col("score") + weight * F.coalesce("pagerank", F.lit(0.0)) / F.col("__top")).otherwise(F.col("score"))
    ).drop("__top")


def relations_inside(results: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct edges whose ends are both among a query's results (V-13)."""
    held = results.select("query_id", "doc_id").distinct()
    return (
        relations.join(held.withColumnRenamed("doc_id", "src_doc_id"), "src_doc_id")
        .join(held.withColumnRenamed("doc_id", "dst_doc_id"), ["query_id", "dst_doc_id"])
        .select("query_id", "src_doc_id", "dst_doc_id", "relation_type")
        .distinct()
    )


def previews(results: DataFrame, minimum: float, length: int = 200) -> DataFrame:
    """Results of at least ``minimum`` score with the beginning of their text (V-14)."""
    return results.where(F.col("score") >= minimum).withColumn("preview", F.substring("text", 1, length))


def reranked(candidates: DataFrame, left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Candidates (query_id, doc) scored again by MaxSim of representative vectors (V-16); left(query_id, tokens), right(doc, tokens)."""
    pairs = candidates.select("query_id", "doc").distinct()
    told = score_pairs(pairs, left.where("tokens is not null"), right.where("tokens is not null").select("doc", "tokens", F.col("doc").alias("__of")), "doc", "__of")
    scored = told.select("query_id", "doc", F.round(1 - F.col("distance"), 9).alias("similarity"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc"))).where(F.col("rank") <= k)


def latency_stats(latencies: DataFrame, last: int = 1000) -> DataFrame:
    """n, mean and p95 = sorted[min(int(.95 n), n - 1)] of the latest values (V-17); at most ``last`` values are gathered."""
    recent = latencies.orderBy(F.desc("ts"), F.desc("seq")).limit(last)
    held = recent.agg(F.count("*").alias("n"), F.avg("ms").alias("mean"), F.array_sort(F.collect_list("ms")).alias("__v"))
    at = F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1).cast("int")
    return held.select("n", "mean", F.when(F.col("n") > 0, F.get("__v", at)).alias("p95"))


def checked_queries(queries: DataFrame, default_n: int = 10) -> DataFrame:
    """Queries with their mode's full name, n, and a reason where they are rejected (V-18)."""
    mode = F.coalesce(*[F.when(F.col("mode") == k, F.lit(v)) for k, v in MODE_NAMES.items()], F.col("mode"))
    return (
        queries.withColumn("mode", mode)
        .withColumn("n", F.coalesce("n", F.lit(default_n)))
        .withColumn("reason", F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty query").when(~F.col("mode").isin(*sorted(MODES)), "unknown mode"))
    )
