"""Registered search queries (V). Queries are the chunks whose number is divisible by 20; they are searched against all."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import graph
from lectern.operators import vectors as ops
from lectern.plans.registry import query

DIST = """, n AS (SELECT chunk, doc, vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM lib_tokens),
s AS (SELECT q.chunk AS query_id, c.chunk, c.doc, q.vec_id, max(list_cosine_similarity(q.v, c.v)) AS m FROM n q, n c WHERE q.chunk % 20 = 0 GROUP BY ALL),
d AS (SELECT query_id, chunk, doc, 1 - avg(m) AS distance FROM s GROUP BY ALL)"""
TOP = DIST + """, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), chunk) AS rank FROM d)"""
RESULTS = TOP + """, r AS (SELECT query_id, CAST(doc AS VARCHAR) AS doc_id, max(1 / (1 + distance)) AS score FROM t WHERE rank <= 30 GROUP BY ALL)"""


def _asked(lib):
    return lib.vectors.where("chunk % 20 = 0").select(F.col("chunk").alias("query_id"), "tokens")


def _results(lib):
    hits = ops.search(lib.vectors, _asked(lib), 30)
    return hits.groupBy("query_id", F.col("doc").cast("string").alias("doc_id")).agg(F.max(ops.score(F.col("distance"))).alias("score"))


@query("V01_maxsim", TOP + " SELECT query_id, chunk, round(1 - distance, 6) AS similarity FROM t WHERE rank <= 30")
def _(lib):
    """The defining form on the pairs that the search brings up."""
    near = ops.search(lib.vectors, _asked(lib), 30).select("query_id", "chunk")
    pairs = near.join(_asked(lib).withColumnRenamed("tokens", "q"), "query_id").join(lib.vectors.select("chunk", "tokens"), "chunk")
    return pairs.select("query_id", "chunk", F.round(ops.maxsim("q", "tokens"), 6).alias("similarity"))


@query(
    "V02_text_topk",
    TOP + " SELECT query_id, t.chunk, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score, l.filename FROM t LEFT JOIN lib_documents l ON CAST(t.doc AS VARCHAR) = l.doc_id WHERE rank <= 10",
)
def _(lib):
    hits = ops.search(lib.vectors, _asked(lib), 10).withColumn("doc_id", F.col("doc").cast("string"))
    named = hits.join(lib.documents.select("doc_id", "filename"), "doc_id", "left")
    return named.select("query_id", "chunk", "rank", F.round("distance", 6).alias("distance"), F.round(ops.score(F.col("distance")), 6).alias("score"), "filename")


PAGES = """, n AS (SELECT chunk // 3 AS page, doc, vec_id, chunk, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM lib_tokens),
s AS (SELECT q.chunk AS query_id, c.page, c.doc, q.vec_id, max(list_cosine_similarity(q.v, c.v)) AS m FROM n q, n c WHERE q.chunk % 20 = 0 GROUP BY ALL),
d AS (SELECT query_id, page, doc, 1 - avg(m) AS distance FROM s GROUP BY ALL)"""


def _pages(lib):
    flat = lib.vectors.select(F.floor(F.col("chunk") / 3).alias("page"), "doc", "chunk", "tokens")
    gathered = flat.groupBy("page", "doc").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "tokens"))), lambda x: x["tokens"])).alias("tokens"))
    return gathered.select((F.col("page") * 1000 + F.col("doc") % 1000).alias("at"), "page", "doc", "tokens")


@query("V03_visual_topk", PAGES + ", t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), page * 1000 + doc % 1000) AS rank FROM d) SELECT query_id, page * 1000 + doc % 1000 AS at, doc, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM t WHERE rank <= 10")
def _(lib):
    return ops.search(_pages(lib), _asked(lib), 10, ident="at").select("query_id", "at", "doc", "rank", F.round("distance", 6).alias("distance"))


@query(
    "V04_hybrid",
    """, n AS (SELECT chunk // 3 AS page, doc, vec_id, chunk, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM lib_tokens),
s AS (SELECT q.chunk AS query_id, c.chunk, c.page, c.doc, q.vec_id, max(list_cosine_similarity(q.v, c.v)) AS m FROM n q, n c WHERE q.chunk % 20 = 0 GROUP BY ALL),
dt AS (SELECT query_id, chunk, page, doc, 1 - avg(m) AS distance FROM s GROUP BY ALL),
tt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), chunk) AS rank FROM dt),
sp AS (SELECT query_id, page, doc, vec_id, max(m) AS m FROM s GROUP BY ALL), dp AS (SELECT query_id, page, doc, 1 - avg(m) AS distance FROM sp GROUP BY ALL),
tp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), page * 1000 + doc % 1000) AS rank FROM dp),
u AS (SELECT query_id, doc, page, round(distance, 12) AS distance, 0 AS side FROM tp WHERE rank <= 50 UNION ALL SELECT query_id, doc, page, round(distance, 12), 1 FROM tt WHERE rank <= 50),
b AS (SELECT query_id, doc, page, min((distance, side)) AS k FROM u GROUP BY ALL),
z AS (SELECT query_id, CAST(doc AS VARCHAR) AS doc_id, page AS page_num, k[1] AS distance, k[2] AS side, row_number() OVER (PARTITION BY query_id ORDER BY k[1], k[2], CAST(doc AS VARCHAR), page) AS rank FROM b)
SELECT query_id, doc_id, page_num, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance, CASE WHEN side = 0 THEN 'visual' ELSE 'text' END AS source FROM z WHERE rank <= 10""",
)
def _(lib):
    asked = _asked(lib)
    text = ops.search(lib.vectors, asked, 50).select("query_id", F.col("doc").cast("string").alias("doc_id"), F.floor(F.col("chunk") / 3).alias("page_num"), "distance")
    visual = ops.search(_pages(lib), asked, 50, ident="at").select("query_id", F.col("doc").cast("string").alias("doc_id"), F.floor(F.col("at") / 1000).alias("page_num"), "distance")
    return ops.hybrid(visual, text, 10).select("query_id", "doc_id", "page_num", "rank", F.round("distance", 6).alias("distance"), "source")


@query(
    "V05_project_scope",
    DIST + """, t AS (SELECT d.*, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), chunk) AS rank FROM d JOIN lib_documents l ON CAST(d.doc AS VARCHAR) = l.doc_id WHERE l.project_id = 'src2')
SELECT query_id, chunk, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM t WHERE rank <= 5""",
)
def _(lib):
    held = ops.scoped(lib.vectors.withColumn("doc", F.col("doc").cast("string")), lib.documents, "src2")
    return ops.search(held, _asked(lib), 5).select("query_id", "chunk", "rank", F.round("distance", 6).alias("distance"))


@query("V10_graph_boost", RESULTS + """, e AS (SELECT src_doc_id AS a, dst_doc_id AS b, relation_type AS t FROM lib_relations UNION ALL SELECT dst_doc_id, src_doc_id, relation_type FROM lib_relations),
g AS (SELECT x.query_id, x.doc_id, sum(CASE e.t WHEN 'series_member' THEN 0.03 WHEN 'same_author' THEN 0.02 ELSE 0 END) AS gain FROM r x JOIN e ON x.doc_id = e.a JOIN r y ON y.query_id = x.query_id AND y.doc_id = e.b GROUP BY ALL)
SELECT r.query_id, r.doc_id, round(least(1.0, score + coalesce(CAST(gain AS DOUBLE), 0)), 6) AS boosted FROM r LEFT JOIN g ON r.query_id = g.query_id AND r.doc_id = g.doc_id""")
def _(lib):
    return ops.graph_boost(_results(lib), lib.relations).select("query_id", "doc_id", F.round("boosted", 6).alias("boosted"))


@query("V11_pagerank_blend", RESULTS + """, p AS (SELECT dst_doc_id AS doc_id, CAST(count(*) AS DOUBLE) AS pr FROM lib_relations GROUP BY 1), m AS (SELECT r.*, p.pr, max(p.pr) OVER (PARTITION BY query_id) AS top FROM r LEFT JOIN p ON r.doc_id = p.doc_id)
SELECT query_id, doc_id, round(CASE WHEN top > 0 THEN 0.9 * score + 0.1 * coalesce(pr, 0) / top ELSE score END, 6) AS blended FROM m""")
def _(lib):
    ranks = lib.relations.groupBy(F.col("dst_doc_id").alias("doc_id")).agg(F.count("*").cast("double").alias("pagerank"))
    return ops.pagerank_blend(_results(lib), ranks).select("query_id", "doc_id", F.round("blended", 6).alias("blended"))


@query("V11_pagerank_blend_ranked")
def _(lib):
    return ops.pagerank_blend(_results(lib), graph.pagerank(lib.documents, lib.relations)).select("query_id", "doc_id", "score", "pagerank", F.round("blended", 6).alias("blended"))


@query("V13_relations_inside", RESULTS + " SELECT DISTINCT x.query_id, e.src_doc_id, e.dst_doc_id, e.relation_type FROM lib_relations e JOIN r x ON x.doc_id = e.src_doc_id JOIN r y ON y.query_id = x.query_id AND y.doc_id = e.dst_doc_id")
def _(lib):
    return ops.relations_inside(_results(lib), lib.relations)


@query("V14_previews", RESULTS + " SELECT r.query_id, r.doc_id, md5(left(l.markdown, 200)) AS preview_md5 FROM r JOIN lib_documents l ON r.doc_id = l.doc_id WHERE score >= 0.6")
def _(lib):
    texts = lib.documents.select("doc_id", F.col("markdown").alias("text"))
    return ops.previews(_results(lib).join(texts, "doc_id"), 0.6).select("query_id", "doc_id", F.md5("preview").alias("preview_md5"))


@query("V15_nearest_documents", TOP + ", b AS (SELECT query_id, doc, min(distance) AS distance FROM t WHERE rank <= 50 GROUP BY ALL), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), doc) AS rank FROM b) SELECT query_id, doc, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM z WHERE rank <= 5")
def _(lib):
    return ops.nearest_documents(ops.search(lib.vectors, _asked(lib), 50), 5).select("query_id", "doc", "rank", F.round("distance", 6).alias("distance"))


@query("V16_rerank")
def _(lib):
    hits = ops.nearest_documents(ops.search(lib.vectors, _asked(lib), 50), 10)
    first = lib.vectors.groupBy("doc").agg(F.min_by("tokens", "chunk").alias("tokens"))
    return ops.reranked(hits, _asked(lib), first, 5)


@query("V17_latency_stats", "SELECT count(*) AS n, round(avg(value), 6) AS mean, list_sort(list(value))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1] AS p95 FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)")
def _(lib):
    e = lib.given("events").select("ts", F.col("event_id").alias("seq"), F.col("value").alias("ms"))
    return ops.latency_stats(e).select("n", F.round("mean", 6).alias("mean"), "p95")


@query("V18_checked_queries", """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'visual_only' WHEN 1 THEN 'text_only' WHEN 2 THEN 'hybrid' ELSE 'other' END AS mode, CAST(10 AS INTEGER) AS n,
CASE WHEN coalesce(trim(text, ' '), '') = '' THEN 'empty query' WHEN turn % 4 = 3 THEN 'unknown mode' END AS reason FROM conversations""")
def _(lib):
    names = F.element_at(F.array(F.lit("visual"), F.lit("text_only"), F.lit("hybrid"), F.lit("other")), (F.col("turn") % 4 + 1).cast("int"))
    q = lib.given("conversations").withColumn("mode", names).withColumn("n", F.lit(None).cast("int"))
    return ops.checked_queries(q).select("conv_id", "turn", "mode", "n", "reason")
