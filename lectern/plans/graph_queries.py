"""Registered graph queries (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import graph as ops
from lectern.operators import regions
from lectern.plans.registry import query

SERIES = "relation_type = 'series_member'"


def _types(lib):
    t = lib.transitions
    edges = t.select(F.col("src").alias("src_doc_id"), F.col("dst").alias("dst_doc_id"), F.lit("follows").alias("relation_type"))
    return lib.given("events").select(F.col("event_type").alias("doc_id")).distinct(), edges


@query("G01_vertex_numbers", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position FROM lib_documents")
def _(lib):
    return ops.numbered(lib.documents.select("doc_id"), ["doc_id"]).select("doc_id", F.col("position").cast("long").alias("position"))


@query("G02_edge_set", "SELECT r.* FROM lib_relations r JOIN lib_documents a ON r.src_doc_id = a.doc_id JOIN lib_documents b ON r.dst_doc_id = b.doc_id WHERE a.project_id = 'src1' AND b.project_id = 'src1'")
def _(lib):
    return ops.edge_set(lib.relations, lib.documents, "src1").select("src_doc_id", "dst_doc_id", "relation_type")


@query("G03_pagerank")
def _(lib):
    return ops.pagerank(lib.documents, lib.relations).select("doc_id", F.round("pagerank", 9).alias("pagerank"))


@query("G04_components", ", s AS (SELECT DISTINCT project_id, min(doc_id) OVER (PARTITION BY project_id) AS m FROM lib_documents WHERE project_id IS NOT NULL) SELECT d.doc_id, coalesce(s.m, d.doc_id) AS component FROM lib_documents d LEFT JOIN s ON d.project_id = s.project_id")
def _(lib):
    return ops.connected_components(lib.documents, lib.relations)


@query("G05_label_propagation")
def _(lib):
    communities, settled = ops.labels_settled(lib.documents, lib.relations)
    return communities.withColumn("settled", F.lit(settled))


FAR = ", k AS (SELECT project_id, num, doc_id, row_number() OVER (PARTITION BY project_id ORDER BY num) AS n FROM lib_documents WHERE project_id IS NOT NULL) SELECT a.doc_id AS source, b.doc_id, CAST(b.n - a.n AS INTEGER) AS distance FROM k a JOIN k b ON a.project_id = b.project_id AND a.n = 1 AND b.n > 1"


@query("G06_distances_all", FAR)
@query("G06_distances", FAR)
def _(lib):
    """From the first document of each series; a forest's distances need only log rounds."""
    series = lib.relations.where(SERIES).select(F.col("src_doc_id").alias("src"), F.col("dst_doc_id").alias("dst"))
    return ops.forest_depths(lib.documents.select("doc_id"), series).where("layer > 0").select(F.col("root").alias("source"), "doc_id", F.col("layer").alias("distance"))


@query("G06_distances_near", FAR + " AND b.n <= 11")
def _(lib):
    first = lib.documents.where("project_id is not null").groupBy("project_id").agg(F.min_by("doc_id", "num").alias("doc_id"))
    return ops.distances(lib.relations.where(SERIES), first, max_depth=10).select("source", "doc_id", "distance")


@query(
    "G06_distances_every_20th",
    """SELECT doc_id, count(*) AS sources, min(distance) AS nearest, max(distance) AS farthest, CAST(sum(distance) AS BIGINT) AS total FROM (
WITH RECURSIVE e AS (SELECT DISTINCT src_doc_id AS s, dst_doc_id AS t FROM lib_relations), r(source, doc_id, distance) USING KEY (source, doc_id) AS (
SELECT doc_id, doc_id, 0 FROM lib_documents WHERE num % 20 = 0
UNION SELECT r.source, e.t, min(r.distance + 1) FROM r JOIN e ON r.doc_id = e.s LEFT JOIN recurring.r k ON k.source = r.source AND k.doc_id = e.t WHERE k.source IS NULL GROUP BY r.source, e.t)
SELECT * FROM r) WHERE distance > 0 GROUP BY doc_id""",
)
def _(lib):
    """Over all relations to any depth, from every document whose id is divisible by 20, summed up for each document."""
    return regions.closeness(lib.relations, lib.documents.where("num % 20 = 0"), lib.documents.select("doc_id", "project_id", "num"))


@query("G07_strong_components", ", v AS (SELECT DISTINCT event_type AS doc_id FROM events) SELECT doc_id, (SELECT max(doc_id) FROM v) AS component FROM v WHERE (SELECT count(DISTINCT src) FROM lib_transitions) > 1")
def _(lib):
    return ops.strong_components(*_types(lib))


@query(
    "G07_strong_components_relations",
    """SELECT d.doc_id, coalesce(m.top, d.doc_id) AS component FROM lib_documents d LEFT JOIN (
WITH RECURSIVE e AS (SELECT DISTINCT src_doc_id AS s, dst_doc_id AS t FROM lib_relations), r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s)
SELECT a.s, max(a.t) AS top FROM r a JOIN r b ON a.s = b.t AND a.t = b.s GROUP BY a.s) m ON d.doc_id = m.s""",
)
def _(lib):
    return ops.strong_components(lib.documents, lib.relations)


@query(
    "G09_has_cycle_relations",
    """SELECT 'all' AS relations, EXISTS (SELECT 1 FROM lib_relations a JOIN lib_relations b ON a.src_doc_id = b.dst_doc_id AND a.dst_doc_id = b.src_doc_id) AS cyclic
UNION ALL SELECT 'series_member', EXISTS (SELECT 1 FROM lib_relations WHERE relation_type = 'series_member' AND CAST(src_doc_id AS BIGINT) >= CAST(dst_doc_id AS BIGINT))""",
)
def _(lib):
    found = [("all", ops.has_cycle(lib.documents, lib.relations)), ("series_member", ops.has_cycle(lib.documents, lib.relations.where(SERIES)))]
    return lib.spark.createDataFrame(found, "relations string, cyclic boolean")


LAYERS = "SELECT doc_id, CAST(CASE WHEN project_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY project_id ORDER BY num) - 1 END AS INTEGER) AS layer FROM lib_documents"


@query("G08_topological_order", f"SELECT doc_id, layer, row_number() OVER (ORDER BY layer, doc_id) AS position FROM ({LAYERS})")
def _(lib):
    return ops.topological_order(lib.documents, lib.relations.where(SERIES)).select("doc_id", "layer", F.col("position").cast("long").alias("position"))


@query("G08_topological_order_all", LAYERS)
def _(lib):
    return ops.topological_layers(lib.documents, lib.relations.where(SERIES))[0]


@query("G09_has_cycle", "SELECT true AS cyclic FROM lib_transitions WHERE src = dst LIMIT 1")
def _(lib):
    return lib.spark.range(1).select(F.lit(ops.has_cycle(*_types(lib))).alias("cyclic"))


@query(
    "G10_relations_of",
    "SELECT src_doc_id AS doc_id, dst_doc_id AS other, relation_type, 'outgoing' AS direction FROM lib_relations WHERE src_doc_id IN (SELECT doc_id FROM lib_documents WHERE format = 'pdf') UNION ALL SELECT dst_doc_id, src_doc_id, relation_type, 'incoming' FROM lib_relations WHERE dst_doc_id IN (SELECT doc_id FROM lib_documents WHERE format = 'pdf')",
)
def _(lib):
    return ops.relations_of(lib.relations, lib.documents.where("format = 'pdf'"))


@query(
    "G11_related_documents",
    """, k AS (SELECT doc_id FROM lib_documents WHERE format = 'png'),
h1 AS (SELECT k.doc_id AS source, r.dst_doc_id AS doc_id FROM k JOIN lib_relations r ON r.src_doc_id = k.doc_id),
h2 AS (SELECT h.source, r.dst_doc_id AS doc_id FROM h1 h JOIN lib_relations r ON r.src_doc_id = h.doc_id),
u AS (SELECT source, doc_id, 1 AS depth FROM h1 UNION ALL SELECT source, doc_id, 2 FROM h2)
SELECT source, doc_id, CAST(min(depth) AS INTEGER) AS depth FROM u WHERE source <> doc_id GROUP BY source, doc_id""",
)
def _(lib):
    return ops.distances(lib.relations, lib.documents.where("format = 'png'"), max_depth=2).select("source", "doc_id", F.col("distance").alias("depth"))


@query(
    "G11_related_every_20th",
    """, e AS (SELECT DISTINCT src_doc_id AS s, dst_doc_id AS t FROM lib_relations), h0 AS (SELECT doc_id AS source, doc_id FROM lib_documents WHERE num % 20 = 0),
h1 AS (SELECT DISTINCT source, t AS doc_id FROM h0 JOIN e ON s = doc_id), h2 AS (SELECT DISTINCT source, t AS doc_id FROM h1 JOIN e ON s = doc_id), h3 AS (SELECT DISTINCT source, t AS doc_id FROM h2 JOIN e ON s = doc_id)
SELECT source, doc_id, CAST(min(d) AS INTEGER) AS depth FROM (SELECT *, 1 AS d FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3) WHERE source <> doc_id GROUP BY ALL""",
)
def _(lib):
    """Within three steps of every document whose id is divisible by 20."""
    found = ops.expanded(*ops.reached(lib.relations, lib.documents.where("num % 20 = 0"), max_depth=3))
    return found.select("source", "doc_id", F.col("distance").alias("depth"))


@query("G12_paths", ", k AS (SELECT project_id, num, doc_id, row_number() OVER (PARTITION BY project_id ORDER BY num) AS n FROM lib_documents WHERE project_id IS NOT NULL), h AS (SELECT *, doc_id || '>' || lead(doc_id) OVER (PARTITION BY project_id ORDER BY num) || ':series_member' AS step FROM k) SELECT a.doc_id AS source, t.doc_id AS target, string_agg(h.step, ' ' ORDER BY h.n) AS path FROM k a JOIN k t ON a.project_id = t.project_id AND a.n = 1 AND t.n BETWEEN 2 AND 11 JOIN h ON h.project_id = a.project_id AND h.n < t.n GROUP BY ALL")
def _(lib):
    """From the first document of each series to every one within the ten steps of a path."""
    first = lib.documents.where("project_id is not null").groupBy("project_id").agg(F.min_by("doc_id", "num").alias("doc_id"))
    reached = ops.distances(lib.relations.where(SERIES), first, max_depth=10)
    return ops.paths(reached, reached.select("source", F.col("doc_id").alias("target")))


@query(
    "G13_neighbourhood",
    """, c AS (SELECT doc_id FROM lib_documents WHERE format = 'md'), n AS (SELECT doc_id AS source, doc_id FROM c UNION SELECT r.src_doc_id, r.dst_doc_id FROM lib_relations r JOIN c ON r.src_doc_id = c.doc_id)
SELECT DISTINCT a.source, r.src_doc_id, r.dst_doc_id, r.relation_type FROM n a JOIN lib_relations r ON r.src_doc_id = a.doc_id JOIN n b ON b.source = a.source AND b.doc_id = r.dst_doc_id""",
)
def _(lib):
    return ops.neighbourhood(lib.relations, lib.documents.where("format = 'md'").select("doc_id"), 1)[1]


@query("G14_hub_scores", "SELECT doc_id, count(*) AS hub_score FROM (SELECT src_doc_id AS doc_id FROM lib_relations UNION ALL SELECT dst_doc_id FROM lib_relations) GROUP BY doc_id")
def _(lib):
    return ops.hub_scores(lib.relations)


@query("G15_edge_counts", "SELECT coalesce(relation_type, 'total') AS relation_type, count(*) AS n FROM lib_relations GROUP BY ROLLUP (relation_type)")
def _(lib):
    return ops.edge_counts(lib.relations)


@query("G17_community_sizes", "SELECT coalesce(project_id, doc_id) AS c, count(*) AS n FROM lib_documents GROUP BY 1 HAVING count(*) > 0")
def _(lib):
    c = ops.connected_components(lib.documents, lib.relations).withColumnRenamed("component", "community")
    sized = ops.community_members(c, lib.documents).join(lib.documents.select("doc_id", "project_id"), "doc_id")
    return sized.groupBy(F.coalesce("project_id", "doc_id").alias("c")).agg(F.max("size").alias("n"))


@query("G18_community_members", "SELECT d.doc_id, d.filename, count(*) OVER (PARTITION BY coalesce(project_id, doc_id)) AS size FROM lib_documents d")
def _(lib):
    c = ops.connected_components(lib.documents, lib.relations).withColumnRenamed("component", "community")
    return ops.community_members(c, lib.documents).select("doc_id", "filename", "size")


@query("G19_top_ranked")
def _(lib):
    return ops.top_ranked(ops.pagerank(lib.documents, lib.relations), lib.documents, 10)


@query(
    "G20_similar_documents",
    """, e AS (SELECT src_doc_id AS doc_id, dst_doc_id AS other, CASE relation_type WHEN 'series_member' THEN 0.9 ELSE 0.8 END AS s FROM lib_relations UNION ALL SELECT dst_doc_id, src_doc_id, CASE relation_type WHEN 'series_member' THEN 0.9 ELSE 0.8 END FROM lib_relations),
b AS (SELECT doc_id, other, CAST(max(s) AS DOUBLE) AS score FROM e WHERE doc_id <> other GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, other) AS rank FROM b)
SELECT doc_id, other, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""",
)
def _(lib):
    return ops.similar_documents(lib.relations, F.when(F.col("relation_type") == "series_member", 0.9).otherwise(0.8), 3).select("doc_id", "other", "score", "rank")


@query("G21_edge_list", "SELECT src_doc_id, dst_doc_id, relation_type FROM lib_relations WHERE relation_type = 'same_author' ORDER BY 1, 2, 3 LIMIT 100")
def _(lib):
    return ops.edge_list(lib.relations, relation_type="same_author").select("src_doc_id", "dst_doc_id", "relation_type")


@query("G22_reading_order", f"SELECT doc_id, 'topological' AS method, row_number() OVER (ORDER BY layer, doc_id) AS position FROM ({LAYERS}) WHERE doc_id IN (SELECT doc_id FROM lib_documents WHERE lang = 'fr')")
def _(lib):
    """The order of the whole graph, for the members of one group."""
    found = ops.reading_order(lib.documents, lib.relations.where(SERIES), lib.documents.where("lang = 'fr'"))
    return found.select("doc_id", "method", F.col("position").cast("long").alias("position"))


@query("G22_reading_order_all", f"SELECT doc_id, 'topological' AS method, row_number() OVER (ORDER BY layer, doc_id) AS position FROM ({LAYERS})")
def _(lib):
    return ops.reading_order(lib.documents, lib.relations.where(SERIES)).select("doc_id", "method", F.col("position").cast("long").alias("position"))


@query("G22_reading_order_ranked")
def _(lib):
    """Authors' links go both ways, so the whole graph is cyclic and PageRank orders it."""
    return ops.reading_order(lib.documents, lib.relations).select("doc_id", "method", F.col("position").cast("long").alias("position"))


@query("G23_graph_stats", "SELECT (SELECT count(*) FROM lib_documents) AS documents, (SELECT count(*) FROM lib_relations) AS relations, (SELECT count(DISTINCT relation_type) FROM lib_relations) AS types")
def _(lib):
    r = lib.relations.agg(F.count("*").alias("relations"), F.count_distinct("relation_type").alias("types"))
    return lib.documents.agg(F.count("*").alias("documents")).crossJoin(r)
