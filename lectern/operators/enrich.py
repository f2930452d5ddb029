"""Graph enrichment (E): representative chunks, similarity and topic edges, node properties, the full run."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from lectern.operators import graph, vectors
from lectern.sources.shared import cut


@dataclass(frozen=True)
class Settings:
    """Thresholds of the enrichment (E-08)."""

    neighbours: int = 5
    min_similarity: float = 0.7
    min_jaccard: float = 0.5
    largest_community: int = 20
    interval_s: int = 3600
    recall: float = 0.95
    exact: bool = False
    max_iter: int = 100


def representatives(chunks: DataFrame) -> DataFrame:
    """The chunk of most words of each document, with its vectors (E-01); chunks(id, doc, word_count, tokens)."""
    best = F.max_by(F.struct("id", "tokens"), F.struct("word_count", "id"))
    return chunks.where("tokens is not null").groupBy("doc").agg(best.alias("b")).select("doc", "b.id", "b.tokens")


def both_directions(pairs: DataFrame, relation_type: str, metadata: Column) -> DataFrame:
    """Edges a -> b and b -> a of unordered pairs."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("src_doc_id"), F.col("b").alias("dst_doc_id")), F.struct(F.col("b").alias("src_doc_id"), F.col("a").alias("dst_doc_id"))))
    return pairs.select(ends.alias("e"), metadata.alias("metadata")).select("e.src_doc_id", "e.dst_doc_id", F.lit(relation_type).alias("relation_type"), "metadata")


def similar_edges(chunks: DataFrame, s: Settings) -> DataFrame:
    """similar_to: each document's representative against all chunks (E-02).

    Candidates come from the exact grid, for very large corpora from a hyperplane index that finds chunks of
    ``min_similarity`` with the chance ``recall``, unless ``exact`` is set; equal representatives ask once. The nearest documents are scored again by exact MaxSim of the representatives; those of enough similarity get edges both
    ways, a pair once with its best score.
    """
    rep = cut(representatives(chunks))
    hits = similar_hits(chunks.select(F.col("id").alias("chunk"), "doc", "tokens"), rep.select(F.col("doc").alias("query_id"), "tokens"), s)
    return similar_pairs(similar_scores(hits, rep, s))


def most_hits(s: Settings) -> int:
    """Nearest chunks of a document among which its neighbours are sought."""
    return 10 * (s.neighbours + 1)


def similar_hits(corpus: DataFrame, asked: DataFrame, s: Settings) -> DataFrame:
    """(query_id, chunk, doc, distance) of the nearest ``most_hits`` chunks of ``corpus(chunk, doc, tokens)`` for each ``asked(query_id, tokens)``, those of enough similarity.

    A document's representative is no nearer than the nearest of its chunks, so what is left out here makes no edge.
    """
    within = 1 - s.min_similarity + 1e-6
    if s.exact:
        return vectors.search(corpus, asked, most_hits(s), within=within).drop("rank")
    classes = cut(asked.groupBy("tokens").agg(F.min("query_id").alias("first")))
    once = classes.select(F.col("first").alias("query_id"), "tokens")
    if vectors.index_pays(corpus.agg(F.sum(F.size("tokens"))).first()[0] or 0, s.min_similarity, s.recall):
        found = vectors.search_near(corpus, once, most_hits(s), s.min_similarity - 1e-6, s.recall)
    else:
        found = vectors.search(corpus, once, most_hits(s), within=within).drop("rank")
    same = asked.join(classes, "tokens").select("query_id", "first")
    return found.withColumnRenamed("query_id", "first").join(same, "first").select("query_id", "chunk", "doc", "distance")


def similar_scores(hits: DataFrame, rep: DataFrame, s: Settings) -> DataFrame:
    """(query_id, doc, similarity): each query's nearest other documents by exact MaxSim of representatives, those of enough similarity."""
    near = vectors.nearest_documents(hits, s.neighbours + 1).where("query_id <> doc")
    asked = rep.select(F.col("doc").alias("query_id"), "tokens")
    scored = vectors.reranked(near, asked, rep.select("doc", "tokens"), s.neighbours + 1)
    return scored.where(F.col("similarity") >= s.min_similarity).select("query_id", "doc", "similarity")


def similar_pairs(scored: DataFrame) -> DataFrame:
    """Edges both ways of scored pairs, a pair once with its best score."""
    pairs = scored.groupBy(F.least("query_id", "doc").alias("a"), F.greatest("query_id", "doc").alias("b")).agg(F.max("similarity").alias("score"))
    return both_directions(pairs, "similar_to", F.to_json(F.struct(F.round("score", 4).alias("score"), F.lit("maxsim_reranked").alias("method"))))


def heading_sets(chunks: DataFrame) -> DataFrame:
    """Distinct (doc_id, heading) of chunks: parent heading, and section path as a whole or, of a list, each entry; trimmed and lower (E-03)."""
    listed = isinstance(chunks.schema["section_path"].dataType, T.ArrayType)
    named = F.concat(F.array("parent_heading"), F.coalesce("section_path", F.array().cast("array<string>")) if listed else F.array("section_path"))
    h = chunks.select("doc_id", F.explode(named).alias("h")).select("doc_id", F.lower(F.trim("h")).alias("heading"))
    return h.where("heading <> ''").distinct()


def with_context(chunks: DataFrame) -> DataFrame:
    """``chunks(doc_id, context)`` with the context's parent_heading and section_path, a list of one where it is a text; broken contexts drop out."""
    told, lists = F.from_json("context", "parent_heading string, section_path string"), F.from_json("context", "section_path array<string>")
    path = F.coalesce(lists["section_path"], F.array(told["section_path"]))
    return chunks.where(F.try_parse_json("context").isNotNull()).select("doc_id", told["parent_heading"].alias("parent_heading"), path.alias("section_path"))


def _sets(headings: DataFrame) -> DataFrame:
    return headings.groupBy("doc_id").agg(F.sort_array(F.collect_set("heading")).alias("headings"))


def topic_classes(headings: DataFrame) -> DataFrame:
    """(class_id, headings, members): each distinct set of headings, named after its smallest document (E-04)."""
    return _classes(_sets(headings))


def _classes(sets: DataFrame) -> DataFrame:
    return sets.groupBy("headings").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members")).select("class_id", "headings", "members")


def topic_links(classes: DataFrame, s: Settings, fresh: DataFrame | None = None) -> DataFrame:
    """(a, b, jaccard, shared) of different classes whose sets have a Jaccard of at least min_jaccard, a before b (E-04).

    Headings are ranked from rare to common. The smaller set of a pair is looked up by its first headings only, the larger
    one by somewhat more of them, and the places of a heading in both bound what the sets can share. A heading of a third
    of all documents is thus looked up in sets that consist of little else. With ``fresh(class_id)`` only links that have
    one of these classes at an end are sought, under headings of theirs.
    """
    t = s.min_jaccard
    ranked = _ranked(classes.select("class_id", F.size("headings").alias("n"), F.size("headings").alias("held"), F.explode("headings").alias("heading")))
    if fresh is None:
        ranked = ranked.withColumn("new", F.lit(True))
    else:
        ranked = ranked.join(fresh.select("class_id", F.lit(True).alias("new")), "class_id", "left")
        ranked = ranked.join(ranked.where("new").select("heading").distinct(), "heading", "left_semi").withColumn("new", F.coalesce("new", F.lit(False)))
    own = lambda name, held: classes.select(F.col("class_id").alias(name), F.col("headings").alias(held))
    met = _candidates(ranked, t).join(own("x", "hx"), "x").join(own("y", "hy"), "y").withColumn("shared", F.sort_array(F.array_intersect("hx", "hy")))
    n, c = F.size("hx") + F.size("hy"), F.size("shared")
    return met.where(c >= t * (n - c)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round(c / (n - c), 4).alias("jaccard"), "shared")


def _ranked(single: DataFrame) -> DataFrame:
    """``single(class_id, heading, ...)`` with ``df``, the classes of a heading, and ``at``, its place in its class from rare to common."""
    freq = single.groupBy("heading").agg(F.count("*").alias("df"))
    return single.join(freq, "heading").withColumn("at", F.row_number().over(Window.partitionBy("class_id").orderBy("df", "heading")))


def _candidates(ranked: DataFrame, t: float) -> DataFrame:
    """(x, y), the smaller set first, of which one is new and that may have a Jaccard of t; ranked(class_id, n, held, heading, at, new).

    A class has n headings, of which ``held`` are ranked; only those count as shared.
    """
    first = lambda share: ranked.where(F.col("at") <= F.col("held") - F.ceil(F.col("n") * share - 1e-9) + 1)
    end = lambda c: [F.col("class_id").alias(c), F.col("n").alias(f"n{c}"), F.col("held").alias(f"h{c}"), F.col("at").alias(f"i{c}"), F.col("new").alias(f"new_{c}")]
    small, large = first(2 * t / (1 + t)).select("heading", *end("x")), first(t).select("heading", *end("y"))
    most = 1 + F.least(F.col("hx") - F.col("ix"), F.col("hy") - F.col("iy"))
    smaller = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    fits = smaller & (F.col("nx") >= F.col("ny") * t) & (most >= t * (F.col("nx") + F.col("ny") - most))
    return small.join(large, "heading").where(fits & (F.col("new_x") | F.col("new_y"))).select("x", "y").distinct()


def topic_number(classes: DataFrame, s: Settings, crowd: int | None = None) -> DataFrame:
    """(topic_edges): how many rows ``topic_edges`` has, without a row for each link of classes (E-04, E-08).

    Headings of more than ``crowd`` classes, by default the root of their number and 300 at least, are common. Classes of one size with the same common headings are a kind. Two classes that
    share common headings only are counted by their kinds, at once for all of both. Those that share another one too are few,
    at most ``crowd`` for each heading of a class; of them the pairs are added that reach min_jaccard by it and not
    by their common headings alone.
    """
    t = s.min_jaccard
    crowd = max(300, int(classes.count() ** 0.5)) if crowd is None else crowd
    single = classes.select("class_id", F.size("headings").alias("n"), F.size("headings").alias("held"), F.lit(True).alias("new"), F.explode("headings").alias("heading"))
    ranked = cut(_ranked(single))
    common = ranked.where(F.col("df") > crowd).groupBy("class_id").agg(F.sort_array(F.collect_list("heading")).alias("common"))
    sized = classes.join(common, "class_id", "left").withColumn("common", F.coalesce("common", F.array().cast("array<string>"))).withColumn("n", F.size("headings"))
    total = F.col("members").cast("long")
    grouped = sized.groupBy("n", "common").agg(F.min("class_id").alias("class_id"), F.sum(total).alias("members"), F.sum(total * total).alias("squares"))
    kinds = cut(grouped.withColumn("held", F.size("common")).where("held > 0"))

    def enough(c: Column, n: Column) -> Column:
        return c >= t * (n - c)

    alone = classes.select((total * (total - 1)).alias("n"))
    inside = kinds.where(enough(F.col("held"), 2 * F.col("n"))).select((F.col("members") * F.col("members") - F.col("squares")).alias("n"))
    looked = _ranked(kinds.select("class_id", "n", "held", F.lit(True).alias("new"), F.explode("common").alias("heading")))
    both = lambda rows, *names: [rows.select(F.col("class_id").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in names]) for c in "xy"]
    x, y = both(kinds, "n", "members", "common")
    shared = F.size(F.array_intersect("common_x", "common_y"))
    size = F.col("n_x") + F.col("n_y")
    times = (2 * F.col("members_x") * F.col("members_y")).alias("n")
    across = _candidates(looked, t).join(x, "x").join(y, "y").where(enough(shared, size)).select(times)
    x, y = both(sized, "n", "members", "common", "headings")
    by_more = enough(F.size(F.array_intersect("headings_x", "headings_y")), size) & ~enough(shared, size)
    more = _candidates(ranked.where(F.col("df") <= crowd), t).join(x, "x").join(y, "y").where(by_more).select(times)
    return alone.unionByName(inside).unionByName(across).unionByName(more).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("topic_edges"))


def topic_members(headings: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, class_id, links): a document's class and how many documents it shares its topic with (E-04); one row a document."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("class_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("class_id"), F.col("a").alias("other")))).alias("e")).select("e.*")
    others = ends.join(classes.select(F.col("class_id").alias("other"), "members"), "other").groupBy("class_id").agg(F.sum("members").alias("reached"))
    told = classes.join(others, "class_id", "left").select("headings", "class_id", (F.col("members") - 1 + F.coalesce("reached", F.lit(0))).alias("links"))
    return _sets(headings).join(told, "headings").select("doc_id", "class_id", "links")


def topic_edges(headings: DataFrame, s: Settings, fresh: DataFrame | None = None) -> DataFrame:
    """same_topic: pairs of documents that share headings, Jaccard of at least min_jaccard (E-04).

    Classes of equal sets are compared once; this expands them into all their pairs. ``topic_members`` and ``topic_links``
    tell the same in rows linear in the documents and in the pairs of different sets. With ``fresh(doc_id)`` only edges
    that touch one of these documents.
    """
    sets = cut(_sets(headings))
    classes = cut(_classes(sets))
    members = cut(sets.join(classes, "headings").select("doc_id", "class_id"))
    ends = members.withColumn("new", F.lit(True)) if fresh is None else members.join(fresh.select("doc_id", F.lit(True).alias("new")).distinct(), "doc_id", "left")
    touched = None if fresh is None else cut(ends.where("new").select("class_id").distinct())
    alike = classes if touched is None else classes.join(touched, "class_id", "left_semi")
    return expanded_topics(ends, cut(topic_links(classes, s, touched)).unionByName(within_classes(alike)))


def within_classes(classes: DataFrame) -> DataFrame:
    """The link of each class of several members to itself, as ``topic_links`` has those of different ones."""
    return classes.where("members > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.lit(1.0).alias("jaccard"), F.col("headings").alias("shared"))


def topic_count(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(topic_edges): how many rows ``topic_edges`` has, from the classes' sizes."""
    size = lambda c: classes.select(F.col("class_id").alias(c), F.col("members").alias(f"n_{c}"))
    apart = links.select("a", "b").join(size("a"), "a").join(size("b"), "b").select((2 * F.col("n_a") * F.col("n_b")).alias("n"))
    return classes.select((F.col("members") * (F.col("members") - 1)).alias("n")).unionByName(apart).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("topic_edges"))


def expanded_topics(members: DataFrame, links: DataFrame, block: int = 1000) -> DataFrame:
    """The same_topic edges of documents for members(doc_id, class_id, new) and links(a, b, jaccard, shared), a class linked to itself included; one end at least is new.

    Members are dealt into blocks of about ``block``, and so are the members of all smaller classes linked to a class, together. A
    pair of blocks is a row, so a class moves once for a block and not once for a link; these rows are dealt evenly, so a large
    class spreads over all tasks.
    """
    n = 4 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = members.groupBy("class_id").agg(F.count("*").alias("size"))
    dealt = members.join(sizes, "class_id").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / block)))
    blocks = cut(dealt.groupBy("class_id", "at").agg(F.collect_list(F.struct("doc_id", "new")).alias("docs")))
    left, right = (blocks.select(F.col("class_id").alias("a"), F.col("at").alias(f"at_{c}"), F.col("docs").alias(f"docs_{c}")) for c in "ab")
    within = links.where("a = b").select("a", "jaccard", "shared").join(left, "a").join(right, "a").where("at_a <= at_b")

    of = lambda c: sizes.select(F.col("class_id").alias(c), F.col("size").alias(f"n_{c}"))
    apart = links.where("a <> b").join(of("a"), "a").join(of("b"), "b")
    first = F.col("n_a") >= F.col("n_b")
    turned = apart.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("class_id"), "jaccard", "shared")
    smaller = cut(turned.join(members, "class_id").select("a", "doc_id", "new", "jaccard", "shared"))
    parts = smaller.groupBy("a").agg(F.ceil(F.count("*") / block).alias("parts"))
    met = smaller.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    beside = met.groupBy("a", "part").agg(F.collect_list(F.struct("doc_id", "new", "jaccard", "shared")).alias("docs_b"))

    spread = lambda tiles: tiles.repartition(n).withColumn("p", F.explode("docs_a")).drop("docs_a").withColumn("q", F.explode("docs_b"))
    ends = ["p.new as p_new", "q.new as q_new", "p.doc_id as a", "q.doc_id as b"]
    own = spread(within).where("at_a < at_b or p.doc_id < q.doc_id").selectExpr(*ends, "jaccard", "shared")
    other = spread(beside.join(left, "a").select("docs_a", "docs_b")).selectExpr(*ends, "q.jaccard", "q.shared")
    return both_directions(own.unionByName(other).where("p_new or q_new").select("a", "b", "jaccard", "shared"), "same_topic", topic_metadata())


def topic_metadata() -> Column:
    return F.to_json(F.struct("jaccard", F.col("shared").alias("shared_headings")))


def topic_parts(headings: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, links of different ones, members (doc_id, class_id)): what ``topic_edges`` says, linear in documents and in pairs of different sets."""
    classes = cut(topic_classes(headings))
    return classes, cut(topic_links(classes, s)), _sets(headings).join(classes, "headings").select("doc_id", "class_id")


def community_edges(communities: DataFrame, s: Settings) -> DataFrame:
    """overlaps_topic: all pairs within a community of at most largest_community members; larger ones are skipped (E-05)."""
    sizes = communities.groupBy("community").agg(F.count("*").alias("n")).where((F.col("n") <= s.largest_community) & (F.col("n") > 1))
    held = communities.join(sizes, "community")
    a, b = held.select("community", F.col("doc_id").alias("a")), held.select("community", F.col("doc_id").alias("b"))
    return both_directions(a.join(b, "community").where("a < b"), "overlaps_topic", F.to_json(F.struct(F.col("community").alias("community_id"))))


def node_properties(documents: DataFrame, ranks: DataFrame, communities: DataFrame, hubs: DataFrame) -> DataFrame:
    """(doc_id, pagerank_score, community_id, hub_score) of documents that have at least one, with defaults (E-06)."""
    joined = documents.select("doc_id").join(ranks, "doc_id", "left").join(communities, "doc_id", "left").join(hubs, "doc_id", "left")
    some = F.coalesce(F.col("pagerank").cast("string"), F.col("community").cast("string"), F.col("hub_score").cast("string")).isNotNull()
    return joined.where(some).select("doc_id", F.round(F.coalesce("pagerank", F.lit(0.0)), 6).alias("pagerank_score"), F.col("community").alias("community_id"), F.coalesce("hub_score", F.lit(0)).alias("hub_score"))


def with_graph_metadata(documents: DataFrame, properties: DataFrame, at: Column | None = None) -> DataFrame:
    """``documents`` whose metadata holds the properties and the time under ``graph``; other keys stay (E-06)."""
    kept = F.coalesce(F.try_parse_json("metadata").cast("map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    when = F.date_format(at if at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    graph_of = F.struct("pagerank_score", "community_id", "hub_score", when.alias("enriched_at"))
    own = properties.select("doc_id", F.parse_json(F.to_json(graph_of, {"ignoreNullFields": "false"})).alias("__graph"))
    merged = F.to_json(F.map_concat(F.map_filter(kept, lambda k, v: k != "graph"), F.create_map(F.lit("graph"), F.col("__graph"))))
    joined = documents.join(own, "doc_id", "left")
    return joined.withColumn("metadata", F.when(F.col("__graph").isNull(), F.col("metadata")).otherwise(merged)).drop("__graph")


def full_run(spark: SparkSession, steps: dict, s: Settings | None = None) -> DataFrame:
    """One row a step: name, rows made, error, milliseconds, settled; a failing step doesn't stop the next (E-07).

    steps maps a name to a function that returns the step's DataFrame or how many rows it has, those with rounds also whether they settled.
    """
    rows = []
    for name, make in steps.items():
        began = time.time()
        try:
            made = make()
            df, settled = made if isinstance(made, tuple) else (made, None)
            rows.append((name, df if isinstance(df, int) else df.count(), None, int((time.time() - began) * 1000), settled))
        except Exception as e:  # isolated by contract; the error is in the result
            rows.append((name, 0, str(e).splitlines()[0][:500], int((time.time() - began) * 1000), None))
    return spark.createDataFrame(rows, "step string, rows long, error string, ms long, settled boolean")


def stored_run(
    documents: DataFrame, relations: DataFrame, chunks: DataFrame, vector_chunks: DataFrame, s: Settings, path: str, run: int = 0, project_id: str | None = None, at: Column | None = None, batch: DataFrame | None = None
) -> DataFrame:
    """The four steps with their results kept under ``path``; gives one row a step as ``full_run`` (E-07).

    Each run writes folders of its own, named by its number, so a repeated run replaces what it wrote before and nothing
    else: ``edges/relation_type=T/run=N`` and ``properties/run=N``, the documents with their graph metadata. A step that
    fails leaves the edges of the last run that made them. Within ``project_id`` only its documents, chunks and relations
    take part, and the edges of a type are replaced as a whole. Every step reads the relations as they were when the run
    began. same_topic is kept as links of classes and their members, ``topic_members/run=N``; ``stored_relations`` expands
    them. With ``batch(doc_id)``, the documents that came since the last run, similar_to computes the edges that touch them
    alone and takes the others from earlier runs (``grown_steps``).
    """
    spark = documents.sparkSession
    if project_id is not None:
        ids = cut(documents.where(F.col("project_id") == project_id).select("doc_id"))
        relations, documents = graph.edge_set(relations, ids), documents.join(ids, "doc_id", "left_semi")
        chunks = chunks.join(ids, "doc_id", "left_semi")
        vector_chunks = vector_chunks.join(ids, vector_chunks["doc"].cast("string") == ids["doc_id"], "left_semi")
    steps = enrichment_steps(documents, relations, chunks, vector_chunks, s) | {"same_topic": lambda: topic_parts(heading_sets(chunks), s)}
    if batch is not None:
        steps |= grown_steps(documents, chunks, vector_chunks, s, path, run, batch)

    def kept(name: str) -> tuple[DataFrame, bool | None]:
        made = steps[name]()
        if name == "same_topic":
            classes, links, members = made
            df, settled = None, None
        else:
            df, settled = made if isinstance(made, tuple) else (made, None)
        if name == "same_topic":
            members.select(F.col("doc_id").cast("string"), F.col("class_id").cast("string")).write.mode("overwrite").parquet(f"{path}/topic_members/run={run}")
            df = links.unionByName(within_classes(classes)).select(F.col("a").alias("src_doc_id"), F.col("b").alias("dst_doc_id"), topic_metadata().alias("metadata"))
        if name == "node_properties":
            folder = f"{path}/properties/run={run}"
            shown = with_graph_metadata(documents, df, at).select("doc_id", "metadata")
            shown.write.mode("overwrite").parquet(folder)
            return df, settled
        folder = f"{path}/edges/relation_type={name}/run={run}"
        df.select(F.col("src_doc_id").cast("string"), F.col("dst_doc_id").cast("string"), "metadata").write.mode("overwrite").parquet(folder)
        if name == "same_topic":
            return topic_count(classes, links).first()[0], settled
        return spark.read.schema("src_doc_id string, dst_doc_id string, metadata string").parquet(folder), settled

    report = full_run(spark, {name: lambda name=name: kept(name) for name in steps}, s)
    report.coalesce(1).write.mode("overwrite").parquet(f"{path}/report/run={run}")  # four rows
    return spark.read.schema(report.schema).parquet(f"{path}/report/run={run}")


def of_runs(spark: SparkSession, folder: str, schema: str, runs: DataFrame, before: int) -> DataFrame:
    """What those of runs(run) that are before a number wrote into ``folder``, with the column ``run``; later folders are not opened."""
    try:
        held = spark.read.schema(f"{schema}, run int").option("basePath", folder).parquet(f"{folder}/run=*")
    except AnalysisException as e:  # no run so far
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, run int")
    return held.where(F.col("run") < before).join(F.broadcast(runs), "run", "left_semi")  # a row a run


def grown_steps(documents: DataFrame, chunks: DataFrame, vector_chunks: DataFrame, s: Settings, path: str, run: int, batch: DataFrame) -> dict:
    """similar_to as a function that goes on from the good runs before ``run`` under ``path`` (E-07, T-10).

    A step's new documents are the batch and those that no good run of the step has seen, so a failed step is made up for.
    New representatives are compared with all chunks and the others with the new documents' chunks only; the nearest chunks
    of a document are kept, so both together are what a full run finds (with the index each finds pairs with the chance
    ``recall``). A document that comes again replaces what it was; those that had it among their nearest ask anew. Only
    what earlier runs left counts, so a run that is repeated under its number gives the same, and so does a batch that comes
    twice. Settings must stay as they were. Communities and ranks are of the whole graph and are computed anew.
    """
    spark = documents.sparkSession

    def written(df: DataFrame, folder: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{folder}/run={run}")
        return spark.read.schema(df.schema).parquet(f"{path}/{folder}/run={run}")

    def good(step: str) -> DataFrame:
        told = of_runs(spark, f"{path}/report", "step string, error string", spark.range(run).select(F.col("id").cast("int").alias("run")), run)
        return cut(told.where((F.col("step") == step) & F.col("error").isNull()).select("run").distinct())

    def fresh(step: str, runs: DataFrame) -> DataFrame:
        ids = documents.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
        seen = of_runs(spark, f"{path}/seen/relation_type={step}", "doc_id string", runs, run)
        again = ids.join(batch.select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id", "left_semi")
        return written(ids.join(seen, "doc_id", "left_anti").unionByName(again).distinct(), f"seen/relation_type={step}")

    def similar() -> DataFrame:
        runs = good("similar_to")
        new = fresh("similar_to", runs)
        kind, name = vector_chunks.schema["doc"].dataType.simpleString(), vector_chunks.schema["id"].dataType.simpleString()
        of_new = lambda rows, c: rows.join(new.withColumnRenamed("doc_id", "__new"), F.col(c).cast("string") == F.col("__new"), "left_semi")
        last = cut(of_runs(spark, f"{path}/similar_asked", f"query_id {kind}", runs, run).groupBy("query_id").agg(F.max("run").alias("run")))
        held = of_runs(spark, f"{path}/similar_hits", f"query_id {kind}, chunk {name}, doc {kind}, distance double", runs, run).join(last, ["query_id", "run"]).drop("run")
        rep = cut(representatives(vector_chunks))
        corpus = vector_chunks.select(F.col("id").alias("chunk"), "doc", "tokens")
        anew = cut(of_new(rep.select(F.col("doc").alias("query_id")), "query_id").union(of_new(last.select("query_id"), "query_id")).union(of_new(held, "doc").select("query_id")).distinct())
        asked = rep.select(F.col("doc").alias("query_id"), "tokens")
        whole = similar_hits(corpus, asked.join(anew, "query_id", "left_semi"), s)
        came = cut(similar_hits(of_new(corpus, "doc"), asked.join(anew, "query_id", "left_anti"), s))
        both = held.join(came.select("query_id").distinct(), "query_id", "left_semi").withColumn("new", F.lit(False)).unionByName(came.withColumn("new", F.lit(True)))
        order = Window.partitionBy("query_id").orderBy("distance", "chunk")
        nearest = cut(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_hits(s)))
        moved = nearest.where("new").select("query_id").distinct()
        hits = written(whole.unionByName(nearest.join(moved, "query_id", "left_semi").select(*whole.columns)), "similar_hits")
        now = written(anew.union(moved).distinct(), "similar_asked")
        scored = written(similar_scores(hits, rep, s), "similar_scored")
        before = of_runs(spark, f"{path}/similar_scored", f"query_id {kind}, doc {kind}, similarity double", runs, run).join(last, ["query_id", "run"]).join(now, "query_id", "left_anti")
        return similar_pairs(before.select(*scored.columns).unionByName(scored))

    return {"similar_to": similar}


def stored_relations(spark: SparkSession, path: str, relations: DataFrame | None = None, expand: bool = True) -> DataFrame:
    """The edges of each computed type from its last good run, with those of other types from ``relations`` (S-14, E-07).

    Without ``expand`` same_topic joins the first documents of classes only, and same_topic_class leads from each other
    document to the first of its class; that tells the same in rows linear in the documents and the pairs of different sets.
    """
    report = spark.read.schema("step string, rows long, error string, run int").option("basePath", f"{path}/report").parquet(f"{path}/report/run=*")
    last = report.where("error is null and step <> 'node_properties'").groupBy(F.col("step").alias("relation_type")).agg(F.max("run").alias("run"))
    schema = "src_doc_id string, dst_doc_id string, metadata string, relation_type string, run int"
    edges = spark.read.schema(schema).option("basePath", f"{path}/edges").parquet(f"{path}/edges/relation_type=*/run=*")
    found = edges.join(F.broadcast(last), ["relation_type", "run"])  # at most three rows
    topics = found.where("relation_type = 'same_topic'")
    held = spark.read.schema("doc_id string, class_id string, run int").option("basePath", f"{path}/topic_members").parquet(f"{path}/topic_members/run=*")
    members = held.join(F.broadcast(last.where("relation_type = 'same_topic'").select("run")), "run", "left_semi").select("doc_id", "class_id")
    if expand:
        told = F.from_json("metadata", "jaccard double, shared_headings array<string>")
        links = topics.select(F.col("src_doc_id").alias("a"), F.col("dst_doc_id").alias("b"), told["jaccard"].alias("jaccard"), told["shared_headings"].alias("shared"))
        topics = expanded_topics(members.withColumn("new", F.lit(True)), links)
    else:
        between = both_directions(topics.where("src_doc_id <> dst_doc_id").select(F.col("src_doc_id").alias("a"), F.col("dst_doc_id").alias("b"), "metadata"), "same_topic", F.col("metadata"))
        into = members.where("doc_id <> class_id").select(F.col("doc_id").alias("src_doc_id"), F.col("class_id").alias("dst_doc_id"), F.lit("same_topic_class").alias("relation_type"), F.lit(None).cast("string").alias("metadata"))
        topics = between.unionByName(into)
    found = found.where("relation_type <> 'same_topic'").select("src_doc_id", "dst_doc_id", "relation_type", "metadata").unionByName(topics)
    if relations is None:
        return found
    made = last.select("relation_type").unionByName(spark.createDataFrame([("same_topic_class",)], "relation_type string"))
    others = relations.join(F.broadcast(made), "relation_type", "left_anti")
    return others.unionByName(found, allowMissingColumns=True).select("src_doc_id", "dst_doc_id", "relation_type", "metadata")


def stored_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, metadata) of each document from the last run that had it (E-06, E-07)."""
    runs = spark.read.schema("doc_id string, metadata string, run int").option("basePath", f"{path}/properties").parquet(f"{path}/properties/run=*")
    return runs.groupBy("doc_id").agg(F.max_by("metadata", "run").alias("metadata"))


def without_own_edges(relations: DataFrame, relation_type: str) -> DataFrame:
    """Input of a computed type: all edges but those it will replace."""
    return relations.where(F.col("relation_type") != relation_type)


def enrichment_steps(documents: DataFrame, relations: DataFrame, chunks: DataFrame, vector_chunks: DataFrame, s: Settings) -> dict:
    """The four steps of a full run as functions."""
    base = without_own_edges(relations, "overlaps_topic")
    labels = cache(lambda: graph.labels_settled(documents, base, s.max_iter))

    def overlaps() -> tuple[DataFrame, bool]:
        communities, settled = labels()
        return community_edges(communities, s), settled

    def properties() -> tuple[DataFrame, bool]:
        ranks, ranked = graph.pagerank_settled(documents, relations, max_iter=s.max_iter)
        communities, settled = labels()
        return node_properties(documents, ranks, communities, graph.hub_scores(relations)), ranked and settled

    return {
        "similar_to": lambda: similar_edges(vector_chunks, s),
        "same_topic": lambda: topic_edges(heading_sets(chunks), s),
        "overlaps_topic": overlaps,
        "node_properties": properties,
    }
