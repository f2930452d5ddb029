"""The search grid, candidate index, graph algorithms on relations and stored enrichment against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import enrich, graph, jobs, vectors
from lectern.plans import catalog, registry
from lectern.plans.context_queries import with_variants


def plain_distance(q, d):
    def unit(m):
        m = np.array(m, np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    return 1 - float((unit(q) @ unit(d).T).max(axis=1).mean())


def plain_search(corpus, queries, k):
    out = {}
    for i, q in queries:
        near = sorted((round(plain_distance(q, t), 9), name, doc) for name, doc, t in corpus if t and len(t[0]) == len(q[0])) if q else []
        out |= {(i, rank + 1): (name, doc, d) for rank, (d, name, doc) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_search_over_bands_and_cells(spark, monkeypatch, kind):
    monkeypatch.setattr(vectors, "BAND", 2)
    monkeypatch.setattr(vectors, "CELL", 2)
    r = random.Random(8)
    some = lambda n, d: [[float(np.float32(r.gauss(0, 1))) for _ in range(d)] for _ in range(n)]
    corpus = [(i, i // 3, some(r.randint(0, 4), 3 if i % 11 else 5)) for i in range(150)] + [(500 + i, 99, [[1.0, 2.0, 3.0]]) for i in range(6)]
    queries = [(i, some(r.randint(0, 3), 3)) for i in range(40)] + [(90, [[0.0, 0.0, 0.0]]), (91, [[1.0, 2.0, 3.0]]), (92, some(2, 5))]
    c = spark.createDataFrame(corpus, f"chunk long, doc long, tokens array<array<{kind}>>").repartition(4)
    q = spark.createDataFrame(queries, f"query_id long, tokens array<array<{kind}>>").repartition(3)
    got = {(x.query_id, x.rank): (x.chunk, x.doc, round(x.distance, 9)) for x in vectors.search(c, q, 7, block=6, shard=9).collect()}
    assert got == plain_search(corpus, queries, 7)


def test_grid_moves_each_shard_once_for_a_band():
    assert vectors.grid(64, 10_000) == (1, 625)
    assert vectors.grid(1000, 10_000) == (16, 625)
    assert vectors.grid(1, 1) == (1, 1) and vectors.grid(1, 40) == (1, 12)


def test_purge(spark):
    rows = [("a", "completed", 1), ("b", "failed", 1), ("c", "completed", 9), ("d", "completed", None), ("e", None, 1), ("f", "queued", 1), ("g", None, None)]
    t = spark.createDataFrame(rows, "doc_id string, status string, completed_at int")
    left, gone = jobs.purge(t, F.lit(5))
    assert {r.doc_id for r in left.collect()} == set("cdefg") and gone.first().deleted == 2
    left, gone = jobs.purge(t.where("false"), F.lit(5))
    assert left.count() == 0 and gone.first().deleted == 0


def test_index_finds_what_the_exact_search_finds(spark, sf):
    """Recall of the candidate index against the exact edges, on the library and a variant of each chunk."""
    v = with_variants(registry.library(spark, sf)).cache()
    told = lambda df: {(r.src_doc_id, r.dst_doc_id): r.metadata for r in df.collect()}
    exact = told(enrich.similar_edges(v, enrich.Settings(exact=True)))
    found = told(catalog.queries()["E02_similar_edges_indexed"](spark, sf))
    assert len(exact) > 20 and found.items() <= exact.items() and len(found) >= 0.9 * len(exact)


def test_index_with_copies_and_crowded_buckets(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((30, 2, 16))
    rows = [(i, i % 50, (base[i % 30] + 0.15 * r.standard_normal((2, 16))).tolist()) for i in range(200)]
    rows += [(1000 + i, 60 + i, base[0].tolist()) for i in range(40)]  # copies
    corpus = spark.createDataFrame(rows, "chunk long, doc long, tokens array<array<double>>").repartition(4)
    queries = corpus.where("chunk % 10 = 0").select(F.col("chunk").alias("query_id"), "tokens")
    near = lambda rows: {(x.query_id, x["rank"]): (x.chunk, round(x.distance, 9)) for x in rows.where("distance < 0.3").collect()}
    want = near(vectors.search(corpus, queries, 5))
    for most in (3, 512):  # with nearly all buckets crowded, and with none
        got = near(vectors.search_near(corpus, queries, 5, 0.7, 0.98, most))
        assert sum(got.get(k) == x for k, x in want.items()) >= 0.95 * len(want) and len(want) > 80


def test_index_size():
    bits, tables = vectors.index_size(10**6, 0.7, 0.95)
    same = (1 - np.arccos(0.7) / np.pi) ** bits
    assert 1 - (1 - same) ** tables >= 0.95 > 1 - (1 - same) ** (tables - 1)


def plain_components(ids, pairs):
    ahead = defaultdict(set)
    for a, b in pairs:
        if a in ids and b in ids:
            ahead[a].add(b)

    def reach(v):
        seen, todo = set(), [v]
        while todo:
            for w in ahead[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        return seen

    far = {v: reach(v) for v in ids}
    return {v: max([v, *(w for w in far[v] if v in far[w])]) for v in ids}


def relations(spark, pairs):
    return spark.createDataFrame([(a, b, "r") for a, b in pairs], "src_doc_id string, dst_doc_id string, relation_type string")


def test_strong_components(spark):
    r = random.Random(2)
    ids = [f"{i:03}" for i in range(90)]
    ring = [(ids[i], ids[(i + 1) % 20]) for i in range(20)]
    tail = [(ids[i], ids[i + 1]) for i in range(19, 40)]
    ear = [(ids[3], ids[41]), (ids[41], ids[42]), (ids[42], ids[10])]
    core = [(r.choice(ids[45:53]), r.choice(ids[45:53])) for _ in range(14)]
    odd = [(ids[80], ids[80]), (ids[81], ids[82]), (ids[82], ids[81]), (ids[83], "elsewhere"), (ids[81], ids[82])]
    pairs = ring + tail + ear + core + odd
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id string")
    got = {x.doc_id: x.component for x in graph.strong_components(docs, relations(spark, pairs)).collect()}
    assert got == plain_components(set(ids), pairs)


def test_cycles(spark):
    docs = spark.createDataFrame([(i,) for i in "ABCDEF"], "doc_id string")
    has = lambda *pairs: graph.has_cycle(docs, relations(spark, pairs))
    assert not has(("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E"))
    assert has(("A", "A")) and has(("A", "B"), ("B", "A")) and has(("A", "B"), ("B", "C"), ("C", "A"), ("A", "D"))
    assert not has(("A", "X"), ("X", "A"))
    assert not graph.has_cycle(docs.where("false"), relations(spark, [("A", "A")]))


def test_stored_run(spark, sf, tmp_path):
    """A run's stored edges equal the steps alone; repeats change nothing, failures keep what was, scopes hold."""
    lib = registry.library(spark, sf)
    s = enrich.Settings(min_similarity=0.7)
    docs = lib.documents.where("num < 60").withColumn("metadata", F.lit('{"a":1}')).cache()
    held = graph.edge_set(lib.relations, docs).cache()
    chunks = lib.chunks.join(docs.select("doc_id"), "doc_id", "left_semi").cache()
    path = str(tmp_path / "kept")
    told = lambda df: {(r.src_doc_id, r.dst_doc_id, r.relation_type) for r in df.collect()}
    vectors_ = with_variants(lib).cache()
    report = enrich.stored_run(docs, held, chunks, vectors_, s, path)
    assert {r.step: r.error for r in report.collect()} == dict.fromkeys(("similar_to", "same_topic", "overlaps_topic", "node_properties"))
    first = told(enrich.stored_relations(spark, path, held))
    want = told(held) | told(enrich.similar_edges(vectors_, s)) | told(enrich.topic_edges(enrich.heading_sets(chunks), s))
    want |= told(enrich.community_edges(graph.label_propagation(docs, held), s))
    strings = {(str(a), str(b), t) for a, b, t in want}
    assert first == strings and {"similar_to", "same_topic"} <= {t for _, _, t in first}
    metadata = {r.doc_id: r.metadata for r in enrich.stored_metadata(spark, path).collect()}
    assert len(metadata) == 60 and all('"a":1' in m and '"graph"' in m for m in metadata.values())
    broken = vectors_.select("id", "doc", "word_count", F.raise_error(F.lit("no vectors")).cast("array<array<float>>").alias("tokens"))
    report = enrich.stored_run(docs, held, chunks.where("false"), broken, s, path, run=1)
    errors = {r.step: r.error for r in report.collect()}
    assert errors["similar_to"] and not errors["same_topic"]
    second = told(enrich.stored_relations(spark, path, held))
    assert {x for x in second if x[2] == "similar_to"} == {x for x in first if x[2] == "similar_to"}
    assert not {x for x in second if x[2] == "same_topic"}


def test_stored_run_of_a_project(spark, sf):
    edges = catalog.queries()["E07_stored_edges_of_a_project"](spark, sf).collect()
    own = {r.doc_id for r in registry.library(spark, sf).documents.where("project_id = 'src1'").collect()}
    assert edges and all({r.src_doc_id, r.dst_doc_id} <= own for r in edges)
