"""What the findings of round 4 asked for, one by one."""

import random

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import enrich, graph, vectors


def bits(df):
    """How long the number is by which Spark estimates the size of ``df``."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_estimates_stay_short_in_loops(spark):
    """the estimated size of a frame that is joined with itself each round does not become a number of millions of digits."""
    pairs = [(f"d{i}", f"d{i + 1}") for i in range(600)]
    step = spark.createDataFrame(pairs, "src string, dst string").repartition(4)
    edges, chain = graph.without_chains(step)
    assert [(r.src, r.dst) for r in edges.collect()] == [("d0", "d600")] and chain.count() == 599
    hung = graph.hung_from(step.selectExpr("dst as at", "src as far", "1L as hops"))
    assert {(r.at, r.far, r.hops) for r in hung.collect()} == {(f"d{i}", "d0", i) for i in range(1, 601)}
    named = spark.createDataFrame(pairs, "src_doc_id string, dst_doc_id string")
    groups = graph.connected_components(spark.createDataFrame([(f"d{i}",) for i in range(601)], "doc_id string"), named)
    assert {r.component for r in groups.collect()} == {"d0"}
    assert max(bits(edges), bits(chain), bits(hung), bits(groups)) < 400


def test_topics_are_counted_by_kinds(spark, monkeypatch):
    """the number of edges is that of all pairs, and links are not listed where classes share common headings only."""
    r = random.Random(5)
    docs = {f"d{i}": frozenset(r.sample("abc", r.randint(0, 3)) + r.sample([f"w{k}" for k in range(30)], r.randint(0, 4))) for i in range(160)}
    docs |= {f"e{i}": frozenset(["a", "b", f"own{i // 2}"]) for i in range(40)}
    headings = spark.createDataFrame([(d, h) for d, s in docs.items() for h in s], "doc_id string, heading string")
    classes = enrich.topic_classes(headings).repartition(3).checkpoint()
    listed = []
    plain = enrich._candidates
    monkeypatch.setattr(enrich, "_candidates", lambda *a: listed.append(plain(*a)) or listed[-1])
    for t in (0.2, 0.3, 0.5, 1.0):
        want = sum(len(a & b) >= t * len(a | b) for x, a in docs.items() for y, b in docs.items() if x != y and a & b)
        assert want > 0
        for crowd in (0, 1, 5, 1000):
            assert enrich.topic_number(classes, enrich.Settings(min_jaccard=t), crowd).first()[0] == want, (t, crowd)
    listed.clear()
    alike = spark.createDataFrame([(f"e{i}", h) for i in range(400) for h in ("a", "b", f"own{i}")], "doc_id string, heading string")
    assert enrich.topic_number(enrich.topic_classes(alike), enrich.Settings(), 300).first()[0] == 400 * 399
    assert sum(x.count() for x in listed) == 0


def test_no_topics(spark):
    """without headings there are no edges."""
    none = spark.createDataFrame([], "doc_id string, heading string")
    assert enrich.topic_number(enrich.topic_classes(none), enrich.Settings()).first()[0] == 0


def test_far_vectors_are_ruled_out_first(spark):
    """with a distance set, queries and documents that are not near at all are not compared in full, and the result is that of all pairs."""
    r = np.random.default_rng(6)
    for width in (2, 5, 64):
        sizes, own = r.integers(1, 6, 40), r.integers(1, 5, 15)
        unit = lambda n: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(r.standard_normal((n, width)))
        held, asked = unit(sizes.sum()), unit(own.sum())
        distance = vectors._distances(asked, own, held, sizes)
        for within in (0.05, 0.3, 0.9, *distance.ravel()[:20]):
            near = vectors._may_be_near(vectors._by_place(asked, own), own, vectors._by_place(held, sizes), within)
            assert not (~near & (distance <= within)).any() and not (near & (distance > within + 1e-4)).any()
    rows = [(i, i, [x.tolist()]) for i, x in enumerate(r.standard_normal((60, 64)))]
    c = spark.createDataFrame([*rows, (100, 100, rows[0][2])], "chunk long, doc long, tokens array<array<double>>")
    q = spark.createDataFrame([(a, t) for a, _, t in rows], "query_id long, tokens array<array<double>>")
    found = {(x.query_id, x.chunk, x["rank"]) for x in vectors.search(c, q, 5, within=0.2).collect()}
    assert found == {(i, i, 1) for i in range(60)} | {(0, 100, 2)}


def test_intake_by_folders(spark, tmp_path, monkeypatch):
    """no stream sees more than about FOLDER files, and each content is a job once over all folders; pages without or with negative ids count."""
    from hashlib import sha256
    from pathlib import Path

    from lectern.plans import catalog, stream_queries
    from lectern.sources.shared import shared_folder

    monkeypatch.setattr(stream_queries, "FOLDER", 30)
    rows = [(i - 5, f"page {i % 40}") for i in range(100)] + [(None, "no id"), (7, None), (8, "")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    folder = Path(shared_folder(spark).removeprefix("file://"))
    known = set(folder.glob("lectern-intake-*"))
    found = [r.doc_id for r in catalog.queries()["T01_file_intake"](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted({sha256(f"{h}\n".encode()).hexdigest() for _, h in rows if h is not None})
    (made,) = set(folder.glob("lectern-intake-*")) - known
    sizes = [len(list(d.glob("part-*.txt"))) for d in made.glob("in*")]
    assert len(sizes) == 4 and sum(sizes) == 102 and max(sizes) < 60


def test_a_class_moves_once_for_many_links(spark, monkeypatch):
    """the blocks of a large class meet the members of all classes linked to it together, with each link's own metadata."""
    import json

    sets = {f"h{i:03}": {"a", "b"} for i in range(50)} | {f"s{i:03}": {"a", "b", f"own{i}"} for i in range(200)} | {"t": {"a", "b", "c", "d"}}
    headings = spark.createDataFrame([(d, h) for d, s in sets.items() for h in s], "doc_id string, heading string")
    kept = []
    monkeypatch.setattr(enrich, "cut", lambda df: kept.append(df.checkpoint()) or kept[-1])
    found = enrich.topic_edges(headings, enrich.Settings())
    got = [(r.src_doc_id, r.dst_doc_id, tuple(json.loads(r.metadata)["shared_headings"]), json.loads(r.metadata)["jaccard"]) for r in found.collect()]
    want = {(x, y, tuple(sorted(a & b)), round(len(a & b) / len(a | b), 4)) for x, a in sets.items() for y, b in sets.items() if x != y and len(a & b) >= 0.5 * len(a | b)}
    assert len(got) == len(set(got)) and set(got) == want
    links = enrich.topic_links(enrich.topic_classes(headings), enrich.Settings()).unionByName(enrich.within_classes(enrich.topic_classes(headings)))
    members = headings.groupBy("doc_id").agg(F.concat_ws(",", F.sort_array(F.collect_set("heading"))).alias("k"))
    members = members.join(members.groupBy("k").agg(F.min("doc_id").alias("class_id")), "k").select("doc_id", "class_id", F.lit(True).alias("new"))
    moved = []
    plain = type(members).repartition
    monkeypatch.setattr(type(members), "repartition", lambda self, *a: moved.append(self.agg(F.sum(F.size("docs_a"))).first()[0] or 0) or plain(self, *a))
    assert enrich.expanded_topics(members, links).count() == len(want)
    assert sum(moved) < 1000  # the large class moves twice and not 200 times
