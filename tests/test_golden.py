"""Small cases with known results: boosts, blends, graphs, deletion, budgets, replies, sessions."""

import hashlib
import json
import re
import struct
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import context, enrich, graph, ingest, library, structure, vectors
from lectern.operators import citations as cite
from lectern.plans import catalog, registry  # noqa: F401  catalog registers the queries
from lectern.sources import shared
from lectern.sources.derived import following, padded
from lectern.sources.schemas import conform, schema_differences
from lectern.streaming import streams


def edges(spark, pairs, kind="references"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "src_doc_id string, dst_doc_id string, relation_type string")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "doc_id string")


def test_boost(spark):
    r = spark.createDataFrame([(1, "C", 0.9), (1, "A", 0.8), (1, "B", 0.7)], "query_id long, doc_id string, score double")
    got = {x.doc_id: round(x.boosted, 6) for x in vectors.graph_boost(r, edges(spark, [("A", "B")])).collect()}
    assert got == {"C": 0.9, "A": 0.85, "B": 0.75}
    top = spark.createDataFrame([(1, "A", 0.99), (1, "B", 0.99)], "query_id long, doc_id string, score double")
    assert all(x.boosted == 1.0 for x in vectors.graph_boost(top, edges(spark, [("A", "B")])).collect())


def test_blend(spark):
    r = spark.createDataFrame([(1, "A", 0.9), (1, "B", 0.85)], "query_id long, doc_id string, score double")
    pr = spark.createDataFrame([("A", 0.1), ("B", 0.9)], "doc_id string, pagerank double")
    got = {x.doc_id: round(x.blended, 3) for x in vectors.pagerank_blend(r, pr, 0.3).collect()}
    assert got == {"A": 0.663, "B": 0.895}


def test_maxsim_forms_agree(spark):
    q = [(1, [[1.0, 0.0], [0.0, 2.0]]), (2, [[0.0, 0.0]])]
    d = [(10, 1, [[3.0, 4.0]]), (11, 1, [[0.0, 5.0], [1.0, 0.0]]), (12, 2, [])]
    queries = spark.createDataFrame(q, "query_id long, tokens array<array<float>>")
    corpus = spark.createDataFrame(d, "chunk long, doc long, tokens array<array<float>>")
    fast = {(r.query_id, r.chunk): 1 - r.distance for r in vectors.search(corpus, queries, 5).collect()}
    pairs = queries.withColumnRenamed("tokens", "q").crossJoin(corpus.where("size(tokens) > 0"))
    slow = {(r.query_id, r.chunk): r.s for r in pairs.select("query_id", "chunk", vectors.maxsim("q", "tokens").alias("s")).collect()}
    assert fast.keys() == slow.keys() and all(abs(fast[k] - slow[k]) < 1e-6 for k in fast)
    assert fast[(1, 10)] == pytest.approx(0.7) and fast[(2, 10)] == 0


def test_pagerank(spark):
    tri = graph.pagerank(nodes(spark, "ABC"), edges(spark, [("A", "B"), ("B", "C"), ("C", "A")])).collect()
    assert len(tri) == 3 and sum(r.pagerank for r in tri) == pytest.approx(1, abs=1e-6)
    loose = {r.doc_id: r.pagerank for r in graph.pagerank(nodes(spark, "ABD"), edges(spark, [("A", "B")])).collect()}
    assert sum(loose.values()) == pytest.approx(1, abs=1e-5) and loose["B"] > loose["A"] == pytest.approx(loose["D"])


def test_components_and_labels(spark):
    pairs = edges(spark, [("A", "B"), ("B", "A"), ("C", "D"), ("D", "C")])
    got = {r.doc_id: r.component for r in graph.connected_components(nodes(spark, "ABCDE"), pairs).collect()}
    assert got == {"A": "A", "B": "A", "C": "C", "D": "C", "E": "E"}
    two = [(a, b) for g in ("ABE", "CDF") for a in g for b in g if a != b]
    lab = {r.doc_id: r.community for r in graph.label_propagation(nodes(spark, "ABCDEF"), edges(spark, two)).collect()}
    assert lab["A"] == lab["B"] == lab["E"] != lab["C"] == lab["D"] == lab["F"]


def test_enrichment_runs_until_it_settles(spark):
    n = [f"{i:02}" for i in range(26)]  # the smallest label walks one hop a round
    chain = edges(spark, list(zip(n, n[1:])))
    docs = nodes(spark, n)
    made = enrich.enrichment_steps(docs, chain, None, None, enrich.Settings())["node_properties"]()
    got = enrich.full_run(spark, {"node_properties": lambda: made}).collect()
    assert [(r.rows, r.error, r.settled) for r in got] == [(26, None, True)]
    assert {r.community_id for r in made[0].collect()} == {"00"}
    assert not graph.labels_settled(docs, chain, 3)[1] and not graph.pagerank_settled(docs, chain, max_iter=5)[1]


def test_paths_and_order(spark):
    chain = edges(spark, [("A", "B"), ("B", "C")])
    d = {r.doc_id: r.distance for r in graph.distances(chain, nodes(spark, ["A"])).collect()}
    assert d == {"B": 1, "C": 2}
    assert graph.distances(chain, nodes(spark, ["Z"])).count() == 0
    dag, tri = edges(spark, [("A", "B"), ("A", "C"), ("B", "C")]), edges(spark, [("A", "B"), ("B", "C"), ("C", "A")])
    layers = {r.doc_id: r.layer for r in graph.topological_layers(nodes(spark, "ABC"), dag)[0].collect()}
    assert layers["A"] < layers["B"] < layers["C"]
    assert not graph.has_cycle(nodes(spark, "ABC"), dag) and graph.has_cycle(nodes(spark, "ABC"), tri)
    assert graph.has_cycle(nodes(spark, "A"), edges(spark, [("A", "A")]))
    strong = {r.doc_id: r.component for r in graph.strong_components(nodes(spark, "ABCD"), edges(spark, [("A", "B"), ("B", "C"), ("C", "A"), ("C", "D")])).collect()}
    assert strong["A"] == strong["B"] == strong["C"] != strong["D"]


def test_layers_of_chains_and_trees(spark):
    rho = edges(spark, [("A", "B"), ("B", "C"), ("A", "D"), ("X", "Y"), ("Y", "X"), ("Y", "Z"), ("S", "S")])
    layers, rest = graph.topological_layers(nodes(spark, "ABCDEXYZS"), rho)
    assert {r.doc_id: r.layer for r in layers.collect()} == {"A": 0, "B": 1, "C": 2, "D": 1, "E": 0}
    assert {r.doc_id for r in rest.collect()} == {"X", "Y", "Z", "S"}
    n = [f"{i:02}" for i in range(40)]
    step = edges(spark, list(zip(n, n[1:]))).selectExpr("src_doc_id src", "dst_doc_id dst")
    assert {tuple(r) for r in graph.forest_depths(nodes(spark, n), step).collect()} == {(d, "00", i) for i, d in enumerate(n)}


def test_whole_series(spark, sf):
    chains = {}
    docs = registry.library(spark, sf).documents.select("doc_id", "num", "project_id").orderBy("num").collect()
    for r in docs:
        chains.setdefault(r.project_id or (r.doc_id,), []).append(r.doc_id)
    layer = {d: i for c in chains.values() for i, d in enumerate(c)}
    assert {r.doc_id: r.layer for r in registry.QUERIES["G08_topological_order_all"](spark, sf).collect()} == layer
    order = sorted(layer, key=lambda d: (layer[d], d))
    assert {r.doc_id: (r.method, r.position) for r in registry.QUERIES["G22_reading_order_all"](spark, sf).collect()} == {d: ("topological", i) for i, d in enumerate(order, 1)}
    far = {(c[0], d, i) for c in chains.values() for i, d in enumerate(c) if i}
    assert {tuple(r) for r in registry.QUERIES["G06_distances_all"](spark, sf).collect()} == far


def test_no_rows_left_out(spark, sf, tmp_path):
    texts = [(0, "x" * 1_048_577, "en"), (1, "Ünïcode straße a", "de"), (5, " ".join(["w"] * 200_100), "en")]
    spark.createDataFrame([(*t, "s", len(t[1])) for t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 2, "assistant", "no end"), (2, 2, "assistant", "One. Two.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.ok, r.message) for r in run("S20_upload_check")}["0"] == (False, "File too large: 1048577 bytes (max 1MB)")
    assert {(r.answer_id, r.idx, r.text) for r in run("K03_sentences")} >= {("1-2", 0, "no end")}
    pages = {r.id for r in run("I02_page_records") if r.doc_id == "5"}
    assert len(pages) == 1001 - (5 % 7 == 0) and {"5-page999", "5-page1000", "5-page1001"} <= pages
    numbers = spark.createDataFrame([(n,) for n in (7, 9999, 10000, 100001)], "n long").select(padded(F.col("n"), 4).alias("p"))
    assert [r.p for r in numbers.collect()] == ["0007", "9999", "10000", "100001"]
    parts = registry.library(spark, sf).chunks.select("id", "section_path").collect()
    slow = {r.id: re.sub("^-+|-+$", "", re.sub("[^a-z0-9_-]+", "-", r.section_path.lower()))[:128] or "project" for r in parts}
    assert any(not r.section_path.isascii() for r in parts)
    assert {r.id: r.slug for r in registry.QUERIES["I19_slug_all"](spark, sf).collect()} == slow


def test_cascade(spark):
    d = nodes(spark, ["d1", "d2", "d3"]).withColumn("project_id", F.lit("p"))
    c = spark.createDataFrame([(f"{x}-{i}", x) for x in ("d1", "d2", "d3") for i in range(3)], "id string, doc_id string")
    r = edges(spark, [("d1", "d2"), ("d2", "d3"), ("d1", "d3")])
    out = library.cascade_delete({"documents": d, "chunks": c, "doc_relations": r}, nodes(spark, ["d2"]))
    assert out["documents"].count() == 2 and out["chunks"].count() == 6
    assert [(x.src_doc_id, x.dst_doc_id) for x in out["doc_relations"].collect()] == [("d1", "d3")]
    again = library.cascade_delete(out, nodes(spark, ["d2"]))
    assert again["documents"].count() == 2
    with pytest.raises(ValueError):
        library.delete_project({"documents": d}, "default")


def test_relation_checks(spark):
    got = {(x.src_doc_id, x.dst_doc_id): x.reason for x in library.checked_relations(edges(spark, [("a", "b"), ("a", "x"), ("x", "b"), ("b", "a")]), nodes(spark, "ab"), edges(spark, [("b", "a")])).collect()}
    assert got == {("a", "b"): None, ("a", "x"): "target missing", ("x", "b"): "source missing", ("b", "a"): "edge exists"}


def test_topic_and_community_edges(spark):
    h = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "z"), ("c", "x")], "doc_id string, heading string")
    got = {(r.src_doc_id, r.dst_doc_id) for r in enrich.topic_edges(h, enrich.Settings()).collect()}
    assert got == {("a", "b"), ("b", "a")}
    c = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "2")], "doc_id string, community string")
    assert enrich.community_edges(c, enrich.Settings()).count() == 4


def test_topic_classes_against_all_pairs(spark):
    rnd = np.random.default_rng(3)
    sets = {f"d{i:03d}": {f"h{int(x)}" for x in rnd.zipf(1.4, rnd.integers(1, 8)) if x < 40} | ({"common"} if i % 3 else set()) for i in range(220)}
    sets |= {f"e{i}": sets[f"d{i:03d}"] for i in range(0, 60, 2)}
    sets = {d: h for d, h in sets.items() if h}
    table = spark.createDataFrame([(d, h) for d, hs in sets.items() for h in hs], "doc_id string, heading string")
    for t in (0.34, 0.5, 0.8, 1.0):
        s = enrich.Settings(min_jaccard=t)
        wanted = {(a, b) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}
        got = [(r.src_doc_id, r.dst_doc_id) for r in enrich.topic_edges(table, s).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted
        classes = enrich.topic_classes(table)
        links = enrich.topic_links(classes, s)
        assert all(sets[r.a] != sets[r.b] and r.shared == sorted(sets[r.a] & sets[r.b]) for r in links.collect())
        members = {r.doc_id: (r.class_id, r.links) for r in enrich.topic_members(table, classes, links).collect()}
        assert members == {d: (min(x for x in sets if sets[x] == sets[d]), sum(a == d for a, _ in wanted)) for d in sets}
    assert enrich.topic_edges(table.limit(0), enrich.Settings()).count() == 0


def test_nested_markers_and_many_of_them(spark):
    """Equal positions, places inside others and beyond the end; then more places than a copy of the text for each could bear."""
    def slow(t, items):
        for at, i, page, n in sorted(items, reverse=True):
            end = min(at + n, len(t))
            t = f'{t[:at]}<!-- chunk:{i} page:{page} section:"" -->\n<div data-chunk-id="{i}" data-page="{page}" data-section="">\n{t[at:end]}\n</div>\n{t[end:]}'
        return t

    rnd = np.random.default_rng(5)
    text = "".join(rnd.choice(list("ab é\U0001f600"), 400))
    cases = {f"d{k}": [(int(rnd.integers(0, 400)) // 7 * 7, f"c{i}", 1, int(rnd.integers(0, 500))) for i in range(k)] for k in (1, 2, 9, 60)}
    docs = spark.createDataFrame([(d, text) for d in cases] + [("none", text), ("null", None)], "doc_id string, markdown string")
    placed = spark.createDataFrame([(d, i, None, None, at, n) for d, xs in cases.items() for at, i, _, n in xs] + [("null", "c", 1, None, 0, 5), ("none", "c", 1, None, None, 5)], "doc_id string, id string, page_num long, section_path string, position long, length int")
    got = {r.doc_id: r.marked for r in cite.with_markers(placed, docs).collect()}
    assert got == {**{d: slow(text, xs) for d, xs in cases.items()}, "none": text, "null": None}
    long = spark.range(1).select(F.lit("x").alias("doc_id"), F.repeat(F.lit("word "), 2_000_000).alias("markdown"))
    many = spark.range(40_000).select(F.lit("x").alias("doc_id"), F.col("id").cast("string").alias("id"), F.lit(1).alias("page_num"), F.lit("s").alias("section_path"), (F.col("id") * 250).alias("position"), F.lit(300).alias("length"))
    assert cite.with_markers(many, long).select(F.regexp_count("marked", F.lit("</div>")).alias("n")).first().n == 40_000


def test_supplementary_and_clusters(spark):
    s = spark.createDataFrame([(1, "A", 1, 0.9, 1), (1, "B", 1, 0.5, 2), (1, "C", 1, 0.7, 3)], "query_id long, doc_id string, page_num long, score double, rank int")
    got = context.supplementary(s, edges(spark, [("A", x) for x in "WXYZ"])).collect()
    assert len(got) == 3 and all(r.score == pytest.approx(0.27) for r in got)
    order = [r.doc_id for r in context.clustered(s, edges(spark, [("A", "B")])).orderBy("position").collect()]
    assert order == ["A", "B", "C"]


def test_budget_is_a_prefix(spark):
    rows = [(1, i, "x" * n, "f.pdf", 1, False) for i, n in ((1, 400), (2, 4000), (3, 40))]
    s = spark.createDataFrame(rows, "query_id long, rank int, text string, filename string, page_num long, is_visual boolean")
    assert [r["rank"] for r in context.within_budget(s, 300).collect()] == [1]


def test_page_text(spark):
    md = "intro\n## Page 1\none\n## page 2\ntwo\n## Page 10\nten"
    df = spark.createDataFrame([(md, 1), (md, 2), (md, 10), ("short", 4), (None, 1)], "m string, p int")
    assert [r.t for r in df.select(context.page_text("m", "p").alias("t")).collect()] == ["one", "two\n## Page 10\nten", "ten", "short", ""]


def test_replies(spark):
    df = spark.createDataFrame([('{"score": 8}',), ('text {"a": 1} and {"score": 3, "x": 2}',), ("none",), ("",), ('{"score": 42}',)], "r string")
    assert [r.s for r in df.select(context.reply_score(F.col("r")).alias("s")).collect()] == [8.0, 3.0, 5.0, 5.0, 5.0]


def test_citations(spark):
    a = spark.createDataFrame([("x", "One [1]. Two [[2]](http://u) and [9][1]! End", 2), ("y", "no marks", 1)], "answer_id string, text string, num_sources int")
    got = [(r.id, r.marker, r.start, r.end) for r in cite.citations(a).orderBy("start").collect()]
    assert got == [(1, "[1]", 4, 7), (2, "[[2]](http://u)", 13, 28), (9, "[9]", 33, 36), (1, "[1]", 36, 39)]
    assert [r.ids for r in cite.clusters(a).collect()] == [[9, 1]]
    assert [r.id for r in cite.out_of_range(cite.citations(a), a).collect()] == [9]
    assert {r.answer_id: r.n for r in cite.sentences(a).groupBy("answer_id").agg(F.count("*").alias("n")).collect()} == {"x": 2, "y": 1}


def test_vectors_round_trip(spark):
    good = struct.pack("<II4f", 2, 2, 1, 2, 3, 4)
    df = spark.createDataFrame([(bytearray(good),), (bytearray(good[:-1]),), (None,)], "b binary")
    back = df.select(ingest.unpack_vectors(F.col("b")).alias("v")).select("v", ingest.pack_vectors(F.col("v")).alias("b")).collect()
    assert back[0].v == [[1, 2], [3, 4]] and bytes(back[0].b) == good and back[1].v is None and back[2].v is None


def test_conformance(spark):
    df = spark.createDataFrame([("d", 3)], "doc_id string, num_pages int")
    assert schema_differences(conform(df, "documents"), "documents") == {}
    assert schema_differences(df, "documents")["num_pages"] == "was int"


def test_queue_and_sessions(spark):
    t = spark.sql("SELECT 1 AS key, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,s) AS ts, 'assistant' AS role, 'd' AS source FROM VALUES (0), (1800), (3601) t(s)")
    assert sorted(r.turns for r in streams.sessions(t).collect()) == [1, 2]
    r = spark.sql("SELECT 'a' AS upload_id, 'a' AS key, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 'b', 'b', timestamp'2024-01-01 00:00:00'")
    u = spark.sql("SELECT 'a' AS key, timestamp'2024-01-01 00:09:00' AS ts UNION ALL SELECT 'b', timestamp'2024-01-01 00:11:00'")
    assert [x.upload_id for x in streams.abandoned(r, u).collect()] == ["b"]


def test_sessions_close_by_timers(spark, tmp_path):
    """A gap of just 1800 s joins, one microsecond more does not; a late bridge joins two; what has ended is not given out again and its state is gone."""
    said = "key string, ts timestamp, role string, source string"
    at = lambda *s: [f"2024-01-01 {x}" for x in s]

    def turns(key, *times):
        return [(key, t, "assistant", f"s{i}") for i, t in enumerate(at(*times))]

    batches = [
        turns("a", "00:00:00", "00:30:00", "01:00:00.000001") + turns("b", "00:29:00", "01:00:30") + [("a", None, "user", None)] + [(None, x, "user", None) for x in at("00:00:01")],
        turns("b", "00:55:00") + turns("z", "01:02:00"),
        turns("z", "03:00:00"),
        turns("a", "01:00:02") + turns("c", "03:10:00"),  # the first is later than the watermark
        turns("z", "09:00:00"),
    ]
    base, given, state = str(tmp_path / "out"), str(tmp_path / "in"), []
    spark.createDataFrame([], said).write.parquet(given)
    for rows in batches:
        spark.createDataFrame(rows, "key string, ts string, role string, source string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(given)
        stream = spark.readStream.schema(said).parquet(given)
        found = streams.drained(streams.closed_sessions(stream, "10 minutes"), base=base)
        state.append(found.count())
    got = sorted((str(r.key), str(r.started)[11:], str(r.ended)[11:], r.turns, r.answers, r.sources) for r in found.collect())
    assert got == sorted([
        ("None", "00:00:01", "00:30:01", 1, 0, []),
        ("a", "00:00:00", "01:00:00", 2, 2, ["s0", "s1"]),
        ("a", "01:00:00.000001", "01:30:00.000001", 1, 1, ["s2"]),
        ("b", "00:29:00", "01:30:30", 3, 3, ["s0", "s1"]),
        ("c", "03:10:00", "03:40:00", 1, 1, ["s0"]),
        ("z", "01:02:00", "01:32:00", 1, 1, ["s0"]),
        ("z", "03:00:00", "03:30:00", 1, 1, ["s0"]),
    ])
    assert state == sorted(state) and state[-1] == 7
    left = spark.read.format("statestore").option("stateVarName", "open").option("flattenCollectionTypes", "true").load(f"{base}/state")
    assert {r.key.id for r in left.select("key").collect()} == {'{"key":"z"}'}


def test_file_intake_stream(spark, tmp_path):
    for n, body in (("a.txt", b"x"), ("b.txt", b"x"), ("c.txt", b"y")):
        (tmp_path / n).write_bytes(body)
    assert streams.drained(streams.intake_jobs(streams.files(spark, str(tmp_path)))).count() == 2


def test_full_run_isolates_errors(spark):
    def broken():
        raise RuntimeError("no")

    got = {r.step: (r.rows, r.error) for r in enrich.full_run(spark, {"bad": broken, "good": lambda: nodes(spark, "ab")}).collect()}
    assert got == {"bad": (0, "no"), "good": (2, None)}


def rows_of(name, spark, sf):
    return registry.QUERIES[name](spark, sf).collect()


def test_pagerank_and_labels_against_plain_python(spark, sf):
    """G03, G05, G19, the ranked reading order, blend, communities and metadata on whole tables."""
    lib = registry.library(spark, sf)
    ids = sorted(r.doc_id for r in lib.documents.select("doc_id").collect())
    links = [(r.src_doc_id, r.dst_doc_id) for r in lib.relations.collect()]
    out, near = {i: [] for i in ids}, {i: [] for i in ids}
    for a, b in links:
        out[a].append(b)
        if a != b:
            near[a].append(b)
            near[b].append(a)
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(200):
        loose = sum(rank[i] for i in ids if not out[i])
        fresh = dict.fromkeys(ids, 0.15 / len(ids) + 0.85 * loose / len(ids))
        for a in ids:
            for b in out[a]:
                fresh[b] += 0.85 * rank[a] / len(out[a])
        rank = fresh
    got = {r.doc_id: r.pagerank for r in rows_of("G03_pagerank", spark, sf)}
    assert got.keys() == rank.keys() and all(abs(got[i] - rank[i]) < 1e-5 for i in ids)
    assert sum(got.values()) == pytest.approx(1, abs=1e-5)
    best = sorted(got.values(), reverse=True)[:10]
    assert [round(r.pagerank, 6) for r in rows_of("G19_top_ranked", spark, sf)] == pytest.approx([round(x, 6) for x in best], abs=2e-6)
    label = {i: i for i in ids}
    for _ in range(100):
        fresh = {}
        for i in ids:
            votes = {}
            for j in [i, *near[i]]:
                votes[label[j]] = votes.get(label[j], 0) + 1
            fresh[i] = min(votes, key=lambda v: (-votes[v], v))
        settled = fresh == label
        label = fresh
        if settled:
            break
    found = rows_of("G05_label_propagation", spark, sf)
    assert {r.doc_id: r.community for r in found} == label and {r.settled for r in found} == {settled}
    order = sorted(rows_of("G22_reading_order_ranked", spark, sf), key=lambda r: r.position)
    assert {r.method for r in order} == {"pagerank"} and [r.position for r in order] == list(range(1, len(ids) + 1))
    assert all(got[a.doc_id] >= got[b.doc_id] - 1e-8 for a, b in zip(order, order[1:]))
    sizes = {}
    for c in label.values():
        sizes[c] = sizes.get(c, 0) + 1
    want = {(a, b) for a in ids for b in ids if a != b and label[a] == label[b] and sizes[label[a]] <= 20}
    assert {tuple(r) for r in rows_of("E05_label_communities", spark, sf)} == want
    hubs = {i: sum((a == i) + (b == i) for a, b in links) for i in ids}
    for r in rows_of("E06_graph_metadata", spark, sf):
        m = json.loads(r.metadata)
        assert m["graph"]["community_id"] == label[r.doc_id] and m["graph"]["hub_score"] == hubs[r.doc_id] and "lang" in m
        assert abs(m["graph"]["pagerank_score"] - got[r.doc_id]) < 2e-6 and m["graph"]["enriched_at"].startswith("2024-03-01T00:00:00")
    blended = rows_of("V11_pagerank_blend_ranked", spark, sf)
    top = {}
    for r in blended:
        top[r.query_id] = max(top.get(r.query_id, 0), got.get(r.doc_id, 0))
    for r in blended:
        assert r.blended == pytest.approx(0.9 * r.score + 0.1 * got.get(r.doc_id, 0) / top[r.query_id] if top[r.query_id] else r.score, abs=2e-5)


def test_rerank_and_similar_edges_against_plain_python(spark, sf):
    """V16 and E02 on whole tables."""
    held = {r.chunk: (r.doc, [np.array(t, float) for t in r.tokens]) for r in registry.library(spark, sf).vectors.collect()}

    def sim(a, b):
        u = lambda x: x / np.linalg.norm(x)
        return float(np.mean([max(u(x) @ u(y) for y in b) for x in a]))

    def nearest(tokens, n, k):
        hits = sorted((round(1 - sim(tokens, t), 12), c) for c, (_, t) in held.items())[:n]
        best = {}
        for d, c in hits:
            best.setdefault(held[c][0], d)
        return [doc for doc, _ in sorted(best.items(), key=lambda x: (x[1], x[0]))[:k]]

    first, rep = {}, {}
    for c in sorted(held):
        first.setdefault(held[c][0], c)
        rep[held[c][0]] = max(rep.get(held[c][0], (-1, -1)), (c % 3, c))
    want = {}
    for q in [c for c in held if c % 20 == 0]:
        near = nearest(held[q][1], 50, 10)
        scored = sorted(((-round(sim(held[q][1], held[first[d]][1]), 9), d) for d in near))[:5]
        want |= {(q, d): (i, -s) for i, (s, d) in enumerate(scored, 1)}
    got = {(r.query_id, r.doc): (r["rank"], r.similarity) for r in rows_of("V16_rerank", spark, sf)}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in got)
    pairs = {}
    for d, (_, c) in rep.items():
        for o in nearest(held[c][1], 60, 6):
            s = sim(held[c][1], held[rep[o][1]][1])
            if o != d and s >= 0.15:
                pairs[tuple(sorted((d, o)))] = max(s, pairs.get(tuple(sorted((d, o))), 0))
    edges_ = {(r.src_doc_id, r.dst_doc_id): json.loads(r.metadata) for r in rows_of("E02_similar_edges", spark, sf)}
    assert edges_.keys() == {x for a, b in pairs for x in ((a, b), (b, a))} and pairs
    assert all(abs(m["score"] - pairs[tuple(sorted(k))]) < 1e-4 and m["method"] == "maxsim_reranked" for k, m in edges_.items())


def test_clusters_and_safe_names_against_plain_python(spark, sf):
    """C09 and F29 on whole tables."""
    sources = rows_of("C01_ranked_sources", spark, sf)
    links = [(r.src_doc_id, r.dst_doc_id) for r in registry.library(spark, sf).relations.collect()]
    got = rows_of("C09_clusters", spark, sf)
    assert len(got) == len(sources)
    for q in {r.query_id for r in sources}:
        docs = {r.doc_id for r in sources if r.query_id == q}
        label = {d: d for d in docs}
        for _ in docs:
            for a, b in links:
                if a in docs and b in docs:
                    label[a] = label[b] = min(label[a], label[b])
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(1, len(own) + 1))
        for a in own:
            for b in own:
                assert (a.cluster == b.cluster) == (label[a.doc_id] == label[b.doc_id])
        assert len([1 for a, b in zip(own, own[1:]) if a.cluster != b.cluster]) == len({r.cluster for r in own}) - 1
    paths = {r.id: r.section_path for r in registry.library(spark, sf).chunks.select("id", "section_path").collect()}
    for r in rows_of("F29_header_safe", spark, sf):
        plain = "".join(c for c in unicodedata.normalize("NFKD", paths[r.id]) if ord(c) < 128)
        assert r.safe == " ".join(plain.split())


def test_markers_of_all_chunks_against_plain_python(spark, sf):
    lib = registry.library(spark, sf)
    texts = {r.doc_id: re.sub("[ \\t\\r\\n]+", " ", r.markdown or "").strip(" ") for r in lib.documents.select("doc_id", "markdown").collect()}
    places = {}
    for c in lib.chunks.collect():
        places.setdefault(c.doc_id, []).append((texts[c.doc_id].find(c.text[:100].strip()), c.id, c.page_num, c.section_path or "", len(c.text)))
    marked = {}
    for doc, t in texts.items():
        for at, i, page, section, n in sorted(places.get(doc, ()), reverse=True):
            end, s = min(at + n, len(t)), section.replace('"', "&quot;")
            t = f'{t[:at]}<!-- chunk:{i} page:{page} section:"{s}" -->\n<div data-chunk-id="{i}" data-page="{page}" data-section="{s}">\n{t[at:end]}\n</div>\n{t[end:]}'
        marked[doc] = t
    got = {r.doc_id: r.marked_md5 for r in rows_of("M02_markers_of_all_chunks", spark, sf)}
    assert got == {d: hashlib.md5(t.encode()).hexdigest() for d, t in marked.items()}
    for r in rows_of("M03_audit_of_all_chunks", spark, sf):
        marks, opens = re.findall(cite.MARKER, marked[r.doc_id]), re.findall(cite.OPEN_DIV, marked[r.doc_id])
        wrong, closes = sum(a != b for a, b in zip(marks, opens)), marked[r.doc_id].count("</div>")
        assert (r.markers, r.opens, r.closes, r.mismatched, r.valid) == (len(marks), len(opens), closes, wrong, len(marks) == len(opens) == closes and not wrong)


def test_patches(spark):
    t = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("c", "z", 3)], "doc_id string, filename string, num_pages int")
    p = spark.createDataFrame([("a", "x1", None, 1), ("a", "x2", None, 2), ("b", None, ["filename"], 1), ("q", "no", None, 1)], "doc_id string, filename string, cleared array<string>, at int")
    got = {tuple(r) for r in library.patched(t, p, ["doc_id"], ["filename"], F.col("at")).collect()}
    assert got == {("a", "x2", 1), ("b", None, 2), ("c", "z", 3)}


def test_sentence_list_keeps_the_end(spark):
    texts = ["Dr. Smith came. He left. And more", "He saw Dr.", "a. b", "", "no end", "x! Mr. y? z "]
    want = [["Smith came.", "He left.", "And more"], ["He saw Dr."], ["a.", "b"], [], ["no end"], ["x!", "y?", "z"]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(cite.sentence_list(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == want


def test_cycle_is_an_error(spark):
    with pytest.raises(ValueError):
        graph.topological_order(nodes(spark, "AB"), edges(spark, [("A", "B"), ("B", "A")]))


def test_no_display_box_for_bad_dimensions(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0, 2.0, 0, 10), (1.0, 1.0, 2.0, 2.0, 10, 10)], "x1 double, y1 double, x2 double, y2 double, w int, h int")
    bad, good = structure.scaled(df, F.col("w"), F.col("h"), F.lit(20), F.lit(20)).collect()
    assert bad.problem == "invalid original dimensions: 0x10" and bad.sx1 is None and bad.shown_w is None
    assert good.problem is None and (good.sx1, good.shown_w) == (2.0, 2.0)


def test_following_across_buckets(spark):
    df = spark.createDataFrame([(n, "ab"[n % 3 == 0], None if n % 5 else "l") for n in range(0, 60, 2)], "num long, g string, l string").withColumn("doc_id", F.col("num").cast("string"))
    for group in (["g"], ["g", "l"]):
        rows = sorted(df.collect(), key=lambda r: r.num)
        want = {r.doc_id: next((x.doc_id for x in rows if x.num > r.num and all(x[c] == r[c] for c in group)), None) for r in rows}
        assert {r.doc_id: r.o for r in following(df, group, "num", "doc_id", per_bucket=7).collect()} == want


def test_shared_folder_is_asked_for(monkeypatch):
    class Bare:
        conf = sparkContext = None
        master = "spark://host:7077"

        def get(self, *_):
            return None

        getCheckpointDir = get

    bare = Bare()
    bare.conf = bare.sparkContext = bare
    with pytest.raises(ValueError):
        shared.shared_folder(bare)
