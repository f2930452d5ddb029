"""What the findings of round 3 asked for: bounded search cells, sifted candidates, and the rest one by one."""

import random

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import enrich, graph, vectors
from tests.test_search_and_graph import plain_search, relations


def test_search_within_a_distance_by_strips(spark, monkeypatch):
    """A cell keeps only its k best that are near enough, and products are made strip by strip."""
    monkeypatch.setattr(vectors, "STRIP", 3)
    monkeypatch.setattr(vectors, "CELL", 3)
    r = random.Random(4)
    some = lambda n: [[float(np.float32(r.gauss(0, 1))) for _ in range(3)] for _ in range(n)]
    corpus, queries = [(i, i // 3, some(r.randint(0, 4))) for i in range(120)], [(i, some(r.randint(0, 5))) for i in range(30)]
    c = spark.createDataFrame(corpus, "chunk long, doc long, tokens array<array<double>>").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, tokens array<array<double>>")
    got = {(x.query_id, x["rank"]): (x.chunk, x.doc, round(x.distance, 9)) for x in vectors.search(c, q, 7, block=9, shard=5, within=0.2).collect()}
    want = {k: v for k, v in plain_search(corpus, queries, 7).items() if v[2] <= 0.2}
    assert got == want and 0 < len(want) < 7 * 28


def test_strips_cover_each_query_once(monkeypatch):
    monkeypatch.setattr(vectors, "STRIP", 4)
    for sizes in ([1] * 11, [9, 1, 1, 9], [2, 2, 2, 2, 1], [5]):
        strips = list(vectors._strips(np.array(sizes)))
        assert [i for a, b in strips for i in range(a, b)] == list(range(len(sizes)))
        assert all(b - a == 1 or sum(sizes[a:b]) <= 4 for a, b in strips)


def test_sketches_sift_a_bucket(spark):
    """of the pairs of a bucket hardly any but the near ones are moved."""
    r = np.random.default_rng(3)
    base = r.standard_normal((300, 64))
    near = 0.75 * base / np.linalg.norm(base, axis=1, keepdims=True) + (1 - 0.75**2) ** 0.5 * r.standard_normal((300, 64)) / 8
    told = lambda m: vectors.signatures(spark.createDataFrame([(i, [v.tolist()]) for i, v in enumerate(m)], "id long, tokens array<array<double>>"), "id", 1, 1)
    a, b = told(base), told(near).withColumnsRenamed({"name": "other", "s0": "t0", "s1": "t1"})
    differ = F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("t1")))
    kept = a.crossJoin(b).where(differ <= vectors.sketch_bits(0.7)).agg(F.count_if(F.expr("name = other")), F.count_if(F.expr("name <> other"))).first()
    assert kept[0] >= 0.99 * 300 and kept[1] < 0.03 * 300 * 299


def test_index_only_where_it_moves_little():
    assert not vectors.index_pays(10**6, 0.7, 0.95) and vectors.index_pays(10**9, 0.7, 0.95)


def test_topic_counts_and_expansion_by_blocks(spark):
    """Classes tell the number of edges; a large class is expanded block against block."""
    rows = [(f"d{i}", h) for i in range(90) for h in ("abcd" if i < 60 else "abc" if i < 80 else "xy")]
    headings = spark.createDataFrame(rows, "doc_id string, heading string")
    s = enrich.Settings()
    classes, links, members = enrich.topic_parts(headings, s)
    found = enrich.expanded_topics(members.withColumn("new", F.lit(True)), links.unionByName(enrich.within_classes(classes)), block=7)
    got = [(r.src_doc_id, r.dst_doc_id) for r in found.collect()]
    of = lambda i: i // 80
    want = {(f"d{a}", f"d{b}") for a in range(90) for b in range(90) if a != b and of(a) == of(b)}
    assert len(got) == len(set(got)) and set(got) == want
    assert enrich.topic_count(classes, links).first()[0] == len(want)
    assert {(r.src_doc_id, r.dst_doc_id) for r in enrich.topic_edges(headings, s).collect()} == want


def test_cycle_test_needs_no_components(spark, monkeypatch):
    """whether there is a cycle is told without labelling the components."""
    monkeypatch.setattr(graph, "strong_components", None)
    docs = spark.createDataFrame([(f"{i:02}",) for i in range(30)], "doc_id string")
    has = lambda pairs: graph.has_cycle(docs, relations(spark, [(f"{a:02}", f"{b:02}") for a, b in pairs]))
    chain = [(i, i + 1) for i in range(20)]
    woven = [(i, j) for i in range(8) for j in range(i + 1, 8)]
    assert not has(chain) and not has(chain + woven) and has([*chain, (20, 0)])
    assert has([*woven, (7, 9), (7, 10), (9, 11), (10, 11), (11, 12), (11, 13), (12, 7), (13, 7)])


def test_a_key_has_one_timer(spark):
    """a key's sessions are read and written once a batch, however many they are, and all that are over come out together."""
    import pandas as pd

    from lectern.streaming import streams

    class Handle:
        def __init__(self):
            self.timers, self.held, self.written = set(), [], 0

        def getListState(self, *_):  # noqa: N802
            return self

        def get(self):
            return iter(self.held)

        def exists(self):
            return bool(self.held)

        def put(self, rows):
            self.held, self.written = list(rows), self.written + 1

        def clear(self):
            self.held, self.written = [], self.written + 1

        def registerTimer(self, at):  # noqa: N802
            self.timers.add(at)

        def deleteTimer(self, at):  # noqa: N802
            self.timers.remove(at)

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

        getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815

    handle, keyed, hour = Handle(), streams.OpenSessions(), 3_600_000
    keyed.init(handle)
    rows = pd.DataFrame({"at": [i * hour * 1000 for i in range(50)], "role": "user", "source": None})
    assert list(keyed.handleInputRows(("k",), iter([rows]), Now(0))) == []
    assert handle.timers == {hour // 2 + 1} and len(handle.held) == 50
    handle.timers.clear()  # as the store does with a timer that goes off
    out = list(keyed.handleExpiredTimer(("k",), Now(40 * hour), Now(hour // 2 + 1)))
    assert [len(x) for x in out] == [40] and len(handle.held) == 10 and handle.written == 2
    assert handle.timers == {40 * hour + hour // 2 + 1}


def test_labels_are_voted_on_where_they_change(spark, monkeypatch):
    """Pairs that swing for ever are not counted again while labels still travel elsewhere; the result is that of all votes."""
    ids, r = [f"{i:04d}" for i in range(720)], random.Random(11)
    series, colours, last = ids[600:], [r.choice("aaabc") for _ in range(120)], {}
    pairs = [(ids[2 * k], ids[2 * k + 1]) for k in range(300)] + list(zip(series, series[1:])) + [("gone", ids[10])]
    for i, c in zip(series, colours):
        pairs += [(last[c], i), (i, last[c])] if c in last else []
        last[c] = i
    near = {i: [] for i in [*ids, "gone"]}
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    label, states = {i: i for i in ids}, []
    for _ in range(100):
        states.append(label)
        votes = {i: [label[j] for j in [i, *near[i]] if j in label] for i in ids}
        label = {i: min(set(v), key=lambda x: (-v.count(x), x)) for i, v in votes.items()}
    rows, real = [], graph.cut

    def cut(df):
        made = real(df)
        rows.append(made.count())
        return made

    monkeypatch.setattr(graph, "cut", cut)
    got, settled = graph.labels_settled(spark.createDataFrame([(i,) for i in ids], "doc_id string"), relations(spark, pairs))
    assert {r.doc_id: r.community for r in got.collect()} == label and settled == (label == states[-1])
    rounds = next(n for n in range(2, 100) if states[n] == states[n - 2])
    assert rounds > 15 and sum(rows) < rounds * len(ids)


def test_texts_become_python_objects_in_slices(spark, monkeypatch):
    """Pieces of bounded rows and bytes, in order and with nothing left out; results do not depend on them."""
    import re

    import pyarrow as pa

    from lectern.operators import citations

    for length, most in ((10, 256), (100_000, 45)):
        batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * length] * 1000)], ["key", "text"])
        parts = list(citations.slices(iter([batch, batch.slice(0, 0), batch.slice(7, 1)])))
        assert [i for p in parts for i in p["key"].to_pylist()] == [*range(1000), 7] and max(p.num_rows for p in parts) <= most
    monkeypatch.setattr(citations, "SLICE_ROWS", 3)
    rows = [(i, None if i % 7 == 0 else f"Á [{i}] b. c [[{i + 1}](u)]! " * (i % 4)) for i in range(50)]
    found = citations.located(spark.createDataFrame(rows, "answer_id long, text string").coalesce(1), "answer_id", citations.CITATION)
    want = [(k, i, m.group(0), m.start(), m.end()) for k, t in rows if t for i, m in enumerate(re.finditer(citations.CITATION, t))]
    assert sorted(tuple(r) for r in found.collect()) == want


def test_intake_files_are_written_by_all_cores(spark, sf):
    """the pages' files come from as many tasks as there are cores, not from one for each part of the table."""
    from pathlib import Path

    from lectern.plans import catalog
    from lectern.sources.shared import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file://"))
    known = set(folder.glob("lectern-intake-*"))
    found = catalog.queries()["T01_file_intake"](spark, sf)
    (made,) = set(folder.glob("lectern-intake-*")) - known
    names = [p.name for p in (made / "in").glob("part-*.txt")]
    assert len({n.split("-")[1] for n in names}) == spark.sparkContext.defaultParallelism
    assert len(names) == spark.read.parquet(f"{sf}/pages.parquet").where("html is not null").count() >= found.count()
