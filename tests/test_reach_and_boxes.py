"""Bitmap reachability, layers of general graphs, and boxes on a page against plain Python."""

import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from lectern.operators import graph, structure
from lectern.plans import catalog, registry


def relations(spark, pairs):
    return spark.createDataFrame([(a, b, "r") for a, b in pairs], "src_doc_id string, dst_doc_id string, relation_type string")


def documents(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "doc_id string")


def plain_distances(pairs, sources, most=10**9):
    ahead = defaultdict(set)
    for a, b in pairs:
        ahead[a].add(b)
    out = {}
    for s in set(sources):
        far, todo = {s: 0}, deque([s])
        while todo:
            v = todo.popleft()
            if far[v] < most:
                for w in ahead[v] - far.keys():
                    far[w] = far[v] + 1
                    todo.append(w)
        out |= {(s, v): d for v, d in far.items() if d}
    return out


def told(rows):
    found = [((r.source, r.doc_id), r.distance) for r in rows.collect()]
    assert len(found) == len(dict(found))
    return dict(found)


@pytest.mark.parametrize("most", [1, 3, 10**6])
def test_reached_over_several_blocks(spark, most):
    r = random.Random(most)
    ids = [f"{i:03}" for i in range(420)]
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(600)] + [(ids[i], ids[i + 1]) for i in range(60)] + [("000", "000"), ("001", "outside")]
    sources = ids[:300] + ["unknown", ids[0]]  # more than one block; one without edges, one twice
    got = told(graph.expanded(*graph.reached(relations(spark, pairs), documents(spark, [*sources, None]), most)))
    assert got == plain_distances(pairs, sources, most)


def test_reached_from_all_bits_of_a_block(spark):
    ids = [f"{i:03}" for i in range(256)]
    got = told(graph.expanded(*graph.reached(relations(spark, [(i, "hub") for i in ids] + [("hub", "end")]), documents(spark, ids))))
    assert got == {(i, "hub"): 1 for i in ids} | {(i, "end"): 2 for i in ids}


def test_reached_without_sources_or_edges(spark):
    e, d = relations(spark, [("a", "b")]), documents(spark, ["a"])
    assert graph.expanded(*graph.reached(e, d.where("false"))).count() == 0
    assert graph.expanded(*graph.reached(e.where("false"), d)).count() == 0


def test_distances_every_20th(spark, sf):
    lib = registry.library(spark, sf)
    pairs = [(r.src_doc_id, r.dst_doc_id) for r in lib.relations.collect()]
    want = defaultdict(list)
    for (_, v), d in plain_distances(pairs, [r.doc_id for r in lib.documents.where("num % 20 = 0").collect()]).items():
        want[v].append(d)
    got = {r.doc_id: (r.sources, r.nearest, r.farthest, r.total) for r in catalog.queries()["G06_distances_every_20th"](spark, sf).collect()}
    assert got == {v: (len(d), min(d), max(d), sum(d)) for v, d in want.items()} and len(got) > 5


def plain_layers(ids, pairs):
    into, ahead = Counter(), defaultdict(set)
    for a, b in {(a, b) for a, b in pairs if a in ids and b in ids}:
        into[b] += 1
        ahead[a].add(b)
    now, out = {i for i in ids if not into[i]}, {}
    while now:
        out |= dict.fromkeys(now, max(out.values(), default=-1) + 1)
        for v in now:
            into.subtract(ahead[v])
        now = {w for v in now for w in ahead[v] if not into[w]}
    return out


def check_layers(spark, ids, pairs):
    layers, rest = graph.topological_layers(documents(spark, ids), relations(spark, pairs))
    want = plain_layers(set(ids), pairs)
    found = {r.doc_id: r.layer for r in layers.collect()}
    assert found == want
    assert sorted(r.doc_id for r in rest.collect()) == sorted(set(ids) - want.keys())
    return want


@pytest.mark.parametrize("seed", range(3))
def test_layers_of_random_graphs(spark, seed):
    r = random.Random(seed)
    ids = [f"{i:02}" for i in range(60)]
    pairs = [tuple(sorted(r.sample(ids, 2))) for _ in range(30 + 25 * seed)] + [("00", "elsewhere")]
    check_layers(spark, ids, pairs)


def test_layers_with_cycles(spark):
    ids = [*"ABCDEFGHIJKLMNOP", ""]
    check_layers(spark, ids, [("A", "B"), ("B", "C"), ("C", "B"), ("C", "D"), ("D", "E"), ("A", "E"), ("F", "F"), ("F", "G"), ("G", "H"), ("I", "J"), ("J", "K"), ("K", "I"), ("K", "L"), ("A", "M"), ("M", "M"), ("", "N"), ("N", "O"), ("A", "O")])
    check_layers(spark, ["A"], [("A", "A")])
    check_layers(spark, ["A"], [])
    assert graph.topological_layers(documents(spark, ["A"]).where("false"), relations(spark, []))[0].count() == 0


def test_layers_of_long_chains_and_joins_take_few_rounds(spark, monkeypatch):
    """Chains of 150 that fork and join again: rounds go with the joins that follow each other, not with the length."""
    ids = [f"{i:04}" for i in range(900)]
    pairs = [(ids[i], ids[i + 1]) for i in range(149)] + [(ids[i], ids[i + 1]) for i in range(150, 299)] + [(ids[i], ids[i + 1]) for i in range(300, 449)]
    pairs += [(ids[149], ids[450]), (ids[299], ids[450]), (ids[60], ids[300]), (ids[449], ids[450])] + [(ids[i], ids[i + 1]) for i in range(450, 899)]
    calls = []
    hung = graph.hung_from
    monkeypatch.setattr(graph, "hung_from", lambda single: calls.append(1) or hung(single))
    assert max(check_layers(spark, ids, pairs).values()) > 600
    assert len(calls) <= 4


BOX = "page long, element long, x1 double, y1 double, x2 double, y2 double"


def plain_overlaps(boxes):
    out = {}
    for p, a, ax, ay, ax2, ay2 in boxes:
        for q, b, bx, by, bx2, by2 in boxes:
            w, h = min(ax2, bx2) - max(ax, bx), min(ay2, by2) - max(ay, by)
            if p == q and a < b and w > 0 and h > 0:
                out[p, a, b] = round(w * h, 6)
    return out


def some_boxes(r):
    """Pages of few, many, equal, huge, negative and touching boxes."""
    place = lambda most, size: (lambda x, y: (x, y, x + r.random() * size, y + r.random() * size))(r.random() * most - most / 3, r.random() * most)
    boxes = [(1, i, *place(100, 30)) for i in range(9)] + [(2, i, *place(1000, 40)) for i in range(300)] + [(3, i, 5.0, 5.0, 8.0, 9.0) for i in range(25)]
    boxes += [(4, i, *place(1000, 900 if i % 10 == 0 else 5)) for i in range(120)] + [(5, i, float(i % 8), float(i // 8), i % 8 + 1.0, i // 8 + 1.0) for i in range(64)]
    boxes += [(6, i, float(i), 3.0, i + 2.0, 3.0) for i in range(30)]  # without area
    return boxes


def test_overlaps_on_tiles(spark):
    boxes = some_boxes(random.Random(1))
    nan, inf = float("nan"), float("inf")
    odd = [(2, 900, None, 1.0, 2.0, 3.0), (2, 901, nan, 1.0, 500.0, 500.0), (2, 902, 0.0, 0.0, inf, inf), (2, 903, 9.0, 9.0, 1.0, 1.0), (None, 1, 0.0, 0.0, 9.0, 9.0), (None, 2, 0.0, 0.0, 9.0, 9.0)]
    found = structure.overlaps(spark.createDataFrame(boxes + odd, BOX).withColumn("w", F.lit(1)), ["page"]).collect()
    got = {(r.page, r.a_element, r.b_element): round(r.intersection, 6) for r in found}
    assert len(got) == len(found) and got == plain_overlaps(boxes) and len(got) > 400
    assert structure.overlaps(spark.createDataFrame([], BOX), ["page"]).count() == 0


def test_clicks_on_tiles(spark):
    r = random.Random(2)
    boxes = some_boxes(r)
    clicks = [(i, r.randint(1, 7), r.choice([r.random() * 1000, float(r.randint(0, 9))]), r.choice([r.random() * 300, float(r.randint(0, 9))])) for i in range(800)]
    clicks += [(900, 2, None, 1.0), (901, 6, 7.0, 3.0), (902, None, 1.0, 1.0)]
    found = structure.clicked(spark.createDataFrame(clicks, "click_id long, page long, x double, y double"), spark.createDataFrame(boxes, BOX), ["page"]).collect()
    want = {(i, p, e) for i, p, x, y in clicks for q, e, x1, y1, x2, y2 in boxes if p == q and x is not None and x1 <= x <= x2 and y1 <= y <= y2}
    assert {(c.click_id, c.page, c.element) for c in found} == want and len(found) == len(want) > 100


def test_a_page_of_very_many_boxes(spark):
    """100,489 boxes on one page, each over its next neighbours: pairs are counted by rule."""
    m = 317
    boxes = spark.range(m * m).select(F.lit(1).alias("page"), F.col("id").alias("element"), (F.col("id") % m).cast("double").alias("x1"), F.floor(F.col("id") / m).cast("double").alias("y1"))
    boxes = boxes.withColumn("x2", F.col("x1") + 1.5).withColumn("y2", F.col("y1") + 1.5)
    assert structure.overlaps(boxes, ["page"]).count() == 2 * m * (m - 1) + 2 * (m - 1) ** 2
