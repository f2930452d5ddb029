"""distances region by region against plain Python, for good, bad and missing layouts."""

import random
from collections import defaultdict

import pytest

from lectern.operators import graph, regions
from tests.test_reach_and_boxes import documents, plain_distances, relations


def summed(pairs, sources):
    found = defaultdict(list)
    for (_, v), d in plain_distances(pairs, sources).items():
        found[v].append(d)
    return {v: (len(d), min(d), max(d), sum(d)) for v, d in found.items()}


def told(rows):
    found = rows.collect()
    assert len({r.doc_id for r in found}) == len(found)
    return {r.doc_id: (r.sources, r.nearest, r.farthest, r.total) for r in found}


def by_regions(spark, pairs, sources, places, size):
    return told(regions.by_regions(*regions.laid_out(relations(spark, pairs), documents(spark, sources), spark.createDataFrame(places, "doc_id string, at long"), size), size))


@pytest.mark.parametrize("seed", range(3))
def test_any_layout_gives_the_same(spark, monkeypatch, seed):
    monkeypatch.setattr(regions, "STRIP", 4)
    monkeypatch.setattr(regions, "TALLY", 3)
    r = random.Random(seed)
    ids = [f"{i:03}" for i in range(150)]
    near = [(ids[i], ids[min(149, max(0, i + r.randint(-4, 5)))]) for i in range(150) for _ in range(2) if i % 50]
    pairs = near + [(r.choice(ids), r.choice(ids)) for _ in range(12 * seed)] + [("000", "000"), ("001", "outside"), ("002", None), (None, "003")]
    sources = r.sample(ids, 60) + [ids[5], ids[5], "unknown", None]
    places = [(i, n if seed < 2 else r.randint(0, 30)) for n, i in enumerate(ids[:140])] + [("no edges", 7)]
    got = by_regions(spark, pairs, sources, places, 10 + 7 * seed)
    assert got == summed([p for p in pairs if None not in p], [s for s in sources if s]) and len(got) > 100


def test_out_of_a_region_and_back(spark):
    """The short way between two documents of one region leads through another."""
    chain = [f"{i:02}" for i in range(12)]
    pairs = [*zip(chain, chain[1:]), ("00", "20"), ("20", "11"), ("11", "00")]
    got = by_regions(spark, pairs, ["00", "06"], [(i, int(i)) for i in chain] + [("20", 20)], 12)
    assert got == summed(pairs, ["00", "06"]) and got["11"][1] == 2


def test_long_ways_take_few_rounds(spark, monkeypatch):
    """600 hops over six regions: rounds go with the regions on the way, and not with the hops."""
    ids = [f"{i:03}" for i in range(600)]
    pairs, cuts, real = list(zip(ids, ids[1:])), [], regions.cut
    for module in (regions, graph):
        monkeypatch.setattr(module, "cut", lambda df: cuts.append(1) or real(df))
    got = told(regions.closeness(relations(spark, pairs), documents(spark, ids[::20]), spark.createDataFrame([(i, int(i)) for i in ids], "doc_id string, at long"), size=100))
    assert got == summed(pairs, ids[::20]) and got["599"][2] == 599 and len(cuts) < 20


def test_layouts_that_do_not_pay_go_by_hops(spark, monkeypatch):
    monkeypatch.setattr(regions, "by_regions", None)
    r = random.Random(5)
    ids = [f"{i:02}" for i in range(60)]
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(150)]
    got = told(regions.closeness(relations(spark, pairs), documents(spark, ids[:9]), documents(spark, ids), size=6))
    assert got == summed(pairs, ids[:9])


def test_without_sources_or_edges(spark):
    e, d = relations(spark, [("a", "b")]), documents(spark, ["a"])
    assert regions.closeness(e, d.where("false"), d).count() == 0
    assert regions.closeness(e.where("false"), d, d).count() == 0
    assert regions.closeness(e.where("false"), d.where("false"), d).count() == 0
