"""Hop distances over graphs of many hops, region by region (G-06).

Vertices are laid out in an order in which near ones tend to be linked and cut into regions of bounded size. A path from s
to v stays in its region, or leaves it, goes from entry to entry and comes into v's region by one of its entries. So a task
counts hops inside one region, a small weighted graph of the entries takes a round for each region on the way, and the
distances to each vertex are put together from those two. Any layout gives the same result; a good one has few entries.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import graph
from lectern.sources.shared import cut

SIZE = 8192  # vertices of a region
FAR = 2**29  # no path
STRIP, TALLY = 256, 16  # sources whose hops inside a region, or to all its vertices, are held at a time
INNER, ENTRY, EXIT, SOURCE = range(4)
FOUND = "at long, sources long, nearest int, farthest int, total long"


def pays(vertices: int, entries: int, sources: int, most_links: int, size: int = SIZE) -> bool:
    """Whether regions cost less than hops: few entries, whose pairs are few beside those asked for, and no region of very many edges."""
    return entries * 16 <= vertices and entries**2 * 16 <= vertices * sources and most_links <= 32 * size


def closeness(edges: DataFrame, sources: DataFrame, places: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, sources, nearest, farthest, total) of the distances from other sources to each document; ``places`` (doc_id, columns to order by) is the layout.

    Where the layout has too many entries, ``graph.reached`` goes hop by hop instead: such graphs have short ways.
    """
    vertices, rows = laid_out(edges, sources, places, size)
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    each = rows.groupBy("region").agg(count(ENTRY).alias("e"), count(SOURCE).alias("s"), count(INNER, EXIT).alias("l"))
    entries, asked, most_links = each.agg(F.coalesce(F.sum("e"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.max("l"), F.lit(0))).first()
    if not pays(vertices.count(), entries, asked, most_links, size):
        return graph.closeness(graph.reached(edges, sources)[1])
    return by_regions(vertices, rows, size)


def laid_out(edges: DataFrame, sources: DataFrame, places: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(vertices (doc_id, at), rows (region, kind, slot, other)): the edges inside each region, its entries, the edges out of it and its sources."""
    by = [c for c in places.columns if c != "doc_id"]
    ends = edges.select(F.col("src_doc_id").alias("doc_id")).union(edges.select("dst_doc_id")).union(sources.select("doc_id"))
    ids = ends.where("doc_id is not null").distinct().join(places.dropDuplicates(["doc_id"]), "doc_id", "left")
    vertices = cut(graph.numbered(ids, [*by, "doc_id"]).select("doc_id", (F.col("position") - 1).cast("long").alias("at")))
    place = lambda end, out: vertices.select(F.col("doc_id").alias(end), F.col("at").alias(out))
    step = edges.select("src_doc_id", "dst_doc_id").where("src_doc_id <> dst_doc_id").distinct()
    links = cut(step.join(place("src_doc_id", "a"), "src_doc_id").join(place("dst_doc_id", "b"), "dst_doc_id").select("a", "b"))
    out = links.where(f"a div {size} <> b div {size}")
    row = lambda df, kind, at, other: df.selectExpr(f"{at} div {size} as region", f"{kind} as kind", f"cast({at} % {size} as int) as slot", f"{other} as other")
    asked = vertices.join(sources.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = row(links.where(f"a div {size} = b div {size}"), INNER, "a", f"b % {size}").unionByName(row(out.select("b").distinct(), ENTRY, "b", "0L"))
    return vertices, cut(rows.unionByName(row(out, EXIT, "a", "b")).unionByName(row(asked, SOURCE, "at", "0L")))


def _inside(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(first, to): the edges inside a region, sorted by where they begin; those of slot i are to[first[i] : first[i + 1]]."""
    inner = rows[rows["kind"] == INNER].sort_values(["slot", "other"])
    n = 1 + max(int(rows["slot"].max()), int(inner["other"].max()) if len(inner) else 0)
    return np.searchsorted(inner["slot"].to_numpy(), np.arange(n + 1)), inner["other"].to_numpy()


def _hops(first: np.ndarray, to: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hops inside a region from each start (row) to each slot (column)."""
    n = len(first) - 1
    far = np.full(len(starts) * n, FAR, np.int32)
    front, hop = np.arange(len(starts)) * n + starts, 0
    far[front] = 0
    while len(front):
        hop += 1
        slot = front % n
        many = first[slot + 1] - first[slot]
        edge = np.repeat(first[slot] - np.cumsum(many) + many, many) + np.arange(many.sum())
        ahead = np.repeat(front - slot, many) + to[edge]
        front = np.unique(ahead[far[ahead] == FAR])
        far[front] = hop
    return far.reshape(len(starts), n)


def _strips(starts: np.ndarray) -> list[np.ndarray]:
    return [starts[i : i + STRIP] for i in range(0, len(starts), STRIP)]


def _of(rows: pd.DataFrame, kind: int) -> np.ndarray:
    return np.sort(rows.loc[rows["kind"] == kind, "slot"].to_numpy())


def by_regions(vertices: DataFrame, rows: DataFrame, size: int = SIZE) -> DataFrame:
    """``closeness`` of what ``laid_out`` gave."""
    regions, last = rows.agg(F.count_distinct("region"), F.count_distinct(F.when(F.col("kind") == SOURCE, F.col("region")))).first()
    bands, parts, tasks = math.ceil(max(regions, 1) / 64), math.ceil(max(last, 1) / 16), lambda n: max(4, min(4 * n, 2000))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def leave(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        """Hops from entries to the next regions' entries, and from all sources to them as one array each (start -1)."""
        first, to = _inside(some)
        out = some[some["kind"] == EXIT].sort_values("other")
        made = [pd.DataFrame({"region": [], "start": [], "next": [], "hops": [], "body": []})]
        if len(out):
            nexts, begin = np.unique(out["other"].to_numpy(), return_index=True)
            ahead = lambda starts: np.minimum(np.minimum.reduceat(_hops(first, to, starts)[:, out["slot"].to_numpy()], begin, axis=1) + 1, FAR)
            for starts in _strips(_of(some, ENTRY)):
                hops = ahead(starts)
                i, j = np.nonzero(hops < FAR)
                made.append(pd.DataFrame({"region": key[0], "start": key[0] * size + starts[i], "next": nexts[j], "hops": hops[i, j], "body": None}))
            if len(asked := _of(some, SOURCE)):
                hops = np.concatenate([ahead(starts) for starts in _strips(asked)])
                made.append(pd.DataFrame({"region": key[0], "start": -1, "next": nexts, "hops": 0, "body": [hops[:, j].tobytes() for j in range(len(nexts))]}))
        return pd.concat([x for x in made if len(x)] or made, ignore_index=True)

    left = cut(rows.repartition(tasks(regions), "region").groupBy("region").applyInPandas(leave, "region long, start long, next long, hops int, body binary"))
    bodies = left.where("start < 0").select("region", F.col("next").alias("entry"), "body")
    reach = between(left.where("start >= 0").select("start", "next", "hops"), bodies.select("entry").distinct())

    def onward(key: tuple, held: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        """Hops from all sources of a region to each entry that they reach."""
        body = {e: np.frombuffer(b, np.int32) for e, b in zip(held["entry"], held["body"])}
        made = [(at // size, at % size, key[0], np.minimum(np.min([body[e] + h for e, h in zip(x["entry"], x["hops"])], axis=0), FAR).astype(np.int32).tobytes()) for at, x in some.groupby("at")]
        return pd.DataFrame(made, columns=["region", "slot", "source", "body"])

    pairs = bodies.select("region", "entry").join(reach, "entry")
    met = pairs.select(F.col("region").alias("region"), F.col("entry").alias("entry"), "at", "hops", F.expr(f"cast(at div {size} % {bands} as int)").alias("band"))
    dealt = lambda df, n, *keys: df.repartition(tasks(n), *keys).groupBy(*keys)
    came = dealt(bodies.withColumn("band", every(bands)), last * bands, "region", "band").cogroup(dealt(met, last * bands, "region", "band")).applyInPandas(onward, "region long, slot int, source long, body binary")

    def arrive(key: tuple, some: pd.DataFrame, come: pd.DataFrame) -> pd.DataFrame:
        """What the sources of a part of the regions add to each vertex of a region."""
        own = _of(some, SOURCE) if key[0] % parts == key[1] else np.array([], int)
        if not len(come) and not len(own):
            return pd.DataFrame(columns=[c.split()[0] for c in FOUND.split(", ")])
        first, to = _inside(some)
        entries = np.unique(come["slot"].to_numpy(dtype=np.int64))
        ahead = np.concatenate([_hops(first, to, starts) for starts in _strips(entries)] or [np.empty((0, len(first) - 1), np.int32)])
        n, total = np.zeros((2, len(first) - 1), np.int64)
        near, far = np.full(len(n), FAR, np.int32), np.zeros(len(n), np.int32)
        from_all = {source: (x["slot"].to_numpy(), np.stack([np.frombuffer(b, np.int32) for b in x["body"]])) for source, x in come.groupby("source")}
        if len(own):
            from_all.setdefault(key[0], (entries[:0], np.empty((0, len(own)), np.int32)))
        for source, (slots, hops) in from_all.items():
            ways = ahead[np.searchsorted(entries, slots)]
            for i in range(0, hops.shape[1], STRIP):
                begun = _hops(first, to, own[i : i + STRIP]) if source == key[0] else None
                for j in range(i, min(i + STRIP, hops.shape[1]), TALLY):
                    part = hops[:, j : min(j + TALLY, i + STRIP)]
                    d = np.full((part.shape[1], len(n)), FAR, np.int32) if begun is None else begun[j - i : j - i + TALLY]
                    for h, way in zip(part, ways):
                        if h.min() < FAR:
                            np.minimum(d, h[:, None] + way, out=d)
                    known = (d > 0) & (d < FAR)
                    n += known.sum(axis=0)
                    np.minimum(near, np.where(known, d, FAR).min(axis=0), out=near)
                    d[~known] = 0
                    np.maximum(far, d.max(axis=0), out=far)
                    total += d.sum(axis=0, dtype=np.int64)
        slot = np.flatnonzero(n)
        return pd.DataFrame({"at": key[0] * size + slot, "sources": n[slot], "nearest": near[slot], "farthest": far[slot], "total": total[slot]})

    there = rows.where(f"kind in ({INNER}, {ENTRY}, {SOURCE})").withColumn("part", every(parts))
    came = came.withColumn("part", (F.col("source") % parts).cast("int"))
    told = dealt(there, regions * parts, "region", "part").cogroup(dealt(came, regions * parts, "region", "part")).applyInPandas(arrive, FOUND)
    summed = told.groupBy("at").agg(F.sum("sources").alias("sources"), F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"), F.sum("total").alias("total"))
    return summed.join(vertices, "at").select("doc_id", "sources", "nearest", "farthest", "total")


def between(hops: DataFrame, starts: DataFrame) -> DataFrame:
    """(entry, at, hops): fewest hops from each start (entry) over edges (start, next, hops), to itself 0."""
    best = starts.select("entry", F.col("entry").alias("at"), F.lit(0).alias("hops"), F.lit(True).alias("fresh"))
    known = lambda df, was: df.withColumn("was", was)
    while True:
        front = best.where("fresh").select("entry", F.col("at").alias("start"), F.col("hops").alias("before"))
        ahead = front.join(hops, "start").select("entry", F.col("next").alias("at"), (F.col("before") + F.col("hops")).alias("hops"))
        both = known(best.select("entry", "at", "hops"), F.col("hops")).unionByName(known(ahead, F.lit(None).cast("int")))
        least = both.groupBy("entry", "at").agg(F.min("hops").alias("hops"), F.min("was").alias("was"))
        best = cut(least.select("entry", "at", "hops", F.expr("was is null or hops < was").alias("fresh")))
        if not best.where("fresh").limit(1).count():
            return best.select("entry", "at", "hops")
