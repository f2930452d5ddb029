"""Graph reads and iterative algorithms over document relations (G).

Edges are DataFrames (src_doc_id, dst_doc_id, relation_type), vertices are documents. Iterative jobs cut their lineage
every round with reliable checkpoints in the folder named by spark.checkpoint.dir, or with tables where a round joins the
one before it with itself, and stop on a one-row aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.shared import cut, table


def edge_set(relations: DataFrame, documents: DataFrame, project_id: str | None = None) -> DataFrame:
    """Relations with both ends among the (scoped) documents; parallel edges stay (G-02)."""
    d = documents if project_id is None else documents.where(F.col("project_id") == project_id)
    ids = d.select("doc_id")
    return relations.join(ids.withColumnRenamed("doc_id", "src_doc_id"), "src_doc_id", "left_semi").join(ids.withColumnRenamed("doc_id", "dst_doc_id"), "dst_doc_id", "left_semi")


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """(doc_id, pagerank), summing to 1; dangling mass is spread evenly, parallel edges count (G-03)."""
    return pagerank_settled(vertices, edges, damping, max_iter, tol)[0]


def pagerank_settled(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6) -> tuple[DataFrame, bool]:
    """``pagerank`` and whether it settled before the rounds ran out.

    Dangling mass goes evenly to all, as the teleport does, so it only scales the ranks: the rounds leave it out and the
    result is scaled to sum to 1. Each round then reads the one before it once.
    """
    ids = cut(vertices.select("doc_id").distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("pagerank", F.lit(0.0)), True
    multiple = edges.groupBy(F.col("src_doc_id").alias("src"), F.col("dst_doc_id").alias("dst")).agg(F.count("*").alias("m"))
    out = multiple.groupBy("src").agg(F.sum("m").alias("d"))
    inner = ids.withColumnRenamed("doc_id", "dst")
    shares = cut(multiple.join(out, "src").join(inner, "dst", "left_semi").select("src", "dst", (F.col("m") / F.col("d")).alias("share")))
    nothing = ids.select("doc_id", F.lit(0.0).alias("got"))
    now, total = cut(ids.select("doc_id", F.lit(1.0 / n).alias("rank"))), 1.0
    settled = False
    for start in range(0, max_iter, 5):  # five rounds a job
        was, before = now, total
        for _ in range(min(5, max_iter - start)):
            given = now.join(shares, now["doc_id"] == shares["src"]).select(F.col("dst").alias("doc_id"), (F.col("rank") * F.col("share")).alias("got"))
            now = given.unionByName(nothing).groupBy("doc_id").agg((F.lit((1 - damping) / n) + damping * F.sum("got")).alias("rank"))
        now = cut(now)
        total = now.agg(F.sum("rank")).first()[0]
        moved = now.join(was.withColumnRenamed("rank", "was"), "doc_id").agg(F.sum(F.abs(F.col("rank") / total - F.col("was") / before))).first()[0]
        if moved < tol:
            settled = True
            break
    return now.select("doc_id", (F.col("rank") / total).alias("pagerank")), settled


def connected_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(doc_id, component): the smallest id of each undirected component, isolated vertices included (G-04)."""
    e = edges.where("src_doc_id <> dst_doc_id").select(F.greatest("src_doc_id", "dst_doc_id").alias("u"), F.least("src_doc_id", "dst_doc_id").alias("v")).distinct()
    now, mark = cut(e), None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = table(small.where("u <> v").distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return vertices.select("doc_id").distinct().join(now.select(F.col("u").alias("doc_id"), F.col("v").alias("component")), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))


class Layers:
    """Rows that grow layer by layer, held as checkpointed parts of doubling sizes: a row is rewritten log(layers) times."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, DataFrame]] = []

    def add(self, rows: DataFrame) -> None:
        level = 0
        while self.parts and self.parts[-1][0] == level:
            rows = cut(self.parts.pop()[1].unionByName(rows))
            level += 1
        self.parts.append((level, rows))

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [rows for _, rows in self.parts])


FEW = 500_000  # rows of ids that may be broadcast


class Labels:
    """(doc_id, community) of every document as a checkpointed table and the changes made since."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows, self.changes, self.n = rows, Layers(), 0

    def change(self, rows: DataFrame, n: int, at: int, most: int) -> None:
        """Takes over n changed rows of round ``at``; beyond ``most`` they go into the table."""
        self.changes.add(rows.select("doc_id", "community", F.lit(at).alias("at")))
        self.n += n
        if self.n > most:
            self.rows, self.changes, self.n = cut(self.among()), Layers(), 0

    def among(self, keys: DataFrame | None = None) -> DataFrame:
        """The labels of all documents, or of those in keys(doc_id)."""
        own = lambda rows: rows if keys is None else rows.join(keys, "doc_id", "left_semi")
        if not self.n:
            return own(self.rows)
        return own(self.rows).join(own(self.last()), "doc_id", "left").select("doc_id", F.coalesce("fresh", "community").alias("community"))

    def onto(self, edges: DataFrame) -> DataFrame:
        """(doc_id, community, m): edges(doc_id, other, m) with the label of the other end."""
        met = edges.join(self.rows.withColumnRenamed("doc_id", "other"), "other")
        if self.n:
            met = met.join(self.last().withColumnRenamed("doc_id", "other"), "other", "left").withColumn("community", F.coalesce("fresh", "community"))
        return met.select("doc_id", "community", "m")

    def last(self) -> DataFrame:
        return self.changes.all().groupBy("doc_id").agg(F.max_by("community", "at").alias("fresh"))


def label_propagation(vertices: DataFrame, edges: DataFrame, max_iter: int = 100) -> DataFrame:
    """(doc_id, community): synchronous majority labels; a vertex votes once for its own, ties go to the smallest label (G-05)."""
    return labels_settled(vertices, edges, max_iter)[0]


def labels_settled(vertices: DataFrame, edges: DataFrame, max_iter: int = 100) -> tuple[DataFrame, bool]:
    """``label_propagation`` and whether a round without change came before the rounds ran out.

    A vertex whose neighbourhood is as it was two rounds before votes as it did then, so a round counts votes only at
    vertices that changed against two rounds before and next to them; the labels of even and of odd rounds are two tables. Synchronous
    votes end in one state or swing between two; a state equal to that of two rounds before decides the rest.
    """
    ends = edges.where("src_doc_id <> dst_doc_id").select(F.col("src_doc_id").alias("doc_id"), F.col("dst_doc_id").alias("other"))
    near = cut(ends.unionByName(ends.select(F.col("other").alias("doc_id"), F.col("doc_id").alias("other"))).groupBy("doc_id", "other").agg(F.count("*").alias("m")))
    names = cut(vertices.select("doc_id").distinct())
    total = names.count()
    now, before = Labels(names.withColumn("community", F.col("doc_id"))), Labels(names.withColumn("community", F.lit(None).cast("string")))
    small = lambda rows, n: F.broadcast(rows) if n <= FEW else rows
    own, n_own, n_changed = None, 0, total  # the edges of the vertices that vote anew; none where all do
    for done in range(1, max_iter + 1):
        active = None if own is None else small(own.select("doc_id").distinct(), n_own)
        votes = now.onto(near if own is None else small(own, n_own)).unionByName(now.among(active).withColumn("m", F.lit(1).cast("long")))
        counted = votes.groupBy("doc_id", "community").agg(F.sum("m").alias("n"))
        best = counted.groupBy("doc_id").agg(F.min(F.struct(-F.col("n"), F.col("community"))).alias("b")).select("doc_id", F.col("b.community").alias("fresh"))
        swung = ~F.col("community").eqNullSafe(F.col("fresh"))
        voted = before.among(active).join(best, "doc_id")
        after = cut(voted if own is None else voted.where(swung))
        changed = after.where(swung).select("doc_id", F.col("fresh").alias("community"))
        n_changed = changed.count()
        if own is None:
            before = Labels(after.select("doc_id", F.col("fresh").alias("community")))
        elif n_changed:
            before.change(changed, n_changed, done, total // 8)
        now, before = before, now
        if not n_changed:
            break
        own = None
        if n_changed * 8 < total:  # what never changed has voted once; what did has neighbours
            ids = changed.select("doc_id")
            beside = near.join(small(ids, n_changed), "doc_id", "left_semi").select(F.col("other").alias("doc_id")).union(ids).distinct()
            own = cut(near.join(small(beside, 5 * n_changed), "doc_id", "left_semi"))
            n_own = own.count()
    told, was = now.among(), before.among()
    moved = told.join(was.withColumnRenamed("community", "was"), "doc_id").where(~F.col("community").eqNullSafe(F.col("was"))).limit(1).count() > 0
    swapped = moved and not n_changed and (max_iter - done) % 2
    return (was if swapped else told), not moved


def distances(edges: DataFrame, sources: DataFrame, max_depth: int = 1_000_000) -> DataFrame:
    """(source, doc_id, distance, parent, relation_type): fewest hops from each source along edges, the source itself left out (G-11, G-12).

    The parent is the smallest (parent, relation_type) that reaches a document first. ``reached`` tells distances alone,
    in less space.
    """
    step = cut(edges.select(F.col("src_doc_id").alias("at"), F.col("dst_doc_id").alias("next"), "relation_type").distinct())
    start = sources.select(F.col("doc_id").alias("source")).distinct()
    frontier = start.select("source", F.col("source").alias("doc_id"), F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("relation_type"))
    frontier = cut(frontier)
    seen = Layers()
    seen.add(frontier)
    depth = 0
    while depth < max_depth:
        depth += 1
        ahead = frontier.join(step, frontier["doc_id"] == step["at"]).select("source", F.col("next").alias("doc_id"), F.col("at").alias("parent"), step["relation_type"])
        first = ahead.groupBy("source", "doc_id").agg(F.min(F.struct("parent", "relation_type")).alias("p"))
        fresh = first.join(seen.all().select("source", "doc_id"), ["source", "doc_id"], "left_anti").select("source", "doc_id", F.lit(depth).alias("distance"), "p.parent", "p.relation_type")
        frontier = cut(fresh)
        if not frontier.limit(1).count():
            break
        seen.add(frontier)
    return seen.all().where("distance > 0")


WORDS = 4  # columns of 64 sources each in a row of bitmaps


def reached(edges: DataFrame, sources: DataFrame, max_depth: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(members (source, block, slot), hops (doc_id, block, distance, b0, b1, ...)): which sources first reach a document in how many hops (G-06, G-11, G-13).

    Sources are numbered and dealt into blocks of 256; a row holds the sources of a block as bits, so a hop moves and
    merges bitmaps and not a row for each source. The sources themselves have distance 0. Sources without edges count
    as sources, null ids as none; an empty table gives no row.
    """
    names = [f"b{w}" for w in range(WORDS)]
    step = cut(edges.select(F.col("src_doc_id").alias("at"), F.col("dst_doc_id").alias("next")).where("at <> next").distinct())
    numbers = numbered(sources.select(F.col("doc_id").alias("source")).where("source is not null").distinct(), ["source"])
    at = F.col("position") - 1
    members = cut(numbers.select("source", F.floor(at / (64 * WORDS)).alias("block"), (at % (64 * WORDS)).cast("int").alias("slot")))
    bit = lambda w: F.expr(f"case when slot div 64 = {w} then shiftleft(1L, slot % 64) else 0L end").alias(f"b{w}")
    frontier = cut(members.select(F.col("source").alias("doc_id"), "block", F.lit(0).alias("distance"), *[bit(w) for w in range(WORDS)]))
    seen = Layers()
    seen.add(frontier)
    none = F.lit(0).cast("long")
    for depth in range(1, max_depth + 1):
        ahead = frontier.join(step, frontier["doc_id"] == step["at"]).select(F.col("next").alias("doc_id"), "block", *names, *[none.alias(f"s{w}") for w in range(WORDS)])
        held = seen.all().select("doc_id", "block", *[none.alias(c) for c in names], *[F.col(f"b{w}").alias(f"s{w}") for w in range(WORDS)])
        merged = ahead.unionByName(held).groupBy("doc_id", "block").agg(*[F.bit_or(c).alias(c) for c in names + [f"s{w}" for w in range(WORDS)]])
        fresh = merged.select("doc_id", "block", F.lit(depth).alias("distance"), *[F.expr(f"b{w} & ~s{w}").alias(f"b{w}") for w in range(WORDS)])
        frontier = cut(fresh.where(" or ".join(f"{c} <> 0" for c in names)))
        if not frontier.limit(1).count():
            break
        seen.add(frontier)
    return members, seen.all()


def expanded(members: DataFrame, hops: DataFrame) -> DataFrame:
    """(source, doc_id, distance) of each bit of ``reached``, the sources themselves left out."""
    words = ", ".join(f"b{w}" for w in range(WORDS))
    slots = F.expr(f"explode(filter(sequence(0, {64 * WORDS - 1}), i -> getbit(array({words})[i div 64], i % 64) = 1))")
    return hops.where("distance > 0").select("doc_id", "block", "distance", slots.alias("slot")).join(members, ["block", "slot"]).select("source", "doc_id", "distance")


def closeness(hops: DataFrame) -> DataFrame:
    """(doc_id, sources, nearest, farthest, total) of the distances from other sources to each document, counted on bitmaps."""
    n = F.expr(" + ".join(f"bit_count(b{w})" for w in range(WORDS))).cast("long")
    return hops.where("distance > 0").groupBy("doc_id").agg(F.sum(n).alias("sources"), F.min("distance").alias("nearest"), F.max("distance").alias("farthest"), F.sum(n * F.col("distance")).alias("total"))


def paths(reached: DataFrame, targets: DataFrame, max_steps: int = 10) -> DataFrame:
    """(source, target, path): the steps 'from>to:type' back from each (source, target) along parents (G-12)."""
    tree = cut(reached.where(F.col("distance") <= max_steps))
    now = targets.join(tree.select("source", F.col("doc_id").alias("target"), "distance"), ["source", "target"]).select("source", "target", F.col("target").alias("at"), F.lit("").alias("path"))
    for _ in range(max_steps):
        up = now.join(tree.select("source", F.col("doc_id").alias("at"), "parent", "relation_type"), ["source", "at"], "left")
        link = F.concat("parent", F.lit(">"), "at", F.lit(":"), "relation_type")
        longer = F.when(F.col("path") == "", link).otherwise(F.concat(link, F.lit(" "), F.col("path")))
        now = cut(up.select("source", "target", F.coalesce("parent", "at").alias("at"), F.when(F.col("parent").isNotNull(), longer).otherwise(F.col("path")).alias("path")))
        if not now.where("at <> source").limit(1).count():
            break
    return now.select("source", "target", "path")


def forest_depths(vertices: DataFrame, parents: DataFrame) -> DataFrame:
    """(doc_id, root, layer) where each dst of parents(src, dst) has one src; both null on and behind cycles.

    The ancestor known of each vertex is twice as far off after every round, so a chain of n takes log2(n) rounds.
    """
    n = vertices.count()
    root = F.col("src").isNull()
    now = cut(vertices.join(parents.withColumnRenamed("dst", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("src", "doc_id").alias("far"), F.when(root, 0).otherwise(1).cast("long").alias("hops")))
    reach = 1
    while True:
        ahead = now.select(F.col("doc_id").alias("far"), F.col("far").alias("next"), F.col("hops").alias("more"))
        moved = table(now.join(ahead, "far"))
        if reach > n or not moved.where("more > 0").limit(1).count():
            settled = F.col("more") == 0
            return moved.select("doc_id", F.when(settled, F.col("far")).alias("root"), F.when(settled, F.col("hops").cast("int")).alias("layer"))
        now = moved.select("doc_id", F.col("next").alias("far"), (F.col("hops") + F.col("more")).alias("hops"))
        reach *= 2


def topological_order(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, layer, position) in dependency order; an error if the graph is cyclic (G-08)."""
    layers, rest = topological_layers(vertices, edges)
    if rest.limit(1).count():
        raise ValueError("the graph has a cycle")
    return numbered(layers, ["layer", "doc_id"])


def topological_layers(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, layer) of vertices in dependency order, vertices on or behind cycles) (G-08, G-09).

    A layer is the number of edges on the longest way from a document without prerequisites; all of those hang from one
    top. A vertex with a single edge in stands a known way behind that edge's start, so it hangs from the nearest vertex
    above with none or several, found by doubled pointers, and hands its edges out to it; of edges that then lie between
    the same two the longest stays. So a round takes off all chains and trees at once, in the log of their length, and
    at least one layer of anything else. What has no vertex with a single edge in is on or behind a cycle.
    """
    names = cut(vertices.select("doc_id").distinct())
    key = lambda c: F.concat(F.lit("v"), c)
    own = edge_set(edges, names).select(key(F.col("src_doc_id")).alias("src"), key(F.col("dst_doc_id")).alias("dst"), F.lit(1).cast("long").alias("w")).distinct()
    top = names.select(F.lit("").alias("src"), key(F.col("doc_id")).alias("dst"), F.lit(1).cast("long").alias("w")).join(own.select("dst"), "dst", "left_anti")
    step = cut(own.unionByName(top))
    hung = []
    while True:
        several = F.count("*").alias("n")
        single = step.groupBy("dst").agg(several, F.min("src").alias("far"), F.min("w").alias("hops")).where("n = 1")
        at = hung_from(single.select(F.col("dst").alias("at"), "far", "hops"))
        if at is None:
            break
        hung.append(at.where("not open"))
        kept = step.join(at.select(F.col("at").alias("dst")), "dst", "left_anti")
        moved = kept.join(at.withColumnRenamed("at", "src"), "src", "left")
        blocked = F.coalesce("open", F.lit(False))  # behind a ring: waits for itself for ever
        start = F.when(blocked, F.col("dst")).otherwise(F.coalesce("far", "src"))
        step = table(moved.select(start.alias("src"), "dst", (F.col("w") + F.coalesce("hops", F.lit(0))).alias("w")).groupBy("src", "dst").agg(F.max("w").alias("w")))
    known = vertices.sparkSession.createDataFrame([("", 0)], "far string, layer long")
    done = known
    for at in reversed(hung):
        placed = at.join(done, "far").select(F.col("at").alias("far"), (F.col("layer") + F.col("hops")).alias("layer"))
        done = table(done.unionByName(placed))
    layers = done.where("far <> ''").select(F.expr("substring(far, 2)").alias("doc_id"), (F.col("layer") - 1).cast("int").alias("layer"))
    return layers, names.join(layers, "doc_id", "left_anti")


def hung_from(single: DataFrame) -> DataFrame | None:
    """(at, far, hops, open) for single(at, far, hops): the nearest vertex above that is not itself in ``single``.

    ``open`` marks vertices on or behind a ring of such vertices, which have none. None where ``single`` is empty.
    """
    now, reach = cut(single.withColumn("open", F.lit(True))), 1
    n = now.count()
    if not n:
        return None
    while True:
        above = now.select(F.col("at").alias("far"), F.col("far").alias("next"), F.col("hops").alias("more"), F.col("open").alias("further"))
        moved = now.where("open").join(above, "far", "left")
        fresh = moved.select("at", F.coalesce("next", "far").alias("far"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.coalesce("further", F.lit(False)).alias("open"))
        now = table(now.where("not open").unionByName(fresh))
        reach *= 2
        if reach > 2 * n or not now.where("open").limit(1).count():
            return now


def has_cycle(vertices: DataFrame, edges: DataFrame) -> bool:
    """Whether an edge leads to its own start or two documents lie on a common cycle (G-09)."""
    ids = vertices.select("doc_id").distinct()
    step = table(edge_set(edges, ids).select(F.col("src_doc_id").alias("src"), F.col("dst_doc_id").alias("dst")).distinct())
    if step.where("src = dst").limit(1).count():
        return True
    between = step.groupBy(F.least("src", "dst"), F.greatest("src", "dst")).agg(F.count("*").alias("ways"))
    if between.where("ways > 1").limit(1).count():
        return True
    left = step.count()
    while left:  # no components are named: chains become edges, what has no edge in or out goes; a ring, or what never shrinks, is a cycle
        step, chain = without_chains(step)
        if chain is not None and chain.where("src is null or src = dst").limit(1).count():
            return True
        both = step.select("src").distinct().join(step.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        step = table(step.join(both, "src", "left_semi").join(both.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"))
        before, left = left, step.count()
        if chain is None and left == before:
            return left > 0
    return False


def strong_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(doc_id, component): strongly connected components, named by their largest id (G-07).

    The graph shrinks by rounds. Documents that point at each other merge, all that hang together at once by connected
    components. Chains of documents with one edge in and one out become an edge, found by doubled pointers; a chain belongs to the
    component of its two ends if they share one. Documents without an edge in or out go. All this takes rounds in the log
    of the longest chain. What none of it shrinks is split by colours: the largest id that reaches each document, in as
    many rounds as the longest way in what is left.
    """
    names = cut(vertices.select("doc_id").distinct())
    step = cut(edge_set(edges, names).where("src_doc_id <> dst_doc_id").select(F.col("src_doc_id").alias("src"), F.col("dst_doc_id").alias("dst")).distinct())
    label = names.withColumn("at", F.col("doc_id"))
    chains = []
    for _ in range(max_rounds):
        if not step.limit(1).count():
            break
        turned = step.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        mutual = cut(step.join(turned, ["src", "dst"], "left_semi").where("src < dst"))
        if mutual.limit(1).count():
            ends = mutual.select("src").union(mutual.select("dst")).distinct().withColumnRenamed("src", "doc_id")
            groups = cut(connected_components(ends, mutual.select(F.col("src").alias("src_doc_id"), F.col("dst").alias("dst_doc_id"))).select(F.col("doc_id").alias("at"), F.col("component").alias("root")))
            label, step = relabelled(label, groups), contracted(step, groups)
            continue
        before = step.count()
        step, chain = without_chains(step)
        if chain is not None:
            rings = chain.where("src is null").select("at", "root")
            label = relabelled(label, rings)
            chains.append(chain.where("src is not null").select("at", "src", "dst"))
        both = step.select("src").distinct().join(step.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        step = cut(step.join(both, "src", "left_semi").join(both.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"))
        if chain is None and step.count() == before:
            groups = coloured(step)
            label = relabelled(label, groups)
            gone = groups.select(F.col("at").alias("src"))
            step = cut(step.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti"))
    else:
        raise RuntimeError("strong components did not settle")
    for chain in reversed(chains):
        ends = chain.select("at", F.explode(F.array("src", "dst")).alias("doc_id")).join(label.withColumnRenamed("at", "root"), "doc_id")
        both = cut(ends.groupBy("at").agg(F.min("root").alias("root"), F.max("root").alias("other")))
        label = relabelled(label, both.where("root = other").select("at", "root"))
    top = label.groupBy("at").agg(F.max("doc_id").alias("component"))
    return label.join(top, "at").select("doc_id", "component")


def relabelled(label: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, at) with ``at`` replaced by groups(at, root) where it is there."""
    return table(label.join(groups, "at", "left").select("doc_id", F.coalesce("root", "at").alias("at")))


def contracted(step: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between the groups' roots, without loops and repeats."""
    one = step.join(groups.select(F.col("at").alias("src"), F.col("root").alias("r")), "src", "left").select(F.coalesce("r", "src").alias("src"), "dst")
    two = one.join(groups.select(F.col("at").alias("dst"), F.col("root").alias("r")), "dst", "left").select("src", F.coalesce("r", "dst").alias("dst"))
    return table(two.where("src <> dst").distinct())


def without_chains(step: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(edges in which each chain is one edge, chain (at, src, dst, root)): the ends outside of each vertex with one edge in and one out.

    A ring of such vertices has no ends; its vertices have the smallest as ``root`` instead. None where there is no chain.
    """
    into = step.groupBy(F.col("dst").alias("at")).agg(F.count("*").alias("n_in"), F.min("src").alias("src"))
    out = step.groupBy(F.col("src").alias("at")).agg(F.count("*").alias("n_out"), F.min("dst").alias("dst"))
    inner = table(into.join(out, "at").where("n_in = 1 and n_out = 1").select("at", "src", "dst"))
    n = inner.count()
    if not n:
        return step, None
    now, reach = inner.select("at", "src", "dst", F.col("at").alias("low")), 1
    while True:
        back = now.select(F.col("at").alias("src"), F.col("src").alias("src2"), F.col("low").alias("low2"))
        ahead = now.select(F.col("at").alias("dst"), F.col("dst").alias("dst2"))
        met = table(now.join(back, "src", "left").join(ahead, "dst", "left"))
        open_ended = met.where("src2 is not null or dst2 is not null").limit(1).count() > 0
        ring = F.col("src2").isNotNull() & F.col("dst2").isNotNull()
        if not open_ended or reach > n:
            chain = met.select("at", F.when(~ring, F.col("src")).alias("src"), F.when(~ring, F.col("dst")).alias("dst"), F.when(ring, F.least("low", "low2")).alias("root"))
            chain = cut(chain)
            break
        now = met.select("at", F.coalesce("src2", "src").alias("src"), F.coalesce("dst2", "dst").alias("dst"), F.least("low", "low2").alias("low"))
        reach *= 2
    own = inner.select("at")
    rest = step.join(own.withColumnRenamed("at", "src"), "src", "left_anti").join(own.withColumnRenamed("at", "dst"), "dst", "left_anti").select("src", "dst")
    return table(rest.unionByName(chain.where("src is not null and src <> dst").select("src", "dst")).distinct()), chain


def coloured(step: DataFrame) -> DataFrame:
    """(at, root): the strong components of the vertices that no larger id outside of their component reaches."""
    own = step
    colour = cut(step.select(F.col("src").alias("doc_id")).union(step.select("dst")).distinct().withColumn("c", F.col("doc_id")))
    while True:  # the largest id that reaches each vertex; what reaches that one does too
        got = own.join(colour.select(F.col("doc_id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("doc_id")).agg(F.max("c").alias("g"))
        far = colour.select(F.col("doc_id").alias("c"), F.col("c").alias("f"))
        fresh = table(colour.join(got, "doc_id", "left").join(far, "c").select("doc_id", "c", F.greatest("c", F.coalesce("g", "c"), "f").alias("n")))
        moved = fresh.where("c <> n").limit(1).count()
        colour = fresh.select("doc_id", F.col("n").alias("c"))
        if not moved:
            break
    held = edge = cut(colour.where("doc_id = c"))
    while True:  # what reaches its colour's root inside the colour
        back = own.join(edge.select(F.col("doc_id").alias("dst"), "c"), "dst").select(F.col("src").alias("doc_id"), "c").distinct().join(colour, ["doc_id", "c"], "left_semi")
        edge = cut(back.join(held, "doc_id", "left_anti"))
        if not edge.limit(1).count():
            return held.select(F.col("doc_id").alias("at"), F.col("c").alias("root"))
        held = cut(held.unionByName(edge))


def relations_of(relations: DataFrame, keys: DataFrame, direction: str = "both", relation_type: str | None = None) -> DataFrame:
    """Relations of each key document with its direction (G-10)."""
    r = relations if relation_type is None else relations.where(F.col("relation_type") == relation_type)
    k = keys.select("doc_id").distinct()
    out = r.join(k.withColumnRenamed("doc_id", "src_doc_id"), "src_doc_id", "left_semi").select(F.col("src_doc_id").alias("doc_id"), F.col("dst_doc_id").alias("other"), "relation_type", F.lit("outgoing").alias("direction"))
    inc = r.join(k.withColumnRenamed("doc_id", "dst_doc_id"), "dst_doc_id", "left_semi").select(F.col("dst_doc_id").alias("doc_id"), F.col("src_doc_id").alias("other"), "relation_type", F.lit("incoming").alias("direction"))
    return out if direction == "outgoing" else inc if direction == "incoming" else out.unionByName(inc)


def neighbourhood(relations: DataFrame, centres: DataFrame, depth: int, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes (source, doc_id, depth), induced edges) around each centre (G-13)."""
    r = relations if not types else relations.where(F.col("relation_type").isin(types))
    around = expanded(*reached(r, centres, depth)).select("source", "doc_id", F.col("distance").alias("depth"))
    nodes = around.unionByName(centres.select(F.col("doc_id").alias("source"), "doc_id", F.lit(0).alias("depth")).distinct())
    ends = nodes.select("source", "doc_id")
    edges = r.join(ends.withColumnRenamed("doc_id", "src_doc_id"), "src_doc_id").join(ends.withColumnRenamed("doc_id", "dst_doc_id"), ["source", "dst_doc_id"], "left_semi").select("source", "src_doc_id", "dst_doc_id", "relation_type").distinct()
    return nodes, edges


def hub_scores(relations: DataFrame) -> DataFrame:
    """(doc_id, hub_score): edges out plus edges in (G-14)."""
    ends = relations.select(F.explode(F.array("src_doc_id", "dst_doc_id")).alias("doc_id"))
    return ends.groupBy("doc_id").agg(F.count("*").alias("hub_score"))


def edge_counts(relations: DataFrame) -> DataFrame:
    """Edges by type with a total row (G-15, G-23)."""
    return relations.rollup("relation_type").agg(F.count("*").alias("n")).select(F.coalesce("relation_type", F.lit("total")).alias("relation_type"), "n")


def community_members(communities: DataFrame, documents: DataFrame) -> DataFrame:
    """(community, size, doc_id, filename): largest communities first, members by id; large ones stay flat (G-17, G-18)."""
    sizes = communities.groupBy("community").agg(F.count("*").alias("size"))
    named = communities.join(sizes, "community").join(documents.select("doc_id", "filename"), "doc_id", "left")
    return named.select("community", "size", "doc_id", "filename").orderBy(F.desc("size"), "community", "doc_id")


def top_ranked(ranks: DataFrame, documents: DataFrame, n: int) -> DataFrame:
    """The n documents of highest PageRank (G-19)."""
    return ranks.join(documents.select("doc_id", "filename"), "doc_id").orderBy(F.desc("pagerank"), "doc_id").limit(n)


def similar_documents(relations: DataFrame, score: Column, n: int) -> DataFrame:
    """Each document's n best neighbours over edges in either direction (G-20)."""
    scored = relations.withColumn("__score", score)
    ends = scored.select(F.col("src_doc_id").alias("doc_id"), F.col("dst_doc_id").alias("other"), "__score").unionByName(scored.select(F.col("dst_doc_id").alias("doc_id"), F.col("src_doc_id").alias("other"), "__score"))
    best = ends.where("doc_id <> other").groupBy("doc_id", "other").agg(F.max("__score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "other"))).where(F.col("rank") <= n)


def edge_list(relations: DataFrame, doc_id: str | None = None, relation_type: str | None = None, limit: int = 100) -> DataFrame:
    """Edges by document and type in a fixed order (G-21)."""
    if doc_id:
        relations = relations.where((F.col("src_doc_id") == doc_id) | (F.col("dst_doc_id") == doc_id))
    if relation_type:
        relations = relations.where(F.col("relation_type") == relation_type)
    return relations.orderBy("src_doc_id", "dst_doc_id", "relation_type").limit(limit)


def reading_order(vertices: DataFrame, edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(doc_id, method, position): topological where acyclic, else by falling PageRank (G-22).

    The order is that of the whole graph; ``members(doc_id)``, say one community, keeps its own and numbers them anew.
    """
    layers, rest = topological_layers(vertices, edges)
    if rest.limit(1).count():
        found = pagerank(vertices, edges).select("doc_id", F.lit("pagerank").alias("method"), (-F.col("pagerank")).alias("__key"))
    else:
        found = layers.select("doc_id", F.lit("topological").alias("method"), F.col("layer").cast("double").alias("__key"))
    if members is not None:
        found = found.join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    return numbered(found, ["__key", "doc_id"]).drop("__key")


def numbered(rows: DataFrame, by: list[str], out: str = "position", within: str | None = None) -> DataFrame:
    """1-based positions in a global order, or in the order within each value of a column (S-19, G-01, G-22).

    Rows are dealt into ranges; counts of the ranges give where each begins, so a frequent value spreads over tasks.
    """
    keys = [within] if within else []
    ranged = cut(rows.repartitionByRange(*keys, *by).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "__p").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = sizes.select(*keys, "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__p").orderBy(*by))
    return ranged.join(base, [*keys, "__p"]).withColumn(out, F.col("__base") + inside).drop("__p", "__base")
