"""Sharding (1): best-fit-decreasing bin packing of indivisible groups.

``assign_shards`` places every row of a table. Rows of one group (equal texts) are never parted. Every group is an item:
groups of equal size are interchangeable, so only the histogram of sizes reaches the packing step, in classes of twelve
leading bits (sizes below 4,096 bytes exactly, larger ones rounded up by less than a part in 2,048), which is at most
2,048 classes for each doubling of the size. Classes from the largest down enter the bins with the least sufficient room,
found in a balanced tree of remaining capacities that holds runs of equally full bins as one entry; the smallest capacity
that opens no more bins than asked for is sought by bisection. Groups are numbered inside their class and look up the
run that their number falls in; the texts themselves are never shuffled.

Defined cases: a null text has no bytes and forms one group with other nulls, apart from empty texts; each row counts
one more byte than its text; repeated rows share a group; a group above the capacity has a shard of its own; an empty
table gives no row; other columns are ignored; a row with a null doc_id is placed like any other.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import bytes_of, cut, running_start


class CapacityTree:
    """Bins by (remaining capacity, bin) in an AVL tree; ``take`` finds the tightest bin with room."""

    def __init__(self) -> None:
        self.root: list | None = None  # node: [key, left, right, height]

    @staticmethod
    def _height(n: list | None) -> int:
        return n[3] if n else 0

    def _fixed(self, n: list) -> list:
        h = self._height
        n[3] = 1 + max(h(n[1]), h(n[2]))
        lean = h(n[1]) - h(n[2])
        if lean > 1:
            if h(n[1][1]) < h(n[1][2]):
                n[1] = self._turned(n[1], 2, 1)
            return self._turned(n, 1, 2)
        if lean < -1:
            if h(n[2][2]) < h(n[2][1]):
                n[2] = self._turned(n[2], 1, 2)
            return self._turned(n, 2, 1)
        return n

    def _turned(self, n: list, near: int, far: int) -> list:
        top = n[near]
        n[near], top[far] = top[far], n
        for x in (n, top):
            x[3] = 1 + max(self._height(x[1]), self._height(x[2]))
        return top

    def _put(self, n: list | None, key: tuple[int, int]) -> list:
        if n is None:
            return [key, None, None, 1]
        side = 1 if key < n[0] else 2
        n[side] = self._put(n[side], key)
        return self._fixed(n)

    def _cut(self, n: list, key: tuple[int, int]) -> list | None:
        if key != n[0]:
            side = 1 if key < n[0] else 2
            n[side] = self._cut(n[side], key)
        elif n[1] is None or n[2] is None:
            return n[1] or n[2]
        else:
            low = n[2]
            while low[1]:
                low = low[1]
            n[0] = low[0]
            n[2] = self._cut(n[2], low[0])
        return self._fixed(n)

    def add(self, room: int, bin_: int) -> None:
        self.root = self._put(self.root, (room, bin_))

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the (room, bin) with the least room of at least ``size``."""
        n, best = self.root, None
        while n:
            if n[0][0] >= size:
                best, n = n[0], n[1]
            else:
                n = n[2]
        if best:
            self.root = self._cut(self.root, best)
        return best


def fit_classes(counts: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit-decreasing of ``many`` items of each size, given as (size, many) from the largest size down.

    Returns (size, start, many, bin, each): items start to start + many - 1 of that size enter bin, bin + 1, ..., each
    bin taking ``each`` of them. Bins are numbered as they open; an item above ``capacity`` gets a bin of its own.
    """
    tree, opened, out = CapacityTree(), 0, []
    width: dict[int, int] = {}  # bins of the run that starts at this bin

    def keep(room: int, first: int, bins: int) -> None:
        if bins and room:
            width[first] = bins
            tree.add(room, first)

    for size, many in counts:
        start = 0
        while start < many:
            left = many - start
            found = tree.take(size)
            if found is None:
                room, first, bins = max(capacity, size), opened, -(-left // max(1, capacity // size))
                opened += bins
            else:
                room, first = found
                bins = width.pop(first)
            each = room // size
            full = min(bins, left // each)
            if full:
                out.append((size, start, full * each, first, each))
                keep(room - each * size, first, full)
                start += full * each
            if full < bins:
                rest = min(left - full * each, each)
                if rest:
                    out.append((size, start, rest, first + full, each))
                    keep(room - rest * size, first + full, 1)
                    start += rest
                keep(room, first + full + (rest > 0), bins - full - (rest > 0))
    return out


def _histogram(sizes: list[int]) -> list[tuple[int, int]]:
    return sorted(Counter(sizes).items(), reverse=True)


def _bins(sizes: list[int], placed: list[tuple[int, int, int, int, int]]) -> list[int]:
    """The bin of each item; items of one size are numbered in their order."""
    where = {(size, start + i): first + i // each for size, start, many, first, each in placed for i in range(many)}
    seen: Counter[int] = Counter()
    out = []
    for size in sizes:
        out.append(where[size, seen[size]])
        seen[size] += 1
    return out


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, bins numbered as they open; an item above ``capacity`` gets a bin of its own."""
    return _bins(sizes, fit_classes(_histogram(sizes), capacity))


def fewest_capacity_classes(counts: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """``fit_classes`` at the smallest capacity found that needs no more than ``shards`` bins."""
    if not counts:
        return []
    total = sum(size * many for size, many in counts)
    low, high = max(-(-total // shards), counts[0][0]), total
    best = fit_classes(counts, high)
    step = max(1, low // 10_000)
    while low < high:
        middle = (low + high) // 2
        tried = fit_classes(counts, middle)
        if max(first + (many - 1) // each for _, _, many, first, each in tried) < shards:
            best, high = tried, middle
        else:
            low = middle + 1
        if high - low < step:
            break
    return best


def fewest_capacity(sizes: list[int], shards: int) -> list[int]:
    """Bins 0 to shards - 1 by best-fit-decreasing at the smallest capacity found that needs no more than ``shards``."""
    return _bins(sizes, fewest_capacity_classes(_histogram(sizes), shards))


def assign_shards(docs: DataFrame, shards: int | None = 8, capacity: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, group_key, shard, slot) for every row.

    Give ``shards`` for the most even packing into so many, or ``capacity`` (bytes) for the fewest shards of that size.
    slot numbers the rows of a shard from 0 without gaps.
    """
    rows = cut(
        docs.select(
            "doc_id",
            (bytes_of("text") + 1).alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
            F.coalesce(F.md5("text"), F.lit("null")).alias("group_key"),
        )
    )
    unit = F.pow(F.lit(2), F.greatest(F.length(F.bin("bytes")) - 12, F.lit(0)))
    sized = rows.groupBy("group_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    groups = cut(sized.select("group_key", "rows", (F.ceil(F.col("bytes") / unit) * unit).cast("long").alias("class"), F.lit(1).alias("one")))
    found = groups.groupBy("class").agg(F.count("*").alias("many"), F.sum("rows").alias("rows")).sort(F.desc("class")).collect()
    counts = [(r["class"], r.many) for r in found]
    placed = fit_classes(counts, capacity) if capacity else fewest_capacity_classes(counts, shards)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("class", "start", "many", "bin", "each")])
    runs = docs.sparkSession.createDataFrame(placed, schema)
    nth = running_start(groups.select("group_key", "class", "one"), ["class"], ["group_key"], "one", "nth", sum(r.many for r in found))
    inside = (F.col("nth") >= F.col("start")) & (F.col("nth") < F.col("start") + F.col("many"))
    shard = (F.col("bin") + F.floor((F.col("nth") - F.col("start")) / F.col("each"))).cast("int")
    homes = nth.join(runs, "class").where(inside).select("group_key", shard.alias("shard"), "one")
    return running_start(cut(rows.join(homes, "group_key")), ["shard"], ["doc_id", "text_crc32"], "one", "slot", sum(r.rows for r in found)).drop("one")


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign_shards(docs, shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
