"""Suffix-array dedup (4): exact removal of repeated byte strings by a hash-compared suffix sort.

Every byte covered by a ``length``-byte string that also starts earlier goes. Strings ("windows") are gathered by an
anchor: of the ``gram``-byte grams inside a window the one of least hash, leftmost of equals. Equal windows have equal
grams at equal places, so they meet under the anchor's hash; an anchor with its run of windows is one row per ~35 bytes.

1. Rows with the same anchor, place and context hash form a class; all but its first are repeats whole. Inside a batch of
   half a megabyte they are found before the shuffle and verified on the bytes, and only a class's first goes to its
   anchor's task, so a hot anchor sends one row of a class a batch. Across batches two 64-bit hashes, of the gram and of
   the context, must agree.
2. The firsts of different classes under one anchor share only part of their windows. Their contexts are sorted as
   suffixes, forward from the anchor and backward from it: a mergesort network whose comparisons find the common
   extension by binary search over prefix polynomial hashes. Neighbours' extensions are verified on the bytes (a group
   with a collision is sorted again by its bytes) and cut the two orders into runs; a window repeats if an earlier
   context lies in the same forward and backward run.
3. An anchor under more than ``most`` distinct contexts is resolved window by window: windows are grouped by two hashes
   and the earliest found by partial aggregation, so no task gathers the group.

Earlier means a smaller doc_id, or the same document and an earlier start; strings are judged on the input.

Defined cases: null and empty texts have no byte; rows without a doc_id come first; rows that repeat a doc_id are ordered
by their text, and of repeated rows the later lose what the first holds; an empty table gives no row; other columns are
ignored; long texts are read in overlapping tiles, so every window is seen once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import runs, written

GRAM = 32
TILE = 1 << 19
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i below at least n."""
    size = 1 << max(16, n.bit_length())
    if size not in _powers:
        _powers[size] = tuple(np.multiply.accumulate(np.array([1, *[b] * (size - 1)], dtype=np.uint64)) for b in (BASE, pow(BASE, -1, 1 << 64)))
    return _powers[size]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed polynomial hash of data[i : i + gram] for each i."""
    up, back = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    h = (total[gram:] - total[:-gram]) * back[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(gram hash, anchor, first window, number of windows) of each run of windows that share an anchor.

    Windows lie inside one of the segments [starts, ends) of ``data``.
    """
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < length:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    h = gram_hashes(raw, GRAM)
    low = (h & ~np.uint64((1 << 21) - 1)) | np.arange(len(h), dtype=np.uint64)
    span, wide = 1, length - GRAM + 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if wide > span:
        low = np.minimum(low[: span - wide], low[wide - span :])
    own = np.zeros(len(raw) + 1, np.int8)
    fits = ends - starts >= length
    np.add.at(own, starts[fits], 1)
    np.add.at(own, (ends - length + 1)[fits], -1)
    at = np.flatnonzero(np.cumsum(own[: len(low)]))
    anchor = (low[at] & np.uint64((1 << 21) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(at) else np.empty(0, np.int64)
    count = np.diff(np.concatenate([first, [len(at)]]))
    return h[anchor[first]].view(np.int64), anchor[first], at[first], count


def anchor_rows(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """(anchor, context, doc, place, again): place packs the first window's start, the anchor's distance and the run's length.

    again marks repeats, compared byte by byte, of a context earlier in the same batch; their anchor only spreads them.
    """

    def of(group: list[tuple[int, int, bytes]]) -> pd.DataFrame:
        data = b"".join(g[2] for g in group)
        ends = np.cumsum([len(g[2]) for g in group])
        starts = ends - [len(g[2]) for g in group]
        key, anchor, first, count = anchors(data, starts, ends, length)
        segment = np.searchsorted(ends, first, "right")
        docs, bases = (np.array([g[i] for g in group], np.int64) for i in (0, 1))
        digest = xxhash.xxh3_64_intdigest
        context = np.fromiter((digest(data[s : s + n]) for s, n in zip(first.tolist(), (count + length - 1).tolist())), np.uint64, len(first)).view(np.int64)
        place = (first - starts[segment] + bases[segment] << 16) | (anchor - first << 8) | count
        doc = docs[segment]
        order = np.lexsort((place, doc, place & 0xFFFF, context, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order[1:]] != key[order[:-1]]) | (context[order[1:]] != context[order[:-1]]) | ((place[order[1:]] ^ place[order[:-1]]) & 0xFFFF != 0)
        rest = np.flatnonzero(~new)
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))[rest]]
        late = order[rest]
        again = np.zeros(len(order), bool)
        again[late] = [data[s : s + n] == data[f : f + n] for s, f, n in zip(first[late].tolist(), first[head].tolist(), (count[late] + length - 1).tolist())]
        spread = (doc << 20) + (place >> 16)
        return pd.DataFrame({"anchor": np.where(again, spread, key), "context": context, "doc": doc, "place": place, "again": again})

    for frame in frames:
        group, held = [], 0
        for doc, text in zip(frame["doc"].tolist(), frame["text"]):
            body = (text or "").encode("utf-8", "surrogatepass")
            for base in range(0, max(0, len(body) - length + 1), TILE):
                group.append((doc, base, body[base : base + TILE + length - 1]))
                held += len(group[-1][2])
                if held >= TILE:
                    yield of(group)
                    group, held = [], 0
        if group:
            yield of(group)


class Suffixes:
    """Fixed-width byte strings with prefix polynomial hashes; compares them by binary search for the common extension."""

    def __init__(self, body: np.ndarray, size: np.ndarray) -> None:
        self.body, self.size = body, size
        self.hashes = np.zeros((len(body), body.shape[1] + 1), np.uint64)
        for k in range(body.shape[1]):
            self.hashes[:, k + 1] = self.hashes[:, k] * np.uint64(BASE) + body[:, k] + np.uint64(1)
        self.steps = int(body.shape[1]).bit_length()

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix by hash."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        for _ in range(self.steps + 1):
            middle = (low + high + 1) >> 1
            same = self.hashes[a, middle] == self.hashes[b, middle]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether string a sorts after string b (a prefix first, equals by number)."""
        n = self.extension(a, b)
        x = np.where(n < self.size[a], self.body[a, np.minimum(n, self.body.shape[1] - 1)].astype(np.int64), -1)
        y = np.where(n < self.size[b], self.body[b, np.minimum(n, self.body.shape[1] - 1)].astype(np.int64), -1)
        return (x > y) | ((x == y) & (a > b))

    def true_extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        for k in range(0, len(a), 4096):
            i, j = a[k : k + 4096], b[k : k + 4096]
            differ = np.concatenate([self.body[i] != self.body[j], np.ones((len(i), 1), bool)], axis=1)
            out[k : k + 4096] = np.minimum(differ.argmax(axis=1), np.minimum(self.size[i], self.size[j]))
        return out


def merge_sorted(text: Suffixes, bounds: np.ndarray) -> np.ndarray:
    """Numbers of the strings, sorted inside each group bounds[i] to bounds[i + 1].

    A mergesort as an odd-even merging network, which compares many pairs of many groups at a time.
    """
    order = np.arange(int(bounds[-1]))
    sizes = np.diff(bounds)
    for level in range(1, int(max(1, sizes.max(initial=1)) - 1).bit_length() + 1):
        wide = 1 << level
        groups = np.flatnonzero((sizes > wide // 2) & (sizes <= wide))
        if not len(groups):
            continue
        at = np.full((len(groups), wide), -1, np.int64)
        inside = np.arange(wide)[None, :] < sizes[groups][:, None]
        at[inside] = np.concatenate([np.arange(bounds[g], bounds[g + 1]) for g in groups])

        def exchange(left: np.ndarray, right: np.ndarray, at=at) -> None:
            a, b = at[:, left], at[:, right]
            swap = (a < 0) & (b >= 0)
            both = (a >= 0) & (b >= 0)
            swap[both] = text.after(a[both], b[both])
            at[:, left], at[:, right] = np.where(swap, b, a), np.where(swap, a, b)

        run = 1
        while run < wide:
            gap = run
            while gap >= 1:
                left = np.concatenate([np.arange(j, min(j + gap, wide - gap)) for j in range(gap % run, wide - gap, 2 * gap)])
                left = left[left // (2 * run) == (left + gap) // (2 * run)]
                exchange(left, left + gap)
                gap //= 2
            run *= 2
        order[np.concatenate([np.arange(bounds[g], bounds[g + 1]) for g in groups])] = at[inside]
    return order


def run_numbers(text: Suffixes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the sorted strings and each one's verified common extension with the one before, -1 at a group's first."""
    order = merge_sorted(text, bounds)
    first = np.zeros(len(order), bool)
    first[bounds[:-1]] = True
    common = np.full(len(order), -1, np.int64)
    rest = np.flatnonzero(~first)
    found = text.extension(order[rest - 1], order[rest])
    true = text.true_extension(order[rest - 1], order[rest])
    for g in np.unique(np.searchsorted(bounds, rest[found != true], "right") - 1).tolist():  # hash collisions
        own = np.arange(bounds[g], bounds[g + 1])
        order[own] = sorted(own.tolist(), key=lambda i: (text.body[i, : text.size[i]].tobytes(), i))
    common[rest] = text.true_extension(order[rest - 1], order[rest])
    return order, common


def padded(parts: list[bytes]) -> Suffixes:
    size = np.array([len(p) for p in parts], np.int64)
    wide = max(1, int(size.max(initial=0)))
    body = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in parts), np.uint8).reshape(len(parts), wide)
    return Suffixes(body, size)


def repeated_windows(frame: pd.DataFrame, bounds: np.ndarray, length: int) -> pd.DataFrame:
    """(doc, start, windows) of the runs of windows that an earlier context under the same anchor holds too."""
    place = frame["place"].to_numpy(np.int64)
    start, back, count = place >> 16, (place >> 8) & 255, place & 255
    texts = frame["text"].tolist()
    doc = frame["doc"].to_numpy(np.int64)
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    age = np.empty(len(frame), np.int64)
    age[np.lexsort((start + back, doc))] = np.arange(len(frame))
    forward = padded([t[b:] for t, b in zip(texts, back.tolist())])
    backward = padded([t[:b][::-1] for t, b in zip(texts, back.tolist())])
    sides = [(*run_numbers(side, bounds), side.size) for side in (forward, backward)]
    gone: list[pd.DataFrame] = []
    for delta in range(int(back.max(initial=-1)) + 1):
        held = (delta <= back) & (delta > back - count)
        if held.sum() < 2:
            continue
        numbers = []
        for (order, common, size), need in zip(sides, (length - delta, delta)):
            number = np.empty(len(frame), np.int64)
            number[order] = np.cumsum(common < need)
            numbers.append(number)
        rows = np.flatnonzero(held)
        by = np.lexsort((age[rows], numbers[1][rows], numbers[0][rows], group[rows]))
        rows = rows[by]
        same = np.concatenate([[False], (group[rows[1:]] == group[rows[:-1]]) & (numbers[0][rows[1:]] == numbers[0][rows[:-1]]) & (numbers[1][rows[1:]] == numbers[1][rows[:-1]])])
        late = rows[same]
        if len(late):
            gone.append(pd.DataFrame({"doc": doc[late], "start": (start + back)[late] - delta}))
    if not gone:
        return pd.DataFrame({"doc": np.empty(0, np.int64), "start": np.empty(0, np.int64), "windows": np.empty(0, np.int64)})
    found = pd.concat(gone).drop_duplicates().sort_values(["doc", "start"])
    d, s = found["doc"].to_numpy(), found["start"].to_numpy()
    head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)]))
    return pd.DataFrame({"doc": d[head], "start": s[head], "windows": np.diff(np.concatenate([head, [len(d)]]))})


def numbered(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text) with doc in the order of (doc_id, text) and no two rows alike: doc_id itself where it is a key."""
    own = docs.select("doc_id", "text")
    if own.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count() == 0:
        return own.select(F.col("doc_id").alias("doc"), "doc_id", "text").where("doc is not null")

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 40
        for frame in frames:
            yield frame.assign(doc=np.arange(at, at + len(frame)), doc_id=frame["doc_id"].astype("Int64"))[["doc", "doc_id", "text"]]
            at += len(frame)

    ranged = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ranged.mapInPandas(number, "doc long, doc_id long, text string"), "numbered").where("doc is not null")


SPANS = "doc long, start long, windows long"


def repeats(rows: DataFrame, length: int, most: int) -> DataFrame:
    """(doc, start, windows): runs of windows that start earlier elsewhere, for rows (doc, text)."""
    found = rows.mapInPandas(lambda frames: anchor_rows(frames, length), "anchor long, context long, doc long, place long, again boolean").repartition("anchor")
    kind = ["anchor", "again", "context", F.col("place").bitwiseAND(F.lit(0xFFFF))]
    of_class = Window.partitionBy(*kind).orderBy("doc", "place")
    ranked = found.withColumn("first", ~F.col("again") & (F.row_number().over(of_class) == 1)).drop("again")
    counted = ranked.withColumn("classes", F.sum(F.col("first").cast("int")).over(Window.partitionBy("anchor")))
    marks = written(counted.where("not first or classes > 1"), "marks")
    later = marks.where("not first").select("doc", F.shiftright("place", 16).alias("start"), F.col("place").bitwiseAND(F.lit(255)).alias("windows"))
    spread = F.col("place").bitwiseAND(F.lit(255)) + (length - 1)
    held = marks.where("first").join(rows, "doc").select("anchor", "doc", "place", "classes", F.substring(F.col("text").cast("binary"), (F.shiftright("place", 16) + 1).cast("int"), spread.cast("int")).alias("text"))

    def inside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in runs(frames, ["anchor"]):
            yield repeated_windows(frame.reset_index(drop=True), bounds, length)

    usual = held.where(F.col("classes") <= most).select("anchor", "doc", "place", "text").repartition("anchor").sortWithinPartitions("anchor", "doc", "place").mapInPandas(inside, SPANS)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, place, text in zip(frame["doc"], frame["place"], frame["text"]):
                for k in range(place & 255):
                    whole = xxhash.xxh3_128_intdigest(text[k : k + length])
                    out.append(((whole >> 64) - 2**63, (whole & MASK) - 2**63, doc, (place >> 16) + k))
            yield pd.DataFrame(out, columns=["h1", "h2", "doc", "start"])

    windows = held.where(F.col("classes") > most).mapInPandas(each, "h1 long, h2 long, doc long, start long")
    earliest = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("low"))
    crowded = windows.join(earliest, ["h1", "h2"]).where(F.struct("doc", "start") > F.col("low")).select("doc", "start", F.lit(1).cast("long").alias("windows"))
    spans = later.unionByName(usual)
    if marks.where(F.col("classes") > most).limit(1).count():
        spans = spans.unionByName(crowded)
    return spans


def remove_repeats(docs: DataFrame, length: int = 100, most: int = 32_768) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept) of every row: removed lists the spans (start, end), kept the rest."""
    if not GRAM < length < 228:
        raise ValueError(f"length must lie between {GRAM + 1} and 227")
    rows = numbered(docs)
    dealt = rows.repartition("doc")
    spans = repeats(rows.select("doc", "text"), length, most)
    listed = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))

    def remove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), 500):
                out = []
                for d, text, found in frame.iloc[k : k + 500][["doc_id", "text", "spans"]].itertuples(index=False, name=None):
                    body = (text or "").encode("utf-8", "surrogatepass")
                    merged: list[list[int]] = []
                    for s, e in sorted((x["start"], x["start"] + x["windows"] + length - 1) for x in (found if found is not None else ())):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    edges = [0, *[x for m in merged for x in m], len(body)]
                    kept = b"".join(body[s:e] for s, e in zip(edges[::2], edges[1::2]))
                    out.append((None if pd.isna(d) else int(d), len(body), len(body) - len(kept), [{"start": s, "end": e} for s, e in merged], kept))
                part = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "removed", "kept"])
                part["doc_id"] = part["doc_id"].astype("Int64")
                yield part

    schema = "doc_id long, n_bytes long, n_removed long, removed array<struct<start: long, end: long>>, kept binary"
    return dealt.join(listed, "doc", "left").select("doc_id", "text", "spans").mapInPandas(remove, schema)


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


