"""Benchmark decontamination (5): CGK embeddings, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are sequences of lower-case words. A CGK walk reads a window with one random bit for each (step, word)
that tells whether to move on; edits make two walks differ in few outputs, so edit distance becomes Hamming distance.
Each repetition samples ``sampled`` outputs as an LSH key; a window that shares a key with an item of its length class
makes (document, item) a candidate. The number of repetitions is the least that finds ``target`` of the items themselves
after random edits at the bound. Each candidate's exact least edit distance over the whole document, start and end
free, then decides (bit-parallel), so every reported row is right and only a candidate can be missed.

Windows of every start are considered. One whose words hold too few of the class's item words to lie within the edit
bound of any of its items is passed over, which loses nothing. Items are matched in batches of at most ``max_items``, so
what is sent to every task is bounded; documents are never shuffled.

Defined cases: null and empty texts and items without words match nothing; an item of fewer than ``min_words`` words
must appear unchanged; repeated rows and items are reported each; an empty table gives no row; other columns are ignored;
texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

words_of = re.compile(r"[^\W_]+").findall


def least_edits(item: list[int], text: list[int]) -> tuple[int, int]:
    """(distance, end): the least edit distance of ``item`` to any stretch of ``text``, and where the first ends."""
    m = len(item)
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score = full, 0, m
    best, end = m, 0
    get = at.get
    for pos, w in enumerate(text, 1):
        x = get(w, 0) | down
        diagonal = ((up + (x & up)) ^ up) | x
        minus = up & diagonal
        plus = down | (full & ~(up | diagonal))
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best, end = score, pos
        x = plus << 1 & full
        down = x & diagonal
        up = (minus << 1 | ~(x | diagonal)) & full
    return best, end


#: Words that share a bucket share their walk's bits, which bounds the tables of bits.
BUCKETS = 1024


@lru_cache(maxsize=512)
def walk(seed: int, repetition: int, length: int, sampled: int) -> tuple[np.ndarray, np.ndarray]:
    """The steps whose output a repetition samples, and the bit of each (step, bucket of words) up to the last of them."""
    rng = np.random.default_rng((seed, repetition, length))
    picks = np.sort(rng.choice(2 * length, size=min(sampled, 2 * length), replace=False))
    return picks, rng.integers(0, 2, (int(picks[-1]) + 1, BUCKETS), dtype=np.int8)


class Items:
    """Benchmark items with their LSH tables by length class."""

    def __init__(self, items: list[tuple[int, str]], max_edit: float, min_words: int, sampled: int, target: float, most: int = 64, seed: int = 5) -> None:
        read = [(i, words_of((t or "").lower())) for i, t in items]
        read = [(i, w) for i, w in read if w]
        self.names = [i for i, _ in read]
        self.number = {w: n for n, w in enumerate(sorted({w for _, ws in read for w in ws}), 1)}
        self.items = [[self.number[w] for w in ws] for _, ws in read]
        self.bound = [int(max_edit * len(x)) if len(x) >= min_words else 0 for x in self.items]
        self.sampled, self.seed, self.size = sampled, seed, len(self.number) + 1
        classes: dict[int, list[int]] = {}
        for n, x in enumerate(self.items):
            step = max(1, len(x) // 8)
            classes.setdefault(len(x) // step * step, []).append(n)
        self.classes = sorted(classes.items())
        self.longest = max([0, *classes])
        self.known = {}
        for length, members in self.classes:
            inside = np.zeros(self.size, bool)
            for n in members:
                inside[self.items[n]] = True
            # a window of `length` may also miss what the item has beyond it
            self.known[length] = (inside, min(length - self.bound[n] for n in members))
        self.repetitions = most
        self.tables = {length: [self._keys_of(length, members, r) for r in range(most)] for length, members in self.classes}
        self.repetitions = self._calibrated(target, most)

    def keys(self, words: np.ndarray, bucket: np.ndarray, starts: np.ndarray, length: int, repetition: int) -> np.ndarray:
        """The sampled outputs of the CGK walk of words[start : start + length], as one integer; bucket is words modulo BUCKETS."""
        picks, bits = walk(self.seed, repetition, length, self.sampled)
        at = starts.astype(np.int32)
        ends, last = at + length, len(words) - 1
        key = np.zeros(len(starts), np.uint64)
        wanted = set(picks.tolist())
        for step in range(len(bits)):
            if step < length:  # no walk can have left its window
                over, here = None, at
            else:
                over, here = at >= ends, np.minimum(at, last)
            if step in wanted:
                now = words.take(here) if over is None else np.where(over, self.size, words.take(here))
                key = (key + now.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
            move = bits[step].take(bucket.take(here))
            at += move if over is None else np.where(over, 0, move).astype(np.int8)
        return key

    def _keys_of(self, length: int, members: list[int], repetition: int) -> tuple[np.ndarray, np.ndarray]:
        words = np.array([w for n in members for w in self.items[n][:length]], np.int32)
        keys = self.keys(words, words % BUCKETS, np.arange(len(members)) * length, length, repetition)
        order = np.argsort(keys, kind="stable")
        return keys[order], np.array(members)[order]

    def _calibrated(self, target: float, most: int) -> int:
        """The least number of repetitions that finds ``target`` of edited items again."""
        rng = np.random.default_rng(self.seed)
        first = []
        for n in rng.permutation(len(self.items))[:100].tolist():
            item = list(self.items[n])
            length = next(c for c, members in self.classes if n in members)
            for _ in range(self.bound[n]):
                kind, at = int(rng.integers(3)), int(rng.integers(max(1, len(item))))
                if kind == 0 and len(item) > 1:
                    del item[at]
                elif kind == 1:
                    item.insert(at, 0)
                else:
                    item[at] = 0
            words = np.array([0] * length + item + [0] * length, np.int32)
            starts = np.arange(len(words) - length)
            seen = most + 1
            for r in range(most):
                keys, members = self.tables[length][r]
                hits = np.isin(keys[members == n], self.keys(words, words % BUCKETS, starts, length, r))
                if hits.any():
                    seen = r + 1
                    break
            first.append(seen)
        return int(min(most, np.quantile(first, target, method="higher"))) if first else 1

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, item) of windows that share an LSH key with an item of their class."""
        at, own = [], []
        bucket = (words % BUCKETS).astype(np.int16)
        for length, _ in self.classes:
            inside, least = self.known[length]
            held = np.concatenate([[0], np.cumsum(inside[words], dtype=np.int32)])
            starts = np.flatnonzero(held[length:] - held[:-length] >= max(1, least))
            if not len(starts):
                continue
            for r in range(self.repetitions):
                keys, members = self.tables[length][r]
                mine = self.keys(words, bucket, starts, length, r)
                low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                hit = np.flatnonzero(high > low)
                for k in hit.tolist():
                    at += [int(starts[k])] * int(high[k] - low[k])
                    own += members[low[k] : high[k]].tolist()
        return np.array(at, np.int64), np.array(own, np.int64)


def leaks_of(frame: pd.DataFrame, items: Items, most_words: int = 400_000) -> Iterator[tuple]:
    """(doc_id, item_id, edits, item_words, end_word) of the rows of ``frame``; documents are searched in groups."""
    get = items.number.get
    gap = [0] * items.longest

    def search(group: list[tuple], words: list[int]) -> Iterator[tuple]:
        at, own = items.candidates(np.array(words, np.int32))
        where = np.searchsorted([g[1] for g in group], at, "right") - 1
        for d, n in sorted({*zip(where.tolist(), own.tolist())}):
            doc, start, end = group[d]
            edits, stop = least_edits(items.items[n], words[start:end])
            if edits <= items.bound[n]:
                yield doc, items.names[n], edits, len(items.items[n]), stop

    group: list[tuple] = []
    words: list[int] = []
    for doc, text in zip(frame["doc_id"], frame["text"]):
        own = [get(w, 0) for w in words_of((text or "").lower())]
        group.append((None if pd.isna(doc) else int(doc), len(words), len(words) + len(own)))
        words += own
        words += gap
        if len(words) >= most_words:
            yield from search(group, words)
            group, words = [], []
    if group and len(words) > items.longest:
        yield from search(group, words)


def item_batches(benchmark: DataFrame, max_edit: float, min_words: int, sampled: int, target: float, max_items: int) -> Iterator:
    """Broadcasts of at most about ``max_items`` items each."""
    rows = benchmark.select("item_id", "text")
    batches = max(1, math.ceil(rows.count() / max_items))
    for b in range(batches):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)) == b).orderBy("item_id", "text").collect()
        items = Items([(r.item_id, r.text) for r in own], max_edit, min_words, sampled, target)
        yield benchmark.sparkSession.sparkContext.broadcast(items)


SCHEMA = "doc_id long, item_id long, edits int, item_words int, end_word int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_edit: float = 0.2, min_words: int = 8, sampled: int = 3, target: float = 0.97, max_items: int = 20_000) -> DataFrame:
    """One row for each (document, item) whose least edit distance is at most max_edit of the item's words."""
    found = []
    for shared in item_batches(benchmark, max_edit, min_words, sampled, target, max_items):

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = pd.DataFrame(leaks_of(frame, shared.value), columns=["doc_id", "item_id", "edits", "item_words", "end_word"])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

        found.append(docs.select("doc_id", "text").where("text is not null").mapInPandas(run, SCHEMA))
    return reduce(DataFrame.unionByName, found)


def _flag(shared):
    @F.pandas_udf("boolean")
    def of(texts: pd.Series) -> pd.Series:
        frame = pd.DataFrame({"doc_id": range(len(texts)), "text": texts.to_numpy()})
        hit = {row[0] for row in leaks_of(frame, shared.value)}
        return pd.Series([i in hit for i in range(len(texts))], dtype="bool")

    return of


def leaked(benchmark: DataFrame, text: Column, max_edit: float = 0.2, min_words: int = 8, sampled: int = 3, target: float = 0.97, max_items: int = 20_000) -> Column:
    """Whether a text holds an item as ``find_leaks`` would report it; false for a null text."""
    flags = []
    for shared in item_batches(benchmark, max_edit, min_words, sampled, target, max_items):
        flags.append(_flag(shared)(text))
    return reduce(Column.__or__, flags)


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, benchmark)
