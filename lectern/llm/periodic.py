"""Periodic run detection (13): maximal runs of a text's words, found by block convolution.

A run is a stretch of consecutive words with smallest period q, of length at least ``max(least, 2 q)``, that no
neighbouring word extends with the same period. A run of period q repeats its words q places on over at least
``max(least - q, q)`` places, so it holds a whole aligned block of half that length. At each dyadic scale B, the
distances 2 B - 1 to 4 B - 2 (1 to 6 for B = 2) are searched: the sum of squared differences between a block and each
place of the following window is the block's and the window's sums of squares less twice their product, which one
number-theoretic transform gives for all distances at once, in integers modulo a prime. Distances without mismatch are
seeds: they are compared word by word (the sum is exact only modulo the prime) and extended to both sides as far as the
period holds.

Blocks that can't match anywhere in their window, since a word of theirs doesn't come back within it, are left out before
the transform, and so are blocks deep inside a run that is known already, whose matches are all multiples of its period.
Neither loses a run. All texts of an Arrow batch are searched together, with marks between them that match nothing. Memory
is bounded by the longest text; blocks above ``WIDEST`` words are represented by their first words, in several windows.

Defined cases: null, empty and blank texts have no word and no run and collapse to the empty text; words are cut at
\\x20 and \\x09 to \\x0D only and compared byte by byte; rows are independent, so repeated rows get the same answer each;
other columns, whatever their names, are not read; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prime 15 * 2^27 + 1 and a generator of its group: transforms of up to 2^27 places.
PRIME, GENERATOR = np.uint64(15 * 2**27 + 1), 31
#: Longest block that is transformed whole, and places transformed at once.
WIDEST, AT_ONCE = 1 << 18, 1 << 20
#: Words searched together.
GATHERED = 1 << 20

Run = tuple[int, int, int]


def reduced(a: np.ndarray) -> np.ndarray:
    return a - (a // PRIME) * PRIME


def turns(half: int, back: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order 2 ``half`` (or of its inverse)."""
    prime = int(PRIME)
    root = pow(GENERATOR, (prime - 1) // (2 * half), prime)
    step = pow(root, prime - 2, prime) if back else root
    out = np.ones(1, np.uint64)
    while len(out) < half:
        out = np.concatenate([out, reduced(out * np.uint64(pow(step, len(out), prime)))])
    return out[:half]


def forward(a: np.ndarray) -> np.ndarray:
    """Transform of each row (a power of two long); places come out in bit-reversed order."""
    a = a.copy()
    half = a.shape[1] // 2
    while half:
        pair = a.reshape(len(a), -1, 2, half)
        low, high = pair[:, :, 0].copy(), pair[:, :, 1].copy()
        pair[:, :, 0] = reduced(low + high)
        pair[:, :, 1] = reduced(reduced(low + PRIME - high) * turns(half, False))
        half //= 2
    return a


def inverse(a: np.ndarray) -> np.ndarray:
    """The rows whose ``forward`` is ``a``."""
    a = a.copy()
    n, half = a.shape[1], 1
    while half < n:
        pair = a.reshape(len(a), -1, 2, half)
        low, high = pair[:, :, 0].copy(), reduced(pair[:, :, 1] * turns(half, True))
        pair[:, :, 0] = reduced(low + high)
        pair[:, :, 1] = reduced(low + PRIME - high)
        half *= 2
    return reduced(a * np.uint64(pow(n, int(PRIME) - 2, int(PRIME))))


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences, modulo the prime, of each row of ``blocks`` with every place of the same row of ``windows``."""
    width, reach = blocks.shape[1], windows.shape[1]
    places = reach - width + 1
    size = 1 << (reach - 1).bit_length()
    turned = np.zeros((len(blocks), size), np.uint64)
    turned[:, :width] = blocks[:, ::-1]
    laid = np.zeros((len(blocks), size), np.uint64)
    laid[:, :reach] = windows
    product = inverse(reduced(forward(turned) * forward(laid)))[:, width - 1 : width - 1 + places]  # these places don't wrap around
    own = reduced(reduced(blocks * blocks).sum(axis=1))[:, None]
    sums = np.zeros((len(blocks), reach + 1), np.uint64)
    np.cumsum(reduced(windows * windows), axis=1, out=sums[:, 1:])
    met = reduced(sums[:, width:] - sums[:, :places])
    return reduced(own + met + np.uint64(2) * (PRIME - product))


def holds(x: np.ndarray, at: int, d: int, step: int) -> int:
    """How many places from ``at`` on, going by ``step`` (1 or -1), equal the word ``d`` places further."""
    n, size = 0, 32
    room = len(x) - d - at if step > 0 else at + 1
    while n < room:
        size = min(size * 2, room - n)
        lo = at + n if step > 0 else at - n - size + 1
        same = x[lo : lo + size] == x[lo + d : lo + d + size]
        if step < 0:
            same = same[::-1]
        if not same.all():
            return n + int(same.argmin())
        n += size
    return n


def near_enough(x: np.ndarray, starts: np.ndarray, gaps: np.ndarray, width: int, wanted: np.ndarray, steps: int = 12) -> np.ndarray:
    """Which seeds may hold over ``wanted`` places: those that don't, and end within ``steps`` on both sides, are ruled out."""
    held = np.full(len(starts), width, np.int64)
    open_ended = np.zeros(len(starts), bool)
    for first, step in ((starts + width, 1), (starts - 1, -1)):
        going = np.arange(len(starts))
        for n in range(steps):
            at = first[going] + n * step
            inside = (at >= 0) & (at + gaps[going] < len(x))
            going, at = going[inside], at[inside]
            going = going[x[at] == x[at + gaps[going]]]
            held[going] += 1
            if not len(going):
                break
        open_ended[going] = True
    return open_ended | (held >= wanted)


def runs_of(x: np.ndarray, least: int = 12, longest: int | None = None) -> list[Run]:
    """(start, end, period) of every run of ``x``, non-negative numbers below 2^30 between marks that occur once each.

    ``x`` begins and ends with a mark; ``longest`` bounds the words between two marks.
    """
    total = len(x)
    order = np.argsort(x, kind="stable")
    back = np.full(total, total, np.int64)  # places to the next equal word
    same = x[order[1:]] == x[order[:-1]]
    back[order[:-1][same]] = (order[1:] - order[:-1])[same]
    numbers = x.astype(np.uint64)
    period_at, end_at = np.zeros(total, np.int64), np.zeros(total, np.int64)
    found: dict[tuple[int, int], int] = {}
    longest = total if longest is None else longest

    def extend(starts: np.ndarray, gaps: np.ndarray, width: int) -> None:
        """Seeds in the order of distance, then place; a stretch that a seed has opened takes the later ones in it."""
        hopeful = near_enough(x, starts, gaps, width, np.maximum(least - gaps, gaps))
        starts, gaps = starts[hopeful], gaps[hopeful]
        order = np.lexsort((starts, gaps))
        starts, gaps = starts[order], gaps[order]
        k = 0
        while k < len(starts):
            at, d = int(starts[k]), int(gaps[k])
            k += 1
            if not np.array_equal(x[at : at + width], x[at + d : at + d + width]):
                continue
            stop = at + width + holds(x, at + width, d, 1)
            begin = at - holds(x, at - 1, d, -1)
            same_gap = int(np.searchsorted(gaps, d, "right"))
            k = max(k, int(np.searchsorted(starts[:same_gap][k:], stop)) + k) if k < same_gap else k
            end = stop + d
            if end - begin < max(least, 2 * d):
                continue
            known = found.get((begin, end))
            if known and d % known == 0:
                continue
            found[begin, end] = d
            part = slice(begin, end)
            further = end_at[part] < end
            period_at[part][further], end_at[part][further] = d, end

    block, farthest = 2, back.copy()  # farthest: most places to the next equal word, by block
    farthest = np.maximum(farthest[: total // 2 * 2 : 2], farthest[1 : total // 2 * 2 : 2])
    while True:
        low, high = (1, 6) if block == 2 else (2 * block - 1, 4 * block - 2)
        if 2 * low > longest:
            break
        width = min(block, WIDEST)
        starts = np.flatnonzero(farthest <= high).astype(np.int64) * width
        if width < block:
            starts = starts[starts % block == 0]
        q, end = period_at[starts], end_at[starts]
        starts = starts[~((q > 0) & (q <= width) & (end >= starts + high + width))]
        distances = min(high - low + 1, 2 * width)
        firsts = np.arange(low, high + 1, distances)
        at, gap = np.repeat(starts, len(firsts)), np.tile(firsts, len(starts))
        near = at + gap + width <= total
        at, gap = at[near], gap[near]
        reach = distances + width - 1
        per = max(1, AT_ONCE // (1 << (reach - 1).bit_length()))
        for s in range(0, len(at), per):
            a, g = at[s : s + per], gap[s : s + per]
            q, end = period_at[a], end_at[a]
            fresh = ~((q > 0) & (q <= width) & (end >= a + high + width))
            a, g = a[fresh], g[fresh]
            if not len(a):
                continue
            rows = numbers[a[:, None] + np.arange(width)]
            spots = (a + g)[:, None] + np.arange(reach)
            windows = numbers[np.minimum(spots, total - 1)]
            i, d = np.nonzero(mismatches(reduced(rows), reduced(windows)) == 0)
            a, d = a[i], g[i] + d
            q, end = period_at[a], end_at[a]
            seed = (a + d + width <= total) & (d <= high) & ~((q > 0) & (d % np.maximum(q, 1) == 0) & (end >= a + d + width))
            extend(a[seed], d[seed], width)
        block *= 2
        if block <= WIDEST:
            pairs = len(farthest) // 2 * 2
            farthest = np.maximum(farthest[:pairs:2], farthest[1:pairs:2])
    return sorted((s, e, q) for (s, e), q in found.items())


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(x, starts): words as numbers with marks around each text, and where each text starts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[1], np.cumsum(sizes + 1) + 1])
    marks = np.concatenate([[0], starts[1:] - 1])
    x = np.empty(len(ids) + len(texts) + 1, np.int64)
    inside = np.ones(len(x), bool)
    inside[marks] = False
    x[inside] = ids
    x[marks] = len(flat.dictionary) + np.arange(len(marks))
    return x, starts[:-1]


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for s, e, q in runs:
        gone[s + q] += 1
        gone[e] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])


def periodic_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = 12,
    looped: Callable[[int, int], tuple[int, int] | None] | None = None,
) -> DataFrame:
    """(``key``, runs, collapsed): the runs of each row's text in the order of start and period, and the text without repeats.

    ``looped(key, words)`` may name (a, p): the words from a on are then taken to repeat the p words that start at a.
    """
    kind = docs.schema[key].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            held: list[list[bytes]] = []
            size = begin = 0
            for i in range(len(keys) + 1):
                if i == len(keys) or size >= GATHERED:
                    if i > begin:
                        yield answered(keys[begin:i], held, batch.schema.field(0).type)
                    held, size, begin = [], 0, i
                if i < len(keys):
                    words = (texts[i] or "").encode("utf-8").split()
                    loop = looped(keys[i], len(words)) if looped and words else None
                    if loop:
                        a, p = loop
                        cycle = words[a : a + p]
                        words = words[:a] + (cycle * ((len(words) - a) // p + 1))[: len(words) - a]
                    held.append(words)
                    size += len(words)

    def answered(keys: list, texts: list[list[bytes]], key_type: pa.DataType) -> pa.RecordBatch:
        x, starts = numbered(texts)
        runs: list[list[Run]] = [[] for _ in texts]
        for s, e, q in runs_of(x, least, max(map(len, texts))):
            t = int(np.searchsorted(starts, s, "right")) - 1
            runs[t].append((s - int(starts[t]), e - int(starts[t]), q))
        for r in runs:
            r.sort(key=lambda run: (run[0], run[2]))
        told = [[{"start": s, "length": e - s, "period": q} for s, e, q in r] for r in runs]
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        left = [collapsed(t, r).decode("utf-8") for t, r in zip(texts, runs)]
        return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(told, run_type), pa.array(left, pa.string())], [key, "runs", "collapsed"])

    return docs.select(key, text).mapInArrow(search, f"`{key}` {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def looped_tenth(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The contract's loops: a tenth of the documents, chosen by the checksum of their id, repeat a part of themselves."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(docs, looped=looped_tenth)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.less")).alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("(1000 * -longest.less) div longest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
