"""SimHash near-dedup (2): covering locality-sensitive hashing of 64-bit fingerprints.

Bit i carries a nonzero vector m(i) of radius + 1 bits; for each nonzero vector v there is one mask holding the bits
with <m(i), v> = 1. Two fingerprints that differ in at most ``radius`` bits differ in vectors that span less than the
whole space, so some v is orthogonal to all of them and that mask hides every difference: the pair meets in that table.
Tables hold distinct fingerprints only; a bucket's links are found by exact bit counts inside blocks of bounded size
and returned as star edges, never as all pairs; components follow by large-star and small-star rounds.

``similar_groups`` is the definition on five-word shingles with a set similarity of 0.8 or more. Such pairs differ in
up to about 14 of 64 bits, for which covering masks would need 2^15 - 1 tables, so besides the radius-3 tables each
document enters tables keyed by min-wise sampled sub-bags of its shingles; all candidates meet an exact set comparison.

Defined cases: a null text counts as empty, an empty text has fingerprint zero and links like any other; repeated rows
share a fingerprint; a component without any doc_id gets a null id; an empty table gives no row; other columns are
ignored; texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import blocked_links, components, cut, private, star

SEED = 42


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """Structured masks of which one at least hides any ``radius`` differing bits."""
    vectors = 2 ** (radius + 1)
    at = [1 + i % (vectors - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (at[i] & v).bit_count() % 2) for v in range(1, vectors)]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, repeats included; ASCII lower case, ASCII white space."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    last = ends[words - 1 :].tolist() or [len(joined)]
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(first, last)), np.uint64, len(last))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint as a signed 64-bit integer: a bit is 1 if set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(words: int):
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([majority(shingle_hashes(t, words)) for t in texts], dtype="int64")

    return of


def near_fingerprints(radius: int):
    def link(frame: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        prints = frame["fp"].to_numpy()
        sizes = np.diff(bounds)
        two = bounds[:-1][sizes == 2]
        close = two[np.bitwise_count((prints[two] ^ prints[two + 1]).view(np.uint64)) <= radius]
        a, b = [prints[close + 1]], [prints[close]]
        for s, e in zip(bounds[:-1][sizes > 2].tolist(), bounds[1:][sizes > 2].tolist()):
            own = prints[s:e]
            label = star(np.bitwise_count((own[:, None] ^ own[None, :]).view(np.uint64)) <= radius)
            linked = label != np.arange(len(own))
            a.append(own[linked])
            b.append(own[label[linked]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return link


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, block: int = 1000) -> DataFrame:
    """(doc_id, fp, component_id): fingerprints that differ in at most ``radius`` bits are linked."""
    prints = cut(docs.select("doc_id", fingerprint(words)(F.col("text")).alias("fp")))
    known = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    signed = [m - 2**64 if m >= 2**63 else m for m in covering_masks(radius)]
    tables = known.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("table", "key"))
    found = components(blocked_links(tables, ["table", "key"], "fp", near_fingerprints(radius), block))
    labelled = known.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    lowest = labelled.where("component is not null").groupBy("component").agg(F.min("rep").alias("low"))
    names = labelled.join(lowest, "component", "left").select("fp", F.coalesce("low", "rep").alias("component_id"))
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


BANDS, ROWS = 20, 4


def _signature(words: int):
    """SimHash, and one key for each min-wise sampled sub-bag of ROWS shingles."""
    rng = np.random.default_rng(SEED)
    odd = rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)

    @F.pandas_udf("fp long, keys array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            hashes = shingle_hashes(t, words)
            distinct = np.unique(hashes)
            low = np.zeros(BANDS * ROWS, np.uint64)
            if len(distinct):
                low[:] = np.uint64(2**64 - 1)
                for k in range(0, len(distinct), 4096):
                    mixed = distinct[k : k + 4096, None] * odd[None, :] + add[None, :]
                    mixed ^= mixed >> np.uint64(29)
                    mixed *= np.uint64(0xBF58476D1CE4E5B9)
                    np.minimum(low, mixed.min(axis=0), out=low)
            keys = [xxhash.xxh64_intdigest(x.tobytes()) - 2**63 for x in low.reshape(BANDS, ROWS)]
            out.append((majority(hashes), keys))
        return pd.DataFrame(out, columns=["fp", "keys"])

    return of


def _shingle_set(words: int):
    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, words)).tobytes() for t in texts], dtype=object)

    return of


def word_digest(text: str) -> Column:
    """Names a text's words: ASCII lower case, ASCII white space."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.md5(F.trim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " ")))


def similar_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether the Jaccard similarity of each two sets reaches ``similarity``; two empty sets are equal."""
    sizes = np.array([len(s) for s in sets])
    n = len(sets)
    rows = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    rows, column = rows[shared], column[shared]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    first = np.concatenate([[True], column[1:] != column[:-1]]) if len(column) else np.empty(0, bool)
    column = np.cumsum(first) - 1
    both = np.zeros((n, n), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [c, c + 4096])
        part = np.zeros((n, 4096), np.float32)
        part[rows[lo:hi], column[lo:hi] - c] = 1
        both += part @ part.T
    np.fill_diagonal(both, sizes)
    union = sizes[:, None] + sizes[None, :] - both
    return both >= similarity * union - 1e-4


def _near_sets(similarity: float):
    def link(frame: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        names, hashes = frame["digest"].to_numpy(), frame["hashes"].tolist()
        a, b = [], []
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if e - s > 1:
                label = star(similar_sets([np.frombuffer(h, np.uint64) for h in hashes[s:e]], similarity))
                linked = np.flatnonzero(label != np.arange(e - s))
                a += names[s + linked].tolist()
                b += names[s + label[linked]].tolist()
        return pd.DataFrame({"a": a, "b": b}, dtype=object)

    return link


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 3, block: int = 500) -> DataFrame:
    """(doc_id, digest, group_digest, group_id): distinct documents linked when their shingle sets are this similar.

    digest names a document's normalised words; every table bucket links its members to its smallest digest, which
    gathers candidate clusters, and inside each cluster all pairs are compared exactly, block against block.
    """
    signed = cut(docs.select("doc_id", word_digest("text").alias("digest"), _signature(words)(F.col("text")).alias("s")).select("doc_id", "digest", "s.*"))
    known = cut(signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    masks = [m - 2**64 if m >= 2**63 else m for m in covering_masks(radius)]
    keyed = known.select("digest", F.posexplode(F.concat(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks]), "keys")).alias("table", "key"))
    low = keyed.groupBy("table", "key").agg(F.min("digest").alias("b"), F.count("*").alias("n")).where("n > 1")
    near = keyed.join(low, ["table", "key"]).where("digest <> b").select(F.col("digest").alias("a"), "b").distinct()
    clusters = components(near).select(F.col("node").alias("digest"), F.col("component").alias("cluster"))
    nowhere = F.lit(-(2**63))  # stands for a missing doc_id in the join, which the digest spreads
    members = clusters.join(known.select("digest", F.coalesce("rep", nowhere).alias("rep")), "digest")
    texts = docs.select(F.coalesce("doc_id", nowhere).alias("rep"), word_digest("text").alias("digest"), "text")
    sets = texts.join(members, ["rep", "digest"]).select("cluster", "digest", _shingle_set(words)(F.col("text")).alias("hashes"))
    loaded = cut(sets.dropDuplicates(["digest"]))
    groups = components(blocked_links(loaded, ["cluster"], "digest", _near_sets(similarity), block))
    named = known.join(groups.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "rep", F.coalesce("component", "digest").alias("group_digest"))
    chosen = named.groupBy("group_digest").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "digest")).alias("k")).select("group_digest", F.col("k.rep").alias("group_id"), F.col("k.digest").alias("kept_digest"))
    return signed.select("doc_id", "digest").join(named.select("digest", "group_digest"), "digest").join(chosen, "group_digest").select("doc_id", "digest", "group_digest", "group_id", "kept_digest")


def one_of_each_group(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of ``similar_groups``: the smallest doc_id's, rows without one last."""
    digest, number, kept_id, kept_digest = private(docs, "digest", "n", "kept_id", "kept_digest")
    kept = similar_groups(docs, words, similarity).select(F.col("group_id").alias(kept_id), F.col("kept_digest").alias(kept_digest)).distinct()
    marked = docs.withColumn(digest, word_digest("text"))
    same = marked["doc_id"].eqNullSafe(kept[kept_id]) & (marked[digest] == kept[kept_digest])
    once = Window.partitionBy("doc_id", digest).orderBy(*[F.col(f"`{c}`") for c, kind in docs.dtypes if kind in ("string", "bigint", "int", "double")])
    return marked.join(kept, same, "left_semi").withColumn(number, F.row_number().over(once)).where(F.col(number) == 1).drop(number, digest)


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
