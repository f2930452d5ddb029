"""Phrase collocation mining (12): stripes of next-word counters, merged elementwise, level by level.

A prefix of k words keys a stripe: an associative counter of the words that follow it. Texts are dealt into batches; a batch
sends, for each prefix it holds, the part of the stripe that falls into each bucket (dealt by prefix and next word, so that
the stripe of a hot prefix spreads), and the buckets merge the parts elementwise: sorted arrays whose equal entries add up.
Entries that reach ``least`` stay and are numbered; each batch gets the numbers of its own entries back, so that the next
level has them as prefixes. A phrase of k + 1 words is only counted where both phrases of k words in it are frequent, as it
can't be frequent elsewhere; nothing else is left out. Words are numbered by level 0, whose one prefix is empty. Phrases are
told apart by these numbers, never by a hash.

The merged stripes hold everything the scores need: an entry is the count of prefix and next word, the same entry as a key of
the next level has its extensions, whose maximum decides with that of the phrases it ends (subsumption), and the counts of
its parts are entries of the levels below, joined by number.

What is shuffled: distinct phrases of a batch and their numbers as a few bytes each, in proportion to the input. Nothing is broadcast and
nothing but row counts reaches the driver. A bucket's memory is bounded by ``bucket_words`` and a batch's by ``batch_bytes``,
or by the longest text. The ranks of a language come from a range partition and the counts of its parts before.

Defined cases: null and empty texts have no word; a null language is ``und`` and shares its counts with one that is named so;
repeated rows count each; a language without candidates has no row; equal scores and counts go by the phrase's bytes; other
columns, whatever their names, are not read; an empty table gives no row.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import shared_folder, written

#: What each byte of a text is: 0 of a word, 1 a gap, 2 the end of a piece; and its lower-case form (A-Z only).
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

BATCH = "batch long, lang string, dictionary binary, counts binary, words binary"
PART = "batch long, bucket int, lang string, prefixes binary, nexts binary, counts binary"
MERGED = "kind int, batch long, bucket int, lang string, word string, prefix long, next long, id long, f long, names binary"


def pressed(a: np.ndarray) -> bytes:
    """Non-negative integers, compressed: the lowest byte of each, then the next, up to the highest in use."""
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def opened(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[1:]), np.uint8).reshape(body[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : body[0]] = planes.T
    return out.view("<i8").ravel()


def squeezed(words: list[bytes]) -> bytes:
    """Words, which hold no line end, one a line."""
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def lines_of(body: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(body).split(b"\n")


def distinct(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in the order of their bytes, and the place of each of ``words`` among them."""
    held = words.dictionary_encode()
    order = pc.sort_indices(held.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return held.dictionary.take(order), place[held.indices.to_numpy(zero_copy_only=False)]


def answer(ids: np.ndarray, n: int) -> bytes:
    """Ascending numbers of one bucket, 0 for none, as which they are and their steps in units of ``n``."""
    which = pressed(np.packbits(ids > 0))
    return len(which).to_bytes(4, "little") + which + pressed(np.diff(ids[ids > 0] // n, prepend=0))


def answered(body: bytes, size: int, bucket: int, n: int) -> np.ndarray:
    """The numbers that ``answer`` gave, ``size`` of them."""
    split = 4 + int.from_bytes(body[:4], "little")
    out = np.zeros(size, np.int64)
    out[np.unpackbits(opened(body[4:split]).astype(np.uint8))[:size] > 0] = np.cumsum(opened(body[split:])) * n + bucket
    return out


def word_numbers(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """(dictionary, words): the distinct words in byte order and each word's place in it, from 1, with 0 between pieces."""
    data = LOWER[np.frombuffer("\n".join(texts).encode("utf-8"), np.uint8)]
    kind = KIND[data]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    body = data[inside]
    before = np.cumsum(inside)
    offsets = np.append(before[starts] - 1, len(body)).astype(np.int32)
    dictionary, number = distinct(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)]))
    piece = np.cumsum(kind == 2)[starts] if len(starts) else starts
    fresh = np.concatenate([[0], (piece[1:] != piece[:-1]).astype(np.int64)]) if len(starts) else starts
    places = np.arange(len(starts)) + np.cumsum(fresh)
    words = np.zeros(int(places[-1]) + 1 if len(places) else 0, np.int64)
    words[places] = number + 1
    return dictionary.to_pylist(), words


def by_frequency(counts: np.ndarray) -> np.ndarray:
    """The rank of each word, from 1, most frequent first, which are smaller numbers to keep; 0 stays 0."""
    out = np.zeros(len(counts) + 1, np.int64)
    out[1 + np.argsort(-counts, kind="stable")] = np.arange(1, len(counts) + 1)
    return out


def batches(docs: DataFrame, text: str, lang: str, batch_bytes: int) -> DataFrame:
    """One row for the texts of one language in a stretch of a partition."""
    named = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text")).where("text is not null")

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}

        def out(language: str) -> pd.DataFrame:
            nonlocal number
            number += 1
            sizes.pop(language)
            dictionary, words = word_numbers(held.pop(language))
            counts = np.bincount(words, minlength=1)[1:]
            told = {"dictionary": [squeezed(dictionary)], "counts": [pressed(counts)], "words": [pressed(by_frequency(counts)[words])]}
            return pd.DataFrame({"batch": [number], "lang": [language]} | told)

        for frame in frames:
            for language, value in zip(frame["lang"], frame["text"]):
                size = sizes.get(language, 0)
                if size and size + len(value) > batch_bytes:
                    yield out(language)
                held.setdefault(language, []).append(value)
                sizes[language] = sizes.get(language, 0) + len(value)
                if sum(sizes.values()) > 2 * batch_bytes:
                    yield out(max(sizes, key=sizes.get))
        for language in list(held):
            yield out(language)

    return named.mapInPandas(deal, BATCH)


def entries(words: np.ndarray, phrases: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(prefixes, nexts, counts, at): the distinct phrases of ``level`` + 1 words; ``at`` leads from places to them, -1 elsewhere.

    ``words`` has the number of each place's word, ``phrases`` that of the phrase of ``level`` words that starts there, 0 for none.
    """
    alive = np.flatnonzero((phrases[: len(phrases) - level] > 0) & (phrases[1 : len(phrases) - level + 1] > 0))
    prefixes, nexts = phrases[alive], words[alive + level]
    at = np.full(len(words), -1, np.int64)
    if not len(alive):
        return prefixes, nexts, prefixes, at
    order = np.lexsort((nexts, prefixes))
    p, n = prefixes[order], nexts[order]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (p[1:] != p[:-1]) | (n[1:] != n[:-1])
    firsts = np.flatnonzero(fresh)
    at[alive[order]] = np.cumsum(fresh) - 1
    return p[firsts], n[firsts], np.diff(np.append(firsts, len(p))), at


def buckets_of(prefixes: np.ndarray, nexts: np.ndarray, n: int) -> np.ndarray:
    mixed = prefixes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ nexts.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % n


def at_level(row, level: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(prefixes, nexts, counts, bucket, dictionary) of a batch's entries at a level; the levels below are numbered by their replies."""
    counts, dictionary = opened(row.counts), lines_of(row.dictionary)
    words = np.argsort(by_frequency(counts))[opened(row.words)]
    bucket = np.fromiter((zlib.crc32(w) % n for w in dictionary[: len(counts)]), np.int64, len(counts))
    prefixes, nexts, at, phrases = np.zeros(len(counts), np.int64), np.arange(1, len(counts) + 1), words - 1, words
    for k in range(level):
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(n + 1))
        ids = np.zeros(len(nexts) + 1, np.int64)
        for reply in getattr(row, f"replies{k}"):
            b = reply["bucket"]
            ids[order[starts[b] : starts[b + 1]]] = answered(reply["names"], int(starts[b + 1] - starts[b]), b, n)
        phrases = ids[at]
        if k == 0:
            words = phrases
        prefixes, nexts, counts, at = entries(words, phrases, k + 1)
        bucket = buckets_of(prefixes, nexts, n)
    return prefixes, nexts, counts, bucket, dictionary


def sent(table: DataFrame, level: int, n: int) -> DataFrame:
    """Each batch's parts of the stripes, one row a bucket."""

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                prefixes, nexts, counts, bucket, dictionary = at_level(row, level, n)
                if not len(nexts):
                    continue
                order = np.argsort(bucket, kind="stable")
                ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
                rows = []
                for s, e in zip([0, *ends[:-1].tolist()], ends.tolist()):
                    own = order[s:e]
                    told = pressed(nexts[own]) if level else squeezed([dictionary[i] for i in own.tolist()])
                    steps = pressed(np.diff(prefixes[own], prepend=0)) if level else b""
                    rows.append((row.batch, int(bucket[own[0]]), row.lang, steps, told, pressed(counts[own])))
                yield pd.DataFrame(rows, columns=["batch", "bucket", "lang", "prefixes", "nexts", "counts"])

    return table.mapInPandas(send, PART)


def merged(parts: DataFrame, level: int, n: int, least: int) -> DataFrame:
    """Kind 1: the frequent entries, numbered; kind 0: each part's numbers; kind 2 (words only): a language's words in a bucket."""

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for frame in frames:
            for row in frame.itertuples():
                if held and held[-1].bucket != row.bucket:
                    yield from added(held)
                    held = []
                held.append(row)
        if held:
            yield from added(held)

    def added(rows: list) -> Iterator[pd.DataFrame]:
        bucket = rows[0].bucket
        counts = [opened(r.counts) for r in rows]
        sizes = [len(c) for c in counts]
        owner = np.repeat(np.arange(len(rows)), sizes)
        count = np.concatenate(counts)
        langs = sorted({r.lang for r in rows})
        lang = np.array([langs.index(r.lang) for r in rows])[owner]
        if level == 0:
            shown, nexts = distinct(pa.array([w for r in rows for w in lines_of(r.nexts)], pa.binary()))
            prefixes = lang
        else:
            nexts = np.concatenate([opened(r.nexts) for r in rows])
            prefixes = np.concatenate([np.cumsum(opened(r.prefixes)) for r in rows])
        order = np.lexsort((nexts, prefixes))
        p, q = prefixes[order], nexts[order]
        fresh = np.ones(len(p), bool)
        fresh[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        firsts = np.flatnonzero(fresh)
        f = np.add.reduceat(count[order], firsts)
        kept = f >= least
        ids = np.where(kept, np.cumsum(kept) * n + bucket, 0)
        names = np.empty(len(p), np.int64)
        names[order] = np.repeat(ids, np.diff(np.append(firsts, len(p))))
        numbers = [(r.batch, answer(part, n)) for r, part in zip(rows, np.split(names, np.cumsum(sizes)[:-1])) if part.any()]
        if numbers:
            yield told(0, bucket, batch=[x for x, _ in numbers], names=[x for _, x in numbers])
        firsts = firsts[kept]
        languages = [langs[i] for i in lang[order][firsts].tolist()]
        if level == 0:
            yield told(2, bucket, lang=langs, f=[int(count[lang == i].sum()) for i in range(len(langs))])
        if not len(firsts):
            return
        if level == 0:
            yield told(1, bucket, lang=languages, word=[shown[i].as_py().decode("utf-8") for i in q[firsts].tolist()], id=ids[kept], f=f[kept])
        else:
            yield told(1, bucket, lang=languages, prefix=p[firsts], next=q[firsts], id=ids[kept], f=f[kept])

    def told(kind: int, bucket: int, **columns) -> pd.DataFrame:
        rows = len(next(iter(columns.values())))
        given = {"kind": np.full(rows, kind), "bucket": np.full(rows, bucket)} | columns
        return pd.DataFrame({c: given.get(c, [None] * rows) for c in (x.split()[0] for x in MERGED.split(", "))})

    return parts.repartition("bucket").sortWithinPartitions("bucket", "batch").mapInPandas(merge, MERGED)


def replied(table: DataFrame, found: DataFrame, level: int) -> DataFrame:
    """The batches with what the buckets told them about this level; those that nothing was told have no frequent entry."""
    replies = found.where("kind = 0").groupBy("batch").agg(F.collect_list(F.struct("bucket", "names")).alias(f"replies{level}"))
    return table.join(replies, "batch")


def bucketed(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder that joins by ``key`` read without a shuffle, and the table's name."""
    spark = df.sparkSession
    name = f"lectern_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name), name


def stripes(docs: DataFrame, text: str, lang: str, longest: int, least: int, batch_bytes: int, bucket_words: int) -> list[DataFrame]:
    """The merged entries of each level, 0 (words) to ``longest`` - 1, as written tables.

    The batches are written once, bucketed by batch: each level reads them with the replies of the levels below, which are
    all that moves, and numbers them anew.
    """
    table, name = bucketed(batches(docs, text, lang, batch_bytes), "batch")
    size = table.agg(F.sum(F.octet_length("words") + F.octet_length("dictionary"))).first()[0] or 0
    n = max(16, math.ceil(size / bucket_words))
    levels = []
    for level in range(longest):
        found = written(merged(sent(table, level, n), level, n, least), f"stripes{level}")
        levels.append(found)
        table = replied(table, found, level)
    docs.sparkSession.sql(f"DROP TABLE {name}")
    return levels


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, least: int = 30, subsumed: int = 80, batch_bytes: int = 10_000_000, bucket_words: int = 1_500_000
) -> tuple[DataFrame, DataFrame]:
    """(phrases, words): scored phrases (lang, phrase, a, l, r, score), without those that a longer one subsumes, and (lang, n).

    ``a`` is the count of the phrase, ``l`` and ``r`` those of the parts at its worst cut; ``subsumed`` is the percentage of
    ``a`` at which a longer phrase takes the shorter one's place.
    """
    levels = stripes(docs, text, lang, longest, least, batch_bytes, bucket_words)
    words = levels[0].where("kind = 2").groupBy("lang").agg(F.sum("f").cast("long").alias("n"))
    kept = lambda t: t.where("kind = 1").select("lang", "word", "prefix", "next", "id", "f")
    single = kept(levels[0]).select("id", F.col("word"), F.col("f").alias("f_word"))
    none = F.array().cast("array<bigint>")
    below = kept(levels[0]).select("lang", "id", F.col("word").alias("phrase"), "f", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("long").alias("tail"), "prefix", "next")
    scored = []
    for level in range(1, longest):
        now = kept(levels[level]).select("id", "prefix", "next", "f")
        heads = below.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("head"), F.col("f").alias("f_head"), F.col("lefts").alias("head_lefts"), F.col("tail").alias("head_tail"))
        met = now.join(heads, "prefix").join(single.withColumnRenamed("id", "next"), "next")
        if level == 1:
            tailed = met.select("*", F.col("next").alias("tail"), F.array("f_word").alias("rights"))
        else:
            tails = below.select(F.col("prefix").alias("head_tail"), "next", F.col("id").alias("tail"), F.concat(F.array("f"), "rights").alias("rights"))
            tailed = met.join(tails, ["head_tail", "next"])
        above = written(
            tailed.select("lang", "id", F.concat_ws(" ", "head", "word").alias("phrase"), "f", F.concat("head_lefts", F.array("f_head")).alias("lefts"), "rights", "tail", "prefix", "next"), "phrases"
        )
        if level > 1:
            scored.append(subsume(below, above, subsumed))
        below = above
    scored.append(below)
    worst = F.expr(
        "array_min(transform(arrays_zip(lefts, rights), (x, k) -> struct("
        "(cast(2000000 as decimal(7,0)) * cast(f as decimal(20,0))) div (cast(x.lefts as decimal(20,0)) + cast(x.rights as decimal(20,0))) as score, "
        "k as k, x.lefts as l, x.rights as r)))"
    )
    phrases = None
    for part in scored:
        shown = part.select("lang", "phrase", F.col("f").alias("a"), worst.alias("w")).select("lang", "phrase", "a", "w.l", "w.r", "w.score")
        phrases = shown if phrases is None else phrases.unionByName(shown)
    return phrases, words


def subsume(shorter: DataFrame, longer: DataFrame, percent: int) -> DataFrame:
    """The phrases that none of one word more, before or after, holds at ``percent`` of their count.

    A phrase of several words more holds one of one word more at least as often, so these decide.
    """
    around = longer.select(F.col("prefix").alias("id"), "f").unionByName(longer.select(F.col("tail").alias("id"), "f"))
    most = around.groupBy("id").agg(F.max("f").alias("most"))
    enough = F.lit(100).cast("decimal(3,0)") * F.col("most").cast("decimal(20,0)") >= F.lit(percent).cast("decimal(3,0)") * F.col("f").cast("decimal(20,0)")
    return shorter.join(most, "id", "left").where(F.col("most").isNull() | ~enough).drop("most")


def ranked(rows: DataFrame, group: str, order: list[Column], first: int) -> DataFrame:
    """The ``first`` rows of each group in an order that has no ties, with their ``rank``.

    Rows are range-partitioned by group and order; a row's rank is its place in its part plus the group's rows in the parts
    before. Only one count for each part and group meets in a window.
    """
    columns = rows.columns

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at, last = TaskContext.get().partitionId(), 0, object()
        for frame in frames:
            places = []
            for g in frame[group]:
                at = at + 1 if g == last else 1
                last = g
                places.append(at)
            yield frame.assign(part=part, place=places)

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    laid = written(rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order).mapInPandas(number, f"{kinds}, part int, place long"), "ranked")
    sizes = laid.groupBy(group, "part").agg(F.max("place").alias("size"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ahead")).where(F.col("ahead") < first)
    return laid.join(starts, [group, "part"]).withColumn("rank", F.col("ahead") + F.col("place")).where(F.col("rank") <= first).select(*columns, "rank")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    phrases, words = collocations(docs)
    top = ranked(written(phrases, "scored"), "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], 2000)
    return top.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = """
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL
), p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[ \\t]+') IF x <> ''] AS ws FROM p),
g AS (
  SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase
  FROM w, (VALUES (1), (2), (3), (4)) AS s(k) WHERE len(ws) >= k
), f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 30),
cut AS (SELECT c.*, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail FROM c, (VALUES (1), (2), (3)) AS s(j) WHERE j < k),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, l.a AS l, r.a AS r, ((2000000::HUGEINT * cut.a) // (l.a + r.a))::BIGINT AS score, j
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = head JOIN f r ON r.lang = cut.lang AND r.phrase = tail
), worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_part AS (
  SELECT c.lang, c.a AS longer, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM c, (VALUES (2), (3)) AS s(m), (VALUES (1), (2), (3)) AS t(i) WHERE m < k AND i + m - 1 <= k
), most AS (SELECT lang, phrase, max(longer) AS longer FROM inner_part GROUP BY lang, phrase),
kept AS (
  SELECT worst.* FROM worst LEFT JOIN most ON most.lang = worst.lang AND most.phrase = worst.phrase
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n.n AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
