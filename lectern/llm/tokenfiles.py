"""Token-ID / binary output (3): documents' ids as separately compressed frames that share one zstandard dictionary.

File format. A folder of Parquet part files in ascending doc_id order; each row is one pack:
``part, pack`` (order), ``first_id, last_id`` (the smallest and largest doc_id), ``dict_hash`` (xxh64 of the dictionary), ``ids_width`` (bytes an id), ``doc_ids``,
``offsets`` (n + 1 byte offsets into ``payload``), ``counts`` (ids a document) and ``payload`` (the documents' zstandard
frames, each compressed alone with the dictionary). A second folder, ``dictionary``, holds the dictionary with its hash.
So one short document is read by the range of ids, which leads to its pack, the pack's offset index and one small frame. Spark's writer commits the files, which
makes lost or repeated tasks harmless and lets them lie in any store that Spark reaches.

The dictionary is trained on serialized id arrays of at most ``sample_docs`` documents (the lowest hashes of doc_id),
each cut to ``sample_bytes``; it only affects size. Everything else covers every document.

Defined cases: null and empty texts hold the end id alone; rows with a null doc_id come first; repeated rows each have a
frame; an empty table gives an empty folder and no row; other columns are ignored; texts of any length are one frame.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import shared_folder
from lectern.llm.encoding import documents, encode_texts, encoder, tokenizer_path, wide

PACKS = "part int, pack int, first_id long, last_id long, dict_hash string, ids_width int, doc_ids array<long>, offsets array<long>, counts array<long>, payload binary"


def train_dictionary(encoded: DataFrame, size: int, sample_docs: int, sample_bytes: int) -> bytes:
    """A dictionary of at most ``size`` bytes; empty where there is too little to learn from."""
    rows = encoded.select(F.substring("ids", 1, sample_bytes).alias("x")).collect()
    samples = [bytes(r.x) for r in rows if r.x]
    if sum(map(len, samples)) < 50 * 1024:
        return b""
    return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 10), samples, level=3).as_bytes()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, dict_size: int = 65_536, sample_docs: int = 1000, sample_bytes: int = 4096, pack_bytes: int = 4_000_000, level: int = 3) -> None:
    """Writes ``docs(doc_id, text)`` to ``path`` in the format above."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    lowest = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = docs.join(F.broadcast(lowest.distinct()), "doc_id", "left_semi").select("doc_id", F.substring("text", 1, 2 * sample_bytes).alias("text")).orderBy("doc_id", F.xxhash64("text")).limit(sample_docs)
    trained = train_dictionary(encode_texts(sample, tokenizer, end_id), dict_size, sample_docs, sample_bytes)
    name = xxhash.xxh64_hexdigest(trained)
    spark.createDataFrame([(name, bytearray(trained))], "dict_hash string, body binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = zstandard.ZstdCompressionDict(trained) if trained else None
        press = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True)
        part, n = TaskContext.get().partitionId(), 0
        ids: list = []
        body: list[bytes] = []
        counts: list[int] = []
        held, width = 0, 0

        def row() -> pd.DataFrame:
            offsets = [0, *np.cumsum([len(b) for b in body]).tolist()]
            known = [i for i in ids if i is not None] or [None]
            ends = {"first_id": pd.array(known[:1], dtype="Int64"), "last_id": pd.array(known[-1:], dtype="Int64")}
            return pd.DataFrame({"part": [part], "pack": [n], **ends, "dict_hash": [name], "ids_width": [width], "doc_ids": [ids], "offsets": [offsets], "counts": [counts], "payload": [b"".join(body)]})

        coder = encoder(tokenizer)
        end, width = np.array([end_id], dtype=coder.kind).tobytes(), coder.width
        for frame in frames:
            for k in range(0, len(frame), 500):
                rows = frame.iloc[k : k + 500]
                for d, x in zip(rows["doc_id"], coder.encode_many(rows["text"].tolist())):
                    ids.append(None if pd.isna(d) else int(d))
                    body.append(press.compress(x + end))
                    counts.append(len(x) // width + 1)
                    held += len(body[-1])
                    if held >= pack_bytes:
                        yield row()
                        ids, body, counts, held, n = [], [], [], 0, n + 1
        if body:
            yield row()

    ranged = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInPandas(pack, PACKS).write.option("compression", "none").parquet(f"{path}/packs")


def read_dictionary(spark, path: str) -> tuple[str, bytes]:
    found = spark.read.schema("dict_hash string, body binary").parquet(f"{path}/dictionary").first()
    body = bytes(found.body)
    if xxhash.xxh64_hexdigest(body) != found.dict_hash:
        raise ValueError("the dictionary does not match its hash")
    return found.dict_hash, body


def _opened(payload: bytes, offsets, counts, at: int, press: zstandard.ZstdDecompressor, width: int) -> bytes:
    ids = press.decompress(payload[offsets[at] : offsets[at + 1]])
    if len(ids) != counts[at] * width:
        raise ValueError("a frame does not hold the ids its index tells")
    return ids


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_width, ids) of every document, start counting the ids before it."""
    name, trained = read_dictionary(spark, path)
    packs = spark.read.schema(PACKS).parquet(f"{path}/packs")
    heads = packs.select("part", "pack", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"))
    of_part = heads.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part file
    parts = of_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)
    starts = heads.join(parts, "part").select("part", "pack", (F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("base"))

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        for frame in frames:
            for r in frame.itertuples():
                if r.dict_hash != name:
                    raise ValueError("a pack was written with another dictionary")
                counts, offsets = np.asarray(r.counts, np.int64), np.asarray(r.offsets, np.int64)
                start = np.concatenate([[0], np.cumsum(counts)[:-1]])
                for k in range(0, len(counts), 512):
                    at = range(k, min(k + 512, len(counts)))
                    yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(r.doc_ids[i]) else int(r.doc_ids[i]) for i in at], dtype="Int64"), "part": r.part, "pack": r.pack, "inner": start[at.start : at.stop], "n_tokens": counts[at.start : at.stop], "ids_width": r.ids_width, "ids": [_opened(r.payload, offsets, counts, i, press, r.ids_width) for i in at]})

    opened = packs.mapInPandas(unpack, "doc_id long, part int, pack int, inner long, n_tokens long, ids_width int, ids binary")
    return opened.join(starts, ["part", "pack"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_width", "ids")


def packs_of(spark, path: str, doc_id: int) -> DataFrame:
    """The packs whose range of ids holds ``doc_id``; the files' statistics leave out the pages of all others, payloads too."""
    return spark.read.schema(PACKS).parquet(f"{path}/packs").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))


def read_document(spark, path: str, doc_id: int) -> list[int] | None:
    """The ids of one document, by its pack's range, its place in the pack and its frame alone; of repeated rows the first."""
    _, trained = read_dictionary(spark, path)
    row = packs_of(spark, path, doc_id).where(F.array_contains("doc_ids", F.lit(doc_id))).orderBy("part", "pack").first()
    if row is None:
        return None
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    ids = _opened(bytes(row.payload), row.offsets, row.counts, row.doc_ids.index(doc_id), press, row.ids_width)
    return np.frombuffer(wide(ids, row.ids_width), "<u4").tolist()


@F.pandas_udf(T.LongType())
def ids_crc32(ids: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([zlib.crc32(wide(x, w)) for x, w in zip(ids, width)], dtype="int64")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/lectern-tokens-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), path, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", ids_crc32("ids", "ids_width").alias("ids_crc32"))
