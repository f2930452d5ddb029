"""Packing (8): mixture-controlled sequences by deficit round-robin over source queues.

Each source is a queue of its documents' ids. A round is one window's worth of ids: in every round a queue's deficit
grows by its quantum, its target share of the window, and it pays out its next packets while the deficit covers them,
carrying what is left. A packet is a whole document, or ``part`` ids of a longer one. A packet that ends at id e of its
queue is therefore paid in the first round r with r * quantum >= e, so any partition knows the round of its packets from
the queues' totals alone, without running earlier rounds. When a queue runs dry, the others share its quantum by their
targets. Packets laid end to end by (round, queue, start) are cut every ``length`` ids: all windows are full but the
last, and besides long documents only what crosses a window's end is cut.

``targets`` maps sources to their share of every window; sources it doesn't name share the rest by their sizes, as one
queue. Without it each source's share is its share of the corpus, for any number of sources, and all run dry together.
No id is dropped or repeated, so other targets hold until the first queue runs dry.

Defined cases: null and empty texts are their end id; a null source is a queue of its own; repeated rows and doc_ids are
packed each; an empty table gives no row; other columns are ignored; long documents spread over many windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ordered_start, running_start, written
from lectern.llm.encoding import documents, encode_texts, tokenizer_path, wide


def queue_names(source: str, targets: Mapping[str | None, float] | None) -> Column:
    """The queue of a row: its source, or the joint one where ``targets`` doesn't name it."""
    own = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("none"))
    if targets is None:
        return own
    return F.when(own.isin([_name(s) for s in targets]), own).otherwise(F.lit("rest"))


def _name(source: str | None) -> str:
    return "none" if source is None else f"={source}"


def rounds_of(placed: DataFrame, totals: DataFrame, targets: Mapping[str | None, float] | None, length: int) -> DataFrame:
    """``placed`` with the round that pays a packet which ends at ``end`` of its queue."""
    if targets is None:
        whole = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
        paid = F.col("end") / F.col("total") * F.lit(float(whole))
        return placed.join(totals, "queue").withColumn("round", F.ceil(paid / length)).drop("total")
    known = {r.queue: r.total for r in totals.collect()}  # at most one more than targets names
    weight = {_name(s): float(w) for s, w in targets.items()}
    weight["rest"] = 1.0 - sum(weight.values())
    if min(weight.values()) < -1e-9 or any(weight[q] <= 0 for q in known):
        raise ValueError("targets must be positive, with a sum of at most 1 that leaves a share for sources they don't name")
    shares = [(weight[q], n) for q, n in sorted(known.items())]
    own = F.coalesce(*[F.when(F.col("queue") == q, F.col("end") / weight[q]) for q in sorted(known)], F.lit(0.0))
    served = reduce(Column.__add__, [F.least(F.lit(w) * F.col("__served"), F.lit(float(n))) for w, n in shares], F.lit(0.0))
    return placed.withColumn("__served", own).withColumn("round", F.ceil(served / length)).drop("__served")


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096, queue: str = "source", targets: Mapping[str | None, float] | None = None, part: int = 1024) -> DataFrame:
    """(doc_id, queue, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of every piece."""
    own = docs.select("doc_id", "text", queue_names(queue, targets).alias("queue"))
    encoded = written(encode_texts(own, tokenizer, end_id).withColumn("row", F.monotonically_increasing_id()), "encoded")
    totals = encoded.groupBy("queue").agg(F.sum("n_tokens").alias("total"))
    heads = running_start(encoded.select("row", "queue", "n_tokens"), ["queue"], ["row"], "n_tokens", "begin", encoded.count())
    packets = heads.select("row", "queue", "begin", "n_tokens", F.explode(F.sequence(F.lit(0), F.expr(f"(n_tokens - 1) div {part}"))).alias("at"))
    packets = packets.withColumn("start", F.col("at") * part).withColumn("size", F.least(F.lit(part), F.col("n_tokens") - F.col("start")))
    ended = packets.select("row", "queue", "start", "size", (F.col("begin") + F.col("start") + F.col("size")).alias("end"))
    laid = ordered_start(rounds_of(ended, totals, targets, length), "round", ["queue", "end"], "size", "place", per_bucket=64)
    listed = laid.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "size", "place"))).alias("packets"))

    def lay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "queue", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        for frame in frames:
            for k in range(0, len(frame), 256):
                out = []
                for d, q, ids, n, w, own in frame.iloc[k : k + 256][["doc_id", "queue", "ids", "n_tokens", "ids_width", "packets"]].itertuples(index=False, name=None):
                    body, doc = wide(ids, w), None if pd.isna(d) else int(d)
                    for at, size, place in pieces([(p["start"], p["size"], p["place"]) for p in own], length):
                        piece = body[4 * at : 4 * (at + size)]
                        out.append((doc, q, at, size, zlib.crc32(piece), n, place // length, place % length, piece))
                rows = pd.DataFrame(out, columns=names)
                rows["doc_id"] = rows["doc_id"].astype("Int64")
                yield rows

    schema = "doc_id long, queue string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return encoded.join(listed, "row").mapInPandas(lay, schema)


def pieces(packets: list[tuple[int, int, int]], length: int) -> Iterator[tuple[int, int, int]]:
    """(start, size, place) of a document's packets, neighbours that touch joined, cut at the windows' ends."""
    joined: list[list[int]] = []
    for start, size, place in packets:
        if joined and joined[-1][2] + joined[-1][1] == place:
            joined[-1][1] += size
        else:
            joined.append([start, size, place])
    for start, size, place in joined:
        while size > 0:
            step = min(size, length - place % length)
            yield start, step, place
            start, place, size = start + step, place + step, size - step


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def op8_packing(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "source")
    return pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2).select(*COLUMNS, "queue")
