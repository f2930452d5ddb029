"""Token ids of whole texts by the tokenizers library, distinct words encoded once per worker.

The word tokenizer lower-cases, splits a text into runs of letters, single digits, contractions and runs of other marks,
drops white space and merges inside those parts only. So a text's ids are its parts' ids in order. Texts of ASCII and
Latin-1 letters, where lower-casing and composition work character by character, are cut into parts as one byte array a
batch; Arrow numbers the distinct parts, the library's model encodes those that the worker has not met, and the ids are
gathered by number. Words of other texts go to the library one by one, through its whole chain. The memo is emptied when
full, which bounds memory. Where a tokenizer's file does not promise this splitting, texts go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters that lower-casing and composition treat one by one.
LATIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*").fullmatch
#: Fixed value: the splitting pattern this module reproduces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space of the word tokenizer that words of any text may be cut at.
GAPS = re.compile(r"[ \n]+").split

SPACE, LETTER, DIGIT, MARK = range(4)
#: What each byte of a lower-case Latin text belongs to; bytes above ASCII are halves of letters.
KINDS = np.full(256, MARK, np.uint8)
KINDS[[*range(9, 14), 32]] = SPACE
KINDS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = LETTER
KINDS[ord("0") : ord("9") + 1] = DIGIT
#: The byte-level alphabet: bytes without a printable character of their own stand for 256, 257 and so on.
HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
VISIBLE = {b: 256 + n for n, b in enumerate(HIDDEN)}


def part_starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, kinds): where the parts of lower-case Latin text ``data`` start, and the kind of each byte."""
    kind = KINDS[data]
    fresh = kind == DIGIT
    fresh[1:] |= kind[1:] != kind[:-1]
    fresh[:1] = True
    fresh &= kind != SPACE
    quote = np.flatnonzero(data == ord("'"))
    quote = quote[fresh[quote]]
    if len(quote):
        ahead = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two = ahead[quote + 1], ahead[quote + 2]
        size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, 0)
        for a, b in (b"re", b"ve", b"ll"):
            size[(one == a) & (two == b)] = 2
        quote, size = quote[size > 0], size[size > 0]
        fresh[quote + 1] = False
        end = quote + 1 + size
        end = end[end < len(data)]
        fresh[end[kind[end] == LETTER]] = True
    return np.flatnonzero(fresh), kind


#: Longer words are encoded each time, so that the memos are bounded in bytes too (texts without spaces are one word).
LONGEST = 64


class WordEncoder:
    """``encode(text)`` gives little-endian ids of ``width`` bytes each."""

    def __init__(self, path: str, memo: int = 600_000, batch: int = 1 << 22) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65_536 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = [(x.get("type"), (x.get("pattern") or {}).get("Regex")) for x in (told.get("normalizer") or {}).get("normalizers", [])]
        parts = [(x.get("type"), (x.get("pattern") or {}).get("Regex"), x.get("behavior"), x.get("use_regex"), x.get("add_prefix_space")) for x in (told.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = (
            steps == [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
            and parts == [("Split", PATTERN, "Removed", None, None), ("ByteLevel", None, None, False, False)]
            and not any(x["lstrip"] or x["rstrip"] or " " in x["content"] or "\n" in x["content"] for x in told["added_tokens"])
        )
        #: Special strings are matched case by case on the raw text, so texts that might hold one are not lowered here.
        self.added = [x["content"].lower() for x in told["added_tokens"]]
        self.small = [self._packed([i]) for i in range(self.tokenizer.get_vocab_size())]
        self.limit, self.batch = memo, batch
        self.parts: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {"": b""}

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.kind).tobytes()

    def _encoded(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each distinct part by the library's model."""
        known = self.parts
        if len(known) + len(parts) > self.limit:
            known.clear()
        found = list(map(known.get, parts))
        if None in found:
            split, small = self.tokenizer.model.tokenize, self.small
            for i, ids in enumerate(found):
                if ids is None:
                    part = parts[i]
                    shown = part.decode("ascii") if part.isalpha() else part.decode("latin-1").translate(VISIBLE)
                    found[i] = b"".join([small[t.id] for t in split(shown)])
                    if len(part) <= LONGEST:
                        known[part] = found[i]
        return found

    def _latin(self, bodies: list[bytes]) -> list[bytes]:
        """Ids of each lower-case Latin text."""
        data = np.frombuffer(b"\n".join(bodies), np.uint8)
        starts, kind = part_starts(data)
        solid = kind != SPACE
        body = data[solid]
        before = np.cumsum(solid, dtype=np.int32)
        offsets = np.append(before[starts] - 1, np.int32(len(body))).astype(np.int32)
        held = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        ids = self._encoded(held.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        flat = np.frombuffer(b"".join(ids), self.kind)
        at = held.indices.to_numpy()
        many = sizes[at]
        ends = np.cumsum(many)
        begin = (np.cumsum(sizes) - sizes)[at]
        out = flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - many), many)]
        limits = np.cumsum([len(b) + 1 for b in bodies])
        stops = np.concatenate([[0], ends])[np.searchsorted(starts, limits)].tolist()
        return [out[s:e].tobytes() for s, e in zip([0, *stops[:-1]], stops)]

    def _by_words(self, text: str) -> bytes:
        """Ids of a text of any letters; its white-space separated words go through the library's whole chain."""
        out = []
        for word in GAPS(text):
            ids = self.words.get(word)
            if ids is None:
                ids = self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
                if len(word) <= LONGEST:
                    if len(self.words) >= self.limit:
                        self.words = {"": b""}
                    self.words[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return [self._packed(self.tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, bytes]] = []
        held = 0

        def finish() -> None:
            for (at, _), ids in zip(waiting, self._latin([body for _, body in waiting])):
                out[at].append(ids)
            waiting.clear()

        for at, text in enumerate(texts):
            if not text:
                continue
            low = text.lower()
            if not LATIN(text) or any(x in low for x in self.added):
                out[at].append(self._by_words(text))
                continue
            body = low.encode()
            start = 0
            while start < len(body):  # a text beyond the batch is cut at a gap
                end = len(body)
                if end - start > self.batch:
                    gap = max(body.rfind(b" ", start, start + self.batch), body.rfind(b"\n", start, start + self.batch))
                    end = gap + 1 if gap > start else end
                waiting.append((at, body[start:end]))
                held += end - start
                start = end
                if held >= self.batch:
                    finish()
                    held = 0
        if waiting:
            finish()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_texts(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``docs`` without text but with ids (little-endian, ids_width bytes each, ``end_id`` last) and n_tokens."""
    kept = [f for f in docs.schema if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "ids binary", "n_tokens long", "ids_width int"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        end = np.array([end_id], dtype=e.kind).tobytes()
        for frame in frames:
            for k in range(0, len(frame), 1000):
                part = frame.iloc[k : k + 1000]
                ids = [x + end for x in e.encode_many(part["text"].tolist())]
                yield part.drop(columns="text").assign(ids=ids, n_tokens=[len(x) // e.width for x in ids], ids_width=e.width)

    return docs.mapInPandas(run, schema)


def wide(ids: bytes, width: int) -> bytes:
    """Ids of ``width`` bytes as unsigned 32-bit little-endian."""
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files lie; nothing of them is copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *columns)


