"""Token counts (10): byte-pair merging with a heap over a linked list, counting merges instead of emitting ids.

A text's units (words with their leading spaces) start as characters in a linked list. The adjacent pairs that form a
piece wait in a heap by rank; the lowest rank is popped, ties to the left, and joined if both halves are still as they
were pushed. A unit's count is its initial symbols minus its merges, with the bytes of characters outside the vocabulary
counted one by one (byte fallback). Units are cut only between characters that no piece holds side by side, so no merge
could have crossed a cut. Each worker remembers the counts of short units it has met, up to ``memo`` of them.

Defined cases: null and empty texts have no byte and no token; repeated rows count alike; other columns are ignored; an
empty table gives no row; texts and units of any length are counted whole (heap work is n log n).
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bytes_of
from lectern.llm.encoding import documents, tokenizer_path

SPACE = "▁"


class PieceCounter:
    """Counts the pieces of a sentencepiece BPE model with an identity normaliser."""

    def __init__(self, path: str, memo: int = 800_000) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.encode("a  b", out_type=str)[-1] != SPACE + "b" or model.encode("Ａ", out_type=str)[-1] == "A":
            raise ValueError("the model normalises its input")
        usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in usable}
        self.fallback = any(model.is_byte(i) for i in range(model.get_piece_size()))
        self.pairs = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        self.limit = memo
        self.known: dict[str, int] = {}
        if any(x[0] != SPACE and x[1] == SPACE for x in self.pairs):
            raise ValueError("pieces cross word starts")

    def merged(self, unit: str) -> int:
        """Tokens of one unit: initial symbols minus merges, bytes for characters that stay outside the vocabulary."""
        n, rank = len(unit), self.rank
        text = list(unit)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(unit[i : i + 2])
            if r is not None:
                heap.append((r, i, 2))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, size = heapq.heappop(heap)
            left = text[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or len(left) + len(text[j]) != size:
                continue
            whole = left + text[j]
            text[i], text[j] = whole, None
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(whole + text[k])
                if r is not None:
                    heapq.heappush(heap, (r, i, len(whole) + len(text[k])))
            h = before[i]
            if h >= 0:
                r = rank.get(text[h] + whole)
                if r is not None:
                    heapq.heappush(heap, (r, h, len(text[h]) + len(whole)))
        symbols = n
        if self.fallback:
            symbols += sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in text if c is not None and len(c) == 1 and c not in rank)
        return symbols - merges

    def unit(self, unit: str) -> int:
        """Tokens of a word with its leading spaces, cut where no piece could join."""
        pairs, total, start = self.pairs, 0, 0
        for k in range(1, len(unit)):
            if unit[k - 1 : k + 1] not in pairs:
                total += self._part(unit[start:k])
                start = k
        return total + self._part(unit[start:])

    def _part(self, part: str) -> int:
        if len(part) == 1:
            return 1 if part in self.rank or not self.fallback else len(part.encode("utf-8", "surrogatepass"))
        if len(part) > 64:
            return self.merged(part)
        n = self.known.get(part)
        if n is None:
            if len(self.known) >= self.limit:
                self.known.clear()
            n = self.known[part] = self.merged(part)
        return n

    def count(self, text: str | None) -> int:
        """Tokens of a text; a space is put before it, as the model does."""
        if not text:
            return 0
        known, total = self.known, 0
        marked = SPACE + text.replace(" ", SPACE)
        for word in units(marked):
            n = known.get(word)
            if n is None:
                n = self.unit(word)
                if len(word) <= 64:
                    if len(known) >= self.limit:
                        known.clear()
                    known[word] = n
            total += n
        return total


#: A run of word marks with what follows it; text before the first mark stands alone.
units = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, model: str, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        c = counter(model)
        return pd.Series([c.count(t) for t in texts], dtype="int64")

    return docs.select("doc_id", bytes_of("text").alias("n_bytes"), tokens(F.col("text")).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), limit=4096)
