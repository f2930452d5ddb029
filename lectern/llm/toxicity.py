"""Toxicity (9): multiple-instance learning of sentence scores from document labels.

A document is a bag of sentences. Each sentence has a logistic score from its words; the document's is their noisy-or,
1 - prod(1 - s). Only documents are labelled, so the weights are fitted through the noisy-or, and afterwards a sentence
with a high score is where the offence lies. A word counts by its whole form and by its first 3 to 6 letters.

Fitting uses at most ``fit_docs`` labelled rows (the lowest hashes of doc_id outside the held-out fifth). Spark counts
the features of that sample by label; the ``features`` most telling ones (likelihood ratio) are kept, the sample's bags
are reduced to them, and gradient descent runs on what is left, a few bytes a document. Scoring covers every whole
text, with the weights (bounded by ``features``) in each task. Labels, language, source and doc_id never enter a score.

Defined cases: null and empty texts have no sentence and score the fitted rate of such a bag (0 sentences: score 0);
rows with a null doc_id are scored but not learned from and not held out; a doc_id labelled twice is toxic if either
label says so; labels of null teach nothing; without both kinds of label every score is the sample's rate; repeated rows
score alike; other columns are ignored; an empty table gives no row; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut

words_or_ends = re.compile(r"[^\W_]+|[.!?\n]").findall
PREFIXES = (3, 4, 5, 6)
ENDS = frozenset(".!?\n")


def features(word: str) -> list[str]:
    """The whole word and its longer word starts."""
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence that has any, in lower case."""
    found: list[list[str]] = [[]]
    for w in words_or_ends((text or "").lower()):
        if w in ENDS:
            if found[-1]:
                found.append([])
        else:
            found[-1].append(w)
    return found if found[-1] else found[:-1]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, fit_docs: int) -> DataFrame:
    """(text, toxic) of at most ``fit_docs`` labelled rows outside the held-out fifth."""
    marked = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def telling_features(sample: DataFrame, most: int, least: int) -> dict[str, float]:
    """The features whose document counts by label differ most, with their smoothed log odds."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: tuple[Counter, Counter] = Counter(), Counter()
        for frame in frames:
            for t, y in zip(frame["text"], frame["toxic"]):
                own = set()
                for w in {w for s in sentences(t) for w in s}:
                    own.update(features(w))
                by[y].update(own)
        names = list(by[0].keys() | by[1].keys())
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pd.DataFrame({"feature": part, "clean": [by[0][f] for f in part], "toxic": [by[1][f] for f in part]})

    whole = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = whole.get(0, 0), whole.get(1, 0)
    if not n0 or not n1:
        return {}
    seen = sample.mapInPandas(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b")).where(F.col("a") + F.col("b") >= least)
    p, q = (F.col("a") + 0.5) / (n0 + 1.0), (F.col("b") + 0.5) / (n1 + 1.0)
    ratio = F.col("b") * F.log(q / p) + (n1 - F.col("b")) * F.log((1 - q) / (1 - p))
    top = seen.select("feature", F.log(q / p).alias("odds"), F.abs(ratio).alias("g")).orderBy(F.desc("g"), "feature").limit(most).collect()
    return {r.feature: r.odds for r in top}


def reduced_bags(sample: DataFrame, names: dict[str, int]) -> DataFrame:
    """(toxic, plain, times, sizes, features): a document's sentences by the known features they hold.

    Sentences without any are counted in ``plain``; equal ones are told once, with how often they occur. The three lists
    are arrays of unsigned integers in bytes, so a document takes a few bytes for each distinct offending sentence.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for t, y in zip(frame["text"], frame["toxic"]):
                kinds = Counter(tuple(sorted(names[f] for w in s for f in features(w) if f in names)) for s in sentences(t))
                plain = kinds.pop((), 0)
                told = sorted(kinds)
                lists = ([kinds[k] for k in told], [len(k) for k in told], [f for k in told for f in k])
                out.append((int(y), plain, *[np.array(x, kind).tobytes() for x, kind in zip(lists, ("<u4", "<u4", "<u2"))]))
            yield pd.DataFrame(out, columns=["toxic", "plain", "times", "sizes", "features"])

    return sample.mapInPandas(run, "toxic int, plain long, times binary, sizes binary, features binary")


class Bags:
    """Labelled documents as rows of ``reduced_bags``; the loss of weights on them and its slope."""

    def __init__(self, rows: list) -> None:
        read = lambda name, kind: [np.frombuffer(r[name], kind).astype(np.int64) for r in rows]
        times, sizes = read("times", "<u4"), read("sizes", "<u4")
        self.y = np.array([r["toxic"] for r in rows], np.float64)
        #: Each document's first sentence kind is the one without known features.
        self.doc = np.repeat(np.arange(len(rows)), [len(t) + 1 for t in times])
        self.times = np.concatenate([np.concatenate([[r["plain"]], t]) for r, t in zip(rows, times)]).astype(np.float64)
        lengths = np.concatenate([np.concatenate([[0], n]) for n in sizes])
        self.at = np.repeat(np.arange(len(lengths)), lengths)
        self.own = np.concatenate(read("features", "<u2"))

    def loss_and_slope(self, x: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
        """Mean log loss of the noisy-or plus decay / 2 times the squared weights, and the derivative; x ends with the bias."""
        n = len(self.y)
        s = 1 / (1 + np.exp(-np.clip(np.bincount(self.at, x[self.own], minlength=len(self.times)) + x[-1], -30, 30)))
        clear = np.bincount(self.doc, self.times * np.log1p(-s), minlength=n)  # log of the chance that no sentence offends
        p = np.clip(-np.expm1(clear), 1e-9, 1.0)
        loss = -np.where(self.y == 1, np.log(p), clear).mean() + decay / 2 * (x[:-1] ** 2).sum()
        # by a sentence's logit: s for clean documents, -s (1 - p) / p for toxic ones
        pull = np.where(self.y == 1, -np.exp(clear) / p, 1.0)
        g = pull[self.doc] * s * self.times / n
        return loss, np.concatenate([np.bincount(self.own, g[self.at], minlength=len(x) - 1) + decay * x[:-1], [g.sum()]])


class Model:
    """Word weights and the bias of a sentence's logit; the noisy-or of a document's sentences."""

    def __init__(self, weights: dict[str, float], bias: float, rate: float | None = None) -> None:
        self.weights, self.bias, self.rate = weights, bias, rate
        self.memo: dict[str, float] = {}

    def word(self, w: str) -> float:
        x = self.memo.get(w)
        if x is None:
            if len(self.memo) >= 500_000:
                self.memo.clear()
            get = self.weights.get
            x = self.memo[w] = sum(get(f, 0.0) for f in features(w))
        return x

    def sentence_scores(self, text: str | None) -> list[float]:
        out, logit, any_word, word, memo = [], self.bias, False, self.word, self.memo
        for w in words_or_ends((text or "").lower()):
            if w in ENDS:
                if any_word:
                    out.append(logit)
                    logit, any_word = self.bias, False
            else:
                x = memo.get(w)
                logit += word(w) if x is None else x
                any_word = True
        if any_word:
            out.append(logit)
        return [1 / (1 + math.exp(-max(-50.0, min(50.0, x)))) for x in out]

    def document(self, scores: list[float]) -> float:
        if self.rate is not None:
            return self.rate
        return -math.expm1(sum(math.log1p(-min(s, 1 - 1e-15)) for s in scores))


def fitted(sample: DataFrame, features_kept: int, least: int, rounds: int, decay: float) -> Model:
    odds = telling_features(sample, features_kept, least)
    if not odds:
        y = sample.agg(F.avg("toxic")).first()[0]
        return Model({}, 0.0, float(y or 0.0))
    names = {f: i for i, f in enumerate(odds)}
    bags = Bags(reduced_bags(sample, names).collect())  # a short row for each of at most fit_docs documents
    x = np.concatenate([np.clip(np.array(list(odds.values())), -1, 2) * 0.2, [-6.0]])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        slope = bags.loss_and_slope(x, decay)[1]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return Model({f: float(x[i]) for f, i in names.items() if abs(x[i]) > 1e-3}, float(x[-1]))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = 12_000, features_kept: int = 256, least: int = 5, rounds: int = 400, decay: float = 1e-5) -> Model:
    """Sentence weights whose noisy-or over each labelled document best explains its label.

    The defaults are those that ``inner_losses`` ranks first on the given data.
    """
    return fitted(cut(fit_sample(docs, labels, fit_docs)), features_kept, least, rounds, decay)


def inner_losses(docs: DataFrame, labels: DataFrame, settings: list[dict], fit_docs: int = 12_000) -> list[tuple[float, dict]]:
    """(log loss, setting) in rising order, each fitted on four fifths of the training rows and measured on the other fifth.

    The held-out fifth takes no part, so a setting chosen here leaves it unseen.
    """
    sample = cut(fit_sample(docs, labels, fit_docs).withColumn("inner", F.crc32(F.concat(F.lit("inner"), F.md5("text"))) % 5 == 0))
    found = []
    for setting in settings:
        given = {"features_kept": 256, "least": 5, "rounds": 400, "decay": 1e-5} | setting
        model = fitted(sample.where("not coalesce(inner, false)").select("text", "toxic"), **given)
        p = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-6)), F.lit(1e-6))
        scored = sample.where("inner").select("toxic", score_column(model)["score"].alias("p"))
        found.append((scored.agg(F.avg(-F.log(F.when(F.col("toxic") == 1, p).otherwise(1 - p)))).first()[0], setting))
    return sorted(found, key=lambda x: x[0])


def score_column(model: Model, threshold: float = 0.5):
    """A column of (score, offending), offending listing the sentences at or above ``threshold`` by number and score."""
    weights, bias, rate = model.weights, model.bias, model.rate

    @F.pandas_udf("score double, offending array<struct<sentence: int, score: double>>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(weights, bias, rate)
        for part in texts:
            out = []
            for t in part:
                scores = own.sentence_scores(t)
                out.append((own.document(scores), [{"sentence": i, "score": s} for i, s in enumerate(scores) if s >= threshold]))
            yield pd.DataFrame(out, columns=["score", "offending"])

    return of(F.col("text"))


def score_documents(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """(doc_id, held_out, score, predicted, offending) of every row."""
    model = fit(docs, labels, **parameters)
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(model).alias("s"))
    return scored.select("doc_id", "held_out", F.col("s.score").alias("score"), (F.col("s.score") >= 0.5).cast("int").alias("predicted"), F.col("s.offending").alias("offending"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
