"""Each pipeline stage on small tables, and the registered queries on the smallest given ones."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import queries
from lectern.llm.encoding import tokenizer_path
from lectern.llm.toxicity import fit

from .test_operators import groups, rows, shingles, slow_score, table


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def edge_rows(spark):
    """Rows with nulls, empties, ties and repeats, and with columns named like private ones."""
    texts = [*rows(), rows()[8], None]
    ids = [*range(len(rows())), 8, None]
    names = {"__n": "'n'", "__digest": "'d'", "__toxicity": "1.5", "__gone": "'g'", "__doc": "2", "__lines": "'l'", "__removed": "'r'"}
    return table(spark, texts, ids).selectExpr("*", *(f"{v} as {k}" for k, v in names.items())), list(zip(ids, texts))


def counted(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(name, spark, sf):
    docs, given = edge_rows(spark)
    whole = Counter((d, t) for d, t in given)
    out = stage(name)(spark, docs, sf)
    if name == "packing":
        tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
        want = Counter()
        for d, t in given:
            want[d] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
        assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == dict(want)
    else:
        assert out.columns == docs.columns
        private = [c for c in docs.columns if c.startswith("__")]
        got = counted(out, "doc_id", "text")
        if name == "toxicity":
            model = fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"))
            score = lambda t: slow_score(t, model.weights, model.bias) if model.rate is None else model.rate
            assert got == Counter({k: n for k, n in whole.items() if score(k[1]) < 0.5})
        elif name in ("line_dedup", "decontamination"):  # fewer than ten sources, so no boilerplate; no benchmark item
            assert got == whole
        else:
            sets = {i: shingles(t) for i, (_, t) in enumerate(given)}
            near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) if sets[a] | sets[b] else True
            label = groups(list(sets), near)
            best = {}
            for i, g in label.items():
                key = (given[i][0] is None, given[i][0] or 0)
                best[g] = min(best.get(g, key), key)
            assert Counter(r.doc_id for r in out.collect()) == Counter(None if k[0] else k[1] for k in best.values())
        assert len(counted(out, *private)) == 1 and next(iter(counted(out, *private))) == tuple(docs.select(*private).first())
    assert stage(name)(spark, docs.where("false"), sf).collect() == []


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    toxic = "The idiot said so. What a moron and a clown, worthless scum. " * 3
    more = spark.createDataFrame([(9001, toxic), (9002, "zq " + item + " end"), (9003, "lone words here")], "doc_id long, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    much = sf.replace("sf0.001", "sf0.1")  # labels enough to learn from
    large = spark.read.parquet(f"{much}/documents.parquet").unionByName(more.withColumn("doc_id", F.col("doc_id") + 10**6), allowMissingColumns=True)
    kept = {r.doc_id for r in stage("toxicity")(spark, large, much).select("doc_id").collect()}
    assert 1009001 not in kept and 1009003 in kept and len(kept) > 0.85 * large.count()
    kept = {r.doc_id for r in stage("decontamination")(spark, both, sf).select("doc_id").collect()}
    assert 9002 not in kept and 9003 in kept
    unique = stage("near_dedup")(spark, both, sf)
    assert unique.count() == unique.select("doc_id").distinct().count() < both.count()


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(name, spark, sf):
    found = queries.queries()[name](spark, sf).toPandas()
    assert len(found) or name.startswith("op5")
    sql = queries.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
        want = con.execute(sql).df()[list(found.columns)]
        order = list(found.columns)
        assert found.sort_values(order).values.tolist() == want.sort_values(order).values.tolist()
