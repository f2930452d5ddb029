"""Enrichment by batches against a full run over the same documents."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import enrich, graph
from lectern.plans import registry
from lectern.plans.context_queries import with_variants


@pytest.fixture(scope="module")
def given(spark, sf):
    lib = registry.library(spark, sf)
    docs = lib.documents.where("num < 60").withColumn("metadata", F.lit("{}")).cache()
    variants = with_variants(lib).withColumn("doc", F.col("doc") % 60).cache()  # a variant stands in its chunk's document or another
    return docs, lib.relations.cache(), lib.chunks.join(docs.select("doc_id"), "doc_id", "left_semi").cache(), variants


def edges(spark, path):
    found = enrich.stored_relations(spark, path).where("relation_type in ('similar_to', 'same_topic')").collect()
    out = {(r.relation_type, r.src_doc_id, r.dst_doc_id): r.metadata for r in found}
    assert len(out) == len(found)
    return out


def run(given, part, path, number, s, batch=None, vectors=None):
    docs, relations, chunks, variants = given
    now = docs.where(part)
    ids = now.select("doc_id")
    variants = variants if vectors is None else vectors
    own = variants.join(ids, variants["doc"].cast("string") == ids["doc_id"], "left_semi")
    report = enrich.stored_run(now, graph.edge_set(relations, ids), chunks.join(ids, "doc_id", "left_semi"), own, s, path, run=number, batch=batch and docs.where(batch).select("doc_id"))
    return {r.step: r.error for r in report.collect()}


S = enrich.Settings(min_similarity=0.1, min_jaccard=0.2, exact=True, neighbours=2, max_iter=2)


def test_batches_equal_a_full_run(spark, given, tmp_path):
    """Three batches, one of them repeated under its number, then one that comes again under a new one."""
    path, whole = str(tmp_path / "grown"), str(tmp_path / "whole")
    run(given, "num < 60", whole, 0, S)
    want = edges(spark, whole)
    assert {t for t, _, _ in want} == {"similar_to", "same_topic"} and len(want) > 60
    run(given, "num < 25", path, 0, S, "num < 25")
    for _ in range(2):
        assert not any(run(given, "num < 45", path, 1, S, "num between 25 and 44").values())
    half = str(tmp_path / "half")
    run(given, "num < 45", half, 0, S)
    assert edges(spark, path) == edges(spark, half)
    assert not any(run(given, "num < 60", path, 2, S, "num >= 45").values())
    assert edges(spark, path) == want
    run(given, "num < 60", path, 3, S, "num between 20 and 30")
    assert edges(spark, path) == want


def test_a_failed_step_is_made_up_for(spark, given, tmp_path):
    path, whole = str(tmp_path / "grown"), str(tmp_path / "whole")
    run(given, "num < 40", whole, 0, S)
    broken = given[3].withColumn("tokens", F.raise_error(F.lit("no vectors")).cast("array<array<float>>"))
    run(given, "num < 20", path, 0, S, "num < 20")
    errors = run(given, "num < 30", path, 1, S, "num between 20 and 29", broken)
    assert errors["similar_to"] and not errors["same_topic"]
    run(given, "num < 40", path, 2, S, "num >= 30")
    assert edges(spark, path) == edges(spark, whole)


def test_a_document_that_comes_again_with_other_vectors(spark, given, tmp_path):
    path, whole = str(tmp_path / "grown"), str(tmp_path / "whole")
    docs, relations, chunks, variants = given
    other = variants.withColumn("tokens", F.when(F.col("doc") == 7, F.transform("tokens", lambda t: F.reverse(t))).when(F.col("doc") == 9, F.lit(None)).otherwise(F.col("tokens")))
    run(given, "num < 40", path, 0, S, "num < 40")
    run(given, "num < 40", path, 1, S, "num in (7, 9)", other)
    run(given, "num < 40", whole, 0, S, vectors=other)
    assert edges(spark, path) == edges(spark, whole)
