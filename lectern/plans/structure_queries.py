"""Registered page structure queries (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import structure as ops
from lectern.operators.jobs import violations
from lectern.plans.registry import query
from lectern.sources.schemas import CONTEXT, STRUCTURE


def _structures(lib):
    """Structures of pages: headings and pictures from line items."""
    li = lib.given("lineitem")
    box = F.array("l_quantity", F.col("l_linenumber") * F.lit(20.0), F.col("l_quantity") + 30, F.col("l_linenumber") * F.lit(20.0) + 25)
    heads = F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("text"), (F.col("l_linenumber") - 1).alias("page"), F.col("l_discount").alias("d"), box.alias("bbox"))))
    g = li.groupBy("l_orderkey").agg(heads.alias("h"))
    json = F.to_json(
        F.struct(
            F.transform("h", lambda x: F.struct(x["text"].alias("text"), F.lit(1).alias("level"), x["page"].alias("page"), x["bbox"].alias("bbox"))).alias("headings"),
            F.transform("h", lambda x: F.struct(x["page"].alias("page"), F.lit("chart").alias("type"), (x["d"] * 15).alias("confidence"), F.concat(F.lit("p"), x["n"].cast("string")).alias("picture_id"), x["bbox"].alias("bbox"))).alias("pictures"),
        )
    )
    return g.select("l_orderkey", F.from_json(json, STRUCTURE).alias("structure"))


@query("B01_page_elements", "SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber = 3) AS n FROM lineitem GROUP BY l_orderkey")
def _(lib):
    return _structures(lib).select("l_orderkey", ops.page_elements("structure", F.lit(2)).alias("s")).select("l_orderkey", F.size("s.headings").cast("long").alias("n"))


@query("B02_flattened", "SELECT l_orderkey, 'heading' AS kind, NULL AS element_id, l_linenumber - 1 AS page FROM lineitem UNION ALL SELECT l_orderkey, 'picture', 'p' || l_linenumber, l_linenumber - 1 FROM lineitem")
def _(lib):
    return ops.flattened(_structures(lib), ["l_orderkey"]).select("l_orderkey", "kind", F.when(F.col("kind") == "picture", F.col("element_id")).alias("element_id"), "page")


@query("B03_flip", "SELECT page, element, 792.0 - y2 AS top, 792.0 - y1 AS bottom FROM lib_elements")
def _(lib):
    return lib.elements.select("page", "element", ops.flipped(F.col("y2")).alias("top"), ops.flipped(F.col("y1")).alias("bottom"))


@query("B04_scale", "SELECT page, element, round(least(x1 * 300.0 / 612, 300), 6) AS sx1, round(least(y2 * 400.0 / 792, 400), 6) AS sy2, round(greatest(least(x2 * 300.0 / 612, 300) - least(x1 * 300.0 / 612, 300), 20), 6) AS shown_w FROM lib_elements")
def _(lib):
    s = ops.scaled(lib.elements, F.lit(612), F.lit(792), F.lit(300), F.lit(400), least=20.0)
    return s.select("page", "element", F.round("sx1", 6).alias("sx1"), F.round("sy2", 6).alias("sy2"), F.round("shown_w", 6).alias("shown_w"))


@query("B05_box_problems", "SELECT page, element, CASE WHEN x1 >= 60 OR y1 >= 130 THEN 'starts outside bounds' WHEN x2 > 60 OR y2 > 130 THEN 'extends outside bounds' END AS problem FROM lib_elements")
def _(lib):
    return lib.elements.select("page", "element", ops.box_problem(F.lit(60), F.lit(130)).alias("problem"))


@query(
    "B06_overlaps",
    """, p AS (SELECT a.page, a.element AS a_element, b.element AS b_element, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS w, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS h FROM lib_elements a JOIN lib_elements b ON a.page = b.page AND a.element < b.element)
SELECT page, a_element, b_element, round(w * h, 6) AS intersection, round(w * h / (1500 - w * h), 6) AS iou FROM p WHERE w > 0 AND h > 0""",
)
def _(lib):
    return ops.overlaps(lib.elements, ["page"]).select("page", "a_element", "b_element", F.round("intersection", 6).alias("intersection"), F.round("iou", 6).alias("iou"))


@query("B07_clicked", ", c AS (SELECT event_id AS click_id, user_id AS page, value AS x, CAST(event_id % 160 AS DOUBLE) AS y FROM events) SELECT c.click_id, c.page, e.element FROM c JOIN lib_elements e ON c.page = e.page WHERE x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2")
def _(lib):
    clicks = lib.given("events").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("page"), F.col("value").alias("x"), (F.col("event_id") % 160).cast("double").alias("y"))
    return ops.clicked(clicks, lib.elements, ["page"])


@query("B08_structure_rules", "SELECT l_orderkey, 'heading pages positive' AS rule FROM lineitem WHERE l_linenumber = 1 UNION SELECT l_orderkey, 'picture confidence between 0 and 1' FROM lineitem WHERE l_discount * 15 > 1")
def _(lib):
    return violations(_structures(lib), ["l_orderkey"], ops.structure_rules("structure"))


@query("B09_context_rules", "SELECT id, 'heading level between 0 and 10' AS rule FROM lib_chunks WHERE pos > 10 UNION ALL SELECT id, 'known element type' FROM lib_chunks WHERE word_count % 2 = 1 UNION ALL SELECT id, 'page numbers positive' FROM lib_chunks WHERE pos = 0")
def _(lib):
    c = F.struct(F.col("pos").alias("parent_heading_level"), "section_path", F.when(F.col("word_count") % 2 == 1, "other").otherwise("text").alias("element_type"), F.array("pos").alias("page_nums"))
    rows = lib.chunks.select("id", F.from_json(F.to_json(c), CONTEXT).alias("context"))
    return violations(rows, ["id"], ops.context_rules("context"))


@query("B10_metadata_size", "SELECT id, CAST(strlen(text) AS INTEGER) AS bytes, strlen(text) < 51200 AS within FROM lib_chunks")
def _(lib):
    return lib.chunks.select("id", ops.metadata_size(F.col("text")).alias("m")).select("id", "m.bytes", "m.within")


@query("B11_context_projection", "SELECT id, parent_heading, section_path, CAST(page_num AS VARCHAR) AS pages FROM lib_chunks")
def _(lib):
    as_list, as_text = F.to_json(F.struct("parent_heading", F.split("section_path", " > ").alias("section_path"))), F.to_json(F.struct("parent_heading", "section_path"))
    c = lib.chunks.withColumn("context", F.when(F.col("pos") % 2 == 0, as_list).otherwise(as_text))
    p = c.select("id", ops.context_projection(F.col("context"), F.col("page_num")).alias("p"))
    return p.select("id", "p.parent_heading", "p.section_path", F.array_join(F.transform("p.page_nums", lambda x: x.cast("string")), ",").alias("pages"))
