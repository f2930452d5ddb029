"""Page structure analytics (B)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element kinds with their id fields, chunk element types, limits, default page height.
KINDS = {"headings": None, "tables": "table_id", "pictures": "picture_id", "code_blocks": None, "formulas": None}
ELEMENT_TYPES = ["text", "list_item", "table_cell", "caption", "code", "formula"]
STRUCTURE_LIMIT, METADATA_LIMIT = 200 * 1024, 50 * 1024
PAGE_HEIGHT = 792.0


def page_elements(structure: str, page: Column) -> Column:
    """The structure with only the elements of one page (B-01)."""
    return F.struct(*[F.filter(F.col(f"{structure}.{k}"), lambda x: x["page"] == page).alias(k) for k in KINDS])


def flattened(rows: DataFrame, key: list[str], structure: str = "structure") -> DataFrame:
    """(key, kind, idx, element_id, page, bbox): one row for each element with a box (B-02)."""
    out = []
    for kind, ident in KINDS.items():
        name = kind.rstrip("s")
        exploded = rows.select(*key, F.posexplode(f"{structure}.{kind}").alias("idx", "x"))
        own = F.coalesce(F.when(F.col(f"x.{ident}") != "", F.col(f"x.{ident}")) if ident else F.lit(None), F.concat(F.lit(f"{name}-"), F.col("idx").cast("string")))
        out.append(exploded.select(*key, F.lit(name).alias("kind"), "idx", own.alias("element_id"), "x.page", "x.bbox"))
    return reduce(DataFrame.unionByName, out).where("bbox is not null")


def flipped(y: Column, height: Column | None = None) -> Column:
    """A bottom-left y as seen from the top (B-03)."""
    return (height if height is not None else F.lit(PAGE_HEIGHT)) - y


def scaled(df: DataFrame, width: Column, height: Column, shown_width: Column, shown_height: Column, least: float = 0.0) -> DataFrame:
    """Boxes x1, y1, x2, y2 in display units, clamped, at least ``least`` wide and high (B-04).

    ``problem`` tells of dimensions that are not positive; such rows have no display box.
    """
    sx, sy = (F.try_divide(a, b) for a, b in ((shown_width, width), (shown_height, height)))
    clamp = lambda c, most: F.greatest(F.lit(0.0), F.least(c, most.cast("double")))
    bad = lambda a, b, name: F.when(~F.coalesce((a > 0) & (b > 0), F.lit(False)), F.concat(F.lit(f"invalid {name} dimensions: "), F.coalesce(a.cast("string"), F.lit("none")), F.lit("x"), F.coalesce(b.cast("string"), F.lit("none"))))
    out = df.withColumn("problem", F.coalesce(bad(width, height, "original"), bad(shown_width, shown_height, "displayed")))
    for c, s, most in (("x1", sx, shown_width), ("y1", sy, shown_height), ("x2", sx, shown_width), ("y2", sy, shown_height)):
        out = out.withColumn(f"s{c}", F.when(F.col("problem").isNull(), clamp(F.col(c) * s, most)))
    size = lambda a, b: F.when(F.col("problem").isNull(), F.greatest(F.col(b) - F.col(a), F.lit(least)))
    return out.withColumn("shown_w", size("sx1", "sx2")).withColumn("shown_h", size("sy1", "sy2"))


def box_problem(width: Column, height: Column) -> Column:
    """The first reason why a box x1, y1, x2, y2 is invalid, null if there is none (B-05)."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    finite = reduce(Column.__and__, [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in (x1, y1, x2, y2)])
    return (
        F.when(~finite, "coordinates must be finite")
        .when((x1 < 0) | (y1 < 0) | (x2 < 0) | (y2 < 0), "coordinates must be non-negative")
        .when(x2 <= x1, "invalid width")
        .when(y2 <= y1, "invalid height")
        .when((width <= 0) | (height <= 0), "dimensions must be positive")
        .when((x1 >= width) | (y1 >= height), "starts outside bounds")
        .when((x2 > width) | (y2 > height), "extends outside bounds")
    )


SMALL_PAGE = 16  # boxes up to which a page is one tile


def tile_sizes(elements: DataFrame, key: list[str]) -> DataFrame:
    """(key, tile_w, tile_h): a page's tiles are as wide and high as its boxes on average, at least a page's part in the root of their number.

    So a box lies on few tiles on average, and none on more than about as many as the page has boxes. Pages of up to 16
    boxes are one tile (null sizes).
    """
    n = F.count("*")
    side = lambda a, b: F.greatest(F.avg(F.col(b) - F.col(a)), (F.max(b) - F.min(a)) / F.sqrt(n))
    sized = elements.groupBy(*key).agg(n.alias("n"), side("x1", "x2").alias("w"), side("y1", "y2").alias("h"))
    told = lambda c: F.when((F.col("n") > SMALL_PAGE) & (F.col(c) > 0) & (F.col(c) < float("inf")), F.col(c))
    return sized.select(*key, told("w").alias("tile_w"), told("h").alias("tile_h"))


def tile(at: Column, size: str) -> Column:
    return F.coalesce(F.floor(at / F.col(size)), F.lit(0).cast("long"))


def on_tiles(elements: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """``elements`` once for each tile (tx, ty) of their page that they touch, with the page's tile sizes."""
    dealt = elements.join(sizes, key)
    return dealt.withColumn("tx", F.explode(F.sequence(tile(F.col("x1"), "tile_w"), tile(F.col("x2"), "tile_w")))).withColumn("ty", F.explode(F.sequence(tile(F.col("y1"), "tile_h"), tile(F.col("y2"), "tile_h"))))


def finite_boxes(elements: DataFrame) -> DataFrame:
    """Boxes with four finite coordinates in order; the others hold and overlap nothing."""
    corners = [F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]
    ok = reduce(Column.__and__, [~F.isnan(c) & (F.abs(c) < float("inf")) for c in corners])
    return elements.where(ok & (F.col("x1") <= F.col("x2")) & (F.col("y1") <= F.col("y2")))


def overlaps(elements: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of a page's elements that intersect, with area and intersection over union (B-06).

    Boxes meet on the tiles of their page, so a page of very many boxes is many small joins; of the tiles that two share
    the one with the upper left corner of their intersection reports them. Elements are told apart by ``element``, which is
    unique on a page. Boxes without area, with null or infinite coordinates or on a page of null key overlap nothing.
    """
    boxes = finite_boxes(elements.select(*key, "element", "x1", "y1", "x2", "y2")).where("x1 < x2 and y1 < y2")
    dealt = on_tiles(boxes, tile_sizes(boxes, key), key)
    own = ("element", "x1", "y1", "x2", "y2")
    a = dealt.select(*key, "tx", "ty", "tile_w", "tile_h", *[F.col(c).alias(f"a_{c}") for c in own])
    b = dealt.select(*key, "tx", "ty", *[F.col(c).alias(f"b_{c}") for c in own])
    left, upper = F.greatest("a_x1", "b_x1"), F.greatest("a_y1", "b_y1")
    w, h = F.least("a_x2", "b_x2") - left, F.least("a_y2", "b_y2") - upper
    area = lambda p: (F.col(f"{p}_x2") - F.col(f"{p}_x1")) * (F.col(f"{p}_y2") - F.col(f"{p}_y1"))
    met = (F.col("a_element") < F.col("b_element")) & (w > 0) & (h > 0) & (tile(left, "tile_w") == F.col("tx")) & (tile(upper, "tile_h") == F.col("ty"))
    both = a.join(b, [*key, "tx", "ty"]).where(met).withColumn("w", w).withColumn("h", h)
    common = F.col("w") * F.col("h")
    return both.select(*key, "a_element", "b_element", common.alias("intersection"), (common / (area("a") + area("b") - common)).alias("iou"))


def clicked(clicks: DataFrame, elements: DataFrame, key: list[str]) -> DataFrame:
    """Clicks (click_id, key, x, y) with the elements that hold them, edges included (B-07).

    A click meets only the boxes on its tile. Clicks without a place and boxes with null or infinite coordinates give no row.
    """
    boxes = finite_boxes(elements.select(*key, "element", "x1", "y1", "x2", "y2"))
    sizes = tile_sizes(boxes, key)
    placed = clicks.select("click_id", *key, "x", "y").where("x is not null and y is not null").join(sizes, key)
    at = placed.select("click_id", *key, "x", "y", tile(F.col("x"), "tile_w").alias("tx"), tile(F.col("y"), "tile_h").alias("ty"))
    held = on_tiles(boxes, sizes, key).select(*key, "tx", "ty", "element", "x1", "y1", "x2", "y2")
    return at.join(held, [*key, "tx", "ty"]).where("x between x1 and x2 and y between y1 and y2").select("click_id", *key, "element")


def structure_rules(structure: str) -> dict[str, Column]:
    s = lambda c: F.col(f"{structure}.{c}")
    return {
        "heading pages positive": F.forall(s("headings"), lambda x: x["page"] > 0),
        "heading texts not blank": F.forall(s("headings"), lambda x: F.trim(x["text"]) != ""),
        "table rows and columns not negative": F.forall(s("tables"), lambda x: (x["rows"] >= 0) & (x["cols"] >= 0)),
        "picture confidence between 0 and 1": F.forall(s("pictures"), lambda x: (x["confidence"] >= 0) & (x["confidence"] <= 1)),
        "structure below limit": F.octet_length(F.to_json(F.col(structure))) < STRUCTURE_LIMIT,
    }


def context_rules(context: str) -> dict[str, Column]:
    c = lambda n: F.col(f"{context}.{n}")
    return {
        "heading level between 0 and 10": c("parent_heading_level").between(0, 10),
        "section path below 500": F.length(c("section_path")) < 500,
        "known element type": c("element_type").isin(ELEMENT_TYPES),
        "page numbers positive": F.forall(c("page_nums"), lambda p: p > 0),
    }


def metadata_size(json: Column) -> Column:
    """struct(bytes, within) of a JSON text (B-10)."""
    return F.struct(F.octet_length(json).alias("bytes"), (F.octet_length(json) < METADATA_LIMIT).alias("within"))


def context_projection(context: Column, page: Column) -> Column:
    """Context with fallbacks: a section path given as list is joined, page numbers default to the chunk's page (B-11)."""
    parsed = F.from_json(context, "parent_heading string, section_path string, page_nums array<int>")
    listed = F.from_json(context, "section_path array<string>")
    path = F.coalesce(F.array_join(listed["section_path"], " > "), parsed["section_path"])
    return F.struct(parsed["parent_heading"].alias("parent_heading"), path.alias("section_path"), F.coalesce(parsed["page_nums"], F.array(page.cast("int"))).alias("page_nums"))
