"""Research context assembly (C) for many queries at a time, keyed by query_id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import graph
from lectern.operators.library import details_url

# Limits, factors, visual patterns, prices per million tokens.
MAX_SOURCES, RELATED_TOP, SUPPLEMENTARY, SUPPLEMENTARY_FACTOR = 10, 5, 3, 0.3
SEPARATOR_TOKENS, IMAGE_TOKENS, IMAGE_TOKENS_LOW = 5, 1000, 85
VISUAL_SCORE, MIN_TWIN, MIN_COMPRESS = 9.0, 100, 400
IMAGE_FORMATS = ["png", "jpg", "jpeg", "gif", "webp"]
VISUAL_TYPES = ["table", "list_item", "picture", "figure"]
VISUAL_PATTERNS = [
    r"\bfigure\s+\d+\b",
    r"\btable\s+\d+\b",
    r"\bchart\b",
    r"\bdiagram\b",
    r"\bgraph\b",
    r"\bsee\s+(figure|table|chart|diagram)\b",
    r"\bas\s+shown\s+in\s+(figure|table|chart)\b",
    r"\bthe\s+(chart|diagram|graph)\s+shows\b",
    r"\bthe\s+(chart|diagram|graph)\s+illustrates\b",
]
PRICES = {
    "gpt-4-turbo": (10.0, 30.0),
    "gpt-3.5-turbo": (0.5, 1.5),
    "claude-3-opus-20240229": (15.0, 75.0),
    "claude-3-sonnet-20240229": (3.0, 15.0),
    "gemini-1.5-pro": (3.5, 10.5),
}


def ranked_hits(hits: DataFrame, most: int = MAX_SOURCES) -> DataFrame:
    """Best hit of each (query, doc, page), best first, at most ``most`` a query (C-01, C-02); the first of equals wins."""
    best = Window.partitionBy("query_id", "doc_id", "page_num").orderBy(F.desc("score"), "pos")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    return hits.withColumn("__n", F.row_number().over(best)).where("__n = 1").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("__n")


def with_metadata(sources: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Sources with what their page and document tell: file name, extension, time, section path and parent heading.

    Dropped where neither page nor document exists (C-03).
    """
    told = F.from_json("structure" if "structure" in pages.columns else F.lit(None).cast("string"), "section_path string, parent_heading string")
    p = pages.select("doc_id", "page_num", told["section_path"].alias("section_path"), told["parent_heading"].alias("parent_heading"), F.lit(True).alias("__page"))
    d = documents.select("doc_id", "filename", "format", F.col("created_at").alias("timestamp"), "markdown")
    joined = sources.join(p, ["doc_id", "page_num"], "left").join(d, "doc_id", "left")
    return joined.where(F.col("__page").isNotNull() | F.col("filename").isNotNull()).withColumn("filename", F.coalesce("filename", F.lit("unknown"))).drop("__page")


def page_text(markdown: str, page: str) -> Column:
    """A page's text by its '## Page N' marker, else estimated (C-04, C-05)."""
    m, n = F.col(markdown), F.col(page)
    mark = lambda k: F.concat(F.lit(r"(?i)##\s*Page\s*"), k.cast("string"), F.lit(r"\b"))
    at = F.regexp_instr(m, mark(n))
    rest = F.regexp_replace(F.substr(m, at), F.concat(F.lit("^"), mark(n)), F.lit(""))
    following = F.regexp_instr(rest, mark(n + 1))
    own = F.when(following > 0, F.substr(rest, F.lit(1), following - 1)).otherwise(rest)
    return F.when(F.coalesce(m, F.lit("")) == "", "").when(at > 0, F.regexp_replace(own, r"^\s+|\s+$", "")).otherwise(estimated_page(markdown, page))


def estimated_page(markdown: str, page: str) -> Column:
    """Short text whole; else three paragraphs a page, the last ones beyond the end; else 800-character slices (C-05)."""
    m, n = F.col(markdown), F.col(page).cast("int")
    paragraphs = F.filter(F.split(m, "\n\n"), lambda p: F.trim(F.regexp_replace(p, r"\s", "")) != "")
    own = F.slice(paragraphs, (n - 1) * 3 + 1, F.lit(3))
    last = F.slice(paragraphs, F.greatest(F.size(paragraphs) - 2, F.lit(1)), F.lit(3))
    sliced = F.when((n - 1) * 800 < F.length(m), F.substr(m, (n - 1) * 800 + 1, F.lit(800))).otherwise(F.substring(m, 1, 800))
    return F.when(F.length(m) < 1000, m).when(F.size(paragraphs) == 0, sliced).when(F.size(own) > 0, F.array_join(own, "\n\n")).otherwise(F.array_join(last, "\n\n"))


def with_twins(sources: DataFrame) -> DataFrame:
    """Visual hits followed by a text twin where their text is long enough (C-06)."""
    sides = F.when(F.col("is_visual") & (F.length("text") >= MIN_TWIN), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.col("is_visual")))
    return sources.withColumn("is_visual", F.explode(sides))


def ends(relations: DataFrame) -> DataFrame:
    """(doc_id, other, relation_type) in both directions."""
    r = relations.select(F.col("src_doc_id").alias("doc_id"), F.col("dst_doc_id").alias("other"), "relation_type")
    return r.unionByName(r.select(F.col("other").alias("doc_id"), F.col("doc_id").alias("other"), "relation_type"))


def related(sources: DataFrame, relations: DataFrame, top: int = RELATED_TOP) -> DataFrame:
    """(query_id, doc_id, related, relation_types) of each of the top sources (C-07).

    Neighbours stand in the order in which the source's relations, by source, target and type, first name them; types are
    those that first name a neighbour, in the same order.
    """
    held = sources.where(F.col("rank") <= top).select("query_id", "doc_id").distinct()
    own = F.struct("src_doc_id", "dst_doc_id", "relation_type")
    r = relations.select(own.alias("r"))
    both = r.select(F.col("r.src_doc_id").alias("doc_id"), F.col("r.dst_doc_id").alias("other"), "r").unionByName(r.select(F.col("r.dst_doc_id").alias("doc_id"), F.col("r.src_doc_id").alias("other"), "r"))
    first = held.join(both, "doc_id").groupBy("query_id", "doc_id", "other").agg(F.min("r").alias("r"))
    lists = first.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("r", "other"))).alias("l"))
    return lists.select("query_id", "doc_id", F.transform("l", lambda x: x["other"]).alias("related"), F.array_distinct(F.transform("l", lambda x: x["r"]["relation_type"])).alias("relation_types"))


def supplementary(sources: DataFrame, relations: DataFrame, most: int = SUPPLEMENTARY) -> DataFrame:
    """Neighbours that are no source yet: score is a share of the best parent's, at most ``most`` a query, page 1 (C-08)."""
    parents = sources.where(F.col("rank") <= RELATED_TOP).groupBy("query_id", "doc_id").agg(F.max("score").alias("parent"))
    near = parents.join(ends(relations), "doc_id").groupBy("query_id", F.col("other").alias("doc_id")).agg(F.max("parent").alias("parent"))
    fresh = near.join(sources.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("parent"), "doc_id")
    return fresh.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).select("query_id", "doc_id", F.lit(1).cast("long").alias("page_num"), (F.col("parent") * SUPPLEMENTARY_FACTOR).alias("score"))


def clustered(sources: DataFrame, relations: DataFrame) -> DataFrame:
    """Sources with their cluster of related sources; clusters by best score, then members by score (C-09)."""
    name = lambda c: F.concat(F.col("query_id").cast("string"), F.lit("|"), F.col(c))
    held = sources.select("query_id", "doc_id").distinct()
    inside = relations.join(held.withColumnRenamed("doc_id", "src_doc_id"), "src_doc_id").join(held.withColumnRenamed("doc_id", "dst_doc_id"), ["query_id", "dst_doc_id"])
    edges = inside.select(name("src_doc_id").alias("src_doc_id"), name("dst_doc_id").alias("dst_doc_id"))
    found = graph.connected_components(held.select(name("doc_id").alias("doc_id")), edges)
    joined = sources.withColumn("__v", name("doc_id")).join(found.select(F.col("doc_id").alias("__v"), F.col("component").alias("cluster")), "__v").drop("__v")
    top = F.max("score").over(Window.partitionBy("query_id", "cluster"))
    order = Window.partitionBy("query_id").orderBy(F.desc("cluster_score"), "cluster", F.desc("score"), "doc_id", "page_num")
    return joined.withColumn("cluster_score", top).withColumn("position", F.row_number().over(order))


def tokens(text: Column) -> Column:
    """A quarter of the characters (C-10)."""
    return F.floor(F.length(text) / 4)


def citation_block(number: Column) -> Column:
    """Numbered block of a source with a tag for visual ones (C-12)."""
    tag = F.when(F.col("is_visual"), "[Visual Match] ").otherwise("")
    body = F.regexp_replace("text", r"^\s+|\s+$", "")
    return F.concat(tag, F.lit("[Document "), number.cast("string"), F.lit(": "), F.col("filename"), F.lit(", Page "), F.col("page_num").cast("string"), F.lit("]\n"), body)


def within_budget(sources: DataFrame, budget: int) -> DataFrame:
    """The longest prefix by rank whose blocks and separators stay within the budget (C-11)."""
    spent = F.sum(tokens(F.col("block")) + SEPARATOR_TOKENS).over(Window.partitionBy("query_id").orderBy("rank"))
    return sources.withColumn("block", citation_block(F.col("rank"))).withColumn("spent", spent).where(F.col("spent") <= budget)


def context_document(sources: DataFrame, base: str = "http://localhost:3000") -> DataFrame:
    """(query_id, context): numbered blocks, then the source links, joined by blank lines (C-13, C-16)."""
    page = F.when(~F.col("format").isin("mp3", "wav"), F.col("page_num"))
    url = details_url("doc_id", page, F.col("chunk_id"), base)
    link = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.when(F.col("is_visual"), "[Visual Match] ").otherwise(""), F.col("filename"), F.lit(" "), url)
    rows = F.sort_array(F.collect_list(F.struct("rank", "block", link.alias("link"))))
    lists = sources.groupBy("query_id").agg(rows.alias("r"))
    part = lambda f: F.transform("r", lambda x: x[f])
    whole = F.concat(part("block"), F.array(F.lit("\n---\n"), F.lit("SOURCE LINKS:\n")), part("link"))
    return lists.select("query_id", F.array_join(whole, "\n\n").alias("context"))


def image_urls(sources: DataFrame, base: str, cap: int) -> DataFrame:
    """Absolute image URLs of visual sources in a supported format, the first ``cap`` a query (C-14)."""
    ext = F.lower(F.regexp_extract("image_path", r"\.([^./]+)$", 1))
    held = sources.where(F.col("is_visual") & ext.isin(IMAGE_FORMATS))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    url = F.when(F.col("image_path").startswith("/"), F.concat(F.lit(base), F.col("image_path"))).otherwise(F.col("image_path"))
    return held.withColumn("__n", n).where(F.col("__n") <= cap).select("query_id", "rank", url.alias("url"))


def context_metadata(sources: DataFrame, kept: DataFrame) -> DataFrame:
    """Counts by kind, tokens and whether the budget cut sources off (C-15)."""
    k = kept.groupBy("query_id").agg(F.count("*").alias("sources"), F.count_if("is_visual").alias("visual"), F.count_if(~F.col("is_visual")).alias("textual"), F.max("spent").alias("context_tokens"))
    whole = sources.groupBy("query_id").agg(F.count("*").alias("__all"))
    joined = whole.join(k, "query_id", "left").fillna(0, ["sources", "visual", "textual", "context_tokens"])
    return joined.select("query_id", "sources", "visual", "textual", "context_tokens", (F.col("visual") * IMAGE_TOKENS).alias("image_tokens"), (F.col("sources") < F.col("__all")).alias("truncated"))


def visual_reason(text: str, pictures: Column, tables: Column, element_type: Column) -> Column:
    """Why a chunk needs its pictures: related ones, its type, or what its text refers to; null if it doesn't (C-17)."""
    lower = F.lower(F.col(text))
    said = reduce(Column.__or__, [lower.rlike(p) for p in VISUAL_PATTERNS])
    return F.when(F.size(pictures) > 0, "related_pictures").when(F.size(tables) > 0, "related_tables").when(F.lower(element_type).isin(VISUAL_TYPES), "element_type").when(said, "text")


def visual_dependency(text: str, pictures: Column, tables: Column, element_type: Column) -> Column:
    return visual_reason(text, pictures, tables, element_type).isNotNull()


def relevant(scored: DataFrame, threshold: float = 7.0) -> DataFrame:
    """Rows of at least ``threshold`` of 10; visual ones count 9, missing scores 0 (C-18)."""
    s = F.when(F.col("is_visual"), F.lit(VISUAL_SCORE)).otherwise(F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.coalesce(F.col("relevance"), F.lit(0.0)))))
    return scored.withColumn("relevance", s).where(F.col("relevance") >= threshold)


def retention(before: DataFrame, after: DataFrame) -> DataFrame:
    """Share of rows kept and share of characters saved for each query (C-19)."""
    b = before.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    a = after.groupBy("query_id").agg(F.count("*").alias("kept"), F.sum(F.length("text")).alias("kept_chars"))
    j = b.join(a, "query_id", "left").fillna(0, ["kept", "kept_chars"])
    ratio = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    return j.select("query_id", F.round(ratio("kept", "n"), 6).alias("retention"), F.round(1 - ratio("kept_chars", "chars"), 6).alias("reduction"))


def compressible(text: Column, is_visual: Column) -> Column:
    return ~is_visual & (F.length(text) >= MIN_COMPRESS)


def accepted_compression(original: Column, compressed: Column, structured: Column | None = None) -> Column:
    """struct(text, method, valid): the compressed text where it is shorter, else the original (C-21).

    A structured reply's method is harmony_json, or rejected where it is not shorter; that of a plain one is legacy.
    """
    use = F.coalesce(compressed != "", F.lit(False)) & (F.length(compressed) < F.length(original))
    method = F.when(use, "harmony_json").otherwise("rejected")
    if structured is not None:
        method = F.when(structured, method).otherwise("legacy")
    return F.struct(F.when(use, compressed).otherwise(original).alias("text"), method.alias("method"), use.alias("valid"))


def reply_json(reply: Column) -> Column:
    """The longest flat object with a key in a reply; where there is none, what the outer braces hold; null if that is no JSON (C-22)."""
    flat = F.regexp_extract_all(reply, F.lit(r'\{[^{}]*"[^"]+"\s*:\s*[^{}]*\}'), F.lit(0))
    longest = F.array_max(F.transform(flat, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]
    outer = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    chosen = F.when(F.size(flat) > 0, longest).otherwise(outer)
    return F.when(F.try_parse_json(F.when(chosen != "", chosen)).isNotNull(), chosen)


def _field(reply: Column, name: str) -> tuple[Column, Column]:
    """(value, type) of a top-level field of the JSON in a reply."""
    held = F.try_variant_get(F.try_parse_json(reply_json(reply)), f"$.{name}", "variant")
    return held, F.schema_of_variant(held)


def reply_score(reply: Column) -> Column:
    """A relevance reply's score, 5 where there is none that is a number between 0 and 10 (C-22)."""
    held, kind = _field(reply, "score")
    s = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(held, "$", "double"))
    return F.when(s.between(0, 10), s).otherwise(5.0)


def reply_facts(reply: Column) -> Column:
    """A compression reply's facts, the reply itself where there is no text that isn't blank (C-22)."""
    held, kind = _field(reply, "facts")
    facts = F.when(kind == "STRING", F.try_variant_get(held, "$", "string"))
    return F.when(F.regexp_replace(facts, r"\s+", "") != "", facts).otherwise(reply)


def reply_channel(reply: Column, channel: str = "final") -> Column:
    """The text of the last message of a channel in a tagged reply, else the whole (C-23)."""
    found = F.regexp_extract_all(reply, F.lit(r"(?s)<\|channel\|>" + channel + r"<\|message\|>(.*?)(?=<\||$)"), F.lit(1))
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1))).otherwise(reply)


def usage_cost(usage: DataFrame) -> DataFrame:
    """Cost of tokens by model; unknown models cost nothing (C-25); usage(model, input_tokens, output_tokens)."""
    prices = usage.sparkSession.createDataFrame([(m, i, o) for m, (i, o) in PRICES.items()], "model string, input_price double, output_price double")
    cost = F.coalesce((F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6, F.lit(0.0))
    return usage.join(F.broadcast(prices), "model", "left").groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(cost).alias("cost"))


def image_tokens(count: Column, detail: Column) -> Column:
    return count * F.when(detail == "low", IMAGE_TOKENS_LOW).otherwise(IMAGE_TOKENS)


def source_list(sources: DataFrame) -> DataFrame:
    """(query_id, listing): one line a source with page and relevance in per cent (C-24, C-27)."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("filename"), F.lit(" (page "), F.col("page_num").cast("string"), F.lit(") - "), F.round(F.col("score") * 100).cast("int").cast("string"), F.lit("%"))
    return sources.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("listing"))


def numbered_listing(chunks: DataFrame, key: str) -> DataFrame:
    """(key, listing): chunks of a key as numbered paragraphs in order (C-24)."""
    item = F.concat(F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("] "), F.col("text"))
    rows = F.sort_array(F.collect_list(F.struct("pos", item.alias("t"))))
    return chunks.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x["t"]), "\n\n").alias("listing"))
