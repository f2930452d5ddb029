"""Line dedup (6): removal of lines that spread over many distinct sites.

Each line is known by two 64-bit hashes of its trimmed text. HyperLogLog sketches of the sites that hold it merge by
aggregation, so a line in a third of all rows meets as one small sketch a task. Lines whose estimate is clearly above
or below ``min_sites`` are decided by it; those within ``margin`` of it get an exact distinct count. A boilerplate line
stays at its first occurrence (smallest doc_id, then position) and goes everywhere else, so no content is lost whole.

Before sketching, lines are counted; one held fewer than ``min_sites`` times can't reach that many sites and needs none.

Defined cases: null and empty texts have no line and stay as they are; blank lines are never boilerplate; a null site is
a site of its own; rows of one doc_id (or of none) are one document for first occurrences, so repeated rows are cut
alike; other columns, whatever their names, come back unchanged; an empty table gives no row; long lines are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, private

KEY = ["__h1", "__h2"]


def line_rows(docs: DataFrame, site: str) -> DataFrame:
    """(doc, __site, __at, __h1, __h2) of every line that is not blank; positions count from 0."""
    lines = docs.select(
        F.col("doc_id").alias("__doc"),
        F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("none")).alias("__site"),
        F.posexplode(F.split("text", "\n")).alias("__at", "__line"),
    )
    trimmed = F.trim("__line")
    return lines.where(F.length(trimmed) > 0).select("__doc", "__site", "__at", F.xxhash64(trimmed).alias("__h1"), F.xxhash64(F.lit(1), trimmed).alias("__h2"))


def spread_lines(lines: DataFrame, min_sites: int, margin: float = 0.25, lg_k: int = 12) -> DataFrame:
    """(__h1, __h2, sites, first_doc, first_at) of the lines on at least ``min_sites`` distinct sites."""
    frequent = lines.groupBy(*KEY).agg(F.count("*").alias("__n")).where(F.col("__n") >= min_sites).select(*KEY)
    held = lines.join(frequent, KEY, "left_semi")
    sketched = cut(
        held.groupBy(*KEY).agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("__site", F.lit(lg_k))).alias("sites"),
            F.min(F.struct(F.col("__doc"), F.col("__at"))).alias("first"),
        )
    )
    clear = sketched.where(F.col("sites") >= min_sites * (1 + margin))
    near = sketched.where((F.col("sites") < min_sites * (1 + margin)) & (F.col("sites") >= min_sites * (1 - margin)))
    pairs = held.join(near.select(*KEY), KEY, "left_semi").select(*KEY, "__site").distinct()
    counted = pairs.groupBy(*KEY).agg(F.count("*").alias("exact")).where(F.col("exact") >= min_sites)
    exact = near.join(counted, KEY).select(*KEY, F.col("exact").alias("sites"), "first")
    return clear.unionByName(exact).select(*KEY, "sites", F.col("first.__doc").alias("first_doc"), F.col("first.__at").alias("first_at"))


def staying(gone: Column) -> Column:
    """Whether each line up to the last one that goes stays, from the ascending positions of those that go; one look-up a line."""
    before = F.concat(F.array(F.lit(-1)), F.slice(gone, 1, F.size(gone) - 1))
    between = F.zip_with(gone, before, lambda at, last: at - last - 1)
    return F.flatten(F.transform(between, lambda n: F.concat(F.array_repeat(F.lit(True), n), F.array(F.lit(False)))))


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = 10, margin: float = 0.25, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the text of kept lines; ``counts`` names two columns to add: how many lines there were and how many went."""
    if counts and {c.lower() for c in counts} & {c.lower() for c in docs.columns}:
        raise ValueError("the table has a column named like one of counts")
    lines = cut(line_rows(docs.select("doc_id", "text", F.col(f"`{site}`").alias("__s")), "__s"))
    spread = spread_lines(lines, min_sites, margin)
    later = ~(F.col("__doc").eqNullSafe(F.col("first_doc")) & (F.col("__at") == F.col("first_at")))
    doc, gone, stays = private(docs, "doc", "gone", "stays")
    cuts = lines.join(spread, KEY).where(later).groupBy(F.col("__doc").alias(doc)).agg(F.sort_array(F.collect_set("__at")).alias("__cut"))
    cuts = cuts.select(doc, F.size("__cut").alias(gone), staying(F.col("__cut")).alias(stays))
    joined = docs.join(cuts, docs["doc_id"].eqNullSafe(cuts[doc]), "left")
    parts = F.split("text", "\n")
    left = F.filter(parts, lambda line, at: F.coalesce(F.get(F.col(stays), at), F.lit(True)))
    kept = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    told = []
    if counts:
        told = [
            F.when(F.length("text") > 0, F.size(parts)).otherwise(0).alias(counts[0]),
            F.coalesce(F.col(gone), F.lit(0)).alias(counts[1]),
        ]
    return joined.select(*[kept.alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns], *told)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = remove_boilerplate(docs, site="source", min_sites=10, counts=("lines", "removed"))
    return found.select("doc_id", F.col("lines").cast("long").alias("n_lines"), F.col("removed").cast("long").alias("n_removed"), F.md5("text").alias("kept_md5"))


OP6_SQL = """
WITH l AS (
  SELECT doc_id, coalesce('=' || source, 'none') AS site, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos,
         unnest(string_split(text, chr(10))) AS line
  FROM documents
), t AS (SELECT doc_id, site, pos, line, trim(line, ' ') AS k FROM l),
b AS (
  SELECT k, min({'d': doc_id, 'a': pos}) AS low FROM t WHERE length(k) > 0 GROUP BY k HAVING count(DISTINCT site) >= 10
), m AS (
  SELECT t.doc_id, t.pos, t.line, (b.k IS NOT NULL AND NOT (b.low.d = t.doc_id AND b.low.a = t.pos)) AS gone
  FROM t LEFT JOIN b ON t.k = b.k
), g AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM m GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN length(d.text) > 0 THEN g.n ELSE 0 END AS n_lines, coalesce(g.r, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(g.kept, '')) END AS kept_md5
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
