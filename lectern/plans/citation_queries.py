"""Registered citation and alignment queries (K, M)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import citations as ops
from lectern.plans.registry import query

SENT = """, sx AS (SELECT answer_id, text, num_sources, regexp_extract_all(text, '[^.!?]+[.!?]+') AS m FROM lib_answers),
se AS (SELECT answer_id, i - 1 AS idx, m[i] AS s FROM (SELECT answer_id, m, unnest(range(1, len(m) + 1)) AS i FROM sx)),
ci AS (SELECT answer_id, idx AS sentence, CAST(regexp_extract(s, '\\[(\\d+)\\]', 1) AS INTEGER) AS id FROM se WHERE regexp_matches(s, '\\[\\d+\\]'))"""


@query("K01_citations", """, p AS (SELECT answer_id, string_split_regex(text, '\\[\\d+\\]') AS b, regexp_extract_all(text, '\\[\\d+\\]') AS m FROM lib_answers),
x AS (SELECT answer_id, b, m, unnest(range(1, len(m) + 1)) AS i FROM p)
SELECT answer_id, CAST(i - 1 AS INTEGER) AS idx, CAST(m[i][2:-2] AS INTEGER) AS id, m[i] AS marker, CAST(length(array_to_string(b[1:i], '')) + length(array_to_string(m[1:i-1], '')) AS INTEGER) AS start FROM x""")
def _(lib):
    return ops.citations(lib.answers).select("answer_id", "idx", "id", "marker", "start")


@query("K01_citation_spans_builtin", """, p AS (SELECT answer_id, string_split_regex(text, '\\[\\d+\\]') AS b, regexp_extract_all(text, '\\[\\d+\\]') AS m FROM lib_answers),
x AS (SELECT answer_id, b, m, unnest(range(1, len(m) + 1)) AS i FROM p)
SELECT answer_id, m[i] AS text, CAST(length(array_to_string(b[1:i], '')) + length(array_to_string(m[1:i], '')) AS INTEGER) AS "end" FROM x""")
def _(lib):
    return lib.answers.select("answer_id", F.inline(ops.spans(F.col("text"), ops.CITATION))).select("answer_id", "text", "end")


@query("K02_clusters", """, p AS (SELECT answer_id, string_split_regex(text, '\\[\\d+\\]') AS b, regexp_extract_all(text, '\\[\\d+\\]') AS m FROM lib_answers),
x AS (SELECT answer_id, b, m, unnest(range(1, len(m) + 1)) AS i FROM p)
SELECT answer_id, m[i] || ', [9]' AS marker, CAST(length(array_to_string(b[1:i], '')) + length(array_to_string(m[1:i-1], '')) + 5 * (i - 1) AS INTEGER) AS start, m[i][2:-2] || ',9' AS ids FROM x""")
def _(lib):
    doubled = lib.answers.withColumn("text", F.regexp_replace("text", r"(\[\d+\])", "$1, [9]"))
    return ops.clusters(doubled).select("answer_id", "marker", "start", F.array_join("ids", ",").alias("ids"))


@query("K03_sentences", SENT + " SELECT answer_id, CAST(idx AS INTEGER) AS idx, regexp_replace(s, '^[ \\n]+|[ \\n]+$', '', 'g') AS text FROM se")
def _(lib):
    return ops.sentences(lib.answers).select("answer_id", "idx", "text")


@query(
    "K04_sentence_list",
    """, p AS (SELECT answer_id, text || CASE WHEN length(text) % 2 = 0 THEN ' See Dr. Smith' ELSE '' END AS text FROM lib_answers),
m AS (SELECT answer_id, text, regexp_extract_all(text, '[^.!?]+[.!?]+') AS m, string_split_regex(text, '[^.!?]+[.!?]+') AS b FROM p),
t AS (SELECT *, [regexp_replace(s, '^\\s+|\\s+$', '', 'g') FOR s IN m] AS s FROM m),
k AS (SELECT *, [regexp_replace(regexp_extract(x, '\\S+$'), '\\.+$', '') NOT IN ('Dr', 'Mr', 'Mrs', 'Ms', 'Prof', 'Sr', 'Jr', 'etc', 'vs', 'Inc', 'Ltd') FOR x IN s] AS ok FROM t),
n AS (SELECT *, coalesce(list_max([i FOR i IN range(1, len(s) + 1) IF ok[i]]), 0) AS n FROM k),
r AS (SELECT *, regexp_replace(right(text, length(array_to_string(m[n + 1:], '')) + length(array_to_string(b[n + 1:], ''))), '^\\s+|\\s+$', '', 'g') AS rest FROM n)
SELECT answer_id, md5(array_to_string(list_concat([s[i] FOR i IN range(1, len(s) + 1) IF ok[i]], CASE WHEN rest <> '' THEN [rest] ELSE [] END), '|')) AS sentences_md5 FROM r""",
)
def _(lib):
    text = F.concat("text", F.when(F.length("text") % 2 == 0, " See Dr. Smith").otherwise(""))
    return lib.answers.select("answer_id", F.md5(F.array_join(ops.sentence_list(text), "|")).alias("sentences_md5"))


@query("K05_assigned", SENT + " SELECT answer_id, id, CAST(sentence AS INTEGER) AS sentence FROM ci")
def _(lib):
    return ops.assigned(ops.citations(lib.answers), ops.sentences(lib.answers)).select("answer_id", "id", "sentence")


@query("K06_citation_map", SENT + " SELECT answer_id, id, string_agg(DISTINCT CAST(sentence AS VARCHAR), ',' ORDER BY CAST(sentence AS VARCHAR)) AS sentences FROM ci GROUP BY ALL")
def _(lib):
    by_id, _ = ops.citation_maps(ops.assigned(ops.citations(lib.answers), ops.sentences(lib.answers)))
    return by_id.select("answer_id", "id", F.array_join(F.sort_array(F.transform("sentences", lambda x: x.cast("string"))), ",").alias("sentences"))


@query("K07_out_of_range", SENT + " SELECT c.answer_id, c.id, 'Citation [' || c.id || '] out of range (1-3)' AS message FROM ci c WHERE c.id > 3")
def _(lib):
    return ops.out_of_range(ops.citations(lib.answers), lib.answers).select("answer_id", "id", "message")


@query("K08_clean_text", "SELECT answer_id, md5(trim(regexp_replace(regexp_replace(text, '\\[\\d+\\]', '', 'g'), '[ \\n\\t\\r]+', ' ', 'g'), ' ')) AS clean_md5 FROM lib_answers")
def _(lib):
    return lib.answers.select("answer_id", F.md5(ops.clean_text(F.col("text"))).alias("clean_md5"))


@query("K09_first_sentence", SENT + " SELECT answer_id, id, CAST(min(sentence) AS INTEGER) AS first FROM ci GROUP BY ALL")
def _(lib):
    pairs = ops.assigned(ops.citations(lib.answers), ops.sentences(lib.answers))
    return pairs.groupBy("answer_id", "id").agg(F.min("sentence").alias("first"))


@query("K10_payload", SENT + """ SELECT a.answer_id, (SELECT count(DISTINCT id) FROM ci WHERE ci.answer_id = a.answer_id) AS n_cited, greatest(len(a.m), 1) AS n_sentences, len(regexp_extract_all(a.text, '\\[\\d+\\]')) AS n_marks,
(SELECT count(DISTINCT sentence) FROM ci WHERE ci.answer_id = a.answer_id) AS n_citing, (SELECT count(*) FROM (SELECT DISTINCT sentence, id FROM ci WHERE ci.answer_id = a.answer_id)) AS n_links FROM sx a""")
def _(lib):
    p, none = ops.payload(lib.answers), F.lit(0)
    links = F.aggregate(F.map_values("citation_map"), none, lambda a, x: a + F.size(x))
    citing = F.size(F.filter("sentences", lambda x: F.size(x["citation_ids"]) > 0))
    counts = {"n_cited": F.size(F.map_keys("citation_map")), "n_sentences": F.size("sentences"), "n_marks": F.size("citations"), "n_citing": citing, "n_links": links}
    return p.select("answer_id", *[F.coalesce(F.when(c > 0, c), none).cast("long").alias(k) for k, c in counts.items()])


def _single(lib):
    return lib.documents.withColumn("markdown", F.trim(F.regexp_replace("markdown", "[ \\t\\r\\n]+", " ")))


@query("M01_positions", """, d AS (SELECT doc_id, trim(regexp_replace(markdown, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS m FROM lib_documents)
SELECT c.id, strpos(d.m, rtrim(left(c.text, 100))) - 1 AS position FROM lib_chunks c JOIN d ON c.doc_id = d.doc_id""")
def _(lib):
    return ops.chunk_positions(lib.chunks, _single(lib)).select("id", "position")


def _marked(lib, chunks):
    at = ops.chunk_positions(chunks, _single(lib))
    placed = at.join(chunks.select("id", "page_num", "section_path", F.length("text").alias("length")), "id")
    return ops.with_markers(placed, _single(lib))


def _whole(lib):
    """Every document as one chunk, so that markers never meet."""
    return _single(lib).where("markdown <> ''").select(F.concat("doc_id", F.lit("-chunk0000")).alias("id"), "doc_id", F.lit(1).cast("long").alias("page_num"), F.concat(F.lit('a "'), "lang", F.lit('"')).alias("section_path"), F.col("markdown").alias("text"))


ONE = ", s AS (SELECT *, trim(regexp_replace(markdown, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS m FROM lib_documents)"


@query(
    "M02_markers",
    ONE + """ SELECT doc_id, md5(CASE WHEN m <> '' THEN '<!-- chunk:' || doc_id || '-chunk0000 page:1 section:"' || t || '" -->' || chr(10) || '<div data-chunk-id="' || doc_id || '-chunk0000" data-page="1" data-section="' || t || '">' || chr(10) || m || chr(10) || '</div>' || chr(10) ELSE m END) AS marked_md5
FROM (SELECT *, 'a &quot;' || lang || '&quot;' AS t FROM s)""",
)
def _(lib):
    return _marked(lib, _whole(lib)).select("doc_id", F.md5("marked").alias("marked_md5"))


@query("M02_markers_of_all_chunks")
def _(lib):
    """Windows overlap, so wrappers nest and a chunk's end may fall into a later chunk's marker, as the definition has it."""
    return _marked(lib, lib.chunks).select("doc_id", F.md5("marked").alias("marked_md5"))


@query("M03_marker_audit", ONE + " SELECT doc_id, CASE WHEN m <> '' THEN 1 ELSE 0 END AS opens, num % 3 <> 0 OR coalesce(m, '') = '' AS valid FROM s")
def _(lib):
    """Every third document has lost its closing tag, which the audit must notice."""
    broken = _marked(lib, _whole(lib)).withColumn("marked", F.when(F.col("num") % 3 == 0, F.expr("replace(marked, '</div>', '')")).otherwise(F.col("marked")))
    return broken.select("doc_id", ops.marker_audit(F.col("marked")).alias("a")).select("doc_id", F.col("a.opens").cast("int").alias("opens"), "a.valid")


@query("M03_audit_of_all_chunks")
def _(lib):
    return _marked(lib, lib.chunks).select("doc_id", F.inline(F.array(ops.marker_audit(F.col("marked")))))


@query("M04_strip_markers", "SELECT doc_id, md5(trim(regexp_replace(markdown, '[ \\t\\r\\n]+', ' ', 'g'), ' ')) AS clean_md5 FROM lib_documents")
def _(lib):
    return _marked(lib, _whole(lib)).select("doc_id", F.md5(ops.without_markers(F.col("marked"))).alias("clean_md5"))


@query("M05_front_matter", "SELECT doc_id, '---\nchunk_count: 3\ntitle: ' || filename || '\n---\n' AS head, md5(markdown) AS body_md5 FROM lib_documents")
def _(lib):
    text = F.concat(F.lit("---\ntitle: "), "filename", F.lit("\n---\n"), "markdown")
    parts = lib.documents.select("doc_id", ops.front_matter(text).alias("p"))
    return parts.select("doc_id", ops.with_chunk_count(F.col("p.head"), F.lit(3)).alias("head"), F.md5("p.body").alias("body_md5"))


@query("M06_chunk_order", "SELECT id, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, length(text), id) AS n FROM lib_chunks")
def _(lib):
    w = Window.partitionBy("doc_id").orderBy("page_num", F.length("text"), "id")
    return lib.chunks.select("id", F.row_number().over(w).cast("long").alias("n"))


@query("M07_time_segments", "SELECT id, start_time AS start_s, end_time AS end_s, parent_heading AS segment FROM lib_chunks WHERE start_time IS NOT NULL")
def _(lib):
    tagged = F.concat(F.lit("[time: "), F.col("start_time").cast("string"), F.lit("-"), F.col("end_time").cast("string"), F.lit("] "), "parent_heading")
    return ops.time_segments(lib.chunks.where("start_time is not null").select("id", tagged.alias("text"))).select("id", "start_s", "end_s", "segment")


@query("M08_active_chunk", """, e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS doc_id, value AS t FROM events)
SELECT e.event_id, c.id AS chunk_id FROM e JOIN lib_chunks c ON e.doc_id = c.doc_id AND c.start_time <= e.t AND e.t < c.end_time""")
def _(lib):
    """Every other chunk tells its times in a tag of its text only."""
    e = lib.given("events").select("event_id", F.col("user_id").cast("string").alias("doc_id"), F.col("value").alias("t"))
    tag = F.concat(F.lit("[time: "), F.col("start_time").cast("string"), F.lit("-"), F.col("end_time").cast("string"), F.lit("] "), "text")
    odd = F.col("pos") % 2 == 1
    told = lib.chunks.withColumn("text", F.when(odd & F.col("start_time").isNotNull(), tag).otherwise(F.col("text")))
    return ops.active_chunks(e, told.withColumns({c: F.when(~odd, F.col(c)) for c in ("start_time", "end_time")})).select("event_id", "chunk_id")
