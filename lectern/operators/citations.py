"""Citation analytics over a table of answers (K), and chunk-to-document alignment (M)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Citation and sentence patterns, abbreviations, chunk marker formats.
CITATION = r"\[\[?(\d+)\](?:\]\([^\)]+\))?\]?"
CLUSTER = r"(\[\d+\](?:\s*,?\s*\[\d+\])*)"
SENTENCE = r"[^.!?]+[.!?]+"
ABBREVIATIONS = ["Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "etc", "vs", "Inc", "Ltd"]
MARKER = r'<!-- chunk:([^\s]+) page:(\d+) section:"([^"]*)" -->'
OPEN_DIV = r'<div data-chunk-id="([^"]+)" data-page="(\d+)" data-section="([^"]*)">'
CLOSE_DIV = r"</div>"
TIME_TAG = r"\[time: ([0-9.]+)-([0-9.]+)\]"


def spans(text: Column, pattern: str) -> Column:
    """array<struct<idx, text, start, end>> of a pattern's matches in order; offsets in characters.

    The pieces between matches are what split leaves, so a match starts where the pieces and matches before it end.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    lengths = F.zip_with(F.transform(found, F.length), F.slice(F.transform(between, F.length), 1, F.greatest(F.size(found), F.lit(1))), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    empty = F.array().cast("array<struct<idx:int,text:string,start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["p"]
        n = F.size(acc["out"])
        one = F.struct(n.alias("idx"), F.get(found, n).alias("text"), first.alias("start"), (first + x["m"]).alias("end"))
        return F.struct((first + x["m"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.when(F.size(found) == 0, empty).otherwise(F.aggregate(F.filter(lengths, lambda x: x["m"].isNotNull()), start, add, lambda acc: acc["out"]))


#: Rows and bytes of texts that a task turns into Python objects at a time.
SLICE_ROWS, SLICE_BYTES = 256, 4_000_000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of bounded size, so that a task's Python memory does not grow with Spark's batches."""
    for batch in batches:
        rows = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def located(texts: DataFrame, key: str, pattern: str, text: str = "text") -> DataFrame:
    """(key, idx, match, start, end) by one pass of the pattern over each text, in Arrow batches: linear in long texts."""
    import re

    compiled = re.compile(pattern)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            kept, (keys, held) = part.schema.types[0], (c.to_pylist() for c in part.columns)
            out = [(k, i, m.group(0), m.start(), m.end()) for k, t in zip(keys, held) if t for i, m in enumerate(compiled.finditer(t))]
            of = lambda n, type: pa.array([x[n] for x in out], type)
            yield pa.RecordBatch.from_arrays([of(0, kept), of(1, pa.int32()), of(2, pa.string()), of(3, pa.int32()), of(4, pa.int32())], ["key", "idx", "match", "start", "end"])

    return texts.select(key, text).mapInArrow(run, f"key {kind}, idx int, match string, start int, end int").withColumnRenamed("key", key)


def citations(answers: DataFrame) -> DataFrame:
    """(answer_id, idx, id, marker, start, end) (K-01)."""
    return located(answers, "answer_id", CITATION).select("answer_id", "idx", F.regexp_extract("match", CITATION, 1).cast("int").alias("id"), F.col("match").alias("marker"), "start", "end")


def clusters(answers: DataFrame) -> DataFrame:
    """Runs of two citations or more that stand together (K-02)."""
    found = located(answers, "answer_id", CLUSTER)
    ids = F.transform(F.regexp_extract_all("match", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
    return found.withColumn("ids", ids).where(F.size("ids") > 1).select("answer_id", F.col("match").alias("marker"), "start", "end", "ids")


def sentences(answers: DataFrame) -> DataFrame:
    """(answer_id, idx, text, start, end) of terminated sentences; the whole text where there is none (K-03)."""
    found = located(answers, "answer_id", SENTENCE).select("answer_id", "idx", F.trim(F.regexp_replace("match", r"^\s+|\s+$", "")).alias("text"), "start", "end")
    bare = answers.join(found.select("answer_id").distinct(), "answer_id", "left_anti").where("text is not null")
    return found.unionByName(bare.select("answer_id", F.lit(0).alias("idx"), F.trim("text").alias("text"), F.lit(0).alias("start"), F.length("text").alias("end")))


def sentence_list(text: Column) -> Column:
    """Trimmed sentences without those that end in an abbreviation, then what follows the last one taken (K-04)."""
    found, between = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), F.split(text, SENTENCE, -1)
    trimmed = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    last = lambda s: F.regexp_replace(F.element_at(F.split(trimmed(s), r"\s+"), -1), r"\.+$", "")
    taken = lambda s: ~last(s).isin(ABBREVIATIONS)
    n = F.coalesce(F.array_max(F.transform(found, lambda s, i: F.when(taken(s), i + 1))), F.lit(0))
    after = lambda parts: F.length(F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts), F.lit(1))), ""))
    rest = trimmed(F.right(text, after(found) + after(between)))
    return F.concat(F.filter(F.transform(found, lambda s: F.when(taken(s), trimmed(s))), lambda s: s.isNotNull()), F.filter(F.array(rest), lambda s: s != ""))


def assigned(found: DataFrame, sents: DataFrame) -> DataFrame:
    """Citations with the sentence that contains them (K-05)."""
    s = sents.select("answer_id", F.col("idx").alias("sentence"), F.col("start").alias("s"), F.col("end").alias("e"))
    return found.join(s, "answer_id").where((F.col("start") >= F.col("s")) & (F.col("end") <= F.col("e"))).drop("s", "e")


def citation_maps(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(citation -> sentences, sentence -> citations), each sorted and distinct (K-06)."""
    by_id = pairs.groupBy("answer_id", "id").agg(F.sort_array(F.collect_set("sentence")).alias("sentences"))
    by_sentence = pairs.groupBy("answer_id", "sentence").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return by_id, by_sentence


def out_of_range(found: DataFrame, answers: DataFrame) -> DataFrame:
    """Citations whose number names no source, with a message (K-07)."""
    joined = found.join(answers.select("answer_id", "num_sources"), "answer_id")
    bad = (F.col("id") < 1) | (F.col("id") > F.col("num_sources"))
    message = F.concat(F.lit("Citation ["), F.col("id").cast("string"), F.lit("] out of range (1-"), F.col("num_sources").cast("string"), F.lit(")"))
    return joined.where(bad).withColumn("message", message)


def clean_text(text: Column) -> Column:
    """Text without citation markers, spaces single (K-08)."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, CITATION, ""), r"\s+", " "))


def inside(found: DataFrame, low: Column, high: Column) -> DataFrame:
    """Citations within a character range (K-09)."""
    return found.where((F.col("start") >= low) & (F.col("end") <= high))


def payload(answers: DataFrame) -> DataFrame:
    """One row an answer: text, citations, sentences with the ids they cite, and each id's sentences (K-10)."""
    found, sents = citations(answers), sentences(answers)
    pairs = assigned(found, sents)
    _, by_sentence = citation_maps(pairs)
    marks = found.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "id", "marker"))).alias("citations"))
    cited = sents.join(by_sentence.withColumnRenamed("sentence", "idx"), ["answer_id", "idx"], "left")
    one = F.struct("idx", "text", "start", "end", F.coalesce("ids", F.array().cast("array<int>")).alias("citation_ids"))
    told = cited.groupBy("answer_id").agg(F.sort_array(F.collect_list(one)).alias("sentences"))
    named = pairs.join(sents.select("answer_id", F.col("idx").alias("sentence"), "text"), ["answer_id", "sentence"])
    of_id = named.groupBy("answer_id", "id").agg(F.sort_array(F.collect_set(F.struct(F.col("sentence").alias("sentence_index"), F.col("text").alias("sentence_text")))).alias("s"))
    gathered = of_id.groupBy("answer_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", "s")))).alias("citation_map"))
    whole = answers.select("answer_id", "text")
    for part in (marks, told, gathered):
        whole = whole.join(part, "answer_id", "left")
    return whole


# ---- alignment ---------------------------------------------------------------------------------------------------


def chunk_positions(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, doc_id, position): where a chunk's first 100 characters begin in its document, white space aside (M-01).

    The first 20 characters are the anchor; candidates are tried in turn. Null where there is none. A document meets the
    list of its chunks' beginnings once.
    """
    import re

    space = re.compile(r"\s+").sub

    def position(markdown: str, head: str) -> int | None:
        head = head.strip()
        if not head:
            return None
        wanted, anchor = space(" ", head), head[:20]
        at = markdown.find(anchor)
        while at >= 0:
            if wanted in space(" ", markdown[at : at + len(head)]):
                return at
            at = markdown.find(anchor, at + 1)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for doc, markdown, heads in zip(*(part[c].to_pylist() for c in ("doc_id", "markdown", "heads"))):
                out += [(h["id"], doc, position(markdown, h["head"]) if markdown and h["head"] else None) for h in heads]
            of = lambda n, type: pa.array([x[n] for x in out], type)
            yield pa.RecordBatch.from_arrays([of(0, pa.string()), of(1, pa.string()), of(2, pa.int64())], ["id", "doc_id", "position"])

    heads = chunks.groupBy("doc_id").agg(F.collect_list(F.struct("id", F.substring("text", 1, 100).alias("head"))).alias("heads"))
    return heads.join(documents.select("doc_id", "markdown"), "doc_id").mapInArrow(run, "id string, doc_id string, position long")


def _wrapped(text: str, places: list) -> str:
    """``text`` with a wrapper around each place (position, head, length); places come from last to first.

    A place reaches ``length`` characters on from its position in the text as it stands by then, later wrappers included.
    The text from the last position on is kept as pieces, first piece on top; a place takes its characters off the top and
    puts them back as one piece, so the work is the sum of the lengths and not places times text.
    """
    pieces: list[str] = []
    begun = len(text)
    for place in places:
        at, left = min(place["position"], begun), place["length"]
        pieces.append(text[at:begun])
        begun, inside = at, []
        while pieces and left > 0:
            piece = pieces.pop()
            if len(piece) > left:
                pieces.append(piece[left:])
                piece = piece[:left]
            inside.append(piece)
            left -= len(piece)
        pieces.append("\n</div>\n")
        pieces.append("".join([place["head"], *inside]))
    return text[:begun] + "".join(reversed(pieces))


@F.arrow_udf(T.StringType())
def _with_wrappers(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for part in slices(pa.RecordBatch.from_arrays(list(b), ["texts", "places"]) for b in batches):
        yield pa.array([t if t is None or p is None else _wrapped(t, p) for t, p in zip(*(c.to_pylist() for c in part.columns))], pa.string())


def with_markers(placed: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents with markers around their located chunks, inserted from last to first (M-02); placed(doc_id, id, page_num, section_path, position, length).

    A chunk without a page number is on page 1, one without a length is empty; a document without a located chunk stays as it is.
    """
    page, section = F.coalesce("page_num", F.lit(1)).cast("string"), F.regexp_replace(F.coalesce("section_path", F.lit("")), '"', "&quot;")
    head = F.concat(F.lit("<!-- chunk:"), "id", F.lit(" page:"), page, F.lit(' section:"'), section, F.lit('" -->\n<div data-chunk-id="'), "id", F.lit('" data-page="'), page, F.lit('" data-section="'), section, F.lit('">\n'))
    item = F.struct(F.col("position").cast("int").alias("position"), "id", "page_num", "section_path", F.coalesce("length", F.lit(0)).alias("length"), head.alias("head"))
    ordered = F.sort_array(F.collect_list(item), asc=False)
    slim = F.transform(ordered, lambda x: F.struct(x["position"].alias("position"), x["length"].alias("length"), x["head"].alias("head")))
    lists = placed.where("position is not null").groupBy("doc_id").agg(slim.alias("places"))
    joined = documents.join(lists, "doc_id", "left")
    return joined.withColumn("marked", F.when(F.col("places").isNull(), F.col("markdown")).otherwise(_with_wrappers("markdown", "places"))).drop("places")


def marker_audit(text: Column) -> Column:
    """struct(markers, opens, closes, mismatched, valid) of a marked text (M-03)."""
    parts = lambda p: F.transform(F.arrays_zip(*[F.regexp_extract_all(text, F.lit(p), F.lit(i)).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "c"))]), lambda x: F.concat_ws("\n", x["a"], x["b"], x["c"]))
    marks, opens = parts(MARKER), parts(OPEN_DIV)
    closes = F.size(F.regexp_extract_all(text, F.lit(CLOSE_DIV), F.lit(0)))
    both = F.least(F.size(marks), F.size(opens))
    wrong = F.size(F.filter(F.zip_with(marks, opens, lambda a, b: a != b), lambda x: F.coalesce(x, F.lit(False))))
    valid = (F.size(marks) == F.size(opens)) & (F.size(opens) == closes) & (wrong == 0)
    return F.struct(F.size(marks).alias("markers"), F.size(opens).alias("opens"), closes.alias("closes"), F.when(both > 0, wrong).otherwise(0).alias("mismatched"), valid.alias("valid"))


def without_markers(text: Column) -> Column:
    """Text without chunk comments and wrappers (M-04)."""
    out = F.regexp_replace(text, r'<!-- chunk:[^\s]+ page:\d+ section:"[^"]*" -->\n?', "")
    out = F.regexp_replace(out, r'<div data-chunk-id="[^"]+" data-page="\d+" data-section="[^"]*">\n?', "")
    return F.regexp_replace(out, r"\n?</div>\n?", "")


def front_matter(text: Column) -> Column:
    """struct(head, body): a leading '---' block and the rest (M-05)."""
    head = F.regexp_extract(text, r"(?s)^(---\n.*?\n---\n)", 1)
    return F.struct(head.alias("head"), F.substr(text, F.length(head) + 1).alias("body"))


def with_chunk_count(head: Column, n: Column) -> Column:
    """Front matter with chunk_count set, inserted after the opening line where absent (M-05)."""
    line = F.concat(F.lit("chunk_count: "), n.cast("string"))
    return F.when(head.rlike(r"(?m)^chunk_count:"), F.regexp_replace(head, F.lit(r"(?m)^chunk_count:.*$"), line)).otherwise(F.regexp_replace(head, F.lit(r"^---\n"), F.concat(F.lit("---\n"), line, F.lit("\n"))))


def time_segments(chunks: DataFrame) -> DataFrame:
    """(id, idx, start_s, end_s, segment) of '[time: a-b]' tags with the text that follows (M-07)."""
    starts, ends = (F.regexp_extract_all("text", F.lit(TIME_TAG), F.lit(i)) for i in (1, 2))
    after = F.slice(F.split("text", TIME_TAG, -1), 2, F.greatest(F.size(starts), F.lit(1)))
    zipped = F.arrays_zip(starts.alias("s"), ends.alias("e"), after.alias("t"))
    return chunks.where(F.size(starts) > 0).select("id", F.posexplode(zipped).alias("idx", "x")).select("id", "idx", F.col("x.s").cast("double").alias("start_s"), F.col("x.e").cast("double").alias("end_s"), F.trim("x.t").alias("segment"))


def active_chunks(events: DataFrame, chunks: DataFrame, bucket_s: int = 60) -> DataFrame:
    """Each playback event (event_id, doc_id, t) with the chunk playing then: start <= t < end (M-08).

    Chunks without times are asked for a time tag at the beginning of their text, where none with times plays. Time buckets
    keep long documents apart.
    """
    timed = F.col("start_time").isNotNull() & F.col("end_time").isNotNull()
    tag = lambda i: F.regexp_extract("text", r"^\[time:\s*([0-9.]+)-([0-9.]+)\]", i).try_cast("double")
    c = chunks.select("doc_id", "id", F.when(timed, 0).otherwise(1).alias("side"), F.when(timed, F.col("start_time")).otherwise(tag(1)).alias("s"), F.when(timed, F.col("end_time")).otherwise(tag(2)).alias("e"))
    spread = c.where("s < e").withColumn("b", F.explode(F.sequence(F.floor(F.col("s") / bucket_s), F.floor(F.col("e") / bucket_s))))
    hit = events.withColumn("b", F.floor(F.col("t") / bucket_s)).join(spread, ["doc_id", "b"]).where("s <= t and t < e")
    return hit.groupBy("event_id", "doc_id", "t").agg(F.min(F.struct("side", "s", "id"))["id"].alias("chunk_id"))
