"""HTML extraction, collocations and periodic runs against brute force on small tables."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import collocations, mainpage, periodic

SPACES = re.compile(r"[\x20\x09-\x0D]+")


# ---- 11 HTML extraction


@pytest.mark.parametrize(
    "page, text",
    [
        (
            "<html><body><header><h1>Site</h1></header><nav><a href=/>x</a></nav><div id='cookie-notice'>We use cookies</div><main><article><h1>T &lt;1&gt;</h1>"
            "<p>First, para<p>Second <b>bo</b>ld&nbsp;x<ul><li>one<li>two</ul><aside>side</aside><form><input>Sub</form></article>"
            "<section id='comments'><article class='comment'><p>Nice, really nice, long comment, yes</p></article></section></main><footer>f</footer></body></html>",
            "T <1> First, para Second bold x one two",
        ),
        ("<body><div class=sidebar><p>aaa, bbb, ccc, ddd</p></div><div id=content><h2>H</h2><p>Hello world, this.</p><p>Another</p><table><tr><td>a<td>b</table></div><div class=footer>foot</div>", "H Hello world, this. Another a b"),
        ("<body><div class='with-sidebar'><p>Hello world, this is text.</p></div><div class='ad'>An, ad, is, very, long, with, many, commas</div>", "Hello world, this is text."),
        ("<script>var a='<p>no</p>'</script><article><p>x &am y &amp z &#65;</p></article>", "x &am y & z A"),
        ("<article><div class='ad'><p>x</p></div><p>y</p><div class='article-comments'><p>zz</p></div></article>", "y"),
        ("<nav>unclosed <article><p>kept</p></article>", "unclosed kept"),
        ("<form><p>in a form, wrapped</p><p>more</p><input></form>", "in a form, wrapped more"),
        ("<article><section><p>long, yes, with, commas</p></section><section><p>s</p></section></article>", "long, yes, with, commas s"),
        ("<p>a<!-- <p>c --><p>b<br>c \n d", "a b c d"),
        ("a < b", "a < b"),
        ("plain", "plain"),
        ("<article><p>x<script>never closed <p>y", "x"),
        ("<head><title>t</title></head>", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_main_text(page, text):
    assert mainpage.main_text(page) == text


@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "<div>", "</div>", "<a href='x'>", "</a>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<article>", "</article>", "<td>", "<!--", "-->", "<script>", "</script>", "<", "word, ", "&amp;", "<form>", "</form>", "<body>"]), max_size=40))
@settings(max_examples=300, deadline=None)
def test_main_text_of_any_markup(parts):
    text = mainpage.main_text("".join(parts))
    assert text == " ".join(text.split())


def test_main_text_is_linear():
    for part in ("<div>", "<p>", "</div>", '<a x="', "<", "<!--", "<li>", "<b class=ad>"):
        mainpage.main_text(part * 30_000)


def test_extract(spark, sf):
    pages = spark.createDataFrame([(1, "u", None, 5), (2, None, "<article><p>x, y</p></article>", 6), (2, None, "<article><p>x, y</p></article>", 6), (None, "u", "", 7)], "page_id long, url string, html string, n_chars int")
    got = sorted(map(tuple, mainpage.extract_main_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", 5, ""), (2, None, 6, "x, y"), (2, None, 6, "x, y"), (None, "u", 7, "")], key=str)
    assert mainpage.extract_main_text(pages.where("false")).count() == 0
    with pytest.raises(ValueError):
        mainpage.extract_main_text(pages.withColumnRenamed("url", "TEXT"))
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = {}
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        want[r.page_id] = (r.url, " ".join(html.unescape(re.sub(r"</?(?:h1|p|b|br)>", " ", article)).split()))
    got = mainpage.op11_html_extraction(spark, sf).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)


# ---- 12 collocations


def brute_phrases(rows, least, first, subsumed=80):
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            if text is not None:
                n["und" if lang is None else lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    most[p[i : i + m]] = max(most[p[i : i + m]], a)
        scored = []
        for p, a in cand.items():
            if 100 * most[p] >= subsumed * a and most[p]:
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:first])]
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    r = random.Random(11)
    words = ["The", "the", "of", "a", "é", "x-y", "日本", "\xa0b", "Zz"]
    rows = [(None, "en"), ("", None), (" \t\n", "en"), (". ! ?", "de"), ("one", "en")]
    for i in range(160):
        w = [r.choice(words) for _ in range(r.randint(0, 60))]
        rows.append(("".join(x + r.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b"]) for x in w), r.choice(["en", "en", "de", None, "und"])))
    rows += [("alpha beta gamma delta epsilon, tail", "en")] * 40 + [("alpha beta gamma " * 5000, "en")]
    return rows


def test_collocations(spark, prose):
    docs = spark.createDataFrame([(t, g, 1, "x") for t, g in prose], "text string, lang string, n int, phrase string").repartition(5)
    phrases, words = collocations.collocations(docs, least=5, batch_bytes=4000, bucket_words=2000)
    top = collocations.ranked(phrases, "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], 40).join(words, "lang")
    got = sorted(map(tuple, top.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == brute_phrases(prose, 5, 40)
    assert len(got) > 100 and {len(p[2].split(" ")) for p in got} == {2, 3, 4}


def test_collocations_query(spark, prose, tmp_path):
    import duckdb

    spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(prose)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, collocations.op12_collocations(spark, str(tmp_path)).collect()))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = "lang, rank, phrase, a, l, r, n, score"
    assert got == brute_phrases(prose, 30, 2000) == sorted(duckdb.sql(f"SELECT {columns} FROM ({collocations.OP12_SQL})").fetchall())


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([(None, "en"), ("", "en")], "text string, lang string")
    for docs in (none, none.where("false")):
        phrases, words = collocations.collocations(docs)
        assert phrases.count() == 0 and words.count() == 0


# ---- 13 periodic runs


def brute_runs(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            part = w[s : i + q]
            if len(part) >= max(least, 2 * q) and not any(all(a == b for a, b in zip(part, part[d:])) for d in range(1, q)):
                out.append((s, i + q, q))
    return sorted(out)


def found_runs(texts):
    x, starts = periodic.numbered(texts)
    out = [[] for _ in texts]
    for s, e, q in periodic.runs_of(x, 12, max(map(len, texts))):
        t = max(i for i, at in enumerate(starts) if at <= s)
        out[t].append((s - int(starts[t]), e - int(starts[t]), q))
    return [sorted(r) for r in out]


@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=70), min_size=1, max_size=3), st.integers(1, 40), st.integers(2, 9), st.sampled_from([8, 1 << 18]))
@settings(max_examples=150, deadline=None)
def test_runs(texts, p, times, widest):
    texts.append((texts[0][:p] or [b"z"]) * times + [b"q"])
    was, periodic.WIDEST = periodic.WIDEST, widest
    try:
        assert found_runs(texts) == [brute_runs(t) for t in texts]
    finally:
        periodic.WIDEST = was


def test_transform():
    import numpy as np

    r = np.random.default_rng(3)
    for width, reach in ((2, 7), (4, 11), (8, 23), (16, 47)):
        b, w = r.integers(0, 2**30, (5, width)), r.integers(0, 2**30, (5, reach))
        w[2, 3 : 3 + width] = b[2]
        got = periodic.mismatches(b.astype(np.uint64), w.astype(np.uint64))
        want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(b[i], w[i, d : d + width])) % int(periodic.PRIME) for d in range(reach - width + 1)] for i in range(5)]
        assert got.tolist() == want and got[2, 3] == 0


def test_long_loops():
    one = [b"a"] * 200_000
    assert found_runs([one]) == [[(0, 200_000, 1)]]
    wide = [b"%d" % (i % 30_000) for i in range(100_000)]
    assert found_runs([wide, [], one[:11]]) == [[(0, 100_000, 30_000)], [], []]


def digest(text, doc_id):
    w = [x for x in SPACES.split(text or "") if x]
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    told = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    best = max(runs, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    first = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *first, sha(told), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_query(spark, tmp_path):
    r = random.Random(4)
    texts = [None, "", " \t\n\x0b ", "a", "x " * 12, "x " * 11, "a\xa0b c " * 8, " ".join(str(i % 40) for i in range(300))]
    texts += [" ".join(r.choice("abcdefgh") + "é" for _ in range(n)) for n in [30, 100, 200] * 12]
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)] + [(3, "a", "c", 1), (None, "x " * 30, "c", 1)]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts)))
    spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periodic.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([digest(t, i) for i, t, _, _ in rows], key=str)
    assert periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, a string, b int").where("false")).count() == 0
