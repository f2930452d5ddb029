"""The ten operators against brute force on small tables with nulls, empties, ties, repeats, long texts and extra columns."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import decontam, linededup, packing, sharding, simhash, suffixdedup, tokencount, tokenfiles, topk, toxicity
from lectern.llm.common import components, shared_folder
from lectern.llm.encoding import WordEncoder, tokenizer_path

WORDS, PIECES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")
EXTRA = "shard int, fp string, score string, component_id string, start string, rank string"


def rows():
    r = random.Random(7)
    syllables = ["the", "re", "ing", "on", "an", "é", "st", "ion", "ß", "und"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(n) for n in (1, 2, 3, 5, 40, 90, 200)]
    long = "\n".join(text(12) + "." for _ in range(400))
    shared = text(40)
    out = [None, "", "   \n\t ", "\n\n", "A", *base, *base[3:], base[5].upper(), base[6] + " tail", base[6].replace("ing", "Ing", 1), long, long[: len(long) // 2] + " other " + long[len(long) // 2 :]]
    out += [text(30) + "\n" + shared + "\n" + text(30) for _ in range(6)]
    out += ["x" * 450, "ab" * 300, "日本語 テキスト ▁ <s> </s> <|endoftext|> ｆｕｌｌ \x00   a", base[4] + "\n" + base[4]]
    return out


def table(spark, texts, ids=None, sources=None):
    ids = ids or list(range(len(texts)))
    sources = sources or [None if i % 9 == 0 else f"s{i % 4}" for i in range(len(texts))]
    data = [(i, t, "en", s, len(t or ""), 1, "f", "x", "c", "s", "r") for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [None]).where("false")


#: Rows without doc_id and rows that repeat one.
ODD = [(d, None if n is None else rows()[n]) for d, n in ((3, 8), (3, 8), (3, 9), (4, None), (None, 10), (None, 10), (9, 10))]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, [x for _, x in ODD], [d for d, _ in ODD])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---- 1 sharding


def test_sharding(spark, docs, empty, odd):
    got = sharding.assign_shards(docs, 8).toPandas()
    texts = rows()
    assert len(got) == len(texts) and set(got.shard) <= set(range(8))
    for r in got.itertuples():
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 1, zlib.crc32(body))
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got.groupby("group_key").shard.nunique().max() == 1
    assert sharding.assign_shards(empty, 8).count() == 0
    again = sharding.assign_shards(odd, 2).toPandas()
    assert len(again) == 7 and again.groupby("group_key").shard.nunique().max() == 1
    few = sharding.assign_shards(docs, None, capacity=20_000).toPandas()
    assert few.groupby("shard")["size"].sum().max() <= max(20_000, few.groupby("group_key")["size"].sum().max())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60), st.integers(60, 120))
def test_best_fit(sizes, capacity):
    bins = sharding.best_fit_decreasing(sizes, capacity)
    room: list[int] = []
    want = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = min((b for b in range(len(room)) if room[b] >= sizes[i]), key=lambda b: (room[b], b), default=None)
        if fit is None:
            room.append(capacity)
            fit = len(room) - 1
        room[fit] -= sizes[i]
        want[i] = fit
    assert bins == want


def test_fewest_capacity():
    sizes = [random.Random(1).randint(1, 50) for _ in range(500)]
    bins = sharding.fewest_capacity(sizes, 8)
    load = Counter()
    for s, b in zip(sizes, bins):
        load[b] += s
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) <= 50


def test_groups_of_one_size_fill_runs_of_bins():
    sizes = [7] * 1000 + [3] * 10 + [250]
    bins = sharding.best_fit_decreasing(sizes, 100)
    load, held = Counter(), Counter()
    for s, b in zip(sizes, bins):
        load[b] += s
        held[b] += s == 7
    assert load.pop(bins[-1]) == 250 and max(load.values()) <= 100 and max(held.values()) == 14 and len(load) == 72
    assert len(sharding.fit_classes([(250, 1), (7, 1000), (3, 10)], 100)) <= 8


def test_small_capacity_holds_for_every_group(spark):
    texts = ["x" * (50 + i % 400) + str(i) for i in range(12_000)] + ["y" * 9_000, "y" * 8_999]
    got = sharding.assign_shards(table(spark, texts), None, capacity=6_000).groupBy("shard").agg({"size": "sum", "*": "count"}).toPandas()
    whole = got["sum(size)"].sum()
    assert got["count(1)"].sum() == len(texts) and sorted(got["sum(size)"])[-2:] == [9_000, 9_001]
    assert sorted(got["sum(size)"])[-3] <= 6_000 and len(got) - 2 <= 1.01 * (whole - 18_001) / 6_000 + 1


# ---- 2 simhash


def slow_print(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(sh)) if sh else 0


def groups(keys, near):
    label = {k: k for k in keys}
    find = lambda k: k if label[k] == k else find(label[k])
    for a, b in itertools.combinations(keys, 2):
        if near(a, b):
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash(spark, docs, empty, odd):
    want = {i: slow_print(t) for i, t in enumerate(rows())}
    comp = groups(list(want), lambda a, b: (want[a] ^ want[b]).bit_count() <= 3)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs, block=4).collect()}
    assert got == {i: (want[i], comp[i]) for i in want}
    assert simhash.near_duplicates(empty).count() == 0
    t = rows()
    low = {slow_print(t[8]): 3, slow_print(t[9]): 3, slow_print(None): 4, slow_print(t[10]): 9}
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert len({*low}) == 4 and got == Counter((d, slow_print(x), low[slow_print(x)]) for d, x in ODD)


def test_masks_cover():
    r = random.Random(3)
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            d = sum(1 << b for b in r.sample(range(64), radius))
            assert any(not d & m for m in masks)


def test_blocks_lose_no_link(spark):
    r = random.Random(5)
    prints = {r.getrandbits(64) - 2**63 for _ in range(3)}
    for p in list(prints):
        q = p
        for _ in range(60):  # a chain in one dense bucket
            q ^= 1 << r.randrange(20)
            prints.add(q)
    df = spark.createDataFrame([(0, p) for p in prints], "key int, fp long")
    links = simhash.blocked_links(df, ["key"], "fp", simhash.near_fingerprints(3), block=7)
    got = {x.node: x.component for x in components(links).collect()}
    want = groups(sorted(prints), lambda a, b: ((a ^ b) % 2**64).bit_count() <= 3)
    assert {k: got.get(k, k) for k in prints} == want


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def test_similar_groups(spark, empty):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(60, 200))]
        texts.append(" ".join(base))
        for _ in range(3):
            t = list(base)
            for _ in range(max(1, len(t) // r.choice((60, 100)))):
                t[r.randrange(len(t))] = word()
            texts.append(" ".join(t))
    texts += ["", None, "one", "One ", "one two"]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    close = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) if sets[a] | sets[b] else True
    want = groups(list(sets), close)
    docs = table(spark, texts)
    got = {x.doc_id: x.group_id for x in simhash.similar_groups(docs, block=3).collect()}
    assert got == want
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(set(want.values()))
    assert simhash.one_of_each_group(empty).count() == 0
    twice = table(spark, ["a b c", "a b c", "a b c"], [1, 1, None])
    assert [x.doc_id for x in simhash.one_of_each_group(twice).collect()] == [1]


# ---- 3 token files, encoder


def test_token_files(spark, docs, empty, odd, capsys):
    tok = Tokenizer.from_file(WORDS)
    path = f"{shared_folder(spark)}/files-{random.random()}"
    tokenfiles.write_token_files(docs, path, WORDS, 1, pack_bytes=2000)
    got = {r.doc_id: r for r in tokenfiles.read_token_files(spark, path).collect()}
    at = 0
    for i, t in enumerate(rows()):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        r = got[i]
        assert (r.start, r.n_tokens) == (at, len(ids)) and np.frombuffer(r.ids, "<u2").tolist() == ids
        at += len(ids)
    assert tokenfiles.read_document(spark, path, 9) == tok.encode(rows()[9], add_special_tokens=False).ids + [1]
    assert tokenfiles.read_document(spark, path, -5) is None
    assert [9 in r.doc_ids for r in tokenfiles.packs_of(spark, path, 9).collect()] == [True] and spark.read.parquet(f"{path}/packs").count() > 3
    tokenfiles.packs_of(spark, path, 9).explain("formatted")
    assert "GreaterThanOrEqual(last_id,9)" in capsys.readouterr().out
    for df, given in ((empty, []), (odd, ODD)):
        p = f"{path}-{len(given)}"
        tokenfiles.write_token_files(df, p, WORDS, 1)
        want, at = [], 0
        for d, t in sorted(given, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
            ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
            want.append((d, at, ids))
            at += len(ids)
        found = sorted(tokenfiles.read_token_files(spark, p).collect(), key=lambda r: r.start)
        assert [(r.doc_id, r.start, np.frombuffer(r.ids, "<u2").tolist()) for r in found] == want


ENCODERS = {}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aBéÉßİΣς1².,'’sl \n\t\xa0\x1ć日😀#!?ﬁÅ\x00<|>")) | st.characters(codec="utf-8"), max_size=40), max_size=8))
def test_word_encoder(texts):
    e = ENCODERS.setdefault("w", WordEncoder(WORDS, memo=200))
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in e.encode_many(texts)] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|StartOfText|>", "<|endof", "TEXT|>", "A", "b", "É", "日", " ", "\n", ".", "!", "<|"]), max_size=12).map("".join), max_size=6))
@example(["a <|ENDOFTEXT|> b"])
def test_word_encoder_special_strings(texts):
    e = ENCODERS.setdefault("w", WordEncoder(WORDS, memo=200))
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in e.encode_many(texts)] == want


# ---- 4 suffix arrays


def slow_dedup(texts, n=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            if w in seen:
                hit[i : i + n] = b"\1" * n
            seen.add(w)
        out.append((len(b), sum(hit), sum(1 for i in range(len(b)) if hit[i] and (not i or not hit[i - 1])), hashlib.sha256(bytes(x for x, h in zip(b, hit) if not h)).hexdigest()))
    return out


def test_memos_hold_no_long_words():
    """Texts without spaces leave nothing in the memos, and have the library's ids."""
    e, tok = WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    rnd = random.Random(2)
    texts = ["".join(rnd.choices(letters, k=n)) for letters, n in (("\u4e00\u4e8c\u4e09\u56db", 2000), ("abcdefgh", 3000)) for _ in range(20)]
    for text, ids in zip(texts, e.encode_many(texts)):
        assert np.frombuffer(ids, e.kind).tolist() == tok.encode(text, add_special_tokens=False).ids
    assert max(map(len, [*e.words, *e.parts])) <= 64


@pytest.mark.parametrize("most", [32_768, 2])
def test_suffix_dedup(spark, docs, empty, odd, most):
    want = slow_dedup(rows())
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in suffixdedup.remove_repeats(docs, 100, most).collect()}
    assert got == dict(enumerate(want))
    assert suffixdedup.remove_repeats(empty).count() == 0
    ordered = sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in suffixdedup.remove_repeats(odd).collect())
    assert got == Counter((d, *w) for (d, _), w in zip(ordered, slow_dedup([t for _, t in ordered])))


def test_suffix_dedup_tiles(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "TILE", 256)
    texts = [t for t in rows() if t] + ["ab" * 700]
    own = [suffixdedup.pd.DataFrame({"doc": range(len(texts)), "text": texts})]
    seen = Counter()
    for f in suffixdedup.anchor_rows(iter(own), 100):
        for d, p in zip(f.doc, f.place):
            for k in range(p & 255):
                seen[(d, (p >> 16) + k)] += 1
    assert seen == Counter({(i, s): 1 for i, t in enumerate(texts) for s in range(len(t.encode()) - 99)})


@pytest.mark.parametrize("collide", [False, True])
def test_suffix_dedup_repeats_inside_a_batch(monkeypatch, collide):
    """Equal contexts of a batch leave their anchor for its first one; colliding hashes of different bytes don't count."""
    if collide:
        monkeypatch.setattr(suffixdedup.xxhash, "xxh3_64_intdigest", lambda _: 7)
    r = random.Random(4)
    shared = "".join(r.choice("abcdefgh ") for _ in range(400))
    texts = [shared[:180] + "".join(r.choice("xyz") for _ in range(120)) + shared[180:] for _ in range(40)] + [shared] * 5
    made = list(suffixdedup.anchor_rows(iter([suffixdedup.pd.DataFrame({"doc": range(len(texts)), "text": texts})]), 100))
    assert len(made) == 1
    seen, late = set(), 0
    for doc, place, again in sorted(zip(made[0].doc, made[0].place, made[0].again)):
        start, count = place >> 16, place & 255
        part = (place & 0xFFFF, texts[doc][start : start + count + 99])
        assert not again or part in seen
        assert collide or again == (part in seen)
        seen.add(part)
        late += again
    assert late > 40


def test_merge_sorted_orders_suffixes():
    r = random.Random(9)
    parts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(300)]
    bounds = np.array([0, 1, 3, 3 + 64, 3 + 64 + 100, 300])
    s = suffixdedup.padded(parts)
    order, common = suffixdedup.run_numbers(s, bounds)
    for a, b in zip(bounds[:-1], bounds[1:]):
        assert [parts[i] for i in order[a:b]] == sorted(parts[a:b])
        for k in range(a + 1, b):
            x, y = parts[order[k - 1]], parts[order[k]]
            assert common[k] == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


# ---- 5 decontamination


def test_decontamination(spark, sf, empty, odd):
    r = random.Random(4)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(x.item_id, x.text) for x in bench.collect()]
    clean = [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    texts, planted = [], set()
    for q in range(60):
        i, t = r.choice(items)
        w = t.split()
        for _ in range(r.randint(0, int(0.15 * len(w)))):
            z = r.randrange(len(w))
            w[z : z + 1] = r.choice(([], ["zzq"], [w[z], "qqz"]))
        texts.append(r.choice(clean)[:500] + " " + " ".join(w) + " " + r.choice(clean)[:300])
        planted.add((q, i))
    texts += [None, "", items[0][1], items[0][1].upper(), "short"]
    docs = table(spark, texts)
    got = {(x.doc_id, x.item_id): x.edits for x in decontam.find_leaks(docs, bench).collect()}
    want = {}
    for (d, t), (i, item) in itertools.product(enumerate(texts), items):
        a, b = decontam.words_of(item.lower()), decontam.words_of((t or "").lower())
        edits = slow_edits(a, b)
        if edits <= int(0.2 * len(a)):
            want[(d, i)] = edits
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.95 * len(want) and len(planted - set(got)) <= 3
    flag = {x.doc_id for x in docs.where(decontam.leaked(bench, F.col("text"))).collect()}
    assert flag == {d for d, _ in got}
    assert decontam.find_leaks(empty, bench).count() == 0 and decontam.find_leaks(docs, bench.where("false")).count() == 0
    assert decontam.find_leaks(odd, spark.createDataFrame([(1, rows()[8]), (None, None), (2, "")], "item_id long, text string")).count() == 2


def slow_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=30))
def test_least_edits(item, text):
    assert decontam.least_edits(item, text)[0] == slow_edits(item, text)


# ---- 6 lines


def test_line_dedup(spark, empty):
    texts = ["head\nsame line \nown 1", None, "", *[f"own {i}\n same line\nmost {i % 2}" for i in range(12)], "same line\nsame line", "x\n\ny"]
    sources = [f"s{i}" if i != 4 else None for i in range(len(texts))]
    for lowest in (3, 10, 13):
        got = {r.doc_id: (r.text, r.removed) for r in linededup.remove_boilerplate(table(spark, texts, sources=sources), min_sites=lowest, counts=("lines", "removed")).collect()}
        sites, first = defaultdict(set), {}
        for i, t in enumerate(texts):
            for k, line in enumerate((t or "").split("\n")):
                key = line.strip(" ")
                if t and key:
                    sites[key].add(sources[i])
                    first.setdefault(key, (i, k))
        for i, t in enumerate(texts):
            lines = (t or "").split("\n")
            gone = [k for k, x in enumerate(lines) if x.strip(" ") and len(sites[x.strip(" ")]) >= lowest and first[x.strip(" ")] != (i, k)]
            want = t if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
            assert got[i] == (want, len(gone)), (i, lowest)
    assert linededup.remove_boilerplate(empty).count() == 0


def test_line_dedup_of_very_many_lines(spark):
    """Twelve documents of 100,000 lines share every other line; lines are kept in place, and the time is linear in them."""
    n = 100_000
    lines = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i % 2 == 0, F.concat(F.lit("shared "), i.cast("string"))).otherwise(F.concat(F.lit("own "), F.col("id").cast("string"), F.lit(" "), i.cast("string"))))
    docs = spark.range(12).select(F.col("id").alias("doc_id"), F.array_join(lines, "\n").alias("text"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"))
    started = time.monotonic()
    got = {r.doc_id: (r.removed, r.md5) for r in linededup.remove_boilerplate(docs, counts=("lines", "removed")).select("doc_id", "removed", F.md5("text").alias("md5")).collect()}
    assert time.monotonic() - started < 120
    kept = {d: "\n".join(f"own {d} {i}" if i % 2 else f"shared {i}" for i in range(n) if i % 2 or d == 0) for d in range(12)}
    assert got == {d: (0 if d == 0 else n // 2, hashlib.md5(t.encode()).hexdigest()) for d, t in kept.items()}


@pytest.mark.parametrize("gone", [[0], [4], [0, 1, 2], [1, 3, 4], [0, 5]])
def test_staying(spark, gone):
    flags = spark.createDataFrame([(gone,)], "g array<int>").select(linededup.staying(F.col("g"))).first()[0]
    assert flags == [i not in gone for i in range(max(gone) + 1)]


def test_line_dedup_names_and_repeats(spark):
    """Columns named like private ones come back; repeated rows and rows without a doc_id are cut as one document each."""
    rows = [(i, f"same\nown {i}", f"s{i}") for i in range(3)] + [(2, "same\nown 3", "s9"), (None, "same", "s8"), (None, "x\nsame", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'g' as __gone", "7 as __DOC", "'l' as __lines", "text as __removed", "'a b' as `a.b`")
    out = linededup.remove_boilerplate(df, min_sites=3)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text, r["__gone"], r["__DOC"], r["__lines"], r["__removed"], r["a.b"]) for r in out.collect()), key=str)
    # the first "same" is the one of the rows without a doc_id, which come first, at their position 0
    want = [(0, "own 0"), (1, "own 1"), (2, "own 2"), (2, "own 3"), (None, "same"), (None, "x")]
    assert [x[:2] for x in got] == want and all((x[2], x[3], x[4], x[6]) == ("g", 7, "l", "a b") for x in got)
    assert sorted(x[5] for x in got) == sorted(t for _, t, _ in rows)
    with pytest.raises(ValueError):
        linededup.remove_boilerplate(df, counts=("__LINES", "n"))


# ---- 7 top-k


def test_topk(spark):
    r = random.Random(2)
    vec = [(i, [round(r.uniform(-1, 1), 3) for _ in range(6)] if i % 17 else [0.5] * 6) for i in range(230)]
    vec += [(300, None), (400, []), (500, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (501, [float("nan")] * 6), (502, [float("inf")] * 6), (None, [1.0] * 6), (600, [0.1, 0.2]), (5, vec[5][1]), (100, vec[100][1])]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    held = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in vec if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    asked = {i: v for i, v in held if i % 100 == 0}
    want = {}
    for q, v in asked.items():
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in held if i != q and len(w) == len(v))[:10]
        want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(s)]
    got = defaultdict(list)
    for x in topk.exact_topk(df, F.col("vec_id") % 100 == 0, 10, shard=16, block=2).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    assert dict(got) == {q: w for q, w in want.items() if w}
    assert topk.exact_topk(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


# ---- 8 packing


def test_packing(spark, docs, empty, odd):
    tok, texts = Tokenizer.from_file(WORDS), rows()
    got = packing.pack(docs, WORDS, 2, length=64).toPandas()
    for d, g in got.sort_values("start").groupby("doc_id"):
        ids = tok.encode(texts[d] or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in g.itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert got.doc_id.nunique() == len(texts)
    fill = got.groupby("sequence_id").length.sum()
    assert (fill.sort_index().iloc[:-1] == 64).all() and sorted(fill.index) == list(range(len(fill)))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    assert packing.pack(empty, WORDS, 2).count() == 0
    want = sum(len(tok.encode(rows()[i] or "", add_special_tokens=False).ids) + 1 for i in (8, 8, 9, 10, 10, 10)) + 1
    assert packing.pack(odd, WORDS, 2).agg(F.sum("length")).first()[0] == want


def slow_round_robin(queues, quanta, part):
    """Packets in the order a deficit round-robin pays them; ``queues`` holds lists of sizes."""
    left = {q: [min(part, n - at) for n in sizes for at in range(0, n, part)] for q, sizes in queues.items()}
    deficit, paid = dict.fromkeys(queues, 0.0), []
    while any(left.values()):
        share = sum(quanta[q] for q in queues if left[q])
        for q in sorted(queues):
            if left[q]:
                deficit[q] += quanta[q] / share * sum(quanta.values())
            while left[q] and deficit[q] >= left[q][0] - 1e-6:
                deficit[q] -= left[q][0]
                paid.append((q, left[q].pop(0)))
    return paid


def test_packing_round_robin(spark):
    """Payments and their order against a plain round-robin, with the corpus's own shares."""
    tok, r = Tokenizer.from_file(WORDS), random.Random(8)
    texts = [" ".join(["the"] * r.choice((1, 3, 10, 40, 90))) for _ in range(240)]
    sources = [r.choice("aaab") for _ in texts]
    got = packing.pack(table(spark, texts, sources=sources), WORDS, 2, length=64, part=16).toPandas().sort_values(["sequence_id", "offset"])
    order = got.groupby(["queue", "doc_id"]).apply(lambda g: g.sort_values("start").iloc[0], include_groups=False).reset_index().sort_values(["sequence_id", "offset"])
    sizes = {q: [int(n) for n in g.doc_tokens] for q, g in order.groupby("queue")}
    whole = sum(map(sum, sizes.values()))
    want = slow_round_robin(sizes, {q: 64 * sum(n) / whole for q, n in sizes.items()}, 16)
    flat = [q for q, n in want for _ in range(n)]
    assert flat == [q for q, n in zip(got.queue, got.length) for _ in range(n)]
    cut = got[(got.start > 0) & (got.start % 16 > 0)]
    assert (cut.offset == 0).all()  # besides long documents' parts only windows' ends cut
    assert len(tok.encode(texts[0], add_special_tokens=False).ids) + 1 == got[got.doc_id == 0].doc_tokens.iloc[0]


def test_packing_targets(spark):
    texts = ["the cat"] * 300
    docs = table(spark, texts, sources=["a", "b", "c", None, "d", "d"] * 50)
    got = packing.pack(docs, WORDS, 2, length=30, targets={"a": 0.4, None: 0.2, "b": 0.2}).toPandas()
    assert got.length.sum() == 900 and set(got.queue) == {"=a", "=b", "none", "rest"}
    early = got[got.sequence_id < 10].groupby("queue").length.sum()
    for q, share in (("=a", 0.4), ("none", 0.2), ("=b", 0.2), ("rest", 0.2)):
        assert abs(early[q] - 300 * share) <= 3 + 30 * share
    late = got[got.sequence_id >= 20]
    assert set(late.queue) == {"rest"} or late.groupby("queue").length.sum()["rest"] > 100  # others ran dry
    with pytest.raises(ValueError):
        packing.pack(docs, WORDS, 2, targets={"a": 1.0})


# ---- 9 toxicity


def test_toxicity(spark, sf, empty, odd):
    sf1 = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf1}/documents.parquet"), spark.read.parquet(f"{sf1}/labels.parquet")
    found = toxicity.score_documents(docs, labels).join(labels, "doc_id").select("held_out", "score", "predicted", "toxic").toPandas()
    held = found[found.held_out]
    hit = held[held.predicted == 1]
    assert (hit.toxic == 1).mean() >= 0.8 and (held[held.toxic == 1].predicted == 1).mean() >= 0.85
    assert held.score.between(0, 1).all()
    small = table(spark, rows())
    for lab in (labels.where("false"), labels.limit(5), labels.withColumn("toxic", F.lit(None).cast("int"))):
        out = toxicity.score_documents(small, lab).collect()
        assert len(out) == len(rows()) and all(0 <= x.score <= 1 for x in out)
    assert toxicity.score_documents(empty, labels.limit(5)).count() == 0
    plain = toxicity.score_documents(odd, labels.where("false")).collect()  # nothing learned: the sample's rate, none
    assert Counter((r.doc_id, r.held_out, r.score, r.predicted) for r in plain) == Counter((d, d is not None and zlib.crc32(str(d).encode()) % 5 == 0, 0.0, 0) for d, _ in ODD)


def test_noisy_or_locates():
    m = toxicity.Model({"bad": 12.0}, -8.0)
    s = m.sentence_scores("all fine. a BAD one! good")
    assert [x > 0.5 for x in s] == [False, True, False] and m.document(s) > 0.9 and m.document([]) == 0


def slow_score(text, weights, bias):
    """A document's noisy-or, sentence by sentence and word by word."""
    clear = 1.0
    for sentence in re.split(r"[.!?\n]", (text or "").lower()):
        words = re.findall(r"[^\W_]+", sentence)
        if words:
            logit = bias + sum(weights.get(f, 0.0) for w in words for f in [w, *("^" + w[:n] for n in (3, 4, 5, 6) if len(w) > n)])
            clear *= 1 - 1 / (1 + np.exp(-logit))
    return 1 - clear


def test_scores_and_slope_against_slow_ones(spark):
    r = random.Random(12)
    pool = ["idiot", "idiotic", "kind", "day", "worthless", "worth", "tree", "é", "a"]
    texts = ["".join(r.choice(pool) + r.choice((" ", ". ", "!\n", "_", "? ")) for _ in range(r.randint(1, 40))) for _ in range(60)] + [None, "", "...", "idiot " * 3]
    toxic = [int("idiot" in (t or "") and r.random() < 0.9) for t in texts]
    names = {f: i for i, f in enumerate(["idiot", "^idio", "worthless", "^wor", "kind"])}
    x = np.array([2.0, 0.7, 1.5, -0.3, -1.0, -2.5])
    model = toxicity.Model({f: x[i] for f, i in names.items()}, x[-1])
    want = [slow_score(t, model.weights, model.bias) for t in texts]
    assert np.allclose([model.document(model.sentence_scores(t)) for t in texts], want)
    docs = table(spark, texts)
    found = {d.doc_id: d.s for d in docs.select("doc_id", toxicity.score_column(model).alias("s")).collect()}
    assert np.allclose([found[i].score for i in range(len(texts))], want)
    assert all(found[i].offending == [] for i in (60, 61, 62)) and [o.sentence for o in found[63].offending] == [0]
    sample = spark.createDataFrame(list(zip(texts, toxic)), "text string, toxic int")
    bags = toxicity.Bags(toxicity.reduced_bags(sample, names).collect())

    def slow_loss(x, decay):
        w, total = {f: x[i] for f, i in names.items()}, 0.0
        for t, y in zip(texts, toxic):
            p = slow_score(t, w, x[-1])
            total -= np.log(max(p, 1e-9)) if y else np.log(1 - p)
        return total / len(texts) + decay / 2 * (x[:-1] ** 2).sum()

    loss, slope = bags.loss_and_slope(x, 0.01)
    assert np.isclose(loss, slow_loss(x, 0.01))
    for i in range(len(x)):
        step = np.eye(len(x))[i] * 1e-5
        assert np.isclose(slope[i], (slow_loss(x + step, 0.01) - slow_loss(x - step, 0.01)) / 2e-5, atol=1e-6)


# ---- 10 token counts

COUNTER, MODEL = tokencount.PieceCounter(PIECES, memo=50), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab the<s>/é日▁ \n\t\xa0\x00ｆ.,'")) | st.characters(codec="utf-8"), max_size=60))
def test_piece_counts(text):
    assert COUNTER.count(text) == len(MODEL.encode(text))


def test_token_counts(spark, docs, empty, odd):
    texts = rows()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(docs, PIECES, 100).collect()}
    for i, t in enumerate(texts):
        n = len(MODEL.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 100)
    assert tokencount.count_tokens(empty, PIECES, 1).count() == 0
    got = Counter(tuple(r) for r in tokencount.count_tokens(odd, PIECES, 1).collect())
    assert got == Counter((d, len((t or "").encode()), len(MODEL.encode(t or "")), len(MODEL.encode(t or "")) > 1) for d, t in ODD)
