"""The corpus operators against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import (
    chat_format,
    common,
    decontamination,
    exact_dedup,
    language_id,
    mixing,
    near_dedup,
    quality,
    sentence_spans,
    suffix_array,
    url_filter,
)
from foliospark.llm.common import WORD_BYTES, drop_tables, recording, stored
from foliospark.llm.induced_sort import suffix_array as sort_suffixes

SF = "/root/testdata/sf0.001"
# extra columns whose names operators might use themselves
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, at string, node long, text_hash string, spans string, n_removed string, rate string"
LONG = " ".join(f"wort{i}" for i in range(30_000))
SENTENCES = "One two three four five six. Seven eight nine ten eleven twelve! Thirteen fourteen fifteen sixteen seventeen? Eighteen nineteen twenty."


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), 1, "x", 5, "h", "s", "n", "r")


ROWS = [
    row(1, SENTENCES),
    row(2, SENTENCES.upper()),
    row(3, None, None, None),
    row(4, ""),
    row(5, "!!! ??? ..."),
    row(6, "Straße ÄÖÜ", "de", "b"),
    row(6, "Straße ÄÖÜ", "de", "b"),
    row(7, LONG),
    row(8, LONG + " ende"),
    row(None, "no id here"),
    row(9, SENTENCES + " Closing words."),
    row(9, "same id, other text"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().translate(WORD_BYTES).split()


# --------------------------------------------------------------------------- 1


def brute_leaks(text, items, window=10):
    w = words(text)
    hit, named = set(), set()
    for item, t in items:
        b = words(t)
        for k in range(max(1, len(b) - window + 1) if b else 0):
            g = b[k : k + window]
            for s in range(len(w) - len(g) + 1):
                if w[s : s + len(g)] == g:
                    hit.update(range(s, s + len(g)))
                    named |= {item} - {None}
    return len(w), len(hit), sorted(map(str, named))


ITEMS = [(10, "nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"), (10, "nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"), (2, "Straße äöü"), (None, "other text"), (4, None), (5, "!"), (6, "wort29999 ende"), (7, "wort5 wort7")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_leaks_match_brute_force(spark, docs, block_bytes):
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    leaks = decontamination.find_leaks(docs, benchmark, block_bytes=block_bytes, shard_bytes=2000)
    got = decontamination.digest(leaks).collect()
    want = Counter()
    for r in ROWS:
        n, h, items = brute_leaks(r[1], ITEMS)
        want[(r[0], n, h, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), h > 0)] += 1
    assert Counter(map(tuple, got)) == want


def test_leaks_by_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha x x x beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    exact = decontamination.digest(decontamination.find_leaks(docs, bench)).where("contaminated").count()
    near = decontamination.digest(decontamination.find_leaks(docs, bench, slop=1)).where("contaminated").collect()
    assert exact == 0 and [r.doc_id for r in near] == [1]


def test_leaks_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(empty, none).count() == 0
    assert decontamination.digest(decontamination.find_leaks(docs, none)).where("contaminated").count() == 0
    assert decontamination.drop_leaks(docs, none).columns == docs.columns


def test_drop_leaks_keeps_the_clean_row_of_a_shared_id(spark, docs):
    bench = spark.createDataFrame([(1, "same id other")], "item_id long, text string")
    left = decontamination.drop_leaks(docs, bench)
    assert left.count() == len(ROWS) - 1 and left.where("doc_id = 9").count() == 1


# --------------------------------------------------------------------------- 2


def test_mixing_reaches_the_weights(spark):
    rows = [(i, "t", "big" if i % 10 else "small", "x") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate string")
    out = mixing.replicate(docs, {"big": 1, "small": 3, "absent": 9})
    n = dict(out.groupBy("source").count().collect())
    assert 0.7 < n["small"] / sum(n.values()) < 0.8
    assert out.columns == [*docs.columns, "copy_no", "shuffle_key"]
    per = out.where("source = 'small'").groupBy("doc_id").count().toPandas()["count"]
    assert abs(per.sum() / 400 - 7.5) < 0.5
    once = sorted(map(tuple, out.select("doc_id", "copy_no").collect()))
    again = sorted(map(tuple, mixing.replicate(docs.repartition(7), {"big": 1, "small": 3}).select("doc_id", "copy_no").collect()))
    assert once == again


def test_mixing_high_rates_and_salted_sources(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "t", "rare" if i < 3 else "s") for i in range(300)], "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.replicate(docs).select("doc_id", "copy_no").collect()))
    assert 100 < sum(1 for d, _ in want if d < 3) < 200  # rate 50 in two parts
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.replicate(docs).select("doc_id", "copy_no").collect())) == want


def test_mixing_awkward_rows(docs, empty):
    out = mixing.replicate(docs)
    assert out.columns == [*docs.columns, "copy_no", "shuffle_key"] and out.count() >= 0
    assert out.explain is not None and out._jdf.queryExecution().optimizedPlan().toString().lower().count("md5(") <= 8
    assert mixing.replicate(empty).count() == 0
    assert mixing.replicate(docs, {}).count() == 0


# --------------------------------------------------------------------------- 3


def bag(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(3)
    ratios = []
    for _ in range(30):
        base = [rng.randrange(40) for _ in range(120)]
        other = [x if rng.random() < 0.9 else rng.randrange(40) for x in base]
        m = 1024
        bags = [Counter(base), Counter(other)]
        doc = np.repeat([0, 1], [len(b) for b in bags])
        element = near_dedup.mix64(np.array([x for b in bags for x in b], np.uint64))
        weight = np.array([n for b in bags for n in b.values()])
        sig = near_dedup.bag_minhash(doc, element, weight, 2, m)
        ratios.append((sig[0] == sig[1]).mean() - jaccard(*bags))
    assert abs(np.mean(ratios)) < 0.01 and np.std(ratios) < 0.03


def brute_classes(rows):
    bags = {(d, t): bag(t) for d, t in rows}
    keys = list(bags)
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bags[a] and bags[b] and jaccard(bags[a], bags[b]) >= 0.8:
                root[find(a)] = find(b)
    groups = defaultdict(set)
    for k in keys:
        groups[find(k)].add(k)
    return sorted(sorted(g, key=str) for g in groups.values())


def near_groups(df):
    return df


def test_near_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 150]))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = [x if rng.random() > rng.choice([0, 0.01, 0.03]) else rng.choice(vocabulary) for x in base]
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = defaultdict(list)
    for r in near_dedup.near_duplicates(docs).collect():
        got[r.class_id].append((r.doc_id, rows[r.doc_id][1]))
    assert sorted(sorted(g, key=str) for g in got.values()) == brute_classes(rows)


def test_near_dedup_recall_of_all_links(spark):
    """Every pair of sf0.01 that is similar enough, found through shared shingles, against the classes."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    bags = {d: bag(t) for d, t in rows}
    having = defaultdict(list)
    for d, b in bags.items():
        for shingle in b:
            having[shingle].append(d)
    pairs = {(a, b) for ids in having.values() for i, a in enumerate(ids) for b in ids[i + 1 :]}
    size = {d: sum(b.values()) for d, b in bags.items()}
    links = {(a, b) for a, b in pairs if min(size[a], size[b]) >= 0.8 * max(size[a], size[b]) and jaccard(bags[a], bags[b]) >= 0.8}
    class_of = {r.doc_id: r.class_id for r in near_dedup.op3_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    kept = sum(class_of[a] == class_of[b] for a, b in links)
    print(f"{kept} of {len(links)} links are within a class")
    assert len(links) > 50 and kept == len(links)
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {d: find(d) for d in root} == class_of  # and no class holds more than the links say


def test_near_dedup_awkward_rows(docs, empty):
    out = Counter((r.doc_id, r.class_id, r.class_size, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    one = [(1, 1, 3, True), (2, 1, 3, False), (9, 1, 3, False), (7, 7, 2, True), (8, 7, 2, False), (3, 3, 1, True), (4, 4, 1, True), (5, 5, 1, True), (6, 6, 2, True), (6, 6, 2, False), (None, None, 1, True), (9, 9, 1, True)]
    assert out == Counter(one)
    left = near_dedup.near_dedup(docs)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids == Counter({1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, None: 1, 9: 1})
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.near_dedup(empty).count() == 0


# --------------------------------------------------------------------------- 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120), st.integers(1, 6), st.sampled_from([64, 1 << 20]))
def test_suffixes_are_sorted(symbols, times, budget):
    text = np.array(symbols * times, np.int16)
    flat = text.tolist()
    assert sort_suffixes(text, 5, budget).tolist() == sorted(range(len(flat)), key=lambda i: flat[i:])


def test_suffixes_of_large_alphabets_and_long_runs():
    rng = np.random.default_rng(4)
    for text in (rng.integers(0, 5000, 20_000), np.repeat(rng.integers(0, 9, 50), 400), np.tile(rng.integers(0, 300, 700), 20)):
        flat = text.tolist()
        got = sort_suffixes(text.astype(np.int32), 5001, 1 << 16).tolist()
        assert sorted(got) == list(range(len(flat)))
        assert all(flat[a : a + 900] <= flat[b : b + 900] for a, b in zip(got[::7], got[1::7]) if abs(a - b) > 0) or got == sorted(range(len(flat)), key=lambda i: flat[i:])


def brute_repeats(texts, length):
    places = defaultdict(int)
    raw = [(t or "").encode() for t in texts]
    for t in raw:
        for p in range(len(t) - length + 1):
            places[t[p : p + length]] += 1
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if places[t[p : p + length]] > 1:
                gone[p : p + length] = True
        edges = np.diff(np.r_[0, gone.astype(int), 0])
        out.append((len(t), int(gone.sum()), int((edges == 1).sum()), bytes(b for b, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("length,seed", [(20, 8), (12, 12), (20, 3)])
def test_repeats_match_brute_force(spark, length, seed):
    rng = random.Random(length + seed)
    parts = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(1, 70))) for _ in range(40)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(6))) for _ in range(60)]
    texts += ["ab" * 50, "x" * 90, None, "", texts[0], texts[0]]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, texts[1], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(4)
    want = Counter((r[0], *w) for r, w in zip(rows, brute_repeats([r[1] for r in rows], length)))
    out = suffix_array.drop_repeats(docs, length, seed, 3000).collect()
    assert Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in out) == want


def test_repeats_of_hot_anchors_match_brute_force(spark):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choices("abcdefgh", k=n))
    common = noise(26)  # one passage in many surroundings: many kinds of segment at its anchors
    rows = [(i, noise(rng.randrange(40)) + common[: rng.choice([19, 23, 26])] + noise(rng.randrange(40))) for i in range(150)]
    rows += [(200, common * 3), (201, rows[5][1]), (202, None), (203, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter((r[0], *w) for r, w in zip(rows, brute_repeats([r[1] for r in rows], 20)))
    # most kinds at an anchor: divided, and sorted in one shard with queues beyond their budget
    for hot_bytes, divided in ((640, True), (1 << 20, False)):
        paths: list[str] = []
        with recording(paths):
            out = suffix_array.drop_repeats(docs, 20, 8, 1 << 20, hot_bytes, 1 << 10)
            got = Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in out.collect())
        assert got == want
        assert any("/windows-" in p for p in paths) == divided


def test_repeats_awkward_rows(docs, empty):
    got = suffix_array.drop_repeats(docs).collect()
    assert len(got) == len(ROWS)
    assert suffix_array.drop_repeats(empty).count() == 0


def test_anchors_do_not_depend_on_pieces():
    text = bytes(random.Random(1).choices(b"abcd", k=5000))
    whole = suffix_array.anchors(text, 40, 16)
    pieces = suffix_array.anchors(text, 40, 16, piece=333)
    assert all((a == b).all() for a, b in zip(whole, pieces))


# --------------------------------------------------------------------------- 5


def test_exact_groups(docs, empty):
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect())
    assert got == Counter([(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 2, True), (6, 6, 2, False), (7, 7, 1, True), (8, 8, 1, True), (None, None, 1, True), (9, 9, 1, True), (9, 9, 1, True)])
    left = exact_dedup.exact_dedup(docs)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 3
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0


def test_exact_groups_with_heavy_hitters(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 1500}") for i in range(3000)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), support=0.01).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = {(i, max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t in rows}
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == want


# --------------------------------------------------------------------------- 6

URLS = [
    ("http://a.example.net/en/x", "example.net/en/", "allow"), ("http://a.example.net/de/x", "net/", "block"), ("https://NET/", "net/", "block"), ("https://net", None, "allow"),
    ("ftp://x.example.com/de/?q#f", "example.com/de/", "block"), ("http://badexample.com/de/", None, "allow"), ("http://x.org/fr/a", "org/fr/", "allow"), ("no scheme", None, "allow"),
    (None, None, "allow"), ("http://?x", None, "allow"), ("://net/", "net/", "block"), ("", None, "allow"), ("http://net?/", None, "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, (u, _, _) in enumerate(URLS)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(list(url_filter.RULES), "verdict string, host string, path string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {i: w for i, (_, *w) in enumerate(URLS) for w in [tuple(w)]}
    assert url_filter.filter_urls(pages, rules.limit(0)).where("rule IS NOT NULL").count() == 0
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_url_rules_of_any_number(spark):
    """A list over the bound for constants gives the same rows, out of tables; so do very many path lengths."""
    rng = random.Random(6)
    urls = ["http://" + rng.choice(["a.", "", "b.c."]) + rng.choice(["net", "example.com", "x.org"]) + "/" + "de/"[: rng.randrange(4)] + "p" * rng.randrange(60) for _ in range(300)]
    urls += [None, urls[0], urls[0], "http://net/" + "p" * 20_000]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(3)
    made = [("block", "net", "/" + "p" * k) for k in range(0, 90, 7)] + [("allow", "x.org", "/d" + "e" * (k % 2) + "x" * k) for k in range(40)] + [("allow", "a.net", "/ppp"), ("block", None, "/"), ("allow", "net", None)]
    made += [("block", f"other{i}.example", "/") for i in range(200)]
    rules = spark.createDataFrame(made, "verdict string, host string, path string")
    few = sorted(map(tuple, url_filter.filter_urls(pages, rules).collect()), key=str)
    many = sorted(map(tuple, url_filter.filter_urls(pages, rules, constant_bytes=0).collect()), key=str)
    assert few == many and len(few) == len(urls)
    for _, url, host, path, rule, verdict in [(r[0], r[1], *r[2:]) for r in map(tuple, url_filter.filter_urls(pages, rules).select("page_id", "url", "host", "path", "rule", "verdict").collect())]:
        fit = [(len(h + p), v == "block", h + p) for v, h, p in made if h and p and (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (rule, verdict) == ((max(fit)[2], "block" if max(fit)[1] else "allow") if fit else (None, "allow"))


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 2)  # many false positives, so several levels
    monkeypatch.setattr(url_filter, "MAX_HASHES", 1)
    monkeypatch.setattr(url_filter, "SPLIT_KEYS", 100)
    listed = spark.range(0, 300).selectExpr("concat('k', id) AS key")
    universe = spark.range(0, 3000).selectExpr("array(concat('k', id)) AS keys")
    keys = spark.range(0, 3000).selectExpr("id", "concat('k', id) AS key")
    for most, splits in ((None, 1), (0, 3)):
        cascade = url_filter.Cascade(listed, universe, most)
        assert len(cascade.levels) > 2 and cascade.splits == splits
        assert sorted(r.id for r in cascade.ask(keys, "listed").where("listed").collect()) == list(range(300))


# --------------------------------------------------------------------------- 7


def test_ppm_code_lengths_by_hand():
    model = language_id.train({"x": [b"aab"]}, order=1)
    tables = language_id.flatten(model)
    # order 0 of 'aab': a 2, b 1, n 3, q 2; the text is preceded by a blank
    log = np.log2
    a0, b0 = log(5 / 2), log(5 / 1)
    want = log(2 / 1) + log(4 / 1) + log(4 / 1)  # after ' ': a 1; after a: a 1, b 1
    assert abs(language_id.code_lengths(tables, [b"aab"])[0, 0] - want) < 1e-5
    after_b = log(2 / 1) + log(4 / 1) + a0  # b never had a next symbol: order 0 at no cost
    assert abs(language_id.code_lengths(tables, [b"aba"])[0, 0] - after_b) < 1e-5
    unseen = log(2 / 1) + log(4 / 2) + log(5 / 2) + 8  # escape after a, escape of order 0, 8 bits
    assert abs(language_id.code_lengths(tables, [b"az"])[0, 0] - unseen) < 1e-5
    assert b0 > a0


class BruteTree:
    """A context tree of dictionaries, with escapes taken one at a time."""

    def __init__(self, texts, order=3):
        self.order, self.counts = order, defaultdict(Counter)
        for t in texts:
            padded = b" " * order + t
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    self.counts[padded[i - k : i]][padded[i]] += 1

    def bits(self, t):
        padded, out = b" " * self.order + t, 0.0
        for i in range(self.order, len(padded)):
            for k in range(self.order, -1, -1):
                seen = self.counts.get(padded[i - k : i])
                if seen is None:
                    continue
                n, q = sum(seen.values()), len(seen)
                if padded[i] in seen:
                    out += math.log2((n + q) / seen[padded[i]])
                    break
                out += math.log2((n + q) / q)
            else:
                out += 8
        return out


def test_language_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    by = defaultdict(list)
    for r in rows:
        if not held[r.doc_id] and r.lang is not None and r.text is not None:
            by[r.lang].append(r.text.encode())
    assert all(len(t) < language_id.SAMPLE_DOCS and sum(map(len, t)) < language_id.SAMPLE_BYTES for t in by.values())
    trees = {lang: BruteTree(t) for lang, t in sorted(by.items())}
    got = {r.doc_id: r for r in language_id.op7_language_id(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows[:120]:
        t, mine = (r.text or "").encode(), got[r.doc_id]
        assert mine.held_out == held[r.doc_id]
        if not any(c.isalpha() for c in r.text or ""):
            assert (mine.lang_pred, mine.score) == ("und", 0)
            continue
        bits = {lang: tree.bits(t) for lang, tree in trees.items()}
        best = min(bits, key=bits.get)
        p = 1 / sum(math.exp(min(700, (bits[best] - b) / math.sqrt(len(t)))) for b in bits.values())
        assert mine.lang_pred == best and abs(mine.score - p) < 1e-3


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=4), st.lists(st.binary(max_size=30), min_size=1, max_size=5), st.integers(1, 4))
def test_code_lengths_match_brute_force(known, texts, order):
    tables = language_id.flatten(language_id.train({"a": known, "b": known[:1], "c": [b"abc" * 9]}, order=order))
    got = language_id.code_lengths(tables, texts)
    want = [[BruteTree(k, order).bits(t) for k in (known, known[:1], [b"abc" * 9])] for t in texts]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.op7_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and out.score.between(0, 1).all()


def test_language_sample_skips_texts_that_do_not_fit(spark):
    rows = [(i, ("long " * 1000 if i % 2 else "short text") + f" {i:04}", "en") for i in range(60)]
    rows += [(100, "a" * 3000 + "b" * 3000, "xx")]  # no text of this language fits
    sample = language_id._sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 20, 1000)
    assert len(sample["en"]) == 20 and all(t.startswith(b"short") for t in sample["en"])
    assert 0 < sum(map(len, sample["xx"])) <= 1000
    assert language_id.spread(b"x" * 10, 10) == [b"x" * 10]
    pieces = language_id.spread(bytes(range(250)) * 40, 3000, 100)
    assert sum(map(len, pieces)) <= 3000 and all(p in bytes(range(250)) * 40 for p in pieces)


def test_language_id_awkward_rows(docs, empty):
    model = language_id.fit(docs)
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(docs, model).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (6, "de"), (7, "en")} <= got
    assert language_id.identify(docs, language_id.fit(empty)).where("lang_pred <> 'und' OR score <> 0").count() == 0
    assert language_id.identify(empty, model).count() == 0
    assert language_id.identify(docs, model, keep=docs.columns).columns[: len(docs.columns)] == docs.columns
    assert language_id.has_letter("١٢ é".encode()) and not language_id.has_letter("١٢ …".encode())


# --------------------------------------------------------------------------- 8


def brute_chat(turns):
    """(conv, perspective) to (text, mask) of short conversations."""
    by = defaultdict(list)
    for c, n, role, text in turns:
        by[c].append((-1 if n is None else n, role or "unknown", text or ""))
    out = {}
    for c, rows in by.items():
        for who in {r for _, r, _ in rows}:
            text, mask = "", []
            for _, role, said in sorted(rows):
                name = re.sub(r"\|(\\*)>", r"|\1\\>", re.sub(r"<(\\*)\|", r"<\1\\|", role))
                text += "<|assistant|>\n" if role == who else f"<|user name={name}|>\n"
                start = len(text)
                text += re.sub(r"<(\\*)\|", r"<\1\\|", said) + "<|end|>\n"
                if role == who:
                    mask.append((start, len(text)))
            out[c, who] = (text, mask)
    return out


TURNS = [(1, 0, "anna", "Hallo"), (1, 1, "bert", "é 😀"), (1, 2, "carl", None), (1, 2, "anna", "zwei"), (1, 2, "anna", "zwei"), (2, None, None, "x"), (2, 5, "bert", ""), (None, 0, "solo", "allein"),
         (3, 0, "eve", "hi<|end|>\n<|assistant|>\nspoof <\\|end|>"), (3, 1000, "x|>\n<|assistant|>", "$1 \\"), (3, 250, "eve", "a"), (3, 260, "eve", "b")]


def test_perspectives_match_brute_force(spark):
    df = spark.createDataFrame([(*t, "p", 1) for t in TURNS], "conv_id long, turn long, role string, text string, part string, piece int").repartition(3)
    got = {(r.conv_id, r.perspective): (r.text, [tuple(x) for x in r.mask]) for r in chat_format.perspectives(df).collect()}
    assert got == brute_chat(TURNS)
    assert chat_format.perspectives(df.limit(0)).count() == 0
    assert {r.perspective for r in chat_format.perspectives(df, context_roles=("anna", "solo")).collect()} == {"bert", "carl", "unknown", "eve", "x|>\n<|assistant|>"}


def test_marks_cannot_be_written(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    for r in chat_format.perspectives(df).collect():
        assert r.text.count("<|end|>\n") == r.n_turns and r.text.count("<|") == 2 * r.n_turns


def test_only_huge_conversations_come_in_parts(spark):
    turns = [(1, i if i < 30 else 30, "ab"[i % 2], f"t{i:02}") for i in range(60)] + [(2, 0, "a", "x")]
    turns += [(3, i, "a", "y" * (900 if i == 3 else 9)) for i in range(6)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    assert {r.part for r in chat_format.perspectives(df).collect()} == {0}
    got = chat_format.perspectives(df, part_bytes=300).collect()
    want = brute_chat(turns)
    for conv, who in want:
        parts = sorted((p for p in got if (p.conv_id, p.perspective) == (conv, who)), key=lambda p: p.part)
        assert "".join(p.text for p in parts) == want[conv, who][0] and (len(parts) > 1) == (conv != 2)
        at = np.cumsum([0] + [len(p.text) for p in parts]).tolist()
        assert [(a + s.start, a + s.end) for a, p in zip(at, parts) for s in p.mask] == want[conv, who][1]


# --------------------------------------------------------------------------- 9


def brute_sentences(text, long=13, window=8):
    """(words, text) of each sentence, by the definition, a word at a time; what stands before the first word."""
    found = list(re.finditer(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", text))
    lead = text[: found[0].start()] if found else text
    whole, now = [], []
    for k, m in enumerate(found):
        stop = found[k + 1].start() if k + 1 < len(found) else len(text)
        now.append((m[0].translate(LOW), text[m.start() : stop]))
        gap = text[m.end() : stop]
        if "\n" in gap or re.search(r"(?s)[.!?].*[ \t\r]", gap) or k + 1 == len(found):
            whole.append(now)
            now = []
    out = []
    for said in whole:
        ends = {len(said) - 1}
        if len(said) > long:
            for k in range(len(said) - window + 1):
                ends.add(min(range(k, k + window), key=lambda i: (hashlib.md5(said[i][0].encode()).hexdigest()[:12], -i)))
        at = 0
        for e in sorted(ends):
            out.append((tuple(w for w, _ in said[at : e + 1]), "".join(t for _, t in said[at : e + 1])))
            at = e + 1
    return lead, out


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_runs(said, run=2, least=24):
    got = []
    for i in range(len(said)):
        for j in range(i + run, len(said) + 1):
            if sum(len(w) for w, _ in said[i:j]) >= least:
                got.append((i, j))
                break
    if said and (not got or got[-1][1] < len(said)):
        got.append((got[-1][0] if got else 0, len(said)))
    return got


def brute_spans(rows, run=2, least=24):
    """What is left of each row (in order of doc_id; rows with equal ids must be equal), sentences and sentences lost."""
    seen, out, done = set(), [], set()
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lead, said = brute_sentences(t or "")
        gone = set(range(len(said))) if (d, t) in done and t is not None else set()
        done.add((d, t))
        for i, j in brute_runs(said, run, least):
            key = sum((w for w, _ in said[i:j]), ())
            if key in seen:
                gone |= set(range(i, j))
            seen.add(key)
        left = lead + "".join(x for k, (_, x) in enumerate(said) if k not in gone)
        out.append((d, None if t is None else left, len(said), len(gone)))
    return Counter(out)


def test_sentence_runs_match_brute_force(spark):
    rng = random.Random(8)
    ends = [". ", "! ", "\n", "?! ", ".### ", ", ", " ", "... (", ".\t", "1.5 ", ".x "]
    said = [" ".join(rng.choice(["Wort", "satz", "é", "X9", f"n{i}", f"m{i}"]) for _ in range(rng.choice([1, 3, 7, 20, 60]))) + rng.choice(ends) for i in range(40)]
    rows = [(i, rng.choice(["", "- ", "\n"]) + "".join(said[(s + j) % 40] for j in range(rng.randrange(9)))) for i in range(60) for s in [rng.randrange(40)]]
    rows += [(70, None), (71, ""), (72, "... !!!"), (73, "one word"), (74, "ONE! Word."), (None, said[3] * 3), (75, "la " * 200)]
    rows += [rows[5]] * 3 + [(71, "")]
    docs = spark.createDataFrame([(d, t, "keep") for d, t in rows], "doc_id long, text string, at string").repartition(4)
    got = sentence_spans.drop_repeats(docs).collect()
    assert Counter((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in got) == brute_spans(rows) and {r.at for r in got} == {"keep"}


def test_repeated_passages_of_over_50_words_lose_something():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 9)))
    noise = lambda: "".join(word() + rng.choice([" "] * 9 + [". ", ", ", "\n"]) for _ in range(rng.randrange(90)))
    for _ in range(400):
        passage = "".join(word() + rng.choice([" "] * rng.choice([2, 8, 40]) + [". "]) for _ in range(51))
        keys = []
        for _ in range(2):
            _, said = brute_sentences(noise() + passage + noise())
            keys.append({sum((w for w, _ in said[i:j]), ()) for i, j in brute_runs(said)})
        assert keys[0] & keys[1]


def test_sentence_runs_awkward_rows(docs, empty):
    out = sentence_spans.drop_repeats(docs)
    assert set(out.columns) == {*docs.columns, "n_sentences"} and out.count() == len(ROWS)
    got = Counter((r.doc_id, r.n_removed) for r in out.collect())
    assert got[(1, 0)] == 1 and got[(2, 4)] == 1 and got[(6, 0)] == 1 and got[(6, 1)] == 1
    assert sentence_spans.drop_repeats(empty).count() == 0


# --------------------------------------------------------------------------- 10


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.op10_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = out[out.quality == 1].score.values, out[out.quality == 0].score.values
    auc = (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()
    assert auc > 0.95 and (out.predicted == (out.score >= 0.3)).all()


def test_quality_query_matches_a_loop_over_all_rows(spark):
    import zstandard

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where(~quality.held_out()))
    dictionaries = [zstandard.ZstdCompressionDict(model[k]) for k in ("good", "bad")]
    for d in dictionaries:
        d.precompute_compress(level=3)
    packers = [zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False) for d in dictionaries]
    got = {r.doc_id: r for r in quality.op10_quality_classifier(spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        t = (r.text or "").encode()
        good, bad = (sum(len(p.compress(t[k : k + quality.PIECE])) for k in range(0, len(t), quality.PIECE)) for p in packers)
        x = (bad - good) / (bad + good) if t else 0.0
        p = 1 / (1 + math.exp(-(model["slope"] * x + model["offset"])))
        mine = got[r.doc_id]
        assert abs(mine.score - p) < 1e-9 and mine.predicted == (p >= 0.3) and mine.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_lowest_takes_the_smallest_hashes_of_each_group(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 10 = 0 THEN 'b' WHEN id < 7 THEN 'c' ELSE 'a' END AS g", "xxhash64(id) AS h", "id")
    rows = rows.unionByName(rows.where("id < 40").crossJoin(spark.range(300)).select("g", rows.h, rows.id)).cache()  # many repeats
    got = common.lowest(rows, "g", 60, 9)
    want = defaultdict(set)
    for r in rows.distinct().collect():
        want[r.g].add((r.h % (1 << 40), r.id))
    assert {g: {r.id for r in got if r.g == g} for g in want} == {g: {i for _, i in sorted(w)[:60]} for g, w in want.items()}
    assert {r.g for r in common.lowest(rows, "g", 60, 1)} == {"a"}


def test_quality_learns_from_the_later_part_of_long_texts(spark):
    rng = random.Random(3)
    same = " ".join(f"wort{rng.randrange(10**6)}" for _ in range(2500))  # over SAMPLE_BYTES
    said = {q: [" ".join(f"{w}{rng.randrange(300)}" for _ in range(3000)) for _ in range(8)] for q, w in ((1, "wahrheit"), (0, "kaufen"))}
    rows = [(8 * q + i, same + " " + t) for q in said for i, t in enumerate(said[q])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(8 * q + i, q) for q in said for i in range(8)], "doc_id long, quality int"))
    good, bad = quality.features([said[1][0].encode(), said[0][0].encode()], *quality.compressors(model["good"], model["bad"]))
    assert good > 0.02 and bad < -0.02


def test_quality_awkward_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (6, 1, 1), (7, None, 0), (99, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(empty, model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}


# --------------------------------------------------------------------------- tables


def test_tables_are_dropped_unless_read(spark):
    paths: list[str] = []
    with recording(paths):
        a, b = stored(spark.range(5), "a"), stored(spark.range(6), "b")
    derived = b.selectExpr("id + 1 AS x")
    drop_tables(spark, paths, needed_by=derived)
    assert len(paths) == 1 and derived.count() == 6
    with pytest.raises(Exception):
        a.count()
    drop_tables(spark, paths)
    assert paths == []
