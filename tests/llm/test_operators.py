"""The training-data operators against plain versions, on small fixtures dense in odd cases."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import archives, quality
from ledgerloom.llm.best_fit import best_fit_decreasing, pack_best_fit
from ledgerloom.llm.decontaminate import with_hits
from ledgerloom.llm.html_text import main_text
from ledgerloom.llm.jaccard import Classes, _candidates, _links, join_region, near_duplicates, shared_cells
from ledgerloom.llm.line_dedup import with_line_bitmaps
from ledgerloom.llm.packing import pack
from ledgerloom.llm.queries import QUERIES, SQL
from ledgerloom.llm.repeats import interval_repeats, without_repeats
from ledgerloom.llm.tokens import byte_bpe
from ledgerloom.llm.toxicity import Lexicon, folded, learn, with_score
from pyspark.sql import functions as F
from tests.compare import connect, differences

LONG = " ".join(f"word{i * 7919 % 1000}" for i in range(3000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards watch the moon rise"
TEXTS = [
    (1, f"{PASSAGE}\nunique first line here\n{PASSAGE}"), (2, f"intro {PASSAGE} outro\n{PASSAGE}\nshort\nshort"), (3, None), (4, ""), (5, "\n\n"),
    (6, LONG), (7, LONG + " tail"), (8, LONG), (9, "Ünïcödé " * 30 + "\n" + PASSAGE.upper()), (10, "a" * 400), (11, "a" * 300 + "b"),
    (12, "x"), (13, "x"), (14, " \t\x0b "), (15, "one two three"), (None, PASSAGE), (16, "ONE two THREE"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, kept_text string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, [None, "en", "zz"][k % 3], None, None, "clash", "clash", "clash") for k, (i, t) in enumerate(TEXTS)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_statement(spark, folder, name):
    assert not differences(QUERIES[name](spark, folder), connect(folder), SQL[name])


def test_line_dedup(docs, empty):
    rows = {r.doc_id: r for r in with_line_bitmaps(docs).collect()}
    assert len(rows) == len(TEXTS) and with_line_bitmaps(empty).count() == 0
    assert rows[1].n_dropped == 0 and rows[2].n_dropped == 1 and rows[3].n_lines == 1 and rows[3].kept_text == ""
    assert rows[9].kept_text == "Ünïcödé " * 30 and rows[8].kept_text == "" and rows[None].n_dropped == 1
    assert rows[2].kept_text == f"intro {PASSAGE} outro\nshort\nshort" and [tuple(x) for x in rows[2].kept_runs] == [(0, 1), (2, 2)]


def test_suffix_dedup(docs, empty):
    order = sorted(TEXTS, key=lambda x: (x[0] is None, x[0] or 0))
    seen, want = set(), {}
    for i, t in order:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if data[p : p + 50] in seen:
                gone[p : p + 50] = b"\1" * 50
        seen |= {data[p : p + 50] for p in range(len(data) - 49)}
        kept = bytes(b for b, g in zip(data, gone) if not g)
        want[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in without_repeats(docs).collect()}
    assert got == want and without_repeats(empty).count() == 0


def test_maximal_repeats():
    pieces = [b"xxabcdefyy", b"zzabcdefqq", b"abcdefyyww"]
    piece, place, groups = interval_repeats(pieces, 4)
    found = {(n, tuple(sorted((int(piece[i]), int(place[i])) for i in at))) for n, at in groups}
    assert (6, ((0, 2), (1, 2), (2, 0))) in found and (8, ((0, 2), (2, 0))) in found


def test_near_duplicates(docs, empty):
    sets = {}
    for i, t in TEXTS:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: len(s) for i, s in sets.items()}
    assert [got[i][1] for i in (6, 7, 8, 12, 13, 15, 16, 3, 4, 14)] == [6, 6, 6, 12, 12, 15, 15, 3, 4, 14]
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_region_join_is_exact(seed):
    r = np.random.default_rng(seed)
    new = lambda n: r.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
    bases = [np.unique(new(n)) for n in (3, 12, 60, 300)]
    sets = []
    for _ in range(120):
        b = bases[r.integers(4)]
        sets.append(np.unique(np.r_[b[r.random(len(b)) > r.choice([0, 0.03, 0.07, 0.12])], new(int(len(b) * r.choice([0, 0.02, 0.08])))]))
    sets = [s for s in sets if len(s)]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if _links(sets[i], sets[j], 85):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = [find(i) for i in range(len(sets))]
    assert join_region(sets, 85) == want == join_region(sets, 85, cells=shared_cells(sets, 85))


@pytest.mark.parametrize("small, chunk", [(32, 1 << 20), (3, 50), (1, 400), (2, 7)])
def test_candidates_connect_all_links(spark, small, chunk):
    """Also where every region is large, in many small chunks and buckets."""
    rng = np.random.default_rng(small)
    groups = [rng.integers(0, 10**9, int(rng.integers(3, 60))).astype(np.uint64) for _ in range(12)]
    sets = [np.unique(np.r_[g[rng.random(len(g)) > 0.07], rng.integers(0, 10**9, int(rng.integers(0, 3))).astype(np.uint64)]) for g in groups for _ in range(12)]
    shared = rng.integers(0, 10**9, 20).astype(np.uint64)  # a passage of many sets that do not link
    sets += [np.unique(np.r_[shared, rng.integers(0, 10**9, 25).astype(np.uint64)]) for _ in range(20)]
    sets = [s for s in {s.tobytes(): s for s in sets if len(s)}.values()]
    for percent in (80, 85):
        classes = Classes(percent)
        rows = []
        for k, s in enumerate(sets):
            cls, regions, needs = classes.described(s)
            rows.append((k, len(s), cls, *needs, regions.view(np.int64).tolist()))
        found = spark.createDataFrame(rows, "key long, n long, cls int, own int, next int, regions array<long>").repartition(5)
        parent = list(range(len(sets)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in _candidates(found, percent, small, chunk).collect():
            assert r.a < r.b
            parent[root(r.a)] = root(r.b)
        links = [(i, j) for i in range(len(sets)) for j in range(i) if _links(sets[i], sets[j], percent)]
        assert len(links) > 100 and all(root(i) == root(j) for i, j in links)


def test_unlike_sets_are_no_candidates(spark):
    """Neither parts without n-grams nor common single n-grams bring unlike sets together."""
    rng = np.random.default_rng(3)
    common = rng.integers(0, 10**9, 12).astype(np.uint64)
    sets = [np.unique(np.r_[common, rng.integers(0, 10**9, int(n)).astype(np.uint64)]) for n in rng.integers(90, 500, 600)]
    classes = Classes(80)
    rows = []
    for k, s in enumerate(sets):
        cls, regions, needs = classes.described(s)
        rows.append((k, len(s), cls, *needs, regions.view(np.int64).tolist()))
    found = spark.createDataFrame(rows, "key long, n long, cls int, own int, next int, regions array<long>").repartition(3)
    assert _candidates(found, 80, 4).count() == 0


def test_large_regions_connect_sets_that_need_them(spark):
    """40 sets share two regions: they are connected by them only where they may share no other one with sets that link."""
    schema = "key long, n long, cls int, own int, next int, regions array<long>"
    for need, connected in ((3, 0), (2, 39), (1, 39)):
        rows = [(k, 100, 0, need, 5, [2, 4, 1001 + 2 * k, 2000 + 2 * k]) for k in range(40)]
        for chunk in (1 << 20, 60):
            pairs = {tuple(r) for r in _candidates(spark.createDataFrame(rows, schema).repartition(2), 80, 8, chunk).collect()}
            assert pairs == {(0, k) for k in range(1, connected + 1)}


def test_near_duplicates_in_blocks(spark):
    r = np.random.default_rng(7)
    base = [f"w{i}" for i in range(160)]
    texts = []
    for i in range(120):
        words = [w if keep else f"x{i}" for w, keep in zip(base, r.random(160) > r.choice([0.01, 0.02, 0.05]))]
        texts.append(" ".join(words))
    rows = spark.createDataFrame([*enumerate(texts), (500, texts[3]), (501, "")], "doc_id long, text string").repartition(4)
    sets = [{tuple(w[k : k + 4]) for k in range(157)} for w in (t.split() for t in texts)]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    want = {**dict(enumerate(root)), 500: root[3], 501: 501}
    for most in (1 << 21, 4_000):  # in one task, and dealt into blocks
        assert {x.doc_id: x.component_id for x in near_duplicates(rows, most_items=most).collect()} == want
    assert 1 < len(set(root)) < len(root)


def test_near_duplicate_stage(spark):
    r = np.random.default_rng(11)
    base = [f"w{i}" for i in range(98)]
    texts = []
    for i in range(60):
        words = list(base) if i % 3 else [f"v{i % 4}x{k}" for k in range(60)]
        for k in r.choice(len(words), r.choice([0, 1, 2, 3, 4, 6]), replace=False):
            words[k] = f"x{i}"
        texts.append(" ".join(words))
    two = list(base)
    two[20], two[60] = "y", "z"  # 84 of 104 runs of five words are in common, but 87 of 103 of four
    ids = [None if i % 7 == 0 else i // 2 for i in range(60)]
    rows = [*zip(ids, texts), (0, texts[1]), (0, texts[1]), (None, ""), (None, None), (3, " \t"), (3, " \t"), (500, " ".join(f"q{w}" for w in base)), (501, " ".join(f"q{w}" for w in two))]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").split() for _, t in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = corpus_pipeline.near_duplicate_documents(spark, docs, "").collect()
    group = {t: g for (_, t), s, g in zip(rows, sets, root) if s}
    with_words = [x for x in kept if x.text and x.text.strip()]
    assert sorted(group[x.text] for x in with_words) == sorted(set(group.values())) and 1 < len(with_words) < 60
    order = lambda i: (i is None, i or 0)
    for x in with_words:
        assert order(x.doc_id) == min(order(i) for (i, _), g, s in zip(rows, root, sets) if s and g == group[x.text])
        assert (x.doc_id, x.text) in rows
    assert Counter((x.doc_id, x.text) for x in kept if x not in with_words) == Counter({(None, ""): 1, (None, None): 1, (3, " \t"): 2})
    assert sum(x.doc_id in (500, 501) for x in kept) == 1


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(7, PASSAGE), (8, "one, two! three?"), (9, None), (10, "..."), (11, "word0 nothing")], "item_id long, text string")
    hits = {r.doc_id: r.contamination for r in with_hits(docs, items).collect()}
    assert hits[1].item_ids == ["7"] and hits[1].n_hit == 32 and hits[15].item_ids == ["8"] and hits[16].n_hit == 3
    assert hits[3].n_words == 0 and hits[10].n_hit == 0
    text = dict(TEXTS)[2]
    assert [text[s.start : s.end] for s in hits[2].spans] == [PASSAGE, PASSAGE]
    assert with_hits(empty, items).count() == 0 and with_hits(docs, items.limit(0)).count() == len(TEXTS)
    blocks = {r.doc_id: r.contamination for r in with_hits(docs, items, most=100).collect()}
    assert blocks == hits


def test_quality(docs, empty):
    for text in (t for _, t in TEXTS):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        threes = Counter(zip(words, words[1:], words[2:]))
        hit = {i + k for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert quality.base_figures(text) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))
    rows = quality.quality_verdicts(docs).collect()
    assert len(rows) == len(TEXTS) and all(r.base_failed for r in rows if r.n_words < 50) and quality.quality_verdicts(empty).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def plain_model(texts):
    """Scores of the runs of symbols in texts (a list of a language's texts), by dictionaries."""
    order = quality.ORDER
    padded = [[*[0] * (order - 1), *quality.symbols(t).tolist()] for t in texts]
    counts, holders = {order: Counter()}, defaultdict(set)
    for row, s in enumerate(padded):
        for k in range(len(s) - order + 1):
            counts[order][tuple(s[k : k + order])] += 1
            for n in range(order):
                holders[tuple(s[k + n : k + order])].add(row)
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(x[1:] for x in counts[n + 1])
    totals, kinds, cuts = defaultdict(int), defaultdict(Counter), {}
    for n in counts:
        c = Counter(counts[n].values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.5
        cuts[n] = [0, *(min(max(k - (k + 1) * y * c[k + 1] / c[k] if c[k] else k / 2, 0.05), k - 0.05) for k in (1, 2, 3))]
        for x, m in counts[n].items():
            totals[x[:-1]] += m
            kinds[x[:-1]][min(m, 3)] += 1

    def weight(x):
        return sum(cuts[len(x) + 1][k] * v for k, v in kinds[x].items()) / totals[x]

    known = {}

    def chance(x):
        if not x:
            return 1 / (len(counts[1]) + 1)
        if x not in known:
            m = counts[len(x)][x]
            known[x] = (m - cuts[len(x)][min(m, 3)]) / totals[x[:-1]] + weight(x[:-1]) * chance(x[1:])
        return known[x]

    def score(x):
        if not x:
            return np.log(chance(x))
        return np.log(chance(x)) if len(holders[x]) > 1 else np.log(weight(x[:-1])) + score(x[1:])

    return padded, chance, score, counts


def test_quality_verdicts_are_those_of_a_plain_model(spark, folder, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 50_000)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    prose = [r.text for r in docs.where("lang = 'en' AND n_chars > 800").orderBy("doc_id").limit(8).collect()]
    junk = [(9000 + i, " ".join(f"{w} |" for w in t.split()[:150]), "en") for i, t in enumerate(prose)] + [(9100 + i, " ".join(f"{w} $$$ &&& %%%" for w in t.split()[:150]), "en") for i, t in enumerate(prose)]
    draw = np.random.default_rng(5)
    noise = [(9200 + i, " ".join("".join(chr(0x430 + c) for c in draw.integers(0, 32, 6)) for _ in range(120)), "en") for i in range(8)]
    docs = docs.unionByName(spark.createDataFrame([*junk, *noise, (9300, prose[0], None), (9301, "", None)], "doc_id long, text string, lang string"))
    rows = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    assert len(rows) == docs.count() and not any(rows[i].kept for i, _, _ in noise + junk)
    texts = defaultdict(dict)
    for r in docs.collect():
        if r.text:
            texts[r.lang or ""][r.doc_id] = r.text
    for own in texts.values():
        padded, _, score, _ = plain_model(list(own.values()))
        letters = [sum(c > 127 or chr(c) in "0abcdefghijklmnopqrstuvwxyz" for c in s) for s in padded]
        plain = {i: -sum(score(tuple(s[k : k + quality.ORDER])) for k in range(len(s) - quality.ORDER + 1)) / max(1, n) for i, s, n in zip(own, padded, letters)}
        for i, value in plain.items():
            assert abs(rows[i].log_perplexity - value) < 1e-5 * max(1, value)
        body = sorted(np.floor(rows[i].log_perplexity * 1000) / 1000 + 0.0005 for i in own if not rows[i].base_failed)
        if body:
            low, mid, high = (body[int(np.ceil(q * len(body))) - 1] for q in (0.25, 0.5, 0.75))
        for i in plain:
            kept = not rows[i].base_failed and mid - max(0.1, 5 * (mid - low) / 0.6745) <= rows[i].log_perplexity <= mid + max(0.1, 5 * (high - mid) / 0.6745)
            assert rows[i].kept == kept


def test_junk_goes_and_good_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    found = quality.quality_verdicts(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    junk, good = ([r.kept for r in found if r.quality == k] for k in (0, 1))
    assert sum(junk) <= 0.2 * len(junk) and sum(good) >= 0.95 * len(good)


def test_kneser_ney_is_that_of_dictionaries(spark):
    texts = ["the cat sat on the mat", "a dog, the dog! 42", "zebra", "the cat sat on the mat"]
    rows = spark.createDataFrame([("x", t) for t in texts] + [("y", "other"), ("y", None), ("y", "")], "_lang string, _text string")
    found = {tuple(map(ord, r.run)): r for r in quality.kneser_ney(quality.count_runs(quality.blocks(rows))).where("_lang = 'x'").collect()}
    _, chance, score, counts = plain_model(texts)
    assert found.keys() == counts[quality.ORDER].keys()
    assert all(abs(r.chance - chance(x)) < 1e-12 and abs(r.score - score(x)) < 1e-9 for x, r in found.items())


def test_rows_keep_columns_of_any_name(spark):
    long = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(i, f"{long} {i}", "en", i, "mine", i, "row") for i in range(6)], "doc_id long, text string, lang string, _id long, _t1 string, _t2 long, _row string")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and all(r._t1 == "mine" and r._id == r.doc_id for r in kept.collect())


def test_html():
    body = "The fox is in the house of the king and it was not for us to see that with all of them."
    page = f"<html><head><title>no</title></head><body><nav><a href=x>Home</a></nav><div class=ad>{body}</div><div id=story><h2>Head</h2><p>{body} &amp; x<br>y<p>Short.</div>" \
        f"<script>'<p>{body}</p>'</script><form><p>{body}</p></form><section id='comments'><p>{body}</p></section><footer>{body}</footer><!-- {body}"
    assert main_text(page) == f"Head {body} & x y Short."
    assert [main_text(p) for p in (None, "", "<p>")] == [""] * 3 and main_text("just text") == "just text"


class PlainPage(HTMLParser):
    """Words of a page outside menus, footers, forms and scripts, and the paragraphs of articles that stand in no part with a class or id."""

    INLINE = set("a abbr b bdi bdo cite code em font i kbd label mark q s small span strong sub sup time u var wbr".split())
    OUTSIDE = set("nav footer aside form script style head noscript template svg button select".split())

    def __init__(self, page):
        super().__init__()
        self.stack, self.data, self.paragraphs = [], [], []
        self.feed(page)
        self.close()
        self.words = "".join(self.data).split()

    def handle_starttag(self, tag, attrs):
        if tag not in self.INLINE:
            self.data.append(" ")
        if tag not in ("br", "hr", "img", "input", "link", "meta"):
            self.stack.append((tag, any(k in ("class", "id") for k, _ in attrs)))
        if tag == "p":
            self.paragraphs.append("" if self.counts() else None)

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.data.append(" ")
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def counts(self):
        tags = [t for t, _ in self.stack]
        return "article" in tags and not self.OUTSIDE & set(tags) and not any(named for _, named in self.stack[tags.index("article") + 1 :])

    def handle_data(self, data):
        tags = [t for t, _ in self.stack]
        if not self.OUTSIDE & set(tags):
            self.data.append(data)
            if "p" in tags and self.paragraphs and self.paragraphs[-1] is not None:
                self.paragraphs[-1] += data


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_pages_are_those_of_a_plain_parser(spark, size):
    folder, in_articles = f"/root/testdata/sf{size}", 0
    for r in QUERIES["op5_html_extraction"](spark, folder).join(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html"), "page_id").collect():
        page = PlainPage(r.html or "")
        assert r.n_chars == len(r.text) and r.text == " ".join(r.text.split())
        left = iter(page.words)  # in page order, and nothing of the parts outside
        assert all(word in left for word in r.text.split()), r.page_id
        for paragraph in page.paragraphs:
            if paragraph and paragraph.strip():
                in_articles += 1
                assert " ".join(paragraph.split()) in r.text, r.page_id
    assert in_articles > 10


def test_toxicity(spark, docs, empty):
    assert folded("Y0u ІDI0T!! ​M​oron") == " you idiot moron "
    lexicon = Lexicon({" trash ": 3.0}, ("trash can",), (-3.0, 1.0, 1.0))
    assert lexicon.found("tr4sh")[:2] == (3.0, 1) and lexicon.found("a trash can")[:2] == (0.0, 0)
    rows = with_score(docs, lexicon).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    none = learn(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert not none.weights and with_score(empty, none).count() == 0


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op7_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_tokens_are_those_of_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = [t or "" for _, t in TEXTS] + ["a  b", " a", "a ", "x\n y", "x \ny", "tab\tb", " x y", "don't we'll 12 3!? \n\n z", "日本 語", "\x1c a b"]
    for text in texts:
        assert np.frombuffer(byte_bpe(path).ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_those_of_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    end = "<|endoftext|>"
    assert np.frombuffer(byte_bpe(path).ids(f"a {end} b"), "<u4").tolist() == [64, 220, 50256, 275]
    for text in (end, end * 3, f"{end} x", f"x{end}", f"one two  {end}\n\n three{end}four", f"<{end}>", "<|endoftext|", "<| endoftext |>", f"tab\t{end}\t", "<|ENDOFTEXT|>"):
        assert np.frombuffer(byte_bpe(path).ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = pack(docs, path, size=256, most_open=3).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        by_doc[(r.doc_id)].append((r.start, r.ids))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, t in TEXTS:
        joined = b"".join(ids for _, ids in sorted(by_doc[i]))
        assert joined == byte_bpe(path).ids(t or "") + (1).to_bytes(4, "little")
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_sequence) <= sum(r.length for r in rows) / 256 * 1.1 + 2 and pack(empty, path).count() == 0


def test_best_fit_decreasing_is_a_plain_search():
    r = np.random.default_rng(3)
    pieces = [(i, 0, bytes(4 * int(n)), int(n)) for i, n in enumerate(np.r_[r.integers(1, 65, 400), r.integers(1, 9, 200), [64, 1]])]
    want: list[list] = []  # free places and lengths
    for n in sorted((p[3] for p in pieces), reverse=True):
        fits = [w for w in want if w[0] >= n]
        if fits:
            best = min(fits, key=lambda w: w[0])
            best[0] -= n
            best[1].append(n)
        else:
            want.append([64 - n, [n]])
    got = best_fit_decreasing(pieces, 64)
    assert sorted(p[0] for _, held in got for p in held) == list(range(len(pieces))) and best_fit_decreasing([], 64) == []
    assert all(free == 64 - sum(p[3] for p in held) >= 0 for free, held in got)
    assert sorted(free for free, _ in got) == sorted(free for free, _ in want)


@pytest.mark.parametrize("most_ids, most_open", [(1 << 22, 64), (300, 1)])
def test_best_fit_packing(docs, empty, most_ids, most_open):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = pack_best_fit(docs.unionByName(docs), path, size=256, pad_id=7, most_ids=most_ids, most_open=most_open, merge_tasks=2).collect()
    pieces = []
    for r in rows:
        ids, positions, cu = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4"), r.cu_lengths
        assert len(ids) == len(positions) == 256 and cu[0] == 0 and cu[-1] == r.n_ids and (ids[r.n_ids :] == 7).all() and not positions[r.n_ids :].any()
        assert len(cu) - 1 == len(r.doc_ids) == len(r.starts) == len(r.doc_tokens)
        for a, b, doc, start, total in zip(cu, cu[1:], r.doc_ids, r.starts, r.doc_tokens):
            assert positions[a:b].tolist() == list(range(b - a)) and b > a
            pieces.append((str(doc), start, total, ids[a:b].tolist()))
    want, plain = [], Tokenizer.from_file(path)
    for i, t in TEXTS * 2:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(str(i), k, len(ids), ids[k : k + 256]) for k in range(0, len(ids), 256)]
    assert sorted(pieces) == sorted(want)
    assert len({r.sequence_id for r in rows}) == len(rows) and pack_best_fit(empty, path).count() == 0
    if most_ids > 300:
        assert len(rows) <= sum(r.n_ids for r in rows) / 256 * 1.1 + 4


@pytest.mark.parametrize("version", [1, 2])
def test_archives(spark, version):
    rows = [(1, "http://a b/é", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\nodd\n" * 50), (None, "u", "<p>x</p>"), (1, "u", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = archives.archive(pages, version, with_payload=True).collect()
    assert sorted((r.page_id or 99, r.record_type, r.refers_to) for r in got) == sorted([(1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None), (99, "revisit", 1)], key=str)
    assert {r.page_id: r.payload for r in got if r.record_type == "response"} == {1: b"<p>x</p>", 3: b"", 5: rows[4][2].encode()}
    assert all(r.payload_digest == archives.payload_digest((h or "").encode()) for r in got for i, _, h in rows if i == r.page_id)
    assert archives.archive(pages.limit(0)).count() == 0


def test_arc_records_without_blocks(spark, tmp_path):
    """What finds the first captures reads the same rows and compresses no block; files are written at the fast level."""
    text = " ".join(str(i * i % 9973) for i in range(20_000))
    pages = spark.createDataFrame([(i, "u", f"<p>{text}</p>") for i in range(3)] + [(None, None, None)], "page_id long, url string, html string").coalesce(1)
    archives.write_arc(pages, f"{tmp_path}/arc")
    whole, light = (archives.read_arc(spark, f"{tmp_path}/arc", with_block=w) for w in (True, False))
    assert all(zlib.decompress(r.block).startswith(b"HTTP/") for r in whole.collect())
    assert [r.block for r in light.collect()] == [None] * 4
    assert sorted(whole.drop("block").collect(), key=str) == sorted(light.drop("block").collect(), key=str)
    (file,) = tmp_path.glob("arc/*.gz")
    data = archives._unpacked(file.read_bytes())
    assert len(file.read_bytes()) > 1.02 * len(zlib.compress(data, 6))


def test_answers_are_arrays_for_each_block(spark):
    draw = np.random.default_rng(3)
    rows = [(int(b), int(k), float(np.float32(x))) for b, k, x in zip(draw.integers(0, 5, 4000), draw.integers(-(2**63), 2**63, 4000), draw.normal(size=4000))]
    found = spark.createDataFrame(rows, "block long, key long, score float").repartition(3)
    for most, parts in ((1 << 19, 15), (300, 80)):
        got = quality.answers(found, most).collect()
        assert len(got) <= parts and sorted((r.block, k, s) for r in got for k, s in zip(np.frombuffer(r["keys"], "<i8").tolist(), np.frombuffer(r.scores, "<f4").tolist(), strict=True)) == sorted(rows)
    assert quality.answers(found.limit(0)).count() == 0


def test_shared_runs_have_equal_numbers(spark):
    """A run that several rows hold is told by the same two numbers wherever it is seen, one that one row holds by that row's."""
    rows = spark.createDataFrame([("x", "abcd"), ("x", "abcd, zwyx"), ("x", "abcd"), ("y", "abcd abcd")], "_lang string, _text string").coalesce(1)
    found = {(r._lang, r.run): (r.lo, r.hi) for r in quality.count_runs(quality.blocks(rows)).collect()}
    assert found["x", "abcd"] == found["x", "\0\0\0a"] == (-1, quality.LAST_ROW)
    assert found["x", "zwyx"][0] == found["x", "zwyx"][1] == found["x", "d, z"][0] != found["y", "abcd"][0] == found["y", "abcd"][1]


def test_a_block_is_closed_at_its_size(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 1_000_000)
    texts = [f"{i} " * 300_000 for i in range(7)]
    rows = spark.createDataFrame([("x", t) for t in texts] + [("x", None)], "_lang string, _text string").coalesce(1)
    held = [[t for batch in pa.ipc.open_stream(r.packed) for t in batch.column("_text").to_pylist()] for r in quality.blocks(rows).orderBy("block").collect()]
    assert len(held) > 1 and [t for block in held for t in block] == [*texts, None]


def test_runs_of_a_block_are_sent_once(spark, monkeypatch):
    """Counts, and who holds a run, are the same whether a block's runs are merged over slices or sent early."""
    monkeypatch.setattr(quality, "SLICE", 2_000)
    draw = np.random.default_rng(7)
    texts = ["".join(map(chr, draw.integers(97, 104, 900))) for _ in range(12)] + ["zebra 42", None, ""]
    rows = spark.createDataFrame([("xy"[i % 2], t) for i, t in enumerate(texts)], "_lang string, _text string").coalesce(1)
    want, holders = Counter(), defaultdict(set)
    for i, t in enumerate(texts):
        own = "\0\0\0" + (t or "").replace("42", "00")
        for k in range(len(own) - 3):
            want["xy"[i % 2], own[k : k + 4]] += 1
            holders["xy"[i % 2], own[k : k + 4]].add(i)
    for most in (1 << 19, 1_000):
        found = {(r._lang, r.run): r for r in quality.count_runs(quality.blocks(rows), most).collect()}
        assert {k: r.n for k, r in found.items()} == want
        assert all((r.lo == r.hi) == (len(holders[k]) == 1) for k, r in found.items())


class _Taken:
    """Stands for a DataFrame and keeps the function that it is mapped by."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def groupBy(self, *columns):
        return self

    agg = groupBy


def _texts_run(monkeypatch, texts: list[str]) -> pa.RecordBatch:
    """The texts as one batch, for functions run in this process."""
    monkeypatch.setattr(quality, "stored", lambda df, name: df)
    monkeypatch.setattr(quality, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    return pa.RecordBatch.from_arrays([pa.array(["x"] * len(texts)), pa.array(texts)], names=["_lang", "_text"])


def test_sent_blocks_are_let_go(spark, monkeypatch):
    """A worker serves many tasks: what it sent must not stay in its memory."""
    monkeypatch.setattr(quality, "BLOCK", 200_000)
    rows = _texts_run(monkeypatch, [np.random.default_rng(i).bytes(50_000).hex() for i in range(20)])
    run, before = quality.blocks(_Taken()).run, pa.total_allocated_bytes()
    assert sum(made.num_rows for made in run(iter([rows]))) == 10
    assert pa.total_allocated_bytes() - before < 50_000


def test_counting_holds_distinct_runs_only(spark, monkeypatch):
    """Slices with the same runs take no more memory while they are counted than a few of them."""
    monkeypatch.setattr(quality, "SLICE", 2_000)
    text = "".join(map(chr, np.random.default_rng(5).integers(97, 123, 1_900)))
    rows = _texts_run(monkeypatch, [text] * 700)
    (packed,) = quality.blocks(_Taken()).run(iter([rows]))
    count = quality.count_runs(_Taken()).run
    tracemalloc.start()
    try:
        found = list(count(iter([packed])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == 1 and sum(found[0].column("n").to_pylist()) == 700 * 1_900
    assert peak < 30_000_000
