"""Decontamination, quality rules, quality classifier, language, html and URL operators."""

import collections
import hashlib
import html as escapes
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import byte_cnn, decontam, html_text, quality_rules, queries, url_rules, zstd_quality

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACE = re.compile("[^\x20\x09-\x0d]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_hits(docs, items):
    """(n_words, n_hit, sorted items) of each text."""
    windows = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    out = []
    for _, t in docs:
        w, hit, found = WORD.findall(lower(t or "")), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= x
        out.append((len(w), len(hit), sorted(found)))
    return out


def benchmark_case(seed):
    r = random.Random(seed)
    fresh = lambda n: [r.choice("ab") * r.randrange(1, 3) if r.random() < 0.6 else "Wé%d" % r.randrange(60) for _ in range(n)]
    items = [(i, " ".join(fresh(r.randrange(0, 25)))) for i in range(20)] + [(3, "aa b"), (99, None), (98, "..."), (7, "Aa, aa-aa aa")]
    docs = []
    for i in range(40):
        t = " ".join(fresh(r.randrange(0, 30)))
        if i % 3:
            t += " " + (r.choice(items)[1] or "").upper() + "! " + " ".join(fresh(4))
        docs.append((i, t))
    return docs + [(None, items[0][1]), (41, None), (42, ""), (0, "aa b"), (43, "aa b " * 4000)], items


@pytest.mark.parametrize(("seed", "block"), [(1, 10**6), (2, 60)])
def test_decontamination(spark, seed, block):
    docs, items = benchmark_case(seed)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, spans string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contaminated(d, b, block_words=block).collect()
    key = lambda x: (x[0], x[1], x[2])
    assert sorted(((r["n_words"], r["n_hit"], r["items"]) for r in found), key=key) == sorted(brute_hits(docs, items), key=key)
    assert any(r["n_hit"] for r in found) and not all(r["n_hit"] for r in found)
    kept = decontam.clean(d, b, block_words=block)
    assert kept.columns == d.columns
    assert kept.count() == sum(1 for _, n, _ in brute_hits(docs, items) if not n)


def test_decontamination_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.contaminated(d.where("false"), b).count() == 0
    row = decontam.contaminated(d, b.where("false")).first()
    assert (row["n_words"], row["n_hit"], row["items"]) == (2, 0, [])


def test_proximity_matches(spark):
    words = ["q%d" % i for i in range(10)]
    near = [*words[:4], words[5], words[4], *words[6:]]
    far = [*words[:5], *["z"] * 9, *words[5:]]
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    out = {r["doc_id"]: (r["items"], r["near_items"]) for r in decontam.matches(d, b).collect()}
    assert out == {1: (["7"], []), 2: ([], ["7"]), 3: ([], [])}


def base_counts(t):
    t = t or ""
    w = SPACE.findall(t)
    c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = {i for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for i in range(k, k + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(cover)


RULE_TEXTS = [None, "", " \n\t", "a", "é " * 30, "x\n x\nx\n\nx", "a b c d e f g h " * 40, "the of and " * 30, "#$%& *** |" * 30, "a\x0bb\x1cc d\xa0e", "word" * 9000]


def test_base_counts(spark, sf):
    texts = RULE_TEXTS + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    d = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    rows = quality_rules.judge(d, {}).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r["kept"] == (not r["base_failed"])


def test_divergence(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    references = quality_rules.fit(docs)
    assert sorted(references) == ["de", "en", "es", "fr"]
    total = sum(sum(c) for c, _ in references.values())
    assert total == docs.agg(F.sum(F.length("text"))).first()[0]
    clean = docs.where("doc_id = 8").first()["text"]
    bad = " ".join(w + "***" for w in clean.upper().split())
    d = spark.createDataFrame([(1, clean), (2, bad), (3, clean[:100])], "doc_id long, text string")
    out = {r["doc_id"]: r for r in quality_rules.judge(d, references).collect()}
    assert out[1]["kept"] and not out[2]["kept"] and not out[2]["base_failed"]
    assert out[3]["class_distance"] is None
    same = np.array([[3.0, 1.0, 0.0]])
    assert quality_rules.distance(same[0], same)[0] == 0
    assert quality_rules.distance(np.array([1.0, 0, 0]), np.array([[0, 1.0, 0]]))[0] == pytest.approx(1)


def test_rules_keep_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op6_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed")
    by = {r["quality"]: r["share"] for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("share")).collect()}
    assert by[1] > 0.99 and by[0] < 0.2


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op5_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert np.mean([r["predicted"] for r in held if r["quality"] == 1]) > 0.97
    assert np.mean([1 - r["predicted"] for r in held if r["quality"] == 0]) > 0.8


def test_classifier_edge_cases(spark):
    d = spark.createDataFrame([(1, "good text here " * 9, "s"), (2, None, "s"), (None, "", "s"), (1, "bad *** ", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (5, None)], "doc_id long, quality int")
    for known in (labels, labels.where("false")):
        model = zstd_quality.fit(d, known)
        out = zstd_quality.score(d, model).collect()
        assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)
    assert zstd_quality.score(d.where("false"), model).count() == 0
    assert zstd_quality.keep_good(d, model).columns == d.columns


def test_logistic_separates():
    x = np.concatenate([np.linspace(-1, 0.2, 50), np.linspace(-0.1, 1, 50)])
    y = np.repeat([0.0, 1.0], 50)
    slope, offset = zstd_quality.logistic(x, y, np.ones(100))
    p = 1 / (1 + np.exp(-(slope * x + offset)))
    assert slope > 0 and p.mean() == pytest.approx(0.5, abs=0.01)


def test_isotonic_fit():
    x = np.array([3.0, 1.0, 2.0, 4.0])
    assert zstd_quality.isotonic(x, np.array([0.0, 0.0, 1.0, 1.0]), np.ones(4)) == ((1.0, 2.5, 4.0), (0.0, 0.5, 1.0))


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]) > 0.98


def test_language_edge_cases(spark):
    text = {"a": "lorem ipsum dolor " * 20, "b": "żółć gęśl jaźń " * 20}
    rows = [(i, text["ab"[i % 2]], "ab"[i % 2], "x") for i in range(60)] + [(100, None, "a", "x"), (101, "123 !?", None, "x"), (None, "lorem", None, "x"), (102, "", "b", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    net = byte_cnn.fit(d)
    out = {r["doc_id"]: r for r in byte_cnn.identify(d, net).collect()}
    assert all(out[i]["lang_pred"] == "ab"[i % 2] for i in range(60))
    assert all(out[i]["lang_pred"] == "und" for i in (100, 101, 102)) and out[None]["lang_pred"] in "ab"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    unlabelled = d.withColumn("lang", F.lit(None).cast("string"))
    assert byte_cnn.fit(unlabelled) is None
    assert {r["lang_pred"] for r in byte_cnn.identify(d, None).collect()} == {"und"}
    assert byte_cnn.identify(d.where("false"), net).count() == 0


def test_network_windows_cover_the_text():
    assert byte_cnn.cut(b"").shape == (1, byte_cnn.LENGTH)
    text = bytes(range(1, 256)) * 2
    assert byte_cnn.cut(text).reshape(-1)[: len(text)].tobytes() == text


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{x:1}</style><script>var t="</p>";</script></head><body><header><h2>Site name</h2></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies and this is a long sentence about them.</div><div class="ad">Buy this now, it is really very good.</div>
<article><header><h1>The   title&amp;</h1></header><p><b>First   paragraph with &eacute; and&nbsp;more words in it.<br><p>x.</p><aside>Related things are here.</aside><form><input value="q"><label>Search</label></form>
<ul><li>Item one is here</li></ul><!-- no --></article><section id="comments"><p>A reader says a good many things in this comment.</p></section><aside><p>Sidebar text that is long enough to look like content.</p></aside><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "The title&\nFirst paragraph with é and more words in it.\nx.\nItem one is here"


def test_main_text_without_article():
    body = "".join(f"<p>This is paragraph number {i} and it has a good number of words to read.</p>" for i in range(6))
    page = f"<html><body><div><a href=1>one</a> <a href=2>two</a></div><div>{body}<p>Short.</p></div><div class='sidebar'>{body}</div></body></html>"
    lines = html_text.main_text(page).split("\n")
    assert len(lines) == 7 and lines[-1] == "Short."


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ('<div class="article-header"><h1>Head</h1></div><p>Text goes here.</p>', "Head\nText goes here."),
        ('<p>Text <span class="ad">buy <span>more</span> now</span> goes on.</p>', "Text\ngoes on."),
        ('<p class="notice">Site notice.<p>Text goes here.</p>', "Text goes here."),
        ('<div class="comments"><p>Nice one.</p></div><p>A<br>B &lt;c&gt;</p>', "A B <c>"),
        ('<div class="has-sidebar"><p>Text goes here.</p></div><ins class="adsbygoogle">x</ins>', "Text goes here."),
        ('<noscript><p>Turn scripts on.</p></noscript><table><tr><td>one</td><td>two</td></tr></table>', "one\ntwo"),
        ('<p hidden>Not seen.</p><p style="display: none">Nor this.</p><p>Seen.</p>', "Seen."),
    ],
)
def test_parts_inside_articles(inner, text):
    assert html_text.main_text(f"<body><div role=navigation>Menu</div><article>{inner}</article></body>") == text


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ('<ul><li><a href="/1">First linked item of the article</a></li><li>Plain item</li></ul>', "First linked item of the article\nPlain item"),
        ('<p class="popular">Well liked.</p><p class="legal notice">So the law says.</p>', "Well liked.\nSo the law says."),
        ('<section><h2>Part</h2><div><a href="/x">A reading list</a></div></section>', "Part\nA reading list"),
    ],
)
def test_articles_keep_lists_and_links(inner, text):
    long = "<p>A paragraph that says a good many things about what is at hand here.</p>"
    assert html_text.main_text(f"<body><article>{long}{inner}{long}</article></body>").split("\n")[1:-1] == text.split("\n")


def test_short_items_between_paragraphs_stay():
    long = "<p>" + "word " * 60 + "</p>"
    page = f"<body><div><a href=1>one</a> <a href=2>two</a></div><div>{long * 3}<ul>{'<li>item</li>' * 10}</ul>{long * 3}</div><div><p>x</p></div></body>"
    assert html_text.main_text(page).split("\n").count("item") == 10 and "one" not in html_text.main_text(page)


def test_ratios_choose_the_region(monkeypatch):
    """Without marks the smoothed ratios decide; turned round, they give the other region."""
    menu = "".join(f"<div><i>{w}</i><b>{w}</b><u>{w}</u></div>" for w in "one two three four five six seven eight nine ten".split())
    text = "".join(f"<p>Sentence number {i} is long enough to be read by somebody with time.</p>" for i in range(8))
    page = f"<html><body><div>{menu}</div><div>{text}</div></body></html>"
    assert html_text.main_text(page).startswith("Sentence number 0") and "seven" not in html_text.main_text(page)
    real = html_text.smooth
    monkeypatch.setattr(html_text, "smooth", lambda ratios, sigma: real(ratios[::-1], sigma))
    assert "sevensevenseven" in html_text.main_text(page) and "Sentence number 7" not in html_text.main_text(page)


def test_lines_of_the_page_have_ratios_of_their_own():
    page = html_text.parse("<body><p>first words\nand <b>more</b> here\n</p><p>x</p></body>")
    assert [b[0] for b in page.blocks] == ["first words and more here", "x"]
    assert [(c, b) for c, _, _, b in page.lines if c] == [(11, 0), (11, 0), (1, 1)]


@pytest.mark.parametrize("page", ["", "<p", "<!--", "<div><<<>", "&#x;&bogus;", "<article>", "<script>x", "</p></div>"])
def test_broken_pages_do_not_crash(page):
    assert isinstance(html_text.main_text(page), str)


KEEP = "<p>" + "KEEP this long text of the article that goes on for many words and says a lot. " * 4 + "</p>"
DROP = KEEP.replace("KEEP", "DROP") * 9


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="layout sidebar-right"><article>{KEEP}</article></div>', f'<div class="columns-with-sidebar"><article>{KEEP}</article></div>', f'<div id=page class="nav-open"><main>{KEEP}</main></div>',
        f'<div class="page-with-sidebar">{KEEP}</div>', f'<div class="sidebar">{KEEP}{KEEP}</div><div class=ad>DROP</div>', f'<article>{KEEP}<section id="social-history">{KEEP}</section></article>',
        f'<article>{KEEP}<table id="menu-prices"><tr><td>{KEEP}</table></article>', f'<article>{KEEP}<ul class="share-classes"><li>{KEEP}</ul></article>', f'<article>{KEEP}<div class="reply-of-the-minister">{KEEP}</div></article>',
        f'<form id=f><div id=main>{KEEP}</div><div class=ad>DROP</div></form>', f"<article><p>short KEEP</p></article><article>{KEEP}{KEEP}</article>", f"<div>{KEEP}{KEEP}</div><div><p>short KEEP</p></div><div>{KEEP}{KEEP}</div>",
        f'<article>{KEEP}</article><section class="comments"><article>{DROP}</article></section>', f'<main><article>{KEEP}</article><section id="comments">{DROP}</section><div class="related-posts">DROP</div></main>',
        f'<nav>DROP</nav><div class="site-header">DROP</div><div>{KEEP}</div><div class="cookie-banner">DROP</div><div id="comment-list">DROP</div><footer>DROP</footer>',
        f'<article><header class="article-header"><h1>KEEP head</h1></header>{KEEP}</article><aside>{DROP}</aside>', f"<div>{KEEP}</div><aside>{DROP}</aside>",
    ],
)
def test_marks_drop_parts_and_no_wrappers(page):
    text = html_text.main_text(page)
    assert text.count("KEEP") == page.count("KEEP") and "DROP" not in text


def test_cut_off_page_keeps_its_article():
    page = "<html><body><nav><a>Menu</a><article><h1>Head</h1><p>Some text that goes on"
    assert html_text.main_text(page) == "Head\nSome text that goes on"


def test_extract(spark):
    d = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "u", "", "t"), (1, "u", PAGE * 30, "t")], "page_id long, url string, html string, text string")
    rows = html_text.extract(d).collect()
    assert len(rows) == 4 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html_text.extract(d.where("false")).count() == 0


def test_pages_of_the_table(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op2_html_text(spark, sf).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(escapes.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?(?:p|h1|br|div)>", article)]
        assert r["text"] == "\n".join(x for x in parts if x)


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = lower(host)
    fits = [(h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


URLS = [None, "", "no scheme", "http://", "HTTP://A.Org", "https://x.ORG/", "https://example.org/es/1", "https://www.example.org/en/12?x=1", "https://example.org/en/2", "http://a.com/fr/1#z", "http://a.com/de/", "http://acom/de/", "http://com/de/x", "ftp://b.net/a//c?u=http://d.org/", "x://é.org/p"]


def test_listed_rules(spark):
    d = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[5], "h"), (5, URLS[5], "h")], "page_id long, url string, host string")
    none = spark.createDataFrame([], "tokens array<string>, confidence double, support double, lift double")
    rows = url_rules.judge(d, none).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        if r["page_id"] is not None:
            host, path, rule, verdict = brute_rule(URLS[r["page_id"]])
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert url_rules.judge(d.where("false"), none).count() == 0


def test_mined_rules(spark):
    pages, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        pages.append((i, f"http://{'cheap-pills' if bad else 'news'}{i % 3}.net/{'buy' if bad else 'read'}/{i}"))
        labels.append((i, 0 if bad else 1))
    p = spark.createDataFrame([*pages, (900, "http://cheap-pills1.net/buy/7"), (901, "http://quiet.net/"), (902, None)], "page_id long, url string")
    lab = spark.createDataFrame([*labels, (None, 0)], "doc_id long, quality int")
    rules = url_rules.mine(p, lab)
    found = [set(r["tokens"]) for r in rules.collect()]
    assert {"buy"} in found or {"cheap"} in found
    assert not any({"news0", "read"} & f for f in found)
    verdict = {r["page_id"]: r["verdict"] for r in url_rules.judge(p, rules).collect()}
    assert verdict[900] == "block" and verdict[901] == verdict[902] == "allow"
    assert all(verdict[i] == ("block" if i % 5 == 0 else "allow") for i in range(300))
    assert url_rules.mine(p, lab.where("false")).count() == 0


def brute_rules(labelled, least, confidence, lift):
    """Every set of tokens that implies bad, the long way round; those a shorter one is as sure as left out."""
    n, bad = len(labelled), sum(b for _, b in labelled)
    every = sorted({t for s, _ in labelled for t in s})
    sure = {}
    for k in range(1, 4):
        for x in itertools.combinations(every, k):
            rows = [b for s, b in labelled if set(x) <= s]
            if sum(rows) >= least and sum(rows) / len(rows) >= confidence and sum(rows) / len(rows) / (bad / n) >= lift:
                sure[x] = sum(rows) / len(rows)
    return {x for x, c in sure.items() if not any(sure.get(x[:i] + x[i + 1 :], 0) >= c for i in range(len(x)))}


def test_verdicts_of_mined_rules_against_brute_force(spark):
    r = random.Random(8)
    rows = []
    for i in range(400):
        t = {r.choice(["a", "b", "c"]), r.choice(["d", "e"]), r.choice(["f", "g", "h"])}
        rows.append((i, "http://" + ".".join(sorted(t)), 0 if {"a", "d"} <= t and r.random() < 0.9 or "h" in t and r.random() < 0.5 else 1))
    p = spark.createDataFrame([x[:2] for x in rows], "page_id long, url string")
    lab = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, quality int")
    rules = url_rules.mine(p, lab, min_pages=10, min_confidence=0.6, min_lift=1.2)
    want = brute_rules([(set(u[7:].split(".")), q == 0) for _, u, q in rows], 10, 0.6, 1.2)
    assert {tuple(sorted(x["tokens"])) for x in rules.collect()} == want and want
    for x in url_rules.judge(p, rules, listed_rules=()).collect():
        assert x["mined"] == any(set(w) <= set(rows[x["page_id"]][1][7:].split(".")) for w in want)
        assert x["verdict"] == ("block" if x["mined"] else "allow")


def test_mining_is_bounded(spark):
    """Many tokens that always come together are one item; independent ones are cut to max_items a url."""
    long = "http://" + ".".join("t%c" % (97 + i) for i in range(26)) + "/" + "x" * 9000
    r = random.Random(2)
    mixed = ["http://" + ".".join(w for w in ("q%c" % (97 + i) for i in range(24)) if r.random() < 0.9) for _ in range(60)]
    p = spark.createDataFrame([(i, long) for i in range(60)] + [(100 + i, u) for i, u in enumerate(mixed)] + [(900, None)], "page_id long, url string")
    lab = spark.createDataFrame([(i, 0) for i in range(60)] + [(100 + i, 1) for i in range(60)], "doc_id long, quality int")
    rules = url_rules.mine(p, lab)
    assert [x["tokens"] for x in rules.collect()] == [["ta"]]
    assert {x["page_id"]: x["verdict"] for x in url_rules.judge(p, rules).collect()} == {i: "block" for i in range(60)} | {100 + i: "allow" for i in range(60)} | {900: "allow"}
    assert url_rules.mine(p, lab, max_items=3).count() == 1 and url_rules.mine(p, lab.where("doc_id < 10")).count() == 0


def test_no_item_of_a_long_url_is_cut(spark):
    """A pair that tells only together, in URLs of twelve tokens that each tell more alone."""
    r = random.Random(3)
    rows = []
    for i in range(400):
        bad = i % 2 == 0
        pair = ["xx", "yy"] if bad else [r.choice(["xx", "yy"])]
        # Tokens of the other ten in two thirds of the bad URLs and a third of the good.
        rows.append((i, "http://" + ".".join(pair + ["t%d" % k + "k" for k in range(10) if r.random() < (0.66 if bad else 0.34)]), 0 if bad else 1))
    p = spark.createDataFrame([x[:2] for x in rows], "page_id long, url string")
    lab = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, quality int")
    rules = url_rules.mine(p, lab)
    found = {tuple(sorted(x["tokens"])) for x in rules.collect()}
    assert ("xx", "yy") in found
    held = [(set(u[7:].split(".")), q == 0) for _, u, q in rows]
    assert {x for x in found if len(x) <= 3} == brute_rules(held, 20, 0.9, 1.5)
    for x in url_rules.judge(p, rules, listed_rules=()).collect():
        assert x["mined"] == any(set(w) <= held[x["page_id"]][0] for w in found)


def test_no_token_and_no_rule_is_cut(spark):
    pages = spark.range(2400).selectExpr("id as page_id", "concat('http://w', translate(cast(id % 1200 as string), '0123456789', 'abcdefghij'), 'z.net') as url")
    lab = spark.range(2400).selectExpr("id as doc_id", "cast(id % 1200 >= 600 as int) as quality")
    rules = url_rules.mine(pages, lab, min_pages=2)
    assert rules.count() == 600
    for most in (500, 600):  # a table, a literal
        found = url_rules.judge(pages, rules, listed_rules=(), max_rules=most)
        assert found.count() == 2400 and found.where("mined <> (page_id % 1200 < 600)").isEmpty()


def test_rules_are_mined_from_listed_verdicts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labelled = url_rules.listed_labels(pages)
    want = [brute_rule(r["url"])[3] for r in pages.select("url").collect()]
    assert labelled.count() == sum(v is not None for v in want) and labelled.where("bad").count() == want.count("block")
    out = queries.op8_url_rules(spark, "/root/testdata/sf0.1")
    assert out.where("mined AND rule IS NULL AND verdict = 'block'").count() > 0


def test_queries(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {d: x for (d, _), x in zip(docs, brute_hits(docs, items), strict=True)}
    for r in queries.op4_decontamination(spark, sf).collect():
        n, hit, found = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op8_url_rules(spark, sf).collect():
        host, path, rule, verdict = brute_rule(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ((verdict,) if verdict else ("allow", "block"))
