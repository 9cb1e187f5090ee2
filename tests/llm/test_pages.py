"""Page operators and the importance sampler: held-out accuracy, brute force, hard rows."""

import random
import time
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from captionloom.llm import html_extract, importance, url_filter


# --- HTML extraction

ARTICLE = "<h1>A Title</h1><p>First &amp; <b>bold</b>\n  text&nbsp;here.<br>more</p><p>Second, with &#233;.</p>"
WANT = "A Title\nFirst & bold text here. more\nSecond, with é."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style><script>var x='<p>no</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav><article>{ARTICLE}</article><footer>&copy; us</footer></body></html>",
        f"<body><header><p>Site name</p></header><div class='cookie-notice'>We use cookies here.</div><main>{ARTICLE}<!-- <p>hidden</p> --></main><aside class=sidebar><p>Read this too</p></aside><section class='comments'><div class=comment><p>Great read!</p></div></section>",
        f"<body><div class=content>{ARTICLE}</div><form class=newsletter><p>Subscribe to our letter</p><input><button>Go</button></form><div class='ad'>Buy it now.</div><div id=footer>Imprint",
        f"<body><article>{ARTICLE}<div class='ad'>Buy it now, it is cheap.</div></article><div id='comments'><p>I disagree, sir.</p></div><p",
    ],
)
def test_extract(page):
    assert html_extract.extract(html_extract.trained(), [page]) == [WANT]


@pytest.mark.parametrize(
    "page",
    [
        f"<head><title>T</title><meta charset=utf-8><article>{ARTICLE}</article>",  # neither </head> nor <body>
        f"<html><head><title>T</title></head><body><main><datalist id=x><option value=a>A<option>B</datalist>{ARTICLE}</main></body>",
        f"<body><article><div><button class=share>Share</div>{ARTICLE}</article></body>",
        f"<body><article><!-- <script> is made later -->{ARTICLE}<!-- <style> --></article></body>",
        f"<body><article><button><div>Go</div></button>{ARTICLE}<select><option>One<option>Two</select></article></body>",
        f"<body><article><svg><g><path/></g><text>no</text></svg>{ARTICLE}<noscript><p>Turn it on</p></noscript></article></body>",
    ],
)
def test_extract_broken_markup(page):
    assert html_extract.extract(html_extract.trained(), [page]) == [WANT]


STORY = "<h1>A Title</h1><p>The text of the story is here, and goes on.</p><p>It ends here.</p>"
TOLD = "A Title\nThe text of the story is here, and goes on.\nIt ends here."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><nav><ul><li><a href=/>Home</a></li></ul></nav><article>{STORY}<figure><img src=x><figcaption>A caption of it.</figcaption></figure></article><footer>&copy; us</footer></body>", f"{TOLD}\nA caption of it."),
        ("<body><nav><a href=/>Home</a></nav><article><h1>Terms</h1><dl><dt>One</dt><dd>The first number.</dd><dt>Two</dt><dd>The second number.</dd></dl></article></body>", "Terms\nOne\nThe first number.\nTwo\nThe second number."),
        ("<body><article><h1>A Title</h1><p>The code is this:</p><pre>x = 1\ny = 2</pre><p>It ends here.</p></article></body>", "A Title\nThe code is this:\nx = 1 y = 2\nIt ends here."),
        ("<body><article><h1>A Title</h1>Text without any paragraph around it.<p>And one with.</p></article></body>", "A Title\nText without any paragraph around it.\nAnd one with."),
        ("The plain sentence stands here alone.", "The plain sentence stands here alone."),
        ("<html><body>Some bare text of a page. It has two sentences.</body></html>", "Some bare text of a page. It has two sentences."),
        (f"<body><div class=rail><ul><li><a href=#>Other stories to read</a></li><li><a href=#>Another story</a></li></ul></div><article>{STORY}</article></body>", TOLD),
        (f"<body><article>{STORY}</article><div class=userposts><h3>Comments</h3><p>I like this one.</p><p>Me too, thanks.</p></div></body>", TOLD),
        (f"<body><article>{STORY}</article><div class=legalese>Copyright 2020 Story Press. All rights reserved.</div></body>", TOLD),
        (f"<body><article>{STORY}</article><h3>Comments</h3><ul><li>I like this one.</li><li>Me too, thanks.</li></ul></body>", TOLD),
        (f"<body><article>{STORY}</article><section><h2>Related</h2><ul><li><a href=#>One more thing</a></li><li><a href=#>Two things</a></li></ul></section></body>", TOLD),
    ],
)
def test_extract_shapes(page, want):
    """Captions, lists of terms, bare text, and parts outside the article whose names tell nothing."""
    assert html_extract.extract(html_extract.trained(), [page]) == [want]


def test_given_pages(spark):
    """Every given page is its article element's blocks."""
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").toLocalIterator():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)
        want = "\n".join(t for _, t, _ in html_extract.blocks_of(body[1] if body else ""))
        assert html_extract.extract(html_extract.trained(), [r.html]) == [want]


def test_blocks_keep_fallbacks_and_formulas():
    texts = [t for _, t, _ in html_extract.blocks_of("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p><object data=a><p>A chart of it.</p></object></article>")]
    assert texts == ["Let x=2 hold.", "A chart of it."]


def test_long_pages_in_parts(monkeypatch):
    model, r = html_extract.trained(), random.Random(3)
    page = "".join(html_extract.training_page(r)[0] for _ in range(12))
    blocks = html_extract.blocks_of(page)
    x, mask = html_extract.padded([blocks])
    assert np.allclose(model.long_page(blocks, 50), model.probabilities(x, mask)[0], atol=1e-4)
    whole = html_extract.extract(model, [page])
    monkeypatch.setattr(html_extract, "BLOCKS", 50)
    assert html_extract.extract(model, [page, "<p>x</p>"])[:1] == whole


@pytest.mark.parametrize("page, n", [("<div><b>x</i>" * 16_000, 16_000), ("<div>" * 16_000 + "y</foo>" * 16_000, 16_000), ("<noscript>" + "<div>" * 16_000 + "</q></zz>" * 16_000, 0)])
def test_deep_pages_take_linear_time(page, n):
    """Paths are shared by the blocks below an element; end tags without a start look nowhere."""
    began = time.perf_counter()
    blocks = html_extract.blocks_of(page)
    assert len(blocks) == n and time.perf_counter() - began < 5  # some 0.2 s; a quadratic walk takes minutes
    assert len({id(path) for path, _, _ in blocks}) <= 2


def test_an_open_quote_ends_with_its_tag():
    assert [t for _, t, _ in html_extract.blocks_of('<p>one</p><p class="x>two</p><p>three</p>')] == ["one", "two", "three"]
    assert [t for _, t, _ in html_extract.blocks_of("a < b <3 <p title='x")] == ["a < b <3"]


def test_extract_held_out():
    model, r, right, total = html_extract.trained(), random.Random(99), 0, 0
    for _ in range(150):
        page, labels = html_extract.training_page(r)
        blocks = html_extract.blocks_of(page)
        assert len(blocks) == len(labels)
        if blocks:
            x, mask = html_extract.padded([blocks])
            right += ((model.probabilities(x, mask)[0] >= 0.5) == np.array(labels, bool)).sum()
            total += len(labels)
    assert right / total > 0.99


def test_gradients_are_the_slope():
    m = html_extract.Labeller()
    r = np.random.default_rng(0)
    x, mask, y = r.normal(size=(3, 4, html_extract.INPUTS)), np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], float), r.integers(0, 2, (3, 4)).astype(float)

    def loss():
        p = m.probabilities(x, mask)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    g = m.gradients(x, mask, y)
    for k, w in m.w.items():
        at = tuple(r.integers(0, n) for n in w.shape)
        kept = w[at]
        w[at] = kept + 1e-5
        up = loss()
        w[at] = kept - 1e-5
        down = loss()
        w[at] = kept
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, "u", None, "row"), (2, None, "", "row"), (3, "u", f"<article>{ARTICLE}</article>", "row"), (3, "u", f"<article>{ARTICLE}</article>", "row"), (4, "u", "plain words without any tag", "row"), (5, "u", "<p>" * 3000 + "deep", "row"), (6, "u", "<article>" + "<p>word and more.</p>" * 3000 + "</article>", "row")], "page_id long, url string, html string, text string")
    rows = html_extract.pages_report(df).collect()
    got = {r.page_id: (r.text, r.n_chars) for r in rows}
    assert len(rows) == 7 and got[1] == got[2] == ("", 0) and got[3] == (WANT, len(WANT)) and got[6][0].count("word") == 3000
    assert html_extract.pages_report(df.where("false")).count() == 0
    assert html_extract.extract_pages(df, out_col="text").columns == ["page_id", "url", "html", "text"]


# --- URL filter

def judge(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None))


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://a.com", "http://A.com/x?y#z", "https://example.com/en/", "https://www.example.com/en/1", "https://x.www.Example.com/en/1", "http://notexample.com/en/a", "http://a.net/es/1", "http://net/fr/", "http://a.net/de/", "http://b.org?x=/es/", "x://y://z.com/a", "http://é.org/a"]
    urls += ["http://bad.net/es/p"] * 30 + ["http://bad.net/de/p"] + ["http://new.org/a"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert len(rows) == len(urls)
    for k, u in enumerate(urls):
        host, path, rule, verdict = judge(u)
        assert (rows[k].host, rows[k].path, rows[k].rule) == (host, path, rule), u
        assert rows[k].verdict == verdict if verdict else rows[k].verdict in ("allow", "block")
    assert rows[len(urls) - 2].verdict == "block" and rows[len(urls) - 1].verdict == "allow" and rows[0].verdict == "allow"
    assert url_filter.judge_urls(df.where("false")).count() == 0


def test_a_host_with_most_pages(spark):
    """One host in many parts, one domain with many hosts, ids that are null or repeat: every row has its host's bound."""
    rows = [(k % 3000 or None, f"http://big.site.org/{k}") for k in range(9000)] + [(k, f"http://h{k}.site.org/x") for k in range(500)] + [(k, f"http://bad.net/es/{k}") for k in range(200)] + [(1, "http://bad.net/en/1"), (None, None)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string").repartition(5)).collect()
    assert len(got) == len(rows)
    bounds = {h: {r.lower for r in got if r.host == h} for h in ("big.site.org", "h1.site.org", "h499.site.org", "bad.net")}
    assert all(len(b) == 1 and None not in b for b in bounds.values()) and bounds["h1.site.org"] == bounds["h499.site.org"]
    assert [r.verdict for r in got if r.path == "/en/1" and r.host == "bad.net"] == ["block"] and [r.lower for r in got if r.host == ""] == [None]


def test_reputations(spark):
    rows = [("bad.x.aa", True)] * 40 + [("good.x.aa", False)] * 40 + [("one.y.aa", True)] + [("few.z.aa", False)] * 3 + [(f"h{k}.w.aa", k % 9 == 0) for k in range(60)]
    got = {r.host: r for r in url_filter.host_reputations(spark.createDataFrame(rows, "host string, is_bad boolean")).collect()}
    assert got["bad.x.aa"].lower > 0.5 > got["one.y.aa"].lower and got["good.x.aa"].mean < got["few.z.aa"].mean < got["one.y.aa"].mean < got["bad.x.aa"].mean
    assert all(r.lower <= r.mean for r in got.values())


def test_hosts_without_outcomes(spark):
    """A new host is judged by its domain, else its suffix, else all pages; one that is known, by its own pages."""
    rows = [(f"h{k}.bad.aa", True) for k in range(200)] + [(f"h{k}.good.aa", False) for k in range(200)] + [(f"x{k}.d{k}.cc", True) for k in range(60)] + [(f"x{k}.e{k}.dd", False) for k in range(90)] + [("ok.bad.aa", False)] * 12
    outcomes = spark.createDataFrame(rows, "host string, is_bad boolean")
    want = {"new.bad.aa": "block", "a.b.bad.aa": "block", "bad.aa": "block", "new.good.aa": "allow", "new.z.aa": "allow", "new.z.cc": "block", "new.z.dd": "allow", "new.z.zz": "allow"}
    pages = spark.createDataFrame([(f"http://{h}/p",) for h in [*want, "ok.bad.aa"]] + [("no host",), (None,)], "page_id string").withColumn("url", F.col("page_id"))
    got = {r.host: r for r in url_filter.judge_urls(pages, rules=(), outcomes=outcomes).collect()}
    assert {h: got[h].verdict for h in want} == want
    assert got[""].verdict == "allow" and got[""].lower is None and all(got[h].lower is not None for h in want)
    assert got["ok.bad.aa"].lower == url_filter.host_reputations(outcomes).where("host = 'ok.bad.aa'").first().lower < got["new.bad.aa"].lower
    all_bad = spark.createDataFrame([(f"x.d{k}.s{k}", True) for k in range(200)], "host string, is_bad boolean")
    assert {r.verdict for r in url_filter.judge_urls(pages.where("url LIKE '%.zz/p'"), rules=(), outcomes=all_bad).collect()} == {"block"}


# --- importance resampling

def test_top_k(spark):
    r = random.Random(8)
    rows = [(k, float(r.randint(0, 40))) for k in range(500)] + [(None, 39.0)]
    df = spark.createDataFrame(rows, "id long, score double").repartition(6).cache()
    order = sorted(rows, key=lambda x: (-x[1], x[0] is not None, x[0] or 0))
    for k in (0, 1, 7, 250, 500, 501, 900):
        assert {x.id for x in importance.top_k(df, k).where("kept").collect()} == {i for i, _ in order[:k]}


def test_importance(spark):
    r = random.Random(5)
    good = lambda: " ".join(r.choice(("sun", "moon", "star", "sky", "light")) for _ in range(30))
    bad = lambda: " ".join(r.choice(("$$$", "buy", "now", "!!!")) for _ in range(30))
    texts = [good() if k % 4 else bad() for k in range(200)] + [None, "", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(0, 200, 3)], "doc_id long, quality int")
    rows = importance.importance_report(docs, labels).collect()
    kept = {x.doc_id for x in rows if x.kept}
    assert len(rows) == 203 and {k for k in range(200) if k % 4 == 0}.isdisjoint(kept) and len(kept & set(range(200))) > 140
    again = importance.importance_report(docs.repartition(3), labels).collect()
    assert {x.doc_id: round(x.score, 9) for x in rows} == {x.doc_id: round(x.score, 9) for x in again}
    ratio = importance.fit_ratio(docs.join(labels, "doc_id", "left"), labels["quality"] == 1)
    counts = np.ones((2, importance.BUCKETS))
    for k, t in enumerate(texts):
        _, b = importance.features([(t or "").encode()])
        np.add.at(counts[0], b, 1)
        if k < 200 and k % 3 == 0 and k % 4:
            np.add.at(counts[1], b, 1)
    p = np.log(counts / counts.sum(1, keepdims=True))
    assert np.allclose(ratio, p[1] - p[0])
    assert importance.importance_report(docs.where("false"), labels.where("false")).count() == 0
