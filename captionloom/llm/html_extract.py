"""HTML extraction: a bidirectional LSTM in numpy labels each page's text blocks as article or not, in page context."""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionloom.llm.common import Words, quoted

# Element names of HTML.
SKIPPED = frozenset("head noscript template svg select option button datalist".split())
HEAD = frozenset("title meta link base script style noscript template".split())
RAW = frozenset("script style textarea title iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meta link q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
MATHS = frozenset("math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot munder mover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_NEXT = frozenset("p li dt dd tr td th".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|$)|<[!?][^>]*(?:>|$)|([^<]+|<)", re.S)
#: A tag whose attribute lacks its closing quote, up to where it seems to end.
BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|$)")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

PATH_DIM, WORD_DIM, EXTRA_DIM = 384, 32, 6
INPUTS = PATH_DIM + WORD_DIM + EXTRA_DIM
HIDDEN = 12


@functools.lru_cache(maxsize=4096)
def _names(attributes: str) -> tuple[str, ...]:
    found = " ".join(x or y or z for x, y, z in NAMED.findall(attributes)).lower()
    return tuple(dict.fromkeys(re.findall(r"[a-z]+", found)))


@functools.cache
def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.I)


#: Slots of the names on a block's path, its text, and its share of linked characters.
Block = tuple[tuple[int, ...], str, float]


def _slots(names: tuple[str, ...], above: tuple[int, ...] = ()) -> tuple[int, ...]:
    """The slots of an element's path: those above it and its own; the same object where it adds none, so that a page
    nested to any depth has few of them."""
    more = {zlib.crc32(n.encode()) % PATH_DIM for n in names}.difference(above)
    return tuple(sorted(more.union(above))) if more else above


def blocks_of(page: str) -> list[Block]:
    """(path, text, share of linked characters) of every leaf block in page order, in time linear in the page.

    The path holds hashed names, classes, ids and roles of the open block elements. A block ends at every block element's
    start and end tag; <br> and other inline tags end none. Text is decoded, white space runs become one space. Comments,
    scripts, styles and form controls are no text; a control or drawing without an end tag ends with the element it is
    in, and a head with the first element that belongs to a body. A tag with an open quote ends at the next '>'.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    open_tags: Counter[str] = Counter()
    open_inner: Counter[str] = Counter()
    text: list[str] = []
    linked = anchor = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((stack[-1][1] if stack else (), joined, min(1.0, linked / len(joined))))
            text.clear()
        linked = 0

    def pop_to(tags: list, counts: Counter, tag: str, name) -> None:
        """Close the innermost open `tag` and all in it."""
        while tags:
            gone = name(tags.pop())
            counts[gone] -= 1
            if gone == tag:
                return

    skip, inner, at = None, [], 0  # the element whose content is left out, what is open in it, where to read on
    while at < len(page):
        m = TOKEN.match(page, at)
        if m[5] == "<":
            m = BROKEN.match(page, at) or m
        at = m.end()
        plain = m[5] if m.re is TOKEN else None
        if plain is not None:
            if skip == "head" and not inner and not plain.isspace():
                skip = None
            if skip is None:
                text.append(plain)
                if anchor:
                    linked += len(plain)
            continue
        if m[2] is None:
            continue
        tag, closing, alone = m[2].lower(), m[1] == "/", m[3].endswith("/")
        if tag in RAW and not closing:
            end = _end_tag(tag).search(page, at)
            at = end.end() if end else len(page)
            if tag == "textarea" and skip is None:
                flush()
            continue
        if skip is not None:
            if closing and open_inner[tag]:
                pop_to(inner, open_inner, tag, lambda x: x)
            elif closing and tag == skip:
                skip = None
            elif closing and open_tags[tag] or not closing and skip == "head" and tag not in HEAD:
                skip = None
                inner.clear()
                open_inner.clear()
            elif not closing and tag not in VOID and tag not in INLINE and tag != "option" and not alone:
                inner.append(tag)
                open_inner[tag] += 1
            if skip is not None or closing and tag in SKIPPED:
                continue
        if tag in INLINE or tag in MATHS:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                anchor = 0 if closing else 1
            continue
        flush()
        if closing:
            if open_tags[tag]:
                pop_to(stack, open_tags, tag, lambda x: x[0])
            anchor = 0
        elif tag in SKIPPED:
            skip = None if alone else tag
            inner.clear()
            open_inner.clear()
        elif tag not in VOID:
            if stack and (tag in CLOSED_BY_NEXT and stack[-1][0] == tag or stack[-1][0] == "p"):
                open_tags[stack.pop()[0]] -= 1
            if not alone:
                stack.append((tag, _slots((tag, *_names(m[3])), stack[-1][1] if stack else ())))
                open_tags[tag] += 1
    flush()
    return out


def features(blocks: list[Block], place: np.ndarray) -> np.ndarray:
    """One input vector per block: hashed path names, hashed words of the whole block, and shape; place is 0 at a page's
    start and 1 at its end."""
    x = np.zeros((len(blocks), INPUTS), np.float32)
    if not blocks:
        return x
    for i, (path, _, _) in enumerate(blocks):
        x[i, list(path)] = 1
    w = Words([t.encode("utf-8", "replace") for _, t, _ in blocks], lower=True)
    slot = (w.hashes() % np.uint64(WORD_DIM)).astype(np.int64)
    counts = np.bincount(w.doc * WORD_DIM + slot, minlength=len(blocks) * WORD_DIM).reshape(-1, WORD_DIM)
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] = counts / np.sqrt(np.maximum(w.n_words, 1))[:, None] / 4
    length = np.array([len(t) for _, t, _ in blocks])
    x[:, PATH_DIM + WORD_DIM :] = np.stack([np.log1p(length) / 6, np.log1p(w.n_words) / 5, [r for _, _, r in blocks], [t[-1] in ".!?:;\"'”»" for _, t, _ in blocks], place, [t.count(",") / (len(t) + 1) * 20 for _, t, _ in blocks]], axis=1)
    return x


def places(n: int) -> np.ndarray:
    return np.arange(n) / max(1, n - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Labeller:
    """Two LSTMs, one from each end, and a logistic output per block."""

    def __init__(self, seed: int = 7, kind: type = np.float64):
        r = np.random.default_rng(seed)
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = r.normal(0, 1 / np.sqrt(INPUTS), (INPUTS, 4 * HIDDEN))
            self.w[f"h{d}"] = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            self.w[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.w["o"] = r.normal(0, 0.3, 2 * HIDDEN)
        self.w["p"] = np.zeros(1)
        self.w = {k: v.astype(kind) for k, v in self.w.items()}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, state: tuple[np.ndarray, np.ndarray] | None = None):
        """x: pages x blocks x inputs, mask: pages x blocks. (outputs, what gradients need, state at the end); states after
        padding are left as they were."""
        n, t, _ = x.shape
        kind = self.w["p"].dtype
        h, c = state or (np.zeros((n, HIDDEN), kind), np.zeros((n, HIDDEN), kind))
        pre = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        mask = mask.astype(kind)
        out, saved = np.zeros((n, t, HIDDEN), kind), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[:, k] + h @ self.w[f"h{d}"]
            gates = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, k, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep:
                saved.append((k, i, f, o, g, c, h, tc, m))
            h, c = m * o * tc + (1 - m) * h, m * c2 + (1 - m) * c
            out[:, k] = h
        return out, saved, (h, c)

    def scored(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        return sigmoid(np.concatenate([forward, backward], axis=2) @ self.w["o"] + self.w["p"])

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self.scored(*(self._run(x, mask, d, False)[0] for d in "fb"))

    def long_page(self, blocks: list[Block], most: int) -> np.ndarray:
        """probabilities() of one page, whose blocks pass `most` at a time in either direction with the state carried on."""
        place, both = places(len(blocks)), []
        for d in "fb":
            out, state = np.zeros((1, len(blocks), HIDDEN), np.float32), None
            starts = range(0, len(blocks), most)
            for a in starts if d == "f" else reversed(starts):
                part = blocks[a : a + most]
                out[:, a : a + most], _, state = self._run(features(part, place[a : a + most])[None], np.ones((1, len(part))), d, False, state)
            both.append(out)
        return self.scored(*both)[0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        delta = ((sigmoid(both @ self.w["o"] + self.w["p"]) - y) * mask / mask.sum()).astype(both.dtype)
        grad = {"o": delta.ravel() @ both.reshape(-1, 2 * HIDDEN), "p": np.array([delta.sum()])}
        for s, d in enumerate("fb"):
            above = delta[:, :, None] * self.w["o"][s * HIDDEN : (s + 1) * HIDDEN]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), both.dtype)
            dh, dc = np.zeros((len(x), HIDDEN), both.dtype), np.zeros((len(x), HIDDEN), both.dtype)
            wh = np.zeros_like(self.w[f"h{d}"])
            for k, i, f, o, g, c, h, tc, m in reversed(runs[d][1]):
                dh = dh + above[:, k]
                do = m * dh * tc
                dc2 = m * (dc + dh * o * (1 - tc**2))
                dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), do * o * (1 - o), dc2 * i * (1 - g**2)], axis=1)
                dz_all[:, k] = dz
                wh += h.T @ dz
                dh, dc = (1 - m) * dh + dz @ self.w[f"h{d}"].T, (1 - m) * dc + dc2 * f
            grad |= {f"x{d}": x.reshape(-1, INPUTS).T @ dz_all.reshape(-1, 4 * HIDDEN), f"h{d}": wh, f"c{d}": dz_all.sum((0, 1))}
        return grad


def padded(pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, mask) of pages side by side."""
    x = features([b for p in pages for b in p], np.concatenate([places(len(p)) for p in pages]))
    most = max(map(len, pages))
    out, mask, at = np.zeros((len(pages), most, x.shape[1]), x.dtype), np.zeros((len(pages), most)), 0
    for k, p in enumerate(pages):
        out[k, : len(p)], mask[k, : len(p)] = x[at : at + len(p)], 1
        at += len(p)
    return out, mask


# What page builders call the parts of a page that are not its article.
SIDE = {
    "nav": ("nav", "div.menu", "ul.navigation", "div.navbar", "div#nav", "div.nav", "ol.breadcrumb", "div.breadcrumbs", "div.topnav", "div.main-menu", "ul.menu", "div.pagination", "nav.pager"),
    "header": ("header", "div.header", "div#masthead", "div.site-header", "div.topbar", "div#header", "div.page-header"),
    "footer": ("footer", "div.footer", "div#footer", "div.site-footer", "div.copyright", "div.bottom", "div.legal", "div.foot"),
    "aside": ("aside", "div.sidebar", "div#sidebar", "aside.widget", "div.widget", "div.related", "section.recommended", "div.popular", "div.side", "div.teaser", "div.trending", "ul.related-posts"),
    "ad": ("div.ad", "div.advert", "div.ads", "div.sponsored", "aside.promo", "div.banner", "div#ad", "section.advertisement", "div.ad-slot", "div.promotion", "div.commercial"),
    "notice": ("div.notice", "div.cookie-notice", "div.alert", "div.cookies", "div.cookie-banner", "div.consent", "div.gdpr", "section.announcement", "div.popup", "div.warning", "div.privacy", "div.message"),
    "form": ("form", "form.search", "div.newsletter", "form.subscribe", "div.signup", "form.login", "div.login", "div.share", "div.social", "div.form", "form.contact", "div.subscribe"),
    "comments": ("section.comments", "div#comments", "div.comment", "ol.comment-list", "ul.comments", "div.replies", "div.reply", "section#disqus", "div.reader-comments", "div.discussion", "div.responses", "div.feedback"),
}
MAIN = ("article", "main", "main/article", "div.content", "div#content", "div.post", "div.article-body", "section.story", "div.entry-content", "article.post", "div.text", "div.main", "div#main", "section.article", "div.page-content", "div.blog-post", "div.post-body", "div.news-item", "div", "section")
FRAME = ("div.container", "div#page", "div.wrapper", "div.layout", "div.site", "div#wrap", "div.row")


def _element(spec: str, inside: str) -> str:
    for part in reversed(spec.split("/")):
        tag, kind, name = re.fullmatch(r"(\w+)([.#]?)([\w-]*)", part).groups()
        attribute = {"": "", ".": f' class="{name}"', "#": f' id="{name}"'}[kind]
        inside = f"<{tag}{attribute}>{inside}</{tag}>"
    return inside


def training_page(r: random.Random) -> tuple[str, list[int]]:
    """A page made by rule, and 1 or 0 for each of its blocks: article or not.

    Where the article's own element is named, the parts outside it need no name that is known, or none at all.
    """
    syllables = [a + b for a in "bdfgklmnprstvz" for b in ("a", "e", "i", "o", "u", "an", "er", "io", "en")]
    labels: list[int] = []

    def words(n: int) -> str:
        made = [("".join(r.choice(syllables) for _ in range(r.randint(1, 3)))) for _ in range(n)]
        return " ".join(made).capitalize()

    def leaf(tag: str, label: int, low: int, high: int, stop: str = ".") -> str:
        labels.append(label)
        body = words(r.randint(low, high)) + (stop if r.random() < 0.8 else "")
        if r.random() < 0.1:
            body = f"<b>{body}</b>" if r.random() < 0.5 else f"{body}<br>"
        return f"<{tag}>{body}</{tag}>"

    main = r.choice(MAIN)
    told = main not in ("div", "section")

    def unnamed(kind: str) -> str:
        """An element whose name tells nothing."""
        tag = r.choice(("div", "div", "section", "ul" if kind == "nav" else "div"))
        return tag if r.random() < 0.5 else f"{tag}{r.choice('.#')}{''.join(r.choice(syllables) for _ in range(3))}"

    def side(kind: str, outside: bool = False) -> str:
        spec = unnamed(kind) if outside and told and r.random() < 0.3 else r.choice(SIDE[kind])
        shape = r.random()
        if kind == "nav" or shape < 0.2:
            inside = "<ul>" + "".join(f"<li><a href='#'>{_marked(labels, words(r.randint(1, 2)))}</a></li>" for _ in range(r.randint(2, 7))) + "</ul>"
        elif shape < 0.45 and kind in ("aside", "comments"):
            tag = r.choice(("ul/li", "ol/li", "div/p"))
            inside = leaf(r.choice(("h2", "h3", "h4")), 0, 1, 4, "") + _element(tag.split("/")[0], "".join(leaf(tag.split("/")[1], 0, 2, 30) for _ in range(r.randint(1, 5))))
            if outside and told and r.random() < 0.4:  # a heading and a list in the page's body
                return inside
        elif shape < 0.55:
            inside = _marked(labels, words(r.randint(3, 40)) + ".")
        else:
            inside = "".join(leaf(r.choice(["p", "div", "h3"]), 0, 2, 60) for _ in range(r.randint(1, 3)))
        return _element(spec, inside)

    if r.random() < 0.06:  # a page of text alone
        text = " ".join(words(r.randint(3, 30)) + "." for _ in range(r.randint(1, 6)))
        labels.append(1)
        return r.choice(("{}", "<body>{}</body>", "<html><head><title>x</title></head><body>{}</body></html>", "<p>{}</p>", "<body><div>{}</div></body>")).format(text), labels
    before = "".join(side(k, True) for k in ("header", "nav", "notice", "ad", "form") if r.random() < 0.5)
    body = leaf("h1", 1, 2, 12, "") if r.random() < 0.85 else ""
    for _ in range(r.choice((0, 1, 2, 4, 8, 16))):
        if r.random() < 0.12:
            body += side(r.choice(("ad", "aside", "form", "notice", "nav")))
        kind = r.choice("pppppppphlqtdfgxb")
        if kind == "p":
            body += leaf("p", 1, 1, 120)
        elif kind == "h":
            body += leaf(r.choice(("h2", "h3")), 1, 1, 8, "")
        elif kind == "l":
            body += "<ul>" + "".join(leaf("li", 1, 1, 20) for _ in range(r.randint(1, 4))) + "</ul>"
        elif kind == "q":
            body += _element("blockquote", leaf("p", 1, 5, 40))
        elif kind == "t":
            body += "<table><tr>" + "".join(leaf("td", 1, 1, 4, "") for _ in range(3)) + "</tr></table>"
        elif kind == "f":
            body += "<figure><img src=x>" + leaf("figcaption", 1, 2, 20) + "</figure>"
        elif kind == "g":
            body += "<dl>" + "".join(leaf("dt", 1, 1, 3, "") + leaf("dd", 1, 3, 20) for _ in range(r.randint(1, 3))) + "</dl>"
        elif kind == "x":
            body += leaf("pre", 1, 2, 30, "")
        elif kind == "b":  # text of no element of its own
            labels.append(1)
            body += f"<hr>{words(r.randint(4, 60))}.<hr>"
        else:
            body += leaf("div", 1, 5, 80)
    if r.random() < 0.1:
        body += side("comments")
    page = before + _element(main, body)
    page += "".join(side(k, True) for k in ("aside", "ad", "comments", "form", "footer") if r.random() < 0.5)
    if r.random() < 0.4:
        page = _element(r.choice(FRAME), page)
    return f"<html><head><title>x</title></head><body>{page}</body></html>", labels


def _marked(labels: list[int], text: str) -> str:
    labels.append(0)
    return text


@functools.cache
def trained(pages: int = 2000, epochs: int = 14, batch: int = 40, seed: int = 11) -> Labeller:
    """Fit the labeller by Adam on `pages` pages made by rule; no row of the input is used, so it is the same for all inputs."""
    r = random.Random(seed)
    data = []
    for _ in range(pages):
        page, labels = training_page(r)
        blocks = blocks_of(page)
        if blocks and len(blocks) == len(labels):
            data.append((blocks, np.array(labels, float)))
    data.sort(key=lambda d: len(d[0]))
    batches = []
    for at in range(0, len(data), batch):
        part = data[at : at + batch]
        x, mask = padded([b for b, _ in part])
        y = np.zeros(mask.shape)
        for k, (_, labels) in enumerate(part):
            y[k, : len(labels)] = labels
        batches.append((x, mask, y))
    model = Labeller(kind=np.float32)
    first, second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        r.shuffle(batches)
        for x, mask, y in batches:
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for k, g in model.gradients(x, mask, y).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


#: Blocks whose inputs are held at a time.
BLOCKS = 8_000


def extract(model: Labeller, htmls: list[str], group: int = 128) -> list[str]:
    """The article text of each page: its blocks labelled article, in page order, joined by line feeds.

    Pages of like length are labelled side by side. A page of more than BLOCKS blocks passes in parts, with the network's
    state carried on, so inputs are bounded and every block still sees the whole page.
    """
    pages = [blocks_of(h) for h in htmls]
    out = [""] * len(pages)

    def told(page: list[Block], p: np.ndarray) -> str:
        return "\n".join(t for (_, t, _), score in zip(page, p, strict=False) if score >= 0.5)

    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        size = 1
        while at + size < len(order) and size < group and (size + 1) * len(pages[order[at + size]]) <= BLOCKS:
            size += 1
        part = order[at : at + size]
        if len(pages[part[0]]) > BLOCKS:
            out[part[0]] = told(pages[part[0]], model.long_page(pages[part[0]], BLOCKS))
        else:
            x, mask = padded([pages[k] for k in part])
            for k, p in zip(part, model.probabilities(x, mask), strict=True):
                out[k] = told(pages[k], p)
        at += size
    return out


def extract_column(spark):
    shared = spark.sparkContext.broadcast(trained().w)  # a fixed number of weights, 0.2 MB

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Labeller()
        model.w = shared.value
        for htmls in batches:
            out: list[str] = []
            for at in range(0, len(htmls), 500):
                out += extract(model, [h if isinstance(h, str) else "" for h in htmls.iloc[at : at + 500]])
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")


def extract_pages(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with out_col: the page's main text, empty if it has none (null or empty html); all other columns stay."""
    kept = [F.col(quoted(c)) for c in pages.columns if c != out_col]
    return pages.select(F.struct(*kept).alias("row"), extract_column(pages.sparkSession)(F.col(html_col)).alias("t")).select("row.*", F.col("t").alias(out_col))


def pages_report(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; without html or article the text is empty."""
    return extract_pages(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
