"""What the fitted models decide, against plain Python: log weights and noise, posteriors, tilts and copies, whole pages."""

import collections
import html
import math
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from captionloom.llm import html_extract, importance, mixing, quality_rules
from tests.llm import brute
from tests.llm.test_documents import ROWS, docs  # noqa: F401  a fixture of hard rows

SF = "/root/testdata/sf0.001"


# --- importance resampling

def hashed(*values):
    """Spark's xxhash64: values chained by seed, nulls left out."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<i" if isinstance(v, bool) else "<q", v), h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def test_importance_scores(spark):
    texts = [(k, t) for k, (_, t) in enumerate(ROWS)]
    labels = {k: int(k % 3 > 0) for k in range(0, len(texts), 2)}
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    rows = importance.importance_report(df, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()
    grams = {k: importance.features([(t or "").encode()])[1].tolist() for k, t in texts}
    counts = [collections.Counter(), collections.Counter()]
    for k, g in grams.items():
        counts[0].update(g)
        if labels.get(k) == 1:
            counts[1].update(g)
    size = [sum(c.values()) + importance.BUCKETS for c in counts]
    ratio = lambda b: math.log((counts[1][b] + 1) / size[1]) - math.log((counts[0][b] + 1) / size[0])
    want = {}
    for k, t in texts:
        words = len(brute.WORD.findall(t or ""))
        assert len(grams[k]) == max(0, 2 * words - 1)
        seed = xxhash.xxh64_intdigest(struct.pack("<i", 17), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", k), seed)
        h = xxhash.xxh64_intdigest(struct.pack("<q", signed(hashed(t.encode() if t is not None else None))), h)
        weight = sum(map(ratio, grams[k]))
        want[k] = weight, weight - math.log(-math.log(((h >> 11) + 0.5) / (1 << 53)))
    assert len(rows) == len(texts)
    for r in rows:
        assert math.isclose(r.log_weight, want[r.doc_id][0], abs_tol=1e-6) and math.isclose(r.score, want[r.doc_id][1], abs_tol=1e-6) and r.n_grams == len(grams[r.doc_id])
    best = sorted(want, key=lambda k: -want[k][1])[: round(sum(labels.values()) / len(labels) * len(texts))]
    assert {r.doc_id for r in rows if r.kept} == set(best)


# --- quality rules

def plain_votes(text):
    """One vote of each rule: '=' or '-' for bad, '+' for good, '0' for none."""
    n, chars, symbols, dup, repeated = brute.measures(text)
    words = brute.WORD.findall(text or "")
    lines = sum(1 for x in (text or "").split("\n") if brute.WORD.search(x))
    letters = lambda w: sum(1 for c in w.encode() if c > 127 or chr(c).isalpha())
    alpha = sum(letters(w) * 2 >= len(w.encode()) for w in words)
    with_symbol = sum(bool(re.search(r"[#*$%&|<>]", w)) for w in words)
    d = max(n, 1)
    reasons = (symbols / d > 0.1) + (symbols > 0.02 * chars) + (with_symbol / d > 0.08)
    few = symbols / d < 0.03 and symbols < 0.005 * chars and with_symbol / d < 0.03
    told = lambda bad, good: "-" if bad else "+" if good else "0"
    return "".join([
        told(n < 10, n >= 30),
        "=" if reasons > 1 else told(reasons, few),
        told(dup / max(lines, 1) > 0.5, dup == 0 and lines >= 2),
        told(repeated / d > 0.2, n >= 50 and repeated / d < 0.05),
        told(chars / d < 2 or chars / d > 15, 3 <= chars / d <= 10),
        told(alpha / d < 0.6, alpha / d > 0.8),
        told(n >= 50 and len(set(words)) / d < 0.1, n >= 50 and len(set(words)) / d > 0.2),
    ])


def plain_posteriors(votes):
    """Expectation-maximisation over rows, one number at a time, for a fixed and ample number of steps."""
    rules = range(len(votes[0]))
    strong = [any(v[j] == "=" for v in votes) for j in rules]
    rates = [[{"=": s, "-": b} for _ in rules] for s, b in quality_rules.STARTS]
    prior = 0.8

    def chance(c, j, vote):
        if vote == "0":
            return 1.0
        r = rates[c][j]
        return r[vote] if vote in r else 1 - r["-"] - (r["="] if strong[j] else 0.0)

    for _ in range(400):
        good = []
        for v in votes:
            p = [w * math.prod(chance(c, j, v[j]) for j in rules) for c, w in enumerate((1 - prior, prior))]
            good.append(p[1] / sum(p))
        prior = (sum(good) + 4) / (len(votes) + 5)
        for c in (0, 1):
            for j in rules:
                weight = {x: sum(g if c else 1 - g for g, v in zip(good, votes, strict=True) if v[j] == x) for x in "=-+"}
                held = quality_rules.PRIOR_WEIGHTS[c] * len(votes)
                given = sum(weight.values()) + held
                rates[c][j] = {x: (weight[x] + held * quality_rules.STARTS[c][k]) / given for k, x in enumerate("=-")}
    return good


def test_quality_posteriors(docs):  # noqa: F811
    rows = quality_rules.quality_report(docs).collect()
    votes = [plain_votes(t) for _, t in ROWS]
    want = collections.Counter()
    for (i, t), p in zip(ROWS, plain_posteriors(votes), strict=True):
        m = brute.measures(t)
        want[i, m, round(p, 6), p >= 0.5 and m[0] >= 10 and 100 * m[4] <= 20 * m[0]] += 1
    assert collections.Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), round(r.posterior, 6), r.kept) for r in rows) == want
    assert 0 < sum(r.kept for r in rows) < len(rows)


# --- mixing

def test_tilts_and_copies(docs):  # noqa: F811
    plan = mixing.copies_plan(docs).collect()
    by_source = collections.defaultdict(list)
    for r in plan:
        by_source[r.source].append(r)
    assert sum(r.n_rows for r in plan) == len(ROWS)
    for units in by_source.values():
        total, target = units[0].source_size, units[0].target
        mean = total / sum(u.n_rows for u in units)
        rate = lambda n, tilt: 1.0 if n == 0 else math.exp(min(tilt * n / mean, math.log(2)))  # noqa: B023, E731
        low, high = -1000.0, 1000.0
        for _ in range(200):
            tilt = (low + high) / 2
            low, high = (tilt, high) if sum(u.n_rows * u["size"] * rate(u["size"], tilt) for u in units) < target else (low, tilt)
        want = taken = 0.0
        for u in sorted(units, key=lambda u: (-u["size"], u.k_id is not None, u.k_id or 0, u.k_text)):
            want += rate(u["size"], tilt) * u["size"] * u.n_rows
            copies = u.n_rows if not u["size"] else min(2 * u.n_rows, max(0, math.floor((want - taken) / u["size"] + 0.5)))
            taken += copies * u["size"]
            assert divmod(copies, u.n_rows) == (u.copies, u.extra)
        assert abs(taken - target) <= max(1.0, 0.01 * target)


@pytest.mark.parametrize("kinds, times", [(1, 9000), (3, 1000), (40, 7)])
def test_repeated_rows_meet_the_target(spark, kinds, times):
    """Copies are spread over rows that repeat: the words taken come within a percent of the target, and reruns agree."""
    rows = spark.range(kinds).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") * 7 + 50).cast("int")).alias("text"), F.lit("a").alias("source"), F.explode(F.sequence(F.lit(1), F.lit(times))).alias("n")).drop("n")
    rows = rows.unionByName(spark.range(300).select((F.col("id") + 100).alias("doc_id"), F.repeat(F.lit("x "), (F.col("id") % 40 + 1).cast("int")).alias("text"), F.lit("b").alias("source"))).repartition(5)
    got = mixing.mix_report(rows).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    assert all(abs(r.taken / r.target - 1) < 0.01 and r.most <= 2 for r in got)
    mixed = lambda: sorted(map(tuple, mixing.mix_sources(rows).groupBy("doc_id", "source").count().collect()))
    again = mixed()
    assert again == mixed() and sum(c for i, s, c in again if s == "a") > 0
    told = mixing.mix_report(rows).where("doc_id < 100").groupBy("doc_id").agg(F.sum(F.expr("taken div size")).alias("n")).where("n > 0")
    assert sorted((r.doc_id, r.n) for r in told.collect()) == sorted((i, c) for i, s, c in again if s == "a")


# --- pages

def test_every_page_of_the_table(spark):
    """On the given pages the article is one element, so plain cutting tells its blocks."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.pages_report(pages).collect()}
    want = {}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", "\n<br>") if r.html else ""
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " " if x.startswith("<br") else "", x)).split()) for x in re.split(r"</?(?:h1|h2|p|ul|ol|li|div|table|tr|td)\b[^>]*>", inside)]
        text = "\n".join(b for b in blocks if b)
        want[r.page_id] = text, len(text)
    assert got == want


@pytest.mark.parametrize("k", [0, 1, 5])
def test_noise_is_the_rows_own(spark, k):
    df = spark.range(20).select((F.col("id") + k).alias("id"))
    got = {r.id: r.g for r in df.repartition(3).select("id", importance.gumbel(3, "id").alias("g")).collect()}
    seed = xxhash.xxh64_intdigest(struct.pack("<i", 3), 42)
    assert all(math.isclose(g, -math.log(-math.log(((xxhash.xxh64_intdigest(struct.pack("<q", i), seed) >> 11) + 0.5) / (1 << 53)))) for i, g in got.items())
