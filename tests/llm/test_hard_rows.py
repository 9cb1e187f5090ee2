"""Odd column names, repeats, nulls and ties, for the operators that carry whole rows."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from captionloom.llm import common, html_extract, importance, line_dedup, mixing, ngram_join, pieces, quality_rules, suffix_dedup, url_filter

TEXT = "a plain line of words that is long enough to pass\nand a second line of other words, again long enough to be kept here"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, TEXT, "s", 7, "x"), (1, TEXT, "s", 7, "x"), (2, None, None, 8, None), (None, "", "s", 9, "y"), (3, "short", "t", None, "z"), (4, TEXT + " more", "t", 1, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int, `row` string")


def test_whole_rows_pass_whatever_their_names(odd):
    for f in (quality_rules.keep_good, line_dedup.drop_repeated_lines, ngram_join.drop_near_copies, mixing.mix_sources):
        out = f(odd)
        assert out.columns == odd.columns and out.schema["a.b"].dataType == odd.schema["a.b"].dataType, f
        assert {r["a.b"] for r in out.collect()} <= {7, 8, 9, None, 1}
    coded = pieces.encode_documents(odd)
    assert coded.columns == [*odd.columns, "token_ids", "n_tokens", "round_trip"] and coded.count() == 6
    pages = odd.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<article><p>"), "text", F.lit("</p></article>")).alias("html"), F.col("`a.b`"), F.col("row"))
    assert sorted((r.page_id or 0, r["a.b"] or 0, r.text != "") for r in html_extract.extract_pages(pages).collect()) == [(0, 9, False), (1, 7, True), (1, 7, True), (2, 8, False), (3, 0, True), (4, 1, True)]


def test_repeated_rows_have_a_row_each(odd):
    assert Counter(r.doc_id for r in mixing.mix_report(odd).collect()) == Counter([1, 1, 2, None, 3, 4])
    many = odd.where("doc_id = 1").limit(1).select("doc_id", "text", "source", F.explode(F.sequence(F.lit(1), F.lit(9000))).alias("n")).drop("n")
    assert mixing.mix_report(many).count() == 9000
    urls = [("http://a.net/x",)] * 3 + [("http://é" + "a" * 5000 + ".net/es/" + "b" * 50_000,), (None,), ("http://10.0.0.1:80/x",), ("http://u@x.co.uk:8080/y",)]
    df = urls and odd.sparkSession.createDataFrame([(k, u, "host", "v") for k, (u,) in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = url_filter.judge_urls(df).collect()
    assert len(got) == 7 and {r.host for r in got if r.page_id < 3} == {"a.net"} and len([r for r in got if r.verdict == "block"]) == 1
    told = df.select(url_filter.suffix_of(url_filter.host_of(F.col("url"))).alias("s"), url_filter.domain_of(url_filter.host_of(F.col("url"))).alias("d")).collect()
    assert [tuple(r) for r in told[-2:]] == [("(address)", "10.0.0.1"), ("co.uk", "x.co.uk")] and tuple(told[0]) == ("net", "a.net")


def test_ties_at_the_border(spark):
    rows = [(k % 50, float(k % 3)) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, score double").cache()
    for k in (1, 100, 333, 599):
        kept = {(r.id, r.score) for r in importance.top_k(df, k).where("kept").collect()}
        order, seen = sorted(set(rows), key=lambda x: (-x[1], x[0])), 0
        for x in order:
            assert (x in kept) == (seen < k)
            seen += rows.count(x)


def test_label_model_settles_and_groups_symbols():
    counts = {"+" * 7: 900, "+=" + "+" * 5: 60, "++-++++": 30, "0" * 7: 10}
    p = quality_rules.fit_label_model(counts)
    assert p["+=+++++"] < 0.5 < p["+" * 7] and set(p) == set(counts)


def test_a_key_of_most_rows_is_dealt_to_parts(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("k"), "id")
    got = common.beside(rows, ["k"], ["id"], "n > 1", n=F.count("*"), low=F.min("id"))
    assert {tuple(r) for r in got.select("n", "low").collect()} == {(900, 0)} and got.count() == 900


def test_scratch_tables_go(spark):
    import os

    with common.scratch(spark):
        t = common.cut(spark.range(3))
        path = t.inputFiles()[0].removeprefix("file:")
        kept = common.cut(t, lasting=True)
        assert os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3


def test_repeated_windows_with_runs():
    """A thousand small corpora with runs of short periods in shared passages: every window as brute force says."""
    r = random.Random(21)
    w = lambda n, a="abcdefgh ": "".join(r.choice(a) for _ in range(n))
    for _ in range(1000):
        run = lambda: (w(r.randint(1, 4), "-. a") * 120)[: r.randint(0, 120)]
        passage = w(r.randint(0, 90)) + run() + w(r.randint(60, 200)) + run()
        texts = [w(r.randint(0, 50)) + run() * r.randint(0, 1) + passage + w(r.randint(0, 60)) for _ in range(3)]
        windows = [[t[k : k + 200] for k in range(len(t) - 199)] for t in texts]
        count = Counter(x for v in windows for x in v)
        runs = pd.concat([suffix_dedup.anchored_runs(held) for held in suffix_dedup.pieces(texts, 5000)])
        if not len(runs):
            continue
        hit = suffix_dedup.repeated_windows([texts[x.row][x.start : x.start + x.n + 199].encode() for x in runs.itertuples()], runs["n"].to_numpy(), runs["anchor"].to_numpy())
        at = [(x.row, x.start + k) for x in runs.itertuples() for k in range(x.n)]
        assert np.array_equal(hit, [count[windows[i][k]] > 1 for i, k in at])
