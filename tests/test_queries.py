"""Every registered query runs; those with SQL give the same rows as DuckDB on the same files."""

import glob
import hashlib
import html
import os
import re

import duckdb
import pytest

from captionloom.plans import queries as plans
from captionloom.plans import stream_queries  # noqa: F401  registers its queries

SF = "/root/testdata/sf0.001"


def rows(df):
    names = sorted(df.columns)
    clean = df[names].astype(object).where(df[names].notna(), None)
    return sorted(map(repr, clean.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, oracle, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in plans.ORACLES:
        want = oracle.sql(plans.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_page_text_of_all_pages(spark, tmp_path):
    pages = ["<p>a &amp; b</p>", "cut &", "cut &a", "cut &am", "cut &amp", "<b>x</b>\r\n\ty &amp", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.digest, r.n_chars) for r in plans.QUERIES["page_text_whole"](spark, str(tmp_path)).collect()}
    texts = [" ".join(re.sub("<[^>]+>", "", html.unescape(p)).split()) if p is not None else None for p in pages]
    assert got == {k: (hashlib.md5(t.encode()).hexdigest(), len(t)) if t is not None else (None, None) for k, t in enumerate(texts)}


def test_overlap_of_all_lines(spark, tmp_path):
    docs = ["one two three\r\ntwo three four\r\nthree four\r\n", "a\tb\tc\nb c\td e\nd  e f", "p q r s\nq r s\tt", "same\r\nsame\r\n", "alone", "\t\n\r\n"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.line): r.digest for r in plans.QUERIES["overlap_of_all_lines"](spark, str(tmp_path)).collect()}
    want = {}
    for k, d in enumerate(docs):
        lines = d.split("\n")
        for n, (prev, cur) in enumerate(zip(lines, lines[1:]), 1):
            a, b = prev.split(), cur.split()
            cut = next((m for m in range(min(len(a), len(b), 30), 1, -1) if a[-m:] == b[:m]), 0)
            want[k, n] = hashlib.md5((" ".join(b[cut:]) if cut else cur).encode()).hexdigest()
    assert got == want


def test_parsed_captions_of_hard_words(spark, tmp_path):
    """Repeats in other letters' case are two words to SQL, and a cue may begin after ten hours."""
    says = ["Ö ö eintz ein", "Èon èon onvi, Ñez ñez", "a Ö b A ö b a Ö b", "so So SO", None]
    turns = [(c, t, "user", x) for c in range(6) for t, x in [*enumerate(says), (20_000, "late"), (20_001, "à À")]]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = plans.QUERIES["parsed_captions"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(c.sql(plans.ORACLES["parsed_captions"]).df())


def test_caption_files_lie_under_their_jobs(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(plans.derived, "folder", lambda _: str(tmp_path / "out"))
    jobs = {r.job_id for r in plans.QUERIES["caption_files"](spark, SF).collect()}
    assert {str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.*")} >= {f"{j}/en.vtt" for j in jobs}
