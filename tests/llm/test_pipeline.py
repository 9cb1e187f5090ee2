"""The pipeline's stages, each on what the one before it kept, against brute force."""

import collections
import random

import sentencepiece

import corpus_pipeline
from captionloom.llm import pieces
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(t.columns == columns for t in tables[:-1])
    source, good, lines, single, mixed, ids = ([r.asDict() for r in t.collect()] for t in tables)
    pair = lambda rows: [(r["doc_id"], r["text"]) for r in rows]
    assert set(pair(good)) <= set(pair(source)) and all(m[0] >= 10 and 100 * m[4] <= 20 * m[0] for m in (brute.measures(r["text"]) for r in good))
    expected = brute.kept_lines(pair(good))
    assert sorted(pair(lines)) == sorted((i, t) for (i, _), (_, _, t) in zip(pair(good), expected, strict=True))
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    least = brute.components(pair(lines))
    assert sorted(pair(single)) == sorted(p for k, p in enumerate(pair(lines)) if least[k] == p[0])
    times = collections.Counter(r["doc_id"] for r in mixed)
    assert max(times.values()) <= 2 and {(r["doc_id"], r["text"]) for r in mixed} <= set(pair(single))
    words = lambda rows: sum(len(brute.WORD.findall(r["text"])) for r in rows)
    assert abs(words(mixed) / (1.5 * words(single)) - 1) < 0.02
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert sorted(pair(ids)) == sorted(pair(mixed)) and all(r["token_ids"] == sp.encode(r["text"]) and r["round_trip"] for r in ids)
    run = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.text) for r in run.select("doc_id", "text").collect()) == sorted(pair(ids))


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0 and "token_ids" in docs.columns


def test_hard_rows_pass_every_stage(spark, tmp_path):
    """Nulls, repeated rows, a very long text and columns whose names clash with those that stages use inside."""
    r = random.Random(6)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))
    plain, huge = text(60), text(60_000)
    rows = [(1, plain, "en", "s", 0), (1, plain, "en", "s", 0), (2, plain, None, None, 1), (None, text(50), "en", "s", 2), (3, None, "en", "s", None), (4, "", None, "t", 4), (5, huge, "en", None, 5), (6, text(40) + "\n" + text(30), "en", "t", 6)]
    names = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `row` string, k_id string, copies int, kept string, line string"
    docs = spark.createDataFrame([(i, t, lang, source, len(t or ""), n, "r", "k", 9, "yes", "l") for i, t, lang, source, n in rows], names)
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, SF).write.parquet(str(tmp_path / str(k)))
        at = spark.read.parquet(str(tmp_path / str(k)))
        assert at.columns[: len(docs.columns)] == docs.columns
        if k == 0:
            assert sorted(x["a.b"] for x in at.collect()) == [0, 0, 1, 2, 5, 6]
        if k == 2:
            assert sorted(x["a.b"] for x in at.collect()) == [0, 2, 5, 6]
    held = at.collect()
    assert {x["a.b"] for x in held} <= {0, 2, 5, 6} and all((x.row, x.k_id, x.copies, x.kept, x.line) == ("r", "k", 9, "yes", "l") and x.round_trip for x in held)
    assert {x.text for x in held} <= {t for _, t, *_ in rows if t}
