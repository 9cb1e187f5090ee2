import re
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from captionloom.operators import audio, chunks, jobs, points, tracks, transcripts, validate, vectors
from captionloom.sources import messages


# --- chunks

def test_pack_keeps_the_recorded_comparison_rule():
    long = "w " * 10 + "end of it"
    cue = lambda *texts: [(float(k), k + 1.0, t) for k, t in enumerate(texts)]
    assert list(chunks.pack(cue("a b c", "a b c", "d"), 100)) == [("a b c a b c d", 0.0, 3.0)]
    assert list(chunks.pack(cue("a b c", "a b c", "d"), 100, compare_first=True)) == [("a b c d", 0.0, 3.0)]
    assert list(chunks.pack(cue("x", long, "end of it"), 20)) == [("x", 0.0, 1.0), (long, 1.0, 2.0)]  # the oversize text is compared with
    assert list(chunks.pack(cue(long, "end of it"), 20)) == [(long, 0.0, 1.0), ("end of it", 1.0, 2.0)]  # not if it opened the buffer
    assert list(chunks.pack([], 5)) == []


@pytest.mark.parametrize("seed", range(3))
def test_pack_properties(seed):
    r = random.Random(seed)
    cues = [(k, k + 1, " ".join(r.choice("abcdef") * r.randint(1, 9) for _ in range(r.randint(1, 12)))) for k in range(300)]
    out = list(chunks.pack(cues, 60, overlap=False))
    assert all(len(t) <= 60 or t in {c[2] for c in cues} for t, _, _ in out)
    assert " ".join(t for t, _, _ in out) == " ".join(c[2] for c in cues)
    assert all(a <= b for _, a, b in out) and [a for _, a, _ in out] == sorted(a for _, a, _ in out)


def test_pack_chunks_counts_code_points(spark):
    cues = spark.createDataFrame([("j", k, float(k), k + 1.0, "é" * 5) for k in range(4)] + [("e", 0, 0.0, 1.0, " ")], "job_id string, cue_no int, start double, end double, text string")
    got = chunks.pack_chunks(cues, 11).orderBy("chunk_no").collect()
    assert [(r.job_id, r.text, r.time_from, r.time_to) for r in got] == [("j", "ééééé ééééé", 0.0, 2.0), ("j", "ééééé ééééé", 2.0, 4.0)]
    with pytest.raises(ValueError):
        chunks.pack_chunks(cues, 0)


# --- validation

GOOD = {"doc_chunk_id": "6ba7b811-9dad-11d1-80b4-00c04fd430c8", "text": "t", "user_id": "6ba7b8119dad11d180b400c04fd430c8", "source": "s", "title": "t", "lang": "en", "created_at": "2025-01-02T03:04:05Z", "source_url": "u", "source_id": "7"}


@pytest.mark.parametrize(
    ("change", "reason"),
    [({}, None), ({"text": " "}, "missing_text"), ({"lang": None}, "missing_lang"), ({"text": "x" * 500}, None), ({"text": "x" * 501}, "text_too_long"), ({"created_at": "no"}, "bad_created_at"), ({"source_id": "1.5"}, None), ({"source_id": "NaN"}, "bad_source_id"), ({"source_id": "x"}, "bad_source_id"),
     ({"user_id": "1"}, "bad_user_id"), ({"doc_chunk_id": "1"}, "bad_doc_chunk_id"), ({"video_timestamp": {"time_from": 1, "time_to": "2.5"}}, None), ({"video_timestamp": {"time_from": 3, "time_to": 2}}, "bad_video_timestamp"), ({"video_timestamp": {"time_from": -1, "time_to": 2}}, "bad_video_timestamp"),
     ({"video_timestamp": {"time_from": "NaN", "time_to": 2}}, "bad_video_timestamp"), ({"video_timestamp": {"time_to": 2}}, "bad_video_timestamp"), ({"video_timestamp": 5}, None), ({"title": 12}, None)],
)
def test_reasons(spark, change, reason):
    import json

    df = messages.parse_messages(spark.createDataFrame([(json.dumps(GOOD | change),)], "value string"))
    assert validate.validate_messages(df).first().reason == reason


def test_bad_json_and_strict(spark):
    import json

    lines = spark.createDataFrame([("{broken",), ("17",), ("",), (json.dumps(GOOD),)], "value string")
    df = messages.parse_messages(lines)
    assert [r.reason for r in validate.validate_messages(df).collect()] == ["invalid_json"] * 3 + [None]
    assert validate.validate_messages(df.where("not bad_json"), strict=True).first().reason == "bad_source_id"
    assert validate.accepted(validate.validate_messages(df)).count() == 1 and validate.rejected(validate.validate_messages(df)).count() == 3


def test_requests_and_search_text(spark):
    df = spark.createDataFrame([("https://a.b/c", None), ("ftp://a", None), ("http://a", ["vtt", "xyz"]), (None, None), ("http://a", [])], "url string, preferred_sub_formats array<string>")
    assert [r.reason for r in validate.check_requests(df).collect()] == [None, "bad_url", "unknown_format", "bad_url", None]
    q = spark.createDataFrame([("a",), (" ",), (None,), ("x" * 11,)], "text string")
    assert [r.reason for r in validate.check_search_text(q, max_len=10).collect()] == [None, "empty_text", "empty_text", "text_too_long"]


# --- tracks

def test_choose_track(spark):
    t = spark.createDataFrame([("a", "de", 0, ["ttml"]), ("a", "pl-orig", 1, ["srt", "vtt"]), ("a", "en", 2, ["vtt"]), ("b", "fr", 0, ["srv1", "json3"]), ("b", "en", 1, ["json3"]), ("c", "fr", 0, ["srv1", "srt"])], "video_id string, lang string, lang_pos int, formats array<string>")
    got = {r.video_id: (r.lang, r.format) for r in tracks.choose_track(t).collect()}
    assert got == {"a": ("pl-orig", "vtt"), "b": ("en", "json3"), "c": ("fr", "srv1")}
    wish = spark.createDataFrame([("a", ["xx", "de"], ["srt"]), ("c", None, ["json3", "srt"]), ("d", None, None)], "video_id string, languages array<string>, preferred_sub_formats array<string>")
    got = {r.video_id: (r.lang, r.format, r.chain) for r in tracks.choose_track(t, wish).collect()}
    assert got == {"a": ("de", "ttml", "ttml/json3/srv3/vtt/srt/best"), "c": ("fr", "srt", "srt/json3/srv3/vtt/ttml/best"), "d": (None, None, None)}


def test_pick_file(spark):
    f = spark.createDataFrame([("a", "/a/en.en-orig.vtt"), ("a", "/a/aa.srt"), ("b", "/b/pl.srt"), ("b", "/b/en.vtt"), ("c", "/c/x.json3")], "job_id string, path string")
    langs = spark.createDataFrame([("a", "en-orig"), ("b", "pl")], "job_id string, lang string")
    assert {r.job_id: r.path for r in tracks.pick_caption_file(f, langs).collect()} == {"a": "/a/en.en-orig.vtt", "b": "/b/pl.srt", "c": "/c/x.json3"}


# --- audio

def frames(spark, **series):
    return spark.createDataFrame([(j, k, float(k), float(v)) for j, s in series.items() for k, v in enumerate(s)], "job_id string, frame_no int, t double, rms_db double")


def test_silences(spark):
    f = frames(spark, open=[9, 1, 1, 1], start=[1, 1, 9, 9], short=[9, 1, 9], two=[9, 1, 1, 9, 1, 1, 1, 9])
    got = audio.detect_silences(f.withColumns({"noise_db": F.lit(2.0), "min_d": F.lit(2.0)})).collect()
    assert {(r.job_id, r.start, r.end, r.mid) for r in got} == {("start", 0.0, 2.0, 1.0), ("two", 1.0, 3.0, 2.0), ("two", 4.0, 7.0, 5.5)}


def test_adaptive(spark):
    f = frames(spark, a=[9, 1, 1, 9], b=[9, 1, 9], c=[9, 9, 9])
    floors = spark.createDataFrame([("a", 8.0), ("b", 8.0), ("c", 8.0)], "job_id string, noise_db double")
    got = {(r.job_id, r["pass"], r.noise_db, r.start) for r in audio.detect_silences_adaptive(f, floors, 2.0, 0.0).collect()}
    assert got == {("a", 1, 8.0, 1.0), ("b", 2, 3.0, 1.0)}


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 100])
def test_noise_floor(spark, n):
    r = random.Random(n)
    values = [r.uniform(-60, 0) for _ in range(n)]
    got = audio.noise_floor(frames(spark, a=values), 5.0, -50.0, -20.0).first()
    p10 = sorted(values)[int(0.1 * (n - 1))]
    assert got.p10 == p10 and got.noise_db == min(-20.0, max(-50.0, p10 - 5.0))


@pytest.mark.parametrize("kind", ["spread", "near", "equal", "few"])
def test_noise_floor_in_passes(spark, kind):
    """One job with nearly all frames, counted in passes of few buckets, on values of all kinds."""
    r = np.random.default_rng(3)
    values = {"spread": r.normal(-30, 9, 5000), "near": 1e-9 * r.normal(size=5000) + np.where(r.random(5000) < 0.5, -40, 5), "equal": np.full(5000, -7.0), "few": r.choice([-np.inf, -50.0, -20.0, np.inf], 5000, p=[0.09, 0.3, 0.6, 0.01])}[kind]
    rows = [("a", float(v)) for v in values] + [("a", None), ("a", float("nan")), ("b", -3.0), ("c", None)]
    df = spark.createDataFrame(rows, "job_id string, rms_db double").repartition(4)
    got = {x.job_id: (x.p10, x.noise_db) for x in audio.noise_floor(df, 5.0, -50.0, -20.0, buckets=8, rows=20).collect()}
    p10 = float(np.sort(values)[int(0.1 * 4999)])
    assert got == {"a": (p10, min(-20.0, max(-50.0, p10 - 5.0))), "b": (-3.0, -20.0), "c": (None, None)}


def test_silences_of_one_long_recording(spark):
    """A million frames of one job lie in even ranges; silences that cross many borders, or fill whole ranges, are found."""
    from captionloom.operators.stored import ranged

    n = 1_000_000
    quiet = lambda k: (k % 1000 < 300) | ((k > 120_000) & (k < 700_000)) | (k > n - 50)
    k = F.col("id")
    df = spark.range(n).select(F.lit("a").alias("job_id"), k.alias("frame_no"), k.cast("double").alias("t"), F.when(quiet(k), 0.0).otherwise(F.when(k == 900_100, None).otherwise(9.0)).alias("rms_db"), F.lit(1.0).alias("noise_db"), F.lit(250.0).alias("min_d"))
    sizes = [r["count"] for r in ranged(df, "job_id", "frame_no").groupBy("range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.4 * n
    got = sorted((r.start, r.end) for r in audio.detect_silences(df).collect())
    q = quiet(np.arange(n))
    edge = np.flatnonzero(np.diff(q.astype(int), prepend=0))
    want = [(float(a), float(b)) for a, b in zip(edge[::2], edge[1::2]) if b - a >= 250]
    assert got == want and (120_000.0, 700_300.0) in want


def test_nearest_like_brute_force(spark):
    r = random.Random(2)
    pts = [("a", float(r.randint(0, 60))) for _ in range(12)] + [("b", 5.0)]
    asks = [("a", float(t)) for t in range(0, 60, 3)] + [("b", 5.0), ("c", 1.0)]
    got = {(x.job_id, x.target): x.point for x in audio.nearest(spark.createDataFrame(asks, "job_id string, target double"), spark.createDataFrame(pts, "job_id string, mid double"), 4.0).collect()}
    for j, t in asks:
        own = sorted((abs(p - t), p) for k, p in pts if k == j)
        assert got[j, t] == (own[0][1] if own and own[0][0] <= 4.0 else None)


def test_plan(spark):
    d = spark.createDataFrame([("snap", 35.0), ("none", 35.0), ("short", 4.0), ("tail", 22.0)], "job_id string, duration double")
    s = spark.createDataFrame([("snap", 9.0), ("snap", 11.0), ("snap", 21.0), ("tail", 20.5), ("tail", 10.0)], "job_id string, mid double")
    plans = {r.job_id: r for r in audio.plan_segments(d, s, 10.0, 2.0, 3.0, 2.0, 0.5).collect()}
    assert plans["snap"].cuts == [0.0, 9.0, 21.0, 35.0] and [tuple(x) for x in plans["snap"].segments] == [(0.5, 8.5), (9.5, 20.5), (21.5, 34.5)]
    assert plans["none"].method == "uniform-fallback" and [tuple(x) for x in plans["none"].segments] == [(0.5, 9.5), (10.5, 19.5), (20.5, 29.5), (30.5, 34.5)]
    assert plans["short"].cuts == [0.0, 4.0] and plans["tail"].cuts == [0.0, 10.0, 20.5]
    assert audio.segment_rows(audio.plan_segments(d, s, 10.0, 2.0, 3.0, 2.0, 0.5)).count() == 3 + 4 + 1 + 2


# --- transcripts

def test_transcripts(spark):
    seg = spark.createDataFrame([("j", 0), ("j", 1), ("j", 2)], "job_id string, seg_no int")

    def fake(r):
        if r["seg_no"] == 1:
            raise RuntimeError("no sound")
        return [{"start": 0.5, "end": 1.9996, "text": f"part {r['seg_no']}"}], "en" if r["seg_no"] else "pl"

    parts = transcripts.transcribe(seg, fake).cache()
    assert {r.idx: r.error for r in parts.collect()} == {0: None, 1: "RuntimeError: no sound", 2: None}
    cues = transcripts.merge_transcripts(parts, spark.createDataFrame([("j", 0, 3.0)], "job_id string, idx int, offset double"), 30.0)
    assert [(r.cue_no, r.start, round(r.end, 4), r.text) for r in cues.orderBy("cue_no").collect()] == [(0, 3.5, 4.9996, "part 0"), (1, 60.5, 61.9996, "part 2")]
    assert transcripts.majority_language(parts).first().lang == "pl"
    srt = transcripts.render_srt(cues).first().value
    assert srt == "1\n00:00:03,500 --> 00:00:05,000\npart 0\n\n2\n00:01:00,500 --> 00:01:02,000\npart 2\n"
    from captionloom.sources.captions import parse_captions

    back = parse_captions(spark.createDataFrame([("j", "/j/a.srt", "srt", srt)], "job_id string, path string, ext string, content string"))
    assert [(r.start, r.end, r.text) for r in back.orderBy("cue_no").collect()] == [(3.5, 5.0, "part 0"), (60.5, 62.0, "part 2")]
    assert transcripts.render_vtt(cues).first().value.startswith("WEBVTT\n\n00:00:03.500 --> ")


# --- vectors and points

def test_embed(spark):
    df = spark.createDataFrame([(k, "bad" if k == 5 else f" word{k} word ") for k in range(10)] + [(10, None)], "id int, text string").coalesce(1)

    def make():
        inner = vectors.hashed_words(8)()

        def encode(texts):
            if "bad" in texts:
                raise ValueError("bad text")
            return inner(texts)

        return encode

    rows = vectors.embed(df, make_encoder=make, dim=8, batch=4).collect()
    assert [r.id for r in rows] == list(range(11))
    assert [r.vector is None for r in rows] == [r.id == 5 for r in rows] and rows[5].embed_error == "ValueError: bad text"
    assert all(abs(np.linalg.norm(r.vector) - 1) < 1e-6 for r in rows if r.vector and r.id != 10)
    again = vectors.embed(df, make_encoder=make, dim=8, batch=4).collect()
    assert rows == again


def test_embedding_batches_by_length(spark):
    """A bad text in a thousand is one reject; batches of like length pad less, none passes its budget, order stays."""
    r = np.random.default_rng(1)
    sizes = r.integers(1, 2000, 1000)
    df = spark.createDataFrame([(k, ("bad " if k == 637 else "") + "w" * int(n)) for k, n in enumerate(sizes)], "id int, text string").coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    def make():
        def encode(texts):
            calls.add(1)
            assert len(texts) <= 64 and (len(texts) == 1 or len(texts) * max(map(len, texts)) <= 20_000)
            if any(t.startswith("bad") for t in texts):
                raise ValueError("bad text")
            return np.array([[len(t), 1.0] for t in texts])

        return encode

    rows = vectors.embed(df, make_encoder=make, dim=2, batch=64, chars=20_000).collect()
    assert [x.id for x in rows] == list(range(1000)) and [x.id for x in rows if x.vector is None] == [637] and rows[637].embed_error == "ValueError: bad text"
    assert all(abs(x.vector[0] / x.vector[1] - sizes[x.id]) < 1 for x in rows if x.vector)
    batches = list(vectors.length_batches(sizes, 64, 20_000))
    assert sorted(np.concatenate(batches).tolist()) == list(range(1000)) and calls.value <= len(batches) + 2 * 7
    padded = sum(len(b) * sizes[b].max() for b in batches)
    plain = sum(64 * sizes[k : k + 64].max() for k in range(0, 1000, 64))
    assert padded < 1.03 * sizes.sum() < 0.6 * plain
    wrong = vectors.embed(df.limit(5), make_encoder=make, dim=3).collect()
    assert {x.embed_error for x in wrong} == {"ValueError: vectors of 2 numbers, not 3"}


def test_search(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 5)).round(1)
    pts = spark.createDataFrame([(k, v.tolist(), ("s" + str(k % 3),)) for k, v in enumerate(x)] + [(300, x[7].tolist(), ("s1",))], "id int, vector array<double>, payload struct<source:string>").repartition(7)
    q = spark.createDataFrame([(k, x[k].tolist()) for k in range(6)] + [(7, x[7].tolist())], "query_id int, vector array<double>")
    for metric in ("cosine", "dot"):
        a = np.vstack([x, x[7:8]])
        unit = a / np.linalg.norm(a, axis=1, keepdims=True) if metric == "cosine" else a
        got = {}
        for h in vectors.search_topk(pts, q, 5, metric=metric).orderBy("query_id", "rank").collect():
            got.setdefault(h.query_id, []).append(h.id)
        for k in got:
            assert got[k] == sorted(range(301), key=lambda i: (-round(float(unit[i] @ unit[k]), 12), i))[:5]
    assert vectors.search_topk(pts, q, 5, score_threshold=2.0).count() == 0
    assert vectors.search_topk(pts, q, 1000).count() == 7 * 301
    assert {h.id % 3 for h in vectors.search_topk(pts, q, 5, where=vectors.payload_filter(source="s2")).collect()} == {2}
    with pytest.raises(ValueError):
        vectors.search_topk(pts, q, metric="euclid")


def test_search_in_blocks(spark, monkeypatch):
    """More queries than a block holds, more points than are scored at a time, and many equal vectors."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 40)
    monkeypatch.setattr(vectors, "POINT_BLOCK", 70)
    monkeypatch.setattr(vectors, "SCORES", 500)
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 9))
    x[r.choice(300, 90, replace=False)] = x[7]
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3).cache()
    q = pts.where("id % 2 = 0").select(F.col("id").alias("query_id"), "vector")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: sorted(range(300), key=lambda j: (-round(float(unit[i] @ unit[j]), 12), j))[:5] for i in range(0, 300, 2)}
    got = {}
    for h in vectors.search_topk(pts, q, 5).orderBy("query_id", "rank").collect():
        got.setdefault(h.query_id, []).append(h.id)
    assert got == want
    assert vectors.search_topk(pts, q.limit(40), 5).count() == 200 and vectors.search_topk(pts, q.where("false"), 5).count() == 0


def test_search_of_many_queries(spark, tmp_path):
    """The plan holds one scan of the points, however many queries there are, and nothing passes the driver."""
    r = np.random.default_rng(9)
    x, q = r.normal(size=(3000, 8)).astype(np.float32), r.normal(size=(100_000, 8)).astype(np.float32)
    for name, a in (("points", x), ("queries", q)):
        pa.parquet.write_table(pa.table({"id": np.arange(len(a)), "vector": list(a)}), str(tmp_path / f"{name}.parquet"))
    pts, asked = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("points", "queries"))
    asked = asked.withColumnRenamed("id", "query_id")
    hits = vectors.search_topk(pts, asked, 3, metric="dot", where=F.col("id") >= 10)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = vectors.search_topk(pts, asked.where("query_id < 5"), 3, metric="dot", where=F.col("id") >= 10)
    assert plan(hits).count("FileScan") == plan(few).count("FileScan") == 2 and plan(hits).count("Exchange") == plan(few).count("Exchange") and "Broadcast" not in plan(hits)
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(id,10\)", plan(hits))
    got = hits.toPandas().sort_values(["query_id", "rank"])
    assert len(got) == 300_000 and got["query_id"].nunique() == 100_000
    scores = q.astype(float) @ x[10:].astype(float).T
    best = np.argpartition(-scores, 3, axis=1)[:, :3]
    order = np.take_along_axis(best, np.argsort(-np.take_along_axis(scores, best, 1), axis=1), 1)
    assert np.array_equal(got["id"].to_numpy().reshape(-1, 3), order + 10)


def test_payload_filter(spark):
    df = spark.createDataFrame([("Big Title, here", "2025-01-02 00:00:00")], "title string, at string").select(F.struct("title", F.col("at").cast("timestamp").alias("created_at")).alias("payload"))
    import datetime

    assert df.where(vectors.payload_filter(title_word="title", created_from=datetime.datetime(2025, 1, 1), created_to=datetime.datetime(2025, 1, 3))).count() == 1
    assert df.where(vectors.payload_filter(title_word="titl")).count() == 0 and df.where(vectors.payload_filter(created_from=datetime.datetime(2025, 1, 3))).count() == 0


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "points")
    batch = lambda *rows: spark.createDataFrame(rows, "id string, v int, order int")
    table = lambda: {r.id: r.v for r in points.read_points(spark, path).collect()}
    points.upsert_points(batch(("a", 1, 1), ("a", 2, 2), ("b", 1, 1)), path)
    assert table() == {"a": 2, "b": 1}
    for _ in range(2):
        points.upsert_points(batch(("b", 5, 9), ("b", 4, 8), ("c", 7, 1)), path)
        assert table() == {"a": 2, "b": 5, "c": 7}
    points.upsert_points(batch().where("false") if False else spark.createDataFrame([], "id string, v int, order int"), path)
    assert table() == {"a": 2, "b": 5, "c": 7}


def test_items(spark):
    schema = "id string, vector array<float>, payload struct<doc_chunk_id:string>"
    df = spark.createDataFrame([("i", [1.0, 2.0], ("c",)), ("i", [], ("",)), (None, None, None), ("", [1.0], (None,))], schema)
    got = [(r.point_id, r.reason) for r in validate.check_items(df, 2).collect()]
    assert got == [("c", None), ("i", "no_vector"), ("", "no_vector"), ("", "wrong_dimension")]
    named = vectors.build_points(validate.check_items(df, 2), "text").first()
    assert named.id == "c" and named.vector == {"text": [1.0, 2.0]}


# --- jobs

def test_job_reports(spark):
    ev = [(1, "a", "state", '{"state":"running","detail":"x"}'), (2, "a", "state", '{"state":"done"}'), (3, "b", "state", '{"error":"boom"}'), (4, "z", "state", '{"state":"done"}'), (5, "a", "artifact", '{"key":"k","value":"1"}'), (6, "a", "artifact", '{"key":"k","value":"2"}'), (7, "a", "progress", '{"received":1,"total":3}'), (8, "a", "progress", '{"received":2,"total":3}')]
    df = spark.createDataFrame(ev, "event_id long, job_id string, type string, data string").withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string")
    assert {r.job_id: (r.state, r.detail, r.error) for r in jobs.job_status(df, known).collect()} == {"a": ("done", "x", None), "b": ("error", None, "boom"), "c": ("queued", None, None)}
    assert [tuple(r) for r in jobs.job_progress(df).collect()] == [("a", 2, 3)]
    assert jobs.artifacts(df).first().artifacts == {"k": ["1", "2"]}
    assert [r.type for r in jobs.job_events(df, "a").collect()] == ["state", "state", "state", "artifact", "artifact", "progress", "progress"]
    rates = jobs.rate(df, 4, F.col("type") == "state").orderBy("start").collect()
    assert [(r.processed, r.failed, r.per_second) for r in rates] == [(3, 3, 0.75), (4, 1, 1.0), (1, 0, 0.25)]


def test_metadata_round_trip(spark, tmp_path):
    msgs = spark.createDataFrame([("a", None), ("a", "text_too_long"), ("b", None)], "job_id string, reason string")
    recs = spark.createDataFrame([("a", "captions", "en-orig", "en.vtt", "en", None), ("b", "whisper", None, None, "pl", "b.srt")], "job_id string, method string, selected_lang string, captions_file string, lang string, srt_file string")
    base = spark.createDataFrame([("a", "v1", "T", "u"), ("b", "v2", None, "u")], "job_id string, video_id string, video_title string, source_url string")
    stage = "stages struct<captions:struct<success:boolean,seconds:double,selected:struct<lang:string,format:string,chain:string>>,whisper:struct<success:boolean,seconds:double,stats:map<string,string>,lang:string>>"
    stages = spark.createDataFrame([("a", ((True, 1.5, ("en", "vtt", "vtt/x")), None), 2.0, None), ("b", (None, None), 3.0, "boom")], f"job_id string, {stage}, total_seconds double, error string")
    made = jobs.job_metadata(base, jobs.text_stats(msgs, recs, "embed", 500), stages)
    out = str(tmp_path / "meta")
    messages.write_job_metadata(made, out)
    from captionloom.functions.schemas import JOB_METADATA

    back = {r.job_id: r for r in spark.read.schema(JOB_METADATA).json(out).collect()}
    assert back["a"].success and back["a"].text_processing.chunks == 2 and back["a"].text_processing.enqueued == 1 and back["a"].text_processing.errors == ["text_too_long"]
    assert not back["b"].success and back["b"].error == "boom" and back["b"].text_processing is None
    assert {r.method: r.jobs for r in jobs.run_summary(spark.read.schema(JOB_METADATA).json(out)).collect()} == {"captions": 1, "none": 1}
    (tmp_path / "runs" / "a").mkdir(parents=True)
    (tmp_path / "runs" / "a" / "x.meta.json").write_text('{\n "job_id": "a",\n "success": true,\n "stages": {"whisper": null},\n "text_processing": {"chunks": 21}\n}')
    read = messages.read_job_metadata(spark, str(tmp_path / "runs")).collect()
    assert [(r.job_id, r.success, r.text_processing.chunks, r.stages.whisper) for r in read] == [("a", True, 21, None)]


def test_message_files(spark, tmp_path):
    df = spark.createDataFrame([("żółć", 1), ("b", 2)], "text string, n int")
    assert messages.write_chunk_messages(df, str(tmp_path / "m")) == 2
    assert {r.value for r in spark.read.text(str(tmp_path / "m")).collect()} == {'{"text":"żółć","n":1}', '{"text":"b","n":2}'}


def test_buckets_split_as_the_table_grows(spark, tmp_path):
    """From ten rows to many: even buckets, plain last-write-wins, one evaluation a batch, untouched buckets left alone."""
    path = str(tmp_path / "points")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    want = {}
    for k, (first, n) in enumerate(((0, 10), (5, 200_000), (150_000, 300_000), (499_000, 2_000))):
        seen.value = 0
        rows = spark.range(first, first + n).select(F.concat(F.lit("p"), "id").alias("id"), F.lit(k).alias("v"), F.lit(1).alias("order"))
        points.upsert_points(rows.mapInPandas(counted, rows.schema), path, bucket_rows=10_000)
        assert seen.value == n
        want |= dict.fromkeys(range(first, first + n), k)
        live = points.live_buckets(spark, path)
        sizes = [b[3] for b in live]
        assert sum(sizes) == len(want) and max(sizes) <= 10_000 and (k == 0 or min(sizes) > 2_500)
    got = points.read_points(spark, path).select(F.substring("id", 2, 9).cast("long").alias("id"), "v").toPandas()
    assert dict(zip(got["id"], got["v"])) == want and len(got) == len(want)
    points.upsert_points(spark.createDataFrame([("p7", 9, 1)], "id string, v int, order int"), path, bucket_rows=10_000)
    after = points.live_buckets(spark, path)
    assert len(set(after) - set(live)) == 1 and len(set(live) & set(after)) == len(live) - 1
    assert points.heads(spark, path) == [3, 4]
    folders = {(int(p.parent.parent.name[6:]), int(p.parent.name[6:]), int(p.name[7:])) for p in (tmp_path / "points" / "points").glob("batch=*/depth=*/bucket=*")}
    assert folders == {b[:3] for b in live + after}  # what only older heads held is gone


def test_replays_split_nothing_and_a_crash_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "points")
    rows = spark.range(900).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("v"), F.lit(1).alias("order"))
    for _ in range(4):  # full buckets whose rows are all replaced stay as many
        points.upsert_points(rows, path, bucket_rows=250)
    live = points.live_buckets(spark, path)
    assert sum(b[3] for b in live) == 900 and len(live) <= 8
    newer = rows.withColumn("v", F.lit(5))
    real = points._read
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(points, "_read", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        points.upsert_points(newer, path, bucket_rows=250)
    assert points._read is real and points.read_points(spark, path).where("v = 5").count() == 0
    points.upsert_points(newer.limit(10), path, bucket_rows=250)
    assert points.read_points(spark, path).where("v = 5").count() == 10 and points.read_points(spark, path).count() == 900
    with pytest.raises(ValueError):
        points.upsert_points(rows, path, bucket_rows=0)
    with pytest.raises(ValueError):
        points.read_points(spark, str(tmp_path / "none"))


def test_few_splits_are_spread(spark, tmp_path):
    from captionloom.plans import derived

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    one = spark.read.parquet(str(tmp_path / "one"))
    assert derived.spread(one).rdd.getNumPartitions() == cores and sorted(r.id for r in derived.spread(one).collect()) == list(range(100))
    many = one.repartition(cores + 3)
    assert derived.spread(many) is many


def test_written_subtitles(spark, tmp_path):
    cues = spark.createDataFrame([("a", 0, 1.0, 2.0, "x"), ("a", 1, 3.0, 4.5, "y"), ("b", 0, 0.0, 1.0, "z")], "job_id string, cue_no int, start double, end double, text string")
    transcripts.write_subtitles(transcripts.render_srt(cues), str(tmp_path / "s"))
    held = {p.parent.name: p.read_text() for p in (tmp_path / "s").glob("*/*.txt")}
    assert held == {"job_id=a": "1\n00:00:01,000 --> 00:00:02,000\nx\n\n2\n00:00:03,000 --> 00:00:04,500\ny\n\n", "job_id=b": "1\n00:00:00,000 --> 00:00:01,000\nz\n\n"}


def test_callers_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b", "k", "v"), (2, "a b", "k", "w")], "n int, text string, _prepared string, `_before.x` string")
    assert vectors.embed(df, dim=8).columns == [*df.columns, "vector", "embed_error"] and {r["_prepared"] for r in vectors.embed(df, dim=8).collect()} == {"k"}
    kept = chunks.drop_adjacent_duplicates(df, ["_prepared"], "n")
    assert kept.columns == df.columns and [r.n for r in kept.collect()] == [1]


def test_nearest_of_many_targets_of_one_job(spark):
    targets = spark.range(100_000).select(F.lit("j").alias("job_id"), F.col("id").cast("double").alias("target"))
    silences = spark.range(0, 100_000, 10).select(F.lit("j").alias("job_id"), (F.col("id") + 4.0).alias("mid"))
    got = audio.nearest(targets, silences, 4.5).where("point IS NOT NULL").agg(F.count("*").alias("n"), F.max(F.abs(F.col("point") - F.col("target"))).alias("d")).first()
    assert (got.n, got.d) == (90_000, 4.0)
