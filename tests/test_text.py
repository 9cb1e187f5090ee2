import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from captionloom.functions import ids, text
from captionloom.operators.chunks import trimmed_overlap


def apply(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_times(spark):
    assert apply(spark, ["01:02:03.004", "01:02:03,500", "1:02:03.004", "02:03.004", "x", "", None], text.timecode_to_seconds) == [3723.004, 3723.5, 0, 0, 0, 0, 0]
    assert apply(spark, ["12.3s", "12.3", "00:00:01.250", "", None, "abc"], text.any_time_to_seconds) == [12.3, 12.3, 1.25, 0, 0, 0]
    assert apply(spark, [0.9996, 3723.0045, 360000.0, -1.0], text.format_timecode, "double") == ["00:00:01.000", "01:02:03.005", "100:00:00.000", "00:00:00.000"]
    assert apply(spark, [1.5], lambda c: text.format_timecode(c, True), "double") == ["00:00:01,500"]


def test_normalize(spark):
    cases = {"a\\Nb": "a b", "&lt;b&gt;x&lt;/b&gt; &amp; y": "x & y", "a<i>b</i>c": "abc", " a\u00a0\u2003b ": "a b", "go go go": "go", "the cat The Cat sat": "the cat sat", "a b c a b c a b c d": "a b c d", "Żółw żółw idzie": "Żółw idzie", "haha": "haha"}
    assert apply(spark, list(cases), text.normalize_text) == list(cases.values())


def test_repeats_like_a_plain_loop(spark):
    r = random.Random(1)
    lines = [" ".join(r.choice(("ja", "Ja", "nie", "to", "ł")) for _ in range(r.randint(1, 14))) for _ in range(200)]

    def plain(t):
        for width in (3, 2, 1):
            gram = r"\S+" + r"\s+\S+" * (width - 1)
            for _ in range(3):
                t = re.sub(rf"\b({gram})(?:\s+\1)+\b", r"\1", t, flags=re.I)
        return t

    assert apply(spark, lines, text.collapse_repeats) == [plain(t) for t in lines]


@pytest.mark.parametrize(("prev", "cur", "want"), [("a b c", "a b c", ""), ("x a b c", "a b c d", "d"), ("x y", "x y z", "z"), ("a", "a b", "a b"), ("A b c", "a b c d", "a b c d"), (None, "a b", "a b"), (" ".join(map(str, range(31))), " ".join(map(str, range(31))) + " z", " ".join(map(str, range(31))) + " z"), (" ".join(map(str, range(30))), " ".join(map(str, range(30))) + " z", "z")])
def test_overlap(spark, prev, cur, want):
    df = spark.createDataFrame([(prev, cur)], "p string, c string")
    assert df.select(text.remove_overlap(F.col("p"), F.col("c"))).first()[0] == want == trimmed_overlap(prev, cur)


def test_ids(spark):
    names = ["https://a.example/x", "", "żółć"]
    assert apply(spark, names, ids.url_uuid) == [uuid.uuid5(uuid.NAMESPACE_URL, n).hex for n in names]
    good = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    assert apply(spark, [good, "{" + good + "}", "urn:uuid:" + good, good.replace("-", ""), "x", "", None, good[:-1]], ids.is_uuid) == [True] * 4 + [False] * 4
    df = spark.createDataFrame([("s", 1), ("s", 1), ("s", 2)], "s string, n int")
    a, b, c = (r.x for r in df.select(ids.chunk_id(F.col("s"), F.col("n")).alias("x")).collect())
    assert a == b != c and str(uuid.UUID(a)) == a


def test_small_ones(spark):
    assert apply(spark, ["vtt", "xyz"], text.format_chain) == ["vtt/json3/srv3/ttml/srt/best", "xyz/json3/srv3/vtt/ttml/srt/best"]
    assert [x is not None for x in apply(spark, ["2025-01-02T03:04:05Z", "2025-01-02T03:04:05.123+01:00", "2025-01-02", "yesterday", "", None], text.parse_created_at)] == [True, True, True, False, False, False]
    assert apply(spark, ["\u2003 a b \t"], text.prepare_text) == ["a b"]
    assert apply(spark, ["x"], lambda c: text.to_jsonable(F.struct(c.alias("a"), F.lit(None).cast("string").alias("b")))) == ['{"a":"x","b":null}']


def test_times_are_trimmed_and_strict(spark):
    df = spark.createDataFrame([(" 00:00:01.500 ",), ("-5",), ("1e3",), (".5",), ("5.",), ("nan",), ("7s",), ("7 s",), (" 2.25s\t",), ("00:00:01,5",), (None,)], "t string")
    got = df.select(text.timecode_to_seconds(F.col("t")).alias("a"), text.any_time_to_seconds(F.col("t")).alias("b")).collect()
    assert [r.a for r in got] == [1.5, *[0.0] * 10] and [r.b for r in got] == [1.5, 0.0, 0.0, 0.0, 0.0, 0.0, 7.0, 0.0, 2.25, 0.0, 0.0]
