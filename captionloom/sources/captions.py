"""Caption files and track listings as tables: one row a file in, one row a cue out. Nothing is shuffled."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionloom.functions.schemas import CUE_ARRAY
from captionloom.functions.text import cleaned, strip, timecode_to_seconds

EXTENSIONS = ("vtt", "srt", "ttml", "dfxp", "xml", "srv1", "srv2", "srv3", "json3", "ass", "ssa")
STAMP = r"[0-9]{2}:[0-9]{2}:[0-9]{2}"


def _any_case(ext: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


def read_caption_files(spark: SparkSession, path: str, exts: Iterable[str] = EXTENSIONS) -> DataFrame:
    """(job_id, path, ext, content) of the files with these extensions under path; job_id is the file's folder.

    Files of other extensions are not listed, so media beside captions are never read. Text is UTF-8; a byte-order mark and
    bytes that don't decode are dropped. Files of no bytes have no row.
    """
    glob = "*.{" + ",".join(_any_case(e) for e in exts) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    text = F.col("content").cast("string")
    decoded = F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("job_id"), "path", ext.alias("ext"), F.regexp_replace(decoded, r"^\x{FEFF}", "").alias("content"))


#: What ends a line: all that Python's splitlines() takes for one.
LINE_END = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"


def _lines(content: Column) -> Column:
    return F.split(content, LINE_END, -1)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, as an array's element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _timed_cues(content: Column, mark: str, blank: str, plain: Column | None, each: Callable[[Column], Column], repeats: bool) -> Column:
    """Cues of blocks of lines, in the row. A cue begins at a block's first timing line, which begins with its times and has
    spaces around its arrow, and goes to the next blank line; other lines that look like a timing line are its text.

    plain, if given, holds for each line what its text is read from. Only lines of cues are cleaned, each once.
    """
    timing = rf"^({STAMP}[{mark}][0-9]{{3}})\s+-->\s+({STAMP}[{mark}][0-9]{{3}})"

    def seen(line: Column, i: Column) -> Column:
        blank_line = strip(line) == "" if blank == "whitespace" else line == ""
        return F.struct(i.alias("i"), blank_line.alias("blank"), line.rlike(timing).alias("stamped"), line.alias("line"))

    def text_of(texts: Column, begin: Column, stop: Column) -> Column:
        kept = F.filter(F.transform(F.slice(texts, begin + 2, stop - begin - 1), each), lambda t: t != "")
        return F.array_join(_bound(kept, lambda t: F.filter(t, lambda x, i: (i == 0) | (x != F.get(t, i - 1)))) if repeats else kept, " ")

    def cues(lines: Column) -> Column:
        marks = _bound(F.filter(lines, lambda x: x["blank"] | x["stamped"]), lambda m: F.filter(m, lambda x, k: x["blank"] | (k == 0) | F.get(m, k - 1)["blank"]))
        texts = F.transform(lines, lambda x: x["line"])
        texts = F.coalesce(plain, texts) if plain is not None else texts

        def told(x: Column, place: Column, all_marks: Column) -> Column:
            stop = F.coalesce(F.get(all_marks, place + 1)["i"], F.size(lines))
            when = [timecode_to_seconds(F.regexp_extract(x["line"], timing, k)) for k in (1, 2)]
            return F.when(x["stamped"], F.struct(when[0].alias("start"), when[1].alias("end"), text_of(texts, x["i"], stop).alias("text")))

        return _bound(marks, lambda m: F.filter(F.transform(m, lambda x, place: told(x, place, m)), lambda c: c.isNotNull() & (c["text"] != "")))

    return _bound(F.transform(_lines(content), seen), cues)


def vtt_cues(content: Column, normalize: str = "line", blank: str = "whitespace", plain: Column | None = None, ascii_case: bool = False) -> Column:
    """WebVTT cues. normalize: clean each line (equal neighbours in a cue become one) or the whole cue. blank: what ends a cue.

    plain: the lines with '\\N' as a space and entities decoded, null where a file has none (see plain_lines()).
    ascii_case: see collapse_repeats().
    """
    spaced = lambda x: F.replace(x, F.lit("\\N"), F.lit(" ")) if plain is None else F.when(plain.isNull(), F.replace(x, F.lit("\\N"), F.lit(" "))).otherwise(x)
    if normalize == "line":
        return _timed_cues(content, ".,", blank, plain, lambda x: cleaned(spaced(x), ascii_case), True)
    cues = _timed_cues(content, ".,", blank, plain, strip, False)
    return F.filter(F.transform(cues, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), cleaned(spaced(c["text"]), ascii_case).alias("text"))), lambda c: c["text"] != "")


def srt_cues(content: Column) -> Column:
    """SRT cues: comma milliseconds only, lines trimmed and joined, text as it is."""
    return _timed_cues(content, ",", "whitespace", None, strip, False)


def json3_cues(content: Column) -> Column:
    """Cues of json3 events: an object with `events` or a bare list. Events without text or start are skipped; line breaks
    in a segment are spaces; a duration of 0 or none is that of dDuration, if there is one."""
    event = "struct<tStartMs:string,dDurationMs:string,dDuration:string,segs:array<struct<utf8:string>>>"
    listed = F.from_json(content, f"array<{event}>")
    events = F.when(strip(content).startswith("["), listed).otherwise(F.from_json(content, f"struct<events:array<{event}>>")["events"])
    number = lambda c: c.try_cast("double")

    def told(e: Column) -> Column:
        text = F.array_join(F.filter(F.transform(e["segs"], lambda s: strip(F.translate(F.coalesce(s["utf8"], F.lit("")), "\n", " "))), lambda t: t != ""), " ")
        begin = number(e["tStartMs"]) / 1000
        length = F.coalesce(F.nullif(number(e["dDurationMs"]), F.lit(0.0)), number(e["dDuration"]), F.lit(0.0))
        return F.struct(begin.alias("start"), (begin + length / 1000).alias("end"), F.coalesce(text, F.lit("")).alias("text"))

    return F.coalesce(F.filter(F.transform(events, told), lambda c: c["start"].isNotNull() & (c["text"] != "")), F.array().cast(CUE_ARRAY))


def ass_cues(content: Column) -> Column:
    """Cues of Dialogue lines: ten comma fields, the last keeps its commas; override blocks go, \\N is a space. A line
    whose times are no clock is skipped."""
    dialogue = F.filter(_lines(content), lambda x: strip(x).startswith("Dialogue:"))
    fields = F.transform(dialogue, lambda x: F.split(F.regexp_replace(strip(x), r"^Dialogue:\s*", ""), ",", 10))
    clock = r"^([0-9]+):([0-9]{2}):([0-9]{2})\.([0-9]{2})$"

    def seconds(t: Column) -> Column:
        g = [F.regexp_extract(strip(t), clock, k).cast("double") for k in range(1, 5)]
        return g[0] * 3600 + g[1] * 60 + g[2] + g[3] / 100

    def told(f: Column) -> Column:
        text = strip(F.replace(F.regexp_replace(strip(f[9]), r"\{[^}]*\}", ""), F.lit("\\N"), F.lit(" ")))
        return F.struct(seconds(f[1]).alias("start"), seconds(f[2]).alias("end"), text.alias("text"))

    whole = F.filter(fields, lambda f: (F.size(f) == 10) & strip(F.get(f, F.lit(1))).rlike(clock) & strip(F.get(f, F.lit(2))).rlike(clock))
    return F.filter(F.transform(whole, told), lambda c: c["text"] != "")


def _seconds(text: str) -> float:
    """any_time_to_seconds() of a time attribute."""
    t = text.strip()
    if re.fullmatch(r"[0-9]+(\.[0-9]+)?s?", t):
        return float(t.removesuffix("s"))
    m = re.fullmatch(r"(\d\d):(\d\d):(\d\d)[.,](\d\d\d)", t)
    return int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3]) + int(m[4]) / 1000 if m else 0.0


#: Fixed value: the namespace that time attributes may have.
TIME_SPACE = "{http://www.w3.org/ns/ttml#parameter}"


def xml_cues(content: str, kind: str) -> list[dict]:
    """Cues of one TTML ('ttml': elements whose name ends in p) or timed-text ('timed': in text) document; bad XML has none.

    Text keeps its inner white space, but for line breaks of timed text, whose entities are decoded once more.
    """
    try:
        root = ElementTree.fromstring(content.encode("utf-8", "replace"))
    except (ElementTree.ParseError, ValueError):
        return []
    out = []
    for node in root.iter():
        if not str(node.tag).endswith("p" if kind == "ttml" else "text"):
            continue
        text = "".join(node.itertext())
        if kind == "ttml":
            begin, end, length = (node.get(n) or node.get(TIME_SPACE + n) for n in ("begin", "end", "dur"))
            text, start = text.strip(), _seconds(begin or "0")
            stop = _seconds(end) if end else start + _seconds(length or "0")
        else:
            begin = node.get("start") or node.get("t")
            if begin is None:
                continue
            text, start = html.unescape(text.replace("\n", " ").strip()), _seconds(begin)
            stop = start + _seconds(node.get("dur") or node.get("d") or "0")
        if text:
            out.append({"start": start, "end": stop, "text": text})
    return out


def _xml_of(contents: pd.Series, kinds: pd.Series) -> pd.Series:
    return pd.Series([xml_cues(t, k) if isinstance(t, str) else None for t, k in zip(contents, kinds, strict=True)], dtype=object)


def _plain_of(contents: pd.Series) -> pd.Series:
    spaced = lambda x: html.unescape(x.replace("\\N", " ")) if "&" in x else x.replace("\\N", " ")
    return pd.Series([[spaced(x) for x in re.split(LINE_END, t)] if isinstance(t, str) else None for t in contents], dtype=object)


def plain_lines(content: Column) -> Column:
    """A file's lines with '\\N' as a space and entities decoded, line by line, so that what decodes to a line break or an
    arrow stays text. Null of null: files without entities need no Python."""
    return F.pandas_udf(_plain_of, "array<string>")(content)


KINDS = {"vtt": "vtt", "srt": "srt", "json3": "json3", "ass": "ass", "ssa": "ass", "ttml": "ttml", "dfxp": "ttml", "xml": "ttml", "srv1": "timed", "srv2": "timed", "srv3": "timed"}


def parse_captions(files: DataFrame, normalize: str = "line", blank: str = "whitespace", ascii_case: bool = False) -> DataFrame:
    """(job_id, path, cue_no, start, end, text) of a table of caption files (job_id, path, ext, content).

    The parser goes by extension; an unknown one is read as WebVTT, and as SRT if that gives no cues. Files are read once
    and parsed in their row; the Python helpers get null for files that don't need them. Files without cues give no rows;
    files_without_cues() lists them. normalize, blank and ascii_case are those of vtt_cues().
    """
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.lower("ext")], F.lit("unknown"))
    routed = files.select("job_id", "path", F.coalesce("content", F.lit("")).alias("content"), kind.alias("kind"))
    content, kind = F.col("content"), F.col("kind")
    helped = routed.withColumns({
        "plain": plain_lines(F.when(kind.isin("vtt", "unknown") & content.contains("&"), content)),
        "marked": F.pandas_udf(_xml_of, CUE_ARRAY)(F.when(kind.isin("ttml", "timed"), content), kind),
    })
    srt = srt_cues(content)
    vtt = _bound(vtt_cues(content, normalize, blank, F.col("plain"), ascii_case), lambda v: F.when((kind == "unknown") & (F.size(v) == 0), srt).otherwise(v))
    cues = F.when(kind.isin("vtt", "unknown"), vtt).when(kind == "srt", srt).when(kind == "json3", json3_cues(content)).when(kind == "ass", ass_cues(content)).otherwise(F.col("marked"))
    out = helped.select("job_id", "path", F.posexplode(cues).alias("cue_no", "cue"))
    return out.select("job_id", "path", F.col("cue_no").cast("int").alias("cue_no"), "cue.start", "cue.end", "cue.text")


def files_without_cues(files: DataFrame, cues: DataFrame) -> DataFrame:
    """Reject rows (job_id, path, reason) of the files that gave no cue."""
    return files.select("job_id", "path").join(cues.select("path").distinct(), "path", "left_anti").select("job_id", "path", F.lit("no cues").alias("reason"))


def parse_track_listing(listings: DataFrame) -> DataFrame:
    """(video_id, lang, lang_pos, formats) of listing texts (video_id, listing).

    Rows are `lang  name  fmt, fmt` with two spaces or more between fields, below a heading that names captions or
    subtitles. A language in several sections keeps its first place; its formats are merged in first-seen order.
    """
    heading, row = r"(?i)^.*available (automatic captions|subtitles).*$", r"^([A-Za-z0-9_-]+)\s{2,}(?:.*?\s{2,})?([a-z0-9]+(?:,\s*[a-z0-9]+)*)\s*$"
    lines = listings.select("video_id", F.posexplode(F.split("listing", r"\r?\n")).alias("pos", "line"))
    heads = lines.where(F.col("line").rlike(heading)).groupBy("video_id").agg(F.min("pos").alias("from"))
    rows = lines.join(heads, "video_id").where((F.col("pos") > F.col("from")) & F.col("line").rlike(row) & ~F.col("line").rlike(r"(?i)^language\s"))
    found = rows.select("video_id", "pos", F.regexp_extract("line", row, 1).alias("lang"), F.split(F.regexp_extract("line", row, 2), r",\s*").alias("formats"))
    merged = found.groupBy("video_id", "lang").agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "formats"))).alias("held"))
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("first")) - 1
    return merged.select("video_id", "lang", place.alias("lang_pos"), F.array_distinct(F.flatten(F.col("held.formats"))).alias("formats"))
