"""Column functions over caption text and times."""

from __future__ import annotations

import html
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CLOCK = r"^([0-9]{2}):([0-9]{2}):([0-9]{2})[.,]([0-9]{3})$"
#: Formats tried behind the wanted one, best first.
FALLBACK_FORMATS = ("json3", "srv3", "vtt", "ttml", "srt", "best")


def _parts(c: Column, pattern: str) -> Column:
    whole = [F.regexp_extract(c, pattern, k).cast("double") for k in (1, 2, 3)]
    return whole[0] * 3600 + whole[1] * 60 + whole[2]


def timecode_to_seconds(c: Column) -> Column:
    """HH:MM:SS.mmm or HH:MM:SS,mmm as seconds, white space around it allowed; anything else, null included, is 0."""
    t = strip(c)
    seconds = _parts(t, CLOCK) + F.regexp_extract(t, CLOCK, 4).cast("double") / 1000
    return F.when(t.rlike(CLOCK), seconds).otherwise(F.lit(0.0))


def any_time_to_seconds(c: Column) -> Column:
    """'12.3s', '12.3' or '12' as seconds, without sign or exponent, else timecode_to_seconds(); empty and null are 0."""
    t = strip(c)
    return F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?s?$"), F.regexp_replace(t, "s$", "").cast("double")).otherwise(timecode_to_seconds(t))


def format_timecode(seconds: Column, comma: bool = False) -> Column:
    """HH:MM:SS.mmm (or with a comma); milliseconds are rounded first, so 0.9996 is a whole second. Negative counts as 0."""
    ms = F.greatest(F.lit(0), F.round(seconds * 1000)).cast("long")
    shape = "%02d:%02d:%02d" + ("," if comma else ".") + "%03d"
    return F.format_string(shape, F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends; trim() takes off spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


prepare_text = strip


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def collapse_ws(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def _unescape(texts: pd.Series) -> pd.Series:
    hit = texts.str.contains("&", regex=False, na=False)
    return texts.where(~hit, texts[hit].map(html.unescape).reindex(texts.index))


def unescape_html(c: Column) -> Column:
    """Named and numeric character references decoded; texts without '&' pass untouched."""
    return F.pandas_udf(_unescape, "string")(c)


def _gram(words: str, ascii_case: bool) -> str:
    # Words of a repeat are whole but for the first one's start and the last repeat's end, so nothing is tried twice.
    return rf"(?iU{'-u' if ascii_case else ''})\b(\S++{words})(?:\s++\1)+\b"


def collapse_repeats(c: Column, ascii_case: bool = False) -> Column:
    """Immediate repeats of three words, then two, then one become one; case doesn't count, the first spelling stays.

    ascii_case: only the case of A to Z doesn't count. One look for any repeat spares most texts the nine replacements.
    """
    out = c
    for more in (r"\s++\S++\s++\S++", r"\s++\S++", ""):
        for _ in range(3):
            out = F.regexp_replace(out, _gram(more, ascii_case), "$1")
    return F.when(c.rlike(_gram(r"(?:\s++\S++){0,2}", ascii_case)), out).otherwise(c)


def cleaned(c: Column, ascii_case: bool = False) -> Column:
    """normalize_text() behind its first two steps: tags, white space and repeats of text whose entities are decoded."""
    return collapse_repeats(collapse_ws(strip_tags(c)), ascii_case)


def normalize_text(c: Column, entities: bool = True) -> Column:
    """The whole clean-up of a caption line, in its fixed order. entities=False skips decoding, for text without '&'."""
    spaced = F.replace(c, F.lit("\\N"), F.lit(" "))
    return cleaned(unescape_html(spaced) if entities else spaced)


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(c, r"(?U)\s+"), "")


def remove_overlap(prev: Column, cur: Column, least: int = 3, most: int = 30) -> Column:
    """cur without the longest token prefix (least to most tokens, else two) that ends prev. Case counts."""

    def told(x: Column) -> Column:
        a, b = x["a"], x["b"]
        fits = F.least(F.size(a), F.size(b), F.lit(most))
        none = F.array().cast("array<int>")
        sizes = F.when(fits >= least, F.sequence(fits, F.lit(least), F.lit(-1))).otherwise(none)
        if least > 2:
            sizes = F.concat(sizes, F.when(fits >= 2, F.array(F.lit(2))).otherwise(none))
        hits = F.filter(sizes, lambda n: F.slice(a, -n, n) == F.slice(b, F.lit(1), n))
        k = F.coalesce(F.get(hits, F.lit(0)), F.lit(0))
        cut = F.array_join(F.slice(b, k + 1, F.greatest(F.size(b) - k, F.lit(0))), " ")
        # A prefix begins with cur's first token: where that is not near prev's end, nothing else is tried.
        near = F.array_contains(F.slice(a, -F.greatest(F.lit(1), F.least(F.size(a), F.lit(most))), F.lit(most)), F.get(b, F.lit(0)))
        return F.when(near & (k > 0), cut).otherwise(cur)

    # Both texts are cut into tokens once, as an array's element: an expression used again would be computed again.
    both = F.array(F.struct(tokens(F.coalesce(prev, F.lit(""))).alias("a"), tokens(cur).alias("b")))
    return F.when(prev.isNull() | cur.isNull(), cur).otherwise(F.get(F.transform(both, told), F.lit(0)))


def format_chain(fmt: Column, fallbacks: Iterable[str] = FALLBACK_FORMATS) -> Column:
    return F.array_join(F.array_distinct(F.concat(F.array(fmt), F.array(*[F.lit(f) for f in fallbacks]))), "/")


def parse_created_at(c: Column) -> Column:
    """ISO-8601 with or without zone ('Z' too) as a timestamp; null if it doesn't parse."""
    t = strip(c)
    return F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2}(:[0-9]{2})?)?)?$"), F.try_to_timestamp(t))


def to_jsonable(c: Column) -> Column:
    return F.to_json(c, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"})
