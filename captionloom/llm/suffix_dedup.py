"""Suffix-array dedup: bytes inside 200-byte strings that start elsewhere too, by blockwise difference-cover sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionloom.llm.common import SLICE, beside, cut, mix, per_salt, powers, prefix_hash, row_key, salt, salts_of, same_key, span_hash

LENGTH = 200
#: Bytes of the content-defined anchor that assigns suffixes to buckets.
GRAM = 24
#: Period of the difference cover and the cover: every difference modulo PERIOD is one of two members.
PERIOD = 64
COVER = sorted({*range(8), *range(8, PERIOD, 8)})
#: Suffixes sorted at a time.
BLOCK = 1 << 18
#: Distinct strings around one anchor from which on its suffixes are dealt out by context, STEP at a time, then singly.
HOT, STEP = 1024, 16
#: Bytes of segments that one bucket is to hold.
BUCKET_BYTES = 8 << 20


def pieces(texts: list, most: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (row, offset, bytes) of about `most` bytes; a longer text comes in pieces that share LENGTH-1 bytes."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for row, t in enumerate(texts):
        b = t.encode("utf-8", "replace") if isinstance(t, str) else b""
        for at in range(0, max(1, len(b) - LENGTH + 1), most):
            part = b[at : at + most + LENGTH - 1]
            if held and size + len(part) > most:
                yield held
                held, size = [], 0
            held.append((row, at, part))
            size += len(part)
    if held:
        yield held


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by running minima inside blocks of that width."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    full = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    blocks = full.reshape(-1, width)
    down = np.minimum.accumulate(blocks, axis=1).ravel()
    up = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(up[:n], down[width - 1 : width - 1 + n])


def anchored_runs(held: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    """Runs of neighbouring windows of LENGTH bytes with one anchor: the window's GRAM bytes of least hash.

    Equal windows have equal anchors at equal distances, so they meet under the anchor's hash. `whole` is the hash of
    all bytes that the run's windows cover: equal runs repeat each other window by window.
    """
    data = np.frombuffer(b"\n".join([*(b for _, _, b in held), b""]), np.uint8)
    sizes = np.array([len(b) for _, _, b in held])
    first = np.append(0, np.cumsum(sizes + 1)[:-1])
    empty = pd.DataFrame({"row": [], "start": [], "n": [], "anchor": [], "gram": [], "whole": []}, dtype="int64")
    if len(data) < LENGTH or (sizes < LENGTH).all():
        return empty
    sums = prefix_hash(data)
    _, down = powers(len(sums))
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(sums) - GRAM])
    order = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    best = (sliding_min(order, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(len(best) + LENGTH + 2, np.int8)
    long = sizes >= LENGTH
    edge[first[long]] += 1
    edge[first[long] + sizes[long] - LENGTH + 1] -= 1
    best[np.cumsum(edge)[: len(best)] == 0] = -1
    cuts = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
    n = np.diff(np.append(cuts, len(best)))
    real = best[cuts] >= 0
    cuts, n = cuts[real], n[real]
    at = best[cuts]
    piece = np.searchsorted(first, cuts, side="right") - 1
    rows, offsets = np.array([r for r, _, _ in held]), np.array([o for _, o, _ in held])
    whole = mix(span_hash(sums, cuts, cuts + n + LENGTH - 1) + n.astype(np.uint64))
    return pd.DataFrame({"row": rows[piece], "start": cuts - first[piece] + offsets[piece], "n": n, "anchor": at - cuts, "gram": gram[at].view(np.int64), "whole": whole.view(np.int64)})


RUN = "k_id long, k_text long, start long, n int, anchor int, gram long, whole long"


SEGMENT = "k_id long, k_text long, start long, n int, anchor int, gram long, many boolean, bytes binary"


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, keys = pdf["k_id"], pdf["k_text"]
        for held in pieces(pdf["text"].tolist(), SLICE):
            found = anchored_runs(held)
            at = found.pop("row").to_numpy()
            found.insert(0, "k_id", ids.to_numpy()[at])
            found.insert(1, "k_text", keys.to_numpy()[at])
            yield found


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(text, asked) in; the bytes of each asked run out."""
    for pdf in batches:
        for at in range(0, len(pdf), 200):
            part, rows = pdf.iloc[at : at + 200], []
            for k_id, k_text, text, asked in zip(part["k_id"], part["k_text"], part["text"], part["asked"], strict=True):
                b = text.encode("utf-8", "replace")
                rows += [(k_id, k_text, a["start"], a["n"], a["anchor"], a["gram"], a["many"], b[a["start"] : a["start"] + a["n"] + LENGTH - 1], a["hot"]) for a in asked]
            yield pd.DataFrame(rows, columns=["k_id", "k_text", "start", "n", "anchor", "gram", "many", "bytes", "hot"])


def words_at(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The n big-endian 8-byte words from each position: word order is byte order."""
    view = np.lib.stride_tricks.sliding_window_view(data, 8)
    return [np.ascontiguousarray(view[at + 8 * j]).view(">u8").ravel().astype(np.uint64) for j in range(n)]


def repeated_windows(segments: list[bytes], n: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """For all windows of all segments, in order: does the same LENGTH-byte string start at another window?

    One bucket of a blockwise suffix sort. Segments are laid out with their anchors at multiples of PERIOD. First the
    suffixes at cover positions are ranked by the bytes that a window can have from there on; then all suffixes are sorted
    by their first 8 bytes, the distance to the next cover position, and the rank there of what is left of the window. So
    equal windows, which are equally far from the cover, are neighbours whatever their period. Neighbours are compared
    byte by byte.
    """
    size = np.array([len(b) for b in segments])
    room = -(-(anchor + 1) // PERIOD) * PERIOD - anchor  # so that room + anchor is a multiple of PERIOD
    slot = -(-(room + size + LENGTH + 2 * PERIOD) // PERIOD) * PERIOD
    base = np.append(0, np.cumsum(slot)[:-1]) + room
    data = np.zeros(int(slot.sum()) + LENGTH + 2 * PERIOD, np.uint8)
    for b, s in zip(base.tolist(), segments, strict=True):
        data[b : b + len(s)] = np.frombuffer(s, np.uint8)
    at = np.repeat(base, n) + np.arange(int(n.sum())) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
    to_cover = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
    # Suffixes that share an anchor are equally far from it, so they meet the cover at the same offset, of 7 bytes at most.
    away = to_cover[at % PERIOD]
    meet = at + away
    sample = np.unique(meet)
    keys = words_at(data, sample, LENGTH // 8)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(sample), bool)
    for k in keys[:-1]:
        new[1:] |= k[order][1:] != k[order][:-1]
    place, last = np.searchsorted(sample, meet), keys[-1][order]
    rank = np.empty(len(at), np.int64)
    for d in np.unique(away).tolist():  # the window's last d bytes from there on are not its own
        left = last >> np.uint64(8 * d)
        ranks = np.empty(len(sample), np.int64)
        ranks[order] = np.cumsum(new | np.append(False, left[1:] != left[:-1]))
        rank[away == d] = ranks[place[away == d]]
    order = np.lexsort([rank, away, *words_at(data, at, 1)])
    same = np.ones(len(at) - 1, bool)
    for k in words_at(data, at, LENGTH // 8):
        same &= k[order][1:] == k[order][:-1]
    out = np.zeros(len(at), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def spans_of(hit: np.ndarray, n: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(segment, first byte, end) of each run of hits inside a segment, in document bytes."""
    ends = np.cumsum(n)
    begin = ends - n
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    up, down = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for a, b in zip(up.tolist(), down.tolist(), strict=True):
        k = int(np.searchsorted(ends, a, side="right"))
        while a < b:
            stop = min(b, int(ends[k]))
            yield k, int(start[k] + a - begin[k]), int(start[k] + stop - begin[k] + LENGTH - 1)
            a, k = stop, k + 1


SPAN = "k_id long, k_text long, first long, end long"


def _sort_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("gram", kind="stable")
    gram, n = pdf["gram"].to_numpy(), pdf["n"].to_numpy().astype(np.int64)
    edges = np.append(np.flatnonzero(np.append(True, gram[1:] != gram[:-1])), len(gram))
    total = np.append(0, np.cumsum(n))
    out, a = [], 0
    while a < len(edges) - 1:
        b = a + 1
        while b < len(edges) - 1 and total[edges[b + 1]] - total[edges[a]] <= BLOCK:
            b += 1
        part = pdf.iloc[edges[a] : edges[b]]
        m = n[edges[a] : edges[b]]
        hit = repeated_windows(part["bytes"].tolist(), m, part["anchor"].to_numpy().astype(np.int64))
        ids, keys, many = part["k_id"].to_numpy(), part["k_text"].to_numpy(), part["many"].to_numpy()
        out += [(ids[k], keys[k], s, e) for k, s, e in spans_of(hit, m, part["start"].to_numpy()) if not many[k]]
        a = b
    return pd.DataFrame(out, columns=["k_id", "k_text", "first", "end"])


def _split(step: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Runs around a hot anchor in; sub-runs of at most `step` windows out, aligned by their distance to the anchor.

    All windows of a sub-run hold its bytes from step-1 to LENGTH, so equal windows have equal cores: the anchor is
    replaced by a hash of anchor, distance and core, which spreads a hot anchor over as many buckets as it has contexts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                yield _sub_runs(pdf.iloc[at : at + 2000], step)

    return run


def _sub_runs(part: pd.DataFrame, width: int) -> pd.DataFrame:
    texts = part["bytes"].tolist()
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(b) for b in texts])
    base = np.append(0, np.cumsum(size)[:-1])
    sums = prefix_hash(data)
    n, anchor = part["n"].to_numpy().astype(np.int64), part["anchor"].to_numpy().astype(np.int64)
    low, high = -anchor // width, (n - 1 - anchor) // width  # window j stands at distance j - anchor
    count = high - low + 1
    row = np.repeat(np.arange(len(part)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]
    first = np.maximum(step * width + anchor[row], 0)
    end = np.minimum((step + 1) * width + anchor[row], n[row])
    block = base[row] + step * width + anchor[row]
    core = span_hash(sums, block + width - 1, block + LENGTH)
    whole = mix(span_hash(sums, base[row] + first, base[row] + end + LENGTH - 1) + (end - first).astype(np.uint64))
    held = part.iloc[row]
    gram = mix(mix(held["gram"].to_numpy().view(np.uint64) + step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + core)
    cut_bytes = [texts[r][f : e + LENGTH - 1] for r, f, e in zip(row.tolist(), first.tolist(), end.tolist(), strict=True)]
    return pd.DataFrame({"k_id": held["k_id"].to_numpy(), "k_text": held["k_text"].to_numpy(), "start": held["start"].to_numpy() + first, "n": end - first, "anchor": anchor[row] - first, "gram": gram.view(np.int64), "many": held["many"].to_numpy(), "bytes": cut_bytes, "whole": whole.view(np.int64)})


PLACE = ("k_id", "k_text", "start", "n", "anchor")
CLASS = ["gram", "whole"]


def _span(rows: DataFrame) -> DataFrame:
    return rows.select("k_id", "k_text", F.col("start").alias("first"), (F.col("start") + F.col("n") + LENGTH - 1).alias("end"))


def _kinds(classes: DataFrame, having: str) -> DataFrame:
    """Classes of runs (gram, whole, ...) with `kinds`, how many their anchor has, where the anchor fits `having`."""
    return beside(classes, ["gram"], ["whole"], having, kinds=F.count("*"), least=F.min("held")).drop("least")


def _classes(runs: DataFrame, *more: str) -> DataFrame:
    """Equal runs as one row (gram, whole, held, place of one of them, salts); a hot class is combined before the shuffle."""
    dealt = runs.withColumn("salt", salt("k_id", "k_text", "start"))
    many = [F.max("many").alias("many")] if "many" in runs.columns else []
    return cut(dealt.groupBy(*CLASS).agg(F.count("*").alias("held"), *many, *[F.first(c).alias(c) for c in (*PLACE, *more)], salts_of("salt").alias("salts")))


def _repeated(runs: DataFrame, classes: DataFrame) -> DataFrame:
    """Spans of the runs that are one of several equal ones: they repeat each other window by window."""
    dealt = runs.withColumn("salt", salt("k_id", "k_text", "start"))
    return _span(dealt.join(per_salt(classes.where("held > 1").select(*CLASS, "salts")), [*CLASS, "salt"]))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k_id, k_text, first, end): byte spans whose union is what LENGTH-byte strings that start twice or more cover.

    Overlaps count, strings never cross documents, and all are judged on the input; null texts have no bytes. Four steps,
    none of which holds a group of unbounded size: (1) runs of windows under content-defined anchors; an anchor that occurs
    once has no repeats, and equal runs repeat in full whatever their number; (2) what is left, one text per distinct run,
    is dealt by anchor to suffix buckets of about BUCKET_BYTES, as many as the bytes need, each of which is sorted by
    itself (`repeated_windows`); (3) anchors with more than HOT distinct runs are first split by context into sub-runs of
    STEP windows, and equal sub-runs are merged; (4) where even a sub-run has more than HOT contexts, its windows are told
    apart singly. Hashes are of 64 bits.
    """
    source = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    runs = cut(source.where(F.octet_length("text") >= LENGTH).mapInPandas(_runs, RUN))
    live = cut(beside(runs, ["gram"], ["k_id", "k_text", "start"], "n_runs > 1", n_runs=F.count("*")).drop("n_runs"))
    classes = _classes(live)
    # Anchors with several classes, one of which at least is no copy of another run: windows may still repeat across classes.
    asked = _kinds(classes, "kinds > 1 AND least = 1")
    asked = asked.select("k_id", "k_text", F.struct("start", "n", "anchor", "gram", (F.col("held") > 1).alias("many"), (F.col("kinds") > HOT).alias("hot")).alias("a"))
    asked = asked.groupBy("k_id", "k_text").agg(F.collect_list("a").alias("asked"))
    texts = source.join(asked, same_key(source, asked)).select(source["k_id"], source["k_text"], "text", "asked")
    segments = cut(texts.mapInPandas(_cut_out, f"{SEGMENT}, hot boolean"))
    parts = cut(segments.where("hot").mapInPandas(_split(STEP), f"{SEGMENT}, whole long"))
    merged = _classes(parts, "bytes")
    open_ = cut(_kinds(merged, "kinds > 1").withColumn("many", F.col("many") | (F.col("held") > 1)))
    single = cut(open_.where(F.col("kinds") > HOT).mapInPandas(_split(1), f"{SEGMENT}, whole long"))
    columns = [c.split()[0] for c in SEGMENT.split(", ")]
    cold = segments.where(~F.col("hot")).select(*columns).unionByName(open_.where(F.col("kinds") <= HOT).select(*columns))
    total = cold.agg(F.sum(F.octet_length("bytes").cast("long"))).first()[0] or 0
    buckets = total // BUCKET_BYTES + 1
    dealt = cold.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets))).repartition(buckets, "bucket")
    found = dealt.groupBy("bucket").applyInPandas(_sort_bucket, SPAN)
    not_many = ~F.col("many")
    return _repeated(live, classes).unionByName(_repeated(parts.where(not_many), merged)).unionByName(_repeated(single.where(not_many), _classes(single))).unionByName(found)


def union_of(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((s["first"], s["end"]) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def without_spans(text: str | None, spans: list | None) -> tuple[bytes, int, int, int]:
    """(remaining bytes, bytes before, bytes removed, maximal removed runs)."""
    b = text.encode("utf-8", "replace") if isinstance(text, str) else b""
    gone = union_of(spans) if spans is not None else []
    keep, at = [], 0
    for s, e in gone:
        keep.append(b[at:s])
        at = e
    keep.append(b[at:])
    left = b"".join(keep)
    return left, len(b), len(b) - len(left), len(gone)


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k_id, text, spans) for every row of docs: spans is null where nothing repeats."""
    source = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    found = repeated_spans(docs, id_col, text_col).groupBy("k_id", "k_text").agg(F.collect_set(F.struct("first", "end")).alias("spans"))  # sets are combined before the shuffle: repeats of a row add nothing
    return source.join(found, same_key(source, found), "left").select(source["k_id"], "text", "spans")


def _digest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, spans in batches:
        rows = [without_spans(t, s) for t, s in zip(texts, spans, strict=True)]
        yield pd.DataFrame([(n, gone, runs, hashlib.sha256(left).hexdigest()) for left, n, gone, runs in rows], columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; null and empty texts have no bytes and lose none."""
    digest = F.pandas_udf(_digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    out = cut_documents(docs.select("doc_id", "text"))
    return out.select(F.col("k_id").alias("doc_id"), digest("text", "spans").alias("d")).select("doc_id", "d.*")


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT r, 250 * k AS base, substr(x, 500 * k + 1, 898) AS y FROM (SELECT r, x, unnest(range(0, length(x) // 500 + 1)) AS k FROM d)),
w AS (SELECT r, base + p AS p, hash(substr(y, 2 * p + 1, 400)) AS h FROM (SELECT r, base, y, unnest(range(0, least(250, length(y) // 2 - 199))) AS p FROM c WHERE length(y) >= 400)),
again AS (SELECT r, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
marked AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 200 THEN 0 ELSE 1 END AS opens FROM again),
spans AS (SELECT r, min(p) AS a, max(p) + 200 AS b FROM (SELECT r, p, sum(opens) OVER (PARTITION BY r ORDER BY p) AS k FROM marked) GROUP BY r, k),
kept AS (SELECT s.r, sum(b - a) AS gone, count(*) AS n, string_agg(substr(x, 2 * start + 1, 2 * (a - start)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS left_
  FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS start FROM spans) s JOIN d ON d.r = s.r GROUP BY s.r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(left_, x))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
