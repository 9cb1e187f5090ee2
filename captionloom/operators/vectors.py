"""Embedding and exact vector search."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captionloom.functions import batches
from captionloom.functions.text import prepare_text
from captionloom.operators import grid

Encoder = Callable[[list[str]], np.ndarray]


def hashed_words(dim: int) -> Callable[[], Encoder]:
    """Factory of the default encoder: signed hashed bag of words, the same in every process. A real model takes its place."""

    def make() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for k, t in enumerate(texts):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    out[k, h % dim] += 1 if h >> 31 else -1
            return out

        return encode

    return make


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def letter_counts() -> Encoder:
    """An encoder that SQL can say: how often a text has each letter from a to z."""

    def encode(texts: list[str]) -> np.ndarray:
        return np.array([[t.count(chr(c)) for c in range(97, 123)] for t in texts], float).reshape(-1, 26)

    return encode


#: Characters of a batch, counted as its rows times its longest text: what a model pads them to.
PADDED_CHARS = 65_536


def length_batches(sizes: np.ndarray, most: int, chars: int) -> Iterator[np.ndarray]:
    """Row numbers in batches of rows of like length, the longest first: `most` rows and `chars` padded characters at most,
    or one row that is longer than that."""
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, min(most, int(chars // max(1, sizes[order[at]]))))
        yield order[at : at + n]
        at += n


def encoded(encode: Encoder, texts: list[str], dim: int) -> list[tuple[np.ndarray | None, str | None]]:
    """(vector, error) of each text. A batch that fails is halved until the texts that fail stand alone; one whose vectors
    have another size fails as a whole, since that is no text's fault."""
    try:
        x = np.asarray(encode(texts), float)
        if x.shape == (len(texts), dim):
            return [(v, None) for v in unit_rows(x).astype(np.float32)]
        if x.ndim == 2 and len(x) == len(texts):
            return [(None, f"ValueError: vectors of {x.shape[1]} numbers, not {dim}")] * len(texts)
        raise ValueError(f"vectors of shape {x.shape}, not {(len(texts), dim)}")
    except Exception as e:  # noqa: BLE001  the encoder is the caller's; its failure belongs to the text
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        half = len(texts) // 2
        return encoded(encode, texts[:half], dim) + encoded(encode, texts[half:], dim)


def embed(df: DataFrame, text_col: str = "text", make_encoder: Callable[[], Encoder] | None = None, dim: int = 64, batch: int = 256, chars: int = PADDED_CHARS) -> DataFrame:
    """df with `vector` (unit length, array<float>) and `embed_error`; row order inside partitions stays.

    The encoder is made once per task and called on batches of texts of like length, of `batch` rows and about `chars`
    characters with padding at most, out of some 2 MB of texts or one that is longer. A text that the encoder fails on has a null vector and the reason; the others of its
    batch go on. Null texts count as empty.
    """
    make = make_encoder or hashed_words(dim)
    plain = [f"c{k}" for k in range(len(df.columns))]  # so that no name of a column matters inside
    fields = [T.StructField(n, f.dataType) for n, f in zip(plain, df.schema.fields, strict=True)]
    schema = T.StructType([*fields, T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("embed_error", T.StringType())])

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for part in (p for b in given for p in batches.parts(b, "prepared", batches.TEXT)):
            texts = part.column("prepared").to_pylist()
            found: list = [(None, None)] * len(texts)
            for rows in length_batches(np.array([len(t) for t in texts], np.int64), batch, chars):
                for k, told in zip(rows, encoded(encode, [texts[k] for k in rows], dim), strict=True):
                    found[k] = told
            made = [pa.array([v for v, _ in found], pa.list_(pa.float32())), pa.array([e for _, e in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in plain), *made], [*plain, "vector", "embed_error"])

    held = df.toDF(*plain)
    text = F.col(plain[df.columns.index(text_col)])
    return held.withColumn("prepared", prepare_text(F.coalesce(text, F.lit("")))).mapInArrow(run, schema).toDF(*df.columns, "vector", "embed_error")


def embedded_items(messages: DataFrame, model: str) -> DataFrame:
    """(id, vector, payload) of embedded messages: the payload holds the metadata and the model, not the text."""
    fields = [F.col(c) for c in ("doc_chunk_id", "user_id", "source", "title", "lang")] + [F.lit(model).alias("model")] + [F.col(c) for c in ("created_at", "source_url", "source_id", "video_timestamp")]
    return messages.where("vector IS NOT NULL").select(F.col("doc_chunk_id").alias("id"), "vector", F.struct(*fields).alias("payload"))


def build_points(items: DataFrame, named: str | None = None) -> DataFrame:
    """(id, vector, payload) of checked items (point_id, ...); the vector is bare, or a map under one name."""
    vector = F.create_map(F.lit(named), F.col("vector")) if named else F.col("vector")
    return items.where("reason IS NULL").select(F.col("point_id").alias("id"), vector.alias("vector"), "payload")


def title_words(title: Column) -> Column:
    """The distinct words of a title, in lower case."""
    return F.array_distinct(F.array_remove(F.split(F.lower(title), r"(?U)\W+"), ""))


def payload_filter(user_id: str | None = None, source: str | None = None, lang: str | None = None, model: str | None = None, source_url: str | None = None, source_id: str | None = None, title_word: str | None = None, created_from=None, created_to=None, payload: str = "payload") -> Column:
    """Predicate on payload fields: equality of keywords, a word of the title, a range of created_at (ends included)."""
    out = F.lit(True)
    for name, value in (("user_id", user_id), ("source", source), ("lang", lang), ("model", model), ("source_url", source_url), ("source_id", source_id)):
        if value is not None:
            out = out & (F.col(f"{payload}.{name}") == value)
    if title_word is not None:
        out = out & F.array_contains(title_words(F.col(f"{payload}.title")), title_word.lower())
    if created_from is not None:
        out = out & (F.col(f"{payload}.created_at") >= (created_from if isinstance(created_from, Column) else F.lit(created_from)))
    if created_to is not None:
        out = out & (F.col(f"{payload}.created_at") <= (created_to if isinstance(created_to, Column) else F.lit(created_to)))
    return out


#: Rows of a block of points and of queries: what a task holds of each (64 floats a vector: 34 and 8 MB).
POINT_BLOCK, QUERY_BLOCK = 1 << 17, 1 << 15
#: Scores held at a time in a task.
SCORES = 1 << 20


def _matrix(rows: pa.Table, metric: str) -> np.ndarray:
    """The rows' vectors, one size each, as doubles; of length 1 where directions are compared."""
    held = rows["vector"].combine_chunks()
    x = held.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(held), -1)
    return unit_rows(x) if metric == "cosine" else x


def _best(q: np.ndarray, x: np.ndarray, limit: int, score_threshold: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score) of each query's `limit` best points, equal scores by the point's place."""
    step = max(8 * limit, SCORES // max(1, len(q)))
    floor = np.full(len(q), -np.inf if score_threshold is None else score_threshold)
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for first in range(0, len(x), step):
        part = x[first : first + step]
        scores = q @ part.T
        bar = floor
        if len(part) > 4 * limit:  # all that tie with the last kept one stay, so that places decide
            bar = np.maximum(bar, np.partition(scores, len(part) - limit, axis=1)[:, len(part) - limit])
        near = 1e-9 * max(1.0, np.fmax.reduce(np.abs(scores), axis=None))
        row, col = np.nonzero(scores >= bar[:, None] - near)
        # Each pair is summed in the same order and rounded, so that equal scores tie wherever they were computed.
        score = np.concatenate([np.zeros(0), *((part[col[a : a + 65536]] * q[row[a : a + 65536]]).sum(axis=1) for a in range(0, len(row), 65536))]).round(12)
        fits = score >= floor[row]
        best = tuple(np.concatenate(both) for both in zip(best, (row[fits], col[fits] + first, score[fits]), strict=True))
        order = np.lexsort((best[1], -best[2], best[0]))
        r = best[0][order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        best = tuple(part[order[nth < limit]] for part in best)
        full = nth == limit - 1
        floor[r[full]] = np.maximum(floor[r[full]], best[2][np.searchsorted(best[0], r[full], side="right") - 1])
    return best


def _cell(limit: int, score_threshold: float | None, metric: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block of points (id, vector) and one of queries (query_id, vector) to (query_id, id, score) of its best."""

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        points = points.sort_by("id")
        found: list[tuple[np.ndarray, ...]] = []
        if len(points) and len(queries):
            x = _matrix(points, metric)
            for at in range(0, len(queries), 1024):
                row, col, score = _best(_matrix(queries.slice(at, 1024), metric), x, limit, score_threshold)
                found.append((row + at, col, score))
        row, col, score = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        return pa.table({"query_id": queries["query_id"].take(pa.array(row)), "id": points["id"].take(pa.array(col)), "score": pa.array(score, pa.float64())})

    return run


def search_topk(points: DataFrame, queries: DataFrame, limit: int = 10, score_threshold: float | None = None, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """(query_id, rank, id, score): the `limit` best points of each query, exactly; ties, to 12 decimals, go to the smaller id.

    Points (id, vector) and queries (query_id, vector) meet as a grid of blocks: no row passes the driver, which learns two
    counts only (of unfiltered points, so that a plain scan answers from file footers); the plan is the same for any number
    of queries. Points are scanned once, `where` reaches that scan. A cell returns its own best, and the best of all cells
    are merged by rank, cut per task before the shuffle. Rows with null vectors take no part; vectors have one size.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError("metric must be cosine or dot")
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", points.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    n_points, n_queries = (grid.blocks(df, df.count(), most) for df, most in ((points, POINT_BLOCK), (queries, QUERY_BLOCK)))
    kept = points.where("vector IS NOT NULL")
    kept = (kept.where(where) if where is not None else kept).select("id", "vector")
    asked = queries.where("vector IS NOT NULL").select("query_id", "vector")
    local = grid.meet(grid.dealt(kept, ["id", "vector"], n_points, "l"), grid.dealt(asked, ["query_id"], n_queries, "r"), n_points, n_queries, _cell(limit, score_threshold, metric), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", "id", "score")


def hits_with_payload(hits: DataFrame, points: DataFrame) -> DataFrame:
    """Hits with their point's payload, ids as text; vectors are not read."""
    p = points.select("id", "payload")
    return hits.join(p, "id").select("query_id", "rank", F.col("id").cast("string").alias("id"), "score", "payload")
