"""Hard negatives of anchors by Fagin's threshold algorithm over sorted lists of every dimension."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionloom.llm.common import cut
from captionloom.llm.integer_vectors import firsts, integer_rows, matrix, padded
from captionloom.operators import grid

#: Rows of a block, which has lists of its own, and anchors that a block is asked for at a time.
BLOCK, ANCHORS = 8192, 1024
#: Entries of each list that are read before the threshold is first looked at.
FIRST_READ = 64

LISTS = "l int, vec_id binary, own binary, label binary, width int, vector binary, lists binary"
POSITIVE = "own long, other long, vec_id long, score long"
NEGATIVE = "own long, positive_id long, positive_score long, other long, vec_id long, score long"

ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def sorted_lists(rows: DataFrame, n: int) -> DataFrame:
    """The index: one row a block, with its rows' integers and, for each dimension, the rows in the order of their component."""

    def packed(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        x = matrix(t).astype(np.int32)
        order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        held = {k: [t[k].to_numpy().astype(np.int64).tobytes()] for k in ("vec_id", "own", "label")}
        return pa.table({"l": t["l"].slice(0, 1), **held, "width": pa.array([x.shape[1]], pa.int32()), "vector": [x.tobytes()], "lists": [np.ascontiguousarray(order).tobytes()]})

    return grid.dealt(rows, ["vec_id", "own"], n, "l").repartition(n, "l").groupBy("l").applyInArrow(packed, LISTS)


class Block:
    """A block's lists, read in either direction: downwards where the anchor's component is positive, upwards where negative."""

    def __init__(self, row: dict):
        self.vec_id, self.own, self.label = (np.frombuffer(row[k], np.int64) for k in ("vec_id", "own", "label"))
        n = len(self.vec_id)
        self.x = np.frombuffer(row["vector"], np.int32).reshape(n, row["width"]).astype(float)
        self.lists = np.frombuffer(row["lists"], np.int32).reshape(row["width"], n)

    def widen(self, anchors: np.ndarray) -> np.ndarray:
        """Give rows and anchors one width; a dimension that the rows don't have is a list of zeros."""
        self.x, a = padded(self.x, anchors)
        more = self.x.shape[1] - len(self.lists)
        self.lists = np.vstack([self.lists, np.tile(np.arange(len(self.x), dtype=np.int32), (more, 1))]) if more else self.lists
        self.values = np.take_along_axis(self.x.T, self.lists, axis=1)
        return a

    def read(self, a: np.ndarray, done: Callable[[np.ndarray, np.ndarray], float]) -> None:
        """Sorted access to all lists at one depth, random access to score what is met; done(new rows, their scores) tells
        the score that an unseen row must reach to matter. Stops when the threshold falls strictly below it."""
        up, down = np.flatnonzero(a < 0), np.flatnonzero(a > 0)
        threshold = a[up] @ self.values[up] + (a[down] @ self.values[down])[::-1]
        n, at, to, seen = len(self.x), 0, min(FIRST_READ, len(self.x)), np.zeros(len(self.x), bool)
        while at < n:
            new = np.zeros(n, bool)
            new[self.lists[up, at:to]] = True
            new[self.lists[down, n - to : n - at]] = True
            if not len(up) and not len(down):
                new[:], to = True, n  # an anchor of zeros: no list tells rows apart
            new &= ~seen
            seen |= new
            rows = np.flatnonzero(new)
            bar = done(rows, (self.x[rows] @ a).astype(np.int64))
            if threshold[to - 1] < bar:
                return
            # Not beyond the depth where the threshold falls below the bar as it is, and not too far, since it may rise.
            at, to = to, min(n, 2 * to, max(to + FIRST_READ, int(np.searchsorted(-threshold, -bar, side="right")) + 1))


def _asked(anchors: pa.Table, blocks: pa.Table):
    for row in blocks.to_pylist():
        b = Block(row)
        yield b, b.widen(matrix(anchors))


def nearest_alike(limit: int):
    """Blocks and anchors to POSITIVE rows: an anchor's best other rows of its label in each block."""

    def run(blocks: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 4]
        own, label = anchors["own"].to_numpy(), anchors["label"].to_numpy()
        for b, a in _asked(anchors, blocks) if len(anchors) else ():
            for k in range(len(a)):
                alike = (b.label == label[k]) & (b.own != own[k])
                held = np.zeros(0, np.int64), np.zeros(0, np.int64)

                def done(rows, scores, alike=alike):
                    nonlocal held
                    fits = alike[rows]
                    held = np.concatenate([held[0], rows[fits]]), np.concatenate([held[1], scores[fits]])
                    best = firsts(np.zeros(len(held[0]), np.int64), held[1], held[0], limit)
                    held = held[0][best], held[1][best]
                    return held[1][-1] if len(best) == limit else -np.inf

                b.read(a[k], done)
                out.append((np.full(len(held[0]), own[k]), b.own[held[0]], b.vec_id[held[0]], held[1]))
        return pa.table(dict(zip(("own", "other", "vec_id", "score"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    return run


def windows(positive_scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The integers s with low * p <= 100 * s <= high * p, as least and greatest."""
    return -((-low * positive_scores) // 100), (high * positive_scores) // 100


def nearest_unlike(limit: int, low: int, high: int):
    """Blocks and anchors with their positives to NEGATIVE rows: for each window its best rows of other labels."""

    def run(blocks: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 6]
        own, label, positives = anchors["own"].to_numpy(), anchors["label"].to_numpy(), anchors["positives"].to_pylist()
        for b, a in _asked(anchors, blocks) if len(anchors) else ():
            for k in range(len(a)):
                p = np.array([(x["vec_id"], x["score"]) for x in positives[k]], np.int64).reshape(-1, 2)
                least, most = windows(p[:, 1], low, high)
                p, least, most = p[least <= most], least[least <= most], most[least <= most]
                if not len(p):
                    continue
                unlike = b.label != label[k]
                kept = np.zeros(0, np.int64), np.zeros(0, np.int64)

                def done(rows, scores, unlike=unlike, least=least, most=most):
                    nonlocal kept
                    fits = unlike[rows] & (scores >= least.min()) & (scores <= most.max())
                    kept = np.concatenate([kept[0], rows[fits]]), np.concatenate([kept[1], scores[fits]])
                    bar = np.inf
                    for lo, hi in zip(least, most, strict=True):
                        inside = kept[1][(kept[1] >= lo) & (kept[1] <= hi)]
                        bar = min(bar, np.partition(inside, len(inside) - limit)[len(inside) - limit] if len(inside) >= limit else lo)
                    return bar

                b.read(a[k], done)
                for (pid, score), lo, hi in zip(p, least, most, strict=True):
                    inside = np.flatnonzero((kept[1] >= lo) & (kept[1] <= hi))
                    rows, scores = kept[0][inside], kept[1][inside]
                    best = firsts(np.zeros(len(rows), np.int64), scores, rows, limit)
                    one = np.ones(len(best), np.int64)
                    out.append((own[k] * one, pid * one, score * one, b.own[rows[best]], b.vec_id[rows[best]], scores[best]))
        return pa.table(dict(zip(("own", "positive_id", "positive_score", "other", "vec_id", "score"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    return run


def _ranked(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "other"))
    return rows.withColumn("rank", nth).where(F.col("rank") <= limit)


def mine(vectors: DataFrame, anchors: str, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, part: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for the rows that `anchors` selects (an
    expression over vec_id), each of their first `positives` other rows of the same label and the first `negatives` rows of
    other labels whose score lies between low and high percent of the positive's. Scores are integer inner products, the
    higher first, ties by smaller id. Exact.

    Rows are dealt by hash to blocks, each with a sorted list for every dimension; a label that most rows have changes
    nothing. Anchors ask every block twice, for positives and then, with their windows known, for negatives; each time a
    block is read by the threshold algorithm, and what its blocks find is merged by rank. A positive score below 0 has an
    empty window; one of 0 has the window 0. See integer_rows() for rows left out; a row that repeats as a whole counts
    once; rows that share only the id are rows of their own, and each of them is an anchor. Other columns are ignored; an
    empty table gives no rows.
    """
    rows = cut(integer_rows(vectors, id_col, vector_col, label=label.cast("long")).withColumn("own", F.xxhash64("vec_id", "label", "vector")))
    blocks = grid.blocks(rows, rows.count(), block)
    index = cut(sorted_lists(rows, blocks))
    asked = rows.where(anchors)
    parts = grid.blocks(asked, asked.count(), part)
    asked = grid.dealt(asked, ["own"], parts, "r")
    found = _ranked(grid.meet(index, asked.select("own", "label", "vector", "r"), blocks, parts, nearest_alike(positives), POSITIVE), ["own"], positives)
    held = found.groupBy("own").agg(F.collect_set(F.struct("vec_id", "score")).alias("positives"))
    known = cut(asked.join(held, "own"))
    far = grid.meet(index, known.select("own", "label", "vector", "positives", "r"), blocks, parts, nearest_unlike(negatives, low, high), NEGATIVE)
    best = _ranked(far, ["own", "positive_id", "positive_score"], negatives)
    named = best.join(known.select("own", F.col("vec_id").alias("anchor_id")), "own")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def negatives_report(vectors: DataFrame) -> DataFrame:
    """The contract's mining: rows whose vec_id is divisible by 100; labels of rows divisible by 7 move on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, "vec_id % 100 = 0", label)
