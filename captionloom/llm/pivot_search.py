"""Exact top-k search by inner product: a table of distances to pivots eliminates what can't be among the k best."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captionloom.llm.common import cut
from captionloom.llm.integer_vectors import firsts, integer_rows, matrix, padded
from captionloom.operators import grid

#: Pivots, and rows that they are chosen from.
PIVOTS, SAMPLE = 64, 2048
#: Rows of a block of the index, queries of a part, and block summaries that meet such a part at a time.
BLOCK, QUERIES, SUMMARIES = 4096, 1024, 8192
#: Queries that a block is asked for at a time, and pairs that are scored at a time.
TILE, PAIRS = 256, 1 << 16
#: What bounds are loosened by: distances are kept as 32-bit floats.
SLACK = 1e-5

ROW = "block int, vec_id long, vector array<int>, norm double, dists array<float>"
HIT = "query_id long, own long, vec_id long, score long"

ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def choose_pivots(rows: DataFrame, pivots: int, sample: int) -> np.ndarray:
    """Pivots from a bounded sample, the rows of the smallest hashes: each is farthest from those chosen before it.

    The sample is all that the driver holds. Fewer rows give fewer pivots, none give one pivot at the origin.
    """
    held = rows.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(sample).select("vector").toArrow()
    x = matrix(held)
    if not x.size:
        return np.zeros((1, 0))
    chosen, gap = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < pivots and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of rows to pivots, and the rows' squared lengths."""
    x, p = padded(x, pivots)
    norm = (x * x).sum(axis=1).astype(float)
    return np.sqrt(np.maximum(norm[:, None] + (p * p).sum(axis=1) - 2.0 * (x @ p.T), 0)), norm


def pivot_table(rows: DataFrame, pivots: np.ndarray, block: int = BLOCK) -> DataFrame:
    """The index: every row with its block, squared length and distances to all pivots, written to the shared folder.

    A block holds rows whose nearest pivot is the same; a pivot that many rows are near has as many blocks as they need,
    dealt by hash, so that no block grows with a group of copies.
    """

    def measured(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            d, norm = distances(matrix(t), pivots)
            flat = pa.ListArray.from_arrays(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1], d.astype(np.float32).ravel())
            yield pa.RecordBatch.from_pydict({"cell": pa.array(d.argmin(axis=1) if len(d) else [], pa.int32()), "vec_id": b["vec_id"], "vector": b["vector"], "norm": norm, "dists": flat})

    table = cut(rows.mapInArrow(measured, ROW.replace("block", "cell")))
    counts = dict(table.groupBy("cell").count().toLocalIterator())  # a row a pivot at most
    first, parts, at = [], [], 0
    for cell in range(len(pivots)):
        first.append(at)
        parts.append(max(1, -(-counts.get(cell, 0) // block)))
        at += parts[-1]
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("cell"))
    number = of(first) + F.pmod(F.xxhash64("vec_id", "vector"), of(parts)).cast("int")
    return table.select(number.cast("int").alias("block"), "vec_id", "vector", "norm", "dists")


def block_ranges(index: DataFrame, pivots: int) -> DataFrame:
    """(block, low, high, norm): of a block's distances to each pivot the least and the greatest, and its longest row."""
    low = [F.min(F.get("dists", F.lit(k))).alias(f"a{k}") for k in range(pivots)]
    high = [F.max(F.get("dists", F.lit(k))).alias(f"b{k}") for k in range(pivots)]
    held = index.groupBy("block").agg(F.max("norm").alias("norm"), *low, *high)
    return held.select("block", "norm", F.array(*[f"a{k}" for k in range(pivots)]).alias("low"), F.array(*[f"b{k}" for k in range(pivots)]).alias("high"))


def upper_bound(q_norm: np.ndarray, x_norm: np.ndarray, least: np.ndarray) -> np.ndarray:
    """What the score of a query and a row that lie `least` apart or more can't pass: 2 qx = q² + x² - |q - x|²."""
    q_norm, x_norm = q_norm[:, None], x_norm[None, :]
    loose = SLACK * (1 + np.sqrt(q_norm) + np.sqrt(x_norm))
    return (q_norm + x_norm - np.square(np.maximum(least - loose, 0))) / 2 + loose


def lower_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Over all pivots the greatest lower bound of the distance from each query to each row (or range of rows)."""
    out = np.zeros((len(q), len(low)), np.float32)
    for k in range(q.shape[1]):
        mine = q[:, k, None]
        np.maximum(out, np.maximum(mine - high[None, :, k], low[None, :, k] - mine), out=out)
    return out


def _floats(t: pa.Table, name: str) -> np.ndarray:
    held = t[name].combine_chunks()
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1) if len(held) else np.zeros((0, 0), np.float32)


def _eliminated(q, q_norm, q_dists, q_own, bar, x, x_norm, x_dists, x_own, ids, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the block's best for a tile of queries, where they reach the query's bar.

    Rows are scored in the order of their bounds, a round of them at a time, until no bound reaches the k-th score.
    """
    bound = upper_bound(q_norm, x_norm, lower_bounds(q_dists, x_dists, x_dists))
    bound[q_own[:, None] == x_own[None, :]] = -np.inf
    bar, per = bar.copy(), 4 * limit
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    while (open_ := (bound >= bar[:, None]) & (bound > -np.inf)).any():
        if per < bound.shape[1]:
            open_ &= bound >= np.partition(bound, bound.shape[1] - per, axis=1)[:, bound.shape[1] - per, None]
        row, col = np.nonzero(open_)
        if 16 * len(row) > open_.size:
            score = (q @ x.T)[row, col]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", q[row[a : a + PAIRS]], x[col[a : a + PAIRS]]) for a in range(0, len(row), PAIRS)])
        bound[open_] = -np.inf
        fits = score >= bar[row]
        best = tuple(np.concatenate(b) for b in zip(best, (row[fits], col[fits], score[fits].astype(np.int64)), strict=True))
        best = tuple(b[k] for b, k in zip(best, [firsts(best[0], best[2], ids[best[1]], limit)] * 3, strict=True))
        n = np.bincount(best[0], minlength=len(q))
        last = np.cumsum(n) - 1
        bar[n == limit] = np.maximum(bar[n == limit], best[2][last[n == limit]])
        per *= 4
    return best


def searched(limit: int):
    """A block of the index and the queries that ask it, to HIT rows."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if len(rows) and len(asked):
            x, q = padded(matrix(rows), matrix(asked))
            x_norm, x_dists, ids, x_own = rows["norm"].to_numpy(), _floats(rows, "dists"), rows["vec_id"].to_numpy(), rows["own"].to_numpy()
            q_norm, q_dists, q_own, bar = asked["norm"].to_numpy(), _floats(asked, "dists"), asked["own"].to_numpy(), asked["bar"].to_numpy()
            for a in range(0, len(q), TILE):
                part = slice(a, a + TILE)
                row, col, score = _eliminated(q[part], q_norm[part], q_dists[part], q_own[part], bar[part], x, x_norm, x_dists, x_own, ids, limit)
                found.append((row + a, col, score))
        row, col, score = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(3))
        return pa.table({"query_id": asked["vec_id"].take(pa.array(row)), "own": asked["own"].take(pa.array(row)), "vec_id": rows["vec_id"].take(pa.array(col)), "score": pa.array(score, pa.int64())})

    return run


def _open_blocks(asked: pa.Table, ranges: pa.Table) -> pa.Table:
    """Which of the summarised blocks may hold a row that reaches a query's bar; its own block has been searched."""
    out = []
    if len(asked) and len(ranges):
        low, high, norm, block = _floats(ranges, "low"), _floats(ranges, "high"), ranges["norm"].to_numpy(), ranges["block"].to_numpy()
        q, q_norm, bar, home = _floats(asked, "dists"), asked["norm"].to_numpy(), asked["bar"].to_numpy(), asked["block"].to_numpy()
        for a in range(0, len(q), TILE):
            p = slice(a, a + TILE)
            bound = upper_bound(q_norm[p], norm, lower_bounds(q[p], low, high))
            row, col = np.nonzero((bound >= bar[p, None]) & (home[p, None] != block[None, :]))
            out.append((row + a, col))
    row, col = (np.concatenate([np.zeros(0, np.int64), *(o[k] for o in out)]) for k in range(2))
    kept = asked.select(["part", "vec_id", "vector", "norm", "dists", "own", "bar"]).take(pa.array(row))
    return kept.append_column("block", pa.array(ranges["block"].to_numpy()[col] if len(row) else row, pa.int32()))


def search(vectors: DataFrame, asks: str, limit: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `asks` selects (an expression over vec_id) the `limit` other rows
    of the highest integer inner product, all if fewer, ties by smaller vec_id. Exact, whatever pivots are chosen.

    First each query searches the block that it lies in, which gives its bar, the k-th score so far. Then the ranges of
    pivot distances of all other blocks tell which of them can reach the bar; those are opened, asked by a part of the
    queries at a time, and their rows eliminated by the pivot table in turn. See integer_rows() for rows left out; a row that
    repeats as a whole counts once; rows that share only the id are rows of their own, and each of them is a query. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = cut(integer_rows(vectors, id_col, vector_col))
    chosen = choose_pivots(rows, pivots, sample)
    index = pivot_table(rows, chosen, block).withColumn("own", F.xxhash64("vec_id", "vector"))
    wanted = index.where(asks)
    parts = grid.blocks(wanted, wanted.count(), queries)
    wanted = grid.dealt(wanted, ["vec_id", "vector"], parts, "part")
    home = cut(grid.cogrouped(index, wanted.withColumn("bar", F.lit(float("-inf"))), ["block"], searched(limit), HIT))
    kth = home.groupBy("own").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("kth"))
    barred = cut(wanted.join(kth, "own", "left").select(wanted["*"], F.when(F.col("n") >= limit, F.col("kth")).otherwise(float("-inf")).alias("bar")))
    ranges = cut(block_ranges(index, len(chosen)))
    n = ranges.count()
    ranges = grid.dealt(ranges, ["block"], summaries := grid.blocks(ranges, n, SUMMARIES), "r")
    ask = f"part int, {ROW.removeprefix('block int, ')}, own long, bar double, block int"
    asked = cut(grid.meet(barred.withColumn("l", F.col("part")), ranges, parts, summaries, _open_blocks, ask))
    opened = index.join(asked.select("block", "part").distinct(), "block")
    far = grid.cogrouped(opened, asked, ["block", "part"], searched(limit), HIT)
    best = Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id")
    ranked = home.unionByName(far).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= limit).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_report(vectors: DataFrame) -> DataFrame:
    """The contract's search: rows whose vec_id is divisible by 50, five others each."""
    return search(vectors, "vec_id % 50 = 0")
