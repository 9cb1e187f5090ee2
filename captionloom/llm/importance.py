"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionloom.llm.common import Words, cut, slices

#: Hash buckets of word uni- and bigrams: the size of either model, whatever the corpus.
BUCKETS = 1 << 14
SMOOTHING = 1.0
#: Labelled good documents that the target model is fitted on at most, drawn by hash of the id. The raw model counts all rows.
TARGETS = 20_000


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every word and word pair of each text."""
    w = Words(texts, lower=True)
    one = (w.hashes() % np.uint64(BUCKETS)).astype(np.int64)
    pairs, first = w.shingles(2)
    return np.append(w.doc, w.doc[first]), np.append(one, (pairs % np.uint64(BUCKETS)).astype(np.int64))


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per class and bucket, counts of one task: at most 2 * BUCKETS rows."""
    sums = np.zeros((2, BUCKETS), np.int64)
    for pdf in batches:
        good = pdf["is_target"].to_numpy().astype(bool)
        for at, held in slices(pdf["text"]):
            doc, bucket = features(held)
            raw = np.bincount(bucket, minlength=BUCKETS)
            sums[0] += raw
            mine = good[at : at + len(held)][doc]
            sums[1] += np.bincount(bucket[mine], minlength=BUCKETS)
    c, b = np.nonzero(sums)
    yield pd.DataFrame({"target": c, "bucket": b, "n": sums[c, b]})


def fit_ratio(docs: DataFrame, is_target: Column, text_col: str = "text") -> np.ndarray:
    """log(p_target / p_raw) of each bucket, from the n-grams of all rows. BUCKETS numbers reach the driver.

    Null texts have no n-grams; a null is_target is false. Without rows, or without targets, both models are uniform.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(is_target, F.lit(False)).alias("is_target"))
    tally = rows.mapInPandas(_tally, "target int, bucket int, n long").groupBy("target", "bucket").agg(F.sum("n").alias("n"))
    counts = np.full((2, BUCKETS), SMOOTHING)
    for r in tally.collect():
        counts[r["target"], r["bucket"]] += r["n"]
    p = np.log(counts / counts.sum(axis=1, keepdims=True))
    return p[1] - p[0]


def log_weights(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", temper: int | None = None) -> DataFrame:
    """docs as `row` with log_weight, the sum of its n-grams' log ratios, and n_grams. Null texts and texts without words have 0.

    temper, if given, takes a text's mean log ratio times its n-grams, but no more than so many of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = []
            for _, held in slices(texts):
                doc, bucket = features(held)
                n = np.bincount(doc, minlength=len(held))
                total = np.bincount(doc, shared.value[bucket], minlength=len(held))
                parts.append((total * np.minimum(1, temper / np.maximum(n, 1)) if temper else total, n))
            yield pd.DataFrame({"log_weight": np.concatenate([p[0] for p in parts] or [np.empty(0)]), "n_grams": np.concatenate([p[1] for p in parts] or [np.empty(0, int)])})

    scored = F.pandas_udf(run, "log_weight double, n_grams long")
    return docs.select(F.struct("*").alias("row"), scored(F.col(text_col)).alias("s")).select("row", "s.*")


def gumbel(seed: int, *key: str) -> Column:
    """A Gumbel variate made of the key's hash: the same for the same row in every run and partitioning."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


#: Rows that the last step of a search for the k-th row sorts at most, unless they all have the same score.
FEW = 20_000


def top_k(scored: DataFrame, k: int, order: str = "score", tie: str = "id") -> DataFrame:
    """scored with `kept`: whether the row is one of exactly k with the greatest order, ties by the smaller tie (null first).

    Pairs of quantiles close in on the k-th score until few rows lie between them, and only those are sorted. Where more
    rows than that have the same score, their distinct ties are. Rows that repeat score and tie are kept or left together.
    scored must be a table: it is read several times. Scores must not be null or NaN; ties may be of any type that sorts.
    """
    total = scored.count()
    if k >= total or k <= 0:
        return scored.withColumn("kept", F.lit(k > 0))
    inside, left, n, error = scored, k, total, 2e-4
    while n > FEW:
        band = [min(1.0, max(0.0, 1 - left / n + e)) for e in (-error, error)]
        low, high = inside.agg(F.percentile_approx(order, band, 10_000)).first()[0]
        if low == high:
            above = inside.where(F.col(order) > F.lit(high)).count()
            inside, left = inside.where(F.col(order) == F.lit(high)), left - above
            break
        seen = inside.agg(F.count_if(F.col(order) > F.lit(high)), F.count_if(F.col(order).between(F.lit(low), F.lit(high)))).first()
        if not 0 <= left - seen[0] <= seen[1] or seen[1] == n:
            error *= 4  # the quantiles missed the k-th score, or closed in on nothing
            if error > 1:
                break
            continue
        inside, left, n = inside.where(F.col(order).between(F.lit(low), F.lit(high))), left - seen[0], seen[1]
    rows = inside.groupBy(order, tie).agg(F.count("*").alias("n")).orderBy(F.desc(order), F.col(tie).asc_nulls_first()).limit(max(1, left))
    so_far = F.sum("n").over(Window.orderBy(F.desc(order), F.col(tie).asc_nulls_first())) - F.col("n")
    last = rows.withColumn("before", so_far).where(F.col("before") < max(1, left)).orderBy(F.desc("before")).first()
    bar, id_ = last[order], last[tie]
    at_bar = F.col(tie).isNull() | (F.col(tie) <= F.lit(id_)) if id_ is not None else F.col(tie).isNull()
    return scored.withColumn("kept", (F.col(order) > F.lit(bar)) | ((F.col(order) == F.lit(bar)) & at_bar))


def resample(docs: DataFrame, ratio: np.ndarray, k: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, temper: int | None = None) -> DataFrame:
    """(id, n_grams, log_weight, score, kept) for every row of docs: kept marks the k rows of greatest log_weight + Gumbel noise.

    That is a sample without replacement by importance weight. Rows that repeat id and text have the same noise, and at
    the border all or none of them are kept.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("k_text"))
    scored = log_weights(keyed, ratio, temper=temper)
    noisy = scored.select("row.id", "n_grams", "log_weight", (F.col("log_weight") + gumbel(seed, "row.id", "row.k_text")).alias("score"))
    return top_k(cut(noisy), k)


def good_share(labels: DataFrame) -> float:
    """Share of good labels; 1 where there are none."""
    r = labels.agg(F.avg((F.col("quality") == 1).cast("double")).alias("good")).first()
    return 1.0 if r["good"] is None else float(r["good"])


def importance_report(docs: DataFrame, labels: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, n_grams, log_weight, score, kept): target text is what labels call good; as large a share of all documents
    is sampled as is good among the labelled ones. Without labels all are kept. Null and empty texts have log weight 0 and compete by noise."""
    one = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = good_share(one)
    target = one.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGETS).select("doc_id", F.lit(True).alias("is_target"))
    marked = docs.select("doc_id", "text").join(F.broadcast(target), "doc_id", "left")
    ratio = fit_ratio(marked, F.col("is_target"))
    total = docs.count()
    return resample(docs, ratio, round(share * total), seed=seed).withColumnRenamed("id", "doc_id")
