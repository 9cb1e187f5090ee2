"""Connected components as a few rounds of grouped minima over an edge table; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionloom.llm.common import cut, per_salt, salt, salts_of


def _least_neighbours(edges: DataFrame) -> DataFrame:
    """(a, b, m): edges with the least b that their a has. A hub's edges are dealt to parts, not to one task."""
    dealt = edges.withColumn("salt", salt("b"))
    low = dealt.groupBy("a").agg(F.min("b").alias("m"), salts_of("salt").alias("salts"))
    return dealt.join(per_salt(low), ["a", "salt"]).select("a", "b", "m")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of edges (a, b) reaches; nodes without edges don't appear.

    Alternates two contractions: every node links its larger neighbours to its smallest one, then its smaller ones,
    until the edge set is a set of stars and changes no more, however many rounds that takes. Each round is two grouped
    minima with map-side combining and their joins. Nulls are no nodes; loops and repeated edges don't matter.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least_neighbours(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b")
        small = _least_neighbours(large).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        now = cut(small.distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = seen
