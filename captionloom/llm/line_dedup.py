"""Line dedup without text in the shuffle: line hashes are range-partitioned and sorted by document; keep bitmaps come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionloom.llm.common import LOWER, UPPER, WS, cut, per_salt, row_key, salt, salts_of, same_key


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WS)), UPPER, LOWER)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(k_id, k_text, n_dropped, keep): the documents that lose lines, with a compressed bitmap of the lines they keep.

    A key (line stripped of ASCII white space, A-Z lower-cased) of at least min_chars code points that min_docs
    different ids hold loses all its lines except those of the largest id (null is the smallest id). keep lists only the
    64-line words that miss a line: (word, bits), bit i for line 64*word+i. Rows that repeat id and text share a bitmap.
    Lines are compared by 128 bits of hash. Empty and null texts have one empty line and lose nothing.

    Each key's documents are dealt to parts; a part streams its first occurrence (the largest id) in sorted order, only
    these summaries meet per key, and they go back to lines by key and part, so a line that every document holds is no hot
    task anywhere.
    """
    rows = docs.select(*row_key(id_col, text_col), F.posexplode(F.transform(lines_of(F.col(text_col)), line_key)).alias("pos", "key")).where(F.length("key") >= min_chars)
    rows = cut(rows.select("k_id", "k_text", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), salt("k_id").alias("salt")))
    part = ["h1", "h2", "salt"]
    dealt = rows.repartitionByRange(*part)
    order = Window.partitionBy(*part).orderBy(F.desc_nulls_last("k_id"), "k_text", "pos")
    streamed = dealt.select(*part, "k_id", F.row_number().over(order).alias("nth"), F.lag("k_id").over(order).alias("before"))
    heads = streamed.where((F.col("nth") == 1) | ~F.col("k_id").eqNullSafe(F.col("before")))
    hot = heads.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("k_id").alias("last_id"), salts_of("salt").alias("salts")).where(F.col("n_docs") >= min_docs)
    lost = rows.join(per_salt(hot.select("h1", "h2", "last_id", "salts")), part).where(~F.col("k_id").eqNullSafe(F.col("last_id")))
    words = lost.groupBy("k_id", "k_text", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("gone"))
    return words.groupBy("k_id", "k_text").agg(
        F.sum(F.bit_count("gone")).alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"),
    )


def kept_text(text: Column, keep: Column) -> Column:
    """The text without the lines that the bitmap clears; a null bitmap keeps all."""
    bits = F.map_from_entries(keep)

    def stays(_: Column, i: Column) -> Column:
        word = F.try_element_at(bits, F.floor(i / 64).cast("int"))
        return word.isNull() | (F.getbit(word, i % 64) == 1)

    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(lines_of(text), stays), "\n"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with their kept text in place; every row and every other column stays, whatever its name (null text becomes empty)."""
    gone = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    keyed = docs.select(F.struct("*").alias("row"), *row_key(id_col, text_col))
    out = keyed.join(gone, same_key(keyed, gone), "left").select("row", "keep")
    field = lambda c: F.col("row").getField(c)
    return out.select(*[(kept_text(field(c), F.col("keep")) if c == text_col else field(c)).alias(c) for c in docs.columns])


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row; null and empty texts have one line, which stays."""
    keyed = docs.select("doc_id", "text", *row_key("doc_id", "text"))
    gone = keep_bitmaps(docs)
    both = keyed.join(gone, same_key(keyed, gone), "left")
    return both.select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), F.col("keep")), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
keyed AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.doc_id, k.i, k.line, h.key IS NOT NULL AND k.doc_id <> h.last_id AS gone FROM keyed k LEFT JOIN hot h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
