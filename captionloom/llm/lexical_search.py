"""Ranked lexical search: MaxScore over shards of documents, its bounds tightened by the joint maxima of term pairs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captionloom.llm.common import TO_LOWER, cut, give_back, prefix_hash, slices, span_hash, utf8_of
from captionloom.operators import grid

#: Bytes of text and documents of a shard, and items that a shard is asked for at a time.
SHARD_BYTES, SHARD_DOCS, ITEMS = 1 << 23, 1 << 14, 512
#: Bits of the fixed-size filter of query terms: what it lets through is at worst all terms, so results don't depend on it.
FILTER_BITS = 22
#: Part of the shards that is searched first, for scores that the others must reach.
FIRST_PART = 16

#: Bytes of terms: letters and digits, and whatever isn't ASCII.
IS_TERM = np.zeros(256, bool)
IS_TERM[128:] = True
IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True

SHARD = "shard long, n_docs long, n_terms long, doc_id array<long>, n binary, terms binary, starts binary, docs binary, tf binary"
INDEX = "l int, r int, doc_id array<long>, terms binary, starts binary, docs binary, part binary, top binary, pairs binary, joint binary, pair_starts binary, pair_docs binary"
HIT = "own long, item_id long, doc_id long, score long"

TERMS = r"regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT * FROM (SELECT doc_id, {TERMS.format(x="text")} AS ts FROM documents WHERE text IS NOT NULL) WHERE len(ts) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS term FROM d) GROUP BY doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TERMS.format(x="text")}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
s AS (SELECT item_id, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of every term of some texts, in order; the hash stands for the term from here on."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    edge = np.flatnonzero(np.diff(IS_TERM[data].astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return np.searchsorted(begins, start, side="right") - 1, span_hash(prefix_hash(TO_LOWER[data]), start, end)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(own, item_id, term, qtf): terms of each distinct (id, text) with how often it has them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in slices(utf8_of(b["text"])):
                doc, term = term_hashes(texts)
                order = np.lexsort((term, doc))
                doc, term = doc[order], term[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])])) if len(doc) else np.zeros(0, np.int64)
                at = pa.array(doc[new] + first)
                yield pa.RecordBatch.from_pydict({"own": b["own"].take(at), "item_id": b["item_id"].take(at), "term": term[new].astype(np.int64), "qtf": np.diff(np.append(new, len(doc)))})

    held = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return held.dropDuplicates().select(F.xxhash64("item_id", "text").alias("own"), "item_id", "text").mapInArrow(run, "own long, item_id long, term long, qtf long")


def term_filter(terms: DataFrame) -> np.ndarray:
    """A bit for each slot that a wanted term has: 512 KB at most, whatever the number of terms."""
    slot = F.expr(f"shiftrightunsigned(term, {64 - FILTER_BITS})")
    words = terms.select(F.shiftright(slot, 6).alias("word"), (slot % 64).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))
    out = np.zeros(1 << FILTER_BITS >> 6, np.int64)
    for row in words.toLocalIterator():  # a row for each of the 65,536 words at most
        out[row["word"]] = row["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _shard(number: int, doc_ids: list, counts: list[np.ndarray], doc: np.ndarray, term: np.ndarray) -> dict:
    order = np.lexsort((doc, term))
    doc, term = doc[order], term[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])]) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    distinct, starts = np.unique(term[first], return_index=True)
    n = np.concatenate([np.zeros(0, np.int64), *counts])
    return {
        "shard": [(TaskContext.get().partitionId() << 32) + number], "n_docs": [int((n > 0).sum())], "n_terms": [int(n.sum())], "doc_id": pa.array([doc_ids], pa.list_(pa.int64())), "n": [n.astype(np.int64).tobytes()],
        "terms": [distinct.tobytes()], "starts": [np.append(starts, len(first)).astype(np.int32).tobytes()], "docs": [doc[first].astype(np.int32).tobytes()], "tf": [np.diff(np.append(first, len(doc))).astype(np.int32).tobytes()],
    }


def shards_of(docs: DataFrame, wanted: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """One row a shard of documents: their ids, how many terms each has, and the postings of the terms that the filter lets
    through, by term and document. Documents stay in their partition; one longer than a shard is a shard of its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = 0, 0
        ids: list = []
        counts: list[np.ndarray] = []
        docs, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]

        def full() -> pa.RecordBatch:
            nonlocal number, size, ids, counts, docs, terms
            out = pa.RecordBatch.from_pydict(_shard(number, ids, counts, np.concatenate(docs), np.concatenate(terms)))
            number, size, ids, counts, docs, terms = number + 1, 0, [], [], docs[:1], terms[:1]
            return out

        for b in batches:
            names = b["doc_id"].to_pylist()
            for first, texts in slices(utf8_of(b["text"])):
                doc, term = term_hashes(texts)
                kept = wanted[_slot(term)]
                docs.append(doc[kept] + len(ids))
                terms.append(term[kept])
                counts.append(np.bincount(doc, minlength=len(texts)))
                ids += names[first : first + len(texts)]
                size += sum(map(len, texts))
                if size >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                    yield full()
        if ids:
            yield full()
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SHARD)


def document_frequencies(shards: DataFrame) -> DataFrame:
    """(term, df): documents that hold the term; a row a shard and term is summed before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for terms, starts in zip(b["terms"].to_pylist(), b["starts"].to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"term": np.frombuffer(terms, np.int64), "df": np.diff(np.frombuffer(starts, np.int32)).astype(np.int64)})

    return shards.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _items(t: pa.Table) -> list[tuple]:
    """(own, item_id, bar, terms, counts, weights) of every item of a part."""
    return [(r["own"], r["item_id"], r.get("bar") or 0, *(np.array([x[k] for x in r["held"]], np.int64) for k in ("term", "qtf", "w"))) for r in t.to_pylist()]


def units(term: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How an item's terms are combined: neighbours in the order of their bounds are a pair (-1: the last is alone)."""
    order = np.lexsort((term, -bound))
    return order[::2], np.append(order[1::2], [-1] * (len(order) % 2)).astype(np.int64)


def pair_index(n_docs: int, n_terms: int):
    """Shards and items to INDEX rows: each posting's part of the score that is not the weight, each term's greatest, and
    for the pairs that items ask for the documents that hold both and the greatest sum that one of those has."""

    def run(shards: pa.Table, items: pa.Table) -> pa.Table:
        rows = []
        asked = _items(items)
        if asked:
            vocabulary, at = np.unique(np.concatenate([x[3] for x in asked]), return_index=True)
            weight = np.concatenate([x[5] for x in asked])[at]
        for s in shards.to_pylist() if asked else ():
            n = np.frombuffer(s["n"], np.int64)
            m = 75 + (25 * n * n_docs) // n_terms
            mine, starts = np.frombuffer(s["terms"], np.int64), np.frombuffer(s["starts"], np.int32)
            by_value = np.argsort(mine)
            spot = np.minimum(np.searchsorted(mine, vocabulary, sorter=by_value), max(0, len(mine) - 1))
            hit = mine[by_value[spot]] == vocabulary if len(mine) else np.zeros(len(vocabulary), bool)
            terms, w, where = vocabulary[hit], weight[hit], by_value[spot[hit]] if len(mine) else spot[hit]
            sizes = (starts[where + 1] - starts[where]).astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(sizes)])
            take = np.arange(begin[-1]) + np.repeat(starts[where] - begin[:-1], sizes)
            docs, tf = np.frombuffer(s["docs"], np.int32)[take], np.frombuffer(s["tf"], np.int32)[take].astype(np.int64)
            part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[docs])
            top = np.maximum.reduceat(part, begin[:-1]) if len(terms) else np.zeros(0, np.int64)
            wanted: dict[tuple[int, int], None] = {}
            for _, _, _, term, qtf, _ in asked:
                k, q = _present(terms, term, qtf)
                a, b = units(term[_known(terms, term)], q * w[k] * top[k])
                wanted.update(dict.fromkeys((min(k[i], k[j]), max(k[i], k[j])) for i, j in zip(a, b, strict=True) if j >= 0))
            lists, joint = [], []
            place = np.zeros(len(n), np.int64)
            for a, b in wanted:
                x, y = slice(begin[a], begin[a + 1]), slice(begin[b], begin[b + 1])
                place[docs[x]] = part[x] + 1
                other = place[docs[y]]
                both = other > 0
                lists.append(docs[y][both])
                joint.append(int((w[a] * (other[both] - 1) + w[b] * part[y][both]).max()) if both.any() else 0)
                place[docs[x]] = 0
            as_bytes = lambda x, kind: np.ascontiguousarray(np.asarray(x, kind)).tobytes()
            rows.append({
                "l": s["l"], "r": items["r"][0].as_py(), "doc_id": s["doc_id"], "terms": as_bytes(terms, np.int64), "starts": as_bytes(begin, np.int64), "docs": as_bytes(docs, np.int32), "part": as_bytes(part, np.int32), "top": as_bytes(top, np.int64),
                "pairs": as_bytes(list(wanted), np.int64), "joint": as_bytes(joint, np.int64), "pair_starts": as_bytes(np.cumsum([0, *map(len, lists)]), np.int64), "pair_docs": as_bytes(np.concatenate([np.zeros(0, np.int32), *lists]), np.int32),
            })
        binary = {k: pa.binary() for k in ("terms", "starts", "docs", "part", "top", "pairs", "joint", "pair_starts", "pair_docs")}
        return pa.Table.from_pylist(rows, pa.schema({"l": pa.int32(), "r": pa.int32(), "doc_id": pa.list_(pa.int64()), **binary}))

    return run


def _known(terms: np.ndarray, term: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(terms, term), max(0, len(terms) - 1))
    return terms[at] == term if len(terms) else np.zeros(len(term), bool)


def _present(terms: np.ndarray, term: np.ndarray, qtf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of an item's terms that a shard has, and how often the item has them."""
    known = _known(terms, term)
    return np.searchsorted(terms, term[known]), qtf[known]


class Shard:
    """One row of the index, opened."""

    def __init__(self, row: dict):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids = row["doc_id"]
        self.terms, self.starts, self.docs, self.part, self.top = get("terms", np.int64), get("starts", np.int64), get("docs", np.int32), get("part", np.int32), get("top", np.int64)
        self.joint, self.pair_starts, self.pair_docs = get("joint", np.int64), get("pair_starts", np.int64), get("pair_docs", np.int32)
        self.pair = {(a, b): k for k, (a, b) in enumerate(get("pairs", np.int64).reshape(-1, 2).tolist())}
        self.opened = 0  # postings that were read one after the other

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.starts[term], self.starts[term + 1])
        return self.docs[at], self.part[at]

    def looked_up(self, term: int, docs: np.ndarray) -> np.ndarray:
        """What the term adds to some documents, 0 where they don't have it."""
        held, part = self.postings(term)
        at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
        return np.where(held[at] == docs, part[at], 0).astype(np.int64)

    def best(self, term: np.ndarray, qtf: np.ndarray, weight: np.ndarray, limit: int, bar: int, paired: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the shard's `limit` best for an item that reach the bar; more where scores tie.

        A unit is a pair of terms, bounded by what a document with one of them or with both can have. Units are read from
        the greatest bound on. Once the bounds of those left are below the bar together, only documents met so far are
        looked up in them, and fewer with every unit.
        """
        known = _known(self.terms, term)
        k, q = np.searchsorted(self.terms, term[known]), (qtf * weight)[known]
        if not len(k):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bound = q * self.top[k]
        a, b = units(term[known], bound)
        most, lists = bound[a] + np.where(b >= 0, bound[b], 0), []
        for u, (i, j) in enumerate(zip(a, b, strict=True) if paired else ()):
            pair = self.pair.get((min(k[i], k[j]), max(k[i], k[j]))) if j >= 0 else None
            if pair is not None:
                most[u] = min(most[u], max(bound[i], bound[j], int(self.joint[pair]) * int(max(qtf[known][i], qtf[known][j]))))
                lists.append(self.pair_docs[self.pair_starts[pair] : self.pair_starts[pair + 1]])
        order = np.argsort(-most, kind="stable")
        left = np.append(np.cumsum(most[order][::-1])[::-1], 0)
        bar = max(bar, 1, self._first_bar(k, q, lists, limit))
        score = np.zeros(len(self.ids), np.int64)
        at = 0
        while at < len(order) and left[at] >= bar:
            for i in (a[order[at]], b[order[at]]):
                if i >= 0:
                    docs, part = self.postings(k[i])
                    score[docs] += q[i] * part
                    self.opened += len(docs)
            at += 1
            if len(score) > limit:
                bar = max(bar, int(np.partition(score, len(score) - limit)[len(score) - limit]))
        docs = np.flatnonzero((score > 0) & (score + left[at] >= bar))
        score = score[docs]
        for u in range(at, len(order)):
            for i in (a[order[u]], b[order[u]]):
                if i >= 0 and len(docs):
                    score = score + q[i] * self.looked_up(k[i], docs)
            if len(docs) > limit:
                bar = max(bar, int(np.partition(score, len(score) - limit)[len(score) - limit]))
            docs, score = docs[keep := score + left[u + 1] >= bar], score[keep]
        return docs, score

    def _first_bar(self, k: np.ndarray, q: np.ndarray, lists: list[np.ndarray], limit: int) -> int:
        """The k-th score of some documents that hold both terms of a strong pair: nothing below it is among the best."""
        some = np.zeros(0, np.int64)
        for docs in lists[:4]:
            some = np.union1d(some, docs[: 8 * limit])
        if len(some) < limit:
            return 0
        return int(np.partition(sum(x * self.looked_up(t, some) for t, x in zip(k, q, strict=True)), len(some) - limit)[len(some) - limit])


def found_in(limit: int, paired: bool = True):
    """Index rows and items to HIT rows: a shard's best documents for each item."""

    def run(index: pa.Table, items: pa.Table) -> pa.Table:
        out: list[tuple] = []
        asked = _items(items)
        for row in index.to_pylist() if asked else ():
            s = Shard(row)
            ids = np.array([np.iinfo(np.int64).max if x is None else x for x in s.ids], np.int64)
            for own, item_id, bar, term, qtf, weight in asked:
                docs, score = s.best(term, qtf, weight, limit, bar, paired)
                best = np.lexsort((ids[docs], -score))[:limit]
                out += [(own, item_id, s.ids[d], int(x)) for d, x in zip(docs[best], score[best], strict=True)]
        names = ("own", "item_id", "doc_id", "score")
        return pa.table({n: pa.array([r[k] for r in out], pa.int64()) for k, n in enumerate(names)})

    return run


def search(docs: DataFrame, items: DataFrame, limit: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", items_part: int = ITEMS, paired: bool = True) -> DataFrame:
    """(item_id, rank, doc_id, score): the `limit` documents of the highest score above 0 for every item, all if fewer,
    equal scores by smaller doc_id. Exact: bounds only tell which postings need not be read.

    Texts are read once, into shards that hold postings of the items' terms; counts cover all documents. Every shard meets
    every part of the items twice: to store scores and pair lists, then to be searched, some shards first, whose k-th scores
    the others must reach. Null texts have no terms; documents of null id come last among equals; every row is a document,
    also where rows repeat. An item without a term that some document has gives no rows; items that repeat id and text are
    one, those that share only the id are ranked each for itself. Empty tables give no rows; other columns are ignored.
    """
    words = cut(item_terms(items, item_id, item_text))
    shards = cut(shards_of(docs, term_filter(words), id_col, text_col))
    total = shards.agg(F.count("*").alias("shards"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    n_shards, n_docs, n_terms = max(1, total["shards"]), total["n"], max(1, total["l"])
    w = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    held = words.join(document_frequencies(shards), "term").groupBy("own", "item_id").agg(F.collect_list(F.struct("term", "qtf", w.alias("w"))).alias("held"))
    asked = cut(held)
    parts = grid.blocks(asked, asked.count(), items_part)
    asked = grid.dealt(asked, ["own"], parts, "r")
    index = cut(grid.meet(grid.dealt(shards, ["shard"], n_shards, "l"), asked, n_shards, parts, pair_index(n_docs, n_terms), INDEX))
    order = Window.partitionBy("own").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = lambda hits: hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    first = -(-n_shards // FIRST_PART)
    every = lambda some, a, b: some.withColumn("l", F.explode(F.sequence(F.lit(a), F.lit(b - 1))))
    some = cut(ranked(grid.cogrouped(index.where(F.col("l") < first), every(asked, 0, first), ["l", "r"], found_in(limit, paired), HIT)))
    if first < n_shards:
        bars = some.where(F.col("rank") == limit).select("own", F.col("score").alias("bar"))
        rest = grid.cogrouped(index.where(F.col("l") >= first), every(asked.join(bars, "own", "left"), first, n_shards), ["l", "r"], found_in(limit, paired), HIT)
        some = ranked(some.drop("rank").unionByName(rest))
    return some.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's search: 20 documents for every benchmark item."""
    return search(docs, items)
