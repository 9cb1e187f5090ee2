"""N-gram Jaccard self-join over a token-group matrix: exact components of documents that share most of their shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionloom.llm.common import Words, beside, cut, give_back, mix, per_salt, release, row_key, salt, salts_of, same_key, slices, utf8_of
from captionloom.llm.components import connected

#: Documents that a group holds at most; a larger set of similar documents becomes several groups.
GROUP = 96
#: Tokens that a packed row set gathers, so that its documents are named once per bucket.
PACKED = 1 << 20
#: Bytes of a token that travel; the bucket holds further bits.
TOKEN_BYTES = 6
#: Postings that a bucket is to hold; buckets are as many as the tokens need.
BUCKET_TOKENS = 1 << 21
#: Queries that one task compares with a group; more are dealt to several, each beside the group's members.
ASKED = 1024


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, doc, n): each document's distinct shingle hashes, sorted by document and hash, and their number."""
    w = Words(texts, lower=True)
    h, first = w.shingles(width)
    doc = w.doc[first]
    if short := np.flatnonzero((w.n_words > 0) & (w.n_words < width)).tolist():
        words, ends = w.hashes(), np.cumsum(w.n_words)
        whole = [0] * len(short)
        for k, d in enumerate(short):
            for x in words[ends[d] - w.n_words[d] : ends[d]].tolist():
                whole[k] = (whole[k] * 0x9FB21C651E98DF25 + x + 1) % (1 << 64)
        h, doc = np.append(h, mix(np.array(whole, np.uint64))), np.append(doc, short)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, doc, np.bincount(doc, minlength=len(texts))


def set_keys(h: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each whole set; equal sets, equal keys. int64, as Spark stores it; 0 for the empty set."""
    sums = np.zeros(len(n), np.uint64)
    np.add.at(sums, doc, mix(h * np.uint64(0xC2B2AE3D27D4EB4F)))
    keys = mix(sums + n.astype(np.uint64)).view(np.int64)
    return np.where(n > 0, keys, 0)


def _sizes(width: int) -> Callable:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            n_all, key_all = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for _, held in slices(utf8_of(texts)):
                h, doc, n = shingle_sets(held, width)
                n_all.append(n)
                key_all.append(set_keys(h, doc, n))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (n_all, key_all)], ["n", "set_key"])
            give_back()

    return run


def pack_tokens(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]).tobytes()


def unpack_tokens(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // TOKEN_BYTES, 8), np.uint8)
    out[:, :TOKEN_BYTES] = np.frombuffer(b, np.uint8).reshape(-1, TOKEN_BYTES)
    return out.view(np.uint64).ravel()


def _postings(width: int, buckets: int) -> Callable:
    """Rows (bucket, sets, sizes, local, tokens): per slice and bucket its postings; local numbers the sets of the row."""

    def packed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        begin = np.cumsum([0, *(len(p[2]) for p in parts)])
        h = np.concatenate([p[0] for p in parts])
        doc = np.concatenate([p[1] + b for p, b in zip(parts, begin, strict=False)])
        n, keys = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        _, once = np.unique(keys, return_index=True)
        fresh = np.zeros(len(n), bool)
        fresh[once] = True
        mine = fresh[doc]
        h, doc = h[mine], doc[mine]
        bucket = (h >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        h, doc = h[order], doc[order]
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for b in range(buckets):
            if (at := ends[b]) < (to := ends[b + 1]):
                docs, local = np.unique(doc[at:to], return_inverse=True)
                rows.append((b, keys[docs].tobytes(), n[docs].astype(np.uint32).tobytes(), local.astype(np.uint16).tobytes(), pack_tokens(h[at:to])))
        kinds = [("bucket", pa.int64()), *((c, pa.binary()) for c in ("sets", "sizes", "local", "tokens"))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], [n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            for _, held in slices(utf8_of(batch.column(0))):
                h, doc, n = shingle_sets(held, width)
                if parts and (sum(len(p[0]) for p in parts) > PACKED or sum(len(p[2]) for p in parts) + len(n) > 0xFFFF):
                    yield packed(parts)
                    parts = []
                    give_back()
                parts.append((h, doc, n, set_keys(h, doc, n)))
        if parts:
            yield packed(parts)
        parts = []
        give_back()

    return run


#: Parts that a bucket is sorted in, one after the other.
PARTS = 8


def _shared_tokens(buckets: int) -> Callable:
    """One bucket's postings in; out, per set bucket, the postings of tokens that two sets or more hold, with that number."""

    def of_part(token: np.ndarray, key: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((key, token))
        token, key, size = token[order], key[order], size[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key, size = token[new], key[new], size[new]
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        held = np.diff(np.append(start, len(token)))
        df = np.repeat(held, held)
        many = df > 1
        return token[many], key[many], size[many], np.minimum(df[many], 0xFFFFFFFF).astype(np.uint32)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.uint64(int(pdf["bucket"].iloc[0])) << np.uint64(8 * TOKEN_BYTES)
        token = np.concatenate([unpack_tokens(b) for b in pdf["tokens"]])
        at = [np.frombuffer(b, np.uint16) for b in pdf["local"]]
        key = np.concatenate([np.frombuffer(s, np.int64)[i] for s, i in zip(pdf["sets"], at, strict=True)])
        size = np.concatenate([np.frombuffer(s, np.uint32)[i] for s, i in zip(pdf["sizes"], at, strict=True)])
        part = (mix(token) % np.uint64(PARTS)).astype(np.uint8)
        found = [of_part(*(x[part == k] for x in (token, key, size))) for k in range(PARTS) if (part == k).any()]
        del token, key, size, part, at
        token, key, size, df = (np.concatenate([f[j] for f in found]) for j in range(4))
        del found
        home = (mix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(home, kind="stable")
        ends = np.searchsorted(home[order], np.arange(buckets + 1))
        rows = []
        for b in range(buckets):
            i = order[ends[b] : ends[b + 1]]
            if len(i):
                docs, local = np.unique(key[i], return_inverse=True)
                sizes = np.zeros(len(docs), np.uint32)
                sizes[local] = size[i]
                rows.append((b, docs.tobytes(), sizes.tobytes(), local.astype(np.uint32).tobytes(), mix(token[i] + own).tobytes(), df[i].tobytes()))
        del token, key, size, df, home, order
        give_back()
        return pd.DataFrame(rows, columns=["home", "sets", "sizes", "local", "tokens", "df"])

    return run


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Sets of n tokens that match anything share a token among so many of their rarest."""
    return n - -(-n * percent // 100) + 1


def _candidates(percent: int) -> Callable:
    """Sets of one home bucket: those that can match anything, with their shared tokens, rarest first.

    A set whose unshared tokens fill its prefix has no partner. `prefix` counts the shared tokens left in the prefix.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = [np.frombuffer(b, np.uint32) for b in pdf["local"]]
        key = np.concatenate([np.frombuffer(s, np.int64)[i] for s, i in zip(pdf["sets"], at, strict=True)])
        size = np.concatenate([np.frombuffer(s, np.uint32)[i] for s, i in zip(pdf["sizes"], at, strict=True)]).astype(np.int64)
        token = np.concatenate([np.frombuffer(b, np.uint64) for b in pdf["tokens"]])
        df = np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["df"]])
        order = np.lexsort((token, df, key))
        key, size, token = key[order], size[order], token[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        end = np.append(start[1:], len(key))
        n, shared = size[start], end - start
        prefix = prefix_length(n, percent) - (n - shared)
        rows = []
        for i in np.flatnonzero((prefix > 0) & (100 * shared >= percent * n)):
            t = token[start[i] : end[i]]
            a, b = (np.sort(mix(t ^ np.uint64(seed)))[:2] for seed in (0x1234567, 0x89ABCDE))
            rows.append((key[start[i]], n[i], prefix[i], *(int(x) for x in (a[0], a[-1], b[0], b[-1])), t.tobytes()))
        out = pd.DataFrame(rows, columns=["set_key", "n", "prefix", "a1", "a2", "b1", "b2", "tokens"])
        for c in ("a1", "a2", "b1", "b2"):
            out[c] = out[c].astype("uint64").to_numpy().view(np.int64) if len(out) else out[c].astype("int64")
        return out

    return run


CANDIDATE = "set_key long, n long, prefix long, a1 long, a2 long, b1 long, b2 long, tokens binary"


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common tokens of each left with each right list, by one sort of the right tokens."""
    token, owner = np.concatenate(right), np.repeat(np.arange(len(right)), [len(r) for r in right])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for i, t in enumerate(left):
        lo, hi = np.searchsorted(token, t, "left"), np.searchsorted(token, t, "right")
        if total := int((hi - lo).sum()):
            at = np.repeat(lo - np.append(0, np.cumsum(hi - lo)[:-1]), hi - lo) + np.arange(total)
            out[i] = np.bincount(owner[at], minlength=len(right))
    return out


def matches(common: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (n_left[:, None] + n_right[None, :] - common)


def _group_links(percent: int) -> Callable:
    """Sorted candidates in; links inside runs of at most GROUP sets, a spanning tree for each run's components.

    A run ends where the first minhash changes; its first set also joins the next run of the same minhash, so that a
    large set of copies hangs together.
    """

    def linked(held: list) -> Iterator[tuple]:
        token = [np.frombuffer(r.tokens, np.uint64) for r in held]
        n = np.array([r.n for r in held])
        left = list(range(len(held)))
        while len(left) > 1:  # breadth-first: each step opens the sets that the tree has just reached
            tree, left = [left[0]], left[1:]
            while tree and left:
                ok = matches(overlaps([token[i] for i in tree], [token[j] for j in left]), n[tree], n[left], percent)
                new = [(tree[int(ok[:, j].argmax())], left[j]) for j in range(len(left)) if ok[:, j].any()]
                for i, j in new:
                    yield held[i].set_key, held[j].set_key
                tree = [j for _, j in new]
                left = [j for j in left if j not in set(tree)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if held and (r.first != held[-1].first or len(held) >= GROUP):
                    out += linked(held)
                    held = held[:1] if r.first == held[-1].first else []
                held.append(r)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(list(linked(held)), columns=["a", "b"], dtype="int64")

    return run


GROUPS = "group long, pool long, root_size long, least long, most long, members array<long>, union binary, matrix array<struct<token:long,reach:long,least:long>>"


def _make_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sets sorted by pool: runs of at most GROUP sets of one pool become groups, named by a member, with their token union.

    Each token of the members' prefixes has a row in the group's matrix: `reach` is how many tokens a member still has
    from there on at most, `least` the smallest member with it.
    """
    held: list = []

    def flush(rows: list) -> tuple:
        token = np.concatenate([np.frombuffer(r.tokens, np.int64)[: r.prefix] for r in rows])
        reach = np.concatenate([len(r.tokens) // 8 - np.arange(min(r.prefix, len(r.tokens) // 8)) for r in rows])
        n = np.repeat([r.n for r in rows], [min(r.prefix, len(r.tokens) // 8) for r in rows])
        order = np.argsort(token, kind="stable")
        start = np.flatnonzero(np.append(True, token[order][1:] != token[order][:-1]))
        columns = token[order][start].tolist(), np.maximum.reduceat(reach[order], start).tolist(), np.minimum.reduceat(n[order], start).tolist()
        union = np.unique(np.concatenate([np.frombuffer(r.tokens, np.uint64) for r in rows])).tobytes()
        return rows[0].set_key, rows[0].pool, rows[0].root_size, min(r.n for r in rows), max(r.n for r in rows), [r.set_key for r in rows], union, [dict(zip(("token", "reach", "least"), x, strict=True)) for x in zip(*columns, strict=True)]

    columns = [c.split()[0] for c in GROUPS.split(", ")]
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if held and ((r.pool, r.root_size) != (held[-1].pool, held[-1].root_size) or len(held) >= GROUP):
                out.append(flush(held))
                held = []
            held.append(r)
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame([flush(held)] if held else [], columns=columns)


ASKS = "q_group long, q_part long, q_root long, q_n long, q_tokens binary"


def _bounded(percent: int) -> Callable:
    """A group's token union and the queries that met it: out come those whose overlap with the union suffices for a link."""

    def run(_: tuple, groups: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        union = np.frombuffer(groups["union"].iloc[0], np.uint64) if len(groups) else np.empty(0, np.uint64)
        enough = [len(union) > 0 and 100 * np.isin(np.frombuffer(t, np.uint64), union).sum() >= percent * n for n, t in zip(queries["q_n"], queries["q_tokens"], strict=True)]
        return queries.loc[np.array(enough, bool), [c.split()[0] for c in ASKS.split(", ")]]

    return run


def _opened(percent: int) -> Callable:
    """A group's members and the queries that its union lets in: out come the components to join, the query's with that of
    each member it matches."""

    def run(_: tuple, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        inside = [np.frombuffer(b, np.uint64) for b in members["tokens"]]
        n, roots = members["n"].to_numpy(), members["root"].to_numpy()
        out: set[tuple[int, int]] = set()
        for root, size, tokens in zip(queries["q_root"], queries["q_n"], queries["q_tokens"], strict=True) if inside else ():
            ok = matches(overlaps([np.frombuffer(tokens, np.uint64)], inside), np.array([size]), n, percent)[0]
            out |= {(int(root), int(x)) for x in np.unique(roots[ok]) if x != root}
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    return run


def candidate_sets(docs: DataFrame, text_col: str, width: int, percent: int, n_tokens: int) -> DataFrame:
    """The distinct sets that can link with another, with the tokens they share with any other set.

    n_tokens is what all rows' sets sum up to: buckets are as many as it takes for BUCKET_TOKENS each.
    """
    buckets = n_tokens // BUCKET_TOKENS + 1
    packed = docs.select(F.col(text_col).alias("text")).mapInArrow(_postings(width, buckets), "bucket long, sets binary, sizes binary, local binary, tokens binary")
    shared = packed.repartition(2 * buckets, "bucket").groupBy("bucket").applyInPandas(_shared_tokens(buckets), "home long, sets binary, sizes binary, local binary, tokens binary, df binary")
    return cut(shared.repartition(2 * buckets, "home").groupBy("home").applyInPandas(_candidates(percent), CANDIDATE))


def set_links(docs: DataFrame, text_col: str, width: int, percent: int, n_tokens: int) -> DataFrame:
    """(node, root) over set keys: components of the sets of texts that link with another set."""
    sets = candidate_sets(docs, text_col, width, percent, n_tokens)
    release(docs.sparkSession)
    links = []
    for first, second in (("a1", "a2"), ("b1", "b2")):
        dealt = sets.select("set_key", "n", "tokens", F.col(first).alias("first"), F.col(second).alias("second"))
        dealt = dealt.repartitionByRange("first", "second", "set_key").sortWithinPartitions("first", "second", "set_key")
        links.append(dealt.mapInPandas(_group_links(percent), "a long, b long"))
    near = cut(links[0].unionByName(links[1]))
    roots = connected(near)
    sized = beside(roots, ["root"], ["node"], root_size=F.count("*"))
    found = sets.join(sized, sets["set_key"] == sized["node"], "left").select("set_key", "n", "prefix", "tokens", "a1", F.coalesce("root", "set_key").alias("root"), F.coalesce("root_size", F.lit(1)).alias("root_size"))
    # A component is a pool of groups; sets without links so far are pooled by their first minhash.
    known = cut(found.withColumn("pool", F.when(F.col("root_size") > 1, F.col("root")).otherwise(F.col("a1"))).drop("a1"))
    dealt = known.repartitionByRange("pool", "set_key").sortWithinPartitions("pool", "root_size", "set_key")
    groups = cut(dealt.mapInPandas(_make_groups, GROUPS))
    matrix = groups.select("group", "pool", "root_size", F.col("least").alias("g_least"), "most", F.explode("matrix").alias("m")).select("group", "pool", "root_size", "g_least", "most", "m.*")
    asks = _prefix_rows(known)
    # Two pools meet once: sets of smaller components ask. A component needs no look at itself.
    first = (F.col("q_size") < F.col("root_size")) | ((F.col("q_size") == F.col("root_size")) & ((F.col("q_pool") < F.col("pool")) | ((F.col("q_pool") == F.col("pool")) & (F.col("root_size") == 1))))
    fits = (100 * F.col("n") >= percent * F.col("g_least")) & (100 * F.col("most") >= percent * F.col("n"))
    # From a shared token on, neither side may have too few tokens left to reach the overlap.
    enough = (100 + percent) * F.least("q_left", "reach") >= percent * (F.col("n") + F.col("least"))
    met = cut(asks.join(matrix, "token").where(first & fits & enough).select("set_key", "group").distinct())
    # A group that many sets meet is asked in parts of about ASKED queries, each of which has the group beside it.
    parts = F.ceil(F.col("asked") / ASKED)
    met = beside(met, ["group"], ["set_key"], asked=F.count("*")).select("group", F.pmod(F.xxhash64("set_key"), parts).alias("part"), F.col("set_key").alias("q_key"))
    met = cut(met)
    queries = met.join(known.select("set_key", F.col("root").alias("q_root"), F.col("n").alias("q_n"), F.col("tokens").alias("q_tokens")), F.col("q_key") == F.col("set_key"))
    queries = queries.select(F.col("group").alias("q_group"), F.col("part").alias("q_part"), "q_root", "q_n", "q_tokens")
    unions = met.select("group", "part").distinct().join(groups.select("group", "union"), "group")
    inside = cut(unions.groupBy("group", "part").cogroup(queries.groupBy("q_group", "q_part")).applyInPandas(_bounded(percent), ASKS))
    opened = inside.select(F.col("q_group").alias("group"), F.col("q_part").alias("part")).distinct().join(groups.select("group", "members"), "group").select("group", "part", F.explode("members").alias("set_key"))
    members = opened.join(known.select("set_key", "n", "tokens", "root"), "set_key")
    far = members.groupBy("group", "part").cogroup(inside.groupBy("q_group", "q_part")).applyInPandas(_opened(percent), "a long, b long")
    joined = connected(far)
    return roots.join(joined.withColumnsRenamed({"node": "j_node", "root": "j_root"}), F.col("root") == F.col("j_node"), "left").select("node", F.coalesce("j_root", "root").alias("root")).unionByName(joined)


def _prefix_rows(known: DataFrame) -> DataFrame:
    """(set_key, n, q_pool, q_size, token, q_left): each set's prefix tokens, and how many tokens it has from there on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                held = [np.frombuffer(t, np.int64)[:p] for t, p in zip(part["tokens"], part["prefix"], strict=True)]
                left = [len(t) // 8 - np.arange(len(h)) for t, h in zip(part["tokens"], held, strict=True)]
                rest = part[["set_key", "n", "pool", "root_size"]].rename(columns={"pool": "q_pool", "root_size": "q_size"})
                if held:
                    yield rest.loc[rest.index.repeat([len(x) for x in held])].assign(token=np.concatenate(held), q_left=np.concatenate(left))

    return known.mapInPandas(run, "set_key long, n long, q_pool long, q_size long, token long, q_left long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(k_id, k_text, n_shingles, component_id, root) for every row of docs; root tells components of equal smallest id apart.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set is its distinct `width`-word shingles, or
    its whole word sequence if shorter. Two documents link when 100 * |A and B| >= percent * |A or B|; component_id is the
    smallest id reachable by links. Texts without words (null, empty) have empty sets and link with nothing: their own id.
    Shingles are compared by 48 bits of hash and their bucket's, sets by 64 bits; equal sets are one node, so copies cost nothing.
    """
    sizes = F.arrow_udf(_sizes(width), "n long, set_key long")
    seen = cut(docs.select(*row_key(id_col, text_col), sizes(F.col(text_col)).alias("s")).select("k_id", "k_text", F.col("s.n").alias("n_shingles"), F.when(F.col("s.n") > 0, F.col("s.set_key")).alias("set_key")))
    n_tokens = seen.agg(F.sum("n_shingles")).first()[0] or 0
    roots = set_links(docs, text_col, width, percent, n_tokens)
    # A set that many rows have, and a component of many sets, send their smallest id back by parts.
    dealt = seen.withColumn("salt", salt("k_id", "k_text"))
    sets = dealt.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("k_id").alias("least"), salts_of("salt").alias("salts"))
    sets = cut(sets.join(roots, sets["set_key"] == roots["node"], "left").select("set_key", "least", "salts", F.coalesce("root", "set_key").alias("root")))
    told = beside(sets, ["root"], ["set_key"], component_id=F.min("least")).select("set_key", "salts", "root", "component_id")
    return dealt.join(per_salt(told), ["set_key", "salt"], "left").select("k_id", "k_text", "n_shingles", F.coalesce("component_id", "k_id").alias("component_id"), "root")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs without near copies: of each component the row with the smallest id stays (one row, if rows repeat it).

    A null id is the component's smallest only where it has no other. Texts without words all stay. All columns stay,
    whatever their names.
    """
    found = near_components(docs, id_col, text_col, width, percent)
    first = found.where(F.col("k_id").eqNullSafe(F.col("component_id")))
    alone = F.when(F.col("root").isNull(), F.col("k_text"))
    stays = cut(first.groupBy("k_id", "root", alone.alias("alone")).agg(F.min("k_text").alias("k_text"), F.count("*").alias("rows")))
    repeated = stays.where("rows > 1").limit(1).count()
    release(docs.sparkSession)
    keyed = docs.select(F.struct("*").alias("row"), *row_key(id_col, text_col))
    out = keyed.join(stays, same_key(keyed, stays), "left_semi").select("row.*")
    return out.dropDuplicates([id_col, text_col]) if repeated else out


def near_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; see near_components()."""
    found = near_components(docs.select("doc_id", "text"))
    return found.select(F.col("k_id").alias("doc_id"), "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
rows_ AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM rows_ a JOIN rows_ b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.b) AS component_id FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
