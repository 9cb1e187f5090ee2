"""Operator 12 against plain loops, and what its bounds save."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from captionloom.llm import lexical_search as ls

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, limit=20):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    counted = [c for c in counted if c[2]]
    n_docs, n_terms = len(counted), sum(c[2] for c in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in sorted({x for x in items if x[1] is not None}, key=repr):
        scored = []
        for i, c, n in counted:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(scored)[:limit], 1)]
    return sorted(out, key=repr)


def corpus(seed, n, words):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)] + ["Straße", "naïve", "東京", "x1"]
    text = lambda most: r.choice([" ", "-", "\n", "."]).join(r.choice(vocabulary[: r.choice([5, 40, len(vocabulary)])]) for _ in range(r.randrange(1, most)))
    return [(k, text(60)) for k in range(n)], [(k, text(25)) for k in range(30)]


def table(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("paired", [True, False])
def test_equals_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(ls, "SHARD_DOCS", 20)
    docs, items = corpus(1, 700, 300)
    docs += docs[:40] * 3 + [(1000 + k, docs[5][1]) for k in range(30)]  # rows that repeat, and texts that tie
    got = ls.search(*table(spark, docs, items), limit=7, items_part=8, paired=paired)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, 7)


def test_hard_rows(spark):
    docs = [(1, None), (2, ""), (3, "-- \x00\x7f !"), (None, "Alpha beta"), (4, "alpha beta"), (5, "ALPHA beta"), (6, "alpha " * 50_000), (7, "É é ÀB àb"), (7, "beta gamma"), (8, "alpha\x00beta"), (9, "퟿ gamma 0")]
    items = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, ""), (4, "nothing here"), (None, "gamma"), (5, "É ÀB gamma gamma"), (1, "beta beta ALPHA")]
    d, i = table(spark, docs, items)
    clash = d.withColumn("item_id", F.lit(5)).withColumn("term", F.lit("x")).withColumn("a.b", F.lit(1)), i.withColumn("doc_id", F.lit(3)).withColumn("own", F.lit("y"))
    want = brute(docs, items)
    assert sorted(map(tuple, ls.search_report(*clash).collect()), key=repr) == want
    for none in ((d.where("false"), i), (d, i.where("false")), (d.where("text = ''"), i), (d, i.where("text = ''"))):
        assert ls.search_report(*none).count() == 0


def test_terms_are_those_of_the_pattern():
    r = random.Random(3)
    texts = ["".join(r.choice("aZ09_-.'\n\t \x00\x7fé東ß  ") for _ in range(r.randrange(0, 40))) for _ in range(300)]
    doc, hashes = ls.term_hashes([t.encode() for t in texts])
    want = [(k, t) for k, text in enumerate(texts) for t in terms(text)]
    assert doc.tolist() == [k for k, _ in want]
    name = {}
    for h, (_, t) in zip(hashes.tolist(), want, strict=True):
        assert name.setdefault(t, h) == h
    assert len(set(name.values())) == len(name)


def shard_of(docs, items, paired=True):
    """One shard of some documents, opened, without Spark."""
    seen = {}
    for k, (_, t) in enumerate(docs):
        for x in terms(t):
            seen.setdefault(x, Counter())[k] += 1
    names = sorted(seen)
    n = np.array([len(terms(t)) for _, t in docs])
    weight = {x: math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * len(seen[x]) + 1))) for x in names}
    held = [(k, k, [{"term": names.index(x), "qtf": c, "w": weight[x]} for x, c in Counter(terms(t)).items() if x in seen]) for k, t in items]
    import pyarrow as pa

    row = {
        "l": [0], "doc_id": [[i for i, _ in docs]], "n": [n.astype(np.int64).tobytes()], "terms": [np.arange(len(names)).tobytes()], "starts": [np.cumsum([0, *(len(seen[x]) for x in names)]).astype(np.int32).tobytes()],
        "docs": [np.array([d for x in names for d in sorted(seen[x])], np.int32).tobytes()], "tf": [np.array([seen[x][d] for x in names for d in sorted(seen[x])], np.int32).tobytes()],
    }
    asked = pa.table({"own": [h[0] for h in held], "item_id": [h[1] for h in held], "held": [h[2] for h in held], "r": [0] * len(held)})
    return ls.pair_index(len(docs), int(n.sum()))(pa.table(row), asked).to_pylist()[0], held


def test_pairs_open_fewer_postings():
    """Terms that never meet: a pair's bound is the greater of the two, so more postings are left unread."""
    r = random.Random(5)
    docs = [(k, " ".join([f"t{r.randrange(8)}" for _ in range(3)] + ["common"] * r.randrange(3) + ["filler"] * 20)) for k in range(3000)]
    docs += [(5000 + k, "t0 t1 t2 t3 t4 t5 t6 t7 common") for k in range(10)]
    row, held = shard_of(docs, [(0, "t0 t1 t2 t3 t4 t5 t6 t7 common")])
    spent = {}
    for paired in (True, False):
        s = ls.Shard(row)
        term, qtf, w = (np.array([x[k] for x in held[0][2]], np.int64) for k in ("term", "qtf", "w"))
        d, score = s.best(term, qtf, w, 5, 0, paired)
        spent[paired] = s.opened
        best = np.lexsort((d, -score))[:5]
        assert [docs[k][0] for k in d[best]] == [i for _, _, i, _ in brute(docs, [(0, "t0 t1 t2 t3 t4 t5 t6 t7 common")], 5)]
    assert spent[True] <= spent[False] < sum(len(terms(t)) for _, t in docs)


def test_joint_maximum_is_that_of_the_intersection():
    docs = [(0, "a b"), (1, "a a a c"), (2, "b b b c"), (3, "c d")]
    row, held = shard_of(docs, [(0, "a b")])
    s = ls.Shard(row)
    (pair,) = s.pair.values()
    assert s.pair_docs.tolist() == [0] and s.pair_starts.tolist() == [0, 1]
    w = {x["term"]: x["w"] for x in held[0][2]}
    assert s.joint[pair] == sum(w[int(t)] * int(s.looked_up(k, np.array([0]))[0]) for k, t in enumerate(s.terms))


def test_filter_lets_all_wanted_terms_through(spark):
    _, items = corpus(2, 1, 500)
    words = ls.item_terms(table(spark, [(0, "")], items)[1], "item_id", "text")
    kept = ls.term_filter(words)
    assert kept[ls._slot(np.array([r.term for r in words.collect()], np.int64).view(np.uint64))].all() and kept.mean() < 0.001
