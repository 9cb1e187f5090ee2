"""Operators on documents against brute force, on a fixture of hard rows: nulls, empties, ties, repeats, long texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from captionloom.llm import common, line_dedup, mixing, ngram_join, pieces, quality_rules, suffix_dedup
from captionloom.llm.components import connected
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, row string, k_id int, text_2 string"


def fixture_rows():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeéß日") for _ in range(r.randint(1, 7)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    passage = sentence(70)
    rows = [(0, None), (1, ""), (2, "   \n\t "), (3, "two words"), (4, "Two  WORDS"), (None, "no id at all but some words here to read"), (5, "x" * 5000), (6, "A shared line of text here\nshort\nown " + sentence(30)), (7, "a shared line of text here \nshort\nown " + sentence(30)), (8, "  A SHARED line of text here\n" + sentence(12)), (9, "dup\ndup\n" + sentence(20))]
    base = sentence(120)
    for i in range(10, 40):
        w = base.split(" ")
        for _ in range(i % 4):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(i, base) for i in range(40, 50)]
    rows += [(i, sentence(r.randint(20, 80)) + "\n" + passage + "\n" + sentence(r.randint(20, 80))) for i in range(50, 70)]
    rows += [(i, sentence(r.randint(1, 300))) for i in range(70, 100)]
    rows += [(100, "abcdefghij" * 60), (101, sentence(40) * 3), (101, "the same id with another text " + sentence(9)), (60, rows[61][1]), (102, base), (102, base)]
    rows += [(103, "### $$ %%% " * 40), (104, (sentence(2000) + "\n") * 2)]
    return rows


ROWS = fixture_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if k % 7 == 0 else f"s{k % 3}", "row", k, "x") for k, (i, t) in enumerate(ROWS)], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, expected):
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_ngram_join(docs, empty):
    got = [tuple(r)[:3] for r in ngram_join.near_report(docs).collect()]
    want = brute.components(ROWS)
    same(got, [(i, len(brute.shingles(t)), want[k]) for k, (i, t) in enumerate(ROWS)])
    assert ngram_join.near_report(empty).count() == 0


def test_runs_longer_than_a_group_hang_together(monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP", 3)
    r = random.Random(6)
    core = [r.getrandbits(62) for _ in range(100)]
    sets = [sorted(core[: 100 - k % 4] + [r.getrandbits(62) for _ in range(k % 5)]) for k in range(20)]
    pdf = pd.DataFrame({"set_key": range(20), "n": [len(x) for x in sets], "tokens": [np.array(x, np.uint64).tobytes() for x in sets], "first": 1, "second": range(20)})
    links = pd.concat(ngram_join._group_links(80)(iter([pdf.iloc[:7], pdf.iloc[7:]])))
    reached = {0}
    for _ in range(20):
        reached |= {b for a, b in links.itertuples(index=False) if a in reached} | {a for a, b in links.itertuples(index=False) if b in reached}
    assert reached == set(range(20)) and len(links) == 19


def test_groups_keep_every_prefix_token(monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP", 2)
    pdf = pd.DataFrame({"set_key": [1, 2, 3, 4], "n": [9, 8, 7, 6], "prefix": [2, 9, 1, 2], "tokens": [np.array(t, np.uint64).tobytes() for t in ([5, 6, 7], [6, 8], [5, 9], [9, 5, 6])], "pool": [1, 1, 1, 4], "root": [1, 1, 1, 4], "root_size": [3, 3, 3, 1]})
    out = pd.concat(ngram_join._make_groups(iter([pdf.iloc[:1], pdf.iloc[1:]])))
    got = {g: (list(m), {(x["token"], x["reach"], x["least"]) for x in t}) for g, m, t in zip(out["group"], out["members"], out["matrix"], strict=True)}
    assert got == {1: ([1, 2], {(5, 3, 9), (6, 2, 8), (8, 1, 8)}), 3: ([3], {(5, 2, 7)}), 4: ([4], {(9, 3, 6), (5, 2, 6)})}


def test_every_window_is_in_one_run():
    r = random.Random(7)
    texts = [None, "a" * 199, "b" * 200, "".join(r.choice("abcd") for _ in range(1500)), "xyz" * 300]
    for most in (60, 301, 5000):
        seen = []
        for held in suffix_dedup.pieces(texts, most):
            for x in suffix_dedup.anchored_runs(held).itertuples(index=False):
                seen += [(x.row, x.start + k) for k in range(x.n)]
        assert sorted(seen) == [(i, k) for i, t in enumerate(texts) for k in range(len(t or "") - 199)]


def test_drop_near_copies(docs):
    got = ngram_join.drop_near_copies(docs)
    assert got.columns == docs.columns
    want = brute.components(ROWS)
    same({(r.doc_id, r.text) for r in got.collect()}, {(i, t) for k, (i, t) in enumerate(ROWS) if i == want[k] and (t, i) == min((x, j) for m, (j, x) in enumerate(ROWS) if want[m] == want[k] and j == i and x == t)})


def test_suffix_dedup(docs, empty):
    got = [tuple(r) for r in suffix_dedup.suffix_report(docs).collect()]
    same(got, [(i, n, gone, runs, sha(left)) for (i, _), (n, gone, runs, left) in zip(ROWS, brute.repeated_bytes([t for _, t in ROWS]), strict=True)])
    assert suffix_dedup.suffix_report(empty).count() == 0


def test_suffix_dedup_hot_anchor(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    got = [tuple(r) for r in suffix_dedup.suffix_report(docs).collect()]
    same(got, [(i, n, gone, runs, sha(left)) for (i, _), (n, gone, runs, left) in zip(ROWS, brute.repeated_bytes([t for _, t in ROWS]), strict=True)])


def test_suffix_dedup_short_periods():
    """Separators and leaders before what two texts share, in all lengths: each repeated window is found by the sort."""
    r = random.Random(11)
    plain = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    missed = []
    for unit in ("-", ". ", "- -", " \t ", "=-=-+", "abcdefghi"):
        for length in (0, 5, 8, 17, 64, 70, 131, 199, 200, 230):
            mark, shared = (unit * length)[:length], plain(400)
            texts = [plain(r.randint(1, 90)) + mark + shared + mark + plain(r.randint(1, 90)) for _ in range(2)] + [plain(30) + mark + shared[:205] + plain(90), plain(40) + mark + plain(300)]
            windows = [[t[k : k + 200] for k in range(len(t) - 199)] for t in texts]
            count = Counter(w for x in windows for w in x)
            runs = pd.concat([suffix_dedup.anchored_runs(held) for held in suffix_dedup.pieces(texts, 5000)])
            segments = [texts[x.row][x.start : x.start + x.n + 199].encode() for x in runs.itertuples()]
            hit = suffix_dedup.repeated_windows(segments, runs["n"].to_numpy(), runs["anchor"].to_numpy())
            at = [(x.row, x.start + k) for x in runs.itertuples() for k in range(x.n)]
            missed += [(unit, length, *p) for p, h in zip(at, hit, strict=True) if h != (count[windows[p[0]][p[1]]] > 1)]
    assert not missed


def test_suffix_dedup_separators(spark):
    r = random.Random(12)
    plain = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    texts = []
    for length in (9, 70, 150):
        shared = plain(400)
        texts += [plain(r.randint(20, 90)) + c * length + shared + plain(50) for c in "-." for _ in range(2)]
    got = [tuple(r) for r in suffix_dedup.suffix_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    same(got, [(i, n, gone, runs, sha(left)) for i, (n, gone, runs, left) in enumerate(brute.repeated_bytes(texts))])


def test_line_dedup(docs, empty):
    got = [tuple(r) for r in line_dedup.line_dedup_report(docs).collect()]
    same(got, [(i, n, gone, sha(text.encode())) for (i, _), (n, gone, text) in zip(ROWS, brute.kept_lines(ROWS), strict=True)])
    assert line_dedup.line_dedup_report(empty).count() == 0
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    same([(r.doc_id, r.text) for r in kept.collect()], [(i, text) for (i, _), (_, _, text) in zip(ROWS, brute.kept_lines(ROWS), strict=True)])


def test_quality_rules(docs, empty):
    rows = quality_rules.quality_report(docs).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows], [(i, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]) for i, m in ((i, brute.measures(t)) for i, t in ROWS)])
    by = {r.doc_id: r.kept for r in rows}
    assert not by[103] and by[10] and by[55] and not by[0] and not any(r.kept for r in rows if r.base_failed)
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.quality_report(empty).count() == 0


def test_label_model_finds_the_careless_rule():
    r = random.Random(1)
    counts = {}
    for _ in range(4000):
        good = r.random() < 0.7
        votes = "".join("0" if r.random() < 0.2 else "-" if (r.random() < p if not good else r.random() < q) else "+" for p, q in ((0.9, 0.01), (0.8, 0.01), (0.3, 0.04)))
        counts[votes] = counts.get(votes, 0) + 1
    p = quality_rules.fit_label_model(counts)
    assert p["+++"] > 0.9 and p["--+"] < 0.1 and p["++-"] > p["-++"]
    assert quality_rules.fit_label_model({}) == {}


def test_label_model_recovers_planted_accuracies():
    """For every rule: what it catches of bad texts is what was planted, and its false alarms lie between that and the prior."""
    r = random.Random(3)
    planted = [(0.9, 0.03), (0.75, 0.02), (0.6, 0.04), (0.45, 0.03), (0.8, 0.03), (0.3, 0.02), (0.55, 0.03)]
    counts = {}
    for _ in range(30_000):
        good = r.random() < 0.8
        votes = "".join("0" if r.random() < 0.25 else ("-" if r.random() < (q if good else p) else "+") for p, q in planted)
        counts[votes] = counts.get(votes, 0) + 1
    _, rates, prior = quality_rules.fitted(counts)
    assert abs(prior - 0.8) < 0.02
    for k, (p, q) in enumerate(planted):
        assert abs(rates[0][1][k] - p) < 0.04 and abs(rates[1][1][k] - (q + 0.03) / 2) < 0.01
    told = quality_rules.rule_rates(counts)
    assert [t["rule"] for t in told] == list(quality_rules.RULES) and all(t["caught"] > t["false_alarms"] for t in told)


def test_repeats_of_a_row_share_their_spans(spark):
    """Twenty thousand rows of one id and text: each span once, not once a row."""
    from pyspark.sql import functions as F

    text = "".join(f"{k} and {k * k}, " for k in range(60))
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    cut = suffix_dedup.cut_documents(rows)
    assert cut.count() == 20_000 and cut.agg(F.max(F.size("spans"))).first()[0] <= 24
    assert {tuple(r) for r in suffix_dedup.suffix_report(rows.limit(3)).select("n_bytes", "n_removed", "n_spans").collect()} == {(len(text), len(text), 1)}


def test_rules_are_named_in_order(spark):
    from pyspark.sql import functions as F

    assert tuple(quality_rules.rules(F.col("m"))) == quality_rules.RULES


def test_mixing(docs, empty):
    rows = mixing.mix_report(docs).collect()
    sizes = {}
    by_row = {}
    for k, (i, t) in enumerate(ROWS):
        s, n = None if k % 7 == 0 else f"s{k % 3}", len(brute.WORD.findall(t or ""))
        sizes[s] = sizes.get(s, 0) + n
        by_row.setdefault((i, n), []).append(s)
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight, live = dict(zip(order, (3, 1, 2, 3), strict=True)), set(order)
    left, target = 1.5 * sum(sizes.values()), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in live) for s in live}
        over = [s for s in live if share[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            live.discard(s)
    target |= share
    assert len(rows) == len(ROWS)
    taken, size_of = {}, {v: k for k, v in sizes.items()}
    for r in rows:
        s = size_of[r.source_size]
        assert abs(r.target - target[s]) < 1e-6 * target[s] and 0 <= r.taken <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] / target[s] - 1) < 0.01 for s in order)
    again = mixing.mix_report(docs.repartition(3)).collect()
    same(rows, again)
    assert mixing.mix_report(empty).count() == 0
    out = mixing.mix_sources(docs)
    assert out.columns == docs.columns
    assert sum(len(brute.WORD.findall(r.text or "")) for r in out.collect()) == sum(taken.values())


def test_pieces(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = pieces.pieces_report(docs).collect()
    same([(r.doc_id, r.token_ids, r.round_trip) for r in rows], [(i, sp.encode(t or ""), True) for i, t in ROWS])
    assert pieces.pieces_report(empty).count() == 0
    v = pieces.vocabulary(pieces.MODEL)
    odd = ["", "  a  b\n\nc ", "▁", "the▁cat", " " * 40 + "x", " " * 17, "a" * 500, "\x00a", "<s> <unk> <0x0A>", "日本語 𝄞 ﬁ Å", "é" * 50 + "  " + "日" * 9]
    assert [i.tolist() for i in pieces.encode_batch(v, odd)] == [sp.encode(t) for t in odd]
    assert [pieces.decode_ids(v, i) for i in pieces.encode_batch(v, odd)] == [t.replace("▁", " ") if t != "▁" else " " for t in odd]
    back = pieces.encode_documents(docs).select(pieces.decode_column(pieces.MODEL)("token_ids").alias("t"), "text")
    assert all(r.t == (r.text or "") for r in back.collect())


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in parent} == {n: find(n) for n in parent}


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
