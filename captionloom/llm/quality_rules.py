"""Quality rules as weak supervision: rules vote or abstain, EM learns their accuracies, a posterior decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionloom.llm.common import IS_WORD, WS, Words, cut, give_back, quoted, slices, utf8_of

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_alpha_words long, n_lines long, n_distinct_words long, n_symbol_words long"
WINDOW = 5
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True


def measure(texts: list[bytes]) -> pd.DataFrame:
    """The counts of MEASURES for each text of a slice."""
    w = Words(texts)
    n = w.n_docs
    per_doc = lambda weights: np.add.reduceat(np.append(weights, 0), w.doc_start[:-1]).astype(np.int64)
    inside = IS_WORD[w.data]
    chars = per_doc(inside & ((w.data & 0xC0) != 0x80))
    hashes = w.hashes()
    by_word = hashes ^ (w.doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    _, first = np.unique(by_word, return_index=True)
    letters = np.cumsum(np.append(0, IS_LETTER[w.data]))
    symbols = np.cumsum(np.append(0, IS_SYMBOL[w.data]))
    alpha = (letters[w.end] - letters[w.start]) * 2 >= (w.end - w.start)
    h, at = w.shingles(WINDOW)
    covered = np.zeros(len(w.start) + 1, np.int64)
    if len(h):
        _, inverse, count = np.unique(h ^ (w.doc[at].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), return_inverse=True, return_counts=True)
        again = at[count[inverse] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + WINDOW, -1)
    repeat = np.cumsum(covered)[:-1] > 0
    lines, dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    strip = WS.encode()
    for i, t in enumerate(texts):
        full = [x for x in t.split(b"\n") if x.strip(strip)]
        lines[i], dup[i] = len(full), len(full) - len(set(full))
    count = lambda mask: np.bincount(w.doc[mask], minlength=n)
    return pd.DataFrame({"n_words": w.n_words, "word_chars": chars, "n_symbols": per_doc(IS_SYMBOL[w.data]), "n_dup_lines": dup, "n_repeat_words": count(repeat), "n_alpha_words": count(alpha), "n_lines": lines, "n_distinct_words": count(first), "n_symbol_words": count(symbols[w.end] > symbols[w.start])})


def _measures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = [x.split()[0] for x in MEASURES.split(", ")]
    for texts in batches:
        parts = [measure(held) for _, held in slices(utf8_of(texts))]
        columns = [np.concatenate([p[n].to_numpy() for p in parts]) if parts else np.empty(0, np.int64) for n in names]
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
        give_back()


def measures(text: Column) -> Column:
    """The struct MEASURES over the whole text; null and empty texts have none of anything."""
    return F.arrow_udf(_measures, MEASURES)(text)


#: The rules, in the order of their votes.
RULES = ("length", "symbols", "lines", "repeats", "word_length", "letters", "variety")


def rules(m: Column) -> dict[str, tuple[Column, ...]]:
    """Each rule's (votes bad, votes good[, votes bad for two reasons or more]); it abstains where neither holds.

    Votes are taken to be independent, so measures of the same thing are one rule: its strong vote says that they agree.
    """
    words = F.greatest(m["n_words"], F.lit(1))
    share = lambda c: m[c] / words
    length = m["word_chars"] / words
    lines = F.greatest(m["n_lines"], F.lit(1))
    long_enough = m["n_words"] >= 50
    many_symbols = (share("n_symbols") > 0.1, m["n_symbols"] > 0.02 * m["word_chars"], share("n_symbol_words") > 0.08)
    few_symbols = (share("n_symbols") < 0.03) & (m["n_symbols"] < 0.005 * m["word_chars"]) & (share("n_symbol_words") < 0.03)
    reasons = sum((c.cast("int") for c in many_symbols), F.lit(0))
    return {
        "length": (m["n_words"] < 10, m["n_words"] >= 30),
        "symbols": (reasons > 0, few_symbols, reasons > 1),
        "lines": (m["n_dup_lines"] / lines > 0.5, (m["n_dup_lines"] == 0) & (m["n_lines"] >= 2)),
        "repeats": (share("n_repeat_words") > 0.2, long_enough & (share("n_repeat_words") < 0.05)),
        "word_length": ((length < 2) | (length > 15), (length >= 3) & (length <= 10)),
        "letters": (share("n_alpha_words") < 0.6, share("n_alpha_words") > 0.8),
        "variety": (long_enough & (share("n_distinct_words") < 0.1), long_enough & (share("n_distinct_words") > 0.2)),
    }


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def vote_pattern(m: Column) -> Column:
    """All votes in one string: '=' (strongly bad), '-', '0' or '+' for each rule, in the order of rules()."""
    return F.concat(*[F.when(strong[0] if strong else F.lit(False), "=").when(bad, "-").when(good, "+").otherwise("0") for bad, good, *strong in rules(m).values()])


#: A rule's rates of strongly bad and of bad votes before any text is seen, for bad and for good texts; and how heavy that
#: prior is for either class, as a share of all votes. A false alarm on good texts is what the prior says as much as what
#: the votes say; how often a rule catches a bad text is left to the votes.
STARTS = ((0.4, 0.5), (0.0002, 0.03))
PRIOR_WEIGHTS = (0.01, 1.0)


def fitted(counts: dict[str, int], tolerance: float = 1e-9) -> tuple[dict[str, float], list[list[np.ndarray]], float]:
    """(posterior probability of good quality for each vote pattern, rates [bad, good] x [strong, bad] x rule, share of good
    texts), by expectation-maximisation until nothing moves.

    A rule that votes calls a bad text bad, and a good text bad, with probabilities of its own; abstaining says nothing.
    Rates are the most probable ones under a beta prior; none is cut off. The prior keeps the classes from changing places:
    bad texts may look good to most rules, good ones are seldom called bad. A pattern in which all rules abstain gets the
    share of good texts. RuntimeError if 100,000 steps are not enough.
    """
    if not counts:
        return {}, [], 0.8
    votes = np.array([list(p) for p in counts])
    n = np.array(list(counts.values()), float)
    strong, bad, fine = ((votes == v).astype(float) for v in "=-+")
    graded = strong.any(axis=0)
    rates = [[np.where(graded, s, 0.0), np.full(votes.shape[1], b)] for s, b in STARTS]
    prior, before = 0.8, None
    least = 1e-12
    for _ in range(100_000):
        log = [strong @ np.log(np.maximum(s, least)) + bad @ np.log(b) + fine @ np.log(np.maximum(1 - b - s, least)) for s, b in rates]
        good = 1 / (1 + np.exp(np.clip(log[0] + np.log(1 - prior) - log[1] - np.log(prior), -700, 700)))
        if before is not None and np.abs(good - before).max() < tolerance:
            return dict(zip(counts, map(float, good), strict=True)), rates, prior
        before = good
        prior = float((n @ good + 4) / (n.sum() + 5))
        for c, (weight, share) in enumerate(zip((n * (1 - good), n * good), PRIOR_WEIGHTS, strict=True)):
            given = weight @ (strong + bad + fine) + share * n.sum()
            rates[c] = [np.where(graded | (k == 1), (weight @ v + share * n.sum() * start) / given, 0.0) for k, (v, start) in enumerate(zip((strong, bad), STARTS[c], strict=True))]
    raise RuntimeError("the rules' accuracies don't settle")


def fit_label_model(counts: dict[str, int], tolerance: float = 1e-9) -> dict[str, float]:
    """The posteriors of fitted()."""
    return fitted(counts, tolerance)[0]


def rule_rates(counts: dict[str, int]) -> list[dict]:
    """What fitted() says of each rule: the shares of bad and of good texts it calls bad, strongly and in all."""
    _, rates, _ = fitted(counts)
    return [{"rule": r, "caught": float(rates[0][0][k] + rates[0][1][k]), "strongly": float(rates[0][0][k]), "false_alarms": float(rates[1][0][k] + rates[1][1][k])} for k, r in enumerate(RULES)] if rates else []


def judged(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, carried: list[str] | None = None) -> DataFrame:
    """(row, m, base_failed, posterior, kept) for every row of docs; row holds all its columns, or those that are carried.

    A row is kept if the base rules pass and its posterior reaches the threshold. Null and empty texts have no words and
    fail. Measures are taken once and written with the rows; only the counts of vote patterns reach the driver: at most
    4 * 3 ** 6 of them, whatever the input's size.
    """
    names = docs.columns if carried is None else carried
    row = F.struct(*[F.col(quoted(c)) for c in names]) if names else F.struct(F.lit(None).alias("none"))
    seen = cut(docs.select(row.alias("row"), measures(F.col(text_col)).alias("m")).withColumn("pattern", vote_pattern(F.col("m"))))
    posterior = fit_label_model({r["pattern"]: r["count"] for r in seen.groupBy("pattern").count().collect()})
    table = docs.sparkSession.createDataFrame(sorted(posterior.items()), "p string, posterior double")
    both = seen.join(F.broadcast(table), seen["pattern"] == table["p"], "left")
    failed = base_failed(F.col("m"))
    return both.select("row", "m", failed.alias("base_failed"), "posterior", (~failed & (F.coalesce("posterior", F.lit(0.0)) >= threshold)).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that judged() keeps, with all their columns, repeated rows as often as they come. Null texts and
    texts without words go; an empty table gives no rows."""
    return judged(docs, text_col, threshold).where("kept").select("row.*")


def quality_report(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept, posterior) of every row; null and empty texts have counts of 0 and fail."""
    out = judged(docs, carried=["doc_id"])
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select(F.col("row.doc_id").alias("doc_id"), *[F.col("m")[c].alias(c) for c in counts], "base_failed", "kept", "posterior")
