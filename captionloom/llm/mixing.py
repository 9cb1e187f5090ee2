"""Mixing sources to target weights: entropy balancing solved by distributed Newton steps, then rounded into copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionloom.llm.common import SALTS, WORD, cut, row_key, salt, same_key

#: Source weights, repeating over the sources in code point order, null last.
WEIGHTS = (3.0, 1.0, 2.0)
#: Documents that one rounding group holds; sources are split into as many groups as they need.
GROUP = 512
#: Newton's method and bisection end long before this; if not, an error says so.
NEWTON_STEPS, TOLERANCE = 300, 1e-8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows with sums over all rows that come before them in a total order: within ranges of the order by a window, across
    ranges by one row each, so no task sees all rows."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).withColumns({f"_{n}": c for n, c in sums.items()}))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(*[F.sum(f"_{n}").alias(f"_{n}_all") for n in sums])
    ranges = ranges.select("_range", *[F.coalesce(F.sum(f"_{n}_all").over(ahead), F.lit(0)).alias(f"_{n}_ahead") for n in sums])
    both = dealt.join(F.broadcast(ranges), "_range")  # a row per range: as many as shuffle partitions
    return both.withColumns({n: F.col(f"_{n}_ahead") + F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) for n in sums}).select(*rows.columns, *sums)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, n_rows, n_units, target) from a histogram (source, size, n, units).

    `share` times all sizes is dealt by weight; no target passes `most` times its source's size, and the excess is
    dealt again by weight. That fixed point is min(cap, weight * level), so one pass over the sources sorted by cap per
    weight finds it. Works on one row per source, in ranges; two numbers reach the driver. A null source is a source.
    """
    by_source = cut(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_rows"), F.sum("units").alias("n_units")))
    placed = running(by_source, [F.asc_nulls_last("source")], place=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    dealt = placed.withColumn("weight", weight).drop("place").withColumn("cap", most * F.col("source_size"))
    dealt = running(cut(dealt), [(F.col("cap") / F.col("weight")).asc(), F.asc_nulls_last("source")], cap_before=F.col("cap"), weight_before=F.col("weight"))
    sums = by_source.agg(F.sum("source_size").alias("size"), F.count("*").alias("n")).first()
    n, rest = divmod(sums["n"], len(weights))
    total_weight = n * sum(weights) + sum(weights[:rest])
    level = (share * (sums["size"] or 0) - F.col("cap_before")) / (total_weight - F.col("weight_before"))
    leveled = dealt.withColumn("level", level).where(F.col("cap") > F.col("weight") * F.col("level"))
    first = leveled.agg(F.min_by("level", F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source"))).first()[0]
    target = F.col("cap") if first is None else F.least("cap", F.col("weight") * F.lit(float(first)))
    return dealt.select("source", "source_size", "n_rows", "n_units", target.alias("target"))


def tilted_rate(size: Column, tilt: Column, mean: Column, most: float) -> Column:
    """How often the mix takes a document on average: min(most, exp(tilt * size / mean size)); 1 where nothing is to tilt."""
    x = tilt * size / mean
    return F.when(tilt.isNull() | (size == 0), 1.0).when(x < F.log(F.lit(most)), F.exp(x)).otherwise(most)


def solved_tilts(sizes: DataFrame, targets: DataFrame, most: float = 2.0) -> DataFrame:
    """(source, tilt, mean): the tilt at which the rates' token sum meets each source's target, from a histogram (source, size, n).

    The tilt of a source is the dual variable of its token constraint. Every Newton step is one distributed aggregation
    over the histogram; steps are taken on the log of the sum and fall back to bisection where they would leave the
    bracket. Goes on until every source is within TOLERANCE; RuntimeError if that doesn't happen. Sources without tokens
    have no row.
    """
    hist = sizes.select("source", "size", "n")
    live = targets.where(F.col("source_size") > 0).withColumn("mean", F.col("source_size") / F.col("n_rows"))
    state = cut(live.select("source", "target", "mean", "source_size", F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("miss")))
    x = F.col("size") / F.col("mean")
    free = F.col("tilt") * x < F.log(F.lit(most))
    rate = F.when(free, F.exp(F.col("tilt") * x)).otherwise(most)
    for _ in range(NEWTON_STEPS):
        both = hist.join(state, hist["source"].eqNullSafe(state["source"])).select(state["source"], "size", "n", "target", "mean", "source_size", "tilt", "low", "high")
        tokens = F.col("n") * F.col("size") * rate
        sums = both.groupBy("source", "target", "mean", "source_size", "tilt", "low", "high").agg(F.sum(tokens).alias("s"), F.sum(F.when(free, tokens * x).otherwise(0.0)).alias("slope"))
        over = F.col("s") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
        full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
        newton = F.col("tilt") - F.log(F.col("s") / F.col("target")) * F.col("s") / F.col("slope")
        inside = (F.col("slope") > 0) & (F.col("low2").isNull() | (newton > F.col("low2"))) & (F.col("high2").isNull() | (newton < F.col("high2")))
        middle = F.when(F.col("low2").isNull(), F.least(F.lit(-1.0), 2 * F.col("tilt"))).when(F.col("high2").isNull(), F.greatest(F.lit(1.0), 2 * F.col("tilt"))).otherwise((F.col("low2") + F.col("high2")) / 2)
        miss = F.when(full, 0.0).otherwise(F.abs(F.col("s") / F.col("target") - 1))
        step = F.when(full, F.lit(float("inf"))).when(miss < TOLERANCE, F.col("tilt")).when(inside, newton).otherwise(middle)
        state = cut(sums.withColumns({"low2": low, "high2": high}).select("source", "target", "mean", "source_size", step.alias("tilt"), F.col("low2").alias("low"), F.col("high2").alias("high"), miss.alias("miss")))
        worst = state.agg(F.max("miss")).first()[0] or 0.0
        if worst < TOLERANCE:
            return state.select("source", "tilt", "mean")
    raise RuntimeError(f"a source's tokens still miss its target by a share of {worst}")


def copies_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 2) -> DataFrame:
    """(source, k_id, k_text, size, n_rows, source_size, target, copies, extra): how often the mix takes each document.

    Rows that repeat source, id and text are one unit of n_rows rows, each taken `copies` times, and `extra` of them once
    more. Units are dealt by hash into groups of about GROUP; a group goes from its largest document to its smallest and
    gives each unit as many copies in all as make the words taken follow the sum of rates, so a group's error is about half
    its smallest document, however often rows repeat. No sampling: reruns agree.
    Null ids and sources are values; null texts and texts without words have size 0 and are taken once.
    """
    sized = docs.select(F.col(source_col).alias("source"), *row_key(id_col, text_col), word_count(F.col(text_col)).alias("size"))
    units = cut(sized.groupBy("source", "k_id", "k_text").agg(F.first("size").alias("size"), F.count("*").alias("n_rows")))
    hist = cut(units.groupBy("source", "size").agg(F.sum("n_rows").alias("n"), F.count("*").alias("units")))
    targets = cut(source_targets(hist, most=float(most)))
    tilts = solved_tilts(hist, targets, float(most)).withColumnRenamed("source", "s_source")
    known = targets.join(tilts, targets["source"].eqNullSafe(tilts["s_source"]), "left").select(F.col("source").alias("t_source"), "source_size", "target", "tilt", "mean", F.greatest(F.lit(1), F.ceil(F.col("n_units") / GROUP)).alias("groups"))
    # Small tables of sources are broadcast by size; others meet their units in parts, so that a large source fills no task.
    known = cut(known).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = units.withColumn("u_salt", salt("k_id", "k_text"))
    rated = dealt.join(known, dealt["source"].eqNullSafe(known["t_source"]) & (dealt["u_salt"] == known["salt"]))
    rate = tilted_rate(F.col("size"), F.col("tilt"), F.col("mean"), float(most))
    unit = F.struct((-F.col("size")).alias("order"), "k_id", "k_text", "size", "n_rows", rate.alias("rate"))
    rated = rated.select("source", "source_size", "target", F.pmod(F.xxhash64("k_id", "k_text"), "groups").alias("part"), unit.alias("unit"))
    held = rated.groupBy("source", "source_size", "target", "part").agg(F.array_sort(F.collect_list("unit")).alias("units"))

    def rounded(acc: Column, u: Column) -> Column:
        want = acc["want"] + u["rate"] * (u["size"] * u["n_rows"]).cast("double")
        wished = F.round((want - acc["taken"]) / u["size"].cast("double"))
        copies = F.when(u["size"] == 0, u["n_rows"]).otherwise(F.least((most * u["n_rows"]).cast("double"), F.greatest(F.lit(0.0), wished)).cast("long"))
        return F.struct(want.alias("want"), (acc["taken"] + (copies * u["size"]).cast("double")).alias("taken"), F.concat(acc["copies"], F.array(copies)).alias("copies"))

    start = F.struct(F.lit(0.0).alias("want"), F.lit(0.0).alias("taken"), F.array().cast("array<long>").alias("copies"))
    folded = held.withColumn("copies", F.aggregate("units", start, rounded)["copies"])
    flat = folded.select("source", "source_size", "target", F.explode(F.arrays_zip("units", "copies")).alias("u"))
    each = F.expr("u.copies div u.units.n_rows").cast("int")
    return flat.select("source", "u.units.k_id", "u.units.k_text", "u.units.size", "u.units.n_rows", "source_size", "target", each.alias("copies"), (F.col("u.copies") % F.col("u.units.n_rows")).alias("extra"))


def repeated(rows: DataFrame, n: str, nth: str = "nth") -> DataFrame:
    """Each row n times, numbered from 0, however large n is: no array of more than 4,096 numbers or n / 4,096 is built."""
    most = 4096
    outer = rows.withColumn("_outer", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {most}"))))
    inner = outer.withColumn("_inner", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(most), F.col(n) - most * F.col("_outer")) - 1)))
    return inner.withColumn(nth, most * F.col("_outer") + F.col("_inner")).drop("_outer", "_inner")


KEY = ["k_source", "k_id", "k_text"]


def numbered(rows: DataFrame) -> DataFrame:
    """rows (KEY, at, ...) with `nth`, their number from 0 among the rows of their key. at says where a row was read: its
    upper bits are the partition, so a key's rows are numbered in parts, and the parts by the counts before them."""
    dealt = cut(rows.withColumn("part", F.shiftright("at", 33)))
    counts = dealt.groupBy(*KEY, "part").agg(F.count("*").alias("n"))  # a row a key and partition
    before = Window.partitionBy(*KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*KEY, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    here = F.row_number().over(Window.partitionBy(*KEY, "part").orderBy("at")) - 1
    placed = dealt.withColumn("here", here)
    return placed.join(counts, same_key(placed, counts, (*KEY, "part"))).select(*[placed[c] for c in rows.columns], (F.col("here") + F.col("ahead")).alias("nth"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 2) -> DataFrame:
    """docs as the mix takes them: each row as often as copies_plan() says, zero times included; columns stay.

    Null ids, texts and sources are values, texts without words are taken once, an empty table gives no rows. Of rows that
    repeat, those read first are the ones taken once more; they are numbered only where a plan has such.
    """
    plan = copies_plan(docs, id_col, text_col, source_col, most).select(F.col("source").alias("k_source"), "k_id", "k_text", "copies", "extra")
    plan = cut(plan)
    keyed = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("k_source"), *row_key(id_col, text_col), F.monotonically_increasing_id().alias("at"))
    even, odd = plan.where("extra = 0 AND copies > 0"), plan.where("extra > 0")
    taken = keyed.join(even, same_key(keyed, even, KEY)).select("row", "copies")
    if odd.limit(1).count():
        both = keyed.join(odd, same_key(keyed, odd, KEY)).select("row", *[keyed[k] for k in KEY], "at", "copies", "extra")
        taken = taken.unionByName(numbered(both).select("row", (F.col("copies") + (F.col("nth") < F.col("extra")).cast("int")).alias("copies")).where("copies > 0"))
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row; repeated rows have a row each."""
    rows = repeated(copies_plan(docs), "n_rows")
    copies = F.col("copies") + (F.col("nth") < F.col("extra")).cast("int")
    return rows.select(F.col("k_id").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), "target", (copies * F.col("size")).cast("long").alias("taken"))
