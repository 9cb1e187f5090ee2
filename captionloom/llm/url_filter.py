"""URL filters: allow and block rules first, then empirical-Bayes reputations of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionloom.llm.common import LOWER, UPPER, cut, per_salt, salt, salts_of

#: (verdict, host, path): a rule fits its host and all subdomains where the path begins with its path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: A host is blocked if the lower bound of its rate of bad pages, Z deviations under the mean, reaches BOUND.
BOUND, Z = 0.5, 1.645
#: Labelled pages that a prior weighs at least, so that one page alone blocks no host.
LEAST = 2.0


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty without '://'."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; of equal lengths the first listed."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


#: Second labels under country suffixes where names are registered one label further down.
SECOND_LABELS = ("ac", "co", "com", "edu", "gov", "net", "org")
ADDRESS = r"^([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*)$"


def name_of(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), ":[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    """The public suffix, taken to be the last label, or two under countries that register below co, com and the like; all
    addresses share one."""
    name = name_of(host)
    deep = name.rlike(rf"(^|\.)({'|'.join(SECOND_LABELS)})\.[a-z][a-z]$")
    return F.when(name.rlike(ADDRESS), "(address)").otherwise(F.when(deep, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1)))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more. An address is its own."""
    name = name_of(host)
    more = F.size(F.split(suffix_of(host), r"\.")) + 1
    return F.when(name.rlike(ADDRESS), name).otherwise(F.array_join(F.slice(F.split(name, r"\."), -F.least(more, F.size(F.split(name, r"\."))), more), "."))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Beta-binomial concentration by the method of moments from groups (n, bad): how much rates vary between groups."""
    w = groups.where("n > 0").select("n", (F.col("bad") / F.col("n")).alias("rate"), mean.alias("mean"))
    r = w.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("rate") - F.col("mean"), 2)).alias("spread"), F.sum(F.col("n") * F.col("mean") * (1 - F.col("mean"))).alias("within"), F.count("*").alias("groups")).first()
    if not r["n"] or not r["within"] or r["groups"] < 2:
        return 10.0
    # E[(rate - mean)^2] = mean(1-mean) * (1 + (n-1) rho) / n, summed over groups with weight n
    rho = (r["spread"] - r["within"] * r["groups"] / r["n"]) / max(r["within"] * (1 - r["groups"] / r["n"]), 1e-12)
    rho = min(max(rho, 1e-3), 1 / (1 + LEAST))
    return 1 / rho - 1


def reputation_levels(outcomes: DataFrame) -> dict[str, DataFrame]:
    """Of labelled page outcomes (host, is_bad): (key, n, bad, mean, lower) of each host under 'host', and under 'domain',
    'suffix' and 'all' (one row, key empty) what holds for a host without labelled pages that has nothing narrower.

    Beta-binomial priors chain from all pages to suffix, registered domain and host: each level's mean is its own counts
    shrunk to the level above, with a concentration fitted to the spread at that level. Counts are pre-aggregated per host,
    so a host with a third of all pages is one row; a few numbers reach the driver. A host without labelled pages has the
    mean of the level above it and the spread of all levels from there down to hosts.
    """
    hosts = cut(outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("is_bad").cast("long")).alias("bad")))
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    n, bad = total["n"] or 0, total["bad"] or 0
    base = (bad + 1) / (n + 2)
    means, k = {"all": hosts.sparkSession.createDataFrame([("", n, bad, base)], "key string, n long, bad long, mean double")}, {}
    above, key = None, None
    for level in ("suffix", "domain", "host"):
        groups = hosts.groupBy(level, *([key] if key else [])).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        groups = groups.withColumn("prior", F.lit(base)) if above is None else groups.join(above.select(key, F.col("mean").alias("prior")), key)
        groups = cut(groups)
        k[level] = _strength(groups, F.col("prior"))
        above = groups.withColumn("mean", (F.col("bad") + k[level] * F.col("prior")) / (F.col("n") + k[level]))
        means[level] = above.select(F.col(level).alias("key"), "n", "bad", "mean")
        key = level
    spread, out = 1.0, {}
    for level, below in (("host", None), ("domain", "host"), ("suffix", "domain"), ("all", "suffix")):
        if below:
            spread *= k[below] / (k[below] + 1)
        share = F.lit(1 - spread) if below else 1 / (F.col("n") + k["host"] + 1)
        out[level] = means[level].withColumn("lower", F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) * share))
    return out


def host_reputations(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, mean, lower) from labelled page outcomes (host, is_bad): each host's rate of bad pages."""
    return reputation_levels(outcomes)["host"].withColumnRenamed("key", "host")


def _with_bound(rows: DataFrame, key: str, unit: str, known: DataFrame, name: str) -> DataFrame:
    """rows with their key's `lower` of known (key, lower) as `name`, null where there is none. Keys meet known values once
    each, and those go back by key and part, so the rows of no key meet in one task."""
    dealt = rows.withColumn("_salt", salt(unit))
    keys = dealt.groupBy(key).agg(salts_of("_salt").alias("_salts"))
    found = keys.join(known.select(F.col("key").alias(key), F.col("lower").alias(name)), key)
    return dealt.join(per_salt(found, "_salts", "_salt"), [key, "_salt"], "left").drop("_salt")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, outcomes: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, lower) for every row of pages.

    Pages that a rule fits get its verdict. Others are blocked if their host's reputation bound reaches BOUND, else
    allowed; a host without labelled pages has the bound that its domain's pages give, else its suffix's, else all pages.
    Bounds are found once for each host, and go back to its pages by host and part: a host with a third of all pages, or a
    suffix with a third of all hosts, is no task's alone.
    URLs without a host are allowed. outcomes (host, is_bad) are the labelled pages; by default they are the pages that a
    rule judged. Null URLs have an empty host and path.
    """
    url = F.col(url_col)
    seen = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    seen = seen.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select(id_col, "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))
    labelled = outcomes if outcomes is not None else seen.where("verdict IS NOT NULL").select("host", (F.col("verdict") == "block").alias("is_bad"))
    levels = reputation_levels(labelled)
    rest = F.lit(levels["all"].first()["lower"])
    hosts = seen.where("host <> ''").select("host").distinct().withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    for key in ("domain", "suffix"):
        hosts = _with_bound(hosts, key, "host", levels[key], f"{key}_lower")
    own = levels["host"].select(F.col("key").alias("host"), F.col("lower").alias("own_lower"))
    bounds = hosts.join(own, "host", "left").select(F.col("host").alias("key"), F.coalesce("own_lower", "domain_lower", "suffix_lower", rest).alias("lower"))
    both = _with_bound(seen, "host", id_col, cut(bounds), "lower")
    by_host = F.when(F.col("lower") >= BOUND, "block").otherwise("allow")
    return both.select(id_col, "host", "path", "rule", F.coalesce("verdict", by_host).alias("verdict"), "lower")


def judged_report(pages: DataFrame) -> DataFrame:
    """judge_urls() with the bound rounded, so that the order of sums doesn't show."""
    return judge_urls(pages).withColumn("lower", F.round("lower", 6))


def _sql_strength(groups: str) -> str:
    rho = "(sum(n * pow(bad / n - prior, 2)) - sum(n * prior * (1 - prior)) * count(*) / sum(n)) / greatest(sum(n * prior * (1 - prior)) * (1 - count(*) / sum(n)), 1e-12)"
    return f"(SELECT CASE WHEN count(*) < 2 OR sum(n * prior * (1 - prior)) = 0 THEN 10.0 ELSE 1 / least(greatest({rho}, 1e-3), 1 / (1 + {LEAST})) - 1 END FROM {groups})"


def _sql_lower(mean: str, share: str) -> str:
    return f"{mean} - {Z} * sqrt({mean} * (1 - {mean}) * {share})"


def _sql_case(value: str) -> str:
    """The longest rule that fits, as a CASE."""
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if value == 'rule' else v}'" for v, h, p in rules) + " END"


_SECOND = "|".join(SECOND_LABELS)
ORACLE = rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
v AS (SELECT *, {_sql_case("rule")} AS rule, {_sql_case("verdict")} AS given, regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', '') AS name FROM u),
x AS (SELECT *, CASE WHEN regexp_matches(name, '{ADDRESS}') THEN '(address)' WHEN regexp_matches(name, '(^|\.)({_SECOND})\.[a-z][a-z]$') THEN array_to_string(string_split(name, '.')[-2:], '.') ELSE string_split(name, '.')[-1] END AS suffix FROM v),
s AS (SELECT *, CASE WHEN suffix = '(address)' THEN name ELSE array_to_string(list_slice(string_split(name, '.'), -(len(string_split(suffix, '.')) + 1), -1), '.') END AS domain FROM x),
h AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, count(*) FILTER (given = 'block')::DOUBLE AS bad FROM s WHERE given IS NOT NULL GROUP BY ALL),
base AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM h),
g1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT mean FROM base) AS prior FROM h GROUP BY suffix),
k1 AS (SELECT {_sql_strength("g1")} AS k),
m1 AS (SELECT suffix, (bad + k * prior) / (n + k) AS mean FROM g1, k1),
g2 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(m1.mean) AS prior FROM h JOIN m1 USING (suffix) GROUP BY domain, suffix),
k2 AS (SELECT {_sql_strength("g2")} AS k),
m2 AS (SELECT domain, (bad + k * prior) / (n + k) AS mean FROM g2, k2),
g3 AS (SELECT host, n, bad, m2.mean AS prior FROM h JOIN m2 USING (domain)),
k3 AS (SELECT {_sql_strength("g3")} AS k),
m3 AS (SELECT host, n, (bad + k * prior) / (n + k) AS mean FROM g3, k3),
b3 AS (SELECT host, {_sql_lower("mean", "(1 / (n + k + 1))")} AS lower FROM m3, k3),
b2 AS (SELECT domain, {_sql_lower("mean", "(1 - k3.k / (k3.k + 1))")} AS lower FROM m2, k3),
b1 AS (SELECT suffix, {_sql_lower("mean", "(1 - k3.k / (k3.k + 1) * k2.k / (k2.k + 1))")} AS lower FROM m1, k3, k2),
b0 AS (SELECT {_sql_lower("mean", "(1 - k3.k / (k3.k + 1) * k2.k / (k2.k + 1) * k1.k / (k1.k + 1))")} AS lower FROM base, k3, k2, k1),
j AS (SELECT s.*, CASE WHEN s.host <> '' THEN coalesce(b3.lower, b2.lower, b1.lower, (SELECT lower FROM b0)) END AS lower FROM s LEFT JOIN b3 ON s.host = b3.host LEFT JOIN b2 ON s.domain = b2.domain LEFT JOIN b1 ON s.suffix = b1.suffix)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN lower >= {BOUND} THEN 'block' ELSE 'allow' END) AS verdict, round(lower, 6) AS lower FROM j
"""
