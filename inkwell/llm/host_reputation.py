"""URL filter by rules and by empirical-Bayes host reputation.

Rules name a host and the beginning of a path; the longest that fits decides. All other urls are judged by their host: the
outcomes of labelled pages give each host a beta posterior whose prior mean is the posterior mean of its registered domain,
whose own prior mean comes from its suffix, and that from all pages. The strength of each level's prior is fitted by the
method of moments to how much its groups differ. A host is blocked when the lower bound of its share of bad pages is above
a limit, so one with few or no labelled pages is allowed unless those above it speak clearly against it.

For its reputation a host goes without user and port. Its suffix is the last label, or the last two where a country's label stands
behind one of SECOND_LEVEL, and its registered domain has one label more; an address of numbers is a domain of its own.

A null url, or one without `://`, has an empty host and path and is judged as the host "". Rows are kept as they are,
repeated ones too; without any label all are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import ascii_lower, cut, table

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: A host is blocked above this share of bad pages, at the lower bound of so many standard deviations.
BAD_SHARE, DEVIATIONS = 0.25, 2.0
#: Labels under which countries register names, as in co.uk and com.au.
SECOND_LEVEL = ["ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org"]
#: Prior strengths, in pages, are held between these.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.lit(2**31 - 1)))
    return ascii_lower(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.lit(2**31 - 1)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, with its verdict, or null."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        name, _, begin = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + begin)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def named_levels(hosts: DataFrame) -> DataFrame:
    """hosts with the suffix and the registered domain of each host."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", ""), r"\.$", "")
    parts = F.split(plain, r"\.")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), n), ".")
    two = plain.rlike(rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$")
    numbers = plain.rlike(r"^[0-9]+(\.[0-9]+)+$")
    return hosts.withColumns({"suffix": F.when(numbers, "").when(two, last(2)).otherwise(last(1)), "domain": F.when(numbers, plain).when(two, last(3)).otherwise(last(2))})


def _strength(groups: DataFrame, mean: str) -> float:
    """Prior strength, in pages, from groups (n, bad) around their column of prior means, by the method of moments."""
    m = F.col(mean)
    row = groups.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - m, 2)).alias("spread"),
        F.sum(m * (1 - m)).alias("chance"),
        F.sum(F.col("n") * m * (1 - m)).alias("scale"),
    ).first()
    if not row.scale:
        return STRONGEST
    between = (row.spread - row.chance) / row.scale  # the share of the variance that chance alone doesn't give
    return STRONGEST if between <= 0 else min(STRONGEST, max(WEAKEST, 1 / between - 1))


def reputation(outcomes: DataFrame) -> DataFrame:
    """host, n, bad, share (posterior mean) and bound (its lower bound) for outcomes (host, n, bad), a row per host.

    Every level has at most as many rows as there are hosts; only six sums reach the driver."""
    hosts = named_levels(outcomes)
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total.bad or 0) + 0.1) / ((total.n or 0) + 1)  # without any label nothing is blocked
    above, prior = hosts.withColumn("all", F.lit(overall)), "all"
    for level in ("suffix", "domain", "host"):
        keys = [level] if level == "suffix" else [level, "suffix"]
        groups = above.groupBy(*keys, prior).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        s = _strength(groups, prior)
        mean = (F.col("bad") + s * F.col(prior)) / (F.col("n") + s)
        if level == "host":
            share = groups.select("host", "n", "bad", mean.alias("share"), (F.col("n") + s).alias("weight"))
            break
        above = hosts.join(groups.select(*keys, mean.alias(f"{level}_mean")), keys)
        prior = f"{level}_mean"
    deviation = F.sqrt(F.col("share") * (1 - F.col("share")) / (F.col("weight") + 1))
    return share.select("host", "n", "bad", "share", (F.col("share") - DEVIATIONS * deviation).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages, learning from outcomes (page_id, bad)."""
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = cut(named.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    bounds = cut(reputation(hosts).select("host", "bound"))
    hit = matched(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bound") > BAD_SHARE, "block").otherwise("allow")
    return named.join(bounds, "host", "left").select("page_id", "host", "path", hit.getField("rule").alias("rule"), F.coalesce(hit.getField("verdict"), by_host).alias("verdict"))


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad if the label of its id is toxic or of low quality."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def _rules_sql() -> str:
    cases = []
    for rule, verdict in sorted(RULES, key=lambda r: -len(r[0])):
        name, _, begin = rule.partition("/")
        cases.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{begin}')", rule, verdict))
    return "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in cases) + " END AS rule, CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cases)


def _level_sql(level: str, prior: str, above: str) -> str:
    keys = "suffix" if level == "suffix" else f"{level}, suffix"
    between = "(sum(n * pow(bad / n - p, 2)) FILTER (n > 0) - sum(p * (1 - p)) FILTER (n > 0)) / nullif(sum(n * p * (1 - p)) FILTER (n > 0), 0)"
    return f"""
g_{level} AS (SELECT {keys}, {prior} AS p, sum(n) AS n, sum(bad) AS bad FROM {above} GROUP BY {keys}, {prior}),
v_{level} AS (SELECT {between} AS b FROM g_{level}),
s_{level} AS (SELECT CASE WHEN b IS NULL OR b <= 0 THEN {STRONGEST} ELSE least({STRONGEST}, greatest({WEAKEST}, 1 / b - 1)) END AS s FROM v_{level}),
m_{level} AS (SELECT {keys}, (bad + s * p) / (n + s) AS {level}_mean, n + s AS weight FROM g_{level}, s_{level})"""


OP4_SQL = rf"""WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
named AS (SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
known AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
counted AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM named LEFT JOIN known USING (page_id) GROUP BY host),
overall AS (SELECT (sum(bad) + 0.1) / (sum(n) + 1) AS every FROM counted),
plain AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS name FROM counted, overall),
hosts AS (SELECT * EXCLUDE (name), CASE WHEN numbers THEN '' WHEN two THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix, CASE WHEN numbers THEN name WHEN two THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain
  FROM (SELECT *, string_split(name, '.') AS parts, regexp_matches(name, '(^|\.)({"|".join(SECOND_LEVEL)})\.[a-z]{{2}}$') AS two, regexp_matches(name, '^[0-9]+(\.[0-9]+)+$') AS numbers FROM plain)),{_level_sql("suffix", "every", "hosts")},
h1 AS (SELECT * FROM hosts JOIN m_suffix USING (suffix)),{_level_sql("domain", "suffix_mean", "h1")},
h2 AS (SELECT * FROM hosts JOIN m_domain USING (domain, suffix)),{_level_sql("host", "domain_mean", "h2")}
SELECT page_id, host, path, {_rules_sql()} WHEN host_mean - {DEVIATIONS} * sqrt(host_mean * (1 - host_mean) / (weight + 1)) > {BAD_SHARE} THEN 'block' ELSE 'allow' END AS verdict
FROM named JOIN m_host USING (host)"""
