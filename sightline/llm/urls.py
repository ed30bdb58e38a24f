"""URL filters: rules, then empirical-Bayes host reputation; DataFrame operations only.

Labelled page outcomes are counted per host, registered domain and suffix. Each level's good
rate is shrunk to the one above by a beta-binomial prior whose strength is estimated from the
spread between the groups of that level (method of moments); hosts without labels have their
domain's prior. A host's page is blocked by the method if even the upper posterior bound of its
good rate is below ``CUT``: doubt keeps a page.

Hosts are counted with partial aggregation; the join of pages to hosts is a plain equi-join that
AQE splits where one host holds many pages. Three scalars per level pass through the driver.

Edge cases: a null url, or one without ``://``, has an empty host and path and is judged as the
host ``""``. Pages without labels count for nothing; labels without pages are ignored; a page with
several labels counts each. Repeated rows are judged one by one. Columns besides those named are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import ascii_lower

# The contract's rules.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Good rate under which a host is blocked, if its posterior bound says so.
CUT = 0.5
#: Standard deviations from the posterior mean to the bound.
WIDTH = 1.645
#: Bounds of a prior's strength, in labelled pages.
STRENGTH = (1.0, 1000.0)
#: Second labels that belong to a two-letter suffix.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")


def parted(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """Struct of rule and verdict of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def domain_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix: the last two labels and the last, one more under
    two-letter suffixes with a second label of SECOND."""
    labels = F.split(host, "[.]", -1)
    n = F.size(labels)
    deep = (n >= 3) & (F.length(F.get(labels, n - 1)) == 2) & F.get(labels, n - 2).isin(*SECOND)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.lit(1), n - k + 1), k), ".")
    return (
        F.when(deep, last(F.lit(3))).otherwise(last(F.lit(2))),
        F.when(deep, last(F.lit(2))).otherwise(last(F.lit(1))),
    )


@dataclass(frozen=True)
class Prior:
    mean: float
    strength: float


def strength_of(groups: DataFrame) -> Prior:
    """Overall good rate and beta-binomial strength of groups with columns n and good."""
    s = groups.agg(
        F.count("*").alias("g"),
        F.sum("n").alias("n"),
        F.sum("good").alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("good") * F.col("good") / F.col("n")).alias("kk"),
    ).first()
    if not s.n:
        return Prior(0.5, STRENGTH[0])
    p = s.k / s.n
    spread = s.kk - s.n * p * p
    within = p * (1 - p)
    free = s.n - s.nn / s.n - (s.g - 1)
    if within <= 0 or free <= 0:
        return Prior(p, STRENGTH[1])
    rho = (spread - within * (s.g - 1)) / (within * free)
    strength = STRENGTH[1] if rho <= 0 else (1 - rho) / rho
    return Prior(p, min(max(strength, STRENGTH[0]), STRENGTH[1]))


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, rate, upper): posterior good rate and its bound, from (host, good) rows."""
    hosts = outcomes.groupBy("host").agg(
        F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")
    )
    domain, suffix = domain_of(F.col("host"))
    hosts = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "good")
    sums = lambda *by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    domains, suffixes = sums("domain", "suffix"), sums("suffix")
    known = lambda t: strength_of(t.where("n > 0"))
    top, mid, low = known(suffixes), known(domains), known(hosts)
    of_suffix = suffixes.select(
        "suffix",
        ((F.col("good") + top.strength * top.mean) / (F.col("n") + top.strength)).alias("suffix_rate"),
    )
    of_domain = domains.join(of_suffix, "suffix").select(
        "domain",
        "suffix",
        ((F.col("good") + mid.strength * F.col("suffix_rate")) / (F.col("n") + mid.strength)).alias("domain_rate"),
    )
    total = F.col("n") + low.strength
    rate = (F.col("good") + low.strength * F.col("domain_rate")) / total
    return (
        hosts.join(of_domain, ["domain", "suffix"])
        .select("host", "n", rate.alias("rate"), total.alias("total"))
        .select(
            "host",
            "rate",
            (F.col("rate") + WIDTH * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("total") + 1))).alias("upper"),
        )
    )


def judged(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, rate, upper); ``outcomes`` are (page_id, good)."""
    host, path = parted(F.col("url"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"))
    good = placed.select("page_id", "host").join(
        outcomes.select("page_id", F.col("good").cast("long").alias("good")), "page_id", "left"
    )
    ruled = placed.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("upper") < CUT, "block").otherwise("allow")
    return ruled.join(reputation(good), "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), method).alias("verdict"),
        "rate",
        "upper",
    )


def _oracle() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rules = ", ".join(
        f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES
    )
    second = ", ".join(f"'{s}'" for s in SECOND)
    low, high = STRENGTH

    def prior(name: str, table: str) -> str:
        """One row: a level's mean and strength."""
        return f"""
{name}_sum AS (SELECT count(*) AS g, coalesce(sum(n), 0) AS n, coalesce(sum(k), 0) AS k, sum(n * n) AS nn,
  sum(k * k / n) AS kk FROM {table} WHERE n > 0),
{name}_mid AS (SELECT *, k / n AS p, (k / n) * (1 - k / n) AS w, n - nn / n - (g - 1) AS free FROM {name}_sum),
{name} AS (SELECT CASE WHEN n = 0 THEN 0.5 ELSE p END AS mean, CASE WHEN n = 0 THEN {low}
    WHEN w <= 0 OR free <= 0 OR kk - n * p * p - w * (g - 1) <= 0 THEN {high}
    ELSE least(greatest((1 - (kk - n * p * p - w * (g - 1)) / (w * free)) / ((kk - n * p * p - w * (g - 1)) / (w * free)), {low}), {high})
    END AS size FROM {name}_mid),"""

    return f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
part AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{upper}', '{upper.lower()}') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, rule, name, start) AS (VALUES {rules}),
good AS (SELECT doc_id AS page_id, CAST(quality = 1 AND toxic = 0 AS INTEGER) AS good FROM labels),
cut AS (SELECT host, CAST(count(good) AS DOUBLE) AS n, CAST(coalesce(sum(good), 0) AS DOUBLE) AS k, string_split(host, '.') AS l
  FROM part LEFT JOIN good USING (page_id) GROUP BY host),
deep AS (SELECT *, CASE WHEN len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ({second}) THEN 1 ELSE 0 END AS more FROM cut),
hosts AS (SELECT host, n, k, array_to_string(l[-least(len(l), 2 + more):], '.') AS domain,
  array_to_string(l[-least(len(l), 1 + more):], '.') AS suffix FROM deep),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),{prior("top", "suffixes")}{prior("mid", "domains")}{prior("low", "hosts")}
s_rate AS (SELECT suffix, (k + size * mean) / (n + size) AS rate FROM suffixes, top),
d_rate AS (SELECT domain, suffix, (k + size * s.rate) / (n + size) AS rate FROM domains JOIN s_rate s USING (suffix), mid),
h_rate AS (SELECT host, (k + size * d.rate) / (n + size) AS rate, n + size AS total FROM hosts JOIN d_rate d USING (domain, suffix), low),
named AS (SELECT p.*, rate + {WIDTH} * sqrt(rate * (1 - rate) / (total + 1)) AS upper,
  (SELECT max_by(rule, length(rule)) FROM rules WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)) AS rule
  FROM part p JOIN h_rate USING (host))
SELECT page_id, host, path, n.rule, coalesce(r.verdict, CASE WHEN upper < {CUT} THEN 'block' ELSE 'allow' END) AS verdict
FROM named n LEFT JOIN rules r ON n.rule = r.rule
"""


ORACLE = _oracle()
