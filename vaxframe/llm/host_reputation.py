"""URL verdicts: stated rules first, then empirical-Bayes host reputation.

Pages that a rule decides are the labelled outcomes (1: block). Rates are shrunk down the tree, suffix to
registered domain to host, by beta priors whose strength comes from the spread of the level's rates (method
of moments). A page without a rule is blocked when even the lower posterior bound of its host's rate is
above the threshold; a host about which nothing is known keeps its parents' rate and a wide bound.

Only DataFrame functions. Defined results: a null url, or one without ``://``, has an empty host and path and
no rule; an empty host is a host of its own. Repeated rows each get their verdict and count as outcomes.
An empty table has no verdicts. Columns other than page_id and url are unused, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaxframe.sources.scratch import stage

#: Fixed rules of the query: verdict, host, path.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
#: Public suffixes of two labels; any other suffix is the last label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "co.in", "co.za", "com.mx", "com.cn")
THRESHOLD = 0.5
#: Width of the posterior bound in standard deviations.
BOUND = 1.64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def decide(host: Column, path: Column, rules) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def parents(hosts: DataFrame) -> DataFrame:
    """Adds suffix and registered domain; an address of numbers is its own domain and suffix."""
    labels = F.split("host", r"\.")
    last_two = F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), F.lit(2)), ".")
    wide = F.least(F.size(labels), F.when(last_two.isin(*LONG_SUFFIXES), 2).otherwise(1))
    numbers = F.col("host").rlike(r"^[0-9.:\[\]]*$")
    tail = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return hosts.withColumn("suffix", F.when(numbers, F.col("host")).otherwise(tail(wide))).withColumn(
        "domain", F.when(numbers, F.col("host")).otherwise(tail(F.least(F.size(labels), wide + 1))))


def _strength(level: DataFrame, parent_rate: float) -> float:
    """Prior observations that the spread of the level's rates stands for (beta-binomial moments)."""
    row = level.where("n > 0").selectExpr(
        "count(*) as g", "coalesce(sum(n), 0) as n", "coalesce(sum(1.0D * n * n), 0) as nn",
        f"coalesce(sum(n * pow(y / n - {parent_rate}D, 2)), 0) as spread").first()
    noise, room = parent_rate * (1 - parent_rate), (row.n - row.nn / row.n if row.n else 0) - (row.g - 1)
    if noise <= 0 or row.g < 2 or room <= 0:
        return 2.0
    within = min(max((row.spread - noise * (row.g - 1)) / (noise * room), 0.001), 0.9)
    return (1 - within) / within


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, rate, low) from (host, y, n): n labelled pages of which y blocked; hosts without labels have n = 0."""
    hosts = stage(parents(outcomes), "hosts")
    total = hosts.selectExpr("coalesce(sum(y), 0) as y", "coalesce(sum(n), 0) as n").first()
    rate = float((total.y + 0.5) / (total.n + 1))
    levels = [hosts.groupBy("suffix").agg(F.sum("y").alias("y"), F.sum("n").alias("n")),
              hosts.groupBy("suffix", "domain").agg(F.sum("y").alias("y"), F.sum("n").alias("n")), hosts]
    s, d, h = (_strength(level, rate) for level in levels)
    suffixes = levels[0].selectExpr("suffix", f"(y + {s * rate}D) / (n + {s}D) as up")
    domains = levels[1].join(suffixes, "suffix").selectExpr("suffix", "domain", f"(y + {d}D * up) / (n + {d}D) as up")
    shrunk = hosts.join(domains, ["suffix", "domain"]).selectExpr("host", f"y + {h}D * up as a", f"n - y + {h}D * (1 - up) as b")
    return shrunk.selectExpr("host", "a / (a + b) as rate", f"a / (a + b) - {BOUND}D * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as low")


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, rate): the html is never read."""
    parsed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    ruled = parsed.withColumn("decided", decide(F.col("host"), F.col("path"), rules))
    outcomes = ruled.groupBy("host").agg(
        F.count(F.when(F.expr("decided.verdict = 'block'"), 1)).alias("y"), F.count("decided.verdict").alias("n"))
    known = reputation(outcomes)
    return ruled.join(known, "host", "left").select(
        "page_id", "host", "path", F.col("decided.rule").alias("rule"),
        F.coalesce("decided.verdict", F.when(F.col("low") > threshold, "block").otherwise("allow")).alias("verdict"), F.round("rate", 6).alias("rate"))
