"""URL filters: listed rules first, then empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes are counted for each host, registered domain and suffix. The rate of bad pages of a suffix is
shrunk to the rate of all pages, a domain's to its suffix's, a host's to its domain's, each by a beta-binomial prior
whose strength is estimated at that level by the method of moments. A host is blocked if the lower bound of its
posterior rate is above a threshold: few labelled pages never block a host on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host and path prefix) of the listed rules: fixed values.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _fold(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str = "url") -> tuple[Column, Column]:
    """host and path of a url; both empty where there is no `://` or the url is null."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return _fold(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


#: Second-level labels under which countries register domains, as in ac.uk, com.au, go.jp: fixed values.
SECOND_LEVEL = ["ac", "asso", "co", "com", "edu", "go", "gob", "gov", "gouv", "gv", "info", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch"]


def _levels(host: Column, two_level: tuple[str, ...]) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; a host of one label is its own domain and suffix.

    A suffix has two labels where a country's code of two letters stands behind one of SECOND_LEVEL, or if it is one of
    two_level; else it is the last label."""
    two = F.substring_index(host, ".", -2)
    long = two.rlike(f"^({'|'.join(SECOND_LEVEL)})[.][a-z][a-z]$")
    long = long | two.isin(*two_level) if two_level else long
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(two), F.when(long, two).otherwise(F.substring_index(host, ".", -1))


def _strength(groups: DataFrame, prior: Column) -> DataFrame:
    """One row `m`: the prior's strength, from how much the groups' rates spread beyond binomial noise.

    Method of moments over groups of two labelled pages or more: rho is the within-group correlation, m = 1/rho - 1,
    held between 1 and 1000. Without such groups m is 10.
    """
    g = groups.where("n > 1").withColumn("p", prior)
    num = F.sum((F.col("bad") - F.col("n") * F.col("p")) * (F.col("bad") - F.col("n") * F.col("p")) - F.col("n") * F.col("p") * (1 - F.col("p")))
    den = F.sum(F.col("n") * (F.col("n") - 1) * F.col("p") * (1 - F.col("p")))
    rho = F.when(den > 0, num / den)
    m = F.when(rho.isNull(), 10.0).when(rho <= 0.001, 1000.0).otherwise(F.greatest(F.lit(1.0), 1 / rho - 1))
    return g.agg(F.round(m, 6).alias("m"))


def host_reputation(outcomes: DataFrame, bound: float = 0.5, z: float = 1.645, two_level: tuple[str, ...] = ()) -> DataFrame:
    """host, n, bad, rate (posterior mean), lower (posterior bound), blocked, for outcomes(host, bad in 0/1).

    The aggregates are combined before each shuffle and each level starts from the one below, so a host, domain or
    suffix with any share of the pages is one row from the first shuffle on. Null hosts and outcomes are left out.
    """
    domain, suffix = _levels(F.col("host"), two_level)
    hosts = outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg((F.sum("bad") / F.sum("n")).alias("p0"))  # one row
    shrunk = (F.col("bad") + F.col("m") * F.col("prior")) / (F.col("n") + F.col("m"))

    def level(groups: DataFrame, above: DataFrame) -> DataFrame:
        with_prior = groups.join(above, "suffix" if "domain" not in above.columns else "domain") if above is not total else groups.crossJoin(F.broadcast(total))
        with_prior = with_prior.withColumnRenamed("p0" if above is total else "rate", "prior")
        return with_prior.crossJoin(F.broadcast(_strength(with_prior, F.col("prior"))))  # one row

    s = level(suffixes, total).select("suffix", shrunk.alias("rate"))
    d = level(domains, s).select("domain", shrunk.alias("rate"))
    h = level(hosts.drop("suffix"), d)
    a, b = F.col("bad") + F.col("m") * F.col("prior"), F.col("n") - F.col("bad") + F.col("m") * (1 - F.col("prior"))
    rate, spread = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    lower = rate - z * spread
    return h.select("host", "n", "bad", F.round(rate, 9).alias("rate"), F.round(lower, 9).alias("lower"), (F.round(lower, 9) > bound).alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, **how) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages(page_id, url); outcomes(page_id, bad) are the labels.

    A listed rule decides where one fits, else the reputation of the host: block if its posterior bound is above the
    threshold, allow otherwise (also for hosts without labelled pages and for urls without a host).

    Null url: host and path empty. Null page_id, repeated rows: each row is judged. A page with several outcomes is bad
    if one is. A posterior bound at the threshold does not block. Empty tables: an empty result, or no reputation. Very
    long urls are read whole. Other columns are not read. Hot hosts: only hosts found bad are joined to the pages, and that join may split skewed partitions.
    """
    host, path = parts()
    seen = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.withColumns({"rule": rule, "listed": verdict}).drop("url")
    labelled = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = seen.select("page_id", "host").join(labelled, "page_id").where("host <> ''")
    blocked = host_reputation(known, **how).where("blocked").select("host", F.lit("block").alias("by_host"))
    out = seen.join(blocked, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", "by_host", F.lit("allow")).alias("verdict"))
