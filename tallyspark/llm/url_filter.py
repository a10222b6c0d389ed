"""URL filtering: host rules, then empirical-Bayes reputation of hosts.

Labelled outcomes of pages (bad or not) are counted by host, registered domain and suffix. Each level
has a beta prior whose mean is the posterior mean of the level above, without its own counts, and whose
strength is fitted from the overdispersion of the level's groups (beta-binomial moments). A host is
blocked when the lower posterior bound of its bad rate exceeds a threshold. All in DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored


@dataclass(frozen=True)
class Rule:
    """Fits a host, its subdomains, and paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


DEFAULT_RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

#: Suffixes of two labels under which names are registered; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "co.za", "com.mx", "com.tr", "com.cn")


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end; empty where there is no host part."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def bare_host(host: Column) -> Column:
    """The host without user information before an @ and without a port, as it is grouped."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def host_suffix(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The public suffix of a host by a short list: its last two labels if listed, else its last label."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_label), two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The suffix and one label more; the host itself if it has no more."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_label), F.substring_index(host, ".", -3)).otherwise(two)


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null. Ties: the rule listed first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def host_counts(outcomes: DataFrame) -> DataFrame:
    """outcomes (host, bad boolean or null): by host its labelled pages n and bad ones k, with domain and suffix."""
    counted = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k"))
    return counted.withColumns({"domain": registered_domain(bare_host(F.col("host"))), "suffix": host_suffix(bare_host(F.col("host")))})


def _strength(groups: DataFrame) -> float:
    """The beta prior's strength from groups (n, k, m: the mean above them), by the moments of a beta-binomial."""
    m = F.col("m")
    row = groups.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - m, 2) / (m * (1 - m))).alias("s"), F.count(F.lit(1)).alias("g"), F.sum("n").alias("n")
    ).first()
    if not row["g"] or row["n"] <= row["g"]:
        return 10.0
    rho = (row["s"] - row["g"]) / (row["n"] - row["g"])
    rho = min(max(rho, 1e-3), 0.5)  # a strength of one page at least: no single page decides
    return (1 - rho) / rho


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """Posterior of each host's bad rate: host, n, k, prior_mean, mean, lower, upper.

    outcomes: host and bad (null: not labelled). Hosts without labels get their domain's posterior,
    domains without labels their suffix's. Bounds are mean -+ z standard deviations of the beta
    posterior, within 0 and 1. An empty table gives no rows.
    """
    hosts = stored(host_counts(outcomes), "hosts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    domains = hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    overall = F.lit((total["k"] + 0.5) / (total["n"] + 1))
    # each level's mean leaves out the counts of the one that it is the prior of, so no page speaks twice
    strength = _strength(suffixes.select(F.col("sn").alias("n"), F.col("sk").alias("k"), overall.alias("m")))
    rows = domains.join(suffixes, "suffix").withColumn("m", (overall * strength + F.col("sk") - F.col("dk")) / (strength + F.col("sn") - F.col("dn")))
    rows = stored(rows.select("domain", "dn", "dk", "m"), "domains")
    strength = _strength(rows.select(F.col("dn").alias("n"), F.col("dk").alias("k"), "m"))
    rows = hosts.join(rows, "domain").withColumn("m", (F.col("m") * strength + F.col("dk") - F.col("k")) / (strength + F.col("dn") - F.col("n")))
    strength = _strength(rows)
    a, b = F.col("m") * strength + F.col("k"), (1 - F.col("m")) * strength + F.col("n") - F.col("k")
    mean = a / (a + b)
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return rows.select(
        "host", "n", "k", F.col("m").alias("prior_mean"), mean.alias("mean"),
        F.greatest(F.lit(0.0), mean - z * sd).alias("lower"), F.least(F.lit(1.0), mean + z * sd).alias("upper"),
    )


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, max_bad_rate: float = 0.5, z: float = 1.645) -> DataFrame:
    """Judge every row of pages (page_id, url): page_id, host, path, rule, verdict, bad_lower.

    A fitting rule decides (the longest); else the host is blocked if its lower posterior bound of the
    bad rate exceeds max_bad_rate. Null urls and urls without :// have empty host and path and are
    judged as the host ''. Repeated rows are judged each; other columns are not read. Hosts that hold
    a third of the pages only meet a join whose skewed partitions Spark splits.
    """
    judged = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    reputation = host_reputation(outcomes, z).select("host", F.col("lower").alias("bad_lower"))
    judged = judged.join(reputation, "host", "left").withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    by_method = F.when(F.coalesce(F.col("bad_lower"), F.lit(0.0)) > max_bad_rate, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", by_method).alias("verdict"), "bad_lower")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of pages whose url ends in the id of a labelled document: bad if its quality is 0 or it is toxic."""
    url = F.col("url")
    doc = F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) as bigint)")
    marked = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    seen = pages.select(url_host(url).alias("host"), doc.alias("doc_id"))
    return seen.join(marked, "doc_id", "left").select("host", (F.col("bad") == 1).alias("bad"))
