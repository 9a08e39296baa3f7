"""Empirical-Bayes host reputation with fixed rules in front of it.

Every page may carry a labelled outcome (bad or good, null if unlabelled). Bad rates are shrunk from
above: the suffix towards the rate of all pages, the registered domain towards its suffix, the host
towards its domain. How strongly is itself estimated, one beta-binomial strength per level, from how
much more the rates of its members vary than chance explains. A host is blocked if the lower
posterior bound of its bad rate is above `lift` times the rate of all pages, or above `max_bad` where
that is less; hosts with few outcomes lean on their domain.

Everything is column expressions. Outcomes are counted per host before anything else moves, so a
host with a third of all pages is one row from then on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import lower_ascii, stored

# Fixed values: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

# Suffixes of two labels; all other hosts have their last label as suffix.
TWO_LABEL_SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.jp co.nz com.br com.cn".split()

STRENGTH_RANGE = (1.0, 10_000.0)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first `://` and the next `/`, `?` or `#`, and the path after it."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + F.lit(1), F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(lower_ascii(raw), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does.

    A rule fits its host and all subdomains if the path starts with its path. Of rules of one length
    the first in text order wins. The rules become one CASE, so they should be hundreds at most.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(
        rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True
    ):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(
            path, F.lit(rule_path)
        )
        made = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, made).otherwise(found)
    return found


def domain_and_suffix(host: Column, two_label=tuple(TWO_LABEL_SUFFIXES)) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; user names and ports do not count.

    Numeric addresses and hosts that are a suffix themselves are their own domain.
    """
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    long = two.isin(list(two_label))
    numeric = bare.rlike("^[0-9.]+$") | bare.startswith("[")
    suffix = F.when(numeric, bare).when(long, two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(numeric, bare).when(long, F.substring_index(bare, ".", -3)).otherwise(two)
    return domain, suffix


def _strength(members: DataFrame) -> float:
    """Beta-binomial strength of a level from rows with n, bad and the parent's rate `mean`.

    The expected square n (p - mean)^2 is v (1 + (n - 1) rho), v = mean (1 - mean); strength is
    1 / rho - 1, kept within STRENGTH_RANGE.
    """
    v = F.col("mean") * (1 - F.col("mean"))
    rows = members.filter("n > 0").select(
        (F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean"), 2) - v).alias("more"),
        (v * (F.col("n") - 1)).alias("room"),
    )
    more, room = rows.agg(F.sum("more"), F.sum("room")).first()
    low, high = STRENGTH_RANGE
    if not room or more is None or more <= 0:
        return high
    return min(max(room / more - 1, low), high)


def _shrunk(n: Column, bad: Column, mean: Column, strength: float) -> Column:
    return (bad + F.lit(strength) * mean) / (n + F.lit(strength))


def host_reputation(outcomes: DataFrame, z: float = 1.64) -> DataFrame:
    """(host, n, bad, rate, low, overall): posterior mean and lower bound of the bad rate of every
    host, and the rate of all pages.

    `outcomes` has host and bad (boolean, null if unlabelled). A host without outcomes gets its
    domain's rate; without any outcome at all the rate is 0.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = stored(
        outcomes.groupBy("host")
        .agg(
            F.count("bad").alias("n"),
            F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"),
        )
        .withColumns({"domain": domain, "suffix": suffix}),
        "hosts",
    )
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    n, bad = hosts.agg(*sums).first()
    overall = (bad / n) if n else 0.0
    suffixes = hosts.groupBy("suffix").agg(*sums).withColumn("mean", F.lit(overall))
    by_suffix = _strength(suffixes)
    parent = suffixes.select("suffix", F.col("n").alias("sn"), F.col("bad").alias("sb"))
    c = F.col
    # A member's own outcomes are left out of its parent's rate, or they would count at every level.
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(parent, "suffix").withColumn(
        "mean", _shrunk(c("sn") - c("n"), c("sb") - c("bad"), F.lit(overall), by_suffix)
    )
    by_domain = _strength(domains)
    parent = domains.select("domain", "suffix", c("n").alias("dn"), c("bad").alias("db"), c("mean").alias("smean"))
    rated = hosts.join(parent, ["domain", "suffix"]).withColumn(
        "mean", _shrunk(c("dn") - c("n"), c("db") - c("bad"), c("smean"), by_domain)
    )
    by_host = _strength(rated)
    rated = rated.withColumns(
        {"weight": c("n") + F.lit(by_host), "post": _shrunk(c("n"), c("bad"), c("mean"), by_host)}
    )
    spread = F.sqrt(F.col("post") * (1 - F.col("post")) / (F.col("weight") + 1))
    return rated.select(
        "host", "n", "bad", F.col("post").alias("rate"), (F.col("post") - z * spread).alias("low"),
        F.lit(float(overall)).alias("overall"),
    )


def url_filter(pages: DataFrame, page_id: str = "page_id", url: str = "url", bad: Column | None = None,
               rules=RULES, max_bad: float = 0.5, z: float = 1.64, lift: float = 1.5) -> DataFrame:
    """One row per row of `pages`: host, path, rule, verdict, rate and lower bound of the host.

    `bad` is the outcome of a page as a column of `pages`, null where unlabelled (default: all).
    Null urls and urls without `://` have an empty host and path, fit no rule and are judged as the
    pages of one host named by the empty text. Repeated rows count as often as they occur.
    """
    host, path = host_and_path(F.col(url))
    outcome = (F.lit(None) if bad is None else bad).cast("boolean")
    rows = pages.select(
        F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), outcome.alias("bad")
    )
    known = host_reputation(rows.select("host", "bad"), z).select("host", "rate", "low", "overall")
    rows = rows.drop("bad").withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules))
    most = F.least(F.lit(max_bad), lift * F.col("overall"))
    verdict = F.coalesce(
        F.col("_fit.verdict"), F.when(F.col("low") > most, F.lit("block")).otherwise(F.lit("allow"))
    )
    return rows.join(known, "host", "left").select(
        "page_id", "host", "path", F.col("_fit.rule").alias("rule"), verdict.alias("verdict"),
        "rate", "low",
    )
