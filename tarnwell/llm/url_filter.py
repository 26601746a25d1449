"""URL filtering by rules and by an empirical-Bayes reputation of hosts. DataFrame functions only.

Labelled page outcomes are summed by host, registered domain and suffix. The share
of bad pages of each level is shrunk towards its parent's: a host's beta prior is
centred on its domain's posterior mean, the domain's on the suffix's, the suffix's
on the overall share. How strongly is estimated from how far the children of a
level differ beyond binomial noise (method of moments). A host is blocked where a
lower posterior bound of its share of bad pages is above a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import stage

# Second labels under which countries register names.
SECOND_LABELS = ("ac", "co", "com", "ed", "edu", "gob", "gouv", "gov", "go", "gv", "ltd", "me", "mil", "ne", "net", "nhs", "nic", "nom", "or", "org", "plc", "sch")
#: A suffix of two labels: one of these before a country's.
TWO_LABELS = r"^(" + "|".join(SECOND_LABELS) + r")\.[a-z]{2}$"
ADDRESS = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$"

#: (host, path prefix, verdict); a rule holds for its host and all subdomains.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: Share of characters in runs of three or more of one symbol from which a page counts as bad.
JUNK_SHARE = 0.02
#: The bound is so many posterior deviations below the mean; a host above BLOCK_SHARE is blocked.
DEVIATIONS = 2.0
BLOCK_SHARE = 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/?#``, A-Z lowered; then up to ``?`` or ``#``.

    Both are empty for null and where there is no ``://``.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does.

    The rules are a short list, so they are one CASE in order of length.
    """
    name = verdict = None
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    for of, prefix, says in ordered:
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(prefix))
        name = F.when(fits, F.lit(of + prefix)) if name is None else name.when(fits, F.lit(of + prefix))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def levels(host: Column, suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without its port; a host of one label is both.

    A suffix has one label, or two where these are a country's (TWO_LABELS) or among
    ``suffixes``, such as a public list's. An address is a domain of its own under the
    suffix "(address)".
    """
    name = F.regexp_replace(host, r":[0-9]*$", "")
    labels = F.split(name, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".")
    double = two.rlike(TWO_LABELS) | two.isin(*suffixes) if suffixes else two.rlike(TWO_LABELS)
    three = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 2), 3), ".")
    address = name.rlike(ADDRESS)
    domain = F.when(address, name).when(double, three).otherwise(two)
    return domain, F.when(address, F.lit("(address)")).when(double, two).otherwise(F.element_at(labels, -1))


def junk_page(html: Column) -> Column:
    """Whether over JUNK_SHARE of a page's characters are runs of one of ``#*$%`` (entities folded); null for null."""
    plain = F.replace(html, F.lit("&amp;"), F.lit("&"))
    junk = F.length(plain) - F.length(F.regexp_replace(plain, r"#{3,}|\*{3,}|\${3,}|%{3,}|&{3,}", ""))
    return junk > JUNK_SHARE * F.length(plain)


def _shrunk(level: DataFrame, key: str, mean: str) -> DataFrame:
    """Add alpha and beta of the posterior of each row of (key, bad, n, ``mean`` of its parent).

    The prior's strength k comes from the intra-level correlation 1 / (k + 1) that
    the squared deviations from the parents' means show, clipped to 0.001..0.999.
    """
    m = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col(mean)))
    v, p = m * (1 - m), F.col("bad") / F.col("n")
    excess = F.sum(F.col("n") * (p - m) * (p - m)) - F.sum(v)
    room = F.sum(v * (F.col("n") - 1))
    rho = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.when(room > 0, excess / room).otherwise(F.lit(0.5))))
    strength = level.agg((1 / F.coalesce(rho, F.lit(0.5)) - 1).alias("strength"), F.lit(1).alias("one"))
    # One row, so its broadcast has a size bound.
    out = level.withColumn("one", F.lit(1)).join(F.broadcast(strength), "one").drop("one")
    return out.withColumns({"alpha": m * F.col("strength") + F.col("bad"), "beta": (1 - m) * F.col("strength") + F.col("n") - F.col("bad")})


def reputation(outcomes: DataFrame) -> DataFrame:
    """One row per host of (host, bad boolean): host, n_pages, share (posterior mean), bound.

    Rows with a null outcome are not labelled and do not count.
    """
    domain, suffix = levels(F.col("host"))
    hosts = outcomes.where("bad IS NOT NULL").groupBy("host").agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count(F.lit(1)).alias("n"))
    hosts = stage(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    counts = lambda *by: hosts.groupBy(*by).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    overall = hosts.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("parent"), F.lit(1).alias("one"))
    suffixes = counts("suffix").withColumn("one", F.lit(1)).join(F.broadcast(overall), "one").drop("one")
    suffixes = stage(_shrunk(suffixes, "suffix", "parent").select("suffix", mean.alias("parent")), "suffixes")
    domains = counts("domain", "suffix").join(suffixes, "suffix")
    domains = stage(_shrunk(domains, "domain", "parent").select("domain", mean.alias("parent")), "domains")
    known = _shrunk(hosts.join(domains, "domain"), "host", "parent")
    size = F.col("alpha") + F.col("beta")
    deviation = F.sqrt(F.col("alpha") * F.col("beta") / (size * size * (size + 1)))
    return known.select("host", F.col("n").alias("n_pages"), mean.alias("share"), F.greatest(F.lit(0.0), mean - DEVIATIONS * deviation).alias("bound"))


def judge(pages: DataFrame, outcome: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, n_pages, share, bound.

    ``outcome`` is a boolean over the columns of ``pages``: true for a bad page,
    null where unlabelled. The longest fitting rule decides; else the host's bound.
    Hosts without a labelled page are allowed, with null n_pages, share and bound.
    Null urls have empty host and path; null page_ids and repeated rows stay as they
    are. An empty table gives no rows. Columns other than page_id, url and those of
    ``outcome`` are not read.
    """
    host, path = split_url(F.col("url").cast("string"))
    slim = stage(pages.select("page_id", host.alias("host"), path.alias("path"), outcome.alias("bad")), "pages")
    known = stage(reputation(slim.select("host", "bad")), "reputation").withColumnRenamed("host", "of_host")
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    out = slim.join(known, slim["host"] == known["of_host"], "left").withColumns({"rule": rule, "says": says})
    own = F.when(F.col("bound") > BLOCK_SHARE, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("says", own).alias("verdict"), "n_pages", "share", "bound")
