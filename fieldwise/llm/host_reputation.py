"""URL filter by host reputation, in DataFrame functions only.

Labelled page outcomes are counted per host; rates are shrunk from host to registered domain
to suffix to all (shrink.py), and a host is blocked when the lower posterior bound of its bad
rate passes a limit set by the rate of all outcomes.  Explicit rules on (host, path) come before the method.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stages import stage
from .shrink import lower_bound, overall_rate, posteriors

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Registries that give out names under a second label.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp",
    "co.nz", "co.in", "co.kr", "co.za", "com.br", "com.cn", "com.mx", "com.tr",
)
#: A host is blocked where its odds of bad are surely over this many times those of all pages.
LIFT = 2.0
#: Standard deviations between a posterior's mean and its bound (95 % on one side).
Z = 1.645
#: (verdict, host, path): a rule fits its host and all subdomains where the path starts so.
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; '' if there is none."""
    got = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(got, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; '' without a host part."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def site_of(host: Column) -> Column:
    """What the hierarchy knows a host by: without user, port and closing dot."""
    bare = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(bare, r"\.$", "")


def is_address(site: Column) -> Column:
    """Numbers of an IPv4 address, or an IPv6 address in brackets."""
    return site.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | site.startswith("[")


def suffix_of(host: Column, suffixes: Sequence[str] = ()) -> Column:
    """The longest listed suffix of several labels that fits, else the last label.

    An address has no suffix above it: it is its own.
    """
    out = F.element_at(F.split(host, r"\."), -1)
    for s in sorted(suffixes, key=len):
        out = F.when((host == s) | host.endswith("." + s), F.lit(s)).otherwise(out)
    return F.when(is_address(host), host).otherwise(out)


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix with one more label."""
    rest = F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    label = F.element_at(F.split(rest, r"\."), -1)
    return F.when(label == "", suffix).otherwise(F.concat(label, F.lit("."), suffix))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name (host + path) and verdict of the longest rule that fits, else NULL."""
    name = verdict = F
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = name.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(v))
    return (F.lit(None).cast("string"),) * 2 if name is F else (name, verdict)


def limit_for(overall: float, lift: float = LIFT) -> float:
    """The rate whose odds are ``lift`` times those of ``overall``."""
    return lift * overall / (1 - overall + lift * overall)


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule],
    limit: float | None = None,
    z: float = Z,
    suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): host, path, rule, verdict.

    ``outcomes`` (url, bad 0/1) are the labelled pages; NULLs in ``bad`` do not count.  A url
    that is NULL or has no host is allowed unless a rule fits; without any outcome all hosts
    are allowed.  Without ``limit`` it is the rate whose odds are LIFT times those of all
    outcomes: 0.26 where 15 % are bad, 0.5 where a third is.  Hosts without outcomes stand on their domain, domains on their suffix.  User
    and port are no part of a host's reputation, and an address shares it with nobody.
    A host with very many pages is counted before it is shuffled, and pages meet their host's
    one row in a join that Spark may broadcast or split.
    """
    host = host_of(F.col("url"))
    site = site_of(host).alias("site")
    seen = pages.select(site, F.lit(0).alias("n"), F.lit(0).alias("k"))
    told = outcomes.filter("bad is not null").select(
        site, F.lit(1).alias("n"), F.col("bad").cast("int").alias("k")
    )
    counts = seen.unionByName(told).groupBy("site").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffix = suffix_of(F.col("site"), suffixes)
    counts = counts.withColumn("suffix", suffix)
    counts = counts.withColumn("domain", domain_of(F.col("site"), F.col("suffix")))
    counts = stage(counts, "host-counts")
    if limit is None:
        limit = limit_for(overall_rate(counts))
    reputation = posteriors(counts, ["suffix", "domain", "site"])
    blocked = stage(
        reputation.filter((lower_bound(z) > limit) & (F.col("site") != "")).select(
            F.col("site").alias("bad_site")
        ),
        "bad-sites",
    )
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.join(blocked, site_of(F.col("host")) == F.col("bad_site"), "left")
    by_method = F.when(F.col("bad_site").isNull(), F.lit("allow")).otherwise(F.lit("block"))
    return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"))
