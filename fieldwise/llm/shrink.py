"""Empirical-Bayes shrinkage of rates down a hierarchy, by grouped aggregation.

At every level the children's counts are beta-binomial around their parent's mean; the prior
strength is fitted by the method of moments over all children of the level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the fitted within-parent correlation: strengths from 0.25 to 9,999.
RHO = (0.0001, 0.8)


def _strength(children: DataFrame) -> float:
    """Prior strength a + b from children (n, k, parent): moments of the beta-binomial."""
    seen = children.filter("n > 0")
    spread = F.col("parent") * (1 - F.col("parent"))
    row = seen.agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("parent"), 2.0)).alias("s"),
        F.sum(spread).alias("one"),
        F.sum(spread * (F.col("n") - 1)).alias("more"),
    ).first()
    if not row.more:
        return 1 / RHO[0] - 1
    rho = min(max((row.s - row.one) / row.more, RHO[0]), RHO[1])
    return 1 / rho - 1


def overall_rate(counts: DataFrame) -> float:
    """Rate of all outcomes of ``counts`` (n, k), drawn to 1/2 by one outcome."""
    total = counts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    return ((total.k or 0) + 0.5) / ((total.n or 0) + 1)


def posteriors(counts: DataFrame, levels: Sequence[str]) -> DataFrame:
    """One row per key of the finest level: levels, ``a``, ``b`` of its Beta posterior.

    ``counts`` has a row per finest key: the level columns (none NULL), ``n`` outcomes, ``k`` of
    them positive.  Keys without outcomes get their parent's mean at the prior's strength.
    Pass a staged frame: it is read a few times.  Without any outcome all means are 1/2.
    """
    mean = overall_rate(counts)
    parents = None
    for i in range(len(levels)):
        keys = list(levels[: i + 1])
        child = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        if parents is None:
            child = child.withColumn("parent", F.lit(mean))
        else:
            child = child.join(parents, keys[:-1])
        s = F.lit(_strength(child))
        child = child.withColumns({
            "a": s * F.col("parent") + F.col("k"),
            "b": s * (1 - F.col("parent")) + F.col("n") - F.col("k"),
        })
        parents = child.select(*keys, (F.col("a") / (F.col("a") + F.col("b"))).alias("parent"))
    return child.select(*levels, "a", "b")


def mean(a: str = "a", b: str = "b") -> Column:
    return F.col(a) / (F.col(a) + F.col(b))


def lower_bound(z: float, a: str = "a", b: str = "b") -> Column:
    """Mean less ``z`` standard deviations of the Beta posterior."""
    t = F.col(a) + F.col(b)
    return F.col(a) / t - z * F.sqrt(F.col(a) * F.col(b) / (t * t * (t + 1)))
