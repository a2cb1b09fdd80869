"""Covariate cells, weighted moments, design-based variances, strata.

Cases that share a covariate pattern contribute identically to every model and
indicator, so the raw table is read once, collapsed to cells with map-side
combine, and all statistics are sums over cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..specs import ModelSpec
from ..stages import stage

SUMS = ("n", "w", "w2", "y", "yy")


def covariate_cells(
    df: DataFrame, by: Sequence[str], covariates: Sequence[str], responses: Sequence[str],
    weight: str | None = None, stratum: str | None = None,
) -> DataFrame:
    """One row per (group, response, covariate pattern, stratum).

    n rows, w = sum of weights, w2 = sum of squared weights, y = sum of weight
    times response, yy = sum of weight times squared response, and the range of
    the weights.  All responses come from one aggregation over ``df``, and the
    cells are written once: everything after this step reads them, not ``df``.
    Refuses weights that are NULL, NaN, zero or negative, and NULL strata.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    unfit = w.isNull() | F.isnan(w) | (w <= 0)
    if stratum:
        unfit = unfit | F.col(stratum).isNull()
    value = {r: F.col(r).cast("double") for r in responses}
    keys = [*by, *covariates, *([stratum] if stratum else [])]
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(w).alias("w"),
        F.sum(w * w).alias("w2"),
        F.min(w).alias("wmin"),
        F.max(w).alias("wmax"),
        F.count_if(unfit).alias("_unfit"),
        *[F.sum(w * value[r]).alias(f"_y_{r}") for r in responses],
        *[F.sum(w * value[r] * value[r]).alias(f"_yy_{r}") for r in responses],
        *[F.count(value[r]).alias(f"_k_{r}") for r in responses],
    )
    per_response = F.explode(F.array(*[
        F.struct(
            F.lit(r).alias("response"), F.col(f"_y_{r}").alias("y"),
            F.col(f"_yy_{r}").alias("yy"), F.col(f"_k_{r}").alias("answered"),
        )
        for r in responses
    ]))
    carried = ["n", "w", "w2", "wmin", "wmax", "_unfit"]
    cells = sums.select(*keys, *carried, per_response.alias("_r")).select(
        *by, "_r.response", *keys[len(by):], *carried, "_r.y", "_r.yy", "_r.answered"
    )
    written = stage(cells, "cells")
    if (weight or stratum) and not written.filter("_unfit > 0").isEmpty():
        raise ValueError("weights must be positive numbers and strata must not be NULL")
    return written.drop("_unfit")


def rollup_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coarser cells from finer ones."""
    return cells.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in (*SUMS, "answered")],
        F.min("wmin").alias("wmin"),
        F.max("wmax").alias("wmax"),
    )


def _is_level(name: str, value: str) -> Column:
    return F.col(name).cast("string") == F.lit(value)


def design_array(spec: ModelSpec) -> Column:
    """Design row over the full effect layout (an indicator for every level)."""
    parts = []
    for c in spec.coordinates():
        if c.kind == "intercept":
            parts.append(F.lit(1.0))
        elif c.kind == "numeric":
            parts.append(F.col(c.names[0]).cast("double"))
        else:
            hit = _is_level(c.names[0], c.levels[0])
            for name, value in list(zip(c.names, c.levels))[1:]:
                hit = hit & _is_level(name, value)
            parts.append(hit.cast("double"))
    return F.array(*parts)


def design_matrix(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """Adds one indicator column per non-reference level and interaction pair."""
    ref = {m.name: m.values[0] for m in spec.main}
    cols = {}
    for c in spec.coordinates():
        if c.kind in ("level", "pair") and all(ref[n] != v for n, v in zip(c.names, c.levels)):
            hit = _is_level(c.names[0], c.levels[0])
            for name, value in list(zip(c.names, c.levels))[1:]:
                hit = hit & _is_level(name, value)
            cols[c.term] = hit.cast("int")
    return df.withColumns(cols)


def weighted_moments(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], weight: str | None = None
) -> DataFrame:
    """Weighted mean, unbiased and ML variance of each column, ML covariance of each pair.

    Two passes (means, then centred sums); the table of means is one row per group.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    means = stage(
        df.groupBy(*by).agg(
            F.sum(w).alias("_sw"),
            *[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"mean_{c}") for c in cols],
        ),
        "means",
    )
    centred = df.join(means, list(by))
    dev = {c: F.col(c) - F.col(f"mean_{c}") for c in cols}
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    ss = centred.groupBy(*by, "_sw", *[f"mean_{c}" for c in cols]).agg(
        *[F.sum(w * dev[c] * dev[c]).alias(f"_ss_{c}") for c in cols],
        *[F.sum(w * dev[a] * dev[b]).alias(f"_sp_{a}_{b}") for a, b in pairs],
    )
    return ss.select(
        *by,
        F.col("_sw").alias("sum_w"),
        *[f"mean_{c}" for c in cols],
        *[F.try_divide(F.col(f"_ss_{c}"), F.col("_sw") - 1).alias(f"var_{c}") for c in cols],
        *[F.try_divide(F.col(f"_ss_{c}"), F.col("_sw")).alias(f"var_ml_{c}") for c in cols],
        *[F.try_divide(F.col(f"_sp_{a}_{b}"), F.col("_sw")).alias(f"cov_{a}_{b}") for a, b in pairs],
    )


def strata_var_total(
    df: DataFrame, by: Sequence[str], y: str, weight: str, stratum: str, out: str = "var_total"
) -> DataFrame:
    """Variance of a total under (stratified) simple random sampling.

    Sum over strata of N^2 (1 - n/N) var(y) / n; NULL when a stratum has one row.
    """
    per = df.groupBy(*by, stratum).agg(
        F.sum(F.col(weight).cast("double")).alias("_pop"),
        F.count(F.lit(1)).alias("_rows"),
        F.var_samp(y).alias("_v"),
    )
    term = F.col("_pop") ** 2 * (1 - F.col("_rows") / F.col("_pop")) * F.col("_v") / F.col("_rows")
    return per.groupBy(*by).agg(
        F.when(F.count_if(F.col("_v").isNull()) == 0, F.sum(term)).alias(out)
    )


def pps_var_total(
    df: DataFrame, by: Sequence[str], y: str, weight: str, out: str = "var_total"
) -> DataFrame:
    """Variance of a total under unequal-probability sampling: (n sum t^2 - T^2) / (n - 1)."""
    t = F.col(y) * F.col(weight)
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        F.try_divide(n * F.sum(t * t) - F.sum(t) * F.sum(t), n - 1).alias(out)
    )


def group_share_by_category(
    df: DataFrame, by: Sequence[str], category: str, value: str, weight: str | None = None
) -> DataFrame:
    """Sum of weights and weighted mean of ``value`` per category."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    v = F.col(value).cast("double")
    return df.groupBy(*by, category).agg(
        F.sum(w).alias("sum_w"), (F.sum(w * v) / F.sum(w)).alias("share")
    )


def group_mean_broadcast(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None,
    out: str = "group_mean",
) -> DataFrame:
    """Weighted mean within a combination of keys, put back on each row.

    Aggregate and join instead of a window: a combination holding much of the
    table is combined map-side and never sits in one task.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    v = F.col(value).cast("double")
    means = stage(df.groupBy(*keys).agg((F.sum(w * v) / F.sum(w)).alias(out)), "group-means")
    return df.join(means, list(keys), "left")


def infer_strata(
    df: DataFrame, by: Sequence[str], weight: str, max_strata: int = 20, out: str = "stratum"
) -> DataFrame:
    """Number strata by distinct weight when a group has few, else one stratum.

    Refuses NULL weights: they would be a stratum of their own and move the others up.
    """
    few = (
        df.groupBy(*by).agg(F.count_distinct(weight).alias("_k"))
        .filter(F.col("_k") <= max_strata)
    )
    # At most max_strata rows per group from here on.
    distinct = stage(df.select(*by, weight).distinct().join(few, list(by)), "weights")
    if not distinct.filter(F.col(weight).isNull()).isEmpty():
        raise ValueError("weights must be positive numbers and strata must not be NULL")
    numbered = stage(
        distinct.select(
            *by, weight,
            F.dense_rank().over(Window.partitionBy(*by).orderBy(weight)).alias(out),
        ),
        "strata",
    )
    return df.join(numbered, [*by, weight], "left").withColumn(
        out, F.coalesce(F.col(out), F.lit(1))
    )


def sample_design(df: DataFrame, by: Sequence[str], weight: str, stratum: str) -> DataFrame:
    """SI (one stratum), STSI (constant weight in each stratum) or PPS, per group."""
    per = df.groupBy(*by, stratum).agg(F.min(weight).alias("_lo"), F.max(weight).alias("_hi"))
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_strata"),
        F.bool_and(F.col("_lo") == F.col("_hi")).alias("constant_weights"),
    ).withColumn(
        "design",
        F.when(~F.col("constant_weights"), "PPS")
        .when(F.col("n_strata") == 1, "SI")
        .otherwise("STSI"),
    )
