"""R-indicators, coefficients of variation and partial indicators per group.

Everything is a weighted sum over covariate cells: a cell's propensity p and
gradient z are the same for all its cases.  Spark does the sums; Python gets
one row per group (or group and category) holding k x k sums, and returns the
three matrix forms the bias and variance formulas need.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..specs import ModelSpec
from ..stages import stage
from .cells import covariate_cells, design_array, infer_strata
from .propensity import fit_grouped, fit_models, linear_part

_FORMS = "trace double, quad double, square double"


def _forms(centred: bool):
    """pandas UDF: (sums, sigma, total) -> tr(S M), a'S a, tr(B S B S).

    ``sums`` are second moments of (1, q, z), S is sigma.  M holds the sums over
    z; a and B are the covariances with and of z when ``centred``, else the
    plain sums.
    """

    @F.pandas_udf(_FORMS)
    def forms(sums: pd.Series, sigma: pd.Series, total: pd.Series) -> pd.DataFrame:
        out = []
        for s, g, n in zip(sums, sigma, total):
            if g is None:
                out.append((None, None, None))
                continue
            size = int(round(len(g) ** 0.5))
            cov = np.asarray(g, float).reshape(size, size)
            whole = int(round((8 * len(s) + 1) ** 0.5 - 1)) // 2  # of the widest model in the table
            m = np.zeros((whole, whole))
            m[np.triu_indices(whole)] = s
            m = np.maximum(m, m.T) + np.minimum(m, m.T) - np.diag(np.diag(m))
            m = m[: size + 2, : size + 2]
            zz, a = m[2:, 2:], m[1, 2:]
            b = zz
            if centred:
                mean = m[0, 2:] / n
                a = a / n - mean * (m[0, 1] / n)
                b = zz / n - np.outer(mean, mean)
            bs = b @ cov
            out.append((float(np.sum(cov * zz)), float(a @ cov @ a), float(np.sum(bs * bs.T))))
        return pd.DataFrame(out, columns=["trace", "quad", "square"], dtype=float)

    return forms


def _sum_or_null(c: Column) -> Column:
    """Sum that is NULL when any term is NULL."""
    return F.when(F.count_if(c.isNull()) == 0, F.sum(c))


def _rows_variance(n: Column, s1: Column, s2: Column) -> Column:
    """Sample variance of n values with sum s1 and sum of squares s2."""
    return F.try_divide(F.greatest(s2 - s1 * s1 / n, F.lit(0.0)), n - 1)


def _stratum_term(big_n: Column, n: Column, variance: Column) -> Column:
    return big_n * big_n * (1 - n / big_n) * variance / n


def _pps(n: Column, total: Column, square: Column) -> Column:
    return F.try_divide(n * square - total * total, n - 1)


def scored_cells(cells: DataFrame, fits: DataFrame, by: Sequence[str], family: str) -> DataFrame:
    """Cells (with design row x) plus p, z, stratum and group totals, written once.

    Totals are aggregated and joined back, not taken by a window over cells, so
    a group with very many cells is combined map-side.
    """
    by = list(by)
    c = cells.join(fits.select(*by, "effects"), by)
    eta = linear_part(F.col("x"), F.col("effects"))
    c = c.withColumn("p", eta if family == "gaussian" else 1 / (1 + F.exp(-eta)))
    strata = c.groupBy(*by, "stratum").agg(
        F.sum("w").alias("st_pop"),
        F.sum("n").alias("st_rows"),
        F.sum(F.col("w") * F.col("p")).alias("_wp"),
        (F.min("wmin") == F.max("wmax")).alias("_flat"),
    )
    group = Window.partitionBy(*by)  # over one row per stratum
    totals = stage(
        strata.select(
            *by, "stratum", "st_pop", "st_rows",
            F.sum("st_pop").over(group).alias("pop"),
            F.sum("st_rows").over(group).alias("rows"),
            (F.sum("_wp").over(group) / F.sum("st_pop").over(group)).alias("p_mean"),
            F.bool_and("_flat").over(group).alias("constant_weights"),
            F.count(F.lit(1)).over(group).alias("n_strata"),
        ),
        "totals",
    )
    g = F.lit(1.0) if family == "gaussian" else F.col("p") * (1 - F.col("p"))
    c = c.withColumn("z", F.transform("x", lambda v: v * g))
    c = c.drop("x", "effects", "wmin", "wmax", "answered")
    return stage(c.join(totals, [*by, "stratum"]), "scored")


def var_totals(
    c: DataFrame, by: Sequence[str], values: dict[str, Column]
) -> DataFrame:
    """Design variance of the total of several cell-constant values, per group."""
    per = c.groupBy(*by, "stratum", "st_pop", "st_rows", "constant_weights", "rows").agg(*[
        a
        for k, v in values.items()
        for a in (
            F.sum(F.col("n") * v).alias(f"_s1_{k}"),
            F.sum(F.col("n") * v * v).alias(f"_s2_{k}"),
            F.sum(F.col("w") * v).alias(f"_t_{k}"),
            F.sum(F.col("w2") * v * v).alias(f"_q_{k}"),
        )
    ])
    big_n, n = F.col("st_pop"), F.col("st_rows")
    out = per.groupBy(*by, "constant_weights", "rows").agg(*[
        a
        for k in values
        for a in (
            _sum_or_null(_stratum_term(
                big_n, n, _rows_variance(n, F.col(f"_s1_{k}"), F.col(f"_s2_{k}"))
            )).alias(f"_st_{k}"),
            F.sum(f"_t_{k}").alias(f"_t_{k}"),
            F.sum(f"_q_{k}").alias(f"_q_{k}"),
        )
    ])
    return out.select(*by, *[
        F.when(F.col("constant_weights"), F.col(f"_st_{k}"))
        .otherwise(_pps(F.col("rows"), F.col(f"_t_{k}"), F.col(f"_q_{k}"))).alias(k)
        for k in values
    ])


def covariances(fits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each group's covariance of the effects; NULL where the design is incomplete."""
    return fits.select(*by, F.when(F.col("complete"), F.col("sigma")).alias("sigma"))


def moment_columns(c: DataFrame, by: Sequence[str], value: Column, gradient: str, size: int) -> DataFrame:
    """``sums``: sums of w v_i v_j (i <= j, by rows) of v = (1, value, gradient), one row per group.

    The number of sums is fixed by the model, so they are plain columns of one aggregation.
    """
    parts = [F.coalesce(F.get(gradient, F.lit(i)), F.lit(0.0)) for i in range(size)]
    entries = c.select(*by, "w", value.alias("_v1"), *[p.alias(f"_v{i + 2}") for i, p in enumerate(parts)])
    v = [F.lit(1.0), *[F.col(f"_v{i}") for i in range(1, size + 2)]]
    pairs = [(i, j) for i in range(size + 2) for j in range(i, size + 2)]
    sums = entries.groupBy(*by).agg(*[F.sum(F.col("w") * v[i] * v[j]).alias(f"_m{i}_{j}") for i, j in pairs])
    return sums.select(*by, F.array(*[F.col(f"_m{i}_{j}") for i, j in pairs]).alias("sums"))


def r_indicator(c: DataFrame, by: Sequence[str], sigma: DataFrame, size: int) -> DataFrame:
    """R, CV, their unadjusted versions and standard errors; one row per group.

    ``sigma`` comes from ``covariances``; ``size`` is the length of the (longest) design row.
    """
    by = list(by)
    q = F.col("p") - F.col("p_mean")
    const = [*by, "pop", "rows", "p_mean"]
    spread = c.groupBy(*const).agg(
        F.sum(F.col("w") * q * q).alias("_ss"),
        F.first("constant_weights").alias("_flat"),
        F.first("n_strata").alias("n_strata"),
    )
    sums = moment_columns(c, by, q, "z", size)
    v = var_totals(c, by, {"_vp": F.col("p"), "_vq": q * q})
    r = spread.join(sums, by).join(v, by).join(sigma, by)
    r = r.withColumn("f", _forms(True)("sums", "sigma", "pop"))
    n, s2 = F.col("pop"), F.try_divide("_ss", F.col("pop") - 1)
    bias = (F.col("f.trace") - F.col("_vp") / n) / n
    var = F.try_divide(
        4 * F.col("f.quad") + 2 * F.col("f.square") + F.col("_vq") / (n * n), F.col("_ss") / n
    )
    r = r.select(*const, "_flat", "n_strata", s2.alias("s2"), bias.alias("bias"), var.alias("r_var"))
    factor = F.when(F.col("bias") > F.col("s2"), F.lit(0.0)).otherwise(
        1 - F.try_divide("bias", "s2")
    )
    r = r.withColumn("bias_factor", F.when(F.col("bias").isNotNull(), factor))
    sd, adj = F.sqrt("s2"), F.sqrt(F.col("s2") * F.col("bias_factor"))
    cv = F.try_divide(adj, F.col("p_mean"))
    return r.select(
        *by,
        F.col("rows").alias("n_obs"),
        F.col("pop").alias("population"),
        F.when(~F.col("_flat"), "PPS").when(F.col("n_strata") == 1, "SI").otherwise("STSI")
        .alias("design"),
        F.col("p_mean").alias("prop_mean"),
        (1 - 2 * adj).alias("r"),
        (1 - 2 * sd).alias("r_unadj"),
        F.sqrt("r_var").alias("r_se"),
        "bias_factor",
        cv.alias("cv"),
        F.try_divide(sd, F.col("p_mean")).alias("cv_unadj"),
        F.sqrt(
            0.25 * F.col("r_var") / F.col("p_mean") ** 2 + cv ** 4 / F.col("rows")
        ).alias("cv_se"),
    )


def _by_variable(c: DataFrame, variables: Sequence[str], covariates: Sequence[str]) -> DataFrame:
    """Cells repeated per variable: its category, and the pattern of all other model variables."""

    def others(v: str) -> Column:
        rest = [F.col(o).cast("string") for o in covariates if o != v]
        return F.to_json(F.array(*rest)) if rest else F.lit("[]")

    each = F.explode(F.array(*[
        F.struct(
            F.lit(v).alias("variable"), F.col(v).cast("string").alias("category"),
            others(v).alias("others"),
        )
        for v in variables
    ]))
    return c.withColumn("_k", each).select("*", "_k.*").drop("_k")


def _one_factor_se(c: DataFrame, by: Sequence[str], family: str) -> DataFrame:
    """Half the standard error of R for the model on the variable alone.

    A model with one factor is saturated: its propensities are the category
    means, so the matrix forms collapse to sums over categories.
    """
    key = [*by, "variable"]
    cat = c.groupBy(*key, "category", "pop", "rows", "p_mean", "constant_weights").agg(
        F.sum("w").alias("cw"), F.sum("y").alias("cy"), F.sum("yy").alias("cyy")
    ).withColumn("m", F.col("cy") / F.col("cw"))
    var_w = Window.partitionBy(*key)
    if family == "gaussian":
        scale = F.col("rows") / F.col("pop")
        rss = F.sum(scale * (F.col("cyy") - F.col("cy") * F.col("m"))).over(var_w)
        spread = F.try_divide(rss, F.col("rows") - F.count(F.lit(1)).over(var_w))
    else:
        spread = F.col("m") * (1 - F.col("m"))
    cat = stage(
        cat.withColumns({"v": spread, "mean": F.sum("cy").over(var_w) / F.col("pop")}), "one-factor"
    )
    n, big = F.col("rows"), F.col("pop")
    dev = F.col("m") - F.col("mean")
    s = F.col("cw") * F.col("v")
    sums = cat.groupBy(*key, "pop", "rows").agg(
        F.sum(F.col("cw") * F.col("v") * dev * dev).alias("_a"),
        F.sum((F.col("v") / n) ** 2 * (1 - F.col("cw") / big) ** 2).alias("_b1"),
        F.sum(s).alias("_s"),
        F.sum(s * s).alias("_s2"),
        F.sum(F.col("cw") * dev * dev).alias("_ss"),
    )
    means = cat.select(*key, "category", "m", "mean")
    q = F.col("m") - F.col("mean")
    v = var_totals(c.join(means, [*key, "category"]), key, {"_vq": q * q})
    square = F.col("_b1") + (F.col("_s") ** 2 - F.col("_s2")) / (big * big * n * n)
    r_var = F.try_divide(
        4 * F.col("_a") / (big * n) + 2 * square + F.col("_vq") / (big * big),
        F.col("_ss") / big,
    )
    return sums.join(v, key).select(*key, (0.5 * F.sqrt(r_var)).alias("pu_se"))


def unconditional_partials(
    c: DataFrame, by: Sequence[str], variables: Sequence[str], covariates: Sequence[str],
    family: str,
) -> tuple[DataFrame, DataFrame]:
    """(by variable: pu_unadj, pu_se), (by category: pu_unadj, pu_unadj_se)."""
    key = [*by, "variable"]
    long = _by_variable(c, variables, covariates)
    # Category sums inside each stratum, and what the stratum holds in total.
    per = long.groupBy(
        *key, "category", "stratum", "st_pop", "st_rows", "pop", "rows", "p_mean",
        "constant_weights",
    ).agg(
        F.sum("w").alias("cw"),
        F.sum(F.col("w") * F.col("p")).alias("ct"),
        F.sum(F.col("w2") * F.col("p") ** 2).alias("cq"),
        F.sum(F.col("n") * F.col("p")).alias("s1"),
        F.sum(F.col("n") * F.col("p") ** 2).alias("s2"),
    )
    st = Window.partitionBy(*key, "stratum")
    whole = Window.partitionBy(*key)
    per = per.withColumns({f"{x}_h": F.sum(x).over(st) for x in ("s1", "s2")})
    per = per.withColumns({f"{x}_all": F.sum(x).over(whole) for x in ("ct", "cq")})
    big_n, n = F.col("st_pop"), F.col("st_rows")
    inside = _stratum_term(big_n, n, _rows_variance(n, F.col("s1"), F.col("s2")))
    outside = _stratum_term(
        big_n, n,
        _rows_variance(n, F.col("s1_h") - F.col("s1"), F.col("s2_h") - F.col("s2")),
    )
    every = _stratum_term(big_n, n, _rows_variance(n, F.col("s1_h"), F.col("s2_h")))
    first = F.row_number().over(st.orderBy("category")) == 1
    per = per.withColumns({"_in": inside, "_out": outside, "_every": every})
    per = per.withColumn("_first", first).withColumn(
        "_every_all", F.sum(F.when(F.col("_first"), F.col("_every"))).over(whole)
    )
    cat = per.groupBy(
        *key, "category", "pop", "rows", "p_mean", "constant_weights", "ct_all", "cq_all", "_every_all"
    ).agg(
        F.sum("cw").alias("cw"),
        F.sum("ct").alias("ct"),
        F.sum("cq").alias("cq"),
        _sum_or_null(F.col("_in")).alias("_in"),
        # Strata without the category keep their full variance.
        _sum_or_null(F.col("_out") - F.col("_every")).alias("_out"),
    )
    v1 = F.when(F.col("constant_weights"), F.col("_in")).otherwise(
        _pps(F.col("rows"), F.col("ct"), F.col("cq"))
    )
    v2 = F.when(F.col("constant_weights"), F.col("_every_all") + F.col("_out")).otherwise(
        _pps(F.col("rows"), F.col("ct_all") - F.col("ct"), F.col("cq_all") - F.col("cq"))
    )
    dev = F.col("ct") / F.col("cw") - F.col("p_mean")
    part = F.col("cw") * dev * dev / F.col("pop")
    se2 = F.col("cw") / F.col("pop") * (
        F.greatest(v1, F.lit(0.0)) * (1 / F.col("cw") - 1 / F.col("pop")) ** 2
        + F.greatest(v2, F.lit(0.0)) / F.col("pop") ** 2
    )
    by_category = cat.select(
        *key, "category", part.alias("_part"),
        (F.signum(dev) * F.sqrt(part)).alias("pu_unadj"), F.sqrt(se2).alias("pu_unadj_se"),
    )
    by_variable = by_category.groupBy(*key).agg(F.sqrt(F.sum("_part")).alias("pu_unadj"))
    by_variable = by_variable.join(_one_factor_se(long, by, family), key)
    return by_variable, by_category.drop("_part")


def conditional_partials(
    c: DataFrame, spec: ModelSpec, by: Sequence[str], variables: Sequence[str],
    sigma: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(by variable: pc_unadj), (by category: pc_unadj, pc_unadj_se).

    Each cell is compared with the mean of the cells that share all *other*
    model variables; without other variables that is the grand mean.  A
    variable outside the model adds nothing beyond it: zero, with error zero.
    The means are aggregated and joined back: no task holds a group's cells.  Standard errors
    need ``sigma`` (``covariances``).
    """
    key = [*by, "variable"]
    size = len(spec.coordinates())
    long = _by_variable(c, variables, spec.covariates)
    w = F.col("w")
    inside = F.col("variable").isin(spec.factors)
    z = [F.get("z", F.lit(i)) for i in range(size)] if sigma is not None else []
    means = stage(
        long.filter(inside).groupBy(*key, "others").agg(
            *[(F.sum(w * v) / F.sum(w)).alias(f"_mean{i}") for i, v in enumerate([F.col("p"), *z])]
        ),
        "peers",
    )
    long = long.join(means, [*key, "others"], "left")

    def centre(v: Column, i: int) -> Column:
        return F.when(inside, v - F.col(f"_mean{i}")).otherwise(F.lit(0.0))

    centred = stage(
        long.select(
            *key, "category", "stratum", "st_pop", "st_rows", "constant_weights", "rows",
            "n", "w", "w2", "pop",
            centre(F.col("p"), 0).alias("d"),
            *([F.array(*[centre(v, i + 1) for i, v in enumerate(z)]).alias("dz")] if z else []),
        ),
        "centred",
    )
    d = F.col("d")
    by_cat = centred.groupBy(*key, "category", "pop").agg(F.sum(w * d * d).alias("_ss"))
    by_variable = by_cat.groupBy(*key, "pop").agg(
        F.sqrt(F.sum("_ss") / F.col("pop")).alias("pc_unadj")
    ).drop("pop")
    pc = F.sqrt(F.col("_ss") / F.col("pop")).alias("pc_unadj")
    if sigma is None:
        return by_variable, by_cat.select(*key, "category", pc)
    cat_key = [*key, "category"]
    sums = moment_columns(centred, cat_key, d, "dz", size)
    v = category_var_totals(centred, key, d * d)
    r = by_cat.join(sums, cat_key).join(v, cat_key).join(sigma, list(by))
    r = r.withColumn("f", _forms(False)("sums", "sigma", "pop"))
    var = F.try_divide(
        0.25 * (4 * F.col("f.quad") + 2 * F.col("f.square") + F.col("var_total")),
        F.col("pop") * F.col("_ss"),
    )
    var = F.when((F.col("_ss") == 0) & F.col("sigma").isNotNull(), F.lit(0.0)).otherwise(var)
    return by_variable, r.select(*cat_key, pc, F.sqrt(var).alias("pc_unadj_se"))


def category_var_totals(c: DataFrame, key: Sequence[str], y: Column) -> DataFrame:
    """Design variance of the total of ``y`` restricted to each category."""
    n, big = F.col("st_rows"), F.col("st_pop")
    per = c.groupBy(
        *key, "category", "stratum", "st_pop", "st_rows", "constant_weights", "rows"
    ).agg(
        F.sum(F.col("n") * y).alias("_s1"), F.sum(F.col("n") * y * y).alias("_s2"),
        F.sum(F.col("w") * y).alias("_t"), F.sum(F.col("w2") * y * y).alias("_q"),
    )
    term = _stratum_term(big, n, _rows_variance(n, F.col("_s1"), F.col("_s2")))
    out = per.groupBy(*key, "category", "constant_weights", "rows").agg(
        _sum_or_null(term).alias("_st"), F.sum("_t").alias("_t"), F.sum("_q").alias("_q")
    )
    return out.select(
        *key, "category",
        F.when(F.col("constant_weights"), F.col("_st"))
        .otherwise(_pps(F.col("rows"), F.col("_t"), F.col("_q"))).alias("var_total"),
    )


@dataclass
class Indicators:
    """overall: one row per group and response; partials are None unless asked for."""

    overall: DataFrame
    by_variable: DataFrame | None = None
    by_category: DataFrame | None = None


def merge_categories(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Inner merge of two category tables on group, variable and category."""
    return left.join(right, [*key, "variable", "category"])


def overall_indicators(
    models: dict[str, tuple[DataFrame, ModelSpec]], by: Sequence[str], family: str = "binomial"
) -> DataFrame:
    """Indicators under several models in one pass: name -> (cells, spec).

    Past the design row nothing depends on the model, so the cells of all
    models are stacked and every later step runs once.
    """
    by = list(by)
    fits = fit_models(models, by, family)
    stacked = reduce(DataFrame.unionByName, [
        cells.select(
            *by, F.lit(name).alias("model"), "stratum", "n", "w", "w2", "wmin", "wmax",
            design_array(spec).alias("x"),
        )
        for name, (cells, spec) in models.items()
    ])
    key, widest = [*by, "model"], max(len(spec.coordinates()) for _, spec in models.values())
    return r_indicator(scored_cells(stacked, fits, key, family), key, covariances(fits, key), widest)


def cell_indicators(
    cells: DataFrame, spec: ModelSpec, by: Sequence[str], family: str = "binomial",
    partials: bool = False, other_variables: Sequence[str] = (),
) -> Indicators:
    """Indicators from cells that carry ``stratum``; ``by`` includes the response."""
    by = list(by)
    fits = fit_grouped(cells, spec, by, family)
    ready = cells.select("*", design_array(spec).alias("x"))
    c = scored_cells(ready, fits, by, family)
    sigma = covariances(fits, by)
    overall = r_indicator(c, by, sigma, len(spec.coordinates()))
    if not partials:
        return Indicators(overall)
    overall = stage(overall, "indicators")
    variables = list(dict.fromkeys([*spec.factors, *other_variables]))
    pu_var, pu_cat = unconditional_partials(c, by, variables, spec.covariates, family)
    pc_var, pc_cat = conditional_partials(c, spec, by, variables, sigma)
    factor = overall.select(*by, "bias_factor", "prop_mean")
    v = pu_var.join(pc_var, [*by, "variable"]).join(factor, by)
    root = F.sqrt("bias_factor")
    mean = F.col("prop_mean")
    v = v.select(
        *by, "variable",
        (F.col("pu_unadj") * root).alias("pu"), "pu_unadj", "pu_se",
        (F.col("pc_unadj") * root).alias("pc"), "pc_unadj",
        F.col("pu_se").alias("pc_se_approx"),
        "prop_mean",
    )
    partial_cv = ["pu", "pu_unadj", "pu_se", "pc", "pc_unadj", "pc_se_approx"]
    v = v.select(
        "*", *[F.try_divide(F.col(x), mean).alias("cv" + x[1:]) for x in partial_cv]
    ).drop("prop_mean")
    cat = merge_categories(pu_cat, pc_cat, by).join(factor.drop("bias_factor"), by)
    cat = cat.select(
        *[x for x in cat.columns if x != "prop_mean"],
        *[
            F.try_divide(F.col(x), mean).alias("cv" + x[1:])
            for x in ("pu_unadj", "pu_unadj_se", "pc_unadj", "pc_unadj_se")
        ],
    )
    return Indicators(overall, v, cat)


def indicator_by_group(
    df: DataFrame, spec: ModelSpec, responses: Sequence[str], by: Sequence[str],
    weight: str | None = None, stratum: str | None = None, family: str = "binomial",
    partials: bool = False, other_variables: Sequence[str] = (), max_strata: int = 20,
) -> Indicators:
    """Representativeness of one or more responses in every group of ``df``.

    Without ``stratum`` the strata are read off the weights (up to ``max_strata``
    distinct weights: one stratum each; more: one stratum).
    """
    if weight is None:
        df, stratum = df.withColumn("stratum", F.lit(1)), "stratum"
    elif stratum is None:
        df, stratum = infer_strata(df, by, weight, max_strata), "stratum"
    else:
        df, stratum = df.withColumn("stratum", F.col(stratum)), "stratum"
    covariates = list(dict.fromkeys([*spec.covariates, *other_variables]))
    cells = covariate_cells(df, by, covariates, responses, weight, stratum)
    return cell_indicators(
        cells, spec, [*by, "response"], family, partials, other_variables
    )


def summarise_indicator(overall: DataFrame, keep: Sequence[str]) -> DataFrame:
    """CV, its standard error and 95 % interval, and the response rate."""
    return overall.select(
        *keep, "cv", "cv_se", F.col("prop_mean").alias("response_rate"),
        (F.col("cv") - 1.96 * F.col("cv_se")).alias("cv_ci95_lower"),
        (F.col("cv") + 1.96 * F.col("cv_se")).alias("cv_ci95_upper"),
    )
