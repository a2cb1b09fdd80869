"""One response-propensity model per group of a large table.

The raw rows are collapsed to covariate cells first; a group's model is then
fitted on its cells.  Groups whose covariates are continuous, so that cells do
not shrink, are fitted by distributed Newton steps instead: every step is one
aggregation over all cells, and only k x k sums reach Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..specs import Coordinate, ModelSpec
from ..stages import stage
from .cells import design_array

MAX_CELLS_IN_TASK = 100_000
MAX_ITERATIONS = 25
TOLERANCE = 1e-8  # relative change of the deviance
BOUND = 30.0  # linear predictors are clipped here
BOUNDARY = 15.0  # beyond this a fit counts as lying on the boundary

# First step of a logistic fit: a row starts at 3/4 when it responded and 1/4
# when not, which fixes its weight, working response and deviance.
START_WEIGHT = 0.75 * 0.25
START_RESPONSE = math.log(3) + 0.25 / START_WEIGHT
START_DEVIANCE = -math.log(0.75)

_FIT_FIELDS = [
    T.StructField("effects", T.ArrayType(T.DoubleType())),
    T.StructField("roles", T.ArrayType(T.StringType())),
    T.StructField("sigma", T.ArrayType(T.DoubleType())),
    T.StructField("p_values", T.ArrayType(T.DoubleType())),
    T.StructField("complete", T.BooleanType()),
    T.StructField("n_obs", T.LongType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("log_lik", T.DoubleType()),
    T.StructField("aic", T.DoubleType()),
    T.StructField("dispersion", T.DoubleType()),
    T.StructField("iterations", T.IntegerType()),
    T.StructField("converged", T.BooleanType()),
]


def coordinate_roles(coords: Sequence[Coordinate], present: Sequence[bool]) -> list[str]:
    """fitted, reference or absent, given which indicators occur in the group.

    The first level that occurs is the reference; an interaction cell without
    rows stays "fitted" here and is found to be aliased by the rank check.
    """
    roles, reference, seen = [], {}, {}
    for c, here in zip(coords, present):
        if c.kind in ("intercept", "numeric"):
            roles.append("fitted")
        elif c.kind == "level":
            seen[c.names[0], c.levels[0]] = here
            if not here:
                roles.append("absent")
            elif c.names[0] not in reference:
                reference[c.names[0]] = c.levels[0]
                roles.append("reference")
            else:
                roles.append("fitted")
        elif not all(seen[n, v] for n, v in zip(c.names, c.levels)):
            roles.append("absent")
        elif any(reference[n] == v for n, v in zip(c.names, c.levels)):
            roles.append("reference")
        else:
            roles.append("fitted")
    return roles


def independent_columns(gram: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Columns, in order, that are not combinations of the columns before them."""
    left, kept = gram.copy(), []
    for j in range(len(gram)):
        if gram[j, j] > 0 and left[j, j] > tolerance * gram[j, j]:
            left -= np.outer(left[:, j], left[j]) / left[j, j]
            kept.append(j)
    return kept


def _fit_row(coords, roles, fitted, beta, inverse, rank, n_obs, log_lik, disp, iterations,
             converged, family) -> dict:
    """Expand a solution over the fitted columns to the full effect layout."""
    size = len(coords)
    effects = [None if r == "absent" else 0.0 for r in roles]
    sigma = np.zeros((size, size))
    p_values: list[float | None] = [None] * size
    for a, j in enumerate(fitted):
        effects[j] = float(beta[a])
        sigma[j, fitted] = inverse[a]
        if family == "binomial" and inverse[a, a] > 0:
            p_values[j] = math.erfc(abs(beta[a]) / math.sqrt(inverse[a, a]) / math.sqrt(2))
    parameters = rank + (family == "gaussian")
    return {
        "effects": effects,
        "roles": roles,
        "sigma": sigma.ravel().tolist(),
        "p_values": p_values,
        "complete": "aliased" not in roles,
        "n_obs": int(n_obs),
        "rank": int(rank),
        "log_lik": float(log_lik),
        "aic": float(2 * parameters - 2 * log_lik),
        "dispersion": float(disp),
        "iterations": int(iterations),
        "converged": bool(converged),
    }


def _alias(roles: list[str], gram: np.ndarray) -> list[int]:
    """Mark dependent columns as aliased; return the columns to fit."""
    candidates = [j for j, r in enumerate(roles) if r == "fitted"]
    fitted = [candidates[i] for i in independent_columns(gram[np.ix_(candidates, candidates)])]
    for j in candidates:
        if j not in fitted:
            roles[j] = "aliased"
    return fitted


def _inverse(info: np.ndarray) -> np.ndarray:
    """Inverse of an information matrix, scaled first: fits on the boundary have
    weights near zero in some columns only."""
    d = np.sqrt(np.maximum(np.diag(info), 1e-300))
    scaled = info / np.outer(d, d)
    try:
        return np.linalg.inv(scaled) / np.outer(d, d)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(scaled, hermitian=True) / np.outer(d, d)


def _irls(x: np.ndarray, w: np.ndarray, y: np.ndarray):
    """Reweighted least squares from the customary start and stopping rule.

    A fit away from the boundary is polished to full precision.  Where a
    category responds always or never the maximum lies at infinity and the
    answer *is* where the stopping rule ends the run, so it is left there.
    Returns beta, inverse information, log likelihood, steps, converged.
    """
    weight, target = START_WEIGHT * w, START_WEIGHT * START_RESPONSE * (2 * y - w)
    last, converged = 2 * w.sum() * START_DEVIANCE, False
    for step in range(1, MAX_ITERATIONS + 1):
        inverse = _inverse((x * weight[:, None]).T @ x)
        beta = inverse @ (x.T @ target)
        eta = np.clip(x @ beta, -BOUND, BOUND)
        mu = 1 / (1 + np.exp(-eta))
        log_lik = float(np.sum(y * eta - w * np.logaddexp(0, eta)))
        converged = abs(-2 * log_lik - last) / (abs(2 * log_lik) + 0.1) < TOLERANCE
        weight, last = w * mu * (1 - mu), -2 * log_lik
        target = weight * eta + y - w * mu
        if converged:
            break
    while converged and np.abs(eta).max() < BOUNDARY:
        inverse = _inverse((x * weight[:, None]).T @ x)
        change = inverse @ (x.T @ (y - w * mu))
        beta, step = beta + change, step + 1
        eta = np.clip(x @ beta, -BOUND, BOUND)
        mu = 1 / (1 + np.exp(-eta))
        log_lik = float(np.sum(y * eta - w * np.logaddexp(0, eta)))
        weight = w * mu * (1 - mu)
        if np.abs(change).max() < 1e-9 or step >= 2 * MAX_ITERATIONS:
            inverse = _inverse((x * weight[:, None]).T @ x)
            break
    return beta, inverse, log_lik, step, converged


def _residuals(rss: float, scale: float, n: float, rank: int) -> tuple[float, float]:
    """Dispersion and log likelihood of a linear fit; a perfect fit has none of the latter, a
    saturated one none of the former.  ``scale``: a residual this small against it is rounding."""
    if rss <= 1e-12 * scale:
        rss = 0.0
    disp = rss / (n - rank) if n > rank else math.nan
    return disp, -n / 2 * (math.log(2 * math.pi * rss / n) + 1) if rss > 0 else math.nan


def _solve_cells(pdf: pd.DataFrame, coords: Sequence[Coordinate], family: str) -> dict:
    x_all = np.stack(pdf["x"].to_numpy())
    n = pdf["n"].to_numpy(float)
    scale = n.sum() / pdf["w"].sum()  # weights with mean one
    w, y, yy = (pdf[c].to_numpy(float) * scale for c in ("w", "y", "yy"))
    roles = coordinate_roles(coords, (x_all != 0).any(axis=0))
    fitted = _alias(roles, (x_all * w[:, None]).T @ x_all)
    x = x_all[:, fitted]
    rank = len(fitted)
    if family == "gaussian":
        inverse = np.linalg.inv((x * w[:, None]).T @ x)
        beta = inverse @ (x.T @ y)
        mu = x @ beta
        rss = float(np.sum(yy - 2 * mu * y + w * mu * mu))
        disp, log_lik = _residuals(rss, float(np.sum(y * y / w)), n.sum(), rank)
        return _fit_row(coords, roles, fitted, beta, inverse * disp, rank, n.sum(), log_lik,
                        disp, 1, True, family)
    beta, inverse, log_lik, steps, converged = _irls(x, w, y)
    return _fit_row(coords, roles, fitted, beta, inverse, rank, n.sum(), log_lik, 1.0, steps,
                    converged, family)


def _by_schema(df: DataFrame, by: Sequence[str]) -> list[T.StructField]:
    return [df.schema[c] for c in by]


def prepare_cells(cells: DataFrame, spec: ModelSpec, by: Sequence[str]) -> DataFrame:
    """Cells with their design row."""
    return cells.select(*by, "n", "w", "y", "yy", "answered", design_array(spec).alias("x"))


def large_groups(
    ready: dict[str, DataFrame], by: Sequence[str], max_cells: int
) -> tuple[DataFrame, set[str]]:
    """Written (name, group) of the groups with more than ``max_cells`` cells, and the names that have any.

    One job for all prepared tables; at most cells / max_cells rows are left.  Refuses incomplete
    cases: they would have to be dropped from model and indicator alike, which
    ``complete_cases`` does.
    """
    bad = F.exists("x", lambda v: v.isNull()) | (F.col("answered") < F.col("n"))
    counts = [
        r.groupBy(*by).agg(F.count(F.lit(1)).alias("_cells"), F.count_if(bad).alias("_bad"))
        .select(F.lit(name).alias("_name"), *by, "_cells", "_bad")
        for name, r in ready.items()
    ]
    found = reduce(DataFrame.unionByName, counts).filter((F.col("_cells") > max_cells) | (F.col("_bad") > 0))
    found = stage(found, "large-groups")
    names = found.groupBy("_name").agg(F.max("_bad").alias("_bad"), F.max("_cells").alias("_cells")).collect()
    if any(r._bad for r in names):
        raise ValueError("covariates and responses must be complete: use complete_cases first")
    return found, {r._name for r in names}


def spread(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Hash partitioning on ``by`` that adaptive execution does not shrink."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *by)


def fit_in_tasks(
    ready: DataFrame, spec: ModelSpec, by: Sequence[str], family: str = "binomial"
) -> DataFrame:
    """Lazy fit of prepared cells, one task per group; see ``fit_grouped``."""
    by, coords = list(by), spec.coordinates()
    schema = T.StructType(_by_schema(ready, by) + _FIT_FIELDS)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        key = {c: pdf[c].iloc[0] for c in by}
        return pd.DataFrame([{**key, **_solve_cells(pdf, coords, family)}])

    # A fit costs far more than its few cells weigh, so the groups keep the full
    # number of shuffle partitions instead of being coalesced by size.
    return spread(ready, by).groupBy(*by).applyInPandas(solve, schema)


def fit_grouped(
    cells: DataFrame, spec: ModelSpec, by: Sequence[str], family: str = "binomial",
    max_cells: int = MAX_CELLS_IN_TASK,
) -> DataFrame:
    """Coefficients, their covariance and fit statistics, one row per group.

    ``cells`` comes from ``covariate_cells``.  Each group's own size decides its
    way: cells that fit in one task are solved there, otherwise each Newton
    step is a distributed aggregation over the cells of such groups.
    """
    return fit_models({"": (cells, spec)}, by, family, max_cells).drop("model")


def fit_models(
    models: dict[str, tuple[DataFrame, ModelSpec]], by: Sequence[str], family: str = "binomial",
    max_cells: int = MAX_CELLS_IN_TASK,
) -> DataFrame:
    """Several models at once: name -> (cells, spec).  Adds the name as ``model``.

    Groups that fit in tasks are solved together in one job, whatever the size of the others.
    """
    by, parts = list(by), []
    ready = {name: prepare_cells(cells, spec, by) for name, (cells, spec) in models.items()}
    large, names = large_groups(ready, by, max_cells)
    for name, (_, spec) in models.items():
        cells = ready[name].drop("answered")
        if name in names:
            own = large.filter(F.col("_name") == name).select(*[F.col(b).alias(f"_l_{b}") for b in by])
            in_large = reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"_l_{b}")) for b in by], F.lit(True))
            fits = _fit_iterative(cells.join(own, in_large, "left_semi"), spec, by, family)
            parts.append(fits.withColumn("model", F.lit(name)))
            cells = cells.join(own, in_large, "left_anti")
        parts.append(fit_in_tasks(cells, spec, by, family).withColumn("model", F.lit(name)))
    return stage(reduce(DataFrame.unionByName, parts), "fits")


def linear_part(x: Column, effects: Column) -> Column:
    return F.aggregate(
        F.zip_with(x, effects, lambda a, b: a * F.coalesce(b, F.lit(0.0))),
        F.lit(0.0), lambda acc, v: acc + v,
    )


def pair_columns(size: int, vector: str, weight: str) -> list[Column]:
    """Aggregates ``_s<i>_<j>`` = sum of weight * v_i * v_j (i <= j) of an array of known length."""
    w = F.col(weight)
    v = [F.get(vector, F.lit(i)) for i in range(size)]
    return [
        F.sum(w * v[i] * v[j]).alias(f"_s{i}_{j}") for i in range(size) for j in range(i, size)
    ]


def pair_list(size: int) -> Column:
    """The columns of ``pair_columns`` as the list that ``to_matrix`` reads."""
    return F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_s{i}_{j}").alias("v"))
        for i in range(size) for j in range(i, size)
    ])


def to_matrix(sums, size: int) -> np.ndarray:
    m = np.zeros((size, size))
    for e in sums:
        m[e["i"], e["j"]] = m[e["j"], e["i"]] = e["v"]
    return m


def _fit_iterative(ready: DataFrame, spec: ModelSpec, by: list[str], family: str) -> DataFrame:
    """The same fit by aggregations over all cells; state is one row per group.

    A step sums W x x' with the working response as one more column, in one aggregation.  The state
    is written after each step, which also cuts the lineage.
    """
    coords = spec.coordinates()
    size = len(coords)
    totals = ready.groupBy(*by).agg(F.sum("n").alias("_n"), F.sum("w").alias("_sw"))
    fields = _by_schema(ready, by)
    extra = [("_n", T.LongType()), ("_sw", T.DoubleType()), ("_last", T.DoubleType()),
             ("_done", T.BooleanType()), ("_polish", T.BooleanType())]
    schema = T.StructType(fields + [T.StructField(n, t) for n, t in extra] + _FIT_FIELDS)
    blank = {f.name: F.lit(None).cast(f.dataType) for f in _FIT_FIELDS}
    blank["effects"] = F.array(*[F.lit(0.0)] * size)
    blank["iterations"] = F.lit(0)
    state = stage(
        totals.select(
            *by, "_n", "_sw", (2 * F.col("_n") * START_DEVIANCE).alias("_last"),
            F.lit(False).alias("_done"), F.lit(False).alias("_polish"),
            *[c.alias(n) for n, c in blank.items()],
        ),
        "newton",
    )

    def advance(batches):
        for pdf in batches:
            rows = [_advance_row(r, coords, family, by) for r in pdf.to_dict("records")]
            yield pd.DataFrame(rows, columns=schema.names)

    finished = []
    for step in range(2 * MAX_ITERATIONS):
        live = ready.join(state.select(*by, "_n", "_sw", "effects"), by)
        scale = F.col("_n") / F.col("_sw")
        eta = linear_part(F.col("x"), F.col("effects"))
        w, y, yy = (F.col(c) * scale for c in ("w", "y", "yy"))
        live = live.select(*by, "x", w.alias("w"), y.alias("y"), yy.alias("yy"), eta.alias("eta"))
        w, y, eta = F.col("w"), F.col("y"), F.col("eta")
        rss, log_lik, reach = F.lit(0.0), F.lit(0.0), F.lit(0.0)
        if family == "gaussian":
            weight, response = w, y / w
            rss = F.col("yy") - 2 * eta * y + w * eta * eta
        elif step == 0:
            weight, response = START_WEIGHT * w, START_RESPONSE * (2 * y / w - 1)
        else:
            bounded = F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), eta))
            mu = 1 / (1 + F.exp(-bounded))
            weight = w * mu * (1 - mu)
            response = bounded + (y - w * mu) / weight
            log_lik = y * bounded - w * F.log1p(F.exp(bounded))
            reach = F.abs(eta)
        live = live.select(
            *by, weight.alias("_weight"), F.concat("x", F.array(response)).alias("_v"),
            log_lik.alias("_ll"), rss.alias("_r"), reach.alias("_eta"),
        )
        totals = [
            F.sum("_ll").alias("_log_lik"), F.sum("_r").alias("_rss"), F.max("_eta").alias("_reach"),
        ]
        sums = live.groupBy(*by).agg(*pair_columns(size + 1, "_v", "_weight"), *totals).select(
            *by, pair_list(size + 1).alias("sums"), "_log_lik", "_rss", "_reach"
        )
        state = stage(sums.join(state, by).mapInPandas(advance, schema), "newton")
        finished.append(state.filter("_done").select(*by, *[f.name for f in _FIT_FIELDS]))
        state = state.filter(~F.col("_done"))
        if state.isEmpty():
            break
    return stage(reduce(DataFrame.unionByName, finished), "fits")


def _advance_row(r: dict, coords: Sequence[Coordinate], family: str, by: Sequence[str]) -> dict:
    """One step of one group's fit: judge the current effects, then move on or finish."""
    size, n, before = len(coords), r["_n"], int(r["iterations"])
    m = to_matrix(r["sums"], size + 1)
    info, score = m[:size, :size], m[:size, size]
    if before == 0:
        roles = coordinate_roles(coords, np.diag(info) > 0)
        fitted = _alias(roles, info)
    else:
        roles = list(r["roles"])
        fitted = [j for j, role in enumerate(roles) if role == "fitted"]
    inverse = _inverse(info[np.ix_(fitted, fitted)])
    beta = inverse @ score[fitted]
    log_lik, disp, done, polish, converged = r["_log_lik"], 1.0, False, bool(r["_polish"]), False
    steps = before + 1
    old = None
    if before:
        old = np.array([np.nan if e is None else e for e in r["effects"]], float)[fitted]
    if family == "gaussian":
        done = converged = before >= 1  # the second pass has the residuals
        if done:
            steps = 1
            disp, log_lik = _residuals(r["_rss"], float(m[size, size]), n, len(fitted))
    elif before:
        settled = abs(-2 * log_lik - r["_last"]) / (abs(2 * log_lik) + 0.1) < TOLERANCE
        converged = polish or settled
        if converged and r["_reach"] >= BOUNDARY or not converged and before >= MAX_ITERATIONS:
            # On the boundary, or out of steps: keep the effects and the information they came from.
            done, beta, steps = True, old, before
            inverse = np.array(r["sigma"], float).reshape(size, size)[np.ix_(fitted, fitted)]
        elif converged:
            done = bool(np.abs(beta - old).max() < 1e-9)
        polish = converged
        done = done or before + 1 >= 2 * MAX_ITERATIONS
    out = _fit_row(coords, roles, fitted, beta, inverse * disp, len(fitted), n, log_lik, disp,
                   steps, converged, family)
    return {**{c: r[c] for c in by}, "_n": n, "_sw": r["_sw"],
            "_last": -2 * log_lik if before else r["_last"], "_done": done, "_polish": polish, **out}


def fit_terms(fits: DataFrame, spec: ModelSpec, by: Sequence[str]) -> DataFrame:
    """One row per fitted term: estimate, std_error, statistic, p_value (NULL if aliased)."""
    size = len(spec.coordinates())
    terms = F.array(*[
        F.struct(
            F.lit(c.term).alias("term"),
            F.get("roles", F.lit(j)).alias("role"),
            F.get("effects", F.lit(j)).alias("estimate"),
            F.sqrt(F.get("sigma", F.lit(j * size + j))).alias("std_error"),
            F.get("p_values", F.lit(j)).alias("p_value"),
        )
        for j, c in enumerate(spec.coordinates())
    ])
    t = fits.select(*by, F.explode(terms).alias("t")).select(*by, "t.*")
    t = t.filter(F.col("role").isin("fitted", "aliased"))
    own = F.col("role") == "fitted"
    return t.select(
        *by, "term",
        F.when(own, F.col("estimate")).alias("estimate"),
        F.when(own, F.col("std_error")).alias("std_error"),
        F.when(own, F.try_divide("estimate", "std_error")).alias("statistic"),
        F.when(own, F.col("p_value")).alias("p_value"),
    )


def model_fit_stats(fits: DataFrame, by: Sequence[str]) -> DataFrame:
    return fits.select(*by, "n_obs", "log_lik", "aic", "rank", "converged")


def linear_predictor(spec: ModelSpec, effects: Column) -> Column:
    """Sum of effects as plain column arithmetic; NULL for a level the model has not seen."""

    def pick(names, values_to_index):
        out = None
        for values, j in values_to_index:
            hit = None
            for n, v in zip(names, values):
                one = F.col(n).cast("string") == F.lit(v)
                hit = one if hit is None else hit & one
            e = F.get(effects, F.lit(j))
            out = F.when(hit, e) if out is None else out.when(hit, e)
        return out

    eta, by_names = None, {}
    for j, c in enumerate(spec.coordinates()):
        if c.kind == "intercept":
            eta = F.get(effects, F.lit(j))
        elif c.kind == "numeric":
            eta = eta + F.get(effects, F.lit(j)) * F.col(c.names[0]).cast("double")
        else:
            by_names.setdefault(c.names, []).append((c.levels, j))
    for names, entries in by_names.items():
        eta = eta + pick(names, entries)
    return eta


def score_column(spec: ModelSpec, effects: Column, family: str = "binomial") -> Column:
    eta = linear_predictor(spec, effects)
    return eta if family == "gaussian" else 1 / (1 + F.exp(-eta))


def score(
    df: DataFrame, fits: DataFrame, spec: ModelSpec, on: Sequence[str], out: str = "score",
    family: str = "binomial",
) -> DataFrame:
    """Score each row with the model of its group; no model gives NULL.

    ``fits`` is a staged table of one row per group, broadcast by its size.
    """
    models = fits.select(*on, F.col("effects").alias("_effects"))
    return (
        df.join(models, list(on), "left")
        .withColumn(out, score_column(spec, F.col("_effects"), family))
        .drop("_effects")
    )


def previous_fits(
    fits: DataFrame, periods: DataFrame, entity: str, period: str
) -> DataFrame:
    """Re-key models so that (entity, period) finds the previous period's model."""
    older = fits.withColumnRenamed(period, "previous")
    return (
        periods.filter(F.col("previous").isNotNull())
        .select(entity, period, "previous")
        .join(older, [entity, "previous"])
        .drop("previous")
    )


def unseen_levels(
    rows: DataFrame, training: DataFrame, spec: ModelSpec, on: Sequence[str]
) -> DataFrame:
    """(group, variable, level) found in ``rows`` but not in the group's training rows."""

    def levels(df: DataFrame) -> DataFrame:
        each = F.explode(F.array(*[
            F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level"))
            for v in spec.factors
        ]))
        patterns = df.select(*on, *spec.factors).distinct()
        return patterns.select(*on, each.alias("_l")).select(*on, "_l.*").distinct()

    return levels(rows).join(levels(training), [*on, "variable", "level"], "left_anti")
