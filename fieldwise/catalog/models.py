"""Queries that fit and apply models, rank, select and count savings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import propensity as P
from ..operators import summaries as S
from ..operators import targeting as T
from ..operators.cells import covariate_cells
from ..operators.ordering import positions
from ..operators.progress import previous_available_period
from ..plans.scenarios import SAVED_FLAGS, late_scores
from ..sources.contacts import union_rounds
from ..specs import ModelSpec
from ..stages import stage
from . import sql
from .registry import query, r6, rounded
from .views import BARRIER, DEM, FULL, PRIO, SEED, STUDY, cases, fits, scenarios

EARLY_CELLS = """
ec AS MATERIALIZED (SELECT cntry_round, prio, barrier, seg, site, CAST(count(*) AS DOUBLE) AS n,
  CAST(sum(CAST(interview AS INTEGER)) AS DOUBLE) AS y FROM cases WHERE attempt_first70pct GROUP BY ALL)"""
LATE_CELLS = """
lc AS MATERIALIZED (SELECT cntry_round, prio, barrier, seg, site, attempt, CAST(count(*) AS DOUBLE) AS n,
  CAST(sum(CAST(interview AS INTEGER)) AS DOUBLE) AS y FROM cases WHERE NOT attempt_first70pct GROUP BY ALL)"""
ALL_CELLS = """
ac AS MATERIALIZED (SELECT cntry_round, prio, barrier, seg, site, CAST(count(*) AS DOUBLE) AS n,
  CAST(sum(CAST(interview AS INTEGER)) AS DOUBLE) AS y FROM cases GROUP BY ALL)"""
DEM2, FULL2 = DEM.with_numeric("attempt"), FULL.with_numeric("attempt")
SLOPE = ModelSpec((), numeric=("attempt",))

# --- fits --------------------------------------------------------------------

LOGIT_SQL = f"""WITH {sql.CASES},
xc AS (SELECT cntry_round, attempt, CAST(count(*) AS DOUBLE) AS n,
  CAST(sum(CAST(interview AS INTEGER)) AS DOUBLE) AS y FROM cases GROUP BY ALL),
{sql.newton("m", "xc", "cntry_round", SLOPE)}
SELECT cntry_round, round(b0, 6) AS intercept, round(b1, 6) AS slope,
  round(sqrt(v0_0), 6) AS intercept_se, round(sqrt(v1_1), 6) AS slope_se FROM m"""


def all_cells(spark, d, covariates, response="interview"):
    return covariate_cells(cases(spark, d), ["cntry_round"], covariates, [response])


@query("logit_2param", LOGIT_SQL)
def logit_2param(spark, d):
    fit = P.fit_grouped(all_cells(spark, d, ["attempt"]), SLOPE, ["cntry_round"])
    return fit.select("cntry_round", *[
        F.round(c, 6).alias(name) for c, name in (
            (F.get("effects", F.lit(0)), "intercept"), (F.get("effects", F.lit(1)), "slope"),
            (F.sqrt(F.get("sigma", F.lit(0))), "intercept_se"),
            (F.sqrt(F.get("sigma", F.lit(3))), "slope_se"),
        )
    ])


LINEAR_SQL = f"""WITH {sql.CASES}
SELECT cntry_round, round(regr_intercept(CAST(interview AS INTEGER), attempt), 6) AS intercept,
  round(regr_slope(CAST(interview AS INTEGER), attempt), 6) AS slope,
  round(sqrt((regr_syy(CAST(interview AS INTEGER), attempt)
    - pow(regr_sxy(CAST(interview AS INTEGER), attempt), 2) / regr_sxx(CAST(interview AS INTEGER), attempt))
    / (count(*) - 2) / regr_sxx(CAST(interview AS INTEGER), attempt)), 6) AS slope_se
FROM cases GROUP BY cntry_round"""


@query("linear_fit", LINEAR_SQL)
def linear_fit(spark, d):
    cells = all_cells(spark, d, ["attempt"])
    fit = P.fit_grouped(cells, SLOPE, ["cntry_round"], "gaussian")
    return fit.select(
        "cntry_round", F.round(F.get("effects", F.lit(0)), 6).alias("intercept"),
        F.round(F.get("effects", F.lit(1)), 6).alias("slope"),
        F.round(F.sqrt(F.get("sigma", F.lit(3))), 6).alias("slope_se"),
    )


# The same model by distributed Newton steps: the answer of the cell-wise fit.
@query("logit_iterative", LOGIT_SQL)
def logit_iterative(spark, d):
    cells = all_cells(spark, d, ["attempt"])
    fit = P.fit_grouped(cells, SLOPE, ["cntry_round"], max_cells=0)
    return fit.select("cntry_round", *[
        F.round(c, 6).alias(name) for c, name in (
            (F.get("effects", F.lit(0)), "intercept"), (F.get("effects", F.lit(1)), "slope"),
            (F.sqrt(F.get("sigma", F.lit(0))), "intercept_se"),
            (F.sqrt(F.get("sigma", F.lit(3))), "slope_se"),
        )
    ])


def _loglik(name: str, spec: ModelSpec = FULL, digits: int = 5) -> str:
    p = sql.predicted(name, spec)
    return f"""SELECT cntry_round, CAST(sum(n) AS BIGINT) AS n_obs,
  round(sum(y * ln(p) + (n - y) * ln(1 - p)), {digits}) AS log_lik,
  round({2 * len(sql.columns(spec))} - 2 * sum(y * ln(p) + (n - y) * ln(1 - p)), {digits}) AS aic
FROM (SELECT *, {p} AS p FROM {name}_x JOIN {name} USING (cntry_round)) GROUP BY cntry_round"""


STATS_SQL = f"""WITH {sql.CASES}, {ALL_CELLS}, {sql.newton("m", "ac", "cntry_round", FULL)}
{_loglik("m")}"""


@query("fit_stats", STATS_SQL)
def fit_stats(spark, d):
    fit = P.fit_grouped(all_cells(spark, d, FULL.factors), FULL, ["cntry_round"])
    return P.model_fit_stats(fit, ["cntry_round"]).select(
        "cntry_round", "n_obs", r6("log_lik", 5), r6("aic", 5)
    )


# erfc by a series of positive terms: 1 - exp(-x^2) sum x^(2n+1) / Gamma(n + 3/2);
# beyond z = 9 it is below 1e-18 and the series would need more terms.
_P = (
    "CASE WHEN z > 9 THEN 0.0 ELSE 1 - exp(-pow(z / sqrt(2), 2)) * list_sum(list_transform(range(0, 150), lambda k: "
    "exp((2 * k + 1) * ln(greatest(z / sqrt(2), 1e-300)) - lgamma(k + 1.5)))) END"
)


def _terms(name: str, spec: ModelSpec) -> str:
    return "\nUNION ALL ".join(
        f"SELECT cntry_round, '{term}' AS term, b{i} AS estimate, sqrt(v{i}_{i}) AS std_error, "
        f"abs(b{i}) / sqrt(v{i}_{i}) AS z FROM {name}"
        for i, (term, _) in enumerate(sql.columns(spec))
    )


COEF_SQL = f"""WITH {sql.CASES}, {ALL_CELLS}, {sql.newton("m", "ac", "cntry_round", FULL)},
t AS (SELECT *, {_P} AS p FROM ({_terms("m", FULL)}))
SELECT cntry_round, term, round(estimate, 3) AS estimate, round(std_error, 3) AS std_error,
  round(estimate / std_error, 3) AS statistic, greatest(round(p, 3), 0) AS p_value,
  CASE WHEN round(p, 3) <= 0.001 THEN '***' WHEN round(p, 3) <= 0.01 THEN '**'
    WHEN round(p, 3) <= 0.05 THEN '*' WHEN round(p, 3) <= 0.1 THEN '.' ELSE ' ' END AS signif
FROM t WHERE round(p, 3) < 0.05"""


@query("coef_table", COEF_SQL)
def coef_table(spark, d):
    fit = P.fit_grouped(all_cells(spark, d, FULL.factors), FULL, ["cntry_round"])
    return S.coefficient_report(P.fit_terms(fit, FULL, ["cntry_round"]))


STUDY_MODELS = {
    "Model 1": ("d1", "dem_sim1", DEM), "Model 2": ("f1", "full_sim1", FULL),
    "Model 3": ("d2", "dem_sim2", DEM2), "Model 4": ("f2", "full_sim2", FULL2),
}
STUDY_FITS = f"""WITH {sql.CASES}, {EARLY_CELLS}, {LATE_CELLS},
{sql.newton("d1", "ec", "cntry_round", DEM, 8)},
{sql.newton("f1", "ec", "cntry_round", FULL, 8)},
{sql.newton("d2", "lc", "cntry_round", DEM2, 8)},
{sql.newton("f2", "lc", "cntry_round", FULL2, 8)}"""
SUMMARIES_SQL = STUDY_FITS + "\n" + "\nUNION ALL ".join(
    f"SELECT '{label}' AS model, * FROM ({_loglik(name, spec)})"
    for label, (name, _, spec) in STUDY_MODELS.items()
)


@query("model_summaries", SUMMARIES_SQL)
def model_summaries(spark, d):
    """Size, log likelihood and AIC of the study's four models in every group."""
    parts = [
        P.model_fit_stats(fits(spark, d)[key], ["cntry_round"]).withColumn("model", F.lit(label))
        for label, (_, key, _) in STUDY_MODELS.items()
    ]
    return union_rounds(*parts).select(
        "model", "cntry_round", "n_obs", r6("log_lik", 5), r6("aic", 5)
    )


COEFS_SQL = STUDY_FITS + ",\nt AS (" + "\nUNION ALL ".join(
    f"SELECT '{label}' AS model, * FROM ({_terms(name, spec)})"
    for label, (name, _, spec) in STUDY_MODELS.items()
) + """)
SELECT model, cntry_round, term, round(estimate, 4) AS estimate, round(std_error, 4) AS std_error FROM t"""


@query("model_coefficients", COEFS_SQL)
def model_coefficients(spark, d):
    """Every coefficient of the study's four models, stacked."""
    parts = [
        P.fit_terms(fits(spark, d)[key], spec, ["cntry_round"]).withColumn("model", F.lit(label))
        for label, (_, key, spec) in STUDY_MODELS.items()
    ]
    return union_rounds(*parts).select(
        "model", "cntry_round", "term", r6("estimate", 4), r6("std_error", 4)
    )


# --- scores ------------------------------------------------------------------


def _eta(alias: str, spec: ModelSpec) -> str:
    eta = " + ".join(
        f"{alias}.b{i} * {e}" for i, (_, e) in enumerate(sql.columns(spec))
    )
    return f"1 / (1 + exp(-({eta})))"


OWN_SQL = f"""WITH {sql.CASES}, {ALL_CELLS}, {sql.newton("m", "ac", "cntry_round", DEM)}
SELECT case_id, round({_eta("m", DEM)}, 6) AS score FROM cases JOIN m USING (cntry_round)"""


@query("score_own", OWN_SQL)
def score_own(spark, d):
    fit = P.fit_grouped(all_cells(spark, d, DEM.factors), DEM, ["cntry_round"])
    s = P.score(cases(spark, d), fit, DEM, ["cntry_round"])
    return rounded(s, ["case_id"], ["score"])


PREV_SQL = f"""WITH {sql.CASES}, {sql.PREVIOUS}, {ALL_CELLS}, {sql.newton("m", "ac", "cntry_round", FULL)}
SELECT case_id, round({_eta("m", FULL)}, 6) AS score FROM cases JOIN previous USING (cntry, round)
LEFT JOIN m ON m.cntry_round = cases.cntry || '-' || CAST(previous AS VARCHAR)"""


@query("score_previous", PREV_SQL)
def score_previous(spark, d):
    c = cases(spark, d)
    cells = covariate_cells(c, ["cntry", "round"], FULL.factors, ["interview"])
    fit = P.fit_grouped(cells, FULL, ["cntry", "round"])
    before = previous_available_period(c, "cntry", "round")
    older = stage(P.previous_fits(fit, before, "cntry", "round"), "previous-fits")
    return rounded(P.score(c, older, FULL, ["cntry", "round"]), ["case_id"], ["score"])


UNSEEN_SQL = f"""WITH {sql.CASES},
l AS (SELECT DISTINCT cntry_round, u.variable, u.level FROM cases, LATERAL (VALUES
  ('prio', prio), ('barrier', barrier)) u(variable, level) WHERE NOT attempt_first70pct),
e AS (SELECT DISTINCT cntry_round, u.variable, u.level FROM cases, LATERAL (VALUES
  ('prio', prio), ('barrier', barrier)) u(variable, level) WHERE attempt < 2 AND price > 300000)
SELECT * FROM l EXCEPT SELECT * FROM e"""


@query("unseen_levels", UNSEEN_SQL)
def unseen(spark, d):
    c = cases(spark, d).select(
        "cntry_round", "prio", "barrier", "attempt", "price", "attempt_first70pct"
    )
    return P.unseen_levels(
        c.filter("NOT attempt_first70pct"), c.filter("attempt < 2 AND price > 300000"),
        ModelSpec((PRIO, BARRIER)), ["cntry_round"],
    )


# --- selections --------------------------------------------------------------

RANK_SQL = f"""WITH {sql.CASES},
r AS (SELECT cntry_round, case_id, row_number() OVER (PARTITION BY cntry_round ORDER BY attempt, {sql.tie("rank")}, case_id) AS rank,
  count(*) OVER (PARTITION BY cntry_round) AS ranked FROM cases WHERE NOT attempt_first70pct)
SELECT *, rank > (ranked + 1) / 2.0 AS top, rank <= (ranked + 1) / 2.0 AS bottom FROM r"""


@query("rank_split", RANK_SQL)
def rank_split(spark, d):
    _, late = T.split_early_late(cases(spark, d), "attempt_first70pct")
    late = late.select("cntry_round", "case_id", "attempt")
    return T.split_at_median(late, ["cntry_round"], "case_id", F.col("attempt"), "rank")


RANDOM_SQL = f"""WITH {sql.CASES}
SELECT case_id, 2 * row_number() OVER (PARTITION BY cntry_round ORDER BY {sql.tie("one")}, case_id)
  <= count(*) OVER (PARTITION BY cntry_round) + 1 AS first_draw,
  2 * row_number() OVER (PARTITION BY cntry_round ORDER BY {sql.tie("two")}, case_id)
  <= count(*) OVER (PARTITION BY cntry_round) + 1 AS second_draw
FROM cases WHERE NOT attempt_first70pct"""


@query("random_half", RANDOM_SQL)
def random_half(spark, d):
    late = cases(spark, d).filter("NOT attempt_first70pct").select("cntry_round", "case_id")
    r = T.rank_random_ties(
        late, ["cntry_round"], "case_id", {"one": (None, "one"), "two": (None, "two")}
    )
    return r.select(
        "case_id",
        T.bottom_half(F.col("rank_one"), F.col("ranked_one")).alias("first_draw"),
        T.bottom_half(F.col("rank_two"), F.col("ranked_two")).alias("second_draw"),
    )


def _draft(name: str, ranks: str) -> str:
    """Recursive draft over ``ranks`` (cntry_round, case_id, a, b); leaves <name>(cntry_round, picked)."""
    return f"""
{name}_n AS (SELECT cntry_round, greatest(1, count(*) // 2) AS want FROM {ranks} GROUP BY cntry_round),
{name}_d AS (
  SELECT r.cntry_round, max(want) AS want, 1 AS t, [arg_min(case_id, a)] AS picked
  FROM {ranks} r JOIN {name}_n n ON r.cntry_round = n.cntry_round GROUP BY r.cntry_round
  UNION ALL
  SELECT d.cntry_round, max(d.want), max(d.t) + 1,
    list_append(first(d.picked), arg_min(r.case_id, CASE WHEN (d.t + 1) % 2 = 0 THEN r.a ELSE r.b END))
  FROM {name}_d d JOIN {ranks} r ON r.cntry_round = d.cntry_round AND NOT list_contains(d.picked, r.case_id)
  WHERE d.t < d.want GROUP BY d.cntry_round
),
{name} AS MATERIALIZED (SELECT cntry_round, unnest(picked) AS case_id FROM {name}_d WHERE t = want)"""


DRAFT_SQL = f"""WITH RECURSIVE {sql.CASES},
ab AS MATERIALIZED (SELECT cntry_round, case_id, row_number() OVER (PARTITION BY cntry_round ORDER BY attempt DESC, case_id) AS a,
  row_number() OVER (PARTITION BY cntry_round ORDER BY price, case_id) AS b FROM cases WHERE NOT attempt_first70pct),
{_draft("dr", "ab")}
SELECT ab.cntry_round, ab.case_id, dr.case_id IS NOT NULL AS picked
FROM ab LEFT JOIN dr ON ab.cntry_round = dr.cntry_round AND ab.case_id = dr.case_id"""


@query("alternating_pick", DRAFT_SQL)
def alternating_pick(spark, d):
    late = stage(
        cases(spark, d).filter("NOT attempt_first70pct")
        .select("cntry_round", "case_id", "attempt", "price"), "late",
    )
    late = positions(late, ["cntry_round"], [F.desc("attempt"), "case_id"], "a")
    late = positions(stage(late), ["cntry_round"], ["price", "case_id"], "b")
    picked = T.alternating_picks(late, ["cntry_round"], "a", "b")
    return picked.select("cntry_round", "case_id", "picked")


RESPONSE_SQL = f"""WITH {sql.CASES}
SELECT case_id, interview AND coalesce(CASE WHEN NOT attempt_first70pct THEN prio = 'High' END, TRUE) AS response,
  coalesce(NOT attempt_first70pct AND prio = 'High', FALSE) AS selected FROM cases"""


@query("counterfactual_response", RESPONSE_SQL)
def counterfactual(spark, d):
    c = cases(spark, d)
    early = F.col("attempt_first70pct")
    flag = F.when(~early, F.col("prio") == "High")
    return c.select(
        "case_id", T.counterfactual_response(F.col("interview"), flag).alias("response"),
        F.coalesce(T.selected_flag(early, flag), F.lit(False)).alias("selected"),
    )


POSS_SQL = f"""WITH {sql.CASES}
SELECT cntry_round, case_id, attempt - attempt_number_70pct AS poss FROM cases"""


@query("possible_savings", POSS_SQL)
def possible(spark, d):
    return T.possible_savings(cases(spark, d)).select("cntry_round", "case_id", "poss")


BINS_SQL = f"""WITH {sql.CASES},
{sql.breaks("cases", "cntry", "price")}
SELECT cntry, bin, count(*) AS n, round(avg(CAST(interview AS INTEGER)), 6) AS rr, min(price) AS score_min, max(price) AS score_max
FROM (SELECT cases.*, CAST(least(len(list_filter(breaks, lambda b: b <= price)), len(breaks) - 1) AS INTEGER) AS bin
  FROM cases JOIN br USING (cntry)) GROUP BY cntry, bin"""


@query("equal_count_bins", BINS_SQL)
def bins(spark, d):
    c = cases(spark, d).select("cntry", "price", "interview")
    t = S.calibration_table(c, ["cntry"], "price", "interview")
    return t.withColumn("rr", F.round("rr", 6))


# --- the full targeting study -------------------------------------------------

RANKED = f"""WITH RECURSIVE {sql.CASES}, {sql.PREVIOUS}, {EARLY_CELLS}, {LATE_CELLS},
{sql.newton("d1", "ec", "cntry_round", DEM, 8)},
{sql.newton("f1", "ec", "cntry_round", FULL, 8)},
{sql.newton("d2", "lc", "cntry_round", DEM2, 8)},
{sql.newton("f2", "lc", "cntry_round", FULL2, 8)},
scored AS MATERIALIZED (
  SELECT cases.*, {_eta("d1", DEM)} AS s_d1, {_eta("f1", FULL)} AS s_f1,
    {_eta("d2", DEM2)} AS s_d2, {_eta("f2", FULL2)} AS s_f2
  FROM cases JOIN previous USING (cntry, round)
    JOIN d1 USING (cntry_round) JOIN f1 USING (cntry_round)
    JOIN d2 ON d2.cntry_round = cases.cntry || '-' || CAST(previous AS VARCHAR)
    JOIN f2 ON f2.cntry_round = cases.cntry || '-' || CAST(previous AS VARCHAR)
  WHERE NOT attempt_first70pct),
ranked AS MATERIALIZED (
  SELECT cntry_round, case_id, s_d1, s_f1, s_d2, s_f2, count(*) OVER (PARTITION BY cntry_round) AS m,
    row_number() OVER (PARTITION BY cntry_round ORDER BY s_d1, {sql.tie(f"{SEED}-dem_sim1")}, case_id) AS r_d1,
    row_number() OVER (PARTITION BY cntry_round ORDER BY s_f1, {sql.tie(f"{SEED}-full_sim1")}, case_id) AS r_f1,
    row_number() OVER (PARTITION BY cntry_round ORDER BY s_d2, {sql.tie(f"{SEED}-dem_sim2")}, case_id) AS r_d2,
    row_number() OVER (PARTITION BY cntry_round ORDER BY s_f2, {sql.tie(f"{SEED}-full_sim2")}, case_id) AS r_f2,
    row_number() OVER (PARTITION BY cntry_round ORDER BY {sql.tie(f"{SEED}-rand")}, case_id) AS r_r1,
    row_number() OVER (PARTITION BY cntry_round ORDER BY {sql.tie(f"{SEED}-rand2")}, case_id) AS r_r2
  FROM scored),
ab_dem AS MATERIALIZED (SELECT cntry_round, case_id, m + 1 - r_d2 AS a, r_d1 AS b FROM ranked),
ab_full AS MATERIALIZED (SELECT cntry_round, case_id, m + 1 - r_f2 AS a, r_f1 AS b FROM ranked),
{_draft("pd", "ab_dem")},
{_draft("pf", "ab_full")},
study AS MATERIALIZED (
  SELECT c.*, s_d1, s_f1, s_d2, s_f2,
    2 * r_d1 <= m + 1 AS d1_bottom, 2 * r_f1 <= m + 1 AS f1_bottom,
    2 * r_d2 > m + 1 AS d2_top, 2 * r_f2 > m + 1 AS f2_top,
    2 * r_r1 <= m + 1 AS r1, 2 * r_r2 <= m + 1 AS r2,
    CASE WHEN m IS NOT NULL THEN pd.case_id IS NOT NULL END AS k_dem,
    CASE WHEN m IS NOT NULL THEN pf.case_id IS NOT NULL END AS k_full
  FROM cases c LEFT JOIN ranked r ON c.cntry_round = r.cntry_round AND c.case_id = r.case_id
    LEFT JOIN pd ON c.cntry_round = pd.cntry_round AND c.case_id = pd.case_id
    LEFT JOIN pf ON c.cntry_round = pf.cntry_round AND c.case_id = pf.case_id
  WHERE c.cntry_round IN (SELECT cntry_round FROM ranked))"""

SCENARIO_SQL = f"""{RANKED}
SELECT cntry_round, case_id, coalesce(NOT attempt_first70pct AND d1_bottom, FALSE) AS dem_sim1_bottom50selected,
  coalesce(NOT attempt_first70pct AND d2_top, FALSE) AS dem_sim2_top50selected,
  coalesce(NOT attempt_first70pct AND f1_bottom, FALSE) AS full_sim1_bottom50selected,
  coalesce(NOT attempt_first70pct AND f2_top, FALSE) AS full_sim2_top50selected,
  coalesce(r1, FALSE) AS rand_selected, coalesce(r2, FALSE) AS rand2_selected,
  coalesce(k_dem, FALSE) AS rank_selected_dem, coalesce(k_full, FALSE) AS rank_selected_full,
  interview AND coalesce(d1_bottom, TRUE) AS dem_sim1_resp_bottom50,
  interview AND coalesce(d2_top, TRUE) AS dem_sim2_resp_top50,
  interview AND coalesce(f1_bottom, TRUE) AS full_sim1_resp_bottom50,
  interview AND coalesce(f2_top, TRUE) AS full_sim2_resp_top50,
  interview AND coalesce(r1, TRUE) AS rand_resp, interview AND coalesce(r2, TRUE) AS rand2_resp,
  interview AND coalesce(k_dem, TRUE) AS rank_resp_dem, interview AND coalesce(k_full, TRUE) AS rank_resp_full
FROM study"""
STUDY_COLS = [
    "dem_sim1_bottom50selected", "dem_sim2_top50selected", "full_sim1_bottom50selected",
    "full_sim2_top50selected", "rand_selected", "rand2_selected", "rank_selected_dem",
    "rank_selected_full", "dem_sim1_resp_bottom50", "dem_sim2_resp_top50",
    "full_sim1_resp_bottom50", "full_sim2_resp_top50", "rand_resp", "rand2_resp",
    "rank_resp_dem", "rank_resp_full",
]


@query("scenario_table", SCENARIO_SQL)
def scenario_table(spark, d):
    return scenarios(spark, d).select("cntry_round", "case_id", *STUDY_COLS)


SCORES_SQL = f"""{RANKED}
SELECT cntry_round, case_id, round(s_d1, 6) AS score_dem_sim1, round(s_f1, 6) AS score_full_sim1,
  round(s_d2, 6) AS score_dem_sim2, round(s_f2, 6) AS score_full_sim2 FROM scored"""


@query("late_scores", SCORES_SQL)
def scores(spark, d):
    s = late_scores(cases(spark, d), fits(spark, d), STUDY)
    names = ["score_dem_sim1", "score_full_sim1", "score_dem_sim2", "score_full_sim2"]
    return rounded(s, ["cntry_round", "case_id"], names)


_FLAG_SQL = {
    "dem_bottom": "d1_bottom", "dem_top": "d2_top", "full_bottom": "f1_bottom",
    "full_top": "f2_top", "rank_dem": "k_dem", "rank_full": "k_full", "rand": "r1", "rand2": "r2",
}


def _saved(name: str) -> str:
    return (
        f"CAST(sum(CASE WHEN coalesce({_FLAG_SQL[name]}, FALSE) THEN 0 ELSE attempt - attempt_number_70pct END) AS BIGINT)"
    )


SAVED_SQL = f"""{RANKED}
SELECT cntry_round, CAST(sum(attempt) AS BIGINT) AS attempts, CAST(sum(attempt - attempt_number_70pct) AS BIGINT) AS poss,
  round(sum(attempt - attempt_number_70pct) / sum(attempt), 6) AS prop_poss,
  {", ".join(f"{_saved(n)} AS saved_{n}, round({_saved(n)} / sum(attempt), 6) AS prop_{n}" for n in SAVED_FLAGS)}
FROM study GROUP BY cntry_round"""


def saved_table(spark, d):
    return T.attempts_saved(scenarios(spark, d), ["cntry_round"], SAVED_FLAGS)


@query("attempts_saved", SAVED_SQL)
def attempts_saved(spark, d):
    s = saved_table(spark, d)
    return s.withColumns({c: F.round(c, 6) for c in s.columns if c.startswith("prop_")})


LIMITS_SQL = f"""{RANKED}
SELECT cntry_round, round(min(CASE WHEN f2_top THEN s_f2 END), 6) AS min_top,
  round(max(CASE WHEN f1_bottom THEN s_f1 END), 6) AS max_bottom
FROM study WHERE NOT attempt_first70pct GROUP BY cntry_round"""


def thresholds_table(spark, d, m="full"):
    late = scenarios(spark, d).filter("NOT attempt_first70pct")
    return T.selection_thresholds(
        late, ["cntry_round"], f"score_{m}_sim2", f"{m}_sim2_top50selected",
        f"score_{m}_sim1", f"{m}_sim1_bottom50selected",
    )


@query("thresholds", LIMITS_SQL)
def thresholds(spark, d):
    return rounded(thresholds_table(spark, d), ["cntry_round"], ["min_top", "max_bottom"])


def _scatter_sql(m: str, k: str) -> str:
    return f"""{RANKED},
lim AS (SELECT cntry_round, min(CASE WHEN {m}2_top THEN s_{m}2 END) AS min_top,
  max(CASE WHEN {m}1_bottom THEN s_{m}1 END) AS max_bottom FROM study WHERE NOT attempt_first70pct GROUP BY cntry_round)
SELECT cntry_round, case_id, round(s_{m}1, 6) AS early_score, round(s_{m}2, 6) AS late_score,
  CASE WHEN {k} THEN 'Selected' ELSE 'Not selected' END AS sim3,
  CASE WHEN r1 THEN 'Selected' ELSE 'Not selected' END AS sim4,
  round(min_top, 6) AS min_top, round(max_bottom, 6) AS max_bottom
FROM study JOIN lim USING (cntry_round) WHERE NOT attempt_first70pct"""


def _scatter(spark, d, m):
    late = scenarios(spark, d).filter("NOT attempt_first70pct")
    t = T.selection_scatter(
        late, ["cntry_round"], ["case_id"], f"score_{m}_sim1", f"score_{m}_sim2",
        {"sim3": f"rank_selected_{m}", "sim4": "rand_selected"},
        f"{m}_sim2_top50selected", f"{m}_sim1_bottom50selected",
    )
    scores = ["early_score", "late_score", "min_top", "max_bottom"]
    return rounded(t, [c for c in t.columns if c not in scores], scores)


@query("selection_scatter", _scatter_sql("f", "k_full"))
def selection_scatter(spark, d):
    return _scatter(spark, d, "full")


@query("selection_scatter_dem", _scatter_sql("d", "k_dem"))
def selection_scatter_dem(spark, d):
    return _scatter(spark, d, "dem")


_LABELS = [
    ("dem_bottom", "Demographics only", "Sim1 Bottom"), ("dem_top", "Demographics only", "Sim2 Top"),
    ("full_bottom", "Demographics + Interviewer obs.", "Sim1 Bottom"),
    ("full_top", "Demographics + Interviewer obs.", "Sim2 Top"),
    ("rank_dem", "Demographics only", "Sim3 Rank"),
    ("rank_full", "Demographics + Interviewer obs.", "Sim3 Rank"),
    ("rand", "Demographics only", "Sim4 Rand"), ("rand2", "Demographics + Interviewer obs.", "Sim4 Rand"),
]
SAVED_LONG_SQL = RANKED + "\n" + "\nUNION ALL ".join(
    f"SELECT cntry_round, '{m}' AS model, '{s}' AS simulation, round({_saved(n)} / sum(attempt), 6) AS prop "
    f"FROM study GROUP BY cntry_round"
    for n, m, s in _LABELS
)


@query("saved_long", SAVED_LONG_SQL)
def saved_long(spark, d):
    long = S.saved_long(saved_table(spark, d), ["cntry_round"])
    return long.select("cntry_round", "model", "simulation", r6("prop"))
