"""Queries on representativeness: R-indicators, CVs, partial indicators, the grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summaries as S
from ..operators.indicators import indicator_by_group
from ..plans.scenarios import GRID_RESPONSES, indicator_grid
from ..specs import Levels, ModelSpec
from ..stages import stage
from . import sql
from .groups import WEIGHTED, weighted_cases
from .models import ALL_CELLS, RANKED
from .registry import query, r6, rounded
from .views import DEM, FULL, PRIO, SEG, SITE, STUDY, cases, once, scenarios, table

IND = ["prop_mean", "r", "r_unadj", "r_se", "bias_factor", "cv", "cv_unadj", "cv_se"]

ONE_SQL = f"""WITH {sql.CASES},
oc AS (SELECT cntry_round, prio AS category, CAST(count(*) AS DOUBLE) AS n,
  CAST(sum(CAST(interview AS INTEGER)) AS DOUBLE) AS y FROM cases GROUP BY ALL),
{sql.one_factor("o", "oc", "cntry_round")}
SELECT cntry_round, {sql.indicator_columns()} FROM o_ind"""


def overall(spark, d, spec, **options):
    i = indicator_by_group(cases(spark, d), spec, ["interview"], ["cntry_round"], **options)
    return i.overall


@query("r_indicator_one_factor", ONE_SQL)
def one_factor(spark, d):
    return rounded(overall(spark, d, ModelSpec((PRIO,))), ["cntry_round", "n_obs"], IND)


ALIASED_SQL = ONE_SQL.replace(
    f"SELECT cntry_round, {sql.indicator_columns()} FROM o_ind",
    "SELECT cntry_round, CAST(rows AS BIGINT) AS n_obs, round(prop_mean, 6) AS prop_mean, "
    "round(1 - 2 * sqrt(s2), 6) AS r_unadj, round(sqrt(s2) / prop_mean, 6) AS cv_unadj, "
    + ", ".join(f"CAST(NULL AS DOUBLE) AS {x}" for x in ("r", "r_se", "bias_factor", "cv", "cv_se"))
    + " FROM o_ind",
)


@query("aliased_indicator", ALIASED_SQL)
def aliased(spark, d):
    """A design with a variable twice: fitted as with one of them, nothing adjusted."""
    twin = Levels("twin", tuple(f"as {v}" for v in PRIO.values))
    c = cases(spark, d).withColumn("twin", F.concat(F.lit("as "), "prio"))
    i = indicator_by_group(c, ModelSpec((PRIO, twin)), ["interview"], ["cntry_round"])
    return rounded(i.overall, ["cntry_round", "n_obs"], IND)


INTER_SQL = f"""WITH {sql.CASES},
oc AS (SELECT cntry_round, seg || site AS category, CAST(count(*) AS DOUBLE) AS n,
  CAST(sum(CAST(interview AS INTEGER)) AS DOUBLE) AS y FROM cases GROUP BY ALL),
{sql.one_factor("o", "oc", "cntry_round")}
SELECT cntry_round, {sql.indicator_columns()} FROM o_ind"""


@query("r_indicator_interaction", INTER_SQL)
def interaction(spark, d):
    spec = ModelSpec((SEG, SITE), (("seg", "site"),))
    return rounded(overall(spark, d, spec), ["cntry_round", "n_obs"], IND)


FULL_SQL = f"""WITH {sql.CASES}, {ALL_CELLS}, {sql.indicator("m", "ac", "cntry_round", FULL)}
SELECT cntry_round, {sql.indicator_columns()} FROM m_ind"""


@query("r_indicator_full", FULL_SQL)
def full_model(spark, d):
    return rounded(overall(spark, d, FULL), ["cntry_round", "n_obs"], IND)


LABEL_SQL = f"""WITH oc AS (SELECT 'all' AS g, lang AS category, CAST(count(*) AS DOUBLE) AS n,
  CAST(sum(quality) AS DOUBLE) AS y FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
{sql.one_factor("o", "oc", "g")}
SELECT {sql.indicator_columns()} FROM o_ind"""


@query("label_indicator", LABEL_SQL)
def label_indicator(spark, d):
    """How evenly a binary label falls over the languages of a document collection."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    df = docs.join(table(spark, d, "labels"), "doc_id").withColumn("g", F.lit("all"))
    spec = ModelSpec((Levels("lang", ("de", "en", "es", "fr")),))
    i = indicator_by_group(df, spec, ["quality"], ["g"])
    return rounded(i.overall, ["n_obs"], IND)


def _weighted_sql(weight: str, variance: str) -> str:
    """Weighted indicator; ``variance`` fills <table>(cntry_round, vp, vq, rows) from pcase."""
    text = f"""{WEIGHTED},
sw AS (SELECT cntry_round, count(*) / sum({weight}) AS scale FROM wc GROUP BY cntry_round),
wcell AS MATERIALIZED (SELECT cntry_round, prio, barrier, sum({weight}) AS w, sum({weight}) * max(scale) AS n,
  sum({weight} * y) * max(scale) AS y FROM wc JOIN sw USING (cntry_round) GROUP BY cntry_round, prio, barrier),
{sql.indicator("m", "wcell", "cntry_round", DEM, total="tot")}
SELECT cntry_round, round(pop, 6) AS population, {sql.indicator_columns()} FROM m_ind"""
    totals = f"""pcase AS MATERIALIZED (SELECT wc.cntry_round, wc.status, wc.{weight} AS wt, p, (p - pm) * (p - pm) AS q
  FROM wc JOIN m_q ON wc.cntry_round = m_q.cntry_round AND wc.prio = m_q.prio AND wc.barrier = m_q.barrier),
tot AS MATERIALIZED ({variance}),
"""
    return text.replace("{TOTALS}", totals)


STSI_SQL = _weighted_sql("w", """
SELECT cntry_round, sum(nn * nn * (1 - n / nn) * v1 / n) AS vp, sum(nn * nn * (1 - n / nn) * v2 / n) AS vq, sum(n) AS rows
FROM (SELECT cntry_round, status, sum(wt) AS nn, count(*) AS n, var_samp(p) AS v1, var_samp(q) AS v2
  FROM pcase GROUP BY ALL) GROUP BY cntry_round""")

PPSI_SQL = _weighted_sql("v", """
SELECT cntry_round, (count(*) * sum(pow(p * wt, 2)) - pow(sum(p * wt), 2)) / (count(*) - 1) AS vp,
  (count(*) * sum(pow(q * wt, 2)) - pow(sum(q * wt), 2)) / (count(*) - 1) AS vq, count(*) AS rows
FROM pcase GROUP BY cntry_round""")


@query("r_indicator_stsi", STSI_SQL)
def stsi(spark, d):
    """Weights constant per stratum; the strata are read off the weights."""
    i = indicator_by_group(weighted_cases(spark, d), DEM, ["y"], ["cntry_round"], weight="w")
    return rounded(i.overall, ["cntry_round", "n_obs"], ["population", *IND])


@query("r_indicator_pps", PPSI_SQL)
def pps(spark, d):
    """Weights that differ case by case."""
    i = indicator_by_group(
        weighted_cases(spark, d), DEM, ["y"], ["cntry_round"], weight="v", stratum="status"
    )
    return rounded(i.overall, ["cntry_round", "n_obs"], ["population", *IND])


LINEAR_IND = f"""WITH {sql.CASES},
oc AS (SELECT cntry_round, prio, count(*) AS n, sum(CAST(interview AS INTEGER)) AS y FROM cases GROUP BY ALL),
c AS (SELECT *, y / n AS p, sum(n) OVER g AS pop, sum(y) OVER g / sum(n) OVER g AS pm,
  (sum(y - y * y / n) OVER g) / (sum(n) OVER g - count(*) OVER g) AS v FROM oc WINDOW g AS (PARTITION BY cntry_round)),
s AS (SELECT cntry_round, max(pop) AS pop, max(pm) AS pm, sum(n * (p - pm) * (p - pm)) AS ss, sum(v) / max(pop) AS bias,
  4 * sum(n * v * (p - pm) * (p - pm)) / pow(max(pop), 2) + 2 * (sum(pow(v / pop, 2) * pow(1 - n / pop, 2))
  + (pow(sum(n * v), 2) - sum(pow(n * v, 2))) / pow(max(pop), 4)) AS top FROM c GROUP BY cntry_round),
o_ind AS (SELECT cntry_round, pop, pop AS rows, pm AS prop_mean, ss / (pop - 1) AS s2, top / (ss / pop) AS r_var,
  CASE WHEN bias > ss / (pop - 1) THEN 0.0 ELSE 1 - bias / (ss / (pop - 1)) END AS bias_factor FROM s)
SELECT cntry_round, {sql.indicator_columns()} FROM o_ind"""


@query("r_indicator_linear", LINEAR_IND)
def linear_indicator(spark, d):
    i = overall(spark, d, ModelSpec((PRIO,)), family="gaussian")
    return rounded(i, ["cntry_round", "n_obs"], IND)


# --- partial indicators --------------------------------------------------------

FITTED = f"""WITH {sql.CASES}, {ALL_CELLS}, {sql.indicator("m", "ac", "cntry_round", FULL)}"""
VARIABLES = FULL.factors

PU_SQL = f"""{FITTED}, {sql.unconditional("m", "cntry_round", VARIABLES)}
SELECT cntry_round, variable, round(pu, 6) AS pu, round(pu_unadj, 6) AS pu_unadj, round(pu_se, 6) AS pu_se FROM m_puv"""


@once("partials")
def partials(spark, d):
    """Indicators of the full model with all partials (built once, read by several queries)."""
    i = indicator_by_group(
        cases(spark, d), FULL, ["interview"], ["cntry_round"], partials=True
    )
    i.by_variable = stage(i.by_variable, "by-variable")
    i.by_category = stage(i.by_category, "by-category")
    return i


@query("partial_unconditional", PU_SQL)
def partial_unconditional(spark, d):
    v = partials(spark, d).by_variable
    return rounded(v, ["cntry_round", "variable"], ["pu", "pu_unadj", "pu_se"])


PC_SQL = f"""{FITTED}, {sql.conditional("m", "cntry_round", FULL, VARIABLES)}
SELECT cntry_round, variable, round(sqrt(sum(ss) / max(pop) * max(bias_factor)), 6) AS pc,
  round(sqrt(sum(ss) / max(pop)), 6) AS pc_unadj FROM m_pc GROUP BY cntry_round, variable"""


@query("partial_conditional", PC_SQL)
def partial_conditional(spark, d):
    v = partials(spark, d).by_variable
    return rounded(v, ["cntry_round", "variable"], ["pc", "pc_unadj"])


PCAT_SQL = f"""{FITTED}, {sql.unconditional("m", "cntry_round", VARIABLES)},
{sql.conditional("m", "cntry_round", FULL, VARIABLES)}
SELECT cntry_round, variable, category, round(sign(pk - pm) * sqrt(part), 6) AS pu_unadj, 0.0::DOUBLE AS pu_unadj_se,
  round(sqrt(ss / m_pc.pop), 6) AS pc_unadj, round(se, 6) AS pc_unadj_se
FROM m_pu JOIN m_pc USING (cntry_round, variable, category)"""
CAT = ["pu_unadj", "pu_unadj_se", "pc_unadj", "pc_unadj_se"]


@query("partial_by_category", PCAT_SQL)
def partial_by_category(spark, d):
    c = partials(spark, d).by_category
    return rounded(c, ["cntry_round", "variable", "category"], CAT)


PCV_SQL = f"""{FITTED}, {sql.unconditional("m", "cntry_round", VARIABLES)},
{sql.conditional("m", "cntry_round", FULL, VARIABLES)},
c AS (SELECT cntry_round, variable, sqrt(sum(ss) / max(pop)) AS pc_unadj,
  sqrt(sum(ss) / max(pop) * max(bias_factor)) AS pc FROM m_pc GROUP BY cntry_round, variable)
SELECT cntry_round, variable, round(pu / prop_mean, 6) AS cvu, round(pu_unadj / prop_mean, 6) AS cvu_unadj,
  round(pu_se / prop_mean, 6) AS cvu_se, round(pc / prop_mean, 6) AS cvc, round(pc_unadj / prop_mean, 6) AS cvc_unadj,
  round(pu_se / prop_mean, 6) AS cvc_se_approx FROM m_puv JOIN c USING (cntry_round, variable)"""


@query("partial_cv", PCV_SQL)
def partial_cv(spark, d):
    v = partials(spark, d).by_variable
    names = ["cvu", "cvu_unadj", "cvu_se", "cvc", "cvc_unadj", "cvc_se_approx"]
    return rounded(v, ["cntry_round", "variable"], names)


_Z = ", ".join(f"z{i}" for i in range(len(sql.columns(DEM))))
WPART_SQL = STSI_SQL[: STSI_SQL.rindex("\nSELECT")] + f""",
wcase AS MATERIALIZED (SELECT wc.cntry_round, wc.status, wc.w AS wt, wc.prio, wc.barrier, wc.seg, p, pm, {_Z}
  FROM wc JOIN m_q ON wc.cntry_round = m_q.cntry_round AND wc.prio = m_q.prio AND wc.barrier = m_q.barrier),
{sql.weighted_partials("m", "cntry_round", DEM, ["prio", "barrier", "seg"], "wcase")}
SELECT cntry_round, variable, category, round(pu, 6) AS pu_unadj, round(pu_se, 6) AS pu_unadj_se,
  round(pc, 6) AS pc_unadj, round(pc_se, 6) AS pc_unadj_se FROM m_wp"""


@query("partial_weighted", WPART_SQL)
def partial_weighted(spark, d):
    """Partials by category under stratified sampling, one variable outside the model."""
    i = indicator_by_group(
        weighted_cases(spark, d), DEM, ["y"], ["cntry_round"], weight="w", stratum="status",
        partials=True, other_variables=["seg"],
    )
    return rounded(i.by_category, ["cntry_round", "variable", "category"], CAT)


# --- the grid and its tables ----------------------------------------------------

_RESP_SQL = {
    "dem_sim1_resp_bottom50": "interview AND coalesce(d1_bottom, TRUE)",
    "dem_sim2_resp_top50": "interview AND coalesce(d2_top, TRUE)",
    "full_sim1_resp_bottom50": "interview AND coalesce(f1_bottom, TRUE)",
    "full_sim2_resp_top50": "interview AND coalesce(f2_top, TRUE)",
    "rank_resp_dem": "interview AND coalesce(k_dem, TRUE)",
    "rank_resp_full": "interview AND coalesce(k_full, TRUE)",
    "rand_resp": "interview AND coalesce(r1, TRUE)",
    "rand2_resp": "interview AND coalesce(r2, TRUE)",
    "status_70pct": "status_70pct",
    "interview": "interview",
}
_UNION = " UNION ALL ".join(
    f"SELECT cntry_round, prio, barrier, seg, site, '{m}' AS response_model, '{s}' AS selected, "
    f"CAST({_RESP_SQL[r]} AS INTEGER) AS val FROM study"
    for r, (m, s) in GRID_RESPONSES.items()
)
_CV = "sqrt(s2 * bias_factor) / prop_mean"
_CVSE = f"sqrt(0.25 * r_var / pow(prop_mean, 2) + pow({_CV}, 4) / rows)"


def _grid_part(name: str, label: str) -> str:
    return (
        f"SELECT split_part(gk, '~', 1) AS cntry_round, split_part(gk, '~', 2) AS response_model, "
        f"split_part(gk, '~', 3) AS selected, '{label}' AS r_indicator, {_CV} AS cv, {_CVSE} AS cv_se, "
        f"prop_mean AS response_rate FROM {name}_ind"
    )


GRID = f"""{RANKED},
gr AS MATERIALIZED (SELECT cntry_round || '~' || response_model || '~' || selected AS gk, * FROM ({_UNION})),
gcf AS MATERIALIZED (SELECT gk, prio, barrier, seg, site, CAST(count(*) AS DOUBLE) AS n, CAST(sum(val) AS DOUBLE) AS y FROM gr GROUP BY ALL),
gcd AS MATERIALIZED (SELECT gk, prio, barrier, sum(n) AS n, sum(y) AS y FROM gcf GROUP BY ALL),
{sql.indicator("gd", "gcd", "gk", DEM, 8)},
{sql.indicator("gf", "gcf", "gk", FULL, 8)},
grid AS MATERIALIZED ({_grid_part("gd", "Dem")} UNION ALL {_grid_part("gf", "Full")})"""

GRID_SQL = f"""{GRID}
SELECT cntry_round, response_model, selected, r_indicator, round(cv, 6) AS cv, round(cv_se, 6) AS cv_se,
  round(response_rate, 6) AS response_rate, round(cv - 1.96 * cv_se, 6) AS cv_ci95_lower,
  round(cv + 1.96 * cv_se, 6) AS cv_ci95_upper FROM grid"""


@once("grid")
def grid(spark, d):
    return stage(indicator_grid(scenarios(spark, d), STUDY), "grid")


GRID_KEYS = ["cntry_round", "response_model", "selected", "r_indicator"]


@query("indicator_grid", GRID_SQL)
def indicator_grid_query(spark, d):
    return rounded(
        indicator_grid(scenarios(spark, d), STUDY), GRID_KEYS,
        ["cv", "cv_se", "response_rate", "cv_ci95_lower", "cv_ci95_upper"],
    )


def _means_sql(label: str) -> str:
    return f"""{GRID}
SELECT response_model, selected, round(avg(cv), 3) AS mean_cv, round(stddev_samp(cv), 3) AS sd_cv,
  round(avg(response_rate), 3) AS mean_rr, round(stddev_samp(response_rate), 3) AS sd_rr
FROM grid WHERE r_indicator = '{label}' GROUP BY ALL"""


@query("scenario_means", _means_sql("Full"))
def scenario_means(spark, d):
    return S.scenario_means(grid(spark, d), "Full")


@query("scenario_means_dem", _means_sql("Dem"))
def scenario_means_dem(spark, d):
    return S.scenario_means(grid(spark, d), "Dem")


BY_GROUP_SQL = f"""{GRID}
SELECT cntry_round, selected, response_model, round(cv, 3) AS cv, round(cv_se, 3) AS cv_se,
  round(response_rate, 3) AS response_rate FROM grid WHERE r_indicator = 'Full'"""


@query("scenario_by_group", BY_GROUP_SQL)
def scenario_by_group(spark, d):
    return S.scenario_by_group(grid(spark, d), "cntry_round", "Full")


DIFF_SQL = f"""{GRID}
SELECT cntry_round, response_model, round(first, 6) AS first, round(second, 6) AS second, round(second - first, 6) AS diff
FROM (SELECT cntry_round, response_model, avg(CASE WHEN selected = 'Sim1 Bottom' THEN cv END) AS first,
  avg(CASE WHEN selected = 'Sim4 Random' THEN cv END) AS second FROM grid WHERE r_indicator = 'Full' GROUP BY ALL)
WHERE first IS NOT NULL AND second IS NOT NULL"""


@query("scenario_diff", DIFF_SQL)
def scenario_diff(spark, d):
    g = grid(spark, d).filter("r_indicator = 'Full'")
    t = S.scenario_diff(g, "cntry_round", "Sim1 Bottom", "Sim4 Random")
    return rounded(t, ["cntry_round", "response_model"], ["first", "second", "diff"])


DIFFSUM_SQL = f"""{GRID}
SELECT response_model, round(avg(d), 6) AS mean_diff, round(stddev_samp(d), 6) AS sd_diff FROM (
  SELECT cntry_round, response_model, avg(CASE WHEN selected = 'Sim2 Top' THEN cv END)
    - avg(CASE WHEN selected = 'Sim1 Bottom' THEN cv END) AS d FROM grid WHERE r_indicator = 'Full' GROUP BY ALL)
WHERE d IS NOT NULL GROUP BY response_model"""


@query("diff_summary", DIFFSUM_SQL)
def diff_summary(spark, d):
    g = grid(spark, d).filter("r_indicator = 'Full'")
    t = S.diff_summary(S.scenario_diff(g, "cntry_round", "Sim1 Bottom", "Sim2 Top"))
    return rounded(t, ["response_model"], ["mean_diff", "sd_diff"])


WIDE = {"bottom": "Sim1 Bottom", "top": "Sim2 Top", "rank": "Sim3 Rank", "random": "Sim4 Random"}


def _wide_sql(value: str, where: str) -> str:
    cols = ", ".join(
        f"round(avg(CASE WHEN selected = '{s}' THEN {value} END), 6) AS mean_{k}, "
        f"round(stddev_samp(CASE WHEN selected = '{s}' THEN {value} END), 6) AS sd_{k}"
        for k, s in WIDE.items()
    )
    return f"{GRID}\nSELECT response_model, {cols} FROM grid {where} GROUP BY response_model"


def _wide(g, value):
    t = S.scenario_wide(g, WIDE, value)
    return rounded(t, ["response_model"], t.columns[1:])


@query("scenario_wide", _wide_sql("cv", "WHERE r_indicator = 'Dem'"))
def scenario_wide(spark, d):
    return _wide(grid(spark, d).filter("r_indicator = 'Dem'"), "cv")


@query("scenario_wide_rates", _wide_sql("response_rate", ""))
def scenario_wide_rates(spark, d):
    return _wide(grid(spark, d), "response_rate")


def _calibration_sql(score: str) -> str:
    return f"""{RANKED},
{sql.breaks("study", "cntry_round", score)}
SELECT cntry_round, bin, count(*) AS n, round(avg(CAST(interview AS INTEGER)), 6) AS rr,
  round(min({score}), 6) AS score_min, round(max({score}), 6) AS score_max
FROM (SELECT study.*, CAST(greatest(1, least(len(list_filter(breaks, lambda b: b <= {score})), len(breaks) - 1)) AS INTEGER) AS bin
  FROM study JOIN br USING (cntry_round) WHERE {score} IS NOT NULL) GROUP BY cntry_round, bin"""


def _calibration(spark, d, score):
    c = scenarios(spark, d).select("cntry_round", "interview", score)
    t = S.calibration_table(c, ["cntry_round"], score, "interview")
    return rounded(t, ["cntry_round", "bin", "n"], ["rr", "score_min", "score_max"])


@query("calibration_full_sim2", _calibration_sql("s_f2"))
def calibration_full_sim2(spark, d):
    return _calibration(spark, d, "score_full_sim2")


@query("calibration_full_sim1", _calibration_sql("s_f1"))
def calibration_full_sim1(spark, d):
    return _calibration(spark, d, "score_full_sim1")


@query("calibration_dem_sim2", _calibration_sql("s_d2"))
def calibration_dem_sim2(spark, d):
    return _calibration(spark, d, "score_dem_sim2")


@query("calibration_dem_sim1", _calibration_sql("s_d1"))
def calibration_dem_sim1(spark, d):
    return _calibration(spark, d, "score_dem_sim1")
