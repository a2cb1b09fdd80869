"""Queries over groups: joins, aggregates, moments, effect sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import summaries as S
from ..operators.indicators import merge_categories
from ..operators.targeting import anti_selected, argmin_per_group
from ..stages import stage
from . import sql
from .registry import query, r6, rounded
from .views import FULL, PRIO, cases

# Weight that is constant per order status, and one that is free.
STSI_WEIGHT = "CASE status WHEN 'F' THEN 1.5 WHEN 'O' THEN 2.0 ELSE 3.0 END"
PPS_WEIGHT = "1 + abs(balance) / 1000"


def weighted_cases(spark, d):
    return cases(spark, d).withColumns({
        "w": F.expr(f"CAST({STSI_WEIGHT} AS DOUBLE)"), "v": F.expr(PPS_WEIGHT),
        "y": F.col("interview").cast("double"),
    })


WEIGHTED = f"""WITH {sql.CASES},
wc AS (SELECT *, CAST({STSI_WEIGHT} AS DOUBLE) AS w, {PPS_WEIGHT} AS v,
  CAST(CAST(interview AS INTEGER) AS DOUBLE) AS y FROM cases)"""


SUMMARY_SQL = f"""WITH {sql.CASES}
SELECT cntry_round, seg, count(*) AS n, CAST(sum(attempt) AS BIGINT) AS sum_attempt,
  round(avg(attempt), 6) AS mean_attempt, round(stddev_samp(attempt), 6) AS sd_attempt,
  min(attempt) AS min_attempt, max(attempt) AS max_attempt, round(sum(price), 2) AS sum_price,
  round(avg(price), 4) AS mean_price, round(stddev_samp(price), 4) AS sd_price,
  min(price) AS min_price, max(price) AS max_price
FROM cases GROUP BY ALL"""


@query("group_summary", SUMMARY_SQL)
def group_summary(spark, d):
    s = S.summarise_groups(cases(spark, d), ["cntry_round", "seg"], ["attempt", "price"])
    return s.withColumns({
        "mean_attempt": F.round("mean_attempt", 6), "sd_attempt": F.round("sd_attempt", 6),
        "sum_price": F.round("sum_price", 2), "mean_price": F.round("mean_price", 4),
        "sd_price": F.round("sd_price", 4),
    })


@query(
    "distinct_groups",
    f"WITH {sql.CASES} SELECT cntry, count(DISTINCT cntry_round) AS n_cntry_round FROM cases GROUP BY cntry",
)
def distinct_groups(spark, d):
    return S.distinct_groups(cases(spark, d), ["cntry"], "cntry_round")


MOMENTS_SQL = f"""{WEIGHTED},
m AS (SELECT *, sum(v) OVER g AS sw, sum(v * attempt) OVER g / sum(v) OVER g AS ma,
  sum(v * y) OVER g / sum(v) OVER g AS my FROM wc WINDOW g AS (PARTITION BY cntry_round))
SELECT cntry_round, round(max(sw), 6) AS sum_w, round(max(ma), 6) AS mean_attempt, round(max(my), 6) AS mean_y,
  round(sum(v * (attempt - ma) * (attempt - ma)) / (max(sw) - 1), 6) AS var_attempt,
  round(sum(v * (y - my) * (y - my)) / (max(sw) - 1), 6) AS var_y,
  round(sum(v * (attempt - ma) * (attempt - ma)) / max(sw), 6) AS var_ml_attempt,
  round(sum(v * (y - my) * (y - my)) / max(sw), 6) AS var_ml_y,
  round(sum(v * (attempt - ma) * (y - my)) / max(sw), 6) AS cov_attempt_y
FROM m GROUP BY cntry_round"""


@query("weighted_moments", MOMENTS_SQL)
def weighted_moments(spark, d):
    m = C.weighted_moments(weighted_cases(spark, d), ["cntry_round"], ["attempt", "y"], "v")
    return m.select("cntry_round", *[r6(c) for c in m.columns[1:]])


STRATA_SQL = f"""{WEIGHTED}
SELECT cntry_round, round(sum(nn * nn * (1 - n / nn) * vv / n), 4) AS var_total FROM (
  SELECT cntry_round, status, sum(w) AS nn, count(*) AS n, var_samp(y) AS vv FROM wc GROUP BY ALL)
GROUP BY cntry_round"""


@query("strata_var_total", STRATA_SQL)
def strata_var_total(spark, d):
    v = C.strata_var_total(weighted_cases(spark, d), ["cntry_round"], "y", "w", "status")
    return rounded(v, ["cntry_round"], ["var_total"], 4)


PPS_SQL = f"""{WEIGHTED}
SELECT cntry_round, round(sum(pow(n * y * v - t, 2)) / max(n) / (max(n) - 1), 3) AS var_total
FROM (SELECT *, count(*) OVER (PARTITION BY cntry_round) AS n,
  sum(y * v) OVER (PARTITION BY cntry_round) AS t FROM wc) q GROUP BY cntry_round"""
PPS_SQL = PPS_SQL.replace("SELECT *, count", "SELECT wc.* EXCLUDE (n), count")


@query("pps_var_total", PPS_SQL)
def pps_var_total(spark, d):
    v = C.pps_var_total(weighted_cases(spark, d), ["cntry_round"], "y", "v")
    return rounded(v, ["cntry_round"], ["var_total"], 3)


CELLS_SQL = f"""{WEIGHTED}
SELECT cntry_round, r AS response, prio, barrier, count(*) AS n, round(sum(v), 6) AS w, round(sum(v * v), 6) AS w2,
  round(sum(v * val), 6) AS y FROM (
    SELECT *, 'interview' AS r, y AS val FROM wc UNION ALL
    SELECT *, 'status_70pct', CAST(CAST(status_70pct AS INTEGER) AS DOUBLE) FROM wc)
GROUP BY ALL"""


@query("covariate_cells", CELLS_SQL)
def covariate_cells(spark, d):
    c = C.covariate_cells(
        weighted_cases(spark, d), ["cntry_round"], ["prio", "barrier"],
        ["interview", "status_70pct"], "v",
    )
    return c.select(
        "cntry_round", "response", "prio", "barrier", "n", r6("w"), r6("w2"), r6("y")
    )


DESIGN_SQL = f"""WITH {sql.CASES}
SELECT case_id, CAST(seg = 'Industry' AS INTEGER) AS seg, CAST(site = 'Closed' AS INTEGER) AS site,
  CAST(barrier = 'Barriers' AS INTEGER) AS barrier, CAST(prio = 'Medium' AS INTEGER) AS medium,
  CAST(prio = 'High' AS INTEGER) AS high, CAST(seg = 'Industry' AND site = 'Closed' AS INTEGER) AS seg_site
FROM cases"""


@query("design_matrix", DESIGN_SQL)
def design_matrix(spark, d):
    m = C.design_matrix(cases(spark, d).select("case_id", *FULL.factors), FULL)
    return m.select("case_id", *[
        F.col(f"`{term}`").alias(name)
        for term, name in (
            ("seg[Industry]", "seg"), ("site[Closed]", "site"), ("barrier[Barriers]", "barrier"),
            ("prio[Medium]", "medium"), ("prio[High]", "high"),
            ("seg[Industry]:site[Closed]", "seg_site"),
        )
    ])


SHARE_SQL = f"""{WEIGHTED}
SELECT cntry_round, prio, round(sum(v), 6) AS sum_w, round(sum(v * y) / sum(v), 6) AS share
FROM wc GROUP BY ALL"""


@query("group_share", SHARE_SQL)
def group_share(spark, d):
    g = C.group_share_by_category(weighted_cases(spark, d), ["cntry_round"], "prio", "y", "v")
    return rounded(g, ["cntry_round", "prio"], ["sum_w", "share"])


AVE_SQL = f"""{WEIGHTED}
SELECT case_id, round(sum(v * y) OVER g / sum(v) OVER g, 6) AS mean_others,
  round(avg(y) OVER (PARTITION BY cntry_round), 6) AS mean_group
FROM wc WINDOW g AS (PARTITION BY cntry_round, barrier, seg, site)"""


@query("ave_window", AVE_SQL)
def ave_window(spark, d):
    c = weighted_cases(spark, d)
    c = C.group_mean_broadcast(c, ["cntry_round", "barrier", "seg", "site"], "y", "v", "mean_others")
    c = C.group_mean_broadcast(c, ["cntry_round"], "y", out="mean_group")
    return rounded(c, ["case_id"], ["mean_others", "mean_group"])


WSTRATA_SQL = f"""{WEIGHTED}
SELECT case_id, CAST(by_status AS INTEGER) AS by_status,
  CASE WHEN k <= 20 THEN CAST(by_price AS INTEGER) ELSE 1 END AS by_price
FROM (SELECT case_id, dense_rank() OVER (PARTITION BY cntry_round ORDER BY w) AS by_status,
  dense_rank() OVER (PARTITION BY cntry_round ORDER BY v) AS by_price, cntry_round FROM wc)
JOIN (SELECT cntry_round, count(DISTINCT v) AS k FROM wc GROUP BY cntry_round) USING (cntry_round)"""


@query("weights_to_strata", WSTRATA_SQL)
def weights_to_strata(spark, d):
    c = weighted_cases(spark, d).select("case_id", "cntry_round", "w", "v")
    c = C.infer_strata(c, ["cntry_round"], "w", out="by_status")
    c = C.infer_strata(c, ["cntry_round"], "v", out="by_price")
    return c.select("case_id", "by_status", "by_price")


SDESIGN_SQL = f"""{WEIGHTED}
SELECT cntry_round, 'status' AS strata, count(*) AS n_strata, bool_and(lo = hi) AS constant_weights,
  CASE WHEN NOT bool_and(lo = hi) THEN 'PPS' WHEN count(*) = 1 THEN 'SI' ELSE 'STSI' END AS design
FROM (SELECT cntry_round, status, min(w) AS lo, max(w) AS hi FROM wc GROUP BY ALL) GROUP BY cntry_round
UNION ALL
SELECT cntry_round, 'segment', count(*), bool_and(lo = hi),
  CASE WHEN NOT bool_and(lo = hi) THEN 'PPS' WHEN count(*) = 1 THEN 'SI' ELSE 'STSI' END
FROM (SELECT cntry_round, segment, min(v) AS lo, max(v) AS hi FROM wc GROUP BY ALL) GROUP BY cntry_round"""


@query("sample_design", SDESIGN_SQL)
def sample_design(spark, d):
    c = weighted_cases(spark, d)
    a = C.sample_design(c, ["cntry_round"], "w", "status").withColumn("strata", F.lit("status"))
    b = C.sample_design(c, ["cntry_round"], "v", "segment").withColumn("strata", F.lit("segment"))
    return a.unionByName(b)


def _d(value, factor, a, b):
    return f"""SELECT cntry, '{value}' AS variable, '{factor}' AS factor, '{a}' AS group1, '{b}' AS group2,
  round((m1 - m2) / sqrt((v1 + v2) / 2), 6) AS effsize, n1, n2,
  CASE WHEN abs((m1 - m2) / sqrt((v1 + v2) / 2)) < 0.2 THEN 'negligible'
    WHEN abs((m1 - m2) / sqrt((v1 + v2) / 2)) < 0.5 THEN 'small'
    WHEN abs((m1 - m2) / sqrt((v1 + v2) / 2)) < 0.8 THEN 'moderate' ELSE 'large' END AS magnitude
FROM (SELECT cntry, avg({value}) FILTER ({factor} = '{a}') AS m1, avg({value}) FILTER ({factor} = '{b}') AS m2,
  var_samp({value}) FILTER ({factor} = '{a}') AS v1, var_samp({value}) FILTER ({factor} = '{b}') AS v2,
  count({value}) FILTER ({factor} = '{a}') AS n1, count({value}) FILTER ({factor} = '{b}') AS n2
  FROM cases GROUP BY cntry)"""


D_SQL = f"WITH {sql.CASES} " + "\nUNION ALL ".join(
    _d("price", "prio", a, b) for a, b in (("Low", "Medium"), ("Low", "High"), ("Medium", "High"))
)


@query("cohens_d", D_SQL)
def cohens_d(spark, d):
    e = S.cohens_d(cases(spark, d), "price", "prio", ["cntry"], PRIO.values)
    return e.withColumn("effsize", F.round("effsize", 6))


EFFECT_VALUES = {"price": "Price", "attempt": "Attempts", "balance": "Balance", "n_success": "Successes"}
EFFECT_FACTORS = {
    "site": ("Type of site", ("Open", "Closed")),
    "seg": ("Type of segment", ("Household", "Industry")),
    "barrier": ("Barriers to access", ("No barriers", "Barriers")),
}
EFFECT_SQL = f"WITH {sql.CASES} " + "\nUNION ALL ".join(
    f"SELECT * EXCLUDE (group1, group2), '{label}' AS y_lab, '{text}: {lv[0]} - {lv[1]}' AS comp FROM ("
    + _d(v, f, *lv) + ")"
    for v, label in EFFECT_VALUES.items() for f, (text, lv) in EFFECT_FACTORS.items()
)


@query("effect_table", EFFECT_SQL)
def effect_table(spark, d):
    e = S.effect_table(cases(spark, d), EFFECT_VALUES, EFFECT_FACTORS, ["cntry"])
    return e.withColumn("effsize", F.round("effsize", 6))


MERGE_SQL = f"""WITH {sql.CASES}
SELECT cntry_round, 'prio' AS variable, prio AS category, count(*) AS cases,
  round(avg(CAST(interview AS INTEGER)), 6) AS rate FROM cases GROUP BY ALL"""


@query("category_merge", MERGE_SQL)
def category_merge(spark, d):
    c = cases(spark, d).withColumns({"variable": F.lit("prio"), "category": F.col("prio")})
    key = ["cntry_round", "variable", "category"]
    a = c.groupBy(*key).agg(F.count(F.lit(1)).alias("cases"))
    b = c.groupBy(*key).agg(F.round(F.avg(F.col("interview").cast("int")), 6).alias("rate"))
    return merge_categories(a, b, ["cntry_round"])


ANTI_SQL = f"WITH {sql.CASES} SELECT cntry_round, case_id FROM cases WHERE NOT attempt_first70pct"


@query("anti_selected", ANTI_SQL)
def not_selected(spark, d):
    c = cases(spark, d)
    taken = c.filter("attempt_first70pct").select("cntry_round", "case_id")
    return anti_selected(c.select("cntry_round", "case_id"), taken, ["cntry_round", "case_id"])


ALLOWED_SQL = f"""WITH {sql.CASES}
SELECT cntry_round, case_id FROM cases WHERE cntry_round IN
  (SELECT cntry_round FROM cases GROUP BY cntry_round HAVING avg(CAST(interview AS INTEGER)) > 0.74)"""


@query("allowed_groups", ALLOWED_SQL)
def allowed_groups(spark, d):
    c = cases(spark, d).select("cntry_round", "case_id", "interview")
    good = c.groupBy("cntry_round").agg(F.avg(F.col("interview").cast("int")).alias("rate"))
    allowed = stage(good.filter("rate > 0.74"), "allowed")
    return c.join(allowed, "cntry_round", "left_semi").drop("interview")


ARGMIN_SQL = f"""WITH {sql.CASES}
SELECT cntry_round, arg_min(case_id, (price, case_id)) AS case_id, min(price) AS price
FROM cases GROUP BY cntry_round"""
ARGMIN_SQL = ARGMIN_SQL.replace("arg_min(case_id, (price, case_id))", "first(case_id ORDER BY price, case_id)")


@query("argmin_per_group", ARGMIN_SQL)
def argmin(spark, d):
    return argmin_per_group(cases(spark, d), ["cntry_round"], "case_id", "price")


SETS_SQL = f"""WITH {sql.CASES}
SELECT DISTINCT cntry_round, seg, site FROM cases EXCEPT
SELECT cntry_round, seg, site FROM cases WHERE attempt >= 8"""


@query("distinct_union_minus", SETS_SQL)
def sets(spark, d):
    c = cases(spark, d).select("cntry_round", "seg", "site", "attempt")
    parts = c.filter("attempt < 4").unionByName(c.filter("attempt >= 4")).drop("attempt")
    return parts.distinct().subtract(c.filter("attempt >= 8").drop("attempt"))


EXPLODE_SQL = f"""WITH {sql.CASES}
SELECT case_id, 1 AS place, seg AS level FROM cases UNION ALL
SELECT case_id, 2, site FROM cases UNION ALL SELECT case_id, 3, barrier FROM cases"""


@query("explode_lists", EXPLODE_SQL)
def explode_lists(spark, d):
    """A short list per case, one row per entry."""
    entries = F.posexplode(F.array("seg", "site", "barrier")).alias("place", "level")
    return cases(spark, d).select("case_id", entries).withColumn("place", F.col("place") + 1)
