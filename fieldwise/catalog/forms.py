"""Queries of the whole plans, on contact forms derived from the star schema.

An order is a sampled case with one wide form: codes, and a group of columns per attempt.  Years
become the rounds 6 to 10; the first four give times in parts without a year.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..plans.contact_history import build_history, derive_covariates
from ..plans.survey_study import outcome_effects, run_study
from ..sources.contacts import literal_table
from ..stages import stage
from . import sql
from .groups import _d
from .registry import query
from .views import attempts, once, table

COUNTRY = {"AFRICA": "BE", "AMERICA": "CH", "ASIA": "DK", "EUROPE": "EE", "MIDDLE EAST": "FI"}
SAMPLES = {"HOUSEHOLD": 2, "BUILDING": 3}
CODES = """
    case_id AS idno, CAST(6 + pmod(round - 1992, 5) AS int) AS round, country AS cntry, typesamp,
    IF(interview, 1, 2) AS interva,
    CAST(1 + money div 3 % 2 AS int) AS telnum, CAST(1 + cents % 2 AS int) AS gndr_su,
    CAST(14 + cents div 7 % 80 AS int) AS age_su, CAST(1 + money % 10 AS int) AS type,
    CAST(1 + money div 10 % 4 AS int) AS access,
    CAST(IF(cents div 11 % 10 < 6, 1, cents div 11 % 10 - 4) AS int) AS physa,
    IF(cents div 13 % 4 = 0, 1, 4) AS vandaa, IF(money div 17 % 4 = 0, 1, 4) AS littera
"""
GROUPS = {
    "monv": "month(time)", "date": "day(time)", "hourv": "8 + attempt % 12",
    "minv": "idno % 59 + 0.5D", "dateca": "time", "resulb": "IF(done, 1, 2)",
}


@once("forms")
def forms(spark, d):
    """Wide forms of all rounds, one row per case."""
    a = attempts(spark, d).withColumns({
        "country": F.create_map(*[F.lit(x) for kv in COUNTRY.items() for x in kv])[F.col("cntry")],
        "typesamp": F.coalesce(
            *[F.when(F.col("segment") == k, v) for k, v in SAMPLES.items()], F.lit(1)
        ),
        "cents": F.floor(F.col("price") * 100), "money": F.floor(F.abs("balance") * 100),
    })
    coded = [c.strip() for c in _split(CODES)]
    rows = a.selectExpr(*coded, "attempt", "time", "done")
    key = [c.rsplit(" ", 1)[-1] for c in coded]
    rows = rows.selectExpr(*key, "attempt", *[f"{e} AS a_{p}" for p, e in GROUPS.items()])
    width = rows.agg(F.max("attempt")).first()[0] or 1
    return stage(H.attempts_wide(rows, key, {p: f"a_{p}" for p in GROUPS}, width), "forms")


def _split(columns: str) -> list[str]:
    """At the commas outside brackets."""
    out, depth = [""], 0
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def one_round(spark, d, number: int):
    """A round's form: time parts up to round 9, timestamps in round 10."""
    f = forms(spark, d).filter(F.col("round") == number).drop("round")
    parts = ["dateca"] if number < 10 else ["monv", "date", "hourv", "minv"]
    return f.drop(*[c for c in f.columns if c.rstrip("0123456789") in parts])


def code_book(spark, number: int):
    done = "Completed interview" if number < 10 else "Complete interview"
    return literal_table(spark, [
        ("typesamp", 1, "Individual person"), ("typesamp", 2, "Household"),
        ("typesamp", 3, "Address"), ("resulb", 1, done), ("resulb", 2, "No contact"),
    ], "var string, code int, label string")


@once("history")
def built(spark, d):
    numbers = range(6, 11)
    out = build_history(
        {r: one_round(spark, d, r) for r in numbers},
        labels={r: code_book(spark, r) for r in numbers},
    )
    return stage(out, "history")


CODED = f"""{sql.ATTEMPTS},
coded AS (
  SELECT case_id AS idno, CAST(6 + ((round - 1992) % 5 + 5) % 5 AS INTEGER) AS round,
    CASE cntry WHEN 'AFRICA' THEN 'BE' WHEN 'AMERICA' THEN 'CH' WHEN 'ASIA' THEN 'DK'
      WHEN 'EUROPE' THEN 'EE' WHEN 'MIDDLE EAST' THEN 'FI' END AS cntry,
    segment, interview, attempt, done, CAST(success AS INTEGER) AS success,
    CAST(n_success AS INTEGER) AS n_success, time AS t, price,
    CAST(floor(price * 100) AS BIGINT) AS cents, CAST(floor(abs(balance) * 100) AS BIGINT) AS money
  FROM attempts
),
described AS (
  SELECT *, round::VARCHAR AS round_x, cntry || '-' || round AS cntry_round,
    CASE WHEN cents % 2 = 0 THEN 'Male' ELSE 'Female' END AS gndr_su,
    CASE WHEN 14 + cents // 7 % 80 <= 34 THEN 'Under 35' WHEN 14 + cents // 7 % 80 <= 50 THEN '35-49'
      WHEN 14 + cents // 7 % 80 <= 64 THEN '50-64' ELSE '65+' END AS age_cat,
    CASE WHEN money % 10 BETWEEN 5 AND 7 THEN 'Multi-unit' ELSE 'Not multi-unit' END AS multi_unit,
    CASE WHEN money // 10 % 4 = 3 THEN 'No barriers' ELSE 'Barriers' END AS no_access,
    CAST(1 + money // 3 % 2 AS INTEGER) AS telnum,
    CASE WHEN cents // 11 % 10 < 6 THEN 1 ELSE cents // 11 % 10 - 4 END AS physa,
    CAST(cents // 11 % 10 >= 8 AS INTEGER) + CAST(cents // 13 % 4 = 0 AS INTEGER)
      + CAST(money // 17 % 4 = 0 AS INTEGER) AS flags
  FROM coded
),
history AS (
  SELECT * EXCLUDE (moment), CASE WHEN flags = 0 THEN 'None' ELSE 'One or more' END AS neighb,
    CASE WHEN y AND (lt IS NULL OR month(moment) < lt) THEN moment + INTERVAL 1 YEAR ELSE moment END AS time
  FROM (
    SELECT *, CASE WHEN round = 10 THEN t ELSE TRY_CAST(printf('%d-%02d-%02d %02d:%02d:00',
      2000 + 2 * round, month(t), day(t), 8 + attempt % 12,
      CAST(round_even(CAST(idno % 59 AS DOUBLE) + 0.5, 0) AS INTEGER)) AS TIMESTAMP) END AS moment
    FROM described WHERE segment NOT IN ('HOUSEHOLD', 'BUILDING')
  ) LEFT JOIN (SELECT *, TRUE AS y FROM (VALUES (6, 'DK', NULL), (6, 'CH', 8), (6, 'EE', 8), (6, 'FI', 8),
    (7, 'CH', 8), (7, 'BE', 9), (7, 'DK', 9), (7, 'EE', 9), (7, 'FI', 9), (8, 'BE', 8), (8, 'CH', 8),
    (8, 'EE', 8), (8, 'FI', 8), (9, 'BE', 8), (9, 'CH', 8), (9, 'EE', 8), (9, 'FI', 8)) v(r, c, lt)) rules
    ON round = r AND cntry = c
  WHERE moment IS NOT NULL
)"""
BUILT = [
    "round", "idno", "cntry", "success", "n_success", "attempt", "time", "interview", "multi_unit",
    "neighb", "gndr_su", "age_cat", "telnum", "no_access", "round_x", "cntry_round",
]
BUILD_SQL = f"WITH {CODED} SELECT {', '.join(BUILT)} FROM history"


@query("history_build", BUILD_SQL)
def history_build(spark, d):
    """Forms of five rounds with codes: decoded, recoded, made long, moved to their years."""
    return built(spark, d).select(*BUILT)


LUMPED_SQL = f"""WITH {CODED},
people AS (SELECT DISTINCT idno, physa, flags FROM described WHERE round = 6),
levels AS (SELECT physa, count(*) AS n,
  sum(count(*)) OVER (ORDER BY count(*) DESC, CAST(physa AS VARCHAR)) AS upto, sum(count(*)) OVER () AS total
  FROM people GROUP BY physa)
SELECT idno, CASE WHEN upto <= (SELECT min(upto) FROM levels WHERE n > total - upto)
    THEN CAST(physa AS VARCHAR) ELSE 'Other' END AS physical_assessment,
  CASE WHEN physa <= 2 THEN 'Good' WHEN physa = 3 THEN 'Satisfactory' ELSE 'Bad' END AS physa_3,
  CASE WHEN flags = 0 THEN 'None' WHEN flags = 1 THEN 'One' ELSE 'Two or more' END AS neighb3
FROM people JOIN levels USING (physa)"""


@query("form_covariates", LUMPED_SQL)
def form_covariates(spark, d):
    """Variables of one round's forms, the rarest assessments merged."""
    f = derive_covariates(one_round(spark, d, 6))
    return f.select("idno", "physical_assessment", "physa_3", "neighb3")


OUTCOMES = {
    "hinctnta_n": "CAST(floor(o_totalprice) AS BIGINT) % 10", "eduyrs_n": "o_custkey % 25",
    "happy_n": "idno % 11", "ppltrst_n": "CAST(floor(o_totalprice) AS BIGINT) % 7",
}
ANALYSED = "CASE WHEN o_orderstatus = 'P' THEN 'Demographics' ELSE 'Interviewer observations and Demographics' END"
OUTCOME_TEXT = {
    "hinctnta_n": "HH income", "eduyrs_n": "Education (yrs)", "happy_n": "Happy", "ppltrst_n": "Trust",
}
FACTOR_TEXT = {
    "neighb": ("Neighbourhood characteristics", "None", "One or more"),
    "multi_unit": ("Type of building", "Not multi-unit", "Multi-unit"),
    "no_access": ("Barriers to access", "No barriers", "Barriers"),
}
OUTCOME_SQL = f"""WITH {CODED},
cases AS (
  SELECT history.*, {', '.join(f'{e} AS {v}' for v, e in OUTCOMES.items())}
  FROM history JOIN orders ON idno = o_orderkey
  WHERE attempt = success AND round > 6 AND cntry_round NOT IN ('EE-8', 'EE-9', 'CH-8') AND o_orderstatus <> 'P'
) """ + "\nUNION ALL ".join(
    f"SELECT * EXCLUDE (group1, group2), '{label}' AS y_lab, '{text}: {a} - {b}' AS comp FROM ({_d(v, f, a, b)}) WHERE n1 > 0 AND n2 > 0"
    for v, label in OUTCOME_TEXT.items() for f, (text, a, b) in FACTOR_TEXT.items()
)


@query("outcome_effects", OUTCOME_SQL)
def effects(spark, d):
    """Answers of the interviewed by what the interviewer saw, groups after the first round."""
    h = built(spark, d)
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    answers = h.filter("attempt = success").join(orders, F.col("idno") == F.col("o_orderkey"))
    answers = answers.withColumns({v: F.expr(e) for v, e in {**OUTCOMES, "analysed": ANALYSED}.items()})
    out = outcome_effects(answers, h.filter("round > 6"))
    return out.withColumn("effsize", F.round("effsize", 6))


@query("study_grid")
def study_grid(spark, d):
    """The whole targeting study on the history: its indicator grid."""
    return run_study(built(spark, d)).grid
