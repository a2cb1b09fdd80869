"""Queries over rows: reading, recoding, reshaping, sequencing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.recode import (
    bin_numeric, build_timestamp, code_flag, collapse_levels, complete_cases, decode_map,
    drop_by_prefix, filter_domain, format_percent, group_key, lump_rare_levels, parse_attempt_no,
    parse_percent, recode, rename_by_pattern, score_classes, score_flags, select_by_prefix,
    split_group_key,
)
from ..operators import history, progress
from ..operators.ordering import positions
from ..operators.summaries import crosstab, crosstab_wide
from ..plans.scenarios import case_table
from ..sources.contacts import (
    decode_labels, read_contact_forms, read_stage, sample_rows, union_rounds, write_stage,
)
from ..stages import shared_dir
from . import sql
from .registry import query, r6
from .views import PRIO, STUDY, attempts, cases, table

ORDER_FORM = T.StructType([
    T.StructField("o_orderkey", T.LongType()),
    T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()),
    T.StructField("o_orderdate", T.TimestampNTZType()),
])


@query("read_forms", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")
def read_forms(spark, d):
    return read_contact_forms(spark, f"{d}/orders.parquet", ORDER_FORM)


LABELS_SQL = """
SELECT c_custkey, n_name AS nation, CAST(c_nationkey AS INTEGER) AS code
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""


@query("decode_labels", LABELS_SQL)
def labels(spark, d):
    codes = table(spark, d, "nation").select(
        F.lit("nation").alias("var"), F.col("n_nationkey").alias("code"),
        F.col("n_name").alias("label"),
    )
    people = table(spark, d, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_nationkey").alias("code")
    )
    return decode_labels(people, codes, ["nation"])


UNION_SQL = f"""WITH {sql.CASES}
SELECT case_id, round, CASE WHEN round <> 1995 THEN seg END AS seg,
  CASE WHEN round <> 1996 THEN site END AS site FROM cases"""


@query("union_rounds", UNION_SQL)
def rounds(spark, d):
    c = cases(spark, d)
    return union_rounds(
        c.filter("round = 1995").select("case_id", "round", "site"),
        c.filter("round = 1996").select("case_id", "round", "seg"),
        c.filter("round > 1996").select("case_id", "round", "seg", "site"),
    )


SAMPLE_SQL = f"""WITH {sql.CASES}
SELECT case_id, cntry_round, seg FROM cases WHERE cntry IN ('ASIA', 'EUROPE')
ORDER BY md5(CAST(case_id AS VARCHAR) || '|7'), case_id LIMIT 10"""


@query("sample_rows", SAMPLE_SQL)
def display_sample(spark, d):
    c = filter_domain(cases(spark, d), {"cntry": ["ASIA", "EUROPE"]})
    return sample_rows(c.select("case_id", "cntry_round", "seg"), 10, ["case_id"], "7")


RECODE_SQL = """
SELECT o_orderkey,
  CASE WHEN o_totalprice >= 1000 AND o_totalprice <= 100000 THEN 'low'
    WHEN o_totalprice >= 90000 AND o_totalprice <= 250000 THEN 'mid'
    WHEN o_totalprice >= 250000 THEN 'high' END AS band,
  CASE WHEN o_orderstatus = 'F' THEN 'Done' WHEN o_orderpriority = '1-URGENT' THEN 'Hurry' END AS state,
  o_orderstatus <> 'P' AS settled, o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent
FROM orders"""


@query("recode_case", RECODE_SQL)
def recode_case(spark, d):
    bands = [(1000, 100000, "low"), (90000, 250000, "mid"), (250000, None, "high")]
    return table(spark, d, "orders").select(
        "o_orderkey",
        bin_numeric("o_totalprice", bands).alias("band"),
        recode([
            (F.col("o_orderstatus") == "F", F.lit("Done")),
            (F.col("o_orderpriority") == "1-URGENT", F.lit("Hurry")),
        ]).alias("state"),
        code_flag("o_orderstatus", "P", negate=True).alias("settled"),
        code_flag("o_orderpriority", ["1-URGENT", "2-HIGH"]).alias("urgent"),
    )


LUMP_SQL = """
WITH counts AS (SELECT p_type AS lv, count(*) AS c FROM part GROUP BY p_type),
cum AS (SELECT lv, c, sum(c) OVER (ORDER BY c DESC, lv ROWS UNBOUNDED PRECEDING) AS upto,
  sum(c) OVER () AS total FROM counts),
cut AS (SELECT min(upto) AS cut FROM cum WHERE c > total - upto)
SELECT p_partkey, CASE WHEN upto <= cut THEN p_type ELSE 'Other' END AS lumped,
  CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'first' WHEN p_brand = 'Brand#13' THEN 'second' END AS collapsed
FROM part JOIN cum ON lv = p_type, cut"""


@query("collapse_lump", LUMP_SQL)
def collapse_lump(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return lump_rare_levels(part, "p_type", "lumped").select(
        "p_partkey", "lumped",
        collapse_levels(
            "p_brand", {"first": ["Brand#11", "Brand#12"], "second": ["Brand#13"]}
        ).alias("collapsed"),
    )


SCORE_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s AS score,
  CASE WHEN s = 0 THEN 'None' WHEN s >= 1 THEN 'One or more' END AS two,
  CASE WHEN s = 0 THEN 'None' WHEN s = 1 THEN 'One' WHEN s >= 2 THEN 'Two or more' END AS three
FROM (SELECT *, CAST(l_returnflag = 'R' AS INTEGER) + CAST(CASE WHEN l_discount > 0.01 THEN l_discount > 0.05 END AS INTEGER)
  + CAST(l_tax > 0.04 AS INTEGER) AS s FROM lineitem)"""


@query("score_flags", SCORE_SQL)
def flags(spark, d):
    df = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        score_flags([
            F.col("l_returnflag") == "R",
            F.when(F.col("l_discount") > 0.01, F.col("l_discount") > 0.05),
            F.col("l_tax") > 0.04,
        ]).alias("score"),
    )
    return df.withColumns({
        "two": score_classes(F.col("score"), ["None", "One or more"]),
        "three": score_classes(F.col("score"), ["None", "One", "Two or more"]),
    })


TIME_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  try_strptime(printf('%04d-%02d-%02d %02d:%02d', CAST(year(l_shipdate) AS INTEGER), CAST(month(l_shipdate) AS INTEGER),
    CAST(day(l_shipdate) + 2 AS INTEGER), CAST(l_linenumber AS INTEGER), CAST(round_even(l_quantity * 1.25, 0) AS INTEGER)),
    '%Y-%m-%d %H:%M') AS time
FROM lineitem"""


@query("build_timestamp", TIME_SQL)
def timestamps(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        build_timestamp(
            F.year("l_shipdate"), F.month("l_shipdate"), F.day("l_shipdate") + 2,
            "l_linenumber", F.col("l_quantity") * 1.25,
        ).alias("time"),
    )


YEAR_RULES = [
    (1995, "ASIA", None, 1), (1995, "EUROPE", 7, 1), (1996, "AFRICA", 8, 1),
    (1997, "AMERICA", 9, 2), (1998, "MIDDLE EAST", None, 1), (1999, "ASIA", 3, 1),
]
RULES_SQL = f"""WITH {sql.ATTEMPTS},
rules(r, c, lt, y) AS (VALUES (1995, 'ASIA', NULL, 1), (1995, 'EUROPE', 7, 1), (1996, 'AFRICA', 8, 1),
  (1997, 'AMERICA', 9, 2), (1998, 'MIDDLE EAST', NULL, 1), (1999, 'ASIA', 3, 1))
SELECT case_id, attempt, CASE WHEN y IS NOT NULL AND (lt IS NULL OR month(time) < lt)
  THEN time + to_years(CAST(y AS INTEGER)) ELSE time END AS time
FROM attempts LEFT JOIN rules ON round = r AND cntry = c"""


@query("year_rules", RULES_SQL)
def year_rules(spark, d):
    a = attempts(spark, d).select("case_id", "attempt", "time", "round", "cntry")
    return history.apply_fieldwork_year(a, YEAR_RULES).select("case_id", "attempt", "time")


COMPLETE_SQL = """
SELECT * FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment,
  CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS balance FROM customer)
WHERE segment IS NOT NULL AND balance IS NOT NULL"""


@query("complete_cases", COMPLETE_SQL)
def complete(spark, d):
    c = table(spark, d, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("balance"),
    )
    return complete_cases(c, ["segment", "balance"])


DOMAIN_SQL = f"""WITH {sql.CASES}
SELECT case_id, cntry_round FROM cases
WHERE cntry IN ('ASIA', 'EUROPE', 'AMERICA') AND cntry_round NOT IN ('ASIA-1996', 'EUROPE-1999')"""


@query("filter_domain", DOMAIN_SQL)
def domain(spark, d):
    return filter_domain(
        cases(spark, d), {"cntry": ["ASIA", "EUROPE", "AMERICA"]},
        {"cntry_round": ["ASIA-1996", "EUROPE-1999"]},
    ).select("case_id", "cntry_round")


KEYS_SQL = f"""WITH {sql.CASES}
SELECT case_id, cntry_round AS k, split_part(cntry_round, '-', 1) AS left_part,
  split_part(cntry_round, '-', 2) AS right_part,
  CASE cntry WHEN 'ASIA' THEN 'Asia' WHEN 'EUROPE' THEN 'Europe' END AS known,
  CASE cntry WHEN 'ASIA' THEN 'Asia' WHEN 'EUROPE' THEN 'Europe' ELSE cntry END AS named,
  CAST(attempt AS INTEGER) AS attempt_no FROM cases"""


@query("group_keys", KEYS_SQL)
def keys(spark, d):
    c = cases(spark, d)
    names = {"ASIA": "Asia", "EUROPE": "Europe"}
    return c.select(
        "case_id", group_key("cntry", "round").alias("k"),
        *split_group_key("cntry_round", ["left_part", "right_part"]),
        decode_map("cntry", names).alias("known"),
        decode_map("cntry", names, keep_unmatched=True).alias("named"),
        parse_attempt_no(F.concat(F.lit("contact"), F.col("attempt"))).alias("attempt_no"),
    )


LEVEL_SQL = f"""WITH {sql.CASES}
SELECT cntry_round, prio, CASE prio WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS position,
  count(*) AS cases FROM cases GROUP BY ALL"""


@query("level_order", LEVEL_SQL)
def level_order(spark, d):
    """Levels that occur, with their place in the declared order."""
    c = cases(spark, d).groupBy("cntry_round", "prio").agg(F.count(F.lit(1)).alias("cases"))
    return c.withColumn("position", PRIO.sort_key().cast("int")).orderBy("cntry_round", "position")


PERCENT_SQL = f"""WITH {sql.CASES}
SELECT cntry_round, round(avg(CAST(interview AS INTEGER)), 3) AS rate, round_even(avg(attempt), 2) AS tries,
  round(round(100 * avg(CAST(interview AS INTEGER)), 1) / 100, 4) AS parsed
FROM cases GROUP BY cntry_round"""


@query("percent_round", PERCENT_SQL)
def percent_round(spark, d):
    c = cases(spark, d).groupBy("cntry_round").agg(
        F.avg(F.col("interview").cast("int")).alias("rate"), F.avg("attempt").alias("tries")
    )
    text = format_percent(F.round("rate", 3))
    return c.select(
        "cntry_round", F.round("rate", 3).alias("rate"), F.bround("tries", 2).alias("tries"),
        F.round(parse_percent(text), 4).alias("parsed"),
    )


# --- reshaping ---------------------------------------------------------------

LONG_SQL = f"""WITH {sql.ATTEMPTS}
SELECT case_id, cntry_round, attempt, time, done FROM attempts"""


def wide_form(spark, d):
    """The history folded back into one form per case, as wide as its longest case."""
    a = attempts(spark, d)
    width = a.agg(F.max("attempt")).first()[0]
    return history.attempts_wide(
        a, ["case_id", "cntry_round"], {"contact": "time", "result": "done"}, width
    )


@query("unpivot_attempts", LONG_SQL)
def unpivot_attempts(spark, d):
    return history.attempts_long(wide_form(spark, d), {"contact": "time", "result": "done"})


SUCCESS_SQL = f"""WITH {sql.ATTEMPTS}
SELECT case_id, max(success) AS last_success, min(CASE WHEN done THEN attempt END) AS first_success,
  CAST(max(n_success) AS INTEGER) AS n_success FROM attempts GROUP BY case_id"""


@query("success_attempt", SUCCESS_SQL)
def success(spark, d):
    w = wide_form(spark, d)
    last, total = history.success_columns(w, "result")
    first, _ = history.success_columns(w, "result", "first")
    return w.select(
        "case_id", last.alias("last_success"), first.alias("first_success"),
        total.alias("n_success"),
    )


EVENTS_SQL = """
SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN k END) AS success,
  count(CASE WHEN event_type = 'purchase' THEN 1 END) AS n_success, count(*) AS attempts
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
GROUP BY user_id"""


@query("long_histories", EVENTS_SQL)
def long_histories(spark, d):
    """Cases with many attempts: users and their events."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    e = positions(e, ["user_id"], ["ts", "event_id"], "k").withColumn(
        "done", F.col("event_type") == "purchase"
    )
    return e.groupBy("user_id").agg(
        *[a.alias(n) for n, a in history.success_aggregates(attempt="k").items()],
        F.count(F.lit(1)).alias("attempts"),
    )


PIVOT_SQL = f"""WITH {sql.CASES}
SELECT cntry_round, round(avg(CASE WHEN seg = 'Household' THEN CAST(interview AS INTEGER) END), 6) AS "Household",
  round(avg(CASE WHEN seg = 'Industry' THEN CAST(interview AS INTEGER) END), 6) AS "Industry"
FROM cases GROUP BY cntry_round"""


def seg_rates(spark, d):
    return cases(spark, d).groupBy("cntry_round", "seg").agg(
        F.round(F.avg(F.col("interview").cast("int")), 6).alias("rate")
    )


@query("scenario_pivot", PIVOT_SQL)
def scenario_pivot(spark, d):
    return history.pivot_scenarios(
        seg_rates(spark, d), ["cntry_round"], "seg", "rate", ["Household", "Industry"]
    )


UNPIVOT_SQL = f"""WITH {sql.CASES}
SELECT cntry_round, measure, value FROM (
  SELECT cntry_round, 'cases' AS measure, count(*) AS value FROM cases GROUP BY cntry_round
  UNION ALL SELECT cntry_round, 'attempts', CAST(sum(attempt) AS BIGINT) FROM cases GROUP BY cntry_round)"""


@query("unpivot_measures", UNPIVOT_SQL)
def unpivot(spark, d):
    t = cases(spark, d).groupBy("cntry_round").agg(
        F.count(F.lit(1)).alias("cases"), F.sum("attempt").cast("bigint").alias("attempts")
    )
    return history.unpivot_measures(t, ["cntry_round"], ["cases", "attempts"], "measure", "value")


PREFIX_SQL = """SELECT l_orderkey, l_linenumber, l_partkey AS item_partkey, l_suppkey AS item_suppkey,
  coalesce(CASE WHEN l_returnflag = 'R' THEN l_quantity END, 0.0) AS returned FROM lineitem"""


@query("prefix_columns", PREFIX_SQL)
def prefix_columns(spark, d):
    """Columns picked, dropped and renamed by their names; NULL filled."""
    line = table(spark, d, "lineitem").withColumn(
        "returned", F.coalesce(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")), F.lit(0.0))
    )
    line = drop_by_prefix(line, "l_ship", "l_return", "l_linestatus", "l_tax", "l_discount", "l_ext", "l_quan")
    line = rename_by_pattern(rename_by_pattern(line, "l_part", "item_part"), "l_supp", "item_supp")
    return line.select("l_orderkey", "l_linenumber", *select_by_prefix(line, "item_"), "returned")


STAGE_SQL = f"WITH {sql.CASES} SELECT case_id, cntry, round, interview FROM cases"


@query("stage_round_trip", STAGE_SQL)
def stage_round_trip(spark, d):
    """Cases written one directory per round and read back."""
    c = cases(spark, d).select("case_id", "cntry", "round", "interview")
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/rounds-{uuid.uuid4().hex}"
    write_stage(c, path)
    return read_stage(spark, path, c.schema)


# --- sequencing --------------------------------------------------------------

SEQUENCE_SQL = f"""WITH {sql.PROGRESS}
SELECT cntry_round, case_id, attempt, attempt_number, n, round(attempt_pct, 6) AS attempt_pct FROM progress"""


@query("attempt_sequence", SEQUENCE_SQL)
def attempt_sequence(spark, d):
    a = attempts(spark, d).select("cntry_round", "case_id", "attempt", "time")
    s = progress.sequence_attempts(a, "cntry_round", ["time", "case_id", "attempt"])
    return s.select("cntry_round", "case_id", "attempt", "attempt_number", "n", r6("attempt_pct"))


FLAGS_SQL = f"""WITH {sql.PROGRESS}
SELECT case_id, attempt, attempt_first50pct, attempt_first60pct, attempt_first70pct, attempt_first80pct,
  status_final, status_final AND attempt_first50pct AS status_50pct,
  status_final AND attempt_first60pct AS status_60pct, status_70pct,
  status_final AND attempt_first80pct AS status_80pct FROM progress"""


@query("progress_flags", FLAGS_SQL)
def progress_flags(spark, d):
    a = attempts(spark, d).select("cntry_round", "case_id", "attempt", "time", "success")
    s = progress.sequence_attempts(a, "cntry_round", ["time", "case_id", "attempt"])
    f = progress.fieldwork_progress(s)
    names = [c for c in f.columns if c.startswith(("attempt_first", "status_"))]
    return f.select("case_id", "attempt", *names)


LAST_SQL = f"""WITH {sql.CASES}
SELECT case_id, cntry_round, attempt, time, attempt_number, interview, status_70pct FROM cases"""


@query("last_attempt", LAST_SQL)
def last(spark, d):
    return case_table(attempts(spark, d), STUDY).select(
        "case_id", "cntry_round", "attempt", "time", "attempt_number", "interview", "status_70pct"
    )


REACHED_SQL = f"WITH {sql.CASES} SELECT cntry_round, case_id, attempt_number_70pct FROM cases"


@query("attempts_at_cutoff", REACHED_SQL)
def reached(spark, d):
    a = attempts(spark, d).select("cntry_round", "case_id", "attempt", "time", "success")
    s = progress.sequence_attempts(a, "cntry_round", ["time", "case_id", "attempt"])
    f = progress.fieldwork_progress(s, [0.7])
    return progress.attempts_at_cutoff(f, ["cntry_round", "case_id"], "attempt_first70pct")


EDGES_SQL = f"""WITH {sql.CASES}
SELECT case_id, round = min(round) OVER (PARTITION BY cntry) AS is_first,
  round = max(round) OVER (PARTITION BY cntry) AS is_last FROM cases"""


@query("first_last_period", EDGES_SQL)
def edges(spark, d):
    c = cases(spark, d).select("case_id", "cntry", "round")
    return progress.first_last_period(c, "cntry", "round").select("case_id", "is_first", "is_last")


PREVIOUS_SQL = f"WITH {sql.CASES}, {sql.PREVIOUS} SELECT cntry, round, previous FROM previous"


@query("previous_period", PREVIOUS_SQL)
def previous(spark, d):
    return progress.previous_available_period(cases(spark, d), "cntry", "round")


KEEP_SQL = f"""WITH {sql.CASES}
SELECT case_id, cntry_round FROM cases WHERE cntry_round IN
  (SELECT cntry_round FROM cases WHERE attempt >= 10)"""


@query("filter_groups", KEEP_SQL)
def keep_groups(spark, d):
    c = cases(spark, d).select("case_id", "cntry_round", "attempt")
    return progress.filter_groups_with(c, "cntry_round", F.col("attempt") >= 10).drop("attempt")


CROSS1_SQL = f"""WITH {sql.CASES}
SELECT prio, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS percent FROM cases GROUP BY prio"""


@query("crosstab1", CROSS1_SQL)
def crosstab1(spark, d):
    return crosstab(cases(spark, d), "prio").select("prio", "n", r6("percent"))


@query("crosstab2", f"WITH {sql.CASES} SELECT seg, interview, count(*) AS n FROM cases GROUP BY ALL")
def crosstab2(spark, d):
    return crosstab(cases(spark, d), "seg", "interview")


@query(
    "crosstab3",
    f"WITH {sql.CASES} SELECT seg, interview, cntry_round, count(*) AS n FROM cases GROUP BY ALL",
)
def crosstab3(spark, d):
    return crosstab(cases(spark, d), "seg", "interview", "cntry_round")


WIDE_SQL = f"""WITH {sql.CASES}
SELECT seg, cntry_round, count(CASE WHEN prio = 'Low' THEN 1 END) AS "Low",
  count(CASE WHEN prio = 'Medium' THEN 1 END) AS "Medium", count(CASE WHEN prio = 'High' THEN 1 END) AS "High"
FROM cases GROUP BY ALL"""


@query("crosstab_wide", WIDE_SQL)
def crosstab_pivot(spark, d):
    return crosstab_wide(cases(spark, d), ["seg", "cntry_round"], "prio", PRIO.values)
