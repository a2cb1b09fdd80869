from datetime import datetime

from pyspark.sql import functions as F

from conftest import rows
from fieldwise.constants import AGE_BANDS
from fieldwise.functions import recode as R
from fieldwise.operators.history import apply_fieldwork_year
from fieldwise.specs import Levels


def test_age_bands_first_match_wins(spark):
    df = spark.createDataFrame([(a,) for a in (13, 14, 34, 35, 50, 64, 65, None)], "age int")
    got = dict(rows(df.select("age", R.bin_numeric("age", AGE_BANDS).alias("b"))))
    assert got == {13: None, 14: "Under 35", 34: "Under 35", 35: "35-49", 50: "35-49",
                   64: "50-64", 65: "65+", None: None}


def test_recode_without_match_is_null(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    got = dict(rows(df.select("x", R.recode([(F.col("x") == 1, F.lit("a"))]).alias("y"))))
    assert got == {1: "a", 2: None, None: None}


def test_flags_keep_null(spark):
    df = spark.createDataFrame([(4,), (1,), (None,)], "x int")
    got = dict(rows(df.select("x", R.code_flag("x", 4, negate=True).alias("y"))))
    assert got == {4: False, 1: True, None: None}


def test_score_flags_null_propagates(spark):
    df = spark.createDataFrame(
        [(True, False, True), (False, False, False), (True, None, True)],
        "a boolean, b boolean, c boolean",
    )
    s = R.score_flags(["a", "b", "c"])
    out = df.select(
        s.alias("s"), R.score_classes(s, ["None", "One", "Two or more"]).alias("k"),
        R.score_classes(s, ["None", "One or more"]).alias("k2"),
    )
    assert rows(out) == [
        (None, None, None), (0, "None", "None"), (2, "Two or more", "One or more"),
    ]


def test_build_timestamp_invalid_is_null(spark):
    df = spark.createDataFrame(
        [(2012, 9, 5, 10, 30.4), (2012, 13, 5, 10, 0.0), (2012, 2, 30, 10, 0.0),
         (2012, 2, 29, 10, 2.5), (2012, 2, None, 10, 0.0), (2012, 2, 1, 10, 59.8)],
        "y int, m int, d int, h int, mi double",
    )
    got = [r[0] for r in df.select(R.build_timestamp("y", "m", "d", "h", "mi")).collect()]
    assert got == [
        datetime(2012, 9, 5, 10, 30), None, None, datetime(2012, 2, 29, 10, 2), None, None,
    ]


def test_fieldwork_year(spark):
    df = spark.createDataFrame(
        [(6, "CZ", datetime(2012, 11, 1)), (6, "CH", datetime(2012, 7, 1)),
         (6, "CH", datetime(2012, 8, 1)), (6, "BE", datetime(2012, 1, 1)),
         (6, "DE", datetime(2012, 2, 29)), (7, "CZ", None)],
        "round int, cntry string, time timestamp_ntz",
    )
    rules = [(6, "CZ", None, 1), (6, "DE", None, 1), (6, "CH", 8, 1)]
    got = sorted(r.time for r in apply_fieldwork_year(df, rules).collect() if r.time)
    assert got == [
        datetime(2012, 1, 1), datetime(2012, 8, 1), datetime(2013, 2, 28),
        datetime(2013, 7, 1), datetime(2013, 11, 1),
    ]
    assert apply_fieldwork_year(df, rules).count() == 6


def test_keys_and_names(spark):
    df = spark.createDataFrame([("BE", 6), ("BE", None)], "c string, r int")
    assert rows(df.select(R.group_key("c", "r").alias("k"))) == [(None,), ("BE-6",)]
    one = spark.createDataFrame([("CH-10", "contact12", "12.5%")], "k string, n string, p string")
    got = one.select(
        *R.split_group_key("k", ["c", "r"]), R.parse_attempt_no("n"), R.parse_percent("p")
    ).first()
    assert tuple(got) == ("CH", "10", 12, 0.125)


def test_lump_rare_levels(spark):
    values = ["a"] * 40 + ["b"] * 18 + ["c"] * 4 + ["d"] * 3 + ["e"] + [None]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = dict(rows(R.lump_rare_levels(df, "x").groupBy("x").count()))
    # 40 outweighs the 26 rows after it: everything rarer is merged.
    assert got == {"a": 40, "Other": 26, None: 1}


def test_select_drop_rename(spark):
    df = spark.createDataFrame([(1, 2, 3)], "monv1 int, monv2 int, idno int")
    assert R.drop_by_prefix(df, "monv").columns == ["idno"]
    assert R.rename_by_pattern(df, "monv", "contact").columns == ["contact1", "contact2", "idno"]


def test_levels_order(spark):
    lv = Levels("x", ("Low", "Medium", "High"))
    df = spark.createDataFrame([("High",), ("Low",), ("Medium",)], "x string")
    assert [r.x for r in df.orderBy(lv.sort_key()).collect()] == ["Low", "Medium", "High"]


def test_rounding(spark):
    df = spark.createDataFrame([(0.125,), (2.5,)], "x double")
    assert [r.x for r in R.round_cols(df, ["x"], 2).collect()] == [0.13, 2.5]
    assert [r.x for r in R.round_cols(df, ["x"], 2, half_even=True).collect()] == [0.12, 2.5]
