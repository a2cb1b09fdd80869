from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from fieldwise.operators import history as H
from fieldwise.plans.contact_history import HISTORY, build_history, derive_covariates
from fieldwise.sources import contacts as C

CODES = ("idno long, cntry string, typesamp string, interva int, telnum int, gndr_su int, "
         "age_su int, type int, access int, physa int, vandaa int, littera int")


def form6(spark):
    schema = CODES + ", " + ", ".join(
        f"monv{i} int, date{i} int, hourv{i} int, minv{i} double, resulb{i} string, outnic{i} int"
        for i in (1, 2, 3)
    )
    person = "Individual person"
    return spark.createDataFrame([
        (1, "CZ", person, 1, 1, 1, 50, 7, 4, 2, 4, 4,
         9, 5, 10, 30.0, "Refusal", 1, 9, 6, 11, 0.0, "Completed interview", 1,
         None, None, None, None, None, None),
        (2, "CH", person, 2, 1, 2, 34, 3, 1, 5, 1, 4,
         1, 5, 10, 30.0, "No contact", 1, 13, 6, 11, 0.0, "No contact", 1,
         2, 29, 9, 15.6, "No contact", 1),
        (3, "CZ", "Household", 1, 1, 2, 34, 3, 1, 5, 1, 4,
         1, 5, 10, 30.0, "Completed interview", 1, None, None, None, None, None, None,
         None, None, None, None, None, None),
        (4, "BE", person, None, None, None, None, None, None, None, None, None,
         None, None, None, None, None, None, None, None, None, None, None, None,
         None, None, None, None, None, None),
    ], schema)


def form10(spark):
    schema = CODES + ", " + ", ".join(
        f"dateca{i} timestamp_ntz, resulb{i} string" for i in (1, 2)
    )
    return spark.createDataFrame([
        (1, "CH", "Individual person", 1, 1, 2, 70, 10, 4, 3, 4, 1,
         datetime(2021, 5, 1, 9), "Complete interview", datetime(2021, 5, 2, 9),
         "Complete interview"),
    ], schema)


def test_build_history(spark):
    h = build_history({6: form6(spark), 10: form10(spark)})
    assert h.columns[: len(HISTORY)] == HISTORY
    got = rows(h, "cntry_round", "idno", "attempt", "time", "success", "n_success")
    assert got == [
        ("CH-10", 1, 1, datetime(2021, 5, 1, 9), 2, 2),
        ("CH-10", 1, 2, datetime(2021, 5, 2, 9), 2, 2),
        ("CH-6", 2, 1, datetime(2013, 1, 5, 10, 30), None, 0),
        ("CH-6", 2, 3, datetime(2013, 2, 28, 9, 16), None, 0),
        ("CZ-6", 1, 1, datetime(2013, 9, 5, 10, 30), 2, 1),
        ("CZ-6", 1, 2, datetime(2013, 9, 6, 11, 0), 2, 1),
    ]


def test_derived_covariates(spark):
    d = derive_covariates(form6(spark))
    got = {r.idno: r.asDict() for r in d.collect()}
    one, two, blank = got[1], got[2], got[4]
    assert (one["age_cat"], one["multi_unit"], one["neighb"], one["no_access"]) == (
        "35-49", "Multi-unit", "None", "No barriers")
    assert (two["age50"], two["single_unit"], two["neighb3"]) == (None, "Single unit", "Two or more")
    assert blank["interview"] is None and blank["interview_na"] is True
    assert blank["neighb"] is None and blank["gndr_su"] is None


def test_success_policies(spark):
    w = spark.createDataFrame(
        [(1, True, False, True), (2, False, False, None), (3, False, True, False)],
        "id int, result1 boolean, result2 boolean, result3 boolean",
    )
    last, total = H.success_columns(w, "result")
    first, _ = H.success_columns(w, "result", "first")
    assert rows(w.select("id", last, first, total)) == [(1, 3, 1, 2), (2, None, None, 0), (3, 2, 2, 1)]


def test_wide_long_round_trip(spark):
    long = spark.createDataFrame(
        [(1, 1, datetime(2020, 1, 1), True), (1, 2, datetime(2020, 1, 2), False),
         (2, 1, datetime(2020, 1, 3), None)],
        "id int, attempt int, time timestamp_ntz, done boolean",
    )
    wide = H.attempts_wide(long, ["id"], {"contact": "time", "result": "done"}, 2)
    back = H.attempts_long(wide, {"contact": "time", "result": "done"})
    assert rows(back, *long.columns) == rows(long)


def test_union_and_decode(spark):
    a = spark.createDataFrame([(1, 2)], "id int, a int")
    b = spark.createDataFrame([(2, "x")], "id int, b string")
    assert rows(C.union_rounds(a, b), "id", "a", "b") == [(1, 2, None), (2, None, "x")]
    labels = C.literal_table(
        spark, [("a", 2, "two"), ("z", 2, "other")], "var string, code int, label string"
    )
    assert rows(C.decode_labels(C.union_rounds(a, b), labels, ["a"]), "id", "a") == [
        (1, "two"), (2, None)]


def test_stages_and_sample(spark, tmp_path):
    df = spark.range(100).withColumn("round", F.col("id") % 2)
    C.write_stage(df, str(tmp_path / "s"))
    back = C.read_stage(spark, str(tmp_path / "s"))
    assert back.filter("round = 1").count() == 50
    picked = rows(C.sample_rows(df, 10, ["id"], "s"), "id")
    assert picked == rows(C.sample_rows(df.repartition(13), 10, ["id"], "s"), "id")
    form = C.read_contact_forms(
        spark, str(tmp_path / "s"), T.StructType([T.StructField("id", T.LongType())])
    )
    assert form.count() == 100


def test_all_columns_are_decoded_at_once(spark):
    df = spark.createDataFrame(
        [(1, 1, 2.0, "1", None), (2, 2, 2.5, "x", 1), (3, 9, None, "2", 2)],
        "id int, a int, b double, c string, d int",
    )
    labels = spark.createDataFrame(
        [("a", 1, "one"), ("a", 2, "two"), ("a", 2, "deux"), ("z", 1, "first"), ("z", 2, "second"),
         ("z", None, "none"), ("other", 1, "no")],
        "var string, code int, label string",
    )
    got = C.decode_labels(df, labels, {"a": "a", "b": "z", "c": "z", "d": "z"})
    assert got.columns == df.columns
    assert rows(got) == [
        (1, "one", "second", "first", None), (2, "deux", None, None, "first"),
        (3, None, None, "second", "second")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("scalar-subquery")[0]
    empty = C.decode_labels(df, labels.filter("false"), ["a"])
    assert rows(empty, "a") == [(None,)] * 3
    assert C.literal_table(spark, [], "var string, code int").collect() == []


def test_long_rule_tables_and_rules_as_a_frame(spark):
    df = spark.createDataFrame(
        [(1, "AA", datetime(2020, 3, 1)), (1, "BB", datetime(2020, 3, 1)), (2, "AA", datetime(2020, 2, 29)),
         (1, None, datetime(2020, 1, 1))],
        "round int, cntry string, time timestamp_ntz",
    )
    rules = [(1, "BB", 4, 2), (2, "AA", None, 1)] + [(9, f"x{i}", None, 1) for i in range(20_000)]
    want = sorted([(1, "AA", datetime(2020, 3, 1)), (1, "BB", datetime(2022, 3, 1)),
                   (2, "AA", datetime(2021, 2, 28)), (1, "", datetime(2020, 1, 1))])
    as_frame = spark.createDataFrame(rules, "a int, b string, c int, d int")
    for given in (rules, as_frame):
        got = H.apply_fieldwork_year(df, given).fillna("", "cntry")
        assert sorted(map(tuple, got.collect())) == want


def test_folding_keeps_cases_holes_and_the_largest_of_repeats(spark):
    long = spark.createDataFrame(
        [(1, 1, "a", 1), (1, 3, "b", None), (1, 3, "a", 7), (2, 9, "z", 1), (3, None, "n", 1), (None, 1, "k", 2)],
        "id int, attempt long, x string, y int",
    )
    got = H.attempts_wide(long, ["id"], {"x": "x", "y": "y"}, 3)
    assert got.columns == ["id", "x1", "x2", "x3", "y1", "y2", "y3"]
    assert rows(got) == [
        (None, "k", None, None, 2, None, None), (1, "a", None, "b", 1, None, 7),
        (2, None, None, None, None, None, None), (3, None, None, None, None, None, None)]


def test_history_from_codes_equals_history_from_labels(spark):
    names = ["Completed interview", "Refusal", "No contact"]
    form = form6(spark)
    outcome = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i + 1))])
    coded = form.withColumns({
        **{f"resulb{i}": outcome[F.col(f"resulb{i}")] for i in (1, 2, 3)},
        "typesamp": F.when(F.col("typesamp") == "Household", 2).otherwise(1),
    })
    book = C.literal_table(
        spark, [("resulb", i + 1, n) for i, n in enumerate(names)]
        + [("typesamp", 1, "Individual person"), ("typesamp", 2, "Household")],
        "var string, code int, label string",
    )
    assert rows(build_history({6: coded}, labels={6: book})) == rows(build_history({6: form}))


def test_rare_assessments_are_lumped(spark):
    form = form6(spark).filter("idno = 1").drop("physa")
    counts = {1: 6, 2: 2, 3: 1, 4: 1}
    many = form.crossJoin(spark.createDataFrame(
        [(p,) for p, n in counts.items() for _ in range(n)] + [(None,)], "physa int"))
    got = derive_covariates(many).groupBy("physa", "physical_assessment").count()
    assert rows(got) == [(None, None, 1), (1, "1", 6), (2, "Other", 2), (3, "Other", 1), (4, "Other", 1)]
    assert "physical_assessment" not in derive_covariates(many, lump=False).columns


def test_stage_files_follow_bytes(spark, tmp_path):
    df = spark.range(0, 400_000, 1, 8).withColumns({
        "round": F.when(F.col("id") < 390_000, 1).otherwise(2), "x": F.md5(F.col("id").cast("string"))})
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        C.write_stage(df, str(tmp_path / "s"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {r: len(list((tmp_path / "s" / f"round={r}").glob("*.parquet"))) for r in (1, 2)}
    assert files[1] > 3 and files[2] <= 2
    assert C.read_stage(spark, str(tmp_path / "s")).count() == 400_000
