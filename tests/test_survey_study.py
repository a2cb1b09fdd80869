import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldwise.constants import ACCESS, AGE_CATEGORY, GENDER, MULTI_UNIT, NEIGHBOURHOOD
from fieldwise.plans import survey_study
from fieldwise.plans.scenarios import Scenario
from fieldwise.plans.survey_study import (
    analysis_attempts, levels_without_model, outcome_effects, run_study,
)
from fieldwise.specs import Levels, ModelSpec


@pytest.fixture(scope="module")
def history(spark):
    r = np.random.default_rng(4)
    frames = []
    for cntry, periods in (("BE", (6, 7)), ("CH", (6, 7, 8, 9)), ("PL", (6,))):
        for period in periods:
            n = 260
            cases = pd.DataFrame({
                "cntry": cntry, "round": period, "cntry_round": f"{cntry}-{period}",
                "idno": np.arange(n), "gndr_su": r.choice(GENDER, n),
                "age_cat": r.choice(AGE_CATEGORY, n), "multi_unit": r.choice(MULTI_UNIT, n),
                "neighb": r.choice(NEIGHBOURHOOD, n), "no_access": r.choice(ACCESS, n),
                "tries": r.integers(1, 6, n),
            })
            chance = 0.35 + 0.15 * (cases.gndr_su == "Male") + 0.1 * (cases.age_cat == "65+")
            cases["interview"] = r.random(n) < chance
            cases["success"] = np.where(cases.interview, cases.tries, np.nan)
            cases.loc[0, "neighb"] = None
            long = cases.loc[cases.index.repeat(cases.tries)].reset_index(drop=True)
            long["attempt"] = long.groupby("idno").cumcount() + 1
            days = 8 * long.attempt + r.integers(0, 15, len(long))
            long["time"] = pd.Timestamp("2012-09-01") + pd.to_timedelta(days, "D")
            frames.append(long.drop(columns="tries"))
    df = spark.createDataFrame(pd.concat(frames))
    return df.withColumns({
        "time": F.col("time").cast("timestamp_ntz"), "attempt": F.col("attempt").cast("int"),
        "round": F.col("round").cast("int"),
        "success": F.when(~F.isnan("success"), F.col("success").cast("int")),
    })


def test_population(history):
    a = analysis_attempts(history)
    assert {r[0] for r in a.select("cntry_round_full").distinct().collect()} == {
        "Belgium-6", "Belgium-7", "Switzerland-6", "Switzerland-7", "Switzerland-9"}
    assert a.filter("idno = 0").isEmpty()


def test_run_study(history):
    out = run_study(history)
    groups = {r[0] for r in out.scenarios.select("cntry_round").distinct().collect()}
    # First periods have no earlier model; the excluded period is skipped over.
    assert groups == {"BE-7", "CH-7", "CH-9"}
    assert out.cases.count() == 5 * 259
    assert out.grid.count() == 3 * 20
    full = out.grid.filter("response = 'interview'").collect()
    for r in full:
        part = out.scenarios.filter(F.col("cntry_round") == r.cntry_round)
        rate = part.agg(F.avg(F.col("interview").cast("int"))).first()[0]
        assert r.response_rate == pytest.approx(rate)
        assert r.cv_ci95_lower <= r.cv <= r.cv_ci95_upper
    assert out.saved_long.count() == 3 * 8
    assert out.saved.filter("saved_full_top > poss").isEmpty()
    assert out.fit_statistics.count() == 4 * 5 and out.thresholds.count() == 3
    assert out.coefficients.filter("p_value >= 0.05").isEmpty()
    for table in out.calibration.values():
        assert table.filter("rr < 0 OR rr > 1").isEmpty()
    assert out.unseen_levels.isEmpty()
    assert out.by_group.count() == 3 * 10 and out.wide_rates.count() == out.wide["Full"].count()
    assert {r.response_model for r in out.means["Dem"].collect()} == {
        r.response_model for r in out.grid.collect()}
    for m, table in out.differences.items():
        mean = {r.response_model: r.mean_diff for r in out.difference_summary[m].collect()}
        for name, part in table.toPandas().groupby("response_model"):
            assert mean[name] == pytest.approx(part["diff"].mean())
    late = out.scenarios.filter("NOT attempt_first70pct").count()
    assert out.scatter["dem"].count() == out.scatter["full"].count() == late


def test_history_is_read_once(history, monkeypatch):
    seen = []

    def table(attempts, s):
        seen.append(attempts.inputFiles())
        raise InterruptedError

    monkeypatch.setattr(survey_study, "case_table", table)
    with pytest.raises(InterruptedError):
        run_study(history)
    assert seen[0] and all("/attempts-" in path for path in seen[0])


def test_written_study_leaves_only_its_results(spark, history, tmp_path):
    from pathlib import Path

    from fieldwise.stages import shared_dir, stage, stage_scope, times_dropped

    mine = Path(shared_dir(spark)) / spark.sparkContext.applicationId
    before, dropped = set(mine.glob("*")), times_dropped(spark)
    names = survey_study.write_study(history, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(names) and "scatter-full" in names
    assert set(mine.glob("*")) == before and times_dropped(spark) == dropped + 1
    grid = spark.read.parquet(str(tmp_path / "grid"))
    assert grid.count() == 60
    with pytest.raises(InterruptedError), stage_scope(spark):
        stage(spark.range(3), "broken")
        raise InterruptedError
    assert set(mine.glob("*")) == before
    with stage_scope(spark):
        outer = stage(spark.range(3), "outer")
        with stage_scope(spark):
            stage(spark.range(3), "inner")
        assert outer.count() == 3 and not list(mine.glob("inner-*"))
    assert set(mine.glob("*")) == before


def test_levels_without_model(spark):
    cases = spark.createDataFrame(
        [("BE", p, early, v) for p, early, v in (
            (6, True, "a"), (6, False, "a"), (7, True, "a"), (7, True, "b"), (7, False, "a"), (7, False, "b"))],
        "cntry string, round int, attempt_first70pct boolean, v string",
    )
    s = Scenario(ModelSpec((Levels("v", ("a", "b")),)), ModelSpec((Levels("v", ("a", "b")),)))
    got = levels_without_model(cases, s).select("training", "round", "variable", "level").collect()
    assert [tuple(r) for r in got] == [("previous", 7, "v", "b")]


def test_outcome_effects(history):
    people = history.filter("attempt = 1").withColumns({
        "hinctnta_n": F.col("idno") * 1.0, "eduyrs_n": F.col("idno") % 17 * 1.0,
        "happy_n": F.lit(None).cast("double"), "ppltrst_n": F.col("round") + F.col("idno") % 3.0,
        "analysed": F.lit("Interviewer observations and Demographics"),
    })
    included = people.select("cntry_round").filter("cntry_round IN ('BE-7', 'CH-9', 'CH-8')")
    got = outcome_effects(people, included).collect()
    assert {r.cntry for r in got} == {"BE", "CH"}
    assert {r.variable for r in got} == {"hinctnta_n", "eduyrs_n", "ppltrst_n"}
    assert len(got) == 2 * 3 * 3
