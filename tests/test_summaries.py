import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from fieldwise.operators import cells as C
from fieldwise.operators import summaries as S


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(2)
    pdf = pd.DataFrame({
        "g": r.choice(["g", "h"], 500, p=[0.8, 0.2]), "f": r.choice(["x", "y"], 500),
        "v": r.normal(size=500).round(2), "w": 1 + r.random(500), "k": r.choice(["p", "q"], 500),
    })
    return pdf, spark.createDataFrame(pdf)


def test_cohens_d(data):
    pdf, df = data
    got = {r.g: r for r in S.cohens_d(df, "v", "f", ["g"], ["x", "y"]).collect()}
    for g, part in pdf.groupby("g"):
        x, y = part[part.f == "x"].v, part[part.f == "y"].v
        d = (x.mean() - y.mean()) / np.sqrt((x.var() + y.var()) / 2)
        assert got[g].effsize == pytest.approx(d) and got[g].n1 == len(x)
    table = S.effect_table(df, {"v": "V"}, {"f": ("F", ("x", "y"))}, ["g"])
    assert {r.g: r.effsize for r in table.collect()} == pytest.approx(
        {g: r.effsize for g, r in got.items()})


def test_magnitude(spark):
    df = spark.createDataFrame([(0.1,), (-0.3,), (0.5,), (-2.0,), (None,)], "e double")
    assert [r[0] for r in df.select(S.magnitude(F.col("e"))).collect()] == [
        "negligible", "small", "moderate", "large", None]


@pytest.mark.parametrize("hot_rows", [None, 30])
def test_equal_count_bins(data, hot_rows):
    pdf, df = data
    df = df.unionByName(df.limit(1).withColumn("v", F.lit(None).cast("double")))
    got = S.equal_count_bins(df, ["g"], "v", 10, hot_rows=hot_rows)
    assert got.filter("v IS NULL").first().bin is None
    seen = {}
    for r in got.filter("v IS NOT NULL").collect():
        seen.setdefault(r.g, {})[r.v] = r.bin
    for g, part in pdf.groupby("g"):
        s = np.sort(part.v.to_numpy())
        h = (len(s) - 1) * np.arange(11) / 10
        lo, hi = s[np.floor(h).astype(int)], s[np.ceil(h).astype(int)]
        edges = np.unique(lo + (hi - lo) * (h - np.floor(h)))
        for v in part.v.unique():
            want = min((edges <= v).sum(), len(edges) - 1)
            assert seen[g][v] == want


def test_bins_of_a_constant_score(spark):
    df = spark.createDataFrame([("g", 0.5)] * 7, "g string, v double")
    assert {r.bin for r in S.equal_count_bins(df, ["g"], "v").collect()} == {1}


def test_weighted_moments_and_totals(data):
    pdf, df = data
    df = df.withColumn("u", F.col("v") * 2 + F.when(F.col("f") == "x", 1).otherwise(0))
    pdf = pdf.assign(u=pdf.v * 2 + (pdf.f == "x"))
    got = {r.g: r for r in C.weighted_moments(df, ["g"], ["v", "u"], "w").collect()}
    pps = {r.g: r.var_total for r in C.pps_var_total(df, ["g"], "v", "w").collect()}
    st = {r.g: r.var_total for r in C.strata_var_total(df, ["g"], "v", "w", "k").collect()}
    for g, part in pdf.groupby("g"):
        cov = np.cov(part.v, part.u, aweights=part.w, ddof=0)
        assert got[g].cov_v_u == pytest.approx(cov[0, 1])
        assert got[g].var_ml_v == pytest.approx(cov[0, 0])
        t, n = part.v * part.w, len(part)
        assert pps[g] == pytest.approx(((n * t - t.sum()) ** 2).sum() / n / (n - 1))
        want = 0
        for _, s in part.groupby("k"):
            big = s.w.sum()
            want += big**2 * (1 - len(s) / big) * s.v.var() / len(s)
        assert st[g] == pytest.approx(want)


def test_stratum_of_one_row_has_no_variance(spark):
    df = spark.createDataFrame([("g", "a", 1.0, 2.0)], "g string, k string, v double, w double")
    assert C.strata_var_total(df, ["g"], "v", "w", "k").first().var_total is None


def test_group_means_and_shares(data):
    pdf, df = data
    got = C.group_mean_broadcast(df, ["g", "f"], "v", "w").select("g", "f", "group_mean").distinct()
    for r in got.collect():
        part = pdf[(pdf.g == r.g) & (pdf.f == r.f)]
        assert r.group_mean == pytest.approx(np.average(part.v, weights=part.w))
    shares = C.group_share_by_category(df, ["g"], "f", "v", "w")
    assert {(r.g, r.f): r.share for r in shares.collect()} == pytest.approx(
        {(r.g, r.f): r.group_mean for r in got.collect()})


def test_crosstab(data):
    pdf, df = data
    one = {r.f: r for r in S.crosstab(df, "f").collect()}
    assert sum(r.percent for r in one.values()) == pytest.approx(1)
    wide = S.crosstab_wide(df, ["g"], "f", ["x", "y", "z"])
    assert all(r.z == 0 for r in wide.collect())


def grid(spark):
    data = []
    for g, shift in (("A", 0.0), ("B", 0.1), ("C", 0.25)):
        for m in ("M1", "M2"):
            for i, s in enumerate(("Sim1 Bottom", "Sim2 Top")):
                data.append((g, m, s, "Full", 0.1 + shift * (i + 1), 0.5 + shift))
    return spark.createDataFrame(
        data, "g string, response_model string, selected string, r_indicator string, "
              "cv double, response_rate double")


def test_scenario_tables(spark):
    g = grid(spark)
    diff = S.scenario_diff(g, "g", "Sim1 Bottom", "Sim2 Top")
    assert {r.g: round(r["diff"], 6) for r in diff.collect()} == {"A": 0, "B": 0.1, "C": 0.25}
    total = S.diff_summary(diff).first()
    assert total.mean_diff == pytest.approx(0.35 / 3)
    assert total.sd_diff == pytest.approx(np.std([0, 0.1, 0.25], ddof=1))
    means = {(r.response_model, r.selected): r for r in S.scenario_means(g, "Full").collect()}
    assert means["M1", "Sim1 Bottom"].mean_cv == 0.217
    wide = S.scenario_wide(g, {"bottom": "Sim1 Bottom"}).first()
    assert wide.mean_bottom == pytest.approx(0.1 + 0.35 / 3)


def test_coefficient_report(spark):
    t = spark.createDataFrame(
        [("a", 1.23456, 0.1, 12.3, 0.0004), ("b", 0.5, 0.2, 2.0, 0.0496), ("c", 0.1, 0.2, 0.5, 0.6),
         ("d", 0.5, 0.2, 2.0, 0.0494)],
        "term string, estimate double, std_error double, statistic double, p_value double",
    )
    got = {r.term: r for r in S.coefficient_report(t).collect()}
    # Rounding comes before the test: 0.0496 becomes 0.050, 0.0494 becomes 0.049.
    assert set(got) == {"a", "d"} and got["a"].signif == "***" and got["a"].estimate == 1.235


def test_saved_long(spark):
    saved = spark.createDataFrame([("g", 0.1, 0.2)], "g string, prop_dem_top double, prop_rand2 double")
    assert rows(S.saved_long(saved, ["g"]), "model", "simulation", "prop") == [
        ("Demographics + Interviewer obs.", "Sim4 Rand", 0.2), ("Demographics only", "Sim2 Top", 0.1)]
