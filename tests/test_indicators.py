import numpy as np
import pytest
from pyspark.sql import functions as F

import rowwise
from fieldwise.operators.cells import covariate_cells, infer_strata, sample_design
from fieldwise.operators.indicators import indicator_by_group, overall_indicators
from fieldwise.specs import Levels, ModelSpec
from test_models import A, B, C, SPEC, sample

NAMES = ["prop_mean", "r", "r_unadj", "r_se", "bias_factor", "cv", "cv_unadj", "cv_se"]
FACTORS = {"a": A, "b": B, "c": C, "s": Levels("s", ("x", "y"))}


@pytest.fixture(scope="module")
def data(spark):
    pdf = sample()
    pdf["s"] = np.where(np.arange(len(pdf)) % 3 == 0, "x", "y")
    return pdf, spark.createDataFrame(pdf)


CASES = [
    (None, None, "SI"), ("w", None, "STSI"), ("w", "c", "STSI"), ("v", None, "PPS"), ("v", "c", "PPS"),
]


@pytest.mark.parametrize("weight, stratum, kind", CASES)
@pytest.mark.parametrize("family", ["binomial", "gaussian"])
def test_against_rows(data, weight, stratum, kind, family):
    pdf, df = data
    got = indicator_by_group(
        df, SPEC, ["y"], ["g"], weight, stratum, family, partials=True, other_variables=["s"]
    )
    overall = {r.g: r for r in got.overall.collect()}
    by_var = {(r.g, r.variable): r for r in got.by_variable.collect()}
    by_cat = {(r.g, r.variable, r.category): r for r in got.by_category.collect()}
    for g, part in pdf.groupby("g"):
        w = part[weight].to_numpy() if weight else np.ones(len(part))
        if stratum:
            strata = part[stratum].to_numpy()
        else:
            few = len(np.unique(w)) <= 20
            strata = np.unique(w, return_inverse=True)[1] if few else np.zeros(len(w))
        base, parts = rowwise.partials(
            part, SPEC, part.y.to_numpy(float), w, strata, list(FACTORS),
            lambda v: ModelSpec((FACTORS[v],)), family,
        )
        assert overall[g].design == kind == base["design"]
        for k in NAMES:
            assert overall[g][k] == pytest.approx(base[k], abs=1e-8), k
        for v, (var, cats) in parts.items():
            for k, x in var.items():
                assert by_var[g, v][k] == pytest.approx(x, abs=1e-7), (v, k)
                cvk = "cv" + k[1:]
                assert by_var[g, v][cvk] == pytest.approx(x / base["prop_mean"], abs=1e-7)
            for c, want in cats.items():
                for k, x in want.items():
                    assert by_cat[g, v, c][k] == pytest.approx(x, abs=1e-7), (v, c, k)


def test_invariants(data):
    pdf, df = data
    got = indicator_by_group(df, SPEC, ["y"], ["g"], "w", partials=True)
    for r in got.overall.collect():
        rate = np.average(pdf[pdf.g == r.g].y, weights=pdf[pdf.g == r.g].w)
        assert 0 <= r.bias_factor <= 1 and r.r_unadj <= r.r <= 1
        assert r.prop_mean == pytest.approx(rate)
    cats = got.by_category.groupBy("g", "variable").agg(F.sum(F.col("pu_unadj") ** 2).alias("s"))
    for r in cats.join(got.by_variable, ["g", "variable"]).collect():
        assert r.s == pytest.approx(r.pu_unadj**2)


def test_reference_level_and_layout_do_not_matter(spark, data):
    _, df = data
    base = indicator_by_group(df, SPEC, ["y"], ["g"]).overall.orderBy("g").collect()
    turned = ModelSpec(
        (Levels("a", A.values[::-1]), Levels("b", B.values[::-1]), C), (("a", "b"),)
    )
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        again = indicator_by_group(df.repartition(9), turned, ["y"], ["g"]).overall
        again = again.orderBy("g").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for x, y in zip(base, again):
        for k in NAMES:
            assert x[k] == pytest.approx(y[k], abs=1e-9)


def test_bias_above_variance_gives_zero_factor(spark):
    df = spark.createDataFrame(
        [("g", a, y) for a in ("a0", "a1") for y in (0, 1) for _ in range(4)]
        + [("g", "a1", 1)], "g string, a string, y int",
    )
    r = indicator_by_group(df, ModelSpec((A,)), ["y"], ["g"]).overall.first()
    assert r.bias_factor == 0 and r.r == 1 and r.cv == 0 and r.r_unadj < 1


def test_aliased_model_has_no_adjusted_values(spark):
    data = [("g", a, b, y) for a, b in (("a0", "b0"), ("a1", "b0"), ("a0", "b1"))
            for y in (0, 1, 1, 1) + (0,) * (a == "a1")]
    df = spark.createDataFrame(data, "g string, a string, b string, y int")
    spec = ModelSpec((A, B), (("a", "b"),))
    got = indicator_by_group(df, spec, ["y"], ["g"], partials=True)
    r = got.overall.first()
    assert r.bias_factor is None and r.r is None and r.cv is None and r.cv_se is None
    assert r.r_unadj is not None and r.cv_unadj is not None
    assert all(v.pu is None and v.pu_unadj is not None for v in got.by_variable.collect())


def test_everyone_responds(spark):
    df = spark.createDataFrame([("g", a, 1) for a in ("a0", "a1") for _ in range(5)],
                               "g string, a string, y int")
    r = indicator_by_group(df, ModelSpec((A,)), ["y"], ["g"]).overall.first()
    assert r.prop_mean == pytest.approx(1, abs=1e-6) and r.r_unadj == pytest.approx(1, abs=1e-6)


def test_several_models_and_responses(data):
    _, df = data
    df = df.withColumns({"stratum": F.lit(1), "y2": 1 - F.col("y")})
    cells = covariate_cells(df, ["g"], ["a", "b", "c"], ["y", "y2"], stratum="stratum")
    small = ModelSpec((A,))
    coarse = covariate_cells(df, ["g"], ["a"], ["y", "y2"], stratum="stratum")
    both = overall_indicators({"full": (cells, SPEC), "a": (coarse, small)}, ["g", "response"])
    got = {(r.g, r.response, r.model): r.r for r in both.collect()}
    assert len(got) == 8
    for g in ("g1", "g2"):
        assert got[g, "y", "full"] == pytest.approx(got[g, "y2", "full"], abs=1e-9)
    alone = indicator_by_group(df, small, ["y"], ["g"]).overall.collect()
    for r in alone:
        assert got[r.g, "y", "a"] == pytest.approx(r.r, abs=1e-9)


def test_strata_and_design(spark):
    few = [("g", 1.0 + i % 3) for i in range(30)]
    many = [("h", 1.0 + i) for i in range(30)]
    df = spark.createDataFrame(few + many, "g string, w double")
    s = infer_strata(df, ["g"], "w")
    per = {r.g: r.k for r in s.groupBy("g").agg(F.count_distinct("stratum").alias("k")).collect()}
    assert per == {"g": 3, "h": 1}
    got = {r.g: r.design for r in sample_design(s, ["g"], "w", "stratum").collect()}
    assert got == {"g": "STSI", "h": "PPS"}
    one = df.withColumns({"w": F.lit(1.0), "stratum": F.lit(1)})
    assert {r.design for r in sample_design(one, ["g"], "w", "stratum").collect()} == {"SI"}
