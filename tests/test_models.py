import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import rowwise
from conftest import rows
from fieldwise.operators import propensity as P
from fieldwise.operators.cells import covariate_cells, infer_strata
from fieldwise.specs import Levels, ModelSpec

A = Levels("a", ("a0", "a1"))
B = Levels("b", ("b0", "b1", "b2"))
C = Levels("c", ("c0", "c1"))
SPEC = ModelSpec((A, B, C), (("a", "b"),))


def sample(n=900, seed=3):
    r = np.random.default_rng(seed)
    df = pd.DataFrame({
        "g": r.choice(["g1", "g2"], n), "a": r.choice(A.values, n, p=[0.6, 0.4]),
        "b": r.choice(B.values, n), "c": r.choice(C.values, n), "t": r.integers(1, 6, n),
    })
    eta = -0.3 + 0.8 * (df.a == "a1") - 0.5 * (df.b == "b2") + 0.2 * df.t
    df["y"] = (r.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    df["w"] = np.where(df.c == "c0", 1.5, 3.0)
    df["v"] = 1 + r.random(n) * 2
    return df


@pytest.fixture(scope="module")
def data(spark):
    pdf = sample()
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("weight", [None, "w", "v"])
@pytest.mark.parametrize("family", ["binomial", "gaussian"])
@pytest.mark.parametrize("max_cells", [100_000, 0])
def test_fit_equals_rows(data, weight, family, max_cells):
    pdf, df = data
    spec = SPEC.with_numeric("t")
    cells = covariate_cells(df, ["g"], spec.covariates, ["y"], weight)
    fit = P.fit_grouped(cells, spec, ["g"], family, max_cells)
    terms = {(r.g, r.term): r for r in P.fit_terms(fit, spec, ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        x, names = rowwise.design(part, spec)
        w = part[weight].to_numpy() if weight else np.ones(len(part))
        solve = rowwise.logit if family == "binomial" else rowwise.gauss
        beta, cov = solve(x, part.y.to_numpy(float), w / w.mean())
        for name, b, s in zip(names, beta, np.sqrt(np.diag(cov))):
            assert terms[g, name].estimate == pytest.approx(b, abs=1e-7)
            assert terms[g, name].std_error == pytest.approx(s, abs=1e-7)


def test_fit_statistics(data):
    pdf, df = data
    fit = P.fit_grouped(covariate_cells(df, ["g"], ["a"], ["y"]), ModelSpec((A,)), ["g"])
    stats = {r.g: r for r in P.model_fit_stats(fit, ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        p = part.groupby("a").y.transform("mean")
        ll = np.sum(part.y * np.log(p) + (1 - part.y) * np.log(1 - p))
        assert stats[g].log_lik == pytest.approx(ll)
        assert stats[g].aic == pytest.approx(4 - 2 * ll)
        assert stats[g].n_obs == len(part) and stats[g].converged


def test_incomplete_cases_are_refused(spark):
    df = spark.createDataFrame([("g", "a0", 1), ("g", None, 0)], "g string, a string, y int")
    with pytest.raises(ValueError):
        P.fit_grouped(covariate_cells(df, ["g"], ["a"], ["y"]), ModelSpec((A,)), ["g"])


def test_absent_reference_and_aliased_interaction(spark):
    data = [("g", "a1", b, y) for b in ("b1", "b2") for y in (0, 1, 1)]
    data += [("h", a, b, y) for a, b in (("a0", "b0"), ("a1", "b0"), ("a0", "b1")) for y in (0, 1)]
    df = spark.createDataFrame(data, "g string, a string, b string, y int")
    spec = ModelSpec((A, B), (("a", "b"),))
    fit = P.fit_grouped(covariate_cells(df, ["g"], ["a", "b"], ["y"]), spec, ["g"])
    got = {r.g: r for r in fit.collect()}
    roles = dict(zip([c.term for c in spec.coordinates()], got["g"].roles))
    assert (roles["a[a0]"], roles["a[a1]"], roles["b[b1]"], roles["b[b2]"]) == (
        "absent", "reference", "reference", "fitted")
    roles = dict(zip([c.term for c in spec.coordinates()], got["h"].roles))
    assert roles["a[a1]:b[b1]"] == "aliased" and got["h"].complete is False
    assert got["g"].complete is True


def test_separation_stops_and_stays(spark):
    data = [("g", "a0", 1)] * 30 + [("g", "a0", 0)] * 20 + [("g", "a1", 1)] * 10
    df = spark.createDataFrame(data, "g string, a string, y int")
    cells = covariate_cells(df, ["g"], ["a"], ["y"])
    fits = [
        P.fit_grouped(cells, ModelSpec((A,)), ["g"], max_cells=m).first() for m in (100, 0)
    ]
    for f in fits:
        assert 15 < f.effects[0] + f.effects[2] < 30 and f.iterations < 30
    assert fits[0].effects == pytest.approx(fits[1].effects, rel=1e-6)
    assert fits[0].sigma == pytest.approx(fits[1].sigma, rel=1e-6)


def test_scores(spark, data):
    pdf, df = data
    spec = ModelSpec((A, B))
    fit = P.fit_grouped(covariate_cells(df, ["g"], ["a", "b"], ["y"]), spec, ["g"])
    extra = spark.createDataFrame(
        [("g1", "a0", "zz"), ("g9", "a0", "b0")], "g string, a string, b string"
    )
    rowset = df.select("g", "a", "b").distinct().unionByName(extra)
    got = {(r.g, r.a, r.b): r.score for r in P.score(rowset, fit, spec, ["g"]).collect()}
    assert got["g1", "a0", "zz"] is None and got["g9", "a0", "b0"] is None
    for g, part in pdf.groupby("g"):
        x, _ = rowwise.design(part, spec)
        beta, _ = rowwise.logit(x, part.y.to_numpy(float), np.ones(len(part)))
        for key, p in zip(part[["a", "b"]].itertuples(index=False), 1 / (1 + np.exp(-x @ beta))):
            assert got[(g, *key)] == pytest.approx(p, abs=1e-9)
    new = P.unseen_levels(rowset, df, spec, ["g"])
    assert ("g1", "b", "zz") in rows(new) and ("g9", "a", "a0") in rows(new)


def test_level_missing_in_training_scores_null(spark):
    train = spark.createDataFrame(
        [("g", "a0", "b0", 1), ("g", "a0", "b1", 0), ("g", "a0", "b0", 0), ("g", "a0", "b1", 1)],
        "g string, a string, b string, y int",
    )
    spec = ModelSpec((A, B))
    fit = P.fit_grouped(covariate_cells(train, ["g"], ["a", "b"], ["y"]), spec, ["g"])
    new = spark.createDataFrame([("g", "a1", "b0"), ("g", "a0", "b1")], "g string, a string, b string")
    got = {r.a: r.score for r in P.score(new, fit, spec, ["g"]).collect()}
    assert got["a1"] is None and got["a0"] == pytest.approx(0.5)


def test_previous_fits(spark, data):
    pdf, df = data
    df = df.withColumns({"e": F.lit("E"), "r": F.when(F.col("g") == "g1", 6).otherwise(9)})
    fit = P.fit_grouped(covariate_cells(df, ["e", "r"], ["a"], ["y"]), ModelSpec((A,)), ["e", "r"])
    periods = spark.createDataFrame([("E", 6, None), ("E", 9, 6)], "e string, r int, previous int")
    moved = P.previous_fits(fit, periods, "e", "r").collect()
    own = {r.r: r.effects for r in fit.collect()}
    assert [(m.r, m.effects) for m in moved] == [(9, own[6])]


def cell_rows(spark, rows_):
    """Cells straight from (g, a, n, y, yy)."""
    data = [(g, "y", a, n, float(n), float(n), 1.0, 1.0, float(y), float(yy), n) for g, a, n, y, yy in rows_]
    return spark.createDataFrame(
        data, "g string, response string, a string, n long, w double, w2 double, wmin double, wmax double, "
        "y double, yy double, answered long",
    )


def both_ways(cells, family):
    spec = ModelSpec((A,))
    return [
        {r.g: r.asDict() for r in P.fit_grouped(cells, spec, ["g"], family, limit).collect()} for limit in (100_000, 0)
    ]


def agree(one, two, tol=1e-9):
    assert one.keys() == two.keys()
    for k, v in one.items():
        w = two[k]
        if isinstance(v, list) and v and not isinstance(v[0], str):
            assert [x is None for x in v] == [x is None for x in w]
            assert np.allclose([x or 0 for x in v], [x or 0 for x in w], rtol=tol, atol=tol, equal_nan=True), k
        elif isinstance(v, float):
            assert w is not None and (v == pytest.approx(w, rel=tol, abs=tol, nan_ok=True)), k
        else:
            assert v == w, k


def test_number_of_cells_does_not_change_a_fit(spark):
    many = 5_000_000
    cells = cell_rows(spark, [
        ("separated", "a0", many, many, many), ("separated", "a1", many, 0, 0),
        ("usual", "a0", 40, 10, 10), ("usual", "a1", 30, 20, 20),
        ("one side", "a0", 40, 40, 40), ("one side", "a1", 30, 20, 20),
    ])
    one, two = both_ways(cells, "binomial")
    for g in one:
        # in the separated group weights vanish, and rounding shows in the seventh digit
        agree(one[g], two[g], 1e-5 if g == "separated" else 1e-7)
    assert not one["separated"]["converged"] and one["usual"]["converged"]
    cells = cell_rows(spark, [
        ("saturated", "a0", 1, 3, 9), ("saturated", "a1", 1, 5, 25),
        ("perfect", "a0", 4, 12, 36), ("perfect", "a1", 3, 15, 75),
        ("usual", "a0", 4, 13, 50), ("usual", "a1", 3, 15, 80),
    ])
    one, two = both_ways(cells, "gaussian")
    for g in one:
        agree(one[g], two[g])


@pytest.mark.parametrize("bad", [None, 0.0, -1.0, float("nan")])
def test_bad_weights_and_strata_are_refused(spark, bad):
    kind = "g string, a string, s int, y int, w double"
    with pytest.raises(ValueError):
        covariate_cells(spark.createDataFrame([("g", "a0", 1, 1, 1.0), ("g", "a0", 1, 0, bad)], kind), ["g"], ["a"], ["y"], "w")
    with pytest.raises(ValueError):
        covariate_cells(spark.createDataFrame([("g", "a0", None, 1, 1.0)], kind), ["g"], ["a"], ["y"], "w", "s")


def test_one_large_group_leaves_the_small_ones_in_tasks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = [("big", x / 40, float(rng.random() < 0.5)) for x in range(200)]
    data += [(f"s{g}", x / 3, float((x * g + x) % 3 == 0)) for g in range(12) for x in range(9)]
    df = spark.createDataFrame(data, "g string, x double, y double")
    spec = ModelSpec((), numeric=("x",))
    cells = covariate_cells(df, ["g"], ["x"], ["y"])
    slow, whole = [], P._fit_iterative

    def watched(ready, *rest):
        slow.append({r.g for r in ready.select("g").distinct().collect()})
        return whole(ready, *rest)

    monkeypatch.setattr(P, "_fit_iterative", watched)
    mixed = {r.g: r for r in P.fit_grouped(cells, spec, ["g"], "gaussian", 50).collect()}
    assert slow == [{"big"}]
    plain = {r.g: r for r in P.fit_grouped(cells, spec, ["g"], "gaussian").collect()}
    assert slow == [{"big"}] and set(mixed) == set(plain)
    for g in plain:
        assert [round(e, 9) for e in mixed[g].effects] == [round(e, 9) for e in plain[g].effects]


def test_null_weights_are_refused(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 2.0)], "g string, w double")
    with pytest.raises(ValueError, match="weights"):
        infer_strata(df, ["g"], "w")
