import random

import pytest
from pyspark.sql import functions as F

import rowwise
from conftest import rows
from fieldwise.operators import targeting as T


def frame(spark, data, schema="g string, id long, s double"):
    return spark.createDataFrame(data, schema)


def test_halves(spark):
    data = [("one", 1, 0.5)] + [("two", i, 0.1 * i) for i in (1, 2)]
    data += [("three", i, 1.0) for i in (1, 2, 3)] + [("null", i, None) for i in (1, 2)]
    got = T.split_at_median(frame(spark, data), ["g"], "id", F.col("s"), "seed")
    per = {
        r.g: (r.n, r.top, r.bottom)
        for r in got.groupBy("g").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("top").alias("top"),
            F.count_if("bottom").alias("bottom"),
        ).collect()
    }
    # Odd groups give the larger half to the bottom; NULL scores are not ranked.
    assert per == {"one": (1, 0, 1), "two": (2, 1, 1), "three": (3, 1, 2)}
    assert got.filter(F.col("top") == F.col("bottom")).isEmpty()
    two = {r.id: r.top for r in got.filter("g = 'two'").collect()}
    assert two == {1: False, 2: True}


def test_ranks_on_every_layout(spark):
    r = random.Random(5)
    df = frame(spark, [(r.choice("ab"), i, r.choice([0.1, 0.2, None])) for i in range(300)])
    rankings = {"x": (F.col("s"), "x"), "y": (None, "y")}
    base = rows(T.rank_random_ties(df, ["g"], "id", rankings))
    again = rows(T.rank_random_ties(df.repartition(11), ["g"], "id", rankings, hot_rows=40))
    assert base == again
    x = [t for t in base if t[0] == "a" and t[2] is not None]
    assert sorted(t[2] for t in x) == list(range(1, len(x) + 1))
    assert {t[3] for t in x} == {len(x)}


def random_groups(seed, groups):
    r = random.Random(seed)
    out = {}
    for g in range(groups):
        m = r.choice([1, 2, 3, 4, 5, 9, 30, 77])
        a, b = list(range(1, m + 1)), list(range(1, m + 1))
        r.shuffle(a)
        if r.random() < 0.3:
            b = list(a) if r.random() < 0.5 else [m + 1 - x for x in a]
        else:
            r.shuffle(b)
        out[f"g{g}"] = (dict(enumerate(a)), dict(enumerate(b)))
    return out


@pytest.mark.parametrize("start", ["aa", "ab"])
@pytest.mark.parametrize("window", [1_000_000, 6])
def test_draft_equals_greedy_rule(spark, start, window):
    groups = random_groups(7, 40)
    data = [(g, i, a[i], b[i]) for g, (a, b) in groups.items() for i in a]
    df = spark.createDataFrame(data, "g string, id int, a long, b long")
    got = T.alternating_picks(df, ["g"], "a", "b", start, window)
    picked = {}
    for r in got.collect():
        picked.setdefault(r.g, set()).update([r.id] if r.picked else [])
    for g, (a, b) in groups.items():
        want = rowwise.draft(list(a), a, b, start)
        assert picked[g] == want and len(want) == max(1, len(a) // 2), g


def test_draft_with_gaps_in_the_ranks(spark):
    groups = random_groups(11, 15)
    data = [(g, i, a[i] * 7, b[i] * 3 + 40) for g, (a, b) in groups.items() for i in a]
    df = spark.createDataFrame(data, "g string, id int, a long, b long")
    for window in (1_000_000, 25):
        got = T.alternating_picks(df, ["g"], "a", "b", window=window).filter("picked").collect()
        picked = {}
        for r in got:
            picked.setdefault(r.g, set()).add(r.id)
        assert picked == {g: rowwise.draft(list(a), a, b) for g, (a, b) in groups.items()}


def test_counterfactual_response(spark):
    df = spark.createDataFrame(
        [(y, f) for y in (True, False) for f in (True, False, None)], "y boolean, f boolean"
    )
    got = rows(df.select("y", "f", T.counterfactual_response(F.col("y"), F.col("f")).alias("r")))
    assert {(y, f): r for y, f, r in got} == {
        (True, True): True, (True, False): False, (True, None): True,
        (False, True): False, (False, False): False, (False, None): False,
    }


def test_attempts_saved(spark):
    df = spark.createDataFrame(
        [("g", 5, 2, True), ("g", 4, 0, False), ("g", 1, 1, False), ("h", 3, 3, True)],
        "g string, attempt int, attempt_number_70pct int, f boolean",
    )
    got = {r.g: r for r in T.attempts_saved(df, ["g"], {"f": "f"}).collect()}
    assert (got["g"].attempts, got["g"].poss, got["g"].saved_f) == (10, 7, 4)
    assert got["g"].prop_f == pytest.approx(0.4) and got["h"].saved_f == 0
    assert all(r.saved_f <= r.poss for r in got.values())


def test_thresholds_and_small_joins(spark):
    df = spark.createDataFrame(
        [("g", 1, 0.9, True, 0.1, True), ("g", 2, 0.7, True, 0.3, False),
         ("g", 3, 0.2, False, 0.2, True)],
        "g string, id int, t double, tf boolean, b double, bf boolean",
    )
    assert rows(T.selection_thresholds(df, ["g"], "t", "tf", "b", "bf")) == [("g", 0.7, 0.2)]
    assert rows(T.argmin_per_group(df, ["g"], "id", "t")) == [("g", 3, 0.2)]
    assert rows(T.anti_selected(df, df.filter("id < 3"), ["g", "id"]), "id") == [(3,)]
