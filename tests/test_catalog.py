"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from fieldwise.catalog import views
from fieldwise.catalog.all import ORACLES, QUERIES
from fieldwise.stages import drop_stages, shared_dir

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables not present")

# Queries without fitted logistic models: at this scale a group has some ten
# cases, fits lie on the boundary and have no value two engines would share.
EXACT = [
    "read_forms", "prefix_columns", "stage_round_trip", "decode_labels", "union_rounds", "sample_rows", "recode_case", "collapse_lump",
    "score_flags", "build_timestamp", "year_rules", "complete_cases", "filter_domain",
    "group_keys", "level_order", "unpivot_attempts", "success_attempt", "long_histories",
    "scenario_pivot", "unpivot_measures", "attempt_sequence", "progress_flags", "last_attempt",
    "attempts_at_cutoff", "first_last_period", "previous_period", "filter_groups", "crosstab1",
    "crosstab2", "crosstab3", "crosstab_wide", "distinct_groups", "weighted_moments",
    "strata_var_total", "covariate_cells", "design_matrix", "group_share", "ave_window",
    "weights_to_strata", "sample_design", "cohens_d", "effect_table", "category_merge",
    "anti_selected", "allowed_groups", "argmin_per_group", "distinct_union_minus",
    "explode_lists", "unseen_levels", "rank_split", "random_half", "alternating_pick",
    "counterfactual_response", "possible_savings", "equal_count_bins", "r_indicator_one_factor",
    "label_indicator", "r_indicator_linear", "aliased_indicator", "history_build", "form_covariates",
    "outcome_effects",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == pytest.approx(b, rel=1e-6, abs=2e-6)
    return a == b


@pytest.mark.parametrize("name", EXACT)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    rel = duck.execute(ORACLES[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()]
    assert len(got) == len(want)

    def key(t):
        return tuple((x is not None, str(x) if not isinstance(x, float) else "") for x in t), tuple(
            x for x in t if isinstance(x, float))

    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert all(close(x, y) for x, y in zip(a, b)), (a, b)


def test_registry():
    assert set(QUERIES) - set(ORACLES) == {"study_grid"}


def test_study_on_the_built_history(spark):
    """Rates of the grid against plain counts: all cases, and those reached by the early cutoff."""
    from fieldwise.catalog.forms import built
    from fieldwise.plans.survey_study import analysis_attempts

    grid = QUERIES["study_grid"](spark, DIR).toPandas()
    cases = analysis_attempts(built(spark, DIR)).select(
        "cntry_round", "idno", "interview").distinct().toPandas()
    rate = cases.groupby("cntry_round")["interview"].mean()
    full = grid[grid.response == "interview"]
    assert len(full) and set(grid.groupby("cntry_round").size()) == {20}
    for r in full.itertuples():
        assert r.response_rate == pytest.approx(rate[r.cntry_round])


def test_hot_cases_take_the_other_way(spark):
    """The history is the same when every case counts as hot."""
    from conftest import rows

    cols = ["case_id", "attempt", "time", "success", "interview"]
    hot = views.build_attempts(spark, DIR, hot_rows=5)
    assert rows(hot, *cols) == rows(views.attempts(spark, DIR), *cols)


def test_study_is_the_same_when_every_group_is_hot(spark):
    from conftest import rows
    from fieldwise.plans.scenarios import case_table, scenario_cases

    flags = ["case_id", "attempt_number", "rank_dem_sim1", "rank_full_sim2", "rand_selected",
             "rank_selected_dem", "rank_selected_full", "full_sim1_bottom50selected"]
    usual = rows(views.scenarios(spark, DIR), *flags)
    spark.conf.set("spark.fieldwise.hotRows", "10")
    try:
        cases = case_table(views.attempts(spark, DIR), views.STUDY).cache()
        fits = views.fits(spark, DIR)
        assert rows(scenario_cases(cases, views.STUDY, fits), *flags) == usual
    finally:
        spark.conf.unset("spark.fieldwise.hotRows")


def test_study_invariants(spark):
    s = views.scenarios(spark, DIR).cache()
    late = s.filter("NOT attempt_first70pct")
    assert late.filter("dem_sim1_top50 = dem_sim1_bottom50").isEmpty()
    assert s.filter("attempt_first70pct AND full_sim2_top50selected").isEmpty()
    assert s.filter("NOT interview AND (rank_resp_full OR rand_resp)").isEmpty()
    # Cases with a level no model has seen have no rank and stay outside the draft.
    drafted = late.filter("rank_full_sim1 IS NOT NULL AND rank_full_sim2 IS NOT NULL")
    total = {r[0]: r[1] for r in drafted.groupBy("cntry_round").count().collect()}
    for r in drafted.filter("rank_selected_full").groupBy("cntry_round").count().collect():
        assert r["count"] == max(1, total[r.cntry_round] // 2)
    assert late.filter("attempt_number_70pct > attempt").isEmpty()


def test_stages_live_in_the_shared_folder(spark):
    assert shared_dir(spark)
    assert callable(drop_stages)
