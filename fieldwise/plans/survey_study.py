"""The targeting study on real contact histories: population, models, all results."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (
    ACCESS, AGE_CATEGORY, COUNTRIES, COUNTRY_NAMES, EXCLUDED_GROUPS, GENDER, MULTI_UNIT,
    NEIGHBOURHOOD, OUTCOME_FACTORS, OUTCOME_LABELS,
)
from ..functions.recode import complete_cases, decode_map, filter_domain, group_key
from ..operators.progress import previous_available_period
from ..operators.propensity import fit_terms, model_fit_stats, unseen_levels
from ..operators.summaries import (
    calibration_table, coefficient_report, diff_summary, effect_table, saved_long,
    scenario_by_group, scenario_diff, scenario_means, scenario_wide,
)
from ..operators.targeting import attempts_saved, selection_scatter, selection_thresholds
from ..sources.contacts import union_rounds
from ..specs import Levels, ModelSpec
from ..stages import stage, stage_scope
from .scenarios import (
    SAVED_FLAGS, Scenario, case_table, indicator_grid, model_specs, propensity_fits,
    scenario_cases,
)

GENDER_AGE = (Levels("gndr_su", GENDER), Levels("age_cat", AGE_CATEGORY))
OBSERVED = (
    Levels("multi_unit", MULTI_UNIT), Levels("neighb", NEIGHBOURHOOD), Levels("no_access", ACCESS),
)
SURVEY = Scenario(
    dem=ModelSpec(GENDER_AGE),
    full=ModelSpec(OBSERVED + GENDER_AGE, (("multi_unit", "neighb"),)),
    case="idno",
)


def analysis_attempts(history: DataFrame, s: Scenario = SURVEY) -> DataFrame:
    """Attempts of the target population with every model variable known."""
    df = filter_domain(history, {s.entity: COUNTRIES}, {s.group: EXCLUDED_GROUPS})
    df = complete_cases(df, [s.response, *s.full.factors, "time"])
    name = decode_map(s.entity, COUNTRY_NAMES)
    return df.withColumn("cntry_round_full", group_key(name, s.period))


#: Suffix of the side-by-side columns -> selection.
SELECTIONS = {
    "bottom": "Sim1 Bottom", "top": "Sim2 Top", "rank": "Sim3 Rank", "random": "Sim4 Random",
}


def levels_without_model(cases: DataFrame, s: Scenario) -> DataFrame:
    """(training, entity, period, variable, level) of late cases that a model has not seen.

    ``training`` is ``own`` (the period's early cases) or ``previous`` (late cases of the entity's
    previous period).  Such cases have a NULL score and leave the rankings.
    """
    keys = [s.entity, s.period]
    late = cases.filter(~F.col(s.early))
    before = stage(
        previous_available_period(cases, *keys).filter(F.col("previous").isNotNull()), "periods"
    )
    shifted = before.select(s.entity, F.col(s.period).alias("_now"), F.col("previous").alias(s.period))
    trained = late.join(shifted, keys).drop(s.period).withColumnRenamed("_now", s.period)
    own = unseen_levels(late, cases.filter(F.col(s.early)), s.full, keys)
    previous = unseen_levels(late.join(before, keys, "left_semi"), trained, s.full, keys)
    return union_rounds(
        own.withColumn("training", F.lit("own")), previous.withColumn("training", F.lit("previous"))
    )


@dataclass
class StudyResults:
    cases: DataFrame
    scenarios: DataFrame
    grid: DataFrame
    saved: DataFrame
    saved_long: DataFrame
    thresholds: DataFrame
    fit_statistics: DataFrame
    coefficients: DataFrame
    calibration: dict[str, DataFrame]
    unseen_levels: DataFrame
    by_group: DataFrame  # CV and response rate of the full indicator in every group
    means: dict[str, DataFrame]  # by indicator model; the next three too
    differences: dict[str, DataFrame]  # per group: top half minus bottom half
    difference_summary: dict[str, DataFrame]
    wide: dict[str, DataFrame]
    wide_rates: DataFrame
    scatter: dict[str, DataFrame]  # by covariate set: dem, full


def run_study(history: DataFrame, s: Scenario = SURVEY) -> StudyResults:
    """Everything from a contact history; the large steps are written once each."""
    # Numbering reads its input more than once, so the history is computed and written first.
    attempts = stage(analysis_attempts(history, s), "attempts")
    cases = stage(case_table(attempts, s), "cases")
    fits = propensity_fits(cases, s)
    scenarios = stage(scenario_cases(cases, s, fits), "scenarios")
    saved = attempts_saved(scenarios, [s.group], SAVED_FLAGS)
    labelled = {f"Model {i + 1}": name for i, name in enumerate(fits)}
    stats = union_rounds(*[
        model_fit_stats(fits[name], [s.group]).withColumn("model", F.lit(label))
        for label, name in labelled.items()
    ])
    terms = union_rounds(*[
        fit_terms(fits[name], model_specs(s)[name][0], [s.group]).withColumn("model", F.lit(label))
        for label, name in labelled.items()
    ])
    late = scenarios.filter(~F.col(s.early))
    grid = stage(indicator_grid(scenarios, s), "grid")
    of_model = {m: grid.filter(F.col("r_indicator") == m) for m in ("Dem", "Full")}
    differences = {
        m: scenario_diff(g, s.group, SELECTIONS["bottom"], SELECTIONS["top"])
        for m, g in of_model.items()
    }
    return StudyResults(
        cases=cases,
        scenarios=scenarios,
        grid=grid,
        saved=saved,
        saved_long=saved_long(saved, [s.group]),
        thresholds=selection_thresholds(
            late, [s.group], "score_full_sim2", "full_sim2_top50selected",
            "score_full_sim1", "full_sim1_bottom50selected",
        ),
        fit_statistics=stats,
        coefficients=coefficient_report(terms),
        calibration={
            name: calibration_table(scenarios, [s.group], f"score_{name}", s.response)
            for name in fits
        },
        unseen_levels=levels_without_model(cases, s),
        by_group=scenario_by_group(grid, s.group, "Full"),
        means={m: scenario_means(grid, m) for m in of_model},
        differences=differences,
        difference_summary={m: diff_summary(t) for m, t in differences.items()},
        wide={m: scenario_wide(g, SELECTIONS) for m, g in of_model.items()},
        wide_rates=scenario_wide(grid, SELECTIONS, "response_rate"),
        scatter={
            m: selection_scatter(
                late, [s.group], [s.case], f"score_{m}_sim1", f"score_{m}_sim2",
                {"sim3": f"rank_selected_{m}", "sim4": "rand_selected"},
                f"{m}_sim2_top50selected", f"{m}_sim1_bottom50selected",
            )
            for m in ("dem", "full")
        },
    )


def write_study(history: DataFrame, path: str, s: Scenario = SURVEY) -> list[str]:
    """Run the study and write each result as a table under ``path``; returns their names.

    The study's stages are deleted at the end: what is left are the results.
    """
    names = []
    with stage_scope(history.sparkSession):
        out = run_study(history, s)
        for field in fields(out):
            value = getattr(out, field.name)
            parts = value if isinstance(value, dict) else {"": value}
            for key, table in parts.items():
                names.append("-".join(x for x in (field.name, key) if x))
                table.write.mode("overwrite").parquet(f"{path}/{names[-1]}")
    return names


def outcome_effects(
    respondents: DataFrame, included: DataFrame, by: str = "cntry",
    analysed: str = "Interviewer observations and Demographics",
) -> DataFrame:
    """Effect sizes of survey outcomes by interviewer observation.

    ``respondents`` are survey answers joined with case covariates; ``included``
    holds the evaluated groups (``cntry_round``).
    """
    groups = stage(included.select("cntry_round").distinct(), "included")
    df = respondents.join(groups, "cntry_round", "left_semi")
    df = filter_domain(
        df, {"cntry": [*COUNTRIES, "NL"], "analysed": [analysed]}, {"cntry_round": EXCLUDED_GROUPS}
    ).filter(F.col("round") > 5)
    return effect_table(df, OUTCOME_LABELS, OUTCOME_FACTORS, [by])
