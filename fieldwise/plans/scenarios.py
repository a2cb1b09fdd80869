"""Targeting scenarios over a case table, the indicator grid and its summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CUTOFFS, DEMOGRAPHICS, DEMOGRAPHICS_OBS
from ..operators.cells import covariate_cells, rollup_cells
from ..operators.indicators import overall_indicators, summarise_indicator
from ..operators.progress import (
    fieldwork_progress, last_attempt, pct, previous_available_period, sequence_attempts,
)
from ..operators.propensity import fit_models, previous_fits, score_column
from ..operators.targeting import (
    alternating_picks, bottom_half, counterfactual_response, rank_random_ties, selected_flag,
    top_half,
)
from ..specs import ModelSpec
from ..stages import stage


@dataclass(frozen=True)
class Scenario:
    """What a targeting study needs to know about its tables."""

    dem: ModelSpec
    full: ModelSpec
    group: str = "cntry_round"
    entity: str = "cntry"
    period: str = "round"
    case: str = "case_id"
    response: str = "interview"
    cutoff: float = 0.7
    seed: str = "fieldwork"

    @property
    def early(self) -> str:
        return f"attempt_first{pct(self.cutoff)}"

    @property
    def group_cols(self) -> list[str]:
        return [self.group, self.entity, self.period]


def case_table(attempts: DataFrame, s: Scenario, cutoffs=CUTOFFS) -> DataFrame:
    """Sequence, cut into phases and reduce to the last attempt of each case."""
    order = ["time", s.case, "attempt"]
    progress = fieldwork_progress(sequence_attempts(attempts, s.group, order), cutoffs)
    # The case number leads the key: the aggregation sorts on it, and a number
    # compares faster than the group's name.
    return last_attempt(progress, [s.case, s.group], early=s.early)


# Model name -> which phase it is fitted on, and which period's model scores a case.
def model_specs(s: Scenario) -> dict[str, tuple[ModelSpec, bool]]:
    return {
        "dem_sim1": (s.dem, True),
        "full_sim1": (s.full, True),
        "dem_sim2": (s.dem.with_numeric("attempt"), False),
        "full_sim2": (s.full.with_numeric("attempt"), False),
    }


def propensity_fits(cases: DataFrame, s: Scenario) -> dict[str, DataFrame]:
    """The four model families, all from one pass over the cases."""
    by = [s.entity, s.period, s.group]
    cells = covariate_cells(cases, [*by, s.early], [*s.full.factors, "attempt"], [s.response])
    models = {
        name: (
            rollup_cells(
                cells.filter(F.col(s.early) if early else ~F.col(s.early)),
                [*by, *spec.covariates],
            ),
            spec,
        )
        for name, (spec, early) in model_specs(s).items()
    }
    fits = fit_models(models, by)
    return {name: fits.filter(F.col("model") == name) for name in models}


def late_scores(cases: DataFrame, fits: dict[str, DataFrame], s: Scenario) -> DataFrame:
    """Late cases with four scores: own early model, previous period's late model.

    All models of a group sit in one row, so the cases are joined once.  Groups
    of an entity's first period have no previous model and drop out.
    """
    keys = [s.entity, s.period]
    table = stage(previous_available_period(cases, s.entity, s.period), "periods")
    models = None
    for name, fit in fits.items():
        keyed = fit.select(*keys, F.col("effects").alias(f"_m_{name}"))
        if name.endswith("sim2"):
            keyed = previous_fits(keyed, table, s.entity, s.period)
        models = keyed if models is None else models.join(keyed, keys, "full")
    models = stage(
        models.filter(F.col("_m_full_sim2").isNotNull()), "models"
    )
    late = cases.filter(~F.col(s.early))
    scored = late.join(models, keys, "inner")
    return scored.select(
        *s.group_cols, s.case,
        *[
            score_column(spec, F.col(f"_m_{name}")).alias(f"score_{name}")
            for name, (spec, _) in model_specs(s).items()
        ],
    )


def targeting_flags(scores: DataFrame, s: Scenario) -> DataFrame:
    """Rank, halve and draft the late cases; one row per late case."""
    rankings = {
        name: (F.col(f"score_{name}"), f"{s.seed}-{name}") for name in model_specs(s)
    }
    rankings["rand"] = (None, f"{s.seed}-rand")
    rankings["rand2"] = (None, f"{s.seed}-rand2")
    keys = [*s.group_cols, s.case]
    ranks = stage(rank_random_ties(scores, s.group_cols, s.case, rankings), "ranks")
    # Both drafts in one table: most likely late responders first against
    # least likely early responders first.
    lists = F.explode(F.array(*[
        F.struct(
            F.lit(m).alias("draft"),
            (F.col(f"ranked_{m}_sim2") + 1 - F.col(f"rank_{m}_sim2")).alias("a"),
            F.col(f"rank_{m}_sim1").alias("b"),
        )
        for m in ("dem", "full")
    ]))
    drafts = (
        ranks.select(*keys, lists.alias("_d")).select(*keys, "_d.*")
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    )
    picked = alternating_picks(drafts, ["draft", *s.group_cols], "a", "b")
    picked = picked.groupBy(*keys).agg(*[
        F.bool_or(F.when(F.col("draft") == m, F.col("picked"))).alias(f"rank_selected_{m}")
        for m in ("dem", "full")
    ])

    def half(rule, name):
        return rule(F.col(f"rank_{name}"), F.col(f"ranked_{name}"))

    flags = ranks.select(
        *keys,
        *[f"rank_{n}" for n in model_specs(s)],
        *[half(top_half, n).alias(f"{n}_top50") for n in model_specs(s)],
        *[half(bottom_half, n).alias(f"{n}_bottom50") for n in model_specs(s)],
        half(bottom_half, "rand").alias("rand_selected"),
        half(bottom_half, "rand2").alias("rand2_selected"),
    )
    return flags.join(picked, keys, "left").join(scores, keys, "left")


def scenario_cases(
    cases: DataFrame, s: Scenario, fits: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Cases of evaluated groups with every selection flag and resulting response.

    ``cases`` is read several times: pass a written table.
    """
    fits = fits or propensity_fits(cases, s)
    scores = stage(late_scores(cases, fits, s), "late-scores")
    flags = targeting_flags(scores, s)
    evaluated = stage(
        scores.filter(F.col("score_full_sim2").isNotNull()).select(*s.group_cols).distinct(),
        "evaluated",
    )
    keys = [*s.group_cols, s.case]
    df = cases.join(evaluated, s.group_cols, "left_semi").join(flags, keys, "left")
    response, early = F.col(s.response), F.col(s.early)
    pursued = ["rand_selected", "rand2_selected", "rank_selected_dem", "rank_selected_full"]
    halves = [f"{n}_{h}" for n in model_specs(s) for h in ("top50", "bottom50")]
    resp = {
        # Computed before the missing flags are filled below.
        **{
            f"{n}_resp_{h}": counterfactual_response(response, F.col(f"{n}_{h}"))
            for n in model_specs(s) for h in ("top50", "bottom50")
        },
        "rand_resp": counterfactual_response(response, F.col("rand_selected")),
        "rand2_resp": counterfactual_response(response, F.col("rand2_selected")),
        "rank_resp_dem": counterfactual_response(response, F.col("rank_selected_dem")),
        "rank_resp_full": counterfactual_response(response, F.col("rank_selected_full")),
    }
    df = df.withColumns({
        **resp,
        **{
            f"{h}selected": F.coalesce(selected_flag(early, F.col(h)), F.lit(False))
            for h in halves
        },
    })
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in pursued})


# Selection flags whose savings are reported.
SAVED_FLAGS = {
    "dem_bottom": "dem_sim1_bottom50selected",
    "dem_top": "dem_sim2_top50selected",
    "full_bottom": "full_sim1_bottom50selected",
    "full_top": "full_sim2_top50selected",
    "rank_dem": "rank_selected_dem",
    "rank_full": "rank_selected_full",
    "rand": "rand_selected",
    "rand2": "rand2_selected",
}

# response column -> (response model, selection)
GRID_RESPONSES = {
    "dem_sim1_resp_bottom50": (DEMOGRAPHICS, "Sim1 Bottom"),
    "dem_sim2_resp_top50": (DEMOGRAPHICS, "Sim2 Top"),
    "full_sim1_resp_bottom50": (DEMOGRAPHICS_OBS, "Sim1 Bottom"),
    "full_sim2_resp_top50": (DEMOGRAPHICS_OBS, "Sim2 Top"),
    "rank_resp_dem": (DEMOGRAPHICS, "Sim3 Rank"),
    "rank_resp_full": (DEMOGRAPHICS_OBS, "Sim3 Rank"),
    "rand_resp": (DEMOGRAPHICS, "Sim4 Random"),
    "rand2_resp": (DEMOGRAPHICS_OBS, "Sim4 Random"),
    "status_70pct": ("Early fieldwork", "Early fieldwork"),
    "interview": ("Full dataset", "Full dataset"),
}


def grid_cells(scenarios: DataFrame, s: Scenario, responses: Sequence[str]) -> DataFrame:
    """Cells of every grid response, one pass over the scenario cases."""
    cases = scenarios.withColumn("stratum", F.lit(1))
    return covariate_cells(
        cases, s.group_cols, s.full.factors, responses, stratum="stratum"
    )


def indicator_grid(scenarios: DataFrame, s: Scenario, responses=GRID_RESPONSES) -> DataFrame:
    """CV and response rate for every (response, indicator model) and group.

    The coarse model's cells are rolled up from the fine ones, so the cases are
    read once for all twenty combinations.
    """
    fine = grid_cells(scenarios, s, list(responses))
    by = [*s.group_cols, "response"]
    coarse = rollup_cells(fine, [*by, *s.dem.factors, "stratum"])
    overall = overall_indicators({"Dem": (coarse, s.dem), "Full": (fine, s.full)}, by)
    grid = summarise_indicator(
        overall.withColumnRenamed("model", "r_indicator"), [*by, "r_indicator"]
    )
    labels = F.create_map(*[
        x for r, (m, sel) in responses.items()
        for x in (F.lit(r), F.struct(F.lit(m).alias("m"), F.lit(sel).alias("s")))
    ])
    found = F.element_at(labels, F.col("response"))
    return grid.withColumns({
        "response_model": found.getField("m"), "selected": found.getField("s"),
    })
