"""From wide contact forms of several rounds to one long attempt history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import AGE_BANDS, BASE_YEAR, FIELDWORK_YEAR_RULES, INTERVIEW_LABELS, UNUSED_PREFIXES
from ..functions.recode import (
    bin_numeric, build_timestamp, code_flag, collapse_levels, decode_map, drop_by_prefix,
    group_key, lump_rare_levels, recode, score_classes, score_flags,
)
from ..operators.history import (
    apply_fieldwork_year, attempts_long, group_widths, interview_flag, success_columns,
)
from ..sources.contacts import decode_labels, union_rounds

# Columns of the history, in order.
HISTORY = [
    "round", "idno", "cntry", "typesamp", "success", "n_success", "attempt", "time",
    "interview", "multi_unit", "neighb", "gndr_su", "age_cat", "telnum", "no_access",
    "round_x", "cntry_round",
]


def derive_covariates(wide: DataFrame, lump: bool = True) -> DataFrame:
    """Case-level variables of a contact form from its codes.

    ``physical_assessment`` needs the counts of the whole form; without ``lump`` it is left out
    and the step is narrow.
    """
    c = F.col
    df = wide
    if lump:
        df = lump_rare_levels(
            df.withColumn("physical_assessment", c("physa").cast("string")), "physical_assessment"
        )
    df = df.withColumns({
        "interview": code_flag("interva", 1),
        "interva789": code_flag("interva", [7, 8, 9]),
        "interview_na": F.coalesce(code_flag("interva", [7, 8, 9]), F.lit(False))
        | c("interva").isNull(),
        "typesamp2": collapse_levels("typesamp", {
            "Individual person": ["Individual person"],
            "Household or Address": ["Household", "Address"],
        }),
        "telephone_present": code_flag("telnum", 1),
        "gndr_su": decode_map("gndr_su", {1: "Male", 2: "Female"}),
        "age_cat": bin_numeric("age_su", AGE_BANDS),
        "age50": recode([
            (c("age_su") < 34, F.lit("Under 50")),
            ((c("age_su") >= 35) & (c("age_su") < 50), F.lit("Under 50")),
            ((c("age_su") >= 50) & (c("age_su") < 64), F.lit("50+")),
            (c("age_su") >= 65, F.lit("50+")),
        ]),
        "housetype": recode([
            (c("type") < 5, F.lit("Single unit")),
            (c("type").between(6, 8), F.lit("Multi-unit")),
            ((c("type") == 5) | c("type").between(9, 10), F.lit("Other")),
        ]),
        "single_unit": recode([
            (c("type") < 5, F.lit("Single unit")),
            (c("type").between(5, 10), F.lit("Other")),
        ]),
        "physa_3": collapse_levels(
            "physa", {"Good": [1, 2], "Satisfactory": [3], "Bad": [4, 5]}
        ),
        "no_access": recode([
            (c("access") == 4, F.lit("No barriers")), (c("access") != 4, F.lit("Barriers")),
        ]),
        "vandalism": code_flag("vandaa", 4, negate=True),
        "litter": code_flag("littera", 4, negate=True),
    })
    df = df.withColumns({
        "multi_unit": recode([
            (c("housetype") == "Multi-unit", F.lit("Multi-unit")),
            (c("housetype") != "Multi-unit", F.lit("Not multi-unit")),
        ]),
        "physa_2": c("physa_3") == "Bad",
        "interview_fct": F.when(c("interview"), "Interview").when(~c("interview"), "No interview"),
    })
    df = df.withColumn("neighb_assessment", score_flags(["physa_2", "vandalism", "litter"]))
    return df.withColumns({
        "neighb": score_classes(c("neighb_assessment"), ["None", "One or more"]),
        "neighb3": score_classes(c("neighb_assessment"), ["None", "One", "Two or more"]),
    })


def round_history(
    wide: DataFrame, round_no: int, base_year: int | None = None,
    rules: DataFrame | Sequence[tuple] = FIELDWORK_YEAR_RULES, labels: DataFrame | None = None,
) -> DataFrame:
    """Long history of one round of person samples.

    With ``base_year`` the attempt times come as month, day, hour and minute
    columns without a year; without it the form has ``dateca<i>`` timestamps.
    ``typesamp`` and ``resulb<i>`` hold labels, or codes that the code book ``labels`` decodes
    (var, code, label with the variables typesamp and resulb).
    """
    if labels is not None:
        repeated = {f"resulb{i}": "resulb" for i in group_widths(wide, "resulb")}
        wide = decode_labels(wide, labels, {"typesamp": "typesamp", **repeated})
    df = derive_covariates(wide, lump=False).filter(F.col("typesamp") == "Individual person")
    df = df.withColumn("round", F.lit(round_no))
    widths = group_widths(df, "monv" if base_year else "dateca")
    results = group_widths(df, "resulb")
    if base_year:
        times = {
            f"contact{i}": build_timestamp(
                F.lit(base_year), f"monv{i}", f"date{i}", f"hourv{i}", f"minv{i}"
            )
            for i in widths
        }
    else:
        times = {f"contact{i}": F.col(f"dateca{i}") for i in widths}
    done = {
        f"result{i}": interview_flag(F.col(f"resulb{i}"), INTERVIEW_LABELS) for i in results
    }
    df = drop_by_prefix(df.withColumns({**times, **done}), *UNUSED_PREFIXES)
    index, total = success_columns(df, "result")
    df = df.withColumns({"success": index, "n_success": total})
    long = attempts_long(df, {"contact": "time"})
    if base_year:
        own = (
            rules.filter(F.col(rules.columns[0]) == round_no) if isinstance(rules, DataFrame)
            else [r for r in rules if r[0] == round_no]
        )
        long = apply_fieldwork_year(long, own)
    return long


def build_history(
    rounds: Mapping[int, DataFrame], base_years=BASE_YEAR,
    rules: DataFrame | Sequence[tuple] = FIELDWORK_YEAR_RULES,
    labels: Mapping[int, DataFrame] | None = None,
) -> DataFrame:
    """Union of all rounds with the group key; one narrow plan, no shuffle.

    ``labels`` are the code books of rounds that come with codes in place of labels.
    """
    books = labels or {}
    parts = [
        round_history(w, r, base_years.get(r), rules, books.get(r)) for r, w in rounds.items()
    ]
    df = union_rounds(*parts)
    df = df.withColumns({
        "round_x": F.col("round").cast("string"),
        "cntry_round": group_key("cntry", "round"),
    })
    results = sorted(c for c in df.columns if c.startswith("result"))
    return df.select(*HISTORY, *results)
