"""Wide contact forms to long attempt histories and back."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import INTERVIEW_LABELS
from ..sources.contacts import literal_table


YEAR_RULE = "round int, entity string, month_lt int, years int"


def group_widths(df: DataFrame, prefix: str) -> list[int]:
    """Numbers i for which the form has a column ``prefix<i>``."""
    found = [re.fullmatch(re.escape(prefix) + r"(\d+)", c) for c in df.columns]
    return sorted(int(m.group(1)) for m in found if m)


def attempts_long(
    wide: DataFrame, groups: Mapping[str, str], time: str = "time"
) -> DataFrame:
    """One row per attempt from repeated column groups; attempts without a time drop out.

    ``groups`` maps a column prefix to the long column's name.  A narrow step:
    each wide row yields its own attempts, nothing is shuffled.
    """
    numbers = sorted({i for prefix in groups for i in group_widths(wide, prefix)})
    repeated = {f"{p}{i}" for p in groups for i in numbers}
    keep = [c for c in wide.columns if c not in repeated]

    def part(prefix: str, name: str, i: int) -> Column:
        source = f"{prefix}{i}"
        if source in wide.columns:
            return F.col(source).alias(name)
        known = next(c for c in wide.columns if c in repeated and c.startswith(prefix))
        return F.lit(None).cast(wide.schema[known].dataType).alias(name)

    attempts = F.array(*[
        F.struct(F.lit(i).alias("attempt"), *[part(p, n, i) for p, n in groups.items()])
        for i in numbers
    ])
    return (
        wide.select(*keep, F.explode(attempts).alias("_a"))
        .select(*keep, "_a.*")
        .filter(F.col(time).isNotNull())
    )


def interview_flag(label: Column, labels: Sequence[str] = tuple(INTERVIEW_LABELS)) -> Column:
    """Did the attempt end in an interview; an unknown outcome counts as no."""
    return F.coalesce(label.isin(list(labels)), F.lit(False))


def success_columns(wide: DataFrame, prefix: str, policy: str = "last") -> tuple[Column, Column]:
    """(attempt number of the interview, number of interviews) of a wide row.

    With several interviews the later attempt takes precedence (``last``).
    """
    numbers = group_widths(wide, prefix)
    ordered = numbers if policy == "first" else numbers[::-1]
    index = F.coalesce(*[F.when(F.col(f"{prefix}{i}"), F.lit(i)) for i in ordered])
    total = F.lit(0)
    for i in numbers:
        total = total + F.coalesce(F.col(f"{prefix}{i}"), F.lit(False)).cast("int")
    return index, total


def success_attempt(
    long: DataFrame, key: Sequence[str], done: str = "done", attempt: str = "attempt",
    policy: str = "last",
) -> DataFrame:
    """Per case: attempt number of the interview (NULL if none) and how many there were."""
    aggs = success_aggregates(done, attempt, policy)
    return long.groupBy(*key).agg(*[a.alias(n) for n, a in aggs.items()])


def success_aggregates(
    done: str = "done", attempt: str = "attempt", policy: str = "last"
) -> dict[str, Column]:
    """The two aggregates of ``success_attempt``, for use with other case totals."""
    pick = F.max if policy == "last" else F.min
    return {
        "success": pick(F.when(F.col(done), F.col(attempt))),
        "n_success": F.count_if(F.col(done)),
    }


def attempts_wide(
    long: DataFrame, key: Sequence[str], values: Mapping[str, str], width: int,
    attempt: str = "attempt",
) -> DataFrame:
    """First ``width`` attempts as repeated column groups, one row per case.

    Attempts are folded into one map per case (number to values), so the aggregates do not grow
    with the longest case, and a case holds ``width`` entries at most.  Where a case has a
    number more than once, the largest value of each column counts.
    """
    number = F.when(F.col(attempt).between(1, width), F.col(attempt)).alias("_i")
    fields = [f"_v{j}" for j in range(len(values))]
    numbered = long.groupBy(*key, number).agg(*[
        F.max(c).alias(f) for f, c in zip(fields, values.values())
    ])
    entry = F.when(F.col("_i").isNotNull(), F.struct("_i", F.struct(*fields)))
    folded = numbered.groupBy(*key).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    kind = long.schema[attempt].dataType
    return folded.select(*key, *[
        F.try_element_at("_m", F.lit(i).cast(kind))[f].alias(f"{prefix}{i}")
        for f, prefix in zip(fields, values) for i in range(1, width + 1)
    ])


def apply_fieldwork_year(
    df: DataFrame, rules: DataFrame | Sequence[tuple], time: str = "time",
    round_col: str = "round", entity: str = "cntry",
) -> DataFrame:
    """Move attempt dates to the year the fieldwork really took place.

    ``rules`` rows are (round, entity, month_lt or None, years), one per pair, as a DataFrame
    or as tuples; they are joined by their size.
    29 February moves to 28 February when the target year has no such day.
    """
    if not isinstance(rules, DataFrame):
        rules = literal_table(df.sparkSession, rules, YEAR_RULE)
    table = rules.toDF("_round", "_entity", "_month_lt", "_years")
    moved = F.when(
        F.col("_years").isNotNull()
        & (F.col("_month_lt").isNull() | (F.month(time) < F.col("_month_lt"))),
        F.col(time) + F.make_ym_interval(F.col("_years"), F.lit(0)),
    ).otherwise(F.col(time))
    match = (df[round_col] == table["_round"]) & (df[entity] == table["_entity"])
    return (
        df.join(table, match, "left").withColumn(time, moved)
        .drop("_round", "_entity", "_month_lt", "_years")
    )


def pivot_scenarios(
    df: DataFrame, keys: Sequence[str], names_from: str, values_from: str,
    names: Sequence[str],
) -> DataFrame:
    """One column per scenario; the scenario list is given, so no extra job reads it."""
    return df.groupBy(*keys).pivot(names_from, list(names)).agg(F.first(values_from))


def unpivot_measures(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str
) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)
