"""Where each attempt falls in the fieldwork of its group, and case-level rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CUTOFFS
from ..stages import stage
from .ordering import positions


def sequence_attempts(
    df: DataFrame, group: str, order: Sequence[str], hot_rows: int | None = None
) -> DataFrame:
    """attempt_number, n and attempt_pct = attempt_number / n inside each group."""
    size = {"n": F.count(F.lit(1))}
    numbered = positions(df, [group], order, "attempt_number", size, hot_rows)
    return numbered.withColumn("attempt_pct", F.col("attempt_number") / F.col("n"))


def pct(cutoff: float) -> str:
    return f"{round(cutoff * 100)}pct"


def fieldwork_progress(
    df: DataFrame, cutoffs: Sequence[float] = CUTOFFS,
    success: str = "success", attempt: str = "attempt",
) -> DataFrame:
    """Early-phase flags (strictly below the cutoff) and the status reached by then."""
    final = F.coalesce(F.col(success) <= F.col(attempt), F.lit(False))
    early = {c: F.col("attempt_pct") < F.lit(float(c)) for c in cutoffs}
    return df.select(
        "*",
        *[flag.alias(f"attempt_first{pct(c)}") for c, flag in early.items()],
        final.alias("status_final"),
        *[(flag & final).alias(f"status_{pct(c)}") for c, flag in early.items()],
    )


def _micros(df: DataFrame, time: str) -> Column:
    """Microseconds of a moment as a long (whole numbers as they are); the clock's own reading, without zones."""
    t, kind = F.col(time), df.schema[time].dataType.simpleString()
    if kind == "timestamp":
        return F.unix_micros(t)
    if kind in ("date", "timestamp_ntz"):
        days = F.unix_date(t.cast("date")).cast("bigint") * 86_400_000_000
        if kind == "date":
            return days
        second = (F.expr(f"extract(SECOND FROM `{time}`)") * 1_000_000).cast("bigint")
        return days + (F.hour(t) * 60 + F.minute(t)).cast("bigint") * 60_000_000 + second
    return t.cast("bigint")


def _latest(df: DataFrame, time: str, attempt: str, ties: str) -> Column:
    """One number per attempt whose maximum is the last attempt of a case.

    The moment and, below it, the attempt number: 32 bits more than a long, so a decimal, which
    is a fixed-width value and stays in hash aggregates.  NULL times and numbers come first.
    """
    tie = F.col(attempt) if ties == "last" else -F.col(attempt)
    moment = F.coalesce(_micros(df, time), F.lit(-(2**62))).cast("decimal(20,0)")
    low = F.coalesce(tie.cast("bigint"), F.lit(-(2**31))).cast("decimal(11,0)")
    return moment * F.lit(2**32).cast("decimal(10,0)") + low


def _reached(latest: str, early: str, attempt: str) -> Column:
    reached = F.max_by(F.when(F.col(early), F.col(attempt)), F.when(F.col(early), F.col(latest)))
    return F.coalesce(reached, F.lit(0)).cast("int").alias(cutoff_name(early))


def cutoff_name(early: str) -> str:
    return f"attempt_number_{early.removeprefix('attempt_first')}"


def last_attempt(
    df: DataFrame, key: Sequence[str], time: str = "time", attempt: str = "attempt",
    ties: str = "first", early: str | None = None,
) -> DataFrame:
    """One row per case: its last attempt.

    Among attempts at the same last moment the first recorded one is kept
    (``ties="first"``).  With ``early`` (a boolean column) the same pass also
    yields ``attempt_number_<cutoff>``: the attempt number the case had reached
    before the cutoff, 0 when it had not been contacted.

    Only key, time and attempt are aggregated, by hash and with map-side combine;
    the case's other columns are joined to the one row that is left.  Keys are not
    NULL, and attempts of a case are told apart by time and number (``sequence_attempts``
    gives such numbers); of rows that are equal in both one is kept.
    """
    key = list(key)
    latest = _latest(df, time, attempt, ties)
    extra = [_reached("_latest", early, attempt)] if early else []
    narrow = df.select(*key, latest.alias("_latest"), *dict.fromkeys([attempt, *([early] if early else [])]))
    winners = narrow.groupBy(*key).agg(F.max("_latest").alias("_latest"), *extra)
    rows = df.withColumn("_latest", latest).join(winners, [*key, "_latest"])
    others = [c for c in df.columns if c not in key]
    return rows.select(*key, *others, *([cutoff_name(early)] if early else []))


def attempts_at_cutoff(
    df: DataFrame, key: Sequence[str], early: str, time: str = "time", attempt: str = "attempt",
    ties: str = "first",
) -> DataFrame:
    """Per case: attempt number reached before the cutoff, 0 if none."""
    narrow = df.select(*key, _latest(df, time, attempt, ties).alias("_latest"), attempt, early)
    return narrow.groupBy(*key).agg(_reached("_latest", early, attempt))


def periods(df: DataFrame, entity: str, period: str) -> DataFrame:
    """Distinct (entity, period) rows with first, last and the previous period present.

    The window runs over distinct pairs only, never over attempt rows.
    """
    pairs = df.select(entity, period).distinct()
    by = Window.partitionBy(entity)
    return pairs.select(
        entity,
        period,
        (F.col(period) == F.min(period).over(by)).alias("is_first"),
        (F.col(period) == F.max(period).over(by)).alias("is_last"),
        F.lag(period).over(by.orderBy(period)).alias("previous"),
    )


def first_last_period(df: DataFrame, entity: str, period: str) -> DataFrame:
    """Rows of ``df`` with ``is_first`` and ``is_last`` flags of their period."""
    p = stage(periods(df, entity, period).drop("previous"), "periods")
    return df.join(p, [entity, period], "left")


def previous_available_period(df: DataFrame, entity: str, period: str) -> DataFrame:
    """(entity, period, previous): gaps between periods are skipped."""
    return periods(df, entity, period).select(entity, period, "previous")


def filter_groups_with(df: DataFrame, group: str, condition: Column) -> DataFrame:
    """Keep the groups in which at least one row meets ``condition``."""
    ok = stage(df.filter(condition).select(group).distinct(), "groups")
    return df.join(ok, group, "left_semi")
