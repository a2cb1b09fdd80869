"""Exact positions and running sums inside groups of any size.

A window function puts a whole group into one task.  That is the best plan for
ordinary groups and a dead end for a group that holds a third of the table, so
groups above ``hot_rows`` take another way: one range sort spreads the group
over many partitions, each partition numbers its own stretch, and the offsets
of the stretches come from a table with one row per (group, partition).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stages import stage

# Rows a group may have and still be ordered inside one task, unless the
# session sets spark.fieldwise.hotRows.
HOT_ROWS = 2_000_000
HOT_SAMPLE = 10_000


def hot_limit(df: DataFrame, hot_rows: int | None) -> int:
    if hot_rows is not None:
        return hot_rows
    return int(df.sparkSession.conf.get("spark.fieldwise.hotRows", str(HOT_ROWS)))


def _cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def split_hot(
    df: DataFrame, by: Sequence[str], hot_rows: int, keys: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary groups, and rows of groups above ``hot_rows`` (None if there are none).

    Sizes are judged on a sample in which a hot group still has some ten
    thousand rows, so that a table of very many small groups is not shuffled
    just to find out that they are small.  The judgement only chooses the way a
    group is ordered: both ways are exact and every row takes one of them.
    The written table of hot groups has at most about rows / hot_rows rows.
    ``keys`` is a cheaper frame holding the same group columns row for row.
    """
    source = (df if keys is None else keys).select(*by)
    share = min(1.0, HOT_SAMPLE / hot_rows)
    if share < 1:
        source = source.sample(share, seed=7)
    sizes = source.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    hot = stage(sizes.filter(F.col("_size") > hot_rows * share), "hot-groups")
    if hot.isEmpty():
        return df, None
    same = _same(df, hot, by)
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def _stretches(df: DataFrame, by: Sequence[str], order: Sequence[Column], keep: list[str]):
    """Globally sorted, written once: ``_id`` is (partition << 33) + row in partition."""
    ordered = df.orderBy(*by, *order).select(*keep, F.monotonically_increasing_id().alias("_id"))
    return stage(ordered, "sorted").withColumn("_part", F.shiftright("_id", 33))


def _attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join a staged table on keys that may be NULL."""
    o = small.withColumnsRenamed({k: f"_o_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(o[f"_o_{k}"]) for k in keys])
    return df.join(o, same, "left").drop(*[f"_o_{k}" for k in keys])


def positions(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    out: str = "position",
    totals: Mapping[str, Column] | None = None,
    hot_rows: int | None = None,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in its group, and group aggregates.

    ``order`` must be a total order inside a group.  ``totals`` maps names to
    aggregates over the numbered rows (they may use ``out``); they ride on the
    same partitioning, without another shuffle or join, except in hot groups.
    Group sizes are counted first, on the group columns of ``df`` alone: pass a
    staged ``df``, or a cheap ``keys`` frame with the same groups, when ``df``
    is expensive.
    """
    by, order, keep, totals = list(by), _cols(order), df.columns, totals or {}
    cold, hot = split_hot(df, by, hot_limit(df, hot_rows), keys)
    group = Window.partitionBy(*by)
    place = F.row_number().over(group.orderBy(*order)).cast("bigint")
    numbered = cold.select(*keep, place.alias(out))
    numbered = numbered.select("*", *[a.over(group).alias(n) for n, a in totals.items()])
    if hot is None:
        return numbered
    rows = _stretches(hot, by, order, keep)
    runs = rows.groupBy(*by, "_part").agg(
        F.min("_id").alias("_start"), F.count(F.lit(1)).alias("_len")
    )
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        *by,
        "_part",
        (F.coalesce(F.sum("_len").over(before), F.lit(0)) - F.col("_start")).alias("_shift"),
    )
    placed = _attach(rows, stage(offsets, "offsets"), [*by, "_part"])
    placed = placed.select(*keep, (F.col("_id") + F.col("_shift") + 1).alias(out))
    if totals:
        sums = stage(placed.groupBy(*by).agg(*[a.alias(n) for n, a in totals.items()]), "totals")
        placed = _attach(placed, sums, by)
    return numbered.unionByName(placed)


def running_sum(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    value: str,
    out: str = "running",
    total: str | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add the inclusive running sum of ``value`` inside each group."""
    by, order, keep = list(by), _cols(order), df.columns
    cold, hot = split_hot(df, by, hot_limit(df, hot_rows))
    group = Window.partitionBy(*by)
    upto = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    extra = [F.sum(value).over(upto).alias(out)]
    if total:
        extra.append(F.sum(value).over(group).alias(total))
    summed = cold.select(*keep, *extra)
    if hot is None:
        return summed
    rows = _stretches(hot, by, order, keep)
    runs = rows.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        *by,
        "_part",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"),
        F.sum("_sum").over(group).alias("_total"),
    )
    placed = _attach(rows, stage(offsets, "offsets"), [*by, "_part"])
    local = (
        Window.partitionBy(*by, "_part")
        .orderBy("_id")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    extra = [(F.sum(value).over(local) + F.col("_shift")).alias(out)]
    if total:
        extra.append(F.col("_total").alias(total))
    return summed.unionByName(placed.select(*keep, *extra))
