"""Cross-tables, group summaries, effect sizes, calibration and scenario tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EFFECT_CLASSES, SAVED_LABELS, SCENARIO_ORDER, STARS
from ..specs import Levels
from ..stages import stage
from .ordering import running_sum


def crosstab(df: DataFrame, *cols: str) -> DataFrame:
    """Counts of every combination that occurs; one column also gives its share."""
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    if len(cols) > 1:
        return counts
    counts = stage(counts, "counts")
    # The total is the sum of the counts, so the rows are not read again.
    total = counts.select(F.sum("n").alias("_total")).first()[0]
    return counts.withColumn("percent", F.col("n") / F.lit(total))


def crosstab_wide(df: DataFrame, rows: Sequence[str], col: str, levels: Sequence[str]) -> DataFrame:
    wide = df.groupBy(*rows).pivot(col, list(levels)).agg(F.count(F.lit(1)))
    return wide.fillna(0, subset=[str(v) for v in levels])


def summarise_groups(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """n, sum, mean, sd, min and max of each column, NULLs skipped."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[
            a
            for c in cols
            for a in (
                F.sum(c).alias(f"sum_{c}"), F.avg(c).alias(f"mean_{c}"),
                F.stddev_samp(c).alias(f"sd_{c}"), F.min(c).alias(f"min_{c}"),
                F.max(c).alias(f"max_{c}"),
            )
        ],
    )


def distinct_groups(df: DataFrame, by: Sequence[str], counted: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count_distinct(counted).alias(f"n_{counted}"))


def magnitude(effect: Column) -> Column:
    out = None
    for bound, label in EFFECT_CLASSES:
        if bound is None:
            return out.otherwise(F.lit(label))
        hit = F.abs(effect) < bound
        out = F.when(effect.isNull(), None).when(hit, label) if out is None else out.when(hit, label)
    return out


def cohens_d(
    df: DataFrame, value: str, factor: str, by: Sequence[str], levels: Sequence[str]
) -> DataFrame:
    """Standardised mean difference of each pair of factor levels, unequal variances.

    (m1 - m2) / sqrt((v1 + v2) / 2); one aggregation over the rows, pairs are
    formed inside the one-row-per-group result.
    """
    v, f = F.col(value).cast("double"), F.col(factor).cast("string")

    def part(level: str) -> Column:
        x = F.when(f == level, v)
        return F.struct(
            F.lit(level).alias("level"), F.count(x).alias("n"), F.avg(x).alias("mean"),
            F.var_samp(x).alias("var"),
        )

    wide = df.groupBy(*by).agg(*[part(lv).alias(f"_l{i}") for i, lv in enumerate(levels)])
    pairs = F.explode(F.array(*[
        F.struct(F.col(f"_l{i}").alias("g1"), F.col(f"_l{j}").alias("g2"))
        for i in range(len(levels)) for j in range(i + 1, len(levels))
    ]))
    p = wide.select(*by, pairs.alias("_p")).select(*by, "_p.*")
    effect = F.try_divide(
        F.col("g1.mean") - F.col("g2.mean"), F.sqrt((F.col("g1.var") + F.col("g2.var")) / 2)
    )
    return p.filter((F.col("g1.n") > 0) & (F.col("g2.n") > 0)).select(
        *by,
        F.lit(value).alias("variable"),
        F.lit(factor).alias("factor"),
        F.col("g1.level").alias("group1"),
        F.col("g2.level").alias("group2"),
        effect.alias("effsize"),
        F.col("g1.n").alias("n1"),
        F.col("g2.n").alias("n2"),
        magnitude(effect).alias("magnitude"),
    )


def effect_table(
    df: DataFrame, values: Mapping[str, str], factors: Mapping[str, tuple[str, Sequence[str]]],
    by: Sequence[str],
) -> DataFrame:
    """Effect sizes of every value by every factor, stacked and labelled.

    All moments come from one aggregation.  A row is repeated once per factor,
    inside the map task; the values ride along as columns and become rows only
    when there is one row per group, factor and level.
    """
    each = F.explode(F.array(*[
        F.struct(F.lit(f).alias("factor"), F.lit(text).alias("text"),
                 F.col(f).cast("string").alias("level"))
        for f, (text, _) in factors.items()
    ]))
    sums = (
        df.select(*by, *[F.col(v).cast("double").alias(v) for v in values], each.alias("_f"))
        .select(*by, *values, "_f.*")
        .filter(F.col("level").isNotNull())
        .groupBy(*by, "factor", "text", "level")
        .agg(*[
            F.struct(F.lit(v).alias("variable"), F.lit(label).alias("y_lab"),
                     F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))
            .alias(f"_{v}")
            for v, label in values.items()
        ])
    )
    stats = F.explode(F.array(*[F.col(f"_{v}") for v in values]))
    key = [*by, "variable", "y_lab", "factor", "text"]
    moments = (
        sums.select(*by, "factor", "text", "level", stats.alias("_s"))
        .select(*by, "factor", "text", "level", "_s.*").filter(F.col("n") > 0)
    )

    def side(i: int) -> Column:
        first = F.create_map(*[
            x for f, (_, levels) in factors.items() for x in (F.lit(f), F.lit(levels[i]))
        ])
        return F.col("level") == F.element_at(first, F.col("factor"))

    sides = moments.groupBy(*key).agg(*[
        F.max(F.when(side(i), F.struct("n", "mean", "var", "level"))).alias(f"g{i + 1}")
        for i in range(2)
    ])
    effect = F.try_divide(
        F.col("g1.mean") - F.col("g2.mean"), F.sqrt((F.col("g1.var") + F.col("g2.var")) / 2)
    )
    return sides.filter(F.col("g1").isNotNull() & F.col("g2").isNotNull()).select(
        *by, "variable", "y_lab", "factor",
        F.concat(F.col("text"), F.lit(": "), F.col("g1.level"), F.lit(" - "), F.col("g2.level"))
        .alias("comp"),
        effect.alias("effsize"), F.col("g1.n").alias("n1"), F.col("g2.n").alias("n2"),
        magnitude(effect).alias("magnitude"),
    )


def quantile_breaks(
    df: DataFrame, by: Sequence[str], score: str, bins: int, hot_rows: int | None = None
) -> DataFrame:
    """Exact (linearly interpolated) bin edges per group, repeated edges merged.

    Counts per distinct score come first, so equal scores cost nothing; the
    running count then locates the ranks the edges need, whatever the group's size.
    """
    counts = stage(
        df.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_s"))
        .agg(F.count(F.lit(1)).alias("_c")),
        "score-counts",
    )
    upto = running_sum(counts, by, ["_s"], "_c", "_upto", "_m", hot_rows)
    # Rank h = (m - 1) i / bins, from 0; a score covers ranks [upto - c, upto - 1].  Edge i needs
    # it where from - 1 < h < upto, so a score is repeated only for the edges it helps to make.
    upto = upto.withColumn("_from", F.col("_upto") - F.col("_c"))
    first = F.expr(f"if(_from = 0, 0, (_from - 1) * {bins} div (_m - 1) + 1)")
    last = F.expr(f"if(_m = 1, {bins}, least({bins}, (_upto * {bins} - 1) div (_m - 1)))")
    edges = upto.select(
        *by, "_s", "_upto", "_from", "_m",
        F.explode(F.when(first <= last, F.sequence(first, last))).alias("_i"),
    )
    h = (F.col("_m") - 1) * F.col("_i") / F.lit(float(bins))
    low, high = F.floor(h), F.ceil(h)
    covers = [
        (r >= F.col("_from")) & (r < F.col("_upto")) for r in (low, high)
    ]
    values = edges.filter(covers[0] | covers[1]).groupBy(*by, "_i").agg(
        F.max(F.when(covers[0], F.col("_s"))).alias("_lo"),
        F.max(F.when(covers[1], F.col("_s"))).alias("_hi"),
        F.max(h - low).alias("_frac"),
    )
    edge = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")
    return values.groupBy(*by).agg(F.sort_array(F.collect_set(edge)).alias("breaks"))


def equal_count_bins(
    df: DataFrame, by: Sequence[str], score: str, bins: int = 20, out: str = "bin",
    hot_rows: int | None = None,
) -> DataFrame:
    """Bin number of each row: left-closed bins between the merged quantile edges.

    The last bin also contains the maximum; a NULL score has no bin.
    """
    breaks = stage(quantile_breaks(df, by, score, bins, hot_rows), "breaks")
    # Plain comparisons instead of an array filter: they stay in generated code.
    reached = F.lit(0)
    for i in range(bins + 1):
        at_least = F.get("breaks", F.lit(i)) <= F.col(score)
        reached = reached + F.coalesce(at_least, F.lit(False)).cast("int")
    last = F.greatest(F.size("breaks") - 1, F.lit(1))
    return (
        df.join(breaks, list(by), "left")
        .withColumn(out, F.when(F.col(score).isNotNull(), F.least(reached, last)))
        .drop("breaks")
    )


def calibration_table(
    df: DataFrame, by: Sequence[str], score: str, response: str, bins: int = 20
) -> DataFrame:
    """Observed response rate per bin of the predicted propensity."""
    binned = equal_count_bins(df, by, score, bins).filter(F.col("bin").isNotNull())
    return binned.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col(response).cast("double")).alias("rr"),
        F.min(score).alias("score_min"),
        F.max(score).alias("score_max"),
    )


def significance(p: Column) -> Column:
    out = None
    for bound, mark in STARS:
        hit = p <= bound
        out = F.when(hit, mark) if out is None else out.when(hit, mark)
    return out.otherwise(F.lit(" "))


def coefficient_report(terms: DataFrame, digits: int = 3, alpha: float = 0.05) -> DataFrame:
    """Rounded coefficients that are significant; rounding comes before the test."""
    cols = ["estimate", "std_error", "statistic", "p_value"]
    r = terms.withColumns({c: F.round(c, digits) for c in cols})
    return r.withColumn("signif", significance(F.col("p_value"))).filter(F.col("p_value") < alpha)


def scenario_means(grid: DataFrame, r_indicator: str, digits: int = 3) -> DataFrame:
    """Mean and sd over groups of CV and response rate per (response model, selection)."""
    return grid.filter(F.col("r_indicator") == r_indicator).groupBy(
        "response_model", "selected"
    ).agg(
        F.round(F.avg("cv"), digits).alias("mean_cv"),
        F.round(F.stddev_samp("cv"), digits).alias("sd_cv"),
        F.round(F.avg("response_rate"), digits).alias("mean_rr"),
        F.round(F.stddev_samp("response_rate"), digits).alias("sd_rr"),
    )


def scenario_by_group(
    grid: DataFrame, group: str, r_indicator: str, selections: Sequence[str] = SCENARIO_ORDER,
    digits: int = 3,
) -> DataFrame:
    """Rounded CV, its error and response rate per group, in the order of ``selections``."""
    order = Levels("selected", selections).sort_key()
    return grid.filter(F.col("r_indicator") == r_indicator).orderBy(
        group, order, "response_model"
    ).select(
        group, "selected", "response_model",
        *[F.round(c, digits).alias(c) for c in ("cv", "cv_se", "response_rate")],
    )


def scenario_diff(
    grid: DataFrame, group: str, first: str, second: str, value: str = "cv"
) -> DataFrame:
    """Per group and response model: value under ``second`` minus under ``first``."""
    a = F.avg(F.when(F.col("selected") == first, F.col(value)))
    b = F.avg(F.when(F.col("selected") == second, F.col(value)))
    return grid.groupBy(group, "response_model").agg(
        a.alias("first"), b.alias("second"), (b - a).alias("diff")
    ).filter(F.col("first").isNotNull() & F.col("second").isNotNull())


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("response_model").agg(
        F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("sd_diff")
    )


def scenario_wide(grid: DataFrame, selections: Mapping[str, str], value: str = "cv") -> DataFrame:
    """Mean and sd per selection side by side; ``selections`` maps suffix to selection."""
    def only(sel: str) -> Column:
        return F.when(F.col("selected") == sel, F.col(value))

    return grid.groupBy("response_model").agg(*[
        a
        for suffix, sel in selections.items()
        for a in (
            F.avg(only(sel)).alias(f"mean_{suffix}"),
            F.stddev_samp(only(sel)).alias(f"sd_{suffix}"),
        )
    ])


def saved_long(saved: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of attempts saved, one row per group and scenario, labelled."""
    names = [c for c in SAVED_LABELS if c in saved.columns]
    long = saved.unpivot(list(by), names, "sim", "prop")
    labels = F.create_map(*[
        x for n in names
        for x in (F.lit(n), F.array(*[F.lit(v) for v in SAVED_LABELS[n]]))
    ])
    found = F.element_at(labels, F.col("sim"))
    return long.withColumns({
        "model": F.get(found, F.lit(0)), "simulation": F.get(found, F.lit(1)),
    })
