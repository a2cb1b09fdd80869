"""Column-level recoding.  NULL in, NULL out unless a rule says otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_sum
from ..stages import stage


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recode(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """First rule whose condition holds; NULL when none does."""
    (first_cond, first_value), *rest = rules
    out = F.when(first_cond, first_value)
    for cond, value in rest:
        out = out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)


def bin_numeric(col: str | Column, bands: Sequence[tuple]) -> Column:
    """Inclusive (low, high, label) bands, the first that holds wins; None is open."""
    c = _col(col)

    def inside(low, high):
        tests = ([c >= low] if low is not None else []) + ([c <= high] if high is not None else [])
        return reduce(lambda a, b: a & b, tests)

    return recode([(inside(low, high), F.lit(label)) for low, high, label in bands])


def code_flag(col: str | Column, codes, negate: bool = False) -> Column:
    """Boolean: is the code one of ``codes`` (NULL stays NULL)."""
    codes = list(codes) if isinstance(codes, (list, tuple, set)) else [codes]
    hit = _col(col).isin(codes)
    return ~hit if negate else hit


def collapse_levels(col: str | Column, groups: Mapping[str, Sequence]) -> Column:
    """Merge levels: ``{new: [old, ...]}``; unlisted levels become NULL."""
    c = _col(col)
    return recode([(c.isin(list(old)), F.lit(new)) for new, old in groups.items()])


def decode_map(col: str | Column, labels: Mapping, keep_unmatched: bool = False) -> Column:
    """Code to label by a short literal dictionary; unlisted codes give NULL or stay."""
    c = _col(col)
    found = recode([(c == code, F.lit(label)) for code, label in labels.items()])
    return F.coalesce(found, c.cast("string")) if keep_unmatched else found


def score_flags(cols: Sequence[str | Column]) -> Column:
    """Sum of booleans; NULL when any of them is NULL."""
    return reduce(lambda a, b: a + b, [_col(c).cast("int") for c in cols])


def score_classes(score: Column, classes: Sequence[str]) -> Column:
    """0 -> first class, 1 -> second, ...; the last class takes everything above."""
    last = len(classes) - 1
    rules = [(score == i, F.lit(classes[i])) for i in range(last)]
    return recode([*rules, (score >= last, F.lit(classes[last]))])


def group_key(*parts: str | Column, sep: str = "-") -> Column:
    """Joined key; NULL when any part is NULL."""
    cols = [_col(p).cast("string") for p in parts]
    whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    return F.when(whole, F.concat_ws(sep, *cols))


def split_group_key(col: str | Column, names: Sequence[str], sep: str = "-") -> list[Column]:
    parts = F.split(_col(col), sep, len(names))
    return [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]


def parse_attempt_no(col: str | Column) -> Column:
    """First number in a column name such as ``contact12``."""
    digits = F.regexp_extract(_col(col), "([0-9]+)", 1)
    return F.nullif(digits, F.lit("")).cast("int")


def build_timestamp(year, month, day, hour, minute) -> Column:
    """Timestamp without zone; impossible dates and NULL parts give NULL.

    Minutes recorded with a fraction are rounded to the even neighbour first.
    """
    y, mo, d, h, mi = (_col(c) for c in (year, month, day, hour, minute))
    return F.try_make_timestamp_ntz(
        y.cast("int"), mo.cast("int"), d.cast("int"), h.cast("int"),
        F.bround(mi.cast("double"), 0).cast("int"), F.lit(0).cast("decimal(16,6)"),
    )


def format_percent(ratio: str | Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(100 * _col(ratio), digits), F.lit("%"))


def parse_percent(text: str | Column) -> Column:
    return F.regexp_replace(_col(text), "[%,]", "").cast("double") / 100


def round_cols(df: DataFrame, cols: Sequence[str], digits: int, half_even: bool = False) -> DataFrame:
    f = F.bround if half_even else F.round
    return df.withColumns({c: f(F.col(c), digits) for c in cols})


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(cols))


def filter_domain(
    df: DataFrame,
    include: Mapping[str, Sequence] | None = None,
    exclude: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """Keep listed values and drop listed values, column by column (short lists)."""
    for col, values in (include or {}).items():
        df = df.filter(F.col(col).isin(list(values)))
    for col, values in (exclude or {}).items():
        df = df.filter(~F.col(col).isin(list(values)))
    return df


def select_by_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def drop_by_prefix(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.drop(*select_by_prefix(df, *prefixes))


def rename_by_pattern(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnsRenamed({c: c.replace(old, new, 1) for c in df.columns if old in c})


def lump_rare_levels(
    df: DataFrame, col: str, out: str | None = None, other: str = "Other"
) -> DataFrame:
    """Merge the rarest levels while the merged level stays the smallest.

    Levels sorted from frequent to rare are kept up to and including the first
    whose count exceeds the total of all levels after it.
    """
    out = out or col
    counts = stage(
        df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_level"))
        .agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0)),
        "level-counts",
    )
    ranked = running_sum(
        counts, ["_all"], [F.desc("_n"), "_level"], "_n", out="_upto", total="_total"
    )
    # The first level that outweighs everything rarer ends the kept part.
    cut = (
        ranked.filter(F.col("_n") > F.col("_total") - F.col("_upto"))
        .groupBy("_all").agg(F.min("_upto").alias("_cut"))
    )
    kept = stage(
        ranked.join(cut, "_all").filter(F.col("_upto") <= F.col("_cut"))
        .select("_level", F.lit(True).alias("_kept")),
        "kept-levels",
    )
    return (
        df.join(kept, df[col] == kept["_level"], "left")
        .withColumn(
            out,
            F.when(F.col(col).isNull(), None)
            .when(F.col("_kept"), F.col(col))
            .otherwise(F.lit(other)),
        )
        .drop("_level", "_kept")
    )
