"""Reading wide contact forms, decoding codes, stacking rounds, written stages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def read_contact_forms(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options
) -> DataFrame:
    """One round of wide contact forms (parquet, csv, orc, json) under a fixed schema."""
    return spark.read.schema(schema).format(fmt).options(**options).load(path)


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ("round",)) -> None:
    """Persist a stage of the work, one directory per round.

    Rows are dealt by round and then cut or joined by bytes (the advisory partition size), so a
    large round has many files, a small one a single file, and no task a whole large round.
    """
    df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_stage(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Driver-side dimension table.

    It goes in as Arrow, so Catalyst knows its bytes and broadcasts it only if they are few.
    """
    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    columns = list(zip(*rows)) if rows else [()] * len(kind)
    table = pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, kind)


def decode_labels(
    df: DataFrame, labels: DataFrame, cols: Sequence[str] | Mapping[str, str]
) -> DataFrame:
    """Replace codes by labels.  ``labels`` has columns var, code, label.

    ``cols`` are columns named like their variable, or column -> variable.  The code book
    becomes one row with a map per variable, which a scalar subquery hands to all columns: one
    pass over ``df`` however many there are, without a join or shuffle.  A code without a label
    gives NULL; of several labels of a code the smallest counts.
    """
    names = dict(cols) if isinstance(cols, Mapping) else {c: c for c in cols}
    kind = labels.schema["code"].dataType
    variables = sorted(set(names.values()))
    entries = (
        labels.filter(F.col("var").isin(variables) & F.col("code").isNotNull())
        .groupBy("var", "code").agg(F.min("label").alias("label"))
    )
    books = entries.agg(F.struct(*[
        F.map_from_entries(
            F.collect_list(F.when(F.col("var") == v, F.struct("code", "label")))
        ).alias(f"book{i}")
        for i, v in enumerate(variables)
    ])).scalar()

    def decoded(col: str, var: str) -> Column:
        own = df.schema[col].dataType
        key = F.col(col) if own == kind else F.col(col).try_cast(kind)
        label = F.try_element_at(books.getField(f"book{variables.index(var)}"), key)
        # 2.5 is no 2
        return label if own == kind else F.when(key.try_cast(own) == F.col(col), label)

    return df.withColumns({c: decoded(c, v) for c, v in names.items()})


def union_rounds(*dfs: DataFrame) -> DataFrame:
    """Stack rounds by column name; columns a round lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: str = "0") -> DataFrame:
    """``n`` rows picked by the hash of their key: the same rows on every layout."""
    tag = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(seed)))
    return df.orderBy(tag, *keys).limit(n)
