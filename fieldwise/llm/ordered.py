"""Rows dealt out by ranges of doc_id, in order, with a look at the row that follows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: doc_ids that are looked at to choose the ranges, per range; they set balance, not results.
LOOKED_AT = 50


def range_bounds(docs: DataFrame, ranges: int) -> list[int]:
    """Upper bounds of ``ranges`` - 1 ranges of doc_id, about equally full."""
    ids = docs.select("doc_id").filter("doc_id is not null")
    seen = ids.agg(F.percentile_approx(
        "doc_id", [i / ranges for i in range(1, ranges)], LOOKED_AT * ranges).alias("q")).first()
    return sorted(set(seen.q or [])) if ranges > 1 else []


def range_numbers(bounds: list[int], ids: pa.Array) -> pa.Array:
    """Number of the range of each doc_id; NULL ids are in range 0."""
    lowest = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    return pa.array(np.searchsorted(np.array(bounds, np.int64), lowest, "left"), pa.int32())


def range_of(bounds: list[int], doc_id: str = "doc_id") -> Column:
    """range_numbers of a column."""

    def find(ids: pa.Array) -> pa.Array:
        return range_numbers(bounds, ids)

    return F.arrow_udf(find, "int")(F.col(doc_id).cast("bigint"))


def ranges_for(docs: DataFrame) -> int:
    """Two ranges per shuffle partition."""
    return 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt_in_order(docs: DataFrame) -> DataFrame:
    """(bucket, doc_id, text, guest): sorted by doc_id in each bucket, then the next bucket's first row.

    The guest of the last bucket is the first row of all.  Each partition holds whole buckets,
    one after the other; a bucket has about rows / ranges rows.
    """
    bucket = range_of(range_bounds(docs, ranges_for(docs)))
    firsts = docs.groupBy(bucket.alias("bucket")).agg(F.min(F.struct("doc_id")).alias("first"))
    found = sorted((r.bucket, r["first"].doc_id) for r in firsts.collect())  # a row per range
    rows = docs.select(bucket.alias("bucket"), "doc_id", "text", F.lit(False).alias("guest"))
    copies = []
    for i, (b, doc_id) in enumerate(found):
        copies.append((found[i - 1][0], b, doc_id))
    schema = "at int, of int, first_id long"
    to = docs.sparkSession.createDataFrame(copies, schema)
    guests = rows.join(
        F.broadcast(to), (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    ).select(F.col("at").alias("bucket"), "doc_id", "text", F.lit(True).alias("guest"))
    both = rows.unionByName(guests)
    dealt = both.repartition(ranges_for(docs) // 2, "bucket")
    return dealt.sortWithinPartitions("bucket", "guest", "doc_id", "text")
