"""Exact dedup by two passes over a Bloom filter.

Pass 1 sets PROBES slots of a filter for every row's digest and keeps the slots that are set
at least twice.  Pass 2 looks all rows up: a row with a slot that nobody else set has no copy
and goes straight through; only the rest ("possibly repeated") are shuffled and grouped.
A Bloom filter never says no wrongly, so no copy is missed; a wrong yes costs one shuffled row.

Texts never travel: a row is its digest, its length and a number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stages import stage
from .common import collected_bits, has_bit, text_or_empty

#: Characters that do not count.
BLANK = " \t\n\x0b\x0c\r"
#: Slots of the filter per row (rounded up to a power of two): 2 % of single rows are shuffled.
SLOTS_PER_ROW, PROBES = 16, 2
#: Bounds of the filter: 8 kB to 128 MB.  Beyond 67 million rows it fills up and lets more single
#: rows into the shuffle; results do not change.
SLOTS = (1 << 16, 1 << 30)
#: Groups with more than this share of all rows are at most 10,000, so they are broadcast.
HOT_SHARE = 1e-4


def normalised(text: str = "text") -> Column:
    return F.translate(text_or_empty(text), BLANK, "")


def slots_for(rows: int) -> int:
    low, high = SLOTS
    return min(max(low, 1 << (max(rows, 1) * SLOTS_PER_ROW - 1).bit_length()), high)


def _slot(digest: Column, probe: int, slots: int) -> Column:
    return F.xxhash64(digest, F.lit(probe)).bitwiseAND(slots - 1)


def filter_of_repeated(digests: DataFrame, slots: int) -> np.ndarray:
    """Bits of the slots that at least two rows of ``digests`` (digest) set.

    Slots are counted before they are shuffled; at most slots / 64 rows reach the driver.
    """
    drawn = digests.select(F.explode(F.array(*(_slot(F.col("digest"), p, slots) for p in range(PROBES)))).alias("slot"))
    twice = drawn.groupBy("slot").count().filter("count > 1")
    return collected_bits(twice, slots)


def possibly_repeated(digest: Column, spark, bits: np.ndarray) -> Column:
    """Whether all slots of a digest are in the filter."""
    sent = spark.sparkContext.broadcast(bits)

    def look_up(*probes: pa.Array) -> pa.Array:
        return pa.array(np.logical_and.reduce([has_bit(sent.value, probe.to_numpy()) for probe in probes]))

    return F.arrow_udf(look_up, "boolean")(*(_slot(digest, p, 64 * len(bits)) for p in range(PROBES)))


def groups_of(rows: DataFrame) -> DataFrame:
    """(g_digest, group_size, keep_id, keep_row) of every digest of several rows.

    Longest text first, then smallest doc_id (NULL last); of rows equal in both any one.  Two
    steps of plain counters, so a group of any size is reduced before each shuffle.
    """
    by_length = rows.groupBy("digest", "length").agg(
        F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first_id"),
        F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("first_row"),
    )
    return by_length.groupBy(F.col("digest").alias("g_digest")).agg(
        F.sum("size").alias("group_size"), F.max_by("first_id", "length").alias("keep_id"),
        F.max_by("first_row", "length").alias("keep_row"),
    ).filter("group_size > 1")


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text): doc_id, keep_id, group_size, kept, text_sha256, row.

    Texts are equal when they are so without BLANK; NULL and empty texts are equal.  Of equal
    texts the row with the most code points stays, then the smallest doc_id (NULL comes last, a
    group of such rows has keep_id NULL); of rows equal in all this exactly one is kept.  ``row``
    numbers the rows.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = stage(docs.select(
        "doc_id", F.unhex(F.sha2(normalised(), 256)).alias("digest"),
        F.length(text_or_empty()).alias("length"), F.monotonically_increasing_id().alias("row"),
    ), "digests")
    total = rows.count()
    bits = filter_of_repeated(rows, slots_for(total))
    looked_up = rows.withColumn("again", possibly_repeated(F.col("digest"), spark, bits))
    again = stage(looked_up.filter("again").drop("again"), "possibly-repeated")
    found = stage(groups_of(again), "groups")

    limit = max(total * HOT_SHARE, 1.0)
    hot = F.broadcast(found.filter(F.col("group_size") > limit))  # at most 1 / HOT_SHARE rows
    in_hot = again.join(hot, F.col("digest") == F.col("g_digest"))
    others = again.join(hot.select("g_digest"), F.col("digest") == F.col("g_digest"), "left_anti")
    few = found.filter(F.col("group_size") <= limit)
    others = others.join(few, F.col("digest") == F.col("g_digest"), "left")
    alone = looked_up.filter(~F.col("again")).drop("again").withColumns({
        "group_size": F.lit(None).cast("long"), "keep_id": F.lit(None).cast("long"),
        "keep_row": F.lit(None).cast("long"),
    })
    parts = alone.unionByName(in_hot.drop("g_digest")).unionByName(others.drop("g_digest"))
    single = F.col("group_size").isNull()
    return parts.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "row",
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """The digest columns of groups(): doc_id, keep_id, group_size, kept, text_sha256."""
    return groups(docs).drop("row")
