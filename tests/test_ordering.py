import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from fieldwise.operators.ordering import positions, running_sum


@pytest.fixture(scope="module")
def frame(spark):
    r = random.Random(1)
    data = [(g, r.randrange(20), i, r.randrange(5)) for i, g in enumerate(
        ["hot"] * 400 + ["warm"] * 120 + ["cold"] * 7 + [None] * 150)]
    r.shuffle(data)
    return spark.createDataFrame(data, "g string, t int, id int, v int")


@pytest.mark.parametrize("hot_rows", [10_000, 100, 5])
def test_positions(frame, hot_rows):
    w = Window.partitionBy("g")
    expect = frame.select(
        "*", F.row_number().over(w.orderBy("t", "id")).cast("long").alias("p"),
        F.count(F.lit(1)).over(w).alias("n"),
    )
    got = positions(frame, ["g"], ["t", "id"], "p", {"n": F.count(F.lit(1))}, hot_rows)
    assert rows(got, "g", "id", "p", "n") == rows(expect, "g", "id", "p", "n")


def test_descending(frame):
    got = positions(frame, ["g"], [F.desc("t"), "id"], "p", hot_rows=100)
    w = Window.partitionBy("g").orderBy(F.desc("t"), "id")
    expect = frame.select("g", "id", F.row_number().over(w).cast("long"))
    assert rows(got, "g", "id", "p") == rows(expect)


@pytest.mark.parametrize("hot_rows", [10_000, 50])
def test_running_sum(frame, hot_rows):
    w = Window.partitionBy("g")
    expect = frame.select(
        "g", "id",
        F.sum("v").over(w.orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)),
        F.sum("v").over(w),
    )
    got = running_sum(frame, ["g"], ["t", "id"], "v", "r", "s", hot_rows)
    assert rows(got, "g", "id", "r", "s") == rows(expect)


@pytest.mark.parametrize("partitions", [1, 16])
def test_layout_does_not_matter(spark, frame, partitions):
    base = rows(positions(frame, ["g"], ["t", "id"], "p", hot_rows=100))
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        again = rows(positions(frame.repartition(7), ["g"], ["t", "id"], "p", hot_rows=100))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again == base
