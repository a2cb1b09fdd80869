from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import rows
from fieldwise.operators import progress as P

T0 = datetime(2020, 1, 1)


def attempts(spark):
    data = [
        # group, case, attempt, day, success
        ("A", 1, 1, 0, 2), ("A", 1, 2, 3, 2), ("A", 2, 1, 0, None), ("A", 2, 2, 9, None),
        ("A", 2, 3, 9, None), ("A", 3, 1, 1, 1), ("A", 4, 1, 8, 1), ("A", 5, 1, 5, None),
        ("A", 5, 2, 6, None), ("A", 6, 1, 9, None), ("B", 1, 1, 4, 1),
    ]
    return spark.createDataFrame(
        [(g, c, a, T0 + timedelta(days=d), s) for g, c, a, d, s in data],
        "g string, case_id int, attempt int, time timestamp_ntz, success int",
    )


def test_sequence_and_flags(spark):
    s = P.sequence_attempts(attempts(spark), "g", ["time", "case_id", "attempt"])
    f = P.fieldwork_progress(s)
    a = f.filter("g = 'A'").orderBy("attempt_number").collect()
    assert [r.attempt_number for r in a] == list(range(1, 11))
    assert [(r.case_id, r.attempt) for r in a][:3] == [(1, 1), (2, 1), (3, 1)]
    # Strictly below the cutoff: the seventh of ten is not early.
    assert [r.attempt_first70pct for r in a] == [True] * 6 + [False] * 4
    assert f.filter("g = 'B'").first().attempt_first50pct is False
    third = next(r for r in a if r.case_id == 3)
    assert third.status_final and third.status_50pct
    first = next(r for r in a if r.case_id == 1 and r.attempt == 1)
    assert not first.status_final


def test_last_attempt_and_cutoff(spark):
    s = P.sequence_attempts(attempts(spark), "g", ["time", "case_id", "attempt"])
    f = P.fieldwork_progress(s)
    got = P.last_attempt(f, ["g", "case_id"], early="attempt_first70pct")
    last = {(r.g, r.case_id): (r.attempt, r.attempt_number_70pct) for r in got.collect()}
    assert last == {("A", 1): (2, 2), ("A", 2): (2, 1), ("A", 3): (1, 1), ("A", 4): (1, 0),
                    ("A", 5): (2, 2), ("A", 6): (1, 0), ("B", 1): (1, 0)}
    ties = P.last_attempt(f, ["g", "case_id"], ties="last")
    assert ties.filter("g = 'A' AND case_id = 2").first().attempt == 3
    reached = P.attempts_at_cutoff(f, ["g", "case_id"], "attempt_first70pct")
    assert rows(reached) == rows(got, "g", "case_id", "attempt_number_70pct")


def test_previous_period_skips_gaps(spark):
    df = spark.createDataFrame(
        [("CH", 6), ("CH", 7), ("CH", 9), ("CH", 10), ("EE", 6), ("EE", 7), ("EE", 10), ("CH", 9)],
        "c string, r int",
    )
    assert rows(P.previous_available_period(df, "c", "r")) == [
        ("CH", 6, None), ("CH", 7, 6), ("CH", 9, 7), ("CH", 10, 9),
        ("EE", 6, None), ("EE", 7, 6), ("EE", 10, 7)]
    flags = P.first_last_period(df, "c", "r")
    assert rows(flags.filter("is_first").distinct(), "c", "r") == [("CH", 6), ("EE", 6)]
    assert rows(flags.filter("is_last").distinct(), "c", "r") == [("CH", 10), ("EE", 10)]


def test_filter_groups(spark):
    kept = P.filter_groups_with(attempts(spark), "g", F.col("attempt") >= 3)
    assert {r.g for r in kept.collect()} == {"A"}
