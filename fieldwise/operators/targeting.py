"""Choosing which late cases to keep, and the response that choice would give."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stages import stage
from .ordering import positions

DRAFT_WINDOW = 1_000_000


def split_early_late(cases: DataFrame, early: str) -> tuple[DataFrame, DataFrame]:
    return cases.filter(F.col(early)), cases.filter(~F.col(early))


def tie_break(id_col: str, seed: str) -> Column:
    """60-bit number from the md5 of key and seed: a random order that is the
    same on every layout and in every engine that has md5."""
    text = F.concat(F.col(id_col).cast("string"), F.lit("|"), F.lit(seed))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def rank_random_ties(
    df: DataFrame, group: Sequence[str], id_col: str,
    rankings: Mapping[str, tuple[Column | None, str]], hot_rows: int | None = None,
) -> DataFrame:
    """Rank rows by several scores at once, ties in random order.

    ``rankings`` maps a name to (score, seed); a score of None is a purely
    random ranking.  Rows with a NULL score get no rank.  Every ranking becomes
    a set of narrow rows (name, group, id, score, tie); one numbering pass
    serves them all and one aggregation by case lines the ranks up again, so
    the number of shuffles does not grow with the number of rankings.

    Returns group, id, then rank_<name> and ranked_<name> (how many were ranked).
    """
    each = F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("_ranking"),
            (F.lit(0.0) if s is None else s.cast("double")).alias("_score"),
            tie_break(id_col, seed).alias("_tie"),
        )
        for name, (s, seed) in rankings.items()
    ]))
    narrow = stage(
        df.select(*group, id_col, each.alias("_r")).select(*group, id_col, "_r.*")
        .filter(F.col("_score").isNotNull()),
        "scores",
    )
    ranked = positions(
        narrow, ["_ranking", *group], ["_score", "_tie", id_col], "_rank",
        {"_m": F.count(F.lit(1))}, hot_rows,
    )
    return ranked.groupBy(*group, id_col).agg(*[
        F.max(F.when(F.col("_ranking") == name, F.col(c))).alias(f"{label}_{name}")
        for name in rankings
        for c, label in (("_rank", "rank"), ("_m", "ranked"))
    ])


def bottom_half(rank: Column, ranked: Column) -> Column:
    """At or below the median rank: ceil(m / 2) cases."""
    return 2 * rank <= ranked + 1


def top_half(rank: Column, ranked: Column) -> Column:
    """Above the median rank: floor(m / 2) cases."""
    return 2 * rank > ranked + 1


def split_at_median(
    df: DataFrame, group: Sequence[str], id_col: str, score: Column | None, seed: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """rank, ranked, top and bottom flags for one score."""
    r = rank_random_ties(df, group, id_col, {"score": (score, seed)}, hot_rows)
    rank, ranked = F.col("rank_score"), F.col("ranked_score")
    return r.select(
        *group, id_col, rank.alias("rank"), ranked.alias("ranked"),
        top_half(rank, ranked).alias("top"), bottom_half(rank, ranked).alias("bottom"),
    )


def selected_flag(early: Column, flag: Column) -> Column:
    """Kept as a late case; an early case is never selected."""
    return ~early & flag


def counterfactual_response(response: Column, flag: Column) -> Column:
    """Response had only flagged cases been pursued; cases outside the choice keep theirs."""
    return response & F.coalesce(flag, F.lit(True))


# --- the alternating draft -----------------------------------------------------
#
# A picks at 1, 2, 4, 6, ... and B at 3, 5, 7, ... (start "aa"), or A at odd and
# B at even picks (start "ab").


def _picks_of_a(picks: int, start: str) -> int:
    """How many of the first ``picks`` picks are list A's."""
    if start == "aa":
        return picks if picks < 2 else 1 + picks // 2
    return (picks + 1) // 2


def _pick_number(a_list: bool, nth: int, start: str) -> int:
    """Overall number of a list's nth pick."""
    if start == "aa":
        return (1 if nth == 1 else 2 * (nth - 1)) if a_list else 2 * nth + 1
    return 2 * nth - 1 if a_list else 2 * nth


def _race(a: list[int], b: list[int], len_a: int, len_b: int, taken: int, want: int, start: str):
    """Play the draft forward over the rows both lists may reach.

    Row i stands at place a[i] of list A and b[i] of list B, counted over the
    rows not yet picked; all other rows belong to one list only and just take
    up a place.  A list reaches a place after as many picks as the place less
    the rows before it that the other list took, so only the shared rows need
    to be looked at, earliest arrival first.  The run ends when ``want`` picks
    are made or a list has to go beyond its ``len_a`` or ``len_b`` places.

    Returns picks made, the place each list stands at, and which list ran out.
    """
    places, ends = (a, b), (len_a + 1, len_b + 1)
    order = tuple(sorted(range(len(p)), key=p.__getitem__) for p in places)
    owner = [-1] * len(a)
    a_before = _picks_of_a(taken, start)
    before = (a_before, taken - a_before)
    at, lost = [0, 0], [0, 0]
    while True:
        arrival = []
        for side in (0, 1):
            queue = order[side]
            while at[side] < len(queue) and owner[queue[at[side]]] == 1 - side:
                lost[side] += 1
                at[side] += 1
            here = places[side][queue[at[side]]] if at[side] < len(queue) else ends[side]
            arrival.append(_pick_number(side == 0, before[side] + here - lost[side], start))
        side = 0 if arrival[0] < arrival[1] else 1
        spent = at[side] == len(order[side])
        if arrival[side] > want or spent:
            break
        owner[order[side][at[side]]] = side
        at[side] += 1
    picks = min(want, arrival[side] - 1)
    ran_out = side if spent and picks < want else -1
    made_a = _picks_of_a(picks, start) - before[0]
    made = (made_a, picks - taken - made_a)
    stands = []
    for side in (0, 1):
        place = made[side]
        if place:
            for i in order[side]:
                if owner[i] == 1 - side:
                    if places[side][i] > place:
                        break
                    place += 1
        stands.append(place)
    return picks, stands, ran_out


def _small_draft(pdf: pd.DataFrame, start: str) -> pd.DataFrame:
    """Both thresholds of a group whose relevant rows fit in one task."""
    ranks = [sorted(pdf[c]) for c in ("rank_a", "rank_b")]
    places = [pdf[c].rank().astype(int).tolist() for c in ("rank_a", "rank_b")]
    _, stands, _ = _race(*places, len(pdf), len(pdf), 0, int(pdf["_want"].iloc[0]), start)
    limits = [int(r[k - 1]) if k else 0 for r, k in zip(ranks, stands)]
    return pd.DataFrame([(pdf["_gid"].iloc[0], *limits)], columns=["_gid", "_alpha", "_beta"])


def _leap(pdf: pd.DataFrame, start: str) -> pd.DataFrame:
    """One leap of a large group's draft over its contested rows."""
    r, shared = pdf.iloc[0], pdf[pdf["_pa"].notna()]
    picks, places, ran_out = _race(
        shared["_pa"].astype(int).tolist(), shared["_pb"].astype(int).tolist(),
        int(r["_la"]), int(r["_lb"]), int(r["_taken"]), int(r["_want"]), start,
    )
    names = ["_gid", "_picks", "_place_a", "_place_b", "_out"]
    return pd.DataFrame([(r["_gid"], picks, *places, ran_out)], columns=names).astype("int64")


def alternating_picks(
    df: DataFrame, by: Sequence[str], rank_a: str, rank_b: str, start: str = "aa",
    window: int = DRAFT_WINDOW, out: str = "picked",
) -> DataFrame:
    """Greedy draft: two rankings take turns, each taking its best case not yet taken.

    ``max(1, floor(m / 2))`` of a group's m cases are picked; with ``start="aa"``
    list A takes the first two picks, then B, A, B, ...  Ranks are distinct
    positive whole numbers within a group and list.

    Whatever list A has taken or passed over is exactly a prefix of its ranking,
    and likewise for B, so a group's picks are {rank_a <= alpha or rank_b <= beta}
    and only the two numbers have to be found.  No pick lies further down a list
    than the number of picks (plus gaps in the ranks), which bounds the rows a
    group needs.  Groups beyond ``window`` go through ``_large_drafts``.
    """
    by = list(by)
    ranked = stage(df, "ranked")
    a, b = F.col(rank_a).cast("bigint"), F.col(rank_b).cast("bigint")
    m = F.count(F.lit(1))
    want = F.greatest(F.lit(1), F.floor(m / 2)).cast("bigint")
    gaps = F.greatest(F.max(a), F.max(b)) - m
    # A number stands for the group from here on: it is all a task needs to carry.
    groups = stage(
        ranked.groupBy(*by).agg(want.alias("_want"), (want + gaps).alias("_reach"))
        .withColumn("_gid", F.monotonically_increasing_id()),
        "draft-groups",
    )
    narrow = ranked.join(groups, by).select(
        "_gid", "_want", "_reach", a.alias("rank_a"), b.alias("rank_b")
    )
    near = narrow.filter(
        (F.col("_reach") <= window) & (F.least("rank_a", "rank_b") <= F.col("_reach"))
    )
    limits = near.drop("_reach").groupBy("_gid").applyInPandas(
        lambda pdf: _small_draft(pdf, start), "_gid bigint, _alpha bigint, _beta bigint"
    )
    large = groups.filter(F.col("_reach") > window)
    if not large.isEmpty():
        rest = stage(
            narrow.filter(F.col("_reach") > window).select("_gid", "rank_a", "rank_b"), "draft-rows"
        )
        limits = limits.unionByName(
            _large_drafts(rest, large.select("_gid", "_want"), start, window)
        )
    limits = stage(limits.join(groups, "_gid").select(*by, "_alpha", "_beta"), "draft-limits")
    chosen = (a <= F.col("_alpha")) | (b <= F.col("_beta"))
    return ranked.join(limits, by, "left").withColumn(out, chosen).drop("_alpha", "_beta")


def _large_drafts(rows: DataFrame, groups: DataFrame, start: str, limit: int) -> DataFrame:
    """Thresholds of groups too large for one task, by leaps of bounded detail.

    From (alpha, beta) a leap looks at the next ``_width`` ranks of both lists.
    Rows in one list's window only need to be counted, which is done by a
    distributed numbering; rows in both windows are the only ones that can be
    contested, and the width is chosen so that at most ``limit`` of them exist.
    For unrelated rankings of m cases the width is near sqrt(limit * m), so the
    number of leaps stays small however large the group.
    """
    zero, nothing = F.lit(0).cast("bigint"), F.lit(None).cast("double")
    state = stage(
        groups.select("_gid", "_want", *[zero.alias(c) for c in ("_taken", "_alpha", "_beta")]),
        "draft",
    )
    ahead = {
        "_da": F.col("rank_a") - F.col("_alpha"), "_db": F.col("rank_b") - F.col("_beta"),
    }
    done = []
    while True:
        # Rows that become contested at width 2^e, for each e: 64 rows per group at most.
        live = rows.join(state, "_gid").withColumns(ahead).filter("_da > 0 AND _db > 0")
        far = F.greatest("_da", "_db")
        bits = F.when(far == 1, 0).otherwise(F.length(F.bin(far - 1)))
        contested = live.groupBy("_gid", bits.alias("_e")).agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy("_gid").orderBy("_e"))
        widths = (
            contested.withColumn("_upto", upto).filter(F.col("_upto") > limit)
            .groupBy("_gid").agg(F.min("_e").cast("int").alias("_e"))
        )
        width = F.expr("shiftleft(1L, coalesce(_e - 1, 62))")
        state = stage(
            state.join(widths, "_gid", "left").withColumn("_width", width).drop("_e"), "draft"
        )
        live = rows.join(state, "_gid").withColumns(ahead).filter("_da > 0 AND _db > 0")
        inside = {}
        for x in ("a", "b"):
            seen = live.filter(F.col(f"_d{x}") <= F.col("_width")).select(
                "_gid", "rank_a", "rank_b", (F.greatest("_da", "_db") <= F.col("_width")).alias("_both")
            )
            inside[x] = stage(positions(seen, ["_gid"], [f"rank_{x}"], f"_p{x}"), "draft-window")
        facts = state
        for x in ("a", "b"):
            length = inside[x].groupBy("_gid").agg(F.count(F.lit(1)).alias(f"_l{x}"))
            facts = facts.join(length, "_gid", "left")
        facts = stage(facts.fillna(0, ["_la", "_lb"]), "draft")
        shared = inside["a"].filter("_both").select("_gid", "rank_a", "_pa").join(
            inside["b"].filter("_both").select("_gid", "rank_a", "_pb"), ["_gid", "rank_a"]
        )
        # One blank row per group: a group without contested rows leaps as well.
        played = shared.select("_gid", F.col("_pa").cast("double"), F.col("_pb").cast("double"))
        played = played.unionByName(
            facts.select("_gid", nothing.alias("_pa"), nothing.alias("_pb"))
        )
        result = stage(
            played.join(facts, "_gid").groupBy("_gid").applyInPandas(
                lambda pdf: _leap(pdf, start),
                "_gid bigint, _picks bigint, _place_a bigint, _place_b bigint, _out bigint",
            ),
            "draft",
        )
        moved = facts.join(result, "_gid")
        for side, (x, limit_col) in enumerate((("a", "_alpha"), ("b", "_beta"))):
            found = inside[x].join(result, "_gid").filter(F.col(f"_p{x}") == F.col(f"_place_{x}"))
            moved = moved.join(
                found.select("_gid", F.col(f"rank_{x}").alias(f"_at_{x}")), "_gid", "left"
            ).withColumn(
                limit_col,
                F.when(F.col("_out") == side, F.col(limit_col) + F.col("_width"))
                .otherwise(F.coalesce(F.col(f"_at_{x}"), F.col(limit_col))),
            )
        state = stage(
            moved.select("_gid", "_want", F.col("_picks").alias("_taken"), "_alpha", "_beta"), "draft"
        )
        done.append(state.filter(F.col("_taken") >= F.col("_want")))
        state = state.filter(F.col("_taken") < F.col("_want"))
        if state.isEmpty():
            return reduce(DataFrame.unionByName, done).select("_gid", "_alpha", "_beta")


def possible_savings(cases: DataFrame, attempt: str = "attempt",
                     reached: str = "attempt_number_70pct") -> DataFrame:
    """Attempts a case received after the cutoff."""
    return cases.withColumn("poss", F.col(attempt) - F.col(reached))


def attempts_saved(
    cases: DataFrame, by: Sequence[str], flags: Mapping[str, str],
    attempt: str = "attempt", reached: str = "attempt_number_70pct",
) -> DataFrame:
    """Attempts made, attempts after the cutoff, and those saved by each selection.

    ``flags`` maps an output name to a selection flag; a case not selected saves
    all its attempts after the cutoff.  One aggregation whatever the number of flags.
    """
    poss = F.col(attempt) - F.col(reached)
    total = F.sum(F.col(attempt))
    return cases.groupBy(*by).agg(
        total.cast("bigint").alias("attempts"),
        F.sum(poss).cast("bigint").alias("poss"),
        F.try_divide(F.sum(poss), total).alias("prop_poss"),
        *[
            c
            for name, flag in flags.items()
            for c in (
                F.coalesce(F.sum(F.when(~F.col(flag), poss)), F.lit(0)).cast("bigint")
                .alias(f"saved_{name}"),
                F.try_divide(
                    F.coalesce(F.sum(F.when(~F.col(flag), poss)), F.lit(0)), total
                ).alias(f"prop_{name}"),
            )
        ],
    )


def selection_thresholds(
    df: DataFrame, by: Sequence[str], top_score: str, top_flag: str, bottom_score: str,
    bottom_flag: str,
) -> DataFrame:
    """Lowest score among the selected top, highest among the selected bottom."""
    return df.groupBy(*by).agg(
        F.min(F.when(F.col(top_flag), F.col(top_score))).alias("min_top"),
        F.max(F.when(F.col(bottom_flag), F.col(bottom_score))).alias("max_bottom"),
    )


def selection_scatter(
    late: DataFrame, by: Sequence[str], keep: Sequence[str], early_score: str, late_score: str,
    flags: Mapping[str, str], top_flag: str, bottom_flag: str,
) -> DataFrame:
    """Both scores of every late case, its selections in words and its group's thresholds.

    ``flags`` maps an output column to the boolean column it spells out.
    """
    limits = stage(
        selection_thresholds(late, by, late_score, top_flag, early_score, bottom_flag), "thresholds"
    )
    words = [
        F.when(F.col(c), "Selected").otherwise("Not selected").alias(name)
        for name, c in flags.items()
    ]
    return late.join(limits, list(by)).select(
        *by, *keep, F.col(early_score).alias("early_score"), F.col(late_score).alias("late_score"),
        *words, "min_top", "max_bottom",
    )


def anti_selected(df: DataFrame, picked: DataFrame, key: Sequence[str]) -> DataFrame:
    """Cases not yet selected."""
    return df.join(picked, list(key), "left_anti")


def argmin_per_group(df: DataFrame, by: Sequence[str], id_col: str, rank: str) -> DataFrame:
    """Best-ranked case of each group."""
    return df.groupBy(*by).agg(
        F.min_by(id_col, F.struct(rank, id_col)).alias(id_col), F.min(rank).alias(rank)
    )
