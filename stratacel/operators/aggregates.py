"""Aggregations: bounded reports, votes, majorities, medians, exclusive sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def bounded_report(df: DataFrame, keys: Names, order: str, location: Column, keep: int = 8) -> DataFrame:
    """Per key the number of issues, the first ``keep`` locations and the first place in order.

    Only rows of a rank up to ``keep`` are collected, so an array never grows with its group; ranks
    are found with Spark's group limit, which drops the rest before the shuffle.
    """
    first = df.select(*keys, F.col(order).alias("__order"), location.alias("__location"))
    kept = (
        first.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy("__order")))
        .where(F.col("__rank") <= keep)
        .groupBy(*keys)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rank", "__location"))), lambda x: x["__location"]), ",").alias("locations"))
    )
    totals = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return totals.join(kept, list(keys))


def pair_votes(df: DataFrame, group: Names, item: str, order: str) -> DataFrame:
    """How often, over the groups, the lower of two items comes before the higher, and after it.

    Items of a group are paired inside the group; a group's items are distinct.
    """
    a = df.select(*group, F.col(item).alias("lo"), F.col(order).alias("at_lo"))
    b = df.select(*group, F.col(item).alias("hi"), F.col(order).alias("at_hi"))
    pairs = a.join(b, list(group)).where("lo < hi")
    return pairs.groupBy("lo", "hi").agg(F.count_if(F.col("at_lo") < F.col("at_hi")).alias("forward"), F.count_if(F.col("at_lo") > F.col("at_hi")).alias("reverse"))


def confident(winner: Column, loser: Column) -> Column:
    """A vote that decides an order: unanimous, or clear by two votes and by two thirds."""
    return (winner > 0) & ((loser == 0) | ((winner >= 2) & (winner >= loser + 2) & (3 * winner >= 2 * (winner + loser))))


def majority(df: DataFrame, keys: Names, choice: str, share: tuple[int, int]) -> DataFrame:
    """The choice that most rows of a key take; none where two lead or the lead has under ``share``."""
    counts = df.groupBy(*keys, choice).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(*keys)
    top = counts.select(
        *keys, choice, "votes", F.sum("votes").over(w).alias("total"), F.rank().over(w.orderBy(F.desc("votes"))).alias("rank")
    )
    best = top.where("rank = 1").groupBy(*keys).agg(F.min(choice).alias("choice"), F.count("*").alias("leaders"), F.max("votes").alias("votes"), F.max("total").alias("total"))
    wins = (F.col("leaders") == 1) & (F.col("votes") * share[1] >= F.col("total") * share[0])
    return best.select(*keys, F.when(wins, F.col("choice")).alias("choice"), "votes", "total")


def upper_median(df: DataFrame, keys: Names, value: str, tie: Names, out: str) -> DataFrame:
    """The value at place n/2 of the sorted values, by rank and not by a collected array."""
    w = Window.partitionBy(*keys)
    ranked = df.select(*keys, value, F.row_number().over(w.orderBy(value, *tie)).alias("rank"), F.count("*").over(w).alias("n"))
    return ranked.where(F.expr("rank = n div 2 + 1")).select(*keys, F.col(value).alias(out))


def profile(df: DataFrame, keys: Names, values: Names, out: str) -> DataFrame:
    """The sorted distinct combinations of some attributes of a key."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(*values))).alias(out))


def exclusive_siblings(activity: DataFrame, parent: str, child: str, slot: str) -> DataFrame:
    """Parents whose children are never active in one slot together, with two slots in use at least.

    Disjoint sets are found without comparing them: no (parent, slot) has two children.
    """
    per_slot = activity.select(parent, child, slot).distinct().groupBy(parent, slot).agg(F.count("*").alias("children"))
    use = per_slot.groupBy(parent).agg(F.max("children").alias("most"), F.count("*").alias("slots"))
    kinds = activity.groupBy(parent).agg(F.count_distinct(child).alias("children"))
    return use.join(kinds, parent).select(parent, "children", "slots", ((F.col("most") == 1) & (F.col("slots") >= 2) & (F.col("children") >= 2)).alias("exclusive"))


def anchor_pick(df: DataFrame, first: str, second: str, tie: str) -> DataFrame:
    """The one row with the greatest of two counts, the earliest of equals."""
    return df.orderBy(F.desc(first), F.desc(second), tie).limit(1)


def complete_interval(df: DataFrame, keys: Names, position: str) -> DataFrame:
    """Whether the positions of a key fill their range without a gap or a repetition."""
    return df.groupBy(*keys).agg(
        F.min(position).alias("low"),
        F.max(position).alias("high"),
        F.count("*").alias("n"),
        ((F.max(position) - F.min(position) + 1 == F.count_distinct(position)) & (F.count("*") == F.count_distinct(position))).alias("complete"),
    )
