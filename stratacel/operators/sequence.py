"""Operators along an ordered axis: states that carry forward, ranges, links, ordinals.

All windows have a total order and are partitioned by the sequence, so Spark sorts each sequence
once; operators with the same keys share that exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def _window(keys: Names, order: Names):
    return Window.partitionBy(*keys).orderBy(*order)


def carry_forward(df: DataFrame, keys: Names, order: Names, value: Column, initial: Column, out: str) -> DataFrame:
    """Each row's state: its own explicit value, else the last explicit one, else ``initial``."""
    upto = _window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(upto), initial))


def resolve_states(layers: DataFrame, frames: DataFrame, records: DataFrame) -> DataFrame:
    """Dense visibility per (layer, frame) from sparse records, with the three inheritance policies.

    layers: doc_id, layer_id, kind, container_group, hidden; frames: doc_id, frame_index (catalog
    order); records: doc_id, layer_id, frame_index, enable. A slot group (a group that isn't a
    container of groups and has records) takes its own record or false; a layer with records is
    false where one is missing, and that holds on; a record without a value inherits; a layer
    without records keeps its static visibility.
    """
    has = records.select("doc_id", "layer_id").distinct().withColumn("has", F.lit(True))
    dense = (
        layers.join(frames.select("doc_id", "frame_index"), "doc_id")
        .join(has, ["doc_id", "layer_id"], "left")
        .join(records.withColumn("present", F.lit(True)), ["doc_id", "layer_id", "frame_index"], "left")
    )
    known, present = F.coalesce("has", F.lit(False)), F.coalesce("present", F.lit(False))
    slot = (F.col("kind") == "group") & ~F.col("container_group") & known
    effective = F.when(slot, F.coalesce("enable", F.lit(False))).when(present, F.col("enable")).when(known, F.lit(False))
    dense = dense.withColumn("effective", effective)
    out = carry_forward(dense, ["doc_id", "layer_id"], ["frame_index"], F.col("effective"), ~F.col("hidden"), "enabled")
    return out.select("doc_id", "layer_id", "frame_index", present.alias("record_present"), F.col("enable").alias("explicit_enable"), "enabled")


def sparse_encode(df: DataFrame, keys: Names, order: Names, value: str, out: str) -> DataFrame:
    """Keeps a state's first value and its changes, and null in between; the inverse of carry_forward."""
    w = _window(keys, order)
    first = F.row_number().over(w) == 1
    return df.withColumn(out, F.when(first | ~F.lag(value).over(w).eqNullSafe(F.col(value)), F.col(value)))


def state_changes(df: DataFrame, keys: Names, order: Names, values: Names, out: str) -> DataFrame:
    """Per sequence the number of adjacent rows that differ in any of the values; null equals null."""
    w = _window(keys, order)
    state = F.struct(*values)
    moved = df.select(*keys, (~F.lag(state).over(w).eqNullSafe(state) & (F.row_number().over(w) > 1)).alias("moved"))
    return moved.groupBy(*keys).agg(F.count_if("moved").alias(out))


def contiguous_ranges(df: DataFrame, keys: Names, order: Names, value: str) -> DataFrame:
    """Maximal runs of one non-null value: keys, value, from_index, to_index (zero-based), n."""
    w, by_value = _window(keys, order), _window([*keys, value], order)
    at = df.select(*keys, value, *[o for o in order if o not in keys and o != value]).withColumn("at", F.row_number().over(w) - 1)
    runs = at.where(F.col(value).isNotNull()).withColumn("run", F.col("at") - F.row_number().over(by_value))
    return runs.groupBy(*keys, value, "run").agg(
        F.min("at").cast("bigint").alias("from_index"), F.max("at").cast("bigint").alias("to_index"), F.count("*").alias("n")
    ).drop("run")


def dense_order(df: DataFrame, keys: Names, order: Names, out: str) -> DataFrame:
    return df.withColumn(out, (F.row_number().over(_window(keys, order)) - 1).cast("bigint"))


def first_equal(df: DataFrame, keys: Names, content: Names, order: str, out: str) -> DataFrame:
    """The first row of equal content in the group, which is never a link itself; null in the first."""
    first = F.min(order).over(Window.partitionBy(*keys, *content))
    return df.withColumn(out, F.when(first != F.col(order), first))


def variant_index(df: DataFrame, keys: Names, content: Names, order: str, out: str) -> DataFrame:
    """Number of each distinct content of a group by its first appearance, from zero."""
    first = df.withColumn("__first", F.min(order).over(Window.partitionBy(*keys, *content)))
    return first.withColumn(out, (F.dense_rank().over(_window(keys, ["__first"])) - 1).cast("bigint")).drop("__first")


def ordinal_suffix(df: DataFrame, keys: Names, name: str, order: Names, out: str, first_plain: bool) -> DataFrame:
    """Tells equal names of a group apart: ``a 1, a 2`` or, with ``first_plain``, ``a, a (2)``."""
    group = Window.partitionBy(*keys, name)
    number = F.row_number().over(group.orderBy(*order)).cast("string")
    if first_plain:
        label = F.when(number == "1", F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), number, F.lit(")")))
    else:
        label = F.when(F.count("*").over(group) > 1, F.concat(F.col(name), F.lit(" "), number)).otherwise(F.col(name))
    return df.withColumn(out, label)


def best_margin(df: DataFrame, keys: Names, score: str, tie: Names, out: str) -> DataFrame:
    """The best row of each group and how far it is ahead of the second, zero at least."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *tie)
    ranked = df.withColumn("__rank", F.row_number().over(w)).withColumn(out, F.greatest(F.col(score) - F.coalesce(F.lead(score).over(w), F.lit(0)), F.lit(0)))
    return ranked.where("__rank = 1").drop("__rank")


def rotated_position(index: Column, anchor: Column, size: Column) -> Column:
    """Place in an order that starts at the anchor and wraps."""
    return F.pmod(index - anchor, size)


def gaps(df: DataFrame, keys: Names, start: str, end: str) -> DataFrame:
    """Sections after which the next doesn't begin where they end: keys, start, end, next_start."""
    w = _window(keys, [start, end])
    return df.select(*keys, start, end, F.lead(start).over(w).alias("next_start")).where(f"next_start IS NOT NULL AND next_start <> {end}")


def playback(tags: DataFrame, first: str, last: str, direction: str) -> DataFrame:
    """Expands frame ranges to the frames as they play: position (from zero) and frame.

    forward, reverse, pingpong and pingpong_reverse; a ping-pong doesn't repeat its end points, and
    of one or two frames adds nothing.
    """
    up = F.sequence(F.col(first), F.col(last))
    down = F.reverse(up)
    inner = F.col(last) - F.col(first) - 1
    back = lambda x: F.when(inner > 0, F.slice(x, F.lit(2), F.greatest(inner, F.lit(1)))).otherwise(F.slice(x, 1, 0))
    order = (
        F.when(F.col(direction) == "reverse", down)
        .when(F.col(direction) == "pingpong", F.concat(up, back(down)))
        .when(F.col(direction) == "pingpong_reverse", F.concat(down, back(up)))
        .otherwise(up)
    )
    return tags.select("*", F.posexplode(order).alias("position", "frame"))


def nearest_both_sides(df: DataFrame, keys: Names, order: Names, value: Column, before: str, after: str) -> DataFrame:
    """The nearest earlier and later non-null value of each row, itself not counted."""
    earlier = Window.unboundedPreceding, -1  # both as a running value: a frame that shrinks is gone over anew for each row
    forwards = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*earlier)
    backwards = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(*earlier)
    return df.withColumn(before, F.last(value, ignorenulls=True).over(forwards)).withColumn(after, F.last(value, ignorenulls=True).over(backwards))
