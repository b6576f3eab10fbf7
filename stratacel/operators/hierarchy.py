"""Trees as adjacency lists: closures, paths, and what spreads up or down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacel.session import checkpoint


def flatten(nodes: DataFrame, node: str, parent: str, ordinal: str, group: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Depth, index path (``0/2/1``) and ancestor ids of every node.

    Pointer doubling: a node knows the part of its path up to an ancestor, and each round puts that
    ancestor's part before it, so a tree of depth d takes log2(d) joins whatever d is. Nodes that no
    root leads to, those of a cycle and under one included, don't come out: a round that reaches no
    root any more ends it.
    """
    keys = list(group)
    state = checkpoint(
        nodes.select(
            *keys, F.col(node).alias("node"), F.col(parent).cast("bigint").alias("above"), F.lit(0).alias("depth"), F.col(ordinal).cast("string").alias("path"), F.array().cast("array<bigint>").alias("ancestors")
        )
    )
    done, waiting = state.where("above IS NULL"), state.where("above IS NOT NULL")
    while not waiting.isEmpty():
        upper = state.select(
            *keys, F.col("node").cast("bigint").alias("above"), F.col("above").alias("next"), F.col("depth").alias("more"), F.col("path").alias("lead"), F.col("ancestors").alias("upper")
        )
        state = checkpoint(
            waiting.join(upper, [*keys, "above"])
            .select(
                *keys, "node", F.col("next").alias("above"), (F.col("depth") + F.col("more") + 1).alias("depth"), F.concat_ws("/", "lead", "path").alias("path"),
                F.concat("upper", F.array("above"), "ancestors").alias("ancestors"),
            )
            .unionByName(done)
        )
        reached, waiting = state.where("above IS NULL"), state.where("above IS NOT NULL")
        if reached.count() == done.count():
            break
        done = reached
    return done.select(*keys, F.col("node").alias(node), "depth", "path", "ancestors")


def closure(flat: DataFrame, node: str, group: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(ancestor, descendant) of a flattened tree, each node with itself."""
    up = flat.select(*group, F.explode(F.concat("ancestors", F.array(F.col(node).cast("bigint")))).alias("ancestor"), F.col(node).alias("descendant"))
    return up


def all_above(closed: DataFrame, flags: DataFrame, node: str, flag: str, group: Sequence[str], slot: Sequence[str] = ()) -> DataFrame:
    """Whether a flag holds at a node and all its ancestors (missing counts as true)."""
    own = flags.select(*group, *slot, F.col(node).alias("ancestor"), F.col(flag).alias("flag"))
    joined = closed.join(own, [*group, "ancestor"])
    return joined.groupBy(*group, F.col("descendant").alias(node), *slot).agg(F.bool_and("flag").alias(flag))


def any_below(closed: DataFrame, flags: DataFrame, node: str, flag: str, group: Sequence[str]) -> DataFrame:
    """Whether a flag holds at a node or anything under it, and at how many."""
    own = flags.select(*group, F.col(node).alias("descendant"), F.col(flag).alias("flag"))
    joined = closed.join(own, [*group, "descendant"])
    return joined.groupBy(*group, F.col("ancestor").alias(node)).agg(F.bool_or("flag").alias(flag), F.count_if("flag").alias(f"{flag}_below"))


def prune(closed: DataFrame, nodes: DataFrame, node: str, keep: Column, group: Sequence[str]) -> DataFrame:
    """Nodes that are kept themselves or lead to one that is: empty groups fall away."""
    kept = nodes.where(keep).select(*group, F.col(node).alias("descendant"))
    leading = closed.join(kept, [*group, "descendant"], "left_semi").select(*group, F.col("ancestor").alias(node)).distinct()
    return nodes.join(leading, [*group, node], "left_semi")


def retime_by_depth(flat: DataFrame, node: str, depth: int, background: DataFrame, group: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One frame per node at ``depth``: it shows the node, its ancestors, its descendants and backgrounds.

    Returns group, frame_index, the node and enabled, dense over (node, frame).
    """
    keys = list(group)
    targets = flat.where(F.col("depth") == depth).select(*keys, F.col(node).alias("target"), "path", F.col("ancestors").alias("above"))
    from pyspark.sql import Window

    from stratacel.functions.columns import path_key

    framed = targets.withColumn("frame_index", (F.row_number().over(Window.partitionBy(*keys).orderBy(path_key(F.col("path")))) - 1).cast("int")).drop("path")
    shown = background.select(*keys, F.col(node)).withColumn("shared", F.lit(True))
    dense = flat.select(*keys, node, "ancestors").join(framed, keys).join(shown, [*keys, node], "left")
    mine = F.col(node).cast("bigint")
    enabled = (mine == F.col("target")) | F.array_contains("above", mine) | F.array_contains("ancestors", F.col("target").cast("bigint")) | F.coalesce("shared", F.lit(False))
    return dense.select(*keys, "frame_index", node, enabled.alias("enabled"))


def effective_bounds(closed: DataFrame, boxes: DataFrame, node: str, group: Sequence[str]) -> DataFrame:
    """Union of the enabled boxes at and under each node: left, top, right, bottom (right and bottom exclusive)."""
    own = boxes.where("enabled").select(*group, F.col(node).alias("descendant"), "left", "top", "right", "bottom")
    return closed.join(own, [*group, "descendant"]).groupBy(*group, F.col("ancestor").alias(node)).agg(
        F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom")
    )


def insert_paths(tracks: DataFrame, path: str, group: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The group nodes that key paths (arrays) stand for: every distinct prefix with its parent prefix."""
    prefixes = tracks.select(*group, F.explode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(F.col(path), F.lit(1), n))).alias("prefix")).where(F.size("prefix") > 0)
    return prefixes.distinct().select(*group, F.array_join("prefix", "/").alias("node"), F.array_join(F.expr("slice(prefix, 1, size(prefix) - 1)"), "/").alias("parent"), F.size("prefix").alias("depth"))


def drop_common_root(tracks: DataFrame, path: str, neutral: Column, group: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Removes the first segment of the paths where all of a document share it and it is neutral."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group)
    first = F.coalesce(F.get(F.col(path), 0), F.lit(""))
    shared = (F.min(first).over(w) == F.max(first).over(w)) & (F.min(F.size(path)).over(w) > 0) & (F.min(neutral.cast("int")).over(w) == 1)
    return tracks.withColumn(path, F.when(shared, F.expr(f"slice({path}, 2, size({path}))")).otherwise(F.col(path)))
