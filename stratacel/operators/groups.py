"""Groups and tracks of a document: selection by depth, relations, owners, wrappers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["doc_id", "layer_id"]


def nodes_at_depth(flat: DataFrame, layers: DataFrame, depth: int) -> DataFrame:
    """Nodes of one depth with the names above them joined by `` / `` (TRE-02)."""
    nodes = flat.where(F.col("depth") == depth).select(*KEY, "path", F.posexplode_outer("ancestors").alias("pos", "ancestor"))
    names = layers.select("doc_id", F.col("layer_id").alias("ancestor"), F.coalesce(F.nullif("name", F.lit("")), F.lit("<unnamed>")).alias("above"))
    joined = nodes.join(names, ["doc_id", "ancestor"], "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("above").isNotNull(), F.struct("pos", "above"))))
    return joined.groupBy(*KEY, "path").agg(F.array_join(F.transform(ordered, lambda x: x.above), " / ").alias("group_name"))


def static_states(layers: DataFrame) -> DataFrame:
    """One frame that shows what isn't hidden (TRE-07)."""
    return layers.select(*KEY, F.lit(0).alias("frame_index"), F.lit(False).alias("record_present"), (~F.coalesce("hidden", F.lit(False))).alias("enabled"))


def selector_groups(layers: DataFrame, activity: DataFrame) -> DataFrame:
    """Sibling groups that are never active together, two of them and two frames at least (JN-14, AGG-07).

    activity: doc_id, layer_id, frame_index of active groups. A group that is never active is
    disjoint from all, so it counts as a sibling. Root groups are siblings too.
    """
    groups = layers.where("kind = 'group'").select(*KEY, F.coalesce("parent_id", F.lit(-1)).alias("parent_id"))
    siblings = groups.groupBy("doc_id", "parent_id").agg(F.count("*").alias("groups")).where("groups >= 2")
    seen = groups.join(activity.select(*KEY, "frame_index").distinct(), KEY).groupBy("doc_id", "parent_id", "frame_index").agg(F.count("*").alias("n"))
    use = seen.groupBy("doc_id", "parent_id").agg(F.max("n").alias("most"), F.count("*").alias("frames")).where("most = 1 AND frames >= 2")
    return groups.join(siblings, ["doc_id", "parent_id"], "left_semi").join(use, ["doc_id", "parent_id"], "left_semi").select(*KEY, "parent_id")


def track_relations(pairs: DataFrame, cels: DataFrame, selectors: DataFrame) -> DataFrame:
    """How two tracks of given pairs relate: co_visible, structural, observed_disjoint (JN-15).

    pairs: doc_id, a, b; cels: doc_id, track, frame_index, selector (the selector group above the
    cel, or null); selectors: doc_id, layer_id, parent_id of ``selector_groups``.
    """
    frames = cels.select("doc_id", "track", "frame_index").distinct()
    one = pairs.join(frames.withColumnRenamed("track", "a"), ["doc_id", "a"])
    both = one.join(frames.withColumnRenamed("track", "b"), ["doc_id", "b", "frame_index"])
    shared = both.select("doc_id", "a", "b").distinct().withColumn("shared", F.lit(True))
    above = cels.join(selectors.select("doc_id", F.col("layer_id").alias("selector"), "parent_id"), ["doc_id", "selector"]).select("doc_id", "track", "selector", "parent_id").distinct()
    left = pairs.join(above.select("doc_id", F.col("track").alias("a"), F.col("selector").alias("sa"), "parent_id"), ["doc_id", "a"])
    apart = left.join(above.select("doc_id", F.col("track").alias("b"), F.col("selector").alias("sb"), "parent_id"), ["doc_id", "b", "parent_id"])
    structural = apart.groupBy("doc_id", "a", "b").agg(F.bool_and(F.col("sa") != F.col("sb")).alias("structural"))
    out = pairs.join(shared, ["doc_id", "a", "b"], "left").join(structural, ["doc_id", "a", "b"], "left")
    relation = F.when(F.col("shared"), "co_visible").when(F.col("structural"), "structural").otherwise("observed_disjoint")
    return out.select("doc_id", "a", "b", relation.alias("relation"))


def merge_candidates(tracks: DataFrame) -> DataFrame:
    """Pairs of tracks a < b of one document with the same features or the same name of their own (JN-20).

    tracks: doc_id, track, features (sorted array), name, generic. Pairs are made by equi-joins on
    the feature key and on the name.
    """
    keyed = tracks.select("doc_id", "track", "name", "generic", F.to_json(F.struct("features")).alias("key"), (F.size("features") > 0).alias("has"))

    def pairs(rows: DataFrame, on: str, kind: int) -> DataFrame:
        a, b = rows.select("doc_id", on, F.col("track").alias("a")), rows.select("doc_id", on, F.col("track").alias("b"))
        return a.join(b, ["doc_id", on]).where("a < b").select("doc_id", "a", "b", F.lit(kind).alias("kind"))

    both = pairs(keyed.where("has"), "key", 0).unionByName(pairs(keyed.where("NOT generic"), "name", 1))
    return both.groupBy("doc_id", "a", "b").agg(F.min("kind").alias("kind"))


def frame_owners(states: DataFrame, frames: DataFrame) -> DataFrame:
    """The first physical state enabled in each frame; a frame without one is an error (JN-19).

    states: doc_id, state, ordinal, frame_index, enabled.
    """
    first = states.where("enabled").groupBy("doc_id", "frame_index").agg(F.min_by("state", "ordinal").alias("state"))
    joined = frames.select("doc_id", "frame_index").join(first, ["doc_id", "frame_index"], "left")
    missing = F.raise_error(F.concat(F.lit("no state in frame "), F.col("frame_index").cast("string")))
    return joined.withColumn("state", F.when(F.col("state").isNull(), missing).otherwise(F.col("state")))


def zip_frame_groups(nodes: DataFrame, frame_count: Column) -> DataFrame:
    """Nodes of parallel frame trees matched by their relative path: doc_id, path, name, nodes, matched (JN-17).

    nodes: doc_id, frame_index, path (relative to the frame's root), name, and what ``frame_count``
    needs. Matched where every frame has the path, under one name.
    """
    out = nodes.groupBy("doc_id", "path").agg(F.min("name").alias("name"), F.count_distinct("name").alias("names"), F.count_distinct("frame_index").alias("frames"), F.count("*").alias("nodes"), F.max(frame_count).alias("wanted"))
    return out.select("doc_id", "path", "name", "nodes", ((F.col("names") == 1) & (F.col("frames") == F.col("wanted")) & (F.col("nodes") == F.col("wanted"))).alias("matched"))


def cel_wrappers(layers: DataFrame, activity: DataFrame) -> DataFrame:
    """Groups that only wrap the cels of one layer (FLT-20): doc_id, layer_id.

    Children of consecutive ids that end just before the group's, of one name, which is the
    group's, each active, and never two in one frame.
    """
    groups = layers.where("kind = 'group'").select("doc_id", F.col("layer_id").alias("parent_id"), F.col("name").alias("parent_name"))
    kids = layers.join(groups, ["doc_id", "parent_id"])
    shape = kids.groupBy("doc_id", "parent_id", "parent_name").agg(
        F.min("layer_id").alias("low"), F.max("layer_id").alias("high"), F.count("*").alias("n"), F.bool_and(F.col("name") == F.col("parent_name")).alias("named"), F.bool_and(F.col("kind") != "group").alias("drawings")
    )
    shape = shape.where("named AND drawings AND high - low + 1 = n AND high + 1 = parent_id")
    own = kids.select("doc_id", "parent_id", "layer_id").join(activity.select(*KEY, "frame_index").distinct(), KEY)
    active = own.groupBy("doc_id", "parent_id").agg(F.count_distinct("layer_id").alias("active"), F.count("*").alias("cells"), F.count_distinct("frame_index").alias("frames"))
    good = shape.join(active, ["doc_id", "parent_id"]).where("active = n AND cells = frames")
    return good.select("doc_id", F.col("parent_id").alias("layer_id"))


def reject_clipping(layers: DataFrame) -> DataFrame:
    """The layers, or an error where one clips to another (FLT-14)."""
    clips = F.coalesce("clipping", F.lit(False))
    guard = F.when(clips, F.raise_error(F.concat(F.lit("clipping layer "), F.col("layer_id").cast("string"))))
    return layers.where(F.coalesce(guard.cast("boolean"), F.lit(True)))


def has_effect(opacity: Column, blend_mode: Column) -> Column:
    """Whether a group changes how its content looks (FLT-18)."""
    return (F.coalesce(opacity, F.lit(1.0)) != 1.0) | ~F.coalesce(blend_mode, F.lit("normal")).isin("normal", "pass through")


def feature_summary(members: DataFrame) -> DataFrame:
    """Per node the features below it, and whether it is pure: one feature and nothing unassigned (AGG-14)."""
    out = members.groupBy("doc_id", "node").agg(F.sort_array(F.collect_set("feature")).alias("features"), F.bool_or(F.col("feature").isNull()).alias("unassigned"))
    return out.withColumn("pure", (F.size("features") == 1) & ~F.col("unassigned"))


def first_free_id(layers: DataFrame) -> DataFrame:
    """The id after the highest of each document, for new records; an id of 0 is an error (AGG-17)."""
    checked = F.when(F.col("layer_id") < 1, F.raise_error(F.lit("layer id 0"))).otherwise(F.col("layer_id"))
    return layers.groupBy("doc_id").agg((F.max(checked) + 1).alias("first_free"))


def delta_states(states: DataFrame) -> DataFrame:
    """Adjacent frames of a layer in which any of enabled, offset or opacity differs (FLT-05)."""
    w = Window.partitionBy(*KEY).orderBy("frame_index")
    state = F.struct("enabled", "offset_x", "offset_y", "opacity")
    return states.withColumn("moved", ~F.lag(state).over(w).eqNullSafe(state) & (F.row_number().over(w) > 1)).where("moved").select(*KEY, "frame_index")
