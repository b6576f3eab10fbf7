"""What is visible in a frame, down a tree of groups whose own state may only select a frame."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacel.session import checkpoint

KEY = ["doc_id", "layer_id"]


def _candidates(flat: DataFrame, layers: DataFrame, closed: DataFrame, states: DataFrame) -> DataFrame:
    """Groups with children, a record, an animated layer below, never enabled, in documents of two frames."""
    frames = states.groupBy("doc_id").agg(F.count_distinct("frame_index").alias("frames")).where("frames >= 2").select("doc_id")
    own = states.groupBy(*KEY).agg(F.bool_or("record_present").alias("record"), F.bool_or("enabled").alias("ever"))
    groups = layers.where("kind = 'group'").select(*KEY).join(own.where("record AND NOT ever").select(*KEY), KEY).join(frames, "doc_id")
    animated = own.where("record").select("doc_id", F.col("layer_id").alias("descendant"))
    below = closed.where("ancestor <> descendant").join(animated, ["doc_id", "descendant"]).select("doc_id", F.col("ancestor").alias("layer_id")).distinct()
    return groups.join(below, KEY, "left_semi")


def structural_containers(flat: DataFrame, layers: DataFrame, closed: DataFrame, states: DataFrame) -> DataFrame:
    """Groups that only select frames, by any enabled drawing below in two frames (doc_id, layer_id).

    flat: doc_id, layer_id, depth; layers: doc_id, layer_id, parent_id, kind; closed: doc_id,
    ancestor, descendant; states: doc_id, layer_id, frame_index, record_present, enabled.
    """
    groups = _candidates(flat, layers, closed, states)
    drawn = states.where("enabled").join(layers.where("kind <> 'group'").select(*KEY), KEY).select("doc_id", F.col("layer_id").alias("descendant"), "frame_index")
    seen = closed.join(drawn, ["doc_id", "descendant"]).groupBy("doc_id", F.col("ancestor").alias("layer_id")).agg(F.count_distinct("frame_index").alias("n"))
    return groups.join(seen.where("n >= 2").select(*KEY), KEY, "left_semi")


def reachable_containers(flat: DataFrame, layers: DataFrame, closed: DataFrame, states: DataFrame) -> DataFrame:
    """The same, where a drawing below counts only through groups that are enabled or such containers.

    Evaluated from the deepest level up: one join per level of the deepest tree.
    """
    candidates = checkpoint(_candidates(flat, layers, closed, states).withColumn("candidate", F.lit(True)))
    tree = layers.select(*KEY, "parent_id", "kind").join(flat.select(*KEY, "depth"), KEY)
    deepest = tree.agg(F.max("depth")).first()[0]
    enabled = states.where("enabled").select(*KEY, "frame_index")
    # drawings, and groups through which drawings are seen: (doc_id, parent_id, frame_index)
    found = None
    reach = tree.where("kind <> 'group'").join(enabled, KEY).select("doc_id", F.col("parent_id").alias("layer_id"), "frame_index", "depth")
    passed = None
    for depth in range(deepest or 0, -1, -1):
        seen = reach.where(F.col("depth") == depth + 1).select(*KEY, "frame_index")
        if passed is not None:
            seen = seen.unionByName(passed)
        seen = checkpoint(seen.distinct())
        level = tree.where((F.col("depth") == depth) & (F.col("kind") == "group"))
        many = seen.groupBy(*KEY).agg(F.count("*").alias("n")).where("n >= 2").select(*KEY)
        own = level.select(*KEY).join(candidates, KEY, "left_semi").join(many, KEY, "left_semi")
        found = own if found is None else found.unionByName(own)
        open_at = seen.join(enabled, [*KEY, "frame_index"], "left_semi").unionByName(seen.join(own, KEY, "left_semi")).distinct()
        passed = open_at.join(level.select(*KEY, "parent_id"), KEY).select("doc_id", F.col("parent_id").alias("layer_id"), "frame_index")
    return found


def effective_visibility(layers: DataFrame, closed: DataFrame, states: DataFrame, containers: DataFrame) -> DataFrame:
    """Per (drawing, frame): its own state, and every group above enabled or a structural container."""
    opens = states.join(containers.withColumn("structural", F.lit(True)), KEY, "left").select(
        "doc_id", F.col("layer_id").alias("ancestor"), "frame_index", (F.col("enabled") | F.coalesce("structural", F.lit(False))).alias("open")
    )
    drawings = layers.where("kind <> 'group'").select("doc_id", F.col("layer_id").alias("descendant"))
    above = closed.join(drawings, ["doc_id", "descendant"], "left_semi").join(opens, ["doc_id", "ancestor"])
    return above.groupBy("doc_id", F.col("descendant").alias("layer_id"), "frame_index").agg(F.bool_and("open").alias("visible"))


def varying(states: DataFrame) -> DataFrame:
    """Layers whose state differs between two adjacent frames (FLT-05)."""
    from stratacel.operators.sequence import state_changes

    return state_changes(states, KEY, ["frame_index"], ["enabled"], "changes").where("changes > 0").select(*KEY)


def exclusive_features(layers: DataFrame, states: DataFrame) -> DataFrame:
    """Groups of drawings only, below a group whose state varies (FLT-07)."""
    kids = layers.where("parent_id IS NOT NULL").groupBy("doc_id", F.col("parent_id").alias("layer_id")).agg(F.bool_and(F.col("kind") != "group").alias("drawings"))
    groups = layers.where("kind = 'group'").join(kids.where("drawings"), KEY, "left_semi")
    parents = varying(states).withColumnRenamed("layer_id", "parent_id")
    return groups.join(parents, ["doc_id", "parent_id"], "left_semi").select(*KEY)


def ever_visible(layers: DataFrame, states: DataFrame, containers: DataFrame) -> DataFrame:
    """Whether a layer is enabled in any frame, or a structural container (FLT-04)."""
    own = states.groupBy(*KEY).agg(F.bool_or("enabled").alias("ever"))
    joined = layers.select(*KEY).join(own, KEY, "left").join(containers.withColumn("structural", F.lit(True)), KEY, "left")
    return joined.select(*KEY, (F.coalesce("ever", F.lit(False)) | F.coalesce("structural", F.lit(False))).alias("ever"))


def timeline_bound(layers: DataFrame, closed: DataFrame, states: DataFrame) -> DataFrame:
    """Groups whose own state varies over the frames and that hold a drawing enabled in one (FLT-05, FLT-06)."""
    varied = varying(states)
    drawn = states.where("enabled").join(layers.where("kind <> 'group'").select(*KEY), KEY).select("doc_id", F.col("layer_id").alias("descendant")).distinct()
    holds = closed.join(drawn, ["doc_id", "descendant"], "left_semi").select("doc_id", F.col("ancestor").alias("layer_id")).distinct()
    return layers.where("kind = 'group'").select(*KEY).join(varied, KEY, "left_semi").join(holds, KEY, "left_semi")


def render_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per frame of two renderings the pixels that differ to the eye, in alpha, and where both are clear.

    a, b: doc_id, frame_index, width, height, pixels. A frame on one side only, or of another size,
    has null counts and ``comparable`` false.
    """
    from stratacel.functions.pixels import differing_pixels, image

    @F.pandas_udf("struct<visible:bigint,alpha:bigint,clear:bigint>")
    def compare(p: pd.Series, q: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y, width, height in zip(p, q, w, h):
            one, two = image(x, width, height), image(y, width, height)
            rows.append((None, None, None) if one is None or two is None else differing_pixels(one, two))
        return pd.DataFrame(rows, columns=["visible", "alpha", "clear"])

    key = ["doc_id", "frame_index"]
    left = a.select(*key, F.col("width").alias("w"), F.col("height").alias("h"), F.col("pixels").alias("p"))
    right = b.select(*key, F.col("width").alias("w2"), F.col("height").alias("h2"), F.col("pixels").alias("q"))
    both = left.join(right, key, "full_outer").withColumn("q", F.when((F.col("w") == F.col("w2")) & (F.col("h") == F.col("h2")), F.col("q")))
    out = both.select(*key, compare("p", "q", "w", "h").alias("d"))
    return out.select(*key, F.col("d.visible").isNotNull().alias("comparable"), "d.visible", "d.alpha", "d.clear")


def loss_report(losses: DataFrame, document: str = "doc_id") -> DataFrame:
    """One JSON report per document of (code, disposition) entries with counts and first places.

    losses: the document, seq, code, disposition, location, detail. Absent values are left out; the
    total counts entries, not occurrences.
    """
    from stratacel.operators.aggregates import bounded_report

    keys = [document, "code", "disposition"]
    entries = bounded_report(losses, keys, "seq", F.col("location"))
    first = losses.groupBy(*keys).agg(F.min_by("detail", "seq").alias("detail"))
    entry = F.struct("first_seen", F.struct("code", "disposition", F.col("n").alias("count"), "detail", F.split("locations", ",").alias("locations")).alias("e"))
    grouped = entries.join(first, keys).groupBy(document).agg(F.array_sort(F.collect_list(entry)).alias("rows"))  # codes times dispositions rows
    report = F.struct(F.lit(3).alias("schema_version"), F.struct(F.size("rows").alias("total")).alias("summary"), F.transform("rows", lambda r: r.e).alias("entries"))
    return grouped.select(document, F.to_json(report).alias("report"))
