"""Cels and snapshots: links, states that content defines, reuse, jitter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacel.functions.pixels import PROFILES, nearly_equal, specks, writable
from stratacel.session import materialize

LAYER = ["doc_id", "source_layer_id"]


def latest_delivery(df: DataFrame, keys: list[str], at: str = "ingested_at") -> DataFrame:
    """Of rows delivered again the latest (ties: the greatest row)."""
    rest = [c for c in df.columns if c not in keys and c != at]
    top = df.groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("row"))
    return top.select(*keys, *[F.col(f"row.{c}").alias(c) for c in [at, *rest]]).select(*df.columns)


def content_key(prefix: str = "") -> Column:
    """What makes two cels one drawing: size and bytes, by hash."""
    return F.sha2(F.concat(F.col(f"{prefix}width").cast("string").cast("binary"), F.lit(b"/"), F.col(f"{prefix}height").cast("string").cast("binary"), F.lit(b"/"), F.col(f"{prefix}pixels")), 256)


def dereference(cels: DataFrame) -> DataFrame:
    """Linked cels with the pixels of the cel they lead to; place and opacity stay their own.

    A link into nothing keeps the cel's own pixels.
    """
    target = cels.groupBy(*LAYER, F.col("source_frame").alias("linked_source_frame")).agg(
        F.min_by(F.struct("width", "height", "pixels"), F.struct("frame_index", "cel_id")).alias("target")
    )
    linked = cels.join(target, [*LAYER, "linked_source_frame"], "left")
    use = (F.col("source_frame") != F.col("linked_source_frame")) & F.col("target").isNotNull()
    return linked.withColumns({c: F.when(use, F.col(f"target.{c}")).otherwise(F.col(c)) for c in ("width", "height", "pixels")}).select(*cels.columns)


def snapshot(layers: DataFrame, frames: DataFrame, cels: DataFrame) -> DataFrame:
    """Every layer at every playback position with its cel, if it has one there."""
    grid = layers.select(*LAYER, "kind", "opacity", "blend_mode", "visible").withColumnRenamed("opacity", "layer_opacity").join(frames.select("doc_id", "frame_index"), "doc_id")
    own = cels.select(*LAYER, "frame_index", "cel_id", "source_frame", "x", "y", "opacity")
    return grid.join(own, [*LAYER, "frame_index"], "left")


def writable_cels(cels: DataFrame) -> DataFrame:
    return cels.withColumn("writable", writable(F.col("pixels"), F.col("opacity")))


def reuse_states(cels: DataFrame, linked: bool) -> DataFrame:
    """State number of every cel: equal cels of a layer share one; columns cel_id, state, first_frame.

    Aggressive reuse takes equal size, place, opacity and pixels. Linked reuse also wants the same
    link and one source: both linked, the same source frame, or one linked to the other's own
    frame. That isn't transitive, so each cel joins the *first* representative it equals: it is
    evaluated against the representatives of its content and link only, which are few.
    """
    content = F.xxhash64("width", "height", "x", "y", "opacity", content_key())
    rows = cels.select(*LAYER, "frame_index", "cel_id", "source_frame", "linked_source_frame", F.concat_ws("/", content.cast("string"), F.col("x").cast("string"), F.col("y").cast("string")).alias("content"))
    if not linked:
        first = F.min("frame_index").over(Window.partitionBy(*LAYER, "content"))
        rows = rows.withColumn("first_frame", first)
    else:
        # Within one content and link, a cel's kinds are: linked, or own at a source frame.
        is_link = F.col("source_frame") != F.col("linked_source_frame")
        kind = F.when(is_link, F.lit(-1)).otherwise(F.col("source_frame"))
        group = Window.partitionBy(*LAYER, "content", "linked_source_frame")
        rows = rows.withColumn("kind", kind).withColumn("first_frame", F.min("frame_index").over(group))
    rank = F.dense_rank().over(Window.partitionBy(*LAYER).orderBy("first_frame")) - 1
    return rows.select(*LAYER, "cel_id", "frame_index", "first_frame", rank.cast("bigint").alias("state"))


def reuse_counts(states: DataFrame) -> DataFrame:
    """Per document the cels, the states, and the cels that repeat one."""
    per = states.groupBy(*LAYER).agg(F.count("*").alias("cels"), F.count_distinct("state").alias("states"))
    return per.groupBy("doc_id").agg(F.sum("cels").alias("cels"), F.sum("states").alias("states"), F.sum(F.col("cels") - F.col("states")).alias("reused"))


def physical_records(layers: DataFrame) -> DataFrame:
    """Records that a document's layers need: one for a drawing, two for a group."""
    return layers.groupBy("doc_id").agg(F.sum(F.when(F.col("kind") == "group", 2).otherwise(1)).alias("records"))


def better_layout(local: DataFrame, baseline: DataFrame) -> DataFrame:
    """Whether the layout by layer needs fewer records than the one by frame, its extra one counted."""
    return local.join(baseline, "doc_id").select("doc_id", (F.col("local") + 1 < F.col("baseline")).alias("use_local"))


def frame_duplicates(cels: DataFrame) -> DataFrame:
    """Playback positions of a document that show the same: doc_id, frame_index, shown_first_at.

    A frame's content is the sum of its cels' hashes, taken by partial aggregation.
    """
    cel = F.xxhash64("source_layer_id", "width", "height", "x", "y", "opacity", content_key())
    frames = cels.groupBy("doc_id", "frame_index").agg(
        F.bit_xor(cel).alias("a"), F.sum(cel.cast("decimal(20,0)")).alias("b"), F.count("*").alias("n")
    )
    return frames.select("doc_id", "frame_index", F.min("frame_index").over(Window.partitionBy("doc_id", "a", "b", "n")).alias("shown_first_at"))


def jitter_repairs(cels: DataFrame, profile: str = "conservative") -> DataFrame:
    """Cels with faint specks: cel_id, patches, cleared and the repaired pixels."""
    cleaned = cels.select("cel_id", specks(F.col("pixels"), F.col("width"), F.col("height"), profile).alias("s"))
    return cleaned.where("s.patches > 0").select("cel_id", "s.patches", "s.cleared", "s.pixels")


def _segments(percent: int) -> Column:
    """Hashes of the parts of a buffer of which two near-equal ones must have one in common.

    Buffers of n pixels that differ in k at most agree in one of any k + 1 parts of them.
    """
    n = F.col("width").cast("bigint") * F.col("height")
    parts = F.floor(n * percent / 100) + 1
    edge = lambda i: F.floor(i * n / parts)
    return F.transform(F.sequence(F.lit(0).cast("bigint"), parts - 1), lambda i: F.xxhash64(F.substring(F.col("pixels"), (edge(i) * 4 + 1).cast("int"), ((edge(i + 1) - edge(i)) * 4).cast("int"))))


def colour_representatives(cels: DataFrame, profile: str = "conservative") -> DataFrame:
    """Cels of a layer that nearly equal an earlier one at the same place: cel_id and its representative.

    The highest earlier cel counts; one hop, not transitive. Different buffers of one (layer, size,
    place) are compared once, and only those that agree in one of so many parts that near-equal ones
    must; what cels a near pair of buffers stands for is a running value along the cels, so cels are
    never paired with each other.
    """
    _, _, percent, _ = PROFILES[profile]
    keys = [*LAYER, "width", "height", "x", "y"]
    sound = cels.where(F.length("pixels") == F.col("width").cast("bigint") * F.col("height") * 4).select(*keys, "cel_id", "pixels", F.sha2("pixels", 256).alias("content"))
    contents = sound.groupBy(*keys, "content").agg(F.any_value("pixels").alias("pixels"))
    parts = contents.select(*keys, "content", F.posexplode(_segments(percent)).alias("part", "hash"))
    pairs = (
        parts.withColumnRenamed("content", "one")
        .join(parts.withColumnRenamed("content", "two"), [*keys, "part", "hash"])
        .where("one < two")
        .select(*keys, "one", "two")
        .distinct()
    )
    side = lambda name: contents.select(*keys, F.col("content").alias(name), F.col("pixels").alias(f"{name}_pixels"))
    both = pairs.join(side("one"), [*keys, "one"]).join(side("two"), [*keys, "two"])
    near = both.where(nearly_equal(F.col("one_pixels"), F.col("two_pixels"), F.col("width"), F.col("height"), profile)).select(*keys, "one", "two")
    ways = near.unionByName(near.select(*keys, F.col("two").alias("one"), F.col("one").alias("two")))
    named = sound.select(*keys, "cel_id", "content")
    given = named.withColumnRenamed("content", "one").join(ways, [*keys, "one"]).select(*keys, "two", "cel_id", F.col("cel_id").alias("given"))
    asked = named.withColumnRenamed("content", "two").select(*keys, "two", "cel_id", F.lit(None).cast("bigint").alias("given"))
    before = Window.partitionBy(*keys, "two").orderBy("cel_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = given.unionByName(asked.join(ways.select(*keys, "two").distinct(), [*keys, "two"], "left_semi")).withColumn("representative", F.last("given", ignorenulls=True).over(before))
    return placed.where("given IS NULL AND representative IS NOT NULL").select("cel_id", "representative")


def resolved_pixels(cels: DataFrame, profile: str = "conservative") -> DataFrame:
    """Cels as they are written: without faint specks, and with the buffer of their representative (PIX-07).

    Representatives are found among the repaired buffers, so cels that are alike once their specks
    are gone share one; one hop: the representative's own repaired buffer counts.
    """
    clean = specks(F.col("pixels"), F.col("width"), F.col("height"), profile)
    repaired = cels.withColumn("pixels", F.coalesce(clean.pixels, F.col("pixels")))
    repaired = materialize(repaired, "repaired")
    hops = colour_representatives(repaired, profile)
    target = repaired.select(F.col("cel_id").alias("representative"), F.col("pixels").alias("shared"))
    joined = repaired.join(hops, "cel_id", "left").join(target, "representative", "left")
    return joined.select("cel_id", "width", "height", "representative", F.coalesce("shared", "pixels").alias("pixels"))


def omitted_layers(layers: DataFrame, cels: DataFrame) -> DataFrame:
    """Drawing layers that no cel shows."""
    return layers.where("kind <> 'group'").join(cels, LAYER, "left_anti").select(*LAYER).distinct()
