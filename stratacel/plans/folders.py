"""Candidate folders: uncertain tracks put beside the confirmed track that they may belong to.

Everything is joins on a document's tracks: an anchor is sought by name family, then by the order
beside the nearest confirmed tracks, then by likeness to confirmed tracks at most three places off,
the only ones whose likeness can suffice; so tracks are never paired with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacel.functions.columns import geometry_score
from stratacel.operators.groups import track_relations
from stratacel.session import checkpoint

DOC = "doc_id"
#: Likeness by distance of places, the reach it has, and the least that makes an anchor (fixed values).
ADJACENCY, REACH, LEAST = {0: 50, 1: 40, 2: 30, 3: 20}, 3, 50


def track_certainty(tracks: DataFrame, decisions: DataFrame) -> DataFrame:
    """The tracks with confirmed and uncertain (FLT-17); a track can be both or neither.

    tracks: doc_id, track, base, generic, suffixes; decisions: doc_id, track, status (strong,
    ambiguous, new or another).
    """
    own = decisions.groupBy(DOC, "track").agg(F.bool_or(F.col("status") == "strong").alias("strong"), F.bool_or(F.col("status").isin("ambiguous", "new")).alias("unsure"))
    plain = ~F.col("generic") & (F.col("suffixes") == 0)
    joined = tracks.join(own, [DOC, "track"], "left")
    return joined.select(
        *tracks.columns, (plain & F.coalesce("strong", F.lit(False))).alias("confirmed"), (~plain | F.coalesce("unsure", F.lit(False))).alias("uncertain")
    )


def _family(known: DataFrame) -> DataFrame:
    """The one confirmed track of the same base name."""
    one = known.where("uncertain AND NOT generic").select(DOC, "track", "base")
    other = known.where("confirmed").select(DOC, F.col("track").alias("anchor"), "base")
    found = one.join(other, [DOC, "base"]).groupBy(DOC, "track").agg(F.count("*").alias("n"), F.min("anchor").alias("anchor"))
    return found.where("n = 1").select(DOC, "track", "anchor")


def _boundary(known: DataFrame, cels: DataFrame) -> DataFrame:
    """The next confirmed track, if what is seen lies after the one before only, or the reverse."""
    sure = F.when(F.col("confirmed"), F.col("track"))
    before = Window.partitionBy(DOC).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(DOC).orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    around = known.select(DOC, "track", "uncertain", F.last(sure, ignorenulls=True).over(before).alias("previous"), F.last(sure, ignorenulls=True).over(after).alias("next"))
    around = around.where("uncertain AND previous IS NOT NULL AND next IS NOT NULL").select(DOC, "track", "previous", "next")
    orders = cels.groupBy(DOC, "track", "frame").agg(F.min("order").alias("low"), F.max("order").alias("high"))
    mine = around.join(orders, [DOC, "track"])
    beside = lambda side, name: orders.select(DOC, F.col("track").alias(side), "frame", F.col(name).alias(f"{side}_{name}"))
    seen = mine.join(beside("previous", "low"), [DOC, "previous", "frame"], "left").join(beside("next", "high"), [DOC, "next", "frame"], "left")
    flags = seen.groupBy(DOC, "track", "previous", "next").agg(
        F.coalesce(F.bool_or(F.col("high") > F.col("previous_low")), F.lit(False)).alias("after"),
        F.coalesce(F.bool_or(F.col("low") < F.col("next_high")), F.lit(False)).alias("before"),
    )
    return flags.where("after <> before").select(DOC, "track", F.when(F.col("after"), F.col("next")).otherwise(F.col("previous")).alias("anchor"))


def _affinity(known: DataFrame, cels: DataFrame) -> DataFrame:
    """The confirmed track of most likeness by place, geometry and order in common frames, if that suffices."""
    one = known.where("uncertain").select(DOC, "track", F.col("place").alias("own"), F.explode(F.sequence(F.col("place") - REACH, F.col("place") + REACH)).alias("place"))
    other = known.where("confirmed").select(DOC, F.col("track").alias("anchor"), "place")
    near = one.join(other, [DOC, "place"]).select(DOC, "track", "anchor", F.abs(F.col("own") - F.col("place")).alias("apart"))
    boxes = cels.select(DOC, "track", "x", "y", "width", "height").distinct()
    left = near.join(boxes, [DOC, "track"])
    right = boxes.select(DOC, F.col("track").alias("anchor"), *[F.col(c).alias(f"{c}2") for c in ("x", "y", "width", "height")])
    likeness = geometry_score(*[F.col(c) for c in ("width", "height", "x", "y", "width2", "height2", "x2", "y2")])
    geometry = left.join(right, [DOC, "anchor"]).groupBy(DOC, "track", "anchor").agg(F.max(likeness).alias("geometry"))
    orders = cels.select(DOC, "track", "frame", "order").distinct()
    there = orders.select(DOC, F.col("track").alias("anchor"), "frame", F.col("order").alias("order2"))
    close = F.lit(15) - F.least(F.abs(F.col("order") - F.col("order2")), F.lit(7)) * 2
    common = near.join(orders, [DOC, "track"]).join(there, [DOC, "anchor", "frame"]).groupBy(DOC, "track", "anchor").agg(F.max(close).alias("close"))
    adjacency = F.element_at(F.create_map(*[F.lit(x).cast("int") for pair in ADJACENCY.items() for x in pair]), F.col("apart").cast("int"))
    scored = near.join(geometry, [DOC, "track", "anchor"], "left").join(common, [DOC, "track", "anchor"], "left").select(
        DOC, "track", "anchor", F.least(F.lit(100), adjacency + F.coalesce("geometry", F.lit(0)) + F.coalesce("close", F.lit(0))).alias("score")
    )
    best = scored.groupBy(DOC, "track").agg(F.max(F.struct("score", -F.col("anchor"))).alias("best"), F.max_by("anchor", F.struct("score", -F.col("anchor"))).alias("anchor"))
    return best.where(F.col("best.score") >= LEAST).select(DOC, "track", "anchor")


def candidate_folders(tracks: DataFrame, cels: DataFrame, decisions: DataFrame, selectors: DataFrame, flat: bool = False) -> DataFrame:
    """One row per proposed folder: doc_id, anchor, members (in order), complete, emitted, reason (SLV-07).

    tracks: doc_id, track, base, generic, suffixes, place (dense, the stable order); cels: doc_id,
    track, frame, order, x, y, width, height, selector; decisions as in ``track_certainty``;
    selectors as in ``track_relations``. A folder holds its anchor and the uncertain tracks that
    exclude it structurally; it is emitted where no two members show in one frame and the members
    fill their interval of the order. A track without an anchor is a proposal of its own.
    """
    known = checkpoint(track_certainty(tracks, decisions))
    ways = None
    for rank, found in enumerate((_family(known), _boundary(known, cels), _affinity(known, cels))):
        own = found.withColumn("way", F.lit(rank))
        ways = own if ways is None else ways.unionByName(own)
    chosen = ways.groupBy(DOC, "track").agg(F.min_by("anchor", "way").alias("anchor"))
    picked = checkpoint(known.where("uncertain").select(DOC, "track").join(chosen, [DOC, "track"], "left"))
    pairs = picked.where("anchor IS NOT NULL").select(DOC, F.col("anchor").alias("a"), F.col("track").alias("b"))
    seen = cels.select(DOC, "track", F.col("frame").alias("frame_index"), "selector")
    related = checkpoint(track_relations(pairs, seen, selectors).select(DOC, F.col("a").alias("anchor"), F.col("b").alias("track"), "relation"))
    held = related.where("relation = 'structural'")
    places = tracks.select(DOC, "track", "place")
    alone = picked.where("anchor IS NULL").select(DOC, F.col("track").alias("anchor"), "track", F.lit("no anchor").alias("reason"))
    refused = related.where("relation <> 'structural'").select(DOC, "anchor", "track", "relation")
    refused = refused.select(DOC, "anchor", F.explode(F.array_distinct(F.array("anchor", "track"))).alias("member"), F.col("track").alias("of"), F.col("relation").alias("reason"))
    single = alone.select(DOC, "anchor", F.col("track").alias("member"), F.col("track").alias("of"), "reason")
    folder = held.select(DOC, "anchor", F.explode(F.array_distinct(F.array("anchor", "track"))).alias("member")).distinct()
    every = refused.unionByName(single).unionByName(folder.select(DOC, "anchor", "member", F.lit(-1).cast(folder.schema["member"].dataType).alias("of"), F.lit(None).cast("string").alias("reason")))
    listed = every.join(places.withColumnRenamed("track", "member"), [DOC, "member"]).groupBy(DOC, "anchor", "of").agg(
        F.max("reason").alias("reason"), F.transform(F.array_sort(F.collect_list(F.struct("place", "member"))), lambda x: x.member).alias("members"),  # a document's tracks at most
        (F.max("place") - F.min("place") + 1 == F.count("*")).alias("complete"),
    )
    frames = folder.join(cels.select(DOC, F.col("track").alias("member"), "frame").distinct(), [DOC, "member"]).groupBy(DOC, "anchor", "frame").agg(F.count("*").alias("n"))
    shown = frames.where("n > 1").select(DOC, "anchor").distinct().withColumn("together", F.lit(True))
    out = listed.join(shown, [DOC, "anchor"], "left")
    reason: Column = (
        F.when(F.col("of") != -1, F.col("reason")).when(F.col("together"), "members show together").when(~F.col("complete"), "incomplete interval").when(F.lit(flat), "flat")
    )
    return out.select(DOC, "anchor", "members", F.when((F.col("of") == -1) | (F.col("reason") != "no anchor"), F.col("complete")).otherwise(False).alias("complete"), reason.isNull().alias("emitted"), reason.alias("reason"))


def folder_paths(folders: DataFrame) -> DataFrame:
    """doc_id, track, folder: the folder of each track that lies in an emitted one."""
    return folders.where("emitted").select(DOC, F.explode("members").alias("track"), F.col("anchor").alias("folder"))


def folder_problems(folders: DataFrame, paths: DataFrame) -> DataFrame:
    """Emitted folders that aren't there once with exactly their members, and paths into no folder (VAL-06)."""
    wanted = folders.where("emitted").groupBy(DOC, F.col("anchor").alias("folder")).agg(F.count("*").alias("times"), F.sort_array(F.first("members")).alias("wanted"))
    got = paths.groupBy(DOC, "folder").agg(F.sort_array(F.collect_list("track")).alias("got"))
    both = wanted.join(got, [DOC, "folder"], "full_outer")
    return both.where("times IS NULL OR times <> 1 OR got IS NULL OR wanted <> got").select(DOC, "folder")
