import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacel.functions import binary as B
from stratacel.operators import groups as G
from stratacel.operators import hierarchy as H

LAYER = "doc_id string, layer_id bigint, parent_id bigint, kind string, ordinal int, name string"


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_nodes_at_depth(spark):
    layers = df(spark, [("d", 1, None, "group", 0, "top"), ("d", 2, 1, "group", 0, ""), ("d", 3, 2, "pixel", 0, "x"), ("d", 4, 1, "pixel", 1, "y")], LAYER)
    flat = H.flatten(layers, "layer_id", "parent_id", "ordinal")
    at = lambda n: {(r.layer_id, r.group_name) for r in G.nodes_at_depth(flat, layers, n).collect()}
    assert at(0) == {(1, "")} and at(1) == {(2, "top"), (4, "top")} and at(2) == {(3, "top / <unnamed>")}


def test_selectors_and_relations(spark):
    layers = df(spark, [("d", i, p, "group", i, "g") for i, p in ((1, None), (2, None), (3, 1), (4, 1), (5, None))], LAYER)
    activity = df(spark, [("d", 1, 0), ("d", 2, 1), ("d", 3, 0), ("d", 4, 0)], "doc_id string, layer_id bigint, frame_index int")
    selectors = G.selector_groups(layers, activity)
    assert {r.layer_id for r in selectors.collect()} == {1, 2, 5}
    cels = df(spark, [("d", 10, 0, 1), ("d", 11, 1, 2), ("d", 12, 0, None), ("d", 13, 1, 2)], "doc_id string, track int, frame_index int, selector bigint")
    pairs = df(spark, [("d", 10, 11), ("d", 10, 12), ("d", 11, 13), ("d", 11, 12)], "doc_id string, a int, b int")
    out = {(r.a, r.b): r.relation for r in G.track_relations(pairs, cels, selectors).collect()}
    assert out == {(10, 11): "structural", (10, 12): "co_visible", (11, 13): "co_visible", (11, 12): "observed_disjoint"}


def test_merge_candidates_owners_and_zip(spark):
    tracks = df(spark, [("d", 1, ["a"], "x", False), ("d", 2, ["a"], "x", False), ("d", 3, [], "x", True), ("d", 4, ["b"], "x", False)], "doc_id string, track int, features array<string>, name string, generic boolean")
    assert {tuple(r)[1:] for r in G.merge_candidates(tracks).collect()} == {(1, 2, 0), (1, 4, 1), (2, 4, 1)}
    states = df(spark, [("d", "s1", 0, 0, True), ("d", "s2", 1, 0, True), ("d", "s2", 1, 1, True)], "doc_id string, state string, ordinal int, frame_index int, enabled boolean")
    frames = df(spark, [("d", 0), ("d", 1)], "doc_id string, frame_index int")
    assert [r.state for r in G.frame_owners(states, frames).orderBy("frame_index").collect()] == ["s1", "s2"]
    with pytest.raises(Exception, match="no state in frame 7"):
        G.frame_owners(states, df(spark, [("d", 7)], "doc_id string, frame_index int")).collect()
    nodes = df(spark, [("d", f, p, n) for f, p, n in ((0, "0", "a"), (1, "0", "a"), (0, "1", "b"), (1, "1", "c"), (0, "2", "e"))], "doc_id string, frame_index int, path string, name string")
    assert {r.path: r.matched for r in G.zip_frame_groups(nodes, F.lit(2)).collect()} == {"0": True, "1": False, "2": False}


def test_wrappers_clipping_and_summaries(spark):
    rows = [("d", 1, 3, "pixel", 0, "w"), ("d", 2, 3, "pixel", 1, "w"), ("d", 3, None, "group", 0, "w"), ("d", 5, 6, "pixel", 0, "v"), ("d", 6, None, "group", 0, "w")]
    layers = df(spark, rows, LAYER)
    activity = df(spark, [("d", 1, 0), ("d", 2, 1), ("d", 5, 0)], "doc_id string, layer_id bigint, frame_index int")
    assert {r.layer_id for r in G.cel_wrappers(layers, activity).collect()} == {3}
    assert G.cel_wrappers(layers, activity.unionByName(df(spark, [("d", 2, 0)], "doc_id string, layer_id bigint, frame_index int"))).count() == 0
    with pytest.raises(Exception, match="clipping layer 2"):
        G.reject_clipping(layers.withColumn("clipping", F.col("layer_id") == 2)).collect()
    assert G.reject_clipping(layers.withColumn("clipping", F.lit(None).cast("boolean"))).count() == 5
    members = df(spark, [("d", "n", "f"), ("d", "n", "f"), ("d", "m", "f"), ("d", "m", None)], "doc_id string, node string, feature string")
    assert {r.node: r.pure for r in G.feature_summary(members).collect()} == {"n": True, "m": False}
    assert G.first_free_id(layers).first().first_free == 7
    assert G.static_states(layers.withColumn("hidden", F.col("layer_id") == 1)).where("enabled").count() == 4
    assert [r.e for r in df(spark, [(1.0, "normal"), (None, None), (0.5, "normal"), (1.0, "screen")], "o double, b string").select(G.has_effect(F.col("o"), F.col("b")).alias("e")).collect()] == [False, False, True, True]


def png(pixels, kinds, colour):
    height, width, step = pixels.shape
    lines, above = b"", np.zeros((width, step), dtype=int)
    for y in range(height):
        now = pixels[y].astype(int)
        left = np.vstack([np.zeros((1, step), dtype=int), now[:-1]])
        corner = np.vstack([np.zeros((1, step), dtype=int), above[:-1]])
        kind = kinds[y % len(kinds)]
        p = left + above - corner
        da, db, dc = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        lines += bytes([kind]) + ((now - guess) & 255).astype(np.uint8).tobytes()
        above = now
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return B.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,step", [(2, 3), (6, 4)])
def test_png_filters(colour, step):
    pixels = np.random.default_rng(1).integers(0, 256, (10, 6, step), dtype=np.uint8)
    width, height, data = B.decode_png(png(pixels, [0, 1, 2, 3, 4], colour))
    got = np.frombuffer(data, dtype=np.uint8).reshape(height, width, 4)
    assert np.array_equal(got[..., :step], pixels) and (step == 4 or (got[..., 3] == 255).all())
    with pytest.raises(ValueError):
        B.decode_png(b"nothing")


def test_zlib_and_json(spark):
    good = zlib.compress(b"abc")
    assert B.zlib_problem(good, 3) is None and "instead" in B.zlib_problem(good, 4)
    assert B.zlib_problem(good[:-2]) == "cut short" and "after the end" in B.zlib_problem(good + b"x") and B.zlib_problem(b"zz") and B.zlib_problem(None) == "missing"
    value = {"a": [{"k": 1, "b": {"k": [2, {"k": 3}]}}], "k": None}
    assert B.values_of(value, "k") == [None, 1, [2, {"k": 3}], 3]
    rows = [(json.dumps(value),), ("broken",), (None,)]
    out = df(spark, rows, "t string").select(B.normalised_json(F.col("t"), ["k"]).alias("n"), B.key_values(F.col("t"), "k").alias("v")).collect()
    assert out[0].n == '{"a":[{"b":{}}]}' and len(out[0].v) == 4 and [tuple(r) for r in out[1:]] == [(None, None)] * 2
