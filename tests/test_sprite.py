import random
import struct
import zlib

import pytest

from stratacel.sources import sprite as S


def made(seed):
    rng = random.Random(seed)
    layers = [{"name": rng.choice(["a", "Ebene ü", ""]), "group": rng.random() < 0.2, "level": rng.randrange(3), "visible": rng.random() < 0.5, "opacity": rng.randrange(256), "blend": rng.choice(list(S.BLEND_NUMBERS))} for _ in range(rng.randrange(1, 5))]
    durations = [rng.randrange(1, 999) for _ in range(rng.randrange(1, 6))]
    cels = []
    for f in range(len(durations)):
        for k in range(len(layers)):
            if rng.random() < 0.7:
                w, h = rng.randrange(1, 5), rng.randrange(1, 5)
                cel = {"frame": f, "layer": k, "x": rng.randrange(-9, 9), "y": 3, "opacity": rng.randrange(256), "z": rng.randrange(-3, 3), "link": None, "width": w, "height": h, "pixels": rng.randbytes(w * h * 4)}
                earlier = [c["frame"] for c in cels if c["layer"] == k]
                if earlier and rng.random() < 0.4:
                    cel |= {"link": rng.choice(earlier), "width": None, "height": None, "pixels": None}
                cels.append(cel)
    tags = [{"first": 0, "last": len(durations) - 1, "direction": rng.choice(S.DIRECTIONS), "repeat": rng.randrange(4), "name": "t"}]
    return durations, layers, cels, tags


@pytest.mark.parametrize("seed", range(30))
def test_exact_round_trip(seed):
    durations, layers, cels, tags = made(seed)
    out = S.decode(S.encode(30, 20, durations, layers, cels, tags))
    assert (out["width"], out["height"], out["durations"], out["layers"], out["cels"], out["tags"]) == (30, 20, durations, layers, cels, tags)


@pytest.mark.parametrize("seed", range(5))
def test_damage_is_found(seed):
    data = S.encode(9, 9, *made(seed))
    for bad in (data[:-1], data[:100], b"", b"\0" * 200, data + b"x", data[:4] + b"\0\0" + data[6:]):
        with pytest.raises(S.Damaged):
            S.decode(bad)


def test_raw_cels_palette_links_and_flattened():
    layer = S._chunk(S.LAYER, struct.pack("<6HB3x", 1, 0, 0, 0, 0, 0, 255) + S._string("l"))
    raw = S._chunk(S.CEL, struct.pack("<HhhBHh5x", 0, 1, 2, 200, S.RAW, 0) + struct.pack("<HH", 1, 1) + b"abcd")
    palette = S._chunk(S.PALETTE, struct.pack("<III8x", 2, 0, 1) + struct.pack("<H4B", 0, 1, 2, 3, 4) + struct.pack("<H4B", 1, 5, 6, 7, 8) + S._string("n"))
    link = S._chunk(S.CEL, struct.pack("<HhhBHh5x", 0, 5, 6, 90, S.LINKED, 0) + struct.pack("<H", 0))
    frame = lambda *c: struct.pack("<IHHH2xI", sum(map(len, c)) + 16, S.FRAME_MAGIC, len(c), 7, len(c)) + b"".join(c)
    body = frame(layer, palette, raw) + frame(link)
    data = struct.pack("<IHHHHHIH8xB3xHBBhhHH84x", len(body) + 128, S.MAGIC, 2, 4, 4, 32, 1, 100, 0, 0, 1, 1, 0, 0, 16, 16) + body
    out = S.decode(data)
    assert out["palette"] == {0: (1, 2, 3, 4), 1: (5, 6, 7, 8)} and out["durations"] == [7, 7]
    followed = S.shown(out)
    assert [(c["x"], c["opacity"], c["pixels"]) for c in followed] == [(1, 200, b"abcd"), (5, 90, b"abcd")]
    assert set(S.flattened_frames(out)) == {0, 1}
    with pytest.raises(S.Damaged):
        S.flattened_frames(out | {"cels": out["cels"] * 2})
    assert zlib.decompress(zlib.compress(b"")) == b""


LAYERS = "doc_id string, source_layer_id bigint, parent_layer_id bigint, child_ordinal int, name string, kind string, visible boolean, opacity int, blend_mode string"
DOCUMENT = "doc_id string, width bigint, height bigint, loop_tag string, loop_count bigint"
CELS = "doc_id string, frame_index int, source_layer_id bigint, x int, y int, opacity int, width int, height int, pixels binary"


def test_tables_to_files_and_back(spark):
    documents = spark.createDataFrame([("d", 30, 20, "finite", 3), ("e", 7, 5, None, None), ("f", 70_000, 5, None, None), ("g", 1, 1, "x", None), ("h", 1, None, None, None)], DOCUMENT)
    frames = spark.createDataFrame([("d", 0, 50), ("d", 1, None), ("e", 0, 10), ("f", 0, 10), ("g", 0, 70_000), ("h", 0, 1)], "doc_id string, frame_index int, duration_ms bigint")
    layers = spark.createDataFrame(
        [("d", 1, 3, 0, "a", "pixel", True, None, "screen"), ("d", 2, None, 1, None, "pixel", False, 9, None), ("d", 3, None, 0, "g", "group", True, 255, None), ("d", 4, 3, 1, "b", "pixel", True, 1, "normal"), ("d", 5, 99, 2, "o", "pixel", True, 1, "normal")], LAYERS
    )
    cels = spark.createDataFrame([("d", 0, 1, 1, 2, 255, 1, 1, b"abcd"), ("d", 1, 1, 3, 2, 255, 1, 1, b"abcd"), ("d", 1, 2, 0, 0, 7, 1, 2, b"abcdefgh"), ("d", 0, 2, 0, 0, 7, 1, 2, b"short"), ("d", 0, 2, 0, 0, 7, 1, 2, None)], CELS)
    encoded = S.encode_documents(documents, frames, layers, cels)
    rows = {r.doc_id: r for r in encoded.collect()}
    assert (rows["d"].layers, rows["d"].cels, rows["d"].linked) == (5, 3, 1) and rows["e"].cels == 0
    assert {k: r.problem for k, r in rows.items()} == {"d": None, "e": None, "f": "width 70000", "g": "frame 0 of 70000 ms", "h": "height None"} and rows["g"].content is None
    out = S.decode(bytes(rows["d"].content))
    assert (out["width"], out["height"], out["durations"]) == (30, 20, [50, 100])
    assert [(l["name"], l["level"], l["group"]) for l in out["layers"]] == [("g", 0, True), ("a", 1, False), ("b", 1, False), ("", 0, False), ("o", 0, False)]
    assert out["tags"] == [{"first": 0, "last": 1, "direction": "forward", "repeat": 3, "name": "finite"}]
    assert S.roundtrip_differences(documents, frames, cels, encoded).count() == 0
    other = documents.withColumn("width", documents.width + 1)
    assert [r.part for r in S.roundtrip_differences(other, frames, cels, encoded).collect()] == ["headers"] * 4
    empty = [x.limit(0) for x in (documents, frames, layers, cels)]
    assert S.encode_documents(*empty).count() == 0 and S.decode_documents(S.encode_documents(*empty), "cels").count() == 0


def test_layers_of_a_cycle_come_last():
    rows = [{"layer": k, "above": a, "place": 0} for k, a in ((1, 2), (2, 1), (3, None), (4, 3))]
    assert [(r["layer"], level) for r, level in S.tree_order(rows)] == [(3, 0), (4, 1), (1, 0), (2, 0)]
    deep = [{"layer": k, "above": k - 1 or None, "place": 0} for k in range(1, 5000)]
    assert S.tree_order(deep)[-1][1] == 4998


def test_files_of_planned_tracks(spark):
    documents = spark.createDataFrame([("d", 9, 9, None, None), ("e", 1, 1, None, None)], DOCUMENT)
    frames = spark.createDataFrame([("d", 0, 50), ("d", 1, 60), ("d", 2, 60), ("e", 0, 1)], "doc_id string, frame_index int, duration_ms bigint")
    cels = spark.createDataFrame([("d", 0, 1, 1, 2, 255, 1, 1, b"abcd"), ("d", 1, 7, 3, 2, 255, 1, 1, b"abcd"), ("d", 1, 2, 0, 0, 7, 1, 2, b"abcdefgh"), ("d", 2, 7, 3, 2, 255, 1, 1, b"abcd")], CELS)
    plan = spark.createDataFrame([("d", 0, 1, 0, 1, "a", 0), ("d", 1, 7, 0, 1, "a", -1), ("d", 1, 2, 4, 0, "b", 1), ("d", 2, 7, 0, 1, "a", 0)], "doc_id string, frame int, layer bigint, track int, track_place int, track_name string, z_index int")
    rows = {r.doc_id: r for r in S.encode_plans(documents, frames, plan, cels).collect()}
    assert (rows["d"].layers, rows["d"].cels, rows["d"].linked, rows["e"].layers) == (2, 4, 2, 0)
    out = S.decode(bytes(rows["d"].content))
    assert [l["name"] for l in out["layers"]] == ["b", "a"] and not S.link_problems(out)
    assert [(c["frame"], c["layer"], c["z"], c["link"]) for c in out["cels"]] == [(0, 1, 0, None), (1, 0, 1, None), (1, 1, -1, 0), (2, 1, 0, 0)]
    out["cels"][3]["link"] = 1
    assert S.link_problems(out) == ["layer 1 frame 2 links to 1"]


def test_planned_pixels_are_shuffled_once(spark):
    documents, frames, cels = (spark.createDataFrame([], s) for s in (DOCUMENT, "doc_id string, frame_index int, duration_ms bigint", CELS))
    plan = spark.createDataFrame([], "doc_id string, frame int, layer bigint, track int, track_place int, track_name string, z_index int")
    physical = S.encode_plans(documents, frames, plan, cels)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 2 and "Join" not in physical


def test_pixels_without_a_plan_are_left_out(spark):
    documents = spark.createDataFrame([("d", 9, 9, None, None)], DOCUMENT)
    frames = spark.createDataFrame([("d", 0, 50)], "doc_id string, frame_index int, duration_ms bigint")
    cels = spark.createDataFrame([(doc, 0, layer, 1, 2, 255, 1, 1, b"abcd") for doc, layer in (("d", 1), ("d", 2), ("x", 1))], CELS)
    plan = spark.createDataFrame([(doc, 0, layer, 0, 0, "a", 0) for doc, layer in (("d", 2), ("d", 3), ("y", 1))], "doc_id string, frame int, layer bigint, track int, track_place int, track_name string, z_index int")
    assert [(r.doc_id, r.layers, r.cels, r.problem) for r in S.encode_plans(documents, frames, plan, cels).collect()] == [("d", 1, 1, None)]
