import random

import numpy as np
import pytest

from stratacel.sources import psd_writer as W
from stratacel.sources.psd import Damaged, scan


def made(rng, depth=0):
    nodes = []
    for _ in range(rng.randrange(0 if depth else 1, 4)):
        head = {"name": rng.choice(["a", "Ebene ü", "测试层", "", "x" * 300]), "id": rng.randrange(1, 1 << 31), "opacity": rng.randrange(256), "blend": rng.choice(list(W.BLEND_KEYS)), "hidden": rng.random() < 0.3}
        if rng.random() < 0.2:
            head["marker"] = tuple(rng.randrange(9) for _ in range(5))
        if depth < 3 and rng.random() < 0.4:
            nodes.append(head | {"children": made(rng, depth + 1)})
        else:
            w, h = rng.randrange(0, 5), rng.randrange(0, 5)
            nodes.append(head | {"x": rng.randrange(-4, 9), "y": rng.randrange(-4, 9), "width": w, "height": h, "pixels": rng.randbytes(w * h * 4)})
    return nodes


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("seed", range(12))
def test_what_is_written_is_read_back(seed, wide):
    nodes = made(random.Random(seed))
    data = W.encode(9, 7, nodes, wide)
    out = W.read_tree(data)
    assert (out["width"], out["height"], out["nodes"]) == (9, 7, nodes)
    assert out["composite"] == W.composite_of(9, 7, nodes).tobytes()
    assert not [f for tag, *_, f in scan(data) if tag == "error"]


def test_composite_by_hand():
    layer = lambda colour, **k: {"name": "", "id": 1, "x": 0, "y": 0, "width": 1, "height": 1, "pixels": bytes(colour)} | k
    image = lambda *n: W.composite_of(1, 1, n).reshape(-1).tolist()
    assert image(layer([200, 100, 0, 255])) == [200, 100, 0, 255]
    assert image(layer([200, 100, 0, 255]), layer([0, 0, 100, 255], opacity=51)) == [160, 80, 20, 255]
    assert image(layer([200, 100, 0, 255], hidden=True)) == [0, 0, 0, 0]
    assert image(layer([10, 20, 30, 128]), {"name": "g", "id": 2, "children": []}) == [10, 20, 30, 128]


def test_what_the_format_cannot_hold():
    for width, height in ((0, 5), (30_001, 1)):
        with pytest.raises(ValueError):
            W.encode(width, height, [])
    with pytest.raises(ValueError):
        W.encode(1, 1, [{"name": "", "id": 1, "x": 0, "y": 0, "width": 2, "height": 2, "pixels": b"short"}])
    with pytest.raises(Damaged):
        W.read_tree(W.encode(2, 2, [])[:40])


def test_frame_first_files(spark):
    documents = spark.createDataFrame([("d", 4, 4), ("e", 0, 1), ("f", 1, 1)], "doc_id string, width bigint, height bigint")
    layers = spark.createDataFrame([("d", 1, "a", "screen", True), ("d", 2, None, None, None)], "doc_id string, source_layer_id bigint, name string, blend_mode string, visible boolean")
    px = np.arange(8, dtype=np.uint8).tobytes()
    rows = [("d", f, l, x, 0, 9, 2, 1, px) for f, l, x in ((0, 1, 0), (1, 1, 0), (2, 1, 1), (2, 2, 3))] + [("d", 3, 9, 0, 0, 1, 2, 1, px), ("d", 3, 1, 0, 0, 1, 2, 1, b"odd")]
    cels = spark.createDataFrame(rows, "doc_id string, frame_index int, source_layer_id bigint, x int, y int, opacity int, width int, height int, pixels binary")
    encoded = W.encode_documents(documents, layers, cels, "frames")
    out = {r.doc_id: r for r in encoded.collect()}
    assert (out["d"].frames, out["d"].groups, out["d"].records) == (3, 2, 7) and out["e"].problem == "a canvas of 0 x 1" and out["f"].groups == 0
    got = sorted((r.parent, r.ordinal, r.name, r.hidden, r.x, r.width) for r in W.decode_drawings(encoded).collect())
    assert got == [("Frame 0", 0, "a", False, 0, 2), ("Frame 2", 0, "a", False, 1, 2), ("Frame 2", 1, "", True, 3, 2)]
    by_state = W.encode_documents(documents, layers, cels, "states")
    assert {(r.doc_id, r.groups, r.records) for r in by_state.collect()} == {("d", 1, 5), ("e", 0, 0), ("f", 0, 0)}
    got = sorted((r.parent or "", r.name, r.hidden, r.x) for r in W.decode_drawings(by_state).collect())
    assert got == [("", "", True, 3), ("a", "State 1", False, 0), ("a", "State 2", True, 1)]
    assert W.encode_documents(documents.limit(0), layers.limit(0), cels.limit(0), "states").count() == 0
    names = spark.createDataFrame([("State 12",), ("State x",), ("Statement",), (None,)], "name string")
    assert [r[0] for r in names.select(W.state_number(names.name)).collect()] == [12, None, None, None]
