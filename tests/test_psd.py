import json
import struct

import pytest

from stratacel.sources.psd import Damaged, blocks_of, gaps_in_sections, head_size, read_documents, scan, to_json


def block(key, body, wide=False, signature=b"8BIM"):
    size = struct.pack(">Q" if wide else ">I", len(body))
    return signature + key + size + body + b"\0" * (len(body) % 2)


def uni(text):
    return struct.pack(">I", len(text)) + text.encode("utf-16-be")


def key(name):
    return struct.pack(">I", 0) + name if len(name) == 4 else struct.pack(">I", len(name)) + name


def desc(**items):
    out = uni("") + key(b"null") + struct.pack(">I", len(items))
    for name, value in items.items():
        out += key(name.encode()) + value
    return out


def record(name, box, extra=b"", wide=False, hidden=False):
    channels = b"".join(struct.pack(">h" + ("Q" if wide else "I"), c, 2) for c in (-1, 0, 1, 2))
    raw = name.encode("latin-1", "replace")
    pascal = bytes([len(raw)]) + raw + b"\0" * (-(len(raw) + 1) % 4)
    body = struct.pack(">II", 0, 0) + pascal + extra
    return struct.pack(">4iH", *box, 4) + channels + b"8BIMnorm" + bytes([200, 0, 2 if hidden else 0, 0]) + struct.pack(">I", len(body)) + body


def document(records=(), resources=b"", wide=False, depth=8):
    head = b"8BPS" + struct.pack(">H6xHIIHH", 2 if wide else 1, 3, 64, 32, depth, 3)
    size = ">Q" if wide else ">I"
    layers = struct.pack(">h", len(records)) + b"".join(records)
    info = struct.pack(size, len(layers)) + layers
    return head + struct.pack(">I", 0) + struct.pack(">I", len(resources)) + resources + struct.pack(size, len(info)) + info + b"\0\0"


def resource(number, body):
    return b"8BIM" + struct.pack(">H", number) + b"\0\0" + struct.pack(">I", len(body)) + body + b"\0" * (len(body) % 2)


@pytest.mark.parametrize("wide", [False, True])
def test_layers_and_markers(wide):
    marker = struct.pack(">5I", 1, 2, 7, 1, 3)
    extra = block(b"luni", uni("Ebene ü")) + block(b"lyid", struct.pack(">I", 42)) + block(b"p2rt", marker) + block(b"p2rt", b"bad!")
    out = scan(document([record("x", (1, 2, 11, 22), extra, wide), record("y", (0, 0, 0, 0), b"", wide, True)], wide=wide))
    by = lambda tag: [f for t, *_, f in out if t == tag]
    assert not by("error")
    assert by("header")[0] | {"version": 0} == {"version": 0, "channels": 3, "width": 32, "height": 64, "bits_per_channel": 8, "color_mode": "rgb"}
    assert [(r["name"], r.get("layer_id"), r["hidden"], r["right"]) for r in by("layer")] == [("Ebene ü", 42, False, 22), ("y", None, True, 0)]
    assert [m["variant_count"] for m in by("marker")] == [3, 0] and by("marker")[0]["logical_layer_id"] == 7
    assert not [t for t, *_ in scan(document([record("x", (0, 0, 1, 1), b"", wide)], wide=wide), headers_only=True) if t == "layer"]


def test_animation_descriptor():
    frames = b"VlLs" + struct.pack(">I", 1) + b"Objc" + desc(FrID=b"long" + struct.pack(">i", 5), FrDl=b"doub" + struct.pack(">d", 1.5), FrVs=b"bool\1", FrTx=b"TEXT" + uni("t"), FrEn=b"enum" + key(b"aaaa") + key(b"Disp"))
    ands = struct.pack(">I", 16) + desc(FrIn=frames)
    body = b"8BIMAnDs" + struct.pack(">I", len(ands)) + ands
    out = scan(document(resources=resource(4000, b"maniIRFR" + struct.pack(">I", len(body)) + body) + resource(1060, b"odd")))
    found = [f for t, *_, f in out if t == "resource"]
    assert [f["animation"] for f in found] == [True, False]
    assert found[0]["subresources"][0]["descriptor"]["FrIn"] == [{"FrID": 5, "FrDl": 1.5, "FrVs": True, "FrTx": "t", "FrEn": {"type": "aaaa", "value": "Disp"}}]


@pytest.mark.parametrize("data,message", [
    (b"", "wanted"), (b"8BPX" + b"\0" * 40, "not a layered"), (document(depth=5), "bits"), (document()[:30], "wanted"),
    (document([record("x", (9, 0, 1, 1))]), "reversed"), (document(resources=b"nope" + b"\0" * 20), "signature"),
])
def test_damage_becomes_a_row(data, message):
    out = scan(data)
    assert out[-1][0] == "error" and message in out[-1][-1]["message"]


def test_folder(spark, tmp_path):
    (tmp_path / "a.psd").write_bytes(document([record("x", (0, 0, 1, 1))]))
    (tmp_path / "b.psd").write_bytes(b"broken")
    blocks = read_documents(spark, str(tmp_path))
    tags = {(r.path[-5:], r.tag): r.n for r in blocks.groupBy("path", "tag").count().withColumnRenamed("count", "n").collect()}
    assert tags["a.psd", "layer"] == 1 and tags["b.psd", "error"] == 1 and tags["a.psd", "section"] == 4
    assert json.loads(blocks.where("tag = 'layer'").first().fields)["name"] == "x"
    assert gaps_in_sections(blocks).where("next_start - end > 8 OR next_start < end").count() == 0
    assert issubclass(Damaged, ValueError)


def test_deep_descriptors(spark):
    depth = 5000
    deep = desc(a=b"long" + struct.pack(">i", 7))
    for k in range(depth):
        deep = desc(a=b"Objc" + deep) if k % 2 else desc(a=b"VlLs" + struct.pack(">I", 1) + b"Objc" + deep)
    ands = struct.pack(">I", 16) + deep
    body = b"8BIMAnDs" + struct.pack(">I", len(ands)) + ands
    data = document(resources=resource(4000, b"maniIRFR" + struct.pack(">I", len(body)) + body))
    assert not [f for t, *_, f in scan(data) if t == "error"]
    blocks = blocks_of(spark.createDataFrame([("x", data)], "path string, content binary"))
    text = blocks.where("tag = 'resource'").first().fields
    assert text.count('"a"') == depth + 1 and '{"a": 7}' in text
    assert json.loads(to_json({"a": [1, {"b": None}], "c": {}, "d": []})) == {"a": [1, {"b": None}], "c": {}, "d": []}


@pytest.mark.parametrize("wide", [False, True])
def test_heads_are_read_without_the_rest(spark, tmp_path, wide):
    data = document([record("x", (0, 0, 1, 1), b"", wide)] * 50, resources=resource(1060, b"odd"), wide=wide)
    (tmp_path / "a b.psd").write_bytes(data)
    (tmp_path / "short.psd").write_bytes(data[:40])
    heads = {(r.path[-5:], r.tag, r.ordinal): (r.start, r.end) for r in read_documents(spark, str(tmp_path), headers_only=True).collect()}
    all_of = {(r.path[-5:], r.tag, r.ordinal): (r.start, r.end) for r in read_documents(spark, str(tmp_path)).where("tag <> 'layer'").collect()}
    assert heads == all_of and ("b.psd", "section", 2) in heads and {k[0] for k in heads if k[1] == "error"} == {"t.psd"}
    read = []
    size = head_size(lambda start, count: read.append((start, count)) or data[start : start + count])
    assert size < 100 and sum(n for _, n in read) == 10
