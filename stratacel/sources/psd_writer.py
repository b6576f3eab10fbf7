"""Layered PSD documents (versions 1 and 2) from tables, and what a reader finds in them again.

Pixels are written raw, groups as pairs of a divider and a folder record, and the composite by
normal blending. ``read_tree`` gives back what ``encode`` was given, which is the check of a writer.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacel.sources.psd import MARKER_KEY, Damaged, Reader, _header, _length, _records
from stratacel.sources.sprite import sound_cels

#: Blend modes by their keys in the format (fixed values).
BLEND_KEYS = {
    "normal": b"norm", "pass through": b"pass", "dissolve": b"diss", "darken": b"dark", "multiply": b"mul ", "color burn": b"idiv", "linear burn": b"lbrn",
    "darker color": b"dkCl", "lighten": b"lite", "screen": b"scrn", "color dodge": b"div ", "linear dodge": b"lddg", "lighter color": b"lgCl", "overlay": b"over",
    "soft light": b"sLit", "hard light": b"hLit", "vivid light": b"vLit", "linear light": b"lLit", "pin light": b"pLit", "hard mix": b"hMix", "difference": b"diff",
    "exclusion": b"smud", "subtract": b"fsub", "divide": b"fdiv", "hue": b"hue ", "saturation": b"sat ", "color": b"colr", "luminosity": b"lum ",
}
#: Kinds of section records (fixed values): an open folder, and the divider below its content.
FOLDER, DIVIDER = 1, 3
#: Largest canvas side by version (fixed values).
LARGEST = {1: 30_000, 2: 300_000}


def _block(key: bytes, body: bytes) -> bytes:
    return b"8BIM" + key + struct.pack(">I", len(body)) + body + b"\0" * (len(body) % 2)


def _record(node: dict, section: int | None, wide: bool) -> tuple[bytes, bytes]:
    """A layer's record and the data of its channels."""
    width, height = node.get("width", 0), node.get("height", 0)
    pixels = node.get("pixels", b"")
    if len(pixels) != width * height * 4:
        raise ValueError(f"{len(pixels)} bytes for {width} x {height} pixels")
    planes = np.frombuffer(pixels, dtype=np.uint8).reshape(-1, 4)
    data = [b"\0\0" + planes[:, k].tobytes() for k in (3, 0, 1, 2)]
    channels = b"".join(struct.pack(">h" + ("Q" if wide else "I"), k, len(d)) for k, d in zip((-1, 0, 1, 2), data))
    name = node["name"]
    plain = name.encode("ascii", "replace")[:255]
    extra = struct.pack(">II", 0, 0) + bytes([len(plain)]) + plain + b"\0" * (-(len(plain) + 1) % 4)
    units = name.encode("utf-16-be")
    extra += _block(b"luni", struct.pack(">I", len(units) // 2) + units)
    if node.get("id") is not None:
        extra += _block(b"lyid", struct.pack(">I", node["id"]))
    if section is not None:
        extra += _block(b"lsct", struct.pack(">I", section))
    if node.get("marker"):
        extra += _block(MARKER_KEY, struct.pack(">5I", *node["marker"]))
    x, y = node.get("x", 0), node.get("y", 0)
    flags = 2 if node.get("hidden") else 0
    head = struct.pack(">4iH", y, x, y + height, x + width, 4) + channels
    head += b"8BIM" + BLEND_KEYS.get(node.get("blend") or "normal", b"norm") + bytes([node.get("opacity", 255), 0, flags, 0])
    return head + struct.pack(">I", len(extra)) + extra, b"".join(data)


def _in_file_order(nodes: Sequence[dict]) -> Iterator[tuple[dict, int | None]]:
    """Records from the bottom up: what a group holds stands between its divider and its folder."""
    stack: list[tuple[dict, bool]] = [(n, False) for n in reversed(nodes)]
    while stack:
        node, closing = stack.pop()
        if closing:
            yield node, FOLDER
        elif "children" in node:
            yield {"name": "</Layer group>"}, DIVIDER
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(node["children"]))
        else:
            yield node, None


def composite_of(width: int, height: int, nodes: Sequence[dict]) -> np.ndarray:
    """What is seen of the layers, from the bottom up, by normal blending."""
    out = np.zeros((height, width, 4), dtype=np.float64)
    for node, section in _in_file_order(nodes):
        if section is not None or node.get("hidden") or not node.get("width") or not node.get("height"):
            continue
        own = np.frombuffer(node["pixels"], dtype=np.uint8).reshape(node["height"], node["width"], 4).astype(np.float64)
        x0, y0 = max(node["x"], 0), max(node["y"], 0)
        x1, y1 = min(node["x"] + node["width"], width), min(node["y"] + node["height"], height)
        if x1 <= x0 or y1 <= y0:
            continue
        part = own[y0 - node["y"] : y1 - node["y"], x0 - node["x"] : x1 - node["x"]]
        below = out[y0:y1, x0:x1]
        alpha = part[..., 3:] * node.get("opacity", 255) / 255 / 255
        under = below[..., 3:] / 255 * (1 - alpha)
        total = alpha + under
        below[..., :3] = np.where(total > 0, (part[..., :3] * alpha + below[..., :3] * under) / np.where(total > 0, total, 1), 0)
        below[..., 3:] = total * 255
    return np.floor(out + 0.5).astype(np.uint8)


def encode(width: int, height: int, nodes: Sequence[dict], wide: bool = False) -> bytes:
    """A document of RGBA layers, from the bottom up.

    nodes: name, id, opacity, blend, hidden, and either children or x, y, width, height and pixels;
    a node may have a marker of five numbers.
    """
    most = LARGEST[2 if wide else 1]
    if not (1 <= width <= most and 1 <= height <= most):
        raise ValueError(f"a canvas of {width} x {height}")
    size = ">Q" if wide else ">I"
    records = [_record(node, section, wide) for node, section in _in_file_order(nodes)]
    if len(records) > 32767:
        raise ValueError(f"{len(records)} records")
    info = struct.pack(">h", -len(records)) + b"".join(r for r, _ in records) + b"".join(d for _, d in records)
    info += b"\0" * (-len(info) % 4)
    section = struct.pack(size, len(info)) + info + struct.pack(">I", 0)
    head = b"8BPS" + struct.pack(">H6xHIIHH", 2 if wide else 1, 4, height, width, 8, 3) + struct.pack(">II", 0, 0)
    image = composite_of(width, height, nodes)
    return head + struct.pack(size, len(section)) + section + b"\0\0" + image.transpose(2, 0, 1).tobytes()


def read_tree(data: bytes) -> dict:
    """width, height, nodes and composite of a document as ``encode`` writes it; ids and markers included."""
    r = Reader(data)
    head, wide = _header(r)
    r.part(r.number("I")), r.part(r.number("I"))
    body = r.part(_length(r, wide))
    own = body.part(_length(body, wide))
    blends = {key.decode("latin-1").strip(): name for name, key in BLEND_KEYS.items()}
    found = list(_records(own, wide))
    markers = {owner: fields for tag, _, owner, _, _, fields in found if tag == "marker"}
    open_groups: list[list] = [[]]
    for tag, ordinal, _, _, _, fields in found:
        if tag != "layer":
            continue
        width, height = fields["right"] - fields["left"], fields["bottom"] - fields["top"]
        planes = np.zeros((width * height, 4), dtype=np.uint8)
        for channel in fields["channels"]:
            raw = own.part(channel["size"])
            if raw.number("H") != 0:
                raise Damaged("compressed channel")
            planes[:, {-1: 3}.get(channel["id"], channel["id"])] = np.frombuffer(raw.take(raw.left), dtype=np.uint8)
        node = {"name": fields["name"], "id": fields.get("layer_id"), "opacity": fields["opacity"], "blend": blends.get(fields["blend_mode"]), "hidden": fields["hidden"]}
        if ordinal in markers:
            node["marker"] = tuple(markers[ordinal].values())
        if fields.get("section") == DIVIDER:
            open_groups.append([])
        elif fields.get("section") == FOLDER:
            node["children"] = open_groups.pop()
            open_groups[-1].append(node)
        else:
            open_groups[-1].append(node | {"x": fields["left"], "y": fields["top"], "width": width, "height": height, "pixels": planes.tobytes()})
    if len(open_groups) != 1:
        raise Damaged("a divider without its folder")
    if r.number("H") != 0:
        raise Damaged("compressed composite")
    image = np.frombuffer(r.take(r.left), dtype=np.uint8).reshape(4, head["height"], head["width"]).transpose(1, 2, 0)
    return {"width": head["width"], "height": head["height"], "nodes": open_groups[0], "composite": image.tobytes()}


ENCODED = "doc_id string, frames int, groups int, records int, bytes bigint, problem string, content binary"


def _drawing(cel: dict, layer: dict, name: str, number: int) -> dict:
    return {"name": name, "id": number, "blend": layer["blend"], "hidden": not layer["visible"], **{k: cel[k] for k in ("x", "y", "opacity", "width", "height", "pixels")}}


def _by_frame(known: dict, drawn: list[dict]) -> list[dict]:
    """A group per different frame, which holds the frame's cels; all but the first are hidden."""
    frames: dict[int, list[dict]] = {}
    for c in drawn:
        frames.setdefault(c["frame"], []).append(c)
    nodes, seen, fresh = [], set(), 1
    for f in sorted(frames):
        own = sorted(frames[f], key=lambda c: c["layer"])
        key = tuple((c["layer"], c["x"], c["y"], c["opacity"], c["width"], c["height"], c["pixels"]) for c in own)
        if key in seen:
            continue
        seen.add(key)
        kids = [_drawing(c, known[c["layer"]], known[c["layer"]]["name"] or "", fresh + k) for k, c in enumerate(own)]
        fresh += len(kids) + 1
        nodes.append({"name": f"Frame {f}", "id": fresh - 1, "hidden": len(nodes) > 0, "children": kids})
    return nodes


def _by_state(known: dict, drawn: list[dict]) -> list[dict]:
    """Each layer by its different states: one alone stands for the layer, more lie in a group, all but the first hidden."""
    layers: dict[int, dict] = {}
    for c in sorted(drawn, key=lambda c: (c["layer"], c["frame"])):
        layers.setdefault(c["layer"], {}).setdefault((c["x"], c["y"], c["opacity"], c["width"], c["height"], c["pixels"]), c)
    nodes, fresh = [], 1
    for number, states in layers.items():
        layer, name = known[number], known[number]["name"] or ""
        if len(states) == 1:
            nodes.append(_drawing(next(iter(states.values())), layer, name, fresh))
        else:
            kids = [_drawing(c, layer, f"State {k + 1}", fresh + 1 + k) | {"hidden": k > 0} for k, c in enumerate(states.values())]
            nodes.append({"name": name, "id": fresh, "hidden": not layer["visible"], "children": kids})
        fresh += 1 + len(nodes[-1].get("children", ()))
    return nodes


ARRANGED = {"frames": _by_frame, "states": _by_state}


def encode_documents(documents: DataFrame, layers: DataFrame, cels: DataFrame, arranged: str) -> DataFrame:
    """One file per document, frame first (``frames``) or by the states of its layers (``states``).

    Frames, or states of a layer, that show the same share one record. What the format can't hold
    gives no file but a ``problem``. A file is one value, so its document is one task.
    """
    arrange = ARRANGED[arranged]

    def write(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, drawn = left.to_pylist(), right.to_pylist()
        head = next((r for r in rows if r["width"] is not None), {"width": 0, "height": 0})
        known = {r["layer"]: r for r in rows if r["layer"] is not None}
        held = [c for c in drawn if c["layer"] in known]
        nodes = arrange(known, held)
        data = problem = None
        try:
            data = encode(head["width"], head["height"] or 0, nodes)
        except (ValueError, TypeError, struct.error) as e:
            problem = str(e)
        out = {
            "doc_id": (rows or drawn)[0]["doc_id"], "frames": len({c["frame"] for c in held}), "groups": sum("children" in n for n in nodes),
            "records": sum(2 + len(n["children"]) if "children" in n else 1 for n in nodes), "bytes": data and len(data), "problem": problem, "content": data,
        }
        return pa.Table.from_pylist([out], schema=_schema(ENCODED))

    heads = documents.select("doc_id", "width", "height")
    named = layers.select("doc_id", F.col("source_layer_id").alias("layer"), "name", F.col("blend_mode").alias("blend"), F.coalesce("visible", F.lit(False)).alias("visible"))
    pixels = sound_cels(cels).select("doc_id", F.col("frame_index").alias("frame"), F.col("source_layer_id").alias("layer"), "x", "y", "opacity", "width", "height", "pixels")
    every = heads.unionByName(named, allowMissingColumns=True)
    return every.groupBy("doc_id").cogroup(pixels.groupBy("doc_id")).applyInArrow(write, ENCODED)


def _schema(columns: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in columns.split(", "))])


DECODED = "doc_id string, parent string, ordinal int, name string, hidden boolean, x int, y int, opacity int, width int, height int, digest string"


def decode_drawings(encoded: DataFrame) -> DataFrame:
    """The drawings that files hold, with the name of the group around them if there is one, pixels as a digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column("doc_id"), batch.column("content")):
                rows, stack = [], [(None, read_tree(content.as_py())["nodes"])]
                while stack:
                    parent, nodes = stack.pop()
                    for k, n in enumerate(nodes):
                        if "children" in n:
                            stack.append((n["name"], n["children"]))
                        else:
                            own = {"doc_id": doc.as_py(), "parent": parent, "ordinal": k, "digest": hashlib.sha256(n["pixels"]).hexdigest()}
                            rows.append(own | {c: n[c] for c in ("name", "hidden", "x", "y", "opacity", "width", "height")})
                yield pa.RecordBatch.from_pylist(rows, schema=_schema(DECODED))

    return encoded.where("content IS NOT NULL").select("doc_id", "content").mapInArrow(read, DECODED)


def state_number(name: Column) -> Column:
    """The number of a record named ``State n``; null for another name (STR-03)."""
    return F.when(name.startswith("State "), F.try_to_number(F.substring(name, 7, 20), F.lit("9999999999")).cast("int"))
