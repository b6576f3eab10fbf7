"""Frame-based sprite documents (magic A5E0) as tables, and back.

``encode`` and ``decode`` are exact inverses for what the tables hold; ``roundtrip_differences`` is
the check that a writer runs on what it has just written.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAGIC, FRAME_MAGIC = 0xA5E0, 0xF1FA
LAYER, CEL, TAGS, PALETTE = 0x2004, 0x2005, 0x2018, 0x2019
RAW, LINKED, COMPRESSED = 0, 1, 2
#: Duration of a frame that has none, in milliseconds (fixed value).
DEFAULT_MS = 100
DIRECTIONS = ("forward", "reverse", "pingpong", "pingpong_reverse")
#: Blend modes by their number in the format (fixed values).
BLEND_NUMBERS = {
    "normal": 0, "multiply": 1, "screen": 2, "overlay": 3, "darken": 4, "lighten": 5, "color dodge": 6, "color burn": 7, "hard light": 8, "soft light": 9,
    "difference": 10, "exclusion": 11, "hue": 12, "saturation": 13, "color": 14, "luminosity": 15, "linear dodge": 16, "subtract": 17, "divide": 18,
}


class Damaged(ValueError):
    """The bytes end early or don't follow the format."""


def _string(text: str) -> bytes:
    raw = text.encode()
    return struct.pack("<H", len(raw)) + raw


def _chunk(kind: int, body: bytes) -> bytes:
    return struct.pack("<IH", len(body) + 6, kind) + body


def encode(width: int, height: int, durations: Sequence[int | None], layers: Sequence[dict], cels: Sequence[dict], tags: Sequence[dict] = ()) -> bytes:
    """A document of RGBA pixels.

    layers (in order): name, group, level, visible, opacity, blend; cels: frame, layer (its place),
    x, y, opacity, z, and either link (an earlier frame) or width, height and pixels.
    """
    head = b"".join(
        _chunk(LAYER, struct.pack("<6HB3x", int(l["visible"]), 1 if l["group"] else 0, l["level"], 0, 0, BLEND_NUMBERS.get(l["blend"], 0), l["opacity"]) + _string(l["name"]))
        for l in layers
    )
    if tags:
        head += _chunk(TAGS, struct.pack("<H8x", len(tags)) + b"".join(struct.pack("<2HBH6x3xx", t["first"], t["last"], DIRECTIONS.index(t["direction"]), t["repeat"]) + _string(t["name"]) for t in tags))
    by_frame: dict[int, list[dict]] = {}
    for c in cels:
        by_frame.setdefault(c["frame"], []).append(c)
    out = b""
    for f, ms in enumerate(durations):
        chunks = [head] if f == 0 and head else []
        count = (len(layers) + bool(tags)) if f == 0 else 0
        for c in sorted(by_frame.get(f, ()), key=lambda c: c["layer"]):
            lead = struct.pack("<HhhBHh5x", c["layer"], c["x"], c["y"], c["opacity"], LINKED if c.get("link") is not None else COMPRESSED, c.get("z", 0))
            if c.get("link") is not None:
                body = struct.pack("<H", c["link"])
            else:
                if len(c["pixels"]) != c["width"] * c["height"] * 4:
                    raise ValueError(f"{len(c['pixels'])} bytes for {c['width']} x {c['height']} pixels")
                body = struct.pack("<HH", c["width"], c["height"]) + zlib.compress(c["pixels"])
            chunks.append(_chunk(CEL, lead + body))
            count += 1
        body = b"".join(chunks)
        out += struct.pack("<IHHH2xI", len(body) + 16, FRAME_MAGIC, min(count, 0xFFFF), DEFAULT_MS if ms is None else ms, count) + body
    header = struct.pack("<IHHHHHIH8xB3xHBBhhHH84x", len(out) + 128, MAGIC, len(durations), width, height, 32, 1, DEFAULT_MS, 0, 0, 1, 1, 0, 0, 16, 16)
    return header + out


def _parts(data: bytes, at: int, end: int, magic_at: int = 4) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of the sized parts between two positions."""
    while at < end:
        if at + 6 > end:
            raise Damaged(f"a part begins at {at} and the data end at {end}")
        size, kind = struct.unpack_from("<IH", data, at)
        if size < 6 or at + size > end:
            raise Damaged(f"a part of {size} bytes at {at}")
        yield kind, at, at + size
        at += size


def decode(data: bytes) -> dict:
    """The tables of a document: header, durations, layers, cels, tags. Linked cels keep their link."""
    if len(data) < 128:
        raise Damaged("no header")
    size, magic, frames, width, height, depth = struct.unpack_from("<IHHHHH", data)
    if magic != MAGIC or size != len(data):
        raise Damaged("not a sprite document, or cut short")
    out: dict = {"width": width, "height": height, "depth": depth, "durations": [], "layers": [], "cels": [], "tags": [], "palette": {}}
    try:
        for kind, start, end in _parts(data, 128, size):
            if kind != FRAME_MAGIC:
                raise Damaged(f"no frame at {start}")
            out["durations"].append(struct.unpack_from("<H", data, start + 8)[0])
            for chunk, lo, hi in _parts(data, start + 16, end):
                _take(out, chunk, data[lo + 6 : hi], len(out["durations"]) - 1)
    except (struct.error, zlib.error, UnicodeDecodeError, IndexError) as e:
        raise Damaged(str(e)) from e
    if len(out["durations"]) != frames:
        raise Damaged(f"{len(out['durations'])} of {frames} frames")
    return out


def _text(body: bytes, at: int) -> tuple[str, int]:
    size = struct.unpack_from("<H", body, at)[0]
    return body[at + 2 : at + 2 + size].decode(), at + 2 + size


def _take(out: dict, chunk: int, body: bytes, frame: int) -> None:
    if chunk == LAYER:
        flags, kind, level, _, _, blend, opacity = struct.unpack_from("<6HB", body)
        names = {n: m for m, n in BLEND_NUMBERS.items()}
        out["layers"].append({"name": _text(body, 16)[0], "group": kind == 1, "level": level, "visible": bool(flags & 1), "opacity": opacity, "blend": names.get(blend, "normal")})
    elif chunk == CEL:
        layer, x, y, opacity, kind, z = struct.unpack_from("<HhhBHh", body)
        cel = {"frame": frame, "layer": layer, "x": x, "y": y, "opacity": opacity, "z": z, "link": None, "width": None, "height": None, "pixels": None}
        if kind == LINKED:
            cel["link"] = struct.unpack_from("<H", body, 16)[0]
        else:
            cel["width"], cel["height"] = struct.unpack_from("<HH", body, 16)
            cel["pixels"] = body[20:] if kind == RAW else zlib.decompress(body[20:])
        out["cels"].append(cel)
    elif chunk == TAGS:
        at = 10
        for _ in range(struct.unpack_from("<H", body)[0]):
            first, last, direction, repeat = struct.unpack_from("<2HBH", body, at)
            name, at = _text(body, at + 17)
            out["tags"].append({"first": first, "last": last, "direction": DIRECTIONS[direction], "repeat": repeat, "name": name})
    elif chunk == PALETTE:
        _, first, last = struct.unpack_from("<III", body)
        at = 20
        for index in range(first, last + 1):
            named = struct.unpack_from("<H", body, at)[0]
            out["palette"][index] = tuple(body[at + 2 : at + 6])
            at += 6 if not named & 1 else _text(body, at + 6)[1] - at


def shown(document: dict) -> list[dict]:
    """The cels with links followed to their pixels; place and opacity stay their own."""
    own = {(c["layer"], c["frame"]): c for c in document["cels"]}
    out = []
    for c in document["cels"]:
        target = c
        while target is not None and target["link"] is not None:
            target = own.get((c["layer"], target["link"])) if target["link"] < target["frame"] else None
        if target is not None:
            out.append(c | {k: target[k] for k in ("width", "height", "pixels")})
    return out


def flattened_frames(document: dict) -> dict[int, dict]:
    """The one cel of each frame of a flattened rendering; two in a frame are an error."""
    out: dict[int, dict] = {}
    for c in shown(document):
        if c["frame"] in out:
            raise Damaged(f"two cels in frame {c['frame']} of a flattened document")
        out[c["frame"]] = c
    return out


def link_problems(document: dict) -> list[str]:
    """What is wrong with the links of cels: each leads back to a cel of its layer that isn't a link."""
    own = {(c["layer"], c["frame"]): c for c in document["cels"]}
    out = []
    for c in document["cels"]:
        if c["link"] is not None:
            target = own.get((c["layer"], c["link"]))
            if c["link"] >= c["frame"] or target is None or target["link"] is not None:
                out.append(f"layer {c['layer']} frame {c['frame']} links to {c['link']}")
    return out


ENCODED = "doc_id string, layers int, cels int, linked int, bytes bigint, problem string, content binary"
#: The largest canvas side, duration, frame number and layer number of the format.
LARGEST = 0xFFFF


def tree_order(rows: Sequence[dict]) -> list[tuple[dict, int]]:
    """(row, level) of layers in file order: siblings by ordinal, what a group holds right after it.

    rows: layer, above (the parent's layer or None), place. A parent that isn't there counts as
    none; what lies on a cycle isn't reached and comes last, without a level.
    """
    there = {r["layer"] for r in rows}
    below: dict = {}
    for r in sorted(rows, key=lambda r: (r["place"] is None, r["place"], r["layer"]), reverse=True):
        below.setdefault(r["above"] if r["above"] in there else None, []).append(r)
    out, stack = [], [(r, 0) for r in below.get(None, ())]
    while stack:
        r, level = stack.pop()
        out.append((r, level))
        stack.extend((k, level + 1) for k in below.get(r["layer"], ()))
    reached = {r["layer"] for r, _ in out}
    return out + [(r, 0) for r in rows if r["layer"] not in reached]


def encode_documents(documents: DataFrame, frames: DataFrame, layers: DataFrame, cels: DataFrame, reuse: bool = True) -> DataFrame:
    """One file per document from the snapshot tables, with its canvas, tree, timeline and loop.

    Equal cels of a layer link back to the first where ``reuse``. A loop becomes a tag over all
    frames, whose repeat is the loop count (0 plays on and on). What the format can't hold isn't
    cut to size: the document gets no file but a ``problem``. A file is one value, so its document
    is one task.
    """

    def write(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, drawn = left.to_pylist(), right.to_pylist()
        head = next((r for r in rows if r["width"] is not None or r["height"] is not None), {"width": None, "height": None, "loop": None, "repeat": None})
        ordered = tree_order([r for r in rows if r["layer"] is not None])
        place = {r["layer"]: k for k, (r, _) in enumerate(ordered)}
        length = max([r["frame"] for r in rows if r["frame"] is not None] + [c["frame"] for c in drawn], default=-1) + 1
        ms: list = [None] * length
        for r in rows:
            if r["frame"] is not None:
                ms[r["frame"]] = r["ms"]
        out, first, linked = [], {}, 0
        for c in sorted(drawn, key=lambda c: (c["frame"], c["layer"])):
            if c["layer"] not in place:
                continue
            cel = {"frame": c["frame"], "layer": place[c["layer"]], "x": c["x"], "y": c["y"], "opacity": c["opacity"]}
            key = (c["layer"], c["width"], c["height"], c["pixels"])
            if reuse and key in first:
                cel["link"], linked = first[key], linked + 1
            else:
                cel |= {"width": c["width"], "height": c["height"], "pixels": c["pixels"]}
                first[key] = c["frame"]
            out.append(cel)
        described = [
            {"name": r["name"] or "", "group": r["kind"] == "group", "level": level, "visible": bool(r["visible"]), "opacity": 255 if r["strength"] is None else r["strength"], "blend": r["blend"] or "normal"}
            for r, level in ordered
        ]
        tags = [] if head["loop"] is None or not length else [{"first": 0, "last": length - 1, "direction": "forward", "repeat": head["repeat"] or 0, "name": head["loop"]}]
        problem = _problem(head, ms, described, tags)
        data = None
        if problem is None:
            try:
                data = encode(head["width"], head["height"], ms, described, out, tags)
            except (ValueError, TypeError, struct.error) as e:
                problem = str(e)
        doc = (rows or drawn)[0]["doc_id"]
        size = None if data is None else len(data)
        return pa.Table.from_pylist([{"doc_id": doc, "layers": len(described), "cels": len(out), "linked": linked, "bytes": size, "problem": problem, "content": data}], schema=_schema(ENCODED))

    heads = documents.select("doc_id", "width", "height", F.col("loop_tag").alias("loop"), F.col("loop_count").alias("repeat"))
    timeline = frames.select("doc_id", F.col("frame_index").alias("frame"), F.col("duration_ms").alias("ms"))
    tree = layers.select(
        "doc_id", F.col("source_layer_id").alias("layer"), F.col("parent_layer_id").alias("above"), F.col("child_ordinal").alias("place"), "name", "kind", "visible", F.col("opacity").alias("strength"), F.col("blend_mode").alias("blend")
    )
    pixels = sound_cels(cels).select("doc_id", F.col("frame_index").alias("frame"), F.col("source_layer_id").alias("layer"), "x", "y", "opacity", "width", "height", "pixels")
    every = heads.unionByName(timeline, allowMissingColumns=True).unionByName(tree, allowMissingColumns=True)
    return every.groupBy("doc_id").cogroup(pixels.groupBy("doc_id")).applyInArrow(write, ENCODED)


def encode_plans(documents: DataFrame, frames: DataFrame, plan: DataFrame, cels: DataFrame, reuse: bool = True) -> DataFrame:
    """One file per document with a layer for each track of its plan, and the cels' z-indices.

    plan: doc_id, frame, layer, track, track_place, track_name, z_index. Equal cels of a track link
    back to the first where ``reuse``, whatever layer they come from. What the format can't hold is
    a ``problem``, as with ``encode_documents``. Cels meet their plan in the task of the document,
    so pixels are shuffled once.
    """
    assigned = ["track", "track_place", "track_name", "z_index"]

    def write(left: pa.Table, right: pa.Table) -> pa.Table:
        is_plan = left["track"].is_valid()
        rows, tracks, own = left.filter(pc.invert(is_plan)).to_pylist(), left.filter(is_plan), defaultdict(list)
        for frame, layer, *values in zip(*(tracks[k].to_pylist() for k in ("planned_frame", "layer", *assigned))):
            own[frame, layer].append(dict(zip(assigned, values)))
        where = [k for k, place in enumerate(zip(right["frame"].to_pylist(), right["layer"].to_pylist())) if place in own]
        drawn = [c | values for c in right.take(pa.array(where, type=pa.int64())).to_pylist() for values in own[c["frame"], c["layer"]]]
        if not rows and not drawn:
            return _schema(ENCODED).empty_table()
        head = next((r for r in rows if r["width"] is not None or r["height"] is not None), {"width": None, "height": None, "loop": None, "repeat": None})
        names = {(c["track_place"], c["track"]): c["track_name"] for c in drawn}
        place = {track: k for k, (_, track) in enumerate(sorted(names))}
        ms: list = [None] * (max([r["frame"] for r in rows if r["frame"] is not None] + [c["frame"] for c in drawn], default=-1) + 1)
        for r in rows:
            if r["frame"] is not None:
                ms[r["frame"]] = r["ms"]
        out, first = [], {}
        for c in sorted(drawn, key=lambda c: (c["frame"], c["track"])):
            cel = {"frame": c["frame"], "layer": place[c["track"]], "x": c["x"], "y": c["y"], "opacity": c["opacity"], "z": c["z_index"]}
            key = (c["track"], c["width"], c["height"], c["pixels"])
            if reuse and key in first:
                cel["link"] = first[key]
            else:
                cel |= {k: c[k] for k in ("width", "height", "pixels")}
                first[key] = c["frame"]
            out.append(cel)
        described = [{"name": names[k] or "", "group": False, "level": 0, "visible": True, "opacity": 255, "blend": "normal"} for k in sorted(names)]
        tags = [] if head["loop"] is None or not ms else [{"first": 0, "last": len(ms) - 1, "direction": "forward", "repeat": head["repeat"] or 0, "name": head["loop"]}]
        problem, data = _problem(head, ms, described, tags), None
        if problem is None:
            try:
                data = encode(head["width"], head["height"], ms, described, out, tags)
            except (ValueError, TypeError, struct.error) as e:
                problem = str(e)
        linked = sum(c.get("link") is not None for c in out)
        return pa.Table.from_pylist([{"doc_id": (rows or drawn)[0]["doc_id"], "layers": len(described), "cels": len(out), "linked": linked, "bytes": data and len(data), "problem": problem, "content": data}], schema=_schema(ENCODED))

    heads = documents.select("doc_id", "width", "height", F.col("loop_tag").alias("loop"), F.col("loop_count").alias("repeat"))
    timeline = frames.select("doc_id", F.col("frame_index").alias("frame"), F.col("duration_ms").alias("ms"))
    pixels = sound_cels(cels).select("doc_id", F.col("frame_index").alias("frame"), F.col("source_layer_id").alias("layer"), "x", "y", "opacity", "width", "height", "pixels")
    planned = plan.select("doc_id", F.col("frame").alias("planned_frame"), "layer", *assigned)
    described = heads.unionByName(timeline, allowMissingColumns=True).unionByName(planned, allowMissingColumns=True)
    return described.groupBy("doc_id").cogroup(pixels.groupBy("doc_id")).applyInArrow(write, ENCODED)


def sound_cels(cels: DataFrame) -> DataFrame:
    """Cels with a place and pixels of the length that their size wants."""
    return cels.where("frame_index IS NOT NULL AND source_layer_id IS NOT NULL").where(F.length("pixels") == F.col("width").cast("bigint") * F.col("height") * 4)


def _problem(head: dict, ms: list, described: list, tags: list) -> str | None:
    """What the format can't hold."""
    for side in ("width", "height"):
        if head[side] is None or not 1 <= head[side] <= LARGEST:
            return f"{side} {head[side]}"
    if not 1 <= len(ms) <= LARGEST:
        return f"{len(ms)} frames"
    for f, d in enumerate(ms):
        if d is not None and not 0 <= d <= LARGEST:
            return f"frame {f} of {d} ms"
    if len(described) > LARGEST:
        return f"{len(described)} layers"
    if any(not 0 <= t["repeat"] <= LARGEST for t in tags):
        return f"repeat {tags[0]['repeat']}"
    return None


def _schema(columns: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in columns.split(", "))])


#: What the parts of a decoded document are given as.
DECODED = {
    "headers": "doc_id string, width int, height int, frames int, duration bigint, loop string, loop_first int, loop_last int, loop_repeat int",
    "layers": "doc_id string, place int, name string, grouped boolean, level int, visible boolean, opacity int, blend string",
    "frames": "doc_id string, frame int, duration int",
    "cels": "doc_id string, layer int, frame int, x int, y int, opacity int, width int, height int, digest string, linked boolean, z int",
}


def _rows(document: dict, part: str) -> Iterator[dict]:
    if part == "headers":
        tag = (document["tags"] or [{"name": None, "first": None, "last": None, "repeat": None}])[0]
        yield {"width": document["width"], "height": document["height"], "frames": len(document["durations"]), "duration": sum(document["durations"])} | {
            "loop": tag["name"], "loop_first": tag["first"], "loop_last": tag["last"], "loop_repeat": tag["repeat"]
        }
    elif part == "layers":
        for k, own in enumerate(document["layers"]):
            yield {"place": k, "grouped": own["group"]} | {n: own[n] for n in ("name", "level", "visible", "opacity", "blend")}
    elif part == "frames":
        for f, ms in enumerate(document["durations"]):
            yield {"frame": f, "duration": ms}
    else:
        links = {(c["layer"], c["frame"]) for c in document["cels"] if c["link"] is not None}
        for c in shown(document):
            yield {"digest": hashlib.sha256(c["pixels"]).hexdigest(), "linked": (c["layer"], c["frame"]) in links} | {k: c[k] for k in ("layer", "frame", "x", "y", "opacity", "width", "height", "z")}


def decode_documents(encoded: DataFrame, part: str) -> DataFrame:
    """One part of the documents that files hold, a key of ``DECODED``; of cels links are followed and
    pixels are given by their digest."""
    schema = DECODED[part]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column("doc_id"), batch.column("content")):
                own = {"doc_id": doc.as_py()}
                yield pa.RecordBatch.from_pylist([own | r for r in _rows(decode(content.as_py()), part)], schema=_schema(schema))

    return encoded.where("content IS NOT NULL").select("doc_id", "content").mapInArrow(read, schema)


def roundtrip_differences(documents: DataFrame, frames: DataFrame, cels: DataFrame, encoded: DataFrame) -> DataFrame:
    """What was written and doesn't come back, or the reverse: doc_id, part and what it is as JSON.

    Canvas, frames, durations and loops of documents, and every cel with its drawing.
    """
    written = encoded.where("content IS NOT NULL").select("doc_id")
    timeline = frames.select("doc_id", F.col("frame_index").alias("frame"), F.coalesce("duration_ms", F.lit(DEFAULT_MS)).cast("int").alias("duration"))
    lengths = timeline.groupBy("doc_id").agg((F.max("frame") + 1).alias("frames"))
    heads = documents.join(lengths, "doc_id").select("doc_id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "frames", F.col("loop_tag").alias("loop"), F.when(F.col("loop_tag").isNotNull(), F.coalesce("loop_count", F.lit(0))).cast("int").alias("loop_repeat"))
    drawn = sound_cels(cels).select("doc_id", F.col("frame_index").alias("frame"), "x", "y", "opacity", "width", "height", F.sha2("pixels", 256).alias("digest"))
    out = None
    for part, wanted in (("headers", heads), ("frames", timeline), ("cels", drawn)):
        wanted = wanted.join(written, "doc_id", "left_semi")
        got = decode_documents(encoded, part).select(*wanted.columns)
        apart = wanted.exceptAll(got).withColumn("side", F.lit("written")).unionByName(got.exceptAll(wanted).withColumn("side", F.lit("read")))
        own = apart.select("doc_id", F.lit(part).alias("part"), F.to_json(F.struct(*[c for c in apart.columns if c != "doc_id"])).alias("difference"))
        out = own if out is None else out.unionByName(own)
    return out
