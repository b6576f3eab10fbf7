"""Layered PSD documents (versions 1 and 2) as flat tables.

``scan`` reads the structure of one file from its bytes without decoding pixels; ``read_documents``
does so for a folder, one tagged row per block, so that a reader takes only the tags it needs. What
can't be read becomes a row of the tag ``error`` instead of an exception of the job.
"""

from __future__ import annotations

import json
import re
import struct
import urllib.parse
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Colour modes by number and bits per channel that the format allows (fixed values).
COLOR_MODES = {0: "bitmap", 1: "grayscale", 2: "indexed", 3: "rgb", 4: "cmyk", 7: "multichannel", 8: "duotone", 9: "lab"}
DEPTHS = (1, 8, 16, 32)
#: Blocks whose length takes eight bytes in version 2 (fixed values of the format).
WIDE_KEYS = (b"LMsk", b"Lr16", b"Lr32", b"Layr", b"Mt16", b"Mt32", b"Mtrn", b"Alph", b"FMsk", b"lnk2", b"FEid", b"FXid", b"PxSD")
#: Resources that may hold an animation, and its signatures.
ANIMATION_RESOURCES = range(4000, 5000)
MARKER_KEY = b"p2rt"
SLICES = 1050

BLOCK = "path string, tag string, ordinal int, parent int, start bigint, end bigint, fields string"


class Damaged(ValueError):
    """The bytes end early or don't follow the format."""


class Reader:
    """Big-endian values of a bounded part of the bytes."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end
        if self.end > len(data):
            raise Damaged(f"a part ends at {self.end} of {len(data)}")

    def take(self, count: int) -> bytes:
        if count < 0 or self.at + count > self.end:
            raise Damaged(f"{count} bytes wanted at {self.at}, {self.end - self.at} left")
        self.at += count
        return self.data[self.at - count : self.at]

    def number(self, kind: str) -> int | float:
        return struct.unpack(">" + kind, self.take(struct.calcsize(kind)))[0]

    def part(self, count: int) -> Reader:
        start = self.at
        self.take(count)
        return Reader(self.data, start, self.at)

    @property
    def left(self) -> int:
        return self.end - self.at

    def text(self) -> str:
        """UTF-16 with its length before it, without a closing zero."""
        return self.take(2 * self.number("I")).decode("utf-16-be", "replace").rstrip("\0")

    def pascal(self, align: int) -> str:
        size = self.number("B")
        raw = self.take(size)
        self.take(min(-(size + 1) % align, self.left))
        return raw.decode("latin-1")


def descriptor(r: Reader) -> dict:
    """A keyed tree of values; objects are dicts, lists are lists, units and enumerations small dicts.

    The open objects and lists stand on a stack, so depth is bounded by the bytes only.
    """
    root: dict = {}
    stack = [[root, _object(r)]]  # holder, members left
    while stack:
        holder, left = stack[-1]
        if not left:
            stack.pop()
            continue
        stack[-1][1] -= 1
        key = _key(r) if isinstance(holder, dict) else None
        kind = r.take(4)
        if kind in (b"Objc", b"GlbO"):
            value, members = {}, _object(r)
        elif kind == b"VlLs":
            value, members = [], r.number("I")
        else:
            value, members = _value(r, kind), None
        if key is None:
            holder.append(value)
        else:
            holder[key] = value
        if members is not None:
            stack.append([value, members])
    return root


def _object(r: Reader) -> int:
    """Reads the head of an object and returns the number of its members."""
    r.text()  # a display name
    _key(r)
    return r.number("I")


def to_json(value) -> str:
    """JSON of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out, stack = [], [value]  # values to write, and finished text as one-element tuples
    while stack:
        at = stack.pop()
        if isinstance(at, tuple):
            out.append(at[0])
        elif isinstance(at, dict):
            parts = [x for k, v in at.items() for x in ((", ",), (json.dumps(k, ensure_ascii=False) + ": ",), v)][1:]
            stack.extend(reversed([("{",), *parts, ("}",)]))
        elif isinstance(at, list):
            stack.extend(reversed([("[",), *[x for v in at for x in ((", ",), v)][1:], ("]",)]))
        else:
            out.append(json.dumps(at, ensure_ascii=False))
    return "".join(out)


def _key(r: Reader) -> str:
    size = r.number("I")
    return r.take(size or 4).decode("latin-1")


def _value(r: Reader, kind: bytes):
    if kind == b"doub":
        return r.number("d")
    if kind == b"UntF":
        return {"unit": r.take(4).decode("latin-1"), "value": r.number("d")}
    if kind == b"TEXT":
        return r.text()
    if kind == b"enum":
        return {"type": _key(r), "value": _key(r)}
    if kind in (b"long", b"comp"):
        return r.number("i" if kind == b"long" else "q")
    if kind == b"bool":
        return r.number("B") != 0
    if kind in (b"tdta", b"alis"):
        return r.take(r.number("I")).hex()
    raise Damaged(f"unknown kind of value {kind!r}")


def _header(r: Reader) -> tuple[dict, bool]:
    if r.take(4) != b"8BPS":
        raise Damaged("not a layered document")
    version = r.number("H")
    if version not in (1, 2):
        raise Damaged(f"version {version}")
    r.take(6)
    channels, height, width, depth, mode = r.number("H"), r.number("I"), r.number("I"), r.number("H"), r.number("H")
    if depth not in DEPTHS:
        raise Damaged(f"{depth} bits per channel")
    return {"version": version, "channels": channels, "width": width, "height": height, "bits_per_channel": depth, "color_mode": COLOR_MODES.get(mode, str(mode))}, version == 2


def _slices(r: Reader) -> dict:
    """Slices of version 6, whose boxes mustn't be reversed; later versions are descriptors."""
    version = r.number("I")
    if version != 6:
        r.number("I")
        return {"version": version, "descriptor": descriptor(r)}
    top, left, bottom, right = (r.number("i") for _ in range(4))
    name, out = r.text(), []
    for _ in range(r.number("I")):
        own = {"id": r.number("I"), "group": r.number("I"), "origin": r.number("I")}
        if own["origin"] == 1:
            r.number("I")
        own["name"] = r.text()
        r.number("I")
        box = [r.number("i") for _ in range(4)]
        if box[2] < box[0] or box[3] < box[1]:
            raise Damaged(f"reversed slice {own['id']}")
        own |= dict(x=box[0], y=box[1], width=box[2] - box[0], height=box[3] - box[1])
        for _ in range(4):
            r.text()
        r.take(1)
        r.text()
        r.take(12)
        out.append(own)
    return {"version": version, "group": name, "bounds": [left, top, right, bottom], "slices": out}


def _resources(r: Reader) -> Iterator[tuple]:
    ordinal = 0
    while r.left:
        start = r.at
        signature = r.take(4)
        if signature not in (b"8BIM", b"MeSa", b"8B64", b"PHUT", b"AgHg", b"DCSR"):
            raise Damaged(f"resource signature {signature!r}")
        number, name, size = r.number("H"), r.pascal(2), r.number("I")
        payload = r.part(size)
        r.take(min(size % 2, r.left))
        fields = {"id": number, "name": name, "size": size, "animation": False}
        if number in ANIMATION_RESOURCES and r.data[payload.at : payload.at + 4] == b"mani" and r.data[payload.at + 4 : payload.at + 8] == b"IRFR":
            fields |= {"animation": True, "subresources": _animation(payload)}
        elif number == SLICES:
            fields |= _slices(payload)
        yield "resource", ordinal, None, start, r.at, fields
        ordinal += 1


def _animation(r: Reader) -> list[dict]:
    r.take(8)
    body, out = r.part(r.number("I")), []
    while body.left >= 12:
        r_sign, key, size = body.take(4), body.take(4).decode("latin-1"), body.number("I")
        if r_sign != b"8BIM":
            break
        own = body.part(size)
        body.take(min(-size % 4, body.left))
        entry: dict = {"key": key, "size": size}
        if key == "AnDs":
            if own.number("I") != 16:
                raise Damaged("descriptor version")
            entry["descriptor"] = descriptor(own)
        out.append(entry)
    return out


def _length(r: Reader, wide: bool) -> int:
    return r.number("Q") if wide else r.number("I")


def _extra(r: Reader, wide: bool) -> Iterator[dict]:
    while r.left >= 12:
        start, signature, key = r.at, r.take(4), r.take(4)
        if signature not in (b"8BIM", b"8B64"):
            raise Damaged(f"block signature {signature!r}")
        size = _length(r, wide and (signature == b"8B64" or key in WIDE_KEYS))
        own = r.part(size)
        r.take(min(size % 2, r.left))
        yield {"key": key.decode("latin-1"), "start": start, "end": r.at, "body": own}


def _marker(r: Reader) -> dict:
    """A private round-trip marker of 20 bytes; one that can't be decoded is all zero."""
    if r.left != 20:
        return {"version": 0, "role": 0, "logical_layer_id": 0, "variant_index": 0, "variant_count": 0}
    return dict(zip(("version", "role", "logical_layer_id", "variant_index", "variant_count"), (r.number("I") for _ in range(5))))


def _records(r: Reader, wide: bool) -> Iterator[tuple]:
    count = abs(r.number("h"))
    for ordinal in range(count):
        start = r.at
        top, left, bottom, right = (r.number("i") for _ in range(4))
        if bottom < top or right < left:
            raise Damaged(f"reversed layer {ordinal}")
        channels = [{"id": r.number("h"), "size": _length(r, wide)} for _ in range(r.number("H"))]
        if r.take(4) != b"8BIM":
            raise Damaged("layer signature")
        blend, opacity, clipping, flags = r.take(4).decode("latin-1"), r.number("B"), r.number("B"), r.number("B")
        r.take(1)
        extra = r.part(r.number("I"))
        extra.part(extra.number("I"))
        extra.part(extra.number("I"))
        fields = {"name": extra.pascal(4), "top": top, "left": left, "bottom": bottom, "right": right, "blend_mode": blend.strip(), "opacity": opacity, "clipping": clipping != 0, "hidden": bool(flags & 2), "channels": channels, "keys": []}
        below = []
        for k, block in enumerate(_extra(extra, wide)):
            own, key = block["body"], block["key"]
            fields["keys"].append(key)
            if key == "luni":
                fields["name"] = own.text()
            elif key == "lyid":
                fields["layer_id"] = own.number("I")
            elif key in ("lsct", "lsdk"):
                fields["section"] = own.number("I")
            elif key.encode("latin-1") == MARKER_KEY:
                below.append(("marker", k, ordinal, block["start"], block["end"], _marker(own)))
            elif key == "shmd":
                below.append(("metadata", k, ordinal, block["start"], block["end"], _metadata(own)))
        yield "layer", ordinal, None, start, r.at, fields
        yield from below


def _metadata(r: Reader) -> dict:
    out = []
    for _ in range(r.number("I")):
        r.take(4)
        key, _, size = r.take(4).decode("latin-1"), r.take(4), r.number("I")
        own = r.part(size)
        entry: dict = {"key": key}
        if key in ("mlst", "mdyn") and own.left >= 4:
            own.number("I")
            entry["descriptor"] = descriptor(own)
        out.append(entry)
    return {"items": out}


def head_size(read: Callable[[int, int], bytes]) -> int:
    """How many bytes lead up to the layers' section, its length included; ``read`` gives (start, count)."""
    wide = read(4, 2) == b"\0\2"
    at = 26
    for _ in range(2):  # the colours, the resources
        raw = read(at, 4)
        if len(raw) < 4:
            return at + len(raw)
        at += 4 + struct.unpack(">I", raw)[0]
    return at + (8 if wide else 4)


def scan(data: bytes, headers_only: bool = False, size: int | None = None) -> list[tuple]:
    """(tag, ordinal, parent, start, end, fields) of one document: header, sections, resources, layers,
    their metadata and markers. ``headers_only`` stops before the layers' records, of which ``data``
    needn't hold anything: it is then the first ``head_size`` of ``size`` bytes.
    """
    out: list[tuple] = []
    r = Reader(data)
    whole = len(data) if size is None else size
    try:
        fields, wide = _header(r)
        out.append(("header", 0, None, 0, r.at, fields))
        for k, name in enumerate(("color", "resources", "layers")):
            start = r.at
            count = _length(r, wide and name == "layers")
            if name == "layers" and headers_only:
                if r.at + count > whole:
                    raise Damaged(f"a part ends at {r.at + count} of {whole}")
                out.append(("section", k, None, start, r.at + count, {"name": name, "size": count}))
                r.at += count
                continue
            body = r.part(count)
            out.append(("section", k, None, start, r.at, {"name": name, "size": count}))
            if name == "resources":
                out.extend(_resources(body))
            elif name == "layers" and count:
                own = body.part(_length(body, wide))
                if own.left:
                    out.extend(_records(own, wide))
        out.append(("section", 3, None, r.at, whole, {"name": "composite", "size": whole - r.at}))
    except (Damaged, struct.error, UnicodeError) as e:
        out.append(("error", len(out), None, r.at, whole, {"message": str(e)}))
    return out


def blocks_of(files: DataFrame, headers_only: bool = False) -> DataFrame:
    """All blocks of documents given as ``path`` and ``content``: columns of ``BLOCK``, fields as JSON.

    Without ``content``, of each path only the bytes before the layers' section are read.
    """
    whole = "content" in files.columns

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(batch.column("path").to_pylist()):
                if whole:
                    found = scan(batch.column("content")[i].as_py() or b"", headers_only)
                else:
                    found = scan(*_head(name))
                rows = [
                    {"path": name, "tag": tag, "ordinal": k, "parent": parent, "start": start, "end": end, "fields": to_json(fields)}
                    for tag, k, parent, start, end, fields in found
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=_schema())

    return files.mapInArrow(parse, BLOCK)


def _head(path: str) -> tuple[bytes, bool, int]:
    """The arguments of ``scan`` for the beginning of a file, wherever its address leads."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", urllib.parse.quote(path, safe=":/@%?=&")))
    with system.open_input_file(at) as file:
        return file.read_at(min(head_size(lambda start, count: file.read_at(count, start)), file.size()), 0), True, file.size()


def read_documents(spark: SparkSession, path: str, headers_only: bool = False) -> DataFrame:
    """All blocks of the documents of a folder; ``headers_only`` reads only the beginnings of the files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return blocks_of(files.select("path") if headers_only else files.select("path", "content"), headers_only)


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in BLOCK.split(", "))])


def gaps_in_sections(blocks: DataFrame) -> DataFrame:
    """Sections whose end isn't where the next begins."""
    from stratacel.operators.sequence import gaps

    return gaps(blocks.where(F.col("tag") == "section"), ["path"], "start", "end")
