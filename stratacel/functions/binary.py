"""Checks and decoders of binary and JSON values."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def zlib_problem(payload: bytes | None, expected: int | None = None) -> str | None:
    """What is wrong with a compressed payload: cut short, followed by other bytes, of another length (BIN-03)."""
    if payload is None:
        return "missing"
    stream = zlib.decompressobj()
    try:
        size = len(stream.decompress(payload)) + len(stream.flush())
    except zlib.error as e:
        return str(e)
    if not stream.eof:
        return "cut short"
    if stream.unused_data:
        return f"{len(stream.unused_data)} bytes after the end"
    return None if expected is None or size == expected else f"{size} bytes instead of {expected}"


def decode_png(data: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGBA) of an image of 8-bit RGB or RGBA without interlacing (SRC-15)."""
    if data[:8] != PNG_SIGNATURE:
        raise ValueError("no image")
    at, width, height, kind, body = 8, 0, 0, None, b""
    while at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", part)
            if depth != 8 or kind not in (2, 6) or interlace:
                raise ValueError("only 8-bit RGB and RGBA")
        elif name == b"IDAT":
            body += part
        at += size + 12
    step = 3 if kind == 2 else 4
    raw = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(height, width * step + 1)
    out = np.zeros((height, width * step), dtype=np.uint8)
    above = np.zeros(width * step, dtype=np.uint8)
    for y in range(height):
        above = out[y] = _unfilter(int(raw[y, 0]), raw[y, 1:], above, step)
    pixels = out.reshape(height, width, step)
    if step == 3:
        pixels = np.dstack([pixels, np.full((height, width), 255, dtype=np.uint8)])
    return width, height, pixels.tobytes()


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    if kind == 1:  # a running sum per channel
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    if kind not in (3, 4):
        raise ValueError(f"filter {kind}")
    out, up = line.astype(int), above.astype(int)
    for i in range(len(out)):
        left = out[i - step] if i >= step else 0
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            corner = up[i - step] if i >= step else 0
            guess = min((left, up[i], corner), key=lambda v: abs(left + up[i] - corner - v))
        out[i] = (out[i] + guess) & 255
    return out.astype(np.uint8)


def without_keys(value, dropped: frozenset[str]):
    """A JSON value without some keys at any depth (JSN-02)."""
    if isinstance(value, dict):
        return {k: without_keys(v, dropped) for k, v in value.items() if k not in dropped}
    return [without_keys(v, dropped) for v in value] if isinstance(value, list) else value


def values_of(value, key: str) -> list:
    """All values of a key at any depth, in document order (JSN-03)."""
    found, stack = [], [value]
    while stack:
        at = stack.pop()
        if isinstance(at, dict):
            stack.extend(reversed([v for v in at.values() if isinstance(v, (dict, list))]))
            if key in at:
                found.append(at[key])
        elif isinstance(at, list):
            stack.extend(reversed([v for v in at if isinstance(v, (dict, list))]))
    return found


def normalised_json(text: Column, dropped: list[str]) -> Column:
    """Canonical JSON without some keys: names sorted, no blanks; what isn't JSON is null."""
    names = frozenset(dropped)

    @F.pandas_udf("string")
    def normalise(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(json.dumps(without_keys(json.loads(t), names), sort_keys=True, separators=(",", ":"), ensure_ascii=False))
            except (TypeError, ValueError, RecursionError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return normalise(text)


def key_values(text: Column, key: str) -> Column:
    """The values of a key at any depth as an array of JSON texts; what isn't JSON is null."""

    @F.pandas_udf("array<string>")
    def search(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append([json.dumps(v, ensure_ascii=False) for v in values_of(json.loads(t), key)])
            except (TypeError, ValueError, RecursionError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return search(text)
