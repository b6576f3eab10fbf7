"""Pixel operators on row-major RGBA8 buffers, as numpy functions and as columns.

A buffer whose length isn't width * height * 4, a null one included, gives null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: alpha threshold, largest speck, changed pixels in percent, largest channel difference (fixed values).
PROFILES = {"conservative": (8, 2, 1, 6), "balanced": (16, 4, 3, 12)}


def thresholds(profile: str, alpha: int | None = None, speck: int | None = None, percent: int | None = None, delta: int | None = None) -> tuple[int, int, int, int]:
    """The values of a profile, each of which may be replaced; a speck holds a pixel at least, a percentage is one."""
    if speck is not None and speck < 1:
        raise ValueError(f"largest speck {speck}")
    if percent is not None and not 0 <= percent <= 100:
        raise ValueError(f"{percent} percent")
    return tuple(own if own is not None else given for own, given in zip((alpha, speck, percent, delta), PROFILES[profile]))


def image(data: bytes | None, width: int | None, height: int | None) -> np.ndarray | None:
    if data is None or width is None or height is None or width != width or height != height or len(data) != int(width) * int(height) * 4:
        return None
    return np.frombuffer(data, dtype=np.uint8).reshape(int(height), int(width), 4)


def is_writable(data: bytes | None, opacity: float | None) -> bool:
    """Something to see: opacity above zero and an alpha that isn't zero."""
    if data is None or len(data) % 4 or not len(data) or (opacity is not None and not opacity > 0):
        return False
    return bool(np.frombuffer(data, dtype=np.uint8)[3::4].any())


def apply_mask(pixels: np.ndarray, left: int, top: int, mask: np.ndarray, mask_left: int, mask_top: int, default: int) -> np.ndarray:
    """Alpha times mask in document coordinates, rounded; the default colour holds outside the mask."""
    height, width = pixels.shape[:2]
    cover = np.full((height, width), default, dtype=np.uint32)
    x0, y0 = max(left, mask_left), max(top, mask_top)
    x1, y1 = min(left + width, mask_left + mask.shape[1]), min(top + height, mask_top + mask.shape[0])
    if x1 > x0 and y1 > y0:
        cover[y0 - top : y1 - top, x0 - left : x1 - left] = mask[y0 - mask_top : y1 - mask_top, x0 - mask_left : x1 - mask_left]
    out = pixels.copy()
    out[..., 3] = (pixels[..., 3] * cover + 127) // 255
    return out


def blit(canvas: np.ndarray, pixels: np.ndarray, x: int, y: int, opacity: int) -> np.ndarray:
    """The pixels put on a canvas, clipped, their alpha times opacity cut off to whole numbers."""
    out = canvas.copy()
    height, width = canvas.shape[:2]
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + pixels.shape[1], width), min(y + pixels.shape[0], height)
    if x1 > x0 and y1 > y0:
        part = pixels[y0 - y : y1 - y, x0 - x : x1 - x].copy()
        part[..., 3] = part[..., 3].astype(np.uint32) * opacity // 255
        out[y0:y1, x0:x1] = part
    return out


def alpha_bits(data: bytes | None) -> bytes | None:
    """One bit per pixel: whether its alpha isn't zero."""
    return None if data is None else np.packbits(np.frombuffer(data, dtype=np.uint8)[3::4] != 0).tobytes()


def _neighbours(values: np.ndarray, fill: int) -> np.ndarray:
    padded = np.pad(values, 1, constant_values=fill)
    return np.stack([padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]])


def clear_specks(pixels: np.ndarray, threshold: int, largest: int) -> tuple[np.ndarray, int, int]:
    """Clears small 4-connected patches of faint alpha that touch nothing stronger: image, patches, cleared.

    Patches are labelled by spreading the least index over neighbours until nothing changes.
    """
    alpha = pixels[..., 3].astype(np.int64)
    faint = (alpha > 0) & (alpha <= threshold)
    if not faint.any():
        return pixels.copy(), 0, 0
    nothing = alpha.size
    label = np.where(faint, np.arange(nothing).reshape(alpha.shape), nothing)
    while True:
        spread = np.where(faint, np.minimum(label, _neighbours(label, nothing).min(axis=0)), nothing)
        if np.array_equal(spread, label):
            break
        label = spread
    own = label[faint]
    names, inverse, sizes = np.unique(own, return_inverse=True, return_counts=True)
    touched = np.zeros(len(names), dtype=bool)
    np.logical_or.at(touched, inverse, (_neighbours(alpha, 0) > threshold).any(axis=0)[faint])
    gone = (sizes <= largest) & ~touched
    out = pixels.copy()
    rows, columns = np.nonzero(faint)
    clear = gone[inverse]
    out[rows[clear], columns[clear]] = 0
    return out, len(names), int(gone.sum())


def near_equal(a: np.ndarray, b: np.ndarray, percent: int, delta: int) -> bool:
    """Buffers of one size that differ, by little and in few pixels."""
    if a.shape != b.shape:
        return False
    apart = np.abs(a.astype(np.int16) - b.astype(np.int16)).max(axis=-1)
    changed = int(np.count_nonzero(apart))
    return changed > 0 and int(apart.max()) <= delta and changed * 100 <= apart.size * percent


def differing_pixels(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Pixels that differ to the eye, of these in alpha, and in colour only where both are transparent."""
    unequal = (a != b).any(axis=-1)
    clear = (a[..., 3] == 0) & (b[..., 3] == 0)
    return int((unequal & ~clear).sum()), int((a[..., 3] != b[..., 3]).sum()), int((unequal & clear).sum())


def to_rgba(data: bytes, mode: str, palette: dict[int, tuple[int, int, int, int]] | None = None, transparent: int | None = None) -> bytes:
    """Grey with alpha, or palette indexes, as RGBA; an index that the palette lacks is black."""
    if mode == "rgba":
        return data
    raw = np.frombuffer(data, dtype=np.uint8)
    if mode == "gray":
        grey = raw.reshape(-1, 2)
        return np.concatenate([grey[:, :1], grey[:, :1], grey], axis=1).tobytes()
    colours = np.tile(np.array([0, 0, 0, 255], dtype=np.uint8), (256, 1))
    for index, colour in (palette or {}).items():
        colours[index] = colour
    if transparent is not None:
        colours[transparent, 3] = 0
    return colours[raw].tobytes()


def writable(pixels: Column, opacity: Column) -> Column:
    @F.pandas_udf("boolean")
    def check(data: pd.Series, strength: pd.Series) -> pd.Series:
        return pd.Series([is_writable(d, None if o is None or o != o else o) for d, o in zip(data, strength)])

    return check(pixels, opacity.cast("double"))


def specks(pixels: Column, width: Column, height: Column, profile: str = "conservative") -> Column:
    """Struct of the repaired buffer, the patches found and those cleared."""
    threshold, largest, _, _ = PROFILES[profile]

    @F.pandas_udf("struct<pixels:binary,patches:bigint,cleared:bigint>")
    def clean(data: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        rows = []
        for d, x, y in zip(data, w, h):
            own = image(d, x, y)
            if own is None:
                rows.append((None, None, None))
            else:
                out, patches, cleared = clear_specks(own, threshold, largest)
                rows.append((out.tobytes(), patches, cleared))
        return pd.DataFrame(rows, columns=["pixels", "patches", "cleared"])

    return clean(pixels, width, height)


def nearly_equal(a: Column, b: Column, width: Column, height: Column, profile: str = "conservative") -> Column:
    _, _, percent, delta = PROFILES[profile]

    @F.pandas_udf("boolean")
    def compare(left: pd.Series, right: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for p, q, x, y in zip(left, right, w, h):
            one, two = image(p, x, y), image(q, x, y)
            out.append(one is not None and two is not None and near_equal(one, two, percent, delta))
        return pd.Series(out, dtype=bool)

    return compare(a, b, width, height)


def drawn_bits(pixels: Column) -> Column:
    @F.pandas_udf("binary")
    def bits(data: pd.Series) -> pd.Series:
        return data.map(alpha_bits)

    return bits(pixels)
