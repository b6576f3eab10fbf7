"""Tracks: which layers of successive frames are one thing, in what order, under which groups.

The association is sequential in the frames of a document, as tracks are the state; documents are
independent. A document's observations hold a hash and one bit per pixel instead of pixels, so even
a large one is a narrow table.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratacel.functions.columns import is_generic_name
from stratacel.functions.names import parsed_name
from stratacel.functions.pixels import drawn_bits
from stratacel.operators.cels import content_key
from stratacel.plans.solvers import EDGE_BONUS, Scores, agreed_edges, best_matching, ranked_order, uncross, z_indices

#: Least likeness of an observation and a track (fixed value).
LEAST_SCORE = 40
#: What an observation is known by.
OBSERVATION = "doc_id string, frame int, layer bigint, place int, name string, base string, generic boolean, path string, x int, y int, width int, height int, content string, locked boolean"
#: Besides: one bit per pixel that is drawn, and the groups above, outermost first. Without the bits
#: a drawing fills its box; without the groups nothing excludes it structurally.
DRAWN = OBSERVATION + ", alpha binary, containers array<bigint>"
#: Up to so many pairs of a frame are compared one by one, more of them by columns.
FEW_PAIRS = 64
#: Pairs that are compared at once.
BLOCK = 1 << 20
#: Two named ones further apart than this, with no name, place or content in common, are below LEAST_SCORE.
NEAR = 8
PLAN = "doc_id string, frame int, layer bigint, track int, track_place int, track_name string, z_index int, phase string, score int, margin int"


@dataclass
class Track:
    number: int
    seen: list = field(default_factory=list)  # observations, one per frame at most
    places: list = field(default_factory=list)
    ordered: list = field(default_factory=list)
    slots: set = field(default_factory=set)  # (parent, selecting group) of its observations
    names: set = field(default_factory=set)
    contents: set = field(default_factory=set)
    paths: set = field(default_factory=set)
    boxes: dict = field(default_factory=dict)  # place and size to an observation that has them

    def add(self, row, place: int, slots: dict) -> None:
        self.seen.append(row)
        self.places.append(place)
        insort(self.ordered, place)
        self.slots.update(slots.items())
        self.names.add(row.name)
        self.contents.add(row.content)
        self.paths.add(row.path)
        self.boxes[row.x, row.y, row.width, row.height] = row

    @property
    def median(self) -> int:
        """The upper median of its places."""
        return self.ordered[len(self.ordered) // 2]


def _ratio(a: int, b: int) -> int:
    return int(np.floor(min(a, b) / max(a, b) * 10 + 0.5)) if a and b else 0


def _geometry(a, b) -> int:
    near = min(abs(a.x - b.x), 32) + min(abs(a.y - b.y), 32)
    return min(20, (_ratio(a.width, b.width) + _ratio(a.height, b.height)) // 2 + (20 - min(20, near)) // 2)


def _group(a: str, b: str) -> int:
    return 20 if a == b else 12 if a and b and a.split("/")[0] == b.split("/")[0] else 0


@lru_cache(maxsize=256)
def _bitmap(alpha: bytes | None, width: int, height: int) -> np.ndarray:
    if alpha is None:
        return np.ones((height, width), dtype=bool)
    return np.unpackbits(np.frombuffer(alpha, dtype=np.uint8), count=width * height).reshape(height, width).astype(bool)


def alpha_overlap(a, b) -> bool:
    """Whether both observations draw at one pixel of the document; boxes are compared first."""
    left, top = max(a.x, b.x), max(a.y, b.y)
    right, bottom = min(a.x + a.width, b.x + b.width), min(a.y + a.height, b.y + b.height)
    if not (left < right and top < bottom):
        return False
    parts = []
    for r in (a, b):
        x, y = int(r.x), int(r.y)
        bits = _bitmap(getattr(r, "alpha", None), int(r.width), int(r.height))
        parts.append(bits[int(top) - y : int(bottom) - y, int(left) - x : int(right) - x])
    return bool((parts[0] & parts[1]).any())


@lru_cache(maxsize=4096)
def _words(alpha: bytes | None, width: int, height: int) -> np.ndarray:
    """The bitmap as one number a line, the first pixel highest."""
    bits = np.zeros((height, 64), dtype=bool)
    bits[:, :width] = _bitmap(alpha, width, height)
    return np.packbits(bits, axis=1).view(">u8")[:, 0].astype(np.uint64)


def _near(x: np.ndarray, y: np.ndarray, right: np.ndarray, bottom: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs whose boxes overlap, in blocks: each box with those that begin left of its right edge, in order of x."""
    by = np.argsort(x, kind="stable")
    counts = np.maximum(np.searchsorted(x[by], right[by]) - np.arange(len(x)) - 1, 0)
    ends = np.cumsum(counts)
    low = 0
    while low < len(x):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BLOCK, side="right")))
        own = np.repeat(np.arange(low, high), counts[low:high])
        other = np.arange(len(own)) - np.repeat(ends[low:high] - counts[low:high] - (ends[low - 1] if low else 0), counts[low:high]) + own + 1
        i, j = by[own], by[other]
        i, j = np.minimum(i, j), np.maximum(i, j)
        near = (x[i] < right[j]) & (x[j] < right[i]) & (y[i] < bottom[j]) & (y[j] < bottom[i])
        yield i[near], j[near]
        low = high


def _meeting(rows: list, i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray, right: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """``alpha_overlap`` of pairs whose boxes overlap; lines of up to 64 pixels are compared for all pairs at once."""
    met = np.zeros(len(i), dtype=bool)
    narrow = np.zeros(len(rows), dtype=bool)
    narrow[np.union1d(i, j)] = True
    narrow &= (right - x <= 64) & (bottom - y <= 256)
    todo = np.flatnonzero(narrow[i] & narrow[j])
    if len(todo) <= FEW_PAIRS:
        todo = todo[:0]
    for k in np.setdiff1d(np.arange(len(i)), todo).tolist():
        met[k] = alpha_overlap(rows[i[k]], rows[j[k]])
    if not todo.size:
        return met
    lines = np.zeros((len(rows), int((bottom - y)[narrow].max())), dtype=np.uint64)
    for k in np.flatnonzero(narrow).tolist():
        r = rows[k]
        lines[k, : int(r.height)] = _words(getattr(r, "alpha", None), int(r.width), int(r.height))
    a, b = i[todo], j[todo]
    left, top, low = np.maximum(x[a], x[b]), np.maximum(y[a], y[b]), np.minimum(bottom[a], bottom[b])
    shifts = [(left - x[k]).astype(np.uint64) for k in (a, b)]
    at = [(top - y[k]).astype(np.int64) for k in (a, b)]
    height = (low - top).astype(np.int64)
    line = 0
    while todo.size:
        hit = (lines[a, at[0] + line] << shifts[0]) & (lines[b, at[1] + line] << shifts[1]) != 0
        met[todo[hit]] = True
        line += 1
        on = ~hit & (height > line)
        todo, a, b, height, shifts, at = todo[on], a[on], b[on], height[on], [k[on] for k in shifts], [k[on] for k in at]
    return met


def overlapping(rows: list) -> np.ndarray:
    """Places of the pairs of a frame's observations that draw at one pixel, in order."""
    if len(rows) * (len(rows) - 1) // 2 <= FEW_PAIRS:
        return np.array([(i, j) for i, j in combinations(range(len(rows)), 2) if alpha_overlap(rows[i], rows[j])], dtype=np.int32).reshape(-1, 2)
    x, y, width, height = (np.array([getattr(r, k) for r in rows], dtype=float) for k in ("x", "y", "width", "height"))
    sides = x, y, x + width, y + height
    out = [np.zeros((0, 2), dtype=np.int32)]
    for i, j in _near(*sides):
        if i.size:
            met = _meeting(rows, i, j, *sides)
            out.append(np.stack([i[met], j[met]], axis=1).astype(np.int32))
    out = np.concatenate(out)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def score(row, place: int, track: Track) -> int:
    """Likeness of an observation and a track, 0 to 100, by name, group, order, geometry and pixels."""
    last = track.seen[-1]
    named = not row.generic and not last.generic
    name = 20 if named and row.name == last.name else 5 if named and row.base == last.base else 0
    order = max(0, 20 - 4 * min(abs(place - track.median), 5))
    group = max(_group(row.path, p) for p in track.paths)
    geometry = max(_geometry(row, s) for s in track.boxes.values())
    pixels = 10 if row.content in track.contents else 0
    return min(100, 100 * (name + group + order + geometry + pixels) // (90 if named else 70))


def anchor_frame(frames: dict) -> int:
    """The frame with most named, then most observations, the earliest of equals."""
    return min(frames, key=lambda f: (-sum(not r.generic for r in frames[f]), -len(frames[f]), f))


def _above(row) -> list:
    groups = getattr(row, "containers", None)
    return [] if groups is None else [int(g) for g in groups]


def selecting_groups(rows: list) -> set:
    """Groups that select frames: two siblings or more, no two of which show in one frame."""
    active, siblings = defaultdict(set), defaultdict(set)
    for r in rows:
        for parent, group in zip([None, *_above(r)], _above(r)):
            active[group].add(r.frame)
            siblings[parent].add(group)
    out: set = set()
    for groups in siblings.values():
        shown = [f for g in groups for f in active[g]]
        if len(groups) >= 2 and len(shown) >= 2 and len(set(shown)) == len(shown):
            out |= groups
    return out


def identity_allowed(row, track: Track) -> bool:
    """A locked observation joins only the locked track of its own source layer (FLT-11)."""
    first = track.seen[0]
    return row.locked == first.locked and (not row.locked or row.layer == first.layer)


def candidate_allowed(row, track: Track, slots: dict) -> bool:
    """A generic name on either side wants groups that exclude each other structurally (FLT-12)."""
    if row.generic or track.seen[0].generic:
        return any(parent in slots and slots[parent] != group for parent, group in track.slots)
    return True


def _scored(rows: list, places: list, tracks: list, bounds: list | None, slots: dict) -> np.ndarray:
    """``score`` of every row and track, 0 where it is below ``LEAST_SCORE`` or the track isn't admitted.

    bounds: the least and the greatest median that a row may join.
    """
    out = np.zeros((len(rows), len(tracks)), dtype=np.int8)
    if len(rows) * len(tracks) <= FEW_PAIRS:
        for i, (r, place) in enumerate(zip(rows, places)):
            for k, t in enumerate(tracks):
                if (bounds is None or bounds[0][i] <= t.median <= bounds[1][i]) and candidate_allowed(r, t, slots[r.frame, r.layer]) and identity_allowed(r, t):
                    points = score(r, place, t)
                    out[i, k] = points if points >= LEAST_SCORE else 0
        return out
    if not out.size:
        return out
    codes: dict = {}
    coded = lambda values: np.array([codes.setdefault(v, len(codes)) for v in values])
    flat = lambda sets: (np.repeat(np.arange(len(sets)), [len(x) for x in sets]), [v for x in sets for v in x])
    last, first = [t.seen[-1] for t in tracks], [t.seen[0] for t in tracks]
    median, place = np.array([t.median for t in tracks]), np.array(places)
    generic = np.array([bool(r.generic) for r in rows])
    began, ended = (np.array([bool(r.generic) for r in x]) for x in (first, last))
    locked = [np.array([bool(r.locked) for r in x]) for x in (rows, first)]
    layer = [np.array([r.layer for r in x]) for x in (rows, first)]
    name, base = ([coded([getattr(r, key) for r in x]) for x in (rows, last)] for key in ("name", "base"))
    chosen = [tuple(slots[r.frame, r.layer].items()) for r in rows]
    kinds = {own: k for k, own in enumerate(dict.fromkeys(chosen))}
    kind, apart = np.array([kinds[own] for own in chosen]), np.zeros((len(kinds), len(tracks)), dtype=bool)
    if generic.any() or began.any():
        track, pairs = flat([t.slots for t in tracks])
        parents, groups = coded([p for p, _ in pairs]), coded([g for _, g in pairs])
        for own, k in kinds.items():
            for parent, group in own:
                apart[k, track[(parents == codes.get(parent, -1)) & (groups != codes.get(group, -1))]] = True
    ways = {w: k for k, w in enumerate(dict.fromkeys(r.path for r in rows))}
    held = {p: k for k, p in enumerate(dict.fromkeys(p for t in tracks for p in t.paths))}
    near = np.array([[_group(w, p) for p in held] for w in ways], dtype=np.int8)
    track, paths = flat([t.paths for t in tracks])
    group = np.maximum.reduceat(near[:, [held[p] for p in paths]], np.searchsorted(track, np.arange(len(tracks))), axis=1)
    way = np.array([ways[r.path] for r in rows])
    drawn = defaultdict(list)
    for i, r in enumerate(rows):
        drawn[r.content].append(i)
    equal = np.sort(np.array([i * len(tracks) + k for k, t in enumerate(tracks) for c in drawn.keys() & t.contents for i in drawn[c]], dtype=np.int64))
    track, boxes = flat([t.boxes for t in tracks])
    boxes, counts = np.array(boxes, dtype=float), np.bincount(track)
    starts = np.cumsum(counts) - counts
    box = np.array([(r.x, r.y, r.width, r.height) for r in rows], dtype=float)
    by = np.argsort(median, kind="stable")
    by = by[(~began | apart.any(axis=0))[by]]  # others admit no row
    low = np.zeros(len(rows), dtype=int) if bounds is None else np.searchsorted(median[by], bounds[0])
    high = np.full(len(rows), len(by)) if bounds is None else np.searchsorted(median[by], bounds[1], side="right")
    window = [np.searchsorted(median[by], place + d, side=side) for d, side in ((-4, "left"), (4, "right"))]  # order counts there
    sides = [f(boxes[:, c], starts)[by] for f, c in ((np.minimum.reduceat, 0), (np.maximum.reduceat, 0), (np.minimum.reduceat, 1), (np.maximum.reduceat, 1))]
    alike = [_members(own[1][by]) for own in (name, base)]
    at = np.full(len(tracks), -1)
    at[by] = np.arange(len(by))
    drawn_at = _members(equal // len(tracks))

    def likely(i: int) -> np.ndarray:
        """Places in ``by`` of the tracks whose score of a row may reach ``LEAST_SCORE``."""
        a, z = int(low[i]), int(high[i])
        if a >= z:
            return by[:0]
        if generic[i]:
            return np.flatnonzero(apart[kind[i], by[a:z]]) + a
        away = [np.maximum(np.maximum(sides[c][a:z] - box[i, c // 2], box[i, c // 2] - sides[c + 1][a:z]), 0) for c in (0, 2)]
        found = away[0] + away[1] <= NEAR
        found |= ended[by[a:z]]
        found[max(int(window[0][i]) - a, 0) : max(int(window[1][i]) - a, 0)] = True
        for some in (alike[0].get(name[0][i]), alike[1].get(base[0][i]), at[equal[drawn_at[i]] % len(tracks)] if i in drawn_at else None):
            if some is not None:
                found[some[(some >= a) & (some < z)] - a] = True
        return np.flatnonzero(found) + a

    for i, k in _pairs(len(rows), likely):
        k = by[k]
        allowed = (locked[0][i] == locked[1][k]) & (~locked[0][i] | (layer[0][i] == layer[1][k]))
        allowed &= ~(generic[i] | began[k]) | apart[kind[i], k]
        i, k = i[allowed], k[allowed]
        named = ~(generic[i] | ended[k])
        total = np.where(named, np.where(name[0][i] == name[1][k], 20, np.where(base[0][i] == base[1][k], 5, 0)), 0)
        total += np.maximum(0, 20 - 4 * np.minimum(np.abs(place[i] - median[k]), 5)) + group[way[i], k]
        if equal.size:
            code = i * len(tracks) + k
            total += np.where(equal[np.minimum(np.searchsorted(equal, code), len(equal) - 1)] == code, 10, 0)
        full = np.where(named, 90, 70)
        able = 100 * (total + 20) // full >= LEAST_SCORE  # 20: the most that geometry adds
        i, k, total, full = i[able], k[able], total[able], full[able]
        for at, to in _blocks(counts[k]):
            n = counts[k[at:to]]
            start = np.cumsum(n) - n
            geometry = _geometries(box[np.repeat(i[at:to], n)], boxes[np.arange(n.sum()) - np.repeat(start - starts[k[at:to]], n)])
            points = np.minimum(100, 100 * (total[at:to] + np.maximum.reduceat(geometry, start)) // full[at:to])
            out[i[at:to], k[at:to]] = np.where(points >= LEAST_SCORE, points, 0)
    return out


def _members(codes: np.ndarray) -> dict:
    """Places of each code."""
    by = np.argsort(codes, kind="stable")
    found, starts = np.unique(codes[by], return_index=True)
    return dict(zip(found.tolist(), np.split(by, starts[1:])))


def _pairs(n: int, partners: Callable[[int], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each of n numbers with its partners, in blocks of up to ``BLOCK`` pairs or one number."""
    own, size = [], 0
    for i in range(n + 1):
        found = partners(i) if i < n else None
        if own and (found is None or size + len(found) > BLOCK):
            yield np.repeat([k for k, _ in own], [len(x) for _, x in own]), np.concatenate([x for _, x in own])
            own, size = [], 0
        if found is not None and len(found):
            own.append((i, found))
            size += len(found)


def _blocks(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges whose counts sum up to ``BLOCK`` or are one item."""
    ends, low = np.cumsum(counts), 0
    while low < len(counts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BLOCK, side="right")))
        yield low, high
        low = high


def _geometries(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``_geometry`` of boxes line by line."""
    sizes = np.zeros(len(a))
    for s in (2, 3):
        some = (a[:, s] != 0) & (b[:, s] != 0)
        sizes += np.floor(np.minimum(a[:, s], b[:, s]) / np.where(some, np.maximum(a[:, s], b[:, s]), 1) * 10 + 0.5) * some
    near = np.minimum(np.abs(a[:, 0] - b[:, 0]), 32) + np.minimum(np.abs(a[:, 1] - b[:, 1]), 32)
    return np.minimum(20, sizes // 2 + (20 - np.where(near < 20, near, 20)) // 2).astype(np.int64)


def _unique(rows, tracks, key_of_row, keys_of_track, admitted) -> Iterator[tuple]:
    """(row, track) where a key belongs to one row and to one track only that is admitted."""
    owners = defaultdict(list)
    count = Counter(key_of_row(r) for r in rows)
    for t in tracks:
        for k in count.keys() & keys_of_track(t):
            owners[k].append(t)
    for r in rows:
        k = key_of_row(r)
        able = [t for t in owners.get(k, ()) if admitted(r, t)] if k is not None and count[k] == 1 else []
        if len(able) == 1:
            yield r, able[0]


def _as_scores(points: np.ndarray, layers: list, numbers: list) -> Scores:
    """Scores by layer and track, without layers and tracks that have none; of one layer's rows the last that has one counts."""
    ids = sorted(set(layers))
    if len(ids) == len(layers):
        merged = points[sorted(range(len(layers)), key=layers.__getitem__)]
    else:
        row, merged = {k: i for i, k in enumerate(ids)}, np.zeros((len(ids), len(numbers)), dtype=points.dtype)
        for k, own in zip(layers, points):
            merged[row[k], own > 0] = own[own > 0]
    rows, columns = (np.flatnonzero(merged.max(axis=k, initial=0)) for k in (1, 0))
    merged = merged[np.ix_(rows, columns)].astype(np.int16)
    return Scores([ids[i] for i in rows], [numbers[c] for c in columns], np.where(merged > 0, merged + EDGE_BONUS, 0))


def _sides(pairs: np.ndarray, n: int) -> list:
    """Of what an observation overlaps, by its place: what comes after it, and what before."""
    if not len(pairs):
        return [lambda k: pairs[:, 0]] * 2
    out = []
    for own, other in ((0, 1), (1, 0)):
        by = np.argsort(pairs[:, own], kind="stable")
        others, bounds = pairs[by, other], np.searchsorted(pairs[by, own], np.arange(n + 1)).tolist()
        out.append(lambda k, others=others, bounds=bounds: others[bounds[k] : bounds[k + 1]])
    return out


def associate(rows: list, protect_new: bool, crossings: bool = False, by_source: bool = False, pairs: dict | None = None) -> tuple[list[Track], dict]:
    """Tracks of one document, and (frame, layer) to (track, phase, score, margin).

    From the anchor frame on, wrapping: unique names, unique pixels, then the best assignment of
    what is left; an ambiguous or unlike observation begins a track. With ``protect_new`` two or
    more generic names that appear for the first time together begin tracks of their own. No phase
    takes a track by which an observation would change order with one that it overlaps (FLT-13),
    except with ``crossings``, where z-indices are to make up for it. With ``by_source`` an
    observation joins the one track that holds its source layer only, or begins one (JN-08).
    ``pairs`` are those of ``overlapping`` by frame, if they are known.
    """
    frames: dict = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.frame, r.place)):
        frames[r.frame].append(r)
    if not frames:
        return [], {}
    anchor, order = anchor_frame(frames), sorted(frames)
    order = order[order.index(anchor) :] + order[: order.index(anchor)]
    tracks: list[Track] = []
    decided: dict = {}
    known: set = set()
    selecting = selecting_groups(rows)
    slots = {(r.frame, r.layer): {p: g for p, g in zip([None, *_above(r)], _above(r)) if g in selecting} for r in rows}
    for f in order:
        now = {id(r): k for k, r in enumerate(frames[f])}
        free = set(range(len(tracks)))
        left = dict(enumerate(frames[f]))
        median = [t.median for t in tracks]
        met = np.zeros((0, 2), dtype=np.int64) if crossings else overlapping(frames[f]) if pairs is None else pairs[f]
        above, under = _sides(met, len(frames[f]))
        least, most = np.full(len(frames[f]), -np.inf), np.full(len(frames[f]), np.inf)  # medians that an observation may join

        def take(row, track, phase, points=0, margin=0):
            track.add(row, now[id(row)], slots[row.frame, row.layer])
            free.discard(track.number)
            del left[now[id(row)]]
            decided[row.frame, row.layer] = (track.number, phase, points, margin)

        def begin(row, phase):
            tracks.append(Track(len(tracks)))
            take(row, tracks[-1], phase)

        if f == anchor:
            for r in list(left.values()):
                begin(r, "anchor")
        open_tracks = lambda: [tracks[i] for i in sorted(free)]
        if by_source:
            for r in list(left.values()):
                own = [t for t in open_tracks() if all(s.layer == r.layer for s in t.seen)]
                take(r, own[0], "source") if len(own) == 1 else begin(r, "new")

        def safe(row, track):
            return least[now[id(row)]] <= median[track.number] <= most[now[id(row)]]

        def admitted(row, track):
            return track.number in free and identity_allowed(row, track) and safe(row, track)

        def keep(row, track, phase):
            place, at = now[id(row)], median[track.number]
            for limit, bound, others in ((least, np.maximum, above(place)), (most, np.minimum, under(place))):
                if others.size:
                    limit[others] = bound(limit[others], at)
            take(row, track, phase)

        for r, t in _unique(list(left.values()), open_tracks(), lambda r: None if r.generic else r.name, lambda t: t.names, admitted):
            keep(r, t, "name")
        for r, t in _unique(list(left.values()), open_tracks(), lambda r: r.content, lambda t: t.contents, admitted):
            keep(r, t, "pixels")
        fresh = [r for r in left.values() if r.generic and r.name not in known]
        if protect_new and len(fresh) >= 2:
            for r in fresh:
                begin(r, "new")
        places, able = list(left), open_tracks()
        points = _scored(list(left.values()), places, able, None if crossings else [least[places], most[places]], slots)
        own = {r.layer: r for r in left.values()}
        at = {k: now[id(r)] for k, r in own.items()}
        scores = _as_scores(points, [r.layer for r in left.values()], [t.number for t in able])
        chosen, ambiguous = best_matching(scores)
        kept = sorted(chosen.items(), key=lambda c: at[c[0]])
        kept = kept if crossings else uncross(kept, at, {t.number: t.median for t in able}, scores, lambda a, b: alpha_overlap(own[a], own[b]))
        for layer, number in kept:
            others = scores.weight[scores.row[layer]].copy()
            others[scores.column[number]] = 0
            take(own[layer], tracks[number], "score", scores[layer, number], max(0, scores[layer, number] - max(0, int(others.max()) - EDGE_BONUS)))
        for r in list(left.values()):
            begin(r, "ambiguous" if r.layer in ambiguous else "new")
        known.update(r.name for r in frames[f])
    return tracks, decided


def track_votes(tracks: list[Track], decided: dict, frames: dict, pairs: dict | None = None) -> dict:
    """In how many frames one of two overlapping tracks comes before the other."""
    return {(a, b): (n, m) for a, b, n, m in zip(*(x.tolist() for x in _votes(len(tracks), decided, frames, pairs)))}


def _votes(n: int, decided: dict, frames: dict, pairs: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower and the higher track of each pair, and how often either comes first."""
    codes, counts = np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.int64)
    for f, rows in frames.items():
        own = pairs[f] if pairs else overlapping(rows)
        if len(own):
            s, t = np.array([decided[r.frame, r.layer][0] for r in rows])[own.T]
            added = np.stack([s < t, s >= t], axis=1).astype(np.int64)
            codes, counts = np.concatenate([codes, np.minimum(s, t) * n + np.maximum(s, t)]), np.concatenate([counts, added])
            codes, number = np.unique(codes, return_inverse=True)
            counts = np.stack([np.bincount(number, counts[:, k]) for k in (0, 1)], axis=1).astype(np.int64)
    return codes // max(n, 1), codes % max(n, 1), counts[:, 0], counts[:, 1]


def display_name(track: Track) -> str:
    names = list(dict.fromkeys(r.name for r in track.seen))
    return names[0] if len(names) == 1 else f"{names[0]} / {names[1]}" + (" …" if len(names) > 2 else "")


def plan_document(pdf: pd.DataFrame, protect_new: bool = True, crossings: bool = False) -> pd.DataFrame:
    """The plan of one document: its tracks, their order, and the z-indices of their cels."""
    rows = list(pdf.itertuples(index=False))
    frames: dict = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.frame, r.place)):
        frames[r.frame].append(r)
    pairs = {f: overlapping(own) for f, own in frames.items()}
    tracks, decided = associate(rows, protect_new, crossings, pairs=pairs)
    base = {t.number: t.places[0] for t in tracks}
    ranked = sorted(base, key=lambda n: (base[n], n))
    anchor = np.empty(len(ranked), dtype=np.int64)
    anchor[ranked] = np.arange(len(ranked))
    first, second, reason = agreed_edges(*_votes(len(tracks), decided, frames, pairs), anchor.astype(float))
    planned = [ranked[k] for k in ranked_order(len(ranked), anchor[first[reason == 0]], anchor[second[reason == 0]])]
    place = np.empty(len(planned), dtype=np.int64)
    place[planned] = np.arange(len(planned))
    names = [display_name(t) for t in tracks]
    out = []
    for f, own in frames.items():
        here = np.array([decided[r.frame, r.layer][0] for r in own])
        number, rank = np.unique(place[here], return_inverse=True)  # of the tracks of this frame, as planned
        ends = rank[pairs[f]]
        ends = ends[ends[:, 0] != ends[:, 1]]
        z = z_indices(planned, [planned[number[k]] for k in ranked_order(len(number), ends[:, 0], ends[:, 1])])
        for r, n in zip(own, here.tolist()):
            _, phase, points, margin = decided[r.frame, r.layer]
            out.append((r.doc_id, r.frame, r.layer, n, int(place[n]), names[n], z[n], phase, points, margin))
    return pd.DataFrame(out, columns=[c.split()[0] for c in PLAN.split(", ")])


def groups_above(layers: DataFrame) -> DataFrame:
    """doc_id, source_layer_id, containers: the ids of the groups above each layer, outermost first."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parent = {int(k): None if pd.isna(p) else int(p) for k, p in zip(pdf.source_layer_id, pdf.parent_layer_id)}
        out = []
        for k in parent:
            above, at = [], parent[k]
            while at is not None and at not in above:  # a cycle ends
                above.append(at)
                at = parent.get(at)
            out.append((pdf.doc_id.iloc[0], k, above[::-1]))
        return pd.DataFrame(out, columns=["doc_id", "source_layer_id", "containers"])

    return layers.select("doc_id", "source_layer_id", "parent_layer_id").groupBy("doc_id").applyInPandas(one, "doc_id string, source_layer_id bigint, containers array<bigint>")


def observations(layers: DataFrame, cels: DataFrame) -> DataFrame:
    """Visible drawings per playback position: names, place, geometry, the hash of their content and their drawn pixels."""
    named = layers.where("kind <> 'group' AND visible").withColumn("parsed", parsed_name(F.col("name")))
    named = named.select("doc_id", "source_layer_id", "child_ordinal", "parsed.normalized", "parsed.base", F.coalesce(F.col("parent_layer_id").cast("string"), F.lit("")).alias("path"))
    named = named.join(groups_above(layers), ["doc_id", "source_layer_id"])
    seen = cels.where("pixels IS NOT NULL").select("doc_id", "source_layer_id", "frame_index", "x", "y", "width", "height", content_key().alias("content"), drawn_bits(F.col("pixels")).alias("alpha"))
    place = F.row_number().over(Window.partitionBy("doc_id", "frame_index").orderBy("child_ordinal", "source_layer_id")) - 1
    together = seen.join(named, ["doc_id", "source_layer_id"]).repartition("doc_id")  # serves the places and the plan
    return together.select(
        "doc_id", F.col("frame_index").alias("frame"), F.col("source_layer_id").alias("layer"), place.cast("int").alias("place"), F.col("normalized").alias("name"),
        "base", is_generic_name(F.col("base")).alias("generic"), "path", "x", "y", "width", "height", "content", F.lit(False).alias("locked"), "alpha", "containers",
    )


def plan_tracks(observed: DataFrame, protect_new: bool = True, crossings: bool = False) -> DataFrame:
    """``plan_document`` for every document; see ``PLAN`` for the columns."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return plan_document(pdf, protect_new, crossings)

    return observed.groupBy("doc_id").applyInPandas(one, PLAN)


def unassigned(observed: DataFrame, plan: DataFrame) -> DataFrame:
    """Conservation: observations that aren't in the plan exactly once, and the reverse."""
    a = observed.select("doc_id", "frame", "layer")
    b = plan.select("doc_id", "frame", "layer")
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def group_votes(plan: DataFrame, observed: DataFrame) -> DataFrame:
    """The group of each track: the path that most of its cels have, by two thirds of the document's
    frames and four fifths of its cels; none on a tie."""
    frames = observed.groupBy("doc_id").agg(F.count_distinct("frame").alias("frames"))
    own = plan.join(observed.select("doc_id", "frame", "layer", "path"), ["doc_id", "frame", "layer"])
    votes = own.groupBy("doc_id", "track", "path").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("doc_id", "track")
    top = votes.withColumns({"total": F.sum("votes").over(w), "rank": F.rank().over(w.orderBy(F.desc("votes")))}).where("rank = 1")
    best = top.groupBy("doc_id", "track").agg(F.min("path").alias("path"), F.count("*").alias("leaders"), F.max("votes").alias("votes"), F.max("total").alias("total"))
    wins = (F.col("leaders") == 1) & (F.col("votes") * 3 >= F.col("frames") * 2) & (F.col("votes") * 5 >= F.col("total") * 4)
    return best.join(frames, "doc_id").select("doc_id", "track", F.when(wins, F.col("path")).alias("group_path"))
