"""Small exact solvers that a document's plan needs: assignment, consensus, stable orders."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Hashable, Iterable, Mapping, Sequence

import numpy as np

#: Weight of an edge besides its score, so that the solver weighs edges and not only their number (fixed value).
EDGE_BONUS = 100
#: Why an edge of a consensus is left out; 0 is none.
REASONS = [None, "undecided", "anchor", "cycle"]


def _assign(weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Largest total of a weight matrix (rows to distinct columns, or none): Hungarian method with potentials.

    Returns the total, each row's column or -1, and which rows have this column in every optimum.
    """
    rows, columns = weight.shape
    cost = np.hstack([weight.max(initial=0) - weight, np.full((rows, rows), weight.max(initial=0), dtype=weight.dtype)])  # a dummy for every row
    width = columns + rows
    u, v, match = np.zeros(rows + 1), np.zeros(width + 1), np.zeros(width + 1, dtype=int)
    for row in range(1, rows + 1):
        match[0], at = row, 0
        least, back, done = np.full(width + 1, np.inf), np.zeros(width + 1, dtype=int), np.zeros(width + 1, dtype=bool)
        while match[at]:
            done[at] = True
            reduced = cost[match[at] - 1] - u[match[at]] - v[1:]
            better = reduced < least[1:]
            better &= ~done[1:]
            np.copyto(least[1:], reduced, where=better)
            back[1:][better] = at
            taken = np.flatnonzero(done)
            open_ones = least.copy()
            open_ones[taken] = np.inf
            best = int(np.argmin(open_ones))
            delta = least[best]
            u[match[taken]] += delta
            v[taken] -= delta
            held = least[taken]
            least -= delta
            least[taken] = held
            at = best
        while at:
            match[at], at = match[back[at]], back[at]
    given = np.zeros(rows, dtype=int)
    taken = np.flatnonzero(match[1:])
    given[match[1:][taken] - 1] = taken
    chosen = np.where(given < columns, given, -1)
    picked = chosen >= 0
    chosen[picked & (weight[np.arange(rows), np.maximum(chosen, 0)] <= 0)] = -1
    total = sum(float(weight[i, c]) for i, c in enumerate(chosen) if c >= 0)
    return float(total), chosen, ~_exchangeable(np.array([own - low == v[1:] for own, low in zip(cost, u[1:])]), v[1:] == 0, given)


def _exchangeable(tight: np.ndarray, spare: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Rows that have another column in some optimum, by what the potentials of one optimum leave tight.

    Optima differ by cycles of tight edges and by chains from a column that may go without a row
    (``spare``) to one that has none. The last node stands for such columns, so both are cycles.
    """
    rows = len(given)
    tight[np.arange(rows), given] = False
    step = np.zeros((rows + 1, rows + 1), dtype=bool)
    step[:rows, :rows] = tight[:, given]
    unused = np.ones(tight.shape[1], dtype=bool)
    unused[given] = False
    step[:rows, rows] = tight[:, unused].any(axis=1)
    step[rows, :rows] = spare[given]
    return _on_cycles(step)[:rows]


def _on_cycles(step: np.ndarray) -> np.ndarray:
    """Nodes of a graph without loops that lie on a cycle."""
    out, alive = np.zeros(len(step), dtype=bool), np.ones(len(step), dtype=bool)

    def reached(way: np.ndarray, start: int) -> np.ndarray:
        seen, front = np.zeros(len(step), dtype=bool), np.array([start])
        while front.size:
            found = way[front].any(axis=0) & alive & ~seen
            seen |= found
            front = np.flatnonzero(found)
        return seen

    while True:
        while True:  # what nothing leads to or from
            kept = alive & step[:, alive].any(axis=1) & step[alive].any(axis=0)
            if kept.sum() == alive.sum():
                break
            alive = kept
        if not alive.any():
            return out
        start = int(np.argmax(alive))
        own = reached(step, start) & reached(step.T, start)
        out |= own
        alive &= ~own
        alive[start] = False


class Scores(Mapping):
    """Scores by (left, right) as a matrix of weights, 0 where there is no edge; both ends in order."""

    def __init__(self, left: Sequence, right: Sequence, weight: np.ndarray):
        self.left, self.right, self.weight = list(left), list(right), weight
        self.row, self.column = {a: i for i, a in enumerate(left)}, {b: i for i, b in enumerate(right)}

    def __getitem__(self, edge: tuple) -> int:
        weight = self.weight[self.row[edge[0]], self.column[edge[1]]]
        if not weight:
            raise KeyError(edge)
        return int(weight) - EDGE_BONUS

    def __iter__(self):
        return ((self.left[i], self.right[c]) for i, c in zip(*np.nonzero(self.weight)))

    def __len__(self) -> int:
        return int(np.count_nonzero(self.weight))


def best_matching(scores: Mapping[tuple[Hashable, Hashable], int]) -> tuple[dict, set]:
    """The assignment of most weight and the left ends whose assignment isn't unique.

    An edge weighs ``EDGE_BONUS`` plus its score. Where an optimum is without a chosen edge, its left
    end is ambiguous and stays unassigned.
    """
    if not scores:
        return {}, set()
    if isinstance(scores, Scores):
        left, right, weight = scores.left, scores.right, scores.weight
    else:
        left, right = sorted({a for a, _ in scores}), sorted({b for _, b in scores})
        row, column = {a: i for i, a in enumerate(left)}, {b: i for i, b in enumerate(right)}
        weight = np.zeros((len(left), len(right)))
        for (a, b), score in scores.items():
            weight[row[a], column[b]] = EDGE_BONUS + score
    _, chosen, sure = _assign(weight)
    out = {left[i]: right[c] for i, c in enumerate(chosen) if c >= 0 and sure[i]}
    return out, {left[i] for i, c in enumerate(chosen) if c >= 0 and not sure[i]}


def ranked_order(n: int, first: np.ndarray, second: np.ndarray) -> list[int]:
    """Topological order of 0 to n - 1; ties, and cycles, by the lowest number."""
    code = np.unique(first.astype(np.int64) * n + second)
    first, second = code // max(n, 1), code % max(n, 1)
    bounds = np.searchsorted(first, np.arange(n + 1)).tolist()
    waits = np.bincount(second, minlength=n)
    ready = np.flatnonzero(waits == 0).tolist()
    done, out, least = [False] * n, [], 0
    while len(out) < n:
        if ready:
            i = heapq.heappop(ready)
        else:
            while done[least]:
                least += 1
            i = least  # a cycle
        if done[i]:
            continue
        done[i] = True
        out.append(i)
        if bounds[i] < bounds[i + 1]:
            after = second[bounds[i] : bounds[i + 1]]
            waits[after] -= 1
            for b in after[waits[after] == 0].tolist():
                if not done[b]:
                    heapq.heappush(ready, b)
    return out


def stable_order(ids: Iterable, edges: Iterable[tuple], base: Mapping) -> list:
    """Topological order with ties, and cycles, broken by the base order."""
    ids = sorted(dict.fromkeys(ids), key=lambda i: (base.get(i, 0), i))
    number = {i: k for k, i in enumerate(ids)}
    known = np.array([(number[a], number[b]) for a, b in edges if a in number and b in number and a != b], dtype=np.int64).reshape(-1, 2)
    return [ids[k] for k in ranked_order(len(ids), known[:, 0], known[:, 1])]


def strict_order(ids: Iterable, edges: Iterable[tuple], base: Mapping) -> list | None:
    """As ``stable_order``, but none where there is a cycle."""
    ids, edges = list(ids), [(a, b) for a, b in edges if a != b]
    order = stable_order(ids, edges, base)
    place = {i: k for k, i in enumerate(order)}
    return order if all(place[a] < place[b] for a, b in edges if a in place and b in place) else None


def _without_cycles(first: np.ndarray, second: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which edges, taken in turn, close no cycle with those that were taken before.

    Keeps a topological order, ``place`` at first: an edge that agrees with it is taken as it is,
    others search what lies between their ends only, and move that (Pearce and Kelly).
    """
    n, place, kept = len(place), place.copy(), np.ones(len(first), dtype=bool)
    sides = []
    for own, other in ((first, second), (second, first)):
        edges = np.argsort(own, kind="stable")
        sides.append((edges, np.searchsorted(own[edges], np.arange(n + 1)).tolist(), other))

    seen, turn = np.zeros(n, dtype=np.int64), 0  # when a node was last reached

    def between(side: int, start: int, k: int, low: int, high: int) -> np.ndarray:
        nonlocal turn
        edges, bounds, other = sides[side]
        turn += 1
        front, out = np.array([start]), [np.array([start])]
        seen[start] = turn
        while front.size:
            own = np.concatenate([edges[bounds[i] : bounds[i + 1]] for i in front.tolist()])
            found = other[own]
            at = place[found]
            front = np.unique(found[(at >= low) & (at <= high) & (seen[found] != turn) & (own < k) & kept[own]])
            seen[front] = turn
            out.append(front)
        return np.concatenate(out)

    k = 0
    while k < len(first):
        against = np.flatnonzero(place[first[k : k + 4096]] >= place[second[k : k + 4096]])
        if not against.size:
            k += 4096
            continue
        k += int(against[0])
        a, b = int(first[k]), int(second[k])
        low, high = place[b], place[a]
        after = between(0, b, k, low, high)
        if seen[a] == turn:
            kept[k] = False
        else:
            moved = [between(1, a, k, low, high), after]
            moved = np.concatenate([m[np.argsort(place[m])] for m in moved])
            place[moved] = np.sort(place[moved])
        k += 1
    return kept


def agreed_edges(a: np.ndarray, b: np.ndarray, forward: np.ndarray, reverse: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``consensus_edges`` of items by number; anchor: the place of each item, nan for none.

    Returns what comes first and second in every edge, the strongest first, and its reason's number in ``REASONS``.
    """
    winner, loser = np.maximum(forward, reverse), np.minimum(forward, reverse)
    by = np.lexsort((b, a, loser - winner, -winner))
    ahead = (forward >= reverse)[by]
    first, second = np.where(ahead, a[by], b[by]), np.where(ahead, b[by], a[by])
    winner, loser = winner[by], loser[by]
    reason = np.where((loser > 0) & (np.abs(anchor[first] - anchor[second]) > 1), REASONS.index("anchor"), 0)
    reason[~((loser == 0) | (winner >= 2) & (winner >= loser + 2) & (3 * winner >= 2 * (winner + loser)))] = REASONS.index("undecided")
    place = np.empty(len(anchor), dtype=np.int64)
    place[np.argsort(anchor, kind="stable")] = np.arange(len(anchor))
    left = np.flatnonzero(reason == 0)
    reason[left[~_without_cycles(first[left], second[left], place)]] = REASONS.index("cycle")
    return first, second, reason


def consensus_edges(votes: Mapping[tuple, tuple[int, int]], anchor: Mapping, strict: bool = False) -> tuple[list, list]:
    """(accepted edges, refusals) of pairwise votes {(a, b): (a before b, b before a)}.

    Strongest pairs first. A vote counts if it is unanimous, or ahead by two votes and by two
    thirds; one that isn't unanimous doesn't move what the anchor order has further apart than one
    place; an edge that would close a cycle is left out. With ``strict`` each of these is an error.
    """
    ids = sorted({i for pair in votes for i in pair})
    number = {i: k for k, i in enumerate(ids)}
    ends = np.array([(number[a], number[b]) for a, b in votes], dtype=np.int64).reshape(-1, 2)
    counts = np.array(list(votes.values()), dtype=np.int64).reshape(-1, 2)
    found = agreed_edges(*ends.T, *counts.T, np.array([anchor.get(i, np.nan) for i in ids], dtype=float))
    edges, refused = [], []
    for k, m, r in zip(*(x.tolist() for x in found)):
        first, second = ids[k], ids[m]
        if not r:
            edges.append((first, second))
        elif strict:
            pair = votes[first, second] if (first, second) in votes else votes[second, first]
            raise ValueError(f"{REASONS[r]}: {first} before {second} ({max(pair)} to {min(pair)})")
        else:
            refused.append((first, second, REASONS[r]))
    return edges, refused


def z_indices(current: Sequence, wanted: Sequence) -> dict:
    """How far each item moves so that the wanted order fills the slots in use; beyond 16 bits is an error."""
    place = {item: k for k, item in enumerate(current)}
    slots = sorted(place[item] for item in wanted)
    out = {item: slot - place[item] for item, slot in zip(wanted, slots)}
    if any(not -32768 <= z <= 32767 for z in out.values()):
        raise ValueError("z-index beyond 16 bits")
    return out


def uncross(assigned: list[tuple], order: Mapping, median: Mapping, scores: Mapping, overlap: Callable | None = None) -> list[tuple]:
    """Swaps or drops assignments whose items overlap and stand in the opposite order of their tracks.

    Without ``overlap``, a test of two items, all of them overlap. The first crossing is repaired
    until none is left; of equal scores the first assignment is dropped. Equal medians don't cross,
    and a swap leaves fewer pairs in opposite order, so it always ends.
    """
    pairs = list(assigned)
    place = np.array([order[a] for a, _ in pairs])
    track = np.array([median[t] for _, t in pairs])
    alive = np.ones(len(pairs), dtype=bool)

    def crossing(i: int, js: np.ndarray) -> int | None:
        """The first of the places that crosses with i."""
        apart = js[alive[js] & ((place[js] - place[i]) * (track[js] - track[i]) < 0)]
        return next((int(j) for j in apart if overlap is None or overlap(pairs[min(i, j)][0], pairs[max(i, j)][0])), None)

    i = 0
    while i < len(pairs):
        j = crossing(i, np.arange(i + 1, len(pairs))) if alive[i] else None
        if j is None:
            i += 1
            continue
        (a, s), (b, t) = pairs[i], pairs[j]
        if (a, t) in scores and (b, s) in scores:
            pairs[i], pairs[j] = (a, t), (b, s)
            track[i], track[j] = track[j], track[i]
            before = [k for k in (crossing(i, np.arange(i)), crossing(j, np.arange(i))) if k is not None]
            i = min([i, *before])  # what stood before may cross with the changed two
        else:
            alive[i if scores.get((a, s), 0) <= scores.get((b, t), 0) else j] = False
    return [p for p, kept in zip(pairs, alive) if kept]
