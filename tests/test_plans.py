import itertools
import random
import time
from collections import namedtuple

import pandas as pd
import pytest

from stratacel.plans import solvers as Z
from stratacel.plans import tracks as P

Obs = namedtuple("Obs", [c.split()[0] for c in P.OBSERVATION.split(", ")])


def brute(scores):
    left, right = sorted({a for a, _ in scores}), sorted({b for _, b in scores})
    best, options = 0, []
    for pick in itertools.product([None, *right], repeat=len(left)):
        used = [p for p in pick if p is not None]
        if len(set(used)) < len(used) or any(p is not None and (a, p) not in scores for a, p in zip(left, pick)):
            continue
        total = sum(100 + scores[a, p] for a, p in zip(left, pick) if p is not None)
        if total > best:
            best, options = total, []
        if total == best:
            options.append(dict((a, p) for a, p in zip(left, pick) if p is not None))
    return best, options


@pytest.mark.parametrize("seed", range(40))
def test_matching_and_ties_against_brute_force(seed):
    rng = random.Random(seed)
    scores = {(a, b): rng.randrange(40, 48) for a in range(rng.randrange(1, 5)) for b in range(rng.randrange(1, 5)) if rng.random() < 0.7}
    got, ambiguous = Z.best_matching(scores)
    best, options = brute(scores)
    if not scores:
        return
    sure = {a: p for a, p in options[0].items() if all(o.get(a) == p for o in options)}
    assert got == sure
    assert all(sum(100 + scores[e] for e in o.items()) == best for o in options)


def test_orders():
    base = {i: i for i in range(5)}
    assert Z.stable_order(range(5), [(4, 0), (3, 1)], base) == [2, 3, 1, 4, 0]
    assert Z.strict_order(range(3), [(0, 1), (1, 0)], base) is None
    assert sorted(Z.stable_order(range(3), [(0, 1), (1, 2), (2, 0)], base)) == [0, 1, 2]
    edges, refused = Z.consensus_edges({(0, 1): (3, 0), (1, 2): (2, 0), (0, 2): (0, 1), (2, 3): (2, 2)}, {})
    assert edges == [(0, 1), (1, 2)] and {r[2] for r in refused} == {"cycle", "undecided"}
    with pytest.raises(ValueError):
        Z.consensus_edges({(2, 3): (2, 2)}, {}, strict=True)
    assert Z.consensus_edges({(0, 5): (1, 9)}, {0: 0, 5: 4})[1] == [(5, 0, "anchor")]
    assert Z.z_indices("abc", "cab") == {"c": -2, "a": 1, "b": 1}


def test_uncrossing_ends():
    order, median = {"a": 0, "b": 1}, {1: 5, 2: 5, 3: 9, 4: 2}
    assert Z.uncross([("a", 1), ("b", 2)], order, median, {}) == [("a", 1), ("b", 2)]
    every = {(o, t): 50 for o in "ab" for t in (3, 4)}
    assert Z.uncross([("a", 3), ("b", 4)], order, median, every) == [("a", 4), ("b", 3)]
    assert Z.uncross([("a", 3), ("b", 4)], order, median, {("a", 3): 60, ("b", 4): 50}) == [("a", 3)]


def document(seed):
    rng = random.Random(seed)
    rows = []
    for f in range(rng.randrange(1, 6)):
        for k in range(rng.randrange(1, 6)):
            n = rng.randrange(6)
            name = rng.choice([f"part {n}", f"layer {n}"])
            rows.append(Obs("d", f, 100 * f + k, k, name, name, name.startswith("layer"), rng.choice(["", "g"]), rng.randrange(40), rng.randrange(40), 10, 10 + n, f"c{rng.randrange(9)}", False))
    return rows


@pytest.mark.parametrize("protect", [True, False])
def test_invariants_over_256_seeds(protect):
    for seed in range(256):
        rows = document(seed)
        tracks, decided = P.associate(rows, protect)
        assert set(decided) == {(r.frame, r.layer) for r in rows}
        assert sum(len(t.seen) for t in tracks) == len(rows)
        assert all(len({s.frame for s in t.seen}) == len(t.seen) for t in tracks)
        assert P.associate(rows, protect)[1] == decided
        random.Random(seed).shuffle(rows)
        assert P.associate(rows, protect)[1] == decided
        if protect:
            assert len(tracks) >= 1


def test_unique_names_and_pixels_come_before_scores():
    make = lambda f, layer, place, name, content, x=0: Obs("d", f, layer, place, name, name, name.startswith("layer"), "", x, 0, 8, 8, content, False)
    rows = [make(0, 1, 0, "eye", "a"), make(0, 2, 1, "layer 1", "b", 30), make(1, 3, 0, "layer 9", "b", 30), make(1, 4, 1, "eye", "z")]
    _, decided = P.associate(rows, True)
    assert decided[1, 4][:2] == (decided[0, 1][0], "name") and decided[1, 3][:2] == (decided[0, 2][0], "pixels")


Drawn = namedtuple("Drawn", [c.split()[0] for c in P.DRAWN.split(", ")])


def drawn(f, layer, place, name, x=0, pixels="1111", **more):
    """A drawing of 2 x 2 pixels, of which ``pixels`` says which are drawn."""
    alpha = bytes([int(pixels.ljust(8, "0"), 2)])
    row = Drawn(*[None] * len(Drawn._fields))._replace(doc_id="d", frame=f, layer=layer, place=place, name=name, base=name, generic=name.startswith("layer"), path="", x=x, y=0)
    return row._replace(width=2, height=2, content=f"{pixels}{layer}", locked=False, alpha=alpha, **more)


def test_overlap_is_of_drawn_pixels():
    assert not P.alpha_overlap(drawn(0, 1, 0, "a", 0, "1010"), drawn(0, 2, 1, "b", 0, "0101"))
    assert P.alpha_overlap(drawn(0, 1, 0, "a", 0, "1010"), drawn(0, 2, 1, "b", -1, "0101"))
    assert not P.alpha_overlap(drawn(0, 1, 0, "a"), drawn(0, 2, 1, "b", 2))


@pytest.mark.parametrize("second, z", [("0101", [0, 0]), ("1111", [1, -1])])
def test_only_drawn_pixels_move_cels(second, z):
    """Both frames' boxes overlap; the order changes in the second, which matters if pixels meet there."""
    rows = [drawn(f, k, p, n, 0, b) for f, order in enumerate(("ab", "ab", "ba")) for p, n in enumerate(order) for k, b in [(10 * f + p, "1010" if n == "a" else second)]]
    plan = P.plan_document(pd.DataFrame(rows), crossings=True).set_index(["frame", "track_name"])
    assert [plan.z_index[2, n] for n in "ab"] == z
    tracks, decided = P.associate(rows, True, crossings=True)
    votes = P.track_votes(tracks, decided, {f: [r for r in rows if r.frame == f] for f in range(3)})
    assert votes == ({} if second == "0101" else {(0, 1): (2, 1)})


def test_uncrossing_wants_overlap():
    order, median, scores = {"a": 0, "b": 1}, {3: 9, 4: 2}, {("a", 3): 60, ("b", 4): 50}
    crossing = [("a", 3), ("b", 4)]
    assert Z.uncross(crossing, order, median, scores, lambda a, b: False) == crossing
    assert Z.uncross(crossing, order, median, scores, lambda a, b: True) == [("a", 3)]
    assert Z.uncross(crossing, order, median, {e: 50 for e in crossing}) == [("b", 4)]


def reordered(step):
    """Two named layers whose order changes in the second frame; names say which track is whose."""
    first = [drawn(0, k, k, n, step * k) for k, n in enumerate(("arm 1", "leg 1"))]
    second = [drawn(1, 10 + k, k, n, step * (1 - k)) for k, n in enumerate(("leg 2", "arm 2"))]
    return [r._replace(base=r.name[:3], path=r.name[:3]) for r in first + second]


def test_layers_that_change_order_beside_each_other_stay():
    _, decided = P.associate(reordered(30), True)
    assert decided[1, 10][:2] == (1, "score") and decided[1, 11][:2] == (0, "score")


def test_generic_names_want_groups_that_exclude_each_other():
    make = lambda groups: [drawn(0, 1, 0, "layer 1", containers=[5]), drawn(1, 2, 0, "layer 2", containers=groups)]
    assert P.associate(make([6]), True)[1][1, 2][:2] == (0, "score")
    assert P.associate(make([5]), True)[1][1, 2][:2] == (1, "new")


def swapped(x, names, contents):
    rows = [drawn(f, 10 * f + k, k, n, x * i) for f, order in enumerate(((0, 1), (1, 0))) for k, i in enumerate(order) for n in [names[f][i]]]
    return [r._replace(base=r.name[:3], content=c) for r, c in zip(rows, contents)]


@pytest.mark.parametrize("names, contents, phase", [(("ab", "ab"), "pqrs", "name"), (("ab", "cd"), "pqqp", "pixels")])
def test_no_phase_reverses_what_overlaps(names, contents, phase):
    beside, over = (P.associate(swapped(x, names, contents), True)[1] for x in (30, 1))
    assert beside[1, 10][:2] == (1, phase) and beside[1, 11][:2] == (0, phase)
    assert over[1, 10][:2] == (1, phase) and over[1, 11][1] != phase
    assert P.associate(swapped(1, names, contents), True, crossings=True)[1] == {**beside}


def test_source_identity_looks_at_all_past_cels():
    rows = [drawn(0, 1, 0, "a"), drawn(1, 2, 0, "a"), drawn(2, 1, 0, "a")]
    assert [P.associate(rows, True, by_source=True)[1][k][:2] for k in ((0, 1), (1, 2), (2, 1))] == [(0, "anchor"), (1, "new"), (0, "source")]
    locked = [r._replace(locked=r.frame == 1) for r in rows]
    assert P.associate(locked, True)[1][1, 2][:2] == (1, "new")


def test_plan_of_a_document():
    out = P.plan_document(pd.DataFrame(document(7)))
    assert len(out) == len(document(7)) and list(out.columns) == [c.split()[0] for c in P.PLAN.split(", ")]
    for _, own in out.groupby("frame"):
        assert len(set(own.track)) == len(own)


def test_plan_is_conserved(spark):
    rows = [r._replace(doc_id=f"d{s}") for s in range(6) for r in document(s)]
    observed = spark.createDataFrame(rows, P.OBSERVATION)
    plan = P.plan_tracks(observed)
    assert P.unassigned(observed, plan).count() == 0
    votes = P.group_votes(plan, observed).collect()
    assert len(votes) == plan.select("doc_id", "track").distinct().count()
    assert P.plan_tracks(observed.limit(0)).count() == 0


def test_many_swaps_leave_nothing_crossing():
    n = 450
    order = {i: i for i in range(n)}
    median = {t: n - t for t in range(n)}
    scores = {(i, t): 50 for i in range(n) for t in range(n)}
    out = Z.uncross([(i, i) for i in range(n)], order, median, scores)
    assert out == [(i, n - 1 - i) for i in range(n)]  # some 10^5 swaps, none dropped


@pytest.mark.parametrize("seed", range(30))
def test_uncross_against_plain_repairs(seed):
    rng = random.Random(seed)
    n = rng.randrange(2, 9)
    order = {i: i for i in range(n)}
    median = {t: rng.randrange(6) for t in range(n)}
    scores = {(i, t): rng.randrange(40, 100) for i in range(n) for t in range(n) if i == t or rng.random() < 0.6}
    touching = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.7}
    pairs = [(i, i) for i in range(n)]
    crossing = lambda p, q: (order[p[0]] - order[q[0]]) * (median[p[1]] - median[q[1]]) < 0 and (p[0], q[0]) in touching
    while True:
        found = next(((i, j) for i in range(len(pairs)) for j in range(i + 1, len(pairs)) if crossing(pairs[i], pairs[j])), None)
        if found is None:
            break
        i, j = found
        (a, s), (b, t) = pairs[i], pairs[j]
        if (a, t) in scores and (b, s) in scores:
            pairs[i], pairs[j] = (a, t), (b, s)
        else:
            pairs.pop(i if scores.get((a, s), 0) <= scores.get((b, t), 0) else j)
    assert Z.uncross([(i, i) for i in range(n)], order, median, scores, lambda a, b: (a, b) in touching) == pairs


def tracks_of(rows, **kw):
    return P.associate(rows, **{"protect_new": True} | kw)


def test_fact_a_renamed_generic_layer_without_container_evidence():
    rows = [drawn(0, 1, 0, "rear foot"), drawn(0, 2, 1, "layer 15", 5), drawn(1, 3, 0, "layer 16")]
    for protect in (True, False):
        tracks, decided = tracks_of(rows, protect_new=protect)
        assert len(tracks) == 3 and decided[1, 3][0] != decided[0, 1][0]


def test_fact_generics_in_an_exclusive_container():
    one = [drawn(0, 1, 0, "layer 1", containers=[5]), drawn(1, 2, 0, "layer 2", containers=[6])]
    assert len(tracks_of(one)[0]) == 1
    named = [drawn(0, 8, 1, "torso", 60), drawn(0, 9, 2, "head", 90)]  # make the first frame the anchor
    two = [*named, *one, drawn(1, 3, 1, "layer 3", 20, containers=[6])]
    assert len(tracks_of(two, protect_new=False)[0]) == 2 + len(named)
    tracks, decided = tracks_of(two)
    assert len(tracks) == 3 + len(named) and [decided[1, k][1] for k in (2, 3)] == ["new", "new"]


def test_fact_order_seen_reversed_three_times():
    edges, refused = Z.consensus_edges({(0, 1): (1, 3)}, {0: 0, 1: 1})
    assert (edges, refused) == ([(1, 0)], []) and Z.stable_order([0, 1], edges, {0: 0, 1: 1}) == [1, 0]
    assert Z.consensus_edges({(0, 1): (1, 3)}, {0: 0, 1: 1}, strict=True)[1] == []


@pytest.mark.parametrize("step, crossings, tracks, moved", [(1, False, 3, False), (1, True, 2, True), (30, True, 2, False), (30, False, 2, False)])
def test_fact_order_reversed_once(step, crossings, tracks, moved):
    rows = [drawn(f, 10 * f + p, p, n, step * "ab".index(n)) for f, order in enumerate(("ab", "ba")) for p, n in enumerate(order)]
    plan = P.plan_document(pd.DataFrame(rows), crossings=crossings)
    assert plan.track.nunique() == tracks
    assert (plan[plan.frame == 1].z_index != 0).tolist() == [moved, moved] and (plan[plan.frame == 0].z_index == 0).all()


def crowd(seed, layers, frames, side=200, wide=13):
    """Frames of boxes with holes at random places; half the names are unique, the rest change from frame to frame."""
    rng = random.Random(seed)
    rows = []
    for f in range(frames):
        for p, k in enumerate(sorted(range(layers), key=lambda k: k + rng.randrange(4))):
            name = f"part {k}" if k % 2 else rng.choice([f"side {k // 8} {rng.randrange(9)}", f"layer {k}"])
            w, h = rng.randrange(1, wide), rng.randrange(1, 12)
            row = drawn(f, k, p, name, rng.randrange(-9, side), containers=rng.choice([[], [900], [901, 902 + f % 2]]))
            rows.append(row._replace(base=name.rsplit(" ", 1)[0], path=rng.choice(["", "g/a", "g/b"]), y=rng.randrange(side), width=w, height=h, content=f"{k} {rng.randrange(3)}", alpha=rng.randbytes((w * h + 7) // 8)))
    return rows


@pytest.mark.parametrize("seed, wide", [(0, 13), (1, 13), (2, 90), (3, 64)])
def test_overlaps_by_columns(monkeypatch, seed, wide):
    monkeypatch.setattr(P, "FEW_PAIRS", 0)
    monkeypatch.setattr(P, "BLOCK", 50)
    rows = crowd(seed, 70, 1, 40, wide) + [drawn(0, 999, 70, "all", 5)._replace(y=5, width=300, height=300, alpha=None)]
    want = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if P.alpha_overlap(rows[i], rows[j])]
    assert [tuple(p) for p in P.overlapping(rows).tolist()] == want


@pytest.mark.parametrize("crossings", [True, False])
def test_columns_score_as_single_pairs_do(monkeypatch, crossings):
    for seed in range(12):
        rows = crowd(seed, 24, 6, 60)
        rows = [r._replace(locked=r.layer % 11 == seed) for r in rows]
        monkeypatch.setattr(P, "FEW_PAIRS", 10**9)
        want = P.plan_document(pd.DataFrame(rows), crossings=crossings)
        monkeypatch.setattr(P, "FEW_PAIRS", 0)
        monkeypatch.setattr(P, "BLOCK", 40)
        assert P.plan_document(pd.DataFrame(rows), crossings=crossings).equals(want)
        assert {"score", "new", "name"} <= set(want.phase)


def test_a_crowded_document_is_planned_in_seconds():
    rows = crowd(1, 1100, 7)
    began = time.process_time()
    plan = P.plan_document(pd.DataFrame(rows))
    assert len(plan) == len(rows) and time.process_time() - began < 30


@pytest.mark.parametrize("side", [60, 200])
def test_distant_pairs_are_passed_over(monkeypatch, side):
    """Where names and contents change, few pairs of a crowd are compared by boxes; the plan is that of all pairs, each observation once in it."""
    rows = [r._replace(name=f"{r.name} {r.frame}", base=f"{r.base} {r.frame}", content=f"{r.content} {r.frame}", path="g", width=10, height=10, alpha=None) for r in crowd(5, 260, 4, side)]
    monkeypatch.setattr(P, "FEW_PAIRS", 10**9)
    want = P.plan_document(pd.DataFrame(rows))
    monkeypatch.setattr(P, "FEW_PAIRS", 64)
    compared, geometries = [], P._geometries
    monkeypatch.setattr(P, "_geometries", lambda a, b: compared.append(len(a)) or geometries(a, b))
    got = P.plan_document(pd.DataFrame(rows))
    assert got.equals(want) and set(zip(got.frame, got.layer)) == {(r.frame, r.layer) for r in rows} and len(got) == len(rows)
    assert 0 < sum(compared) < 100 * len(rows)


def test_unlike_names_join_as_far_as_they_may():
    """Boxes of one size in one group reach LEAST_SCORE up to a distance of 8, also among many tracks."""
    far = [drawn(0, 100 + k, k, f"far {k}", 1000 + 40 * k)._replace(base=f"far {k}", path="g", y=0, width=9, height=9, content=f"far {k}") for k in range(80)]
    for x, joins in [(8, True), (9, False), (-8, True), (-9, False)]:
        one, two = (drawn(f, k, p, n, at)._replace(base=n, y=0, width=9, height=9, content=n) for f, k, p, n, at in [(0, 1, 80, "one", 0), (1, 2, 0, "two", x)])
        plan = P.plan_document(pd.DataFrame([*far, one, two]))
        assert (plan.set_index("layer").phase[2] == "score") == joins
        assert len(far) + 1 > P.FEW_PAIRS


def test_ambiguity_takes_one_assignment():
    began = time.process_time()
    chains = {(i, c): 50 for i in range(0, 600, 2) for c in (i, i + 1)} | {(i, i): 60 for i in range(1, 600, 2)}
    got, ambiguous = Z.best_matching(chains)
    assert got == {i: i for i in range(600)} and not ambiguous
    got, ambiguous = Z.best_matching(chains | {(i, 600 + i): 60 for i in range(1, 600, 2)})
    assert ambiguous == set(range(600)) and not got
    assert time.process_time() - began < 20


def test_consensus_of_many_edges():
    """Every fourth pair of neighbours is seen reversed most often, and what goes back over them closes cycles."""
    n = 400
    votes = {(a, b): (0, 9) if b == a + 1 and a % 4 == 0 else (0, 1) if (a, b) == (0, n - 1) else (2, 0) for a in range(n) for b in range(a + 1, n)}
    began = time.process_time()
    edges, refused = Z.consensus_edges(votes, {i: i for i in range(n)})
    assert refused == [(n - 1, 0, "cycle")] and len(edges) == len(votes) - 1
    order = Z.stable_order(range(n), edges, {})
    assert order == [k ^ 1 if k % 4 < 2 else k for k in range(n)] and time.process_time() - began < 20
