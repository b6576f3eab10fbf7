import itertools
import json
import random

import pytest

from stratacel.operators import hierarchy as H
from stratacel.operators import visibility as V

LAYER = "doc_id string, layer_id bigint, parent_id bigint, kind string, ordinal int"
STATE = "doc_id string, layer_id bigint, frame_index int, record_present boolean, enabled boolean"


def made(seed):
    rng = random.Random(seed)
    layers, states = [], []
    for d in range(6):
        parents = [None]
        for i in range(1, 12):
            parent = rng.choice(parents)
            kind = rng.choice(["group", "group", "pixel"])
            layers.append((f"d{d}", i, parent, kind, i))
            if kind == "group":
                parents.append(i)
            never = kind == "group" and rng.random() < 0.6
            for f in range(rng.choice([3, 3]) if d else 1):
                states.append((f"d{d}", i, f, rng.random() < 0.5, False if never else rng.random() < 0.5))
    return layers, states


def brute(layers, states, reachable):
    kids, kind, on, rec = {}, {}, {}, {}
    for d, i, p, k, _ in layers:
        kids.setdefault((d, p), []).append(i)
        kind[d, i] = k
    for d, i, f, r, e in states:
        on.setdefault((d, i), {})[f] = e
        rec.setdefault((d, i), []).append(r)

    def below(d, i):
        for c in kids.get((d, i), []):
            yield c
            yield from below(d, c)

    def drawn(d, i, f):
        for c in kids.get((d, i), []):
            if kind[d, c] == "pixel":
                if on[d, c][f]:
                    return True
            elif (on[d, c][f] or container(d, c)) and drawn(d, c, f):
                return True
        return False

    def container(d, i):
        frames = on[d, i]
        if kind[d, i] != "group" or len(frames) < 2 or not any(rec[d, i]) or any(frames.values()):
            return False
        if not any(any(rec[d, c]) for c in below(d, i)):
            return False
        if reachable:
            return sum(drawn(d, i, f) for f in frames) >= 2
        return sum(any(kind[d, c] == "pixel" and on[d, c][f] for c in below(d, i)) for f in frames) >= 2

    return {k for k in kind if container(*k)}


@pytest.mark.parametrize("seed", [1, 2])
def test_structural_containers_against_brute_force(spark, seed):
    layers, states = made(seed)
    ldf, sdf = spark.createDataFrame(layers, LAYER), spark.createDataFrame(states, STATE)
    flat = H.flatten(ldf, "layer_id", "parent_id", "ordinal")
    closed = H.closure(flat, "layer_id")
    flat_any = {(r.doc_id, r.layer_id) for r in V.structural_containers(flat, ldf, closed, sdf).collect()}
    assert flat_any == brute(layers, states, False) and flat_any
    through = V.reachable_containers(flat, ldf, closed, sdf)
    assert {(r.doc_id, r.layer_id) for r in through.collect()} == brute(layers, states, True)
    visible = {(r.doc_id, r.layer_id, r.frame_index): r.visible for r in V.effective_visibility(ldf, closed, sdf, through).collect()}
    own, up, boxes = {(d, i, f): e for d, i, f, _, e in states}, {(d, i): p for d, i, p, *_ in layers}, brute(layers, states, True)
    for d, i, _, kind, _ in layers:
        if kind == "pixel":
            for f in {f for (a, b, f) in own if (a, b) == (d, i)}:
                at, want = i, True
                while at is not None:
                    want &= own[d, at, f] or (d, at) in boxes
                    at = up[d, at]
                assert visible[d, i, f] == want
    bound = {(r.doc_id, r.layer_id) for r in V.timeline_bound(ldf, closed, sdf).collect()}
    assert all(len({own[k[0], k[1], f] for f in range(3)}) == 2 for k in bound)


def test_render_diff(spark):
    red, clear = bytes([9, 0, 0, 255]), bytes([1, 1, 1, 0])
    schema = "doc_id string, frame_index int, width int, height int, pixels binary"
    a = [("d", 0, 1, 2, red + clear), ("d", 1, 1, 1, red), ("d", 2, 1, 1, red), ("d", 3, 1, 1, None)]
    b = [("d", 0, 1, 2, red + bytes(4)), ("d", 1, 1, 1, bytes([9, 0, 0, 254])), ("d", 2, 2, 1, red + red)]
    out = {r.frame_index: tuple(r)[2:] for r in V.render_diff(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    assert out == {0: (True, 0, 0, 1), 1: (True, 1, 1, 0), 2: (False, None, None, None), 3: (False, None, None, None)}


def test_loss_report(spark):
    rows = [("d", i, "mask", "dropped", f"l{i}", "first" if i == 0 else "later") for i in range(12)] + [("d", 50, "effect", "kept", "l9", None)]
    df = spark.createDataFrame(rows, "doc_id string, seq int, code string, disposition string, location string, detail string")
    report = json.loads(V.loss_report(df).first().report)
    assert report["summary"]["total"] == 2 and report["schema_version"] == 3
    assert report["entries"][0] == {"code": "mask", "disposition": "dropped", "count": 12, "detail": "first", "locations": [f"l{i}" for i in range(8)]}
    assert "detail" not in report["entries"][1]
    assert list(itertools.islice(report, 1)) == ["schema_version"]


def test_deep_chains_and_cycles(spark):
    from stratacel.operators.hierarchy import flatten

    depth = 500
    rows = [("d", k, k - 1 if k else None, k % 3) for k in range(depth)]
    rows += [("d", 1000, 1001, 0), ("d", 1001, 1000, 0), ("d", 1002, 1001, 0), ("d", 1003, 5555, 0), ("e", 1, None, 4), ("e", 2, 1, 0), ("e", 3, 1, 1)]
    flat = {(r.doc_id, r.node): r for r in flatten(spark.createDataFrame(rows, "doc_id string, node bigint, parent bigint, ordinal int"), "node", "parent", "ordinal").collect()}
    assert len(flat) == depth + 3
    last = flat["d", depth - 1]
    assert last.depth == depth - 1 and last.path == "/".join(str(k % 3) for k in range(depth)) and last.ancestors == list(range(depth - 1))
    assert [(flat["e", k].path, flat["e", k].ancestors, flat["e", k].depth) for k in (1, 2, 3)] == [("4", [], 0), ("4/0", [1], 1), ("4/1", [1], 1)]
    empty = spark.createDataFrame([], "doc_id string, node bigint, parent bigint, ordinal int")
    assert flatten(empty, "node", "parent", "ordinal").count() == 0
