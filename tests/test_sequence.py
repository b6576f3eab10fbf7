import random

import pytest
from pyspark.sql import functions as F

from stratacel.operators import aggregates as A
from stratacel.operators import compare as D
from stratacel.operators import hierarchy as H
from stratacel.operators import sequence as S


def states(spark, layers, frames, records):
    df = S.resolve_states(
        spark.createDataFrame(layers, "doc_id string, layer_id bigint, kind string, container_group boolean, hidden boolean"),
        spark.createDataFrame([("d", i) for i in frames], "doc_id string, frame_index int"),
        spark.createDataFrame(records, "doc_id string, layer_id bigint, frame_index int, enable boolean"),
    )
    out = {}
    for r in df.orderBy("layer_id", "frame_index").collect():
        out.setdefault(r.layer_id, []).append(r.enabled)
    return out


def test_states_carry_forward_by_policy(spark):
    layers = [("d", 1, "pixel", False, False), ("d", 2, "group", False, False), ("d", 3, "pixel", False, True), ("d", 4, "group", True, False), ("d", 5, "pixel", False, False)]
    records = [
        ("d", 1, 0, True), ("d", 1, 1, False), ("d", 1, 3, None),  # missing at 2: false, and that holds on
        ("d", 2, 0, True), ("d", 2, 1, None), ("d", 2, 3, True),  # a slot: own record or false
        ("d", 4, 0, None), ("d", 4, 1, True), ("d", 4, 2, None), ("d", 4, 3, None),  # a container inherits
        ("d", 5, 0, None), ("d", 5, 1, None), ("d", 5, 2, False), ("d", 5, 3, None),
    ]
    assert states(spark, layers, range(4), records) == {
        1: [True, False, False, False],
        2: [True, False, False, True],
        3: [False] * 4,
        4: [True] * 4,
        5: [True, True, False, False],
    }


def test_sparse_encoding_is_undone(spark):
    rng = random.Random(1)
    rows = [(u, i, rng.choice([True, False, False, None])) for u in range(5) for i in range(30)]
    df = spark.createDataFrame(rows, "u int, i int, v boolean")
    dense = S.carry_forward(df, ["u"], ["i"], F.col("v"), F.lit(False), "state")
    stored = S.sparse_encode(dense, ["u"], ["i"], "state", "stored")
    back = S.carry_forward(stored, ["u"], ["i"], F.col("stored"), F.lit(None).cast("boolean"), "back")
    assert back.where("NOT state <=> back").count() == 0
    changes = S.state_changes(dense, ["u"], ["i"], ["state"], "n").agg(F.sum("n")).first()[0]
    assert back.where("stored IS NOT NULL").count() == changes + 5


def test_ranges_break_at_null(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(["x", "x", None, "x", "y", "y"])], "k string, i int, v string")
    assert sorted(tuple(r) for r in S.contiguous_ranges(df, ["k"], ["i"], "v").collect()) == [("a", "x", 0, 1, 2), ("a", "x", 3, 3, 1), ("a", "y", 4, 5, 2)]


@pytest.mark.parametrize("kind,first,last,want", [
    ("forward", 1, 3, [1, 2, 3]), ("reverse", 1, 3, [3, 2, 1]), ("pingpong", 0, 3, [0, 1, 2, 3, 2, 1]), ("pingpong_reverse", 0, 2, [2, 1, 0, 1]),
    ("pingpong", 5, 5, [5]), ("pingpong", 5, 6, [5, 6]),
])
def test_playback(spark, kind, first, last, want):
    df = spark.createDataFrame([(first, last, kind)], "f int, l int, k string")
    assert [r.frame for r in S.playback(df, "f", "l", "k").orderBy("position").collect()] == want


def test_bounded_report_and_median(spark):
    df = spark.createDataFrame([("a", i, f"l{i}") for i in range(20)] + [("b", 99, "m")], "code string, seq int, loc string")
    out = {r.code: r for r in A.bounded_report(df, ["code"], "seq", F.col("loc")).collect()}
    assert (out["a"].n, out["a"].locations) == (20, ",".join(f"l{i}" for i in range(8)))
    assert out["b"].first_seen == 99
    medians = A.upper_median(df, ["code"], "seq", ["loc"], "m").collect()
    assert {r.code: r.m for r in medians} == {"a": 10, "b": 99}


def test_majority_ties_and_threshold(spark):
    rows = [("a", "x")] * 3 + [("a", "y")] + [("b", "x"), ("b", "y")] + [("c", "x")] * 2 + [("c", v) for v in "pqrstuv"]
    out = {r.k: r.choice for r in A.majority(spark.createDataFrame(rows, "k string, v string"), ["k"], "v", (1, 3)).collect()}
    assert out == {"a": "x", "b": None, "c": None}


TREE = [("d", 1, None, 0), ("d", 2, 1, 0), ("d", 3, 1, 10), ("d", 4, 3, 0), ("d", 5, None, 1), ("e", 1, None, 0)]


def test_tree(spark):
    nodes = spark.createDataFrame(TREE, "doc_id string, id bigint, parent bigint, ordinal int")
    flat = H.flatten(nodes, "id", "parent", "ordinal")
    assert {(r.doc_id, r.id): (r.depth, r.path, r.ancestors) for r in flat.collect()}["d", 4] == (2, "0/10/0", [1, 3])
    closed = H.closure(flat, "id")
    flags = nodes.select("doc_id", "id", (F.col("id") != 3).alias("on"))
    above = {(r.doc_id, r.id): r.on for r in H.all_above(closed, flags, "id", "on", ["doc_id"]).collect()}
    assert above == {("d", 1): True, ("d", 2): True, ("d", 3): False, ("d", 4): False, ("d", 5): True, ("e", 1): True}
    below = {(r.doc_id, r.id): r.on_below for r in H.any_below(closed, flags, "id", "on", ["doc_id"]).collect()}
    assert below["d", 1] == 3 and below["d", 3] == 1
    kept = {(r.doc_id, r.id) for r in H.prune(closed, nodes, "id", F.col("id") == 4, ["doc_id"]).collect()}
    assert kept == {("d", 1), ("d", 3), ("d", 4)}
    shown = H.retime_by_depth(flat, "id", 1, nodes.where("id = 5").select("doc_id", "id"))
    frames = {}
    for r in shown.where("enabled").collect():
        frames.setdefault((r.doc_id, r.frame_index), set()).add(r.id)
    assert frames == {("d", 0): {1, 2, 5}, ("d", 1): {1, 3, 4, 5}}


def test_paths_of_groups(spark):
    df = spark.createDataFrame([("d", 1, ["a", "b"]), ("d", 2, ["a", "c"]), ("e", 1, ["x"]), ("e", 2, [])], "doc_id string, t int, path array<string>")
    assert {(r.doc_id, r.node, r.parent) for r in H.insert_paths(df.where("size(path) > 0"), "path").collect()} == {("d", "a", ""), ("d", "a/b", "a"), ("d", "a/c", "a"), ("e", "x", "")}
    out = {(r.doc_id, r.t): r.path for r in H.drop_common_root(df, "path", F.lit(True)).collect()}
    assert out == {("d", 1): ["b"], ("d", 2): ["c"], ("e", 1): ["x"], ("e", 2): []}


def test_overlap_join_makes_each_pair_once(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(2), a := rng.randrange(100), a + rng.randrange(0, 40)) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, k int, lo int, hi int")
    got = [(r.a_i, r.b_i) for r in D.overlap_join(df, df, ["k"], "lo", "hi", 16).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] < b[3] and b[2] < a[3] and a[3] > a[2] and b[3] > b[2]}
    assert len(got) == len(set(got)) and set(got) == want


def marks(spark, rows):
    df = spark.createDataFrame([("d", *r) for r in rows], "doc_id string, version int, role string, logical_layer_id bigint, variant_index int, variant_count int")
    return D.marker_status(df).first()


def test_marker_sets(spark):
    one = [(1, "wrapper", 7, 0, 2), (1, "variant", 7, 1, 2), (1, "variant", 7, 2, 2)]
    assert marks(spark, one).valid
    assert not marks(spark, one[:2]).valid and not marks(spark, one[1:]).valid and not marks(spark, one + one[1:2]).valid
    two = [(2, "frame_group", 1, i, 2) for i in (1, 2)] + [(2, "layer_copy", k, i, 2) for k in (5, 6) for i in (1, 2)]
    assert marks(spark, two).valid and not marks(spark, two[1:]).valid and not marks(spark, two[:2]).valid
    three = [(3, "frame_group", 0xFFFFFFFF, 1, 4), (3, "layer_copy", 5, 3, 4)]
    assert marks(spark, three).valid and marks(spark, three).linked and not marks(spark, three).local
    assert not marks(spark, one + three).valid


def test_row_diff_and_completeness(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 2)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "Y", 2), (4, "z", 2)], "k int, s string, n int")
    assert {tuple(r) for r in D.row_diff(a, b, ["k"], ["s", "n"]).collect()} == {(2, "s,n"), (3, "missing_in_b"), (4, "missing_in_a")}
    with pytest.raises(Exception, match="lost"):
        D.require_matched(a, b.select("k", F.col("s").alias("t")), ["k"], "lost").collect()
    seq = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3), ("c", 2), ("c", 2)], "g string, p int")
    assert {r.g: r.complete for r in A.complete_interval(seq, ["g"], "p").collect()} == {"a": True, "b": False, "c": False}
