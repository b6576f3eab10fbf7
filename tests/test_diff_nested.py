import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratacel.operators.nested import BODIES, apply_schema, emit_nodes, nested_tables, parse_deep, parse_whole
from stratacel.operators.table_diff import Compared, diff_tables, letters_only, unordered
from stratacel.queries.general import REPORT_ARRAYS

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
SCHEMA = "doc string, layer bigint, opacity double, mode string, at timestamp, k0 string, bucket int"
FIELDS = {"opacity": Compared(tolerance=0.004), "mode": Compared(canonical=letters_only)}


def found(spark, a, b):
    left, right = (spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA) for rows in (a, b))
    rows = diff_tables(left, right, ["doc", "layer"], FIELDS, "at").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_missing_rows_differing_fields_and_nulls(spark):
    a = [
        ("d", 1, 0.5, "linear dodge", T0),
        ("d", 2, None, None, T0),
        ("d", 3, 0.504, "normal", T0),
        ("d", 4, None, "normal", T0),
        ("d", 5, 0.5, "normal", T0),
        (None, None, 1.0, "normal", T0),
        ("gone", 1, 1.0, "", T0),
    ]
    b = [
        ("d", 1, 0.5, "Linear_Dodge ", T0),
        ("d", 2, None, None, T0),
        ("d", 3, 0.5, "NORMAL", T0),
        ("d", 4, 0.0, "normal", T0),
        ("d", 5, 0.51, None, T0),
        (None, None, 1.0, "screen", T0),
        ("new", 9, 1.0, "", T0),
    ]
    assert found(spark, a, b) == {
        ("d", 4, "opacity"),
        ("d", 5, "opacity"),
        ("d", 5, "mode"),
        (None, None, "mode"),
        ("gone", 1, "only_in_a"),
        ("new", 9, "only_in_b"),
    }


def test_latest_row_counts_and_ties_are_settled(spark):
    a = [("d", 1, 0.1, "old", T0), ("d", 1, 0.2, "new", T1), ("d", 1, 0.2, "new", T1), ("d", 1, 0.9, "none", None)]
    assert found(spark, a, [("d", 1, 0.2, "new", T0)]) == set()
    tie = [("d", 1, 0.1, "x", T0), ("d", 1, 0.2, "x", T0)]
    assert found(spark, tie, tie[::-1]) == set()


def test_empty_sides(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [("d", 1, 1.0, "x", T0)], []) == {("d", 1, "only_in_a")}
    assert found(spark, [], [("d", 1, 1.0, "x", T0)]) == {("d", 1, "only_in_b")}


def test_many_rows_against_brute_force(spark):
    import random

    rng = random.Random(5)

    def side():
        return [("d%d" % rng.randrange(40), rng.randrange(12), rng.choice([None, 0.1, 0.5]), rng.choice([None, "a b", "A_B", "c"]), rng.choice([T0, T1])) for _ in range(400)]

    def last(rows):
        out = {}
        for r in rows:
            canon = None if r[3] is None else r[3].lower().replace(" ", "").replace("_", "")
            key, value = r[:2], (r[4], (r[2] is not None, r[2] or 0), (canon is not None, canon or ""), r[2], canon)
            out[key] = max(out.get(key, value), value)
        return {k: v[3:] for k, v in out.items()}

    a, b = side(), side()
    x, y = last(a), last(b)
    want = {(*k, "only_in_a") for k in x.keys() - y.keys()} | {(*k, "only_in_b") for k in y.keys() - x.keys()}
    for k in x.keys() & y.keys():
        want |= {(*k, n) for n, p, q in zip(("opacity", "mode"), x[k], y[k]) if p != q}
    assert found(spark, a, b) == want


def test_arrays_compare_as_multisets(spark):
    schema = "doc string, layers array<struct<i:bigint,m:string>>, at timestamp"
    fields = {"layers": Compared(canonical=lambda c: unordered(c, lambda x: F.struct(x.i, letters_only(x.m).alias("m"))))}

    def differ(p, q):
        a, b = (spark.createDataFrame([("d", v, T0)], schema) for v in (p, q))
        return diff_tables(a, b, ["doc"], fields, "at").count() == 1

    assert not differ([(1, "a"), (2, "B c")], [(2, "b-C"), (1, "A")])
    assert differ([(1, "a"), (1, "a")], [(1, "a")])
    assert differ(None, [])
    assert not differ(None, None)
    assert differ([(1, None)], [(1, "null")])
    assert not differ([None], [None])


def nodes(spark, rows):
    raw = spark.createDataFrame(rows, "id bigint, at timestamp, body string, key string, tag string, payload string")
    return nested_tables(raw, "id", "at", "body", REPORT_ARRAYS).nodes()


def paths(spark, *bodies):
    rows = [(i, T0, b, "k", "t", "p") for i, b in enumerate(bodies)]
    return {(r.id, r.node_path, r.parent_path) for r in nodes(spark, rows).collect()}


def test_objects_in_arrays_at_any_depth(spark):
    body = {
        "layers": [{"id": 1, "channels": [{"id": 0}, None, {"id": 2}]}, {"id": 2, "channels": {"id": 7}}, None, 3],
        "issues": json.dumps([{"m": "x [y] {z}"}]),
        "frames": json.dumps({"a": 1}),
        "resources": "no json",
        "additional_info": json.dumps(json.dumps([{"b": 1}])),
        "other": [[{"deep": 1}], {"x": {"metadata_records": {"y": 1}}}],
        "lone": {"z": [1, 2]},
    }
    assert paths(spark, json.dumps(body)) == {
        (0, "layers/0", ""),
        (0, "layers/0/channels/0", "layers/0"),
        (0, "layers/0/channels/2", "layers/0"),
        (0, "layers/1", ""),
        (0, "layers/1/channels/0", "layers/1"),
        (0, "issues/0", ""),
        (0, "frames/0", ""),
        (0, "additional_info/0", ""),
        (0, "other/0/0", ""),
        (0, "other/1", ""),
        (0, "other/1/x/metadata_records/0", "other/1"),
    }


def test_last_whole_body_counts(spark):
    rows = [
        (1, T0, '{"layers":[{"id":1}]}', "", "", ""),
        (1, T1, '{"layers":[{"id":1},{"id":2}', "", "", ""),
        (2, T0, None, "", "", ""),
        (3, T0, "", "", "", ""),
        (4, None, '{"layers":{}}', "", "", ""),
        (5, T0, "[{}, 1]", "", "", ""),
        (6, T0, '{"layers":[{"v":NaN}]}', "", "", ""),
        (None, T0, '{"layers":[{}]}', "", "", ""),
    ]
    got = {(r.id, r.node_path) for r in nodes(spark, rows).collect()}
    assert got == {(1, "layers/0"), (4, "layers/0"), (5, "0"), (None, "layers/0")}


def test_empty_table_and_deep_nesting(spark):
    assert nodes(spark, []).count() == 0
    depth = 30_000
    deep = '{"layers":[{"layers":' * 1 + "[" * depth + "{}" + "]" * depth + "}]}"
    assert len(paths(spark, deep)) == 2


@pytest.mark.parametrize("text", ['{"a": [1, {"b": "c\\"]"}, []], "d": {}}', "[]", "3", '"x"', " [1 , 2 ] "])
def test_deep_parser_agrees(text):
    assert parse_deep(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", "[1,]", '{"a"}', '{"a":1,}', "[1] 2", "{1:2}", "[1", "NaN", "[}", '{"a":1]'])
def test_deep_parser_refuses(text):
    for parse in (parse_deep, parse_whole):
        with pytest.raises(ValueError):
            parse(text)


def test_tables_written_by_tag(spark, tmp_path):
    body = json.dumps({"layers": [{"id": 1, "name": "a", "channels": [{"id": -1}]}, {"id": "bad", "name": "b"}], "odd": [{"x": 1}]})
    path = str(tmp_path / "nodes")
    raw = spark.createDataFrame([(7, T0, body, "k"), (7, T0, body, "k"), (7, T1, '{"layers":', "k")], "id bigint, at timestamp, body string, key string")
    tables = nested_tables(raw, "id", "at", "body", REPORT_ARRAYS, path)
    assert {p.name for p in (tmp_path / "nodes").glob("table=*")} == {"table=layers", "table=channels", "table=_other", "table=_bodies"}
    layers = tables.read("layers", "id BIGINT, name STRING").orderBy("node_path").collect()
    assert [(r[0], r.node_path, r.ordinal) for r in layers] == [(7, "layers/0", 0), (7, "layers/1", 1)] and layers[0].name == "a"
    channels = tables.read("channels", "c INT").collect()
    assert [(r.parent_path, r.c) for r in channels] == [("layers/0", None)]
    assert tables.read("frames", "c INT").count() == 0
    plan = tables.nodes("channels")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(table" in plan


def test_each_body_is_parsed_once(spark):
    raw = spark.createDataFrame([(1, T0, '{"layers":[{},{}]}'), (2, T0, "{"), (1, T1, "{}")], "id bigint, at timestamp, body string")
    rows = emit_nodes(raw, "id", "at", "body", REPORT_ARRAYS).collect()
    assert sorted((r.key, r.table) for r in rows) == [(1, BODIES), (1, BODIES), (1, "layers"), (1, "layers")]
    assert all((r.at is None) == (r.table != BODIES) for r in rows)
    assert nested_tables(raw, "id", "at", "body", REPORT_ARRAYS).nodes().count() == 0  # the last body holds none
