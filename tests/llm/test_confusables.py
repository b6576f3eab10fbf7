from datetime import datetime
from itertools import combinations

import pytest

from stratacel.llm import confusables
from stratacel.llm.confusables import canonical_forms, consistent, look_alike_pairs, look_alikes, visible_form

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)

SAME = [
    ("Layer", "@FF2C@0430@0443@0435r"),
    ("copia", "@0441@043E@0440@0456@0430"),
    ("office", "o@FB03ce"),
    ("office", "o@FB01ce".replace("@FB01", "f@FB01")),
    ("Caf@00E9", "Cafe@0301"),
    ("a b", "@00A0a@3000 b@2003"),
    ("Layer 1", "La@200Byer@2060 1@FEFF@00AD"),
    ("@30D1@30FC@30C4", "@FF8A@FF9F@FF70@FF82"),
    ("@6587", "@2F42"),
    ("@ADF8", "@1100@1173"),
    ("@03BF@03C3@03BF", "ooo"),
    ("tab x", "tab@0009x"),
    ("Bone", "@A4D0one"),
]
DIFFERENT = [
    ("Layer", "layer"),
    ("Eclair", "@00C9clair"),
    ("left arm", "leftarm"),
    ("Iris", "lris"),
    ("x2", "x@00B2"),
    ("o", "@00F8"),
    ("bone", "@A4D0one"),
    ("gr@00F6ss", "gr@00F6@00DF"),
]


def real(text):
    out, i = "", 0
    while i < len(text):
        if text[i] == "@":
            out, i = out + chr(int(text[i + 1 : i + 5], 16)), i + 5
        else:
            out, i = out + text[i], i + 1
    return out


@pytest.fixture(scope="module")
def alike(spark):
    return look_alikes(spark)


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(alike, a, b):
    assert visible_form(real(a), alike) == visible_form(real(b), alike)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_another_look(alike, a, b):
    assert visible_form(real(a), alike) != visible_form(real(b), alike)


def test_empty_and_null(alike):
    assert visible_form(None, alike) is None
    assert visible_form("", alike) == visible_form(real("@200B @00A0"), alike) == ""


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "k bigint, doc string, name string, at timestamp, form string, text string, salt int")
    out = [tuple(r) for r in look_alike_pairs(df, "k", "doc", "name", "at").collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_pairs_against_brute_force(spark, alike, monkeypatch):
    monkeypatch.setattr(confusables, "SALT_ROWS", 2)
    texts = [real(t) for pair in SAME + DIFFERENT for t in pair] * 2
    rows = [(i, f"d{i // 2 % 2}", t, T0, "f", "t", 1) for i, t in enumerate(texts)]
    rows += rows[:5] + [(90, "d0", None, T0, "", "", 1), (None, "d0", "Layer", T0, "", "", 1), (91, None, "Layer", T0, "", "", 1)]
    rows += [(0, "d0", "superseded", datetime(2023, 1, 1), "", "", 1)]
    own = {(i, d): t for i, d, t, at, *_ in rows if at == T0 and None not in (i, d, t)}
    want = {
        (a[0], b[0])
        for (a, s), (b, t) in combinations(sorted(own.items()), 2)
        if a[1] == b[1] and s != t and visible_form(s, alike) == visible_form(t, alike)
    }
    assert pairs(spark, rows) == want and len(want) > 15
    assert pairs(spark, []) == set()


def test_canonical_member(spark):
    rows = [(real(t),) for t in ("Layer", "@FF2Cayer", "L@0430yer", "layer", "@0441opy")] + [(None,), ("Layer",), ("",)]
    out = {r.text: r.canonical for r in canonical_forms(spark.createDataFrame(rows, "t string"), "t").collect()}
    assert {out[real(t)] for t in ("Layer", "@FF2Cayer", "L@0430yer")} == {"Layer"}
    assert out["layer"] == "layer" and out[""] == "" and out[real("@0441opy")] == real("@0441opy")


def test_columns_compare(spark):
    rows = [("Layer " + real("@0441") + "opy", real("@0441opy"), 1), ("x", "copy", 2), (None, None, 3), ("x", "copy", 2)]
    out = consistent(spark.createDataFrame(rows, "name string, token string, text int"), ["name", "token"]).collect()
    assert len(out) == 4
    assert {r.token_canonical for r in out} == {"copy", None}
    empty = spark.createDataFrame([], "name string, token string, text int")
    assert consistent(empty, ["name"]).count() == 0


def test_very_long_names(spark, alike):
    long = "Layer " * 20_000
    rows = [(1, "d", long + "x", T0, "", "", 1), (2, "d", long.replace("a", chr(0x430)) + "x", T0, "", "", 1), (3, "d", long + "y", T0, "", "", 1)]
    assert pairs(spark, rows) == {(1, 2)}
