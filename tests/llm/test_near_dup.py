import random
from datetime import datetime
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacel.llm import near_dup
from stratacel.llm.near_dup import expand_pairs, near_duplicates

CEL = "cel_id bigint, doc_id string, source_layer_id bigint, source_frame int, linked_source_frame int, width int, height int, pixels binary, rep bigint, size string"


def grams(w, h, p):
    if p is None or w is None or h is None or len(p) != w * h * 4:
        return frozenset()
    px = [p[i : i + 4] for i in range(0, len(p), 4)]
    runs = (tuple(px[y * w + x : y * w + x + 4]) for y in range(h) for x in range(w - 3))
    return frozenset(r for r in runs if any(q[3] for q in r))


def brute(rows):
    first = {}
    for r in sorted((r for r in rows if r[0] is not None and r[3] is not None and r[3] == r[4]), key=lambda r: r[0]):
        first.setdefault(r[1:4], r)
    sets = {r[0]: g for r in first.values() if (g := grams(*r[5:8]))}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if 10 * len(sets[a] & sets[b]) >= 6 * len(sets[a] | sets[b])}, set(sets)


def made(seed, n=150):
    rng = random.Random(seed)
    colour = lambda: bytes([rng.randrange(4), rng.randrange(4), 0, rng.choice([0, 255, 255])])
    originals = [(w, h, [colour() for _ in range(w * h)]) for w, h in ((rng.randrange(4, 12), rng.randrange(3, 9)) for _ in range(12))]
    rows = []
    for i in range(n):
        w, h, px = rng.choice(originals)
        px = list(px)
        for _ in range(rng.choice([0, 0, 0, 1, 3])):
            px[rng.randrange(len(px))] = colour()
        if rng.random() < 0.2:
            h, px = h - 1, px[: w * (h - 1)]
        data = b"".join(px)
        if rng.random() < 0.1:
            data = rng.choice([None, data[:-1], b"\0" * len(data), b""])
        f = i % 7
        row = (i, f"d{i % 5}", i // 9, f, rng.choice([f, f, f, f - 1]), w, h, data, 5, "s")
        rows += [row] * rng.choice([1, 1, 2])
    rng.shuffle(rows)
    return rows


def run(spark, rows):
    members, links = near_duplicates(spark.createDataFrame(rows, CEL))
    found = [tuple(r) for r in expand_pairs(members, links).collect()]
    assert len(found) == len(set(found))
    return set(found), {r.cel_id for r in members.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_against_brute_force(spark, seed):
    rows = made(seed)
    found, members = run(spark, rows)
    want, with_content = brute(rows)
    assert members == with_content
    assert found == want and len(want) > 30


def test_hot_class_is_salted(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SALT_ROWS", 3)
    px = bytes([9, 9, 9, 255]) * 5
    near = bytes([9, 9, 9, 255]) * 4 + bytes([8, 9, 9, 255]) + bytes([9, 9, 9, 255]) * 5
    rows = [(i, f"d{i}", 1, 0, 0, 5, 1, px, 0, "") for i in range(20)] + [(100, "e", 1, 0, 0, 4, 1, px[:16], 0, ""), (101, "e", 2, 0, 0, 5, 2, near, 0, "")]
    found, _ = run(spark, rows)
    assert found == brute(rows)[0] and len(found) >= 20 * 21 // 2


def test_split_of_hot_grams_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT_ROWS", 3)
    groups = near_dup.row_groups(np.array([0, 40, 80]), 0.0)
    assert groups[0] == 1 and groups[2] > groups[1] > 1
    rows = made(3)
    found, _ = run(spark, rows)
    assert found == brute(rows)[0] and len(found) > 30


def test_rows_of_a_split_gram_meet():
    rng = np.random.default_rng(1)
    ids, gram, groups = rng.integers(0, 1 << 40, 60), np.full(60, 7, dtype=np.uint64), np.full(60, 5)
    places, split = near_dup.split_hot(gram, ids, groups)
    met = {frozenset((a, b)) for g in np.unique(split) for a in places[split == g] for b in places[split == g] if a != b}
    assert len(met) == 60 * 59 // 2 and len(places) == 300 and len(np.unique(split)) <= 15
    assert np.array_equal(near_dup.split_hot(gram, ids, np.ones(60, dtype=int))[1], gram)


def test_nulls_and_empty_tables(spark):
    assert run(spark, []) == (set(), set())
    px = bytes([1, 2, 3, 255]) * 4
    rows = [(None, "d", 1, 0, 0, 4, 1, px, 0, ""), (1, None, None, 0, 0, 4, 1, px, 0, ""), (2, "d", 1, None, None, 4, 1, px, 0, ""), (3, "d", 1, 1, 1, None, 1, px, 0, ""), (4, "d", 1, 2, 2, 4, 1, px, 0, ""), (5, "d", 1, 3, 3, 1, 4, px, 0, "")]
    assert run(spark, rows) == ({(1, 4)}, {1, 4})


def test_one_cel_delivered_with_different_pixels_counts_once(spark):
    colours = [bytes([c, 1, 2, 255]) for c in range(40)]
    few, many, near = b"".join(colours[:8]), b"".join(colours[10:26]), b"".join(colours[:9])
    rows = [(1, "d", 1, 0, 0, 8, 1, few, 0, ""), (1, "d", 1, 0, 0, 16, 1, many, 0, ""), (2, "e", 1, 0, 0, 8, 1, few, 0, ""), (3, "f", 1, 0, 0, 16, 1, many, 0, ""), (4, "g", 1, 0, 0, 9, 1, near, 0, "")]
    found, members = run(spark, rows)
    assert found == {(1, 2), (1, 4), (2, 4)} and members == {1, 2, 3, 4}


def test_sketch_counts_beyond_16_bits_and_follows_the_size(spark, monkeypatch):
    px = bytes([9, 9, 9, 255]) * 4
    one = spark.range(70_000).selectExpr("id AS rep", "4 AS width", "1 AS height").withColumn("pixels", F.lit(px)).coalesce(1)
    codes, load = near_dup.gram_sketch(one, 22)
    assert codes.max() == int(8 * np.log2(70_001)) and (codes > 0).sum() == 1 and load == 70_000 / (1 << 22)
    monkeypatch.setattr(near_dup, "estimated_bytes", lambda df: size)
    bits = []
    for size in (0, 1 << 31, 1 << 50):
        bits.append(near_dup.sketch_bits(one))
    assert bits == [22, 24, 25]


def test_block_pairs_keep_every_pair():
    rng = np.random.default_rng(3)
    sets = [frozenset(rng.choice(60, size=rng.integers(1, 25), replace=False).tolist()) for _ in range(80)]
    gram, ids, size, position = [], [], [], []
    for i, s in enumerate(sets):
        limit = len(s) - int(np.ceil(0.6 * len(s) - 1e-9)) + 1
        for at, g in enumerate(sorted(s)[:limit]):
            gram.append(g), ids.append(i), size.append(len(s)), position.append(at)
    got = set()
    for a, b in near_dup.block_pairs(*map(np.array, (gram, ids, size, position)), 0.6):
        got |= set(zip(a.tolist(), b.tolist()))
    want = {(a, b) for a, b in combinations(range(80), 2) if 10 * len(sets[a] & sets[b]) >= 6 * len(sets[a] | sets[b])}
    assert want <= got
