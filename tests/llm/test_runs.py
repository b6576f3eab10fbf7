import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest

from stratacel.llm import runs
from stratacel.llm.runs import collapse_runs, resolve_links, same_drawing, same_drawings

T0 = datetime(2024, 1, 1)
CEL = (
    "cel_id bigint, doc_id string, source_layer_id bigint, frame_index int, source_frame int, linked_source_frame int, "
    "width int, height int, x int, y int, opacity int, pixels binary, ingested_at timestamp, chunk int, link int, doc string"
)
FRAME = "doc_id string, frame_index int, duration_ms bigint, ingested_at timestamp"


def ends_of(links):
    step = {}
    for d, l, s, t in links:
        if None not in (d, l, s, t) and s != t:
            step[d, l, s] = min(t, step.get((d, l, s), t))
    out = {}
    for (d, l, s) in step:
        seen, at = [], s
        while (d, l, at) in step and at not in seen:
            seen.append(at)
            at = step[d, l, at]
        out[d, l, s] = min(seen[seen.index(at) :]) if at in seen else at
    return out


def brute(cels, frames):
    ends = ends_of([(c[1], c[2], c[4], c[5]) for c in cels])
    ms = {}
    for d, f, v, at in sorted(frames, key=lambda r: r[3]):
        ms[d, f] = v or 0
    first = {}
    for c in sorted((c for c in cels if None not in (c[1], c[2], c[3])), key=lambda c: c[0]):
        first.setdefault((c[1], c[2], c[3]), c)

    def repeat(a, b):
        if any(a[i] is None or a[i] != b[i] for i in (8, 9, 10)):
            return False
        la, lb = (ends.get((c[1], c[2], c[5]), c[5]) for c in (a, b))
        if la is not None and la == lb:
            return True
        if a[6] is None or a[7] is None or a[6] != b[6] or a[7] != b[7] or a[11] is None or b[11] is None:
            return False
        if not len(a[11]) == len(b[11]) == a[6] * a[7] * 4:
            return False
        return sum(a[11][i : i + 4] != b[11][i : i + 4] for i in range(0, len(a[11]), 4)) <= 2

    out = []
    for key in sorted(first):
        c = first[key]
        d, l, f = key
        if out and out[-1][:2] == [d, l] and out[-1][3] == f - 1 and repeat(first[d, l, f - 1], c):
            out[-1][3], out[-1][4], out[-1][5] = f, out[-1][4] + 1, out[-1][5] + ms.get((d, f), 0)
        else:
            out.append([d, l, f, f, 1, ms.get((d, f), 0)])
    return sorted(map(tuple, out))


def made(seed, n_docs=4, frames=30):
    rng = random.Random(seed)
    cels, cid = [], 0
    for d in range(n_docs):
        for layer in (1, 2):
            drawing = bytes(rng.randrange(256) for _ in range(2 * 2 * 4))
            for f in range(frames):
                cid += 1
                if rng.random() < 0.1:
                    continue
                kind = rng.random()
                if kind < 0.4:
                    drawing = bytearray(drawing)
                    drawing[rng.randrange(16)] ^= rng.choice([0, 255])
                    drawing = bytes(drawing)
                elif kind < 0.5:
                    drawing = bytes(rng.randrange(256) for _ in range(16))
                link = f if rng.random() < 0.5 else max(0, f - 1)
                pixels = rng.choice([drawing] * 8 + [None, drawing[:-1]])
                row = (cid, f"d{d}", layer, f, f, link, 2, 2, rng.choice([0, 0, 0, 0, 1]), 0, rng.choice([255, 255, 255, 255, None]), pixels, T0, 1, 2, "x")
                cels += [row] * rng.choice([1, 1, 1, 2])
    frames_rows = []
    for d in range(n_docs):
        for f in range(frames):
            frames_rows.append((f"d{d}", f, rng.choice([None, 50, 100]), T0))
            if rng.random() < 0.2:
                frames_rows.append((f"d{d}", f, 70, T0 + timedelta(days=1)))
    rng.shuffle(cels)
    return cels, frames_rows


def runs_of(spark, cels, frames, chunks):
    out = collapse_runs(spark.createDataFrame(cels, CEL), spark.createDataFrame(frames, FRAME), chunks)
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("chunks", [1, 7, 40])
def test_runs_against_brute_force(spark, chunks):
    cels, frames = made(3)
    got = runs_of(spark, cels, frames, chunks)
    assert got == brute(cels, frames)
    assert any(r[4] > 3 for r in got)


def test_one_long_run_over_many_chunks(spark):
    cels = [(i, "d", 1, i, i, 0, 1, 1, 0, 0, 9, None, T0, 1, 1, "x") for i in range(200)]
    frames = [("d", i, 10, T0) for i in range(200)]
    assert runs_of(spark, cels, frames, 20) == [("d", 1, 0, 199, 200, 2000)]


def test_small_batches_cut_nothing(spark):
    cels, frames = made(4, n_docs=1, frames=40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert runs_of(spark, cels, frames, 2) == brute(cels, frames)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nulls_empty_tables_and_ties(spark):
    assert runs_of(spark, [], [], 3) == []
    null = (1, None, 1, 0, 0, 0, 1, 1, 0, 0, 9, b"abcd", T0, 1, 1, "x")
    a = (2, "d", 1, 0, None, None, None, None, 0, 0, 9, b"abcd", T0, 1, 1, "x")
    b = (3, "d", 1, 1, None, None, None, None, 0, 0, 9, b"abcd", T0, 1, 1, "x")
    late = (2, "d", 1, 0, None, None, None, None, 0, 0, 9, b"abcd", T0 + timedelta(days=9), 1, 1, "x")
    assert runs_of(spark, [null, a, b, late], [], 2) == [("d", 1, 0, 0, 1, 0), ("d", 1, 1, 1, 1, 0)]


def test_links_long_chains_and_cycles(spark):
    links = [("d", 1, i, i - 1) for i in range(1, 70)] + [("c", 1, 5, 6), ("c", 1, 6, 7), ("c", 1, 7, 5), ("c", 1, 9, 7)] + [("c", 2, i, i - 1) for i in range(100, 140)] + [("c", 2, 100, 139), (None, 1, 1, 2), ("d", 1, 0, 0)]
    df = spark.createDataFrame(links, "doc string, layer bigint, source int, target int")
    got = {(r.doc, r.layer, r.source): r.target for r in resolve_links(df).collect()}
    assert got == ends_of(links)


@pytest.mark.parametrize("at_once", [3, 1 << 20])
def test_drawings_compared_on_flat_buffers(monkeypatch, at_once):
    monkeypatch.setattr(runs, "COMPARED", at_once)
    rng = random.Random(at_once)
    base = rng.randbytes(24)
    buffers = []
    for _ in range(400):
        own = bytearray(base)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            own[rng.randrange(24)] ^= 1
        buffers.append(rng.choice([bytes(own)] * 8 + [None, b"", b"odd", bytes(own)[:20]]))
    pixels = pa.array(buffers, type=pa.binary()).slice(5)
    at = np.arange(1, len(pixels))
    for w, h in ((2, 3), (0, 4), (1, 5)):
        got = same_drawings(pixels, at, np.full(len(at), w * h))
        assert got.tolist() == [same_drawing(buffers[5 + i - 1], buffers[5 + i], w, h) for i in at]
    assert same_drawings(pixels, at[:0], at[:0]).tolist() == []
