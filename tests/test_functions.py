import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacel.functions import columns as C
from stratacel.functions import pixels as P
from stratacel.functions.names import COPY_SUFFIXES, MAX_SUFFIXES, known_blend_mode, parse_name, parsed_name


@pytest.mark.parametrize("name,base,tokens,ordinals", [
    ("Layer 1 copy", "layer 1", ["copy"], [None]),
    ("Layer  1 COPY 2", "layer 1", ["copy"], [2]),
    ("Face (copy 3)", "face", ["copy"], [3]),
    ("Face (copy) #3", "face (copy) #3", [], []),
    ("Face-Kopie", "face", ["kopie"], [None]),
    ("Copy", "copy", [], []),
    ("photocopy", "photocopy", [], []),
    ("a copy copy 2", "a", ["copy", "copy"], [2, None]),
    ("图层 3 拷贝", "图层 3", ["拷贝"], [None]),
    ("x kopia", "x", ["kopia"], [None]),
    ("x copy b", "x copy b", [], []),
    ("x copy 99999999999", "x copy 99999999999", [], []),
    ("", "", [], []),
])
def test_copy_suffixes(name, base, tokens, ordinals):
    out = parse_name(name)
    assert (out.base, out.tokens, out.ordinals, out.limit_reached) == (base, tokens, ordinals, False)


def test_suffix_limit():
    out = parse_name("a" + " copy" * (MAX_SUFFIXES + 1))
    assert out.limit_reached and len(out.tokens) == MAX_SUFFIXES and len(COPY_SUFFIXES) == 35
    assert not parse_name("a" + " copy" * MAX_SUFFIXES).limit_reached


def test_names_as_columns(spark):
    df = spark.createDataFrame([("Über  Kopf Kopie",), (None,), ("图层 12",), ("layer 1a",)], "n string")
    rows = df.select(parsed_name(F.col("n")).alias("p"), C.is_generic_name(C.normalized_name(F.col("n"))).alias("g")).collect()
    assert rows[0].p.base == "über kopf" and rows[1].p.base is None and [r.g for r in rows[2:]] == [True, False]


def test_columns(spark):
    df = spark.createDataFrame([(0.5, "linear_Dodge", "passThrough", 119, "0/10/1")], "o double, b string, e string, d int, p string")
    r = df.select(
        C.quantised_opacity(F.col("o")).alias("q"), C.opacity_loses(F.col("o")).alias("l"), known_blend_mode(F.col("b")).alias("m"), C.camel_words(F.col("e")).alias("w"),
        C.canonical_duration(F.col("d")).alias("d"), C.path_key(F.col("p")).alias("k"), C.fnv1a32(F.lit("hello")).alias("f"), C.fnv1a32(F.lit("")).alias("f0"),
        C.fallback_layer_id(F.lit(7.0), F.lit("0")).alias("i"), C.fallback_layer_id(F.lit(7.5), F.lit("0/1")).alias("j"), C.ratio_score(F.lit(3), F.lit(4)).alias("r"),
        C.differs(F.lit(1.0), F.lit(1.0 + 1e-12)).alias("same"), C.differs(F.lit(None).cast("double"), F.lit(1.0)).alias("apart"),
        C.display_path(F.array(F.lit("a"), F.lit(""))).alias("path"), C.meaningful_reference(F.lit(5.0), F.lit(5.0), F.lit(0), F.lit(0), F.lit(10), F.lit(10)).alias("ref"),
    ).first()
    assert (r.q, r.l, r.m, r.w, r.d, r.k) == (128, True, "linear dodge", "pass through", 110, [0, 10, 1])
    assert (r.f, r.f0, r.i) == (0x4F9F2CAB, 0x811C9DC5, 7) and r.j >= 0x80000000 and r.r == 8
    assert (r.same, r.apart, r.path, r.ref) == (False, True, "a/<unnamed>", False)
    with pytest.raises(Exception, match="size"):
        df.select(C.checked_integer(F.lit(1.5), 0, 9, "size")).collect()


def pic(rows):
    return np.array(rows, dtype=np.uint8)


def test_specks():
    image = np.zeros((4, 5, 4), dtype=np.uint8)
    image[0, 0, 3] = 3  # alone
    image[2, 2, 3], image[2, 3, 3] = 4, 200  # beside something strong
    image[3, 0, 3] = image[3, 1, 3] = 8  # two of them
    out, patches, cleared = P.clear_specks(image, 8, 2)
    assert (patches, cleared) == (3, 2) and out[..., 3].nonzero()[0].tolist() == [2, 2]
    assert P.clear_specks(image, 8, 1)[2] == 1
    assert P.clear_specks(np.zeros((0, 0, 4), dtype=np.uint8), 8, 1)[1:] == (0, 0)


def test_specks_against_flood_fill():
    rng = np.random.default_rng(4)
    for _ in range(20):
        image = np.zeros((9, 7, 4), dtype=np.uint8)
        image[..., 3] = rng.choice([0, 0, 3, 9], size=(9, 7))
        out, patches, cleared = P.clear_specks(image, 5, 2)
        seen, want, count, gone = set(), image.copy(), 0, 0
        for y, x in zip(*np.nonzero((image[..., 3] > 0) & (image[..., 3] <= 5))):
            if (y, x) in seen:
                continue
            stack, patch, touch = [(y, x)], [], False
            seen.add((y, x))
            while stack:
                a, b = stack.pop()
                patch.append((a, b))
                for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                    if 0 <= c < 9 and 0 <= d < 7 and image[c, d, 3]:
                        if image[c, d, 3] > 5:
                            touch = True
                        elif (c, d) not in seen:
                            seen.add((c, d))
                            stack.append((c, d))
            count += 1
            if len(patch) <= 2 and not touch:
                gone += 1
                for p in patch:
                    want[p] = 0
        assert (patches, cleared) == (count, gone) and np.array_equal(out, want)


def test_pixel_arithmetic():
    a = pic([[[10, 20, 30, 255], [1, 2, 3, 128]]])
    mask = pic([[[7]]])[..., 0]
    assert P.apply_mask(a, 0, 0, mask, 1, 0, 255)[..., 3].tolist() == [[255, (128 * 7 + 127) // 255]]
    out = P.blit(np.zeros((1, 2, 4), dtype=np.uint8), a, 1, 0, 100)
    assert out[..., 3].tolist() == [[0, 100]]
    assert P.near_equal(a, a, 99, 9) is False
    b = a.copy()
    b[0, 0, 0] += 6
    assert P.near_equal(a, b, 50, 6) and not P.near_equal(a, b, 49, 6) and not P.near_equal(a, b, 50, 5)
    clear = pic([[[0, 0, 0, 0], [9, 9, 9, 0]]])
    assert P.differing_pixels(clear, clear[:, ::-1]) == (0, 0, 2)
    assert P.to_rgba(b"\x05\x80", "gray") == bytes([5, 5, 5, 128])
    assert P.to_rgba(b"\x00\x01\x02", "indexed", {0: (1, 2, 3, 255), 1: (4, 5, 6, 255)}, 1) == bytes([1, 2, 3, 255, 4, 5, 6, 0, 0, 0, 0, 255])


def test_pixel_columns(spark):
    rows = [(b"\0" * 4, 1, 1, 1.0), (b"\0\0\0\1", 1, 1, 0.0), (b"\0\0\0\1", 1, 1, None), (None, 1, 1, 1.0), (b"abc", 1, 1, 1.0)]
    df = spark.createDataFrame(rows, "p binary, w int, h int, o double")
    out = df.select(P.writable(F.col("p"), F.col("o")).alias("w"), P.specks(F.col("p"), F.col("w"), F.col("h")).alias("s"), P.nearly_equal(F.col("p"), F.col("p"), F.col("w"), F.col("h")).alias("n")).collect()
    assert [r.w for r in out] == [False, False, True, False, False]
    assert [r.s.patches for r in out] == [0, 1, 1, None, None] and not any(r.n for r in out)
