import random

import numpy as np
import pyarrow as pa
import pytest

from stratacel.llm import leakage
from stratacel.llm.leakage import leaked
from stratacel.llm.markup import shown_text

DOC = "doc_id bigint, text string, item_id int, term string"
ITEM = "item_id bigint, task string, lang string, text string"
WORDS = [f"wörd{i}" for i in range(400)]


def found(spark, docs, items, **kw):
    out = leaked(spark.createDataFrame([(*d, 1, "x") for d in docs], DOC), spark.createDataFrame([(i, "t", lang, t) for i, lang, t in items], ITEM), **kw)
    rows = [(r.doc_id, r.item_id) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def passage(n, rng=random):
    return rng.sample(WORDS, n)


def test_sixteen_words_in_a_row(spark):
    p = passage(40, random.Random(1))
    filler = [f"x{i}" for i in range(30)]
    docs = [
        (1, " ".join(filler + p[5:21] + filler)),
        (2, " ".join(filler + p[5:20] + filler + p[21:36])),
        (3, " ".join(p)),
        (4, " ".join(p[::-1])),
        (5, None),
        (6, ""),
        (7, " ".join(p[:16])),
        (7, " ".join(p[:16])),
        (None, " ".join(p)),
    ]
    assert found(spark, docs, [(1, "en", " ".join(p)), (2, "en", "short one"), (3, "en", None), (None, "en", " ".join(p))]) == {(1, 1), (3, 1), (7, 1)}


def test_looks_make_no_difference(spark):
    p = "The river of Zürich is old in 1845 and the mill rose by 14,653 coins while it was never sold again".split()
    wiki = (
        "''THE'' [[Rhine|RIVER]]<ref>ignored words here</ref> of <!-- no --> '''Zürich''' is\n* old {{convert|3|km}} in 1845, and [[the]] mill rose—by 14,653 "
        "coins<ref name=\"k\"/> &nbsp; while it was never sold <!-- x\ny -->again"
    )
    assert found(spark, [(1, wiki), (2, "nothing")], [(9, "en", " ".join(p))]) == {(1, 9)}


def test_scripts_without_spaces(spark):
    item = "".join(chr(0x4E00 + i) for i in range(40)) + "。12"
    docs = [(1, "前" + item[:17] + "，\n" + item[17:34] + "后"), (2, "前" + item[:33] + "后"), (3, item[:20] + "[[甲|" + item[20:30] + "]]" + item[30:])]
    assert found(spark, docs, [(1, "zh", item), (2, "ja", "短い")]) == {(1, 1), (3, 1)}


def test_proximity(spark):
    p = passage(30, random.Random(2))
    docs = [(1, " ".join(p[:10] + ["new"] + p[10:20])), (2, " ".join(p[:10] + ["x"] * 9 + p[10:20]))]
    items = [(1, "en", " ".join(p))]
    assert found(spark, docs, items) == set()
    assert found(spark, docs, items, phrase=False) == {(1, 1)}


def proximity(doc, item, part, least=16, slack=4):
    """Most terms of the item in runs of ``part`` or more that follow each other within the slack, tried from every run."""
    a, b = item.split(), doc.split()
    runs = []
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                n = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
                if n >= part:
                    runs.append((i, j, n))
    most = {}
    for i, j, n in sorted(runs):
        most[i, j, n] = n
        for k, m, o in list(most):
            gaps = (i - k - o, j - m - o)
            if k < i and m < j and k + o < i + n and m + o < j + n and max(gaps) <= slack and abs((j - i) - (m - k)) <= slack:
                most[i, j, n] = max(most[i, j, n], most[k, m, o] + n + min(0, *gaps))
    longest = max(most.values(), default=0)
    return longest if longest >= least else None


def test_two_altered_copies(spark):
    p = passage(30, random.Random(2))
    altered = p[:10] + ["new"] + p[10:20]
    filler = [f"x{i}" for i in range(30)]
    docs = [(1, " ".join(altered)), (2, " ".join(altered + filler + altered)), (3, " ".join(altered + altered)), (4, " ".join((p[:10] + filler) * 2))]
    assert found(spark, docs, [(1, "en", " ".join(p))], phrase=False) == {(1, 1), (2, 1), (3, 1)}


def test_a_word_changed_every_few(spark):
    p = passage(36, random.Random(3))
    changed = [w if (k + 1) % 6 else f"y{k}" for k, w in enumerate(p)]
    put_in = [w for k, x in enumerate(p) for w in ([x] if (k + 1) % 4 else [x, f"y{k}"])]
    left_out = [w for k, w in enumerate(p) if (k + 1) % 8]
    docs = [(d, " ".join(["x"] * 9 + w + ["z"] * 9)) for d, w in enumerate((changed, put_in, left_out))]
    assert found(spark, docs, [(1, "en", " ".join(p))], phrase=False) == {(0, 1), (1, 1), (2, 1)}


def altered_copies(rng, items, docs):
    """Texts that hold passages of items once or more, each with words changed, put in or left out here and there."""
    for d in range(docs):
        text = [f"x{rng.randrange(99)}" for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(1, 4)):
            own = rng.choice(items)[2].split()
            lo = rng.randrange(len(own) - 12)
            part, every = own[lo : lo + rng.randrange(12, 40)], rng.randrange(4, 14)
            for at in range(len(part) - rng.randrange(1, every + 1), 0, -every):
                part[at : at + rng.choice([0, 1, 1, 3, 5])] = [f"y{k}" for k in range(rng.choice([0, 1, 1, 3, 5]))]
            for _ in range(rng.choice([1, 2, 2, 3])):
                text += part + [f"z{k}" for k in range(rng.choice([0, 2, 20]))]
        yield d, " ".join(text)


@pytest.mark.parametrize("size", [400, 25])
def test_proximity_against_brute_force(spark, size):
    rng = random.Random(size)
    items = [(i, "en", " ".join(rng.choice(WORDS[:size]) for _ in range(rng.randrange(18, 50)))) for i in range(10)]
    docs = list(altered_copies(rng, items, 120))
    out = leaked(spark.createDataFrame([(*d, 1, "x") for d in docs], DOC), spark.createDataFrame([(i, "t", lang, t) for i, lang, t in items], ITEM), phrase=False)
    want = {(d, i): n for d, x in docs for i, _, t in items if (n := proximity(x, t, leakage.LEAST_PART))}
    assert {(r.doc_id, r.item_id): r.longest for r in out.collect()} == want and len(want) > 20


def test_one_written_index_answers_two_test_sets(spark, tmp_path):
    rng = random.Random(8)
    first, second = [[(i, "t", "en", " ".join(passage(30, rng))) for i in range(8)] for _ in range(2)]
    docs = [(d, " ".join(passage(9, rng) + rng.choice(first + second)[3].split()[rng.randrange(10) :] + passage(9, rng)), 1, "x") for d in range(60)]
    path = str(tmp_path / "index")
    leakage.build_index(spark.createDataFrame(docs, DOC), "doc_id", "text").write.parquet(path)
    for items in (first, second):
        out = leakage.search_index(spark.read.parquet(path), spark.createDataFrame(items, ITEM))
        want = {}
        for d, text, *_ in docs:
            w = text.split()
            for i, _, _, t in items:
                p = t.split()
                runs = [n for a in range(len(w)) for b in range(len(p)) if (n := next((k for k in range(min(len(w) - a, len(p) - b)) if w[a + k] != p[b + k]), min(len(w) - a, len(p) - b))) >= 16]
                if runs:
                    want[d, i] = max(runs)
        assert {(r.doc, r.item_id): r.longest for r in out.collect()} == want and len(want) > 10


def test_postings_hold_every_term():
    streams = [["a", "b", "a", "c"], [], [" xy", "a"], ["b"]]
    batch = leakage._shard([7, 8, 8, 9], streams)
    items = leakage.Items(*[np.array(x) for x in ([1], [4], [0], [4], [0, 1, 2, 3])], pa.array(["zz", "a", " xy", "b"]))
    held = leakage.read_postings(batch, 0, items)
    lists = [(held.keys[a:b] & ((1 << 33) - 1)).tolist() for a, b in held.listed]
    assert lists == [[], [0, 2, 7], [6], [1, 9]]
    assert held.docs[held.stream(np.array([0, 3, 6, 7, 9]))].tolist() == [7, 7, 8, 8, 9]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "en", " ".join(WORDS[:20]))]) == set()
    assert found(spark, [(1, "text")], []) == set()


@pytest.mark.parametrize("shard,block", [(300, 8 << 20), (1 << 22, 400)])
def test_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(leakage, "SHARD_CHARS", shard)
    monkeypatch.setattr(leakage, "ITEM_CHARS", block)
    rng = random.Random(5)
    common = WORDS[:30]
    items = [(i, "en", " ".join(rng.choice(common) for _ in range(rng.randrange(10, 50)))) for i in range(12)]
    docs = []
    for d in range(40):
        words = [rng.choice(common) for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(4)):
            own = rng.choice(items)[2].split()
            lo, n = rng.randrange(len(own)), rng.randrange(12, 30)
            at = rng.randrange(len(words))
            words[at:at] = own[lo : lo + n]
        docs.append((d, " ".join(words)))

    def windows(text):
        w = text.split()
        return {tuple(w[i : i + 16]) for i in range(len(w) - 15)}

    want = {(d, i) for d, x in docs for i, _, t in items if windows(x) & windows(t)}
    assert found(spark, docs, items) == want and len(want) > 10


def test_shown_text():
    assert shown_text("a [[b|c]]d [[e]] {{x|{{y}}|{{{z}}}}} [[File:f.jpg|thumb|g]] '''h''' <ref>{{i}}</ref>j<br/>k &amp; l").split() == "a cd e h jk & l".split()
    assert shown_text("{{{{{{ open [[ and <!-- lost\nnext <ref>gone\nend").split() == "{{{{{{ open [[ and next end".split()
    assert shown_text("[https://x.invalid/y shown text] z").split() == ["shown", "text", "z"]


def test_very_long_text(spark):
    p = passage(20, random.Random(9))
    long = "filler [[target|words]] " * 60_000
    assert found(spark, [(1, long + " ".join(p)), (2, long)], [(1, "en", " ".join(p))]) == {(1, 1)}
