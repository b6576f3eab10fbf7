import itertools
import random

import public_tokenizers
import pytest

from stratacel.llm import packing
from stratacel.llm.packing import assign, closest_fill, load_encoding, pack_texts, pieces_of, plan

PATH = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
SIZES = "key bigint, tokens bigint"


def test_closest_fill_is_the_best_sum():
    rng = random.Random(1)
    for _ in range(200):
        lengths = rng.sample(range(1, 30), rng.randrange(1, 5))
        counts = [rng.randrange(1, 5) for _ in lengths]
        capacity = rng.randrange(1, 80)
        fill = closest_fill(lengths, counts, capacity)
        assert all(fill[k] <= counts[lengths.index(k)] for k in fill)
        sums = {sum(k * n for k, n in zip(lengths, c)) for c in itertools.product(*[range(n + 1) for n in counts])}
        assert sum(k * n for k, n in fill.items()) == max(x for x in sums if x <= capacity)


def test_plan_uses_every_item_once():
    rng = random.Random(2)
    for _ in range(20):
        histogram = {k: rng.randrange(1, 400) for k in rng.sample(range(1, 101), 30)}
        used: dict = {}
        for times, fill in plan(histogram, 100):
            assert times > 0 and sum(k * n for k, n in fill.items()) <= 100
            for k, n in fill.items():
                used[k] = used.get(k, 0) + n * times
        assert used == histogram


def placed(spark, rows, capacity):
    pieces = pieces_of(spark.createDataFrame(rows, SIZES), capacity)
    return pieces.collect(), assign(pieces, capacity).collect()


@pytest.mark.parametrize("ranked", [5, 100_000])
def test_every_piece_is_placed_and_fits(spark, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANK_ROWS", ranked)
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 7, 7, 7, rng.randrange(1, 100), rng.randrange(90, 350)])) for i in range(600)]
    pieces, out = placed(spark, rows, 100)
    assert sorted((r.key, r.piece, r.start, r.length) for r in out) == sorted((r.key, r.piece, r.start, r.length) for r in pieces)
    used: dict = {}
    for r in out:
        used[r.container] = used.get(r.container, 0) + r.length
    assert max(used.values()) <= 100 and sorted(used) == list(range(len(used)))
    assert len(used) <= -(-sum(used.values()) // 100) * 1.02 + 1
    for key, tokens in rows:
        own = sorted((r.start, r.length) for r in out if r.key == key)
        assert sum(n for _, n in own) == tokens
        assert all(n == 100 for _, n in own[:-1]) and (len(own) == 1 or tokens > 100 or tokens == 0)


def test_empty_null_and_repeated(spark):
    assert placed(spark, [], 100) == ([], [])
    pieces, out = placed(spark, [(None, 3), (1, None), (2, 0), (3, 60), (3, 60)], 100)
    assert sorted((r.key or -1, r.length) for r in out) == [(-1, 3), (3, 60), (3, 60)]
    assert len({r.container for r in out if r.key == 3}) == 2


def test_sizes_are_tokens_of_whole_texts(spark):
    texts = [(1, "a b c", 9), (2, "", 9), (3, None, 9), (4, "long text " * 3000, 9), (5, "日本語。", 9)]
    out = pack_texts(spark.createDataFrame(texts, "doc bigint, text string, key int"), "doc", "text", PATH, public_tokenizers.PATTERN).collect()
    encoding = load_encoding(PATH, public_tokenizers.PATTERN)
    for doc, text, _ in texts:
        own = [r for r in out if r.doc == doc]
        assert sum(r.length for r in own) == (len(encoding.encode_ordinary(text)) if text else 0)
        assert len(own) == max(1, -(-sum(r.length for r in own) // 2048)) or not own
