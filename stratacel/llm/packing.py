"""Filling fixed-capacity containers: texts into containers of tokens.

Items of one length are alike, so the whole problem is a multiset of lengths: a histogram of at
most as many numbers as a container has tokens. Containers are planned on the histogram by minimum
bin slack, and the plan is carried out over the items by their rank within a length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratacel.session import materialize, spread

#: Tokens of a container.
CAPACITY = 2048
#: Items of one length that one task ranks.
RANK_ROWS = 200_000
#: Texts that are tokenised at once.
TEXTS = 64


def load_encoding(path: str, pattern: str):
    """A public byte-level tokenizer from its file of ranks; cached in the process."""
    key = (path, pattern)
    if key not in _LOADED:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


_LOADED: dict = {}


def token_counts(docs: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """key, tokens: the whole texts' sizes. A null text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(path, pattern)
        for batch in batches:
            sizes = [0 if t is None else len(encoding.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, type=pa.int64())], names=["key", "tokens"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(count, rows.select("key").schema.add("tokens", "long"))


def pieces_of(sizes: DataFrame, capacity: int) -> DataFrame:
    """key, piece, start, length: a text of more than the capacity is cut into full pieces and a rest."""
    cut = F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / capacity) - 1))
    return (
        sizes.where("tokens > 0")
        .select("key", "tokens", cut.alias("piece"))
        .select(
            "key",
            F.col("piece").cast("int").alias("piece"),
            (F.col("piece") * capacity).cast("bigint").alias("start"),
            F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("int").alias("length"),
        )
    )


def closest_fill(lengths: Sequence[int], counts: Sequence[int], capacity: int) -> dict[int, int]:
    """The multiset of the lengths whose sum is nearest to the capacity without passing it.

    Bitset subset sums: bit s of the set after the first i lengths tells that a sum of s can be
    made of them. A length's count is split in powers of two, each one shift. Going back from the
    best sum through the kept sets gives the counts. Among fills of one sum the longest lengths,
    which come first, are kept out of the last steps: they are the hardest to place later.
    """
    full = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length, count in zip(lengths, counts):
        left, power = min(count, capacity // length), 1
        while left > 0:
            used = min(power, left)
            steps.append((length, used, reach))
            reach |= (reach << (length * used)) & full
            left -= used
            power *= 2
        if reach >> capacity & 1:
            break
    best = reach.bit_length() - 1
    fill: dict[int, int] = {}
    for length, used, before in reversed(steps):
        if not before >> best & 1:  # can't be made without this step
            fill[length] = fill.get(length, 0) + used
            best -= length * used
    return fill


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Containers as (how many, {length: items in each}).

    Each window begins with the longest length left and is filled by ``closest_fill``; the pattern
    is repeated as often as the counts allow, so the number of windows is bounded by the number of
    lengths, not of items.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    out = []
    while left:
        longest = max(left)
        order = sorted(left, reverse=True)
        counts = [left[k] - (k == longest) for k in order]
        pairs = [(k, c) for k, c in zip(order, counts) if c and k <= capacity - longest]
        fill = closest_fill([k for k, _ in pairs], [c for _, c in pairs], capacity - longest) if pairs else {}
        fill[longest] = fill.get(longest, 0) + 1
        times = min(left[k] // n for k, n in fill.items())
        for k, n in fill.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((times, fill))
    return out


def ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds rank: 0, 1, ... within a length, in an order of hashes.

    A frequent length is ranked in salted parts: the parts' sizes, summed up in order, are added to
    the ranks within them. No count of parts reaches the driver.
    """
    frequent = {k: -(-n // RANK_ROWS) for k, n in histogram.items() if n > RANK_ROWS}
    parts = F.lit(1)
    if frequent:
        by_length = F.create_map(*[F.lit(x) for pair in frequent.items() for x in pair])
        parts = F.coalesce(F.element_at(by_length, F.col("length")), F.lit(1))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("key", "piece"), parts).cast("int"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    offsets = sizes.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy(F.xxhash64("key", "piece", F.lit(1)), "key", "piece")) - 1
    numbered = salted.withColumn("own", own.cast("bigint"))
    return numbered.join(offsets, ["length", "salt"]).select("key", "piece", "start", "length", (F.col("own") + F.col("before")).alias("rank"))


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds container to the pieces: every piece is in one, and no container holds more than the capacity.

    The histogram of lengths, at most ``capacity`` numbers, is all that reaches the driver.
    """
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, base = [], 0
    taken: dict[int, int] = {}
    for times, fill in plan(histogram, capacity):
        for length, each in fill.items():
            lo = taken.get(length, 0)
            taken[length] = lo + each * times
            slots.append((length, lo, each, base))
        base += times
    starts: dict[int, list] = {}
    for length, lo, each, first in slots:
        starts.setdefault(length, []).append((lo, each, first))
    table = {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in starts.items()}
    shared = pieces.sparkSession.sparkContext.broadcast(table)  # grows with the lengths, not with the items

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            container = np.empty(len(length), dtype=np.int64)
            for k in np.unique(length):
                lo, each, first = own[int(k)]
                rows = np.flatnonzero(length == k)
                i = np.searchsorted(lo, rank[rows], side="right") - 1
                container[rows] = first[i] + (rank[rows] - lo[i]) // each[i]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(container)], names=[*batch.schema.names, "container"])

    rows = ranked(pieces, histogram)
    schema = T.StructType([*rows.schema.fields, T.StructField("container", T.LongType())])
    return rows.mapInArrow(place, schema).drop("rank")


def pack_texts(docs: DataFrame, key: str, text: str, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """Texts in containers of ``capacity`` tokens: key, piece, start, length, container.

    Sizes are tokens of the tokenizer whose ranks lie at ``path`` (readable by every executor). A
    text is cut only if it alone exceeds the capacity: into full pieces and one rest. Null and
    empty texts have no tokens and aren't placed; a null key is a key like any other; rows that
    repeat a key are items of their own, and fall in any order within a length; an empty table
    gives an empty result; other columns are never read.
    """
    sizes = materialize(pieces_of(token_counts(docs, key, text, path, pattern), capacity), "pieces")
    return assign(sizes, capacity).withColumnRenamed("key", key)
