"""Near-duplicate drawings by a blocked sparse matrix product.

Rows of the matrix are classes of equal content, columns are runs of adjacent pixels (n-grams).
The product of the matrix with its transpose holds the overlaps of all pairs of rows. It is taken
in two passes. The first goes block of columns by block of columns, over the columns that
size-derived bounds leave: of a row with n grams a pair of at least the wanted similarity must
share one of its rarest n - ceil(t n) + 1, so only those enter, and of a pair it keeps what the
sizes and the places of the shared gram allow. The second accumulates the overlap of those pairs
over whole rows, block of rows by block of rows, and the counts decide.

A gram is known by 64 mixed bits of its pixels: counts are of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacel.session import checkpoint, estimated_bytes, materialize, spread

#: Adjacent pixels of one gram.
RUN = 4
#: Wanted similarity: shared grams divided by the grams of both.
SIMILARITY = 0.6
#: Counters of the sketch of gram frequencies, as a power of two: it follows the size of the pixels
#: between these bounds, of which the upper one is what a task can hold.
SKETCH_BITS = (22, 25)
#: Bytes of estimated pixels for one counter.
COUNTER_BYTES = 256
#: Parts in which the sketch is summed.
SKETCH_PARTS = 64
#: Bytes of the estimated pixels that one block of columns stands for.
BLOCK_BYTES = 2 << 20
#: Pairs that one emitted batch holds.
EMIT_PAIRS = 200_000
#: Classes that share a gram and are multiplied in one task; a more frequent gram is split.
HOT_ROWS = 20_000
#: Members of a class in one salted part; parts are paired with parts.
SALT_ROWS = 2_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _M3
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def pixel_runs(width: np.ndarray, height: np.ndarray, pixels: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of all distinct runs of the batch, sorted; rows without well-formed pixels have none."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(pixels), -1)).astype(np.int64)
    good = (sizes == width * height * 4) & (width >= RUN) & (height > 0)
    if not good.any():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    kept = pixels.filter(pa.array(good))
    kept = pa.concat_arrays([kept])  # offset zero
    offsets = np.frombuffer(kept.buffers()[1], dtype=np.int32 if pa.types.is_binary(kept.type) else np.int64)[kept.offset : kept.offset + len(kept) + 1]
    flat = np.frombuffer(kept.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view("<u4")
    rows, w, n = np.flatnonzero(good), width[good], (width * height)[good]
    begin = np.repeat(np.cumsum(n) - n, n)
    x = (np.arange(len(flat)) - begin) % np.repeat(w, n)
    at = np.flatnonzero(x + RUN <= np.repeat(w, n))
    opaque = np.zeros(len(at), dtype=bool)
    for k in range(RUN):
        opaque |= flat[at + k] > 0x00FFFFFF
    at = at[opaque]
    pair = lambda k: flat[at + k].astype(np.uint64) | (flat[at + k + 1].astype(np.uint64) << np.uint64(32))
    gram = _mixed(_mixed(pair(0) + _M1) + pair(2) * _M1)
    owner = np.repeat(rows, n)[at]
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
    return owner[new], gram[new]


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(pa.compute.fill_null(batch.column(name), 0)).astype(np.int64)


def _grams(batch: pa.RecordBatch, suffix: str = "") -> tuple[np.ndarray, np.ndarray]:
    return pixel_runs(_ints(batch, f"width{suffix}"), _ints(batch, f"height{suffix}"), batch.column(f"pixels{suffix}"))


def _digest() -> Column:
    return F.xxhash64("width", "height", "pixels")


def source_cels(cels: DataFrame) -> DataFrame:
    """One row per source cel with content: cel_id, size (its grams), hi and lo (key of its content), digest.

    A source cel is one (doc_id, source_layer_id, source_frame) whose source_frame equals
    linked_source_frame; its lowest cel_id stands for it. Where that cel_id was delivered with
    different pixels, the delivery with the fewest grams counts, and the digest tells which. Contents are equal when the
    sets of grams are; the key is 128 bits of the set. Pixels don't leave the scan's tasks.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, gram = _grams(batch)
            n = batch.num_rows
            size = np.bincount(owner, minlength=n)
            begin = np.append(np.searchsorted(owner, np.arange(n)), 0)[:n]
            keys_of = []
            for salt in (_M1, _M2):  # sums of mixed grams don't depend on their order
                total = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(gram ^ salt), dtype=np.uint64)])
                keys_of.append((total[begin + size] - total[begin]).view(np.int64))
            names = ["doc_id", "source_layer_id", "source_frame", "cel_id", "digest"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in names], pa.array(size, type=pa.int64()), *[pa.array(k) for k in keys_of]],
                names=[*names, "size", "hi", "lo"],
            )

    own = cels.where("source_frame = linked_source_frame AND cel_id IS NOT NULL").select(
        "doc_id", "source_layer_id", "source_frame", F.col("cel_id").cast("bigint").alias("cel_id"), _digest().alias("digest"), "width", "height", "pixels"
    )
    schema = own.select("doc_id", "source_layer_id", "source_frame", "cel_id", "digest").schema
    for name in ("size", "hi", "lo"):
        schema = schema.add(name, "long")
    rows = spread(own).mapInArrow(keys, schema)
    first = rows.groupBy("doc_id", "source_layer_id", "source_frame").agg(
        F.min(F.struct("cel_id", "size", "hi", "lo", "digest")).alias("row")
    )
    return first.select("row.*").where("size > 0")


def classes_of(members: DataFrame) -> DataFrame:
    """Classes of equal content: rep (lowest cel_id) and its digest, members, size, hi, lo."""
    one = members.groupBy("hi", "lo", "size").agg(F.min(F.struct("cel_id", "digest")).alias("rep"), F.count("*").alias("members"))
    return one.select("hi", "lo", "size", F.col("rep.cel_id").alias("rep"), F.col("rep.digest").alias("digest"), "members")


def sketch_bits(contents: DataFrame) -> int:
    least, most = SKETCH_BITS
    return min(most, max(least, (estimated_bytes(contents) // COUNTER_BYTES).bit_length()))


def gram_sketch(contents: DataFrame, bits: int) -> tuple[np.ndarray, float]:
    """How often grams occur, over all rows, as logarithmic codes of 2^bits counters; their mean.

    It only orders the grams from rare to frequent. Grams that share a counter look more frequent
    than they are, which costs time and no pair.
    """
    width = 1 << bits
    part = width // SKETCH_PARTS
    kind = np.uint16 if part <= 65536 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width, dtype=np.uint32)
        for batch in batches:
            _, gram = _grams(batch)
            at, n = np.unique(gram >> np.uint64(64 - bits), return_counts=True)
            counts[at.astype(np.int64)] += n.astype(np.uint32)
        for i in range(SKETCH_PARTS):
            own = counts[i * part : (i + 1) * part]
            at = np.flatnonzero(own)
            if len(at):
                n = own[at]
                blobs = [np.diff(at, prepend=0).astype(kind).tobytes(), n.astype(np.uint16 if n.max() < 65536 else np.uint32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([i], type=pa.int32()), *[pa.array([b]) for b in blobs]], names=["part", "at", "n"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(part, dtype=np.uint64)
        for batch in batches:
            for at, n in zip(batch.column("at"), batch.column("n")):
                where = np.cumsum(np.frombuffer(at.as_py(), dtype=kind).astype(np.int64))
                total[where] += _sized(n.as_py(), len(where)).astype(np.uint64)
        code = np.floor(8 * np.log2(1 + total.astype(float))).clip(0, 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], type=pa.int32()), pa.array([code.tobytes()]), pa.array([int(total.sum())], type=pa.int64())],
            names=["part", "code", "entries"],
        )

    parts = contents.mapInArrow(count, "part int, at binary, n binary").groupBy("part").applyInArrow(add, "part int, code binary, entries bigint")
    sketch, entries = np.zeros(width, dtype=np.uint8), 0
    for row in parts.collect():  # SKETCH_PARTS rows of fixed size
        sketch[row.part * part : (row.part + 1) * part] = np.frombuffer(row.code, dtype=np.uint8)
        entries += row.entries
    return sketch, entries / width


def row_groups(code: np.ndarray, load: float) -> np.ndarray:
    """Into how many groups the rows of a gram are split: one, but for grams far above the mean counter."""
    frequency = 2.0 ** ((code.astype(float) + 1) / 8)
    return np.ceil((frequency - 2 * load) / HOT_ROWS).clip(1).astype(np.int64)


def split_hot(gram: np.ndarray, ids: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, grams): entries of a split gram once for every pair of groups that its row takes part in.

    Two rows of a gram meet where the pair of their groups does, so the work on a gram that a large
    part of the rows hold is shared by groups * (groups + 1) / 2 tasks.
    """
    places = np.repeat(np.arange(len(gram)), groups)
    other = (np.arange(len(places)) - np.repeat(np.cumsum(groups) - groups, groups)).astype(np.uint64)
    own = _mixed(ids.astype(np.uint64))[places] % groups[places].astype(np.uint64)
    pair = (np.minimum(own, other) << np.uint64(32)) | np.maximum(own, other)
    return places, np.where(groups[places] > 1, _mixed(gram[places] ^ _mixed(pair + _M1)), gram[places])


def prefixes(contents: DataFrame, similarity: float, blocks: int) -> DataFrame:
    """The entries of the matrix that the size bounds leave, packed by block of columns.

    One row per input batch and block: the classes that occur, their sizes, and per entry the
    gram's lower half, the place of its class, and its position in the class's order from rare to
    frequent.
    """
    spark = contents.sparkSession
    bits = sketch_bits(contents)
    codes, load = gram_sketch(contents, bits)
    sketch = spark.sparkContext.broadcast(codes.tobytes())  # 2^bits bytes

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_of = np.frombuffer(sketch.value, dtype=np.uint8)
        for batch in batches:
            owner, gram = _grams(batch)
            if not len(owner):
                continue
            code = code_of[(gram >> np.uint64(64 - bits)).astype(np.int64)]
            order = np.lexsort((gram, code, owner))
            owner, gram = owner[order], gram[order]
            size = np.bincount(owner, minlength=batch.num_rows)
            position = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
            limit = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
            kept = position < limit[owner]
            owner, gram, position, groups = owner[kept], gram[kept], position[kept], row_groups(code[order][kept], load)
            ids = _ints(batch, "rep")
            if (groups > 1).any():
                places, gram = split_hot(gram, ids[owner], groups)
                owner, position = owner[places], position[places]
            block = ((gram >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            owner, gram, position, block = owner[order], gram[order], position[order], block[order]
            cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
            lines = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                rows, local = np.unique(owner[lo:hi], return_inverse=True)
                lines.append(
                    (
                        int(block[lo]),
                        ids[rows].tobytes(),
                        size[rows].astype(np.int32).tobytes(),
                        gram[lo:hi].astype(np.uint32).tobytes(),
                        local.astype(np.uint32 if len(rows) > 65535 else np.uint16).tobytes(),
                        position[lo:hi].astype(np.int32 if size.max() > 65535 else np.uint16).tobytes(),
                    )
                )
            columns = list(zip(*lines))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], type=pa.int32()), *[pa.array(c, type=pa.binary()) for c in columns[1:]]],
                names=["block", "ids", "sizes", "gram", "local", "position"],
            )

    return contents.mapInArrow(pack, "block int, ids binary, sizes binary, gram binary, local binary, position binary")


def _sized(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype={2: np.uint16, 4: np.uint32}[len(data) // n]).astype(np.int64)


def block_pairs(gram: np.ndarray, ids: np.ndarray, size: np.ndarray, position: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes that share a gram of the block and whose sizes and positions allow the similarity.

    Within a gram the classes are sorted by size, so that the partners of one end where theirs is
    too large; each step pairs every class with the one k places on.
    """
    order = np.lexsort((ids, size, gram))
    gram, ids, size, position = gram[order], ids[order], size[order], position[order]
    rest = size - position  # this gram and all after it
    alive, k = np.arange(len(gram)), 0
    while len(alive):
        k += 1
        alive = alive[alive + k < len(gram)]
        alive = alive[gram[alive] == gram[alive + k]]
        alive = alive[size[alive] >= similarity * size[alive + k] - 1e-9]
        other = alive + k
        # A pair's first common gram has all its overlap at and after it.
        need = np.ceil(similarity / (1 + similarity) * (size[alive] + size[other]) - 1e-9)
        good = (np.minimum(rest[alive], rest[other]) >= need) & (ids[alive] != ids[other])
        if good.any():
            a, b = ids[alive[good]], ids[other[good]]
            yield np.minimum(a, b), np.maximum(a, b)


def candidate_pairs(entries: DataFrame, similarity: float) -> DataFrame:
    """a, b (a < b): the pairs that the first pass leaves."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for i in range(batch.num_rows):
                data = {c: batch.column(c)[i].as_py() for c in ("ids", "sizes", "gram", "local", "position")}
                gram = np.frombuffer(data["gram"], dtype=np.uint32)
                local = _sized(data["local"], len(gram))
                parts[0].append(gram)
                parts[1].append(np.frombuffer(data["ids"], dtype=np.int64)[local])
                parts[2].append(np.frombuffer(data["sizes"], dtype=np.int32).astype(np.int64)[local])
                parts[3].append(_sized(data["position"], len(gram)))
        if not parts[0]:
            return
        held: list[np.ndarray] = []
        for a, b in block_pairs(*[np.concatenate(p) for p in parts], similarity):
            held.append(np.stack([a, b]))
            if sum(h.shape[1] for h in held) >= EMIT_PAIRS:
                yield _pairs(held)
                held = []
        if held:
            yield _pairs(held)

    return entries.groupBy("block").applyInArrow(multiply, "a bigint, b bigint").distinct()


def _pairs(held: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(held, axis=1)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])


def gram_rows(contents: DataFrame) -> DataFrame:
    """rep and grams: the whole rows of the matrix, sorted."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, gram = _grams(batch)
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1)) * 8
            if ends[-1] < 2**31:
                packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(gram)])
                yield pa.RecordBatch.from_arrays([batch.column("rep"), packed], names=["rep", "grams"])
            else:
                for i in range(batch.num_rows):
                    own = gram[ends[i] // 8 : ends[i + 1] // 8].tobytes()
                    yield pa.RecordBatch.from_arrays([batch.column("rep").slice(i, 1), pa.array([own], type=pa.binary())], names=["rep", "grams"])

    return contents.mapInArrow(rows, "rep bigint, grams binary")


def _row_entries(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of a column of packed rows."""
    size = np.asarray(pa.compute.binary_length(rows)).astype(np.int64) // 8
    rows = pa.concat_arrays([rows])
    offsets = np.frombuffer(rows.buffers()[1], dtype=np.int32)[rows.offset : rows.offset + len(rows) + 1]
    data = rows.buffers()[2]
    gram = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]].view(np.uint64) if data else np.empty(0, dtype=np.uint64)
    return np.repeat(np.arange(len(rows)), size), gram


def block_product(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Overlaps of the rows of two blocks, place by place, and the grams of both."""
    n = len(left)
    (oa, ga), (ob, gb) = _row_entries(left), _row_entries(right)
    owner, gram = np.concatenate([oa, ob]), np.concatenate([ga, gb])
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    again = (owner[1:] == owner[:-1]) & (gram[1:] == gram[:-1])
    shared = np.bincount(owner[1:][again], minlength=n)
    return shared, np.bincount(owner, minlength=n) - shared


def class_links(cels: DataFrame, classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs of different classes of at least the wanted similarity: a < b, shared, grams (of both)."""
    pixels = cels.where("source_frame = linked_source_frame").select(
        F.col("cel_id").cast("bigint").alias("rep"), _digest().alias("digest"), "width", "height", "pixels"
    )
    once = pixels.join(classes.select("rep", "digest"), ["rep", "digest"], "left_semi").groupBy("rep", "digest").agg(
        F.max(F.struct("width", "height", "pixels")).alias("row")
    )
    contents = materialize(once.select("rep", "row.width", "row.height", "row.pixels"), "contents")
    blocks = max(contents.sparkSession.sparkContext.defaultParallelism, estimated_bytes(contents) // BLOCK_BYTES)
    candidates = checkpoint(candidate_pairs(prefixes(contents, similarity, blocks), similarity))
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    rows = materialize(gram_rows(contents.join(wanted, "rep", "left_semi")), "rows")
    side = lambda s: rows.select(F.col("rep").alias(s), F.col("grams").alias(f"grams_{s}"))
    both = candidates.join(side("b"), "b").join(side("a"), "a")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, grams = block_product(batch.column("grams_a"), batch.column("grams_b"))
            kept = pa.array(shared >= similarity * grams - 1e-9)
            out = pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(shared, type=pa.int64()), pa.array(grams, type=pa.int64())],
                names=["a", "b", "shared", "grams"],
            )
            yield out.filter(kept)

    return both.mapInArrow(multiply, "a bigint, b bigint, shared bigint, grams bigint")


def near_duplicates(cels: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the source cels: no link between different contents is lost.

    members: cel_id, rep (its class, the lowest cel_id of equal content), members of the class.
    links: pairs of classes a < b with shared and grams. Copies are members of one class, so a
    content that a third of all cels repeat enters the product once.

    Null or malformed pixels, drawings narrower than a gram and wholly transparent ones have no
    content and don't count; a null cel_id doesn't either; repeated rows count once; an empty table
    gives empty results; columns that aren't named are never read.
    """
    members = checkpoint(source_cels(cels))
    classes = checkpoint(classes_of(members))
    links = class_links(cels, classes, similarity)
    joined = members.select("cel_id", "hi", "lo", "size").join(classes, ["hi", "lo", "size"]).select("cel_id", "rep", "members")
    return joined, links


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of cels that the classes and their links stand for: lo < hi.

    Classes are cut into salted parts of some ``SALT_ROWS`` members before anything is joined, and
    parts are paired with parts, so the pairs of a hot class, which the result must hold, are made
    by as many tasks as there are pairs of parts.
    """
    parts = F.ceil(F.col("members") / SALT_ROWS).cast("int")
    salted = members.select("rep", F.pmod(F.xxhash64("cel_id"), parts).cast("int").alias("salt"), "cel_id")
    heads = members.where("cel_id = rep")
    hot = heads.where(parts > 1).select("rep", parts.alias("parts"))
    own = heads.where("members > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    ends = links.select("a", "b").unionByName(own)
    for end in ("a", "b"):
        ends = ends.join(hot.select(F.col("rep").alias(end), F.col("parts").alias(f"parts_{end}")), end, "left")
    count = lambda end: F.coalesce(f"parts_{end}", F.lit(1)) - 1
    keys = (
        ends.withColumn("salt_a", F.explode(F.sequence(F.lit(0), count("a"))))
        .withColumn("salt_b", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("salt_a")).otherwise(0), count("b"))))
        .select("a", "b", "salt_a", "salt_b")
    )
    side = lambda end, name: keys.join(salted.select(F.col("rep").alias(end), F.col("salt").alias(f"salt_{end}"), F.col("cel_id").alias(name)), [end, f"salt_{end}"])
    both = side("a", "x").join(side("b", "y"), ["a", "b", "salt_a", "salt_b"]).where("a <> b OR salt_a <> salt_b OR x < y")
    return both.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
