"""Runs of repeated consecutive events in ordered sequences.

A sequence is range-sorted over chunks; each chunk encodes its runs locally, and a tree of small
merges joins the last run of a chunk with the first of the next. The summaries are associative:
whatever the cuts between chunks, the same runs come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacel.session import checkpoint, materialize, partitions_for

#: Bytes of the estimated input in one range chunk.
CHUNK_BYTES = 8 << 20
#: Chunks whose outer runs one merge task joins.
FAN_IN = 16
#: Pixels in which two repeated drawings may differ.
MAX_DIFFERING = 2
#: Pixels that are compared at once.
COMPARED = 1 << 20

#: What the summary of a run keeps of its first and of its last event.
EDGE = ["frame", "x", "y", "opacity", "width", "height", "link", "pixels"]
RUN_FIELDS = "doc string, layer bigint, first_frame int, last_frame int, events bigint, duration bigint"
EDGE_FIELDS = "frame int, x int, y int, opacity int, width int, height int, link int, pixels binary"
SUMMARY = (
    f"chunk int, ordinal int, closed boolean, {RUN_FIELDS}, "
    + ", ".join(f"head_{f.strip()}" for f in EDGE_FIELDS.split(","))
    + ", "
    + ", ".join(f"tail_{f.strip()}" for f in EDGE_FIELDS.split(","))
)


def resolve_links(links: DataFrame) -> DataFrame:
    """Follow links to their ends: columns doc, layer, source, target, of which source is the key.

    Pointer doubling: each round replaces a target by its own target, so a chain of length n takes
    log2(n) rounds, and no sequence is gathered in one task. Each round's result is written to the
    shared folder. A chain that runs into a cycle ends at the cycle's lowest frame. Null keys or
    targets are no links.
    """
    cut = checkpoint(
        links.where("doc IS NOT NULL AND layer IS NOT NULL AND source IS NOT NULL AND target IS NOT NULL AND source <> target")
        .groupBy("doc", "layer", "source")
        .agg(F.min("target").alias("target"))
        .withColumn("low", F.least("source", "target"))
    )
    most = None
    rounds = 0
    while True:
        onward = cut.select("doc", "layer", F.col("source").alias("target"), F.col("target").alias("next"), F.col("low").alias("next_low"))
        step = cut.join(onward, ["doc", "layer", "target"], "left").select(
            "doc",
            "layer",
            "source",
            F.coalesce("next", "target").alias("target"),
            F.least("low", F.coalesce("next_low", "low")).alias("low"),
            F.col("next").isNotNull().alias("moved"),
        )
        step = checkpoint(step)
        if step.where("moved").isEmpty():
            return step.select("doc", "layer", "source", "target")
        cut = step.drop("moved")
        rounds += 1
        if rounds >= 5:  # longer than any chain of the usual length: is it a cycle?
            if most is None:
                most = links.groupBy("doc", "layer").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
            if 2**rounds > most:
                break
    # Every target that still has a link lies on a cycle, whose nodes its path covers.
    onward = cut.select("doc", "layer", F.col("source").alias("target"), F.col("low").alias("cycle"))
    ends = cut.join(onward, ["doc", "layer", "target"], "left")
    return ends.select("doc", "layer", "source", F.coalesce("cycle", "target").alias("target"))


def same_drawing(a: bytes | None, b: bytes | None, width: int, height: int) -> bool:
    """Well-formed buffers of one size of which at most two pixels differ."""
    if a is None or b is None or len(a) != width * height * 4 or len(b) != len(a):
        return False
    if a == b:
        return True
    return int(np.count_nonzero(np.frombuffer(a, dtype="<u4") != np.frombuffer(b, dtype="<u4"))) <= MAX_DIFFERING


def same_drawings(pixels: pa.Array, at: np.ndarray, area: np.ndarray) -> np.ndarray:
    """``same_drawing`` of each place and the one before it, on the flat buffer of the column."""
    out = np.zeros(len(at), dtype=bool)
    if not len(at):
        return out
    pixels = pa.concat_arrays([pixels])
    offsets = np.frombuffer(pixels.buffers()[1], dtype=np.int32 if pa.types.is_binary(pixels.type) else np.int64)[pixels.offset :].astype(np.int64)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(pixels), -1)).astype(np.int64)
    sound = np.flatnonzero((sizes[at] == area * 4) & (sizes[at - 1] == area * 4) & (area >= 0))
    out[sound] = True  # two empty drawings are the same
    sound = sound[area[sound] > 0]
    if not len(sound):
        return out
    data = np.frombuffer(pixels.buffers()[2], dtype=np.uint8)
    for part in np.split(sound, np.flatnonzero(np.diff(np.cumsum(area[sound]) // COMPARED)) + 1):
        size = area[part] * 4
        begin = np.cumsum(size) - size
        inner = np.arange(size.sum()) - np.repeat(begin, size)
        one, two = (data[np.repeat(offsets[at[part] - k], size) + inner].view("<u4") for k in (1, 0))
        out[part] = np.add.reduceat(one != two, begin // 4, dtype=np.int64) <= MAX_DIFFERING
    return out


def repeats(a: dict, b: dict) -> bool:
    """Whether event b, at the next position of the same sequence, repeats event a."""
    if any(a[k] is None or a[k] != b[k] for k in ("x", "y", "opacity")):
        return False
    if a["link"] is not None and a["link"] == b["link"]:
        return True
    if a["width"] is None or a["height"] is None or a["width"] != b["width"] or a["height"] != b["height"]:
        return False
    return same_drawing(a["pixels"], b["pixels"], a["width"], a["height"])


class _Chunk:
    """Encodes the sorted events of one chunk as run summaries, batch by batch."""

    def __init__(self, number: int):
        self.number, self.ordinal, self.run = number, 0, None

    def _emit(self, out: list, closed: bool) -> None:
        if self.run is not None:
            out.append((self.number, self.ordinal, closed, self.run))
            self.ordinal += 1

    def feed(self, batch: pa.RecordBatch, schema: pa.Schema) -> list[pa.RecordBatch]:
        """Runs that this batch has closed. The first run of a chunk stays open on its left."""
        n = batch.num_rows
        col = {name: batch.column(name) for name in batch.schema.names}
        values = {k: col[k].to_numpy(zero_copy_only=False) for k in ("layer", "frame", "x", "y", "opacity", "width", "height", "link")}
        code = col["doc"].dictionary_encode().indices.to_numpy(zero_copy_only=False)
        same = np.zeros(n, dtype=bool)  # repeats the row before it
        drawn = np.zeros(n, dtype=bool)  # does if the pixels agree
        with np.errstate(invalid="ignore"):
            eq = lambda k: values[k][1:] == values[k][:-1]  # noqa: E731  (null, as NaN, equals nothing)
            near = (code[1:] == code[:-1]) & eq("layer") & (values["frame"][1:] == values["frame"][:-1] + 1)
            near &= eq("x") & eq("y") & eq("opacity")
            same[1:] = near & eq("link")
            drawn[1:] = near & ~same[1:] & eq("width") & eq("height")
        at = np.flatnonzero(drawn)
        same[at] = same_drawings(col["pixels"], at, values["width"][at].astype(np.int64) * values["height"][at].astype(np.int64))
        starts = np.flatnonzero(~same)
        if self.run is not None and self._continues(col, self._edge(col, 0)):
            starts = starts[1:]
        duration = np.nan_to_num(col["duration"].to_numpy(zero_copy_only=False).astype(float))
        ends = np.append(starts[1:], n)
        before = starts[0] if len(starts) else n
        if before > 0:
            self._extend(col, 0, before, duration)
        if not len(starts):
            return []
        open_rows: list = []
        self._emit(open_rows, self.ordinal > 0)
        inner = slice(0 if self.ordinal > 0 else 1, len(starts) - 1)
        if self.ordinal == 0 and len(starts) > 1:  # the chunk's first run begins and ends here
            self._begin(col, starts[0], ends[0], duration)
            self._emit(open_rows, False)
        out = [_summary_batch(open_rows, schema)] if open_rows else []
        lo, hi = starts[inner], ends[inner]
        if len(lo):
            total = np.concatenate([[0.0], np.cumsum(duration)])
            fields = {
                "chunk": pa.array(np.full(len(lo), self.number), type=pa.int32()),
                "ordinal": pa.array(np.arange(self.ordinal, self.ordinal + len(lo)), type=pa.int32()),
                "closed": pa.array(np.ones(len(lo), dtype=bool)),
                "doc": col["doc"].take(pa.array(lo)),
                "layer": col["layer"].take(pa.array(lo)),
                "first_frame": col["frame"].take(pa.array(lo)),
                "last_frame": col["frame"].take(pa.array(hi - 1)),
                "events": pa.array(hi - lo, type=pa.int64()),
                "duration": pa.array((total[hi] - total[lo]).astype(np.int64)),
            }
            arrays = [fields[f.name].cast(f.type) if f.name in fields else pa.nulls(len(lo), f.type) for f in schema]
            out.append(pa.RecordBatch.from_arrays(arrays, schema=schema))
            self.ordinal += len(lo)
        self._begin(col, starts[-1], n, duration)
        return out

    def _begin(self, col: dict, lo: int, hi: int, duration: np.ndarray) -> None:
        head = self._edge(col, lo)
        self.run = {
            "doc": col["doc"][int(lo)].as_py(), "layer": col["layer"][int(lo)].as_py(), "first_frame": head["frame"],
            "last_frame": head["frame"], "events": 0, "duration": 0, "head": head, "tail": head,
        }
        self._extend(col, lo, hi, duration)

    def _edge(self, col: dict, i: int) -> dict:
        return {k: col[k][int(i)].as_py() for k in EDGE}

    def _continues(self, col: dict, head: dict) -> bool:
        run = self.run
        return run["doc"] == col["doc"][0].as_py() and run["layer"] == col["layer"][0].as_py() and run["last_frame"] + 1 == head["frame"] and repeats(run["tail"], head)

    def _extend(self, col: dict, lo: int, hi: int, duration: np.ndarray) -> None:
        self.run["events"] += int(hi - lo)
        self.run["duration"] += int(duration[lo:hi].sum())
        self.run["tail"] = self._edge(col, hi - 1)
        self.run["last_frame"] = self.run["tail"]["frame"]

    def end(self) -> list:
        """The last run stays open on its right."""
        out: list = []
        self._emit(out, False)
        return out


def _summary_batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    flat = []
    for number, ordinal, closed, run in rows:
        line = {"chunk": number, "ordinal": ordinal, "closed": closed}
        line.update({k: run[k] for k in ("doc", "layer", "first_frame", "last_frame", "events", "duration")})
        if not closed:  # a closed run is never compared again
            for side in ("head", "tail"):
                line.update({f"{side}_{k}": run[side][k] for k in EDGE})
        flat.append(line)
    return pa.RecordBatch.from_pylist(flat, schema=schema)


def _join(rows: list[tuple]) -> list[tuple]:
    """Joins the runs of neighbouring chunks; all but the outer two become closed."""
    rows.sort(key=lambda r: (r[0], r[1]))
    out: list[list] = []
    for number, ordinal, closed, run in rows:
        last = out[-1] if out else None
        if last and not closed and not last[2] and last[0] != number:
            a, b = last[3], run
            if a["doc"] == b["doc"] and a["layer"] == b["layer"] and a["last_frame"] is not None and b["first_frame"] == a["last_frame"] + 1 and repeats(a["tail"], b["head"]):
                joined = a | {"last_frame": b["last_frame"], "events": a["events"] + b["events"], "duration": a["duration"] + b["duration"], "tail": b["tail"]}
                out[-1] = [number, ordinal, False, joined]
                continue
        out.append([number, ordinal, closed, run])
    return [(out[0][0], i, 0 < i < len(out) - 1, r[3]) for i, r in enumerate(out)]


def _unflatten(table: pa.Table) -> list[tuple]:
    rows = []
    for line in table.to_pylist():
        run = {k: line[k] for k in ("doc", "layer", "first_frame", "last_frame", "events", "duration")}
        run |= {side: {k: line[f"{side}_{k}"] for k in EDGE} for side in ("head", "tail")}
        rows.append((line["chunk"], line["ordinal"], line["closed"], run))
    return rows


def _encoder(schema: pa.Schema) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, key = _Chunk(TaskContext.get().partitionId()), None
        for batch in batches:
            batch, key = _positions_once(batch, key)
            if batch.num_rows:
                yield from chunk.feed(batch, schema)
        rows = chunk.end()
        if rows:
            yield _summary_batch(rows, schema)

    return encode


def _positions_once(batch: pa.RecordBatch, last: tuple | None) -> tuple[pa.RecordBatch, tuple | None]:
    """Of the rows of one position the first in sort order; ``last`` is the position before the batch."""
    n = batch.num_rows
    if not n:
        return batch, last
    doc = batch.column("doc").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    layer, frame = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("layer", "frame"))
    new = np.ones(n, dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (layer[1:] != layer[:-1]) | (frame[1:] != frame[:-1])
    at = lambda i: tuple(batch.column(k)[i].as_py() for k in ("doc", "layer", "frame"))
    if last is not None and at(0) == last:
        new[0] = False
    return batch.filter(pa.array(new)), at(n - 1)


def collapse_runs(cels: DataFrame, frames: DataFrame, chunks: int | None = None) -> DataFrame:
    """Each run of repeated cels of a (doc_id, source_layer_id) as one event.

    A cel repeats the one at the frame before when x, y and opacity are equal and either the links
    end at the same frame, or size and pixels agree up to ``MAX_DIFFERING`` pixels. Columns:
    doc_id, source_layer_id, first_frame, last_frame, cels, duration_ms (sum over its frames, of
    the latest delivery of each; a null duration adds nothing). Runs of one cel come out too.

    Rows without doc_id, source_layer_id or frame_index have no position and don't count; null in
    x, y, opacity, size, link or pixels equals nothing; of the rows at one position the one with
    the lowest cel_id, then the latest, counts; empty tables give an empty result; columns that
    aren't named here are never read.

    Pixels are shuffled once, by range of the position; the links' ends and the durations come
    beside them as narrow rows of the same position.
    """
    cels = cels.where("doc_id IS NOT NULL AND source_layer_id IS NOT NULL AND frame_index IS NOT NULL")
    key = [F.col("doc_id").alias("doc"), F.col("source_layer_id").cast("bigint").alias("layer")]
    links = cels.select(*key, F.col("source_frame").alias("source"), F.col("linked_source_frame").alias("target"))
    ends = resolve_links(links)
    lasting = frames.groupBy(F.col("doc_id").alias("doc"), F.col("frame_index").alias("frame")).agg(
        F.max(F.struct("ingested_at", F.col("duration_ms").cast("bigint").alias("ms"))).alias("latest")
    )
    count = chunks or partitions_for(cels, CHUNK_BYTES)
    narrow = (
        cels.select(*key, F.col("frame_index").alias("frame"), F.col("linked_source_frame").alias("source"), "cel_id", "ingested_at")
        .join(ends, ["doc", "layer", "source"], "left")
        .join(lasting, ["doc", "frame"], "left")
        .groupBy("doc", "layer", "frame")
        .agg(
            F.min_by(F.struct(F.coalesce("target", "source").alias("link")), _order()).alias("end"),
            F.max("latest.ms").alias("ms"),
        )
        .select("doc", "layer", "frame", F.col("end.link").alias("link"), F.col("ms").alias("duration"))
    )
    body = cels.select(*key, F.col("frame_index").alias("frame"), "x", "y", "opacity", "width", "height", "pixels", _order().alias("rank"))
    body = body.withColumns({"link": F.lit(None).cast("int"), "duration": F.lit(None).cast("bigint")})
    beside = narrow.select(
        "doc", "layer", "frame", *[F.lit(None).cast(t).alias(c) for c, t in [("x", "int"), ("y", "int"), ("opacity", "int"), ("width", "int"), ("height", "int"), ("pixels", "binary")]],
        F.lit(None).cast(body.schema["rank"].dataType).alias("rank"), "link", "duration",
    )
    events = (
        body.unionByName(beside)
        .repartitionByRange(count, "doc", "layer", "frame")
        .sortWithinPartitions("doc", "layer", "frame", F.col("rank").asc_nulls_first())
    )
    schema = _arrow(cels.sparkSession)
    encode = _encoder(schema)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encode(_carry_side_rows(batches))

    runs = events.drop("rank").mapInArrow(paired, SUMMARY)
    return merge_runs(runs, count).select(
        F.col("doc").alias("doc_id"), F.col("layer").alias("source_layer_id"), "first_frame", "last_frame",
        F.col("events").alias("cels"), F.col("duration").alias("duration_ms"),
    )


def _order():
    """Sort order of the rows at one position: lowest cel_id first, of its deliveries the latest."""
    return F.struct(F.coalesce(F.col("cel_id"), F.lit(2**63 - 1)), -F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(-(2**62))))


def _arrow(spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(SUMMARY))


def _carry_side_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moves link and duration from a position's narrow row, which sorts first, to its other rows."""
    link = duration = None  # of the position before the batch
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        # A position's first row is its narrow row, so the nearest one before a row is its own.
        doc = batch.column("doc").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        layer, frame = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("layer", "frame"))
        new = np.ones(n, dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (layer[1:] != layer[:-1]) | (frame[1:] != frame[:-1])
        here = tuple(batch.column(k)[0].as_py() for k in ("doc", "layer", "frame"))
        if link is not None and here == link[0]:
            new[0] = False
        source = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        take = pa.array(np.where(source < 0, n, source))
        before = (link[1], link[2]) if link is not None else (None, None)
        columns = {}
        for name, kind, last in (("link", pa.int32(), before[0]), ("duration", pa.int64(), before[1])):
            columns[name] = pa.concat_arrays([batch.column(name).cast(kind), pa.array([last], type=kind)]).take(take)
        last_key = tuple(batch.column(k)[n - 1].as_py() for k in ("doc", "layer", "frame"))
        link = (last_key, columns["link"][n - 1].as_py(), columns["duration"][n - 1].as_py())
        out = pa.RecordBatch.from_arrays(
            [columns.get(name, batch.column(name)) for name in batch.schema.names], names=batch.schema.names
        )
        yield out.filter(pa.array(~new))


def merge_runs(runs: DataFrame, chunks: int) -> DataFrame:
    """Joins runs across the chunks' bounds in a tree: each level merges ``FAN_IN`` neighbours.

    Only the outer two runs of a chunk go up a level, so a merge task holds 2 x FAN_IN summaries,
    and the number of levels is the logarithm of the number of chunks.
    """
    schema = runs.schema
    arrow = _arrow(runs.sparkSession)

    def merge(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_summary_batch(_join(_unflatten(table)), arrow)], schema=arrow)

    runs = materialize(runs, "runs")  # else closed and open runs would each encode the chunks again
    out, rest, width = runs.where("closed"), runs.where("NOT closed"), 1
    while width < chunks:
        width *= FAN_IN
        merged = rest.groupBy(F.floor(F.col("chunk") / width).alias("parent")).applyInArrow(merge, schema)
        if width >= chunks:
            rest = merged  # whatever is open now is a run
            break
        merged = materialize(merged, "merged")  # read twice
        out, rest = out.unionByName(merged.where("closed")), merged.where("NOT closed")
    out = out.unionByName(rest)
    return out.drop(*[f"{side}_{k}" for side in ("head", "tail") for k in EDGE])
