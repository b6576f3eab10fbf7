"""Deeply nested JSON records as flat tables that keep the links between parent and child."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratacel.session import shared_dir, spread

#: Rows of one emitted Arrow batch.
EMIT_ROWS = 20_000


def _refuse(constant: str):
    raise ValueError(f"{constant} isn't JSON")


def _skip_blank(text: str, at: int) -> int:
    while at < len(text) and text[at] in " \t\n\r":
        at += 1
    return at


def parse_deep(text: str):
    """JSON without recursion, for bodies nested deeper than the C parser's stack allows."""
    scan = json.JSONDecoder(parse_constant=_refuse)
    stack: list = []
    at = _skip_blank(text, 0)
    while True:
        char = text[at : at + 1]
        if char == "{" or char == "[":
            holder = {} if char == "{" else []
            at = _skip_blank(text, at + 1)
            stack.append([holder, None])
            if text[at : at + 1] == ("}" if char == "{" else "]"):
                value, at = stack.pop()[0], at + 1
            else:
                at = _key(scan, text, at, stack)
                continue
        else:
            value, at = scan.raw_decode(text, at)
        while True:  # hand the finished value to what encloses it
            at = _skip_blank(text, at)
            if not stack:
                if at != len(text):
                    raise ValueError("text after the end")
                return value
            holder, key = stack[-1]
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            char = text[at : at + 1]
            if char == ",":
                at = _key(scan, text, _skip_blank(text, at + 1), stack)
                break
            if char != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError("comma or end expected")
            value, at = stack.pop()[0], at + 1


def _key(scan: json.JSONDecoder, text: str, at: int, stack: list) -> int:
    """Read the name before a member of an object; returns where its value begins."""
    if isinstance(stack[-1][0], list):
        return at
    if text[at : at + 1] != '"':
        raise ValueError("name expected")
    name, at = scan.raw_decode(text, at)
    at = _skip_blank(text, at)
    if text[at : at + 1] != ":":
        raise ValueError("colon expected")
    stack[-1][1] = name
    return _skip_blank(text, at + 1)


def parse_whole(text: str | None):
    """The value of a body that parses as a whole, or ``ValueError``."""
    if text is None:
        raise ValueError("no body")
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return parse_deep(text)


def visit(root, array_fields: frozenset[str]) -> Iterator[tuple[str, str, str, int, dict]]:
    """Depth-first: (tag, node_path, parent_path, ordinal, object) of each object in an array.

    The tag is the name of the field that holds the array. The stack is explicit, so depth is
    bounded by memory only.
    """
    stack = [(root, "", "", "", None)]  # value, path, nearest enclosing node, field, ordinal in its array
    while stack:
        value, path, parent, tag, ordinal = stack.pop()
        if isinstance(value, dict):
            if ordinal is not None:
                yield tag, path, parent, ordinal, value
                parent = path
            for name in reversed(value):
                child = value[name]
                if name in array_fields:
                    child = _as_array(child)
                if isinstance(child, (dict, list)):
                    stack.append((child, f"{path}/{name}" if path else name, parent, name, None))
        elif isinstance(value, list):
            for i in range(len(value) - 1, -1, -1):
                if isinstance(value[i], (dict, list)):
                    stack.append((value[i], f"{path}/{i}" if path else str(i), parent, tag, i))


def _as_array(value):
    """A string that holds JSON stands for what it holds, a lone object for an array of one."""
    while isinstance(value, str):
        try:
            value = parse_whole(value)
        except ValueError:
            return None
    return [value] if isinstance(value, dict) else value


def _payload(value: dict, array_fields: frozenset[str]) -> str:
    """The object without the arrays that become rows of their own."""
    kept = {}
    for name, child in value.items():
        if name in array_fields:
            continue
        if isinstance(child, list) and any(isinstance(x, (dict, list)) for x in child):
            continue
        kept[name] = child
    try:
        return json.dumps(kept, ensure_ascii=False)
    except RecursionError:
        return json.dumps({k: v for k, v in kept.items() if not isinstance(v, (dict, list))}, ensure_ascii=False)


#: The tables of what isn't an element of a named array: the bodies themselves, and elements of other arrays.
BODIES, OTHER = "_bodies", "_other"


def emit_nodes(raw: DataFrame, key: str, order_by: str, body: str, array_fields: Sequence[str]) -> DataFrame:
    """Every body that parses as a whole in one depth-first pass: a row for it and one per nested object.

    Columns: ``delivery`` (the row of ``raw``), the key, ``at`` and ``digest`` (of bodies only),
    ``tag`` (name of the array's field), ``node_path``, ``parent_path``, ``ordinal``, ``payload``,
    and ``table``: the tag where it is one of ``array_fields``, else ``BODIES`` or ``OTHER``, so that
    the number of tables is that of the named fields whatever the bodies hold.
    """
    names = frozenset(array_fields)
    rows = spread(raw.select(F.col(key).alias("key"), F.col(order_by).alias("at"), F.col(body).alias("body"))).select(
        F.monotonically_increasing_id().alias("delivery"), "key", "at", F.sha2("body", 256).alias("digest"), "body"
    )
    schema = rows.drop("body").schema
    for name, kind in (("tag", "string"), ("node_path", "string"), ("parent_path", "string"), ("ordinal", "integer"), ("payload", "string"), ("table", "string")):
        schema = schema.add(name, kind)
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, out = [], []
            for i, text in enumerate(batch.column("body")):
                try:
                    root = parse_whole(text.as_py())
                except ValueError:
                    continue
                owner.append(i)
                out.append((None, "", None, None, None, BODIES))
                for tag, path, parent, ordinal, value in visit(root, names):
                    owner.append(i)
                    out.append((tag, path, parent, ordinal, _payload(value, names), tag if tag in names else OTHER))
                if len(out) >= EMIT_ROWS:
                    yield _batch(batch, owner, out)
                    owner, out = [], []
            if out:
                yield _batch(batch, owner, out)

    def _batch(batch: pa.RecordBatch, owner: list[int], out: list[tuple]) -> pa.RecordBatch:
        of = pa.array(owner, type=pa.int64())
        columns = [pa.array(c, type=k) for c, k in zip(zip(*out), kinds)]
        head = [batch.column(c).take(of) for c in ("delivery", "key", "at", "digest")]
        bodies = pa.compute.equal(columns[-1], BODIES)
        head[2:] = [pa.compute.if_else(bodies, c, pa.scalar(None, type=c.type)) for c in head[2:]]
        return pa.RecordBatch.from_arrays([*head, *columns], names=schema.fieldNames())

    return rows.mapInArrow(emit, schema)


def write_tables(nodes: DataFrame, path: str) -> None:
    """Write the tagged rows, one folder per table; an existing path is an error."""
    nodes.write.partitionBy("table").option("compression", "zstd").mode("errorifexists").parquet(path)


class Tables:
    """The flat tables that ``write_tables`` wrote, of which the last whole body of each key counts.

    A table reads its own folder only. Which deliveries count is a partial aggregation over the
    bodies' rows, one row per key and map task before the shuffle; ties in ``at`` fall to the
    greatest digest, a null ``at`` is the earliest.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str):
        self.key = key
        self._rows = spark.read.schema(schema).parquet(path)

    def deliveries(self) -> DataFrame:
        latest = self._rows.where(F.col("table") == BODIES).groupBy("key").agg(F.max(F.struct("at", "digest", "delivery")).alias("row"))
        return latest.select("row.delivery")

    def nodes(self, tag: str | None = None) -> DataFrame:
        """The nested objects, of all tables or of one: key, tag, node_path, parent_path, ordinal, payload."""
        rows = self._rows.where(F.col("table") != BODIES if tag is None else F.col("table") == tag)
        kept = rows.join(self.deliveries(), "delivery", "left_semi")
        return kept.select(F.col("key").alias(self.key), "tag", "node_path", "parent_path", "ordinal", "payload")

    def read(self, tag: str, schema: T.StructType | str) -> DataFrame:
        """One table with a schema applied to its payloads; see ``apply_schema``."""
        return apply_schema(self.nodes(tag), schema)


def nested_tables(raw: DataFrame, key: str, order_by: str, body: str, array_fields: Sequence[str], path: str | None = None) -> Tables:
    """Nested records as flat tables, written partitioned by table, in one pass over each body.

    The tables hold one row per object that is an element of an array, at any depth: the key,
    ``tag`` (name of the array's field), ``node_path``, ``parent_path`` (nearest enclosing such
    object, or the empty string), ``ordinal`` (zero-based position) and ``payload`` (the object's
    other fields as JSON). ``path`` is where they are written; by default a new place in the shared
    folder.

    ``array_fields`` always hold arrays: a lone object stands for an array of one, a string of JSON
    for what it holds. Null elements give no row but keep their position; null bodies and bodies
    that don't parse as a whole (a bare NaN or text after the end included) don't count; of a name
    that an object repeats the last value counts; a null key is a key like any other; a body
    delivered twice counts once; an empty table gives empty tables; further columns are never read.
    """
    spark = raw.sparkSession
    nodes = emit_nodes(raw, key, order_by, body, array_fields)
    path = path or os.path.join(shared_dir(spark), f"nested-{uuid.uuid4().hex}")
    write_tables(nodes, path)
    return Tables(spark, path, nodes.schema, key)


def apply_schema(nodes: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Payload fields as columns; a field that is absent or of another type is null."""
    return nodes.withColumn("payload", F.from_json("payload", schema)).select(
        *[c for c in nodes.columns if c not in ("payload", "tag")], "payload.*"
    )
