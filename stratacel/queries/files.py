"""Files, bytes, JSON and pixels as queries on the given tables, each with its SQL.

No files are given, so each query writes what it reads: the tables' values go through a format and
the SQL says what must come back.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacel.functions import binary as B
from stratacel.functions import pixels as P
from stratacel.operators import cels as K
from stratacel.operators import visibility as V
from stratacel.sources import psd, psd_writer
from stratacel.session import shared_dir, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


_CELS = "WITH c AS (SELECT * EXCLUDE (ingested_at) FROM (SELECT *, row_number() OVER (PARTITION BY cel_id ORDER BY ingested_at DESC) AS r FROM snapshot_cel) WHERE r = 1), s AS (SELECT * FROM c WHERE octet_length(pixels) = width * height * 4)"
_DOCS = "d AS (SELECT * FROM psd_document QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC) = 1), l AS (SELECT * FROM snapshot_layer QUALIFY row_number() OVER (PARTITION BY doc_id, source_layer_id ORDER BY ingested_at DESC, layer_key DESC) = 1)"


def _cels(spark: SparkSession, sf: str) -> DataFrame:
    return K.latest_delivery(table(spark, sf, "snapshot_cel"), ["cel_id"])


def _sound(spark: SparkSession, sf: str) -> DataFrame:
    return _cels(spark, sf).where(F.length("pixels") == F.col("width") * F.col("height") * 4)


def _documents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return K.latest_delivery(table(spark, sf, "psd_document"), ["doc_id"]), K.latest_delivery(table(spark, sf, "snapshot_layer"), ["doc_id", "source_layer_id"])


def _trees(spark: SparkSession, sf: str) -> DataFrame:
    """path and content: each document's canvas with its layers as empty records, groups as folders."""
    documents, layers = _documents(spark, sf)
    rows = documents.select("doc_id", "width", "height").join(layers.select("doc_id", "source_layer_id", "name", "kind", "opacity", "visible", "blend_mode"), "doc_id", "left")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = []
        for r in pdf.sort_values("source_layer_id").itertuples(index=False):
            if r.source_layer_id == r.source_layer_id:
                own = {"name": r.name or "", "id": int(r.source_layer_id), "opacity": 255 if r.opacity != r.opacity else int(r.opacity), "hidden": not r.visible, "blend": r.blend_mode, "marker": (3, 2, int(r.source_layer_id), 1, 1)}
                nodes.append(own | ({"children": []} if r.kind == "group" else {}))
        first = pdf.iloc[0]
        return pd.DataFrame([(first.doc_id, psd_writer.encode(int(first.width), int(first.height), nodes, wide=len(nodes) % 2 == 1))], columns=["path", "content"])

    return rows.groupBy("doc_id").applyInPandas(write, "path string, content binary")


@query("WITH " + _DOCS + " SELECT doc_id, width, height, 4::BIGINT AS channels, 8::BIGINT AS bits, 'rgb' AS color_mode, CASE WHEN (SELECT count(*) FROM l WHERE l.doc_id = d.doc_id) % 2 = 1 THEN 2 ELSE 1 END::BIGINT AS version FROM d")
def psd_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Headers of written documents of both versions (SRC-01, SRC-03, BIN-01)."""
    blocks = psd.blocks_of(_trees(spark, sf)).where("tag = 'header'")
    fields = F.from_json("fields", "width bigint, height bigint, channels bigint, bits_per_channel bigint, color_mode string, version bigint")
    return blocks.select(F.col("path").alias("doc_id"), fields.alias("f")).select("doc_id", "f.width", "f.height", "f.channels", F.col("f.bits_per_channel").alias("bits"), "f.color_mode", "f.version")


@query("WITH " + _DOCS + " SELECT doc_id, source_layer_id AS layer_id, coalesce(name, '') AS name, coalesce(opacity, 255)::BIGINT AS opacity, NOT coalesce(visible, false) AS hidden, CASE WHEN kind = 'group' THEN 1 END::BIGINT AS section FROM l")
def psd_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Layer records of written documents (SRC-02, SRC-04, VAL-11)."""
    blocks = psd.blocks_of(_trees(spark, sf)).where("tag = 'layer'")
    fields = F.from_json("fields", "layer_id bigint, name string, opacity bigint, hidden boolean, section bigint")
    return blocks.select(F.col("path").alias("doc_id"), fields.alias("f")).select("doc_id", "f.*").where("layer_id IS NOT NULL")


@query("WITH " + _DOCS + " SELECT doc_id, source_layer_id AS layer_id, 3::BIGINT AS version, 2::BIGINT AS role FROM l")
def psd_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Private markers of written documents (SRC-08, SNK-07)."""
    blocks = psd.blocks_of(_trees(spark, sf)).where("tag = 'marker'")
    fields = F.from_json("fields", "version bigint, role bigint, logical_layer_id bigint")
    return blocks.select(F.col("path").alias("doc_id"), fields.alias("f")).select("doc_id", F.col("f.logical_layer_id").alias("layer_id"), "f.version", "f.role")


@query("WITH " + _DOCS + " SELECT doc_id, 4::BIGINT AS sections, 26::BIGINT AS begins, true AS whole FROM d")
def psd_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of written documents follow each other without a gap (VAL-11, VAL-15)."""
    blocks = psd.blocks_of(_trees(spark, sf)).where("tag = 'section'")
    gaps = psd.gaps_in_sections(blocks).select("path").distinct().withColumn("gap", F.lit(True))
    out = blocks.groupBy("path").agg(F.count("*").alias("sections"), F.min("start").alias("begins"))
    return out.join(gaps, "path", "left").select(F.col("path").alias("doc_id"), "sections", "begins", F.col("gap").isNull().alias("whole"))


_FRAMES = _CELS + ", " + _DOCS + """, k AS (SELECT s.* FROM s JOIN l USING (doc_id, source_layer_id)),
f AS (SELECT doc_id, frame_index, string_agg(source_layer_id || ':' || width || ':' || height || ':' || x || ':' || y || ':' || opacity || ':' || sha256(pixels), '|' ORDER BY source_layer_id) AS key FROM k GROUP BY ALL),
g AS (SELECT doc_id, min(frame_index) AS frame_index FROM f GROUP BY doc_id, key)"""


@query(_FRAMES + """ SELECT k.doc_id, k.frame_index, (row_number() OVER (PARTITION BY k.doc_id, k.frame_index ORDER BY k.source_layer_id) - 1)::INT AS ordinal, coalesce(l.name, '') AS name, NOT coalesce(l.visible, false) AS hidden, k.x, k.y, k.opacity, k.width, k.height, sha256(k.pixels) AS digest
FROM k JOIN g USING (doc_id, frame_index) JOIN l ON l.doc_id = k.doc_id AND l.source_layer_id = k.source_layer_id""")
def psd_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Cels as frame-first documents give them back (SNK-04, SNK-05, VAL-04, VAL-05)."""
    documents, layers = _documents(spark, sf)
    out = psd_writer.decode_drawings(psd_writer.encode_documents(documents, layers, _cels(spark, sf), "frames"))
    return out.withColumn("frame_index", F.split("parent", " ")[1].cast("int")).drop("parent")


@query(_FRAMES + """ SELECT d.doc_id, (SELECT count(*) FROM f WHERE f.doc_id = d.doc_id)::INT AS frames, (SELECT count(*) FROM g WHERE g.doc_id = d.doc_id)::INT AS groups,
(2 * (SELECT count(*) FROM g WHERE g.doc_id = d.doc_id) + (SELECT count(*) FROM k JOIN g USING (doc_id, frame_index) WHERE k.doc_id = d.doc_id))::INT AS records, NULL::VARCHAR AS problem FROM d""")
def psd_files(spark: SparkSession, sf: str) -> DataFrame:
    """One frame-first document each: frames, different ones, and records (SNK-05, AGG-10)."""
    documents, layers = _documents(spark, sf)
    return psd_writer.encode_documents(documents, layers, _cels(spark, sf), "frames").select("doc_id", "frames", "groups", "records", "problem")


@query(_CELS + ", " + _DOCS + """, k AS (SELECT s.*, min(s.frame_index) OVER (PARTITION BY s.doc_id, s.source_layer_id, s.pixels, s.width, s.height, s.x, s.y, s.opacity) AS first_frame, l.name, l.visible FROM s JOIN l USING (doc_id, source_layer_id)),
u AS (SELECT DISTINCT doc_id, source_layer_id, first_frame, name, visible, x, y, opacity, width, height, sha256(pixels) AS digest FROM k),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source_layer_id ORDER BY first_frame) AS n, count(*) OVER (PARTITION BY doc_id, source_layer_id) AS states FROM u)
SELECT doc_id, CASE WHEN states > 1 THEN coalesce(name, '') END AS parent, CASE WHEN states > 1 THEN 'State ' || n ELSE coalesce(name, '') END AS name, CASE WHEN states > 1 THEN n > 1 ELSE NOT coalesce(visible, false) END AS hidden,
CASE WHEN states > 1 THEN n END::INT AS state, x, y, opacity, width, height, digest FROM v""")
def psd_states(spark: SparkSession, sf: str) -> DataFrame:
    """The states of layers as documents with local reuse give them back (SNK-06, SLV-09, STR-03)."""
    documents, layers = _documents(spark, sf)
    out = psd_writer.decode_drawings(psd_writer.encode_documents(documents, layers, _cels(spark, sf), "states"))
    state = F.when(F.col("parent").isNotNull(), psd_writer.state_number(F.col("name")))
    return out.select("doc_id", "parent", "name", "hidden", state.alias("state"), "x", "y", "opacity", "width", "height", "digest")


def _slices() -> bytes:
    uni = lambda t: struct.pack(">I", len(t)) + t.encode("utf-16-be")
    body = struct.pack(">I4i", 6, 0, 0, 60, 80) + uni("all") + struct.pack(">I", 3)
    for k, (left, top, right, bottom) in enumerate([(0, 0, 80, 60), (133, 70, 201, 138), (-5, -6, -5, 4)]):
        body += struct.pack(">III", k, 0, 0) + uni(f"s {k}") + struct.pack(">I4i", 1, left, top, right, bottom) + 4 * uni("") + b"\0" + uni("") + b"\0" * 12
    return body


@query("SELECT * FROM (VALUES (0, 's 0', 0, 0, 80, 60), (1, 's 1', 133, 70, 68, 68), (2, 's 2', -5, -6, 0, 10)) v(id, name, x, y, width, height)")
def psd_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Slices of a document made by hand (SRC-05, SRC-06, PRJ-03)."""
    body = _slices()
    resource = b"8BIM" + struct.pack(">H", psd.SLICES) + b"\0\0" + struct.pack(">I", len(body)) + body + b"\0" * (len(body) % 2)
    data = b"8BPS" + struct.pack(">H6xHIIHH", 1, 3, 180, 240, 8, 3) + struct.pack(">II", 0, len(resource)) + resource + struct.pack(">I", 0)
    blocks = psd.blocks_of(spark.createDataFrame([("by hand", data)], "path string, content binary")).where("tag = 'resource'")
    fields = F.from_json("fields", "slices array<struct<id int, name string, x int, y int, width int, height int>>")
    return blocks.select(F.explode(fields.slices).alias("s")).select("s.*")


def _animation() -> bytes:
    uni = lambda t: struct.pack(">I", len(t)) + t.encode("utf-16-be")
    key = lambda k: struct.pack(">I", 0) + k
    desc = lambda items: uni("") + key(b"null") + struct.pack(">I", len(items)) + b"".join(key(k) + v for k, v in items)
    frame = lambda number, delay: b"Objc" + desc([(b"FrID", b"long" + struct.pack(">i", number)), (b"FrDl", b"long" + struct.pack(">i", delay))])
    ands = struct.pack(">I", 16) + desc([(b"AFSt", b"long" + struct.pack(">i", 0)), (b"FrIn", b"VlLs" + struct.pack(">I", 3) + frame(5, 10) + frame(9, 25) + frame(2, 0))])
    inner = b"8BIMAnDs" + struct.pack(">I", len(ands)) + ands
    return b"maniIRFR" + struct.pack(">I", len(inner)) + inner


@query("SELECT * FROM (VALUES (0, 5, 10), (1, 9, 25), (2, 2, 0)) v(position, frame, delay)")
def psd_animation(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of an animation resource made by hand (SRC-06, SRC-07)."""
    body = _animation()
    resource = b"8BIM" + struct.pack(">H", 4003) + b"\0\0" + struct.pack(">I", len(body)) + body + b"\0" * (len(body) % 2)
    data = b"8BPS" + struct.pack(">H6xHIIHH", 1, 3, 4, 4, 8, 3) + struct.pack(">II", 0, len(resource)) + resource + struct.pack(">I", 0)
    blocks = psd.blocks_of(spark.createDataFrame([("by hand", data)], "path string, content binary")).where("tag = 'resource'")
    fields = F.from_json("fields", "subresources array<struct<key string, descriptor struct<FrIn array<struct<FrID int, FrDl int>>>>>")
    frames = blocks.select(F.explode(fields.subresources).alias("s")).select(F.posexplode("s.descriptor.FrIn").alias("position", "f"))
    return frames.select("position", F.col("f.FrID").alias("frame"), F.col("f.FrDl").alias("delay"))


def _png(width: int, height: int, data: bytes) -> bytes:
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    lines = b"".join(b"\0" + data[y * width * 4 : (y + 1) * width * 4] for y in range(height))
    return B.PNG_SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


@query(_CELS + " SELECT cel_id, width, height, sha256(pixels) AS digest FROM s WHERE width > 0 AND height > 0")
def png_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Drawings through image files and back (SRC-15)."""

    @F.pandas_udf("struct<width:int,height:int,pixels:binary>")
    def through(width: pd.Series, height: pd.Series, data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([B.decode_png(_png(w, h, d)) for w, h, d in zip(width, height, data)], columns=["width", "height", "pixels"])

    rows = _sound(spark, sf).where("width > 0 AND height > 0").select("cel_id", through("width", "height", "pixels").alias("i"))
    return rows.select("cel_id", "i.width", "i.height", F.sha2("i.pixels", 256).alias("digest"))


@query(_CELS + " SELECT cel_id, CASE cel_id % 4 WHEN 1 THEN 'cut short' WHEN 2 THEN '3 bytes after the end' WHEN 3 THEN octet_length(pixels) || ' bytes instead of ' || (octet_length(pixels) + 1) END AS problem FROM s")
def zlib_states(spark: SparkSession, sf: str) -> DataFrame:
    """Compressed drawings that are whole, cut short, followed by bytes or of another length (BIN-03)."""

    @F.pandas_udf("string")
    def problem(key: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for k, d in zip(key % 4, data):
            body = zlib.compress(d)
            out.append(B.zlib_problem(body[:-2] if k == 1 else body + b"odd" if k == 2 else body, len(d) + 1 if k == 3 else len(d)))
        return pd.Series(out, dtype=object)

    return _sound(spark, sf).select("cel_id", problem("cel_id", "pixels").alias("problem"))


@query(_CELS + " SELECT doc_id, source_layer_id, frame_index, cel_id, octet_length(pixels)::INT AS bytes, sha256(pixels) AS digest FROM c WHERE pixels IS NOT NULL")
def pixel_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots with hashes instead of bytes (BIN-02, DIF-04)."""
    return _cels(spark, sf).where("pixels IS NOT NULL").select("doc_id", "source_layer_id", "frame_index", "cel_id", F.length("pixels").alias("bytes"), F.sha2("pixels", 256).alias("digest"))


def _json_events(spark: SparkSession, sf: str) -> DataFrame:
    inner = F.struct(F.col("event_type").alias("path"), F.col("user_id").alias("c"), F.array(F.struct(F.col("event_id").alias("c"), F.lit("p").alias("path"))).alias("b"))
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct(inner.alias("z"), F.col("user_id").alias("a"), F.lit(1).alias("path"))).alias("body"))


@query("SELECT event_id, '{\"a\":' || user_id || ',\"z\":{\"b\":[{\"c\":' || event_id || '}],\"c\":' || user_id || '}}' AS body FROM events")
def json_normal(spark: SparkSession, sf: str) -> DataFrame:
    """JSON without some keys at any depth, names in order (JSN-02)."""
    return _json_events(spark, sf).select("event_id", B.normalised_json(F.col("body"), ["path"]).alias("body"))


@query("SELECT event_id, user_id || ',' || event_id AS found FROM events")
def json_values(spark: SparkSession, sf: str) -> DataFrame:
    """The values of a key at any depth (JSN-03)."""
    return _json_events(spark, sf).select("event_id", F.array_join(B.key_values(F.col("body"), "c"), ",").alias("found"))


@query("SELECT DISTINCT doc_id, width, height, loop_tag, channels, color_mode FROM psd_document")
def json_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as JSON and read again (SRC-14, PRJ-13)."""
    rows = table(spark, sf, "psd_document").select("doc_id", "width", "height", "loop_tag", "channels", "color_mode").distinct()
    path = os.path.join(shared_dir(spark), f"json-{uuid.uuid4().hex}")
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path)


@query(_CELS + """ SELECT cel_id, sha256(unhex(regexp_replace(hex(pixels), '(..)(..)', '\\1\\1\\1\\2', 'g'))) AS gray,
sha256(unhex(array_to_string(list_transform(range(0, octet_length(pixels)), lambda i: CASE WHEN ('0x' || substr(hex(pixels), 2 * i + 1, 2))::INT % 2 = 1 THEN '000000FF'
  ELSE substr(hex(pixels), 2 * i + 1, 2) || printf('%02X', 255 - ('0x' || substr(hex(pixels), 2 * i + 1, 2))::INT) || '07' || CASE WHEN substr(hex(pixels), 2 * i + 1, 2) = '00' THEN '00' ELSE 'C8' END END), ''))) AS indexed FROM s""")
def colour_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes taken as grey with alpha, and as palette indexes (PIX-08, JN-18, ARR-03, MAP-01)."""
    palette = {i: (i, 255 - i, 7, 200) for i in range(0, 256, 2)}

    @F.pandas_udf("struct<gray:binary,indexed:binary>")
    def widen(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(P.to_rgba(d, "gray"), P.to_rgba(d, "indexed", palette, 0)) for d in data], columns=["gray", "indexed"])

    rows = _sound(spark, sf).select("cel_id", widen("pixels").alias("p"))
    return rows.select("cel_id", F.sha2("p.gray", 256).alias("gray"), F.sha2("p.indexed", 256).alias("indexed"))


_PIXELS = _CELS + """, p AS (SELECT s.cel_id, s.x, s.y, s.width, s.height, i % s.width AS px, i // s.width AS py, ('0x' || substr(hex(s.pixels), 8 * i + 7, 2))::INT AS a, ('0x' || substr(hex(s.pixels), 8 * i + 1, 2))::INT AS r
  FROM s, unnest(range(0, s.width * s.height)) AS u(i))"""


@query(_PIXELS + """ SELECT cel_id, sum((a * CASE WHEN px BETWEEN 1 AND 3 AND py BETWEEN 2 AND 3 THEN 10 * ((py - 2) * 3 + px - 1) + 100 ELSE 40 END + 127) // 255)::BIGINT AS alpha, sum(r)::BIGINT AS red FROM p GROUP BY cel_id""")
def masked_alpha(spark: SparkSession, sf: str) -> DataFrame:
    """Drawings under a mask in document coordinates (PIX-01)."""
    mask = (100 + 10 * np.arange(6, dtype=np.uint8)).reshape(2, 3)

    @F.pandas_udf("struct<alpha:bigint,red:bigint>")
    def apply(data: pd.Series, w: pd.Series, h: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = [P.apply_mask(P.image(d, a, b), left, top, mask, left + 1, top + 2, 40) for d, a, b, left, top in zip(data, w, h, x, y)]
        return pd.DataFrame([(int(o[..., 3].sum()), int(o[..., 0].sum())) for o in out], columns=["alpha", "red"])

    return _sound(spark, sf).where("width * height > 0").select("cel_id", apply("pixels", "width", "height", "x", "y").alias("m")).select("cel_id", "m.*")


@query(_PIXELS + """ SELECT cel_id, (coalesce(sum(a * opacity // 255) FILTER (WHERE x % 20 + px BETWEEN 0 AND 15 AND y % 20 + py BETWEEN 0 AND 11), 0))::BIGINT AS alpha FROM p JOIN (SELECT cel_id, opacity FROM s) o USING (cel_id) GROUP BY cel_id""")
def blitted_alpha(spark: SparkSession, sf: str) -> DataFrame:
    """Drawings put on a canvas, clipped, their alpha times opacity (PIX-03)."""

    @F.pandas_udf("bigint")
    def put(data: pd.Series, w: pd.Series, h: pd.Series, x: pd.Series, y: pd.Series, opacity: pd.Series) -> pd.Series:
        canvas = np.zeros((12, 16, 4), dtype=np.uint8)
        return pd.Series([int(P.blit(canvas, P.image(d, a, b), left, top, o)[..., 3].sum()) for d, a, b, left, top, o in zip(data, w, h, x, y, opacity)])

    return _sound(spark, sf).where("width * height > 0").select("cel_id", put("pixels", "width", "height", F.col("x") % 20, F.col("y") % 20, "opacity").alias("alpha"))


@query(_CELS + """, k AS (SELECT cel_id, width, height, hex(pixels) AS one, hex(pixels)[1:6] || '00' || hex(pixels)[9:] AS two FROM s WHERE width * height > 0)
SELECT cel_id, (one <> two)::BIGINT AS visible, (one <> two)::BIGINT AS alpha, 0::BIGINT AS clear FROM k""")
def render_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Drawings and the same with one pixel cleared (DIF-01, AGG-15)."""
    rows = _sound(spark, sf).where("width * height > 0").select(F.col("cel_id").cast("string").alias("doc_id"), F.lit(0).alias("frame_index"), "width", "height", "pixels")
    head, tail = F.substring("pixels", 1, 3), F.expr("substring(pixels, 5)")
    other = rows.withColumn("pixels", F.concat(head, F.lit(b"\0"), tail))
    return V.render_diff(rows, other).select(F.col("doc_id").cast("bigint").alias("cel_id"), "visible", "alpha", "clear")


@query()
def resolved_cels(spark: SparkSession, sf: str) -> DataFrame:
    """Drawings without specks and with the buffer of their representative (PIX-04, PIX-06, PIX-07)."""
    out = K.resolved_pixels(_sound(spark, sf), "balanced")
    return out.select("cel_id", "representative", F.sha2("pixels", 256).alias("digest"))

