"""The document operators on the layered-document tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacel.functions import columns as C
from stratacel.functions.names import COPY_SUFFIXES, known_blend_mode, parsed_name
from stratacel.operators import cels as K
from stratacel.operators import sequence as S
from stratacel.operators import visibility as V
from stratacel.plans import tracks as P
from stratacel.sources import sprite as W
from stratacel.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


_CELS = "WITH c AS (SELECT * EXCLUDE (ingested_at) FROM (SELECT *, row_number() OVER (PARTITION BY cel_id ORDER BY ingested_at DESC) AS r FROM snapshot_cel) WHERE r = 1)"


def _cels(spark: SparkSession, sf: str) -> DataFrame:
    return K.latest_delivery(table(spark, sf, "snapshot_cel"), ["cel_id"])


@query("SELECT doc_id, frame_index, arg_max(source_id, ingested_at) AS source_id, max_by(coalesce(duration_ms, 100), ingested_at) // 10 * 10 AS duration FROM psd_frame GROUP BY ALL")
def frame_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """The latest delivery of each frame, its duration in steps with the default for none (PRJ-11, SNK-03, DAT-01)."""
    frames = K.latest_delivery(table(spark, sf, "psd_frame"), ["doc_id", "frame_index"])
    return frames.select("doc_id", "frame_index", "source_id", C.canonical_duration(F.coalesce("duration_ms", F.lit(100))).alias("duration"))


@query("SELECT doc_id, frame_index, source_id, CASE WHEN min(frame_index) OVER (PARTITION BY doc_id, source_id) <> frame_index THEN min(frame_index) OVER (PARTITION BY doc_id, source_id) END AS played_before FROM (SELECT doc_id, frame_index, arg_max(source_id, ingested_at) AS source_id FROM psd_frame GROUP BY ALL)")
def frame_recurrence(spark: SparkSession, sf: str) -> DataFrame:
    """Positions that play a frame again (WIN-05 on the timeline)."""
    frames = K.latest_delivery(table(spark, sf, "psd_frame"), ["doc_id", "frame_index"])
    return S.first_equal(frames, ["doc_id"], ["source_id"], "frame_index", "played_before").select("doc_id", "frame_index", "source_id", "played_before")


@query("SELECT DISTINCT doc_id, loop_count, CASE WHEN loop_count = 0 THEN 'infinite' ELSE 'finite' END AS mode, NULLIF(loop_count, 0) AS times FROM psd_document WHERE loop_count IS NOT NULL")
def loop_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Loop counts as modes (PRJ-08)."""
    docs = table(spark, sf, "psd_document").where("loop_count IS NOT NULL").select("doc_id", "loop_count").distinct()
    mode = C.loop_mode(F.col("loop_count"))
    return docs.select("doc_id", "loop_count", mode.tag.alias("mode"), mode.value.alias("times"))


@query(_CELS + """, t AS (SELECT doc_id, source_layer_id, source_frame, arg_min(sha256(coalesce(pixels, ''::BLOB)) || width || 'x' || height, (frame_index, cel_id)) AS target FROM c GROUP BY ALL)
SELECT c.cel_id, CASE WHEN c.source_frame <> c.linked_source_frame AND t.target IS NOT NULL THEN t.target ELSE sha256(coalesce(c.pixels, ''::BLOB)) || c.width || 'x' || c.height END AS shown
FROM c LEFT JOIN t ON t.doc_id = c.doc_id AND t.source_layer_id = c.source_layer_id AND t.source_frame = c.linked_source_frame""")
def cel_dereference(spark: SparkSession, sf: str) -> DataFrame:
    """Linked cels with their target's drawing (SRC-12)."""
    shown = F.concat(F.sha2(F.coalesce("pixels", F.lit(b"")), 256), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    return K.dereference(_cels(spark, sf)).select("cel_id", shown.alias("shown"))


_STATES = """, k AS (SELECT doc_id, source_layer_id, cel_id, frame_index, linked_source_frame, sha256(pixels) AS h, width, height, x, y, opacity FROM c WHERE pixels IS NOT NULL),
f AS (SELECT *, min(frame_index) OVER (PARTITION BY doc_id, source_layer_id, h, width, height, x, y, opacity{link}) AS first_frame FROM k)
SELECT cel_id, first_frame, (dense_rank() OVER (PARTITION BY doc_id, source_layer_id ORDER BY first_frame) - 1)::BIGINT AS state FROM f"""


@query(_CELS + _STATES.format(link=""))
def cel_states(spark: SparkSession, sf: str) -> DataFrame:
    """States of a layer by equal content (SLV-08 aggressive, WIN-09)."""
    return K.reuse_states(_cels(spark, sf).where("pixels IS NOT NULL"), linked=False).select("cel_id", "first_frame", "state")


@query(_CELS + _STATES.format(link=", linked_source_frame"))
def cel_states_linked(spark: SparkSession, sf: str) -> DataFrame:
    """States by equal content and link (SLV-08 linked)."""
    return K.reuse_states(_cels(spark, sf).where("pixels IS NOT NULL"), linked=True).select("cel_id", "first_frame", "state")


@query(_CELS + """, k AS (SELECT doc_id, source_layer_id, count(*) AS cels, count(DISTINCT (sha256(pixels), width, height, x, y, opacity)) AS states FROM c WHERE pixels IS NOT NULL GROUP BY ALL)
SELECT doc_id, sum(cels)::BIGINT AS cels, sum(states)::BIGINT AS states, sum(cels - states)::BIGINT AS reused FROM k GROUP BY doc_id""")
def reuse_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Cels that repeat a state (AGG-09, AGG-11)."""
    return K.reuse_counts(K.reuse_states(_cels(spark, sf).where("pixels IS NOT NULL"), linked=False))


@query(_CELS + """, f AS (SELECT doc_id, frame_index, string_agg(source_layer_id || ':' || width || ':' || height || ':' || x || ':' || y || ':' || opacity || ':' || sha256(pixels), '|' ORDER BY source_layer_id, cel_id) AS k FROM c WHERE pixels IS NOT NULL GROUP BY ALL)
SELECT doc_id, frame_index, min(frame_index) OVER (PARTITION BY doc_id, k) AS shown_first_at FROM f""")
def frame_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Playback positions that show the same (SNK-05, PIX-09)."""
    return K.frame_duplicates(_cels(spark, sf).where("pixels IS NOT NULL"))


@query("SELECT doc_id, sum(CASE WHEN kind = 'group' THEN 2 ELSE 1 END)::BIGINT AS records FROM (SELECT DISTINCT layer_key, doc_id, kind FROM snapshot_layer) GROUP BY doc_id")
def physical_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records that layers need (AGG-10)."""
    return K.physical_records(table(spark, sf, "snapshot_layer").select("layer_key", "doc_id", "kind").distinct())


@query("SELECT DISTINCT l.doc_id, l.source_layer_id FROM snapshot_layer l WHERE kind <> 'group' AND NOT EXISTS (SELECT 1 FROM snapshot_cel c WHERE c.doc_id = l.doc_id AND c.source_layer_id = l.source_layer_id)")
def omitted_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Drawing layers without a cel (JN-16)."""
    return K.omitted_layers(table(spark, sf, "snapshot_layer"), table(spark, sf, "snapshot_cel"))


@query("""
WITH l AS (SELECT DISTINCT doc_id, source_layer_id FROM snapshot_layer), f AS (SELECT DISTINCT doc_id, frame_index FROM psd_frame), k AS (SELECT DISTINCT doc_id, source_layer_id, frame_index, cel_id FROM snapshot_cel)
SELECT l.doc_id, l.source_layer_id, count(*)::BIGINT AS positions, count(k.cel_id)::BIGINT AS cels FROM l JOIN f ON f.doc_id = l.doc_id
LEFT JOIN k ON k.doc_id = l.doc_id AND k.source_layer_id = l.source_layer_id AND k.frame_index = f.frame_index GROUP BY ALL""")
def snapshot_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Layers at every position, with or without a cel (SRC-11)."""
    layers = table(spark, sf, "snapshot_layer").groupBy("doc_id", "source_layer_id").agg(F.first("kind").alias("kind"), F.first("opacity").alias("opacity"), F.first("blend_mode").alias("blend_mode"), F.first("visible").alias("visible"))
    frames = table(spark, sf, "psd_frame").select("doc_id", "frame_index").distinct()
    cels = table(spark, sf, "snapshot_cel").select("doc_id", "source_layer_id", "frame_index", "cel_id", "source_frame", "x", "y", "opacity").distinct()
    return K.snapshot(layers, frames, cels).groupBy("doc_id", "source_layer_id").agg(F.count("*").alias("positions"), F.count("cel_id").alias("cels"))


@query(r"SELECT DISTINCT layer_key, trim(regexp_replace(lower(name), '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}]+', ' ', 'g')) AS name FROM snapshot_layer")
def layer_names(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised names (STR-01)."""
    return table(spark, sf, "snapshot_layer").select("layer_key", C.normalized_name(F.col("name")).alias("name")).distinct()


_SUFFIXES = ", ".join(f"({i}, '{t}')" for i, (t, _, _) in enumerate(COPY_SUFFIXES))
_BLANKS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}\x{001c}-\x{001f}\x{000b}]+"
_ENDING = r"\s*(?:[-_.]*#?\s*([0-9]+)\s*)?(?:[)\]}]\s*)*$"


@query(rf"""WITH RECURSIVE t(i, token) AS (VALUES {_SUFFIXES}), n AS (SELECT DISTINCT doc_id, layer_key, name FROM snapshot_layer WHERE name IS NOT NULL),
x AS (SELECT DISTINCT trim(regexp_replace(lower(name), '{_BLANKS}', ' ', 'g')) AS name FROM n),
s AS (SELECT name, name AS base, 0 AS depth FROM x
  UNION ALL SELECT name, base, depth FROM (SELECT s.name, rtrim(rtrim(regexp_extract(s.base, '(?s)^(.*[\s\-_.(\[{{])' || t.token || '{_ENDING}', 1), '-_.([{{')) AS base, s.depth + 1 AS depth, t.i
    FROM s JOIN t ON regexp_matches(s.base, '(?s)^(.*[\s\-_.(\[{{])' || t.token || '{_ENDING}') WHERE s.depth < 8) WHERE base <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY i) = 1),
b AS (SELECT name, arg_max(base, depth) AS base, max(depth) AS depth FROM s GROUP BY name)
SELECT n.doc_id, b.base AS family, count(DISTINCT b.name) AS variants, count(*) AS layers, max(depth)::INT AS suffixes FROM n JOIN b ON b.name = trim(regexp_replace(lower(n.name), '{_BLANKS}', ' ', 'g')) GROUP BY ALL HAVING max(depth) > 0""")
def layer_families(spark: SparkSession, sf: str) -> DataFrame:
    """Names without their copy suffixes, per family (STR-02, AGG-12)."""
    parsed = table(spark, sf, "snapshot_layer").select("doc_id", "layer_key", "name").distinct().withColumn("p", parsed_name(F.col("name")))
    families = parsed.groupBy("doc_id", F.col("p.base").alias("family")).agg(
        F.count_distinct("p.normalized").alias("variants"), F.count("*").alias("layers"), F.max(F.size("p.tokens")).alias("suffixes")
    )
    return families.where("suffixes > 0")


@query(r"""
SELECT blend_mode, count(*)::BIGINT AS n, CASE WHEN c IN ('normal','passthrough','darken','multiply','colorburn','linearburn','darkercolor','lighten','screen','colordodge','lineardodge','lightercolor','overlay','softlight','hardlight','vividlight','linearlight','pinlight','hardmix','difference','exclusion','subtract','divide','hue','saturation','color','luminosity') THEN c END AS known
FROM (SELECT blend_mode, regexp_replace(lower(blend_mode), '[\s_-]', '', 'g') AS c FROM probe_b WHERE blend_mode IS NOT NULL) GROUP BY blend_mode, c""")
def blend_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Blend modes as written and as known (STR-06, FLT-19)."""
    probes = table(spark, sf, "probe_b").where("blend_mode IS NOT NULL").groupBy("blend_mode").agg(F.count("*").alias("n"))
    return probes.select("blend_mode", "n", F.replace(known_blend_mode(F.col("blend_mode")), F.lit(" "), F.lit("")).alias("known"))


@query("SELECT doc_id, layer_id, path, string_agg(lpad(p, 6, '0'), '/' ORDER BY i) AS sort_key FROM (SELECT DISTINCT doc_id, layer_id, path, unnest(string_split(path, '/')) AS p, generate_subscripts(string_split(path, '/'), 1) AS i FROM probe_a) GROUP BY ALL")
def path_order(spark: SparkSession, sf: str) -> DataFrame:
    """Index paths in numeric order (ORD-08, PRJ-07)."""
    probes = table(spark, sf, "probe_a").select("doc_id", "layer_id", "path").distinct()
    key = F.array_join(F.transform(C.path_key(F.col("path")), lambda x: F.lpad(x.cast("string"), 6, "0")), "/")
    return probes.select("doc_id", "layer_id", "path", key.alias("sort_key"))


@query("SELECT doc_id, layer_id, (right_px - left_px)::BIGINT * (bottom_px - top_px) AS area FROM (SELECT DISTINCT doc_id, layer_id, left_px, top_px, right_px, bottom_px FROM probe_a)")
def layer_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Areas of boxes, with inverted ones an error (MTH-07, PRJ-02)."""
    boxes = table(spark, sf, "probe_a").select("doc_id", "layer_id", "left_px", "top_px", "right_px", "bottom_px").distinct()
    return boxes.select("doc_id", "layer_id", C.rectangle_area(F.col("left_px"), F.col("top_px"), F.col("right_px"), F.col("bottom_px")).alias("area"))


@query(_CELS + " SELECT cel_id, coalesce(octet_length(pixels) > 0 AND octet_length(pixels) % 4 = 0 AND NOT regexp_full_match(hex(pixels), '(......00)*'), false) AND coalesce(opacity > 0, true) AS writable FROM c")
def writable_cels(spark: SparkSession, sf: str) -> DataFrame:
    """Cels with something to see (FLT-10, PIX-02)."""
    return K.writable_cels(_cels(spark, sf)).select("cel_id", "writable")


@query(_CELS + """, p AS (SELECT cel_id, i % width AS px, i // width AS py, 1 + ('0x' || substr(hex(pixels), 8 * i + 1, 2))::INT % 24 AS a FROM c, unnest(range(0, width * height)) AS u(i) WHERE octet_length(pixels) = width * height * 4),
g AS (SELECT cel_id, px // 3 AS gx, py, count(*) FILTER (WHERE a <= 16) AS faint, count(*) FILTER (WHERE a > 16) AS strong FROM p WHERE px % 3 < 2 AND py % 2 = 0 GROUP BY ALL)
SELECT cel_id, count(*) FILTER (WHERE faint > 0) AS patches, count(*) FILTER (WHERE faint > 0 AND strong = 0) AS cleared FROM g GROUP BY cel_id HAVING patches > 0""")
def jitter_specks(spark: SparkSession, sf: str) -> DataFrame:
    """Faint specks and those cleared (PIX-04), on drawings thinned out to patches of two pixels."""

    @F.pandas_udf("binary")
    def thinned(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        out = []
        for d, w, h in zip(data, width, height):
            own = np.frombuffer(d, dtype=np.uint8).reshape(h, w, 4).copy()
            kept = (np.arange(w) % 3 < 2)[None, :] & (np.arange(h) % 2 == 0)[:, None]
            own[..., 3] = np.where(kept, 1 + own[..., 0] % 24, 0)
            out.append(own.tobytes())
        return pd.Series(out, dtype=object)

    sound = _cels(spark, sf).where(F.length("pixels") == F.col("width") * F.col("height") * 4)
    return K.jitter_repairs(sound.withColumn("pixels", thinned("pixels", "width", "height")), "balanced").select("cel_id", "patches", "cleared")


@query(_CELS + """, k AS (SELECT doc_id, source_layer_id, width, height, x, y, cel_id, hex(pixels) AS h FROM c WHERE octet_length(pixels) = width * height * 4),
q AS (SELECT a.cel_id AS representative, b.cel_id AS cel_id, a.h AS one, b.h AS two, a.width * a.height AS n FROM k a JOIN k b USING (doc_id, source_layer_id, width, height, x, y) WHERE a.cel_id < b.cel_id AND a.h <> b.h),
m AS (SELECT representative, cel_id, n, i // 4 AS pixel, max(abs(('0x' || substr(one, 2 * i + 1, 2))::INT - ('0x' || substr(two, 2 * i + 1, 2))::INT)) AS apart FROM q, unnest(range(0, 4 * n)) AS u(i) WHERE substr(one, 2 * i + 1, 2) <> substr(two, 2 * i + 1, 2) GROUP BY ALL)
SELECT cel_id, max(representative) AS representative FROM (SELECT representative, cel_id FROM m GROUP BY representative, cel_id, n HAVING max(apart) <= 12 AND count(*) * 100 <= n * 3) GROUP BY cel_id""")
def jitter_colours(spark: SparkSession, sf: str) -> DataFrame:
    """Cels that nearly equal an earlier one of their layer (PIX-05, PIX-06)."""
    return K.colour_representatives(_cels(spark, sf).where("pixels IS NOT NULL"), "balanced")


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    layers = K.latest_delivery(table(spark, sf, "snapshot_layer"), ["doc_id", "source_layer_id"])
    return P.observations(layers, _cels(spark, sf))


@query()
def track_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks of every document, their order and z-indices (SLV-01..06, ORD-01..07, JN-05..08)."""
    return P.plan_tracks(_observed(spark, sf))


@query(_CELS + """, l AS (SELECT * FROM snapshot_layer QUALIFY row_number() OVER (PARTITION BY doc_id, source_layer_id ORDER BY ingested_at DESC, layer_key DESC) = 1)
SELECT c.doc_id, c.frame_index AS frame, c.source_layer_id AS layer, 1::BIGINT AS planned FROM c JOIN l USING (doc_id, source_layer_id) WHERE l.kind <> 'group' AND l.visible AND c.pixels IS NOT NULL GROUP BY ALL""")
def track_conservation(spark: SparkSession, sf: str) -> DataFrame:
    """Every observation and how often it is in the plan: once (SET-03, SLV-06)."""
    return P.plan_tracks(_observed(spark, sf)).groupBy("doc_id", "frame", "layer").agg(F.count("*").alias("planned"))


def _encoded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    documents = K.latest_delivery(table(spark, sf, "psd_document"), ["doc_id"])
    frames = K.latest_delivery(table(spark, sf, "psd_frame"), ["doc_id", "frame_index"])
    layers = K.latest_delivery(table(spark, sf, "snapshot_layer"), ["doc_id", "source_layer_id"])
    cels = _cels(spark, sf)
    return documents, frames, cels, W.encode_documents(documents, frames, layers, cels)


_LATEST_LAYERS = """, l AS (SELECT * FROM snapshot_layer QUALIFY row_number() OVER (PARTITION BY doc_id, source_layer_id ORDER BY ingested_at DESC, layer_key DESC) = 1),
s AS (SELECT * FROM c WHERE octet_length(pixels) = width * height * 4 AND EXISTS (SELECT 1 FROM l WHERE l.doc_id = c.doc_id AND l.source_layer_id = c.source_layer_id))"""


@query(_CELS + _LATEST_LAYERS + """, k AS (SELECT doc_id, source_layer_id, pixels, width, height, count(*) AS n FROM s GROUP BY ALL)
SELECT doc_id, sum(n)::INT AS cels, sum(n - 1)::INT AS linked, (SELECT count(*) FROM l WHERE l.doc_id = k.doc_id)::INT AS layers, NULL::VARCHAR AS problem FROM k GROUP BY doc_id""")
def sprite_files(spark: SparkSession, sf: str) -> DataFrame:
    """One encoded file per document, equal cels linked (SNK-01, SNK-03, WIN-05)."""
    return _encoded(spark, sf)[3].select("doc_id", "layers", "cels", "linked", "problem")


@query("""WITH d AS (SELECT * FROM psd_document QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC) = 1),
f AS (SELECT doc_id, frame_index, arg_max(coalesce(duration_ms, -1), ingested_at) AS ms FROM psd_frame GROUP BY ALL),
t AS (SELECT doc_id, max(frame_index) + 1 AS n, sum(CASE WHEN ms < 0 THEN 100 ELSE ms END)::BIGINT AS ms, count(*) AS given FROM f GROUP BY doc_id)
SELECT doc_id, width::INT AS width, height::INT AS height, n::INT AS frames, (ms + 100 * (n - given))::BIGINT AS duration, loop_tag AS loop,
CASE WHEN loop_tag IS NOT NULL THEN 0 END::INT AS loop_first, CASE WHEN loop_tag IS NOT NULL THEN n - 1 END::INT AS loop_last, CASE WHEN loop_tag IS NOT NULL THEN coalesce(loop_count, 0) END::INT AS loop_repeat
FROM d JOIN t USING (doc_id)""")
def sprite_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Canvas, length, duration and loop as the written files give them back (SRC-09, SNK-01, SNK-03, PRJ-08)."""
    return W.decode_documents(_encoded(spark, sf)[3], "headers")


@query("""WITH RECURSIVE l AS (SELECT * FROM snapshot_layer QUALIFY row_number() OVER (PARTITION BY doc_id, source_layer_id ORDER BY ingested_at DESC, layer_key DESC) = 1),
t AS (SELECT doc_id, source_layer_id, 0 AS level, [(child_ordinal, source_layer_id)] AS way FROM l WHERE parent_layer_id IS NULL OR NOT EXISTS (SELECT 1 FROM l p WHERE p.doc_id = l.doc_id AND p.source_layer_id = l.parent_layer_id)
UNION ALL SELECT l.doc_id, l.source_layer_id, t.level + 1, list_append(t.way, (l.child_ordinal, l.source_layer_id)) FROM l JOIN t ON l.doc_id = t.doc_id AND l.parent_layer_id = t.source_layer_id)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY way) - 1)::INT AS place, coalesce(name, '') AS name, kind = 'group' AS grouped, level::INT AS level, coalesce(visible, false) AS visible, coalesce(opacity, 255)::INT AS opacity
FROM t JOIN l USING (doc_id, source_layer_id)""")
def sprite_layers(spark: SparkSession, sf: str) -> DataFrame:
    """The layer trees as the written files give them back (SRC-09, SNK-01, PRJ-07)."""
    return W.decode_documents(_encoded(spark, sf)[3], "layers").drop("blend")


@query(_CELS + _LATEST_LAYERS + """ SELECT doc_id, frame_index AS frame, x, y, opacity, width, height, sha256(pixels) AS digest,
row_number() OVER (PARTITION BY doc_id, source_layer_id, pixels, width, height ORDER BY frame_index) > 1 AS linked FROM s""")
def sprite_cels(spark: SparkSession, sf: str) -> DataFrame:
    """The cels as the written files give them back, links followed (SRC-10, SRC-12, WIN-05)."""
    return W.decode_documents(_encoded(spark, sf)[3], "cels").drop("layer", "z")


@query(_CELS + _LATEST_LAYERS + """ SELECT s.doc_id, s.frame_index AS frame, s.x, s.y, s.opacity, s.width, s.height, sha256(s.pixels) AS digest FROM s JOIN l USING (doc_id, source_layer_id) WHERE l.kind <> 'group' AND l.visible""")
def planned_cels(spark: SparkSession, sf: str) -> DataFrame:
    """The visible cels as files of planned tracks give them back (SNK-02, VAL-02)."""
    documents = K.latest_delivery(table(spark, sf, "psd_document"), ["doc_id"])
    frames = K.latest_delivery(table(spark, sf, "psd_frame"), ["doc_id", "frame_index"])
    files = W.encode_plans(documents, frames, P.plan_tracks(_observed(spark, sf)), _cels(spark, sf))
    return W.decode_documents(files, "cels").drop("layer", "z", "linked")


@query("SELECT count(DISTINCT doc_id)::BIGINT AS documents, 0::BIGINT AS differing FROM psd_document")
def sprite_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that were written, and those whose files don't give them back (VAL-01)."""
    documents, frames, cels, encoded = _encoded(spark, sf)
    apart = W.roundtrip_differences(documents, frames, cels, encoded).select("doc_id").distinct().agg(F.count("*").alias("differing"))
    return encoded.where("content IS NOT NULL").agg(F.count("*").alias("documents")).join(apart, F.lit(True))


@query(_CELS + """, x AS (SELECT doc_id, cel_id AS seq, 'missing_pixels' AS code, source_layer_id || '/' || frame_index AS place, NULL AS detail FROM c WHERE pixels IS NULL
UNION ALL SELECT doc_id, cel_id, 'malformed_pixels', source_layer_id || '/' || frame_index, octet_length(pixels) || ' bytes' FROM c WHERE octet_length(pixels) <> width * height * 4),
e AS (SELECT doc_id, code, min(seq) AS first_seen, count(*) AS n, arg_min(detail, seq) AS detail, list(place ORDER BY seq)[1:8] AS places FROM x GROUP BY ALL)
SELECT doc_id, '{"schema_version":3,"summary":{"total":' || count(*) || '},"entries":[' || string_agg('{"code":"' || code || '","disposition":"dropped","count":' || n || CASE WHEN detail IS NOT NULL THEN ',"detail":"' || detail || '"' ELSE '' END || ',"locations":["' || array_to_string(places, '","') || '"]}', ',' ORDER BY first_seen) || ']}' AS report FROM e GROUP BY doc_id""")
def loss_reports(spark: SparkSession, sf: str) -> DataFrame:
    """JSON reports of what a conversion would lose, per document (SNK-09, JSN-01, VAL-09)."""
    cels = _cels(spark, sf)
    place = F.concat_ws("/", F.col("source_layer_id").cast("string"), F.col("frame_index").cast("string"))
    missing = cels.where("pixels IS NULL").select("doc_id", F.col("cel_id").alias("seq"), F.lit("missing_pixels").alias("code"), F.lit("dropped").alias("disposition"), place.alias("location"), F.lit(None).cast("string").alias("detail"))
    short = cels.where("length(pixels) <> width * height * 4").select("doc_id", F.col("cel_id").alias("seq"), F.lit("malformed_pixels").alias("code"), F.lit("dropped").alias("disposition"), place.alias("location"), F.concat(F.length("pixels").cast("string"), F.lit(" bytes")).alias("detail"))
    return V.loss_report(missing.unionByName(short))
