"""Trees, states, scores and relations of layers as queries on the given tables, each with its SQL.

The tables hold no states of groups and no features, so these are made of ids by plain rules that
the SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacel.functions import columns as C
from stratacel.operators import cels as K
from stratacel.operators import compare as D
from stratacel.operators import groups as G
from stratacel.operators import hierarchy as H
from stratacel.operators import visibility as V
from stratacel.session import checkpoint, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
KEY = ["doc_id", "layer_id"]


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def _layers(spark: SparkSession, sf: str) -> DataFrame:
    rows = K.latest_delivery(table(spark, sf, "snapshot_layer"), ["doc_id", "source_layer_id"])
    return rows.select("doc_id", F.col("source_layer_id").alias("layer_id"), F.col("parent_layer_id").alias("parent_id"), F.col("child_ordinal").alias("ordinal"), "name", "kind", "opacity", "blend_mode", "visible", "copy_token")


def _flat(layers: DataFrame) -> DataFrame:
    return H.flatten(layers, "layer_id", "parent_id", "ordinal")


def _states(layers: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    frames = table(spark, sf, "psd_frame").select("doc_id", "frame_index").distinct()
    at = F.col("layer_id") + F.col("frame_index")
    silent = (F.col("kind") == "group") & (F.col("layer_id") % 2 == 0)
    return layers.select(*KEY, "kind").join(frames, "doc_id").select(*KEY, "frame_index", ((F.col("kind") == "group") | (at % 5 != 0)).alias("record_present"), (~silent & (at % 3 != 0)).alias("enabled"))


_L = """WITH RECURSIVE l AS (SELECT doc_id, source_layer_id AS layer_id, parent_layer_id AS parent_id, child_ordinal AS ordinal, name, kind, opacity, blend_mode, visible, copy_token FROM snapshot_layer
  QUALIFY row_number() OVER (PARTITION BY doc_id, source_layer_id ORDER BY ingested_at DESC, layer_key DESC) = 1)"""
_T = _L + """, t AS (SELECT doc_id, layer_id, 0 AS depth, ordinal::VARCHAR AS path, []::BIGINT[] AS above FROM l WHERE parent_id IS NULL
  UNION ALL SELECT l.doc_id, l.layer_id, t.depth + 1, t.path || '/' || l.ordinal, list_append(t.above, t.layer_id) FROM l JOIN t ON l.doc_id = t.doc_id AND l.parent_id = t.layer_id),
cl AS (SELECT doc_id, unnest(list_append(above, layer_id)) AS high, layer_id AS low FROM t)"""
_S = _T + """, st AS (SELECT doc_id, layer_id, frame_index, kind, kind = 'group' OR (layer_id + frame_index) % 5 <> 0 AS record_present, NOT (kind = 'group' AND layer_id % 2 = 0) AND (layer_id + frame_index) % 3 <> 0 AS enabled
  FROM l JOIN (SELECT DISTINCT doc_id, frame_index FROM psd_frame) USING (doc_id)),
own AS (SELECT doc_id, layer_id, bool_or(record_present) AS record, bool_or(enabled) AS ever FROM st GROUP BY ALL),
cand AS (SELECT l.doc_id, l.layer_id FROM l JOIN own USING (doc_id, layer_id) WHERE l.kind = 'group' AND record AND NOT ever
  AND doc_id IN (SELECT doc_id FROM st GROUP BY doc_id HAVING count(DISTINCT frame_index) >= 2)
  AND EXISTS (SELECT 1 FROM cl JOIN own o ON o.doc_id = cl.doc_id AND o.layer_id = cl.low WHERE cl.doc_id = l.doc_id AND cl.high = l.layer_id AND cl.low <> l.layer_id AND o.record)),
box AS (SELECT doc_id, layer_id FROM cand WHERE 2 <= (SELECT count(DISTINCT st.frame_index) FROM cl JOIN st ON st.doc_id = cl.doc_id AND st.layer_id = cl.low WHERE cl.doc_id = cand.doc_id AND cl.high = cand.layer_id AND st.kind <> 'group' AND st.enabled)),
var AS (SELECT DISTINCT doc_id, layer_id FROM (SELECT *, lag(enabled) OVER (PARTITION BY doc_id, layer_id ORDER BY frame_index) AS was FROM st) WHERE was IS DISTINCT FROM enabled AND was IS NOT NULL)"""


@query(_L + """ SELECT doc_id, layer_id, coalesce(name, '') AS name, CASE WHEN EXISTS (SELECT 1 FROM l k WHERE k.doc_id = l.doc_id AND k.parent_id = l.layer_id) THEN 'group' ELSE 'pixel' END AS kind, coalesce(blend_mode, 'normal') AS blend_mode FROM l""")
def layer_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Raw layers as normal ones: name, kind by children, enumerations as words (PRJ-01, STR-04, JN-01)."""
    layers = _layers(spark, sf)
    enum = F.replace(F.initcap(F.coalesce("blend_mode", F.lit("normal"))), F.lit(" "), F.lit(""))  # as an enumeration spells it
    holds = layers.where("parent_id IS NOT NULL").select("doc_id", F.col("parent_id").alias("layer_id"), F.lit(True).alias("holds")).distinct()
    kind = F.when(F.col("holds"), "group").otherwise("pixel")
    return layers.join(holds, KEY, "left").select(*KEY, F.coalesce("name", F.lit("")).alias("name"), kind.alias("kind"), C.camel_words(enum).alias("blend_mode"))


@query("SELECT cel_id, (x + CASE WHEN frame_index % 7 <> 0 THEN frame_index % 7 ELSE 0 END)::BIGINT AS left_px, (y - 3)::BIGINT AS top_px FROM (SELECT DISTINCT cel_id, x, y, frame_index FROM snapshot_cel)")
def cel_origins(spark: SparkSession, sf: str) -> DataFrame:
    """Origins of cels from place and offset, within 16 bits (PRJ-04)."""
    cels = table(spark, sf, "snapshot_cel").select("cel_id", "x", "y", "frame_index").distinct()
    offset = F.when(F.col("frame_index") % 7 != 0, F.col("frame_index") % 7)
    return cels.select("cel_id", C.cel_origin(F.col("x"), offset, "left").alias("left_px"), C.cel_origin(F.col("y"), F.lit(-3), "top").alias("top_px"))


@query("""SELECT doc_id, layer_id, path, CASE WHEN layer_id % 2 = 0 AND layer_id > 0 THEN layer_id ELSE
  list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(path) + 1), lambda i: ord(substr(path, i, 1))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) | 2147483648 END AS id
FROM (SELECT DISTINCT doc_id, layer_id, path FROM probe_a)""")
def fallback_layer_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids made of paths where none is stated (MTH-06)."""
    probes = table(spark, sf, "probe_a").select("doc_id", "layer_id", "path").distinct()
    stated = F.when(F.col("layer_id") % 2 == 0, F.col("layer_id").cast("double"))
    return probes.select("doc_id", "layer_id", "path", C.fallback_layer_id(stated, F.col("path")).alias("id"))


@query(_T + """, p AS (SELECT t.*, l.name, l.copy_token, lag(t.above) OVER w AS above2, lag(l.name) OVER w AS name2, row_number() OVER w AS r FROM t JOIN l USING (doc_id, layer_id) WINDOW w AS (PARTITION BY doc_id ORDER BY layer_id)),
n AS (SELECT *, trim(regexp_replace(lower(name), '[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{0085}]+', ' ', 'g')) AS a, trim(regexp_replace(lower(name2), '[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{0085}]+', ' ', 'g')) AS b FROM p WHERE r > 1),
s AS (SELECT *, regexp_matches(a, '^(图层|layer) [0-9]+$') AS ga, regexp_matches(b, '^(图层|layer) [0-9]+$') AS gb FROM n),
k AS (SELECT *, CASE WHEN NOT ga AND NOT gb AND a = b THEN 20 WHEN NOT ga AND NOT gb AND left(a, 3) = left(b, 3) THEN 5 ELSE 0 END AS name_score,
  CASE WHEN above = above2 THEN 20 WHEN len(above) > 0 AND len(above2) > 0 AND above[1] = above2[1] THEN 12 ELSE 0 END AS group_score, greatest(0, 20 - 4 * least(abs(depth - r % 4), 5)) AS order_score FROM s)
SELECT doc_id, layer_id, name_score::INT AS name_score, group_score::INT AS group_score, order_score::INT AS order_score, CASE WHEN ga THEN 0 WHEN copy_token IS NOT NULL THEN 15 ELSE 30 END AS evidence,
  least(100, (name_score + group_score + order_score + 13 + 10) * 100 // CASE WHEN NOT ga AND NOT gb THEN 90 ELSE 70 END)::BIGINT AS score FROM k""")
def layer_likeness(spark: SparkSession, sf: str) -> DataFrame:
    """Likeness of each layer and the one before it (MTH-03, MTH-04, MTH-05)."""
    layers = _layers(spark, sf)
    w = Window.partitionBy("doc_id").orderBy("layer_id")
    name = C.normalized_name(F.col("name"))
    rows = _flat(layers).join(layers.select(*KEY, name.alias("a"), "copy_token"), KEY)
    rows = rows.select("*", F.lag("ancestors").over(w).alias("above2"), F.lag("a").over(w).alias("b"), F.row_number().over(w).alias("r")).where("r > 1")
    a, b = F.col("a"), F.col("b")
    scores = {
        "name_score": C.name_score(a, b, F.left(a, F.lit(3)), F.left(b, F.lit(3))),
        "group_score": C.group_score(F.col("ancestors"), F.col("above2")),
        "order_score": C.order_score(F.col("depth"), F.col("r") % 4),
        "evidence": C.name_evidence_weight(C.is_generic_name(a), F.when(F.col("copy_token").isNotNull(), 1).otherwise(0)),
    }
    out = rows.withColumns(scores)
    both = ~C.is_generic_name(a) & ~C.is_generic_name(b)
    score = C.combined_score(F.col("name_score"), F.col("group_score"), F.col("order_score"), F.lit(13), F.lit(10), both)
    return out.select(*KEY, *scores, score.alias("score"))


@query("""WITH a AS (SELECT doc_id, layer_id, opacity FROM probe_a QUALIFY row_number() OVER (PARTITION BY doc_id, layer_id ORDER BY exported_at DESC, opacity DESC) = 1), b AS (SELECT doc_id, layer_id, opacity FROM probe_b QUALIFY row_number() OVER (PARTITION BY doc_id, layer_id ORDER BY exported_at DESC, opacity DESC) = 1)
SELECT doc_id, layer_id, coalesce(abs(a.opacity - b.opacity) > 1e-9, (a.opacity IS NULL) <> (b.opacity IS NULL)) AS differs, coalesce(a.opacity, b.opacity, 1.0) AS effective FROM a JOIN b USING (doc_id, layer_id)""")
def opacity_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    """Opacities of two systems within a tolerance (MTH-08)."""
    side = lambda n: table(spark, sf, n).groupBy("doc_id", "layer_id").agg(F.max(F.struct("exported_at", "opacity")).opacity.alias(n))
    both = side("probe_a").join(side("probe_b"), KEY)
    return both.select(*KEY, C.differs(F.col("probe_a"), F.col("probe_b")).alias("differs"), C.effective_opacity(F.col("probe_a"), F.col("probe_b")).alias("effective"))


@query("""SELECT DISTINCT doc_id, layer_id, left_px, top_px, right_px, bottom_px, layer_id % 3 <> 0 AS meaningful FROM probe_a""")
def reference_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points that aren't the centre of their box (FLT-16)."""
    rows = table(spark, sf, "probe_a").select("doc_id", "layer_id", "left_px", "top_px", "right_px", "bottom_px").distinct()
    x = (F.col("left_px") + F.col("right_px")) / 2 + F.when(F.col("layer_id") % 3 == 1, 0.5).otherwise(0.0)
    y = (F.col("top_px") + F.col("bottom_px")) / 2 + F.when(F.col("layer_id") % 3 == 2, 1e-3).otherwise(1e-9)
    return rows.select("*", C.meaningful_reference(x, y, F.col("left_px"), F.col("top_px"), F.col("right_px"), F.col("bottom_px")).alias("meaningful"))


@query(_L + """ SELECT doc_id, layer_id, lower(trim(coalesce(name, ''), ' ')) = 'background' AS background, (opacity IS NOT NULL AND opacity <> 255) OR coalesce(blend_mode, 'normal') NOT IN ('normal', 'pass through') AS effect,
  CASE WHEN layer_id % 3 = 0 THEN 'auto' WHEN layer_id % 3 = 1 THEN 'dispose' ELSE 'x.Other' END AS dispose, layer_id % 4 IN (1, 3) AND kind <> 'group' OR layer_id % 4 = 3 AND kind = 'group' AS opacity_counts,
  concat_ws(',', 'group', CASE WHEN opacity <> 255 THEN 'opacity' END, CASE WHEN NOT visible THEN 'hidden' END) AS fields, coalesce(visible, false) AND NOT coalesce(opacity = 0, false) AND copy_token IS NULL AS mask, base64(encode(coalesce(name, ''))) AS coded FROM l""")
def layer_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Shared backgrounds, effects, enumerations, valid properties, fields present, masks, base64 (FLT-08, FLT-15, FLT-18, PRJ-09, PRJ-10, STR-05, STR-07, ARR-04)."""
    k = F.col("layer_id")
    value = F.when(k % 3 == 1, "FrDs.Dispose").when(k % 3 == 2, "x.Other")
    kind = F.when(F.col("kind") == "group", "group").otherwise("normal")
    valid = C.property_validity(kind, F.lit(False), k % 4)
    fields = C.present_fields(["group"], {"opacity": F.col("opacity") != 255, "hidden": ~F.col("visible")})
    mask = C.rasterisable_mask(F.col("visible"), [F.col("opacity") == 0, F.col("copy_token").isNotNull()])
    return _layers(spark, sf).select(
        *KEY, C.is_shared_background(F.col("name")).alias("background"), G.has_effect(F.col("opacity") / 255.0, F.col("blend_mode")).alias("effect"), C.enum_suffix(value, ["auto", "none", "dispose"], "auto").alias("dispose"),
        valid.opacity.alias("opacity_counts"), F.array_join(fields, ",").alias("fields"), mask.alias("mask"), F.base64(F.encode(F.coalesce("name", F.lit("")), "utf-8")).alias("coded"),
    )


@query(_T + """ SELECT t.doc_id, t.layer_id, t.path, coalesce((SELECT string_agg(coalesce(nullif(n.name, ''), '<unnamed>'), ' / ' ORDER BY u.i) FROM (SELECT unnest(t.above) AS id, generate_subscripts(t.above, 1) AS i) u JOIN l n ON n.doc_id = t.doc_id AND n.layer_id = u.id), '') AS group_name FROM t WHERE depth = 1""")
def depth_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Layers of one depth with the names above them (TRE-02)."""
    layers = _layers(spark, sf)
    return G.nodes_at_depth(_flat(layers), layers, 1)


@query(_T + """, b AS (SELECT doc_id, layer_id FROM l WHERE lower(trim(coalesce(name, ''), ' ')) = 'background' OR layer_id % 17 = 0),
g AS (SELECT doc_id, layer_id AS target, above AS up, (row_number() OVER (PARTITION BY doc_id ORDER BY list_transform(string_split(path, '/'), lambda x: x::INT)) - 1)::INT AS frame_index FROM t WHERE depth = 1)
SELECT t.doc_id, g.frame_index, count(*)::BIGINT AS layers, count(*) FILTER (WHERE t.layer_id = g.target OR list_contains(g.up, t.layer_id) OR list_contains(t.above, g.target) OR EXISTS (SELECT 1 FROM b WHERE b.doc_id = t.doc_id AND b.layer_id = t.layer_id))::BIGINT AS enabled
FROM t JOIN g ON g.doc_id = t.doc_id GROUP BY ALL""")
def hierarchy_frames(spark: SparkSession, sf: str) -> DataFrame:
    """One frame per layer of a depth: what it shows (TRE-05, FLT-08)."""
    layers = _layers(spark, sf)
    shown = layers.where(C.is_shared_background(F.col("name")) | (F.col("layer_id") % 17 == 0))
    frames = H.retime_by_depth(_flat(layers), "layer_id", 1, shown)
    return frames.groupBy("doc_id", "frame_index").agg(F.count("*").alias("layers"), F.count_if("enabled").alias("enabled"))


@query(_L + " SELECT doc_id, layer_id, 0 AS frame_index, false AS record_present, coalesce(visible, true) AS enabled FROM l")
def static_frames(spark: SparkSession, sf: str) -> DataFrame:
    """One frame that shows what isn't hidden (TRE-07)."""
    return G.static_states(_layers(spark, sf).withColumn("hidden", ~F.col("visible")))


@query(_T + """, p AS (SELECT DISTINCT doc_id, above[1:n] AS prefix FROM t, unnest(range(1, len(above) + 1)) AS u(n))
SELECT doc_id, array_to_string(prefix, '/') AS node, array_to_string(prefix[1:len(prefix) - 1], '/') AS parent, len(prefix)::INT AS depth FROM p""")
def planned_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes that key paths stand for (TRE-08)."""
    return H.insert_paths(_flat(_layers(spark, sf)).select("doc_id", F.col("ancestors").cast("array<string>").alias("key_path")), "key_path")


@query(_T + """, s AS (SELECT doc_id, count(DISTINCT above[1]) = 1 AND min(len(above)) > 0 AS shared FROM t WHERE depth > 0 GROUP BY doc_id)
SELECT t.doc_id, t.layer_id, array_to_string(CASE WHEN shared THEN above[2:] ELSE above END, '/') AS key_path FROM t JOIN s USING (doc_id) WHERE depth > 0""")
def common_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Key paths without a first segment that all of a document share (TRE-09)."""
    paths = _flat(_layers(spark, sf)).where("depth > 0").select(*KEY, F.col("ancestors").cast("array<string>").alias("key_path"))
    return H.drop_common_root(paths, "key_path", F.lit(True)).select(*KEY, F.array_join("key_path", "/").alias("key_path"))


@query(_T + """, b AS (SELECT doc_id, layer_id, min(left_px) AS x0, min(top_px) AS y0, max(right_px) AS x1, max(bottom_px) AS y1, bool_or(NOT coalesce(hidden, false)) AS enabled FROM probe_a GROUP BY ALL)
SELECT cl.doc_id, cl.high AS layer_id, min(x0) AS left_px, min(y0) AS top_px, max(x1) AS right_px, max(y1) AS bottom_px FROM cl JOIN b ON b.doc_id = cl.doc_id AND b.layer_id = cl.low WHERE enabled GROUP BY ALL""")
def effective_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Union of the enabled boxes at and under each layer (AGG-13)."""
    boxes = table(spark, sf, "probe_a").groupBy(*KEY).agg(
        F.min("left_px").alias("left"), F.min("top_px").alias("top"), F.max("right_px").alias("right"), F.max("bottom_px").alias("bottom"), F.bool_or(~F.coalesce("hidden", F.lit(False))).alias("enabled")
    )
    closed = H.closure(_flat(_layers(spark, sf)), "layer_id")
    out = H.effective_bounds(closed, boxes, "layer_id", ["doc_id"])
    return out.select(*KEY, *[F.col(c).alias(f"{c}_px") for c in ("left", "top", "right", "bottom")])


def _resolved(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    layers = checkpoint(_layers(spark, sf))
    flat = _flat(layers)
    return layers, flat, H.closure(flat, "layer_id"), _states(layers, spark, sf)


@query(_S + " SELECT doc_id, layer_id FROM box")
def structural_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that only select frames (FLT-03)."""
    layers, flat, closed, states = _resolved(spark, sf)
    return V.structural_containers(flat, layers, closed, states)


@query(_S + """ SELECT l.doc_id, l.layer_id, coalesce(own.ever, false) OR EXISTS (SELECT 1 FROM box WHERE box.doc_id = l.doc_id AND box.layer_id = l.layer_id) AS ever FROM l LEFT JOIN own USING (doc_id, layer_id)""")
def ever_visible(spark: SparkSession, sf: str) -> DataFrame:
    """Layers that show in any frame (FLT-04)."""
    layers, flat, closed, states = _resolved(spark, sf)
    return V.ever_visible(layers, states, V.structural_containers(flat, layers, closed, states))


@query(_S + """, o AS (SELECT st.doc_id, st.layer_id, st.frame_index, st.enabled OR box.layer_id IS NOT NULL AS open_ FROM st LEFT JOIN box USING (doc_id, layer_id))
SELECT cl.doc_id, cl.low AS layer_id, o.frame_index, bool_and(o.open_) AS visible FROM cl JOIN l ON l.doc_id = cl.doc_id AND l.layer_id = cl.low AND l.kind <> 'group' JOIN o ON o.doc_id = cl.doc_id AND o.layer_id = cl.high GROUP BY ALL""")
def visible_drawings(spark: SparkSession, sf: str) -> DataFrame:
    """Drawings that show in a frame through the groups above (FLT-01, FLT-02, FLT-03)."""
    layers, flat, closed, states = _resolved(spark, sf)
    return V.effective_visibility(layers, closed, states, V.structural_containers(flat, layers, closed, states))


@query(_S + """ SELECT l.doc_id, l.layer_id, EXISTS (SELECT 1 FROM l k WHERE k.doc_id = l.doc_id AND k.parent_id = l.layer_id) AND NOT EXISTS (SELECT 1 FROM l k WHERE k.doc_id = l.doc_id AND k.parent_id = l.layer_id AND k.kind = 'group')
  AND EXISTS (SELECT 1 FROM var WHERE var.doc_id = l.doc_id AND var.layer_id = l.parent_id) AS feature,
  EXISTS (SELECT 1 FROM var WHERE var.doc_id = l.doc_id AND var.layer_id = l.layer_id) AND EXISTS (SELECT 1 FROM cl JOIN st ON st.doc_id = cl.doc_id AND st.layer_id = cl.low WHERE cl.doc_id = l.doc_id AND cl.high = l.layer_id AND st.kind <> 'group' AND st.enabled) AS bound FROM l WHERE l.kind = 'group'""")
def timeline_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups bound to the timeline, and groups of drawings that are exclusive features (FLT-05, FLT-06, FLT-07)."""
    layers, _, closed, states = _resolved(spark, sf)
    bound, feature = V.timeline_bound(layers, closed, states), V.exclusive_features(layers, states)
    groups = layers.where("kind = 'group'").select(*KEY)
    marked = groups.join(bound.withColumn("b", F.lit(True)), KEY, "left").join(feature.withColumn("f", F.lit(True)), KEY, "left")
    return marked.select(*KEY, F.coalesce("f", F.lit(False)).alias("feature"), F.coalesce("b", F.lit(False)).alias("bound"))


@query(_L + """ SELECT doc_id, max(layer_id) + 1 AS first_free, count(*) FILTER (WHERE kind = 'group')::BIGINT AS dividers, count(DISTINCT blend_mode)::BIGINT AS modes, count(DISTINCT parent_id)::BIGINT AS parents FROM l GROUP BY doc_id""")
def structure_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of a document's structure and its first free id (AGG-16, AGG-17, FLT-14)."""
    layers = G.reject_clipping(_layers(spark, sf).withColumn("clipping", F.lit(None).cast("boolean")))
    counts = layers.groupBy("doc_id").agg(F.count_if(F.col("kind") == "group").alias("dividers"), F.count_distinct("blend_mode").alias("modes"), F.count_distinct("parent_id").alias("parents"))
    return D.require_matched(counts, G.first_free_id(layers), ["doc_id"], "document")


@query("""WITH k AS (SELECT (l_orderkey % 50)::VARCHAR AS doc_id, l_orderkey, l_orderkey * 10 + l_linenumber AS layer_id, l_orderkey * 10 + 1 + max(l_linenumber) OVER (PARTITION BY l_orderkey) AS parent_id, l_returnflag AS name, l_shipdate FROM lineitem)
SELECT doc_id, parent_id AS layer_id FROM k GROUP BY ALL HAVING bool_and(name = 'N') AND count(*) = parent_id - min(layer_id) AND count(DISTINCT layer_id) = count(*) AND count(DISTINCT l_shipdate) = count(*)""")
def cel_wrappers(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that only wrap the cels of one layer, on orders and their lines (FLT-20)."""
    lines = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).cast("string").alias("doc_id"), "l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("layer_id"), F.col("l_returnflag").alias("name"), F.col("l_shipdate").alias("frame_index"))
    groups = lines.groupBy("doc_id", "l_orderkey").agg((F.max("layer_id") + 1).alias("id")).select("doc_id", "l_orderkey", F.col("id").alias("parent_id"))
    kids = lines.join(groups, ["doc_id", "l_orderkey"]).select("doc_id", "layer_id", "parent_id", "name", F.lit("pixel").alias("kind"))
    roots = groups.select("doc_id", F.col("parent_id").alias("layer_id"), F.lit(None).cast("bigint").alias("parent_id"), F.lit("N").alias("name"), F.lit("group").alias("kind"))
    return G.cel_wrappers(kids.unionByName(roots), lines.select("doc_id", "layer_id", "frame_index"))


@query("""WITH t AS (SELECT c_nationkey::VARCHAR AS doc_id, c_custkey AS track, CASE WHEN c_custkey % 5 = 0 THEN []::BIGINT[] ELSE [c_custkey % 7, 10 + c_custkey % 3] END AS features, c_mktsegment || c_custkey % 4 AS name, c_custkey % 3 = 0 AS generic FROM customer)
SELECT a.doc_id, a.track AS a, b.track AS b, CASE WHEN len(a.features) > 0 AND a.features = b.features THEN 0 ELSE 1 END AS kind FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.track < b.track
WHERE len(a.features) > 0 AND a.features = b.features OR NOT a.generic AND NOT b.generic AND a.name = b.name""")
def merge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of tracks that may be one, on customers of a nation (JN-20)."""
    key = F.col("c_custkey")
    features = F.when(key % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(key % 7, key % 3 + 10))
    tracks = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("doc_id"), key.alias("track"), features.alias("features"), F.concat("c_mktsegment", (key % 4).cast("string")).alias("name"), (key % 3 == 0).alias("generic"))
    return G.merge_candidates(tracks)


@query("""WITH c AS (SELECT DISTINCT (l_orderkey % 40)::VARCHAR AS doc_id, l_suppkey % 12 AS track, l_partkey % 97 AS frame_index, l_suppkey % 12 % 5 AS selector FROM lineitem WHERE l_suppkey % 12 <> l_partkey % 12 OR l_linenumber > 5),
p AS (SELECT DISTINCT a.doc_id, a.track AS a, b.track AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.track < b.track)
SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.frame_index = y.frame_index WHERE x.doc_id = p.doc_id AND x.track = p.a AND y.track = p.b) THEN 'co_visible'
  WHEN (a % 5) % 2 = (b % 5) % 2 AND a % 5 <> b % 5 THEN 'structural' ELSE 'observed_disjoint' END AS relation FROM p""")
def track_relations(spark: SparkSession, sf: str) -> DataFrame:
    """How two tracks relate, on suppliers and parts of orders (JN-15)."""
    track = F.col("l_suppkey") % 12
    lines = table(spark, sf, "lineitem").where((track != F.col("l_partkey") % 12) | (F.col("l_linenumber") > 5))
    cels = lines.select((F.col("l_orderkey") % 40).cast("string").alias("doc_id"), track.alias("track"), (F.col("l_partkey") % 97).alias("frame_index"), (track % 5).alias("selector")).distinct()
    selectors = cels.select("doc_id", F.col("selector").alias("layer_id"), (F.col("selector") % 2).alias("parent_id")).distinct()
    one = cels.select("doc_id", "track").distinct()
    pairs = one.withColumnRenamed("track", "a").join(one.withColumnRenamed("track", "b"), "doc_id").where("a < b")
    return G.track_relations(pairs, cels, selectors)


@query("""WITH s AS (SELECT l_orderkey::VARCHAR AS doc_id, l_linenumber AS state, (l_quantity::INT % 4) AS frame_index, l_returnflag <> 'R' AS enabled FROM lineitem)
SELECT doc_id, frame_index, min(state) AS state FROM s WHERE enabled GROUP BY ALL""")
def frame_owners(spark: SparkSession, sf: str) -> DataFrame:
    """The first enabled state of each frame, on the lines of orders (JN-19)."""
    states = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").alias("state"), F.col("l_linenumber").alias("ordinal"), (F.col("l_quantity").cast("int") % 4).alias("frame_index"), (F.col("l_returnflag") != "R").alias("enabled"))
    return G.frame_owners(states, states.where("enabled").select("doc_id", "frame_index").distinct())


@query("""WITH n AS (SELECT o_custkey::VARCHAR AS doc_id, (o_orderkey % 3)::INT AS frame_index, (o_orderkey % 5)::VARCHAR AS path, o_orderpriority AS name FROM orders)
SELECT doc_id, path, min(name) AS name, count(*)::BIGINT AS nodes, count(DISTINCT name) = 1 AND count(DISTINCT frame_index) = 3 AND count(*) = 3 AS matched FROM n GROUP BY ALL""")
def frame_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of parallel frame trees matched by path, on orders of customers (JN-17)."""
    nodes = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), (F.col("o_orderkey") % 3).cast("int").alias("frame_index"), (F.col("o_orderkey") % 5).cast("string").alias("path"), F.col("o_orderpriority").alias("name"))
    return G.zip_frame_groups(nodes, F.lit(3))


@query("""SELECT c_nationkey::VARCHAR AS doc_id, c_custkey % 20 AS node, coalesce(string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FILTER (WHERE c_custkey % 6 <> 0), '') AS features, bool_or(c_custkey % 6 = 0) AS unassigned,
  count(DISTINCT CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END) = 1 AND NOT bool_or(c_custkey % 6 = 0) AS pure FROM customer GROUP BY ALL""")
def feature_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The features below each node, and whether it is pure (AGG-14)."""
    key = F.col("c_custkey")
    members = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("doc_id"), (key % 20).alias("node"), F.when(key % 6 != 0, F.col("c_mktsegment")).alias("feature"))
    return G.feature_summary(members).withColumn("features", F.array_join("features", ","))


_MARKERS = [
    ("a", 1, "wrapper", 7, 0, 2), ("a", 1, "variant", 7, 1, 2), ("a", 1, "variant", 7, 2, 2), ("b", 1, "wrapper", 7, 0, 2), ("b", 1, "variant", 7, 1, 2), ("c", 2, "frame_group", 1, 1, 2), ("c", 2, "frame_group", 1, 2, 2),
    ("c", 2, "layer_copy", 2, 1, 2), ("c", 2, "layer_copy", 2, 2, 2), ("d", 3, "frame_group", 1, 2, 5), ("d", 3, "layer_copy", 4, 1, 5), ("e", 3, "frame_group", 1, 6, 5), ("e", 3, "layer_copy", 4, 1, 5),
    ("f", 1, "wrapper", 7, 0, 1), ("f", 2, "layer_copy", 7, 1, 1), ("g", 3, "frame_group", 0xFFFFFFFF, 1, 1), ("g", 3, "layer_copy", 4, 1, 1),
]


@query("SELECT * FROM (VALUES ('a', true, false), ('b', false, false), ('c', true, false), ('d', true, false), ('e', false, false), ('f', false, false), ('g', true, true)) v(doc_id, valid, linked)")
def marker_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Whether marker sets are whole, on sets made for each version (VAL-03)."""
    rows = spark.createDataFrame(_MARKERS, "doc_id string, version int, role string, logical_layer_id bigint, variant_index int, variant_count int")
    return D.marker_status(rows).select("doc_id", "valid", "linked")


@query("""WITH e AS (SELECT vec_id, embedding, lag(embedding) OVER (ORDER BY vec_id) AS was, vec_id // 10 AS g, lag(vec_id) OVER (ORDER BY vec_id) // 10 AS h FROM embeddings)
SELECT vec_id, len(list_filter(range(1, len(embedding) + 1), lambda i: (embedding[i] > 0) <> (was[i] > 0)))::INT AS changed FROM e WHERE g = h""")
def near_equal_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Components in which neighbouring vectors of a block differ in sign (PIX-05's count on arrays)."""
    w = Window.partitionBy((F.col("vec_id") / 10).cast("bigint")).orderBy("vec_id")
    signs = F.transform("embedding", lambda x: x > 0)
    rows = table(spark, sf, "embeddings").select("vec_id", signs.alias("now"), F.lag(signs).over(w).alias("was")).where("was IS NOT NULL")
    return rows.select("vec_id", D.changed_cells(F.col("now"), F.col("was")).alias("changed"))


_GROUPS = "WITH g AS (SELECT p_partkey // 3 AS grp, p_partkey % 3 AS l, p_partkey AS k, p_size AS s FROM part), e AS (SELECT grp, l, r, (k * 7 + r * 13 + s * (r + 1)) % 60 AS score FROM g, unnest([0, 1, 2]) AS u(r) WHERE (k * 7 + r * 13 + s * (r + 1)) % 60 >= 20)"


def _by_block(rows: DataFrame, solve, schema: str) -> DataFrame:
    """``solve`` of each block of rows, many small blocks to a task."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]

    def every(pdf):
        out = [(block, *row) for block, own in pdf.groupby("block") for row in solve(own)]
        return pd.DataFrame(out, columns=names)

    return rows.withColumn("__part", F.pmod(F.xxhash64("block"), F.lit(256))).groupBy("__part").applyInPandas(every, schema)


@query(_GROUPS + """, o AS (SELECT a, b, c FROM unnest([-1, 0, 1, 2]) AS x(a), unnest([-1, 0, 1, 2]) AS y(b), unnest([-1, 0, 1, 2]) AS z(c) WHERE (a < 0 OR a <> b AND a <> c) AND (b < 0 OR b <> c)),
v AS (SELECT q.grp, a, b, c, CASE WHEN a < 0 THEN 0 ELSE 100 + x.score END + CASE WHEN b < 0 THEN 0 ELSE 100 + y.score END + CASE WHEN c < 0 THEN 0 ELSE 100 + z.score END AS w
  FROM (SELECT DISTINCT grp FROM e) q CROSS JOIN o LEFT JOIN e x ON x.grp = q.grp AND x.l = 0 AND x.r = a LEFT JOIN e y ON y.grp = q.grp AND y.l = 1 AND y.r = b LEFT JOIN e z ON z.grp = q.grp AND z.l = 2 AND z.r = c),
m AS (SELECT * FROM v WHERE w IS NOT NULL QUALIFY w = max(w) OVER (PARTITION BY grp)),
t AS (SELECT grp, unnest([0, 1, 2]) AS l, unnest([a, b, c]) AS r, count(*) OVER (PARTITION BY grp) AS optima FROM m)
SELECT grp AS block, l::BIGINT AS item, r AS track FROM t WHERE r >= 0 GROUP BY ALL HAVING count(*) = any_value(optima)""")
def best_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """The assignments that every best matching of a block holds (SLV-02, SLV-03)."""
    from stratacel.plans.solvers import best_matching

    key, size = F.col("p_partkey"), F.col("p_size")
    edges = table(spark, sf, "part").select((key / 3).cast("bigint").alias("block"), (key % 3).alias("item"), F.explode(F.array(*[F.struct(F.lit(r).alias("track"), ((key * 7 + r * 13 + size * (r + 1)) % 60).alias("score")) for r in range(3)])).alias("e"))
    edges = edges.select("block", "item", "e.*").where("score >= 20")

    def solve(pdf):
        scores = {(int(i), int(t)): int(s) for i, t, s in zip(pdf["item"], pdf["track"], pdf["score"])}
        return best_matching(scores)[0].items()

    return _by_block(edges, solve, "block bigint, item bigint, track int")


@query("""WITH g AS (SELECT p_partkey // 4 AS block, p_partkey % 4 AS i, p_partkey AS k, (p_size * 5 + p_partkey * 3) % 23 AS base, (p_size * 11 + p_partkey) % 29 AS key FROM part),
f AS (SELECT block FROM g GROUP BY block HAVING count(*) = 4),
e AS (SELECT a.block, a.i AS x, b.i AS y FROM g a JOIN g b ON a.block = b.block AND (a.key < b.key OR a.key = b.key AND a.k < b.k) AND (a.k + b.k) % 3 = 0),
p AS (SELECT [a, b, c, d] AS perm FROM unnest([0, 1, 2, 3]) AS w(a), unnest([0, 1, 2, 3]) AS x(b), unnest([0, 1, 2, 3]) AS y(c), unnest([0, 1, 2, 3]) AS z(d) WHERE a <> b AND a <> c AND a <> d AND b <> c AND b <> d AND c <> d),
c AS (SELECT f.block, perm, (SELECT list((g.base, g.k) ORDER BY list_position(perm, g.i)) FROM g WHERE g.block = f.block) AS way FROM f CROSS JOIN p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.block = f.block AND list_position(perm, e.x) > list_position(perm, e.y))),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY block ORDER BY way) = 1)
SELECT g.block, g.k AS item, (list_position(perm, g.i) - 1)::INT AS place FROM b JOIN g USING (block)""")
def topo_order(spark: SparkSession, sf: str) -> DataFrame:
    """The stable topological order of each block: the least by base of those that keep all edges (ORD-02, ORD-05, ORD-06)."""
    from stratacel.plans.solvers import stable_order, strict_order

    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf, "part").select((k / 4).cast("bigint").alias("block"), k.alias("item"), ((size * 5 + k * 3) % 23).alias("base"), ((size * 11 + k) % 29).alias("key"))
    rows = rows.join(rows.groupBy("block").agg(F.count("*").alias("n")).where("n = 4").select("block"), "block", "left_semi")

    def order(pdf):
        ids = [int(x) for x in pdf["item"]]
        key = {i: (int(v), i) for i, v in zip(ids, pdf["key"])}
        edges = [(a, b) for a in ids for b in ids if key[a] < key[b] and (a + b) % 3 == 0]
        base = {i: int(b) for i, b in zip(ids, pdf["base"])}
        out = stable_order(ids, edges, base)
        if strict_order(ids, edges, base) != out:
            raise ValueError("no cycle was given")
        return [(i, n) for n, i in enumerate(out)]

    return _by_block(rows, order, "block bigint, item bigint, place int")


@query("""WITH l AS (SELECT l_orderkey AS block, l_linenumber AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS place, l_extendedprice AS wish, l_linenumber % 3 <> 0 AS moves FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_extendedprice)),
m AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY place) AS a, row_number() OVER (PARTITION BY block ORDER BY wish, item) AS b FROM l WHERE moves)
SELECT x.block, x.item, (y.place - x.place)::INT AS z FROM m x JOIN m y ON x.block = y.block AND x.b = y.a""")
def z_indices(spark: SparkSession, sf: str) -> DataFrame:
    """How far items move so that a wanted order fills the slots in use (ORD-07)."""
    from stratacel.plans.solvers import z_indices as moved

    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("item")).agg(F.min("l_extendedprice").alias("wish"))

    def move(pdf):
        current = sorted(int(i) for i in pdf["item"])
        wish = {int(i): w for i, w in zip(pdf["item"], pdf["wish"])}
        wanted = sorted((i for i in current if i % 3), key=lambda i: (wish[i], i))
        return moved(current, wanted).items()

    return _by_block(lines, move, "block bigint, item int, z int")


_FOLDERS = """WITH c AS (SELECT DISTINCT (l_orderkey // 40)::VARCHAR AS doc_id, l_suppkey % 12 AS track, l_partkey AS frame, l_linenumber AS ord, l_suppkey % 40 AS x, l_partkey % 40 AS y, l_quantity::INT AS width, l_linenumber AS height, l_suppkey % 12 % 5 AS selector FROM lineitem),
t AS (SELECT doc_id, track, track % 4 AS base, track % 6 = 5 AS generic, CASE WHEN track % 3 = 2 THEN 1 ELSE 0 END AS suffixes, row_number() OVER (PARTITION BY doc_id ORDER BY track % 5 % 2 * 100 + track) - 1 AS place FROM (SELECT DISTINCT doc_id, track FROM c)),
k AS (SELECT *, NOT generic AND suffixes = 0 AND track % 2 = 0 AS confirmed, generic OR suffixes > 0 OR track % 4 = 1 AS uncertain FROM t),
fam AS (SELECT u.doc_id, u.track, min(a.track) AS anchor FROM k u JOIN k a ON a.doc_id = u.doc_id AND a.base = u.base AND a.confirmed WHERE u.uncertain AND NOT u.generic GROUP BY ALL HAVING count(*) = 1),
nb AS (SELECT u.doc_id, u.track, (SELECT arg_max(a.track, a.place) FROM k a WHERE a.doc_id = u.doc_id AND a.confirmed AND a.place < u.place) AS prev, (SELECT arg_min(a.track, a.place) FROM k a WHERE a.doc_id = u.doc_id AND a.confirmed AND a.place > u.place) AS nxt FROM k u WHERE u.uncertain),
nf AS (SELECT *, EXISTS (SELECT 1 FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.frame = b.frame AND a.ord > b.ord WHERE a.doc_id = nb.doc_id AND a.track = nb.track AND b.track = nb.prev) AS aft, EXISTS (SELECT 1 FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.frame = b.frame AND a.ord < b.ord WHERE a.doc_id = nb.doc_id AND a.track = nb.track AND b.track = nb.nxt) AS bef FROM nb WHERE prev IS NOT NULL AND nxt IS NOT NULL),
bnd AS (SELECT doc_id, track, CASE WHEN aft THEN nxt ELSE prev END AS anchor FROM nf WHERE aft <> bef),
sc AS (SELECT u.doc_id, u.track, a.track AS anchor, least(100, CASE abs(u.place - a.place) WHEN 0 THEN 50 WHEN 1 THEN 40 WHEN 2 THEN 30 WHEN 3 THEN 20 ELSE 0 END
  + (SELECT max(least(20, (round(least(p.width, q.width) / greatest(p.width, q.width)::DOUBLE * 10)::BIGINT + round(least(p.height, q.height) / greatest(p.height, q.height)::DOUBLE * 10)::BIGINT) // 2 + (20 - least(20, least(abs(p.x - q.x), 32) + least(abs(p.y - q.y), 32))) // 2)) FROM c p JOIN c q ON p.doc_id = q.doc_id WHERE p.doc_id = u.doc_id AND p.track = u.track AND q.track = a.track)
  + coalesce((SELECT max(15 - 2 * least(abs(p.ord - q.ord), 7)) FROM c p JOIN c q ON p.doc_id = q.doc_id AND p.frame = q.frame WHERE p.doc_id = u.doc_id AND p.track = u.track AND q.track = a.track), 0)) AS score FROM k u JOIN k a ON a.doc_id = u.doc_id AND a.confirmed WHERE u.uncertain),
aff AS (SELECT doc_id, track, anchor FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id, track ORDER BY score DESC, anchor) = 1 AND score >= 50),
pick AS (SELECT u.doc_id, u.track, coalesce(fam.anchor, bnd.anchor, aff.anchor) AS anchor FROM k u LEFT JOIN fam USING (doc_id, track) LEFT JOIN bnd USING (doc_id, track) LEFT JOIN aff USING (doc_id, track) WHERE u.uncertain),
rel AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.frame = b.frame WHERE a.doc_id = pick.doc_id AND a.track = pick.anchor AND b.track = pick.track) THEN 'co_visible' WHEN (anchor % 5) % 2 = (track % 5) % 2 AND anchor % 5 <> track % 5 THEN 'structural' ELSE 'observed_disjoint' END AS relation FROM pick WHERE anchor IS NOT NULL),
mem AS (SELECT DISTINCT doc_id, anchor, unnest([anchor, track]) AS member FROM rel WHERE relation = 'structural'),
grp AS (SELECT mem.doc_id, anchor, string_agg(member, ',' ORDER BY place) AS members, max(place) - min(place) + 1 = count(*) AS complete FROM mem JOIN t ON t.doc_id = mem.doc_id AND t.track = member GROUP BY ALL),
fol AS (SELECT doc_id, anchor, members, complete, CASE WHEN EXISTS (SELECT 1 FROM mem m JOIN c ON c.doc_id = m.doc_id AND c.track = m.member WHERE m.doc_id = grp.doc_id AND m.anchor = grp.anchor GROUP BY c.frame HAVING count(DISTINCT m.member) > 1) THEN 'members show together' WHEN NOT complete THEN 'incomplete interval' END AS reason FROM grp
UNION ALL SELECT r.doc_id, r.anchor, (SELECT string_agg(t.track, ',' ORDER BY place) FROM t WHERE t.doc_id = r.doc_id AND t.track IN (r.anchor, r.track)), (SELECT max(place) - min(place) + 1 = count(*) FROM t WHERE t.doc_id = r.doc_id AND t.track IN (r.anchor, r.track)), relation FROM rel r WHERE relation <> 'structural'
UNION ALL SELECT doc_id, track, track::VARCHAR, false, 'no anchor' FROM pick WHERE anchor IS NULL)"""


def _folders(spark: SparkSession, sf: str) -> DataFrame:
    from stratacel.plans.folders import candidate_folders

    track = F.col("l_suppkey") % 12
    cels = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") / 40).cast("bigint").cast("string").alias("doc_id"), track.alias("track"), F.col("l_partkey").alias("frame"), F.col("l_linenumber").alias("order"), (F.col("l_suppkey") % 40).alias("x"),
        (F.col("l_partkey") % 40).alias("y"), F.col("l_quantity").cast("int").alias("width"), F.col("l_linenumber").alias("height"), (track % 5).alias("selector"),
    ).distinct()
    t = F.col("track")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy((t % 5) % 2 * 100 + t)) - 1
    tracks = cels.select("doc_id", "track").distinct().select("doc_id", "track", (t % 4).alias("base"), (t % 6 == 5).alias("generic"), F.when(t % 3 == 2, 1).otherwise(0).alias("suffixes"), place.alias("place"))
    status = F.when(t % 2 == 0, "strong").when(t % 4 == 1, "new").otherwise("probable")
    selectors = cels.select("doc_id", F.col("selector").alias("layer_id"), (F.col("selector") % 2).alias("parent_id")).distinct()
    return candidate_folders(tracks, cels, tracks.select("doc_id", "track", status.alias("status")), selectors)


@query(_FOLDERS + " SELECT doc_id, anchor, members, complete, reason IS NULL AS emitted, reason FROM fol")
def candidate_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Folders of uncertain tracks, on suppliers and parts of orders (SLV-07, FLT-17, ORD-10)."""
    return _folders(spark, sf).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query(_FOLDERS + " SELECT doc_id, count(*) FILTER (WHERE reason IS NULL) AS folders, 0::BIGINT AS wrong FROM fol GROUP BY doc_id")
def folder_topology(spark: SparkSession, sf: str) -> DataFrame:
    """Emitted folders stand once with exactly their members (VAL-06)."""
    from stratacel.plans.folders import folder_paths, folder_problems

    folders = checkpoint(_folders(spark, sf))
    wrong = folder_problems(folders, folder_paths(folders)).groupBy("doc_id").agg(F.count("*").alias("wrong"))
    return folders.groupBy("doc_id").agg(F.count_if("emitted").alias("folders")).join(wrong, "doc_id", "left").select("doc_id", "folders", F.coalesce("wrong", F.lit(0)).cast("bigint").alias("wrong"))
