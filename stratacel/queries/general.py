"""Queries of the general training-data problems: copies that differ, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacel.operators.nested import Tables, nested_tables
from stratacel.operators.table_diff import Compared, diff_tables, letters_only, unordered
from stratacel.session import table

PROBE_FIELDS = {"opacity": Compared(tolerance=0.004), "blend_mode": Compared(canonical=letters_only)}
AUDIT_FIELDS = {
    "sha256": Compared(canonical=F.lower),
    "layers": Compared(
        canonical=lambda c: unordered(
            c,
            lambda x: F.struct(
                x.layer_id.alias("l"), letters_only(x.blend_mode).alias("b"), x.opacity.alias("o")
            ),
        )
    ),
}
#: Fields of a report that always hold arrays (fixed by the data).
REPORT_ARRAYS = ("resources", "subresources", "metadata_records", "layers", "channels", "additional_info", "issues", "frames")


def _probe_diff(spark: SparkSession, sf: str) -> DataFrame:
    return diff_tables(table(spark, sf, "probe_a"), table(spark, sf, "probe_b"), ["doc_id", "layer_id"], PROBE_FIELDS, "exported_at")


def _audit_diff(spark: SparkSession, sf: str) -> DataFrame:
    return diff_tables(table(spark, sf, "audit_a"), table(spark, sf, "audit_b"), ["doc_id"], AUDIT_FIELDS, "exported_at")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of the layer snapshots and of the audits; audits have layer 0."""
    audits = _audit_diff(spark, sf).select("doc_id", F.lit(0).cast("bigint").alias("layer_id"), "finding")
    return _probe_diff(spark, sf).unionByName(audits)


def p1_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Findings counted by table and kind."""
    both = _probe_diff(spark, sf).select(F.lit("probe").alias("source"), "finding").unionByName(
        _audit_diff(spark, sf).select(F.lit("audit").alias("source"), "finding")
    )
    return both.groupBy("source", "finding").agg(F.count("*").alias("n"))


def _tables(spark: SparkSession, sf: str) -> Tables:
    return nested_tables(table(spark, sf, "report_raw"), "report_id", "received_at", "body", REPORT_ARRAYS)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every nested object with its parent."""
    return _tables(spark, sf).nodes().select("report_id", "node_path", "parent_path")


def p5_layers(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of layers, with its schema applied."""
    rows = _tables(spark, sf).read("layers", "id BIGINT, name STRING, kind STRING, opacity DOUBLE, blend_mode STRING")
    return rows.select("report_id", "node_path", "parent_path", "ordinal", "id", "name", "kind", "opacity", "blend_mode")


def p5_channels(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of channels; parent_path leads to their layer."""
    rows = _tables(spark, sf).read("channels", "id INT, compression INT")
    return rows.select("report_id", "node_path", "parent_path", "ordinal", "id", "compression")


def p5_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and reports of each flat table."""
    return _tables(spark, sf).nodes().groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("report_id").alias("reports"))


QUERIES = {
    "p1_found": p1_found,
    "p1_summary": p1_summary,
    "p5_found": p5_found,
    "p5_layers": p5_layers,
    "p5_channels": p5_channels,
    "p5_tags": p5_tags,
}

_P1 = r"""
WITH pa AS (SELECT doc_id, layer_id, opacity, regexp_replace(lower(blend_mode), '[\s_-]', '', 'g') AS bm
    FROM probe_a QUALIFY row_number() OVER (PARTITION BY doc_id, layer_id ORDER BY exported_at DESC, opacity DESC, blend_mode DESC) = 1),
pb AS (SELECT doc_id, layer_id, opacity, regexp_replace(lower(blend_mode), '[\s_-]', '', 'g') AS bm
    FROM probe_b QUALIFY row_number() OVER (PARTITION BY doc_id, layer_id ORDER BY exported_at DESC, opacity DESC, blend_mode DESC) = 1),
pj AS (SELECT coalesce(pa.doc_id, pb.doc_id) AS doc_id, coalesce(pa.layer_id, pb.layer_id) AS layer_id,
    pa.doc_id IS NULL AS no_a, pb.doc_id IS NULL AS no_b, pa.opacity AS oa, pb.opacity AS ob, pa.bm AS ma, pb.bm AS mb
    FROM pa FULL JOIN pb ON pa.doc_id = pb.doc_id AND pa.layer_id = pb.layer_id),
aa AS (SELECT doc_id, lower(sha256) AS sha, layers FROM audit_a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY exported_at DESC) = 1),
ab AS (SELECT doc_id, lower(sha256) AS sha, layers FROM audit_b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY exported_at DESC) = 1),
la AS (SELECT doc_id, sha, list_sort(list_transform(layers, lambda x: coalesce(x.layer_id::VARCHAR, '~') || '/' || coalesce(regexp_replace(lower(x.blend_mode), '[\s_-]', '', 'g'), '~') || '/' || coalesce(x.opacity::VARCHAR, '~'))) AS ls FROM aa),
lb AS (SELECT doc_id, sha, list_sort(list_transform(layers, lambda x: coalesce(x.layer_id::VARCHAR, '~') || '/' || coalesce(regexp_replace(lower(x.blend_mode), '[\s_-]', '', 'g'), '~') || '/' || coalesce(x.opacity::VARCHAR, '~'))) AS ls FROM ab),
aj AS (SELECT coalesce(la.doc_id, lb.doc_id) AS doc_id, la.doc_id IS NULL AS no_a, lb.doc_id IS NULL AS no_b,
    la.sha AS sa, lb.sha AS sb, la.ls AS l1, lb.ls AS l2 FROM la FULL JOIN lb ON la.doc_id = lb.doc_id),
found AS (
SELECT 'probe' AS source, doc_id, layer_id, CASE WHEN no_a THEN 'only_in_b' ELSE 'only_in_a' END AS finding FROM pj WHERE no_a OR no_b
UNION ALL SELECT 'probe', doc_id, layer_id, 'opacity' FROM pj WHERE NOT no_a AND NOT no_b AND ((oa IS NULL) <> (ob IS NULL) OR abs(oa - ob) > 0.004 + 1e-9)
UNION ALL SELECT 'probe', doc_id, layer_id, 'blend_mode' FROM pj WHERE NOT no_a AND NOT no_b AND ma IS DISTINCT FROM mb
UNION ALL SELECT 'audit', doc_id, 0::BIGINT, CASE WHEN no_a THEN 'only_in_b' ELSE 'only_in_a' END FROM aj WHERE no_a OR no_b
UNION ALL SELECT 'audit', doc_id, 0::BIGINT, 'sha256' FROM aj WHERE NOT no_a AND NOT no_b AND sa IS DISTINCT FROM sb
UNION ALL SELECT 'audit', doc_id, 0::BIGINT, 'layers' FROM aj WHERE NOT no_a AND NOT no_b AND l1 IS DISTINCT FROM l2)
"""

ORACLE = {
    "p1_found": _P1 + "SELECT doc_id, layer_id, finding FROM found",
    "p1_summary": _P1 + "SELECT source, finding, count(*)::BIGINT AS n FROM found GROUP BY source, finding",
}
