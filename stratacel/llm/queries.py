"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacel.llm import confusables, leakage, near_dup, packing, runs, sentences
from stratacel.session import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of source cels, of any documents, whose contents are at least 0.6 alike."""
    members, links = near_dup.near_duplicates(table(spark, sf, "snapshot_cel"))
    pairs = near_dup.expand_pairs(members, links)
    return pairs.select(F.col("lo").alias("cel_id_lo"), F.col("hi").alias("cel_id_hi"))


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per source cel: its class of equal content and the links of that class to others."""
    members, links = near_dup.near_duplicates(table(spark, sf, "snapshot_cel"))
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(ends, "rep", "left").select(
        "cel_id", F.col("rep").alias("class_id"), "members", F.coalesce("links", F.lit(0)).cast("bigint").alias("links")
    )


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.collapse_runs(table(spark, sf, "snapshot_cel"), table(spark, sf, "psd_frame"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of at least two repeated cels."""
    return _runs(spark, sf).where("cels >= 2").select("doc_id", "source_layer_id", "first_frame", "last_frame")


def p3_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every run, also of one cel, with its number of cels and its duration."""
    return _runs(spark, sf)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of layers of a document whose names look the same but aren't the same code points."""
    pairs = confusables.look_alike_pairs(table(spark, sf, "snapshot_layer"), "layer_key", "doc_id", "name", "ingested_at")
    return pairs.select(F.col("lo").alias("layer_key_lo"), F.col("hi").alias("layer_key_hi"))


def p4_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Each layer's name, normalised name and copy suffix in their consistent form."""
    layers = table(spark, sf, "snapshot_layer").select("layer_key", "name", "normalized_name", "copy_token").distinct()
    out = confusables.consistent(layers, ["name", "normalized_name", "copy_token"])
    return out.select("layer_key", "name_canonical", "normalized_name_canonical", "copy_token_canonical")


def p6_pack(spark: SparkSession, sf: str) -> DataFrame:
    """All texts in containers of 2,048 tokens of a public tokenizer for many languages."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return packing.pack_texts(table(spark, sf, "documents"), "doc_id", "text", str(path), public_tokenizers.PATTERN)


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are: containers by their number of unused tokens."""
    used = p6_pack(spark, sf).groupBy("container").agg(F.sum("length").alias("used"))
    return used.groupBy((packing.CAPACITY - F.col("used")).alias("unused")).agg(F.count("*").alias("containers"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the test items of which they hold a passage."""
    return leakage.leaked(table(spark, sf, "documents"), table(spark, sf, "eval_item")).select("doc_id", "item_id")


def p7_near(spark: SparkSession, sf: str) -> DataFrame:
    """Proximity matches, and how many of the item's terms they hold."""
    return leakage.leaked(table(spark, sf, "documents"), table(spark, sf, "eval_item"), phrase=False)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences of every text."""
    return sentences.split_sentences(table(spark, sf, "documents"))


def p8_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences by the documents' stated language."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return p8_found(spark, sf).join(docs, "doc_id").groupBy("lang").agg(F.count("*").alias("sentences"))


QUERIES = {"p6_pack": p6_pack, "p6_fill": p6_fill, "p7_found": p7_found, "p7_near": p7_near, "p8_found": p8_found, "p8_counts": p8_counts, "p4_found": p4_found, "p4_canonical": p4_canonical, "p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p3_runs": p3_runs}
_P2 = """WITH s AS (SELECT min(cel_id) AS cel_id FROM snapshot_cel WHERE source_frame = linked_source_frame AND cel_id IS NOT NULL GROUP BY doc_id, source_layer_id, source_frame),
k AS (SELECT DISTINCT cel_id, width, height, hex(pixels) AS h FROM snapshot_cel SEMI JOIN s USING (cel_id) WHERE source_frame = linked_source_frame AND octet_length(pixels) = width * height * 4 AND width >= 4),
g AS (SELECT DISTINCT cel_id, substr(h, 8 * (y * width + x) + 1, 32) AS gram FROM k, unnest(range(0, height)) AS a(y), unnest(range(0, width - 3)) AS b(x)),
o AS (SELECT * FROM g WHERE NOT regexp_full_match(gram, '(......00){4}')),
n AS (SELECT cel_id, count(*) AS n FROM o GROUP BY cel_id),
p AS (SELECT a.cel_id AS lo, b.cel_id AS hi, count(*) AS shared FROM o a JOIN o b ON a.gram = b.gram AND a.cel_id < b.cel_id GROUP BY ALL),
l AS (SELECT lo, hi, shared, x.n + y.n - shared AS grams FROM p JOIN n x ON x.cel_id = lo JOIN n y ON y.cel_id = hi WHERE 10 * shared >= 6 * (x.n + y.n - shared))
"""
_P3 = """WITH RECURSIVE c AS (SELECT * FROM snapshot_cel WHERE doc_id IS NOT NULL AND source_layer_id IS NOT NULL AND frame_index IS NOT NULL),
k AS (SELECT doc_id, source_layer_id, source_frame AS s, min(linked_source_frame) AS t FROM c WHERE source_frame <> linked_source_frame GROUP BY ALL),
r AS (SELECT doc_id, source_layer_id, s, t AS at FROM k UNION SELECT r.doc_id, r.source_layer_id, r.s, k.t FROM r JOIN k ON k.doc_id = r.doc_id AND k.source_layer_id = r.source_layer_id AND k.s = r.at),
e AS (SELECT r.doc_id, r.source_layer_id, r.s, coalesce(max(r.at) FILTER (WHERE k.s IS NULL), min(r.at) FILTER (WHERE y.s IS NOT NULL)) AS link FROM r
  LEFT JOIN k ON k.doc_id = r.doc_id AND k.source_layer_id = r.source_layer_id AND k.s = r.at LEFT JOIN r y ON y.doc_id = r.doc_id AND y.source_layer_id = r.source_layer_id AND y.s = r.at AND y.at = r.at GROUP BY ALL),
f AS (SELECT doc_id, frame_index, arg_max(coalesce(duration_ms, 0), ingested_at) AS ms FROM psd_frame GROUP BY ALL),
p AS (SELECT c.doc_id, c.source_layer_id, c.frame_index, x, y, opacity, width, height, coalesce(e.link, c.linked_source_frame) AS link, CASE WHEN octet_length(pixels) = width * height * 4 THEN hex(pixels) END AS h, f.ms
  FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, source_layer_id, frame_index ORDER BY cel_id, ingested_at DESC) = 1) c
  LEFT JOIN e ON e.doc_id = c.doc_id AND e.source_layer_id = c.source_layer_id AND e.s = c.linked_source_frame LEFT JOIN f ON f.doc_id = c.doc_id AND f.frame_index = c.frame_index),
q AS (SELECT *, lag({'f': frame_index, 'x': x, 'y': y, 'o': opacity, 'w': width, 'g': height, 'l': link, 'h': h}) OVER (PARTITION BY doc_id, source_layer_id ORDER BY frame_index) AS was FROM p),
b AS (SELECT *, coalesce(was.f = frame_index - 1 AND was.x = x AND was.y = y AND was.o = opacity AND (coalesce(was.l = link, false) OR coalesce(was.w = width AND was.g = height AND h IS NOT NULL AND was.h IS NOT NULL AND (was.h = h OR len(list_filter(range(0, width * height), lambda i: substr(h, 8 * i + 1, 8) <> substr(was.h, 8 * i + 1, 8))) <= 2), false)), false) AS again FROM q),
u AS (SELECT *, sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, source_layer_id ORDER BY frame_index) AS run FROM b)
SELECT doc_id, source_layer_id, min(frame_index)::INT AS first_frame, max(frame_index)::INT AS last_frame, count(*)::BIGINT AS cels, sum(coalesce(ms, 0))::BIGINT AS duration_ms FROM u GROUP BY doc_id, source_layer_id, run"""
ORACLE = {
    "p2_found": _P2 + "SELECT lo AS cel_id_lo, hi AS cel_id_hi FROM l",
    "p2_classes": _P2 + """, m AS (SELECT cel_id, string_agg(gram, '' ORDER BY gram) AS content FROM o GROUP BY cel_id),
c AS (SELECT cel_id, min(cel_id) OVER (PARTITION BY content) AS class_id, count(*) OVER (PARTITION BY content) AS members FROM m),
w AS (SELECT DISTINCT a.class_id AS a, b.class_id AS b FROM l JOIN c a ON a.cel_id = lo JOIN c b ON b.cel_id = hi WHERE a.class_id <> b.class_id)
SELECT cel_id, class_id, members, (SELECT count(DISTINCT CASE WHEN a = class_id THEN b ELSE a END) FROM w WHERE class_id IN (a, b)) AS links FROM c""",
    "p3_found": f"SELECT doc_id, source_layer_id, first_frame, last_frame FROM ({_P3}) WHERE cels >= 2",
    "p3_runs": _P3,
}
