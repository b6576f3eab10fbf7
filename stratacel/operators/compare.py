"""Row diffs, range joins and integrity checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def row_diff(left: DataFrame, right: DataFrame, keys: Names, fields: Names) -> DataFrame:
    """Full outer comparison by key: one row per key that is missing or differs, with what differs."""
    a = left.select(*keys, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("in_a"))
    b = right.select(*keys, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("in_b"))
    both = a.join(b, list(keys), "full_outer")
    unequal = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields])), ",")
    kind = F.when(F.col("in_b").isNull(), "missing_in_b").when(F.col("in_a").isNull(), "missing_in_a").otherwise(unequal)
    return both.select(*keys, kind.alias("difference")).where("difference <> ''")


def overlap_join(left: DataFrame, right: DataFrame, keys: Names, low: str, high: str, cell: int, condition: Column | None = None) -> DataFrame:
    """Pairs (a_*, b_*) of one key whose intervals [low, high) overlap, by an equi-join on grid cells.

    An interval stands in every cell of width ``cell`` it touches; a pair is taken only in the cell
    where the later of the two begins, so it comes out once and no cross product is made.
    """
    rename = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    cells = lambda p: F.explode(F.sequence(F.floor(F.col(f"{p}_{low}") / cell), F.floor((F.col(f"{p}_{high}") - 1) / cell)))
    a = rename(left.where(F.col(high) > F.col(low)), "a").withColumn("__cell", cells("a"))
    b = rename(right.where(F.col(high) > F.col(low)), "b").withColumn("__cell_b", cells("b"))
    on = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys] + [F.col("__cell") == F.col("__cell_b")]
    joined = a.join(b, on).where((F.col(f"a_{low}") < F.col(f"b_{high}")) & (F.col(f"b_{low}") < F.col(f"a_{high}")))
    joined = joined.where(F.col("__cell") == F.floor(F.greatest(F.col(f"a_{low}"), F.col(f"b_{low}")) / cell))
    return (joined if condition is None else joined.where(condition)).drop("__cell", "__cell_b")


def duplicate_keys(df: DataFrame, keys: Names) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(df: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose reference leads nowhere; a null reference leads nowhere to begin with and is left out."""
    return df.where(F.col(key).isNotNull()).join(target.select(F.col(target_key).alias("__key")).distinct(), F.col(key) == F.col("__key"), "left_anti")


def require_matched(left: DataFrame, right: DataFrame, keys: Names, what: str) -> DataFrame:
    """Inner join that is an error where the right side lacks a key of the left."""
    marked = right.withColumn("__there", F.lit(True))
    joined = left.join(marked, list(keys), "left")
    check = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit(f"{what}: "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))))
    return joined.where(F.coalesce(check.cast("boolean"), F.lit(True))).drop("__there")


def marker_status(markers: DataFrame, group: str = "doc_id") -> DataFrame:
    """Whether each document's markers are one whole, valid set: marked, valid, version, linked, local.

    markers: the group, version, role, logical_layer_id, variant_index, variant_count. Version 1 has
    wrappers (index 0, one per id) with variants 1..count; version 2 frame groups 1..count and
    layer copies 1..count for every id, of one shared count; version 3 frame groups within the
    count and one layer copy at least. Indexes lie in 1..count and don't repeat. The four highest
    ids mean linked or local layouts.
    """
    top = 0xFFFFFFFF
    keyed = markers.groupBy(group, "version", "role", "logical_layer_id").agg(
        F.count("*").alias("n"), F.count_distinct("variant_index").alias("different"), F.min("variant_index").alias("low"), F.max("variant_index").alias("high"),
        F.min("variant_count").alias("least_count"), F.max("variant_count").alias("most_count"),
    )
    whole = (F.col("n") == F.col("different")) & (F.col("least_count") == F.col("most_count")) & (F.col("low") >= 1) & (F.col("high") <= F.col("most_count"))
    full = whole & (F.col("n") == F.col("most_count"))
    wrapper = (F.col("role") == "wrapper") & (F.col("n") == 1) & (F.col("low") == 0)
    good = (
        F.when(F.col("version") == 1, F.when(F.col("role") == "wrapper", wrapper).when(F.col("role") == "variant", full))
        .when(F.col("version") == 2, F.when(F.col("role").isin("frame_group", "layer_copy"), full))
        .when(F.col("version") == 3, F.when(F.col("role") == "frame_group", whole).when(F.col("role") == "layer_copy", whole))
    )
    marked = keyed.withColumn("good", F.coalesce(good, F.lit(False)))
    per = marked.groupBy(group).agg(
        F.count_distinct("version").alias("versions"),
        F.max("version").alias("version"),
        F.bool_and("good").alias("good"),
        F.count_if(F.col("role") == "wrapper").alias("wrappers"),
        F.count_if(F.col("role") == "variant").alias("variants"),
        F.count_if(F.col("role") == "frame_group").alias("frames"),
        F.count_if(F.col("role") == "layer_copy").alias("copies"),
        F.count_distinct(F.when(F.col("version") == 2, F.col("most_count"))).alias("counts"),
        F.count_distinct(F.when(F.col("version") == 1, F.col("logical_layer_id"))).alias("layers"),
        F.bool_or(F.col("logical_layer_id").isin(top, top - 3)).alias("linked"),
        F.bool_or(F.col("logical_layer_id").isin(top - 2, top - 3)).alias("local"),
    )
    shape = (
        F.when(F.col("version") == 1, (F.col("wrappers") == F.col("variants")) & (F.col("wrappers") == F.col("layers")))
        .when(F.col("version") == 2, (F.col("frames") >= 1) & (F.col("copies") >= 1) & (F.col("counts") == 1))
        .otherwise((F.col("frames") >= 1) & (F.col("copies") >= 1))
    )
    return per.select(group, F.lit(True).alias("marked"), (F.col("good") & (F.col("versions") == 1) & shape).alias("valid"), "version", "linked", "local")


def changed_cells(left: Column, right: Column) -> Column:
    """How many places of two arrays of one length differ."""
    return F.size(F.filter(F.zip_with(left, right, lambda a, b: ~a.eqNullSafe(b)), lambda x: x))


def covered(df: DataFrame, keys: Names, start: str, end: str) -> DataFrame:
    """Sections and whether the next one begins where they end; the last one has no next."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    return df.withColumn("continues", F.lead(start).over(w) == F.col(end))
