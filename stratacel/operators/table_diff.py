"""Differences between two copies of one dataset, field by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacel.session import partitions_for

#: Bytes of the estimated input that one hash bucket may hold.
BUCKET_BYTES = 4 << 20
#: Slack for decimal tolerances that binary floats can't hold.
EPSILON = 1e-9


@dataclass(frozen=True)
class Compared:
    """A compared field: how to bring it to a comparable form, and how far values may lie apart.

    ``canonical`` maps the column to a form in which equal means the same; ``tolerance`` makes the
    comparison numeric.
    """

    canonical: object = None
    tolerance: float | None = None

    def form(self, column: Column) -> Column:
        return column if self.canonical is None else self.canonical(column)


def letters_only(column: Column) -> Column:
    """A word whatever its case, blanks, underscores and hyphens."""
    return F.regexp_replace(F.lower(column), r"(?U)[\s_\-]+", "")


def unordered(column: Column, element) -> Column:
    """An array as the multiset of its elements; null stays null."""
    text = F.transform(column, lambda x: F.coalesce(F.to_json(element(x)), F.lit("null")))
    return F.array_join(F.array_sort(text), "\n")


def latest(df: DataFrame, keys: Sequence[str], order_by: str, values: Mapping[str, Column]) -> DataFrame:
    """Of the rows with one key the one with the greatest ``order_by``.

    Partial aggregation keeps one row per key and map task, so a key that holds a large part of
    the rows isn't gathered. Null order values come first; ties fall to the greatest values in the
    order given, so the choice doesn't depend on the order of the rows.
    """
    row = F.struct(F.col(order_by).alias("at"), *[v.alias(f"v{i}") for i, v in enumerate(values.values())])
    top = df.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.max(row).alias("row"))
    return top.select(
        *[f"k{i}" for i in range(len(keys))], *[F.col(f"row.v{i}").alias(f"v{i}") for i in range(len(values))]
    )


def _codes(left: pa.Table, right: pa.Table, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """One integer per distinct key of both tables, equal for equal keys; null is a value."""
    codes = np.zeros(left.num_rows + right.num_rows, dtype=np.int64)
    for i in range(n_keys):
        both = pa.chunked_array(left.column(f"k{i}").chunks + right.column(f"k{i}").chunks, type=left.schema.field(f"k{i}").type)
        encoded = both.combine_chunks().dictionary_encode(null_encoding="encode")
        if isinstance(encoded, pa.ChunkedArray):
            encoded = encoded.combine_chunks()
        codes = codes * (len(encoded.dictionary) + 1) + encoded.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)  # keeps the product small
    return codes[: left.num_rows], codes[left.num_rows :]


def _differs(a: pa.ChunkedArray, b: pa.ChunkedArray, tolerance: float | None) -> np.ndarray:
    """Null equals null only."""
    null_a, null_b = (np.asarray(pc.is_null(x)) for x in (a, b))
    if tolerance is None:
        unequal = np.asarray(pc.fill_null(pc.not_equal(a, b), False))
    else:
        x, y = (np.asarray(pc.fill_null(v.cast(pa.float64()), 0.0)) for v in (a, b))
        with np.errstate(invalid="ignore"):
            unequal = np.abs(x - y) > tolerance + EPSILON
        unequal |= np.isnan(x) != np.isnan(y)
    return (null_a != null_b) | (unequal & ~null_a & ~null_b)


def diff_bucket(left: pa.Table, right: pa.Table, n_keys: int, names: Sequence[str], tolerances: Sequence[float | None], key_types) -> pa.Table:
    """Findings of one hash bucket: keys, finding. Every key occurs once on a side at most."""
    lc, rc = _codes(left, right, n_keys)
    order = np.argsort(lc, kind="stable")
    at = np.searchsorted(lc[order], rc)
    there = at < len(lc)
    there[there] = lc[order][at[there]] == rc[there]
    matched_left, matched_right = order[at[there]], np.flatnonzero(there)
    only_left = np.ones(len(lc), dtype=bool)
    only_left[matched_left] = False
    key_names = [f"k{i}" for i in range(n_keys)]
    parts = [
        (left.select(key_names).filter(pa.array(only_left)), "only_in_a"),
        (right.select(key_names).filter(pa.array(~there)), "only_in_b"),
    ]
    a, b = left.take(pa.array(matched_left)), right.take(pa.array(matched_right))
    for i, (name, tolerance) in enumerate(zip(names, tolerances)):
        mask = _differs(a.column(f"v{i}"), b.column(f"v{i}"), tolerance)
        parts.append((a.select(key_names).filter(pa.array(mask)), name))
    arrays = [pa.concat_arrays([c for t, _ in parts for c in t.column(k).chunks] or [pa.array([], type=kt)]).cast(kt) for k, kt in zip(key_names, key_types)]
    finding = pa.array(np.repeat([n for _, n in parts], [t.num_rows for t, _ in parts]).tolist(), type=pa.string())
    return pa.Table.from_arrays([*arrays, finding], names=[*key_names, "finding"])


def diff_tables(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    fields: Mapping[str, Compared],
    order_by: str,
) -> DataFrame:
    """Rows missing on a side and differing fields of two copies of a table.

    Both sides are cut to their latest row per key (see ``latest``), sent to hash buckets of the
    whole key, and compared bucket by bucket as Arrow tables: keys are aligned by sorted search,
    fields compared under null-aware masks, and the masked cells come out. The number of buckets
    follows the estimated size of the inputs, so a bucket stays small at any scale.

    Returns the keys and ``finding``: ``only_in_a``, ``only_in_b`` or a field's name. Null keys are
    values like any other; null equals null only; repeated rows count once; an empty side makes
    every key of the other side a finding; columns that aren't named are never read.
    """
    names, tolerances = list(fields), [f.tolerance for f in fields.values()]
    n = len(keys)
    sides = []
    for df in (left, right):
        row = latest(df, keys, order_by, {name: f.form(F.col(name)) for name, f in fields.items()})
        sides.append(row)
    buckets = max(partitions_for(left, BUCKET_BYTES), partitions_for(right, BUCKET_BYTES))
    key_names = [f"k{i}" for i in range(n)]
    bucketed = [s.withColumn("bucket", F.pmod(F.xxhash64(*key_names), F.lit(buckets))) for s in sides]
    from pyspark.sql.pandas.types import to_arrow_type

    key_types = [to_arrow_type(sides[0].schema[k].dataType) for k in key_names]

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        return diff_bucket(a, b, n, names, tolerances, key_types)

    schema = sides[0].select(*key_names).schema.add("finding", "string")
    found = bucketed[0].groupBy("bucket").cogroup(bucketed[1].groupBy("bucket")).applyInArrow(compare, schema)
    return found.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "finding")
