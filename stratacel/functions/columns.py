"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT32 = 0xFFFFFFFF
FNV_OFFSET, FNV_PRIME = 0x811C9DC5, 0x01000193


def normalized_name(name: Column) -> Column:
    """Lower case, with every run of Unicode blanks one blank and none at the ends."""
    return F.lower(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")))


def is_generic_name(name: Column) -> Column:
    """A name that only numbers a layer."""
    return name.rlike(r"^(图层|layer) [0-9]+$")


def camel_words(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<=.)([A-Z])", " $1"))


def checked_integer(value: Column, low: int, high: int, what: str) -> Column:
    """A number as a whole one; a fraction or one out of range is an error, null stays null."""
    good = (value == F.floor(value)) & value.between(low, high)
    return F.when(value.isNull(), None).when(good, value.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), value.cast("string"))))


def quantised_opacity(value: Column) -> Column:
    """Opacity 0 to 1 as 0 to 255, halves away from zero."""
    return F.round(F.coalesce(value, F.lit(1.0)) * 255).cast("int")


def opacity_loses(value: Column) -> Column:
    return F.coalesce(value, F.lit(1.0)) * 255 != F.round(F.coalesce(value, F.lit(1.0)) * 255)


def canonical_duration(ms: Column) -> Column:
    """A duration in steps of ten milliseconds."""
    return (F.floor(ms / 10) * 10).cast("bigint")


def loop_mode(count: Column) -> Column:
    return F.when(count == 0, F.struct(F.lit("infinite").alias("tag"), F.lit(None).cast("bigint").alias("value"))).otherwise(
        F.struct(F.lit("finite").alias("tag"), count.cast("bigint").alias("value"))
    )


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a hash of the text's bytes, as a bigint."""
    byte = lambda i: F.conv(F.substring(F.hex(F.encode(text, "utf-8")), i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
    count = F.octet_length(text)
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    step = lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(INT32).cast("bigint"))
    return F.aggregate(places, F.lit(FNV_OFFSET).cast("bigint"), step)


def fallback_layer_id(layer_id: Column, path: Column) -> Column:
    """A stated id if it is a whole positive 32-bit number, else one made of the path, with the top bit set."""
    good = layer_id.isNotNull() & (layer_id == F.floor(layer_id)) & layer_id.between(1, INT32)
    return F.when(good, layer_id.cast("bigint")).otherwise(fnv1a32(path).bitwiseOR(F.lit(0x80000000).cast("bigint")))


def ratio_score(a: Column, b: Column) -> Column:
    """Ten times the ratio of the smaller to the larger, rounded; zero if either is zero."""
    return F.when((a == 0) | (b == 0), F.lit(0)).otherwise(F.round(F.least(a, b) / F.greatest(a, b) * 10)).cast("bigint")


def geometry_score(width: Column, height: Column, x: Column, y: Column, width2: Column, height2: Column, x2: Column, y2: Column) -> Column:
    """Likeness of size and place, 0 to 20."""
    near = F.least(F.abs(x - x2), F.lit(32)) + F.least(F.abs(y - y2), F.lit(32))
    place = F.lit(20) - F.least(near, F.lit(20))
    size = ratio_score(width, width2) + ratio_score(height, height2)
    return F.least(F.lit(20), F.floor(size / 2) + F.floor(place / 2)).cast("bigint")


def group_score(a: Column, b: Column) -> Column:
    """Likeness of two key paths: 20 equal, 12 with a common beginning, else 0."""
    begins = (F.size(a) > 0) & (F.size(b) > 0) & (F.element_at(a, 1) == F.element_at(b, 1))
    return F.when(a == b, 20).when(F.coalesce(begins, F.lit(False)), 12).otherwise(0)


def name_score(a: Column, b: Column, base_a: Column, base_b: Column) -> Column:
    """Likeness of two names of their own: 20 for equal ones, 5 for equal bases; a generic one has none."""
    own = ~is_generic_name(a) & ~is_generic_name(b)
    return F.when(own & (a == b), 20).when(own & (base_a == base_b), 5).otherwise(0)


def name_evidence_weight(generic: Column, suffixes: Column) -> Column:
    """What a name weighs as evidence: nothing if generic, half if it has copy suffixes (fixed values)."""
    return F.when(generic, 0).when(suffixes > 0, 15).otherwise(30)


def is_shared_background(name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(name)) == "background", F.lit(False))


def enum_suffix(value: Column, known: list[str], default: str) -> Column:
    """What follows the last full stop, in lower case, if it is known; another value stays, null is the default."""
    last = F.lower(F.substring_index(value, ".", -1))
    return F.when(value.isNull(), default).when(last.isin(known), last).otherwise(value)


def property_validity(kind: Column, background: Column, flags: Column) -> Column:
    """Whether a layer's opacity and blend mode count, by the header's flags: 1 for opacity, 2 for those of groups."""
    groups = flags.bitwiseAND(F.lit(2)) != 0
    plain, group = kind.isin("normal", "tilemap"), kind == "group"
    opacity = (flags.bitwiseAND(F.lit(1)) != 0) & (plain | (group & groups))
    return F.struct((~background & opacity).alias("opacity"), (~background & (plain | (group & groups))).alias("blend_mode"))


def present_fields(always: list[str], conditions: dict[str, Column]) -> Column:
    """The names of those fields that hold something, after those that are always named."""
    return F.array_compact(F.array(*[F.lit(x) for x in always], *[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items()]))


def rasterisable_mask(has_image: Column, obstacles: list[Column]) -> Column:
    """A mask with an image and none of what can't be drawn into the pixels."""
    free = has_image
    for o in obstacles:
        free = free & ~F.coalesce(o, F.lit(False))
    return F.coalesce(free, F.lit(False))


def cel_origin(place: Column, offset: Column, what: str) -> Column:
    """Place plus a whole offset, within 16 bits; anything else is an error."""
    return checked_integer(place + F.coalesce(offset, F.lit(0)), -32768, 32767, what)


def order_score(rank: Column, median: Column) -> Column:
    return F.greatest(F.lit(0), 20 - 4 * F.least(F.abs(rank - median), F.lit(5)))


def combined_score(name: Column, group: Column, order: Column, geometry: Column, pixels: Column, both_named: Column) -> Column:
    """All evidence as a part of what it could reach, 0 to 100."""
    total = name + group + order + geometry + pixels
    return F.least(F.lit(100), F.floor(total * 100 / F.when(both_named, 90).otherwise(70))).cast("bigint")


def effective_opacity(frame: Column, layer: Column) -> Column:
    return F.coalesce(frame, layer, F.lit(1.0))


def differs(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Floats that lie apart, or of which one is null."""
    return F.coalesce(F.abs(a - b) > tolerance, a.isNull() != b.isNull())


def meaningful_reference(x: Column, y: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """A finite point that isn't the centre of the bounds."""
    finite = ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    return F.coalesce(finite & ((F.abs(x - (left + right) / 2) > 1e-6) | (F.abs(y - (top + bottom) / 2) > 1e-6)), F.lit(False))


def path_key(path: Column) -> Column:
    """An index path as numbers, so that 10 comes after 2."""
    return F.transform(F.split(path, "/"), lambda x: x.cast("int"))


def display_path(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: F.when(F.coalesce(n, F.lit("")) == "", F.lit("<unnamed>")).otherwise(n)), "/")


def rectangle_area(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Area of a box; an inverted one is an error."""
    bad = (right < left) | (bottom < top)
    return F.when(bad, F.raise_error(F.lit("inverted box"))).otherwise((right - left).cast("bigint") * (bottom - top).cast("bigint"))
