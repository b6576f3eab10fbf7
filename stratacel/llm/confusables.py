"""One consistent form for text that looks the same but is made of different characters."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacel.session import materialize

#: Accent-sensitive and case-sensitive Unicode collation.
COLLATION = "UNICODE"
#: Compatibility decompositions that don't change how a character looks, by their tag.
SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Characters without a visible form besides those of category Cf (fixed by the Unicode standard).
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180f\u3164\uffa0\ufe00-\ufe0f\U000e0100-\U000e01ef"
#: Stands between the letters whose look-alikes are asked for in one call.
BETWEEN = "\ue000"
#: Members of a group of look-alikes that one task pairs with all the others.
SALT_ROWS = 2_000
#: Alphabets whose letters aren't asked for: jamo join into syllables, modifiers differ by place.
NOT_ASKED = ("HANGUL", "MODIFIER")


def _alphabet(letter: str) -> str:
    return unicodedata.name(letter, "?").split(" ")[0]


@lru_cache(maxsize=1)
def _classes(skeletons: tuple[tuple[str, str], ...]) -> dict[str, str]:
    groups = defaultdict(list)
    for letter, skeleton in skeletons:
        kind = unicodedata.category(letter)
        if kind not in ("Lu", "Ll"):  # a letter without case is of the case of the letter it is drawn like
            kind = unicodedata.category(skeleton) if len(skeleton) == 1 else ""
        groups[skeleton, kind if kind in ("Lu", "Ll") else ""].append(letter)
    table = {}
    for letters in groups.values():
        if len({_alphabet(x) for x in letters}) > 1:
            plain = [x for x in letters if x.isascii()] or letters
            table.update({x: min(plain) for x in letters if x != min(plain)})
    return table


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letter to the letter of another alphabet that stands for all of its shape and case.

    The classes come from the confusable data of the ICU library that Spark itself brings, asked
    on the driver in one call. Only undecomposable letters count, and of Latin only ASCII: letters
    of one alphabet (I and l, a and ɑ) look alike to that data but aren't other scripts' shapes.
    """
    letters = [
        x
        for x in map(chr, range(0x41, 0x30000))
        if unicodedata.category(x)[0] == "L" and not unicodedata.decomposition(x) and (x.isascii() or _alphabet(x) not in ("LATIN", *NOT_ASKED))
    ]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    shapes = checker.getSkeleton(BETWEEN.join(letters)).split(BETWEEN)
    if len(shapes) != len(letters):
        raise ValueError("the look-alikes don't fit the letters asked for")
    return _classes(tuple(zip(letters, shapes)))


@lru_cache(maxsize=1)
def _compatible() -> dict[str, str]:
    """Full- and half-width forms, ligatures, presentation forms, radicals and blanks to their plain ones."""
    table = {}
    for x in map(chr, range(0xA0, 0x30000)):
        tag, _, codes = unicodedata.decomposition(x).partition(" ")
        if tag in SAME_LOOK and not "\u3131" <= x <= "\u318e":  # those letters don't join as their plain ones do
            plain = "".join(chr(int(c, 16)) for c in codes.split())
            if len(plain) == 1 or all(unicodedata.category(c)[0] == "L" for c in plain):
                table[x] = plain
    return table


_BLANKS = re.compile(r"[\s\u2800]+")
_UNSEEN = re.compile(f"[{INVISIBLE}]")


def visible_form(text: str | None, alike: dict[str, str]) -> str | None:
    """The text as it looks: equal for texts that differ only in characters of the same look."""
    if text is None:
        return None
    if not text.isascii():
        plain = _compatible()
        text = "".join(plain.get(c, c) for c in text)
        text = "".join(plain.get(c, c) for c in text)  # a ligature may hold another such form
        text = _UNSEEN.sub("", text)
    text = "".join(c for c in text if c.isspace() or unicodedata.category(c) not in ("Cf", "Cc"))
    text = _BLANKS.sub(" ", text).strip(" ")
    if text.isascii():
        return text
    text = "".join(alike.get(c, c) for c in unicodedata.normalize("NFD", text))
    return unicodedata.normalize("NFC", text)


def form_of(spark: SparkSession, column: Column) -> Column:
    """``visible_form`` as a column, in Arrow batches."""
    alike = look_alikes(spark)

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        known: dict = {}
        for text in texts:
            if text not in known:
                known[text] = visible_form(text, alike)
        return texts.map(known, na_action="ignore")

    return form(column)


def canonical_forms(texts: DataFrame, column: str) -> DataFrame:
    """Distinct texts with their look: columns text, form, canonical.

    Distinct texts are mapped to their visible form, grouped under an accent-sensitive Unicode
    collation, and the canonical member of each class is joined back: a text that is its own form
    before others, then the lowest by code points. Null has no form and doesn't come out. The forms,
    which Python makes, and the result are written once, as several joins read them.
    """
    spark = texts.sparkSession
    distinct = texts.where(F.col(column).isNotNull()).select(F.col(column).alias("text")).distinct()
    mapped = materialize(distinct.select("text", form_of(spark, F.col("text")).alias("form")), "forms")
    canonical = spark.sql(
        f"""
        WITH classes AS (
            SELECT collate(form, '{COLLATION}') AS look, min(struct(text <> form AS altered, text)).text AS canonical
            FROM {{mapped}} GROUP BY collate(form, '{COLLATION}')
        )
        SELECT m.text, m.form, c.canonical FROM {{mapped}} m JOIN classes c ON collate(m.form, '{COLLATION}') = c.look
        """,
        mapped=mapped,
    )
    return materialize(canonical, "canonical")


def consistent(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with ``<column>_canonical`` beside each of the text columns; null stays null.

    Texts that look the same get the same canonical text, over all the columns together: a name
    and a suffix can be compared. Repeated rows stay; an empty table stays empty; an existing
    column of that name is replaced.
    """
    spark = rows.sparkSession
    every = None
    for name in columns:
        part = rows.select(F.col(name).alias("text"))
        every = part if every is None else every.unionByName(part)
    forms = canonical_forms(every, "text")
    out = rows
    for name in columns:
        out = out.drop(f"{name}_canonical")
        own = forms.select(F.col("text").alias("__text"), F.col("canonical").alias(f"{name}_canonical"))
        out = out.join(own, F.col(name) == F.col("__text"), "left").drop("__text")
    return out


def look_alike_pairs(rows: DataFrame, key: str, group: str, column: str, latest: str) -> DataFrame:
    """Pairs lo < hi of keys in one group whose texts look the same but aren't the same code points.

    Of repeated keys the latest row counts (ties: the greatest text). Null keys, groups or texts
    make no pair. Groups of one look are salted by their size before they are paired.
    """
    once = (
        rows.where(F.col(key).isNotNull() & F.col(group).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(F.struct(F.col(latest), F.col(column).alias("text"), F.col(group).alias("group"))).alias("row"))
        .select("key", "row.text", "row.group")
        .where("text IS NOT NULL")
    )
    forms = canonical_forms(once, "text")
    looks = materialize(once.join(forms, "text").select("key", "group", "text", "form", "canonical"), "looks")
    sizes = looks.groupBy("group", "canonical").agg(
        F.count("*").alias("n"), F.min("text").alias("least"), F.max("text").alias("most")
    )
    sizes = sizes.where("least <> most").select("group", "canonical", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("parts"))
    mixed = looks.join(sizes, ["group", "canonical"])
    salted = mixed.withColumn("salt", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    rest = F.explode(F.sequence(F.col("salt"), F.col("parts") - 1))  # parts of a group are paired with parts
    left = salted.withColumn("with", rest)
    right = salted.select(
        "group", "canonical", F.col("key").alias("other"), F.col("text").alias("other_text"), F.col("form").alias("other_form"),
        F.col("salt").alias("with"), F.explode(F.sequence(F.lit(0), F.col("salt"))).alias("salt"),
    )
    pairs = left.join(right, ["group", "canonical", "salt", "with"]).where("text <> other_text AND form = other_form AND (salt <> with OR key < other)")
    pairs = pairs.select(F.least("key", "other").alias("key"), F.greatest("key", "other").alias("other"))
    return pairs.select(F.col("key").alias("lo"), F.col("other").alias("hi"))
