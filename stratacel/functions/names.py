"""Layer names: copy suffixes and the family a name belongs to."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffix tokens with language and kind, in the order in which they are tried (fixed values).
COPY_SUFFIXES = (
    ("copy", "en", "copy"),
    ("duplicate", "en", "duplicate"),
    ("clone", "en/fr/it/pt", "clone"),
    ("拷贝", "zh", "copy"),
    ("副本", "zh", "copy"),
    ("复制", "zh", "duplicate"),
    ("克隆", "zh", "clone"),
    ("コピー", "ja", "copy"),
    ("複製", "ja", "duplicate"),
    ("クローン", "ja", "clone"),
    ("복사", "ko", "copy"),
    ("사본", "ko", "copy"),
    ("복제", "ko", "duplicate"),
    ("클론", "ko", "clone"),
    ("копия", "ru", "copy"),
    ("копія", "uk", "copy"),
    ("дубликат", "ru", "duplicate"),
    ("клон", "ru", "clone"),
    ("kopie", "de/nl/cs", "copy"),
    ("duplikat", "de/pl", "duplicate"),
    ("klon", "de/pl", "clone"),
    ("duplicaat", "nl", "duplicate"),
    ("kloon", "nl", "clone"),
    ("copie", "fr", "copy"),
    ("dupliqué", "fr", "duplicate"),
    ("copia", "es/it", "copy"),
    ("duplicado", "es/pt", "duplicate"),
    ("duplicato", "it", "duplicate"),
    ("clon", "es", "clone"),
    ("cópia", "pt", "copy"),
    ("kopia", "pl/sv", "copy"),
    ("kopi", "da/no", "copy"),
    ("kopio", "fi", "copy"),
    ("másolat", "hu", "copy"),
    ("αντίγραφο", "el", "copy"),
)
#: Rounds of stripping; a name that would need another is reported.
MAX_SUFFIXES = 8
MAX_ORDINAL = 0xFFFFFFFF

_SEPARATORS = "-_.([{"
_AFTER = r"\s*(?:[-_.]*#?\s*([0-9]+)\s*)?(?:[)\]}]\s*)*"
#: A token is a suffix at the end, after a separator or blank, with an optional number.
_PATTERNS = [(re.compile(rf"(.*[\s{re.escape(_SEPARATORS)}]){re.escape(token)}{_AFTER}", re.S), token) for token, _, _ in COPY_SUFFIXES]


class ParsedName(NamedTuple):
    normalized: str
    base: str
    tokens: list[str]
    ordinals: list[int | None]
    limit_reached: bool


def _strip_once(name: str) -> tuple[str, str, int | None] | None:
    for pattern, token in _PATTERNS:
        match = pattern.fullmatch(name) if token in name else None
        if match is None:
            continue
        ordinal = int(match.group(2)) if match.group(2) else None
        base = match.group(1).rstrip(_SEPARATORS).rstrip()
        if base and (ordinal is None or ordinal <= MAX_ORDINAL):
            return base, token, ordinal
    return None


def parse_name(name: str) -> ParsedName:
    """The name without its copy suffixes. A name that is only a suffix keeps it."""
    normalized = base = " ".join(name.split()).lower()
    tokens: list[str] = []
    ordinals: list[int | None] = []
    found = _strip_once(base)
    while found and len(tokens) < MAX_SUFFIXES:
        base, token, ordinal = found
        tokens.append(token)
        ordinals.append(ordinal)
        found = _strip_once(base)
    return ParsedName(normalized, base, tokens, ordinals, found is not None)


PARSED = "struct<normalized:string,base:string,tokens:array<string>,ordinals:array<bigint>,limit_reached:boolean>"


def parsed_name(column: Column) -> Column:
    """``parse_name`` as a column, in Arrow batches; null stays null."""

    @F.pandas_udf(PARSED)
    def parse(names: pd.Series) -> pd.DataFrame:
        known: dict = {}
        for name in names:
            if name is not None and name not in known:
                known[name] = parse_name(name)
        rows = [known.get(name) if name is not None else None for name in names]
        return pd.DataFrame([r if r is not None else ParsedName(None, None, None, None, None) for r in rows], columns=ParsedName._fields)

    return parse(column)


#: Blend modes by the names of two formats (fixed values).
BLEND_MODES = (
    "normal", "pass through", "darken", "multiply", "color burn", "linear burn", "darker color", "lighten", "screen", "color dodge",
    "linear dodge", "lighter color", "overlay", "soft light", "hard light", "vivid light", "linear light", "pin light", "hard mix",
    "difference", "exclusion", "subtract", "divide", "hue", "saturation", "color", "luminosity",
)


def known_blend_mode(column: Column) -> Column:
    """A blend mode in its plain spelling, whatever its case, blanks, ``_`` or ``-``; null if unknown."""
    from stratacel.operators.table_diff import letters_only

    table = F.create_map(*[F.lit(x) for name in BLEND_MODES for x in (name.replace(" ", ""), name)])
    return F.element_at(table, letters_only(column))
