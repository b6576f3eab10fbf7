"""Sentence boundaries across languages and scripts.

Every position after a closing mark is decided by ordered pairs of regular expressions, one for the
text before and one for the text after; the first pair that fits says break or no break. The pairs
stand in tables that cascade: what the quotations and brackets around a mark say, lines of one case,
what holds for all languages, the languages of the text's script, then the defaults. Which tables
apply follows from the script, the stated language, the case of the line and the quotation or
bracket that the mark closes. Markup is replaced by stand-ins of equal length first, so positions
are those of the whole text.

No rule looks through a window: pairs see the line on both sides. The text before is matched
backwards from the position, so a pair costs what it matches, and a line is gone over once.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacel.llm.markup import FILE, LINK_CLOSE, LINK_OPEN, PIECE, QUOTE, STANDINS, UNSEEN, masked
from stratacel.session import spread

_ALNUM = re.compile(r"[^\W_]")
_HEADING = re.compile(r"\s*=+[^=].*=\s*$|\s*=+\s*$")
_REDIRECT = re.compile(r"\s*#\s*(?:redirect|weiterleitung|redirection|redirección|перенаправление|重定向|転送|تحويل|पुनर्प्रेषित|เปลี่ยนทาง)\b", re.I)
_FRAME = re.compile(r"\s*(?:\{\{|\{\||\|\}|\}\}|\||!)")
_MARKER = re.compile(r"\s*(?:[*#:;]+\s*|-{4,}\s*)?")
_BLANK = " \t\r\f\v  ᠎             　﻿​"
_HIDDEN = re.compile(f"[{STANDINS}]+")
_SEEN = re.compile(f"[^{STANDINS}]+")
_ANY_SEEN = re.compile(f"[^{STANDINS}]")
_LINK_EDGE = re.compile(f"{LINK_OPEN}+|{LINK_CLOSE}+")
#: Closing marks of sentences.
MARKS = ".!?…。！？．।॥؟۔｡"
#: Closing quotation marks and brackets that may follow a mark.
CLOSERS = "\"'”’»›)]）」』】》〉］｣"
_CANDIDATE = re.compile(rf"(?!(?<=[0-9])\.[0-9])(?!\.[a-z])[{re.escape(MARKS)}]+(?:[   ]?»|[{re.escape(CLOSERS)}]|[“‘](?=[\s{re.escape(MARKS)},;:]|$))*")
_THAI = re.compile(r"(?<=[฀-๿])[  　]+(?=[฀-๿])")
_ADDRESS = re.compile(r"(?:https?://|www\.|ftp://)[^\s<>\"“”«»]+|(?<![\w.+-])[\w.+-]++@[\w-]++\.[\w.-]+|(?<![\w-])[\w-]++\.[\w-]++/[^\s<>\"“”«»]+", re.I)
_PAIR = re.compile(r"[()（）\[\]“”„«»‘’「」『』\"]")
_CLOSE_OF = {"(": ")", "（": "）", "[": "]", "„": "“”", "“": "”", "«": "»", "‘": "’", "「": "」", "『": "』"}
_CLOSES = set("".join(_CLOSE_OF.values()))
#: What stands before a quotation that a colon introduces.
_INTRODUCED = regex.compile(r"(?r)[:：]\s*")


class Rule(NamedTuple):
    """Whether a position breaks whose text before and after fit; the first fitting rule decides.

    ``before`` is matched backwards from the position, ``after`` forwards; none fits everything.
    """

    breaks: bool
    before: regex.Pattern | None
    after: re.Pattern | None


def _rules(*rows: tuple[bool, str, str]) -> list[Rule]:
    return [Rule(b, regex.compile(f"(?r)(?:{before})") if before else None, re.compile(after) if after else None) for b, before, after in rows]


def _apart(text: str) -> str:
    """With the accents of Latin letters as characters of their own."""
    return "".join(unicodedata.normalize("NFD", c) if c.isalpha() else c for c in text)


def _bare(text: str) -> str:
    return "".join(c for c in _apart(text) if not "\u0300" <= c <= "\u036f")


def _words(text: str, blanks: bool = True) -> str:
    """Alternatives, in any case; with ``blanks`` the parts of an abbreviation may be set apart by one."""
    text += f" {_apart(text)} {_bare(text)}"  # as often typed
    dot = r"\.\s?" if blanks else r"\."
    return "(?i:" + "|".join(re.escape(w).replace(r"\.", dot) for w in sorted(set(text.split()), key=lambda w: (-len(w), w))) + ")"


_LOWER = r"[a-zß-öø-ÿœа-яёα-ω]"
_UPPER = r"[A-ZÀ-ÖØ-ÞŒА-ЯЁΑ-Ω]"
_OPEN = r"[“„«‘\"'(\[（「『¿¡]"
_SPACELESS_LETTER = r"[぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]"
#: A question or exclamation mark with the marks and closing marks of the same position.
_ASKED = rf"[!?！？][{re.escape(MARKS)}]*(?:\s?»|[{re.escape(CLOSERS)}])*"

#: Abbreviations before names or explanations, which end no sentence.
BOUND = {
    "en": "Dr Prof Mr Mrs Ms Mt Col Gen Lt Sgt Capt Rev Hon Gov Messrs St cf ca approx vs viz e.g i.e",
    "de": "Dr Prof Hr Fr Vgl vgl ca ggf bzw z.B d.h u.a sog evtl inkl St Str geb gest i.d.R",
    "fr": "MM Mme Mlle Mgr Dr Me cf env p.ex St Ste",
    "es": "Sr Sra Srta Sres Dr Dra Dña Prof Profa p.ej Ud Uds aprox EE Excmo Ilmo Gral",
    "ru": "им ул просп пл пер проф акад доц инж см ср напр т.е св",
    "hi": "डॉ श्री सुश्री प्रो पं कु",
    "ar": "أ",
}
#: Abbreviations before numbers.
NUMBERED = {
    "en": "No Nos no vol pp fig figs ch sec est Jan Feb Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec",
    "de": "Nr Abb Bd Bde Kap Art Abs Jg Anm Tab",
    "fr": "no nos pp vol chap art fig av apr janv févr avr juil sept oct nov déc",
    "es": "núm núms pág págs pp cap vol art fig av",
    "ru": "рис табл стр гл кв корп",
    "hi": "सं पृ",
    "ar": "",
}
#: Abbreviations that may end a sentence: they do before a capital, a number or an opening mark.
LOOSE = {
    "en": "etc Jr Ltd Co Inc Corp Bros al a.m p.m a.s.l U.K U.S U.N D.C Ph.D B.C A.D M.A B.A ft mi lb oz sq",
    "de": "usw etc Mio Mrd Jh Chr Min Std Tel GmbH e.V",
    "fr": "etc Cie J.-C St-M hab",
    "es": "etc UU Cía S.A a.C d.C hab JJ",
    "ru": "гг вв чел др пр тыс млн млрд руб коп км см кг мин ред изд",
    "hi": "ई किमी",
    "ar": "هـ",
}
#: The same with parts that may be set apart.
LOOSE_PARTS = {"ru": "н.э т.д т.п и.о", "de": "o.Ä u.Ä u.s.w"}
#: Those of them that end a sentence where capitals tell nothing, as in a text of one case.
FINAL = {"en": "etc Jr a.s.l", "de": "usw"}
#: Words after a number and a full stop that make it an ordinal.
ORDINAL = {
    "de": "Januar Jänner Februar Feber März April Mai Juni Juli August September Oktober November Dezember Jahrhundert Jahrhunderts Jahrhunderte Jh Jahrtausend Jahrtausends Jahrestag Platz Klasse Auflage Bezirk Infanterie Armee Division Stock Geburtstag",
}

_LATIN, _CYRILLIC = ("en", "de", "fr", "es"), ("ru",)


def _loose(name: str) -> str:
    parts = f"|{_words(LOOSE_PARTS[name])}" if name in LOOSE_PARTS else ""
    return f"(?:{_words(LOOSE[name], False)}{parts})"


COMMON = _rules(
    (False, r"\d[.．]", r"\d"),  # numbers and versions
    (False, r"(?:…|\.{2,}|。{2,})", rf"\s*(?:{_LOWER}|[぀-ヿ㐀-鿿])"),  # an ellipsis after which it goes on
    (False, r"", r"\s*[,;，；、،؛]|[:：]"),
    (False, r"", rf"\s*[—–-]+\s+{_LOWER}"),  # speech, then who speaks
    (False, rf"{_ASKED}(?:\s?»|[”’\"“‘)）」』›])", rf"\s*{_LOWER}"),  # a quotation, then who speaks
    (False, r"[^\W\d_]\.[)）]", rf"\s*{_LOWER}"),  # an abbreviation at the end of a bracket
)
ABBREVIATIONS = {
    name: _rules(
        *([(False, r"(?<!\d)(?<!\d )\b\d{1,2}\.", rf"\s+(?:{_words(ORDINAL[name])})\b")] if name in ORDINAL else []),
        (False, rf"(?<![^\W_]){_words(BOUND[name])}\.", r""),
        *([(False, rf"(?<![^\W_]){_words(NUMBERED[name])}\.", r"\s*[\d#№(]|\s*[IVXLC]+\b|\s*[Jj]\.-[Cc]")] if NUMBERED[name] else []),
        *([(True, rf"{_UPPER}{_LOWER}+,?\s[Ss]r\.", rf"\s+{_UPPER}")] if name == "en" else []),
        (True, rf"(?<![^\W_]){_loose(name)}\.", rf"\s+(?:{_UPPER}|\d|[“„«‘\"¿¡「]|[(\[（]\W*{_UPPER}|[؀-๿぀-鿿])|\s*$"),
        (False, rf"(?<![^\W_]){_loose(name)}\.", rf"\s*(?:{_LOWER}|[^\w\s])|\s+\S"),
    )
    for name in BOUND
}
SINGLE = _rules(
    (True, rf"\d\s?[^\W\d_][̀-ͯ]*\.", rf"\s*(?:{_UPPER}|{_OPEN})"),  # a unit, a year or a century after its number
    (False, r"(?<![^\W_])[^\W\d_][̀-ͯ]*\.", r"\s*(?:[^\W_]|[\-–(])"),  # an initial or a shortened word
    (False, rf"(?<![^\W_])(?:[^\W\d_][̀-ͯ]*\.){{2}}", rf"\s*(?:{_LOWER}|\d)"),
)
SPACELESS = _rules(
    (True, r"[。！？｡．][”’」』）》】]*", r"\s*$"),
    (True, r"[。！？!?｡]", r""),
)
DEFAULTS = _rules(
    (True, r"[।॥؟۔。！？｡]\S{0,3}", r""),
    (True, r"", r"\s"),
    (True, r"", rf"(?:{_UPPER}|{_OPEN}|[֐-๿぀-鿿가-힯])"),
    (True, rf"[!?…][{re.escape(MARKS)}]*[{re.escape(CLOSERS)}]*", r"\d"),
    (True, rf"(?:{_LOWER}{{2}}|\d{{2}}|[؀-๿])\.", rf"\d{{4}}\b"),
    (False, r"", r""),
)

#: Languages whose tables apply, by the script of what stands around a mark.
_BY_SCRIPT = {"latin": _LATIN, "cyrillic": _CYRILLIC, "devanagari": ("hi",), "arabic": ("ar",), "spaceless": (), "other": ()}


def _script(char: str) -> str:
    c = ord(char)
    if c < 0x250 or 0x1E00 <= c < 0x1F00:
        return "latin"
    if 0x400 <= c < 0x530:
        return "cyrillic"
    if 0x900 <= c < 0x980:
        return "devanagari"
    if 0x600 <= c < 0x780 or 0xFB50 <= c < 0xFE00:
        return "arabic"
    if 0x3040 <= c < 0xA000 or 0xF900 <= c < 0xFB00 or 0x20000 <= c < 0x40000:
        return "spaceless"
    return "other"


#: After the last mark of a line, and where a mark stands in a quotation or bracket that goes on.
END = _rules((True, r"", r"\s*$"))
HELD = _rules((False, r"", r""))
#: What a quotation or bracket that closes with the mark says, by what stands before it: a colon, nothing, or words.
SPAN_SPACELESS = {
    "introduced": _rules((True, r"", r"\s*[^\s\x00-\u024f\u1e00-\u1eff]")),
    "bracket alone": _rules((True, r"", r"\s*[^\s\x00-\u024f\u1e00-\u1eff]")),
    "other": _rules((False, r"", r"\s*[^\s\x00-\u024f\u1e00-\u1eff]")),
}
SPAN = {
    "bracket alone": _rules((False, r"", _SPACELESS_LETTER), (True, r"[)\]]", r"")),
    "other": _rules((False, r"", _SPACELESS_LETTER)),
}
_ANY_LOOSE = "(?<![^\\W_])(?:" + "|".join(_loose(n) for n in LOOSE) + r")\."
_ANY_FINAL = "(?<![^\\W_])(?:" + "|".join(_words(FINAL[n], False) for n in FINAL) + r")\."
_ELLIPSIS = r"(?:…|\.{3})"
_JOINS = r"\s*(?i:or|and|but|oder|und|aber|ou|et|mais|o|y|e|pero|или|и|а|но)\b"
#: Lines of one case, where no capital tells where a sentence begins: an ellipsis ends one unless a conjunction follows.
FLAT = _rules((True, _ANY_FINAL, r""), (False, _ELLIPSIS, _JOINS), (True, _ELLIPSIS, r""))
FLAT_SPAN = {
    "ends": _rules((True, _ASKED, r"(?!\s*[—–]\s)")),
    "goes on": _rules((False, _ASKED, r"(?!\s*[—–]\s)")),
}
CAPITALS = _rules((False, _ANY_LOOSE, r""), (False, r"", r"\s*[—–]\s"))


class Context(NamedTuple):
    """What decides which tables a position cascades through."""

    script: str
    lang: str
    shortened: bool  # the mark may end an abbreviation
    case: str  # of the line: "mixed", "upper" or "lower"
    span: str  # of the quotation or bracket that closes with the mark: "", "introduced", "alone" or "inner"
    bracket: str  # with which it opens: "", "ascii", "wide" or "quotation"


_CASCADES: dict[Context, list[Rule]] = {}


def cascade(context: Context) -> list[Rule]:
    """The tables in their order: ends of lines, quotations and brackets, lines of one case, common
    ones, the stated language, the other languages of the script, defaults.

    A stated language counts only where the script allows it, as labels can be wrong. The tables of
    abbreviations are left out where what stands before the mark can't be one.
    """
    if context not in _CASCADES:
        script, lang, shortened, case, span, bracket = context
        tables = [END]
        if span:
            alone = span == "alone" and bracket in ("ascii", "wide")
            if script == "spaceless":
                tables.append(SPAN_SPACELESS["introduced" if span == "introduced" else "bracket alone" if alone else "other"])
            tables.append(SPAN["bracket alone" if span == "alone" and bracket == "ascii" else "other"])
        if case != "mixed" and script in ("latin", "cyrillic"):
            tables.append(FLAT)
            if span:
                tables.append(FLAT_SPAN["ends" if span == "introduced" or bracket == "ascii" else "goes on"])
            if case == "upper":
                tables.append(CAPITALS)
        tables.append(COMMON)
        if script == "spaceless":
            tables.append(SPACELESS)
        if shortened:
            tables.extend(ABBREVIATIONS[n] for n in sorted(_BY_SCRIPT[script], key=lambda n: n != lang))
            tables.append(SINGLE)
        tables.append(DEFAULTS)
        _CASCADES[context] = [rule for rules in tables for rule in rules]
    return _CASCADES[context]


def _first_fit(rules: list[Rule], line: str, at: int) -> bool:
    for breaks, before, after in rules:
        if (after is None or after.match(line, at)) and (before is None or before.match(line, 0, at)):
            return breaks
    return True


#: Last parts of all abbreviations: a longer or other word before a full stop needs no table of them.
_SHORT = {w.split(".")[-1].lower() for table in (BOUND, NUMBERED, LOOSE, LOOSE_PARTS, {"": "Sr"}) for words in table.values() for w in words.split()}
_SHORT |= {f(w) for w in _SHORT for f in (_apart, _bare)}
_WORD_BEFORE = regex.compile(r"(?r)[\p{L}\u0300-\u036f]*+")
#: A whole word before a capital: with a mark that no table of abbreviations knows, it breaks by the defaults.
_PLAIN = re.compile(rf"\s+{_UPPER}{_LOWER}")


def _spans(line: str) -> list[tuple[int, int]]:
    """(open, close) of the quotations and brackets that close in the line, outer ones first."""
    out, stack, awaited = [], [], Counter()  # awaited: closing characters to the open ones they would close
    for match in _PAIR.finditer(line):
        char, at = match.group(), match.start()
        if char == '"':
            if stack and stack[-1][0] == '"':
                out.append((stack.pop()[1], at))
            else:
                stack.append(('"', at))
            continue
        if char == "’" and line[at + 1 : at + 2].isalpha() and line[at - 1 : at].isalpha():
            continue  # an apostrophe
        if awaited[char] > 0:
            while True:
                opened, begin = stack.pop()
                awaited.subtract(_CLOSE_OF.get(opened, ""))
                if char in _CLOSE_OF.get(opened, ""):
                    out.append((begin, at))
                    break
        elif char in _CLOSE_OF:
            stack.append((char, at))
            awaited.update(_CLOSE_OF[char])
    return sorted(out)


def _letters_around(line: str, found: list[tuple[int, int]]) -> list[str]:
    """The letter nearest before each mark, else the nearest after it, by which its script is known."""
    out, last, at = [], "", 0
    for a, b in found:
        last = next((c for c in reversed(line[at:a]) if c.isalpha()), last)
        out.append(last)
        at = b
    if found and not out[0]:
        after = next((c for c in line[found[0][1] :] if c.isalpha()), "a")
        out = [c or after for c in out]
    return out


def _breaks(line: str, lang: str) -> list[int]:
    """Positions after which a new sentence begins, in a line without markup.

    One sweep over the marks and the quotations and brackets in their order. What closes with a
    mark is decided where it opens, as all that it depends on lies before: then a mark inside knows
    whether its sentence can end there.
    """
    found = [m.span() for m in _CANDIDATE.finditer(line)]
    if not found:
        return []
    if "/" in line or "www" in line.lower() or "@" in line:  # marks inside addresses aren't marks
        hidden = bytearray(len(line))
        for match in _ADDRESS.finditer(line):
            end = match.end()
            while end > match.start() and line[end - 1] in ".,;:!?)…'’”\"":
                end -= 1
            hidden[match.start() : end] = b"\1" * (end - match.start())
        found = [(a, b) for a, b in found if not hidden[a]]
    spans = _spans(line) if _PAIR.search(line) else []
    starts = [a for a, _ in found]
    closing, own = {}, {}  # a span's end to the mark that it closes with; a mark to its outermost such span
    for lo, close in spans:
        k = bisect_left(starts, close) - 1
        if k >= 0 and close < found[k][1]:
            closing[close] = k
            own.setdefault(k, lo)
    letters: list[str] = []  # made when the first mark wants the tables
    case = "upper" if line.isupper() else "lower" if line.islower() else "mixed"
    size = len(line.rstrip())
    known: dict[int, bool] = {}
    open_spans: list[tuple[int, bool]] = []  # end, and whether a sentence may end inside
    begin = passed = 0  # where the sentence begins; marks whose place is reached

    def decide(k: int) -> bool:
        a, b = found[k]
        for close, free in reversed(open_spans):
            if close >= b:
                return free and rule(k, a, b)
        return rule(k, a, b)

    def rule(k: int, a: int, b: int) -> bool:
        if b >= size:
            return True  # as the first table says
        first = a
        if line[a] == ".":
            first = _WORD_BEFORE.match(line, 0, a).start()
        shortened = line[a] == "." and (a - first < 2 or (word := line[first:a].lower()) in _SHORT or len(_bare(word)) < 2)
        if b == a + 1 and line[a] in ".!?" and not shortened and _PLAIN.match(line, b):
            return True
        span = bracket = ""
        if k in own:
            lo = own[k]
            bracket = {"(": "ascii", "[": "ascii", "（": "wide"}.get(line[lo], "quotation")
            span = "introduced" if _INTRODUCED.match(line, 0, lo) else "inner" if line[begin:lo].strip() else "alone"
        if not letters:
            letters.extend(_letters_around(line, found))
        return _first_fit(cascade(Context(_script(letters[k]), lang, shortened, case, span, bracket)), line, b)

    if not spans:
        return [b for k, (a, b) in enumerate(found) if rule(k, a, b)]
    events = sorted([(lo, 0, i) for i, (lo, _) in enumerate(spans)] + [(a, 1, k) for k, a in enumerate(starts)])
    for at, is_mark, i in events:
        while open_spans and open_spans[-1][0] < at:
            open_spans.pop()
        while passed < len(found) and found[passed][1] <= at:
            begin = found[passed][1] if known[passed] else begin
            passed += 1
        if is_mark:
            if i not in known:
                known[i] = decide(i)
            continue
        close = spans[i][1]
        k = closing.get(close)
        if k is not None and k not in known:
            known[k] = decide(k)
        open_spans.append((close, k is not None and known[k]))
    return [b for k, (_, b) in enumerate(found) if known[k]]


def _line_sentences(line: str, base: int, lang: str) -> Iterator[tuple[int, int]]:
    """Sentences of a masked line that begins at ``base``."""
    size = len(line)
    if _HIDDEN.search(line):
        where = [m.span() for m in _SEEN.finditer(line)]
        text = "".join([line[a:b] for a, b in where])
    else:
        where, text = None, line
    cuts = set(_breaks(text, lang))
    cuts |= {m.start() for m in _THAI.finditer(text)}
    edges = [(m.start(), line[m.start()]) for m in _LINK_EDGE.finditer(line)] if where is not None and LINK_CLOSE in line else []
    begin = part = before = 0  # before: characters that are seen before the part
    for cut in sorted(cuts):
        if where is None:
            end = cut
        else:
            while before + where[part][1] - where[part][0] < cut:
                before += where[part][1] - where[part][0]
                part += 1
            end = where[part][0] + cut - before
            if edges and _in_link(line, end, edges):
                continue
            end = _attached(line, end, begin)
        yield from _trimmed(line, begin, end, base)
        begin = end
    yield from _trimmed(line, begin, size, base)


def _in_link(line: str, at: int, edges: list[tuple[int, str]]) -> bool:
    """Whether the shown text of a link goes on after a position: the next edge closes a link, and not at once."""
    k = bisect_left(edges, (at, ""))
    if k == len(edges) or edges[k][1] != LINK_CLOSE:
        return False
    seen = _ANY_SEEN.search(line, at)
    return seen is not None and seen.start() < edges[k][0]


def _attached(line: str, at: int, begin: int) -> int:
    """The end of a sentence together with the stand-ins attached to its mark."""
    end = at
    while end < len(line) and line[end] in STANDINS:
        end += 1
    if end == at or end == len(line) or line[end] in _BLANK:
        return end
    # The next sentence follows without a blank: opening marks are its own.
    last = at
    for i in range(at, end):
        char = line[i]
        if char in (UNSEEN, PIECE, LINK_CLOSE):
            last = i + 1
        elif char == QUOTE and last == i and len(re.findall(f"{QUOTE}+", line[begin:i])) % 2:
            while last < end and line[last] == QUOTE:
                last += 1
    return last


def _trimmed(line: str, begin: int, end: int, base: int) -> Iterator[tuple[int, int]]:
    while begin < end and (line[begin] in _BLANK or line[begin] == FILE):
        begin += 1
    while end > begin and (line[end - 1] in _BLANK or line[end - 1] == FILE):
        end -= 1
    if _ALNUM.search(line, begin, end):
        yield base + begin, base + end


def sentences(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, in code points, end exclusive and in order."""
    if not text:
        return []
    lang = (lang or "").lower()[:2]
    out: list[tuple[int, int]] = []
    at = 0
    for line in masked(text).split("\n"):
        base, at = at, at + len(line) + 1
        if not _ALNUM.search(line):
            continue
        bare = line.lstrip(STANDINS + _BLANK)
        if bare[0] in "=#{|}!" and (_HEADING.match(_HIDDEN.sub("", bare)) or _REDIRECT.match(bare) or _FRAME.match(bare)):
            continue
        skip = _MARKER.match(line).end()
        out.extend(_line_sentences(line[skip:], base + skip, lang))
    return out


def split_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """Sentences of every text: the key, start_char and end_char (code points, end exclusive).

    Each line of prose and each list item holds at least one sentence; headings, tables, block
    templates, redirects, category and file links, comments, rules and lines without a letter or
    digit hold none. Null and empty texts hold none; a null or wrong language only changes the
    order of the tables; texts that stand in several rows are split in each, and equal rows give
    equal rows once; an empty table gives an empty result; other columns are never read.
    """
    language = F.col(lang) if lang else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), language.alias("lang"))
    schema = rows.select("key").schema.add("start_char", "long").add("end_char", "long")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans = [], []
            for body, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                own = sentences(body, name)
                counts.append(len(own))
                spans.extend(own)
            flat = np.array(spans, dtype=np.int64).reshape(-1, 2)
            owner = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(owner), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["key", "start_char", "end_char"]
            )

    return spread(rows).mapInArrow(split, schema).withColumnRenamed("key", key)
