"""Wiki markup: what a text shows, and where its markup lies.

Every step goes over the text once, whatever is left unclosed and however deep it nests: pairs are
matched by a moving pointer to the next closing mark, nested braces and brackets by a stack.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

OPEN_COMMENT = re.compile(r"<!--[^\n]*")
NOWIKI, NOWIKI_END = re.compile(r"<nowiki>", re.I), re.compile(r"</nowiki>", re.I)
REFERENCE, REFERENCE_END = re.compile(r"<ref\b[^<>]*>", re.I), re.compile(r"</ref\s*>", re.I)
OPEN_REFERENCE = re.compile(r"<ref\b[^\n]*", re.I)
#: A template, a parameter or a link that holds no other.
PLAIN_TEMPLATE = re.compile(r"\{\{\{[^{}]*+\}\}\}|\{\{[^{}]*+\}\}")
PLAIN_LINK = re.compile(r"\[\[([^\[\]\n]*+)\]\]")
BRACES = re.compile(r"\{+|\}+")
TABLE_EDGE = re.compile(r"^[ \t]*(?:(\{\|)|\|\})", re.M)
TABLE_FRAME = re.compile(r"^[ \t]*(?:\{\|.*|\|-.*|\|\})", re.M)
BRACKETS = re.compile(r"\[+|\]+")
FILE_OR_CATEGORY = re.compile(r"[^\S\n]*(?:file|image|category|media)[^\S\n]*:", re.I)
EXTERNAL = re.compile(r"\[(?:https?:)?//[^\s\[\]]*+([^\[\]\n]*+)\]")
TAG = re.compile(r"</?[a-zA-Z][^<>\n]*+>")
QUOTES = re.compile(r"'{2,}")


def _edited(text: str, edits: Iterable[tuple[int, int, str]]) -> str:
    """The text with (start, end, replacement) put in; the edits are in order and apart."""
    out, at = [], 0
    for start, end, new in edits:
        out.append(text[at:start])
        out.append(new)
        at = end
    out.append(text[at:])
    return "".join(out)


def _comments(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("<!--")
    while at >= 0:
        end = text.find("-->", at + 4)
        if end < 0:
            return
        yield at, end + 3
        at = text.find("<!--", end + 3)


def _paired(opening: re.Pattern, closing: re.Pattern, text: str) -> Iterator[tuple[re.Match, re.Match | None]]:
    """Each opening with the next closing after it; an opening that closes itself has none."""
    closers, at = closing.finditer(text), 0
    close = next(closers, None)
    for match in opening.finditer(text):
        if match.start() < at:
            continue
        if match.group().endswith("/>"):
            yield match, None
            continue
        while close and close.start() < match.end():
            close = next(closers, None)
        if close:
            yield match, close
            at = close.end()


def _references(text: str) -> Iterator[tuple[int, int]]:
    return ((a.start(), (b or a).end()) for a, b in _paired(REFERENCE, REFERENCE_END, text))


def _tables(text: str) -> Iterator[tuple[int, int]]:
    begin = None
    for match in TABLE_EDGE.finditer(text):
        if match.group(1) and begin is None:
            begin = match.start()
        elif not match.group(1) and begin is not None:
            yield begin, match.end()
            begin = None


def _templates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the outermost closed templates and parameters.

    A run of opening braces meets the next run of closing ones with no other brace between them:
    three close three, else two close two. A single brace that is left closes nothing and lets
    nothing close over it.
    """
    found: list[tuple[int, int]] = []
    stack: list[list[int]] = []  # end and number of the braces of a run
    for match in BRACES.finditer(text):
        start, end = match.span()
        if text[start] == "{":
            stack.append([end, end - start])
            continue
        left = end - start
        while left >= 2 and stack and stack[-1][1] >= 2:
            k = 3 if left >= 3 and stack[-1][1] >= 3 else 2
            left -= k
            begin = stack[-1][0] - k
            while found and found[-1][0] > begin:  # inside
                found.pop()
            found.append((begin, end - left))
            stack[-1][0], stack[-1][1] = begin, stack[-1][1] - k
            if not stack[-1][1]:
                stack.pop()
        if left:
            stack.clear()
    return found


class Link(NamedTuple):
    start: int
    end: int
    first: int  # the first and the last bar that is its own, or -1
    last: int


def _links(text: str) -> list[Link]:
    """The closed links in the order of their beginnings; a line break or a single bracket parts what could be one."""
    found: list[Link] = []
    stack: list[list] = []  # end and number of the brackets of a run, and its innermost link's bars
    at = 0
    for match in BRACKETS.finditer(text):
        start, end = match.span()
        if stack:
            if text.find("\n", at, start) >= 0:
                stack.clear()
            elif (bar := text.find("|", at, start)) >= 0:
                stack[-1][2] = bar if stack[-1][2] < 0 else stack[-1][2]
                stack[-1][3] = text.rfind("|", at, start)
        at = end
        if text[start] == "[":
            stack.append([end, end - start, -1, -1])
            continue
        left = end - start
        while left >= 2 and stack and stack[-1][1] >= 2:
            left -= 2
            top = stack[-1]
            found.append(Link(top[0] - 2, end - left, top[2], top[3]))
            top[:] = [top[0] - 2, top[1] - 2, -1, -1]
            if not top[1]:
                stack.pop()
        if left:
            stack.clear()
    return sorted(found)


def _link_edits(text: str, whole: Callable[[int], str], opening: Callable[[int], str], closing: str, last: bool) -> Iterator[tuple[int, int, str]]:
    """Edits that leave of a link what it shows, and of a file or category nothing."""
    edits, done = [], 0
    for link in _links(text):
        if link.start < done:  # in what another link doesn't show
            continue
        if FILE_OR_CATEGORY.match(text, link.start + 2):
            edits.append((link.start, link.end, whole(link.end - link.start)))
            done = link.end
            continue
        bar = link.last if last else link.first
        done = bar + 1 if bar >= 0 else link.start + 2
        edits.append((link.start, done, opening(done - link.start)))
        edits.append((link.end - 2, link.end, closing))
    return sorted(edits)


def shown_text(text: str) -> str:
    """The words that a reader sees: of a link the shown text; no references, comments or templates.

    What isn't closed stays as it is, but an unclosed comment or reference ends with its line.
    """
    if "<" in text:
        text = _edited(text, ((a, b, "") for a, b in _comments(text)))
        text = OPEN_COMMENT.sub("", text)
        text = _edited(text, ((a, b, "") for a, b in _references(text)))
        text = OPEN_REFERENCE.sub("", text)
    if "{{" in text:
        text = _edited(text, ((a, b, "") for a, b in _templates(text)))
    if "{|" in text:
        text = TABLE_FRAME.sub("", text)
    if "[[" in text:
        text = _edited(text, _link_edits(text, lambda n: " ", lambda n: "", "", True))
    if "[" in text:
        text = EXTERNAL.sub(r"\1", text)
    if "<" in text:
        text = TAG.sub("", text)
    if "''" in text:
        text = QUOTES.sub("", text)
    return html.unescape(text) if "&" in text else text


#: Stand-ins for markup, one for one character: they keep every position.
UNSEEN, PIECE, QUOTE, FILE, LINK_OPEN, LINK_CLOSE = (chr(0xE001 + i) for i in range(6))
STANDINS = UNSEEN + PIECE + QUOTE + FILE + LINK_OPEN + LINK_CLOSE
_LITERAL = re.compile(r"['\[\]{}<>|=*#:;]")


def _fill(char: str):
    return lambda match: char * (match.end() - match.start())


def _filled(text: str, spans: Iterable[tuple[int, int]], char: str) -> str:
    return _edited(text, ((a, b, char * (b - a)) for a, b in spans))


def _masked_link(match: re.Match) -> str:
    content = match.group(1)
    if FILE_OR_CATEGORY.match(content):
        return FILE * (len(content) + 4)
    target = content.find("|") + 1
    return LINK_OPEN * (2 + target) + content[target:] + LINK_CLOSE * 2


def _masked_external(match: re.Match) -> str:
    shown = match.group(1)
    return LINK_OPEN * (match.end() - match.start() - len(shown) - 1) + shown + LINK_CLOSE


def _nowiki_edits(text: str) -> Iterator[tuple[int, int, str]]:
    for a, b in _paired(NOWIKI, NOWIKI_END, text):
        inner = _LITERAL.sub(QUOTE, text[a.end() : b.start()])
        yield a.start(), b.end(), QUOTE * 8 + inner + QUOTE * 9


def masked(text: str) -> str:
    """The text with stand-ins of the same length for its markup.

    UNSEEN: comments and references; PIECE: templates and tables; QUOTE: marks of bold, italics and
    tags; FILE: file and category links; LINK_OPEN, LINK_CLOSE: the brackets and targets of links.
    """
    if "<" in text:
        text = _filled(text, _comments(text), UNSEEN)
        text = _edited(text, _nowiki_edits(text))
        text = _filled(text, _references(text), UNSEEN)
        text = OPEN_COMMENT.sub(_fill(UNSEEN), text)
        text = OPEN_REFERENCE.sub(_fill(UNSEEN), text)
    if "{{" in text:
        text = PLAIN_TEMPLATE.sub(_fill(PIECE), text)  # most of them
        if "{{" in text:
            text = _filled(text, _templates(text), PIECE)
    if "{|" in text:
        text = _filled(text, _tables(text), PIECE)
    if "[[" in text:
        text = PLAIN_LINK.sub(_masked_link, text)
        if "[[" in text:
            text = _edited(text, _link_edits(text, lambda n: FILE * n, lambda n: LINK_OPEN * n, LINK_CLOSE * 2, False))
    if "[" in text:
        text = EXTERNAL.sub(_masked_external, text)
    if "<" in text:
        text = TAG.sub(_fill(QUOTE), text)
    if "''" in text:
        text = QUOTES.sub(_fill(QUOTE), text)
    if "&nbsp;" in text:
        text = text.replace("&nbsp;", " " * 6)
    return text
