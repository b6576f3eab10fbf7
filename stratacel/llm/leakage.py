"""Evaluation passages inside a training corpus, found by a distributed positional inverted index.

``build_index`` stores the postings of every term of the corpus, in shards of documents: per shard
its terms, and per term the places where it stands. The index knows nothing of test items; it is
written once and answers any set of them.

A shard is searched by intersection. For every window of an item that a match must cover, the list
of its rarest term, shifted by the term's place in the item, gives the places where the item might
begin; the shifted lists of the next rarer terms are intersected with it one after the other. What
is left when all terms of the window are done stands there word for word, and neighbouring windows
join to runs.

Terms are words, and for texts in scripts without spaces also pairs of neighbouring characters,
which have places of their own.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacel.llm.markup import shown_text
from stratacel.session import materialize, spread

#: Consecutive words, and consecutive letters and digits in scripts without spaces, of a match.
LEAST_WORDS = 16
LEAST_CHARS = 34
#: Languages whose items are matched by characters (fixed by the task).
CHAR_LANGS = ("zh", "ja")
#: Characters of text after which an index shard is closed.
SHARD_CHARS = 4 << 20
#: Characters of test items that are set against the index at once; more items go in several blocks.
ITEM_CHARS = 8 << 20
#: Terms by which a proximity match may be shifted within its passage, and of its shortest part.
SLACK = 4
LEAST_PART = 4
#: Places that are intersected together.
HITS_AT_ONCE = 2_000_000

_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile("[" + "".join(c for c in map(chr, range(0x300, 0x3100)) if unicodedata.category(c)[0] == "M") + "︀-️︠-︯⃐-⃿]+")
_SPACELESS = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")


def folded(text: str) -> str:
    """Without case, accents and their composition, and width."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text)
    return _MARK.sub("", text).casefold()


def words(text: str) -> list[str]:
    return _WORD.findall(text)


def char_pairs(text: str) -> list[str]:
    """Pairs of neighbouring letters and digits, whatever stands between them."""
    run = "".join(_WORD.findall(text))
    return [run[i : i + 2] for i in range(len(run) - 1)]


@dataclass(frozen=True)
class Items:
    """A block of test items, as places of terms; its size is bounded by ``ITEM_CHARS``."""

    ids: np.ndarray  # per item
    least: np.ndarray  # consecutive terms that make a match
    start: np.ndarray  # where the item's terms begin in ``term``
    length: np.ndarray
    term: np.ndarray  # number in ``terms`` at each place of each item
    terms: pa.Array  # the different terms; pairs of characters have a blank before them


def usable_items(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("bigint").alias("item_id"), F.lower("lang").alias("lang"), "text").where(
        "text IS NOT NULL AND item_id IS NOT NULL"
    )


def item_blocks(items: DataFrame) -> int:
    """Into how many blocks the test set is split, so that each can be broadcast; counted, not assumed."""
    chars = usable_items(items).agg(F.sum(F.length("text")).alias("n")).first().n or 0
    return -(-chars // ITEM_CHARS)


def read_items(items: DataFrame, block: int = 0, blocks: int = 1) -> Items:
    """One block of the test set. Null texts hold nothing."""
    rows = usable_items(items).where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).distinct().collect()  # ITEM_CHARS on average
    number: dict[str, int] = {}
    ids, least, start, length, term = [], [], [], [], []
    for row in sorted(rows, key=lambda r: (r.item_id, r.text)):
        text = folded(html.unescape(row.text))
        by_chars = row.lang in CHAR_LANGS
        terms = [" " + t for t in char_pairs(text)] if by_chars else words(text)
        need = LEAST_CHARS - 1 if by_chars else LEAST_WORDS
        if len(terms) < need:
            continue
        ids.append(row.item_id), least.append(need), start.append(len(term)), length.append(len(terms))
        term.extend(number.setdefault(t, len(number)) for t in terms)
    return Items(*[np.array(x, dtype=np.int64) for x in (ids, least, start, length, term)], pa.array(list(number), type=pa.string()))


#: Of a shard: the documents, where the places of each of their streams begin, the different terms
#: (their text, and where it ends), where each term's places end, and the places, as byte planes of
#: the distances between them. A document is a stream of words and, where its script wants it, one
#: of character pairs; streams are a place apart, so that no match runs from one into the next.
INDEX = "docs binary, begins binary, term_text binary, term_ends binary, ends binary, places binary"


def build_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The index of all texts, one row per shard; to be written once and searched by ``search_index``."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        streams: list[list[str]] = []
        size = 0
        for batch in batches:
            for doc, raw in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                if doc is None or not raw:
                    continue
                plain = folded(shown_text(raw))
                ids.append(doc), streams.append(words(plain))
                if _SPACELESS.search(plain):
                    ids.append(doc), streams.append([" " + t for t in char_pairs(plain)])
                size += len(raw)
                if size >= SHARD_CHARS:
                    yield _shard(ids, streams)
                    ids, streams, size = [], [], 0
        if ids:
            yield _shard(ids, streams)

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(index, INDEX)


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, of which the upper ones compress well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _shard(ids: list[int], streams: list[list[str]]) -> pa.RecordBatch:
    lengths = np.array([len(s) for s in streams], dtype=np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    coded = pa.concat_arrays([pa.array(s, type=pa.string()) for s in streams]).dictionary_encode()
    term, names = np.asarray(coded.indices), coded.dictionary
    place = np.arange(len(term)) + np.repeat(np.arange(len(streams)), lengths)
    order = np.argsort(term, kind="stable")
    ends = np.cumsum(np.bincount(term, minlength=len(names)))
    apart = np.diff(place[order], prepend=0)
    first = np.append(0, ends[:-1])[: len(ends)]
    apart[first] = place[order][first]  # of each term the first as it is
    names = pa.concat_arrays([names])
    offsets, data = names.buffers()[1:]
    text_ends = np.frombuffer(offsets, dtype=np.int32)[names.offset : names.offset + len(names) + 1]
    blobs = [np.array(ids, dtype=np.int64).tobytes(), begins.astype(np.int64).tobytes(), data.to_pybytes() if data else b"", text_ends.tobytes(), ends.astype(np.int64).tobytes(), _planes(apart)]
    return pa.RecordBatch.from_arrays([pa.array([b], type=pa.binary()) for b in blobs], names=[f.split()[0] for f in INDEX.split(", ")])


@dataclass(frozen=True)
class Postings:
    """Of one shard the lists of the terms that a block of items asks for."""

    docs: np.ndarray
    begins: np.ndarray
    listed: np.ndarray  # per term of the items: where its places begin and end in ``keys``
    keys: np.ndarray  # term number and place as one sorted number

    def count(self, term: np.ndarray) -> np.ndarray:
        return self.listed[term, 1] - self.listed[term, 0]

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each place is in the list of its term, by sorted search."""
        if not len(self.keys):
            return np.zeros(len(term), dtype=bool)
        key = (term << 33) + place
        at = np.searchsorted(self.keys, key)
        return (place >= 0) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key)

    def stream(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, place, side="right") - 1


def read_postings(batch: pa.RecordBatch, i: int, items: Items) -> Postings:
    raw = {name: batch.column(name)[i].as_buffer() for name in batch.schema.names}
    numbers = lambda name, kind: np.frombuffer(raw[name], dtype=kind)
    ends = numbers("ends", np.int64)
    names = pa.StringArray.from_buffers(len(ends), raw["term_ends"], raw["term_text"])
    where = pa.compute.index_in(items.terms, value_set=names)
    there = np.flatnonzero(np.asarray(where.is_valid()))
    own = np.asarray(where.drop_null()).astype(np.int64)
    lo = np.where(own > 0, ends[own - 1], 0) if len(ends) else own
    n = ends[own] - lo if len(ends) else own
    apart = _from_planes(raw["places"]).astype(np.int64)
    take = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    total = np.cumsum(apart[take])
    first = np.cumsum(n) - n  # sums begin anew with each list
    place = total - np.repeat(total[first] - apart[lo], n) if len(n) else total
    listed = np.zeros((len(items.terms), 2), dtype=np.int64)
    listed[there] = np.stack([first, first + n], axis=1)
    return Postings(numbers("docs", np.int64), numbers("begins", np.int64), listed, (np.repeat(there, n) << 33) + place)


@dataclass(frozen=True)
class Windows:
    """Every window of an item that a match must cover, its places from the rarest term on."""

    item: np.ndarray
    first: np.ndarray  # the place where the window begins
    size: np.ndarray
    place: np.ndarray  # (window, k): the place of its k-th rarest term; beyond its size the last is repeated


def windows_of(items: Items, postings: Postings, phrase: bool) -> Windows:
    """The windows all of whose terms the shard has; rarity is that in the shard."""
    count = postings.count(items.term)
    parts: list[list[np.ndarray]] = [[], [], [], []]
    widest = LEAST_PART if not phrase else int(items.least.max(initial=1))
    for i in range(len(items.ids)):
        size = int(items.least[i]) if phrase else LEAST_PART
        own = count[items.start[i] : items.start[i] + items.length[i]]
        rank = np.lib.stride_tricks.sliding_window_view(own, size)
        kept = np.flatnonzero(rank.min(axis=1) > 0)
        order = np.argsort(rank[kept], axis=1, kind="stable") + kept[:, None]
        parts[0].append(np.full(len(kept), i)), parts[1].append(kept), parts[2].append(np.full(len(kept), size))
        parts[3].append(np.pad(order, ((0, 0), (0, widest - size)), mode="edge"))
    if not parts[0]:
        empty = np.empty(0, dtype=np.int64)
        return Windows(empty, empty, empty, np.empty((0, widest), dtype=np.int64))
    return Windows(*[np.concatenate(p) for p in parts])


def _joined(item: np.ndarray, shift: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(item, shift, first, terms) of the runs that neighbouring windows of one shift make up."""
    order = np.lexsort((first, shift, item))
    item, shift, first, size = item[order], shift[order], first[order], size[order]
    new = np.ones(len(item), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (first[1:] > first[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(item))[: len(begin)] - 1
    return item[begin], shift[begin], first[begin], first[last] - first[begin] + size[begin]


def _clustered(item: np.ndarray, doc: np.ndarray, shift: np.ndarray, place: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Hits whose neighbours in shift make a proximity match possible.

    Every term of a part lies in a window with an anchor of that part, less than LEAST_PART terms
    off, so an anchor's place stands for 2 * LEAST_PART - 1 terms at most, and a match holds as many
    places as its least length needs.
    """
    if not len(item):
        return np.empty(0, dtype=np.int64)
    order = np.lexsort((shift, doc, item))
    i, d, s = item[order], doc[order], shift[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (s[1:] - s[:-1] > SLACK)
    cluster, places = np.cumsum(new) - 1, place[order]
    again = np.lexsort((places, cluster))
    c, p = cluster[again], places[again]
    first = np.ones(len(c), dtype=bool)
    first[1:] = (c[1:] != c[:-1]) | (p[1:] != p[:-1])
    enough = np.bincount(c[first]) >= -(-least[i[new]] // (2 * LEAST_PART - 1))
    return order[enough[cluster]]


def _chains(doc: np.ndarray, shift: np.ndarray, first: np.ndarray, count: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(document, place, terms) of the longest proximity match of each document that has one.

    The parts of a match follow each other in the item and in the document, at most ``SLACK`` terms
    apart and shifted by ``SLACK`` at most; terms in which two of them overlap count once. Any part
    may follow any other, so copies of a passage in one document don't part each other's chains.
    """
    order = np.lexsort((first, shift, doc))
    doc, shift, first, count = doc[order], shift[order], first[order], count[order]
    new = np.ones(len(doc), dtype=bool)  # a chain doesn't cross a gap in the shifts
    new[1:] = (doc[1:] != doc[:-1]) | (shift[1:] - shift[:-1] > SLACK)
    cluster = np.cumsum(new) - 1
    able = np.flatnonzero((np.bincount(cluster, weights=count) >= least)[cluster]) if len(doc) else order
    able = able[np.lexsort((shift[able], first[able], doc[able]))]
    own, best, ended = None, (0, 0), {}  # ended: shift to its parts so far, as (first, end, terms, place where its chain begins)
    for d, s, a, n in zip(*(x[able].tolist() for x in (doc, shift, first, count))):
        if d != own:
            if best[0] >= least:
                yield own, best[1], best[0]
            own, best, ended = d, (0, 0), {}
        b, terms, begin = a + n, n, a
        for other in range(s - SLACK, s + SLACK + 1):
            for c, e, before, place in reversed(ended.get(other, ())):
                gap, apart = a - e, a + s - e - other  # in the item, in the document
                if gap > SLACK:
                    break
                if apart <= SLACK and c < a and c + other < a + s and e < b and e + other < b + s:
                    held = before + n + min(0, gap, apart)
                    if held > terms:
                        terms, begin = held, place
        ended.setdefault(s, []).append((a, b, terms, begin))
        if terms > best[0]:
            best = (terms, begin)
    if best[0] >= least:
        yield own, best[1], best[0]


def search_shard(postings: Postings, items: Items, phrase: bool) -> tuple[np.ndarray, ...]:
    """(document, item, place in the item, terms) of the matches in one shard.

    A phrase match is a run of at least ``least`` consecutive terms of the item that stand in a row
    in the document. Without ``phrase``, runs of ``LEAST_PART`` terms or more that follow each other
    in the item, and in the document, with up to ``SLACK`` terms put in, left out or changed between
    them, are summed, and count when together they reach ``least``; see ``_chains``.
    """
    empty = tuple(np.empty(0, dtype=np.int64) for _ in range(4))
    windows = windows_of(items, postings, phrase)
    if not len(windows.item):
        return empty
    term_at = lambda item, place: items.term[items.start[item] + place]
    # the two rarest lists, once for all windows that have them in common
    pairs, pair_of = np.unique(np.stack([windows.item, windows.place[:, 0], windows.place[:, min(1, windows.place.shape[1] - 1)]]), axis=1, return_inverse=True)
    pair_of = pair_of.reshape(-1)
    rarest = term_at(pairs[0], pairs[1])
    lo, n = postings.listed[rarest, 0], postings.count(rarest)
    hits = []
    for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // HITS_AT_ONCE)) + 1):
        k = n[part]
        take = np.repeat(lo[part] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        pair = np.repeat(part, k)
        shift = (postings.keys[take] & ((1 << 33) - 1)) - pairs[1][pair]
        kept = postings.holds(term_at(pairs[0][pair], pairs[2][pair]), shift + pairs[2][pair])
        hits.append((pair[kept], shift[kept]))
    pair, shift = (np.concatenate(c) for c in zip(*hits))
    if not phrase:
        item, place = pairs[0][pair], pairs[1][pair]
        kept = _clustered(item, postings.stream(shift + place), shift, place, items.least)
        pair, shift = pair[kept], shift[kept]
    # the lists of all other terms of each window, from rare to frequent
    by_pair = np.argsort(pair_of, kind="stable")
    many = np.bincount(pair_of, minlength=pairs.shape[1])
    begin = np.cumsum(many) - many
    found = []
    each = many[pair]
    for part in np.split(np.arange(len(pair)), np.flatnonzero(np.diff(np.cumsum(each) // HITS_AT_ONCE)) + 1):
        k = each[part]
        w = by_pair[np.repeat(begin[pair[part]] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        s = np.repeat(shift[part], k)
        for j in range(2, windows.place.shape[1]):
            if not len(w):
                break
            place = windows.place[w, j]
            kept = postings.holds(term_at(windows.item[w], place), s + place)
            w, s = w[kept], s[kept]
        found.append((windows.item[w], s, windows.first[w], windows.size[w]))
    item, shift, first, count = _joined(*(np.concatenate(c) for c in zip(*found)))
    if not len(item):
        return empty
    doc = postings.stream(shift + first)
    if phrase:
        return postings.docs[doc], items.ids[item], first, count
    out = []
    order = np.argsort(item, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
        i = item[own[0]]
        for doc_at, place_at, total in _chains(doc[own], shift[own], first[own], count[own], int(items.least[i])):
            out.append((postings.docs[doc_at], items.ids[i], place_at, total))
    return tuple(np.array(out, dtype=np.int64).reshape(-1, 4).T)


def search_index(index: DataFrame, items: DataFrame, phrase: bool = True) -> DataFrame:
    """doc, item_id, longest: what ``leaked`` gives, of an index that ``build_index`` made.

    The test set is measured first and split into blocks of some ``ITEM_CHARS`` characters; each is
    broadcast and set against all shards.
    """
    spark = index.sparkSession
    schema = "doc bigint, item_id bigint, terms bigint"
    found = None
    blocks = item_blocks(items)
    for block in range(blocks):
        shared = spark.sparkContext.broadcast(read_items(items, block, blocks))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    doc, item, _, count = search_shard(read_postings(batch, i, shared.value), shared.value, phrase)
                    if len(doc):
                        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (doc, item, count)], names=["doc", "item_id", "terms"])

        own = index.mapInArrow(search, schema)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.groupBy("doc", "item_id").agg(F.max("terms").alias("longest"))


def leaked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", phrase: bool = True) -> DataFrame:
    """doc_id, item_id, longest: documents and the test items they hold, whole or in part.

    A document holds an item when ``LEAST_WORDS`` consecutive words of it (for ``CHAR_LANGS``,
    ``LEAST_CHARS`` consecutive letters and digits) stand in the document in a row, whatever the
    case, accents, punctuation, spacing, line breaks and markup; ``longest`` is the longest such run
    (of an item in characters, its pairs). With ``phrase`` false it is a proximity match: runs of
    ``LEAST_PART`` terms or more that insertions, omissions or changes of up to ``SLACK`` terms part
    count together.

    The items are a stated set that is set against all documents; the index is cut into shards, so
    no list is gathered, and a term that a third of all documents hold is as many postings in as
    many shards. Null keys, null and empty texts hold nothing; repeated rows of a document give one
    row; items shorter than a match give none; empty tables give an empty result; other columns are
    never read.
    """
    index = materialize(build_index(docs, key, text), "postings")
    return search_index(index, items, phrase).withColumnRenamed("doc", key)
