"""Benchmark decontamination with suffix arrays over the training documents.

Every task turns the documents it holds into shards of bounded size.  A shard's
words become numbers, and the suffixes that start at each word are sorted.  All
suffixes of the test items are then located in the shard by binary search, which
yields for each test suffix the longest verbatim match in the shard and the range
of places of its window.  Ranks by 1, 2, 4, ... words carry the search forward, and
equal windows are one class, so texts that repeat a few words cost no more than
others.  A document lies whole in one shard, so nothing is shuffled.

Test items are broadcast in blocks of bounded size; a task holds one at a time
against the shard it has built, so a large benchmark is one pass as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import free_name

WINDOW = 10
#: Bytes of text in a shard (one document may exceed it), and of test items held by a task at once.
SHARD_BYTES, ITEM_BYTES = 2 << 20, 16 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: For each byte: 0 if it parts words, else the byte of its lower case.
_LOWER = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _LOWER[_b] = _b
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start and end of each word, of a UTF-8 buffer.

    A word is a run of digits, letters and non-ASCII characters, so it can be
    told byte by byte.
    """
    low = _LOWER[raw]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = low != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return low, edges[::2], edges[1::2]


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, by differences of a running sum over blocks of the buffer."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        until = max(at + 1, int(np.searchsorted(ends, starts[at] + HASH_BLOCK, "right")))
        first, s, e = starts[at], starts[at:until] - starts[at], ends[at:until] - starts[at]
        power, inverse = _powers(max(HASH_BLOCK, int(e[-1]) + 1))
        sums = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum(_MIX[low[first : first + e[-1]]] * power[: e[-1]], out=sums[1:])
        value = (sums[e] - sums[s]) * inverse[s]
        value ^= value >> np.uint64(32)
        out[at:until] = value * _BASE + (e - s).astype(np.uint64)
        at = until
    return out


HASH_BLOCK = 1 << 18
_kept: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for one block are kept."""
    if _kept and size <= len(_kept[0]):
        return _kept[0], _kept[1]
    both = []
    for x in (_BASE, _UNBASE):
        power = np.full(size, x, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        both.append(power)
    if size <= HASH_BLOCK:
        _kept[:] = both
    return both[0], both[1]


_MIX = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


class Items:
    """The suffixes of a block of test items, as word hashes."""

    def __init__(self, ids: list, texts: list):
        numbers, first, item, self.ids = [], [], [], ids
        bytes_, starts, ends, at = [], [], [], 0
        for i, text in enumerate(texts):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            low, start, end = words_of(raw)
            hashes = word_hashes(low, start, end)
            item.append(np.full(len(hashes), i))
            numbers.append(hashes)
            first.append(len(hashes))
            bytes_.append(low)
            starts.append(start + at)
            ends.append(end + at)
            at += len(low)
        #: The items' lower-cased bytes, and where each word lies in them.
        self.low = np.concatenate([*bytes_, np.zeros(0, np.uint8)])
        self.starts, self.ends = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (starts, ends))
        self.words = np.concatenate([*numbers, np.zeros(0, np.uint64)])
        self.item = np.concatenate([*item, np.zeros(0, np.int64)]).astype(np.int64)
        self.size = np.array(first, np.int64)
        ends = np.cumsum(self.size)
        #: Words from each place to the end of its item.
        self.left = ends[self.item] - np.arange(len(self.words)) if len(self.words) else np.zeros(0, np.int64)
        #: Words that a match must have at each place, or 0 where no window starts.
        whole = np.minimum(self.size[self.item], WINDOW) if len(self.words) else np.zeros(0, np.int64)
        self.need = np.where(self.left >= whole, whole, 0)
        self.longest = int(self.size.max(initial=0))


def equal_words(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether words (buffer, starts, ends) are byte by byte those of another list of the same length."""
    (low_a, start_a, end_a), (low_b, start_b, end_b) = a, b
    size = end_a - start_a
    same = size == end_b - start_b
    alike, at = np.flatnonzero(same), 0
    total = np.concatenate(([0], np.cumsum(size[alike])))
    while at < len(alike):
        until = max(at + 1, int(np.searchsorted(total, total[at] + COMPARED_AT_ONCE, "right")) - 1)
        part = alike[at:until]
        n = size[part]
        first = np.cumsum(n) - n
        within = np.arange(n.sum()) - np.repeat(first, n)
        bytes_ = low_a[np.repeat(start_a[part], n) + within] == low_b[np.repeat(start_b[part], n) + within]
        same[part] = np.logical_and.reduceat(bytes_, first)
        at = until
    return same


COMPARED_AT_ONCE = 1 << 18
#: Pairs of a document and an item that are told apart at once.
PAIRS_AT_ONCE = 1 << 22


@dataclass
class Matches:
    """Per test suffix: words of its longest match in the shard, and one place of it; and the windows found.

    A window is a range [low, high) of the suffix array and the test suffix that
    starts with it.
    """

    length: np.ndarray
    place: np.ndarray
    low: np.ndarray
    high: np.ndarray
    suffix: np.ndarray
    #: First place in the suffix array of each test suffix's longest match.
    where: np.ndarray
    #: For each power of two, the rank of the test suffix's first so many words among those of the shard, or -1.
    numbers: list[np.ndarray]


class Shard:
    """Suffix array over the words of some documents, each ended by a mark that no test word equals.

    Equal words have one number and different words have two: hashes tell most of
    them apart, and words of one hash are compared byte by byte.  The ranks of all
    suffixes by their first 1, 2, 4, ... words are kept, so that a search goes
    forward by powers of two, however repetitive the texts are.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, depth: int):
        self.low, self.starts, self.ends = words_of(raw)
        hashes = word_hashes(self.low, self.starts, self.ends)
        docs = len(offsets) - 1
        self.count = np.diff(np.searchsorted(self.starts, offsets))
        self.doc_end = np.cumsum(self.count + 1) - 1  # place of each document's mark
        total = len(hashes) + docs
        self.hash_of, self.model, word = np.unique(hashes, return_index=True, return_inverse=True)
        #: Words that are not the first of their hash, by their bytes; hardly ever any.
        self.other: dict[bytes, int] = {}
        like = self.model[word]
        for i in np.flatnonzero(~equal_words((self.low, self.starts, self.ends), (self.low, self.starts[like], self.ends[like]))).tolist():
            word[i] = self.other.setdefault(self.low[self.starts[i] : self.ends[i]].tobytes(), len(self.hash_of) + len(self.other))
        self.text = np.empty(total, np.int64)
        marks = np.zeros(total, bool)
        marks[self.doc_end] = True
        self.text[~marks] = word + docs
        self.text[marks] = np.arange(docs)  # each mark is its own number: no match runs past it
        self.first = docs
        self.order, self.ranks = self.sorted_suffixes(depth)

    def sorted_suffixes(self, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Suffix order by at least the first ``depth`` words, which no test suffix exceeds, and the ranks by 1, 2, 4, ... words.

        A rank is the place in the order of the first suffix that starts alike.
        Only suffixes that still tie are sorted again.
        """
        n, text = len(self.text), self.text
        order = np.argsort(text, kind="stable") if n else np.zeros(0, np.int64)
        fresh = np.ones(n, bool)
        fresh[1:] = text[order[1:]] != text[order[:-1]]
        rank = np.empty(n, np.int64)
        group = np.flatnonzero(fresh)
        rank[order] = np.repeat(group, np.diff(np.append(group, n)))
        width, ranks = 1, [rank.astype(np.int32)]
        while width < depth:
            alone = fresh & np.append(fresh[1:], True)
            tied = np.flatnonzero(~alone)
            if not len(tied):
                break
            suffix = order[tied]
            after = np.where(suffix + width < n, rank[np.minimum(suffix + width, n - 1)], -1)
            own = rank[suffix]
            again = np.argsort(own * (n + 1) + after + 1)
            suffix, own, after = suffix[again], own[again], after[again]
            order[tied] = suffix
            new = np.ones(len(tied), bool)
            new[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
            fresh[tied] = new
            group = np.flatnonzero(new)
            rank[suffix] = np.repeat(tied[group], np.diff(np.append(group, len(tied))))
            width *= 2
            ranks.append(rank.astype(np.int32))
        return order, ranks

    def rank_at(self, level: int, place: np.ndarray) -> np.ndarray:
        """Ranks by 2**level words of the suffixes at these places, -1 behind the end."""
        ranks = self.ranks[min(level, len(self.ranks) - 1)]  # once no suffixes tie, ranks stay as they are
        return np.where(place < len(ranks), ranks[np.minimum(place, len(ranks) - 1)], -1)

    def bound(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, level: int, number: np.ndarray, right: bool) -> np.ndarray:
        """First place in [low, high) of the suffix array whose rank by 2**level words behind ``depth`` is not below ``number`` (``right``: is above it)."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            value = self.rank_at(level, self.order[np.minimum(mid, len(self.order) - 1)] + depth)
            goes = open_ & ((value <= number) if right else (value < number))
            low = np.where(goes, mid + 1, low)
            high = np.where(open_ & ~goes, mid, high)
        return low

    def number_words(self, items: Items) -> np.ndarray:
        """The shard's rank of each word of the items, -1 for words that it doesn't hold."""
        slot = np.minimum(np.searchsorted(self.hash_of, items.words), max(0, len(self.hash_of) - 1))
        known = self.hash_of[slot] == items.words if len(self.hash_of) else np.zeros(len(items.words), bool)
        number, hit = np.full(len(items.words), -1, np.int64), np.flatnonzero(known)
        like = self.model[slot[hit]] if len(hit) else hit
        same = equal_words((items.low, items.starts[hit], items.ends[hit]), (self.low, self.starts[like], self.ends[like]))
        number[hit[same]] = slot[hit[same]]
        if self.other:
            for i in hit[~same].tolist():
                number[i] = self.other.get(items.low[items.starts[i] : items.ends[i]].tobytes(), -1)
        found = np.flatnonzero(number >= 0)
        number[found] = np.searchsorted(self.text[self.order], number[found] + self.first)
        return number

    def numbered(self, items: Items) -> list[np.ndarray]:
        """For each power of two the rank that the shard gives to so many words from each place of the items, or -1."""
        out, half = [self.number_words(items)], 1
        while half * 2 <= items.longest:
            last, level = out[-1], len(out) - 1
            whole = np.flatnonzero((items.left >= 2 * half) & (last >= 0))
            whole = whole[last[whole + half] >= 0]
            number = np.full(len(last), -1, np.int64)
            if len(whole):
                low, wanted = last[whole], last[whole + half]
                high = np.searchsorted(self.rank_at(level, self.order), low, "right")
                at = self.bound(low, high, half, level, wanted, False)
                ok = (at < high) & (self.rank_at(level, self.order[np.minimum(at, len(self.order) - 1)] + half) == wanted)
                number[whole[ok]] = at[ok]
            out.append(number)
            half *= 2
        return out

    def forward(self, level: int, test: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray, numbers: list[np.ndarray]):
        """Ranges of the suffix array that match 2**level more words of the test suffixes, and whether they hold any."""
        wanted = numbers[level][test + depth]
        start = self.bound(low, high, depth, level, wanted, False)
        stop = self.bound(start, high, depth, level, wanted, True)
        return start, stop, (wanted >= 0) & (start < stop)

    def search(self, items: Items) -> Matches:
        """Binary search of every test suffix, forward by powers of two."""
        n, numbers = len(items.words), self.numbered(items)
        length, where = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero(numbers[0] >= 0) if n else np.zeros(0, np.int64)
        low, high = np.zeros(len(live), np.int64), np.full(len(live), len(self.order), np.int64)
        for level in reversed(range(len(numbers))):  # the longest match
            on = np.flatnonzero(items.left[live] - length[live] >= 1 << level)
            start, stop, ok = self.forward(level, live[on], low[on], high[on], length[live[on]], numbers)
            on, start, stop = on[ok], start[ok], stop[ok]
            low[on], high[on] = start, stop
            length[live[on]] += 1 << level
        where[live] = low
        place = np.where(length > 0, self.order[np.minimum(where, max(0, len(self.order) - 1))], -1) if n and len(self.order) else np.full(n, -1)
        test = np.flatnonzero((items.need > 0) & (length >= items.need))
        low, high = self.ranges(test, items.need[test], numbers)
        return Matches(length, place, low, high, test, where, numbers)

    def ranges(self, test: np.ndarray, words: np.ndarray, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The range of the suffix array that starts with the first ``words`` words of each test suffix; it holds some."""
        low, high, depth = np.zeros(len(test), np.int64), np.full(len(test), len(self.order), np.int64), np.zeros(len(test), np.int64)
        for level in reversed(range(len(numbers))):
            on = np.flatnonzero(words - depth >= 1 << level)
            low[on], high[on], _ = self.forward(level, test[on], low[on], high[on], depth[on], numbers)
            depth[on] += 1 << level
        return low, high

    def common(self, place: np.ndarray, test: np.ndarray, items: Items, numbers: list[np.ndarray]) -> np.ndarray:
        """Words that the suffix at each place and a test suffix have in common at their start."""
        depth = np.zeros(len(place), np.int64)
        for level in reversed(range(len(numbers))):
            on = np.flatnonzero(items.left[test] - depth >= 1 << level)
            number = numbers[level][test[on] + depth[on]]
            same = (number >= 0) & (self.rank_at(level, place[on] + depth[on]) == number)
            depth[on[same]] += 1 << level
        return depth

    def longest_at(self, spot: np.ndarray, items: Items, found: Matches) -> tuple[np.ndarray, np.ndarray]:
        """For places of the suffix array, the test suffix with the longest match there, and its words.

        Test suffixes have their places between the shard's.  Of all in front of a
        spot the nearest match longest, and so do the nearest behind it; of those
        between the same two suffixes, the one with the longest match on that side.
        Windows of each size are looked at by themselves, for less than a window is
        no match.
        """
        best, words = np.zeros(len(spot), np.int64), np.full(len(spot), -1, np.int64)
        for need in np.unique(items.need[found.suffix]).tolist():
            test = found.suffix[items.need[found.suffix] == need]
            gap = found.where[test]
            before = np.where(gap > 0, self.common(self.order[np.maximum(gap - 1, 0)], test, items, found.numbers), 0)
            for length, front in ((found.length[test], True), (before, False)):
                by = np.lexsort((-length, gap))
                gaps, first = np.unique(gap[by], return_index=True)
                at = np.searchsorted(gaps, spot, "right") - front
                ok = np.flatnonzero((at >= 0) & (at < len(gaps)))
                chosen = test[by[first[at[ok]]]]
                n = self.common(self.order[spot[ok]], chosen, items, found.numbers)
                better = (n >= need) & (n > words[ok])
                best[ok[better]], words[ok[better]] = chosen[better], n[better]
        return best, words

    def hits(self, items: Items, found: Matches) -> tuple[list[list[dict]], list[list[int]], list[dict | None]]:
        """For each document: the merged spans of hit words [start, end), its items, and its longest match.

        A window that many test suffixes share, or that stands at many places, is
        one class: its places are listed once, and its items once.
        """
        docs = len(self.count)
        spans: list[list[dict]] = [[] for _ in range(docs)]
        named: list[list[int]] = [[] for _ in range(docs)]
        longest: list[dict | None] = [None] * docs
        if not len(found.suffix):
            return spans, named, longest
        kind, one, of = np.unique(found.low * (WINDOW + 1) + items.need[found.suffix], return_index=True, return_inverse=True)
        low, sizes, words = found.low[one], (found.high - found.low)[one], items.need[found.suffix[one]]
        spot = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        at, cls = self.order[spot], np.repeat(np.arange(len(kind)), sizes)
        cover = np.zeros(len(self.text) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + words[cls], -1)
        hit = np.concatenate(([0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]))
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        begins = np.concatenate(([0], self.doc_end[:-1] + 1))
        for s, e, d in zip(edges[::2].tolist(), edges[1::2].tolist(), np.searchsorted(self.doc_end, edges[::2]).tolist()):
            spans[d].append({"start": s - int(begins[d]), "end": e - int(begins[d])})
        doc = np.searchsorted(self.doc_end, at)
        for p in self.pairs(np.unique(cls * docs + doc), np.unique(of * len(items.ids) + items.item[found.suffix]), docs, len(items.ids)).tolist():
            named[p // len(items.ids)].append(items.ids[p % len(items.ids)])
        spot = np.unique(spot)
        at = self.order[spot]
        doc = np.searchsorted(self.doc_end, at)
        best, most = self.longest_at(spot, items, found)
        by = np.lexsort((at, -most, doc))
        _, first = np.unique(doc[by], return_index=True)
        top = by[first]
        for d, start, n, item in zip(doc[top].tolist(), at[top].tolist(), most[top].tolist(), self.first_item(best[top], most[top], items, found)):
            longest[d] = {"words": n, "start": start - int(begins[d]), "item": item}
        return spans, named, longest

    def pairs(self, of_doc: np.ndarray, of_item: np.ndarray, docs: int, items: int) -> np.ndarray:
        """Different (document * items + item) of the documents and items that share a class, both given as class * number + own number."""
        cls, item = of_item // items, of_item % items
        low, high = np.searchsorted(cls, of_doc // docs, "left"), np.searchsorted(cls, of_doc // docs, "right")
        n, out, at = high - low, np.zeros(0, np.int64), 0
        total = np.concatenate(([0], np.cumsum(n)))
        while at < len(n):
            until = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS_AT_ONCE, "right")) - 1)
            part = slice(at, until)
            step = np.arange(n[part].sum()) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            out = np.unique(np.concatenate((out, np.repeat(of_doc[part] % docs, n[part]) * items + item[np.repeat(low[part], n[part]) + step])))
            at = until
        return out

    def first_item(self, test: np.ndarray, words: np.ndarray, items: Items, found: Matches) -> list:
        """The least item id (as text) that has the first ``words`` words of each test suffix."""
        keys, back = np.unique(test * (items.longest + 1) + words, return_inverse=True)
        one, n = keys // (items.longest + 1), keys % (items.longest + 1)
        low, high = self.ranges(one, n, found.numbers)
        by = np.argsort(found.where[found.suffix], kind="stable")
        suffix = found.suffix[by]
        a, b = np.searchsorted(found.where[suffix], low, "left"), np.searchsorted(found.where[suffix], high, "left")
        out, known = [], {}
        for i, j, m in zip(a.tolist(), b.tolist(), n.tolist()):
            if (i, j, m) not in known:
                own = suffix[i:j]
                ids = [items.ids[k] for k in np.unique(items.item[own[(found.length[own] >= m) & (items.need[own] <= m)]]).tolist()]
                known[i, j, m] = min((x for x in ids if x is not None), key=str, default=None)
            out.append(known[i, j, m])
        return [out[i] for i in back.tolist()]


def united(one: list[dict], two: list[dict]) -> list[dict]:
    """Union of two lists of sorted spans that don't touch."""
    if not one or not two:
        return one or two
    out: list[dict] = []
    for s in sorted([*one, *two], key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], s["end"])}
        else:
            out.append(s)
    return out


def longer(one: dict | None, two: dict | None) -> dict | None:
    """Of two matches the one of more words, then the earlier, then that of the least item."""
    return min((m for m in (one, two) if m), key=lambda m: (-m["words"], m["start"], m["item"] is None, str(m["item"])), default=None)


HITS = "n_words long, spans array<struct<start: long, end: long>>, items array<string>, longest struct<words: long, start: long, item: string>"
_HITS_ARROW = [pa.field("n_words", pa.int64()), pa.field("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.field("items", pa.list_(pa.string())), pa.field("longest", pa.struct([("words", pa.int64()), ("start", pa.int64()), ("item", pa.string())]))]


def _shards(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text each."""
    at, held = 0, 0
    for i, size in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if i > at and held + size > most:
            yield at, i
            at, held = i, 0
        held += size
    if at < len(texts):
        yield at, len(texts)


def search_column(blocks: list[Broadcast], shard_bytes: int):
    """Column function text -> (n_words, spans, items, longest); one block of items is held at a time."""

    @F.arrow_udf(HITS)
    def search(texts: pa.Array) -> pa.Array:
        rows: list[list] = [[], [], [], []]
        for low, high in _shards(texts, shard_bytes):
            encoded = [(t or "").encode() for t in texts.slice(low, high - low).to_pylist()]
            raw = np.frombuffer(b" ".join(encoded), np.uint8)
            offsets = np.cumsum([0, *(len(t) + 1 for t in encoded)])
            shard, found = None, None
            for block in blocks:
                items = block.value
                if shard is None:
                    shard = Shard(raw, offsets, items.deepest)
                got = shard.hits(items, shard.search(items))
                if len(blocks) > 1:
                    items = None
                    block.__dict__.pop("_value", None)  # it is read again from this machine's copy for the next shard
                found = got if found is None else tuple([join(x, y) for x, y in zip(a, b)] for join, a, b in zip((united, lambda x, y: x + y, longer), found, got))
            for kept, part in zip(rows, (shard.count.tolist(), *found)):
                kept += part
        return pa.StructArray.from_arrays([pa.array(r, f.type) for r, f in zip(rows, _HITS_ARROW)], fields=_HITS_ARROW)

    return search


def item_blocks(benchmark: DataFrame, most: int = ITEM_BYTES) -> Iterator[Items]:
    """The items in blocks of about ``most`` bytes of text, each small enough to be held by every task (a longer item stands alone)."""
    sized = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").distinct().withColumn("n", F.coalesce(F.octet_length("text"), F.lit(0)) + 64)
    total = sized.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // most))
    for k in range(blocks):
        rows = sized.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).select("id", "text").collect()
        yield Items([r.id for r in rows], [r.text for r in rows])


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "hits", shard_bytes: int = SHARD_BYTES, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``docs`` with ``into``: n_words, merged spans of hit words [start, end), the ids (as text) of the items with a window in the document, and ``longest``.

    ``longest`` (words, start, item) is the document's longest verbatim match with
    an item, of equal ones the first, of items there that with the least id; it is
    null where no window matches.  The blocks that the items fill don't show.

    Null texts have no words; so do empty ones.  Items without words match
    nothing; items with one id or text may repeat (an id is named once).  Null
    item ids are named nowhere, their windows hit.  Any other column passes
    through; a column named ``into`` is replaced.  Repeated documents are judged
    alike; no documents or no items give no hits.
    """
    name, blocks, deepest = free_name(docs, f"{into}_found"), [], 0
    deepest = benchmark.agg(F.max(F.octet_length("text"))).first()[0] or 0
    for items in item_blocks(benchmark, item_bytes):
        items.deepest = deepest // 2 + 1  # no item has more words
        blocks.append(docs.sparkSession.sparkContext.broadcast(items))  # the driver keeps one block, and files of the others
    hits = F.col(name)
    names = F.array_sort(F.array_distinct(F.filter(hits["items"], lambda x: x.isNotNull())))
    found = docs.withColumn(name, search_column(blocks, shard_bytes)(F.col(text)))
    return found.withColumn(into, F.struct(hits["n_words"].alias("n_words"), hits["spans"].alias("spans"), names.alias("items"), hits["longest"].alias("longest"))).drop(name)


def n_hit(hits: str = "hits"):
    return F.aggregate(f"{hits}.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without a window of any item, with their columns as they were."""
    name = free_name(docs, "hits")
    return find_matches(docs, benchmark, text, name).where(F.size(f"{name}.spans") == 0).drop(name)


def digest_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = find_matches(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"),
    )


_CUT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_CUT} AS w FROM documents),
b AS (SELECT item_id, {_CUT} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, w[i:i + k - 1] AS win FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, i, w[i:i + k - 1] AS win FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, i, k FROM dw JOIN iw USING (k, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
