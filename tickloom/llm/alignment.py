"""Alignment of two tokenizers' tokens over the same bytes, and how often their tokens end together in a corpus.

The tokens of both sides are byte intervals.  All of them are sorted by start
(``lexsort``) and their ends accumulated to a running maximum; a group breaks
where a start reaches that maximum.  Inside a group every pair of overlapping
tokens is expanded; since each side tiles the text, a group of m and n tokens
has at most m + n - 1 of them.  A link is an overlapping pair that ends at one
byte.  Texts of a batch are laid end to end, so one pass serves them all.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm.bpe import WORD_PATTERN, byte_alphabet
from tickloom.llm.common import release, settle, shared_frequent

#: Characters of text that are aligned at once (a longer text is aligned alone).
BATCH_CHARS = 500_000
#: The fast encoder's pattern engine gives up on runs of white space of about a million characters; half of that goes to the library.
LONG_RUN = 500_000
SPACE_MARK = "▁"


def has_long_run(text: str) -> bool:
    """Whether more than LONG_RUN characters of white space follow each other."""
    return any(not text[at : at + LONG_RUN // 2].strip() for at in range(0, len(text) - LONG_RUN // 2 + 1, LONG_RUN // 2))


class ByteLevel:
    """Ids of a byte-level vocabulary file; strings of special tokens are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        special, to_byte = {t["content"]: t["id"] for t in spec["added_tokens"]}, byte_alphabet()
        vocab = spec["model"]["vocab"]
        ranks = {bytes(to_byte[c] for c in s): i for s, i in vocab.items() if s not in special}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for piece, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.bytes_of[i] = piece
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        made = [vocab[a + b] for a, b in merges]
        words = spec.get("pre_tokenizer") or {}
        plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space") and not spec.get("normalizer")
        #: Ids stand in the order of the merges, so they serve as merge ranks; else the library encodes.
        self.fast = tiktoken.Encoding("ids as ranks", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}) if plain and made == sorted(set(made)) else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [self.encode_whole(t) for t in texts]
        return [self.encode_whole(t) if len(t) > LONG_RUN and has_long_run(t) else self.fast.encode_ordinary(t) for t in texts]

    def encode_whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids of a piece model, which itself puts a space in front."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def coalesce(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The group of each interval, counted from 0 along the bytes."""
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    group = np.empty(len(start), np.int64)
    group[order] = np.concatenate(([0], np.cumsum(start[order][1:] >= reach[:-1]))) if len(start) else 0
    return group


def overlapping(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (places in A, places in B) of overlapping intervals; each side is sorted and has no gaps."""
    low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(n)), n)
    return a, np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)


class Aligned:
    """The tokens of a batch of texts laid end to end.

    Documents whose joined bytes differ from a space and the text, and null and
    empty ones, have no tokens.
    """

    def __init__(self, texts: list[str | None], one: ByteLevel, two: Pieces, sizes: tuple[np.ndarray, np.ndarray]):
        some = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in some]
        a, b = one.encode(spaced), two.encode([texts[i] for i in some])
        same = [b"".join(map(one.bytes_of.__getitem__, p)) == (raw := s.encode()) == b"".join(map(two.bytes_of.__getitem__, q)) for p, q, s in zip(a, b, spaced)]
        self.n = np.zeros((2, len(texts)), np.int64)
        for side, ids in enumerate((a, b)):
            self.n[side, some] = [len(x) * ok for x, ok in zip(ids, same)]
        self.ids = [np.fromiter((t for x, ok in zip(ids, same) if ok for t in x), np.int64, self.n[side].sum()) for side, ids in enumerate((a, b))]
        self.end = [np.cumsum(size[ids]) for size, ids in zip(sizes, self.ids)]
        self.start = [end - size[ids] for size, ids, end in zip(sizes, self.ids, self.end)]
        self.doc = [np.repeat(np.arange(len(texts)), n) for n in self.n]
        group = coalesce(np.concatenate(self.start), np.concatenate(self.end))
        self.group = np.split(group, [len(self.ids[0])])
        self.places = overlapping(self.start[0], self.end[0], self.start[1], self.end[1])
        together = self.end[0][self.places[0]] == self.end[1][self.places[1]]
        self.links = tuple(x[together] for x in self.places)

    def counted(self, doc: np.ndarray) -> np.ndarray:
        return np.bincount(doc, minlength=self.n.shape[1])

    def groups(self) -> np.ndarray:
        """Number of groups of each document."""
        first = np.diff(self.group[0], prepend=-1) > 0  # each group has tokens of both sides
        return self.counted(self.doc[0][first])

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each document its different linked id pairs (A id * width + B id) and how many links hold them."""
        doc, pair = self.doc[0][self.links[0]], self.ids[0][self.links[0]] * width + self.ids[1][self.links[1]]
        order = np.lexsort((pair, doc))
        doc, pair = doc[order], pair[order]
        new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])))) if len(doc) else np.zeros(0, np.int64)
        return doc[new], pair[new], np.diff(np.append(new, len(doc)))

    def written(self, marks: tuple[list[bytes], ...]) -> list[bytes]:
        """Each document's groups as ids; ``marks`` are an A id inside and at the end of its group, then a B id likewise."""
        (a, b), wide = self.group, len(marks[0])
        last = [np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in self.group]
        at_a, at_b = np.arange(len(a)) + np.searchsorted(b, a, "left"), np.arange(len(b)) + np.searchsorted(a, b, "right")
        key = np.empty(len(a) + len(b), np.int64)
        key[at_a], key[at_b] = self.ids[0] + wide * last[0], self.ids[1] + wide * 2 + len(marks[2]) * last[1]
        flat = [m for part in marks for m in part]
        out, at, keys = [], 0, key.tolist()
        for n in self.n.sum(0).tolist():
            out.append(b"".join(map(flat.__getitem__, keys[at : at + n]))[:-1])
            at += n
        return out


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.one, self.two = ByteLevel(path_a), Pieces(path_b)
        self.width = len(self.two.bytes_of)
        self.sizes = tuple(np.array(list(map(len, x.bytes_of)), np.int64) for x in (self.one, self.two))
        names = [[str(i).encode() for i in range(len(x.bytes_of))] for x in (self.one, self.two)]
        self.marks = tuple([m + end for m in ids] for ids, ends in zip(names, (b",|", b",;")) for end in (ends[:1], ends[1:]))

    def align(self, texts: list[str | None]) -> Aligned:
        return Aligned(texts, self.one, self.two, self.sizes)


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One a worker process and pair of files."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


def batches(texts: pa.Array) -> Iterator[list[str | None]]:
    """Slices of at most BATCH_CHARS characters, one text at least."""
    part, chars = [], 0
    for text in texts:
        text = text.as_py()
        if part and chars + len(text or "") > BATCH_CHARS:
            yield part
            part, chars = [], 0
        part.append(text)
        chars += len(text or "")
    if part:
        yield part


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))


def aligned_column(path_a: str, path_b: str):
    """Column function text -> struct of ids, byte ends (in space + text) and groups of both sides, and overlapping places."""
    numbers = ("a_ids", "b_ids", "a_ends", "b_ends", "a_groups", "b_groups", "overlap_a", "overlap_b")

    @F.arrow_udf(f"struct<{','.join(f'{n}:array<bigint>' for n in numbers)}>")
    def align(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = aligner(path_a, path_b)
        for texts in parts:
            out = []
            for part in batches(texts):
                x = model.align(part)
                before = np.cumsum(x.n, axis=1) - x.n
                bytes_before = np.concatenate(([0], x.end[0]))[before[0]]
                groups = np.cumsum(x.groups()) - x.groups()
                doc = x.doc[0][x.places[0]]
                columns = [*x.ids, *(x.end[s] - bytes_before[x.doc[s]] for s in (0, 1)), *(x.group[s] - groups[x.doc[s]] for s in (0, 1)), *(x.places[s] - before[s][doc] for s in (0, 1))]
                sizes = [x.n[0], x.n[1]] * 3 + [x.counted(doc)] * 2
                out.append(pa.StructArray.from_arrays([lists(c, n, pa.int64()) for c, n in zip(columns, sizes)], list(numbers)))
            yield pa.concat_arrays(out)

    return align


def linked_column(path_a: str, path_b: str):
    """Column function text -> struct of token, group and link numbers, the digest of the groups, and the different linked id pairs with their numbers."""

    @F.arrow_udf("struct<n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string,pair:array<bigint>,times:array<int>>")
    def link(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = aligner(path_a, path_b)
        for texts in parts:
            out = []
            for part in batches(texts):
                x = model.align(part)
                doc, pair, times = x.pairs(model.width)
                digests = [hashlib.sha256(w).hexdigest() if w else "" for w in x.written(model.marks)]
                numbers = [*x.n, x.groups(), x.counted(x.doc[0][x.links[0]])]
                n = x.counted(doc)
                columns = [*(pa.array(c, pa.int64()) for c in numbers), pa.array(digests, pa.string()), lists(pair, n, pa.int64()), lists(times, n, pa.int32())]
                out.append(pa.StructArray.from_arrays(columns, ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "times"]))
            yield pa.concat_arrays(out)

    return link


def align_documents(docs: DataFrame, path_a: str, path_b: str, text: str = "text", into: str = "aligned") -> DataFrame:
    """``docs`` with the alignment of each text in ``into`` (replacing a column of that name).

    ``a_ids``/``b_ids``, ``a_ends``/``b_ends`` (exclusive byte ends in space +
    text), ``a_groups``/``b_groups`` (each token's group) and
    ``overlap_a``/``overlap_b`` (places of overlapping tokens).  Null and empty
    texts, and texts that a side doesn't give back byte by byte, have empty
    lists.  Each row stands for itself: ties, repeated rows, nulls elsewhere and
    empty tables need no rule.
    """
    return docs.withColumn(into, aligned_column(path_a, path_b)(F.col(text)))


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, links): of each id pair the links of the corpus that hold it."""
    return linked.select(F.inline(F.arrays_zip("pair", "times"))).groupBy("pair").agg(F.sum("times").alias("links"))


def digest_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document, whatever its id, repeated or null.

    The corpus-wide counts come back to the documents in two ways: pairs that
    hold a fair share of all links are few by their share alone, and broadcast;
    the others, none of which is frequent, are joined by a shuffle.
    """
    width = len(aligner(path_a, path_b).two.bytes_of)
    found = settle(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), linked_column(path_a, path_b)("text").alias("x")).select("doc_id", "row", "x.*"))
    of_b = Window.partitionBy(F.col("pair") % width)  # at most one row for each A id
    counts = settle(pair_counts(found).withColumn("best", F.col("links") == F.max("links").over(of_b)))
    flat = found.select("row", F.inline(F.arrays_zip("pair", "times")))
    held = shared_frequent(flat, counts, ["pair"], "links")
    sums = held.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))
    release(docs.sparkSession)
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")
