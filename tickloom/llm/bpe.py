"""Byte-level BPE encoding and decoding by a walk over a trie of distinct words.

A prefix of a word has one BPE encoding, and that encoding is fixed by its last
token: the token ``t`` that ends the prefix and whose left neighbour, the last
token of the prefix without ``t``, forms with it a pair that BPE leaves as it is.
So one integer per trie node, the last token, is a complete state.  The walk
below visits the trie of a batch's distinct words depth first, computes each
node's state from its ancestors' states, and so handles a prefix that many words
share once.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Fixed value: how a byte-level vocabulary cuts text into words before merging.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words kept between batches, and texts (in characters) handled at once; both bound a worker's memory.
CACHE_WORDS, BATCH_CHARS, PAIR_MEMO = 300_000, 4_000_000, 1_000_000


def byte_alphabet() -> dict[str, int]:
    """Character that a byte-level vocabulary file writes for each byte: printable ones stand for themselves, others follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def shared_prefixes(keys: list[bytes]) -> list[int]:
    """Bytes that each key of a sorted list shares with the one before it."""
    wide, out = 24, np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        heads = np.array([k[:wide] for k in keys], f"S{wide}").view(np.uint8).reshape(-1, wide)
        differ = heads[1:] != heads[:-1]
        sizes = np.array([len(k) for k in keys])
        out[1:] = np.minimum(np.where(differ.any(1), differ.argmax(1), wide), np.minimum(sizes[1:], sizes[:-1]))
        for i in np.flatnonzero(out == wide).tolist():  # longer than the heads show
            one, two, n = keys[i - 1], keys[i], wide
            while n < min(len(one), len(two)) and one[n] == two[n]:
                n += 1
            out[i] = n
    return out.tolist()


class TrieBpe:
    """Encoder and decoder for one vocabulary file of the tokenizers library (byte-level BPE, no normaliser)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.bytes_of = [b""] * (1 + max([*self.vocab.values(), *special.values()]))
        for b, i in self.vocab.items():
            self.bytes_of[i] = b
        for s, i in special.items():
            self.bytes_of[i] = s.encode()
        self.special = {s: i.to_bytes(4, "little") for s, i in special.items()}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merge, self.made = {}, {}
        self.spines: tuple[dict, dict] = ({}, {})
        for rank, (a, b) in enumerate(pairs):
            left, right = raw(a), raw(b)
            one, two, whole = self.vocab[left], self.vocab[right], self.vocab[left + right]
            if whole in self.made or any(t in self.made and self.made[t][0] >= rank for t in (one, two)):
                raise ValueError("the walk needs merges that each make one new token out of earlier ones")
            self.merge[one, two] = (rank, whole)
            self.made[whole] = (rank, one, two)
        self.step: dict[int, int] = {}
        self.starts = {b[:n] for b in self.vocab for n in range(1, len(b) + 1)} | {b""}
        self.places, self.ending = {b"": 0}, [((), b"")]
        self.sizes = [len(b) for b in self.bytes_of]
        self.words = regex.compile(WORD_PATTERN)
        self.stays: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}

    def move(self, place: int, byte: int) -> int:
        """Where reading ``byte`` leads: a place stands for the longest suffix read so far that begins some token.

        Places and moves are made as texts need them; ``ending`` has, for each
        place, the tokens that end there, longest first, with their lengths.
        """
        read = self.ending[place][1] + bytes((byte,))
        at = next(read[i:] for i in range(len(read) + 1) if read[i:] in self.starts)
        if at not in self.places:
            self.places[at] = len(self.ending)
            self.ending.append((tuple((len(at) - i, self.vocab[at[i:]]) for i in range(len(at)) if at[i:] in self.vocab), at))
        self.step[place << 8 | byte] = self.places[at]
        return self.places[at]

    def merged(self, ids: list[int]) -> list[int]:
        """Plain BPE: the pair of least rank, leftmost first, until none is left."""
        while len(ids) > 1:
            found = min(((*self.merge[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge), key=lambda x: (x[0], x[2]), default=None)
            if found is None:
                break
            ids[found[2] : found[2] + 2] = [found[1]]
        return ids

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that come to stand at one end (0 left, 1 right) of ``token`` as it is built, each with the rank of the merge that takes it in."""
        known = self.spines[side].get(token)
        if known is None:
            known, over = [], float("inf")
            while True:
                known.append((token, over))
                if token not in self.made:
                    break
                over, *parts = self.made[token]
                token = parts[side]
            known.reverse()
            self.spines[side][known[-1][0]] = known
        return known

    def stable(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two neighbours as they are; ``left`` is -1 at the start of a word.

        Merges happen in order of rank, so both tokens are built from bytes side
        by side; they stay apart if no merge across their border comes before
        the merges that take in its two sides (of equal ranks, the left one is first).
        """
        key = left << 32 | right
        known = self.stays.get(key)
        if known is not None:
            return known
        if left < 0:
            known = self.merged([self.vocab[bytes((b,))] for b in self.bytes_of[right]]) == [right]
        else:
            a, b, i, j, known = self.spine(left, 1), self.spine(right, 0), 0, 0, True
            while True:
                (x, takes_x), (y, takes_y) = a[i], b[j]
                across = self.merge.get((x, y))
                if across and across[0] < takes_x and across[0] <= takes_y:
                    known = False
                    break
                if i == len(a) - 1 and j == len(b) - 1:
                    break
                if takes_x <= takes_y:
                    i += 1
                else:
                    j += 1
        if len(self.stays) >= PAIR_MEMO:
            self.stays.clear()
        self.stays[key] = known
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids (little-endian unsigned 32-bit) of each distinct word.

        In sorted order the words are the leaves of their trie in depth-first
        order; ``path`` holds the states on the way from the root to the current
        node, and a word goes on from the deepest node it shares with the one before.
        """
        out, step, ending, stays, stable, sizes = {}, self.step, self.ending, self.stays, self.stable, self.sizes
        path, places = [-1], [0]
        by_key = {w.encode(): w for w in words}
        keys = sorted(by_key)
        for key, shared in zip(keys, shared_prefixes(keys)):
            del path[shared + 1 :], places[shared + 1 :]
            place = places[shared]
            for end in range(shared, len(key)):
                place = step.get(place << 8 | key[end], -1)
                if place < 0:
                    place = self.move(places[end], key[end])
                places.append(place)
                for length, token in ending[place][0]:
                    left = path[end + 1 - length]
                    fits = stays.get(left << 32 | token)
                    if stable(left, token) if fits is None else fits:
                        path.append(token)
                        break
            end, ids = len(key), []
            while end:
                token = path[end]
                ids.append(token)
                end -= sizes[token]
            ids.reverse()
            out[by_key[key]] = array("I", ids).tobytes()
        return out

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Words of a text in order; the flag marks strings of special tokens."""
        if self.cut_special is None or not any(s in text for s in self.special):
            for w in self.words.findall(text):
                yield w, False
            return
        for i, part in enumerate(self.cut_special.split(text)):
            if i % 2:
                yield part, True
            else:
                for w in self.words.findall(part):
                    yield w, False

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as bytes; the trie is built over the distinct words of about BATCH_CHARS characters."""
        at = 0
        while at < len(texts):
            cut, chars = at, 0
            while cut < len(texts) and (cut == at or chars + len(texts[cut]) <= BATCH_CHARS):
                chars += len(texts[cut])
                cut += 1
            split = []
            for t in texts[at:cut]:
                plain = self.cut_special is None or not any(s in t for s in self.special)
                split.append(self.words.findall(t) if plain else list(self.segments(t)))
            fresh = set()
            for words in split:
                fresh.update(words if not words or isinstance(words[0], str) else (w for w, special in words if not special))
            if len(self.cache) + len(fresh) > CACHE_WORDS:
                self.cache = {}
            cache = self.cache
            cache.update(self.encode_words(fresh.difference(cache)))
            for words in split:
                if words and not isinstance(words[0], str):
                    yield b"".join(self.special[w] if special else cache[w] for w, special in words)
                else:
                    yield b"".join([cache[w] for w in words])
            at = cut

    def decode(self, ids: bytes) -> str:
        """Text of little-endian unsigned 32-bit ids; bytes that are no UTF-8 become U+FFFD."""
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[str, TrieBpe] = {}


def coder(path: str) -> TrieBpe:
    """One coder a worker process."""
    if path not in _loaded:
        _loaded[path] = TrieBpe(path)
    return _loaded[path]


def encode_column(path: str):
    """Column function text -> array of ids; null is the empty text."""

    @F.pandas_udf("array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = coder(path)
        for texts in parts:
            yield pd.Series([np.frombuffer(x, "<i4") for x in bpe.encode(["" if t is None else t for t in texts])], dtype=object)

    return encode


def decode_column(path: str):
    """Column function array of ids -> text; null decodes to the empty text."""

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = coder(path)
        for ids in parts:
            yield pd.Series([bpe.decode(b"" if x is None else np.asarray(x, "<u4").tobytes()) for x in ids], dtype=object)

    return decode


#: Rows encoded and sent on at once by ``round_trip_documents``, so that a worker never holds a whole Arrow batch's results.
ROWS_AT_ONCE = 512


def round_trip_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of each text and the text decoded from them (replacing columns of those names); edge cases as in ``encode_documents``."""
    kept = docs.drop(ids, decoded)
    schema = StructType([*kept.schema.fields, StructField(ids, ArrayType(IntegerType())), StructField(decoded, StringType())])

    def round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                coded = list(bpe.encode([t or "" for t in batch.column(text).to_pylist()]))
                ends = np.cumsum([0, *(len(x) // 4 for x in coded)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array([bpe.decode(x) for x in coded], pa.string())], names=[*batch.schema.names, ids, decoded])

    return kept.mapInArrow(round_trip, schema)


def digest_column(path: str):
    """Column function text -> (n_tokens, ids_sha256, decoded_sha256), of an encoding followed by a decoding in the same pass."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = coder(path)
        for texts in parts:
            rows = []
            for ids in bpe.encode(["" if t is None else t for t in texts]):
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def encode_documents(docs: DataFrame, path: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each text in ``into`` (replacing a column of that name).

    Null text: no ids, as for the empty text.  Texts of any length are encoded
    whole.  Rows are independent: ties, repeated rows and empty tables need no
    rule, and other columns pass through, null or not.
    """
    return docs.withColumn(into, encode_column(path)(F.col(text)))


def digest_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id with the token count and the digests of ids and of the decoded text; edge cases as in ``encode_documents``."""
    return docs.select("doc_id", digest_column(path)(F.col(text)).alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
