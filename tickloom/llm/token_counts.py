"""Token counts of whole texts with a piece model; huge texts are encoded in overlapping chunks and spliced.

A border is proven stable where the vocabulary allows no piece, and so no merge,
to cross it: in front of a space that follows another character, if no piece has
the space mark after another character.  Everything on one side of such a border
is encoded alike whatever stands on the other side.  Two neighbouring chunks
overlap; their encodings are spliced at a stable border that both have as a
token boundary, and the overlap is doubled until it holds one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Texts up to CHUNK characters are encoded at once; longer ones in chunks that share OVERLAP characters at first.
CHUNK, OVERLAP = 32_768, 256
#: Texts whose ids are held at once.
ROWS_AT_ONCE = 256


class ChunkedCounter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = max(2, chunk), max(1, min(overlap, chunk // 2))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: Whether the vocabulary proves the borders; otherwise texts are encoded at once.
        self.proven = not any(MARK in p.lstrip(MARK) for p in pieces) and self.plain()

    def plain(self) -> bool:
        """Whether the model only turns spaces into marks and puts one in front, so that chunks are normalised as their text is."""
        probe = "  a\tb é　ﬁ A  "
        return self.model.normalize(probe) == MARK + probe.replace(" ", MARK)

    def starts(self, text: str, low: int, high: int) -> list[int]:
        """Where the tokens of ``text[low:high]`` start, as places in ``text``."""
        return [low + at for at, _ in self.model.encode(text[low:high], return_type="offset_mapping")["offsets"]]

    def borders(self, text: str, low: int, high: int) -> Iterator[int]:
        """The proven stable borders behind ``low`` and before ``high``: spaces that follow another character."""
        at = text.find(" ", low + 1, high)
        while at >= 0:
            if text[at - 1] not in (" ", MARK):
                yield at
            at = text.find(" ", at + 1, high)

    def count_huge(self, text: str) -> int:
        """Tokens of a text longer than a chunk.

        The left chunk ends at ``end`` and counts from ``begin``, the border of
        the splice before it.  The right one starts ``overlap`` characters before
        ``end``, wherever that is.
        """
        size, total, begin, at, end = len(text), 0, 0, 0, min(len(text), self.chunk)
        left, overlap = self.starts(text, at, end), self.overlap
        while end < size:
            low = max(begin, end - overlap)
            until = min(size, max(low + self.chunk, end + self.chunk // 2))
            right = border = None
            known = set(left)
            for place in self.borders(text, low, end):
                right = right or self.starts(text, low, until)
                if place in known and place in right:
                    border = place
                    break
            if border is not None:
                total += sum(begin <= s < border for s in left)
                begin, at, end, left, overlap = border, low, until, right, self.overlap
            elif low > begin:
                overlap *= 2
            else:  # the left chunk has no border at all
                end, overlap = min(size, end + (end - at)), self.overlap
                left = self.starts(text, at, end)
        return total + sum(s >= begin for s in left)

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for at in range(0, len(texts), ROWS_AT_ONCE):
            part = texts[at : at + ROWS_AT_ONCE]
            huge = [self.proven and len(t) > self.chunk for t in part]
            short = iter(self.model.encode([t for t, h in zip(part, huge) if not h], num_threads=1))
            out += [self.count_huge(t) if h else len(next(short)) for t, h in zip(part, huge)]
        return out


_loaded: dict[tuple, ChunkedCounter] = {}


def counter(path: str, chunk: int, overlap: int) -> ChunkedCounter:
    """One counter a worker process and setting."""
    key = (path, chunk, overlap)
    if key not in _loaded:
        _loaded[key] = ChunkedCounter(*key)
    return _loaded[key]


def count_column(path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """Column function text -> number of tokens; null counts as the empty text."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = counter(path, chunk, overlap)
        for texts in parts:
            yield pd.Series(model.count(["" if t is None else t for t in texts]), dtype="int64")

    return count


def count_tokens(docs: DataFrame, path: str, text: str = "text", into: str = "n_tokens", limit: int = 4096, over: str = "over_limit") -> DataFrame:
    """``docs`` with the token count of each text in ``into`` and whether it is over ``limit`` in ``over`` (replacing columns of those names).

    Null text: 0 tokens, like the empty text.  Each row is counted by itself and
    in bounded chunks, so ties, repeated rows, empty tables and very long texts
    need no rule; other columns pass through, null or not.
    """
    return docs.withColumn(into, count_column(path)(F.col(text))).withColumn(over, F.col(into) > limit)


def count_documents(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every document."""
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return count_tokens(sized, path, limit=limit).select("doc_id", "n_bytes", "n_tokens", "over_limit")
