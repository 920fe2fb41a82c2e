"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed in Arrow batches.  Trees are grown on the driver from a
bounded sample of labelled rows, over binned columns, and flattened into arrays
that score a batch of documents by indexing alone: all trees at once, one level
a step.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound on the labelled rows that are collected to fit a model.
FIT_ROWS = 40_000

FEATURES = (
    "log_chars", "log_words", "mean_word", "sd_word", "upper", "digit", "symbol", "pipe", "space", "punctuation", "non_ascii", "control",
    "log_lines", "words_a_line", "repeated_lines", "ended_lines", "distinct_words", "top_word", "doubled_words", "distinct_pairs", "capital_words", "symbol_words", "entropy", "longest_word",
)

_CLASS = np.full(256, 7)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A] = 0, 1, 2
for _group, _bytes in ((3, b"#*$%&<>@^_=+~\\/{}[]`"), (4, b"|"), (5, b" \t\n\r\x0b\x0c"), (6, b".,;:!?'\"()-")):
    _CLASS[list(_bytes)] = _group
_CLASS[0x80:] = 8
_ENDED = re.compile(r"""[.!?…:;]["')\]]?\s*$""")
_BARE = re.compile(r"[#*$%&|<>]")


def statistics(text: str | None) -> list[float]:
    """The FEATURES of a whole text; the empty text and null have zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode(), np.uint8)
    bytes_ = np.bincount(raw, minlength=256)
    kinds = np.bincount(_CLASS, bytes_, 9) / len(raw)
    share = bytes_[bytes_ > 0] / len(raw)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    pairs = len(set(pairwise(words))) / max(1, len(words) - 1)
    return [
        np.log1p(len(text)), np.log1p(len(words)), sizes.mean(), sizes.std(), kinds[0], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[8], kinds[7],
        np.log1p(len(lines)), n / m, 1 - len(set(lines)) / m, sum(1 for x in lines if _ENDED.search(x[-8:])) / m, len(counts) / n, max(counts.values(), default=0) / n,
        sum(a == b for a, b in pairwise(words)) / n, pairs, sum(1 for w in counts if w[0].isupper()) / max(1, len(counts)), sum(c for w, c in counts.items() if _BARE.search(w)) / n,
        float(-(share * np.log2(share)).sum()), np.log1p(sizes.max()),
    ]


@dataclass
class Trees:
    """Boosted trees in flat arrays; ``child`` holds the left child, the right one follows it, and leaves point to themselves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of quality 1 for each row of statistics."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = self.child[node] + (x[rows, self.feature[node]] > self.threshold[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: int = 4) -> Trees:
    """Logistic boosting; each node takes the split with the greatest gain over the bins' histograms of first and second derivatives."""
    y = y.astype(float)
    if len(y) == 0:
        return Trees(0.0, *(np.zeros(0, t) for t in (int, float, int, float, int)), 0)
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    feature, threshold, child, value, roots = [], [], [], [], []

    def leaf(v: float) -> int:
        feature.append(0)
        threshold.append(np.inf)
        child.append(len(child))
        value.append(v)
        return len(child) - 1

    margin = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(leaf(0.0))
        level = [(roots[-1], np.arange(len(y)))]
        for deep in range(depth + 1):
            below = []
            for node, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = float(-rate * gs / (hs + ridge))
                best = (1e-6, -1, -1)
                if deep < depth and len(rows) >= 2 * least:
                    for f in range(x.shape[1]):
                        b = binned[rows, f]
                        k = len(cuts[f]) + 1
                        gl, hl, nl = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (g[rows], h[rows], None))
                        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                        gain[(nl < least) | (len(rows) - nl < least)] = 0
                        if len(gain) and gain.max() > best[0]:
                            best = (gain.max(), f, int(gain.argmax()))
                if best[1] >= 0:
                    left = binned[rows, best[1]] <= best[2]
                    feature[node], threshold[node], child[node] = best[1], cuts[best[1]][best[2]], len(child)
                    below += [(leaf(0.0), rows[left]), (leaf(0.0), rows[~left])]
                else:
                    margin[rows] += value[node]
            level = below
    return Trees(base, np.array(feature), np.array(threshold), np.array(child), np.array(value), np.array(roots), depth)


def remainder(key: str = "doc_id"):
    """crc32 of the id as text, modulo 3; rows with remainder 1 are held out from fitting."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3))


def statistics_column():
    @F.pandas_udf("array<double>")
    def measure(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([statistics(t) for t in texts], dtype=object)

    return measure


def fit_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **settings) -> Trees:
    """Trees fitted to ``labels.quality`` of at most ``fit_rows`` labelled documents that are not held out.

    Rows without id, quality or document are not used.  An id labelled more than
    once counts once, by most of its labels; of several documents with one id the
    one with the least statistics does.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder() != 1))
    one_each = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    # Both the ids that are broadcast and the rows that are collected are at most fit_rows.
    drawn = one_each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    measured = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", statistics_column()(F.col("text")).alias("x"))
    rows = measured.groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("one")).select("doc_id", "one.*").collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.quality for r in rows]), **settings)


def score_column(model: Trees):
    """Column function text -> score between 0 and 1; null scores as the empty text."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pd.Series(model.score(x) if len(x) else np.zeros(0))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", into: str = "score", **settings) -> DataFrame:
    """``docs`` with the chance that each text is of quality 1 in ``into`` (replacing a column of that name).

    Null and empty texts get the score of a text whose statistics are all 0;
    without usable labels every score is 0.5.  Texts are read whole; repeated
    rows score alike; other columns pass through.
    """
    return docs.withColumn(into, score_column(fit_documents(docs, labels, **settings))(F.col(text)))


def digest_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score_documents(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", (remainder() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
