"""Vector codes: each of a vector's parts becomes the number of its nearest codebook entry.

All arithmetic is on integers, so codes and codebooks are the same on any
cluster.  Most parts are proven to keep their entry without a look at the other
entries: each part carries an upper bound on the distance to its entry and a
lower bound on that to every other, each with the round it was computed in.  The
codebooks of all rounds are kept; a bound of round ``r`` moves by the distance
between the entry now and in round ``r`` (the norm of the sum of its moves),
which is never more than the sum of the norms.  Only a part whose bounds meet is
measured against all entries.

The history of codebooks is a few kilobytes a round whatever the number of
vectors; vectors, codes and bounds stay in Spark's rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import release, settle, shared_frequent

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Integers up to here are exact in doubles.
EXACT = 2**53
#: Relative room for rounding in bounds.
ROOM = 1e-9
ROWS_AT_ONCE = 4096
STATE = "codes array<tinyint>, stamps array<tinyint>, bounds array<double>, rescans int, error long"


def squared(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances over the last axis; Python's integers where doubles can't hold them."""
    most = max([2 * int(np.abs(x).max()) for x in (parts, entries) if x.size], default=0)
    kind = np.float64 if parts.shape[-1] * most**2 < EXACT else object
    apart = parts.astype(kind) - entries.astype(kind)
    return (apart * apart).sum(-1)


def roots(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


class History:
    """The codebooks of all rounds so far, each of shape (parts, entries, width)."""

    def __init__(self, books: list[np.ndarray]):
        self.now, self.round = books[-1], len(books) - 1
        #: (rounds, parts, entries): how far each entry of a past round is from where it is now.
        self.moved = np.stack([roots(squared(self.now, b)) for b in books]) * (1 + ROOM)
        most = np.sort(self.moved, axis=2)
        alone = most.shape[2] == 1
        #: The farthest move of the other entries.
        self.others = np.where((self.moved == most[..., -1:]) & (not alone), most[..., -1 if alone else -2][..., None], most[..., -1:])

    def assign(self, vectors: np.ndarray, codes: np.ndarray | None, stamps: np.ndarray | None, bounds: np.ndarray | None):
        """Codes, stamps, bounds and number of rescanned parts; vectors are (rows, parts, width), codes (rows, parts), the others (rows, 2, parts)."""
        n, parts, _ = vectors.shape
        at = np.arange(parts)
        if codes is None:
            codes, stamps, bounds = np.zeros((n, parts), np.int64), np.zeros((n, 2, parts), np.int64), np.zeros((n, 2, parts))
            doubt = np.ones((n, parts), bool)
        else:
            upper = bounds[:, 0] + self.moved[stamps[:, 0], at, codes]
            lower = bounds[:, 1] - self.others[stamps[:, 1], at, codes]
            doubt = upper * (1 + ROOM) >= lower
            row, part = np.nonzero(doubt)
            bounds[row, 0, part] = roots(squared(vectors[row, part], self.now[part, codes[row, part]]))
            stamps[row, 0, part] = self.round
            doubt[row, part] = bounds[row, 0, part] * (1 + ROOM) >= lower[row, part]
        for part in range(parts):
            row = np.flatnonzero(doubt[:, part])
            if not len(row):
                continue
            far = squared(vectors[row, part][:, None], self.now[part][None])
            best = far.argmin(1)  # the first of equal ones
            two = np.partition(far, 1, axis=1)[:, :2] if far.shape[1] > 1 else np.column_stack((far[:, 0], np.full(len(row), np.inf)))
            codes[row, part], stamps[row, :, part] = best, self.round
            bounds[row, :, part] = roots(two) * (1 - ROOM, 1 - ROOM)
            bounds[row, 0, part] = roots(two[:, 0])
        return codes, stamps, bounds, doubt.sum(1)

    def errors(self, vectors: np.ndarray, codes: np.ndarray) -> list[int]:
        return [int(sum(r)) for r in squared(vectors, self.now[np.arange(codes.shape[1]), codes])]


def numbers(batch: pa.RecordBatch, name: str, shape: tuple, kind) -> np.ndarray:
    return np.asarray(batch.column(name).flatten(), kind).reshape(batch.num_rows, *shape)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel(), kind))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def one_round(rows: DataFrame, books: list[np.ndarray], last: bool = False) -> DataFrame:
    """``rows`` (with ``whole``) assigned to the newest of ``books``; errors are filled in the last round only."""
    parts, width = books[0].shape[0], books[0].shape[2]
    kept = [c for c in rows.columns if c not in ("codes", "stamps", "bounds", "rescans", "error")]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history = History(books)
        for b in slices(batches):
            vectors = numbers(b, "whole", (parts, width), np.int64)
            old = (None, None, None) if "codes" not in b.schema.names else (numbers(b, "codes", (parts,), np.int64), numbers(b, "stamps", (2, parts), np.int64), numbers(b, "bounds", (2, parts), np.float64).copy())
            codes, stamps, bounds, rescans = history.assign(vectors, *old)
            error = pa.array(history.errors(vectors, codes) if last else [None] * len(codes), pa.int64())
            new = [lists(codes, pa.int8()), lists(stamps, pa.int8()), lists(bounds, pa.float64()), pa.array(rescans, pa.int32()), error]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *new], [*kept, "codes", "stamps", "bounds", "rescans", "error"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)
    return rows.mapInArrow(assign, f"{shape}, {STATE}")


def part_sums(rows: DataFrame, parts: int, entries: int, width: int) -> DataFrame:
    """(part, entry, n, s0, s1, ...): one row for each part and used entry."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for b in slices(batches):
            vectors, codes = numbers(b, "whole", (parts, width), np.int64), numbers(b, "codes", (parts,), np.int64)
            small = not vectors.size or len(vectors) * int(np.abs(vectors).max()) < EXACT
            for part in range(parts):
                n[part] += np.bincount(codes[:, part], minlength=entries)
                if small:
                    total[part] += np.stack([np.bincount(codes[:, part], vectors[:, part, i], entries).astype(np.int64) for i in range(width)], 1) if width else 0
                else:
                    np.add.at(total[part], codes[:, part], vectors[:, part].astype(object))
        used = np.argwhere(n)
        columns = [pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(n[n > 0], pa.int64())]
        sums = [pa.array([Decimal(int(total[p, e, i])) for p, e in used], pa.decimal128(38, 0)) for i in range(width)]
        yield pa.RecordBatch.from_arrays([*columns, *sums], ["part", "entry", "n", *(f"s{i}" for i in range(width))])

    shape = "part int, entry int, n long" + "".join(f", s{i} decimal(38,0)" for i in range(width))
    return rows.select("whole", "codes").mapInArrow(add, shape).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])


def whole_vectors(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """The rows whose vector and its components are there and finite, with floor(scale * x) in ``whole``."""
    x = F.col(vector)
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(x.isNotNull() & fit).withColumn("whole", F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long")))


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray | None]:
    """(key, label, codes, error, rescans) of every kept vector, and the final codebooks (parts, entries, width).

    Dropped: vectors that are null or hold null or non-finite components.  A null
    key comes after all others in the choice of the first entries, equal keys are
    ordered by their vectors; repeated rows and rows with null key or label are
    coded like any other.  With fewer kept rows than ``entries`` the codebooks are
    as short; without any the result is empty and the codebooks are None.  Vectors
    of different lengths, or of a length that ``parts`` doesn't divide, are an
    error.  Other columns are not read.
    """
    first = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows = settle(whole_vectors(first, "vector", scale).drop("vector"))
    low, high = rows.agg(F.min(F.size("whole")), F.max(F.size("whole"))).first()
    if low is None:
        return rows.select("key", "label", F.lit(None).cast("array<tinyint>").alias("codes"), F.lit(0).cast("long").alias("error"), F.lit(0).alias("rescans")), None
    if low != high or low % parts:
        raise ValueError(f"vectors have {low} to {high} components; one length is needed that {parts} divides")
    width = low // parts
    start = rows.orderBy(F.col("key").asc_nulls_last(), "whole").limit(entries).select("whole").collect()  # ``entries`` rows
    books = [np.array([r["whole"] for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)]
    for _ in range(rounds):
        rows = settle(one_round(rows, books))
        release(rows.sparkSession)
        book = books[-1].copy()
        for r in part_sums(rows, *book.shape).collect():  # a row for each part and entry
            book[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
        books.append(book)
    rows = settle(one_round(rows, books, last=True))
    return rows.select("key", "label", "codes", "error", "rescans"), books[-1]


def digest_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (error summed over equal labels) and codebooks_sha256 of every kept vector."""
    rows, book = compress(embeddings)
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows_of_label"))
    held = shared_frequent(rows, sums, ["label"], "rows_of_label")
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest() if book is not None else ""
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")), "")
    return held.select(F.col("key").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The digest in DuckDB SQL: every part against every entry in every round."""
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale}.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS MATERIALIZED (SELECT vec_id, label, p, w[p * len(w) // {parts} + 1 : (p + 1) * len(w) // {parts}] AS v FROM kept, (SELECT unnest(range({parts})) AS p))",
        f"b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM cut WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT c.vec_id, c.label, c.p, any_value(c.v) AS v, min(list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {entries} + b.e) AS m FROM cut c JOIN b{r} b ON c.p = b.p GROUP BY c.vec_id, c.label, c.p)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT p, CAST(m % {entries} AS BIGINT) AS e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r})")
            steps.append(f"m{r} AS (SELECT p, e, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS v FROM (SELECT p, e, i, sum(x) AS total, count(*) AS n FROM s{r} GROUP BY p, e, i) GROUP BY p, e)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON b.p = m.p AND b.e = m.e)")
    steps.append(f"coded AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(m % {entries} AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)")
    steps.append(f"book AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM b{rounds}))")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, book"


SQL = sql()
