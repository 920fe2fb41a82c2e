"""Size-balanced shards by sampled splitters, in DataFrame functions.

Size-weighted samples of the sort key give quantile boundaries; records fall
into the ranges between them, ranges that turn out overfull are divided again at
boundaries sampled inside them, and the ordered ranges are laid end to end and
cut into shards of equal size.  Only one slim shuffle, by range, is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import free_name, settle

#: Ranges for each shard at least, rows of a range at most about, samples for each boundary, and how far over its share a range may be before it is divided.
RANGES_PER_SHARD, ROWS_PER_RANGE, SAMPLES_PER_RANGE, OVERFULL = 8, 4_000_000, 24, 2.0
SEED = 20240229


def splitters(rows: DataFrame, parts: dict[int, int], total: dict[int, int], oversample: int = SAMPLES_PER_RANGE, seed: int = SEED) -> dict[int, list]:
    """Quantile boundaries (order, row) that divide each range r of ``rows`` (columns r, k, size) into parts[r] pieces of like size.

    A row is drawn with the chance size * samples / total (a larger row counts
    for several), so the drawn rows' quantiles are quantiles of size.  The driver
    gets about ``oversample`` rows a piece, whatever the input's size.
    """
    if not parts:
        return {}
    rate = F.element_at(F.create_map(*[F.lit(x) for r, n in parts.items() for x in (r, n * oversample / max(1, total[r]))]), F.col("r"))
    expected = F.col("size") * rate
    drawn = rows.where(F.col("r").isin(list(parts))).select("r", "k", (F.floor(expected) + (F.rand(seed) < expected - F.floor(expected)).cast("int")).alias("weight"))
    drawn = drawn.where("weight > 0")
    ordered = Window.partitionBy("r").orderBy("k")
    placed = drawn.withColumn("upto", F.sum("weight").over(ordered)).withColumn("all", F.sum("weight").over(Window.partitionBy("r")))
    pieces = F.element_at(F.create_map(*[F.lit(x) for x in (y for p in parts.items() for y in p)]), F.col("r"))
    piece = lambda upto: F.least(F.floor(upto * pieces / F.col("all")), pieces - 1)
    bounds = placed.where(piece(F.col("upto")) > piece(F.col("upto") - F.col("weight"))).select("r", "k").distinct().orderBy("r", "k").collect()
    out: dict[int, list] = {}
    for b in bounds:
        out.setdefault(b.r, []).append(b.k)
    return out


def with_range(rows: DataFrame, key: str, bounds: list, into: str) -> DataFrame:
    """``rows`` with ``into``: how many of the sorted ``bounds`` are not above ``key``, by a binary search in halving steps."""
    if not bounds:
        return rows.withColumn(into, F.lit(0))
    kind = rows.schema[key].dataType.simpleString()
    values = F.array(*[F.struct(*[F.lit(v) for v in b]).cast(kind) for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    onward = lambda at, step: F.when((at + step <= len(bounds)) & (F.get(values, at + step - 1) <= F.col(key)), at + step).otherwise(at)
    return rows.withColumn(into, F.aggregate(steps, F.lit(0), onward))


def _nulls_first(bound) -> tuple:
    return tuple((v is not None, v) for v in bound)


def find_ranges(slim: DataFrame, pieces: int, seed: int = SEED, rows_per_range: int = ROWS_PER_RANGE) -> tuple[list, list[tuple[int, int]]]:
    """Boundaries that cut ``slim`` (columns k, size) into ranges of like size, and each range's (size, rows).

    There are about ``pieces`` of them, or as many more as keep the mean range at
    ``rows_per_range`` rows.  Overfull ranges, by size or by rows, are divided
    until none is left that a new boundary can divide.
    """

    def held(bounds: list) -> tuple[DataFrame, list[tuple[int, int]]]:
        ranged = with_range(slim, "k", bounds, "r")
        sums = {x.r: (x.size, x.n) for x in ranged.groupBy("r").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
        return ranged, [sums.get(r, (0, 0)) for r in range(len(bounds) + 1)]

    bounds: list = []
    ranged, sums = held(bounds)
    pieces = max(pieces, -(-sums[0][1] // rows_per_range))
    share = max(1, sums[0][0] // pieces)
    turn = 0
    while True:
        parts = {r: max(-(-size // share), -(-n // rows_per_range)) for r, (size, n) in enumerate(sums) if n > 1 and (size > OVERFULL * share or n > OVERFULL * rows_per_range)}
        more = splitters(ranged, parts, {r: sums[r][0] for r in parts}, seed=seed + turn)
        grown = sorted({*map(tuple, bounds), *(tuple(b) for x in more.values() for b in x)}, key=_nulls_first)
        if len(grown) == len(bounds):
            return bounds, sums
        bounds, turn = grown, turn + 1
        ranged, sums = held(bounds)


def shard_by_size(df: DataFrame, shards: int, key: list[str], size: str, shard: str = "shard", slot: str = "slot", seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... within the shard) in order of ``key``.

    Shard sizes differ by less than two of the largest rows.  Rows of one key
    are ordered by where they were read, so a key that holds most rows is
    divided like any other, and repeated rows get slots of their own.  Null keys
    come first; a null or negative size counts as 0.  Columns named as the
    results are replaced, others pass through.  An empty table gives an empty
    result.  ``df`` must read the same rows in the same order each time, as
    files and checkpoints do.
    """
    df = df.drop(shard, slot)
    k, r, bytes_, nth, upto = (free_name(df, n) for n in ("k", "r", "bytes", "nth", "upto"))
    full = df.withColumn(bytes_, F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)))
    full = full.withColumn(k, F.struct(*[F.col(c) for c in key], F.monotonically_increasing_id().alias("row")))
    bounds, sums = find_ranges(full.select(F.col(k).alias("k"), F.col(bytes_).alias("size")), shards * RANGES_PER_SHARD, seed)
    total, offsets = 0, []
    for held, _ in sums:
        offsets.append(total)
        total += held
    # A row lies where its middle lies; positions are doubled to stay whole numbers.
    shard_at = lambda doubled: min(shards - 1, doubled * shards // max(1, 2 * total))
    ordered = Window.partitionBy(r).orderBy(k)
    before = F.get(F.array(*[F.lit(2 * x).cast("long") for x in offsets]), F.col(r))
    placed = with_range(full, k, bounds, r).withColumn(nth, F.row_number().over(ordered)).withColumn(upto, F.sum(bytes_).over(ordered))
    doubled = before + 2 * F.col(upto) - F.col(bytes_)
    placed = placed.withColumn(shard, F.least(F.lit(shards - 1), F.floor(doubled * F.lit(shards).cast("long") / F.lit(max(1, 2 * total)))).cast("int"))
    first = [shard_at(2 * o) for o in offsets]
    cut = [i for i, (held, n) in enumerate(sums) if n and shard_at(2 * (offsets[i] + held)) != first[i]]
    split: dict[int, dict[int, int]] = {i: {first[i]: n} for i, (_, n) in enumerate(sums)}
    split |= {i: {} for i in cut}
    for x in placed.where(F.col(r).isin(cut)).groupBy(F.col(r).alias("r"), F.col(shard).alias("s")).agg(F.count("*").alias("n")).collect() if cut else []:
        split[x.r][x.s] = x.n
    rows_of, starts = [0] * shards, []
    for i in range(len(sums)):
        within, row = 0, []
        for s in range(first[i], max(split[i], default=first[i]) + 1):
            row.append(rows_of[s] - within)  # the range's rows of earlier shards are not the shard's
            n = split[i].get(s, 0)
            rows_of[s] += n
            within += n
        starts.append(row)
    start = F.get(F.get(F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in starts]), F.col(r)), F.col(shard) - F.get(F.array(*map(F.lit, first)), F.col(r)))
    return placed.select(*df.columns, shard, (F.col(nth) - 1 + start).cast("long").alias(slot))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, plus 8), text_crc32, law, shard, slot and grown_shard of every document."""
    slim = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    placed = shard_by_size(settle(slim), shards, ["doc_id"], "size")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
