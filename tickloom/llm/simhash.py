"""SimHash fingerprints and their near-duplicate components, with candidates from pigeonring filtering.

Fingerprints are cut into ``SEGMENTS`` equal segments laid in a ring.  If two
differ in at most ``DISTANCE`` bits, then from some segment on every chain of 1,
2, 3, ... consecutive segments differs in at most its share of them, chain
length * DISTANCE / SEGMENTS bits.  While that share is below one bit the
segments must agree, so the first ones of a chain are an equi-join key; the
longer chains prune what the key lets through, and the full Hamming check
follows.

A key shared by more than ``BUCKET`` distinct fingerprints is divided by further
segments of the ring.  Behind the segments that must agree come those over which
a chain may gain one bit, then two, and so on; so of the first of these blocks
all segments but one agree, of the next all but two.  Each choice of the segments
left out gives a longer key.  For two bits and sixteen segments such a key fixes
56 of the 64 bits, so at most 256 fingerprints share one, however large the
group is.  The chain test and the Hamming check decide at every level.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tickloom.llm.common import forget, free_name, release, settle

BITS, DISTANCE, SEGMENTS, BUCKET = 64, 2, 16, 128
SHINGLE, SEED = 3, 42
ROWS_AT_ONCE, LINKS_PER_PARTITION = 16_384, 10_000


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of a text: A-Z lower-cased, words cut at ASCII white space, shingles of three words."""
    words = b"" if text is None else text.encode().lower()
    words = words.split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, ones, total = xxhash.xxh64_digest, np.zeros(BITS, np.int64), len(ends)
    for at in range(0, total, ROWS_AT_ONCE):
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + ROWS_AT_ONCE], ends[at : at + ROWS_AT_ONCE])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, BITS)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


@F.pandas_udf(LongType())
def fingerprint_column(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def ring_shape(segments: int = SEGMENTS, distance: int = DISTANCE, bits: int = BITS) -> tuple[int, int]:
    """Bits of a segment, and how many consecutive segments must agree: the longest chain with a share below one."""
    if bits % segments or not 0 < distance < segments:
        raise ValueError("segments must divide the bits and outnumber the distance")
    return bits // segments, (segments - 1) // distance


def ring_masks(segments: int = SEGMENTS, distance: int = DISTANCE, level: int = 0) -> list[int]:
    """The bits, from a chain's first segment on, that a key of this level holds; near pairs agree in one of them at least."""
    width, agree = ring_shape(segments, distance)
    one = lambda i: ((1 << width) - 1) << (BITS - (i + 1) * width)
    masks = [sum(map(one, range(agree)))]
    for extra in range(1, level + 1):  # a chain as long as one of this block may have gained ``extra`` bits
        block = [i for i in range(segments) if (i + 1) * distance // segments == extra]
        masks = [m + sum(one(i) for i in block if i not in out) for m, out in product(masks, combinations(block, min(extra, len(block))))]
    return masks


def ring_keys(fp: Column, segments: int = SEGMENTS, distance: int = DISTANCE, level: int = 0) -> Column:
    """Array of (start, choice, key): for each start the fingerprint turned so that the chain comes first, cut to the bits of each of the level's masks."""
    width, _ = ring_shape(segments, distance)
    turned = [fp if not i else F.shiftleft(fp, i * width).bitwiseOR(F.shiftrightunsigned(fp, BITS - i * width)) for i in range(segments)]
    masks = [m - (1 << BITS) if m >> (BITS - 1) else m for m in ring_masks(segments, distance, level)]
    return F.array(*[F.struct(F.lit(i).alias("start"), F.lit(c).alias("choice"), t.bitwiseAND(F.lit(m)).alias("key")) for i, t in enumerate(turned) for c, m in enumerate(masks)])


def chains_hold(differ: np.ndarray, start: int, segments: int, distance: int) -> np.ndarray:
    """Which XORs of two fingerprints keep every chain from ``start`` within its share."""
    width = BITS // segments
    ok, so_far = np.ones(len(differ), bool), np.zeros(len(differ), np.int64)
    for length in range(1, segments + 1):
        segment = (start + length - 1) % segments
        so_far += np.bitwise_count((differ >> np.uint64(BITS - (segment + 1) * width)) & np.uint64((1 << width) - 1))
        ok &= so_far * segments <= length * distance
    return ok


def bucket_links(start: int, members: np.ndarray, segments: int, distance: int) -> list[tuple[int, int]]:
    """Links that join the members of one bucket as the pairs within ``distance`` do, at most one a member."""
    fps = np.unique(members).view(np.uint64)
    one, two = np.triu_indices(len(fps), 1)
    differ = fps[one] ^ fps[two]
    ring = chains_hold(differ, start, segments, distance)
    one, two, differ = one[ring], two[ring], differ[ring]
    near = np.bitwise_count(differ) <= distance
    root = list(range(len(fps)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    signed, out = fps.view(np.int64).tolist(), []
    for a, b in zip(one[near].tolist(), two[near].tolist()):
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((signed[a], signed[b]))
    return out


def ring_links(segments: int, distance: int):
    def of_buckets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [pair for start, members in zip(part["start"], part["members"]) for pair in bucket_links(start, np.asarray(members, np.int64), segments, distance)]
            yield pd.DataFrame(rows, columns=["a", "b"], dtype="int64")

    return of_buckets


def near_links(fps: DataFrame, segments: int = SEGMENTS, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links (a > b) between the distinct fingerprints of ``fps`` (column fp): their components are those of all pairs within ``distance`` bits.

    Buckets of more than ``bucket`` fingerprints are divided, level by level; what
    the last level holds together is compared whatever its size, which the bits
    left free by its masks bound.
    """
    place, found = ["start", "choice", "key"], []
    for level in range(distance):
        keyed = fps.select("fp", F.inline(ring_keys(F.col("fp"), segments, distance, level)))
        if level:  # only the members of crowded buckets come this far, each where it was crowded
            keyed = keyed.join(crowded, (keyed["start"] == crowded["in_start"]) & (keyed["fp"] == crowded["in_fp"]), "left_semi")
        last = level == distance - 1
        if last:
            buckets = settle(keyed.groupBy(*place).agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1))
            small = buckets
        else:
            ordered = Window.partitionBy(*place).orderBy("fp")
            few = keyed.withColumn("nth", F.row_number().over(ordered)).where(F.col("nth") <= bucket + 1)
            buckets = settle(few.groupBy(*place).agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1))
            small = buckets.where(F.size("members") <= bucket)
        found.append(small.mapInPandas(ring_links(segments, distance), "a long, b long"))
        if last:
            break
        full = buckets.where(F.size("members") > bucket).select(*place)
        crowded = settle(keyed.join(full, place, "left_semi").select(F.col("fp").alias("in_fp"), F.col("start").alias("in_start")).distinct())
        if crowded.isEmpty():
            break
        fps = crowded.select(F.col("in_fp").alias("fp")).distinct()
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a > b), the root being the least node it reaches.

    Alternates two steps until nothing changes: each node hangs its larger
    neighbours on its least neighbour, then each node hangs its smaller
    neighbours, and itself, on the least of them.  What is left are stars.  The
    number of rounds grows with the logarithm of the longest chain.
    """
    links, seen = settle(links), None
    while True:
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("all")).first()
        if now == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())
        # Partitions follow the number of links, so that a few of them are not dealt over many files again and again.
        seen, before, links = now, links, links.coalesce(1 + now["n"] // LINKS_PER_PARTITION)
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        big = links.join(least.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        least = big.groupBy("a").agg(F.min("b").alias("m"))
        moved = big.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = settle(moved.union(least.select("a", F.col("m").alias("b"))).distinct())
        del big, least, moved
        forget(before)
        release(links.sparkSession)  # else the rounds' shuffles pile up, each in a file for every pair of tasks


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", segments: int = SEGMENTS, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: the key, ``text_hash``, ``fp`` (signed 64-bit fingerprint) and ``component_id``, the least key its fingerprint reaches.

    Texts without words, null texts among them, have fingerprint 0 and link like
    any other.  Rows with a null key stay, but name no component (a component of
    such rows only has a null id).  Repeated rows and equal texts share a
    component; other columns are not read.  An empty table gives an empty result.
    A fingerprint shared by very many rows is one row of the link search; the
    joins that carry its component back leave its rows to adaptive skew splitting.
    """
    prints = settle(docs.select(F.col(key).alias("key"), text_hash(text).alias("text_hash"), fingerprint_column(F.col(text)).alias("fp")))
    first = prints.groupBy("fp").agg(F.min("key").alias("first"))
    roots = components(near_links(first.select("fp"), segments, distance, bucket))
    placed = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.join(placed.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("key").alias(key), "text_hash", "fp", "component_id")


def text_hash(text: str) -> Column:
    """Tells the texts of rows with one key apart."""
    return F.xxhash64(F.col(text).isNull(), F.col(text))


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without near duplicates: of each component one row stays, with all its columns.

    It is the row of the least key; of rows with that key in the component, the
    one of the least text hash, then of the least hash over all columns that can
    be hashed.  Rows with a null key all stay.  A key may stand on several rows
    with different texts; each is judged by its own text.
    """
    return first_of_each(docs, near_duplicates(docs, text, key), text, key)


def first_of_each(docs: DataFrame, found: DataFrame, text: str, key: str) -> DataFrame:
    """The row of ``docs`` with the least (key, text hash) of each component in ``found`` (key, text_hash, component_id), and the rows with a null key."""
    firsts = found.where(F.col(key).isNotNull()).groupBy("component_id").agg(F.min(F.struct(F.col(key).alias("k"), F.col("text_hash").alias("h"))).alias("f"))
    firsts = firsts.select("f.k", "f.h").distinct()
    name, again = free_name(docs, "text_hash"), free_name(docs, "nth")
    hashed = docs.withColumn(name, text_hash(text))
    kept = hashed.join(firsts, (F.col(key) == firsts["k"]) & (F.col(name) == firsts["h"]), "left_semi")
    sortable = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    once = Window.partitionBy(key, name).orderBy(F.xxhash64(*sortable))
    kept = kept.withColumn(again, F.row_number().over(once)).where(F.col(again) == 1).drop(again, name)
    return kept.union(docs.where(F.col(key).isNull()))


def digest_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
