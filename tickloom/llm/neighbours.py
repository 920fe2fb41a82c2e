"""Nearest neighbours by inner product, with learned partitions.

A bounded sample is joined to a graph of nearest neighbours, the graph is cut
into partitions of equal size with few edges between them, and a small
classifier learns from a vector in which partitions its neighbours lie.  Every
vector is put into its most probable partition.  A partition that is still large
is divided again in the same way with a sample and a classifier of its own, so
the index is a tree whose fitting, too, is spread over Spark's tasks.  A query
goes to the most probable partitions until they hold enough probability; how
much is enough is measured on held-out vectors of the sample.  In the partitions
reached, candidates are ranked by their exact inner product.

Equal vectors are one row of the index: of their ids only the smallest can be
among the nearest of any query.  Rows of a partition, and queries that reach it,
are cut into blocks, so no task holds more than two of these.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import settle, shared_frequent

NEAREST, EVERY = 20, 20
#: Children of a node; vectors a fit sees; rows above which a partition is divided; rows and queries of a block.
BRANCH, SAMPLE, LEAF_ROWS, BLOCK = 16, 8_192, 8_192, 8_192
#: Share of held-out neighbours that each level has to reach.
REACH = 0.97
#: A child with more than this share of its node's rows shows that the node can't be divided.
UNDIVIDED = 0.9
GRAPH, HIDDEN, EPOCHS, HELD_OUT, QUERIES_AT_ONCE, PAIRS_AT_ONCE = 10, 64, 40, 8, 512, 65_536


# -- one partitioner ------------------------------------------------------------------
def graph_of(vectors: np.ndarray, among: np.ndarray, k: int, same: bool) -> np.ndarray:
    """Of each vector the places of its ``k`` nearest in ``among`` (without itself if ``same``)."""
    out = []
    for at in range(0, len(vectors), QUERIES_AT_ONCE):
        near = vectors[at : at + QUERIES_AT_ONCE] @ among.T
        if same:
            near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out.append(np.argpartition(-near, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_cut(near: np.ndarray, parts: int, seed: int = 0, slack: float = 1.05) -> np.ndarray:
    """A partition of the graph's vertices into ``parts`` (a power of two) of nearly equal size and few cut edges.

    Halves along the slowest mode of a random walk, again and again, then moves
    of single vertices to the part of most neighbours while it has room.
    """
    n, draw = len(near), np.random.default_rng(seed)
    one, two = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    one, two = np.concatenate((one, two)), np.concatenate((two, one))
    part, groups = np.zeros(n, np.int64), [np.arange(n)]
    while len(groups) < parts:
        halves = []
        for own in groups:
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            inner = (place[one] >= 0) & (place[two] >= 0)
            a, b = place[one[inner]], place[two[inner]]
            degree = np.maximum(np.bincount(a, minlength=len(own)), 1)
            mode = draw.normal(size=len(own))
            for _ in range(60):
                mode -= (degree @ mode) / degree.sum()
                mode = (mode + np.bincount(a, mode[b], len(own)) / degree) / 2
                mode /= np.linalg.norm(mode) or 1
            order = np.argsort(mode, kind="stable")
            halves += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
        groups = halves
    for i, own in enumerate(groups):
        part[own] = i
    room = int(np.ceil(n / parts * slack))
    for _ in range(30):
        gain = np.bincount(one * parts + part[two], minlength=n * parts).reshape(n, parts)
        to = gain.argmax(1)
        better = gain[np.arange(n), to] - gain[np.arange(n), part]
        moving = np.flatnonzero((better > 0) & (draw.random(n) < 0.5))
        moving = moving[np.lexsort((-better[moving], to[moving]))]
        nth = np.arange(len(moving)) - np.searchsorted(to[moving], to[moving])
        moving = moving[nth < np.maximum(room - np.bincount(part, minlength=parts), 0)[to[moving]]]
        part[moving] = to[moving]
        if len(moving) < n // 500 + 1:
            break
    return part


class Router:
    """A network with one hidden layer from a vector to the probabilities of the partitions."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays

    @classmethod
    def fit(cls, vectors: np.ndarray, targets: np.ndarray, seed: int = 0) -> Router:
        draw = np.random.default_rng(seed)
        scale = 1 / (np.sqrt((vectors**2).mean()) or 1)
        x_all, width = vectors * scale, vectors.shape[1]
        layers = [draw.normal(size=(width, HIDDEN)) * np.sqrt(2 / width), np.zeros(HIDDEN), draw.normal(size=(HIDDEN, targets.shape[1])) / np.sqrt(HIDDEN), np.zeros(targets.shape[1])]
        mean, square, step = [0 * p for p in layers], [0 * p for p in layers], 0
        for _ in range(EPOCHS):
            order = draw.permutation(len(x_all))
            for at in range(0, len(order), 256):
                x, y = x_all[order[at : at + 256]], targets[order[at : at + 256]]
                hidden = np.maximum(x @ layers[0] + layers[1], 0)
                off = (softmax(hidden @ layers[2] + layers[3]) - y) / len(x)
                back = (off @ layers[2].T) * (hidden > 0)
                step += 1
                for i, g in enumerate((x.T @ back, back.sum(0), hidden.T @ off, off.sum(0))):
                    mean[i], square[i] = 0.9 * mean[i] + 0.1 * g, 0.999 * square[i] + 0.001 * g * g
                    layers[i] = layers[i] - 3e-3 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
        return cls({"scale": np.array(scale), **{f"layer{i}": p for i, p in enumerate(layers)}, "mass": np.array(1.0)})

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        a = self.arrays
        return softmax(np.maximum((vectors * a["scale"]) @ a["layer0"] + a["layer1"], 0) @ a["layer2"] + a["layer3"])

    def home(self, vectors: np.ndarray) -> np.ndarray:
        return self.probabilities(vectors).argmax(1)

    def mass_before(self, vectors: np.ndarray) -> np.ndarray:
        """Of each partition the probability of all more probable ones."""
        p = self.probabilities(vectors)
        order = np.argsort(-p, axis=1, kind="stable")
        sorted_p = np.take_along_axis(p, order, 1)
        out = np.empty_like(p)
        np.put_along_axis(out, order, np.cumsum(sorted_p, 1) - sorted_p, 1)
        return out

    def visits(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of vectors, partitions): the most probable ones until they hold the router's mass."""
        return np.nonzero(self.mass_before(vectors) <= float(self.arrays["mass"]))

    def packed(self) -> bytes:
        np.savez(out := io.BytesIO(), **self.arrays)
        return out.getvalue()

    @classmethod
    def unpacked(cls, packed: bytes) -> Router:
        with np.load(io.BytesIO(packed)) as arrays:
            return cls(dict(arrays))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_router(vectors: np.ndarray, seed: int = 0) -> Router:
    """Graph, partition and classifier over a sample; every HELD_OUT-th vector only measures how much probability to visit."""
    vectors = vectors.astype(np.float64)
    held = np.arange(len(vectors)) % HELD_OUT == HELD_OUT - 1
    train, test = vectors[~held], vectors[held]
    parts = 1 << int(np.log2(max(1, min(BRANCH, len(train) // (2 * GRAPH)))))
    if parts == 1:
        return Router.fit(vectors, np.ones((len(vectors), 1)), seed)
    near = graph_of(train, train, min(GRAPH, len(train) - 1), True)
    part = balanced_cut(near, parts, seed)
    around = np.bincount(np.repeat(np.arange(len(train)), near.shape[1]) * parts + part[near].ravel(), minlength=len(train) * parts).reshape(-1, parts) / near.shape[1]
    router = Router.fit(train, (around + np.eye(parts)[part]) / 2, seed)
    if len(test):
        homes = router.home(train)[graph_of(test, train, min(NEAREST, len(train)), False)]
        before = np.sort(np.take_along_axis(router.mass_before(test), homes, 1).ravel())
        router.arrays["mass"] = np.array(before[min(len(before) - 1, int(np.ceil(REACH * len(before))))])
    return router


# -- the tree over Spark's rows ---------------------------------------------------------
def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def dealt(key: Column, size: Column, block: int) -> Column:
    """A row's block among as many as keep each at about ``block`` rows."""
    return F.pmod(F.xxhash64(key), F.ceil(size / block)).cast("int")


def with_sizes(rows: DataFrame) -> DataFrame:
    """``rows`` with the number of rows of their node in ``size``."""
    return shared_frequent(rows, rows.groupBy("node").agg(F.count("*").alias("size")), ["node"], "size")


def fit_nodes(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    ordered = part.sort_values("cls")  # so that a lost task is fitted alike again
    return pd.DataFrame({"node": [key[0]], "router": [fit_router(stacked(ordered["vector"]), seed=int(key[0]) % 2**32).packed()]})


def route_rows(rows: pd.DataFrame, routers: pd.DataFrame) -> pd.DataFrame:
    if len(rows) and len(routers):
        rows["node"] = rows["node"] * BRANCH + 1 + Router.unpacked(routers["router"].iloc[0]).home(stacked(rows["vector"]))
    return rows[["cls", "vector", "ids", "node", "size"]]


def route_queries(rows: pd.DataFrame, routers: pd.DataFrame) -> pd.DataFrame:
    if len(rows) and len(routers):
        place, part = Router.unpacked(routers["router"].iloc[0]).visits(stacked(rows["vector"]))
        rows = rows.iloc[place].assign(node=rows["node"].to_numpy()[place] * BRANCH + 1 + part)
    return rows[["cls", "vector", "node"]]


def routed(rows: DataFrame, routers: DataFrame, route, schema: str) -> DataFrame:
    """``rows`` (with ``size``) through their node's router: blocks of rows meet a copy of the router each."""
    blocks = rows.groupBy("node").agg(F.max(F.ceil(F.col("size") / BLOCK)).cast("int").alias("blocks"))
    copies = routers.join(blocks, "node").select("node", "router", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = rows.withColumn("block", dealt(F.col("cls"), F.col("size"), BLOCK))
    return rows.groupBy("node", "block").cogroup(copies.groupBy("node", "block")).applyInPandas(route, schema)


def vector_classes(vectors: DataFrame, nearest: int) -> DataFrame:
    """(cls, vector, ids, node), all at node 0: different vectors with the ``nearest`` + 1 smallest of their ids; no query can have more of them among its nearest."""
    by_id = Window.partitionBy("vector").orderBy("id")
    few = vectors.distinct().withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= nearest + 1)
    grouped = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return grouped.select(F.concat_ws(":", F.element_at("ids", 1), F.hex(F.xxhash64("vector"))).alias("cls"), "vector", "ids", F.lit(0).cast("long").alias("node"))


def build_index(classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(cls, vector, ids, node) with each row of ``classes`` (all at node 0) in its leaf, and the (node, router) tables of the levels."""
    kind = dict(classes.dtypes)["vector"]
    rows, levels = with_sizes(classes), []
    large, done = rows, None
    while True:
        chance = F.pmod(F.xxhash64("cls", F.lit(7)), F.lit(1 << 30)) / (1 << 30)
        sample = large.where(chance < SAMPLE / F.col("size")).select("node", "cls", "vector")
        routers = settle(sample.groupBy("node").applyInPandas(fit_nodes, "node long, router binary"))
        levels.append(routers)
        moved = routed(large, routers, route_rows, f"cls string, vector {kind}, ids array<long>, node long, size long").withColumnRenamed("size", "above")
        moved = settle(with_sizes(moved))
        more = (F.col("size") > LEAF_ROWS) & (F.col("size") <= UNDIVIDED * F.col("above"))
        leaves = moved.where(~more).select("cls", "vector", "ids", "node")
        done = leaves if done is None else done.union(leaves)
        large = moved.where(more).drop("above")
        if large.isEmpty():
            return done, levels


def best_of(ids: np.ndarray, owner: np.ndarray, near: np.ndarray, rows: np.ndarray, queries: np.ndarray, nearest: int):
    """(places of queries, ids, scores): each query's nearest ids, ``near`` being inner products of queries and rows of a block."""
    keep = min(nearest, near.shape[1])
    least = -np.partition(-near, keep - 1, axis=1)[:, keep - 1]
    # The product of a pair may differ in its last digits with its place in the matrix: keep what is that close, then sum it anew.
    q, r = np.nonzero(near >= (least - 1e-9 * np.maximum(1, np.abs(least)))[:, None])
    score = np.concatenate([(queries[q[i : i + PAIRS_AT_ONCE]] * rows[r[i : i + PAIRS_AT_ONCE]]).sum(1) for i in range(0, len(q), PAIRS_AT_ONCE)])
    first, count = np.searchsorted(owner, r, "left"), np.searchsorted(owner, r, "right") - np.searchsorted(owner, r, "left")
    q, score = np.repeat(q, count), np.repeat(score, count)
    found = ids[np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)]
    order = np.lexsort((found, -score, q))
    q, found, score = q[order], found[order], score[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    return q[nth < nearest], found[nth < nearest], score[nth < nearest]


def search_block(nearest: int):
    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            matrix = stacked(rows["vector"])
            ids, owner = np.concatenate(rows["ids"].to_numpy()), np.repeat(np.arange(len(rows)), rows["ids"].map(len))
            for at in range(0, len(queries), QUERIES_AT_ONCE):
                part = queries.iloc[at : at + QUERIES_AT_ONCE]
                own = stacked(part["vector"])
                q, found, score = best_of(ids, owner, own @ matrix.T, matrix, own, nearest)
                out.append(pd.DataFrame({"cls": part["cls"].to_numpy()[q], "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"cls": pd.Series(dtype=str), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})

    return search


def search(rows: DataFrame, queries: DataFrame, nearest: int) -> DataFrame:
    """(cls, vec_id, score): the ``nearest`` + 1 ids of the rows of all nodes that a query stands at."""
    shape = rows.groupBy("node").agg(F.count("*").alias("n")).join(queries.groupBy("node").agg(F.count("*").alias("m")), "node")
    shape = shape.select("node", "n", "m", (F.col("n") + F.col("m")).alias("both"))
    spread = lambda size: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(size) / BLOCK) - 1).cast("int")))
    blocks = shared_frequent(rows, shape, ["node"], "both").withColumn("block", dealt(F.col("cls"), F.col("n"), BLOCK)).withColumn("chunk", spread("m"))
    chunks = shared_frequent(queries, shape, ["node"], "both").withColumn("chunk", dealt(F.col("cls"), F.col("m"), BLOCK)).withColumn("block", spread("n"))
    place = ["node", "block", "chunk"]
    found = chunks.select(*place, "cls", "vector").groupBy(*place).cogroup(blocks.select(*place, "vector", "ids").groupBy(*place)).applyInPandas(search_block(nearest + 1), "cls string, vec_id long, score double")
    first = Window.partitionBy("cls").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= nearest + 1).drop("nth")


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of the rows with an id and a vector that is finite and not zero."""
    x = F.col(vector)
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.where(F.col(key).isNotNull() & x.isNotNull() & fit).select(F.col(key).cast("long").alias("id"), x.alias("vector"))


def nearest_neighbours(vectors: DataFrame, queries: Column | None = None, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's nearest rows by inner product; ties go to the smaller id.

    ``queries`` is a condition on ``id`` that says which rows are queries (all by
    default).  Rows with a null id, and vectors that are null, zero or hold null or non-finite components,
    take no part.  Repeated rows count once; an id with several vectors is one
    candidate for each of them, and no row is a candidate for its own id.  A query
    whose partitions hold too few candidates searches all rows, so it always has
    ``nearest`` of them, or all there are; an empty table gives an empty result.  Vectors of different lengths are an error.  Other
    columns are not read.
    """
    fit = settle(usable(vectors, key, vector))
    low, high = fit.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if low != high:
        raise ValueError(f"vectors have {low} to {high} components")
    asked = fit.where(queries if queries is not None else F.lit(True)).distinct()
    classes = settle(vector_classes(fit, nearest))
    rows, levels = build_index(classes)
    asked = settle(asked.join(classes.select("vector", "cls", "node"), "vector").select(F.col("id").alias("query_id"), "cls", "vector", "node"))
    kind = dict(classes.dtypes)["vector"]
    going = asked.select("cls", "vector", "node").distinct()
    arrived = None
    for routers in levels:
        sized = with_sizes(going)
        inner = settle(routed(sized.join(routers.select("node"), "node", "left_semi"), routers, route_queries, f"cls string, vector {kind}, node long"))
        stay = going.join(routers.select("node"), "node", "left_anti").select("cls", "vector", "node")
        arrived = stay if arrived is None else arrived.union(stay)
        going = inner
    arrived = settle(arrived.union(going))
    few = settle(search(rows, arrived, nearest))
    total = classes.select(F.sum(F.size("ids"))).first()[0] or 0
    lacking = few.groupBy("cls").agg(F.count("*").alias("got")).where(F.col("got") > min(nearest, total - 1))
    short = asked.select("cls", "vector").distinct().join(lacking, "cls", "left_anti")
    if not short.isEmpty():
        whole = F.lit(0).cast("long")
        again = search(rows.withColumn("node", whole), short.withColumn("node", whole), nearest)
        few = few.join(short.select("cls"), "cls", "left_anti").union(again)
    each = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = asked.select("query_id", "cls").join(few, "cls").where(F.col("query_id") != F.col("vec_id"))
    return pairs.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def digest_neighbours(embeddings: DataFrame) -> DataFrame:
    """The nearest rows of every row whose id is divisible by EVERY."""
    return nearest_neighbours(embeddings, F.col("id") % EVERY == 0)
