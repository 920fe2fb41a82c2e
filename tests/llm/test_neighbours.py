"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import neighbours as nn
from tickloom.llm import registry

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, node string, id int, cls string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, None, 7, "c", 3) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, ids, nearest=20):
    """query id -> [(id, score)]; the rows are usable and their ids differ."""
    names, matrix, out = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float), {}
    for q in ids:
        score = matrix @ matrix[names == q][0]
        order = [j for j in np.lexsort((names, -np.round(score, 10))) if names[j] != q][:nearest]
        out[q] = [(int(names[j]), score[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12, atol=1e-12)


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_small_tables_are_whole(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=6)) for i in range(15)]
    bad = [(20, None), (40, [0.0] * 6), (60, [NAN] * 6), (80, [INF] + [1.0] * 5), (100, [None] + [1.0] * 5), (None, [1.0] * 6)]
    same(found(nn.digest_neighbours(frame(spark, rows + bad + [rows[0], rows[3], rows[3]]))), brute(rows, [0]))
    assert found(nn.digest_neighbours(frame(spark, []))) == found(nn.digest_neighbours(frame(spark, bad))) == found(nn.digest_neighbours(frame(spark, [(20, [1.0])]))) == {}
    with pytest.raises(ValueError):
        nn.digest_neighbours(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_copies_and_ties(spark):
    """A third of all rows have one vector; ties at every score; every query gets its 20."""
    draw = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 0.0, 0.0] if i % 3 == 0 else draw.integers(-1, 2, 4) + np.array([0, 0, 0, 5])) for i in range(300)]
    asked = [i for i in range(300) if i % 20 == 0]
    same(found(nn.digest_neighbours(frame(spark, rows))), brute(rows, asked))


def test_recall_over_levels_and_blocks(spark, monkeypatch):
    """Small limits give a tree of several levels and many blocks."""
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 16))
    rows = [(i, centres[draw.integers(40)] + draw.normal(size=16) * 0.4) for i in range(1500)]
    for name, value in (("SAMPLE", 400), ("LEAF_ROWS", 90), ("BLOCK", 100)):
        monkeypatch.setattr(nn, name, value)
    asked = [i for i, _ in rows if i % 20 == 0]
    got = found(nn.digest_neighbours(frame(spark, rows)))
    assert all(len(x) == 20 for x in got.values()) and recall(got, brute(rows, asked)) >= 0.9
    classes = nn.vector_classes(nn.usable(frame(spark, rows), "vec_id", "embedding"), 20)
    placed, levels = nn.build_index(nn.settle(classes))
    assert len(levels) >= 2 and sorted(x for r in placed.collect() for x in r.ids) == list(range(1500))


def test_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0])
    got = found(registry.queries()["op13_learned_partitions"](spark, folder))
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values()) and recall(got, want) >= 0.9
    names, matrix = [i for i, _ in rows], np.array([v for _, v in rows]).astype(float)
    at = {i: n for n, i in enumerate(names)}
    assert all(abs(s - matrix[at[q]] @ matrix[at[i]]) < 1e-12 for q in got for i, s in got[q])


def test_other_queries_than_the_default(spark):
    rows = [(i, v) for i, v in enumerate(np.random.default_rng(4).normal(size=(30, 5)))]
    got = found(nn.nearest_neighbours(frame(spark, rows), F.col("id") == 7, nearest=3))
    same(got, brute(rows, [7], 3))


def test_cut_is_balanced_and_follows_the_graph():
    draw = np.random.default_rng(6)
    vectors = np.repeat(np.eye(8) * 5, 100, 0) + draw.normal(size=(800, 8)) * 0.3
    near = nn.graph_of(vectors, vectors, 10, True)
    part = nn.balanced_cut(near, 8)
    assert np.bincount(part, minlength=8).max() <= 110 and (part[near] == part[:, None]).mean() > 0.9
