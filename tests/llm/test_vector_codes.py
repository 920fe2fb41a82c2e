"""Vector codes against a full search in plain integers, and the bounds against the distances they stand for."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from tickloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, key string, codes int, whole string"
NAN, INF = float("nan"), float("inf")


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Rows of (vec_id, code, error, label_error) and the books' digest, all entries tried for all parts."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in order] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (apart(cut(v, p), books[p][e]), e)) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            members = defaultdict(list)
            for (_, v, _), c in zip(kept, codes):
                members[c[p]].append(cut(v, p))
            for e, own in members.items():
                books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    codes, sums, out = assign(), defaultdict(int), []
    errors = [sum(apart(cut(v, p), books[p][c[p]]) for p in range(parts)) for (_, v, _), c in zip(kept, codes)]
    for (_, _, label), e in zip(kept, errors):
        sums[label] += e
    for (i, _, label), c, e in zip(kept, codes, errors):
        out.append((i, "".join(f"{x:02x}" for x in c), e, sums[label], hashlib.sha256(",".join(str(x) for b in books for entry in b for x in entry).encode()).hexdigest()))
    return sorted(out, key=str)


def digest(spark, rows):
    df = spark.createDataFrame([(i, v, label, None, 1, "x") for i, v, label in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in vc.digest_vectors(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def clustered(n, seed, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    return [(int(i), (centres[i % 5] + rng.normal(size=dims) * 0.2).tolist(), int(i % 3) if i % 7 else None) for i in rng.permutation(n) + 10]


def test_nulls_ties_repeated_rows(spark):
    rows = clustered(300, 1)
    copies = [(1000 + i, rows[0][1], 1) for i in range(150)]  # a third of all rows alike
    bad = [(1, None, 1), (2, [None] + [0.5] * 15, 1), (3, [NAN] + [0.5] * 15, 1), (4, [INF] + [0.5] * 15, None)]
    rows += copies + bad + [rows[3], rows[3], (None, rows[5][1], 2), (None, rows[6][1], None), (5, [0.0] * 16, 1), (6, [-0.00001] * 16, 1)]
    assert digest(spark, rows) == plain(rows)


def test_few_rows_large_numbers_and_odd_shapes(spark):
    assert digest(spark, clustered(9, 2)) == plain(clustered(9, 2))
    assert digest(spark, clustered(1, 2)) == plain(clustered(1, 2))
    large = [(i, [x * 30_000 for x in v], label) for i, v, label in clustered(60, 3)]  # squares beyond what doubles hold
    assert digest(spark, large) == plain(large)
    assert digest(spark, []) == digest(spark, [(1, None, 2)]) == []
    assert [r[1:4] for r in digest(spark, [(1, [], 2), (2, [], None)])] == [("00" * 8, 0, 0)] * 2
    with pytest.raises(ValueError):
        digest(spark, [(1, [1.0] * 16, 1), (2, [1.0] * 8, 1)])


def test_bounds_hold_and_spare_most_scans():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (16, 8, 4))
    vectors = (centres[rng.integers(0, 16, 3000)] + rng.normal(0, 300, (3000, 8, 4))).astype(np.int64)
    books, state, scans = [vectors[:16].transpose(1, 0, 2).copy()], (None, None, None), []
    for _ in range(7):
        history = vc.History(books)
        *state, rescans = history.assign(vectors, *state)
        codes, stamps, bounds = state
        far = np.sqrt(((vectors[:, :, None] - books[-1][None]) ** 2).sum(-1))
        assert (codes == far.argmin(2)).all()
        at = np.arange(8)
        own = np.take_along_axis(far, codes[..., None], 2)[..., 0]
        np.put_along_axis(far, codes[..., None], np.inf, 2)
        assert (bounds[:, 0] + history.moved[stamps[:, 0], at, codes] >= own * (1 - 1e-12)).all()
        assert (bounds[:, 1] - history.others[stamps[:, 1], at, codes] <= far.min(2)).all()
        scans.append(int(rescans.sum()))
        new = books[-1].copy()
        for p in range(8):
            for e in range(16):
                if (codes[:, p] == e).any():
                    new[p, e] = vectors[codes[:, p] == e, p].sum(0) // (codes[:, p] == e).sum()
        books.append(new)
    assert scans[0] == 24_000 and scans[-1] < 6_000


def test_net_displacement_is_tighter():
    """An entry that moves away and back again leaves its old bounds as they were."""
    a = np.zeros((1, 2, 2), np.int64)
    a[0, 1] = 100
    b = a + 30
    assert vc.History([a, b, a]).moved[0].max() == 0 and vc.History([a, b]).moved[0].min() > 42


def test_query_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    from tickloom.llm import registry

    name = "op11_norm_of_sum_codes"
    got = registry.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
    want = con.execute(registry.oracle_sql()[name]).df()[list(got.columns)]
    assert got.sort_values("vec_id").values.tolist() == want.sort_values("vec_id").values.tolist()
