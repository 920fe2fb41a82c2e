"""Token alignment against a plain walk over byte ends."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import alignment
from tickloom.llm.common import shared_frequent

public_tokenizers = pytest.importorskip("public_tokenizers")
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
EDGE = [(0, None), (1, ""), (2, "a"), (3, "  two  spaces\n\n"), (4, "▁mark"), (5, "<|endoftext|> <s> é 中文 😀"), (6, "x" * 5000), (7, " " * 3000), (None, "no id"), (8, "same"), (8, "same"), (9, "\x01 \t")]


def ends(ids, sizes):
    return np.cumsum([sizes[i] for i in ids]).tolist()


def plain(rows):
    """The digest by sets of byte ends."""
    model, found, times = alignment.aligner(*FILES), [], Counter()
    for _, text in rows:
        a, b = (model.one.encode_whole(" " + text), model.two.model.encode(text)) if text else ([], [])
        if any(b"".join(x.bytes_of[i] for i in ids) != (" " + (text or "")).encode() for x, ids in ((model.one, a), (model.two, b))):
            a = b = []
        a_end, b_end = dict(zip(ends(a, model.sizes[0]), a)), dict(zip(ends(b, model.sizes[1]), b))
        both, low, groups = sorted(a_end.keys() & b_end.keys()), 0, []
        for high in both:
            groups.append("|".join(",".join(str(x) for e, x in side.items() if low < e <= high) for side in (a_end, b_end)))
            low = high
        links = [(a_end[e], b_end[e]) for e in both]
        times.update(links)
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = Counter()
    for (_, y), n in times.items():
        most[y] = max(most[y], n)
    return sorted((*f[:3], len(f[3]), sum(times[p] == most[p[1]] for p in f[3]), sum(times[p] for p in f[3]), f[4]) for f in found)


def digest(df):
    return sorted(tuple(r) for r in alignment.digest_documents(df, *FILES).select(COLUMNS).collect())


def test_edges(spark):
    df = spark.createDataFrame([(*r, None, "n", 1) for r in EDGE], "doc_id long, text string, row string, pair string, x int")
    assert digest(df) == plain(EDGE)
    assert alignment.digest_documents(df.limit(0), *FILES).count() == 0


def test_documents_and_the_two_ways_back(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect() if len(r.text or "") < 3000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (500, 500_000):  # the batches' borders must not show
        monkeypatch.setattr(alignment, "BATCH_CHARS", limit)
        assert digest(df) == plain(rows)


def test_query(spark):
    from tickloom.llm import registry

    out = registry.queries()["op12_interval_groups"](spark, "/root/testdata/sf0.001")
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_shared_frequent(spark):
    rows = spark.range(1000).selectExpr("if(id < 400, null, if(id < 700, 1, id)) AS k", "id")
    totals = rows.groupBy("k").count()
    for share in (1, 3, 10, 100_000):
        got = shared_frequent(rows, totals, ["k"], "count", share)
        assert got.columns == ["k", "id", "count"] and got.groupBy("count").count().orderBy("count").collect() == [(1, 300), (300, 300), (400, 400)]


def test_intervals_and_overlaps():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a, b = (np.append(np.sort(rng.choice(np.arange(1, n), rng.integers(0, n), replace=False)) if n > 1 else [], n).astype(int) for _ in range(2))
        sides = [(np.concatenate(([0], e[:-1])), e) for e in (a, b)]
        pairs = set(zip(*map(np.ndarray.tolist, alignment.overlapping(*sides[0], *sides[1]))))
        assert pairs == {(i, j) for i, (s, e) in enumerate(zip(*sides[0])) for j, (t, f) in enumerate(zip(*sides[1])) if s < f and t < e}
        group = alignment.coalesce(np.concatenate([s for s, _ in sides]), np.concatenate([e for _, e in sides]))
        assert group.max() + 1 == len(set(a) & set(b))
        assert group.tolist() == [sum(c <= s for c in set(a) & set(b)) for start, _ in sides for s in start]


def test_general_form(spark):
    df = spark.createDataFrame([(1, "A naïve café 😀", "z"), (2, None, "z")], "doc_id long, text string, aligned string")
    one, two = (r.aligned for r in alignment.align_documents(df, *FILES).orderBy("doc_id").collect())
    assert not any(two) and one.a_ends[-1] == one.b_ends[-1] == len(" A naïve café 😀".encode())
    assert one.a_groups[-1] == one.b_groups[-1] and set(one.a_groups) == set(one.b_groups) == set(range(one.a_groups[-1] + 1))
    assert all(one.a_groups[i] == one.b_groups[j] for i, j in zip(one.overlap_a, one.overlap_b))


def test_encoder_equals_the_library():
    """Every code point, alone and beside letters, digits and spaces; very long runs."""
    one = alignment.aligner(*FILES).one
    assert one.fast is not None
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} {c}1{c}{c}\n" for c in points[at : at + 64]) for at in range(0, len(points), 64)]
    texts = [t for i, t in enumerate(texts) if i % 8 == 0 or ord(t[1]) < 0x3400]
    assert one.encode(texts) == [e.ids for e in one.library.encode_batch(texts, add_special_tokens=False)]
    for run in (" " * 1_200_000, "a" * 200_000, " \n" * 600_001):
        assert one.encode([run + "b"]) == [one.encode_whole(run + "b")]
