"""The corpus operators against plain versions, on edge cases and on the small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import bpe, decontaminate, html_text, near_copies, pii, quality_model, quality_rules, revisits, sharding, simhash, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE_FILE, PIECE_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits string, nth int, score string, r int, k string"
LONG = "word and more words. " * 8000
EDGE = [None, "", " \n ", "a", LONG, "same text of a few words here", "same text of a few words here", "<|endoftext|> it's 12 é 中文 😀​", "x" * 50_000, "1.2.3.4 a@b.co"]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rows = [(i, t, None, "s", None, "h", i, "x", 1, None) for i, t in enumerate(EDGE)]
    return spark.createDataFrame([*rows, rows[5], (None,) * 10, (None, "no id", *[None] * 8)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- 1 ---------------------------------------------------------------------------------
def check_shards(rows, shards):
    rows["slot"] = rows["slot"].astype(int)
    for _, g in rows.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    sums = rows.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
    assert sums.max() - sums.min() <= 2 * rows["size"].max()


def test_shards(spark, docs, edge):
    out = sharding.shard_documents(docs).toPandas()
    assert len(out) == docs.count() and set(out.law) == {"bytes"}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(c == zlib.crc32(text[i].encode()) and s == len(text[i].encode()) + 8 for i, c, s in zip(out.doc_id, out.text_crc32, out["size"]))
    check_shards(out, 24)
    check_shards(sharding.shard_documents(edge).toPandas(), 24)
    assert sharding.shard_documents(edge.limit(0)).count() == 0


def test_one_key_is_divided(spark):
    df = spark.range(4000).selectExpr("if(id % 3 = 0, null, 7) key", "if(id % 5 = 0, null, id % 11) size", "id shard", "'x' r").coalesce(3)
    check_shards(sharding.shard_by_size(df, 5, ["key"], "size").fillna(0, ["size"]).toPandas(), 5)


# -- 2 ---------------------------------------------------------------------------------
def plain_pii(text):
    out = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for kind, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            fails = (False, kind == 1 and any(int(x) > 255 for x in m[0].split(".")), not (14 <= len(d) <= 19 and pii.luhn(d)), not 10 <= len(d) <= 15)
            if not fails[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_plain_identifiers_against_the_patterns(docs):
    rng = random.Random(1)
    parts = ["1", "2", "55", ".", "@", "a", "-", " ", "+4", "(", "é", "12.3", "4539578763621486", "%"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert pii.find(t) == plain_pii(t), t
    for r in docs.collect():
        assert pii.find(r.text) == plain_pii(r.text)


@pytest.mark.parametrize(
    "text, spans",
    [
        ("mail john.doe [at] example [dot] com now", "email:5:36"), ("john dot doe at example dot com", "email:0:31"), ("jоhn@exаmple.com", "email:0:16"), ("call plus four nine one seven zero five five five one two three four", "phone:5:68"),
        ("four five three nine five seven eight seven six three six two one four eight six", "card:0:80"), ("４５３９ ５７８７ ６３６２ １４８６", "card:0:19"), ("192 dot 168 dot 0 dot 1", "ip:0:23"), ("me@​mail.example.com", "email:0:20"), ("jane at mail.example.com", "email:0:24"), ("look at the dot and go", ""), ("looked at him. Company", ""), ("one or two at the sea", ""), ("", ""),
    ],
)
def test_disguised_identifiers(text, spans):
    assert pii.write(pii.find_disguised(text, pii.find(text))) == spans


def test_pii_query(spark, docs, edge):
    assert edge.count() == pii.digest_documents(edge).count()
    out = {r.doc_id: r for r in pii.digest_documents(docs).collect()}
    for r in docs.collect():
        assert out[r.doc_id].base_sha256 == hashlib.sha256(pii.write(plain_pii(r.text)).encode()).hexdigest()
    red = pii.redact_documents(docs).collect()
    assert not any(plain_pii(r.text) for r in red) and all(r.n_chars == len(r.text) for r in red)
    assert pii.redact_documents(edge).columns == edge.columns


# -- 3 ---------------------------------------------------------------------------------
def test_classifier_on_held_out_labels(spark, edge):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality_model.digest_documents(docs, labels).join(labels, "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for h, i in zip(out.held_out, out.doc_id))
    held = out[out.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert quality_model.digest_documents(edge, labels).count() == edge.count()
    none = quality_model.digest_documents(edge, labels.limit(0)).toPandas()
    assert set(none.score) == {0.5}


def test_flat_trees_score_as_a_walk_does():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    t = quality_model.fit(x, y, trees=30)
    assert ((t.score(x) > 0.5) == y).mean() > 0.95
    for row in x[:50]:
        total = t.base
        for node in t.roots:
            while np.isfinite(t.threshold[node]):
                node = t.child[node] + (row[t.feature[node]] > t.threshold[node])
            total += t.value[node]
        assert abs(t.score(row[None])[0] - 1 / (1 + np.exp(-total))) < 1e-12


# -- 4 ---------------------------------------------------------------------------------
def plain_rules(text):
    w = words(text)
    places = {}
    for j in range(len(w) - 4):
        places.setdefault(tuple(w[j : j + 5]), []).append(j)
    covered = {k for v in places.values() if len(v) > 1 for j in v for k in range(j, j + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def test_rules_against_plain(spark, docs, edge):
    for df in (docs, edge.where("doc_id is not null").dropDuplicates(["doc_id"])):
        text = {r.doc_id: r.text for r in df.collect()}
        for r in quality_rules.digest_documents(df).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_rules(text[r.doc_id])
            assert not (r.base_failed and r.kept)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1")
    clean = quality_rules.digest_documents(docs).join(labels, "doc_id").where("not base_failed")
    assert clean.where("not kept").count() <= 0.01 * clean.count()


def test_line_rules(spark):
    good = "This is a plain sentence about nothing much, which ends well."
    bad = ["Home | About | Contact | Help", "$$$ *** ### %%% &&& ###", "Read our privacy policy here.", "go go go go go go go go go go", "word " * 60, "A long line of prose that goes on and on, and then it just stops for no", "Tous droits réservés 2024.", "ALLE RECHTE VORBEHALTEN."]
    df = spark.createDataFrame([(0, "\n".join([good, *bad]))], "doc_id long, text string")
    assert quality_rules.clean_lines(df).first().cleaned.text == good


# -- 5 ---------------------------------------------------------------------------------
def test_html_layout(spark):
    html = "<title>x</title><h1>Head &amp; more</h1><p>One <b>bold</b>text<p>Two<br>lines<ul><li>a<li>b<ol start=3><li>n1<li>n2</ol><li>c</ul><table><tr><th>Name<th>Qty<tr><td>apple<td>3</table><div hidden>no</div><span style='display: none'>no</span>tail<script>x</script>"
    assert html_text.html_to_text(html) == "Head & more\n\nOne boldtext\n\nTwo\nlines\n\n- a\n- b\n  3. n1\n  4. n2\n- c\n\nName  | Qty\napple | 3\n\ntail"
    assert html_text.html_to_text(None) == "" and html_text.html_to_text("<div>" * 5000 + "x") == "x" and html_text.html_to_text("<table><tr><td>" * 400 + "x") == "x"
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    out = {r.page_id: r.text for r in html_text.digest_pages(pages).collect()}
    for p in pages.collect():  # all visible words, in order
        bare = re.sub(r"(?is)<(script|style|title)\b.*?</\1>|<!--.*?-->|<!doctype.*?>", "", p.html)
        import html as h

        assert [w for w in out[p.page_id].split() if w not in ("-", "|")] == [w for w in h.unescape(re.sub(r"(?s)<(/?)(b|i|a|em|strong|span)\b[^>]*>", "", bare).replace("<", " <").replace(">", "> ") and re.sub(r"(?s)<[^>]+>", " ", re.sub(r"(?s)</?(?:b|i|a|em|strong|span)\b[^>]*>", "", bare))).split() if w not in ("-", "|")]


def test_html_random_trees():
    rng = random.Random(4)
    for _ in range(200):
        blocks, want = [], []
        for i in range(rng.randrange(1, 6)):
            text = " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 5)))
            blocks.append(rng.choice([f"<p>{text}", f"<p>{text}</p>", f"<h2>{text}</h2>", f"<p><i>{text}</i><script>no</script>"]))
            want.append(text)
        assert html_text.html_to_text("".join(blocks)) == "\n\n".join(want)


# -- 6 ---------------------------------------------------------------------------------
def test_revisits_against_plain(spark):
    import datetime

    rng, rows = random.Random(5), []
    t0 = datetime.datetime(2024, 1, 1)
    for i in range(400):
        url = rng.choice(["http://www.a.com/x/", "https://A.com/x?utm_source=q", "a.com/y?b=2&a=1", "http://a.com:80/y?a=1&b=2#f", None])
        headers = {k: v for k, v in (("ETag", rng.choice(['"1"', 'W/"1"', '"2"', ""])), ("Last-Modified", rng.choice(["m", "n", ""])), ("Date", str(i)), ("X", str(i))) if rng.random() < 0.8}
        rows.append((i, url, t0 + datetime.timedelta(hours=rng.randrange(60)) if rng.random() < 0.97 else None, rng.choice(["response", "revisit", "other"]), headers or None))
    df = spark.createDataFrame(rows, "record_id long, url string, ts timestamp, kind string, headers map<string,string>")
    canon = {r.record_id: r.c for r in df.select("record_id", revisits.canonical_url(F.col("url")).alias("c")).collect()}
    assert {c for c in canon.values() if c} == {"a.com/x", "a.com/y?a=1&b=2"}
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    tag = lambda h: re.sub("^W/", "", h.get("etag", "")) or None
    want = {}
    for i, _, ts, kind, h in rows:
        if kind != "revisit":
            continue
        earlier = [(t, j, low(g)) for j, _, t, q, g in rows if q == "response" and t and ts and canon[j] and canon[j] == canon[i] and t < ts]
        h = low(h)
        if not earlier:
            want[i] = ("no_earlier_response", None, None)
            continue
        _, j, g = max(earlier, key=lambda x: x[:2])
        pair = (tag(h), tag(g)) if tag(h) and tag(g) else (h.get("last-modified") or None, g.get("last-modified") or None)
        status = "no_validator" if None in pair else "resolved" if pair[0] == pair[1] else "validator_mismatch"
        want[i] = (status, j, g | {k: v for k, v in h.items() if k in revisits.PERMITTED} if status == "resolved" else None)
    got = {r.record_id: (r.status, r.response_id, r.headers) for r in revisits.resolve_revisits(df, slice_seconds=7200).collect()}
    assert got == want
    assert revisits.resolve_revisits(df.limit(0)).count() == 0


# -- 7 ---------------------------------------------------------------------------------
@pytest.mark.parametrize("chunk, overlap", [(8, 2), (20, 5), (64, 8)])
def test_spliced_counts(chunk, overlap):
    c, rng = token_counts.ChunkedCounter(PIECE_FILE, chunk, overlap), random.Random(2)
    assert c.proven
    texts = ["".join(rng.choice(["a", "the", "ing", " ", " ", "  ", "\n", "é", "😀", "▁", "x" * 5, "<s>", "中文"]) for _ in range(rng.randrange(120))) for _ in range(500)]
    assert c.count(texts) == [len(x) for x in c.model.encode(texts)]


def test_token_query(docs, edge):
    c = token_counts.ChunkedCounter(PIECE_FILE)
    for df in (docs, edge):
        text = {r.doc_id: r.text or "" for r in df.where("doc_id is not null").collect()}
        for r in token_counts.count_documents(df.where("doc_id is not null"), PIECE_FILE).collect():
            assert (r.n_bytes, r.n_tokens) == (len(text[r.doc_id].encode()), len(c.model.encode(text[r.doc_id]))) and r.over_limit == (r.n_tokens > 4096)


# -- 8 ---------------------------------------------------------------------------------
def plain_hits(texts, items):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t))
    windows = {}
    for i, t in items:
        w = cut(t)
        for j in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = cut(t), set(), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                if ids := windows.get(tuple(w[j : j + size])):
                    found |= ids
                    hit |= set(range(j, j + size))
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("shard_bytes, item_bytes", [(1 << 22, 1 << 24), (200, 1 << 24), (500, 300)])
def test_decontamination_against_plain(spark, shard_bytes, item_bytes):
    rng, letters = random.Random(3), ["a", "B", "c1", "é", "É", "D"]
    items = [(i, " ".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(8)] + [(8, None)]
    texts = ["", None] + [rng.choice([", ", ". "]).join(rng.choice(letters) for _ in range(rng.randrange(60))) + rng.choice(["", " zz " + (rng.choice(items)[1] or "")]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    found = decontaminate.find_matches(df, spark.createDataFrame(items, "item_id long, text string"), shard_bytes=shard_bytes, item_bytes=item_bytes)
    got = {r.doc_id: (r.hits["n_words"], r.n, r.hits["items"]) for r in found.withColumn("n", decontaminate.n_hit()).collect()}
    assert [got[i] for i in range(len(texts))] == plain_hits(texts, items)
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t))
    for r in found.collect():  # the longest match of a window that goes on is the longest common run of words
        w, runs = cut(texts[r.doc_id]), [0]
        for v in (cut(t) for _, t in items):
            for i in range(len(w)):
                for j in range(len(v)):
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    runs.append(n if n >= min(10, len(v)) else 0)
        assert max(runs) == (r.hits.longest.words if r.hits.longest else 0)
        if r.hits.longest:
            ours = " ".join(w[r.hits.longest.start : r.hits.longest.start + r.hits.longest.words])
            assert f" {ours} " in f" {' '.join(cut(dict((str(k), t) for k, t in items)[r.hits.longest.item]))} "


def test_blocks_of_items_keep_the_columns(spark):
    """Columns named like helpers stay, however many blocks the items fill; and a hash alone makes no hit."""
    df = spark.createDataFrame([(1, "a b c", "mine", "too"), (2, None, None, None)], "doc_id long, text string, hits_more string, hits_found string")
    items = spark.createDataFrame([(i, f"a b {'x' * i}") for i in range(20)] + [(99, "b c")], "item_id long, text string")
    for size in (1 << 24, 300):
        out = decontaminate.find_matches(df, items, item_bytes=size)
        assert out.columns == [*df.columns, "hits"]
        assert [(r.hits_more, r.hits_found, r.hits["items"]) for r in out.orderBy("doc_id").collect()] == [("mine", "too", ["0", "99"]), (None, None, [])]


def test_words_are_compared_byte_by_byte(monkeypatch):
    monkeypatch.setattr(decontaminate, "word_hashes", lambda low, starts, ends: np.full(len(starts), 5, np.uint64) + (low[starts] == ord("z")))
    items = decontaminate.Items(["i", "j"], ["a b c", "aa bb"])
    raw = b"q a b c z aa bb a"
    shard = decontaminate.Shard(np.frombuffer(raw, np.uint8), np.array([0, len(raw) + 1]), items.longest)
    spans, named, longest = shard.hits(items, shard.search(items))
    assert spans == [[{"start": 1, "end": 4}, {"start": 5, "end": 7}]] and named == [["i", "j"]] and longest == [{"words": 3, "start": 1, "item": "i"}]


def test_decontamination_query(spark, docs, edge):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = docs.collect()
    want = plain_hits([r.text for r in rows], [(i.item_id, i.text) for i in items.collect()])
    got = {r.doc_id: r for r in decontaminate.digest_documents(docs, items).collect()}
    for r, (n, hit, ids) in zip(rows, want):
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) == (n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0)
    assert decontaminate.remove_contaminated(edge, items).columns == edge.columns
    assert decontaminate.remove_contaminated(edge, items.limit(0)).count() == edge.count()


def test_longest_matches():
    items = decontaminate.Items(["i"], ["a b c d"])
    raw = b"x b c d y"
    shard = decontaminate.Shard(np.frombuffer(raw, np.uint8), np.array([0, len(raw) + 1]), items.longest)
    assert shard.search(items).length.tolist() == [0, 3, 2, 1]


def hits_of(raw, items):
    shard = decontaminate.Shard(np.frombuffer(raw, np.uint8), np.array([0, len(raw) + 1]), items.longest)
    return shard.hits(items, shard.search(items))


def test_repetitive_texts_take_no_longer():
    """20,000 equal words against an item of 2,000, and two words in turn."""
    import time
    import tracemalloc

    for word, n in ((b"ha ", 1), (b"ha ho ", 2)):
        items = decontaminate.Items(["i", "j"], [(word * (2000 // n)).decode(), "one two"])
        raw = word * (20_000 // n)
        tracemalloc.start()
        began = time.process_time()
        spans, named, longest = hits_of(raw, items)
        took, most = time.process_time() - began, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert spans == [[{"start": 0, "end": 20_000}]] and named == [["i"]] and longest == [{"words": 2000, "start": 0, "item": "i"}]
        assert took < 5 and most < 200e6


def test_longest_by_brute_force(spark):
    """The longest match, its first place and its least item, whatever the blocks and shards."""
    rng = random.Random(11)
    for letters in ("ab", "abcd"):
        items = [(f"i{k:02}", " ".join(rng.choice(letters) for _ in range(rng.randrange(1, 40)))) for k in range(12)]
        texts = [" ".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(25)]
        want = []
        for t in texts:
            w, best = t.split(), None
            for name, v in ((n, x.split()) for n, x in items):
                for i in range(len(w)):
                    for j in range(len(v)):
                        n = 0
                        while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                            n += 1
                        if n >= min(10, len(v)) and (best is None or (-n, i, name) < best):
                            best = (-n, i, name)
            want.append(best and (-best[0], best[1], best[2]))
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        bench = spark.createDataFrame(items + items[:3], "item_id string, text string")
        for shard_bytes, item_bytes in ((1 << 22, 1 << 24), (300, 400)):
            found = decontaminate.find_matches(df, bench, shard_bytes=shard_bytes, item_bytes=item_bytes).orderBy("doc_id").collect()
            assert [r.hits.longest and tuple(r.hits.longest) for r in found] == want


# -- 9 ---------------------------------------------------------------------------------
def plain_print(text):
    w = words(lowered(text))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints, distance=2):
    n, root = len(prints), list(range(len(prints)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    arr = np.array(prints, np.uint64)
    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= distance):
            a, b = top(i), top(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_simhash_query(docs, edge):
    for df in (docs, edge.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted(df.collect(), key=lambda r: r.doc_id)
        prints = [plain_print(r.text) for r in rows]
        want = {r.doc_id: (f"{p:016x}", rows[c].doc_id) for r, p, c in zip(rows, prints, plain_components(prints))}
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.digest_documents(df).collect()} == want
    assert simhash.digest_documents(edge.limit(0)).count() == 0
    kept = simhash.keep_first(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 3, 4, 5, 7, 8, 9]


def test_keep_first_judges_rows_not_keys(spark):
    """One key on rows of different texts, repeated rows, null keys, a map column: no text is lost, each stays once."""
    one, two = "one text of some words", "another text that is quite different"
    rows = [(1, one, {"a": 1}), (5, two, None), (5, one, None), (5, two, {"b": 2}), (None, one, None), (None, None, {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_hash map<string,int>")
    for keep in (simhash.keep_first, near_copies.keep_first):
        kept = keep(df)
        assert kept.columns == df.columns
        assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted([("1", one), ("5", two), ("None", one), ("None", "None")])


@pytest.mark.parametrize("segments, distance", [(16, 1), (16, 2), (16, 3), (8, 2)])
def test_near_pairs_share_a_key_at_every_level(segments, distance):
    rng = random.Random(6)
    width = 64 // segments
    for level in range(distance):
        masks = simhash.ring_masks(segments, distance, level)
        for _ in range(500):
            x = sum(1 << b for b in rng.sample(range(64), rng.randrange(distance + 1)))
            starts = [s for s in range(segments) if simhash.chains_hold(np.array([x], np.uint64), s, segments, distance)[0]]
            turned = [(x << s * width | x >> (64 - s * width)) & ((1 << 64) - 1) for s in starts]
            assert starts and all(any(not t & m for m in masks) for t in turned)


@pytest.mark.parametrize("bucket, distance", [(10_000, 2), (20, 2), (20, 1), (5, 3)])
def test_crowded_fingerprints(spark, bucket, distance):
    """A large near-copy group: whichever way it is linked, its components are those of all pairs."""
    rng = np.random.default_rng(0)
    start, prints = int(rng.integers(1 << 62)), []
    for _ in range(500):
        x = start
        for _ in range(rng.integers(0, 5)):
            x ^= 1 << int(rng.integers(64))
        prints.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame(pd.DataFrame({"fp": signed})).distinct()
    root = {r.node: r.root for r in simhash.components(simhash.near_links(df, bucket=bucket, distance=distance)).collect()}
    groups = lambda names: sorted(sorted(i for i, n in enumerate(names) if n == x) for x in set(names))
    assert groups([root.get(f, f) for f in signed]) == groups(plain_components(prints, distance))


def test_every_near_pair_has_a_chain():
    rng = random.Random(6)
    for _ in range(3000):
        x = rng.getrandbits(64)
        differ = np.array([sum(1 << b for b in rng.sample(range(64), rng.randrange(3)))], np.uint64)
        assert any(simhash.chains_hold(differ, s, 16, 2)[0] for s in range(16)), x


# -- 10 --------------------------------------------------------------------------------
def test_bpe_against_the_library(docs, edge):
    from tokenizers import Tokenizer

    library, mine, rng = Tokenizer.from_file(BPE_FILE), bpe.TrieBpe(BPE_FILE), random.Random(1)
    texts = ["".join(rng.choice([chr(rng.randrange(1, 0x250)), " ", "\n", "a", "the", "<|endoftext|>", "'s", "1", "  ", "😀", "​"]) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += [r.text or "" for df in (docs, edge) for r in df.collect()]
    for t, ids in zip(texts, mine.encode(texts)):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t[:80]
        assert mine.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_query(docs, edge):
    mine = bpe.TrieBpe(BPE_FILE)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.digest_documents(docs, BPE_FILE).collect():
        ids = next(mine.encode([text[r.doc_id]]))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
    back = bpe.encode_documents(edge, BPE_FILE).withColumn("back", bpe.decode_column(BPE_FILE)("token_ids"))
    assert back.where("back <> coalesce(text, '')").count() == 0 and back.count() == edge.count()
