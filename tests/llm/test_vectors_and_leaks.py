"""Benchmark decontamination, vector codes and centroid clustering against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

pytest.importorskip("ahocorasick")

from pyspark.sql import functions as F  # noqa: E402

from cellweave.llm import centroids, decontaminate, vectorcodes, vectors  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, items int, SPANS string, `a``b` int", "item_id long, text string, n_words int"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_leaks(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = WORD.findall(lowered(text))
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        found = list(WORD.finditer(lowered(text)))
        w, hit, ids = [m[0] for m in found], set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids |= {str(i) for i in windows[tuple(w[k : k + n])] if i is not None}
        yield doc, len(w), len(hit), sorted(ids), [(found[k].start(), found[k].end()) for k in sorted(hit)]


def leak_tables():
    rng = random.Random(5)
    pool = ["été", "ab", "c1", "日本", "x", "yy", "Zz", "٣", "q"]
    item = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(k, item(rng.choice([3, 9, 10, 11, 30]))) for k in range(30)] + [(7, item(12)), (100, None), (101, ""), (102, " -,- "), (None, "null id " * 6), (103, "one two three"), (104, "one two three")]
    docs = [(k, item(rng.randrange(60))) for k in range(60)]
    docs += [(200 + k, f"A-B {items[k][1].upper()}!? {item(5)} {items[k + 1][1].replace(' ', chr(10) + '- ')}.") for k in range(29)]
    docs += [(300, None), (301, ""), (302, "\n\0 "), (303, "Null ID, null id null id null id null id"), (304, "One  two\tthree"), (None, items[4][1]), (305, "one two threes"), (306, "İone two three"), (200, "again " + items[3][1])]
    docs.append((400, " ".join(["filler words of a text"] * 120_000 + [items[4][1]])))
    at = " ".join(["pads"] * (decontaminate.BLOCK // 5))
    docs += [(401 + k, "z" * k + at[: decontaminate.BLOCK - 20] + " " + items[4][1] + " end") for k in range(6)]
    return docs, items


@pytest.mark.parametrize("limit", [100_000, 60])
def test_leaks(spark, limit):
    docs, items = leak_tables()
    frame = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in docs], DOCS).repartition(3)
    got = decontaminate.find_leaks(frame, spark.createDataFrame([(i, t, 3) for i, t in items], ITEMS), max_windows=limit)
    assert got.columns == ["doc_id", "text", "a`b", "n_words", "n_hit", "items", "spans"]
    key = lambda r: (r[0] or -1, r[1], r[2], r[3])
    rows = got.collect()
    want = sorted(plain_leaks(docs, items), key=key)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows], key=key) == [x[:4] for x in want]
    for r, w in zip(sorted(rows, key=lambda r: (r.doc_id or -1, r.n_words, r.n_hit, r["items"])), want):
        assert all(any(s.start <= a and b <= s.end for s in r.spans) for a, b in w[4])
        assert sum(len(WORD.findall(lowered(r.text[s.start : s.end]))) for s in r.spans) == r.n_hit
    digest = {r.doc_id: r for r in decontaminate.digest_leaks(got.where("doc_id = 303 or doc_id = 304")).collect()}
    assert digest[303].contaminated and digest[303].n_items == 0 and digest[303].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert digest[304].items_sha256 == hashlib.sha256(b"103,104").hexdigest()


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", 1, "s", 2)], DOCS), spark.createDataFrame([(1, "a b", 3)], ITEMS)
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0
    (row,) = decontaminate.find_leaks(docs, items.limit(0)).collect()
    assert (row.n_words, row.n_hit, row["items"], row.spans) == (2, 0, [], [])


def test_tree_ties_and_bounds():
    rng = np.random.default_rng(2)
    for size, span in ((3, 3), (16, 40), (1, 5), (2, 2)):
        entries = rng.integers(-span, span, (256, size))
        queries = rng.integers(-span - 1, span + 1, (3000, size))
        d = ((queries[:, None, :] - entries[None]) ** 2).sum(-1)
        index, best = vectorcodes.Tree(entries).nearest(queries)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
    same = vectorcodes.Tree(np.zeros((40, 2), np.int64)).nearest(np.ones((5, 2), np.int64))
    assert same[0].tolist() == [0] * 5 and same[1].tolist() == [2] * 5
    far = vectorcodes.Tree(np.array([[2**40, 0], [2**40 + 1, 0]])).nearest(np.array([[2**40 + 3, 1]]))
    assert far[0].tolist() == [1] and far[1].tolist() == [5]
    with pytest.raises(OverflowError):
        vectorcodes.Tree(np.array([[-(2**40)]])).nearest(np.array([[2**40]]))


def vector_rows(n=700, dims=8, seed=1):
    rng = random.Random(seed)
    rows = [(k * 3 % 701, [rng.choice([-1, 1]) * rng.randrange(6) / 16 + rng.random() / 256 for _ in range(dims)], rng.choice([None, 1, 2, 3]), 5) for k in range(n)]
    rows += [(k, rows[0][1], 1, 5) for k in range(900, 1300)]  # a hot vector and label
    rows += [(2000, None, 1, 5), (2001, [*[0.5] * (dims - 1), None], 1, 5), (2002, [*[0.5] * (dims - 1), math.nan], 1, 5), (2003, [*[0.5] * (dims - 1), -math.inf], 2, 5), (2004, [0.25] * (dims // 2), 2, 5), (2005, [], None, 5)]
    rows += [(None, [0.125] * dims, 2, 5), (rows[5][0], rows[6][1], 3, 5), (rows[5][0], rows[5][1], 3, 5)]
    return rows


VECTORS = "vec_id long, embedding array<double>, label int, Code int"


def whole(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(1024 * x) for x in v]


def plain_codes(rows, parts, entries, rounds):
    kept = [(k, whole(v), label) for k, v, label, _ in rows if whole(v) is not None]
    size = len(min((k, v) for k, v, _ in kept if k is not None)[1])
    same = [x for x in kept if len(x[1]) == size]
    m = size // parts
    seeds = sorted((k, v) for k, v, _ in same if k is not None)[:entries]
    books = [[v[p * m : p * m + m] for _, v in seeds] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * m : p * m + m], c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            groups = {}
            for _, v, _ in same:
                groups.setdefault(nearest(p, v)[1], []).append(v[p * m : p * m + m])
            for e, own in groups.items():
                new[p][e] = [sum(x) // len(own) for x in zip(*own)]
        books = new
    out = []
    for k, v, label in kept:
        found = [nearest(p, v) for p in range(parts)] if len(v) == size else None
        out.append((k, label, "".join(f"{e:02x}" for _, e in found) if found else None, sum(d for d, _ in found) if found else None))
    return out, books


def order(rows):
    return sorted(rows, key=str)


def test_vector_codes(spark):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, VECTORS).repartition(4)
    coded, books = vectorcodes.compress_vectors(frame, parts=2, entries=40, rounds=3)
    want, plain = plain_codes(rows, 2, 40, 3)
    assert coded.columns == ["vec_id", "label", "code", "error"]
    assert [b.tolist() for b in books] == plain
    assert order(map(tuple, coded.collect())) == order(want)
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + (error or 0)
    digest = order((r.vec_id, r.code, r.error, r.label_error) for r in vectorcodes.digest_codes(coded, books).collect())
    assert digest == order((k, c, e, sums[label]) for k, label, c, e in want)


def test_vector_codes_of_few_rows(spark):
    rows = [(3, [0.5, 0.25], None, 1), (1, [0.0, 1.0], 1, 1), (None, [9.0, 9.0], 1, 1)]
    frame = spark.createDataFrame(rows, VECTORS)
    coded, books = vectorcodes.compress_vectors(frame, parts=2)
    assert [len(b) for b in books] == [2, 2] and order(map(tuple, coded.collect())) == order(plain_codes(rows, 2, 256, 4)[0])
    assert vectorcodes.digest_codes(*vectorcodes.compress_vectors(frame.limit(0))).count() == 0
    assert vectorcodes.compress_vectors(frame.where("vec_id is null"), parts=2)[0].collect()[0].code is None
    with pytest.raises(ValueError):
        vectorcodes.compress_vectors(frame, parts=3)


def plain_clusters(rows, k, rounds, dims, seed=3):
    kept = [(i, whole(v)) for i, v, _, _ in rows if whole(v) is not None and len(v) == dims]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centers = [v for _, v in start]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centers = [[sum(x) // len(groups[e]) for x in zip(*groups[e])] if e in groups else c for e, c in enumerate(centers)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centers


@pytest.mark.parametrize("k,rounds", [(8, 10), (1, 2), (3, 0), (5, 60)])
def test_clusters(spark, k, rounds):
    rows = vector_rows(seed=k)
    frame = spark.createDataFrame(rows, VECTORS).repartition(4)
    got, centers = centroids.cluster_vectors(frame, k=k, rounds=rounds, dims=8)
    want, plain = plain_clusters(rows, k, rounds, 8)
    assert centers.tolist() == plain
    assert order((r.vec_id, r.cluster, r.distance) for r in got.collect()) == order(want)
    total, own = sum(d for *_, d in want), {}
    for _, c, d in want:
        own[c] = own.get(c, 0) + d
    for r in centroids.digest_clusters(got, centers).collect():
        assert (r.inertia, r.cluster_inertia, r.centroid_sha256) == (total, own[r.cluster], hashlib.sha256(",".join(map(str, plain[r.cluster])).encode()).hexdigest())


def test_bounds_hold_in_every_round():
    """Hamerly's bounds enclose the true distances, and most vectors aren't scanned again."""
    rng = np.random.default_rng(4)
    v = rng.integers(-300, 300, (2000, 16)) + rng.integers(0, 4, (2000, 1)) * 2000
    c = v[:6].copy()
    cluster, upper, lower = centroids.scan(v, c)
    for _ in range(12):
        new = np.array([v[cluster == e].sum(0) // max(1, (cluster == e).sum()) if (cluster == e).any() else c[e] for e in range(6)])
        drift, c = np.sqrt(((new - c) ** 2).sum(1).astype(float)) * centroids.UP, new
        cluster, upper, lower = centroids.reassign(v, cluster, upper, lower, c, drift)
        d = ((v[:, None] - c[None]) ** 2).sum(-1)
        assert (cluster == d.argmin(1)).all()
        rows = np.arange(len(v))
        assert (upper >= np.sqrt(d[rows, cluster])).all()
        d[rows, cluster] = 2**60
        assert (lower <= np.sqrt(d.min(1))).all()


def test_clusters_of_odd_tables(spark):
    frame = spark.createDataFrame([(1, [1.0], 1, 1), (1, [2.0], 1, 1), (None, [5.0], 1, 1), (2, [], 1, 1)], VECTORS)
    got, centers = centroids.cluster_vectors(frame, k=2, rounds=1, dims=1)
    assert sorted((r.vec_id or 0, r.cluster, r.distance) for r in got.collect()) == sorted(((i or 0), e, d) for i, e, d in plain_clusters([(1, [1.0], 1, 1), (1, [2.0], 1, 1), (None, [5.0], 1, 1)], 2, 1, 1)[0])
    assert centroids.digest_clusters(*centroids.cluster_vectors(frame.limit(0))).count() == 0
    with pytest.raises(Exception, match="fit a long"):
        vectors.whole_vectors(spark.createDataFrame([(1, [1e30], 1, 1)], VECTORS), "embedding", 1024, "v").collect()
    assert vectors.whole_vectors(frame.withColumn("x.y", F.lit(1)), "embedding", 2, "v").where("v = array(2L)").count() == 1
