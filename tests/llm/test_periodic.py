"""Periodic runs against all lags."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np

from leadweave.llm import periodic


def brute(w):
    """(start, length, period) of all runs of a list."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def split(w, low, high):
    """Segments in which each word occurs four times, six words at least."""
    if high - low < 6:
        return []
    cuts = [i for i in range(low, high) if w[low:high].count(w[i]) < 4]
    if not cuts:
        return [(low, high)]
    return [s for a, b in zip([low, *(c + 1 for c in cuts)], [*cuts, high]) for s in split(w, a, b)]


def stream(rng):
    d = []
    while rng.random() < 0.85:
        block = [rng.randrange(rng.choice([1, 2, 3, 20, 300])) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 30]))]
        d += (block * rng.choice([1, 1, 3, 4, 5, 9]))[: rng.randrange(1, 200)]
    return d


def test_segments_and_runs_brute_force():
    rng, values = random.Random(5), np.random.default_rng(1).integers(1, 2**63, 1000).astype(np.uint64)
    many = 0
    for _ in range(200):
        docs = [stream(rng) for _ in range(rng.choice([1, 3, 6]))]
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        w = values[np.array(sum(docs, []), dtype=int)]
        low, high = periodic.surviving(w, first)
        assert list(zip(low.tolist(), high.tolist())) == [(a + first[i], b + first[i]) for i, d in enumerate(docs) for a, b in split(d, 0, len(d))]
        want = [(i, *r) for i, d in enumerate(docs) for r in brute(d)]
        assert list(zip(*(x.tolist() for x in periodic.periodic_runs(w, first)))) == want
        many += len(want)
    assert many > 1000


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_long_texts_take_little_time():
    began = time.perf_counter()
    n = 300_000
    ends = np.array([0, n])
    start = lambda x: [v.tolist() for v in periodic.periodic_runs(np.array(x, dtype=np.uint64), ends)]
    assert start([1] * n) == [[0], [0], [n], [1]]
    assert start(thue_morse(n)) == [[], [], [], []]  # holds no cube, and powers of two of it confuse polynomial hashes
    block = list(range(n // 5))
    assert start(block * 5) == [[0], [0], [n], [n // 5]]
    assert time.perf_counter() - began < 20
    # each round of splitting leaves a little less: words that stand at distances that double
    chain = [0] * 3
    for k in range(1, 4000):
        chain = chain + [k, k, k, k - 1] if k % 2 else [k - 1, k, k, k] + chain
    began = time.perf_counter()
    periodic.surviving(np.array(chain, dtype=np.uint64), np.array([0, len(chain)]))
    assert time.perf_counter() - began < 10


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def row(doc_id, text):
    w = planted(doc_id, text)
    found = brute(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    of = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *of, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_brute_force(spark, tmp_path):
    rng = random.Random(9)
    texts = [" ".join(f"{'é' if v % 3 else 'w'}{v}" for v in stream(rng)) for _ in range(150)]
    texts += [None, "", " \n\t ", "a", "x y x y " * 9, "a b\n a  b\ta b a b", "no no no no no no", "no no no no no", "A a A a A a A a", "\U0001f600 " * 7, "a\x0bb\x0ca\rb a b a b a b", "tail " + "p q " * 4000]
    ids = [*range(len(texts) - 3), 3, 3, None]
    rows = list(zip(ids, texts, strict=True))
    rows += [rows[0], rows[0]]
    d = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, runs string, n_words int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op12_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((row(i, t) for i, t in rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids) and periodic.find_runs(d.limit(0)).count() == 0
    out = {r.doc_id: r.collapsed for r in periodic.find_runs(d.filter("text LIKE 'a b%'")).collect()}
    assert list(out.values()) == ["a b"]
