"""Operator 12 against plain loops."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from storegrain.llm import periodic
from storegrain.llm import queries as Q


def brute(w):
    """Every maximal stretch of every period, word by word."""
    found = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q) and not any(all(w[x] == w[x + r] for x in range(s, i + q - r)) for r in range(1, q)):
                found.add((s, i + q - s, q))
            i += i == s
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(words):
    found, keep = brute(words), [True] * len(words)
    for s, n, q in found:
        keep[s + q : s + n] = [False] * (n - q)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    digest = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for w, k in zip(words, keep, strict=True) if k)
    return (len(found), *best, best[1] * 1000 // best[2] if found else None, hashlib.sha256(digest.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_random_words_with_planted_repeats():
    rng = random.Random(1)
    for _ in range(2500):
        n, w = rng.randint(0, 60), []
        letters = rng.randint(1, 4)
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            s, p = rng.randrange(n + 1), rng.randint(1, 6)
            for i in range(s + p, min(n, s + rng.randint(1, 40))):
                w[i] = w[i - p]
        ids = np.array(w, np.int64)
        assert periodic.runs(ids) == brute(w)
        assert not brute(w) or list(periodic.repeated_grams(ids, np.zeros(n, np.int64))) == [0]


def test_long_texts():
    assert periodic.runs(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]
    assert periodic.runs(np.arange(60_000) % 7_500) == [(0, 60_000, 7_500)]
    assert periodic.runs(np.arange(60_000) % 30_000) == []


def test_query_is_that_of_brute_force(spark, sf_dir):
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            words = [words[i] if i < a else words[a + (i - a) % (1 + (n - a) // (3 + h // 10 % 8))] for i in range(n)]
        if n < 2500:
            assert got[doc_id] == expected(words), doc_id


def test_edges_are_defined(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (4, "a " * 6, "x"), (4, "a " * 6, "x"), (None, "b c " * 4, None), (5, "é é " * 5, "x"), (6, "q " + "v w " * 5000 + "z", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period string")
    got = [tuple(r) for r in periodic.collapse_runs(docs, texts=True).collect()]
    assert len(got) == len(rows)
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(g[1:8] == (0, None, None, None, None, nothing, nothing) for g in got if g[0] in (1, 2, 3))
    assert [g[1:6] for g in got if g[0] == 4] == [(1, 0, 6, 1, 6000)] * 2
    assert [(g[1:6], g[9]) for g in got if g[0] is None] == [((1, 0, 8, 2, 4000), "b c")]
    assert [g[1] for g in got if g[0] == 5] == [0]  # five words are too few
    assert [(g[2], g[3], g[9]) for g in got if g[0] == 6] == [(1, 10_000, "q v w z")]
    assert periodic.collapse_runs(docs.filter(F.lit(False))).count() == 0
