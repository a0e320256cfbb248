"""Operator 13 against plain loops."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storegrain.llm import passages
from storegrain.llm import queries as Q


def brute(docs, span=50):
    """[(doc_id, n_bytes, n_removed, n_spans, kept)] by a dictionary of all windows."""
    first, out = {}, []
    for doc_id, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - span + 1):
            w = data[i : i + span]
            if doc_id is not None:
                first[w] = min(first.get(w, doc_id), doc_id)
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - span + 1):
            if doc_id is not None and first[data[i : i + span]] < doc_id:
                gone[i : i + span] = b"\1" * span
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), spans, bytes(c for c, g in zip(data, gone, strict=True) if not g)))
    return out


def digests(rows):
    return sorted(((*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in rows), key=repr)


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_query_is_that_of_loops(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = Q.QUERIES["op13_suffix_array_dedup"](spark, sf_dir).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == digests(brute(docs))


def mixed(rng, n):
    """Texts put together of few stretches, so that they overlap in many ways."""
    parts = ["".join(rng.choice("ab é") for _ in range(rng.randint(1, 90))) for _ in range(30)] + ["ab" * 40, "x" * 130, "é" * 30, "", "q" * 49, "r" * 50]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(n)]


@pytest.mark.parametrize("change", [{}, {"HOT": 2}, {"HOT": 2, "UNIT_BYTES": 4000, "BUCKET_KEYS": 40, "BLOCK_BYTES": 3000}, {"LONGEST": 7, "PIECE": 61, "UNIT_BYTES": 9000, "BLOCK_BYTES": 20_000}])
def test_texts_that_overlap_in_many_ways(spark, monkeypatch, change):
    for k, v in change.items():
        monkeypatch.setattr(passages, k, v)
    rng = random.Random(len(change))
    docs = [(rng.randint(0, 150), t) for t in mixed(rng, 160)] + [(None, "x" * 130), (3, None), (3, "y" * 70), (3, "y" * 70), (7, "y" * 70), (8, "y" * 49), (9, "z" * 50 + "y" * 70)]
    df = spark.createDataFrame([(d, t, -1, "r", 5) for d, t in docs], "doc_id long, text string, unit long, row string, copy long")
    got = passages.drop_repeats(df, texts=True).select(*COLUMNS[:4], "kept", "spans").collect()
    assert sorted(((*r[:4], bytes(r[4])) for r in got), key=repr) == sorted(brute(docs), key=repr)
    assert all(sum(s["end"] - s["start"] for s in r[5]) == r[2] and len(r[5]) == r[3] for r in got)


def test_other_spans_and_empty_tables(spark):
    docs = [(k, t) for k, t in enumerate(["abcabcabc", "xabcabx", "cab", "", None, "abcabcabc"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for span in (1, 3, 20):
        assert sorted(map(tuple, passages.drop_repeats(df, span=span).collect()), key=repr) == digests(brute(docs, span))
    assert passages.drop_repeats(df.filter(F.lit(False))).count() == 0
    assert passages.drop_repeats(df.filter("doc_id in (3, 4)")).select("n_bytes", "n_removed").distinct().collect() == [(0, 0)]


def test_long_texts_and_one_passage_in_all(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, long = word(300), word(300_000)
    docs = [(k, word(40) + shared + word(60)) for k in range(300)] + [(1000, long), (1001, word(10) + long[5:-5]), (1002, "z" * 200_000), (1003, "z" * 100_000 + "w")]
    got = {r[0]: r for r in passages.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0]["n_removed"] == got[1000]["n_removed"] == got[1002]["n_removed"] == 0
    assert all(got[k]["n_removed"] >= 300 and got[k]["n_spans"] == 1 for k in range(1, 300))
    assert got[1001]["n_removed"] == len(long) - 10 and got[1003]["n_removed"] == 100_000


def test_intervals_part_where_prefixes_do():
    rng = np.random.default_rng(2)
    for letters in (1, 2, 5):
        b = rng.integers(97, 97 + letters, 400).astype(np.uint8)
        order, edge = passages.prefix_classes(b, 9)
        texts = [bytes(b[i : i + 9]) for i in order]
        assert [t for t in texts if len(t) == 9] == sorted(t for t in texts if len(t) == 9)
        classes = np.cumsum(edge)
        named = {}
        for t, c in zip(texts, classes.tolist(), strict=True):
            assert len(t) < 9 or named.setdefault(c, t) == t
        assert len({t for t in texts if len(t) == 9}) == len(named)


@pytest.mark.parametrize("span", [1, 3, 8, 9, 16, 20, 50])
@pytest.mark.parametrize("collide", [False, True])
def test_least_of_equal_windows(monkeypatch, span, collide):
    if collide:  # equal hashes of unequal windows change nothing
        monkeypatch.setattr(passages, "string_hashes", lambda b, length: np.zeros(len(b) - length + 1, np.uint64))
    rng = np.random.default_rng(span)
    for letters in (1, 2, 5, 200):
        b = rng.integers(0, letters, 900).astype(np.uint8)
        b[700:800] = b[100:200]
        at = np.flatnonzero(rng.random(900 - span + 1) < 0.6)
        of = rng.integers(-5, 50, len(at))
        least = {}
        for i, d in zip(at.tolist(), of.tolist(), strict=True):
            w = b[i : i + span].tobytes()
            least[w] = min(least.get(w, d), d)
        assert passages.least_of_equals(b, at, of, span).tolist() == [least[b[i : i + span].tobytes()] for i in at.tolist()]


def test_only_stretches_with_equals_are_sorted(monkeypatch):
    """Fragments that share a key and no window cost no sort."""
    rng = random.Random(8)
    word = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    gram, copied = word(16), word(60)
    fragments = [word(34) + gram + word(34) for _ in range(2000)] + [copied, word(5) + copied]
    places = np.array([range(2002), [k << 32 for k in range(2002)]], np.int64)
    packed = {"sizes": np.array([len(f) for f in fragments], np.uint32), "data": b"".join(fragments), "of": np.arange(2002, dtype=np.uint32), "places": places}
    block = pa.table({"block": [0], "unit": [4]} | {k: pa.array([v if k == "data" else v.tobytes()], pa.binary()) for k, v in packed.items()})
    seen, classes = [], passages.prefix_classes
    monkeypatch.setattr(passages, "prefix_classes", lambda b, span: seen.append(len(b)) or classes(b, span))
    got = passages.removed_bytes(50)(block).to_pylist()
    assert [(r["unit"], np.frombuffer(r["marks"], np.uint32).tolist()) for r in got] == [(4, [2001, 5, 65])]
    assert seen == [120]


def test_zero_bytes(spark):
    docs = [(1, "\0" * 60), (2, "\0" * 70), (3, "a" + "\0" * 55), (4, "\0" * 49 + "b"), (5, "\0" * 49)]
    got = passages.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == digests(brute(docs))


def test_copies_of_one_text_are_not_dealt_to_one_task(spark):
    rows = [(1 if k < 400 else k // 2, 5, k % 3, k, k // 4) for k in range(600)]
    hashed = spark.createDataFrame(rows, "h1 long, h2 long, unit long, row long, doc_id long").repartition(8)
    first = {}
    for h, _, _, _, d in rows:
        first[h] = min(first.get(h, d), d)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for most in (1, 100, 1000):
            got = passages.later_copies(hashed, most)
            assert sorted(map(tuple, got.collect())) == sorted((u, r) for h, _, u, r, d in rows if d > first[h])
            files = got.filter("copy < 400").groupBy(F.input_file_name().alias("f")).count().collect()
            assert (max(r["count"] for r in files) < 100) == (most < 400)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
