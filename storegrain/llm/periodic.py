"""Runs of words that repeat with a period, found in suffix classes united by falling LCP.

The suffixes of a text in sorted order are the nodes, neighbours joined by their longest common prefix the edges. Edges
are taken from the longest prefix down (Kruskal's order) in a union-find whose sets keep their positions in order. Two
positions that become neighbours in a set, at a distance within the prefix, seed a run of that period. Its ends are then
compared word by word, so a seed never makes a run by itself.

A run of length n >= max(6, 4 * q) with smallest period q has its start and start + q in different sets until prefix n - q
is taken, and next to each other then: a position between them would give the run a smaller period. As n - q >= LEAST,
suffixes that share fewer words with all others of their text are left out before anything is sorted.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.llm.common import slices

#: Words that two suffixes of a run share at least: 5 of six equal words, 6 of four pairs, 9 of four triples and so on.
LEAST = 5
#: Texts that are worked on at once in a task.
AT_ONCE = 64
M = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """word -> its number, by first use."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        return out


def repeated_grams(ids: np.ndarray, doc: np.ndarray, size: int = LEAST) -> np.ndarray:
    """The documents, ascending, in which some `size` words in a row occur twice; by hashes, so a few more may be among them."""
    if len(ids) < size:
        return np.zeros(0, np.int64)
    h = np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        h = (h ^ (h >> np.uint64(31))) * M + ids[k : len(ids) - size + 1 + k].astype(np.uint64) + np.uint64(1)
    own = doc[: len(h)]
    inside = own == doc[size - 1 :]
    h, own = (h[inside] ^ (h[inside] >> np.uint64(29))) * M + own[inside].astype(np.uint64) * np.uint64(0x94D049BB133111EB), own[inside]
    order = np.argsort(h)
    return np.unique(own[order[1:]][h[order[1:]] == h[order[:-1]]])


def _paired(rank: np.ndarray, step: int) -> np.ndarray:
    """Ranks of stretches twice as long, or `step` longer: equal only where both halves are. What ends at the text's end counts as a rank of its own."""
    after = np.zeros(len(rank), np.int64)
    after[: len(rank) - step] = rank[step:] + 1
    return np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)[1]


def suffix_classes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, lcp): suffixes in order and the words each shares with the one before, all with another suffix that shares LEAST words."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    four = _paired(_paired(rank, 1), 2)
    after = np.zeros(n, np.int64)
    after[: n - 4] = rank[4:] + 1
    levels, sizes = [np.unique(four * (n + 2) + after, return_inverse=True)[1]], [LEAST]
    shared = np.bincount(levels[0], minlength=n)[levels[0]] > 1
    shared[max(0, n - LEAST + 1) :] = False
    while sizes[-1] < n and np.bincount(levels[-1]).max() > 1:
        levels.append(_paired(levels[-1], sizes[-1]))
        sizes.append(2 * sizes[-1])
    at = np.flatnonzero(shared)
    at = at[np.argsort(levels[-1][at])]
    a, b = at[:-1].copy(), at[1:].copy()
    lcp = np.zeros(len(a), np.int64)
    for level, size in zip(levels[::-1], sizes[::-1], strict=True):
        fits = np.maximum(a, b) + size <= n
        same = fits & (level[np.where(fits, a, 0)] == level[np.where(fits, b, 0)])
        for x in (a, b, lcp):
            x += size * same
    live = np.ones(len(a), bool)
    for _ in range(LEAST - 1):
        live &= np.maximum(a, b) < n
        live[live] = ids[a[live]] == ids[b[live]]
        for x in (a, b, lcp):
            x += live
    return at, lcp


def seeds(at: np.ndarray, lcp: np.ndarray) -> set[tuple[int, int]]:
    """(position, period) of every two positions that become neighbours within the prefix that unites their sets, where a run of four periods can follow."""
    out: set[tuple[int, int]] = set()
    sets: list[list[int]] = [[int(p)] for p in at]
    parent = list(range(len(at)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for e in np.argsort(-lcp, kind="stable").tolist():
        size = int(lcp[e])
        if size < LEAST:
            break
        x, y = root(e), root(e + 1)
        if len(sets[x]) < len(sets[y]):
            x, y = y, x
        large, small = sets[x], sets[y]
        for p in small:
            k = bisect_left(large, p)
            for d, start in ((p - large[k - 1], large[k - 1]) if k else (0, 0), (large[k] - p, p) if k < len(large) else (0, 0)):
                if d and size >= max(3 * d, 6 - d):
                    out.add((start, d))
            large.insert(k, p)
        parent[y], sets[y] = x, []
    return out


def _equal_from(ids: np.ndarray, i: int, d: int, step: int) -> int:
    """How many words from i on, in the direction of step, equal those d further right."""
    n, size = 0, 64
    while True:
        a = ids[i : min(len(ids) - d, i + size)] if step > 0 else ids[max(0, i + 1 - size) : i + 1][::-1]
        b = ids[i + d : i + size + d] if step > 0 else ids[max(0, i + 1 - size) + d : i + 1 + d][::-1]
        differ = np.flatnonzero(a != b)
        if len(differ) or len(a) < size:
            return n + int(differ[0] if len(differ) else len(a))
        n, i, size = n + size, i + step * size, 2 * size


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, ordered by start and period."""
    if len(ids) < 6:
        return []
    found: set[tuple[int, int, int]] = set()
    done: dict[int, tuple[int, int]] = {}
    for i, d in sorted(seeds(*suffix_classes(ids)), key=lambda x: (x[1], x[0])):
        if done.get(d, (0, 0))[0] <= i < done.get(d, (0, 0))[1]:
            continue
        start = i - (_equal_from(ids, i - 1, d, -1) if i else 0)
        end = i + _equal_from(ids, i, d, 1) + d
        done[d] = (start, end - d)
        primes = [q for q in range(2, d + 1) if d % q == 0 and all(q % r for r in range(2, int(q**0.5) + 1))]
        if end - start >= max(6, 4 * d) and not any(np.array_equal(ids[start : end - d // q], ids[start + d // q : end]) for q in primes):
            found.add((start, end - start, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse_runs(docs: DataFrame, *, changed: Callable[[int | None, list[bytes]], list[bytes]] | None = None, texts: bool = False) -> DataFrame:
    """Per row: doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256; with
    texts=True also runs and collapsed.

    Words lie between ASCII white space. A run is a longest stretch of smallest period q with at least max(6, 4 * q) words;
    all but its first q words go. changed: what is to be done to (doc_id, words) first. Null, empty and blank texts have no
    words and no runs: the longest run's columns are null, both hashes are those of nothing. Equally long runs are told
    apart by start, then period. Rows are independent: repeated rows and null ids give a row each, other columns are not
    read, an empty table gives none. A text is worked on whole, in one task.
    """
    kinds = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}
    more = {"runs": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), "collapsed": pa.string()} if texts else {}

    def row(words: list[bytes], ids: np.ndarray | None) -> tuple:
        found = runs(ids) if ids is not None else []
        keep = np.ones(len(words), bool)
        for s, n, q in found:
            keep[s + q : s + n] = False
        kept = b" ".join(words if not found else [w for w, k in zip(words, keep.tolist(), strict=True) if k])
        longest = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        digest = hashlib.sha256("".join([f"{s},{n},{q}\n" for s, n, q in found]).encode()).hexdigest()
        out = (len(found), *(longest or (None,) * 3), longest and 1000 * longest[1] // longest[2], digest, hashlib.sha256(kept).hexdigest())
        return (*out, [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], kept.decode("utf-8", "replace")) if texts else out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, AT_ONCE):
            ids_of = _Ids()
            words, ids = [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = text.encode("utf-8", "surrogatepass").split() if text else []  # of bytes: ASCII white space only
                own = changed(doc_id, own) if changed else own
                words.append(own)
                ids.append(np.fromiter(map(ids_of.__getitem__, own), np.int64, len(own)))
            doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
            some = set(repeated_grams(np.concatenate(ids), doc).tolist())
            rows = [row(w, x if k in some else None) for k, (w, x) in enumerate(zip(words, ids, strict=True))]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [*kinds.values(), *more.values()], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *kinds, *more])

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, schema + ", runs array<struct<start: long, length: long, period: long>>, collapsed string" * texts)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's texts: in a tenth of the documents, by crc32 of doc_id, the words from a place on repeat a stretch of their own."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), changed=planted)
