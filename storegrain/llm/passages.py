"""Removing passages that an earlier document holds, by intervals of a Burrows-Wheeler transform.

Equal stretches of `span` bytes are brought together in four steps.

1. Texts are dealt to units of some megabytes at random and written once, bucketed by unit. Of equal texts only those of the
   smallest doc_id go on; the others are removed whole.
2. The least hash of the GRAM-byte strings in a window of `span` bytes is the window's key, so equal windows have equal keys, and
   the windows of a stretch of text fall into few fragments of one key. Each unit sends its distinct keys, packed, to buckets,
   which answer whether other documents have them.
3. Fragments of shared keys go, each distinct one once a unit, to blocks by key. The windows of a key with very many fragments go
   one by one, by their own hash, so no key makes a block large.
4. A block sorts the suffixes of its distinct fragments, without stretches whose windows all have hashes of their own, as these
   have no equals. Their intervals are expanded breadth-first by backward extension: an interval of common prefix l + 1 is one of
   prefix l with a byte before it, so boundaries are found by increasing value, from the prefix that the sort has told apart on,
   and the work stops at `span`. What is still together then are equal windows; the smallest doc_id of each is known, and each
   unit is told which of its bytes are to go.

Units, buckets and blocks are bounded by counts, whatever a document, key or group of copies holds.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.llm.common import deleted, discarded, landed, new_path

SPAN = 50
GRAM = 16
#: Bytes of text in a unit, keys in a bucket and bytes of fragments in a block, about.
UNIT_BYTES, BUCKET_KEYS, BLOCK_BYTES = 4 << 20, 1_000_000, 4 << 20
#: Rows of one text that may be dealt to one task, at least.
COPIES = 1000
#: Fragments of a key beyond which its windows are dealt one by one, and windows of a fragment at most.
HOT, LONGEST = 30_000, 512
#: Bytes whose keys are computed at once.
PIECE = 1 << 19
NONE = np.iinfo(np.int64).max
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def string_hashes(b: np.ndarray, length: int) -> np.ndarray:
    """A hash of the string of length bytes that starts at each byte."""
    h = (b.astype(np.uint64) + np.uint64(1)) * M1
    h ^= h >> np.uint64(29)
    size, left, whole, done, by = 1, length, None, 0, M2
    with np.errstate(over="ignore"):
        while left:  # hashes of 1, 2, 4, ... bytes, joined as the binary form of length says
            if left & 1:
                part = h[done:]
                whole = part.copy() if whole is None else whole[: len(part)] * by + part[: len(whole)]
                done += size
            left >>= 1
            if left:
                h = h[: len(h) - size] * by + h[size:]
                by, size = by * M2 + np.uint64(2), 2 * size
    return whole[: len(b) - length + 1]


def window_keys(b: np.ndarray, span: int) -> np.ndarray:
    """The key of the window of span bytes that starts at each byte."""
    gram, width = min(GRAM, span), span - min(GRAM, span) + 1
    h = string_hashes(b, gram)
    h = (h ^ (h >> np.uint64(32))) * M3
    h ^= h >> np.uint64(29)
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[: len(h) - size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def in_pieces(f, b: np.ndarray, span: int) -> np.ndarray:
    """What f has for each window of span bytes."""
    return np.concatenate([np.zeros(0, np.uint64), *(f(b[i : i + PIECE + span - 1], span) for i in range(0, max(0, len(b) - span + 1), PIECE))])


class Unit:
    """The texts of a unit that have windows, in the order of their rows, and their fragments."""

    def __init__(self, texts: pa.Table, copies: set[int], span: int):
        order = np.argsort(texts.column("row").to_numpy())
        rows = zip(*(texts.column(c).take(pa.array(order)).to_pylist() for c in ("row", "doc_id", "text")), strict=True)
        self.rows = [r for r in rows if r[2] is not None and len(r[2]) >= span and r[1] is not None and r[0] not in copies]
        self.span, self.data = span, b"".join([r[2] for r in self.rows])
        self.doc_ids = np.array([r[1] for r in self.rows], np.int64)
        self.ends = np.cumsum([len(r[2]) for r in self.rows], dtype=np.int64)

    def cut(self) -> None:
        """at, windows, key, doc: of each fragment. A fragment is a run of windows of one key and document, LONGEST at most."""
        b, span = np.frombuffer(self.data, np.uint8), self.span
        key = in_pieces(window_keys, b, span)
        starts = np.r_[0, self.ends[:-1]][: len(self.ends)]
        new = np.zeros(len(key) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        new[starts] = True
        over = np.minimum(self.ends - span + 1, len(key))  # where the windows of a text end
        new[over] = True
        at = np.flatnonzero(new[:-1])
        n = np.diff(np.r_[at, len(key)])
        doc = np.searchsorted(self.ends, at, side="right")
        fits = at < over[np.minimum(doc, len(over) - 1)] if len(over) else np.zeros(0, bool)
        at, n, doc = at[fits], n[fits], doc[fits]
        times = -(-n // LONGEST)
        if (times > 1).any():
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at, n, doc = np.repeat(at, times) + part * LONGEST, np.minimum(LONGEST, np.repeat(n, times) - part * LONGEST), np.repeat(doc, times)
        self.at, self.windows, self.doc, self.key = at, n, doc, key[at] if len(at) else np.zeros(0, np.uint64)

    def keys(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, of, n): distinct bucket << 32 | high bits of the key, ascending; the code of each fragment; 2 for each code if documents share it here, and its fragments."""
        code = (self.key & np.uint64(0xFFFFFFFF)) % np.uint64(buckets) << np.uint64(32) | self.key >> np.uint64(32)
        code, of = np.unique(code, return_inverse=True)
        lo, hi = np.full(len(code), NONE), np.full(len(code), -1)
        np.minimum.at(lo, of, self.doc)
        np.maximum.at(hi, of, self.doc)
        return code, of, np.minimum(np.bincount(of, minlength=len(code)), 32_767) | (lo != hi).astype(np.int64) << 15


def _unit(texts: pa.Table, notes: pa.Table, span: int) -> Unit:
    return Unit(texts, set(notes.column("copy").drop_null().to_pylist()), span)


def _by_first(column: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of the runs of an ascending column."""
    at = np.flatnonzero(np.r_[len(column) > 0, column[1:] != column[:-1]][: len(column)])
    yield from zip(column[at].tolist(), at.tolist(), np.r_[at[1:], len(column)][: len(at)].tolist(), strict=True)


def sent_keys(buckets: int, span: int):
    """Of a unit: (bucket, unit, keys, n) for each bucket."""

    def run(texts: pa.Table, notes: pa.Table) -> pa.Table:
        u = _unit(texts, notes, span)
        u.cut()
        code, _, n = u.keys(buckets)
        low, n = code.astype(np.uint32), n.astype(np.uint16)
        rows = [(k, low[i:j].tobytes(), n[i:j].tobytes()) for k, i, j in _by_first((code >> np.uint64(32)).astype(np.int64))]
        columns = [*zip(*rows, strict=True)] or [(), (), ()]
        unit = texts.column("unit")[0].as_py() if texts.num_rows else None
        return pa.table({"bucket": pa.array(columns[0], pa.int64()), "unit": pa.array([unit] * len(rows), pa.int64()), "keys": pa.array(columns[1], pa.binary()), "n": pa.array(columns[2], pa.binary())})

    return run


def shared_keys(bucket: pa.Table) -> pa.Table:
    """(unit, bucket, state, shared): for each unit's keys 0, 1 where several documents have the key, 2 where they have very many fragments of it; shared: fragments of 1 and 2."""
    keys = [np.frombuffer(x, np.uint32) for x in bucket.column("keys").to_pylist()]
    counts = [np.frombuffer(x, np.uint16) for x in bucket.column("n").to_pylist()]
    _, of = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.concatenate(counts).astype(np.int64)
    units, many, total = np.bincount(of), np.zeros(of.max() + 1, bool), np.bincount(of, weights=n & 0x7FFF)
    many[of[n >> 15 == 1]] = True
    state = np.where((units > 1) | many, np.where(total > HOT, 2, 1), 0).astype(np.uint8)[of]
    cuts = np.cumsum([0, *map(len, keys)])
    shared = np.where(state > 0, n & 0x7FFF, 0)
    out = [(state[i:j].tobytes(), int(shared[i:j].sum())) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"unit": bucket.column("unit"), "bucket": bucket.column("bucket"), "state": pa.array([x for x, _ in out], pa.binary()), "shared": pa.array([x for _, x in out], pa.int64())})


def sent_fragments(buckets: int, blocks: int, span: int):
    """Of a unit: (block, unit, sizes, data, of, places) for each block: distinct fragments, and for each occurrence its fragment, doc_id, text and offset."""

    def run(texts: pa.Table, notes: pa.Table) -> pa.Table:
        u = _unit(texts, notes, span)
        u.cut()
        known = notes.filter(pc.is_valid(notes.column("bucket"))).sort_by("bucket")
        state = np.frombuffer(b"".join(known.column("state").to_pylist()), np.uint8)
        of = u.keys(buckets)[1]
        state = state[of] if len(of) else np.zeros(0, np.uint8)
        at, n, doc, key = u.at[state == 1], u.windows[state == 1], u.doc[state == 1], u.key[state == 1]
        hot, times = np.flatnonzero(state == 2), u.windows[state == 2]
        if len(hot):  # each window by itself
            one = np.repeat(u.at[hot], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            own = np.array([xxhash.xxh64_intdigest(u.data[i : i + span]) for i in one.tolist()], np.uint64)
            at, n, doc, key = np.r_[at, one], np.r_[n, np.ones(len(one), np.int64)], np.r_[doc, np.repeat(u.doc[hot], times)], np.r_[key, own]
        block = (key >> np.uint64(7)) % np.uint64(blocks)
        order = np.argsort(block, kind="stable")
        at, n, doc, block = at[order], n[order], doc[order], block[order].astype(np.int64)
        starts = np.r_[0, u.ends[:-1]][: len(u.ends)]
        rows = []
        for k, i, j in _by_first(block):
            numbers: dict[bytes, int] = {}
            of = [numbers.setdefault(u.data[x : x + m + span - 1], len(numbers)) for x, m in zip(at[i:j].tolist(), n[i:j].tolist(), strict=True)]
            places = np.stack([u.doc_ids[doc[i:j]], doc[i:j] << 32 | at[i:j] - starts[doc[i:j]]])
            rows.append((k, np.array([len(f) for f in numbers], np.uint32).tobytes(), b"".join(numbers), np.array(of, np.uint32).tobytes(), places.tobytes()))
        columns = [*zip(*rows, strict=True)] or [()] * 5
        unit = texts.column("unit")[0].as_py() if texts.num_rows else None
        named = {c: pa.array(v, pa.binary()) for c, v in zip(("sizes", "data", "of", "places"), columns[1:], strict=True)}
        return pa.table({"block": pa.array(columns[0], pa.int64()), "unit": pa.array([unit] * len(rows), pa.int64())} | named)

    return run


def sorted_suffixes(b: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, edge, known): suffixes in order of their first `depth` bytes at least: by 7 bytes first, then those still equal by twice as many in each round.

    known is the greatest prefix up to depth of such a round, and edge says where its intervals start. The eighth byte of
    the first key is the number of the others that there are, so the end of b is before a zero byte.
    """
    n, size = len(b), min(7, depth)
    padded = np.r_[b, np.zeros(size, np.uint8)]
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key = key << np.uint64(8) | padded[k : k + n]
    key = key << np.uint64(8) | np.minimum(np.arange(n, 0, -1), size).astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    slot = np.arange(n)
    first = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], slot, 0))  # the slot where a group of equals starts
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = first, -1
    edge, known = first == slot, size
    while size < depth:
        tied = np.flatnonzero(np.r_[first[1:] == first[:-1], False] | np.r_[False, first[1:] == first[:-1]])
        if not len(tied):
            break
        some = order[tied]
        key = first[tied] << 32 | rank[np.minimum(some + size, n)] + 1
        by = np.argsort(key)
        some, key = some[by], key[by]
        order[tied] = some
        first[tied] = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], tied, 0))
        rank[some] = first[tied]
        size *= 2
        if size <= depth:
            edge, known = first == slot, size
    return order, edge, known


def prefix_classes(b: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, edge): suffixes in order, and where a common prefix of less than span bytes with the one before ends an interval.

    next_ leads from a suffix to that without its first byte, so two neighbours of equal first byte share l + 1 bytes if
    their next ones are in one interval of prefix l: the interval is extended backward by that byte. Every level
    looks only at neighbours that no level before has parted.
    """
    n = len(b)
    order, edge, known = sorted_suffixes(b, span)
    place = np.empty(n + 1, np.int64)
    place[order], place[n] = np.arange(n), 0
    next_ = place[order + 1].astype(np.int32)
    together = np.flatnonzero(~edge)
    left, right = next_[together - 1], next_[together]
    for _ in range(span - known):
        if not len(together):
            break
        interval = np.cumsum(edge, dtype=np.int32)
        parted = interval[left] != interval[right]
        edge[together[parted]] = True
        together, left, right = together[~parted], left[~parted], right[~parted]
    return order, edge


def least_of_equals(b: np.ndarray, at: np.ndarray, of: np.ndarray, span: int) -> np.ndarray:
    """For the windows of span bytes at ascending places `at`: the least `of` among those with equal bytes.

    Windows of a hash of their own have no equals. Only the stretches of the others are sorted, and their bytes decide.
    """
    least = of.copy()
    h = in_pieces(string_hashes, b, span)[at]
    order = np.argsort(h)
    h = h[order]
    same = h[1:] == h[:-1]
    again = np.zeros(len(at), bool)
    again[order[np.r_[same, False] | np.r_[False, same]]] = True
    again = np.flatnonzero(again)
    if not len(again):
        return least
    start = np.r_[True, np.diff(at[again]) > 1]  # of a stretch
    stretch = np.cumsum(start) - 1
    size = np.bincount(stretch) + span - 1
    b = b[np.repeat(at[again[start]] - np.cumsum(size) + size, size) + np.arange(size.sum())]
    place = np.arange(len(again)) + stretch * (span - 1)
    order, edge = prefix_classes(b, span)
    values = np.full(len(b), NONE)
    values[place] = of[again]
    values[order] = np.minimum.reduceat(values[order], np.flatnonzero(edge))[np.cumsum(edge) - 1]
    least[again] = values[place]
    return least


def removed_bytes(span: int):
    """Of a block: (unit, marks) for each unit, marks being (text, from, to) of the bytes that an earlier document has."""

    def run(block: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        fragment, doc_ids, places, unit = [], [], [], []
        for k, (sizes, data, of, place) in enumerate(zip(*(block.column(c).to_pylist() for c in ("sizes", "data", "of", "places")), strict=True)):
            cuts = np.cumsum(np.r_[0, np.frombuffer(sizes, np.uint32)]).tolist()
            own = np.array([numbers.setdefault(data[i:j], len(numbers)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], np.int64)
            fragment.append(own[np.frombuffer(of, np.uint32)])
            both = np.frombuffer(place, np.int64).reshape(2, -1)
            doc_ids.append(both[0])
            places.append(both[1])
            unit.append(np.full(both.shape[1], k))
        fragment, doc_ids, places, unit = (np.concatenate(x) for x in (fragment, doc_ids, places, unit))
        size = np.array([len(f) for f in numbers], np.int64)
        ends = np.cumsum(size)
        starts, windows = ends - size, size - span + 1
        least = np.full(len(size), NONE)
        np.minimum.at(least, fragment, doc_ids)
        b = np.frombuffer(b"".join(numbers), np.uint8)
        del numbers
        cuts = np.cumsum(windows) - windows
        first = least_of_equals(b, np.repeat(starts - cuts, windows) + np.arange(windows.sum()), np.repeat(least, windows), span)
        # of each fragment the least and greatest of the documents that its windows have first
        lo, hi = np.minimum.reduceat(first, cuts), np.maximum.reduceat(first, cuts)
        text, at = places >> 32, places & 0xFFFFFFFF
        whole = hi[fragment] < doc_ids
        parts = [np.stack([unit[whole], text[whole], at[whole], (at + size[fragment])[whole]])]
        part = np.flatnonzero(~whole & (lo[fragment] < doc_ids))
        for some in np.array_split(part, 1 + (int(windows[fragment[part]].sum()) >> 20)):
            n = windows[fragment[some]]
            of, k = np.repeat(some, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            gone = first[cuts[fragment[of]] + k] < doc_ids[of]
            on = gone[1:] & gone[:-1] & (k[1:] > 0)
            s, e = np.flatnonzero(gone & ~np.r_[False, on]), np.flatnonzero(gone & ~np.r_[on, False])
            parts.append(np.stack([unit[of[s]], text[of[s]], at[of[s]] + k[s], at[of[e]] + k[e] + span]))
        marks = np.concatenate(parts, axis=1)
        marks = marks[:, np.argsort(marks[0], kind="stable")]
        names = block.column("unit").to_pylist()
        rows = [(names[k], marks[1:, i:j].astype(np.uint32).tobytes()) for k, i, j in _by_first(marks[0])]
        return pa.table({"unit": pa.array([x for x, _ in rows], pa.int64()), "marks": pa.array([x for _, x in rows], pa.binary())})

    return run


def kept_bytes(span: int, texts_too: bool):
    """Of a unit: the result's rows."""

    def run(texts: pa.Table, notes: pa.Table) -> pa.Table:
        u = _unit(texts, notes, span)
        copies = set(notes.column("copy").drop_null().to_pylist())
        marks = [np.frombuffer(x, np.uint32).reshape(3, -1) for x in notes.column("marks").drop_null().to_pylist()]
        text, start, end = np.concatenate([np.zeros((3, 0), np.uint32), *marks], axis=1).astype(np.int64)
        order = np.lexsort((start, text))
        text, start, end = text[order], start[order], end[order]
        cuts = dict.fromkeys((r[0] for r in u.rows), (0, 0)) | {u.rows[k][0]: (i, j) for k, i, j in _by_first(text)}
        out = []
        for row, doc_id, data in zip(*(texts.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
            data, spans = data or b"", []
            if row in copies and len(data) >= span:
                spans = [[0, len(data)]]
            elif row in cuts and cuts[row][0] < cuts[row][1]:
                s, e = start[slice(*cuts[row])], np.maximum.accumulate(end[slice(*cuts[row])])
                new = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
                spans = np.stack([s[new], np.r_[e[new[1:] - 1], e[-1]]], 1).tolist()
            edges = [0, *(x for s in spans for x in s), len(data)]
            kept = b"".join([data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)])
            out.append((doc_id, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *([kept, [{"start": s, "end": e} for s, e in spans]] if texts_too else [])))
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))] * texts_too
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "spans"] * texts_too
        return pa.table([pa.array(c, k) for c, k in zip([*zip(*out, strict=True)] or [()] * len(kinds), kinds, strict=True)], names=names)

    return run


def later_copies(hashed: DataFrame, most: int) -> DataFrame:
    """(unit, copy): the rows of hashed (h1, h2, unit, row, doc_id) whose text a smaller doc_id has. Texts of over `most` rows go to all tasks, so that their rows aren't dealt to one."""
    by = ["h1", "h2"]
    firsts = landed(hashed.groupBy(*by).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter(F.col("first") < F.col("last")), "passage-firsts")
    often = F.broadcast(firsts.filter(F.col("n") > most))
    seldom = hashed.join(often, by, "left_anti").join(firsts.filter(F.col("n") <= most), by)
    copies = seldom.unionByName(hashed.join(often, by)).filter(F.col("doc_id") > F.col("first"))
    copies = landed(copies.select("unit", F.col("row").alias("copy")), "passage-copies")
    discarded(firsts)
    return copies


def drop_repeats(docs: DataFrame, *, span: int = SPAN, texts: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with texts=True also kept (bytes) and spans (start, end in bytes).

    Every byte goes that lies in a string of span bytes which also starts in a document with a smaller doc_id; matches don't cross
    documents, and all texts count as they came in. Null text is empty. Rows of one doc_id don't remove each other's bytes, so
    repeated rows stay; rows without doc_id are left as they are and remove nothing. Other columns are not read, an empty
    table gives no rows. A text has to fit into a task.
    """
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_units, n_buckets = 1 + total // UNIT_BYTES, 1 + total // 16 // BUCKET_KEYS
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"passage_units_{uuid.uuid4().hex}", new_path(spark, "passage-units")
    dealt = docs.select(F.floor(F.rand(7) * n_units).alias("unit"), F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    try:
        dealt.repartition(parts, "unit").write.bucketBy(parts, "unit").format("parquet").option("path", path).option("compression", "zstd").saveAsTable(name)
        units = spark.table(name)
        # of equal texts those of the smallest doc_id
        hashes = [F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2")]
        hashed = landed(units.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= span)).select("unit", "row", "doc_id", *hashes), "passage-hashes")
        copies = later_copies(hashed, max(COPIES, hashed.count() // parts))
        no = lambda c, kind: F.lit(None).cast(kind).alias(c)
        grouped = lambda notes, f, schema: units.groupBy("unit").cogroup(notes.groupBy("unit")).applyInArrow(f, schema)
        sent = grouped(copies, sent_keys(n_buckets, span), "bucket long, unit long, keys binary, n binary")
        states = landed(sent.groupBy("bucket").applyInArrow(shared_keys, "unit long, bucket long, state binary, shared long"), "passage-keys")
        n_blocks = 1 + (states.select(F.sum("shared")).first()[0] or 0) * (span + 17) // BLOCK_BYTES
        notes = copies.select("unit", "copy", no("bucket", "long"), no("state", "binary")).unionByName(states.select("unit", no("copy", "long"), "bucket", "state"))
        sent = grouped(notes, sent_fragments(n_buckets, n_blocks, span), "block long, unit long, sizes binary, data binary, of binary, places binary")
        marks = landed(sent.groupBy("block").applyInArrow(removed_bytes(span), "unit long, marks binary"), "passage-marks")
        notes = copies.select("unit", "copy", no("marks", "binary")).unionByName(marks.select("unit", no("copy", "long"), "marks"))
        schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<start: long, end: long>>" * texts
        out = landed(grouped(notes, kept_bytes(span, texts), schema), "passages")
        discarded(hashed, copies, states, marks)
        return out
    finally:
        spark.sql(f"drop table if exists {name}")
        deleted(spark, path)


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
