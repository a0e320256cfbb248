"""How the tokens of two tokenizers cover the same text.

Both sides' tokens are byte ranges of a document. An as-of merge in each direction, keyed by document, finds for each
token start the other side's token that covers it; the union of both directions is every pair of overlapping tokens.
Where tokens of both sides end at one place, a group of tokens ends. How many documents hold a pair of ids is counted
over the whole table, and each document's links are scored by these counts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.llm.bpe import byte_alphabet
from storegrain.llm.common import landed, slices

#: Texts that are aligned at once in a task.
AT_ONCE = 64
#: Pairs whose counts are sent to every task at most; the counts of rarer pairs come by a shuffle.
MOST_PAIRS = 1_000_000
#: Distinct pairs that a task counts before it hands them on.
MOST_COUNTED = 1_000_000


class ByteLevel:
    """Byte-level BPE of a tokenizer.json whose ids are in the order of its merges, split by the pattern of its kind."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = {c: b for b, c in byte_alphabet().items()}
        made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError(f"{path}: ids aren't in the order of the merges")
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if all(c in byte_of for c in t) and (len(t) == 1 or i >= made[0])}
        ranks = {t: i for t, i in ranks.items() if len(t) == 1 or i <= made[-1]}
        self.bytes: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes[i] = t
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Pieces:
    """BPE of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [bytes([int(t[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", t) else t.replace("▁", " ").encode() for t in names]
        self.encode = lambda texts: model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def _loaded(kind: type, path: str):
    return kind(path)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """(2, links): token numbers of a and b whose ranges overlap. Both: doc, at (start), ascending in at over all documents, which each side covers whole."""
    a, b = a.assign(a=np.arange(len(a))), b.assign(b=np.arange(len(b)))
    of_a = pd.merge_asof(a, b, on="at", by="doc")
    of_b = pd.merge_asof(b, a, on="at", by="doc")
    of_b = of_b[of_b["at"].to_numpy() != a["at"].to_numpy()[of_b["a"].to_numpy()]]  # those that start together are in of_a
    return np.concatenate([of_a[["a", "b"]].to_numpy(np.int64), of_b[["a", "b"]].to_numpy(np.int64)]).T


def _side(tokens: list[list[int]], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, doc, start, end) of all tokens; offsets run on from document to document."""
    n = np.array([len(x) for x in tokens])
    ids = np.fromiter(chain.from_iterable(tokens), np.int64, n.sum())
    doc = np.repeat(np.arange(len(tokens)), n)
    end = np.cumsum(size[ids])
    return ids, doc, end - size[ids], end


def _packed(keys: np.ndarray) -> bytes:
    return np.diff(keys, prepend=np.zeros(1, keys.dtype)).tobytes()


def aligned(docs: DataFrame, path_a: str, path_b: str, *, written: bool = False) -> DataFrame:
    """Per row: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and as bytes its distinct pairs (differences of
    a * size of B + b) and how often each is linked; with written=True also groups.

    Side A encodes a space and the text, side B the text, before which it puts the space itself. Null and empty texts, and those
    whose tokens of either side don't give the bytes of space and text, have no tokens.
    """
    small = vocabulary_sizes(path_a, path_b)
    kind = np.uint32 if small[0] * small[1] < 2**32 else np.uint64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = _loaded(ByteLevel, path_a), _loaded(Pieces, path_b)
        size_a, size_b = (np.array([len(x) for x in s.bytes], np.int64) for s in (left, right))
        marked = [[np.array([f"{i}{mark}" for i in range(len(s))], object) for mark in marks] for s, marks in ((size_a, ",|"), (size_b, ",;"))]
        for batch in slices(batches, AT_ONCE):
            a, b = [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for text, y in zip(texts, right.encode(texts), strict=True):
                x, raw = [], b" " + text.encode("utf-8", "surrogatepass")
                if text:
                    if b"".join(map(right.bytes.__getitem__, y)) == raw:
                        x = left.encode(" " + text)
                if not x or b"".join(map(left.bytes.__getitem__, x)) != raw:
                    x, y = [], []
                a.append(x)
                b.append(y)
            n = len(a)
            ids_a, doc_a, start_a, end_a = _side(a, size_a)
            ids_b, doc_b, start_b, end_b = _side(b, size_b)
            link_a, link_b = overlaps(pd.DataFrame({"doc": doc_a, "at": start_a}), pd.DataFrame({"doc": doc_b, "at": start_b})) if len(ids_a) else np.zeros((2, 0), np.int64)
            ends = np.intersect1d(end_a, end_b, assume_unique=True)
            group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
            last_a, last_b = ends[group_a] == end_a, ends[group_b] == end_b
            # the tokens of a group stand together, those of A first
            out = np.empty(len(ids_a) + len(ids_b), object)
            out[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)] = np.where(last_a, marked[0][1][ids_a], marked[0][0][ids_a])
            out[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, side="right")] = np.where(last_b, marked[1][1][ids_b], marked[1][0][ids_b])
            at = np.arange(n + 1)
            cut_a, cut_b = np.searchsorted(doc_a, at), np.searchsorted(doc_b, at)
            n_groups = np.bincount(doc_a[last_a], minlength=n)
            doc, key = doc_a[link_a], ids_a[link_a] * len(size_b) + ids_b[link_b]
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            first = np.flatnonzero(np.r_[len(key) > 0, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])][: len(key)])
            times = np.diff(np.r_[first, len(key)]).astype(np.uint32)
            key, of = key[first].astype(kind), np.searchsorted(doc[first], at)
            groups = ["".join(out[x:y].tolist())[:-1] for x, y in zip(cut_a[:-1] + cut_b[:-1], cut_a[1:] + cut_b[1:], strict=True)]
            columns = {
                "row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_a": pa.array(np.diff(cut_a)), "n_b": pa.array(np.diff(cut_b)), "n_groups": pa.array(n_groups),
                "n_links": pa.array(np.bincount(doc_a[link_a], minlength=n)), "groups_sha256": pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()),
                "pairs": pa.array([_packed(key[x:y]) for x, y in zip(of[:-1], of[1:], strict=True)], pa.binary()), "times": pa.array([times[x:y].tobytes() for x, y in zip(of[:-1], of[1:], strict=True)], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(columns | ({"groups": pa.array(groups, pa.string())} if written else {}))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    return rows.mapInArrow(run, schema + ", groups string" * written)


@lru_cache(maxsize=4)
def vocabulary_sizes(path_a: str, path_b: str) -> tuple[int, int]:
    return len(_loaded(ByteLevel, path_a).bytes), len(_loaded(Pieces, path_b).bytes)


def pair_counts(rows: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """(pair, n, best): how many rows hold each pair, and whether no other pair of its A id is held by more. Counted in the tasks, then summed."""
    kind = np.uint32 if sizes[0] * sizes[1] < 2**32 else np.uint64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([keys, *waiting])
            order = np.argsort(every, kind="stable")
            every, times = every[order], np.concatenate([n, np.ones(len(every) - len(n), np.int64)])[order]
            first = np.flatnonzero(np.r_[len(every) > 0, every[1:] != every[:-1]][: len(every)])
            return every[first], np.add.reduceat(times, first) if len(first) else times

        for b in batches:
            waiting += [np.cumsum(np.frombuffer(x, kind), dtype=kind).astype(np.int64) for x in b.column("pairs").to_pylist()]
            if sum(map(len, waiting)) < MOST_COUNTED:
                continue
            keys, n = summed()
            waiting = []
            if len(keys) >= MOST_COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])
                keys, n = keys[:0], n[:0]
        keys, n = summed()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])

    counts = landed(rows.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    a = F.floor(F.col("pair") / sizes[1])
    most = F.broadcast(counts.groupBy(a.alias("a")).agg(F.max("n").alias("most")))  # a row for each id of A at most
    return counts.join(most, a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(rows: DataFrame, counts: DataFrame, sizes: tuple[int, int], *, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """rows (of `aligned`) with n_best and count_sum in place of pairs and times.

    The counts of the most frequent pairs, most_pairs at most, go to every task. The others are joined by a shuffle; as
    they are in fewer documents each, none of their keys is hot.
    """
    kind = np.uint32 if sizes[0] * sizes[1] < 2**32 else np.uint64
    power = F.length(F.bin("n")) - 1
    by_power = {r["power"]: r["count"] for r in counts.groupBy(power.alias("power")).count().collect()}  # 63 at most
    least = max(by_power, default=0) + 1
    while by_power and least > 0 and sum(c for p, c in by_power.items() if p >= least - 1) <= most_pairs:
        least -= 1
    sent = counts.filter(power >= least).toPandas().sort_values("pair")
    given = rows.sparkSession.sparkContext.broadcast((sent["pair"].to_numpy(np.int64), sent["n"].to_numpy(np.int64), sent["best"].to_numpy(bool)))
    rest = least > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = given.value
        for b in slices(batches, 256):
            keys = [np.cumsum(np.frombuffer(x, kind), dtype=kind).astype(np.int64) for x in b.column("pairs").to_pylist()]
            times = [np.frombuffer(x, np.uint32).astype(np.int64) for x in b.column("times").to_pylist()]
            doc = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
            key, time = np.concatenate(keys), np.concatenate(times)
            at = np.minimum(np.searchsorted(pair, key), max(0, len(pair) - 1))
            known = pair[at] == key if len(pair) else np.zeros(len(key), bool)
            sums = np.zeros((2, len(keys)), np.int64)
            if len(pair):
                np.add.at(sums[0], doc[known], (time * best[at])[known])
                np.add.at(sums[1], doc[known], (time * n[at])[known])
            cut, other = np.searchsorted(doc[~known], np.arange(len(keys) + 1)), (key[~known], time[~known])
            columns = [b.column(c) for c in b.schema.names if c not in ("pairs", "times")]
            columns += [pa.array(sums[0]), pa.array(sums[1])]
            columns += [pa.array([v[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int64())) for v in other] if rest else []
            yield pa.RecordBatch.from_arrays(columns, names)

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("pairs", "times")]
    names = [f.split()[0] for f in kept] + ["n_best", "count_sum"] + ["rare", "rare_times"] * rest
    summed = rows.mapInArrow(run, ", ".join([*kept, "n_best long", "count_sum long"] + ["rare array<long>", "rare_times array<long>"] * rest))
    if not rest:
        return summed
    summed = landed(summed, "aligned")
    rare = summed.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("times"))
    more = rare.join(counts, "pair").groupBy(F.col("row").alias("of")).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("n")).alias("s"))
    both = summed.join(more, F.col("row") == F.col("of"), "left")
    return both.withColumns({"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0))}).drop("rare", "rare_times", "of", "b", "s")


def align(docs: DataFrame, path_a: str, path_b: str, *, texts: bool = False, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Per row: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups_sha256, and with texts=True groups.

    Groups are written a1,a2|b1;a3|b2,b3. A link is a pair of overlapping token occurrences; n_best counts those whose ids are
    linked in as many documents as any pair of the same A id (ties count), count_sum adds up the documents of every link.
    Null and empty texts, and those that a side cannot give back byte by byte, have zeros, '' as groups and as their hash.
    Each row is a document, also where rows or ids are repeated or null; other columns are not read; an empty table gives no rows.
    A text is aligned whole in one task; its tokens take some 300 bytes each there.
    """
    sizes = vocabulary_sizes(path_a, path_b)
    rows = landed(aligned(docs, path_a, path_b, written=texts), "alignments")
    return scored(rows, landed(pair_counts(rows, sizes), "pairs"), sizes, most_pairs=most_pairs).drop("row")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
