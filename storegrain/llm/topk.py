"""Exact top-k inner products: norm-sorted blocks, rotated partial sums, Cauchy-Schwarz bounds.

Vectors are dealt to blocks in order of falling length, and each task takes its blocks in that order. All are rotated by the eigenvectors of their summed
outer products (the right singular vectors of the table), so that few leading coordinates hold most of a
product. A block is skipped for a query if |q| |v| of its longest vector cannot reach the query's k-th score so
far; a pair is skipped if its leading partial sum plus the product of the two remaining lengths cannot.
The scores of what is left are exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storegrain.llm.common import landed, slices

#: Integers up to here are exact in double arithmetic.
EXACT = 2**53
LEAD = 16
#: Bytes of the vectors of one block at most.
BLOCK_BYTES = 1 << 20


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component; null if the vector is null or has a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("double")))


def _matrix(column) -> np.ndarray:
    """Rows padded with zeros to one width."""
    width = max(map(len, column))
    if all(len(v) == width for v in column):
        return np.stack([*column]).astype(np.float64)
    out = np.zeros((len(column), width))
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def rotation(vectors: DataFrame) -> np.ndarray:
    """Orthogonal matrix whose columns are the right singular vectors, largest first. Sums of outer products meet as width * width numbers."""

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((0, 0))
        for b in batches:
            if len(b):
                x = _matrix(b["v"])
                x = x / max(1.0, np.abs(x).max())
                g = x.T @ x
                w = max(len(g), len(total))
                total = np.pad(total, (0, w - len(total))) + np.pad(g, (0, w - len(g)))
        i, j = np.nonzero(np.ones_like(total))
        yield pd.DataFrame({"i": i, "j": j, "g": total[i, j]})

    rows = vectors.select("v").mapInPandas(outer, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    if rows.empty:
        return np.zeros((0, 0))
    g = np.zeros((rows["i"].max() + 1,) * 2)
    g[rows["i"], rows["j"]] = rows["g"]
    return np.linalg.eigh((g + g.T) / 2)[1][:, ::-1].copy()


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All integer products of rows of a with rows of b, in double where that is exact, else in Python's integers."""
    if a.size == 0 or b.size == 0 or np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return a @ b.T
    whole = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object)
    return whole(a).dot(whole(b).T)


class Search:
    """Best k of the queries of one block, over candidate vectors given in order of falling length."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, turn: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.q, self.k, self.turn = ids, _wide(q, len(turn)), k, turn
        r = self.q @ turn
        self.lead, self.rest, self.norm = r[:, :LEAD], np.linalg.norm(r[:, LEAD:], axis=1), np.linalg.norm(r, axis=1)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.astype(float)
        self.found: list[list[tuple]] = [[] for _ in ids]

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        v = _wide(v, len(self.turn))
        r = v @ self.turn
        norm = np.linalg.norm(r, axis=1)
        slack = 1e-9 * (self.norm.max() * norm.max() + 1) + 1e-6  # rounding of the rotated sums
        live = np.flatnonzero(self.norm * norm.max() + slack >= self.floor)
        if not len(live):
            return
        bound = self.lead[live] @ r[:, :LEAD].T + np.outer(self.rest[live], np.linalg.norm(r[:, LEAD:], axis=1))
        may = bound + slack >= self.floor[live][:, None]
        live, own = live[may.any(1)], np.flatnonzero(may.any(0))
        if not len(live) or not len(own):
            return
        score = exact_products(self.q[live], v[own])
        hit = (score >= self.floor[live][:, None]) & (self.ids[live][:, None] != ids[own][None, :])
        for x in np.flatnonzero(hit.any(1)):
            a, c = live[x], np.flatnonzero(hit[x])
            best = sorted([*self.found[a], *zip((-score[x, c]).tolist(), ids[own[c]].tolist(), strict=True)])[: self.k]
            self.found[a] = best
            if len(best) == self.k:
                # a double may be above the whole number that it stands for
                self.floor[a] = max(self.floor[a], np.nextafter(float(-best[-1][0]), -np.inf) if abs(best[-1][0]) >= EXACT else float(-best[-1][0]))

    def result(self) -> pd.DataFrame:
        rows = [(int(q), int(i), int(-s)) for q, best in zip(self.ids, self.found, strict=True) for s, i in best]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (g, vec_id, v[, floor]) of one batch and group as one row of arrays."""
    for b in batches:
        for g, part in b.groupby("g"):
            v = _matrix(part["v"])
            floor = part["floor"].to_numpy(float) if "floor" in part else np.zeros(0)
            yield pd.DataFrame({"ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "v": [v.tobytes()], "floor": [floor.tobytes()], "far": [np.linalg.norm(v, axis=1).max()]})


PACKED = "ids binary, v binary, floor binary, far double"


def _unpacked(ids: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(v).reshape(len(ids), -1)


def without_repeats(vectors: DataFrame) -> DataFrame:
    """One row of each vec_id: of unlike vectors the least. Only ids are shuffled where none is repeated."""
    n, ids = vectors.agg(F.count("vec_id"), F.count_distinct("vec_id")).first()
    return vectors if n == ids else vectors.groupBy("vec_id").agg(F.min("v").alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, block: int = 2048, query_block: int = 1024, queries_held: int = 32, tasks: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (vec_id, v) the k highest integer products with vectors (vec_id, v) of other ids.

    Ties go to the smaller vec_id; with fewer candidates all are given. v holds whole numbers; vectors of unlike width
    count as padded with zeros. Rows without an id or a vector take no part, rows that repeat a vec_id count once, of
    unlike ones the least vector; empty tables give no rows and other columns are not read. Scores are whole numbers of
    64 bits.

    Tasks form a grid of query groups by vector groups. A task holds up to `queries_held` blocks of queries and reads
    its blocks of vectors as a stream, by falling length. So each vector is shuffled once for each group of queries,
    and each query once for each group of vectors; `tasks` vector groups, by default twice the cores.
    """
    given = lambda t: without_repeats(t.select("vec_id", "v").filter("vec_id is not null and v is not null"))
    vectors, queries = given(vectors), given(queries)
    turn = rotation(vectors)
    # blocks of wide vectors have fewer rows, so that one is a megabyte at most
    block, query_block = (max(1, min(n, BLOCK_BYTES // (8 * max(1, len(turn))))) for n in (block, query_block))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    vectors, queries = vectors.withColumn("norm", length), queries.withColumn("norm", length)
    # the longest vectors give every query a first k-th score; block rows, whatever the table's size
    top = vectors.orderBy(F.desc("norm"), "vec_id").limit(block).toPandas()
    head_ids, head = top["vec_id"].to_numpy(), _matrix(top["v"]) if len(top) else np.zeros((0, len(turn)))

    n_blocks = max(1, -(-vectors.count() // block))
    n_query_blocks = max(1, -(-queries.count() // query_block))
    n_rows = -(-n_query_blocks // queries_held)
    n_columns = min(n_blocks, max(tasks or 2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-n_blocks // 64)))

    def start(b: pd.DataFrame) -> pd.DataFrame:
        s = Search(b["vec_id"].to_numpy(), _matrix(b["v"]), turn, k)
        if len(head):
            s.add(head_ids, head)
        full = np.array([len(f) == k for f in s.found])
        return pd.DataFrame({"vec_id": s.ids, "v": b["v"], "g": b["g"], "floor": np.where(full, s.floor, -np.inf)})

    grouped = queries.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(n_query_blocks)).cast("int"))
    grouped = landed(grouped.groupBy("g").applyInPandas(start, "vec_id long, v array<double>, g int, floor double"), "queries")
    # blocks are rows of arrays; a row of the grid has some of the query blocks, a column some of the vector blocks
    blocks = vectors.repartitionByRange(n_blocks, F.desc("norm"), F.xxhash64("vec_id")).select(F.lit(0).alias("g"), "vec_id", "v")
    blocks = landed(blocks.mapInPandas(_packed, PACKED), "blocks").withColumn("at", F.xxhash64("ids"))
    wanted = landed(grouped.repartition("g").sortWithinPartitions("g").mapInPandas(_packed, PACKED), "query-blocks").withColumn("at", F.xxhash64("ids"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = blocks.select("*", F.lit(1).alias("kind"), F.pmod("at", F.lit(n_columns)).cast("int").alias("y"), every(n_rows).alias("x"))
    wanted = wanted.select("*", F.lit(0).alias("kind"), F.pmod("at", F.lit(n_rows)).cast("int").alias("x"), every(n_columns).alias("y"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def results() -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(pd.concat([s.result() for s in held], ignore_index=True).astype("int64"), preserve_index=False)

        for b in slices(batches, 1):
            row = {c: b.column(c)[0].as_py() for c in b.schema.names}
            if (row["x"], row["y"]) != cell:
                if held:
                    yield results()
                cell, held = (row["x"], row["y"]), []
            ids, v = _unpacked(row["ids"], row["v"])
            if row["kind"] == 0:
                held.append(Search(ids, v, turn, k, np.frombuffer(row["floor"])))
                continue
            order = np.lexsort((ids, -np.linalg.norm(v, axis=1)))
            for i in range(0, len(order), 512):
                for s in held:
                    s.add(ids[order[i : i + 512]], v[order[i : i + 512]])
        if held:
            yield results()

    # the queries of a cell come first, then its vectors by falling length
    cells = wanted.unionByName(blocks).repartition("x", "y").sortWithinPartitions("x", "y", "kind", F.desc("far"))
    found = cells.mapInArrow(scan, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", scaled(F.col("embedding")).alias("v")).filter("v is not null and vec_id is not null")
    return top_k(e, e.filter("vec_id % 50 = 0"))


SQL = """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from e q, e c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""
