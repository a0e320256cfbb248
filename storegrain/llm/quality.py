"""Text quality by naive Bayes support vectors.

Indicators of hashed n-grams (words, punctuation runs and their shapes) are scaled by the log ratio of their
class counts, and a linear hinge-loss model over them is fitted by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import re
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.llm.common import bounded_share, held_out, slices

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|\n")
BUCKETS = 1 << 17
#: Labels that are broadcast at most.
MOST_BROADCAST = 500_000
P = np.uint64(0x9E3779B97F4A7C15)


class Tokens(dict):
    """token -> row of `hashes`, of its lower-cased text and of its shape. Emptied when full."""

    def __init__(self):
        self.hashes = np.zeros((1 << 18, 2), np.uint64)
        self.seen = np.zeros(BUCKETS, bool)

    def __missing__(self, token: str) -> int:
        if token[0].isalnum():
            shape = "A" if len(token) > 1 and token.isupper() else "Aa" if token[0].isupper() else "0" if token.isdigit() else "a"
        else:
            shape = token[:4]
        k = self[token] = len(self)
        self.hashes[k] = xxhash.xxh64_intdigest(token.lower().encode("utf-8", "surrogatepass")), xxhash.xxh64_intdigest("\0" + shape)
        return k

    def rows(self, tokens: list[str]) -> np.ndarray:
        if len(self) + len(tokens) > len(self.hashes):
            self.clear()
            if len(tokens) > len(self.hashes):
                self.hashes = np.zeros((len(tokens), 2), np.uint64)
        return self.hashes[np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))]


def _share(x: np.ndarray) -> int:
    """Distinct values of x."""
    x = np.sort(x)
    return int(np.count_nonzero(x[1:] != x[:-1])) + 1


def indicators(text: str | None, table: Tokens) -> np.ndarray:
    """Sorted distinct buckets: words and word pairs, shapes in runs of 1 to 3, and how much of the text is repeated or of one shape."""
    tokens = TOKEN.findall(text) if text else []
    if not tokens:
        return np.zeros(1, np.int64)
    both = table.rows(tokens)
    w, s = both[:, 0].copy(), both[:, 1].copy()
    parts = [w, w[:-1] * P + w[1:], s, s[:-1] * P + s[1:], (s[:-2] * P + s[1:-1]) * P + s[2:]]
    # shares in sixteenths: distinct words, tokens equal to one of the two before, the commonest shapes
    n = len(tokens)
    again = np.count_nonzero(w[1:] == w[:-1]) + np.count_nonzero(w[2:] == w[:-2])
    _, counts = np.unique(s, return_counts=True)
    stats = [_share(w) / n, min(1, again / n), *sorted(counts / n)[-3:][::-1]]
    parts.append(np.array([(k + 1) * 1000 + int(16 * x) for k, x in enumerate(stats)] + [9000 + n.bit_length()], dtype=np.uint64) * P)
    table.seen[(np.concatenate(parts) * P) >> np.uint64(47)] = True
    out = np.flatnonzero(table.seen)
    table.seen[out] = False
    return out


def class_counts(labelled: DataFrame) -> np.ndarray:
    """(2, BUCKETS + 1): documents of each class that have each indicator, and all of them. Over every row of labelled (text, label)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, table = np.zeros((2, BUCKETS + 1)), Tokens()
        for b in slices(batches, 256):
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                n[label, indicators(text, table)] += 1
                n[label, BUCKETS] += 1
        for y in (0, 1):
            at = np.flatnonzero(n[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), y, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[y, at])], ["label", "cell", "n"])

    rows = labelled.select("text", "label").mapInArrow(count, "label int, cell int, n double").groupBy("label", "cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((2, BUCKETS + 1))
    out[rows["label"].to_numpy(int), rows["cell"].to_numpy(int)] = rows["n"]
    return out


def dual_coordinate_descent(xs: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, *, c: float = 1.0, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model over rows with value ratio[k] at each k of xs; y in -1, 1."""
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(xs))
    values = [ratio[x] for x in xs]
    # classes of unequal size: the bound of a row grows as its class shrinks
    top = np.where(y > 0, c * len(y) / max(1, 2 * (y > 0).sum()), c * len(y) / max(1, 2 * (y < 0).sum()))
    q = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(xs)):
            gradient = y[i] * (w[xs[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / q[i], 0.0), top[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[xs[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def train(labelled: DataFrame, *, bound: int = 3_000, alpha: float = 1.0) -> dict:
    """Model from labelled (doc_id, text, label 0 or 1). Class counts are over all rows; the linear model is fitted on about `bound`
    rows of each class, chosen by a hash of doc_id and text, equal rows once, in one task. Class counts take repeated rows as
    often as they are there; other columns are not read. Without rows of a class all scores are 0.5.
    """
    n = class_counts(labelled)
    totals = n[:, BUCKETS]
    model = {"w": np.zeros(BUCKETS), "bias": 0.0, "scale": 1.0}
    if not totals.all():
        return model
    p = (n[:, :BUCKETS] + alpha) / (totals[:, None] + 2 * alpha)
    ratio = np.log(p[1] / p[0])
    most = [bounded_share(bound, int(t)) for t in totals]
    chosen = labelled.filter(F.xxhash64("doc_id", "text") <= F.when(F.col("label") == 1, most[1]).otherwise(most[0])).select("doc_id", "text", "label").dropDuplicates()

    def fit(b: pd.DataFrame) -> pd.DataFrame:
        table = Tokens()
        b = b.sort_values(["doc_id", "text"])
        xs = [indicators(t, table) for t in b["text"]]
        y = np.where(b["label"] == 1, 1.0, -1.0)
        w, bias = dual_coordinate_descent(xs, y, ratio)
        margins = np.array([w[x] @ ratio[x] + bias for x in xs])
        return pd.DataFrame({"w": [w.tobytes()], "bias": [bias], "scale": [2.0 / max(1e-9, float(np.abs(margins).mean()))]})

    fitted = chosen.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit, "w binary, bias double, scale double").first()
    if fitted is None:
        return model
    return {"w": np.frombuffer(fitted["w"]) * ratio, "bias": fitted["bias"], "scale": fitted["scale"]}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Per row: doc_id, score from 0 to 1, predicted. Null and empty texts are scored alike, by the empty text's indicator.

    Rows are scored one by one: repeated rows have equal scores, an empty table gives none, other columns are not read.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = given.value, Tokens()
        for b in slices(batches, 256):
            margin = np.array([m["w"][indicators(t, table)].sum() + m["bias"] for t in b.column("text").to_pylist()]) * m["scale"]
            s = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the rows to learn from: those not held out, with a quality of 0 or 1.

    A doc_id that is labelled several times has one label; where its labels differ it has none. Each row of docs with
    such a doc_id is one to learn from.
    """
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("d")).agg(F.min("quality").cast("int").alias("label"), F.max("quality").alias("most"))
    known = known.filter(F.col("label") == F.col("most")).drop("most")
    # a label is two numbers: up to a counted size they go to the texts, beyond it the texts are shuffled
    known = F.broadcast(known) if known.count() <= MOST_BROADCAST else known
    return docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("d")).drop("d")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(labelled_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
