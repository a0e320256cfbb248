"""Dropping lines that many documents share, over levelled sorted runs of line hashes.

A run is a table (h1, h2, n_docs), bucketed and sorted by the 128-bit line hash, so runs are merged, and a batch is
anti-joined with them, by merge joins that don't shuffle the runs again. Every batch of documents anti-joins the run
of keys that are known to be frequent, as nothing more has to be known of them, and adds the counts of its other keys
as a run of level 0. When a level has `fanout` runs they are merged to one run of the next level; what a merge finds
to be frequent goes to the run of frequent keys.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.llm.common import ascii_lower, deleted, fewer, free_name, landed, new_path, sha256

#: The characters stripped at both ends of a line: space, and tab to carriage return.
STRIP = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
#: Lines of one batch, about; a table has three batches at least.
BATCH_LINES = 500_000_000
#: Lines for each bucket of the runs, about.
BUCKET_LINES = 200_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(STRIP)))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """One run of two, counts of equal keys added up: a merge join of their buckets."""
    b = b.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("n_docs").alias("m"))
    j = a.join(b.hint("merge"), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "full_outer")
    n = F.coalesce("n_docs", F.lit(0).cast("long")) + F.coalesce("m", F.lit(0).cast("long"))
    return j.select(F.coalesce("h1", "k1").alias("h1"), F.coalesce("h2", "k2").alias("h2"), n.alias("n_docs"))


class LineRuns:
    """Levelled sorted runs of (h1, h2, n_docs), and one of the keys in min_docs documents or more. The driver holds only their names.

    Runs are tables of the session's catalog, in the shared folder. `drop` takes them off the catalog and deletes them.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2, n_lines: int = 0):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.n_buckets = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_lines // BUCKET_LINES)))
        self.levels: list[list[str]] = []
        self.known: str | None = None
        self.made: list[tuple[str, str]] = []

    def _write(self, run: DataFrame) -> str:
        name, path = f"line_run_{uuid.uuid4().hex}", new_path(self.spark, "line-run")
        run.write.bucketBy(self.n_buckets, *KEY).sortBy(*KEY).format("parquet").option("path", path).saveAsTable(name)
        self.made.append((name, path))
        return name

    def frequent(self) -> DataFrame | None:
        """Keys known to be in min_docs documents or more."""
        return None if self.known is None else self.spark.table(self.known).select(*KEY)

    def _split(self, run: DataFrame) -> str:
        """Writes a merged run; of it the frequent keys go to the run of these."""
        name = self._write(run)
        hot = self.spark.table(name).filter(F.col("n_docs") >= self.min_docs)
        if self.known is None:
            self.known = self._write(hot)
        elif hot.limit(1).count():
            self.known = self._write(merged(self.spark.table(self.known), hot))
        return name

    def add(self, counts: DataFrame) -> None:
        """Adds a batch of (h1, h2, n_docs), one row a key; its documents are in no other batch."""
        old = self.frequent()
        if old is not None:
            counts = counts.join(old.hint("merge"), KEY, "left_anti")
        run, level = self._split(counts), 0
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            run = self._split(reduce(merged, map(self.spark.table, self.levels[level])))
            self.levels[level] = []
            level += 1

    def close(self) -> DataFrame:
        """All runs are merged: the keys (h1, h2) in min_docs documents or more, over all batches."""
        runs = [r for level in self.levels for r in level]
        if len(runs) > 1:
            self.levels = [[self._split(reduce(merged, map(self.spark.table, runs)))]]
        return self.frequent()

    def drop(self) -> None:
        for name, path in self.made:
            self.spark.sql(f"drop table {name}")
            deleted(self.spark, path)
        self.made = []


def frequent_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, batches: int | None = None, fanout: int = 2) -> tuple[DataFrame, DataFrame]:
    """The line table (doc_id, th, pos, h1, h2, batch) of docs and the keys (h1, h2) in at least min_docs documents.

    The line table has hashes only and is written once, without lines whose key is shorter than min_chars, which never
    count. It is read in batches of whole documents, by default as many as its counted lines need.
    """
    spark = docs.sparkSession
    lines = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .withColumn("k", line_key(F.col("line")))
        .filter(F.char_length("k") >= min_chars)
        .select("doc_id", "th", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2"))
    )
    lines = landed(lines, "lines")
    n_lines = lines.count()
    batches = batches or max(3, -(-n_lines // BATCH_LINES))
    runs = LineRuns(spark, min_docs, fanout, n_lines)
    for b in range(batches):
        new = lines.filter(F.pmod(F.xxhash64(F.lit(b"batch"), "doc_id"), F.lit(batches)) == b).select(*KEY, "doc_id").distinct()
        runs.add(new.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs")))  # in parts, so a key found everywhere is one row a part
    frequent = landed(fewer(runs.close()), "frequent-lines")
    runs.drop()
    return lines, frequent


def dedup_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, batches: int | None = None, counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with text without the lines that at least min_docs documents hold, and with the counts of its lines and of those dropped.

    A document is a doc_id, null being one; of its rows each keeps its own text. Null or empty text is one empty line,
    which is never dropped, as its key has no character; null becomes the empty text. All other columns of docs stay,
    whatever their names: where docs has a column of a count's name, the count's gets underscores. counts=None gives none.
    Repeated rows stay and have equal results, an empty table stays empty.
    """
    lines, frequent = frequent_lines(docs, min_docs=min_docs, min_chars=min_chars, batches=batches)
    drops = lines.join(frequent, KEY).select("doc_id", "th", "pos").distinct()  # rows that repeat whole
    drops = drops.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.sort_array(F.collect_list("pos")).alias("drops"))
    # whether each line goes, up to the last that does: the gaps between the sorted positions, each followed by a true
    gap = lambda p, k: F.array_repeat(F.lit(False), p - F.coalesce(F.get("drops", k - 1), F.lit(-1)) - 1)
    drops = drops.select("d", "h", F.size("drops").alias("n"), F.flatten(F.transform("drops", lambda p, k: F.concat(gap(p, k), F.array(F.lit(True))))).alias("gone"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text.alias("t"))
    rows = rows.join(drops, F.col("id").eqNullSafe(F.col("d")) & (F.xxhash64("t") == F.col("h")), "left")
    hit = F.col("gone").isNotNull()
    kept = F.filter(F.split("t", "\n", -1), lambda _, i: ~F.coalesce(F.get("gone", i), F.lit(False)))
    n_lines = (F.char_length("t") - F.char_length(F.replace("t", F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_dropped = F.coalesce("n", F.lit(0)).cast("long")
    new = F.when(hit, F.array_join(kept, "\n")).otherwise(F.col("t"))
    names = [free_name(docs.columns, c) for c in counts or ()]
    return rows.select(F.col("row").withField("text", new).alias("row"), *[c.alias(n) for c, n in zip((n_lines, n_dropped), names, strict=False)]).select("row.*", *names)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", sha256(F.col("text")).alias("kept_sha256"))


SQL = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
k as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (where f.key is not null) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.key is null), '')) as kept_sha256
from k left join f on k.key = f.key group by doc_id
"""
