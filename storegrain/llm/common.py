"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new one of this machine, if all runs on it."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = f"file://{tempfile.mkdtemp(prefix='storegrain-')}"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/storegrain/{tag}-{uuid.uuid4().hex}"


def fewer(df: DataFrame, times: int = 8) -> DataFrame:
    """df in an eighth of the shuffle partitions: for what is left after an aggregate or a filter, so that it isn't written as many small files."""
    return df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // times))


def landed(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back. It cuts the lineage, and a lost executor loses none of it."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    """The path and its file system, as Spark's own readers see them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def written(spark: SparkSession, path: str, content: bytes) -> None:
    p, fs = _file(spark, path)
    out = fs.create(p)
    out.write(bytearray(content))
    out.close()


def deleted(spark: SparkSession, path: str) -> None:
    p, fs = _file(spark, path)
    fs.delete(p, True)


def discarded(*tables: DataFrame) -> None:
    """Deletes what `landed` wrote. Nothing that is still to be computed may read it."""
    for t in tables:
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            deleted(t.sparkSession, folder)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. `lower` does the same, faster, where all is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def constant_array(values: list, kind: str) -> Column:
    """A constant array<kind>. One string that Spark folds once, not one expression a value."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def slices(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, n at a time, so that no more texts than that are Python strings at once."""
    for b in batches:
        for i in range(0, b.num_rows, n):
            yield b.slice(i, n)


def bounded_share(bound: int, total: int) -> int:
    """The greatest 64-bit hash of a sample of about `bound` of `total` rows, chosen by their hashes; all of them up to the bound.

    The whole range of hashes is divided, so a sample stays as large at any total.
    """
    return 2**63 - 1 if total <= bound else -(2**63) + 2**64 * bound // total


def free_name(columns: list[str], name: str) -> str:
    """name, with as many underscores behind it as it takes to be none of columns; Spark's names don't know case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of a bitmap of keys for each of them, and its least and greatest size.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 25


def bitmap(hashes: DataFrame, column: str) -> tuple[int, Column]:
    """(bits, constant array<bigint>) with a bit set for each 64-bit hash of the column, sized by their counted number; MOST_BITS / 64 longs at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * hashes.count()).bit_length()))
    at = F.col(column).bitwiseAND(F.lit(bits - 1)).cast("int")
    cells = hashes.select(F.shiftright(at, 6).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), at).alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect()
    words = [0] * (bits // 64)
    for r in cells:
        words[r["cell"]] = r["bits"]
    return bits, constant_array(words, "bigint")


def is_set(table: Column, bits: int, hashed: Column) -> Column:
    at = hashed.bitwiseAND(F.lit(bits - 1)).cast("int")
    return F.call_function("shiftrightunsigned", F.get(table, F.shiftright(at, 6)), at).bitwiseAND(F.lit(1).cast("long")) == 1  # a shift takes the low 6 bits


def may_be_among(key: Column, rows: DataFrame, column: str) -> Column:
    """False only where key is no value of the column of rows. Beyond some million values it rules out few."""
    bits, table = bitmap(rows.select(F.xxhash64(column).alias("h")), "h")
    return is_set(table, bits, F.xxhash64(key))
