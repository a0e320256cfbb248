"""Removing benchmark passages from training documents, with DataFrame functions only.

The windows of all benchmark items form a set of hashed word n-grams. The first words of every
window of a document are tested inside its row against a bitmap sized by their counted number; the few windows that pass are
exploded, joined with the set (broadcast if its counted size is below a bound, else by a shuffle) and confirmed word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.llm.common import ascii_lower, bitmap, fewer, is_set, landed, sha256

#: What is no word character: ASCII but for digits and letters.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The first words of a window that the bitmap holds.
HEAD = 3


def words(text: Column) -> Column:
    """Words of a text: runs of ASCII digits and letters, lower-cased, and of characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


def _head(ws: Column, i: Column, m: int) -> Column:
    """Hash of the words i, i + 1, ... (from 0), m of them."""
    return F.xxhash64(*[F.get(ws, i + k) for k in range(m)])


def benchmark_windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """(item_id, len, h, gram): distinct windows of each item. An item of fewer than n words, but not none, is one window."""
    b = benchmark.select("item_id", words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    length = F.least(F.size("ws"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("ws") - length + 1)
    return b.select("item_id", length.alias("len"), F.explode(F.transform(starts, lambda i: F.slice(F.col("ws"), i, length))).alias("gram")).distinct().withColumn("h", F.xxhash64("gram"))


def _covered(spans: Column) -> Column:
    """Number of positions inside any of the spans (at, len), which are sorted by at."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(acc, s):
        end = (s["at"] + s["len"]).cast("long")
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["at"].cast("long")))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(spans, zero, step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 13, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items (sorted strings), spans of hit words.

    Null, empty and wordless texts have no words and no hits. An empty benchmark gives no hits, an empty docs no rows;
    columns other than doc_id and text of docs, item_id and text of benchmark are not read. Rows of
    docs that repeat give one row each. Item ids are compared as strings; items whose texts are alike all count.
    Rows of benchmark with a null item_id are one item: their words are hits, n_items counts it, items cannot name it.
    """
    grams = benchmark_windows(benchmark, n).groupBy("len", "h", "gram").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items_of"), F.count_if(F.col("item_id").isNull()).alias("nulls"))
    grams = landed(fewer(grams.select("*", F.least("len", F.lit(HEAD)).alias("m"), F.monotonically_increasing_id().alias("window"))), "benchmark-windows")
    held = F.aggregate(F.concat("gram", "items_of"), F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16)
    n_bytes = grams.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0]
    # at most n lengths, whatever the benchmark's size
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect())
    head = F.when(F.col("m") == 1, _head(F.col("gram"), F.lit(0), 1)).when(F.col("m") == 2, _head(F.col("gram"), F.lit(0), 2)).otherwise(_head(F.col("gram"), F.lit(0), HEAD))
    bits, table = bitmap(grams.select(head.alias("h")), "h")
    small = n_bytes <= broadcast_bytes

    def starts(ws: Column, m: int) -> Column:
        """Where the first m words of some window may stand."""
        return F.when(F.size(ws) > 0, F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: is_set(table, bits, _head(ws, i, m)))).otherwise(F.array())

    def whole(m: int, k: int) -> Column:
        """Runs of k words from those starts."""
        ws = F.col("ws")
        return F.transform(F.filter(f"starts{m}", lambda i: i + k <= F.size(ws)), lambda i: F.struct(i.alias("at"), F.lit(k).alias("len"), F.slice(ws, i + 1, k).alias("gram")))

    heads = sorted({min(k, HEAD) for k in lengths})
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("ws"))
    d = d.select("*", *[starts(F.col("ws"), m).alias(f"starts{m}") for m in heads])
    found = F.concat(F.array().cast("array<struct<at:int,len:int,gram:array<string>>>"), *[whole(min(k, HEAD), k) for k in lengths])
    d = d.select("row", "doc_id", F.size("ws").cast("long").alias("n_words"), found.alias("found"))
    each = d.select("row", "doc_id", "n_words", F.explode_outer("found").alias("w")).select("row", "doc_id", "n_words", F.col("w.at").alias("at"), F.col("w.len").alias("len"), F.col("w.gram").alias("gram"))
    each = each.withColumn("h", F.xxhash64("gram"))
    # windows first, each once; items come to the distinct windows of a row
    windows = grams.select(F.col("h").alias("h_b"), F.col("len").alias("len_b"), F.col("gram").alias("gram_b"), "window")
    windows = F.broadcast(windows) if small else windows
    hit = each.join(windows, (F.col("h") == F.col("h_b")) & (F.col("len") == F.col("len_b")) & (F.col("gram") == F.col("gram_b")), "left")
    of_row = ["row", "doc_id", "n_words"]
    rows = hit.groupBy(*of_row).agg(F.array_sort(F.collect_set(F.when(F.col("window").isNotNull(), F.struct("at", "len")))).alias("spans"), F.collect_set("window").alias("windows"))
    held = grams.select(F.col("window").alias("w"), "items_of", "nulls")
    held = F.broadcast(held) if small else held
    named = rows.select(*of_row, "spans", F.explode_outer("windows").alias("window")).join(held, F.col("window") == F.col("w"), "left")
    out = named.groupBy(*of_row).agg(F.first("spans").alias("spans"), F.collect_set("items_of").alias("items"), F.sum("nulls").alias("nulls"))
    out = out.withColumn("items", F.array_sort(F.array_distinct(F.flatten("items"))))
    out = out.withColumn("n_items", F.size("items").cast("long") + F.when(F.col("nulls") > 0, 1).otherwise(0)).drop("nulls")
    return out.withColumn("n_hit", _covered(F.col("spans"))).drop("row")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents of which hit words are a twentieth or more. A doc_id with several rows, null too, goes if any of them is contaminated.

    All columns stay, whatever their names; repeated rows stay or go together. The ids are written first, so that Spark
    knows their size and sends them to the documents where they are few.
    """
    bad = contamination(docs, benchmark).filter(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("d")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))
    return rows.join(landed(fewer(bad), "contaminated"), F.col("id").eqNullSafe(F.col("d")), "left_anti").select("row.*")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    c = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return c.select("doc_id", "n_words", "n_hit", "n_items", sha256(F.array_join("items", ",")).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


SQL = r"""
with dw as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws
  from documents),
bw as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws
  from benchmark),
g as (
  select distinct item_id, n, array_to_string(ws[s:s + n - 1], ' ') as gram
  from (select item_id, ws, least(len(ws), 13) as n, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) as s from bw where len(ws) > 0)),
w as (
  select doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') as gram
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as s from dw, (select distinct n from g) where len(ws) >= n)),
h as (select doc_id, w.n, s, item_id from w join g on w.gram = g.gram and w.n = g.n),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from h) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from h) group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from dw left join c using (doc_id) left join i using (doc_id)
"""
