"""Landed files in, tables out: sitemaps, platform products, probes, labels, runs and snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WOO = (
    "id long, name string, permalink string, price string, regular_price string, stock_status string, description string, short_description string, sku string, weight string, "
    "dimensions struct<length:string,width:string,height:string>, images array<struct<src:string,alt:string>>, meta_data array<struct<key:string,value:string>>, "
    "categories array<struct<name:string,slug:string>>, attributes array<struct<key:string,value:string>>"
)
SHOPIFY = "products array<struct<handle:string,title:string,variants:array<struct<price:string,available:boolean>>,images:array<struct<src:string,alt:string>>>>"
LABELS = "store_url string, platform string, ground_truth map<string,struct<verdict:string,notes:string>>"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; where it is unset, of this machine, if all runs on it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='storegrain-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/storegrain/{tag}-{uuid.uuid4().hex}"


def landed(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again, for what several plans need."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sitemap_urls(spark: SparkSession, path: str) -> DataFrame:
    """Distinct page URLs of landed sitemap documents (one folder of XML files)."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path).select("loc").filter("loc is not null").distinct()


def sitemap_children(spark: SparkSession, path: str) -> DataFrame:
    """Sitemaps that landed sitemap indexes name."""
    return spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path).select("loc").filter("loc is not null").distinct()


def sitemap_walk(spark: SparkSession, path: str, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(loc, depth): the page URLs below the sitemap documents of roots (url), following indexes to `depth`, each document once and each URL at its least depth.

    path holds the landed documents, one file each, with the URL as its name in percent-encoding.
    """
    of = lambda tag: spark.read.format("xml").option("rowTag", tag).schema("loc string, lastmod string").load(path).filter("loc is not null").select(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)).alias("file"), F.trim("loc").alias("loc"))
    # the name is encoded once more in the file's own path
    named = lambda df: df.withColumn("doc", F.url_decode(F.regexp_replace("file", r"\.xml$", ""))).drop("file")
    pages, children = named(of("url")), named(of("sitemap"))
    seen = roots.select(F.col("url").alias("doc"), F.lit(0).alias("depth"))
    for k in range(depth):
        more = children.join(seen.filter(F.col("depth") == k).select("doc"), "doc", "left_semi").select(F.col("loc").alias("doc"), F.lit(k + 1).alias("depth")).distinct()
        seen = seen.unionByName(more.join(seen.select("doc"), "doc", "left_anti"))
    return pages.join(seen, "doc").groupBy("loc").agg(F.min("depth").alias("depth"))


def read_json_columns(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """df with its JSON texts as columns of the given types; a text that doesn't parse is null."""
    return df.withColumns({c: F.from_json(c, kind, {"mode": "PERMISSIVE"}) for c, kind in schemas.items()})


def write_json_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.to_json(c) for c in columns})


def woocommerce_products(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WOO).json(path, multiLine=True)


def shopify_products(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHOPIFY).json(path, multiLine=True).select(F.explode("products").alias("p")).select("p.*")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(store_url, platform, category, verdict, notes)."""
    rows = spark.read.schema(LABELS).json(path, multiLine=True)
    return rows.select("store_url", "platform", F.explode("ground_truth").alias("category", "v")).select("store_url", "platform", "category", "v.verdict", "v.notes")


def append_facts(facts: DataFrame, pages: DataFrame, path: str) -> None:
    """Facts whose URL has a page row in the same run, appended by run and fact."""
    known = pages.select("store_id", "run_id", F.col("url").alias("resource_url"))
    facts.join(known, ["store_id", "run_id", "resource_url"], "left_semi").write.mode("append").partitionBy("run_id", "fact").parquet(path)


def replace_policies(chunks: DataFrame, path: str) -> None:
    """Overwrites the partitions of the policies that have new chunks, and no others."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("policy_id").parquet(path)


def read_evolved(spark: SparkSession, path: str) -> DataFrame:
    """A table whose files have come to have more columns over time."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def _bucket(key: list[str], n: int):
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def write_buckets(df: DataFrame, path: str, key: list[str], buckets: int = 64) -> None:
    """df as a table of folders by a hash of its key, for merge_buckets."""
    df.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def merge_buckets(new: DataFrame, path: str, key: list[str], merge, buckets: int = 64) -> None:
    """Puts new into the table at path (of write_buckets, with as many buckets) by merge(old, new), which has one key's rows at a time.

    Only the folders that new has keys of are read and written; all others keep their files. What is merged is written
    to the shared folder first, so a job that fails leaves the table as it was.
    """
    spark = new.sparkSession
    n = new.withColumn("bucket", _bucket(key, buckets))
    touched = sorted(r["bucket"] for r in n.select("bucket").distinct().collect())  # `buckets` numbers at most
    if not touched:
        return
    old = spark.read.schema(n.schema).parquet(path).filter(F.col("bucket").isin(touched)).drop("bucket")
    merged = landed(merge(old, new).withColumn("bucket", _bucket(key, buckets)), "merged-buckets")
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def replace_changed_buckets(after: DataFrame, path: str, key: list[str], buckets: int = 64) -> None:
    """Makes the table at path (of write_buckets) be after, and writes only the folders of which a row is new, gone or another."""
    spark = after.sparkSession
    a = landed(after.withColumn("bucket", _bucket(key, buckets)), "after")
    row = lambda df: df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(F.to_json(F.struct(*after.columns)))).alias("h"))
    before = spark.read.schema(a.schema).parquet(path)
    j = row(a).join(row(before).withColumnsRenamed({"n": "m", "h": "g"}), "bucket", "full_outer")
    rows = j.filter("n is distinct from m or h is distinct from g").select("bucket", F.col("n").isNull().alias("gone")).collect()  # `buckets` rows at most
    changed = [r["bucket"] for r in rows if not r["gone"]]
    a.filter(F.col("bucket").isin(changed)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for r in rows:
        if r["gone"]:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={r['bucket']}")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
