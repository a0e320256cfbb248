"""Queries over landed files and tables out: the given tables written as a store's files, and read again by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.operators import catalog_match as M
from storegrain.operators import findings as N
from storegrain.operators import retrieval as V
from storegrain.plans import read
from storegrain.sources import tables as T

#: Rows of a table for each file that is written, about.
FILE_ROWS = 200


def _files(rows: DataFrame, text, tag: str) -> str:
    """A folder of files with one text each: rows have the file's number g, and text makes of each g's rows one."""
    path = T.shared_path(rows.sparkSession, tag)
    rows.groupBy("g").agg(text.alias("value")).write.partitionBy("g").text(path)
    return path


def _group(key: str):
    return F.floor(F.col(key) / FILE_ROWS).cast("long").alias("g")


def sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as sitemap documents: their distinct URLs, and an index of hosts."""
    p = read(spark, sf_dir, "pages").filter("url is not null and not contains(url, '&') and not contains(url, '<')")
    one = F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>"))
    path = _files(p.select(_group("page_id"), one.alias("x")), F.concat(F.lit("<urlset>"), F.array_join(F.collect_list("x"), ""), F.lit("</urlset>")), "sitemaps")
    return T.sitemap_urls(spark, path)


SITEMAP_SQL = "select distinct url as loc from pages where url is not null and not contains(url, '&') and not contains(url, '<')"


def woocommerce_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts as one platform's raw products, and the feed that they make."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    text = lambda c: c.cast("string")
    meta = F.array(F.struct(F.lit("_other").alias("key"), F.lit("x").alias("value")), F.struct(F.when(k % 2 == 0, "_GTIN").otherwise("ean").alias("key"), F.when(k % 3 != 0, text(k)).otherwise("").alias("value")), F.struct(F.lit("condition").alias("key"), F.when(k % 5 == 0, "Used").otherwise("odd").alias("value")))
    kinds = F.array(F.struct(F.lit("Goods").alias("name")), F.struct(F.when(k % 4 == 0, "Espresso bar").when(k % 4 == 1, "E-Scooter").otherwise("Things").alias("name")))
    raw = F.struct(
        k.alias("id"), F.col("p_name").alias("name"), F.when(k % 7 == 0, "").otherwise(text(F.col("p_retailprice").cast("decimal(12,2)"))).alias("price"), F.lit("9.50").alias("regular_price"), F.when(k % 2 == 0, "instock").when(k % 9 != 0, "onbackorder").alias("stock_status"),
        F.when(k % 3 == 0, F.col("p_type")).otherwise("").alias("description"), F.lit("short").alias("short_description"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("sku"), k)).alias("sku"), text(F.col("p_size") / 2).alias("weight"), meta.alias("meta_data"), kinds.alias("categories"),
        F.array(F.struct(F.lit("i").alias("src")), F.struct(F.lit("").alias("src"))).alias("images"), none.alias("nothing"),
    )
    path = _files(read(spark, sf_dir, "part").select(_group("p_partkey"), raw.alias("x")), F.to_json(F.collect_list("x")), "products")
    return M.normalized_feed(T.woocommerce_products(spark, path)).select("id", "title", "description", "price", "gtin", "mpn", "category", "condition", "availability", "shipping_weight_kg", F.size("images").alias("n_images"))


WOO_SQL = """
select 'woocommerce-' || p_partkey as id, p_name as title, case when p_partkey % 3 = 0 and p_type <> '' then p_type else 'short' end as description, case when p_partkey % 7 = 0 then 9.5 else p_retailprice::decimal(12, 2)::double end as price,
  case when p_partkey % 3 <> 0 then p_partkey::varchar end as gtin, case when p_partkey % 6 <> 0 then 'sku' || p_partkey end as mpn, case p_partkey % 4 when 0 then 'coffee_machine' when 1 then 'electric_scooter' else 'household_tool' end as category,
  case when p_partkey % 5 = 0 then 'used' else 'new' end as condition, case when p_partkey % 2 = 0 then 'in_stock' when p_partkey % 9 <> 0 then 'onbackorder' else 'out_of_stock' end as availability, p_size / 2 as shipping_weight_kg, 1 as n_images from part
"""


def shopify_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts as another platform's product files: their variants."""
    k = F.col("p_partkey")
    raw = F.struct(F.concat(F.lit("h"), k).alias("handle"), F.col("p_name").alias("title"), F.array(F.struct(F.col("p_size").cast("string").alias("price"), (k % 2 == 0).alias("available")), F.struct(F.lit("1.00").alias("price"), F.lit(None).cast("boolean").alias("available"))).alias("variants"))
    path = _files(read(spark, sf_dir, "part").select(_group("p_partkey"), raw.alias("x")), F.to_json(F.struct(F.collect_list("x").alias("products"))), "shop")
    return T.shopify_products(spark, path).select("handle", "title", F.explode("variants").alias("v")).select("handle", "title", "v.price", F.coalesce("v.available", F.lit(False)).alias("available"))


SHOPIFY_SQL = "select 'h' || p_partkey as handle, p_name as title, p_size::varchar as price, p_partkey % 2 = 0 as available from part union all select 'h' || p_partkey, p_name, '1.00', false from part"


def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as files of ground truth for two categories a document, and the accuracy of verdicts by the length of the texts."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    said = lambda c: F.struct(F.when(F.col(c) == 1, "fail").otherwise("pass").alias("verdict"), F.lit("").alias("notes"))
    row = F.struct(F.col("doc_id").cast("string").alias("store_url"), F.lit("p").alias("platform"), F.struct(said("quality").alias("quality"), said("toxic").alias("toxic")).alias("ground_truth"))
    known = read(spark, sf_dir, "labels").filter("quality is not null and toxic is not null").dropDuplicates(["doc_id"])
    truth = T.ground_truth(spark, _files(known.select(_group("doc_id"), row.alias("x")), F.to_json(F.collect_list("x")), "labels"))
    verdicts = d.select(F.col("doc_id").cast("string").alias("store_url"), F.explode(F.array(F.lit("quality"), F.lit("toxic"))).alias("category"), F.when(F.col("n") > 1000, "fail").otherwise("pass").alias("verdict"))
    return V.accuracy(verdicts, truth.drop("notes", "platform"), ["store_url", "category"]).select("category", "tp", "fp", "tn", "fn")


ACCURACY_SQL = """
with t as (select doc_id, unnest([{'c': 'quality', 'bad': quality = 1}, {'c': 'toxic', 'bad': toxic = 1}]) as x from labels where quality is not null and toxic is not null),
j as (select x.c as category, x.bad as bad, coalesce(length(text) > 1000, false) as said from t left join documents using (doc_id))
select category, count(*) filter (where said and bad) as tp, count(*) filter (where said and not bad) as fp, count(*) filter (where not said and not bad) as tn, count(*) filter (where not said and bad) as fn from j group by 1
"""


def exported_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as findings, exported as a file of comma-separated values and read again; texts hold commas and quotes."""
    o = read(spark, sf_dir, "orders")
    f = o.select(
        F.concat(F.lit("c"), F.col("o_orderkey") % 4).alias("check_id"), F.concat(F.lit('a "title", '), "o_orderkey").alias("title"), F.lower("o_orderpriority").alias("severity"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("u"), "o_orderkey")).alias("page_url"),
        F.col("o_orderdate").cast("timestamp").alias("detected_at"), F.lit("e").alias("unknown"),
    )
    path = T.shared_path(spark, "export")
    N.export_csv(f, path)
    return spark.read.csv(path, header=True).select("check_id", "title", "severity", "page_url", "detected_at", "evidence")


EXPORT_SQL = """
select 'c' || o_orderkey % 4 as check_id, 'a "title", ' || o_orderkey as title, lower(o_orderpriority) as severity, case when o_orderkey % 2 = 0 then 'u' || o_orderkey end as page_url, strftime(o_orderdate::timestamp, '%Y-%m-%dT%H:%M:%S') as detected_at, null::varchar as evidence from orders
"""


def stored_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order lines as facts in two batches, appended where their order is a page of the run; policies as chunks, of which the second batch replaces those of some."""
    li = read(spark, sf_dir, "lineitem")
    f = li.select(F.lit("s").alias("store_id"), F.concat(F.lit("r"), F.col("l_orderkey") % 2).alias("run_id"), F.col("l_orderkey").cast("string").alias("resource_url"), F.col("l_returnflag").alias("fact"), F.col("l_linenumber").cast("string").alias("value"))
    pages = read(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(F.lit("s").alias("store_id"), F.concat(F.lit("r"), F.col("o_orderkey") % 2).alias("run_id"), F.col("o_orderkey").cast("string").alias("url"))
    path, chunks = T.shared_path(spark, "facts"), T.shared_path(spark, "chunks")
    for part in ("value <= '3'", "value > '3'"):
        T.append_facts(f.filter(part), pages, path)
    c = read(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey") % 5).alias("policy_id"), "s_name")
    T.replace_policies(c, chunks)
    T.replace_policies(c.filter("policy_id in ('p1', 'p3')").groupBy("policy_id").agg(F.max("s_name").alias("s_name")), chunks)
    n = spark.read.parquet(path).groupBy(F.concat_ws("/", "run_id", "fact").alias("kept"))
    return n.agg(F.count(F.lit(1)).alias("n")).unionByName(spark.read.parquet(chunks).groupBy(F.col("policy_id").alias("kept")).agg(F.count(F.lit(1)).alias("n")))


STORED_FACTS_SQL = """
select 'r' || l_orderkey % 2 || '/' || l_returnflag as kept, count(*) as n from lineitem where l_orderkey in (select o_orderkey from orders where o_orderkey % 3 <> 0) group by 1
union all select 'p' || s_suppkey % 5, case when s_suppkey % 5 in (1, 3) then 1 else count(*) end from supplier group by s_suppkey % 5
"""

QUERIES = {f.__name__: f for f in (sitemap_pages, woocommerce_feed, shopify_variants, label_accuracy, exported_findings, stored_facts)}
SQL = {"sitemap_pages": SITEMAP_SQL, "woocommerce_feed": WOO_SQL, "shopify_variants": SHOPIFY_SQL, "label_accuracy": ACCURACY_SQL, "exported_findings": EXPORT_SQL, "stored_facts": STORED_FACTS_SQL}
