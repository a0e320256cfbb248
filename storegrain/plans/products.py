"""Queries over products, crawl plans, passages, verdicts and labels: part, lineitem, embeddings, documents in these roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.operators import catalog_match as M
from storegrain.operators import crawl as W
from storegrain.operators import extract as E
from storegrain.operators import retrieval as V
from storegrain.plans import read
from storegrain.sources import features as P
from storegrain.sources.tables import landed


def keyed(df: DataFrame, *cols) -> DataFrame:
    return df.select(F.lit("s").alias("store_id"), F.lit("r1").alias("run_id"), *cols)


def category_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven parts of each type a brand: a store is a brand, the type is the page that a part was found on, or none for every fifth part, whose path names its size."""
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("store_id"), F.lit("r1").alias("run_id"), "p_partkey", F.concat(F.lit("https://shop/s"), "p_size", F.lit("/p"), "p_partkey").alias("url"), F.col("p_type").alias("found_on"), F.when(F.col("p_partkey") % 5 == 0, "faq").otherwise("collection").alias("kind"))
    p = p.withColumn("category", W.category(F.col("url"), F.col("found_on"), F.col("kind")))
    return W.capped(p, ["store_id", "run_id", "category"], ["p_partkey"], 2).select("store_id", "category", "p_partkey")


CATEGORY_SQL = """
with p as (select p_brand as store_id, case when p_partkey % 5 = 0 then '/s' || p_size else p_type end as category, p_partkey from part)
select store_id, category, p_partkey from (select *, row_number() over (partition by store_id, category order by p_partkey) as k from p) where k <= 2
"""


def fair_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a page of one of five stores, whose links are its parts."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.col("l_partkey"))).alias("parts"))  # a few an order
    pages = li.select((F.col("l_orderkey") % 5).cast("string").alias("store_id"), F.lit("r1").alias("run_id"), F.col("l_orderkey").alias("seq"), F.transform("parts", lambda p: p.cast("string")).alias("links"))
    return W.interleaved(pages).drop("run_id")


INTERLEAVE_SQL = """
with l as (select l_orderkey as parent, l_partkey, row_number() over (partition by l_orderkey order by l_partkey) - 1 as child from (select distinct l_orderkey, l_partkey from lineitem))
select (parent % 5)::varchar as store_id, l_partkey::varchar as url, (min((child, parent)))[1]::int as child, (min((child, parent)))[2] as parent from l group by 1, 2
"""


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as the URLs that a store lists; a store is a brand."""
    p = read(spark, sf_dir, "part")
    tier = F.when(F.col("p_partkey") % 50 == 1, 0).when(F.col("p_size") <= 15, 1).when(F.col("p_size") <= 25, 2).otherwise(3)
    return p.select(F.col("p_brand").alias("store_id"), F.lit("r1").alias("run_id"), F.concat(F.lit("/p/"), "p_partkey").alias("url"), tier.alias("tier"), F.col("p_partkey").alias("pos"))


def _budgets(urls: DataFrame) -> DataFrame:
    return urls.groupBy("store_id", "run_id").agg(F.count_if(F.col("tier") == 2).alias("catalog"), F.count(F.lit(1)).alias("listed")).select("store_id", "run_id", W.page_budget(F.col("catalog"), F.col("listed")).alias("budget"))


def crawl_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for each store, with the budget that its catalog gives."""
    urls = _inventory(spark, sf_dir)
    return W.plan(urls, _budgets(urls)).drop("run_id")


BUDGET_SQL = """
u as (select p_brand as store_id, '/p/' || p_partkey as url, case when p_partkey % 50 = 1 then 0 when p_size <= 15 then 1 when p_size <= 25 then 2 else 3 end as tier, p_partkey as pos from part),
n as (select store_id, count(*) filter (where tier = 2) as catalog, count(*) as listed from u group by 1),
b as (select store_id, case when catalog > 0 then greatest(60, 2 * catalog + 40) else greatest(60, listed) end as budget from n)
"""
PLAN_SQL = "with" + BUDGET_SQL + """,
k as (select u.*, least(budget, 500) as budget, least(tier, 2) as kind, row_number() over (partition by u.store_id, least(tier, 2) order by tier, pos, url) as k from u join b using (store_id)),
c as (select *, row_number() over (partition by store_id order by tier, pos, url) as r from k where k <= case kind when 0 then 1 when 1 then greatest(10, budget // 3) else budget end)
select store_id, url, tier, pos from c where r <= budget
"""


def page_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budgets(_inventory(spark, sf_dir)).select("store_id", "budget")


def _product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("store_id"), F.lit("r1").alias("run_id"), F.col("p_partkey").alias("seq"), F.col("p_partkey").cast("string").alias("url"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice")).alias("price"), (F.col("p_size") * M.word_count(F.col("p_name"))).alias("n_words"))


def risk_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.risk_sample(_product_pages(spark, sf_dir)).select("store_id", "url", "score")


def sample_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _product_pages(spark, sf_dir)
    return W.sample_coverage(p, W.risk_sample(p)).drop("run_id").withColumn("coverage", F.round("coverage", 6))


COVERAGE_SQL = "select p_brand as store_id, count(*) as n_products, least(count(*), least(50, greatest(5, ceil(0.05 * count(*)))))::bigint as n_checked, round(least(count(*), least(50, greatest(5, ceil(0.05 * count(*))))) / count(*), 6) as coverage, least(50, greatest(5, ceil(0.05 * count(*)))) < count(*) as is_partial from part group by 1"
SAMPLE_SQL = r"""
with p as (select p_brand as store_id, p_partkey as seq, case when p_partkey % 11 <> 0 then p_retailprice end as price, p_size * len(list_filter(regexp_split_to_array(trim(p_name), '\s+'), lambda w: w <> '')) as n_words from part),
c as (select *, count(*) over (partition by store_id) as n, count(price) over (partition by store_id) as priced, row_number() over (partition by store_id order by price nulls last, seq) as k from p),
s as (select *, (case when priced >= 5 and price is not null and k <= greatest(1, ceil(0.1 * priced)) then 1 else 0 end) + (case when n_words between 1 and 39 then 1 else 0 end) as score from c),
r as (select *, row_number() over (partition by store_id order by score desc, seq) as r from s)
select store_id, seq::varchar as url, score from r where r <= least(50, greatest(5, ceil(0.05 * n)))
"""


def _shop(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """part as platform products, lineitem rows as pages that show a unit price and a stock state."""
    part = read(spark, sf_dir, "part")
    api = keyed(part.filter("p_size > 10"), F.concat(F.lit("https://shop/p/"), "p_partkey", F.lit("/")).alias("permalink"), F.col("p_retailprice").alias("price"), (F.col("p_size") % 2 == 0).alias("in_stock"))
    li = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("sup"), F.max("l_returnflag").alias("flag"))
    pages = keyed(li.join(part, F.col("l_partkey") == F.col("p_partkey")), F.col("l_partkey").alias("seq"), F.concat(F.lit("https://shop/p/"), "l_partkey").alias("url"), F.when(F.col("sup") % 4 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")).alias("price"), (F.col("flag") == "R").alias("in_stock"))
    return pages, api


SHOP_SQL = """
with l as (select l_partkey, min(l_suppkey) as sup, max(l_returnflag) as flag from lineitem group by 1),
p as (select l_partkey, p_size, 'https://shop/p/' || l_partkey as url, sup % 4 = 0 as other_price, flag = 'R' as page_stock, p_size % 2 = 0 as api_stock from l join part on l_partkey = p_partkey)
"""


def api_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, api = _shop(spark, sf_dir)
    return M.mismatches(M.by_path(pages, api)).select("url", "check_id")


def api_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, api = _shop(spark, sf_dir)
    return M.unmatched(pages, M.by_path(pages, api)).select("url")


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as feed products, dealt to the categories; every second has an age grade and a certificate, every third a weight."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    category = F.get(F.array(*map(F.lit, FEED_CATEGORIES)), (k % len(FEED_CATEGORIES)).cast("int"))
    more = F.when(k % 2 == 0, F.create_map(F.lit("age_grade"), F.lit("3+"), F.lit("certification"), F.lit("UL 2272"))).otherwise(F.create_map(F.lit("note"), F.when(k % 9 == 0, "energy star, with warranty").otherwise("choking hazard")))
    return p.select(
        k.cast("string").alias("id"), F.when(k % 13 != 0, F.col("p_name")).alias("title"), F.col("p_type").alias("description"), F.when(k % 17 != 0, F.col("p_retailprice")).alias("price"), (F.col("p_retailprice") + F.when(k % 5 == 0, 1.0).otherwise(0.0)).alias("landing_page_price"),
        F.when(k % 3 != 0, F.concat(F.lit("0"), k)).alias("gtin"), category.alias("category"), F.lit("in_stock").alias("availability"), F.when(k % 19 != 0, F.when(k % 4 == 1, "used").otherwise("new")).alias("condition"), F.when(k % 3 == 0, 2.5).alias("shipping_weight_kg"), more.alias("attributes"),
    )


FEED_CATEGORIES = ["household_tool", "playhouse", "electric_scooter", "electric_motor", "coffee_machine", "refrigerator"]
def feed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.feed_violations(_feed(spark, sf_dir))


FEED_SQL = """
p as (
  select p_partkey as k, p_name, p_type, p_partkey % 6 as c, lower(concat_ws(' ', case when p_partkey % 13 <> 0 then p_name end, p_type, case when p_partkey % 2 = 0 then '3+ UL 2272' when p_partkey % 9 = 0 then 'energy star, with warranty' else 'choking hazard' end)) as blob from part),
v as (
  select k, unnest([case when k % 3 = 0 then 'gtin_present' end, case when k % 17 <> 0 and k % 5 = 0 then 'price_match' end, case when k % 17 = 0 then 'price_positive' end,
    case when k % 13 = 0 or trim(p_name) = '' then 'required_title' end, case when trim(p_type) = '' then 'required_description' end, case when k % 19 = 0 then 'required_condition' end,
    case when c = 1 and k % 2 = 1 and not regexp_matches(blob, 'age|years|months|yrs') then 'playhouse_age_grading' end,
    case when c = 1 and not regexp_matches(blob, 'warning|choking hazard|supervision|adult assembly|not suitable for') then 'playhouse_safety_warning' end,
    case when c in (2, 3) and k % 2 = 1 and not regexp_matches(blob, 'ul |ul2272|ul 2272|csa|certified|certification|iec 62133') then 'battery_safety_certification' end,
    case when c in (2, 3) and k % 3 <> 0 then 'shipping_weight_present' end,
    case when c in (4, 5) and k % 19 <> 0 and k % 4 = 1 and not regexp_matches(blob, 'warranty|guarantee') then 'warranty_disclosure' end,
    case when c in (4, 5) and contains(blob, 'energy star') then 'energy_claim_substantiation' end]) as rule from p),
w as (select k, rule, case when rule in ('gtin_present', 'shipping_weight_present', 'warranty_disclosure', 'energy_claim_substantiation') then 'warning' else 'critical' end as severity from v where rule is not null)
"""


def clean_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gate(M.feed_violations(_feed(spark, sf_dir)))


def vector_topk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sections (labels) for every vector whose id is divisible by 20, against all vectors as the chunks of their labels."""
    e = read(spark, sf_dir, "embeddings").filter("embedding is not null")
    chunks = e.select(F.lit("p").alias("policy_id"), F.lit("u").alias("source_url"), F.concat(F.lit("s"), "label").alias("section"), F.col("vec_id").alias("chunk_index"), F.col("embedding").alias("vector"))
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.lit("p").alias("policy_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return V.best_passages(queries, chunks, 3).select("query_id", "rank", "section", F.round("score", 6).alias("score"))


TOPK_SQL = """
with e as (select vec_id, label, embedding::double[] as v from embeddings where embedding is not null),
s as (select e.vec_id as query_id, 's' || c.label as section, max(list_cosine_similarity(e.v, c.v)) as score from e cross join e c where e.vec_id % 20 = 0 group by 1, 2)
select query_id, rank::int as rank, section, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, section) as rank from s) where rank <= 3
"""


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return V.packed(d).select("id", "chunk_index", F.char_length("chunk_text").cast("long").alias("n_chars"), F.md5(F.col("chunk_text").cast("binary")).alias("digest"))


CHUNK_SQL = r"""
with t as (select doc_id as id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) as t from documents),
p as (
  select id, string_split(list_reduce(string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(2), 'g'), chr(2)),
    lambda acc, x: case when length(list_last(string_split(acc, chr(1)))) + length(x) + 1 <= 1200 then acc || ' ' || x else acc || chr(1) || x end), chr(1)) as chunks
  from t where length(t) >= 40)
select id, i::int - 1 as chunk_index, length(chunks[i]) as n_chars, md5(chunks[i]) as digest from p, unnest(range(1, len(chunks) + 1)) r(i)
"""


def verdict_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents of four policies ask at hours of a day for verdicts of a cache of the labelled ones, aged by days and hours; suppliers are the changes of their policies."""
    noon = F.lit("2024-06-30 12:00:00").cast("timestamp")
    key = lambda c: V.cache_key(F.lit("p"), F.lit("m"), c)
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("p"), F.col("doc_id") % 4).alias("policy_id"), key(F.coalesce("text", F.lit(""))).alias("cache_key"), (noon + F.make_dt_interval(F.lit(0), F.col("doc_id") % 7)).alias("at"))
    age = F.make_dt_interval(F.col("doc_id") % 60, F.col("doc_id") % 24)
    cache = read(spark, sf_dir, "labels").join(d, "doc_id").select("cache_key", F.col("quality").cast("string").alias("result_json"), (noon - age).alias("created_at"))
    changes = read(spark, sf_dir, "supplier").filter("s_suppkey % 4 <> 3").select(F.concat(F.lit("p"), F.col("s_suppkey") % 4).alias("policy_id"), (noon - F.make_dt_interval(5 + F.col("s_suppkey") % 50, 6 * (F.col("s_suppkey") % 4))).alias("changed_at"))
    # of equally new entries of one key any may be found, so only the hit is reported
    return V.reuse(d, cache, F.col("at"), changes).select("doc_id", "hit")


REUSE_SQL = """
with d as (select doc_id, 'p' || doc_id % 4 as policy_id, sha256('p|m|' || coalesce(text, '')) as k, timestamp '2024-06-30 12:00:00' + to_hours(doc_id % 7) as asked from documents),
c as (select k, timestamp '2024-06-30 12:00:00' - to_days((doc_id % 60)::int) - to_hours(doc_id % 24) as created from labels join d using (doc_id)),
h as (select 'p' || s_suppkey % 4 as policy_id, timestamp '2024-06-30 12:00:00' - to_days((5 + s_suppkey % 50)::int) - to_hours(6 * (s_suppkey % 4)) as changed from supplier where s_suppkey % 4 <> 3),
a as (select doc_id, policy_id, asked, (select max(created) from c where c.k = d.k and created <= asked) as created, (select max(changed) from h where h.policy_id = d.policy_id and changed <= asked) as changed from d)
select doc_id, coalesce(created >= asked - interval 30 days and (changed is null or created > changed), false) as hit from a
"""


def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels.quality against a rule: texts with a run of three signs or a bar are bad."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("lang_"), "lang").alias("category"), F.when(F.rlike("text", F.lit(r"[%#$*&!]{2,}| \| ")), "fail").otherwise("pass").alias("verdict"))
    labels = read(spark, sf_dir, "labels").join(d.select("doc_id", "category"), "doc_id").select("doc_id", "category", F.when(F.col("quality") == 0, "fail").otherwise("pass").alias("verdict"))
    return V.accuracy(d, labels, ["doc_id", "category"]).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


PRECISION_SQL = r"""
with j as (select 'lang_' || lang as category, regexp_matches(text, '[%#$*&!]{2,}| \| ') as bad, quality from labels join documents using (doc_id))
select category, count(*) filter (where bad and quality = 0) as tp, count(*) filter (where bad and quality <> 0) as fp, count(*) filter (where not bad and quality <> 0) as tn, count(*) filter (where not bad and quality = 0) as fn,
  0::bigint as excluded, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall from j group by 1
"""


def quote_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), "text")
    return V.quotes_found(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text"), q)


QUOTE_SQL = r"""
with q as (select item_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''), ' ') as q from benchmark),
d as (select doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> ''), ' ') || ' ' as t from documents)
select item_id as quote_id, count(doc_id) as n_texts from q left join d on q.q <> '' and contains(t, ' ' || q.q || ' ') group by 1
"""

#: Pages that one task parses, about. A few bytes of part make a page, so by bytes a task would get a million.
TASK_PAGES = 10_000


def _part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as product pages with structured data of six forms and a price and stock state of either platform's themes; every sixth is no product page."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    p = p.repartition(1 + p.count() // TASK_PAGES, "p_partkey")
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    offer = lambda more, kind="Offer": F.concat(F.lit(f'{{"@type": "{kind}", "priceCurrency": "usd", '), *more, F.lit("}"))
    told = lambda text: [F.lit('"price": "'), text, F.lit('"')]
    variants = [F.concat(F.lit(f'{{"@type": "Product", "sku": "all", "mpn": "m-{v}-'), k, F.lit('", "offers": '), offer(told(price)), F.lit("}")) for v in "ab"]
    forms = [
        F.concat(F.lit('{"@type": "Product", "brand": {"name": " '), "p_brand", F.lit('"}, "sku": "s-'), k, F.lit('", "gtin13": "'), F.lpad(k.cast("string"), 13, "0"), F.lit('", "itemCondition": "https://schema.org/RefurbishedCondition", "offers": '), offer([*told(price), F.lit(', "availability": "https://schema.org/InStock"')]), F.lit("}")),
        F.concat(F.lit('{"@graph": [{"@type": "WebPage", "name": "Products", "offers": {"price": 9}}, {"@type": ["Thing", "product"], "brand": "'), "p_brand", F.lit('", "offers": [[{"sku": "x-'), k, F.lit('", "price": '), "p_size", F.lit('}], {"sku": "", "price": "1 or 2"}]}]}')),
        F.concat(F.lit('{"@type": "ProductGroup", "sku": "group", "offers": {"price": 1}, "hasVariant": ['), variants[0], F.lit(", "), variants[1], F.lit("]}")),
        F.concat(F.lit('[{"@type": "Product", "mpn": "m'), k, F.lit('", "offers": '), offer([F.lit('"lowPrice": "'), price, F.lit('", "offers": ['), offer([*told(F.lit("1,299.00")), F.lit(', "sku": "in"')]), F.lit("]")], "AggregateOffer"), F.lit("}]")),
        F.concat(F.lit('{"@type": "Product", "sku": "alone-'), k, F.lit('", "itemCondition": ""}')), F.concat(F.lit('{"@type": "Product", "offers": {"price": "'), price, F.lit('"}}')),
    ]
    wrong = F.when(k % 4 == 0, F.lit("7.77")).otherwise(price)
    theme = F.concat(F.lit('<div class="x price">$<b>'), wrong, F.lit("</b></div><button>"), F.when(k % 7 == 0, "Sold out").otherwise("Add to cart"), F.lit("</button><p>in stock</p>"))
    order = F.concat(F.lit('<p class="price"><del><span class="amount">9,999.00</span></del> <ins>$'), wrong, F.lit('</ins></p><p class="big stock">'), F.when(k % 7 == 0, "Sold out").otherwise("Only 3 in stock"), F.lit("</p>"))
    node = F.get(F.array(*forms), (k % 6).cast("int"))
    html = F.concat(F.lit('<html><head><script type="application/ld+json">'), node, F.lit("</script></head><body>"), F.when(k % 2 == 0, theme).otherwise(order), F.lit("</body></html>"))
    return keyed(p, k.alias("seq"), F.concat(F.lit("https://shop/p/"), k).alias("url"), F.when(k % 6 == 5, "blog_other").otherwise("product").alias("page_type"), html.alias("html"))


def product_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of structured product data, from html to rows."""
    found = E.product_facts(M.structured_products(P.page_features(_part_pages(spark, sf_dir))), "jsonld")
    return found.select("resource_url", "fact", "value", "variant_key")


PRODUCT_FACTS_SQL = """
with p as (select *, 'https://shop/p/' || p_partkey as url, p_partkey % 6 as form, p_retailprice::decimal(12, 2)::varchar as price from part),
o as (
  select url, unnest([{'v': '0' || lpad(p_partkey::varchar, 13, '0'), 'price': price, 'stock': 'in_stock', 'sku': 'S' || p_partkey, 'gtin': '0' || lpad(p_partkey::varchar, 13, '0'), 'mpn': null, 'usd': true}]) as o from p where form = 0
  union all select url, unnest([{'v': 'X' || p_partkey, 'price': p_size::varchar, 'stock': null, 'sku': 'X' || p_partkey, 'gtin': null, 'mpn': null, 'usd': false}]) from p where form = 1
  union all select url, unnest([{'v': 'MA' || p_partkey, 'price': price, 'stock': null, 'sku': 'ALL', 'gtin': null, 'mpn': 'MA' || p_partkey, 'usd': true}, {'v': 'MB' || p_partkey, 'price': price, 'stock': null, 'sku': 'ALL', 'gtin': null, 'mpn': 'MB' || p_partkey, 'usd': true}]) from p where form = 2
  union all select url, unnest([{'v': 'M' || p_partkey, 'price': price, 'stock': null, 'sku': null, 'gtin': null, 'mpn': 'M' || p_partkey, 'usd': true}, {'v': 'M' || p_partkey, 'price': '1299.00', 'stock': null, 'sku': 'IN', 'gtin': null, 'mpn': 'M' || p_partkey, 'usd': true}]) from p where form = 3),
f as (
  select url, o.v as variant_key, unnest([{'fact': 'product.price_amount', 'value': o.price}, {'fact': 'product.price_currency', 'value': case when o.usd then 'USD' end}, {'fact': 'product.availability', 'value': o.stock}, {'fact': 'product.sku', 'value': o.sku}, {'fact': 'product.gtin', 'value': o.gtin}, {'fact': 'product.mpn', 'value': o.mpn}]) as f from o
  union all select url, null, unnest([{'fact': 'product.brand', 'value': case when form < 2 then p_brand end}, {'fact': 'product.condition', 'value': case when form = 0 then 'refurbished' end}, {'fact': 'product.sku', 'value': case when form = 4 then 'ALONE' || p_partkey end}]) from p where form < 5)
select url as resource_url, f.fact as fact, f.value as value, variant_key from f where f.value is not null
"""


def rendered_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From html to findings: what pages show against platform products, of even parts by handle and variants, of odd ones by path and stock status; every ninth product has no variants."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    # parsed once, for both platforms, and without the features that nothing here reads
    pages = landed(P.page_features(_part_pages(spark, sf_dir)).select("store_id", "run_id", "seq", "url", "page_type", "rendered"), "shown-pages")
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    variant = lambda text, there: F.struct(text.alias("price"), there.alias("available"))
    variants = F.when(k % 9 != 0, F.array(variant(F.lit("3.33"), F.lit(False)), variant(price, F.lit(True)))).otherwise(F.array().cast("array<struct<price:string,available:boolean>>"))
    shop = keyed(p.filter("p_partkey % 2 = 0"), k.cast("string").alias("handle"), variants.alias("variants"))
    store = keyed(p.filter("p_partkey % 2 = 1"), F.concat(F.lit("https://shop/p/"), k, F.lit("/")).alias("permalink"), price.cast("double").alias("price"), F.lit("instock").alias("in_stock"))
    found = M.mismatches(M.by_handle(M.shown(pages, theme=True), shop)).unionByName(M.mismatches(M.by_path(M.shown(pages, theme=False), store)))
    return found.select("url", "check_id")


RENDERED_SQL = """
with p as (select *, 'https://shop/p/' || p_partkey as url, p_partkey as k from part where p_partkey % 6 <> 5)
select url, 'shopify_price_mismatch' as check_id from p where k % 4 = 0 and k % 9 <> 0
union all select url, 'shopify_availability_mismatch' from p where k % 2 = 0 and k % 7 = 0 and k % 9 <> 0
union all select url, 'woocommerce_stock_mismatch' from p where k % 2 = 1 and k % 7 = 0
"""

_F = (product_facts, rendered_mismatches, category_cap, fair_interleave, crawl_plan, page_budget, risk_sample, sample_coverage, api_match, api_unmatched, feed_rules, clean_gate, vector_topk_sections, sentence_chunks, verdict_reuse, precision_recall, quote_verified)
QUERIES = {f.__name__: f for f in _F}
SQL = {
    "product_facts": PRODUCT_FACTS_SQL, "rendered_mismatches": RENDERED_SQL, "category_cap": CATEGORY_SQL, "fair_interleave": INTERLEAVE_SQL, "crawl_plan": PLAN_SQL, "page_budget": "with" + BUDGET_SQL + "select store_id, budget from b", "sample_coverage": COVERAGE_SQL, "sentence_chunks": CHUNK_SQL, "risk_sample": SAMPLE_SQL,
    "api_match": SHOP_SQL + "select url, 'woocommerce_price_mismatch' as check_id from p where p_size > 10 and other_price union all select url, 'woocommerce_stock_mismatch' from p where p_size > 10 and page_stock <> api_stock",
    "api_unmatched": SHOP_SQL + "select url from p where p_size <= 10",
    "feed_rules": "with" + FEED_SQL + "select k::varchar as id, rule, severity from w",
    "clean_gate": "with" + FEED_SQL + "select count(*) filter (where severity = 'critical') as n_critical, count(*) filter (where severity = 'warning') as n_warning, count(*) filter (where severity = 'critical') = 0 as clean from w",
    "vector_topk_sections": TOPK_SQL, "verdict_reuse": REUSE_SQL, "precision_recall": PRECISION_SQL, "quote_verified": QUOTE_SQL,
}
