"""Queries over what merchants and models state: orders and parts as policy pages, journeys, model answers and image lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.operators import checks as C
from storegrain.operators import crawl as W
from storegrain.operators import extract as E
from storegrain.operators import findings as N
from storegrain.plans import read

KEY = "k"


def orders(spark: SparkSession, sf_dir: str, *cols) -> DataFrame:
    """orders by number k, as pages of one run."""
    o = read(spark, sf_dir, "orders").withColumn(KEY, F.col("o_orderkey"))
    return o.select(F.lit("s").alias("store_id"), F.lit("r1").alias("run_id"), KEY, F.concat(F.lit("u"), KEY).alias("url"), *cols)


def merchant_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of shipping, return, home and blog pages whose numbers come from orders; every ninth page didn't load."""
    k = F.col(KEY)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    texts = [
        say("Order processing takes ", 1 + k % 3, " to ", 3 + k % 3, " business days. Estimated delivery ", 5 + k % 6, " days. Shipping is $", 3 + k % 7, ".00 per order. We ship to Canada and France."),
        say("Returns are accepted within ", 14 + k % 30, " days. Customer pays return shipping. We offer a full refund."),
        say("Operated by Acme", k % 11, " Trading Ltd. Find us at ", 12 + k % 80, " High Street; mail Sales", k, "@shop.example; call +44 20 7946 ", F.lpad((k % 10_000).cast("string"), 4, "0"), "; we take Visa, Mastercard and PayPal; worldwide shipping."),
        say("Returns within ", k % 9, " days, mail x@y.example."),
    ]
    kinds = F.array(*map(F.lit, ["shipping_policy", "returns_policy", "homepage", "blog_other"]))
    p = orders(spark, sf_dir, k.alias("seq"), F.get(kinds, (k % 4).cast("int")).alias("page_type"), F.array(F.lit("Contact us"), say("Shop ", k)).alias("headings"), F.get(F.array(*texts), (k % 4).cast("int")).alias("text"), (k % 9 != 0).alias("reachable"))
    return E.extract_facts(p).select("resource_url", "fact", "value", "method", "confidence")


MERCHANT_SQL = """
with o as (select o_orderkey as k, 'u' || o_orderkey as url from orders where o_orderkey % 9 <> 0),
f as (
  select url, unnest([
    {'fact': 'shipping.region', 'value': 'CA,FR', 'method': 'shipping_region_regex', 'c': 0.8}, {'fact': 'shipping.cost_amount', 'value': (3 + k % 7) || '.00', 'method': 'shipping_cost_regex', 'c': 0.8}, {'fact': 'shipping.cost_currency', 'value': 'USD', 'method': 'shipping_cost_regex', 'c': 0.8},
    {'fact': 'shipping.processing_days', 'value': (3 + k % 3)::varchar, 'method': 'shipping_time_regex', 'c': 0.8}, {'fact': 'shipping.delivery_days', 'value': (5 + k % 6)::varchar, 'method': 'shipping_time_regex', 'c': 0.8},
    {'fact': 'business.address_country', 'value': 'CA', 'method': 'address_text_country_regex', 'c': 0.6}, {'fact': 'business.address_country', 'value': 'FR', 'method': 'address_text_country_regex', 'c': 0.6}]) as f from o where k % 4 = 0
  union all select url, unnest([
    {'fact': 'return.window_days', 'value': (14 + k % 30)::varchar, 'method': 'return_window_regex', 'c': 0.8}, {'fact': 'return.refund_terms', 'value': 'full_refund', 'method': 'refund_terms_keyword_classifier', 'c': 0.7},
    {'fact': 'return.cost_responsibility', 'value': 'customer_pays', 'method': 'return_cost_keyword_classifier', 'c': 0.7}]) from o where k % 4 = 1
  union all select url, unnest([
    {'fact': 'business.legal_entity', 'value': 'Acme' || k % 11 || ' Trading Ltd.', 'method': 'legal_suffix_regex', 'c': 0.75}, {'fact': 'business.name', 'value': 'Acme' || k % 11 || ' Trading', 'method': 'legal_suffix_regex', 'c': 0.75},
    {'fact': 'business.name', 'value': 'Shop ' || k, 'method': 'heading_heuristic', 'c': 0.75}, {'fact': 'business.address', 'value': (12 + k % 80) || ' High Street', 'method': 'business_identity_regex', 'c': 0.9},
    {'fact': 'business.email', 'value': 'sales' || k || '@shop.example', 'method': 'business_identity_regex', 'c': 0.9}, {'fact': 'business.phone', 'value': '+44207946' || lpad((k % 10000)::varchar, 4, '0'), 'method': 'business_identity_regex', 'c': 0.9},
    {'fact': 'business.address_country', 'value': 'GB', 'method': 'calling_code_cross_reference', 'c': 0.6}, {'fact': 'payment.methods', 'value': 'MASTERCARD,PAYPAL,VISA', 'method': 'payment_methods_keyword_regex', 'c': 0.7},
    {'fact': 'shipping.region', 'value': 'WORLDWIDE', 'method': 'shipping_region_regex', 'c': 0.8}]) from o where k % 4 = 2)
select url as resource_url, f.fact as fact, f.value as value, f.method as method, f.c::double as confidence from f
"""


def journey_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as recorded purchases: the cart shows another price, none, or was not reached; the checkout names shipping first or last."""
    k, price = F.col(KEY), F.col("o_totalprice").cast("decimal(12,2)")
    shown = lambda p: F.concat(F.lit("$"), F.format_number(p, 2))
    cart = F.when(k % 5 == 0, shown(price + 1)).when(k % 5 == 1, "nothing").when(k % 5 < 4, shown(price))
    checkout = F.when(k % 3 == 0, F.concat(F.lit("Shipping $2.50, total "), shown(price + 2))).when(k % 3 == 1, F.concat(F.lit("Total "), shown(price)))
    return C.journeys(orders(spark, sf_dir, F.col("o_totalprice")).select(F.col("url").alias("product_url"), price.cast("double").alias("product_price"), cart.alias("cart_text"), checkout.alias("checkout_text")))


JOURNEY_SQL = """
with o as (select o_orderkey as k, 'u' || o_orderkey as product_url, o_totalprice::decimal(12, 2) as price from orders)
select product_url, 'purchase_journey_cart_price_mismatch' as check_id from o where k % 5 = 0
union all select product_url, 'purchase_journey_cart_price_not_found' from o where k % 5 = 1
union all select product_url, 'purchase_journey_shipping_not_shown' from o where k % 3 = 1
union all select product_url, 'purchase_journey_total_lower_than_product_price' from o where k % 3 = 0 and 2.5 < price::double - 0.01
"""


def reconciled_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return windows that a pattern and a model read on the orders' pages: model nulls, quotes that aren't there or blank, agreement and other values."""
    k, n = F.col(KEY), (14 + F.col(KEY) % 30)
    fact = F.lit("return.window_days").alias("fact")
    pages = orders(spark, sf_dir, F.concat(F.lit("Returns within "), n, F.lit(" days &amp; more")).alias("text"))
    regex = orders(spark, sf_dir, fact, n.cast("string").alias("value"), F.lit(0.8).alias("confidence")).filter("k % 11 <> 0")
    value = F.when(k % 7 == 0, None).when(k % 7 < 4, F.concat(n.cast("string"), F.lit(".0"))).otherwise((n + 1).cast("string"))
    quote = F.when(k % 4 == 0, "no such words").when(k % 4 == 1, F.concat(F.lit("WITHIN  "), n, F.lit(" days & MORE"))).when(k % 4 == 2, " ")
    model = orders(spark, sf_dir, fact, value.alias("value"), quote.alias("quote"), ((k % 14) / 10.0 - 0.1).alias("confidence")).filter("k % 13 <> 0")
    return N.reconciled(regex, model, pages).select("url", "value", "method", F.round("confidence", 6).alias("confidence"))


RECONCILED_SQL = """
with o as (select o_orderkey as k, 'u' || o_orderkey as url, 14 + o_orderkey % 30 as n, o_orderkey % 11 <> 0 as r, o_orderkey % 13 <> 0 as m from orders)
select url, case when not m then n::varchar when k % 7 < 4 then n || '.0' else (n + 1)::varchar end as value, case when not m then 'regex' when r and k % 7 < 4 then 'regex_llm_agree' else 'llm' end as method,
  round(case when not m then 0.8 when r and k % 7 < 4 then 0.95 else greatest(0.0, least(1.0, (k % 14) / 10.0 - 0.1)) end, 6)::double as confidence
from o where (m and k % 7 <> 0 and k % 4 <> 0) or (r and not m)
"""


def verdict_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model verdicts about the orders' pages: quotes on the page, not on it, blank or null, and contradictions with their policy's quote."""
    k = F.col(KEY)
    pages = orders(spark, sf_dir, F.concat(F.lit("Our window is "), k % 50, F.lit(" days.")).alias("text"))
    quote = F.when(k % 4 == 0, F.concat(F.lit("window  IS "), k % 50, F.lit(" days"))).when(k % 4 == 1, "other words").when(k % 4 == 2, "")
    confidence = F.when(k % 3 == 0, "confirmed").when(k % 3 == 1, "potential_risk").otherwise("cannot_verify")
    check = F.when(k % 5 == 0, "llm_claim_policy_contradiction").otherwise("llm_other")
    policy = F.when(k % 2 == 0, F.concat(F.lit("within "), k % 25, F.lit(" days")))
    v = orders(spark, sf_dir, check.alias("check_id"), (k % 8 != 0).alias("flagged"), confidence.alias("confidence"), quote.alias("evidence_quote"), policy.alias("policy_quote"), F.when(k % 6 == 0, "none").otherwise("days").alias("conflict_dimension"))
    return N.verdict_findings(v, pages).select("url", "check_id", "confidence", "evidence_verified")


VERDICT_SQL = """
with o as (select o_orderkey as k, 'u' || o_orderkey as url from orders where o_orderkey % 8 <> 0)
select url, case when k % 5 = 0 then 'llm_claim_policy_contradiction' else 'llm_other' end as check_id, case when k % 3 = 0 and k % 4 <> 1 then 'confirmed' when k % 3 < 2 then 'potential_risk' else 'cannot_verify' end as confidence, k % 4 <> 1 as evidence_verified
from o where k % 5 <> 0 or (k % 6 <> 0 and k % 2 = 0 and not (k % 4 = 0 and k % 50 = k % 25))
"""


def image_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts as pages of their brand's run, two images each: which of them a model has to see. A third are no product pages, every seventh didn't load."""
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("store_id"), F.lit("r1").alias("run_id"), k.alias("seq"), k.cast("string").alias("url"), F.when(F.col("p_size") % 3 == 0, "collection").otherwise("product").alias("page_type"), (k % 7 != 0).alias("reachable"), "p_name")
    images = p.select("store_id", "run_id", "seq", "url", "page_type", "reachable", "p_name", F.explode(F.array(F.lit(1), F.lit(0))).alias("pos")).withColumn("image_url", F.concat_ws("/", "p_name", "pos")).drop("p_name")
    return W.image_work(images)[0].drop("run_id")


IMAGE_SQL = """
select store_id, url, image_url from (
  select p_brand as store_id, p_partkey::varchar as url, p_name || '/0' as image_url, row_number() over (partition by p_brand order by p_partkey) as r from part where p_size % 3 <> 0 and p_partkey % 7 <> 0)
where r <= 5
"""

QUERIES = {f.__name__: f for f in (merchant_facts, journey_findings, reconciled_facts, verdict_quotes, image_work)}
SQL = {"merchant_facts": MERCHANT_SQL, "journey_findings": JOURNEY_SQL, "reconciled_facts": RECONCILED_SQL, "verdict_quotes": VERDICT_SQL, "image_work": IMAGE_SQL}
