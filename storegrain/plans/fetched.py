"""Queries over what fetches, probes, watched stores and stored tables tell: pages, customers, parts, orders and events in these roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.functions import urls as U
from storegrain.operators import catalog_match as M
from storegrain.operators import checks as C
from storegrain.operators import findings as N
from storegrain.operators import history as H
from storegrain.operators import rules as R
from storegrain.plans import read
from storegrain.plans.streams import event_stream
from storegrain.sources import tables as T
from storegrain.streaming import jobs as S


def picked(k: Column, n: int, values: dict[int, Column | str], otherwise: Column | str | None = None) -> Column:
    """values by k modulo n."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.coalesce(*[F.when(k % n == i, lit(v)) for i, v in values.items()], lit(otherwise))


def _fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as fetches of twelve kinds; a store is a host."""
    k = F.col("page_id")
    p = read(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("page"))
    more = lambda text: F.concat("page", F.lit(text))
    html = F.when((k % 12).isin(5, 7, 8), "").otherwise(picked(k, 12, {1: more("g-recaptcha Verify you are human"), 3: more("Checking your browser"), 9: "<body>Access denied</body>", 10: "<p>x</p>"}, F.col("page")))
    status = F.when(~(k % 12).isin(5, 8), picked(k, 12, {0: F.lit(404), 2: F.lit(403), 4: F.lit(429), 6: F.lit(500)}, F.lit(200)))
    f = p.select(U.netloc(F.col("url")).alias("store_id"), F.lit("r1").alias("run_id"), "page_id", "url", status.alias("status"), html.alias("html"), picked(k, 12, {5: "network_error", 8: "blocked_ssrf"}, F.lit(None).cast("string")).alias("error"))
    return C.fetch_outcomes(f)


def fetch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fetches(spark, sf_dir).select("page_id", "failure_category", "reachable", "cannot_verify")


FETCH_SQL = """
f as (
  select page_id, url, lower(regexp_extract(url, '://([^/?#]*)', 1)) as host,
    case page_id % 12 when 0 then 'not_found' when 1 then 'captcha_blocked' when 2 then 'bot_blocked' when 3 then 'bot_blocked' when 4 then 'rate_limited' when 5 then 'network_error' when 6 then 'http_error' when 7 then 'unknown' when 8 then 'blocked_ssrf'
      when 9 then 'bot_blocked' when 10 then 'unknown' else case when contains(lower(coalesce(html, '')), '<body') then null else 'unknown' end end as failure_category from pages),
o as (select *, failure_category is null as reachable, failure_category is not null and failure_category not in ('not_found', 'blocked_ssrf') as cannot_verify from f)
"""


def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.broken_pages(_fetches(spark, sf_dir)).select("url", "check_id", "confidence")


BROKEN_SQL = "with" + FETCH_SQL + """
select url, 'broken_internal_link' as check_id, case when cannot_verify then 'cannot_verify' else 'confirmed' end as confidence
from o join (select host, bool_or(reachable) as loaded from o group by 1) using (host) where not reachable and (not cannot_verify or loaded)
"""


def platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as stores: one probe each of nine kinds, and a home page, of every second with a mark."""
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select(k.cast("string").alias("store_id"), F.lit("r1").alias("run_id"), "c_custkey")
    path = picked(k, 9, {0: "/wp-json/", 1: "/wp-json/", 2: "/wp-json/wc/v3/products", 3: "/wp-json/wp/v2/", 4: "/products.json"}, "/")
    spaces = F.when(k % 9 == 0, F.array(F.lit("wp/v2"), F.lit("wc/v3"))).when(k % 9 == 1, F.array(F.lit("wp/v2")))
    marks = picked(k, 9, {5: "by WooCommerce", 6: "<link href=/wp-content/a>", 7: "//cdn.shopify.com/x"}, "plain")
    one = c.select("store_id", "run_id", path.alias("path"), F.when(k % 9 == 2, 401).otherwise(200).alias("status"), spaces.alias("namespaces"), (k % 9 == 4).alias("has_products"), marks.alias("html"))
    home = c.select("store_id", "run_id", F.lit("/").alias("path"), F.lit(200).alias("status"), F.lit(None).cast("array<string>").alias("namespaces"), F.lit(False).alias("has_products"), F.when(k % 2 == 0, "x.myshopify.com").otherwise("plain").alias("html"))
    return C.platform(one.unionByName(home)).select("store_id", "platform")


PLATFORM_SQL = """
select c_custkey::varchar as store_id, case when c_custkey % 9 in (0, 2, 5) then 'woocommerce' when c_custkey % 9 in (1, 3, 6) then 'wordpress' when c_custkey % 9 in (4, 7) or c_custkey % 2 = 0 then 'shopify' else 'unknown' end as platform from customer
"""


def image_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts as pages with one image, probed for three quarters of them."""
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part")
    src = F.concat(F.when(k % 10 == 0, "/img/no-image").otherwise("/img/"), k, F.lit(".jpg"))
    pages = p.select(F.lit("s").alias("store_id"), F.lit("r1").alias("run_id"), k.cast("string").alias("url"), F.array(F.struct(src.alias("src"), picked(k, 3, {0: F.col("p_name"), 1: " "}, F.lit(None).cast("string")).alias("alt"))).alias("images"))
    status = F.when(k % 5 == 0, 404).when(k % 5 != 1, 200)
    seen = lambda c: F.when((k % 5 > 1) & (k % 7 != 0), c)
    probes = p.filter("p_partkey % 4 <> 3").select(src.alias("url"), status.cast("int").alias("status"), seen(k % 600).cast("int").alias("width"), seen(F.col("p_size") * 10).cast("int").alias("height"), F.when(k % 5 == 1, "dns").alias("error"))
    return C.image_checks(pages, probes).select("url", "check_id", "confidence")


IMAGE_CHECK_SQL = """
select p_partkey::varchar as url, unnest(list_filter([
  case when p_partkey % 10 = 0 then {'check_id': 'product_image_placeholder_filename', 'confidence': 'potential_risk'} end,
  case when p_partkey % 3 <> 0 or trim(p_name) = '' then {'check_id': 'product_image_missing_alt_text', 'confidence': 'confirmed'} end,
  case when p_partkey % 4 = 3 then null when p_partkey % 5 = 0 then {'check_id': 'product_image_broken', 'confidence': 'confirmed'} when p_partkey % 5 = 1 then {'check_id': 'product_image_broken', 'confidence': 'cannot_verify'}
    when p_partkey % 7 = 0 then {'check_id': 'product_image_broken', 'confidence': 'potential_risk'} when p_partkey % 600 < 250 or p_size * 10 < 250 then {'check_id': 'product_image_low_resolution', 'confidence': 'confirmed'} end], lambda x: x is not null), recursive := true) from part
"""


def claim_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as pages of their customer's crawl, with claims on some; every eleventh looks like a catch-all page."""
    k = F.col("o_orderkey")
    kind = picked(k, 5, {0: "homepage", 1: "product", 2: "product", 3: "shipping_policy"}, "returns_policy")
    p = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("store_id"), F.lit("r1").alias("run_id"), k.alias("seq"), k.cast("string").alias("url"), kind.alias("page_type"), picked(k, 3, {0: "Free shipping and 30-day returns", 1: "ships worldwide"}, "plain").alias("text"), (k % 13 != 0).alias("reachable"))
    return C.claim_tasks(p, p.filter("seq % 11 = 0")).select("store_id", "url", "kind", "policy_url")


CLAIM_SQL = """
with p as (select o_custkey::varchar as store_id, o_orderkey as k, o_orderkey % 5 as t from orders where o_orderkey % 13 <> 0),
s as (select *, row_number() over (partition by store_id, t > 0 order by k) as r from p where t in (0, 1, 2)),
c as (select store_id, k, unnest(case k % 3 when 0 then ['shipping', 'returns'] when 1 then ['shipping'] else [] end) as kind from s where r <= case when t = 0 then 1 else 5 end),
o as (select store_id, case t when 3 then 'shipping' else 'returns' end as kind, min(k) as policy from p where t > 2 and k % 11 <> 0 group by 1, 2)
select store_id, k::varchar as url, kind, policy::varchar as policy_url from c join o using (store_id, kind)
"""


def returns_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as pages of their customer's shop under co.uk, with links to the same shop's help host, to a portal, and to others."""
    k, shop = F.col("o_orderkey"), F.concat(F.lit("shop"), F.col("o_custkey"), F.lit(".co.uk"))
    link = lambda *parts: F.concat(F.lit("https://"), *[F.lit(x) if isinstance(x, str) else x for x in parts])
    links = F.array(
        F.lit("/local"), picked(k, 4, {0: link("x.co.uk/returns"), 1: link("help.", shop, "/about")}, link("www.", shop, "/returns")),
        picked(k, 7, {0: link("a.loopreturns.com/", k), 1: link("help.", shop, ":8080/Refunds"), 2: link("loopreturns.com.evil.example/returns")}, F.lit("mailto:x@y")),
    )
    p = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("store_id"), F.lit("r1").alias("run_id"), k.alias("seq"), link(F.when(k % 2 == 0, "www.").otherwise(""), shop, "/p").alias("url"), links.alias("links"), (k % 5 != 0).alias("reachable"))
    suffixes = spark.createDataFrame([("com",), ("uk",), ("co.uk",), ("example",)], "rule string")
    return C.off_domain_credit(p, C.RETURN_WORDS, C.RETURN_PORTALS, suffixes).select("store_id", "link", "matched_via")


CREDIT_SQL = """
with p as (
  select o_custkey::varchar as store_id, o_orderkey as k, case o_orderkey % 7 when 0 then 'https://a.loopreturns.com/' || o_orderkey when 1 then 'https://help.shop' || o_custkey || '.co.uk:8080/Refunds' end as link,
    case o_orderkey % 7 when 0 then 'known_returns_portal' else 'same_organization_subdomain' end as via from orders where o_orderkey % 5 <> 0 and o_orderkey % 7 < 2)
select store_id, arg_min(link, k) as link, arg_min(via, k) as matched_via from p group by 1
"""


def first_image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts as pages that show their name's image and their type's, each image with the first page that shows it."""
    p = read(spark, sf_dir, "part").select(F.lit("s").alias("store_id"), F.lit("r1").alias("run_id"), F.col("p_partkey").alias("seq"), F.col("p_partkey").cast("string").alias("url"), F.array("p_name", "p_type").alias("image_srcs"))
    return C.first_image_pages(p).select("src", "url")


FIRST_IMAGE_SQL = "select src, arg_min(p_partkey, p_partkey)::varchar as url from (select p_partkey, unnest([p_name, p_type]) as src from part) group by 1"


def due_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as watched stores of three modes, with their last orders as last audits: what is due, and which stores changed policies (regions) audit again."""
    k = F.col("c_custkey")
    last = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    c = read(spark, sf_dir, "customer").join(last, k == F.col("o_custkey"), "left")
    stores = c.select(
        k.cast("string").alias("url"), picked(k, 3, {0: "interval", 1: "on_change"}, "both").alias("mode"), (1 + k % 60).cast("int").alias("interval_days"), (1 + k % 20).cast("int").alias("cheap_check_interval_days"),
        F.col("last").cast("timestamp").alias("last_full_audit_at"), F.col("last").cast("timestamp").alias("last_cheap_check_at"), (k % 4 == 0).alias("on_policy_change"),
    )
    changed = read(spark, sf_dir, "region").filter("r_regionkey < 2").select(F.lower("r_name").alias("policy_id"))
    again = H.reaudits(changed, stores)
    return H.due(stores, F.lit("1998-08-10").cast("date")).select("url", "full", "cheap").join(again, "url", "left")


DUE_SQL = """
with l as (select o_custkey, max(o_orderdate)::date as last from orders group by 1),
s as (select c_custkey as k, last, c_custkey % 3 <> 1 and (last is null or last + (1 + c_custkey % 60)::int <= date '1998-08-10') as full_, c_custkey % 3 <> 0 and (last is null or last + (1 + c_custkey % 20)::int <= date '1998-08-10') as cheap from customer left join l on o_custkey = c_custkey),
t as (select string_agg(lower(r_name), ', ' order by lower(r_name)) as trigger_ from region where r_regionkey < 2)
select k::varchar as url, full_ as "full", cheap, case when k % 4 = 0 then trigger_ end as "trigger" from s, t where full_ or cheap
"""


def stored_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days of order snapshots by customer and status: the second day goes into the stored table, whose other folders stay."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("store_id"), F.col("o_orderstatus").alias("url"), (F.col("o_orderkey") % 2).alias("day")).agg(F.md5(F.sum("o_orderkey").cast("string").cast("binary")).alias("content_hash"))
    rows = lambda day, at: o.filter(F.col("day") == day).select("store_id", "url", "content_hash", F.lit(at).cast("timestamp").alias("fetched_at"))
    path = T.shared_path(spark, "snapshots")
    T.write_buckets(rows(0, "2024-01-01"), path, ["store_id", "url"], 8)
    H.store_snapshots(rows(1, "2024-01-02"), path, ["store_id", "url"], 8)
    return spark.read.parquet(path).select(F.col("store_id").cast("string").alias("store_id"), "url", "content_hash", F.date_format("fetched_at", "yyyy-MM-dd").alias("day"))


STORED_SQL = """
with o as (select o_custkey::varchar as store_id, o_orderstatus as url, o_orderkey % 2 as d, md5(sum(o_orderkey)::bigint::varchar) as content_hash from orders group by 1, 2, 3)
select store_id, url, arg_max(content_hash, d) as content_hash, '2024-01-0' || (max(d) + 1) as day from o group by 1, 2
"""


def stored_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as rules, of which a later set lacks some and renames others, stored by touched folders."""
    s = read(spark, sf_dir, "supplier")
    rule = lambda title: s.select(F.col("s_suppkey").cast("string").alias("id"), title.alias("title"))
    path = T.shared_path(spark, "rules")
    T.write_buckets(rule(F.col("s_name")).withColumn("active", F.lit(True)), path, ["id"], 8)
    R.store_rules(rule(F.when(F.col("s_suppkey") % 10 == 3, F.lower("s_name")).otherwise(F.col("s_name"))).filter("id % 7 <> 0"), path, 8)
    return spark.read.parquet(path).select("id", "title", "active")


RULES_SQL = "select s_suppkey::varchar as id, case when s_suppkey % 10 = 3 and s_suppkey % 7 <> 0 then lower(s_name) else s_name end as title, s_suppkey % 7 <> 0 as active from supplier"


def current_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of findings of their users' runs, whose scores are added up from each batch's counts."""
    k = F.col("event_id")
    e = event_stream(spark, sf_dir).filter("user_id is not null")
    f = e.select(
        F.col("user_id").cast("string").alias("store_id"), F.lit("r1").alias("run_id"), k.alias("seq"), F.lit("x").alias("check_id"), F.lit("t").alias("title"), picked(k, 4, {0: "critical", 1: "high", 2: "medium"}, "low").alias("severity"),
        picked(k, 6, {0: "cannot_verify"}, "confirmed").alias("confidence"), F.col("event_type").alias("page_url"), F.lit("e").alias("evidence"), F.lit(None).cast("string").alias("location"), picked(k, 3, {0: "suspension_risk", 1: "listing_disapproval"}, "quality_improvement").alias("impact_tier"),
    )
    paths = [T.shared_path(spark, tag) for tag in ("findings", "parts", "counts", "checkpoint")]
    S.keep_current(f, *paths, buckets=16).awaitTermination()
    runs = read(spark, sf_dir, "events").filter("user_id is not null").select(F.col("user_id").cast("string").alias("store_id"), F.lit("r1").alias("run_id")).distinct().withColumn("failed", F.lit(False))
    return S.current_scores(spark, paths[2], runs, buckets=16).select("store_id", "score", "rating")


SCORES_SQL = """
with e as (select user_id::varchar as store_id, event_id % 4 as sev, event_id % 6 <> 0 as ok, event_id % 3 as tier from events where user_id is not null),
p as (
  select store_id, sum(case when not ok then 0 when sev = 0 or tier = 0 then [25, 15, 8, 4][sev + 1] when tier = 1 then [10, 5, 2, 1][sev + 1] else 0.5 end) as off, bool_or(ok and sev = 0) as critical from e group by 1),
s as (select store_id, critical, greatest(0, least(100, round_even(100 - off, 0)))::int as score from p)
select store_id, score, case when critical or score < 50 then 'HIGH' when score < 80 then 'MEDIUM' else 'LOW' end as rating from s
"""

def form_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as pages with one form of six kinds, of which some don't answer."""
    k, field = F.col("c_custkey"), "struct<kind:string,hint:string,required:boolean,pattern:string>"
    one = lambda kind, hint, required=False: F.struct(F.lit(kind).alias("kind"), F.lit(hint).alias("hint"), F.lit(required).alias("required"), F.lit(None).cast("string").alias("pattern"))
    fields = picked(k, 6, {
        0: F.array(one("email", "email"), one("textarea", "message"), one("hidden", "token")), 1: F.array(one("text", "your email")), 2: F.array(one("email", "email")), 3: F.array(one("text", "full name"), one("email", "e-mail")),
        4: F.array(one("email", "email"), one("password", "pass"), one("textarea", "message")), 5: F.array(one("email", "email", True)),
    }, F.array().cast(f"array<{field}>"))
    action, hint = picked(k, 6, {3: "/send", 5: "https://x.example/s"}, ""), picked(k, 6, {1: "newsletter box", 2: "login", 3: "contact", 5: "sign-up"}, "")
    url = F.concat(F.lit("https://s"), k, F.lit(".example/p"))
    c = read(spark, sf_dir, "customer")
    pages = c.select(F.lit("s").alias("store_id"), F.lit("r1").alias("run_id"), url.alias("url"), F.when(k % 6 == 0, "contact_about").otherwise("blog_other").alias("page_type"), F.array(F.struct(action.alias("action"), hint.alias("hint"), fields.alias("fields"))).alias("forms"))
    probes = c.filter("c_custkey % 6 in (3, 5) and c_custkey % 4 < 3").select(url.alias("page_url"), action.alias("action"), F.when(k % 6 == 3, F.when(k % 4 == 1, 500).otherwise(200)).alias("status"), F.when(k % 6 == 5, "timeout").alias("error"))
    return C.form_checks(pages, probes).select("url", "check_id", "detail")


FORM_SQL = """
with c as (select c_custkey as k, 'https://s' || c_custkey || '.example/p' as url from customer)
select url, 'contact_form_missing_field' as check_id, 'name' as detail from c where k % 6 = 0
union all select url, 'form_email_field_weak_validation', 'newsletter' from c where k % 6 = 1
union all select url, 'contact_form_missing_field', 'message' from c where k % 6 = 3
union all select url, 'form_action_unreachable', case k % 6 when 3 then 'contact' else 'newsletter' end from c where (k % 6 = 3 and k % 4 = 1) or (k % 6 = 5 and k % 4 < 3)
"""


def new_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events of some value as violations, of which those of a higher one were alerted before."""
    e = read(spark, sf_dir, "events").filter("user_id is not null").select(F.col("user_id").alias("product_id"), F.col("event_type").alias("rule"), "value")
    return S.new_alerts(e.filter("value > 15"), e.filter("value > 40")).select("product_id", "rule")


ALERT_SQL = "select distinct user_id as product_id, event_type as rule from events where user_id is not null and value > 15 and (user_id, event_type) not in (select (user_id, event_type) from events where user_id is not null and value > 40)"


def shown_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict of an image counts for every part that shows it: images are the parts' names, their lengths the verdicts."""
    n = F.char_length("image_url")
    images = read(spark, sf_dir, "part").select(F.lit("s").alias("store_id"), F.lit("r1").alias("run_id"), F.col("p_partkey").cast("string").alias("url"), F.col("p_name").alias("image_url"))
    verdicts = images.select("image_url").distinct().filter(n % 5 != 0).select("image_url", (n % 3 != 0).alias("plausible_match"), (n % 2 == 0).alias("potentially_prohibited"))
    return N.image_findings(images, verdicts).select("url", "check_id", "severity")


SHOWN_SQL = """
with p as (select p_partkey::varchar as url, length(p_name) as n from part)
select url, 'llm_image_vision_check' as check_id, 'low' as severity from p where n % 5 = 0
union all select url, 'llm_image_product_mismatch', 'medium' from p where n % 5 <> 0 and n % 3 = 0
union all select url, 'llm_image_prohibited_content_flag', 'high' from p where n % 5 <> 0 and n % 2 = 0
"""


def feed_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts as feed products: what rules found, what a model's answers named, and where these are missing or broken."""
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part").select(k.cast("string").alias("id"), "p_partkey")
    violations = p.filter("p_partkey % 3 = 0").select("id", F.lit("gtin_present").alias("rule"), F.lit("warning").alias("severity"))
    answers = p.filter("p_partkey % 5 <> 4").select("id", picked(k, 5, {0: '[{"rule": "claims", "severity": "critical"}, {"rule": "tone", "severity": "warning"}]', 1: "[]", 2: "no json"}, F.lit(None).cast("string")).alias("answer"))
    return M.evaluated(p, violations, answers)


REVIEW_SQL = """
with p as (select p_partkey as k, p_partkey::varchar as id, p_partkey % 5 > 1 as manual_review from part),
v as (
  select k, 'gtin_present' as rule, 'warning' as severity, 'rule' as source from p where k % 3 = 0
  union all select k, 'claims', 'critical', 'model' from p where k % 5 = 0 union all select k, 'tone', 'warning', 'model' from p where k % 5 = 0)
select id, manual_review, rule, severity, source from p left join v using (k)
"""


def kept_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as pages, of which those stay with their bodies that the evaluations of order lines cite, by resource or in their text."""
    key = [F.lit("s").alias("store_id"), F.lit("r1").alias("run_id")]
    pages = read(spark, sf_dir, "orders").select(*key, F.concat(F.lit("https://a.example/"), "o_orderkey").alias("url"))
    at = lambda c: F.concat(F.lit("https://a.example/"), c)
    ev = read(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(*key, F.col("l_returnflag").alias("rule_id"), F.when(F.col("l_linenumber") == 1, at(F.col("l_orderkey"))).alias("resource_url"), F.lit(None).cast("array<string>").alias("observed"), F.concat(F.lit("see "), at(F.col("l_partkey")), F.lit("), twice.")).alias("text"))
    return N.kept_bodies(pages, N.cited_pages(ev, pages)).select("url")


KEPT_SQL = """
with c as (select l_orderkey as k from lineitem where l_quantity > 45 and l_linenumber = 1 union select l_partkey from lineitem where l_quantity > 45)
select 'https://a.example/' || o_orderkey as url from orders where o_orderkey in (select k from c)
"""


def api_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as runs of three platforms: which should be given access to the platform's API, as no finding of theirs (orders) was verified by it."""
    k = F.col("c_custkey")
    runs = read(spark, sf_dir, "customer").select(k.cast("string").alias("store_id"), F.lit("r1").alias("run_id"), picked(k, 3, {0: "woocommerce", 1: "shopify"}, "unknown").alias("platform"))
    f = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("store_id"), F.lit("r1").alias("run_id"), F.when(F.col("o_orderstatus") == "P", "api_verified").otherwise("page").alias("verification_method"))
    return N.needs_api(runs, f).select("store_id", "recommended")


ADVICE_SQL = "select c_custkey::varchar as store_id, c_custkey % 3 = 0 and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P') as recommended from customer"


def repeated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts as pages with three blocks of links: equal ones, two of a kind, and such that differ in one of twenty links."""
    k = F.col("p_partkey")
    links = lambda tag, n: F.concat(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("/"), i.cast("string"))), F.array(F.concat(F.lit("/own/"), F.lit(tag))))
    block = lambda tag, hrefs: F.struct(F.lit(tag).alias("tag"), hrefs.alias("hrefs"))
    same, other = F.array(*map(F.lit, "abcde")), F.array(*map(F.lit, "vwxyz"))
    blocks = picked(k, 3, {0: F.array(*[block("nav", same)] * 3), 1: F.array(block("nav", same), block("nav", same), block("nav", other))}, F.array(*[block("footer", links(t, 19)) for t in "pqr"]))
    p = read(spark, sf_dir, "part").select(F.lit("s").alias("store_id"), F.lit("r1").alias("run_id"), k.cast("string").alias("url"), blocks.alias("blocks"))
    return C.repeated_blocks(p).select("url", "tag", F.col("copies").cast("long").alias("copies"))


BLOCK_SQL = "select p_partkey::varchar as url, case p_partkey % 3 when 0 then 'nav' else 'footer' end as tag, 3::bigint as copies from part where p_partkey % 3 <> 1"

_F = (fetch_failures, broken_links, platforms, image_checks, claim_tasks, returns_credit, first_image_pages, due_stores, stored_snapshots, stored_rules, current_scores, form_checks, new_alerts, shown_images, feed_reviews, kept_bodies, api_advice, repeated_blocks)
QUERIES = {f.__name__: f for f in _F}
SQL = {
    "fetch_failures": "with" + FETCH_SQL + "select page_id, failure_category, reachable, cannot_verify from o", "broken_links": BROKEN_SQL, "platforms": PLATFORM_SQL, "image_checks": IMAGE_CHECK_SQL, "claim_tasks": CLAIM_SQL,
    "returns_credit": CREDIT_SQL, "first_image_pages": FIRST_IMAGE_SQL, "due_stores": DUE_SQL, "stored_snapshots": STORED_SQL, "stored_rules": RULES_SQL, "current_scores": SCORES_SQL,
    "form_checks": FORM_SQL, "new_alerts": ALERT_SQL, "shown_images": SHOWN_SQL, "feed_reviews": REVIEW_SQL, "kept_bodies": KEPT_SQL, "api_advice": ADVICE_SQL, "repeated_blocks": BLOCK_SQL,
}
