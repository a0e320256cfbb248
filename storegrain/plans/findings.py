"""Queries over findings and runs: events, orders and lineitem in these roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.functions import urls as U
from storegrain.operators import findings as N
from storegrain.operators import history as H
from storegrain.plans import read

CHECKS = {"click": "external_domain_link", "view": "https_mixed_content_link", "error": "broken_image", "purchase": "llm_policy_substance_terms_of_service", "signup": "required_page_present"}


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as findings: a store is a user modulo 40, the type names the check, the id the link or image, the page a user."""
    e = read(spark, sf_dir, "events").filter("user_id is not null")
    check = N.looked_up(F.col("event_type"), CHECKS)
    k = lambda n: (F.col("event_id") % n).cast("string")
    link = F.concat(F.lit('a[href="https://www.h'), k(7), F.lit(".example/"), k(3), F.lit('"]'))
    location = F.when(F.col("event_type") == "error", F.concat(F.lit('img[src="/i'), k(50), F.lit('"]'))).when(F.col("event_id") % 11 != 0, link)
    return e.select(
        (F.col("user_id") % 40).cast("string").alias("store_id"), F.lit("r1").alias("run_id"), F.col("event_id").alias("seq"), check.alias("check_id"), F.concat(F.lit("Missing required page: "), F.get(F.array(*map(F.lit, ["Privacy policy", "Contact info", "Imprint"])), (F.col("event_id") % 3).cast("int"))).alias("title"),
        F.lit("low").alias("severity"), F.lit("confirmed").alias("confidence"), F.when(F.col("event_id") % 13 != 0, F.concat(F.lit("p"), F.col("user_id"))).alias("page_url"), F.concat(F.lit("seen "), "event_id").alias("evidence"), location.alias("location"),
    )


EVENTS_SQL = """
f as (
  select (user_id % 40)::varchar as store_id, event_id as seq, case when event_id % 13 <> 0 then 'p' || user_id end as page_url, event_type, 'seen ' || event_id as evidence,
    'Missing required page: ' || ['Privacy policy', 'Contact info', 'Imprint'][event_id % 3 + 1] as title,
    case event_type when 'click' then 'external_domain_link' when 'view' then 'https_mixed_content_link' when 'error' then 'broken_image' when 'purchase' then 'llm_policy_substance_terms_of_service' else 'required_page_present' end as check_id,
    case when event_type = 'error' then 'img[src="/i' || event_id % 50 || '"]' when event_id % 11 <> 0 then 'a[href="https://www.h' || event_id % 7 || '.example/' || event_id % 3 || '"]' end as location,
    case when event_type = 'click' and event_id % 11 <> 0 then 'www.h' || event_id % 7 || '.example' when event_type = 'view' and event_id % 11 <> 0 then 'https://www.h' || event_id % 7 || '.example/' || event_id % 3
      when event_type = 'error' then '' end as value
  from events where user_id is not null)
"""


def aggregate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.rolled_up(event_findings(spark, sf_dir)).select("store_id", "check_id", "seq", "title", "page_url", "evidence", "location", "n", "n_pages")


ROLLED_SQL = "with" + EVENTS_SQL + """,
x as (select *, case when event_type = 'error' then '/i' || seq % 50 || ' (on ' || coalesce(page_url, 'unknown page') || ')' else page_url end as example from f),
c as (select store_id, check_id, count(*) as of_check from x group by 1, 2),
g as (
  select store_id, check_id, value, event_type, count(*) as n, count(page_url) as with_page, count(distinct page_url) as n_pages, count(distinct example) as n_examples, min(seq) as seq, arg_min(title, seq) as title
  from x where value is not null group by 1, 2, 3, 4),
b as (select g.* from g join c using (store_id, check_id) where n >= 3 and of_check >= 3),
e as (select store_id, check_id, value, example, row_number() over (partition by store_id, check_id, value order by min(seq), example) as k from x where value is not null and example is not null group by 1, 2, 3, 4),
s as (select store_id, check_id, value, string_agg(example, ', ' order by k) as shown from e where k <= 5 group by 1, 2, 3)
select b.store_id, b.check_id, seq, title, null as page_url,
  case event_type when 'click' then 'Link(s) to ' || b.value || ' found on ' || n_pages || ' page(s): ' when 'view' then 'Link to ' || b.value || ' found on ' || with_page || ' page(s): '
    else title || ' - ' || n || ' instance(s) across ' || n_pages || ' page(s), including: ' end || coalesce(shown, '') || case when n_examples > 5 then ', and ' || (n_examples - 5) || ' more' else '' end as evidence,
  case event_type when 'click' then 'a[href*="' || b.value || '"]' when 'view' then 'a[href="' || b.value || '"]' else 'aggregated site-wide (see evidence for exact pages/images)' end as location, n, n_pages
from b left join s on s.store_id = b.store_id and s.check_id = b.check_id and s.value = b.value
union all
select f.store_id, f.check_id, f.seq, f.title, f.page_url, f.evidence, f.location, 1, case when f.page_url is null then 0 else 1 end
from f left join b on f.store_id = b.store_id and f.check_id = b.check_id and f.value = b.value where b.n is null
"""


def impact_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = N.with_impact(event_findings(spark, sf_dir))
    return f.groupBy("check_id", "impact_tier", "policy_area", "citation", "ads_eligibility_impact").agg(F.count(F.lit(1)).alias("n"))


IMPACT_SQL = "with" + EVENTS_SQL + """,
a as (
  select *, case check_id when 'external_domain_link' then 'misrepresentation' when 'llm_policy_substance_terms_of_service' then 'terms_of_service'
    when 'required_page_present' then case seq % 3 when 0 then 'privacy_policy' when 1 then 'business_identity' end end as policy_area from f)
select check_id, case when check_id in ('required_page_present', 'llm_policy_substance_terms_of_service') then 'suspension_risk' else 'listing_disapproval' end as impact_tier, policy_area,
  case when check_id in ('required_page_present', 'llm_policy_substance_terms_of_service') then 'support.google.com/merchants/answer/13693195' end as citation,
  case when policy_area is null then 'unclear' else 'ads_and_listings' end as ads_eligibility_impact, count(*) as n
from a group by 1, 2, 3, 4, 5
"""


def order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as findings: store = customer, priority = severity, status = tier and confidence."""
    o = read(spark, sf_dir, "orders")
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    severity = F.when(p == 1, "critical").when(p == 2, "high").when(p == 3, "medium").otherwise("low")
    tier = F.when(F.col("o_orderstatus") == "O", "listing_disapproval").when(F.col("o_orderstatus") == "P", "suspension_risk").otherwise("quality_improvement")
    area = F.get(F.array(*map(F.lit, N.AREAS)), (F.col("o_orderkey") % 8).cast("int"))
    return o.select(
        F.col("o_custkey").cast("string").alias("store_id"), F.lit("r1").alias("run_id"), F.col("o_orderkey").alias("seq"), severity.alias("severity"), tier.alias("impact_tier"),
        F.when(F.col("o_orderkey") % 10 == 0, "cannot_verify").otherwise("confirmed").alias("confidence"), area.alias("policy_area"), F.concat(F.lit("title "), F.col("o_orderkey")).alias("title"),
        F.concat(F.lit("page"), F.col("o_orderkey") % 5).alias("page_url"), F.concat(F.lit("c"), F.col("o_orderkey") % 4).alias("check_id"), F.concat(F.lit("f"), F.col("o_orderkey") % 3).alias("fix"),
    )


ORDERS_SQL = """
f as (
  select o_custkey::varchar as store_id, o_orderkey as seq, case left(o_orderpriority, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' else 'low' end as severity,
    case left(o_orderpriority, 1) when '1' then 0 when '2' then 1 when '3' then 2 else 3 end as rank,
    case o_orderstatus when 'O' then 'listing_disapproval' when 'P' then 'suspension_risk' else 'quality_improvement' end as tier,
    o_orderkey % 10 <> 0 as confirmed, o_orderkey % 8 as area, 'title ' || o_orderkey as title, 'page' || o_orderkey % 5 as page_url, 'c' || o_orderkey % 4 as check_id, 'f' || o_orderkey % 3 as fix
  from orders),
r as (select *, confirmed and (severity = 'critical' or tier = 'suspension_risk') as risk from f)
"""


def _runs(f: DataFrame) -> DataFrame:
    return f.select("store_id", "run_id").distinct().withColumn("failed", F.lit(False))


def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = order_findings(spark, sf_dir)
    return N.risk_score(_runs(f), f).select("store_id", "score", "rating")


SCORE_SQL = "with" + ORDERS_SQL + """,
s as (
  select store_id, bool_or(risk and severity = 'critical') as critical, greatest(0, least(100, round_even(100 - sum(
    case when not confirmed then 0 when risk then [25, 15, 8, 4][rank + 1] when tier = 'listing_disapproval' then [10, 5, 2, 1][rank + 1] when tier = 'quality_improvement' then 0.5 else 0 end), 0)))::int as score
  from r group by 1)
select store_id, score, case when critical or score < 50 then 'HIGH' when score < 80 then 'MEDIUM' else 'LOW' end as rating from s
"""


def policy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = order_findings(spark, sf_dir)
    return N.policy_matrix(_runs(f), f).select("store_id", "policy_area", "status", "n", "worst_title")


MATRIX_SQL = "with" + ORDERS_SQL + f""",
a as (select unnest({N.AREAS!r}) as policy_area, unnest(range(8)) as area),
g as (select store_id, area, count(*) as n, bool_or(confirmed and rank <= 1) as fail, bool_or(confirmed) as risk, arg_min(title, (rank, seq)) as worst_title from r group by 1, 2)
select s.store_id, policy_area, case when fail then 'Fail' when risk then 'At Risk' when n > 0 then 'Cannot Verify' else 'Pass' end as status, coalesce(n, 0) as n, worst_title
from (select distinct store_id from r) s cross join a left join g on g.store_id = s.store_id and g.area = a.area
"""


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.run_summary(order_findings(spark, sf_dir)).drop("run_id")


SUMMARY_SQL = "with" + ORDERS_SQL + "select store_id, count(*) as n_findings, count(*) filter (where severity = 'critical') as n_critical, count(*) filter (where severity = 'high') as n_high, count(*) filter (where severity = 'medium') as n_medium, count(*) filter (where severity = 'low') as n_low, count(*) filter (where risk) as n_suspension_risk, count(*) filter (where not confirmed) as n_unverified, count(distinct page_url) as n_pages from r group by 1"


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pages a customer: the order number's remainder names a page, a checksum says whether it loaded."""
    k = F.crc32(F.concat("store_id", F.lit(":"), "page_url").cast("binary"))
    f = order_findings(spark, sf_dir).select("store_id", "run_id", "page_url").distinct()
    return f.select("store_id", "run_id", F.col("page_url").alias("url"), (k % 5 != 0).alias("reachable"), (k % 10 == 0).alias("cannot_verify"), F.when(k % 10 == 0, F.when(k % 20 == 0, "bot_blocked")).otherwise(F.when(k % 5 == 0, "not_found")).alias("failure_category"))


def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.page_status(order_pages(spark, sf_dir), order_findings(spark, sf_dir).filter("check_id <> 'c0'")).drop("run_id")


# DuckDB has no crc32, so the remainders come from a table of it.
CRC_SQL = """
t as (select i as n, list_reduce(list_prepend(i, range(8)), lambda x, k: case when x & 1 = 1 then xor(3988292384, x >> 1) else x >> 1 end) as c from range(256) r(i)),
l as (select list(c order by n) as c from t),
k as (
  select store_id, page_url, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(store_id || ':' || page_url, ''), lambda s: ascii(s)::bigint)),
    lambda x, s: xor(c[(xor(x, s) & 255) + 1]::bigint, x >> 8)), 4294967295) as k
  from (select distinct store_id, page_url from r), l)
"""
STATUS_SQL = "with" + ORDERS_SQL + "," + CRC_SQL + """,
p as (select store_id, page_url, count(*) filter (where risk) as n_major, count(*) filter (where not risk) as n_minor, bool_or(rank <= 1) as bad, bool_or(not confirmed) as unsure from r where check_id <> 'c0' group by 1, 2)
select store_id, page_url as url, coalesce(n_major, 0) as n_major, coalesce(n_minor, 0) as n_minor,
  case when k % 10 = 0 then 'CANNOT VERIFY' when k % 5 = 0 then 'UNREACHABLE' when bad then 'RISK' when unsure then 'CANNOT VERIFY' when n_major + n_minor > 0 then 'RISK' else 'PASS' end as status
from k left join p using (store_id, page_url)
"""


def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.crawl_summary(order_pages(spark, sf_dir)).drop("run_id")


CRAWL_SQL = "with" + ORDERS_SQL + "," + CRC_SQL + """,
n as (select store_id, count(*) as n_pages, count(*) filter (where k % 5 <> 0) as n_reachable, count(*) filter (where k % 10 = 5) as n_broken, count(*) filter (where k % 10 = 0) as n_unverifiable,
  count(*) filter (where k % 20 = 0) as b, count(*) filter (where k % 20 = 10) as u from k group by 1)
select store_id, n_pages, n_reachable, n_broken, n_unverifiable,
  case when b = 0 and u = 0 then null when u = 0 then b || ' bot_blocked' when b = 0 then u || ' unknown' when b >= u then b || ' bot_blocked, ' || u || ' unknown' else u || ' unknown, ' || b || ' bot_blocked' end as reasons from n
"""


def catalog_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages of a domain as its catalog, by canonical key; orders are the findings, dealt to pages by their number."""
    p = read(spark, sf_dir, "pages").select(F.regexp_extract(U.netloc(F.col("url")), r"([^.]+\.[^.]+)$", 1).alias("store_id"), F.lit("r1").alias("run_id"), F.col("page_id").alias("seq"), "url", F.when(F.col("page_id") % 4 == 0, "collection").when(F.col("page_id") % 4 == 3, "faq").otherwise("product").alias("page_type"))
    f = order_findings(spark, sf_dir).withColumn("page_id", F.col("seq") % 499).drop("store_id", "run_id", "page_url")
    f = f.join(p.select("store_id", "run_id", F.col("seq").alias("page_id"), F.col("url").alias("page_url")), "page_id")
    return N.catalog_rollup(p, f).drop("run_id")


CATALOG_SQL = "with" + ORDERS_SQL + r""",
p as (
  select page_id, url, regexp_extract(lower(regexp_extract(url, '://([^/?#]*)', 1)), '([^.]+\.[^.]+)$', 1) as store_id,
    regexp_replace(regexp_extract(url, '^[^?#]*'), '/page/\d+/?$', '') || case when contains(url, '?') then regexp_extract(url, '\?[^#]*') else '' end as page_group
  from pages where page_id % 4 <> 3),
u as (select p.url, count(*) filter (where risk) as n_shown, count(*) filter (where not risk) as n_hidden from r join pages p on p.page_id = r.seq % 499 group by 1),
g as (select store_id, page_group, count(*) as variants, arg_min(p.url, (length(p.url), page_id)) as representative, coalesce(sum(n_shown), 0)::bigint as n_shown, coalesce(sum(n_hidden), 0)::bigint as n_hidden from p left join u on p.url = u.url group by 1, 2)
select *, case when n_shown > 0 then 'flagged' when n_hidden > 0 then 'other' else 'clean' end as state from g
"""


def fix_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.fix_list(order_findings(spark, sf_dir)).drop("run_id")


FIX_SQL = "with" + ORDERS_SQL + """,
b as (select store_id, check_id, fix, min((rank, seq)) as m, arg_min(severity, (rank, seq)) as severity from r where risk group by 1, 2, 3)
select store_id, (row_number() over (partition by store_id order by m, check_id, fix))::int as position, check_id, fix, severity from b
"""


def severity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst finding of each store."""
    f = order_findings(spark, sf_dir)
    return f.groupBy("store_id").agg(F.min_by("title", F.struct(N.severity_rank(F.col("severity")), "seq")).alias("worst_title"))


def delta_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem of two return flags as two runs of one store: key = part and supplier."""
    li = read(spark, sf_dir, "lineitem")
    run = lambda flag: li.filter(F.col("l_returnflag") == flag).select("l_partkey", "l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_tax").alias("seq"), (F.col("l_quantity") > 25).cast("string").alias("evidence"), (F.col("l_tax") > 0.04).cast("string").alias("severity"))
    return N.delta(run("A"), run("R"), ["l_partkey", "l_suppkey"])


DELTA_SQL = """
with l as (select l_returnflag as f, l_partkey, l_suppkey, arg_max((l_quantity > 25)::varchar, (l_orderkey, l_linenumber, l_quantity, l_tax)) as e, arg_max((l_tax > 0.04)::varchar, (l_orderkey, l_linenumber, l_quantity, l_tax)) as s from lineitem group by 1, 2, 3)
select coalesce(a.l_partkey, b.l_partkey) as l_partkey, coalesce(a.l_suppkey, b.l_suppkey) as l_suppkey,
  case when a.e is null then 'new' when b.e is null then 'resolved' when a.e = b.e and a.s = b.s then 'unchanged' else 'changed' end as change, a.s as severity_old, b.s as severity_new
from (select * from l where f = 'A') a full join (select * from l where f = 'R') b on a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey
"""


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"))


def retention_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.to_prune(order_runs(spark, sf_dir), ["o_custkey"], 5).select("o_custkey", "run_id")


RETENTION_SQL = "select o_custkey, o_orderkey as run_id from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) where k > 5"


def retention_age_or_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as runs that began at an hour of their day, two thirds of which ended hours later: beyond the newest three of a customer, and ended over 900 days before a moment."""
    k, start = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    runs = read(spark, sf_dir, "orders").select("o_custkey", k.alias("run_id"), (start + F.make_dt_interval(F.lit(0), k % 24)).alias("started_at"), F.when(k % 3 != 0, start + F.make_dt_interval(F.lit(0), k % 24 + k % 11, k % 60)).alias("finished_at"))
    return H.expired(runs, ["o_custkey"], F.lit("1998-08-01 10:30:00").cast("timestamp"), days=900, keep=3).select("o_custkey", "run_id")


AGE_SQL = """
with r as (select o_custkey, o_orderkey as k, o_orderdate::timestamp + to_hours(o_orderkey % 24) as s, case when o_orderkey % 3 <> 0 then o_orderdate::timestamp + to_hours(o_orderkey % 24 + o_orderkey % 11) + to_minutes(o_orderkey % 60) end as f from orders)
select o_custkey, k as run_id from (select *, row_number() over (partition by o_custkey order by s desc, k desc) as n from r) where n > 3 and coalesce(f, s) < timestamp '1998-08-01 10:30:00' - interval 900 days
"""


def blob_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents as contents: stored once for the documents of odd id, then referenced and released in the order of the order lines, which name them by part."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"), F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
    at = F.lit("2024-01-01").cast("timestamp")
    stored = d.filter("doc_id % 2 = 1").groupBy("hash").agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("refcount")).withColumn("last_referenced_at", at)
    n = d.agg(F.max("doc_id") + 1).first()[0] or 1
    li = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("k"), (F.col("l_partkey") % n).alias("doc_id"), F.col("l_shipdate").cast("timestamp").alias("at"), F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1).alias("change"))
    deltas = li.join(d, "doc_id").select("hash", "bytes", "change", "at", F.col("k").alias("seq"))
    return H.merged_blobs(stored, deltas).select("hash", "bytes", F.col("refcount").cast("long").alias("refcount"), "released")


BLOB_SQL = """
with d as (select doc_id, sha256(coalesce(text, '')) as hash, octet_length(encode(coalesce(text, ''))) as bytes from documents),
s as (select hash, max(bytes) as bytes, count(*) as n from d where doc_id % 2 = 1 group by 1),
m as (select hash, bytes, l_orderkey * 7 + l_linenumber as k, l_shipdate as day, case when l_linenumber % 2 = 0 then 1 else -1 end as c from lineitem join d on doc_id = l_partkey % (select max(doc_id) + 1 from documents)),
r as (select hash, bytes, coalesce(n, 0) + sum(c) over (partition by hash order by day, k rows unbounded preceding) as run, row_number() over (partition by hash order by day desc, k desc) as last from m left join s using (hash, bytes)),
f as (select hash, max(bytes) as bytes, max(case when last = 1 then run end) - least(0, min(run)) as refcount from r group by 1)
select hash, bytes, refcount::bigint as refcount, refcount = 0 as released from f union all select hash, bytes, n, false from s where hash not in (select hash from f)
"""


def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each store's score, in order."""
    f = order_findings(spark, sf_dir)
    return N.risk_score(_runs(f), f).select("store_id", F.posexplode("breakdown").alias("k", "line"))


BREAKDOWN_SQL = "with" + ORDERS_SQL + r""",
g as (select store_id, case when not confirmed then 'excluded' when risk then 'suspension' when tier = 'listing_disapproval' then 'disapproval' when tier = 'quality_improvement' then 'quality' end as kind, rank, severity from r),
c as (
  select store_id, kind, case when kind in ('suspension', 'disapproval') then rank end as rank, case when kind in ('suspension', 'disapproval') then severity end as severity, count(*) as n,
    case kind when 'suspension' then [25, 15, 8, 4][any_value(rank) + 1] when 'disapproval' then [10, 5, 2, 1][any_value(rank) + 1] when 'quality' then 0.5 else 0 end as each
  from g where kind is not null group by 1, 2, 3, 4),
t as (select store_id, round_even(100 - sum(n * each), 0)::int as raw, greatest(0, least(100, raw)) as score, bool_or(each > 0) as cost from c group by 1),
l as (
  select store_id, ['suspension', 'disapproval', 'quality', 'excluded'].list_position(kind) as a, rank as b,
    case when kind = 'excluded' then n || ' finding(s) excluded from scoring: cannot-verify (an unconfirmed issue doesn''t move this score either way).'
      else '-' || regexp_replace((n * each)::decimal(38, 1)::varchar, '\.0$', '') || ': ' || n || ' ' || case kind when 'suspension' then 'suspension-risk' when 'disapproval' then 'listing-disapproval' else 'quality-improvement' end || ' finding(s)'
        || case when kind = 'quality' then '' else ' at ' || severity || ' severity' end || ' (' || regexp_replace(each::decimal(38, 1)::varchar, '\.0$', '') || ' pt each)' end as line from c
  union all select store_id, 0, 0, 'No confirmed findings to deduct for - starting score of 100 stands.' from t where not cost
  union all select store_id, 9, 0, 'Raw score before clamping: ' || raw || ' - ' || case when score = 0 then 'floored' else 'capped' end || ' to ' || score || ' (score is always shown in the 0-100 range).' from t where raw <> score)
select store_id, row_number() over (partition by store_id order by a, b)::int - 1 as k, line from l
"""


def cache_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache entries beyond the newest 5,000."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("created_at"))
    return H.over_cap(o, "key", 5_000).select("key")


CAP_SQL = "select o_orderkey as key from orders where o_orderkey not in (select o_orderkey from orders order by o_orderdate desc, o_orderkey desc limit 5000)"


def previous_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.with_previous(order_runs(spark, sf_dir), ["o_custkey"]).select("o_custkey", "run_id", "previous")


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.latest(order_runs(spark, sf_dir), ["o_custkey"]).select("o_custkey", "run_id")


def policy_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents of a source as the texts of one policy; the new version edits those of every second source, and stores are all sources."""
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("policy_id"), F.col("doc_id").alias("pos"), F.coalesce("text", F.lit("")).alias("text"))
    odd = F.regexp_extract("policy_id", r"(\d+)$", 1).cast("int") % 2 == 1
    old, new = H.policy_hashes(d), H.policy_hashes(d.withColumn("text", F.when(odd, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))))
    return H.changed(new, old, ["policy_id"], ["hash"], first_sight=False).select("policy_id")


def schema_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "region")
    old = r.select(F.col("r_regionkey").alias("id"), F.when(F.col("r_regionkey") > 1, F.col("r_name")).alias("title"))
    return H.with_columns(old, {"title": F.lit("untitled"), "active": F.lit(True)})


def schema_evolve_sql() -> str:
    return "select r_regionkey as id, case when r_regionkey > 1 then r_name else 'untitled' end as title, true as active from region"


_F = (blob_releases, score_breakdown, aggregate_findings, impact_tiers, risk_score, policy_matrix, run_summary, page_status, crawl_summary, catalog_rollup, fix_list, severity_topk, delta_runs, retention_runs, retention_age_or_rank, cache_cap, previous_run, latest_run, policy_changes, schema_evolve)
QUERIES = {f.__name__: f for f in _F}
SQL = {
    "aggregate_findings": ROLLED_SQL, "impact_tiers": IMPACT_SQL, "risk_score": SCORE_SQL, "policy_matrix": MATRIX_SQL, "run_summary": SUMMARY_SQL, "page_status": STATUS_SQL, "crawl_summary": CRAWL_SQL, "catalog_rollup": CATALOG_SQL, "fix_list": FIX_SQL, "delta_runs": DELTA_SQL,
    "severity_topk": "with" + ORDERS_SQL + "select store_id, arg_min(title, (rank, seq)) as worst_title from r group by 1",
    "blob_releases": BLOB_SQL, "score_breakdown": BREAKDOWN_SQL, "retention_runs": RETENTION_SQL, "retention_age_or_rank": AGE_SQL, "cache_cap": CAP_SQL,
    "previous_run": "select o_custkey, o_orderkey as run_id, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous from orders",
    "latest_run": "select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as run_id from orders group by 1",
    "policy_changes": r"select distinct source as policy_id from documents where regexp_extract(source, '(\d+)$', 1)::int % 2 = 1",
    "schema_evolve": schema_evolve_sql(),
}
