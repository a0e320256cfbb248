"""First audit: facts from documents as pages (source = store), rules, findings, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.functions import facts as X
from storegrain.operators import checks as C
from storegrain.operators import rules as R
from storegrain.operators.classes import leaders
from storegrain.plans import read
from storegrain.sources.tables import landed

RULES = "id string, type string, fact string, methods array<string>, sources array<string>, fields array<string>, tolerance double, min_confidence double, severity string, title string, resource_type string, check string, source_url string, impact string, policy_reference string"


def rule(**given) -> dict:
    return {"methods": [], "sources": [], "fields": [], "tolerance": 0.0, "min_confidence": 0.75, "severity": "medium"} | given


def rule_table(spark: SparkSession, *rows: dict) -> DataFrame:
    return spark.createDataFrame([{c.split()[0]: r.get(c.split()[0]) for c in RULES.split(", ")} for r in rows], RULES)


def contact_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "text").filter("text is not null")
    each = lambda fact, values, method, conf: F.transform(values, lambda v: F.struct(F.lit(fact).alias("fact"), v.alias("value"), F.lit(method).alias("method"), F.lit(conf).alias("confidence")))
    # a pattern runs only over texts with a sign of what it finds
    none = F.array().cast("array<string>")
    emails = F.when(F.contains("text", F.lit("@")), X.emails(F.col("text"))).otherwise(none)
    phones = F.when(F.rlike("text", F.lit(r"\d[\d\s().-]{7}")), X.phones(F.col("text"))).otherwise(none)
    found = d.select("doc_id", "source", F.explode(F.concat(each("business.email", emails, "business_identity_regex", 0.9), each("business.phone", phones, "business_identity_regex", 0.6))).alias("f"))
    return found.select(F.col("source").alias("store_id"), F.lit("r1").alias("run_id"), F.col("doc_id").alias("seq"), F.concat(F.lit("doc/"), F.col("doc_id")).alias("resource_url"), "f.fact", "f.value", "f.method", "f.confidence", F.lit(None).cast("string").alias("variant_key"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("source").alias("store_id"), F.lit("r1").alias("run_id"), F.concat(F.lit("doc/"), F.col("doc_id")).alias("url"), F.lit("contact_about").alias("page_type"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("source").alias("store_id"), F.lit("r1").alias("run_id")).distinct().withColumn("failed", F.lit(False))


EMAIL = rule(id="email_conflict", type="cross_page_contradiction", fact="business.email", sources=["contact_about"], severity="high", title="Several mail addresses")
PHONE = rule(id="phone_conflict", type="cross_page_contradiction", fact="business.phone", sources=["contact_about"], severity="medium", title="Several phone numbers")
CONTACT = rule(id="no_contact", type="all_missing", fields=["business.email", "business.phone"], severity="critical", title="No contact data")


#: Rules that may not run: a fact that nothing produces, a type that doesn't exist, a source that is none, and a check that is not in the registry.
BROKEN = [rule(id="no_such_fact", type="all_missing", fields=["business.fax"]), rule(id="no_such_type", type="guess"), rule(id="no_source", type="missing_resource", resource_type="faq", source_url="http://example.com/x"), rule(id="bad_check", type="existing_check", check="not_there")]


def evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules, evaluations, errors) of the sound rules above and of broken ones; facts are written once, as several plans read them."""
    facts = landed(contact_facts(spark, sf_dir), "contact-facts")
    registry = spark.createDataFrame([("business.email",), ("business.phone",)], "fact string")
    table = rule_table(spark, EMAIL, PHONE, CONTACT, *BROKEN)
    pages = document_pages(spark, sf_dir).withColumns({"reachable": F.lit(True), "soft_404": F.lit(False), "cannot_verify": F.lit(False)})
    rs = runs(spark, sf_dir).withColumn("credited", F.array().cast("array<string>"))
    return table, *R.evaluate(table, facts, pages, rs, registry, ["business_identity_regex"])


def first_audit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, evaluations, _ = evaluated(spark, sf_dir)
    return R.snapshot_status(runs(spark, sf_dir), R.build_findings(evaluations, table)).select("store_id", "status", "n_findings")


def rule_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evaluations, and the errors of the rules that were left out, as rows without a store."""
    _, evaluations, errors = evaluated(spark, sf_dir)
    bad = errors.groupBy(F.col("id").alias("rule_id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("store_id"), "rule_id", F.lit("error").alias("result"), F.lit(None).cast("double").alias("confidence"))
    return evaluations.select("store_id", "rule_id", "result", "confidence").unionByName(bad)


FACTS_SQL = r"""
facts as (
  select source as store_id, doc_id, 'business.email' as fact, lower(v) as value, 0.9 as confidence
  from (select source, doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) as v from documents)
  union
  select source, doc_id, 'business.phone', regexp_replace(v, '[^\d+]', '', 'g'), 0.6
  from (select source, doc_id, unnest(regexp_extract_all(text, '\+?\d[\d\s().-]{7,}\d')) as v from documents)
  where length(regexp_replace(v, '\D', '', 'g')) between 8 and 15)
"""
CROSS_SQL = (
    "with"
    + FACTS_SQL
    + """
select store_id, case when fact = 'business.email' then 'email_conflict' else 'phone_conflict' end as rule_id,
       case when count(distinct value) = 1 then 'pass' when min(confidence) >= 0.75 then 'fail' else 'needs_review' end as result,
       count(*) as observations, count(distinct value) as distinct_values
from facts group by store_id, fact having count(*) >= 2
"""
)
STATUS_SQL = (
    "with"
    + FACTS_SQL
    + """,
ev as (
  select store_id, case when fact = 'business.email' then 'at_risk' else 'action_required' end as level
  from facts group by store_id, fact having count(*) >= 2 and count(distinct value) > 1
  union all select source, 'critical' from documents where source not in (select store_id from facts) group by source)
select source as store_id, case when bool_or(level = 'critical') then 'CRITICAL' when bool_or(level = 'at_risk') then 'AT_RISK'
         when bool_or(level = 'action_required') then 'ACTION_REQUIRED' else 'COMPLIANT' end as status, count(level) as n_findings
from (select distinct source from documents) d left join ev on d.source = ev.store_id group by source
"""
)


DISPATCH_SQL = "with" + FACTS_SQL + """
select store_id, case when fact = 'business.email' then 'email_conflict' else 'phone_conflict' end as rule_id, case when count(distinct value) = 1 then 'pass' when min(confidence) >= 0.75 then 'fail' else 'needs_review' end as result, min(confidence)::double as confidence
from facts group by store_id, fact having count(*) >= 2
union all select source, 'no_contact', case when source in (select store_id from facts) then 'pass' else 'fail' end, 1.0 from documents group by source
union all select null, unnest(['no_such_fact', 'no_such_type', 'no_source', 'bad_check']), 'error', null
"""


def cross_page_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.cross_page(contact_facts(spark, sf_dir), document_pages(spark, sf_dir), rule_table(spark, EMAIL, PHONE))
    return out.select("store_id", "rule_id", "result", "observations", "distinct_values")


def missing_fact_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every document is a run of its own here, so that most have none of the facts
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("store_id"), F.col("doc_id").cast("string").alias("run_id"), F.lit(False).alias("failed"))
    facts = contact_facts(spark, sf_dir).withColumn("run_id", F.col("seq").cast("string"))
    return R.missing_facts(d, facts, rule_table(spark, CONTACT)).select("store_id", "run_id", "result", "n_facts")


MISSING_SQL = "with" + FACTS_SQL + "select source as store_id, d.doc_id::varchar as run_id, case when count(fact) > 0 then 'pass' else 'fail' end as result, count(fact) as n_facts from documents d left join facts f on f.doc_id = d.doc_id group by source, d.doc_id"


def method_price_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as facts: resource = part, variant = supplier, method = line status, value = tax."""
    li = read(spark, sf_dir, "lineitem")
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax")
    facts = li.select(F.lit("s").alias("store_id"), F.lit("r1").alias("run_id"), seq.alias("seq"), F.col("l_partkey").cast("string").alias("resource_url"), F.lit("price").alias("fact"), F.col("l_tax").cast("string").alias("value"), F.col("l_linestatus").alias("method"), F.lit(0.95).alias("confidence"), F.col("l_suppkey").cast("string").alias("variant_key"))
    out = R.method_mismatch(facts, rule_table(spark, rule(id="price", type="per_resource", fact="price", methods=["O", "F"], tolerance=0.01001)))
    return out.select("resource_url", "variant_key", "value_1", "value_2", "result")


METHOD_SQL = """
with g as (
  select l_partkey::varchar as resource_url, l_suppkey::varchar as variant_key,
    (arg_min(l_tax, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax)) filter (where l_linestatus = 'O'))::varchar as value_1,
    (arg_min(l_tax, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax)) filter (where l_linestatus = 'F'))::varchar as value_2
  from lineitem group by 1, 2)
select *, case when abs(value_1::double - value_2::double) <= 0.01001 then 'pass' else 'fail' end as result from g where value_1 is not null and value_2 is not null
"""


def missing_resource_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as pages: store = user, page type = event type; errors are soft 404s, views of negative value blocked."""
    e = read(spark, sf_dir, "events").filter("user_id is not null")
    pages = e.select(F.col("user_id").alias("store_id"), F.lit("r1").alias("run_id"), F.col("event_type").alias("page_type"), (F.col("value") >= 1).alias("reachable"), (F.col("value") < 20).alias("soft_404"), (F.col("value") < 1).alias("cannot_verify"))
    rs = pages.select(*R.KEY).distinct().withColumn("credited", F.array(F.lit("signup")))
    table = rule_table(spark, *[rule(id=f"has_{t}", type="missing_resource", resource_type=t) for t in ("purchase", "signup", "error")])
    return R.missing_resource(rs, pages, table).select("store_id", "resource_type", "result", "confidence", "reason", "n_pages")


RESOURCE_SQL = """
with t(resource_type) as (values ('purchase'), ('signup'), ('error')),
u as (select distinct user_id from events where user_id is not null),
g as (select user_id, event_type, bool_or(value >= 20) as genuine, bool_or(value >= 1 and value < 20) as soft, bool_or(value < 1) as blocked, count(*) as n from events group by 1, 2)
select u.user_id as store_id, resource_type,
  case when genuine then 'pass' when soft or blocked then 'needs_review' when resource_type = 'signup' then 'pass' else 'fail' end as result, case when genuine then 1.0 when soft then 0.5 when blocked then 0.3 when resource_type = 'signup' then 0.8 else 1.0 end::double as confidence,
  case when genuine then 'genuine' when soft then 'soft_404' when blocked then 'blocked' when resource_type = 'signup' then 'credited' else 'absent' end as reason,
  coalesce(n, 0) as n_pages
from u cross join t left join g on g.user_id = u.user_id and g.event_type = resource_type
"""


def rule_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    old = n.filter("n_nationkey < 18").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("title"), F.lit(0).alias("version"))
    new = n.filter("n_nationkey >= 8").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), F.lit(1).alias("version"))
    return R.sync_rules(old, new)


SYNC_SQL = "select n_nationkey as id, case when n_nationkey >= 8 then n_name else lower(n_name) end as title, case when n_nationkey >= 8 then 1 else 0 end as version, n_nationkey >= 8 as active from nation"


def identity_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.signals(contact_facts(spark, sf_dir))


def identity_inconsistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores with more than one value of a contact, counted whole; the first 20 are named."""
    return C.inconsistent(contact_facts(spark, sf_dir)).drop("run_id")


def price_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of the unit prices of each return flag within 1.50, in order of the order lines: how many there are, and their first members."""
    li = read(spark, sf_dir, "lineitem").select("l_returnflag", F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    values = li.groupBy("l_returnflag", "value").agg(F.min("seq").alias("seq")).withColumn("tolerance", F.lit(1.5))
    return leaders(values, ["l_returnflag"])


QUERIES = {f.__name__: f for f in (price_classes, first_audit_status, rule_dispatch, cross_page_contradiction, missing_fact_sets, method_price_mismatch, missing_resource_verdict, rule_sync, identity_signals, identity_inconsistent)}
SQL = {
    "first_audit_status": STATUS_SQL,
    "rule_dispatch": DISPATCH_SQL,
    "cross_page_contradiction": CROSS_SQL,
    "missing_fact_sets": MISSING_SQL,
    "method_price_mismatch": METHOD_SQL,
    "missing_resource_verdict": RESOURCE_SQL,
    "rule_sync": SYNC_SQL,
    "identity_signals": "with" + FACTS_SQL + "select fact, value, count(*) as n_pages, count(distinct store_id) as n_stores, min(doc_id) as first_page from facts group by 1, 2",
    "identity_inconsistent": "with" + FACTS_SQL + ", d as (select distinct store_id, fact, value from facts), k as (select *, row_number() over (partition by store_id, fact order by value) as k, count(*) over (partition by store_id, fact) as n from d) select store_id, fact, any_value(n) as n_values, string_agg(value, ', ' order by value) as found from k where n > 1 and k <= 20 group by 1, 2",
}
