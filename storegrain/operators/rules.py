"""Evaluation of declarative rules over facts and pages: one plan for each kind of rule.

`KEY` are the leading keys of every table. A rule row has id, type, fact, methods, sources, tolerance,
min_confidence, severity, title; facts have seq, resource_url, fact, value, method, confidence, variant_key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storegrain.functions.facts import TOLERANCE, VERBATIM, compare_text
from storegrain.operators.classes import leaders
from storegrain.sources.tables import landed, replace_changed_buckets

KEY = ["store_id", "run_id"]
#: Rules above this number are joined by a shuffle.
SMALL = 10_000
# Severity ranks, and the confidences of findings turned into evaluations.
SEVERITY = {"critical": 0, "high": 1, "medium": 2, "low": 3}
FINDING_RESULT = {"confirmed": ("fail", 1.0), "potential_risk": ("fail", 0.85), "cannot_verify": ("needs_review", 0.3)}


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most SMALL rows; for rules, tiers and the like, whose rows are short."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


# What a rule of each type has to name, page types, and the hosts that a rule may cite.
RULE_FIELDS = {"numeric_mismatch": ["fact", "methods", "tolerance"], "cross_page_contradiction": ["fact", "sources"], "missing_resource": ["resource_type"], "all_missing": ["fields"], "existing_check": ["check"]}
PAGE_TYPES = ["homepage", "product", "collection", "cart", "checkout", "privacy_policy", "shipping_policy", "returns_policy", "terms_of_service", "contact_about", "faq", "blog_other"]
SOURCE_HOSTS = ["support.google.com", "google.com", "www.google.com", "developers.google.com"]


def rule_errors(rules: DataFrame, registry: DataFrame, methods: list[str]) -> DataFrame:
    """(id, error) of all that is wrong with rules; a table without rows is a set of rules that may run.

    Ids given twice; an unknown type, or a field that the type needs and the rule lacks; unknown facts (registry: fact),
    methods and page types; a cited source that is no https page of SOURCE_HOSTS; an advisory that cites a policy.
    """
    c, none = F.col, F.array().cast("array<string>")
    empty = lambda f: F.coalesce(F.size(f) == 0, F.lit(True)) if f in ("methods", "sources", "fields") else F.coalesce(c(f) == 0, F.lit(True)) if f == "tolerance" else F.coalesce(c(f) == "", F.lit(True))
    unknown = lambda f, known: F.size(F.array_except(F.coalesce(c(f), none), F.array(*map(F.lit, known)))) > 0
    host = F.regexp_extract("source_url", "^https://([^/?#]*)", 1)
    found = [
        F.when(~F.coalesce(c("type").isin(*RULE_FIELDS), F.lit(False)), "unknown type"),
        *[F.when((c("type") == kind) & empty(f), f"{kind} needs {f}") for kind, fields in RULE_FIELDS.items() for f in fields],
        F.when((c("type") == "numeric_mismatch") & (F.size("methods") != 2), "numeric_mismatch needs two methods"), F.when(unknown("methods", methods), "unknown method"), F.when(unknown("sources", PAGE_TYPES), "unknown page type"),
        F.when(c("resource_type").isNotNull() & ~c("resource_type").isin(PAGE_TYPES), "unknown page type"), F.when(c("source_url").isNotNull() & ~host.isin(SOURCE_HOSTS), "no official source"),
        F.when((c("impact") == "quality_improvement") & c("policy_reference").isNotNull(), "an advisory cites a policy"),
    ]
    own = rules.select("id", F.explode(F.array_distinct(F.array_compact(F.array(*found)))).alias("error"))
    twice = rules.groupBy("id").count().filter("count > 1").select("id", F.lit("duplicate id").alias("error"))
    named = rules.select("id", F.explode(F.array_compact(F.concat(F.array("fact"), F.coalesce("fields", none)))).alias("fact"))
    facts = named.join(small(registry.select("fact")), "fact", "left_anti").select("id", F.lit("unknown fact").alias("error")).distinct()
    return reduce(DataFrame.unionByName, [own, twice, facts])


def sync_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rules ever seen: those of new with active true, the others as they were with active false. Both have id as key and equal columns."""
    cols = [c for c in new.columns if c != "id"]
    o = old.select("id", *[F.col(c).alias(f"old_{c}") for c in cols])
    j = new.withColumn("present", F.lit(True)).join(o, "id", "full_outer")
    return j.select("id", *[F.when(F.col("present"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in cols], F.coalesce("present", F.lit(False)).alias("active"))


def store_rules(new: DataFrame, path: str, buckets: int = 64) -> None:
    """sync_rules on the table at path (of write_buckets by id, with active): only folders of rules that are new, gone or changed are written."""
    old = new.sparkSession.read.parquet(path).drop("bucket", "active")
    replace_changed_buckets(sync_rules(old, new), path, ["id"], buckets)


def cross_page(facts: DataFrame, pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Contradictions of one fact between pages: (key, rule_id, result, confidence, observations, distinct_values).

    Fewer than two observations give no row. Values fall into classes in order of seq, each value to the first
    class whose first member it equals by the fact's own comparison; one class passes, more fail from the rule's
    confidence on, and need review below it. Classes within a tolerance are counted by their leaders.
    """
    r = small(rules.select(F.col("id").alias("rule_id"), F.col("fact").alias("rf"), "sources", "min_confidence"))
    p = pages.select(*KEY, F.col("url").alias("resource_url"), "page_type")
    seen = facts.join(r, F.col("fact") == F.col("rf")).join(p, [*KEY, "resource_url"]).filter("size(sources) = 0 or array_contains(sources, page_type)")
    # one row for each distinct value first: what repeats can't open a class
    num = lambda x: x.try_cast("double")
    tol = F.try_element_at(F.create_map(*[F.lit(x) for kv in TOLERANCE.items() for x in kv]), F.col("fact"))
    canon = F.when(F.col("fact").isin(VERBATIM), F.col("value")).when(tol.isNotNull(), F.coalesce(num(F.col("value")).cast("string"), compare_text(F.col("value")))).otherwise(compare_text(F.col("value")))
    values = seen.groupBy(*KEY, "rule_id", tol.alias("tolerance"), "min_confidence", canon.alias("value")).agg(F.min("seq").alias("seq"), F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))
    # with tolerance 0 the classes are the distinct values, and so they are for what is no number
    on = [*KEY, "rule_id"]
    number = F.when(F.col("tolerance") > 0, num(F.col("value")))
    number = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    per = lambda v: v.groupBy(*on, "min_confidence").agg(F.sum("n").alias("observations"), F.min("confidence").alias("confidence"), F.count_if(number.isNull()).alias("distinct_values"))
    if rules.filter(F.col("fact").isin([fact for fact, t in TOLERANCE.items() if t > 0])).isEmpty():
        out = per(values)
    else:
        values = landed(values, "fact-values")
        classes = leaders(values.select(*on, "tolerance", "seq", number.alias("value")).filter("value is not null"), on).groupBy(*on).agg(F.count(F.lit(1)).alias("classes"))
        out = per(values).join(classes, on, "left").withColumn("distinct_values", F.col("distinct_values") + F.coalesce("classes", F.lit(0).cast("long")))
    out = out.filter("observations >= 2")
    result = F.when(F.col("distinct_values") == 1, "pass").when(F.col("confidence") >= F.col("min_confidence"), "fail").otherwise("needs_review")
    return out.select(*KEY, "rule_id", result.alias("result"), "confidence", "observations", "distinct_values")


def method_mismatch(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """The first facts of a rule's two methods within one resource and variant: (key, rule_id, resource_url, variant_key, value_1, value_2, result, confidence).

    Numbers agree within the rule's tolerance, texts only where they are the same.
    """
    r = small(rules.select(F.col("id").alias("rule_id"), F.col("fact").alias("rf"), F.col("methods")[0].alias("m1"), F.col("methods")[1].alias("m2"), "tolerance", "min_confidence"))
    f = facts.join(r, (F.col("fact") == F.col("rf")) & ((F.col("method") == F.col("m1")) | (F.col("method") == F.col("m2"))))
    first = lambda m, c: F.min_by(F.when(F.col("method") == F.col(m), F.col(c)), F.when(F.col("method") == F.col(m), F.col("seq")))
    g = f.groupBy(*KEY, "rule_id", "tolerance", "min_confidence", "resource_url", F.coalesce("variant_key", F.lit("")).alias("variant_key")).agg(
        first("m1", "value").alias("value_1"), first("m2", "value").alias("value_2"), F.least(first("m1", "confidence"), first("m2", "confidence")).alias("confidence")
    )
    g = g.filter("value_1 is not null and value_2 is not null")
    x, y = F.col("value_1").try_cast("double"), F.col("value_2").try_cast("double")
    same = F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= F.col("tolerance")).otherwise(F.col("value_1") == F.col("value_2"))
    result = F.when(same, "pass").when(F.col("confidence") >= F.col("min_confidence"), "fail").otherwise("needs_review")
    return g.select(*KEY, "rule_id", "resource_url", "variant_key", "value_1", "value_2", result.alias("result"), "confidence")


def missing_facts(runs: DataFrame, facts: DataFrame, rules: DataFrame, credited: DataFrame | None = None) -> DataFrame:
    """Runs without any of a rule's facts (`fields`): (key, rule_id, result, confidence, n_facts, sample).

    A fact passes; then a crawl that failed (runs.failed) needs review, and a contact credit (credited: key) passes a rule
    of exactly mail and phone; else it fails. One row for each run and rule.
    """
    one = rules.select(F.col("id").alias("rule_id"), F.explode("fields").alias("field"))
    have = facts.join(small(one), F.col("fact") == F.col("field")).groupBy(*KEY, "rule_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", "seq").alias("sample"))
    contact = F.array_sort("fields") == F.array(F.lit("business.email"), F.lit("business.phone"))
    every = runs.select(*KEY, "failed").crossJoin(small(rules.select(F.col("id").alias("rule_id"), contact.alias("contact"))))
    j = every.join(have, [*KEY, "rule_id"], "left")
    j = j.withColumn("credit", F.lit(False)) if credited is None else j.join(credited.select(*KEY, F.lit(True).alias("credit")).distinct(), KEY, "left")
    credit = F.col("contact") & F.coalesce("credit", F.lit(False))
    n = F.coalesce("n", F.lit(0).cast("long"))
    result = F.when(F.col("failed"), "needs_review").when((n > 0) | credit, "pass").otherwise("fail")
    confidence = F.when(F.col("failed"), 0.0).when((n == 0) & credit, 0.8).otherwise(1.0)
    return j.select(*KEY, "rule_id", result.alias("result"), confidence.alias("confidence"), n.alias("n_facts"), "sample")


def missing_resource(runs: DataFrame, pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Whether a run has a page of the rule's resource_type: a genuine one passes; then soft 404, blocked, credited off domain, absent.

    (key, rule_id, resource_type, result, reason, confidence, n_pages). pages: key, page_type, reachable, soft_404,
    cannot_verify; runs: key, credited (types seen off the domain)[, failed]; a failed crawl always needs review.
    """
    r = small(rules.select(F.col("id").alias("rule_id"), "resource_type"))
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    of = pages.groupBy(*KEY, F.col("page_type").alias("resource_type")).agg(
        flag(F.col("reachable") & ~F.col("soft_404")).alias("genuine"), flag(F.col("reachable") & F.col("soft_404")).alias("soft"), flag(F.col("cannot_verify")).alias("blocked"), F.count(F.lit(1)).alias("n_pages")
    )
    failed = F.col("failed") if "failed" in runs.columns else F.lit(False)
    j = runs.select(*KEY, "credited", failed.alias("failed")).crossJoin(r).join(of, [*KEY, "resource_type"], "left")
    credit = F.array_contains("credited", F.col("resource_type"))
    reason = F.when(F.col("failed"), "crawl_failed").when(F.col("genuine"), "genuine").when(F.col("soft"), "soft_404").when(F.col("blocked"), "blocked").when(credit, "credited").otherwise("absent")
    by = lambda **given: F.create_map(*[F.lit(x) for kv in given.items() for x in kv])[F.col("reason")]
    result = by(crawl_failed="needs_review", genuine="pass", soft_404="needs_review", blocked="needs_review", credited="pass", absent="fail")
    confidence = by(crawl_failed=0.0, genuine=1.0, soft_404=0.5, blocked=0.3, credited=0.8, absent=1.0)
    return j.withColumn("reason", reason).select(*KEY, "rule_id", "resource_type", result.alias("result"), "reason", confidence.alias("confidence"), F.coalesce("n_pages", F.lit(0).cast("long")).alias("n_pages"))


def existing_checks(checks: dict[str, Callable[[DataFrame, DataFrame], DataFrame]], pages: DataFrame, runs: DataFrame, rules: DataFrame) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Rules that name a check: its findings (key, confidence[, page_url]) become evaluations (key, rule_id, resource_url, result, confidence).

    Checks come from a registry, never from text. A check that can't be planned stops no other: it is returned as
    (check, error), as is one that the registry doesn't know.
    """
    found, errors = [], []
    for row in rules.select("check").filter("check is not null").distinct().limit(SMALL).collect():
        name = row["check"]
        try:
            if name not in checks:
                raise KeyError("unknown check")
            f = checks[name](pages, runs)
            url = F.col("page_url") if "page_url" in f.columns else F.lit(None).cast("string")
            f = f.select(*KEY, F.lit(name).alias("check"), "confidence", url.alias("resource_url"))
            f.schema  # noqa: B018 - planned here, so that what is wrong shows here
            found.append(f)
        except (PySparkException, KeyError) as e:
            errors.append((name, str(e).split("\n")[0]))
    if not found:
        return None, errors
    by = lambda k: F.create_map(*[F.lit(x) for c, v in FINDING_RESULT.items() for x in (c, v[k])])[F.col("found_confidence")]
    all_ = reduce(DataFrame.unionByName, found).withColumnRenamed("confidence", "found_confidence")
    return all_.join(small(rules.select(F.col("id").alias("rule_id"), "check")), "check").select(*KEY, "rule_id", "resource_url", by(0).alias("result"), by(1).alias("confidence")), errors


def evaluate(rules: DataFrame, facts: DataFrame, pages: DataFrame, runs: DataFrame, registry: DataFrame, methods: list[str], checks: dict | None = None, contact: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(evaluations (key, rule_id, resource_url, result, confidence), errors (id, error)): every sound rule by the plan of its kind.

    Each kind of rule is one plan over all its rules. Rules with an error are left out before anything is planned, so
    they stop no other.
    """
    spark = rules.sparkSession
    # both are read by every plan
    errors = landed(rule_errors(rules, registry, methods), "rule-errors")
    good = landed(rules.join(errors.select("id").distinct(), "id", "left_anti"), "rules")
    of = lambda kind: good.filter(F.col("type") == kind)
    url = F.lit(None).cast("string").alias("resource_url")
    out = ["rule_id", "resource_url", "result", "confidence"]
    plans = {
        "cross_page_contradiction": lambda r: cross_page(facts, pages, r).select("*", url), "numeric_mismatch": lambda r: method_mismatch(facts, r), "all_missing": lambda r: missing_facts(runs, facts, r, contact).select("*", url),
        "missing_resource": lambda r: missing_resource(runs, pages, r).select("*", url),
    }
    kinds = [row["type"] for row in good.select("type").distinct().collect()]  # as many as RULE_FIELDS has
    parts = [plans[kind](of(kind)) for kind in sorted(kinds) if kind in plans]
    if "existing_check" in kinds:
        delegated, broken = existing_checks(checks or {}, pages, runs, of("existing_check"))
        parts += [] if delegated is None else [delegated]
        if broken:
            b = spark.createDataFrame(broken, "check string, error string")
            errors = errors.unionByName(of("existing_check").join(F.broadcast(b), "check").select("id", "error"))
    if not parts:
        none = spark.createDataFrame([], "rule_id string, resource_url string, result string, confidence double")
        return runs.select(*KEY).limit(0).crossJoin(none), errors
    return reduce(DataFrame.unionByName, [p.select(*KEY, *out) for p in parts]), errors


# Risk level and consequence of a finding by its severity, and of an advisory.
RISK_LEVEL = {"critical": "suspension_risk", "high": "serious_risk", "medium": "listing_disapproval", "low": "minor_issue"}
CONSEQUENCE = {
    "critical": "This may result in potential suspension risk for the whole Merchant Center account.",
    "high": "This may result in serious risk to the account or affected product listings, and could escalate toward suspension if left unresolved.",
    "medium": "This may result in likely disapproval of the affected product listing(s), or limited visibility/eligibility - not itself a suspension-level issue.",
    "low": "This is a minor issue - addressing it is recommended, but it is not tied to a known enforcement action.",
}
ADVISORY = "This is not a Google Merchant Center policy violation and does not affect the compliance status - it is a recommendation for customer clarity."
STATUS = {"critical": "CRITICAL", "high": "AT_RISK", "medium": "ACTION_REQUIRED", "low": "ACTION_REQUIRED"}


# Sentences about contradictions, pages that count as missing by reason, and facts without any value.
OBSERVED, NOT_OBSERVED, UNKNOWN_SOURCE = '%s shows "%s" (%s, %s, confidence %.2f)', "No comparable evidence recorded.", "unknown source"
MISSING_TEXT = {
    "crawl_failed": "Could not confirm either way - crawl_totally_failed.", "soft_404": "A page was found but could not be confirmed as genuine, distinct content: %2$s.",
    "blocked": "A likely %1$s page was found but could not be read: %2$s. This is not a confirmed absence - the page could not be verified, not shown to be missing.",
    "absent": "No reachable %1$s page was found anywhere on the site.",
}
ALL_MISSING = "None of the following were found anywhere on the site: %s."


def comparison_text(observations: Column) -> Column:
    """Both sides of a contradiction in words. observations: array of (label, value, source_url, method, confidence)."""
    one = lambda o: F.format_string(OBSERVED, F.coalesce(o["label"], o["method"], F.lit(UNKNOWN_SOURCE)), o["value"], o["source_url"], o["method"], o["confidence"])
    return F.when(F.coalesce(F.size(observations), F.lit(0)) > 0, F.array_join(F.transform(observations, one), "; ")).otherwise(NOT_OBSERVED)


def missing_text(reason: Column, resource_type: Column, urls: Column) -> Column:
    """Why a required page counts as missing, in words, by the reason of missing_resource and the pages it is about."""
    kind, named = F.coalesce(resource_type, F.lit("required")), F.array_join(urls, ", ")
    return F.coalesce(*[F.when(reason == r, F.format_string(text, kind, named)) for r, text in MISSING_TEXT.items()])


def all_missing_text(fields: Column) -> Column:
    return F.format_string(ALL_MISSING, F.array_join(fields, ", "))


def build_findings(evaluations: DataFrame, rules: DataFrame) -> DataFrame:
    """Evaluations that don't pass, with title, severity, risk_level, consequence and advisory of their rule; those of unknown rules are left out."""
    impact = F.col("impact") if "impact" in rules.columns else F.lit(None).cast("string")
    r = small(rules.select(F.col("id").alias("rule_id"), "title", "severity", F.coalesce(impact == "quality_improvement", F.lit(False)).alias("advisory")))
    by = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("severity")]
    f = evaluations.filter("result <> 'pass'").join(r, "rule_id")
    return f.withColumns({"risk_level": F.when(F.col("advisory"), "advisory").otherwise(by(RISK_LEVEL)), "consequence": F.when(F.col("advisory"), ADVISORY).otherwise(by(CONSEQUENCE))})


def snapshot_status(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """(key, status, n_findings): CRITICAL, AT_RISK, ACTION_REQUIRED or COMPLIANT by the worst finding; advisories don't count."""
    rank = F.when(~F.col("advisory"), F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("severity")])
    worst = findings.groupBy(*KEY).agg(F.min_by("severity", rank).alias("worst"), F.min(rank).alias("rank"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("rank").isNull(), "COMPLIANT").otherwise(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("worst")])
    return runs.select(*KEY).join(worst, KEY, "left").select(*KEY, status.alias("status"), F.coalesce("n", F.lit(0).cast("long")).alias("n_findings"))
