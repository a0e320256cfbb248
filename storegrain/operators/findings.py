"""Findings after the checks: impact, rollups, scores, matrices, fix lists, comparison of runs, evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storegrain.functions import facts as X
from storegrain.functions import urls as U
from storegrain.operators.rules import KEY, SEVERITY

# Points off per finding, smallest group that is rolled up, examples shown, policy areas in order.
SUSPENSION_POINTS = {"critical": 25, "high": 15, "medium": 8, "low": 4}
DISAPPROVAL_POINTS = {"critical": 10, "high": 5, "medium": 2, "low": 1}
QUALITY_POINTS = 0.5
# The lines of a score's breakdown: deductions in their order, findings left out, a clamped score, no deduction, no score.
DEDUCTION = {
    "suspension": "-%1$s: %2$d suspension-risk finding(s) at %3$s severity (%4$s pt each)", "disapproval": "-%1$s: %2$d listing-disapproval finding(s) at %3$s severity (%4$s pt each)",
    "quality": "-%1$s: %2$d quality-improvement finding(s) (%4$s pt each)",
}
EXCLUDED = "%d finding(s) excluded from scoring: cannot-verify (an unconfirmed issue doesn't move this score either way)."
CLAMPED = "Raw score before clamping: %d - %s to %d (score is always shown in the 0-100 range)."
NO_DEDUCTION = "No confirmed findings to deduct for - starting score of 100 stands."
NO_SCORE = 'This audit did not complete, so no risk score is meaningful - see "This Audit Could Not Run" above.'
LEAST_GROUP, EXAMPLES = 3, 5
AREAS = ["shipping_policy", "returns_refunds", "business_identity", "misrepresentation", "prohibited_content", "privacy_policy", "terms_of_service", "editorial_quality"]

# What makes findings of a check alike; checks that are not here are never rolled up.
STRATEGY = {
    "external_domain_link": "domain", "https_mixed_content_link": "href", "broken_image": "check", "product_image_broken": "check", "product_image_missing_alt_text": "check",
    "product_image_placeholder_filename": "check", "product_image_low_resolution": "check",
}
SITE_WIDE = "aggregated site-wide (see evidence for exact pages/images)"

# Checks by tier, with the policy whose text is the reason; other checks are a listing disapproval without one.
SUSPENSION_CHECKS = {
    "business_identity_present": "misrepresentation", "business_identity_email_consistency": "misrepresentation", "business_identity_phone_consistency": "misrepresentation",
    "business_identity_phone_country_mismatch": "misrepresentation", "required_page_present": "policies_general", "purchase_journey_cart_unreachable": "misrepresentation",
    "purchase_journey_checkout_unreachable": "misrepresentation", "purchase_journey_add_to_cart_failed": "misrepresentation", "contact_form_missing_field": "misrepresentation",
    "form_action_unreachable": "misrepresentation", "llm_prohibited_content": "prohibited_content", "llm_image_prohibited_content_flag": "prohibited_content",
    "llm_claim_policy_contradiction": "misrepresentation", "llm_policy_substance_privacy_policy": "policies_general", "llm_policy_substance_shipping_policy": "policies_general",
    "llm_policy_substance_returns_refunds": "policies_general", "llm_policy_substance_terms_of_service": "policies_general",
}
DISAPPROVAL_CHECKS = {
    "generic_product_price_missing": "shipping_policy", "generic_product_availability_missing": "shipping_policy", "woocommerce_price_mismatch": "shipping_policy", "woocommerce_stock_mismatch": "shipping_policy",
    "shopify_price_mismatch": "shipping_policy", "shopify_availability_mismatch": "shipping_policy", "purchase_journey_cart_price_mismatch": "shipping_policy", "purchase_journey_cart_price_not_found": "shipping_policy",
    "purchase_journey_shipping_not_shown": "shipping_policy", "purchase_journey_total_lower_than_product_price": "shipping_policy",
}
QUALITY_CHECKS = {"llm_editorial_quality": "editorial_quality", "duplicate_product_listing": "editorial_quality"}
# The public help pages of those policies.
CITATIONS = {
    "misrepresentation": "support.google.com/merchants/answer/6150127", "prohibited_content": "support.google.com/merchants/answer/6149970", "shipping_policy": "support.google.com/merchants/answer/6324484",
    "editorial_quality": "support.google.com/merchants/answer/12079604", "policies_general": "support.google.com/merchants/answer/13693195",
}
# The area of the policy matrix that a check belongs to, and of required pages by words of the title, in order.
CHECK_AREAS = {
    "business_identity_present": "business_identity", "business_identity_email_consistency": "business_identity", "business_identity_phone_consistency": "business_identity",
    "business_identity_phone_country_mismatch": "business_identity", "contact_form_missing_field": "business_identity", "form_action_unreachable": "business_identity",
    "external_domain_link": "misrepresentation", "purchase_journey_cart_unreachable": "misrepresentation", "purchase_journey_checkout_unreachable": "misrepresentation",
    "purchase_journey_add_to_cart_failed": "misrepresentation", "purchase_journey_blocked_ssrf": "misrepresentation", "llm_prohibited_content": "prohibited_content",
    "llm_image_prohibited_content_flag": "prohibited_content", "llm_claim_policy_contradiction": "misrepresentation", "llm_editorial_quality": "editorial_quality",
    "duplicate_product_listing": "editorial_quality", "generic_product_price_missing": "shipping_policy", "generic_product_availability_missing": "shipping_policy",
    "woocommerce_price_mismatch": "shipping_policy", "woocommerce_stock_mismatch": "shipping_policy", "shopify_price_mismatch": "shipping_policy", "shopify_availability_mismatch": "shipping_policy",
    "purchase_journey_cart_price_mismatch": "shipping_policy", "purchase_journey_cart_price_not_found": "shipping_policy", "purchase_journey_shipping_not_shown": "shipping_policy",
    "purchase_journey_total_lower_than_product_price": "shipping_policy",
}
TITLE_AREAS = [("privacy", "privacy_policy"), ("shipping", "shipping_policy"), ("return", "returns_refunds"), ("refund", "returns_refunds"), ("terms", "terms_of_service"), ("contact", "business_identity")]
# The columns of the export, in order.
EXPORT = [
    "check_id", "title", "severity", "confidence", "page_url", "evidence", "location", "policy_reference", "recommended_fix", "impact_tier", "ads_eligibility_impact", "verification_method",
    "evidence_verified", "detected_at", "screenshot_path",
]


def looked_up(key: Column, table: dict) -> Column:
    """table[key], null where it is not there."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def severity_rank(severity: Column) -> Column:
    return looked_up(severity, SEVERITY)


def is_suspension_risk(severity: Column, tier: Column, confidence: Column) -> Column:
    return (confidence != "cannot_verify") & ((severity == "critical") | (tier == "suspension_risk"))


def with_impact(findings: DataFrame) -> DataFrame:
    """findings (check_id, title) with impact_tier, citation, policy_area and ads_eligibility_impact.

    The area of a policy substance check is in its id, that of a required page in its title.
    """
    c = F.col("check_id")
    tier = F.when(c.isin(*SUSPENSION_CHECKS), "suspension_risk").when(c.isin(*QUALITY_CHECKS), "quality_improvement").otherwise("listing_disapproval")
    citation = looked_up(looked_up(c, SUSPENSION_CHECKS | DISAPPROVAL_CHECKS | QUALITY_CHECKS), CITATIONS)
    title = F.lower("title")
    by_title = F.coalesce(*[F.when(F.contains(title, F.lit(word)), area) for word, area in TITLE_AREAS])
    substance = F.regexp_extract(c, "^llm_policy_substance_(.*)$", 1)
    area = F.when(c.startswith("llm_policy_substance_"), substance).when(c == "required_page_present", by_title).otherwise(looked_up(c, CHECK_AREAS))
    out = findings.withColumns({"impact_tier": tier, "citation": citation, "policy_area": area})
    return out.withColumn("ads_eligibility_impact", F.when(F.col("policy_area").isin(AREAS), "ads_and_listings").otherwise("unclear"))


# The evidence of a rolled-up finding by what makes its findings alike, and how it says that examples are left out.
EVIDENCE = {"domain": "Link(s) to %s found on %d page(s): %s", "href": "Link to %s found on %d page(s): %s", "check": "%s - %d instance(s) across %d page(s), including: %s"}
MORE = ", and %d more"
#: What findings of one group share.
GROUP = [*KEY, "check_id", "how", "value"]


def rolled_up(findings: DataFrame) -> DataFrame:
    """Groups of LEAST_GROUP and more like findings as one row, where their check has a strategy and as many findings; all others as they are.

    findings: key, seq, check_id, title, severity, confidence, page_url, evidence, location. The result also has n,
    the findings that a row stands for, and n_pages, their distinct pages. What makes findings alike is the link or the
    domain in their location, or the check alone; without a link a finding stays. Evidence names the first distinct
    examples by seq and how many more there are. Counts are aggregated in parts, so a check that fires everywhere is no
    burden to one task.
    """
    return rolled_from(finding_parts(findings), findings)


def _grouped(findings: DataFrame) -> DataFrame:
    """findings with how and value, what makes them alike, and the example that each is."""
    href, src = (F.nullif(F.regexp_extract("location", f'{a}="([^"]*)"', 1), F.lit("")) for a in ("href", "src"))
    how = looked_up(F.col("check_id"), STRATEGY)
    domain = F.nullif(F.regexp_extract(href, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit(""))
    value = F.when(how == "href", href).when(how == "domain", domain).when(how == "check", F.lit(""))
    pair = F.format_string("%s (on %s)", F.coalesce(src, F.nullif("location", F.lit("")), F.lit("?")), F.coalesce("page_url", F.lit("unknown page")))
    return findings.withColumns({"how": how, "value": value}).withColumn("example", F.when(F.col("how") == "check", pair).otherwise(F.col("page_url")))


def finding_parts(findings: DataFrame) -> DataFrame:
    """What a batch of findings adds to their groups: (key, check_id, how, value, page_url, example, n, seq, first). Parts of several batches add up."""
    first = F.min_by(F.struct("title", "severity", "confidence"), "seq")
    return _grouped(findings).filter("how is not null").groupBy(*GROUP, "page_url", "example").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"), first.alias("first"))


def merged_parts(parts: DataFrame) -> DataFrame:
    """Parts of several batches as one for each group, page and example."""
    return parts.groupBy(*GROUP, "page_url", "example").agg(F.sum("n").alias("n"), F.min("seq").alias("s"), F.min_by("first", "seq").alias("first")).withColumnRenamed("s", "seq")


def rolled_from(parts: DataFrame, findings: DataFrame) -> DataFrame:
    """rolled_up from the parts of all findings; of findings only those of small groups and those without a group appear."""
    f, g = _grouped(findings), GROUP
    checks = parts.groupBy(*KEY, F.col("check_id").alias("c")).agg(F.sum("n").alias("of_check")).filter(F.col("of_check") >= LEAST_GROUP)
    groups = parts.filter("value is not null").groupBy(*g).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("page_url").isNotNull(), F.col("n")).otherwise(0)).alias("with_page"), F.count_distinct("page_url").alias("n_pages"), F.count_distinct("example").alias("n_examples"),
        F.min("seq").alias("seq"), F.min_by("first", "seq").alias("first"),
    )
    big = groups.filter(F.col("n") >= LEAST_GROUP).join(checks, (F.col("check_id") == F.col("c")) & (checks.store_id == groups.store_id) & (checks.run_id == groups.run_id), "left_semi")
    w = Window.partitionBy(*g).orderBy("seq", "example")
    firsts = parts.filter("example is not null").groupBy(*g, "example").agg(F.min("seq").alias("seq")).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= EXAMPLES)
    firsts = firsts.groupBy(*g).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "example"))), lambda x: x["example"]), ", ").alias("shown"))
    r = big.join(firsts, g, "left")
    more = F.when(F.col("n_examples") > EXAMPLES, F.format_string(MORE, F.col("n_examples") - EXAMPLES)).otherwise("")
    shown = F.concat(F.coalesce("shown", F.lit("")), more)
    evidence = (
        F.when(F.col("how") == "domain", F.format_string(EVIDENCE["domain"], "value", "n_pages", shown))
        .when(F.col("how") == "href", F.format_string(EVIDENCE["href"], "value", "with_page", shown))
        .otherwise(F.format_string(EVIDENCE["check"], "first.title", "n", "n_pages", shown))
    )
    location = F.when(F.col("how") == "domain", F.format_string('a[href*="%s"]', "value")).when(F.col("how") == "href", F.format_string('a[href="%s"]', "value")).otherwise(SITE_WIDE)
    text = F.lit(None).cast("string")
    rolled = r.select(*KEY, "seq", "check_id", "first.*", text.alias("page_url"), evidence.alias("evidence"), location.alias("location"), "n", "n_pages")
    one = F.when(F.col("page_url").isNotNull(), 1).otherwise(0).cast("long")
    single = f.join(big.select(*g), g, "left_anti").select(*KEY, "seq", "check_id", "title", "severity", "confidence", "page_url", "evidence", "location", F.lit(1).cast("long").alias("n"), one.alias("n_pages"))
    return rolled.unionByName(single)


def score_counts(findings: DataFrame) -> DataFrame:
    """(key, kind, severity, n): findings by what they cost, as counts that can be added up: suspension, disapproval, quality, other, or excluded as not confirmed."""
    c = F.col
    risk = is_suspension_risk(c("severity"), c("impact_tier"), c("confidence"))
    kind = F.when(c("confidence") == "cannot_verify", "excluded").when(risk, "suspension").when(c("impact_tier") == "listing_disapproval", "disapproval").when(c("impact_tier") == "quality_improvement", "quality").otherwise("other")
    return findings.groupBy(*KEY, kind.alias("kind"), "severity").agg(F.count(F.lit(1)).alias("n"))


def score_of(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, score, rating, breakdown) from score_counts, of several batches too: 100 less the points of confirmed findings, rounded half to even and clamped.

    The breakdown names each deduction, the findings that are left out and a clamped score. Failed runs have no score, N/A, and say why.
    """
    n, rank, number = F.sum("n"), severity_rank(F.col("severity")), lambda x: F.regexp_replace(x.cast("decimal(38,1)").cast("string"), r"\.0$", "")
    each = looked_up(F.concat_ws(" ", "kind", "severity"), {f"{k} {sev}": float(v) for k, t in (("suspension", SUSPENSION_POINTS), ("disapproval", DISAPPROVAL_POINTS)) for sev, v in t.items()} | {f"quality {sev}": QUALITY_POINTS for sev in SEVERITY})
    # a quality finding costs the same at any severity
    level = F.when(F.col("kind").isin("suspension", "disapproval"), F.col("severity"))
    per = counts.withColumn("each", F.coalesce(each, F.lit(0.0))).groupBy(*KEY, "kind", level.alias("level"), "each").agg(n.alias("n"), F.min(rank).alias("rank"))
    off = F.col("n") * F.col("each")
    line = F.printf(looked_up(F.col("kind"), DEDUCTION), number(off), F.col("n"), F.coalesce("level", F.lit("")), number(F.col("each")))
    line = F.when(F.col("kind") == "excluded", F.format_string(EXCLUDED, "n")).otherwise(F.trim(line))
    place = F.struct(looked_up(F.col("kind"), {k: i for i, k in enumerate([*DEDUCTION, "excluded"])}).alias("k"), F.col("rank"), line.alias("line"))
    per = per.groupBy(*KEY).agg(
        F.sum(off).alias("off"), F.bool_or((F.col("kind") == "suspension") & (F.col("level") == "critical")).alias("critical"), F.sort_array(F.collect_list(F.when((F.col("each") > 0) | (F.col("kind") == "excluded"), place))).alias("lines")
    )  # a line for each kind and severity at most
    j = runs.select(*KEY, "failed").join(per, KEY, "left")
    raw = F.bround(100 - F.coalesce("off", F.lit(0.0)), 0).cast("int")
    j = j.withColumns({"raw": raw, "score": F.when(~F.col("failed"), F.greatest(F.lit(0), F.least(F.lit(100), raw)))})
    rating = F.when(F.col("failed"), "N/A").when(F.coalesce("critical", F.lit(False)) | (F.col("score") < 50), "HIGH").when(F.col("score") < 80, "MEDIUM").otherwise("LOW")
    lines = F.transform(F.coalesce("lines", F.array().cast(j.schema["lines"].dataType)), lambda x: x["line"])
    cost = F.coalesce(F.exists("lines", lambda x: x["k"] < len(DEDUCTION)), F.lit(False))
    clamp = F.when(F.col("raw") != F.col("score"), F.format_string(CLAMPED, F.col("raw"), F.when(F.col("score") == 0, "floored").otherwise("capped"), F.col("score")))
    text = F.when(F.col("failed"), F.array(F.lit(NO_SCORE))).otherwise(F.array_compact(F.concat(F.array(F.when(~cost, NO_DEDUCTION)), lines, F.array(clamp))))
    return j.select(*KEY, "score", rating.alias("rating"), text.alias("breakdown"))


def risk_score(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """(key, score, rating, breakdown) of each run; see score_of."""
    return score_of(runs, score_counts(findings))


def policy_matrix(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """(key, policy_area, status, n, worst_title) for each of the areas: Fail, At Risk, Cannot Verify or Pass."""
    per = findings.groupBy(*KEY, "policy_area").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or((F.col("confidence") != "cannot_verify") & F.col("severity").isin("critical", "high")).alias("fail"), F.bool_or(F.col("confidence") != "cannot_verify").alias("risk"),
        F.min_by("title", F.struct(severity_rank(F.col("severity")), "seq")).alias("worst_title"),
    )
    every = runs.select(*KEY, F.explode(F.array(*map(F.lit, AREAS))).alias("policy_area"))
    status = F.when(F.col("fail"), "Fail").when(F.col("risk"), "At Risk").when(F.col("n") > 0, "Cannot Verify").otherwise("Pass")
    return every.join(per, [*KEY, "policy_area"], "left").select(*KEY, "policy_area", status.alias("status"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "worst_title")


def run_summary(findings: DataFrame) -> DataFrame:
    """Counts of a run's findings: all, by severity, suspension risk, unverified, API-verified where the method is known, pages."""
    risk = is_suspension_risk(F.col("severity"), F.col("impact_tier"), F.col("confidence"))
    by = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITY]
    api = [F.count_if(F.col("verification_method") == "api_verified").alias("n_api_verified")] if "verification_method" in findings.columns else []
    return findings.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_findings"), *by, F.count_if(risk).alias("n_suspension_risk"), F.count_if(F.col("confidence") == "cannot_verify").alias("n_unverified"), *api, F.countDistinct("page_url").alias("n_pages"))


def crawl_summary(pages: DataFrame) -> DataFrame:
    """(key, n_pages, n_reachable, n_broken, n_unverifiable, reasons) of pages (reachable, cannot_verify, failure_category).

    reasons counts the categories of unverifiable pages, the most frequent first, of equal ones by name.
    """
    n = pages.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_pages"), F.count_if("reachable").alias("n_reachable"), F.count_if(~F.col("reachable") & ~F.col("cannot_verify")).alias("n_broken"), F.count_if("cannot_verify").alias("n_unverifiable"))
    by = pages.filter("cannot_verify").groupBy(*KEY, F.coalesce("failure_category", F.lit("unknown")).alias("category")).agg(F.count(F.lit(1)).alias("k"))
    # as many as there are categories
    reasons = by.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("m"), "category"))).alias("r")).select(*KEY, F.array_join(F.transform("r", lambda x: F.concat_ws(" ", (-x["m"]).cast("string"), x["category"])), ", ").alias("reasons"))
    return n.join(reasons, KEY, "left")


def page_status(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """(key, url, status, n_major, n_minor): CANNOT VERIFY, UNREACHABLE, RISK or PASS.

    A page that loads is at risk by a critical or high finding; else one finding that couldn't be verified makes it
    CANNOT VERIFY, and any other finding RISK. n_major and n_minor count suspension risks and all others.
    """
    risk = is_suspension_risk(F.col("severity"), F.col("impact_tier"), F.col("confidence"))
    per = findings.groupBy(*KEY, F.col("page_url").alias("url")).agg(
        F.count_if(risk).alias("n_major"), F.count_if(~risk).alias("n_minor"), F.bool_or(F.col("severity").isin("critical", "high")).alias("bad"), F.bool_or(F.col("confidence") == "cannot_verify").alias("unsure")
    )
    j = pages.select(*KEY, "url", "reachable", "cannot_verify").join(per, [*KEY, "url"], "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_major", "n_minor")})
    status = F.when(F.col("cannot_verify"), "CANNOT VERIFY").when(~F.col("reachable"), "UNREACHABLE").when(F.col("bad"), "RISK").when(F.col("unsure"), "CANNOT VERIFY").when(F.col("n_major") + F.col("n_minor") > 0, "RISK").otherwise("PASS")
    return j.select(*KEY, "url", status.alias("status"), "n_major", "n_minor")


def is_catalog_page(page_type: Column) -> Column:
    return page_type.isin("product", "collection")


def catalog_rollup(pages: DataFrame, findings: DataFrame, major_only: bool = True) -> DataFrame:
    """(key, page_group, variants, representative, n_shown, n_hidden, state) of catalog pages by canonical page key.

    The representative is the shortest URL, of equal ones the first by seq. Shown are the suspension risks, or with
    major_only=False all findings; state is flagged if there are any, other if all are hidden, else clean.
    """
    shown = is_suspension_risk(F.col("severity"), F.col("impact_tier"), F.col("confidence")) if major_only else F.lit(True)
    per = findings.groupBy(*KEY, F.col("page_url").alias("url")).agg(F.count_if(shown).alias("n_shown"), F.count_if(~shown).alias("n_hidden"))
    p = pages.filter(is_catalog_page(F.col("page_type"))).select(*KEY, "url", "seq").join(per, [*KEY, "url"], "left")
    g = p.groupBy(*KEY, U.page_key(F.col("url")).alias("page_group")).agg(
        F.count(F.lit(1)).alias("variants"), F.min_by("url", F.struct(F.char_length("url"), "seq")).alias("representative"), F.sum(F.coalesce("n_shown", F.lit(0))).cast("long").alias("n_shown"), F.sum(F.coalesce("n_hidden", F.lit(0))).cast("long").alias("n_hidden")
    )
    return g.withColumn("state", F.when(F.col("n_shown") > 0, "flagged").when(F.col("n_hidden") > 0, "other").otherwise("clean"))


def catalog_counts(rollup: DataFrame) -> DataFrame:
    """(key, n_groups, n_pages, n_flagged, n_other, n_clean, n_hidden): n_hidden counts the findings of groups that show none."""
    n = lambda state: F.count_if(F.col("state") == state)
    return rollup.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("variants").alias("n_pages"), n("flagged").alias("n_flagged"), n("other").alias("n_other"), n("clean").alias("n_clean"), F.sum(F.when(F.col("state") == "other", F.col("n_hidden")).otherwise(0)).alias("n_hidden"))


def needs_api(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """(key, recommended): WooCommerce runs (platform) without a finding that the platform's API verified."""
    n = findings.groupBy(*KEY).agg(F.count_if(F.col("verification_method") == "api_verified").alias("n"))
    return runs.select(*KEY, "platform").join(n, KEY, "left").select(*KEY, ((F.col("platform") == "woocommerce") & (F.coalesce("n", F.lit(0)) == 0)).alias("recommended"))


def fix_list(findings: DataFrame, most: int | None = None) -> DataFrame:
    """(key, position, check_id, fix, severity): suspension-risk findings, the first of each check and fix, worst first."""
    f = findings.filter(is_suspension_risk(F.col("severity"), F.col("impact_tier"), F.col("confidence"))).withColumn("rank", severity_rank(F.col("severity")))
    first = f.groupBy(*KEY, "check_id", "fix").agg(F.min_by(F.struct("rank", "seq", "severity"), F.struct("rank", "seq")).alias("b"))
    w = Window.partitionBy(*KEY).orderBy("b.rank", "b.seq", "check_id", "fix")
    out = first.withColumn("position", F.row_number().over(w)).select(*KEY, "position", "check_id", "fix", F.col("b.severity").alias("severity"))
    return out if most is None else out.filter(F.col("position") <= most)


def delta(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """(by, change, severity_old, severity_new) of two runs of findings (by, seq, evidence, severity). Of equal keys the last row counts."""
    last = lambda df, s: df.groupBy(*by).agg(F.max_by(F.struct("evidence", "severity"), "seq").alias(s))
    j = last(old, "o").join(last(new, "n"), by, "full_outer")
    same = F.col("o.evidence").eqNullSafe(F.col("n.evidence")) & F.col("o.severity").eqNullSafe(F.col("n.severity"))
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "resolved").when(same, "unchanged").otherwise("changed")
    return j.select(*by, change.alias("change"), F.col("o.severity").alias("severity_old"), F.col("n.severity").alias("severity_new"))


def cited_pages(evaluations: DataFrame, pages: DataFrame) -> DataFrame:
    """(key, rule_id, url): pages an evaluation cites, by its own resource, its observations, or URLs in its text."""
    found = F.transform(F.regexp_extract_all("text", F.lit(r"https?://[^\s,;()]+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:)]+$", ""))
    all_ = F.array_compact(F.concat(F.array("resource_url"), F.coalesce("observed", F.array().cast("array<string>")), F.coalesce(found, F.array().cast("array<string>"))))
    c = evaluations.select(*KEY, "rule_id", F.explode(F.array_distinct(all_)).alias("url"))
    return c.join(pages.select(*KEY, "url"), [*KEY, "url"], "left_semi").select(*KEY, "rule_id", "url")


def kept_bodies(pages: DataFrame, cited: DataFrame, keep_all: bool = False) -> DataFrame:
    """pages whose body stays: the cited ones, or all."""
    return pages if keep_all else pages.join(cited.select(*KEY, "url").distinct(), [*KEY, "url"], "left_semi")


def quote_stands(quote: Column, text: Column) -> Column:
    """Whether a quote is on a page, but for case, white space and entities. A null or blank quote claims nothing, so it stands."""
    q = X.quote_text(F.coalesce(quote, F.lit("")))
    return (q == "") | F.coalesce(F.contains(X.quote_text(text), q), F.lit(False))


def reconciled(regex: DataFrame, model: DataFrame, pages: DataFrame) -> DataFrame:
    """Facts of regex candidates and model answers (key, url, fact, value[, quote, confidence]).

    The model's value counts: agreement gives regex_llm_agree at 0.95, else its confidence is taken within 0 and 1. A model
    null, or a quote that isn't on the page, gives no fact; a blank quote claims nothing. Facts the model wasn't asked
    about stay as they are.
    """
    on = [*KEY, "url", "fact"]
    m = model.select(*on, F.col("value").alias("m_value"), "quote", F.col("confidence").alias("m_conf"), F.lit(True).alias("asked"))
    j = regex.select(*on, "value", F.col("confidence").alias("r_conf")).join(m, on, "full_outer").join(pages.select(*KEY, "url", "text"), [*KEY, "url"], "left")
    gone = F.col("asked") & (F.col("m_value").isNull() | ~quote_stands(F.col("quote"), F.col("text")))
    agree = X.same_value(F.col("fact"), F.col("value"), F.col("m_value"))
    j = j.filter(~F.coalesce(gone, F.lit(False)))
    pick = lambda alone, both, other: F.when(F.col("asked").isNull(), alone).when(F.coalesce(agree, F.lit(False)), both).otherwise(other)
    return j.select(*on, pick(F.col("value"), F.col("m_value"), F.col("m_value")).alias("value"), pick(F.lit("regex"), F.lit("regex_llm_agree"), F.lit("llm")).alias("method"), pick(F.col("r_conf"), F.lit(0.95), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("m_conf")))).alias("confidence"))


def verdict_findings(verdicts: DataFrame, pages: DataFrame) -> DataFrame:
    """(key, url, check_id, confidence, evidence_verified) of flagged model verdicts; with a quote that isn't on the page they are no longer confirmed, but a potential risk.

    Contradictions without a dimension or a policy quote, or with the same day counts on both sides, are left out.
    """
    j = verdicts.filter("flagged").join(pages.select(*KEY, "url", "text"), [*KEY, "url"], "left")
    ok = quote_stands(F.col("evidence_quote"), F.col("text"))
    counts = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+)\s*(?:business\s+)?days?"), F.lit(1))))
    same_days = (F.size(counts("evidence_quote")) > 0) & (counts("evidence_quote") == counts("policy_quote"))
    bad = (F.col("check_id") == "llm_claim_policy_contradiction") & (F.col("conflict_dimension").isNull() | (F.col("conflict_dimension") == "none") | F.col("policy_quote").isNull() | F.coalesce(same_days, F.lit(False)))
    return j.filter(~bad).select(*KEY, "url", "check_id", F.when(~ok & (F.col("confidence") == "confirmed"), "potential_risk").otherwise(F.col("confidence")).alias("confidence"), ok.alias("evidence_verified"))


def image_findings(images: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(key, url, image_url, check_id, severity): one verdict of an image counts for every page that shows it."""
    j = images.select(*KEY, "url", "image_url").join(verdicts, "image_url", "left")
    one = lambda check, severity: F.struct(F.lit(check).alias("check_id"), F.lit(severity).alias("severity"))
    found = F.array_compact(F.array(F.when(F.col("plausible_match").isNull(), one("llm_image_vision_check", "low")), F.when(~F.col("plausible_match"), one("llm_image_product_mismatch", "medium")), F.when(F.col("potentially_prohibited"), one("llm_image_prohibited_content_flag", "high"))))
    return j.select(*KEY, "url", "image_url", F.explode(found).alias("f")).select(*KEY, "url", "image_url", "f.*")


def union_all(*frames: DataFrame) -> DataFrame:
    """Findings of all checks, with the check's place as branch, so that their order can be had again."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("branch", F.lit(k)) for k, f in enumerate(frames)])


def export_rows(findings: DataFrame) -> DataFrame:
    """The columns of the export, in order, as text; null is empty, and a column that findings lacks is null."""
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if dict(findings.dtypes).get(c) == "timestamp" else F.col(c).cast("string")
    return findings.select(*[F.coalesce(at(c), F.lit("")).alias(c) if c in findings.columns else F.lit("").alias(c) for c in EXPORT])


def export_csv(findings: DataFrame, path: str) -> None:
    """One line a finding, not rolled up."""
    export_rows(findings).write.csv(path, header=True, mode="overwrite")
