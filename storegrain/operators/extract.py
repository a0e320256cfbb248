"""The fact extraction job: pages to facts, in one wide projection and one explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storegrain.functions import facts as X
from storegrain.operators.checks import IDENTITY_PAGES
from storegrain.operators.rules import KEY

# Methods with their confidence, pages that identify a business, headings that name none, suffixes of companies.
CONFIDENCE = {
    "platform_api": 0.98, "jsonld": 0.95, "regex_llm_agree": 0.95, "business_identity_regex": 0.90, "llm": 0.75, "shipping_time_regex": 0.80, "return_window_regex": 0.80, "shipping_cost_regex": 0.80,
    "shipping_region_regex": 0.80, "copyright_footer_regex": 0.75, "legal_suffix_regex": 0.75, "heading_heuristic": 0.75, "refund_terms_keyword_classifier": 0.70, "return_cost_keyword_classifier": 0.70,
    "payment_methods_keyword_regex": 0.70, "visible_price_regex": 0.70, "visible_availability_heuristic": 0.65, "calling_code_cross_reference": 0.60, "address_text_country_regex": 0.60,
}
HEADING_PAGES = ["homepage", "contact_about"]
GENERIC_HEADINGS = ["contact us", "about us", "about", "contact", "get in touch", "our story"]
SUFFIX = r"(?:Inc\.?|L\.?L\.?C\.?|Ltd\.?|GmbH|Pty\.?\s?Ltd\.?|Corp\.?|Corporation|Co\.?)"
OPERATED = rf"(?i)(?:operated by|is a service of|is owned by)\s+([A-Z][\w&',.\- ]{{1,60}}?{SUFFIX})"
COPYRIGHT = rf"(?i)(?:©|\(c\)|copyright)\s*(?:\d{{4}}\s*)?([A-Z][\w&',.\- ]{{1,60}}?{SUFFIX}?)(?=[.,\n]|\s+all rights reserved|$)"

FACT = "struct<fact:string,value:string,method:string,confidence:double>"


def confidence(method: Column) -> Column:
    """The method's base confidence; null for an unknown method, which unknown_methods finds."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), method)


def unknown_methods(facts: DataFrame) -> DataFrame:
    known = facts.sparkSession.createDataFrame([(m,) for m in CONFIDENCE], "method string")
    return facts.join(F.broadcast(known), "method", "left_anti")  # fewer than 20 rows


def _fact(name: str, value: Column, method: str) -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit(name).alias("fact"), value.cast("string").alias("value"), F.lit(method).alias("method"), F.lit(CONFIDENCE[method]).alias("confidence")))


def _each(name: str, values: Column, method: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(name).alias("fact"), v.alias("value"), F.lit(method).alias("method"), F.lit(CONFIDENCE[method]).alias("confidence")))


def _of(name: str, values: Column, method: Column) -> Column:
    """The same where the method follows from the text."""
    return F.transform(values, lambda v: F.struct(F.lit(name).alias("fact"), v.alias("value"), method.alias("method"), confidence(method).alias("confidence")))


def extract_facts(pages: DataFrame) -> DataFrame:
    """Facts (key, seq, resource_url, fact, value, method, confidence, variant_key) of pages (key, seq, url, page_type, headings, text[, reachable]).

    Pages that didn't load or have no text have none. Contacts, countries and names are looked for on identity pages
    only, each commerce fact on its own page types. Of the operator's name and the copyright line the first names the
    company, with its suffix as legal entity and without it as name; a heading of up to 60 characters does on the home
    and contact pages, unless it is a generic one.
    """
    p = pages.filter("text <> ''").filter(F.col("reachable") if "reachable" in pages.columns else F.lit(True))
    t, kind = F.col("text"), F.col("page_type")
    none = F.array().cast("array<string>")
    on = lambda fact, value: F.when(kind.isin(X.GATES[fact]), value)
    own = lambda values: F.when(kind.isin(IDENTITY_PAGES), values).otherwise(none)
    operated, copyright_ = (F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")) for pattern in (OPERATED, COPYRIGHT))
    said = F.when(kind.isin(IDENTITY_PAGES), F.trim(F.regexp_replace(F.coalesce(operated, copyright_), r"(?U)\s+", " ")))
    method = F.when(operated.isNotNull(), "legal_suffix_regex").otherwise("copyright_footer_regex")
    ends = rf"(?i)^(.+?)[,\s]+{SUFFIX}\.?\s*$"
    entity = F.when(F.rlike(said, F.lit(ends)), said)
    name = F.when(entity.isNotNull(), F.trim(F.regexp_extract(said, ends, 1))).otherwise(said)
    heading = F.when(kind.isin(HEADING_PAGES), F.get(F.filter(F.transform("headings", lambda h: F.trim(h)), lambda h: (h != "") & ~F.lower(h).isin(GENERIC_HEADINGS) & (F.char_length(h) <= 60)), F.lit(0)))
    # one look at the text for a sign of each contact before its pattern runs
    phones = own(F.when(F.rlike(t, F.lit(r"\d")), X.phones(t)).otherwise(none))
    emails = own(F.when(F.contains(t, F.lit("@")), X.emails(t)).otherwise(none))
    first = F.create_map(*[x for k, v in X.CALLING_CODES.items() for x in (F.lit(k), F.lit(v[0]))])
    by_phone = F.filter(F.transform(phones, lambda v: F.try_element_at(first, X.calling_code(v))), lambda c: c.isNotNull())
    cost = on("shipping.cost", X.shipping_cost(t))
    single = F.array(
        _fact("business.name", heading, "heading_heuristic"), _fact("shipping.region", on("shipping.region", X.shipping_region(t)), "shipping_region_regex"),
        _fact("shipping.cost_amount", cost["amount"], "shipping_cost_regex"), _fact("shipping.cost_currency", cost["currency"], "shipping_cost_regex"),
        _fact("shipping.processing_days", on("shipping.processing_days", X.keyword_days(t, X.PROCESSING)), "shipping_time_regex"), _fact("shipping.delivery_days", on("shipping.delivery_days", X.keyword_days(t, X.DELIVERY)), "shipping_time_regex"),
        _fact("return.window_days", on("return.window_days", X.return_window(t)), "return_window_regex"), _fact("return.refund_terms", on("return.refund_terms", X.first_class(t, X.REFUND_TERMS)), "refund_terms_keyword_classifier"),
        _fact("return.cost_responsibility", on("return.cost", X.first_class(t, X.RETURN_COST)), "return_cost_keyword_classifier"), _fact("payment.methods", on("payment.methods", X.payment_methods(t)), "payment_methods_keyword_regex"),
    )
    several = [
        _each("business.email", emails, "business_identity_regex"), _each("business.phone", phones, "business_identity_regex"), _each("business.address", own(X.addresses(t)), "business_identity_regex"),
        _each("business.address_country", own(X.countries(t)), "address_text_country_regex"), _each("business.address_country", by_phone, "calling_code_cross_reference"),
        _of("business.legal_entity", F.array_compact(F.array(entity)), method), _of("business.name", F.array_compact(F.array(name)), method),
    ]
    found = p.select(*KEY, F.col("seq").alias("page_seq"), F.col("url").alias("resource_url"), F.posexplode(F.concat(*several, F.array_compact(single))).alias("k", "f"))
    return found.select(*KEY, F.struct("page_seq", "k").alias("seq"), "resource_url", "f.*", F.lit(None).cast("string").alias("variant_key"))


def product_facts(offers: DataFrame, method: str) -> DataFrame:
    """The same rows of offers (key, seq, url, variant_key, price, currency, availability, condition, brand, gtin, mpn, sku), one for each value that is there.

    method: jsonld for structured data of pages, platform_api for what a platform told.
    """
    names = {"product.price_amount": "price", "product.price_currency": "currency", "product.availability": "availability", "product.condition": "condition", "product.brand": "brand", "product.gtin": "gtin", "product.mpn": "mpn", "product.sku": "sku"}
    all_ = F.array_compact(F.array(*[_fact(fact, F.col(c), method) for fact, c in names.items()]))
    at = F.col("k") if "k" in offers.columns else F.lit(0)
    found = offers.select(*KEY, F.col("seq").alias("page_seq"), at.alias("at"), F.col("url").alias("resource_url"), "variant_key", F.posexplode(all_).alias("k", "f"))
    return found.select(*KEY, F.struct("page_seq", (1000 + 10 * F.col("at") + F.col("k")).alias("k")).alias("seq"), "resource_url", "f.*", "variant_key")


def all_facts(pages: DataFrame, structured: DataFrame, platform: DataFrame | None = None) -> DataFrame:
    """What all extractors find: texts, structured data, and the platform's products matched to pages."""
    out = extract_facts(pages).unionByName(product_facts(structured, "jsonld"))
    return out if platform is None else out.unionByName(product_facts(platform, "platform_api"))
