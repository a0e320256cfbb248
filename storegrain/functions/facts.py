"""What merchants state in text, as Column expressions: contacts, money, days, identifiers, policy classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of mail addresses, phone numbers and street addresses.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?<!\d)(\+?\d[\d\s().-]{7,}\d)(?!\d)"
ADDRESS = r"(?i)\b\d{1,6}\s+[A-Za-z0-9.,'\s]{3,60}\b(street|st\.|avenue|ave\.|road|rd\.|boulevard|blvd\.|drive|dr\.|lane|ln\.|suite|floor|way|court|ct\.)\b"

# Country name fragments, currency signs, token maps, keywords and class patterns.
COUNTRIES = [
    ("united states", "US"), ("usa", "US"), ("u.s.a", "US"), ("canada", "CA"), ("united kingdom", "GB"), ("uk", "GB"), ("england", "GB"), ("scotland", "GB"), ("wales", "GB"), ("britain", "GB"),
    ("australia", "AU"), ("new zealand", "NZ"), ("india", "IN"), ("germany", "DE"), ("france", "FR"), ("spain", "ES"), ("italy", "IT"), ("netherlands", "NL"), ("ireland", "IE"),
    ("south africa", "ZA"), ("singapore", "SG"), ("united arab emirates", "AE"), ("uae", "AE"), ("dubai", "AE"), ("pakistan", "PK"),
]
CURRENCIES = {"$": "USD", "£": "GBP", "€": "EUR", "¥": "JPY", "₹": "INR"}
CODES = "USD|GBP|EUR|JPY|INR|CAD|AUD"
AVAILABILITY = {"instock": "in_stock", "limitedavailability": "in_stock", "outofstock": "out_of_stock", "soldout": "out_of_stock", "discontinued": "out_of_stock", "preorder": "preorder", "presale": "preorder", "backorder": "preorder", "onbackorder": "preorder"}
CONDITION = {"newcondition": "new", "new": "new", "usedcondition": "used", "used": "used", "refurbishedcondition": "refurbished", "refurbished": "refurbished"}
WORLDWIDE = r"(?i)\b(worldwide|globally|international shipping|all countries|ship(s)? anywhere)\b"
PROCESSING = ["processing time", "handling time", "ships within", "order processing", "processed within", "dispatch"]
DELIVERY = ["delivery time", "arrives in", "transit time", "estimated delivery", "delivery within", "arrive within", "shipping time"]
REFUND_TERMS = [(r"\bstore credit\b", "store_credit_only"), (r"\bexchanges?\s+only\b", "exchange_only"), (r"\b(restocking fee|partial refund)\b", "partial_refund"), (r"\b(full refund|money\s*back|100%\s*refund)\b", "full_refund")]
RETURN_COST = [
    (r"\bfree returns? on orders? (over|above)\b", "free_above_threshold"),
    (r"\b(free returns?|we (cover|pay for) return shipping|prepaid return label)\b", "merchant_pays"),
    (r"\b(customer (is responsible for|pays) return shipping|you (are|will be) responsible for return shipping)\b", "customer_pays"),
]
PAYMENTS = [
    (r"\bvisa\b", "VISA"), (r"\bmaster\s?card\b", "MASTERCARD"), (r"\b(american express|amex)\b", "AMEX"), (r"\bdiscover\s*(card|network)?\b", "DISCOVER"), (r"\bpaypal\b", "PAYPAL"),
    (r"\bapple\s?pay\b", "APPLE_PAY"), (r"\bgoogle\s?pay\b", "GOOGLE_PAY"), (r"\bshop\s?pay\b", "SHOP_PAY"), (r"\bklarna\b", "KLARNA"), (r"\bafterpay\b", "AFTERPAY"),
]
CALLING_CODES = {"1": ["US", "CA"], "44": ["GB"], "61": ["AU"], "64": ["NZ"], "91": ["IN"], "49": ["DE"], "33": ["FR"], "34": ["ES"], "39": ["IT"], "31": ["NL"], "353": ["IE"], "27": ["ZA"], "65": ["SG"], "971": ["AE"], "92": ["PK"]}
# Names of countries by calling code.
CALLING_NAMES = {
    "1": ["united states", "usa", "u.s.a", "canada"], "44": ["united kingdom", "uk", "england", "scotland", "wales", "britain"], "61": ["australia"], "64": ["new zealand"], "91": ["india"], "49": ["germany"], "33": ["france"], "34": ["spain"],
    "39": ["italy"], "31": ["netherlands"], "353": ["ireland"], "27": ["south africa"], "65": ["singapore"], "971": ["united arab emirates", "uae", "dubai"], "92": ["pakistan"],
}
# Facts that are numbers, with the tolerance of their comparison, and facts that are compared as they are.
TOLERANCE = {"return.window_days": 0.0, "shipping.processing_days": 0.0, "shipping.delivery_days": 0.0, "shipping.cost_amount": 0.01, "product.price_amount": 0.01}
VERBATIM = ["product.gtin", "product.mpn", "product.sku"]
# Page types on which each commerce fact is looked for.
GATES = {
    "shipping.region": ["homepage", "shipping_policy"],
    "shipping.cost": ["shipping_policy", "product", "checkout"],
    "shipping.processing_days": ["shipping_policy", "product", "faq"],
    "shipping.delivery_days": ["shipping_policy", "product", "faq", "checkout"],
    "return.window_days": ["returns_policy", "faq", "product", "checkout"],
    "return.refund_terms": ["returns_policy", "faq"],
    "return.cost": ["returns_policy", "faq"],
    "payment.methods": ["homepage", "checkout", "faq"],
}


# Patterns of free shipping, amounts, day counts and final sales.
FREE_SHIPPING = r"(?i)\bfree\s+(shipping|delivery)\b"
AMOUNT = r"(\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?)"
SAME_DAY, HOURS = r"(?i)\bsame[- ]day\b", r"(?i)\bwithin\s+(\d+)\s+hours?\b"
DAY_SPAN, ONE_DAY = r"(?i)\b(\d+)\s*(?:-|to)\s*(\d+)\s*(?:business\s+)?days?\b", r"(?i)\b(\d+)\s*(?:business\s+)?days?\b"
FINAL_SALE = r"(?i)\b(final sale|no returns)\b"


def _has(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def emails(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), F.lower)))


def phones(text: Column) -> Column:
    """Phone numbers of 8 to 15 digits, as digits with a leading plus if there is one."""
    digits = lambda p: F.regexp_replace(p, r"[^\d+]", "")
    n = lambda p: F.char_length(F.regexp_replace(p, r"\D", ""))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(1)), digits), lambda p: n(p).between(8, 15))))


def addresses(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(0)), lambda a: F.trim(a))


def countries(text: Column) -> Column:
    """Sorted distinct codes of the countries whose name fragments stand anywhere in the text."""
    low = F.lower(text)
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(name)), code) for name, code in COUNTRIES]))))


def calling_code(phone: Column) -> Column:
    """The longest known calling code of a number with a plus; else null."""
    known = F.array(*[F.lit(c) for c in CALLING_CODES])
    fits = [F.when(F.array_contains(known, F.substring(phone, 2, n)), F.substring(phone, 2, n)) for n in (3, 2, 1)]
    return F.when(phone.startswith("+"), F.coalesce(*fits))


def money(text: Column) -> Column:
    """struct(amount, currency), both strings: free shipping is 0 without currency; null if no price stands in the text."""
    by_sign = rf"([$£€¥₹])\s?{AMOUNT}"
    by_code = rf"(?i){AMOUNT}\s?({CODES})\b"
    signs = F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv])
    plain = lambda p, g: F.replace(F.regexp_extract(text, p, g), F.lit(","), F.lit(""))
    out = lambda a, c: F.struct(a.alias("amount"), c.alias("currency"))
    return (
        F.when(_has(text, FREE_SHIPPING), out(F.lit("0"), F.lit(None).cast("string")))
        .when(_has(text, by_sign), out(plain(by_sign, 2), F.try_element_at(signs, F.regexp_extract(text, by_sign, 1))))
        .when(_has(text, by_code), out(plain(by_code, 1), F.upper(F.regexp_extract(text, by_code, 2))))
    )


def days(text: Column) -> Column:
    """Days that a text commits to: 0 for the same day, whole days for hours, the upper end of a range; else null."""
    hours, span, one = HOURS, DAY_SPAN, ONE_DAY
    num = lambda p, g: F.regexp_extract(text, p, g).try_cast("int")
    return (
        F.when(_has(text, SAME_DAY), 0)
        .when(_has(text, hours), F.greatest(F.lit(1), F.ceil(num(hours, 1) / 24).cast("int")))
        .when(_has(text, span), F.greatest(num(span, 1), num(span, 2)))
        .when(_has(text, one), num(one, 1))
    )


def _token(raw: Column, known: dict[str, str]) -> Column:
    last = F.lower(F.element_at(F.split(F.regexp_replace(raw, "/+$", ""), "/"), -1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), last), F.lit("unspecified"))


def availability(raw: Column) -> Column:
    """in_stock, out_of_stock, preorder or unspecified, from a URL, a word, or true and false as text."""
    return F.when(F.lower(raw) == "true", "in_stock").when(F.lower(raw) == "false", "out_of_stock").otherwise(_token(raw, AVAILABILITY))


def condition(raw: Column) -> Column:
    return _token(raw, CONDITION)


def gtin(raw: Column) -> Column:
    """Digits, padded to 14; longer ones stay. Null without digits."""
    d = F.regexp_replace(raw, r"\D", "")
    return F.when(d == "", None).when(F.char_length(d) <= 14, F.lpad(d, 14, "0")).otherwise(d)


def identifier(raw: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(raw, r"[^A-Za-z0-9]", "")), F.lit(""))


def compare_text(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def same_value(fact: Column, a: Column, b: Column) -> Column:
    """Whether two values of a fact agree: numeric facts within their tolerance, identifiers as they are, all others but for case and white space."""
    x, y = a.try_cast("double"), b.try_cast("double")
    tolerance = F.try_element_at(F.create_map(*[F.lit(v) for kv in TOLERANCE.items() for v in kv]), fact)
    text = compare_text(a) == compare_text(b)
    return F.when(fact.isin(VERBATIM), a == b).when(tolerance.isNotNull() & x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tolerance).otherwise(text)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<!\d)[.\n](?!\d)"), lambda s: F.trim(s)), lambda s: s != "")


def first_of(arr: Column, keep, value) -> Column:
    """value of the first element that keep accepts; else null."""
    return F.get(F.transform(F.filter(arr, keep), value), F.lit(0))


def keyword_days(text: Column, keywords: list[str]) -> Column:
    has = lambda s: F.rlike(F.lower(s), F.lit("|".join(keywords)))
    return first_of(sentences(text), lambda s: has(s) & days(s).isNotNull(), days)


def return_window(text: Column) -> Column:
    """Days of the first sentence with a day count that speaks of returns; 0 for final sale if there is none."""
    s = sentences(text)
    by_days = first_of(s, lambda x: F.contains(F.lower(x), F.lit("return")) & days(x).isNotNull(), days)
    final = first_of(s, lambda x: _has(x, FINAL_SALE), lambda x: F.lit(0))
    return F.coalesce(by_days, final)


def first_class(text: Column, rules: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(_has(text, f"(?i){p}"), F.lit(name)) for p, name in rules])


def payment_methods(text: Column) -> Column:
    found = F.array_sort(F.array_compact(F.array(*[F.when(_has(text, f"(?i){p}"), F.lit(name)) for p, name in PAYMENTS])))
    return F.nullif(F.array_join(found, ","), F.lit(""))


def shipping_region(text: Column) -> Column:
    """WORLDWIDE, else the country codes joined by commas, else null."""
    return F.when(_has(text, WORLDWIDE), "WORLDWIDE").otherwise(F.nullif(F.array_join(countries(text), ","), F.lit("")))


def shipping_cost(text: Column) -> Column:
    return first_of(sentences(text), lambda s: F.rlike(F.lower(s), F.lit("ship|delivery")) & money(s).isNotNull(), money)


def content_hash(text: Column) -> Column:
    """sha256 of the text with white space collapsed; null counts as empty."""
    return F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")).cast("binary"), 256)


def quote_text(text: Column) -> Column:
    """Text as quotes are compared: common entities decoded, white space collapsed, lower case."""
    for entity, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return compare_text(text)


def report_text(text: Column, most: int = 2000) -> Column:
    """Text fit for a report: control characters dropped, & < > escaped, cut to `most` characters."""
    text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return F.left(text, F.lit(most))


def price_in(text: Column) -> Column:
    return F.replace(F.regexp_extract(text, r"[$£€¥₹]\s?(\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?)", 1), F.lit(","), F.lit("")).try_cast("double")
