"""Merchant text, one case a row."""

import pytest
from pyspark.sql import functions as F

from storegrain.functions import facts as X
from storegrain.functions import urls as U

MONEY = {"Flat rate shipping: $9.99": ("9.99", "USD"), "12.00 EUR for EU orders": ("12.00", "EUR"), "free shipping": ("0", None), "costs £1,299.50 now": ("1299.50", "GBP"), "nothing": None}
DAYS = {"same day": 0, "within 48 hours": 2, "within 12 hours": 1, "3-5 business days": 5, "2 to 4 days": 4, "in 7 days": 7, "Delivery is fast": None}
AVAILABILITY = {"https://schema.org/InStock": "in_stock", "instock": "in_stock", "true": "in_stock", "false": "out_of_stock", "http://schema.org/SoldOut/": "out_of_stock", "onbackorder": "preorder", "maybe": "unspecified"}


def values(spark, texts, expr):
    return {r["t"]: r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", expr(F.col("t")).alias("v")).collect()}


def test_money(spark):
    assert {t: v and tuple(v) for t, v in values(spark, MONEY, X.money).items()} == MONEY


@pytest.mark.parametrize("expr, cases", [(X.days, DAYS), (X.availability, AVAILABILITY)])
def test_days_and_availability(spark, expr, cases):
    assert values(spark, cases, expr) == cases


def test_identifiers(spark):
    assert values(spark, ["012-345-678-905", "none", "1234567890123456"], X.gtin) == {"012-345-678-905": "00012345678905", "none": None, "1234567890123456": "1234567890123456"}
    assert values(spark, ["ab-12 c", "--"], X.identifier) == {"ab-12 c": "AB12C", "--": None}
    assert values(spark, ["https://schema.org/UsedCondition", "New", "x"], X.condition) == {"https://schema.org/UsedCondition": "used", "New": "new", "x": "unspecified"}


def test_contacts(spark):
    t = "Write to Sales@Shop.example or call +44 20 7946 0958, order 1234. Or +1 (212) 555-0100."
    assert values(spark, [t], X.emails)[t] == ["sales@shop.example"]
    assert values(spark, [t], X.phones)[t] == ["+12125550100", "+442079460958"]
    assert values(spark, ["+442079460958", "+3531234567", "0123"], X.calling_code) == {"+442079460958": "44", "+3531234567": "353", "0123": None}
    assert values(spark, ["12 High Road, London"], X.addresses)["12 High Road, London"] == ["12 High Road"]


def test_countries(spark):
    t = "We ship from the United States and Canada"
    assert values(spark, [t], X.countries)[t] == ["CA", "US"]
    assert values(spark, ["We ship worldwide", t, "no"], X.shipping_region) == {"We ship worldwide": "WORLDWIDE", t: "CA,US", "no": None}


def test_terms(spark):
    both = "All sale items are final sale. Other returns are accepted within 30 days"
    assert values(spark, [both, "Final sale only"], X.return_window) == {both: 30, "Final sale only": 0}
    assert values(spark, ["Store credit or full refund", "Money back", "-"], lambda c: X.first_class(c, X.REFUND_TERMS)) == {"Store credit or full refund": "store_credit_only", "Money back": "full_refund", "-": None}
    assert values(spark, ["Free returns on orders over $50"], lambda c: X.first_class(c, X.RETURN_COST)) == {"Free returns on orders over $50": "free_above_threshold"}
    assert values(spark, ["We take Visa, Master Card and PayPal", "cash"], X.payment_methods) == {"We take Visa, Master Card and PayPal": "MASTERCARD,PAYPAL,VISA", "cash": None}
    t = "Prices from $7.50 up. Processing time is 1-2 business days.\nShipping costs $4.95"
    assert values(spark, [t], lambda c: X.keyword_days(c, X.PROCESSING))[t] == 2
    assert tuple(values(spark, [t], X.shipping_cost)[t]) == ("4.95", "USD")
    assert len(values(spark, [t], X.sentences)[t]) == 3


def test_same_value(spark):
    rows = [("return.window_days", "30", "30.0", True), ("shipping.cost_amount", "19.99", "19.995", True), ("return.window_days", "19.99", "19.995", False), ("product.gtin", "0012", "12", False), ("product.sku", "a", "A", False), ("business.name", "A  b", "a B", True), ("business.name", "x", "y", False), ("business.phone", "012", "12", False)]
    df = spark.createDataFrame(rows, "fact string, a string, b string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", X.same_value(F.col("fact"), F.col("a"), F.col("b")).alias("got")).collect())


def test_shipping_cost_sentences(spark):
    t = "We ship anywhere for $5.00"
    assert tuple(values(spark, [t], X.shipping_cost)[t]) == ("5.00", "USD") and values(spark, ["Postage is $3.00"], X.shipping_cost) == {"Postage is $3.00": None}


def test_text_helpers(spark):
    assert values(spark, ["a  b"], X.content_hash)["a  b"] == values(spark, ["a b "], X.content_hash)["a b "]
    assert values(spark, ["<a> & \x01"], X.report_text)["<a> & \x01"] == "&lt;a&gt; &amp; "
    assert values(spark, ["Tom &amp;\n Co"], X.quote_text)["Tom &amp;\n Co"] == "tom & co"
    assert values(spark, ["only $1,299.00!"], X.price_in)["only $1,299.00!"] == 1299.0


def test_urls(spark):
    u = "HTTPS://Www.Shop.example:8080/A/page/2/?on-sale=1&filter_x=2&b=3#top"
    assert values(spark, [u], U.normalized)[u] == "https://www.shop.example:8080/A/page/2?b=3"
    assert values(spark, [u], U.page_key)[u] == "HTTPS://Www.Shop.example:8080/A?b=3"
    assert values(spark, [u], U.strip_facets)[u].endswith("?b=3#top") and values(spark, [u], U.root_host)[u] == "shop.example:8080"
    forms = {"/cart/": "cart", "/versand": "shipping_policy", "/x": None, "/products/widget": "product", "/products/": None, "/shop/mug/": "product", "/shop/": "collection", "/collections/all": "collection", "/basket": "cart", "/blog/returns": "returns_policy", "/news/1": "blog_other", "/My-Account": "blog_other"}
    assert values(spark, forms, U.url_type) == forms
    said = {"Our Privacy Policy": "privacy_policy", "Frais de livraison": "shipping_policy", "Add to bag": "product", "Über uns": "contact_about", "Preguntas frecuentes": "faq", "Hello": None}
    assert values(spark, said, U.text_type) == said
    assert values(spark, ["/products/x", "/privacy", "/blog/x", "/cart/shipping-policy"], U.crawl_tier) == {"/products/x": 1, "/privacy": 0, "/blog/x": 2, "/cart/shipping-policy": 0}
