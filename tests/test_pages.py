"""Page parsing and page checks on literal pages."""

import json

from pyspark.sql import functions as F

from storegrain.operators import catalog_match as M
from storegrain.operators import checks as C
from storegrain.operators import extract as E
from storegrain.sources import features as P

HTML = """<html lang="en-GB"><head><title> A  shop </title><script type="application/ld+json">{"@graph": [{"@type": "Product", "sku": "W-1", "brand": {"name": "B"}, "gtin13": "0012345678905",
"offers": [{"price": "1,299.00", "priceCurrency": "USD", "availability": "https://schema.org/InStock"}, {"price": 15, "sku": "LG"}]}]}</script><script type="application/ld+json">{broken</script></head>
<body><nav><a href="/1">1</a><a href="/2">2</a><a href="/3">3</a><a href="/4">4</a></nav><nav><a href="/1">1</a><a href="/2">2</a><a href="/3">3</a><a href="/4">4</a></nav>
<nav><a href="/1">1</a><a href="/2">2</a><a href="/3">3</a><a href="/4">4</a></nav><div class="cookie-bar">we use cookies</div><h1>Head &amp; tail</h1><p>Main text<br>here <a href="https://other.example/x">out</a></p>
<img src="/no-image.png"><img src="/ok.jpg" alt="fine"><form action="/send" class="contact"><input name="email"><textarea name="message"></textarea></form></body></html>"""


def pages(spark):
    df = spark.createDataFrame([("s", "r", 0, "http://shop.example/", "homepage", HTML), ("s", "r", 1, "https://shop.example/p/w", "product", None)], "store_id string, run_id string, seq long, url string, page_type string, html string")
    return P.page_features(df)


def test_features(spark):
    a, b = pages(spark).orderBy("seq").collect()
    assert a["title"] == "A shop" and a["lang"] == "en" and a["headings"] == ["Head & tail"] and len(a["links"]) == 13 and "cookies" in a["text"] and a["main_text"] == "Head & tail Main text here out"
    assert [s["heading"] for s in a["sections"]] == ["Head & tail"] and a["sections"][0]["text"] == "Main text here out"
    assert b["title"] is None and b["links"] == [] and b["text"] == ""


def test_checks(spark):
    p = pages(spark).cache()
    assert C.repeated_blocks(p).first()["copies"] == 3
    assert {(r["src"], r["url"]) for r in C.first_image_pages(p).collect()} == {("/no-image.png", "http://shop.example/"), ("/ok.jpg", "http://shop.example/")}
    link = {r["link"]: r["internal"] for r in C.links(p).collect()}
    assert link["/1"] and not link["https://other.example/x"]
    assert {r["check_id"] for r in C.insecure(p).collect()} == {"https_enforced"}
    probes = spark.createDataFrame([("/ok.jpg", 404, None, None, None)], "url string, status int, width int, height int, error string")
    found = lambda pr: sorted((r["src"], r["check_id"], r["confidence"]) for r in C.image_checks(p, pr).collect())
    own = [("/no-image.png", "product_image_missing_alt_text", "confirmed"), ("/no-image.png", "product_image_placeholder_filename", "potential_risk")]
    assert found(probes) == [*own, ("/ok.jpg", "product_image_broken", "confirmed")]
    for probe, want in ((("/ok.jpg", None, None, None, "dns"), [("/ok.jpg", "product_image_broken", "cannot_verify")]), (("/ok.jpg", 200, None, None, None), [("/ok.jpg", "product_image_broken", "potential_risk")]), (("/ok.jpg", 200, 249, 900, None), [("/ok.jpg", "product_image_low_resolution", "confirmed")]), (("/ok.jpg", 200, 250, 250, None), [])):
        assert found(spark.createDataFrame([probe], probes.schema)) == own + want
    probes = spark.createDataFrame([("http://shop.example/", "/send", 500, None)], "page_url string, action string, status int, error string")
    assert {(r["check_id"], r["detail"]) for r in C.form_checks(p, probes).collect()} == {("contact_form_missing_field", "name"), ("form_email_field_weak_validation", "contact"), ("form_action_unreachable", "contact")}
    assert M.structured_products(p).count() == 0  # the home page is no product page
    offers = M.structured_products(p.withColumn("page_type", F.lit("product"))).orderBy("k").collect()
    assert [(o["price"], o["availability"], o["gtin"], o["sku"], o["variant_key"]) for o in offers if o["variant_key"]] == [("1299.00", "in_stock", "00012345678905", "W1", "00012345678905"), ("15", None, "00012345678905", "LG", "00012345678905")]
    assert [(o["brand"], o["gtin"], o["sku"]) for o in offers if not o["variant_key"]] == [("B", None, None)]
    text = p.filter("seq = 0").withColumn("text", F.explode(F.array(F.lit("nothing"), F.lit("USD 5 only"), F.lit("12,00 €, pre-order"), F.lit(""))))
    assert sorted((r["check_id"]) for r in C.product_text(text).collect()) == ["generic_product_availability_missing"] * 2 + ["generic_product_price_missing"]
    assert {r["link"] for r in C.external_links(p).collect()} == {"https://other.example/x"}


def test_aggregate_offers(spark):
    node = '{"@type": "Product", "mpn": "m-1", "offers": {"@type": "AggregateOffer", "lowPrice": "5.00", "offers": [{"price": 7, "sku": "a"}, {"price": "9.5", "sku": "b"}]}}'
    p = spark.createDataFrame([("s", "r", 0, "u", [node, '{"@type": "Person"}', "no json"])], "store_id string, run_id string, seq int, url string, nodes array<string>")
    offers = M.structured_products(p)
    assert sorted((o["price"], o["variant_key"]) for o in offers.collect()) == [("5.00", "M1"), ("7", "M1"), ("9.5", "M1")]
    facts = E.product_facts(offers, "jsonld")
    assert sorted(r["value"] for r in facts.filter("fact = 'product.price_amount'").collect()) == ["5.00", "7", "9.5"] and {r["confidence"] for r in facts.collect()} == {0.95} and {r["variant_key"] for r in facts.collect()} == {"M1"}
    pages_ = spark.createDataFrame([("s", "r", 0, "u", "homepage", ["Acme"], "mail a@b.cd")], "store_id string, run_id string, seq int, url string, page_type string, headings array<string>, text string")
    all_ = E.all_facts(pages_, offers.withColumn("seq", F.col("seq").cast("int")))
    assert {r["fact"] for r in all_.collect()} >= {"business.email", "business.name", "product.price_amount", "product.mpn"} and E.unknown_methods(all_).count() == 0


def product_rows(spark, *blocks, page_type="product", html=None):
    html = html or "".join(f'<script type="application/ld+json">{b if isinstance(b, str) else json.dumps(b)}</script>' for b in blocks)
    p = spark.createDataFrame([("s", "r", 0, "u", page_type, html)], "store_id string, run_id string, seq long, url string, page_type string, html string")
    rows = E.product_facts(M.structured_products(P.page_features(p)), "jsonld").orderBy("seq").collect()
    return [(r["fact"].removeprefix("product."), r["value"]) for r in rows]


def test_structured_product_facts(spark):
    offer = {"@type": "Offer", "price": "5.00", "priceCurrency": "USD"}
    rows = product_rows(spark, {"@type": "Product", "brand": "Acme", "sku": "ABC-123", "gtin13": "0123456789012", "offers": offer | {"availability": "https://schema.org/InStock"}})
    assert sorted(rows) == [("availability", "in_stock"), ("brand", "Acme"), ("gtin", "00123456789012"), ("price_amount", "5.00"), ("price_currency", "USD"), ("sku", "ABC123")]
    prices = lambda *blocks, **more: [v for f, v in product_rows(spark, *blocks, **more) if f == "price_amount"]
    assert prices({"@graph": [{"@type": "WebPage", "name": "Products", "offers": {"price": 9}}, {"@type": "product", "offers": offer}]}) == ["5.00"]
    assert prices({"@type": "Organization"}, "{not valid json", {"@type": ["Thing", "Product"], "offers": offer | {"price": 19.99}}) == ["19.99"]
    assert prices({"@type": "Product", "offers": [offer | {"price": "1,299.00"}, [offer | {"price": "about 5"}], None, "5"]}) == ["1299.00"]
    assert prices({"@type": "ProductGroup", "offers": offer | {"price": 1}, "hasVariant": [{"@type": "Product", "offers": offer}, {"@type": "Product", "offers": offer | {"price": 6}}]}) == ["5.00", "6"]
    deep = {"@type": "AggregateOffer", "lowPrice": "1.00", "price": "7", "offers": {"@type": ["AggregateOffer"], "lowPrice": 2, "offers": [offer, offer | {"sku": "RED"}]}}
    assert prices({"@type": "Product", "offers": deep}) == ["1.00", "2", "5.00", "5.00"]
    assert prices({"@type": "Product", "offers": offer | {"offers": [offer]}}) == ["5.00"]  # only aggregate offers are opened
    assert product_rows(spark, {"@type": "Product", "sku": "a-1", "mpn": 7, "brand": {"name": ""}}) == [("mpn", "7"), ("sku", "A1")]
    assert product_rows(spark, {"@type": "Product", "itemCondition": "https://schema.org/RefurbishedCondition", "offers": {"priceCurrency": "usd", "itemCondition": "NewCondition"}}) == [("condition", "refurbished")]
    assert product_rows(spark, {"@type": "Product", "offers": {"price": "1", "priceCurrency": "usd"}}, page_type="contact_about") == []
    assert product_rows(spark, {"@type": "Product", "sku": "", "mpn": None, "offers": {"@type": "Offer", "price": None, "priceCurrency": "USD"}}) == []
    assert [v for f, v in product_rows(spark, {"@type": "Product", "gtin8": "12345670", "gtin": "1", "offers": offer}) if f == "gtin"] == ["00000012345670"]


def test_prices_and_stock_as_pages_show_them():
    shown = lambda html: tuple(P.parse(html)["rendered"].values())
    assert shown(None) == (None, None, None, None)
    assert shown('<i class="price-item--sale">$ <b>1,0</b>9.5</i><b class="price">3</b> Sold out, add to cart') == (109.5, False, None, "outofstock")
    assert shown("<div data-product-price>none</div><b class=price>3</b>buy now") == (None, True, None, None)
    assert shown('<p class="price"><span class="amount">8</span><ins>7<b class="amount">9</b></ins></p><ins>1</ins>') == (879.0, None, 79.0, None)
    assert shown('<span class="amount">1</span><p class="price">from <span class="amount">8</span> to <span class="amount">9</span></p>') == (8.0, None, 8.0, None)
    assert shown('<p class="price">5.5.5</p><p class="stock out"> </p>ON BACKORDER<script>in stock</script>') == (None, None, None, "onbackorder")
    assert shown('<p class="stock">Currently unavailable</p> in stock')[1:] == (True, None, "instock")  # the words are looked for in their order
    assert shown("<title>In stock</title><style>sold out</style>")[1] is True


def test_pages_to_platform_findings(spark):
    page = lambda k, body, kind="product": ("s", "r", k, f"https://x/p/{k}", kind, f"<body>{body}</body>")
    theme = lambda price, text="Add to cart": f'<div class="product-price">{price}</div>{text}'
    rows = [page(0, theme("$19.99")), page(1, theme("$24.99")), page(2, theme("$19.99", "Sold out")), page(3, theme("$5", "Sold out")), page(4, theme("$5"), "blog_other"), page(5, "nothing"), page(6, theme("$1"))]
    p = P.page_features(spark.createDataFrame(rows, "store_id string, run_id string, seq long, url string, page_type string, html string"))
    one = [("19.99", True)]
    api = [("s", "r", str(k), one) for k in (0, 1, 2, 4, 5)] + [("s", "r", "3", []), ("s", "r", "6", [("none", None), (None, True)])]
    shop = spark.createDataFrame(api, "store_id string, run_id string, handle string, variants array<struct<price:string,available:boolean>>")
    got = sorted((r["url"][-1], r["check_id"]) for r in M.mismatches(M.by_handle(M.shown(p, theme=True), shop)).collect())
    assert got == [("1", "shopify_price_mismatch"), ("2", "shopify_availability_mismatch")]


def test_forms(spark):
    field = "kind:string,hint:string,required:boolean,pattern:string"
    f = lambda kind, hint, required=False, pattern=None: (kind, hint, required, pattern)
    mail, message = f("email", "email"), f("textarea", "message")
    forms = [
        ("", "", [mail, message], "contact"), ("", "newsletter box", [mail], "newsletter"), ("", "", [mail], "newsletter"), ("", "login", [mail, message], None), ("", "", [mail, f("password", "pw")], None), ("/wp-comments-post.php", "", [mail, message], None), ("", "", [message], None),
        ("", "contact", [mail, f("text", "x"), f("text", "y")], "contact"), ("", "", [mail, f("text", "x"), f("text", "y")], None), ("", "", [mail, f("hidden", "a"), f("submit", "b")], "newsletter"),
    ]
    rows = [("s", "r", f"https://a/{k}", "blog_other", [(a, h, x)]) for k, (a, h, x, _) in enumerate(forms)]
    p = spark.createDataFrame(rows, f"store_id string, run_id string, url string, page_type string, forms array<struct<action:string,hint:string,fields:array<struct<{field}>>>>")
    got = {r["url"]: r["kind"] for r in C.leads(p).collect()}
    assert got == {f"https://a/{k}": kind for k, (*_, kind) in enumerate(forms) if kind}
    assert [r["kind"] for r in C.leads(p.limit(9).filter("url = 'https://a/8'").withColumn("page_type", F.lit("contact_about"))).collect()] == ["contact"]
    own = p.filter("url = 'https://a/0'").withColumn("forms", F.transform("forms", lambda x: x.withField("action", F.lit("/0/#form"))))
    probes = spark.createDataFrame([("https://a/0", "/0/#form", 500, None)], "page_url string, action string, status int, error string")
    assert {r["check_id"] for r in C.form_checks(own, probes).collect()} == {"contact_form_missing_field"}


def test_credit(spark):
    key = "store_id string, run_id string, seq int, url string, links array<string>, reachable boolean"
    rows = [
        ("s", "r", 0, "https://www.shop.co.uk/", ["/returns", "https://x.example/returns"], True), ("s", "r", 1, "https://www.shop.co.uk/a", ["https://help.shop.co.uk/refunds", "https://b.loopreturns.com/"], True), ("t", "r", 0, "https://t.example/", ["https://b.narvar.com/x"], True),
        ("u", "r", 0, "https://u.example/", ["https://www.u.example/returns", "https://other.co.uk/help"], True), ("v", "r", 0, "https://v.example/", ["https://support.v.example/"], False),
    ]
    p = spark.createDataFrame(rows, key)
    got = {r["store_id"]: (r["link"], r["matched_via"]) for r in C.returns_credit(p).collect()}
    assert got == {"s": ("https://help.shop.co.uk/refunds", "same_organization_subdomain"), "t": ("https://b.narvar.com/x", "known_returns_portal")}
    assert {r["store_id"]: r["found_on"] for r in C.contact_credit(p).collect()} == {"s": "https://www.shop.co.uk/a"}


def test_fetch_outcomes(spark):
    ok = "<body>" + "word " * 400 + "</body>"
    rows = [
        (200, ok, None, None), (200, "<body>Access denied</body>", None, "bot_blocked"), (200, ok + "Access denied", None, None), (200, ok + "Sorry, you have been blocked", None, "bot_blocked"), (200, ok + "Just a moment...", None, "bot_blocked"), (200, "<body>cf-turnstile</body>", None, "captcha_blocked"),
        (200, ok + "g-recaptcha", None, None), (200, ok + "g-recaptcha I'm not a robot", None, "captcha_blocked"), (404, ok, None, "not_found"), (410, None, None, "not_found"), (429, ok, None, "rate_limited"), (403, ok, None, "bot_blocked"), (None, None, "network_error", "network_error"),
        (None, None, "blocked_ssrf", "blocked_ssrf"), (503, ok, None, "http_error"), (200, "", None, "unknown"), (200, "<html></html>", None, "unknown"), (None, None, "other", "unknown"),
    ]
    df = spark.createDataFrame(rows, "status int, html string, error string, want string")
    out = C.fetch_outcomes(df).collect()
    assert [r["failure_category"] for r in out] == [r["want"] for r in out]
    assert {r["failure_category"] for r in out if not r["reachable"] and not r["cannot_verify"]} == {"not_found", "blocked_ssrf"}
    p = spark.createDataFrame([("s", "r", "a", True, False), ("s", "r", "b", False, False), ("s", "r", "c", False, True), ("t", "r", "d", False, True)], "store_id string, run_id string, url string, reachable boolean, cannot_verify boolean")
    assert sorted((r["url"], r["confidence"]) for r in C.broken_pages(p).collect()) == [("b", "confirmed"), ("c", "cannot_verify")]
    n = lambda store, path, status=200, spaces=None, products=False, html=None: (store, "r", path, status, spaces, products, html)
    probes = [
        n("a", "/products.json", products=True), n("a", "/wp-json/", spaces=["wp/v2", "wc/v3"]), n("b", "/wp-json/", spaces=["wp/v2"]), n("b", "/", html="woocommerce"), n("c", "/wp-json/", 404), n("c", "/wp-json/wc/v3/products", 401), n("d", "/wp-json/wp/v2/"), n("d", "/products.json", products=True),
        n("e", "/products.json", products=True), n("e", "/", html="woocommerce"), n("f", "/", html="wp-content and cdn.shopify.com"), n("g", "/", html="x cdn.shopify.com"), n("h", "/", html=""), n("i", "/products.json", 200),
    ]
    probes = spark.createDataFrame(probes, "store_id string, run_id string, path string, status int, namespaces array<string>, has_products boolean, html string")
    assert {r["store_id"]: r["platform"] for r in C.platform(probes).collect()} == {"a": "woocommerce", "b": "wordpress", "c": "woocommerce", "d": "wordpress", "e": "shopify", "f": "wordpress", "g": "shopify", "h": "unknown", "i": "unknown"}


def test_page_type(spark):
    rows = [("https://a/", True, ["x"], "", "homepage"), ("https://a/products/widget", False, ["Returns policy"], "", "product"), ("https://a/x", False, ["Refund policy"], "", "returns_policy"), ("https://a/x", False, ["Legal notice"], "see our privacy policy", "blog_other"), ("https://a/x", False, [" "], "see our privacy policy", "privacy_policy"), ("https://a/x", False, [], "", "blog_other")]
    df = spark.createDataFrame(rows, "url string, home boolean, headings array<string>, body string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", C.page_type(F.col("url"), F.col("home"), F.col("headings"), F.col("body")).alias("got")).collect())


def test_journeys_claims_and_phones(spark):
    j = spark.createDataFrame([("p", 10.0, "now $12.00", "Total $9.00"), ("q", 10.0, "$10.00", "Shipping $2 Total $12.00"), ("r", 10.0, "none", None), ("t", 10.0, None, None)], "product_url string, product_price double, cart_text string, checkout_text string")
    got = {}
    for r in C.journeys(j).collect():
        got.setdefault(r["product_url"], set()).add(r["check_id"].removeprefix("purchase_journey_"))
    assert got == {"p": {"cart_price_mismatch", "shipping_not_shown", "total_lower_than_product_price"}, "q": {"total_lower_than_product_price"}, "r": {"cart_price_not_found"}}  # the first price of the checkout counts
    rows = [("s", "r", 0, "home", "homepage", "Free shipping"), ("s", "r", 1, "pol", "returns_policy", "x"), ("s", "r", 2, "ship", "shipping_policy", "x"), *[("s", "r", 3 + k, f"p{k}", "product", "30-day returns" if k % 2 else "nothing") for k in range(9)]]
    p = spark.createDataFrame(rows, "store_id string, run_id string, seq long, url string, page_type string, text string")
    assert sorted((r["url"], r["kind"], r["policy_url"]) for r in C.claim_tasks(p).collect()) == [("home", "shipping", "ship"), ("p1", "returns", "pol"), ("p3", "returns", "pol")]
    soft = spark.createDataFrame([("s", "r", "pol")], "store_id string, run_id string, url string")
    assert [r["kind"] for r in C.claim_tasks(p, soft).collect()] == ["shipping"]
    f = spark.createDataFrame([("s", "r", "+4420", "u"), ("s", "r", "+4930", "u")], "store_id string, run_id string, phone string, url string")
    said = p.limit(1).withColumn("text", F.lit("our office in Germany"))
    assert [(r["phone"], r["code"]) for r in C.phone_countries(f, said).collect()] == [("+4420", "44")] and C.phone_countries(f, said.withColumn("page_type", F.lit("product"))).count() == 0


def test_identity_and_required_pages(spark):
    key = "store_id string, run_id string, seq long, url string, page_type string, reachable boolean, cannot_verify boolean, lang string, text string"
    rows = [
        ("a", "r", 0, "h", "homepage", True, False, "en", "a@b.cd or +44 20 7946 0958, in Germany"), ("a", "r", 1, "c", "contact_about", True, False, "en", "x@b.cd, a@b.cd"), ("a", "r", 2, "p", "product", True, False, "en", "other@b.cd"),
        ("b", "r", 0, "h", "homepage", True, False, "pl", "nothing"), ("b", "r", 1, "v", "privacy_policy", False, True, None, None), ("c", "r", 0, "h", "homepage", False, True, None, None), ("d", "r", 0, "h", "homepage", True, False, None, "12 High Road"), ("d", "r", 1, "s", "faq", True, False, None, "x"),
        *[("d", "r", 2 + k, t, t, True, False, None, "1") for k, t in enumerate(["privacy_policy", "shipping_policy", "returns_policy", "terms_of_service"])],
    ]
    p = spark.createDataFrame(rows, key)
    runs = p.select("store_id", "run_id").distinct()
    found = sorted((r["store_id"], r["check_id"].removeprefix("business_identity_"), r["n_values"], r["page_url"]) for r in C.identity_findings(p, runs).collect())
    assert found == [("a", "email_consistency", 2, None), ("a", "phone_country_mismatch", 1, "h"), ("b", "present", 0, None)]
    soft = p.filter("url = 'terms_of_service'").select("store_id", "run_id", "url")
    got = sorted((r["store_id"], r["check_id"], r["page_type"] or "", r["severity"], r["page_url"]) for r in C.required_pages(p, soft, runs).collect())
    four = ["privacy_policy", "returns_policy", "shipping_policy", "terms_of_service"]
    assert got == [
        *[("a", "required_page_present", t, "critical", None) for t in four], ("b", "required_page_present", "contact_about", "medium", None), ("b", "required_page_present", "privacy_policy", "high", "v"), *[("b", "required_page_present", t, "medium", None) for t in four[1:]],
        ("c", "crawl_incomplete", "", "high", "h"), ("d", "required_page_present", "contact_about", "critical", None), ("d", "required_page_present", "terms_of_service", "high", "terms_of_service"),
    ]


def test_soft_404(spark):
    text, home = "this page could not be found in our shop please go back " * 3, "welcome to the shop of many things, all of them good " * 3
    rows = [("s", 0, "h", home), ("s", 1, "a", text), ("s", 2, "b", text + "now"), ("s", 3, "c", "a real page about things"), ("s", 4, "d", None), ("s", 5, "e", home), ("s", 6, "f", home + "yes"), ("t", 0, "h", home), ("t", 1, "a", home), ("u", 0, "h", None), ("u", 1, "a", None), ("u", 2, "b", "text")]
    p = spark.createDataFrame([(s, "r", k, u, t, True) for s, k, u, t in rows] + [("t", "r", 9, "z", home, False)], "store_id string, run_id string, seq long, url string, text string, reachable boolean")
    base = spark.createDataFrame([("s", "r", text)], "store_id string, run_id string, baseline string")
    got = {(r["store_id"], r["url"]): (r["matched"], r["how"]) for r in C.soft_404(p, base).collect()}
    assert got == {("s", "a"): ("baseline", "exact"), ("s", "b"): ("baseline", "near"), ("s", "e"): ("homepage", "exact"), ("s", "f"): ("homepage", "near"), ("t", "a"): ("homepage", "exact"), ("u", "a"): ("homepage", "exact")}


def test_products(spark):
    pages_ = spark.createDataFrame([("s", "r", 0, "https://x/p/w/", 19.99, True), ("s", "r", 1, "https://x/p/w", 1.0, True), ("s", "r", 2, "https://x/p/v", 24.99, False), ("s", "r", 3, "https://x/p/z", 1.0, True)], "store_id string, run_id string, seq long, url string, price double, in_stock boolean")
    api = spark.createDataFrame([("s", "r", "https://x/p/w", 19.99, True), ("s", "r", "https://x/p/v", 19.99, True)], "store_id string, run_id string, permalink string, price double, in_stock boolean")
    m = M.by_path(pages_, api)
    assert sorted((r["url"], r["check_id"]) for r in M.mismatches(m).collect()) == [("https://x/p/v", "woocommerce_price_mismatch"), ("https://x/p/v", "woocommerce_stock_mismatch")]
    assert {r["url"] for r in M.unmatched(pages_, m).collect()} == {"https://x/p/w", "https://x/p/z"}
    shop = spark.createDataFrame([("s", "r", "w", [("18.00", False), ("19.99", True)])], "store_id string, run_id string, handle string, variants array<struct<price:string,available:boolean>>")
    assert M.mismatches(M.by_handle(pages_.filter("seq = 0"), shop)).count() == 0
    schema = "id string, title string, description string, price double, landing_page_price double, gtin string, category string, availability string, condition string, shipping_weight_kg double, attributes map<string,string>"
    rows = [
        ("1", "Playhouse", "for 3 years and up", 5.0, 5.0, "1", "playhouse", "in_stock", "new", None, {"x": "choking hazard"}), ("2", "Scooter", "", None, 5.0, None, "electric_scooter", "in_stock", "new", None, {}), ("3", "Fridge", "Energy Star", 5.0, 5.0, "1", "refrigerator", "in_stock", "used", None, {}),
        ("4", "Fridge", "Energy Star, 2 year guarantee", 5.0, 5.0, "1", "refrigerator", "in_stock", "used", None, {"energy_rating": "A"}), ("5", "Motor", "x", 5.0, 5.0, "1", "electric_motor", "in_stock", "new", 2.0, {"certification": "CSA"}), ("6", "House", "x", 5.0, 5.0, "1", "playhouse", "in_stock", "new", None, {"age_grade": "3"}),
    ]
    feed = spark.createDataFrame(rows, schema)
    got = {(r["id"], r["rule"]) for r in M.feed_violations(feed).collect()}
    assert got == {("2", "gtin_present"), ("2", "price_positive"), ("2", "required_description"), ("2", "battery_safety_certification"), ("2", "shipping_weight_present"), ("3", "warranty_disclosure"), ("3", "energy_claim_substantiation"), ("6", "playhouse_safety_warning")}
    feed = feed.filter("id in ('1', '2')")
    answers = spark.createDataFrame([("1", '[{"rule": "x", "severity": "warning"}]'), ("2", "no json")], "id string, answer string")
    out = {(r["id"], r["rule"]): r["manual_review"] for r in M.evaluated(feed, M.feed_violations(feed), answers).collect()}
    assert out["1", "x"] is False and out["2", "shipping_weight_present"] is True and not M.gate(M.feed_violations(feed)).first()["clean"]
    api_images = spark.createDataFrame([("s", "r", "u1", [("a", None)])], "store_id string, run_id string, url string, images array<struct<src:string,alt:string>>")
    own = spark.createDataFrame([("s", "r", "u1", [("b", None)]), ("s", "r", "u2", [("c", "t")])], api_images.schema)
    assert {(r["url"], r["src"], r["source"]) for r in M.product_images(own, api_images).collect()} == {("u1", "a", "api"), ("u2", "c", "page")}


def test_titles_with_a_hot_first_word(spark):
    import difflib
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    titles = ["new " + " ".join(word() for _ in range(rng.randint(0, 8))) for _ in range(500)]
    for _ in range(200):  # near ones of all lengths
        t = list(rng.choice(titles))
        for _ in range(rng.randint(1, 3)):
            if len(t) > 4:
                t[rng.randrange(4, len(t))] = rng.choice("xyz ")
        titles.append("".join(t))
    titles += ["new", "new a", "new ab", "new abc", "new aab", "new " + "z" * 300, "new " + "z" * 299 + "y", "New  A", "", " ", None]
    df = spark.createDataFrame([("s", "r", k, f"u{k}", t) for k, t in enumerate(titles)], "store_id string, run_id string, seq long, url string, title string")
    first = {}
    for k, t in enumerate(titles):
        first.setdefault(" ".join((t or "").split()).lower(), k)
    rows = sorted((k, t) for t, k in first.items() if t)
    want = set()
    for i, (k, x) in enumerate(rows):
        for j, y in rows[i + 1 :]:
            m = difflib.SequenceMatcher(None, x, y)
            if x.split()[0] == y.split()[0] and m.quick_ratio() >= 0.92 and m.ratio() >= 0.92:
                want.add((f"u{k}", f"u{j}"))
    assert {(r["url_a"], r["url_b"]) for r in C.near_titles(df).collect()} == want and len(want) > 50
    t = df.filter("trim(title) <> ''").selectExpr("store_id", "run_id", "seq", "lower(trim(regexp_replace(title, '\\\\s+', ' '))) as norm", "'new' as block")
    assert C.title_candidates(t).count() < len(rows) ** 2 / 2 / 20  # of all pairs of the block


def test_titles_meet_in_small_cells(spark, monkeypatch):
    """Parts of four titles or fewer, long titles, runs apart: the pairs and ratios of difflib, and a few rows a title, not one for each of its characters."""
    import difflib
    import random

    rng = random.Random(8)
    monkeypatch.setattr(C, "PART_TITLES", 4)
    monkeypatch.setattr(C, "PART_CHARACTERS", 2000)
    rows = []
    for k in range(60):
        t = list(rng.choice(rows)[2]) if rows and k % 3 else list(rng.choice(["new", "old", "\u00e9t\u00e9"]) + " " + "".join(rng.choice("aeiou tnrs\u00e9\u00fc\U0001f600") for _ in range(rng.choice([5, 20, 150, 190, 210, 900]))))
        for _ in range(rng.randint(0, 1 + len(t) // 12)):
            at = rng.randrange(4, len(t))
            t[at : at + rng.randint(0, 2)] = rng.choice(["", "x", "ab", "e"])
        rows.append((rng.choice("st"), k, "".join(t)))
    df = spark.createDataFrame([(s, "r", k, f"u{k}", t) for s, k, t in rows], "store_id string, run_id string, seq long, url string, title string")
    first, want = {}, {}
    for s, k, t in rows:
        first.setdefault((s, " ".join(t.split()).lower()), k)
    for (s, x), i in first.items():
        for (z, y), j in first.items():
            r = difflib.SequenceMatcher(None, x, y).ratio()
            assert C.similarity(x, y, C.places(y)) == (r if r >= 0.92 else 0) or r < 0.92
            if s == z and i < j and x.split()[0] == y.split()[0] and r >= 0.92:
                want[s, f"u{i}", f"u{j}"] = r
    assert {(r["store_id"], r["url_a"], r["url_b"]): r["ratio"] for r in C.near_titles(df).collect()} == want and len(want) > 20
    monkeypatch.undo()
    t = df.selectExpr("store_id", "run_id", "seq", "url", "title as norm", "'b' as block")
    assert C._cells(t).count() <= 9 * len(rows) < sum(len(r[2]) for r in rows)


def test_shared_characters_bound_the_ratio(spark):
    import difflib

    texts = ["", "a", "ab ba", "the quick brown fox", "the quick brown fax!", "éüß éüß", "xyz" * 40, "zyx" * 40]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts if a + b], "a string, b string")
    for a, b, bound in df.select("a", "b", P.shared_characters(F.col("a"), F.col("b"))).collect():
        assert bound >= difflib.SequenceMatcher(None, a, b).ratio() - 1e-9


def test_robots_of_a_host_with_many_rules(spark):
    rules = spark.range(100_000).selectExpr("'hot.example' as host", "concat('/d', id, '/') as path_prefix", "id % 2 = 0 as allow", "id as rule_order")
    rules = rules.union(spark.createDataFrame([("hot.example", "/d8/", False, 200_000), ("hot.example", "/", False, 300_000), ("b.example", "/x", False, 2), ("b.example", "/x/y", True, 1), ("b.example", "", True, 9)], rules.schema))
    rows = [(0, "https://hot.example/d8/a"), (1, "https://hot.example/d7/"), (2, "https://hot.example/e"), (3, "http://b.example/x/y"), (4, "http://b.example/x/z"), (5, "http://b.example"), (6, "http://c.example/x"), (7, None), (0, "https://hot.example/d8/a")]
    pages_ = spark.createDataFrame([(k, u, "clash", {"a": 1}) for k, u in rows], "page_id int, url string, path string, more map<string,int>")
    out = C.robots(pages_, rules)
    assert out.columns == [*pages_.columns, "allowed"]
    assert sorted((r["page_id"], r["allowed"]) for r in out.collect()) == [(0, True), (0, True), (1, False), (2, False), (3, True), (4, False), (5, True), (6, True), (7, True)]


def test_registered_domains(spark):
    suffixes = spark.createDataFrame([(x,) for x in ("com", "uk", "co.uk", "github.io", "io", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp")], "rule string")
    want = {
        "shop.example.com": "example.com", "a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "x.uk": "x.uk", "me.github.io": "me.github.io", "a.me.github.io": "me.github.io", "github.io": "github.io", "a.b.c.ck": "b.c.ck", "www.ck": "www.ck", "a.www.ck": "www.ck",
        "x.city.kawasaki.jp": "city.kawasaki.jp", "a.b.c.kawasaki.jp": "b.c.kawasaki.jp", "a.unknown": "a.unknown", "b.a.unknown": "a.unknown", "localhost": "localhost", "": "",
    }
    hosts = spark.createDataFrame([(h,) for h in [*want, "co.uk"]], "host string")
    assert {r["host"]: r["domain"] for r in C.registered_domains(hosts, suffixes).collect()} == want
    link = lambda u: [u]
    p = spark.createDataFrame([("s", "r", 0, "https://me.github.io/", link("https://you.github.io/returns")), ("t", "r", 0, "https://www.a.co.uk/", link("https://help.a.co.uk/returns"))], "store_id string, run_id string, seq long, url string, links array<string>")
    assert [r["store_id"] for r in C.off_domain_credit(p, ["return"], suffixes=suffixes).collect()] == ["t"]
    assert {r["store_id"] for r in C.off_domain_credit(p, ["return"]).collect()} == {"s", "t"}  # by the pattern alone


def test_shown_pages_are_not_broadcast(spark, sf_dir, monkeypatch):
    """Spark expects little of grouped pages, so a broadcast of them would come to the driver at any size; and pages are dealt by their number and parsed once."""
    from storegrain.plans import products

    monkeypatch.setattr(products, "TASK_PAGES", 50)
    made = products._part_pages(spark, sf_dir)
    assert made.rdd.getNumPartitions() == 1 + made.count() // 50 > 2
    plan = products.rendered_mismatches(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan and "MapInPandas" not in plan
