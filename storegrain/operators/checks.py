"""Checks over page tables. Pages have the keys store_id and run_id, and seq, the order of the crawl."""

from __future__ import annotations

import difflib
import math
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storegrain.functions import facts as X
from storegrain.functions import urls as U
from storegrain.operators.rules import KEY, small
from storegrain.sources.features import may_be_similar, ratio, shared_characters
from storegrain.sources.tables import landed

# Phrases of block pages, those that count only on short pages, and the visible length below which they do.
HARD_BLOCK = [
    "sorry, you have been blocked", "you are unable to access", "this website is using a security service to protect itself from online attacks", "the action you just performed triggered the security solution",
    "incapsula incident id", "your request has been blocked",
]
VAGUE_BLOCK = ["access denied", "reference #", "request unsuccessful"]
CHALLENGE = [
    "checking your browser", "just a moment...", "attention required! | cloudflare", "ddos-guard", "verifying you are human", "please wait while we verify", "needs to review the security of your connection",
    "enable javascript and cookies to continue", "checking if the site connection is secure", "please stand by, while we are checking your browser", "please complete the security check to access",
    "unusual traffic from your computer network",
]
CAPTCHA_WIDGETS = [
    "g-recaptcha", "recaptcha/api.js", "www.google.com/recaptcha", "hcaptcha.com/1/api.js", "h-captcha", "challenges.cloudflare.com/turnstile", "cf-turnstile", "captcha-delivery.com", "funcaptcha", "arkoselabs.com",
]
CAPTCHA_PHRASES = ["verify you are human", "complete the security check", "i'm not a robot"]
BLOCK_CHARS = 1200
SIMILAR = 0.92
# Names of placeholder images, prices and purchase words of product pages, claims, form fields and hints.
PLACEHOLDER = r"(?i)placeholder|default[-_]?product|no[-_]?image|coming[-_]?soon|sample[-_]?image|image[-_]?not[-_]?available|missing[-_]?image"
PRICE = r"(?i)(?:[$£€¥]|USD|EUR|GBP)\s?\d[\d,]*(?:\.\d{2})?|\d[\d,]*(?:\.\d{2})?\s?(?:USD|EUR|GBP|\$|£|€)"
AVAILABLE = r"(?i)add to cart|add to bag|buy now|in stock|out of stock|sold out|available|unavailable|pre-?order"
RETURN_PORTALS = ["loopreturns.com", "narvar.com", "happyreturns.com", "returnly.com", "aftership.com", "returngo.ai", "returbo.com", "returnscenter.com"]
RETURN_WORDS, CONTACT_WORDS = ["return", "refund", "exchange"], ["contact", "support", "help"]
#: Second-level names under which domains are registered, as far as they end like this; no suffix list is at hand.
PUBLIC_SECOND = r"(?:co|com|org|net|gov|edu|ac)\.[a-z]{2}"
SHIPPING_CLAIM = r"(?i)free shipping|ships? (worldwide|internationally|in \d+|same[- ]day|next[- ]day)|shipping (is free|included)|fast shipping|express shipping|flat[- ]rate shipping"
RETURNS_CLAIM = r"(?i)\d+[-\s]day(s)? (return|money[- ]back)|free returns?|no[- ]questions[- ]asked|hassle[- ]free returns?|money[- ]back guarantee|full refund|returns? accepted|satisfaction guarantee"
NAME_FIELD, EMAIL_FIELD, MESSAGE_FIELD = r"(?i)name|full[-_ ]?name|your[-_ ]?name|first[-_ ]?name", r"(?i)e-?mail", r"(?i)message|comment|enquiry|inquiry|details"
NEWSLETTER_HINT, CONTACT_HINT = r"(?i)newsletter|subscribe|signup|sign-up|sign_up", r"(?i)contact|enquiry|inquiry"
ACCOUNT_HINT, REVIEW_HINT = r"(?i)login|register|log-in|sign-in|signin", r"(?i)commentform|comment-form|wp-comments-post\.php"
NO_LEAD_KINDS = ["hidden", "submit", "button", "search", "checkbox", "radio", "file"]
# Titles of findings about required pages, %s being the page's label, and of a crawl that failed.
PAGE_TITLES = {
    "soft": "%s page could not be confirmed - content looks like a generic/catch-all page", "unsure": "%s page could not be verified",
    "language": "%s page could not be confirmed - site content language not recognized", "missing": "Missing required page: %s",
}
NO_CRAWL_TITLE = "Required-page presence could not be checked - this audit could not crawl the site"
# Page types that an audit requires, with their labels.
REQUIRED_PAGES = [("privacy_policy", "Privacy policy"), ("shipping_policy", "Shipping policy"), ("returns_policy", "Returns/refund policy"), ("terms_of_service", "Terms of service"), ("contact_about", "Contact info")]
# Page types that tell who runs a store.
IDENTITY_PAGES = ["homepage", "contact_about", "privacy_policy", "shipping_policy", "returns_policy", "terms_of_service"]


def links(pages: DataFrame) -> DataFrame:
    """(key, seq, url, link, internal): the distinct links of each page; www. is no part of a host, relative links are internal."""
    out = pages.select(*KEY, "seq", "url", F.explode(F.array_distinct("links")).alias("link"))
    out = out.filter(~U.is_asset(F.col("link")) & ~U.is_cart_action(F.col("link")) & (U.scheme(F.col("link")).isin("", "http", "https")) & ~F.rlike("link", F.lit(r"^(mailto|tel|javascript|data):")))
    return out.withColumn("internal", (U.netloc(F.col("link")) == "") | (U.root_host(F.col("link")) == U.root_host(F.col("url"))))


def insecure(pages: DataFrame) -> DataFrame:
    """(key, url, check_id, link): home pages without https, and http links inside https pages to the own host."""
    home = pages.filter((F.col("seq") == 0) & (U.scheme(F.col("url")) != "https")).select(*KEY, "url", F.lit("https_enforced").alias("check_id"), F.lit(None).cast("string").alias("link"))
    mixed = links(pages).filter(F.col("internal") & F.col("url").startswith("https://") & F.col("link").startswith("http://")).select(*KEY, "url", F.lit("https_mixed_content_link").alias("check_id"), "link")
    return home.unionByName(mixed)


def page_type(url: Column, is_home: Column, headings: Column, body: Column) -> Column:
    """Home page, else by URL, else by headings, else other if there is a heading, else by body."""
    said = F.array_join(headings, " ")
    return F.when(is_home, "homepage").otherwise(F.coalesce(U.url_type(U.path(url)), U.text_type(said), F.when(F.trim(said) != "", "blog_other"), U.text_type(body), F.lit("blog_other")))


def external_links(pages: DataFrame) -> DataFrame:
    """(key, url, check_id, link): one finding for each page that loads and link off its site."""
    return links(pages.filter("reachable") if "reachable" in pages.columns else pages).filter("not internal").select(*KEY, "url", F.lit("external_domain_link").alias("check_id"), "link")


def robots(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages with allowed: what the first robots rule (host, path_prefix, allow, rule_order) says that fits; allowed without one.

    Each distinct path is cut to the lengths that its host's rules have, and the cuts meet the rules by equality, of equal
    rules the first. So a host of very many rules costs a path as many rows as there are lengths, and no page column is grouped.
    Pages without a host, and hosts without rules, are allowed.
    """
    r = rules.groupBy(F.col("host").alias("h"), F.col("path_prefix").alias("prefix")).agg(F.min_by("allow", "rule_order").alias("allow"), F.min("rule_order").alias("rule_order"))
    lengths = r.groupBy("h").agg(F.sort_array(F.collect_set(F.char_length("prefix"))).alias("lengths"))
    p = pages.select(F.struct("*").alias("row"), U.netloc(F.col("url")).alias("robots_host"), U.path(F.col("url")).alias("robots_path"))
    places = p.select(F.col("robots_host").alias("h"), F.col("robots_path").alias("path")).distinct()
    cuts = places.join(small(lengths), "h").select("h", "path", F.explode(F.filter("lengths", lambda n: n <= F.char_length("path"))).alias("n"))
    hit = cuts.withColumn("prefix", F.left("path", F.col("n"))).join(small(r), ["h", "prefix"]).groupBy("h", "path").agg(F.min_by("allow", "rule_order").alias("said"))
    j = p.join(hit, (F.col("robots_host") == F.col("h")) & (F.col("robots_path") == F.col("path")), "left")
    return j.select("row.*", F.coalesce("said", F.lit(True)).alias("allowed"))


def _any_of(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def _short(html: Column) -> Column:
    return F.char_length(F.regexp_replace(html, r"<[^>]+>", " ")) < BLOCK_CHARS


def looks_bodyless(html: Column) -> Column:
    return F.coalesce((html != "") & ~F.contains(F.lower(html), F.lit("<body")), F.lit(False))


def looks_hard_block(html: Column) -> Column:
    """A page of a firewall: by phrases of its own, or by vague ones where little else is to be seen."""
    low = F.lower(html)
    return F.coalesce(_any_of(low, HARD_BLOCK) | (_any_of(low, VAGUE_BLOCK) & _short(html)), F.lit(False))


def looks_challenge(html: Column) -> Column:
    low = F.lower(html)
    return F.coalesce(_any_of(low, CHALLENGE) | (_any_of(low, CAPTCHA_WIDGETS) & _short(html)), F.lit(False))


def looks_captcha(html: Column) -> Column:
    low = F.lower(html)
    return F.coalesce(_any_of(low, CAPTCHA_WIDGETS) & (_short(html) | _any_of(low, CAPTCHA_PHRASES)), F.lit(False))


def failure_category(status: Column, html: Column, error: Column) -> Column:
    """Why a fetch gave no page; null if it did. error: null, network_error, blocked_ssrf, or anything else."""
    blocked = status.isin(401, 403) | looks_hard_block(html) | looks_challenge(html)
    return (
        F.when(status.isin(404, 410), "not_found").when(error == "blocked_ssrf", "blocked_ssrf").when(looks_captcha(html), "captcha_blocked").when(blocked, "bot_blocked").when(status == 429, "rate_limited")
        .when(error == "network_error", "network_error").when((status < 200) | (status >= 400), "http_error").when(error.isNotNull() | status.isNull() | (F.coalesce(html, F.lit("")) == "") | looks_bodyless(html), "unknown")
    )


def fetch_outcomes(fetches: DataFrame) -> DataFrame:
    """fetches (status, html, error) with failure_category, reachable, and cannot_verify: failed, but neither not found nor refused as a private address."""
    f = fetches.withColumn("failure_category", failure_category(F.col("status"), F.col("html"), F.col("error")))
    c = F.col("failure_category")
    return f.withColumns({"reachable": c.isNull(), "cannot_verify": c.isNotNull() & ~c.isin("not_found", "blocked_ssrf")})


def broken_pages(pages: DataFrame) -> DataFrame:
    """(key, url, check_id, confidence): pages that didn't load; those that couldn't be verified only where not the whole crawl failed."""
    ran = pages.groupBy(*KEY).agg(F.bool_or("reachable").alias("any"))
    j = pages.filter("not reachable").join(ran, KEY)
    return j.filter("not cannot_verify or any").select(*KEY, "url", F.lit("broken_internal_link").alias("check_id"), F.when(F.col("cannot_verify"), "cannot_verify").otherwise("confirmed").alias("confidence"))


def platform(probes: DataFrame) -> DataFrame:
    """(key, platform) from probe rows (path, status, namespaces, has_products, html), the first signal in this order.

    Namespaces of the index, the status of the product route, the core route, the product list, marks in the home page.
    """
    path, ok = F.col("path"), F.col("status") == 200
    spaces = lambda prefix: (path == "/wp-json/") & ok & F.coalesce(F.exists("namespaces", lambda n: n.startswith(prefix)), F.lit(False))
    marks = lambda p: (path == "/") & F.rlike("html", F.lit(p))
    signals = [
        (spaces("wc/"), "woocommerce"), (spaces("wp/"), "wordpress"), ((path == "/wp-json/wc/v3/products") & F.col("status").isin(200, 401, 403), "woocommerce"), ((path == "/wp-json/wp/v2/") & ok, "wordpress"),
        ((path == "/products.json") & ok & F.col("has_products"), "shopify"), (marks("(?i)woocommerce"), "woocommerce"),
        (marks(r"""(?i)wp-content|wp-includes|<meta[^>]+name=["']generator["'][^>]+content=["']WordPress"""), "wordpress"), (marks(r"(?i)cdn\.shopify\.com|Shopify\.theme|shopify-section|myshopify\.com"), "shopify"),
    ]
    rank = F.coalesce(*[F.when(seen, F.struct(F.lit(k).alias("r"), F.lit(name).alias("p"))) for k, (seen, name) in enumerate(signals)])
    return probes.groupBy(*KEY).agg(F.coalesce(F.min(rank)["p"], F.lit("unknown")).alias("platform"))


def product_text(pages: DataFrame) -> DataFrame:
    """(key, url, check_id): product pages with a text that names no price, no availability."""
    p = pages.filter("text <> ''")
    checks = F.array_compact(F.array(F.when(~F.rlike("text", F.lit(PRICE)), "generic_product_price_missing"), F.when(~F.rlike("text", F.lit(AVAILABLE)), "generic_product_availability_missing")))
    return p.select(*KEY, "url", F.explode(checks).alias("check_id"))


def image_checks(pages: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, url, src, check_id, confidence) of placeholder names, missing alt texts, and what probes (url, status, width, height, error) say.

    An image that answered with an error, or can't be decoded, is broken; one that didn't answer can't be verified.
    """
    i = pages.select(*KEY, "url", F.explode("images").alias("i")).select(*KEY, "url", "i.src", "i.alt").join(probes.withColumnRenamed("url", "src").withColumn("probed", F.lit(True)), "src", "left")
    one = lambda check, confidence: F.struct(F.lit(check).alias("check_id"), F.lit(confidence).alias("confidence"))
    probed = F.when(F.col("probed"), F.when(F.col("status") >= 400, one("product_image_broken", "confirmed")).when(F.col("status").isNull(), one("product_image_broken", "cannot_verify")).when(F.col("width").isNull(), one("product_image_broken", "potential_risk")).when((F.col("width") < 250) | (F.col("height") < 250), one("product_image_low_resolution", "confirmed")))
    checks = F.array_compact(F.array(F.when(F.rlike("src", F.lit(PLACEHOLDER)), one("product_image_placeholder_filename", "potential_risk")), F.when(F.trim(F.coalesce("alt", F.lit(""))) == "", one("product_image_missing_alt_text", "confirmed")), probed))
    return i.select(*KEY, "url", "src", F.explode(checks).alias("c")).select(*KEY, "url", "src", "c.*")


def leads(pages: DataFrame) -> DataFrame:
    """(key, url, action, kind, fields) of the contact and newsletter forms of pages (page_type, forms).

    Forms with a password, and those of accounts, reviews and comments, are none, whatever their fields.
    """
    f = pages.select(*KEY, "url", "page_type", F.explode("forms").alias("f"))
    fields = F.filter("f.fields", lambda x: ~x["kind"].isin(NO_LEAD_KINDS))
    f = f.select(*KEY, "url", "page_type", F.col("f.action").alias("action"), F.concat_ws(" ", "f.hint", "f.action").alias("hint"), fields.alias("fields"))
    email, message = F.exists("fields", _is_email), F.exists("fields", _is_message)
    n = F.size("fields")
    kind = (
        F.when(F.exists("fields", lambda x: x["kind"] == "password") | F.rlike("hint", F.lit(ACCOUNT_HINT)) | F.rlike("hint", F.lit(REVIEW_HINT)) | ~email, F.lit(None).cast("string"))
        .when(F.rlike("hint", F.lit(NEWSLETTER_HINT)), "newsletter").when((F.col("page_type") == "contact_about") | F.rlike("hint", F.lit(CONTACT_HINT)) | (message & (n >= 2)), "contact").when((n <= 2) & ~message, "newsletter")
    )
    return f.withColumn("kind", kind).filter("kind is not null").drop("page_type", "hint")


def _is_email(x: Column) -> Column:
    return (x["kind"] == "email") | F.rlike(x["hint"], F.lit(EMAIL_FIELD))


def _is_message(x: Column) -> Column:
    return (x["kind"] == "textarea") | F.rlike(x["hint"], F.lit(MESSAGE_FIELD))


def form_checks(pages: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, url, check_id, detail) of contact and newsletter forms. probes: page_url, action, status, error.

    detail: the fields that a contact form lacks, or the form's kind. A form that submits to its own page needs no probe.
    """
    f = leads(pages)
    named = lambda x: (x["kind"] == "text") & F.rlike(x["hint"], F.lit(NAME_FIELD)) & ~F.rlike(x["hint"], F.lit(EMAIL_FIELD))
    absent = F.array_join(F.array_compact(F.array(F.when(~F.exists("fields", named), "name"), F.when(~F.exists("fields", _is_email), "email"), F.when(~F.exists("fields", _is_message), "message"))), "/")
    weak = F.exists("fields", lambda x: _is_email(x) & (x["kind"] != "email") & ~x["required"] & x["pattern"].isNull())
    one = lambda check, detail: F.struct(F.lit(check).alias("check_id"), detail.alias("detail"))
    checks = F.array_compact(F.array(F.when((F.col("kind") == "contact") & (absent != ""), one("contact_form_missing_field", absent)), F.when(weak, one("form_email_field_weak_validation", F.col("kind")))))
    own = f.select(*KEY, "url", F.explode(checks).alias("c")).select(*KEY, "url", "c.*")
    page = lambda u: F.regexp_replace(F.regexp_replace(u, "#.*$", ""), "(?<=[^/])/+$", "")
    target = F.when(F.rlike("action", F.lit("^https?://")), F.col("action")).otherwise(F.concat(U.scheme(F.col("url")), F.lit("://"), U.netloc(F.col("url")), F.when(F.col("action").startswith("/"), F.col("action")).otherwise(F.concat(F.regexp_extract(U.path(F.col("url")), "^(.*/)?", 1), "action"))))
    p = f.filter("action <> '' and not rlike(action, '^(mailto:|javascript:|tel:|#)')").filter(page(target) != page(F.col("url")))
    p = p.join(probes.withColumnRenamed("page_url", "url"), ["url", "action"]).filter("error is not null or status >= 400")
    return own.unionByName(p.select(*KEY, "url", F.lit("form_action_unreachable").alias("check_id"), F.col("kind").alias("detail")))


def journeys(rows: DataFrame) -> DataFrame:
    """(product_url, check_id) of recorded purchase journeys: another price in the cart, or none; no shipping at the checkout; its first price below the product's.

    rows: product_url, product_price, cart_text, checkout_text; a step that was not reached has null.
    """
    cart, total = X.price_in(F.col("cart_text")), X.price_in(F.col("checkout_text"))
    seen = F.col("cart_text").isNotNull()
    checks = F.array_compact(F.array(
        F.when(seen & (F.abs(cart - F.col("product_price")) > 0.01), "purchase_journey_cart_price_mismatch").when(seen & cart.isNull(), "purchase_journey_cart_price_not_found"),
        F.when(F.col("checkout_text").isNotNull() & ~F.rlike("checkout_text", F.lit("(?i)shipping|delivery")), "purchase_journey_shipping_not_shown"), F.when(total < F.col("product_price") - 0.01, "purchase_journey_total_lower_than_product_price"),
    ))
    return rows.select("product_url", F.explode(checks).alias("check_id"))


#: Titles and characters of a part of a group of titles at most, and classes by which characters are counted.
PART_TITLES, PART_CHARACTERS, CLASSES = 256, 50_000, 96
CELL = ["g", "k", "up", "i", "j"]


def _cells(titles: DataFrame) -> DataFrame:
    """titles (key, seq, url, norm, block) dealt to the cells (CELL, side) in which they meet all titles of their block that are not too short or long.

    Titles of one block fall into classes k by the logarithm of their length, so wide that SIMILAR ones are of one class or of two next
    to each other. A class is cut into parts, and each two parts of it, or of it and the next one (up), make a cell.
    """
    width = math.log((2 - SIMILAR) / SIMILAR) * 1.001
    t = titles.select(*KEY, "seq", "url", "norm", F.xxhash64(*KEY, "block").alias("g"), F.floor(F.log(F.char_length("norm")) / width).cast("int").alias("k"))
    most = F.greatest(F.lit(1), F.least(F.lit(PART_TITLES), F.floor(F.lit(PART_CHARACTERS) / F.exp((F.col("k") + 1) * width))))
    n = t.groupBy("g", "k").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / most).cast("int"))
    n = n.groupBy("g").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("k", "parts"))).alias("parts")).filter("n > 1")  # a class for each length
    parts = lambda k: F.coalesce(F.try_element_at("parts", k), F.lit(0))
    k, i = F.col("k"), F.col("i")
    t = t.join(n, "g").withColumn("i", F.pmod(F.xxhash64("norm"), parts(k)).cast("int"))
    each = lambda n, cell: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), cell)
    cell = lambda *values: F.struct(*[x.cast("int").alias(c) for x, c in zip(values, [*CELL[1:], "side"], strict=True)])
    same = each(parts(k), lambda j: cell(k, F.lit(0), F.least(i, j), F.greatest(i, j), i > j))
    longer, shorter = each(parts(k + 1), lambda j: cell(k, F.lit(1), i, j, F.lit(0))), each(parts(k - 1), lambda j: cell(k - 1, F.lit(1), j, i, F.lit(1)))
    return t.select(*KEY, "seq", "url", "norm", "g", F.explode(F.concat(same, longer, shorter)).alias("cell")).select("g", "cell.*", *KEY, "seq", "url", "norm")


def places(text: str) -> dict[str, list[int]]:
    """Where each character stands in the second text of a comparison, as difflib counts them: without frequent ones in long texts."""
    at = {}
    for j, c in enumerate(text):
        at.setdefault(c, []).append(j)
    return at if len(text) < 200 else {c: js for c, js in at.items() if len(js) <= len(text) // 100 + 1}


def similarity(a: str, b: str, at: dict[str, list[int]], least: float = SIMILAR) -> float:
    """difflib's ratio of a and b, whose places are at; 0 as soon as it can't reach least. Only characters that have places are gone through."""
    seeds, both = [i for i, c in enumerate(a) if c in at], len(a) + len(b)
    todo, total, may = [(0, len(a), 0, len(b))], 0, min(len(a), len(b))
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i, j, n, runs, before = alo, blo, 0, {}, -2
        for p in seeds[bisect_left(seeds, alo) : bisect_left(seeds, ahi)]:
            runs, old = {}, runs if p == before + 1 else {}
            before, js = p, at[a[p]]
            for q in js[bisect_left(js, blo) : bisect_left(js, bhi)]:
                m = runs[q] = old.get(q - 1, 0) + 1
                if m > n:
                    i, j, n = p - m + 1, q - m + 1, m
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < ahi and j + n < bhi and a[i + n] == b[j + n]:
            n += 1
        total += n
        may -= min(ahi - alo, bhi - blo) - n
        for left in [(alo, i, blo, j), (i + n, ahi, j + n, bhi)] if n else []:
            if left[0] < left[1] and left[2] < left[3]:
                todo.append(left)
                may += min(left[1] - left[0], left[3] - left[2])
        if 2.0 * may / both < least:
            return 0.0
    return 2.0 * total / both


def _met(cell: tuple, rows: list[tuple], judged: bool) -> list[tuple]:
    """(key, seq_a, seq_b, url_a, url_b, ratio) of the titles (side, key, seq, url, norm) of a cell that share enough characters, judged: that are SIMILAR."""
    side, norms, blocks = np.array([r[0] for r in rows]), [r[-1] for r in rows], {}
    block = np.array([blocks.setdefault((*r[1:3], r[-1].split(" ", 1)[0]) if judged else r[1:3], len(blocks)) for r in rows])
    size = np.array([len(t) for t in norms])
    counts = np.stack([np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % CLASSES, minlength=CLASSES) for t in norms]).astype(np.int32)
    if cell[2] == 0 and cell[3] == cell[4]:
        x, y = np.triu_indices(len(rows), 1)
    else:
        x, y = (v.ravel() for v in np.meshgrid(np.flatnonzero(side == 0), np.flatnonzero(side == 1)))
    ok = (block[x] == block[y]) & (2.0 * np.minimum(size[x], size[y]) / (size[x] + size[y]) >= SIMILAR)
    x, y = x[ok], y[ok]
    ok = np.zeros(len(x), bool)
    for at in range(0, len(x), 8192):
        u, v = x[at : at + 8192], y[at : at + 8192]
        ok[at : at + 8192] = 2.0 * np.minimum(counts[u], counts[v]).sum(1) / (size[u] + size[v]) >= SIMILAR
    known, out = {}, []
    for u, v in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
        u, v = (u, v) if rows[u][3] < rows[v][3] else (v, u)
        r = SIMILAR
        if judged:
            if v not in known:
                known[v] = places(norms[v])
            r = similarity(norms[u], norms[v], known[v])
        if r >= SIMILAR:
            out.append((*rows[u][1:3], rows[u][3], rows[v][3], rows[u][4], rows[v][4], r))
    return out


def _title_pairs(titles: DataFrame, judged: bool) -> DataFrame:
    kinds, names = titles.schema, [*KEY, "seq_a", "seq_b", "url_a", "url_b", "ratio"]

    def run(batches):
        cell, rows = None, []
        for b in batches:
            found = []
            for r in b.itertuples(index=False, name=None):
                if r[:5] != cell:
                    found += _met(cell, rows, judged) if len(rows) > 1 else []
                    cell, rows = r[:5], []
                rows.append(r[5:])
            yield pd.DataFrame(found, columns=names)
        yield pd.DataFrame(_met(cell, rows, judged) if len(rows) > 1 else [], columns=names)

    cells, spark = _cells(titles), titles.sparkSession
    n = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # a cell has much to compare and few bytes
    of = lambda c: kinds[c].dataType.simpleString()
    schema = f"store_id {of('store_id')}, run_id {of('run_id')}, seq_a {of('seq')}, seq_b {of('seq')}, url_a {of('url')}, url_b {of('url')}, ratio double"
    return cells.repartition(n, *CELL).sortWithinPartitions(*CELL, "side").mapInPandas(run, schema)


def title_candidates(titles: DataFrame) -> DataFrame:
    """(key, seq_a, seq_b) of titles (key, seq, norm, block) of one block that may be SIMILAR, by their lengths and the characters that they share."""
    return _title_pairs(titles.withColumn("url", F.lit("")), judged=False).select(*KEY, "seq_a", "seq_b")


def near_titles(titles: DataFrame) -> DataFrame:
    """(key, url_a, url_b, ratio) of titles (key, seq, url, title) at least 0.92 alike but not equal, blocked on their first word.

    Titles that are equal come down to the first of them. All titles of a block and of about one length meet in cells of bounded size;
    counts of characters drop most pairs, and the rest are compared in sequence.
    """
    norm = F.lower(F.trim(F.regexp_replace("title", r"\s+", " ")))
    t = titles.withColumn("norm", norm).filter("norm <> ''").groupBy(*KEY, "norm").agg(F.min_by(F.struct("seq", "url"), "seq").alias("first"))
    t = landed(t.select(*KEY, "norm", F.col("first.seq").alias("seq"), F.col("first.url").alias("url"), F.split("norm", " ")[0].alias("block")), "titles")
    return _title_pairs(t, judged=True).select(*KEY, "url_a", "url_b", "ratio")


def same_titles(titles: DataFrame) -> DataFrame:
    """(key, norm, n_urls, first_url) of titles on two or more pages."""
    norm = F.lower(F.trim(F.regexp_replace("title", r"\s+", " ")))
    return titles.withColumn("norm", norm).filter("norm <> ''").groupBy(*KEY, "norm").agg(F.countDistinct("url").alias("n_urls"), F.min_by("url", "seq").alias("first_url")).filter("n_urls >= 2")


def soft_404(pages: DataFrame, baselines: DataFrame) -> DataFrame:
    """(key, url, matched, how): pages whose text is that of the run's probe (baselines: key, baseline), else of its home page, or at least 0.92 alike.

    The home page is the one of the lowest seq; a run may have no probe. Null texts are empty; a text has no match
    in an empty one but by equality. Pages that didn't load (reachable) take no part.
    """
    p = pages.filter("reachable") if "reachable" in pages.columns else pages
    t = p.select(*KEY, "url", "seq", F.coalesce("text", F.lit("")).alias("text"))
    first = pages.groupBy(*KEY).agg(F.min_by(F.struct("url", F.coalesce("text", F.lit("")).alias("text"), F.col("reachable").alias("ok") if "reachable" in pages.columns else F.lit(True).alias("ok")), "seq").alias("h"))
    home = first.select(*KEY, F.col("h.url").alias("home_url"), F.when(F.col("h.ok"), F.col("h.text")).alias("home"))
    j = t.join(home, KEY, "left").join(baselines.select(*KEY, "baseline"), KEY, "left").withColumn("home", F.when(F.col("url") != F.col("home_url"), F.col("home")))
    # hashes first; the ratio is computed only where lengths, then characters leave a chance
    j = j.select(*KEY, "url", X.compare_text(F.col("text")).alias("a"), X.content_hash(F.col("text")).alias("h"), *[x for c in ("baseline", "home") for x in (X.compare_text(F.col(c)).alias(f"{c}_text"), F.when(F.col(c).isNotNull(), X.content_hash(F.col(c))).alias(f"{c}_hash"))])
    equal = lambda c: F.coalesce(F.col("h") == F.col(f"{c}_hash"), F.lit(False))
    maybe = lambda c: F.coalesce(~equal(c) & (F.col("a") != "") & (F.col(f"{c}_text") != "") & may_be_similar(F.col("a"), F.col(f"{c}_text"), SIMILAR), F.lit(False))
    j = j.withColumns({f"{c}_equal": equal(c) for c in ("baseline", "home")} | {f"{c}_maybe": maybe(c) for c in ("baseline", "home")})
    j = j.filter("baseline_equal or home_equal or baseline_maybe or home_maybe")
    for c in ("baseline", "home"):
        j = j.withColumn(f"{c}_maybe", F.when(F.col(f"{c}_maybe"), shared_characters(F.col("a"), F.col(f"{c}_text")) >= SIMILAR).otherwise(F.lit(False)))
    j = j.filter("baseline_equal or home_equal or baseline_maybe or home_maybe")
    near = lambda c: ratio(F.when(F.col(f"{c}_maybe"), F.col("a")).otherwise("x"), F.when(F.col(f"{c}_maybe"), F.col(f"{c}_text")).otherwise("y")) >= SIMILAR
    j = j.withColumns({"near_baseline": near("baseline"), "near_home": near("home")})
    matched = F.when(F.col("baseline_equal") | F.col("near_baseline"), "baseline").when(F.col("home_equal") | F.col("near_home"), "homepage")
    how = F.when(F.when(matched == "baseline", F.col("baseline_equal")).otherwise(F.col("home_equal")), "exact").otherwise("near")
    return j.select(*KEY, "url", matched.alias("matched"), how.alias("how")).filter("matched is not null")


def signals(facts: DataFrame) -> DataFrame:
    """(fact, value, n_pages, n_stores, first_page) of facts (store_id, seq, fact, value): where each value stands."""
    return facts.groupBy("fact", "value").agg(F.count(F.lit(1)).alias("n_pages"), F.countDistinct("store_id").alias("n_stores"), F.min("seq").alias("first_page"))


def inconsistent(facts: DataFrame, most: int = 20) -> DataFrame:
    """(key, fact, n_values, found) of facts with more than one value in a run: all are counted, the first `most` named."""
    of = [*KEY, "fact"]
    f = facts.select(*of, "value").distinct()
    n = f.groupBy(*of).agg(F.count(F.lit(1)).alias("n_values")).filter("n_values > 1")
    first = f.withColumn("k", F.row_number().over(Window.partitionBy(*of).orderBy("value"))).filter(F.col("k") <= most)
    return n.join(first.groupBy(*of).agg(F.array_join(F.sort_array(F.collect_list("value")), ", ").alias("found")), of)


def repeated_blocks(pages: DataFrame, least: float = 0.9) -> DataFrame:
    """(key, url, tag, copies) of link blocks of four and more links that stand on one page three times or more.

    Blocks are alike if their link sequences have a ratio of `least` or more with the first block of a class. Only
    pages with three such blocks go to Python, and there a page is one group.
    """
    b = pages.select(*KEY, "url", F.filter("blocks", lambda b: F.size(b["hrefs"]) >= 4).alias("big")).filter(F.size("big") >= 3)

    def classes(batches):
        for part in batches:
            rows = []
            for store, run, url, big in part.itertuples(index=False):
                firsts = []
                for block in big:
                    hrefs = list(block["hrefs"])
                    for f in firsts:
                        if f[0] == block["tag"] and difflib.SequenceMatcher(None, f[1], hrefs).ratio() >= least:
                            f[2] += 1
                            break
                    else:
                        firsts.append([block["tag"], hrefs, 1])
                rows += [(store, run, url, tag, n) for tag, _, n in firsts if n >= 3]
            yield pd.DataFrame(rows, columns=["store_id", "run_id", "url", "tag", "copies"])

    return b.mapInPandas(classes, "store_id string, run_id string, url string, tag string, copies long")


def first_image_pages(pages: DataFrame) -> DataFrame:
    """(key, src, url): the first page that shows each image."""
    i = pages.select(*KEY, "seq", "url", F.posexplode("image_srcs").alias("pos", "src"))
    return i.groupBy(*KEY, "src").agg(F.min_by("url", F.struct("seq", "pos")).alias("url"))


def dominant_language(pages: DataFrame) -> DataFrame:
    """(key, lang): the language of most pages, of equal ones the first seen."""
    n = pages.filter("lang is not null").groupBy(*KEY, "lang").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    return n.groupBy(*KEY).agg(F.min_by("lang", F.struct((-F.col("n")).alias("n"), "seq")).alias("lang"))


def registrable(host: Column) -> Column:
    """The part of a host that is registered: the last two labels, or three where the last two are a public suffix such as co.uk."""
    return F.coalesce(F.nullif(F.regexp_extract(host, rf"([^.]+\.{PUBLIC_SECOND})$", 1), F.lit("")), F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)


def registered_domains(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(host, domain) of distinct hosts (host) by a table of public suffixes (rule), such as co.uk, *.ck and !www.ck.

    The longest rule that fits the last labels of a host counts, a rule with ! before all others and for one label less; * stands for
    one label; a host that no rule fits has its last label as suffix. The domain is the suffix and one label more, or
    the host where it has none. Only as many last labels are looked up as the longest rule has.
    """
    rules = suffixes.select(F.lower(F.trim("rule")).alias("rule")).filter("rule <> ''").distinct()
    most = rules.agg(F.max(F.size(F.split("rule", r"\.")))).first()[0] or 1
    h = hosts.select("host").distinct().withColumn("labels", F.split(F.lower("host"), r"\."))
    last = lambda k: F.array_join(F.slice("labels", -k, k), ".")
    forms = []
    for k in range(1, most + 1):
        wild = F.concat(F.lit("*."), last(k - 1)) if k > 1 else F.lit("*")
        for rule, first, n in ((last(k), 0, k), (wild, 0, k), (F.concat(F.lit("!"), last(k)), 1, k - 1)):
            forms.append(F.when(F.size("labels") >= k, F.struct(rule.alias("rule"), F.lit(first).alias("first"), F.lit(n).alias("n"))))
    found = h.select("host", F.explode(F.array_compact(F.array(*forms))).alias("f")).select("host", "f.*").join(small(rules), "rule").groupBy("host").agg(F.max(F.struct("first", "n")).alias("b"))
    n = F.coalesce(F.col("b.n"), F.lit(1)) + 1
    own = F.when(F.size("labels") >= n, F.array_join(F.slice("labels", -n, n), ".")).otherwise(F.lower("host"))
    return h.join(found, "host", "left").select("host", own.alias("domain"))


def off_domain_credit(pages: DataFrame, words: list[str], portals: list[str] = (), suffixes: DataFrame | None = None) -> DataFrame:
    """(key, link, found_on, matched_via): the first external link of a run to a known portal, or to another host of the same organisation whose URL has one of the words.

    pages: key, seq, url, links[, reachable]; the store's own host is that of the page with the lowest seq. Organisations
    are told apart by the public suffixes given, else by the pattern of `registrable`.
    """
    host = lambda u: F.regexp_replace(U.netloc(u), r":\d+$", "")
    base = pages.groupBy(*KEY).agg(F.min_by("url", "seq").alias("base")).select(*KEY, host(F.col("base")).alias("base"))
    p = pages.filter("reachable") if "reachable" in pages.columns else pages
    e = p.select(*KEY, "seq", "url", F.posexplode("links").alias("pos", "link")).filter(host(F.col("link")) != "").join(base, KEY)
    root = lambda c: F.regexp_replace(c, r"^www\.", "")
    e = e.withColumn("h", host(F.col("link"))).filter(root(F.col("h")) != root(F.col("base")))
    if suffixes is None:
        e = e.withColumns({"h_domain": registrable(F.col("h")), "base_domain": registrable(F.col("base"))})
    else:
        e = landed(e, "external-links")
        known = landed(registered_domains(e.select(F.col("h").alias("host")).union(base.select("base")), suffixes), "domains")
        for c in ("h", "base"):
            e = e.join(known.select(F.col("host").alias(c), F.col("domain").alias(f"{c}_domain")), c, "left")
    portal = F.col("h_domain").isin(list(portals)) if portals else F.lit(False)
    same = (F.col("h_domain") == F.col("base_domain")) & _any_of(F.lower("link"), words)
    e = e.filter(portal | same).withColumn("via", F.when(portal, "known_returns_portal").otherwise("same_organization_subdomain"))
    return e.groupBy(*KEY).agg(F.min_by(F.struct("link", F.col("url").alias("found_on"), F.col("via").alias("matched_via")), F.struct("seq", "pos")).alias("c")).select(*KEY, "c.*")


def returns_credit(pages: DataFrame) -> DataFrame:
    return off_domain_credit(pages, RETURN_WORDS, RETURN_PORTALS)


def contact_credit(pages: DataFrame) -> DataFrame:
    return off_domain_credit(pages, CONTACT_WORDS)


def claim_tasks(pages: DataFrame, soft: DataFrame | None = None) -> DataFrame:
    """(key, url, kind, policy_url): the home page and the first five product pages that make a shipping or returns claim, each with the first policy page of that kind.

    pages: key, seq, url, page_type, text[, reachable]; policy pages in soft (key, url) are passed over.
    """
    p = pages.filter("reachable") if "reachable" in pages.columns else pages
    w = Window.partitionBy(*KEY, "page_type").orderBy("seq")
    some = p.filter("page_type in ('homepage', 'product')").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= F.when(F.col("page_type") == "homepage", 1).otherwise(5))
    claims = F.array_compact(F.array(F.when(F.rlike("text", F.lit(SHIPPING_CLAIM)), "shipping"), F.when(F.rlike("text", F.lit(RETURNS_CLAIM)), "returns")))
    said = some.select(*KEY, "url", F.explode(claims).alias("kind"))
    policy = p.filter("page_type in ('shipping_policy', 'returns_policy')")
    policy = policy if soft is None else policy.join(soft.select(*KEY, "url"), [*KEY, "url"], "left_anti")
    policy = policy.groupBy(*KEY, F.regexp_extract("page_type", "^(.*)_policy$", 1).alias("kind")).agg(F.min_by("url", "seq").alias("policy_url"))
    return said.join(policy, [*KEY, "kind"]).select(*KEY, "url", "kind", "policy_url")


def required_pages(pages: DataFrame, soft: DataFrame, runs: DataFrame) -> DataFrame:
    """(key, check_id, page_type, title, severity, confidence, page_url): what keeps a run from having each of the required pages.

    A run of which no page loaded has one crawl_incomplete finding. Else, for a type without a genuine page: the first
    one that looks like a catch-all (soft: key, url, matched), else the first that couldn't be verified, else, in a
    language beyond U.LANGUAGES, that it couldn't be confirmed; else it is missing.
    pages: key, seq, url, page_type, reachable, cannot_verify, lang.
    """
    p = pages.join(soft.select(*KEY, "url", F.lit(True).alias("soft")), [*KEY, "url"], "left").withColumn("soft", F.coalesce("soft", F.lit(False)))
    first = lambda cond: F.min_by(F.when(cond, F.col("url")), F.when(cond, F.col("seq")))
    of = p.groupBy(*KEY, "page_type").agg(F.bool_or(F.col("reachable") & ~F.col("soft")).alias("genuine"), first(F.col("reachable") & F.col("soft")).alias("soft_url"), first(F.col("cannot_verify")).alias("unsure_url"))
    ran = pages.groupBy(*KEY).agg(F.bool_or("reachable").alias("any"), F.min_by("url", "seq").alias("home"))
    lang = dominant_language(pages.filter("reachable"))
    r = runs.select(*KEY).join(ran, KEY, "left").join(lang, KEY, "left")
    failed = r.filter("not coalesce(any, false)").select(*KEY, F.lit("crawl_incomplete").alias("check_id"), F.lit(None).cast("string").alias("page_type"), F.lit(NO_CRAWL_TITLE).alias("title"), F.lit("high").alias("severity"), F.lit("cannot_verify").alias("confidence"), F.col("home").alias("page_url"))
    types = F.array(*[F.struct(F.lit(t).alias("page_type"), F.lit(label).alias("label")) for t, label in REQUIRED_PAGES])
    every = r.filter("any").select(*KEY, "lang", F.explode(types).alias("t")).select(*KEY, "lang", "t.*").join(of, [*KEY, "page_type"], "left").filter("not coalesce(genuine, false)")
    no_language = F.col("lang").isNotNull() & ~F.col("lang").isin(U.LANGUAGES)
    case = lambda a, b, c, d: F.when(F.col("soft_url").isNotNull(), a).when(F.col("unsure_url").isNotNull(), b).when(no_language, c).otherwise(d)
    titles = [F.format_string(PAGE_TITLES[k], "label") for k in ("soft", "unsure", "language", "missing")]
    return failed.unionByName(
        every.select(
            *KEY, F.lit("required_page_present").alias("check_id"), "page_type",
            case(*titles).alias("title"),
            case(F.lit("high"), F.lit("high"), F.lit("medium"), F.lit("critical")).alias("severity"), case(F.lit("cannot_verify"), F.lit("cannot_verify"), F.lit("cannot_verify"), F.lit("confirmed")).alias("confidence"), F.coalesce("soft_url", "unsure_url").alias("page_url"),
        )
    )


def identity_signals(pages: DataFrame) -> DataFrame:
    """(key, kind, value, url, seq) of the mail addresses, phone numbers and street addresses on identity pages that loaded."""
    p = pages.filter(F.col("page_type").isin(IDENTITY_PAGES) & (F.col("text") != "") & (F.col("reachable") if "reachable" in pages.columns else F.lit(True)))
    has_digit = F.rlike("text", F.lit(r"\d"))
    none = F.array().cast("array<string>")
    each = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    found = F.concat(each("email", F.when(F.contains("text", F.lit("@")), X.emails(F.col("text"))).otherwise(none)), each("phone", F.when(has_digit, X.phones(F.col("text"))).otherwise(none)), each("address", F.when(has_digit, F.array_distinct(X.addresses(F.col("text")))).otherwise(none)))
    return p.select(*KEY, "url", "seq", F.explode(found).alias("s")).select(*KEY, "s.*", "url", "seq")


def identity_findings(pages: DataFrame, runs: DataFrame, shown: int = 20) -> DataFrame:
    """(key, check_id, severity, confidence, page_url, n_values, evidence): no contact at all; more than one mail address or phone number; a phone of another country.

    Values are counted whole; evidence names the first `shown` by value, each with the number of its pages and the first
    of them, so that no run has to fit into one row. Runs without an identity page that loaded have none of the first.
    """
    s = identity_signals(pages)
    values = s.groupBy(*KEY, "kind", "value").agg(F.count_distinct("url").alias("n"), F.min_by("url", "seq").alias("first"))
    w = Window.partitionBy(*KEY, "kind").orderBy("value")
    per = values.groupBy(*KEY, "kind").agg(F.count(F.lit(1)).alias("n_values"))
    top = values.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= shown).groupBy(*KEY, "kind")
    top = top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.format_string("%s (on %d page(s), first %s)", "value", "n", "first").alias("t")))), lambda x: x["t"]), "; ").alias("evidence"))
    many = per.filter("kind <> 'address' and n_values > 1").join(top, [*KEY, "kind"])
    text = F.lit(None).cast("string")
    row = lambda df, check, severity, confidence, url, n, evidence: df.select(*KEY, check.alias("check_id"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), url.alias("page_url"), n.alias("n_values"), evidence.alias("evidence"))
    several = row(many, F.format_string("business_identity_%s_consistency", "kind"), "medium", "potential_risk", text, F.col("n_values"), F.col("evidence"))
    checked = pages.filter(F.col("page_type").isin(IDENTITY_PAGES) & (F.col("reachable") if "reachable" in pages.columns else F.lit(True))).select(*KEY).distinct()
    none = runs.select(*KEY).join(checked, KEY, "left_semi").join(s.select(*KEY).distinct(), KEY, "left_anti")
    absent = row(none, F.lit("business_identity_present"), "critical", "confirmed", text, F.lit(0).cast("long"), text)
    phones = values.filter("kind = 'phone'").select(*KEY, F.col("value").alias("phone"), F.col("first").alias("url"))
    other = row(phone_countries(phones, pages), F.lit("business_identity_phone_country_mismatch"), "high", "potential_risk", F.col("url"), F.lit(1).cast("long"), F.format_string("%s has calling code +%s", "phone", "code"))
    return several.unionByName(absent).unionByName(other)


def phone_countries(phones: DataFrame, pages: DataFrame) -> DataFrame:
    """(key, phone, code, url): phones (key, phone, url) whose calling code names no country that an identity page of the run mentions, if these mention some."""
    known = [(code, name) for code, names in X.CALLING_NAMES.items() for name in names]
    low = F.lower("text")
    said = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(name)), F.lit(code)) for code, name in known])))
    p = pages.filter(F.col("page_type").isin(IDENTITY_PAGES) & (F.col("text") != "") & (F.col("reachable") if "reachable" in pages.columns else F.lit(True)))
    codes = p.select(*KEY, F.explode(said).alias("c")).groupBy(*KEY).agg(F.collect_set("c").alias("said"))  # as many as there are codes
    f = phones.withColumn("code", X.calling_code(F.col("phone"))).filter("code is not null").join(codes, KEY)
    return f.filter(~F.array_contains("said", F.col("code"))).select(*KEY, "phone", "code", "url")
