"""Product pages against platform product data, and the product feed's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storegrain.functions import facts as X
from storegrain.functions import urls as U

# Category by words of the platform's category names, in order; the category without any; words that a rule looks for.
CATEGORIES = [
    ("scooter", "electric_scooter"), ("electric scooter", "electric_scooter"), ("motor", "electric_motor"), ("electric motor", "electric_motor"), ("coffee", "coffee_machine"), ("espresso", "coffee_machine"),
    ("refrigerator", "refrigerator"), ("fridge", "refrigerator"), ("playhouse", "playhouse"), ("play house", "playhouse"),
]
NO_CATEGORY = "household_tool"
SAFETY_WORDS = ["warning", "choking hazard", "supervision", "adult assembly", "not suitable for"]
AGE_WORDS = ["age", "years", "months", "yrs"]
CERTIFICATION_WORDS = ["ul ", "ul2272", "ul 2272", "csa", "certified", "certification", "iec 62133"]
WARRANTY_WORDS = ["warranty", "guarantee"]
BATTERY_CATEGORIES, APPLIANCE_CATEGORIES = ["electric_scooter", "electric_motor"], ["coffee_machine", "refrigerator"]
# Least image sides, required fields.
LEAST_SIDE, GOOD_SIDE = 100, 800
REQUIRED = ["title", "description", "availability", "condition"]


def by_path(pages: DataFrame, products: DataFrame) -> DataFrame:
    """Pages (key, seq, url, ..) with the product (permalink, ..) of equal path; of several pages the first.

    Neither side is broadcast: both grow with the catalog, and what Spark expects of parsed or grouped pages is far below their size.
    """
    key = ["store_id", "run_id"]
    clean = lambda u: F.regexp_replace(U.path(u), "/+$", "")
    p = pages.withColumn("path", clean(F.col("url")))
    first = p.groupBy(*key, "path").agg(F.min_by(F.struct(*pages.columns), "seq").alias("page"))
    return products.withColumn("path", clean(F.col("permalink"))).join(first.hint("merge"), [*key, "path"], "left").drop("path")


def by_handle(pages: DataFrame, products: DataFrame) -> DataFrame:
    """The same by the last part of the page's path and the product's handle."""
    key = ["store_id", "run_id"]
    p = pages.withColumn("handle", F.element_at(F.split(F.regexp_replace(U.path(F.col("url")), "/+$", ""), "/"), -1))
    first = p.groupBy(*key, "handle").agg(F.min_by(F.struct(*pages.columns), "seq").alias("page"))
    return products.join(first.hint("merge"), [*key, "handle"], "left")


def shown(pages: DataFrame, *, theme: bool) -> DataFrame:
    """pages of products that loaded, with price and in_stock as they show them: theme tells availability as a boolean, else it is a stock status."""
    price, stock = ("theme_price", "theme_available") if theme else ("order_price", "order_stock")
    loaded = F.col("reachable") if "reachable" in pages.columns else F.lit(True)
    return pages.filter((F.col("page_type") == "product") & loaded).withColumns({"price": F.col(f"rendered.{price}"), "in_stock": F.col(f"rendered.{stock}")})


def mismatches(matched: DataFrame) -> DataFrame:
    """(key, url, check_id) where a product (price, in_stock, or variants of price and available) disagrees with its page (price, in_stock).

    With variants any price within 0.01 will do, and any available one makes the product available. What either side
    doesn't tell, a product without variants or without prices among them, is no mismatch.
    """
    key = ["store_id", "run_id"]
    m = matched.filter("page is not null")
    if "variants" in m.columns:
        prices = F.filter(F.transform("variants", lambda v: F.regexp_extract(F.replace(v["price"].cast("string"), F.lit(","), F.lit("")), r"[\d.]+", 0).try_cast("double")), lambda x: x.isNotNull())
        price_ok = F.when(F.size(prices) > 0, F.exists(prices, lambda x: F.abs(x - F.col("page.price")) <= 0.01))
        stock, names = F.when(F.size("variants") > 0, F.exists("variants", lambda v: F.coalesce(v["available"], F.lit(False)))), ("shopify_price_mismatch", "shopify_availability_mismatch")
    else:
        price_ok, stock, names = F.abs(F.col("price") - F.col("page.price")) <= 0.01, F.col("in_stock"), ("woocommerce_price_mismatch", "woocommerce_stock_mismatch")
    checks = F.array_compact(F.array(F.when(F.col("page.price").isNotNull() & ~price_ok, names[0]), F.when(F.col("page.in_stock").isNotNull() & (stock != F.col("page.in_stock")), names[1])))
    return m.select(*key, F.col("page.url").alias("url"), F.explode(checks).alias("check_id"))


def unmatched(pages: DataFrame, matched: DataFrame) -> DataFrame:
    key = ["store_id", "run_id"]
    return pages.join(matched.filter("page is not null").select(*key, F.col("page.url").alias("url")), [*key, "url"], "left_anti")


def product_images(pages: DataFrame, api: DataFrame) -> DataFrame:
    """(key, url, src, alt, source): images by the platform where it has the page's, else those of the page."""
    key = ["store_id", "run_id"]
    a = api.select(*key, "url", F.explode("images").alias("i")).select(*key, "url", "i.src", "i.alt", F.lit("api").alias("source"))
    own = pages.join(a.select(*key, "url").distinct(), [*key, "url"], "left_anti")
    return a.unionByName(own.select(*key, "url", F.explode("images").alias("i")).select(*key, "url", "i.src", "i.alt", F.lit("page").alias("source")))


def normalized_feed(raw: DataFrame) -> DataFrame:
    """Feed products of raw platform rows (id, name, description, short_description, sku, price, regular_price, weight, dimensions, images, meta_data, categories, attributes, stock_status).

    The category is that of the first category name that has one of the words. A meta key is found without its leading
    underscore, whatever its case, by the first entry that has it. Sides are those of the dimensions if any is given.
    """
    known = lambda *names: F.get(F.filter("meta_data", lambda m: F.lower(F.regexp_replace(m["key"], "^_+", "")).isin(*names)), F.lit(0))["value"]
    meta = lambda *names: F.nullif(known(*names), F.lit(""))
    number = lambda c: F.nullif(c, F.lit("")).try_cast("double")
    category = lambda c: F.coalesce(*[F.when(F.contains(F.lower(F.coalesce(c["name"], c["slug"], F.lit(""))), F.lit(word)), F.lit(kind)) for word, kind in CATEGORIES])
    kind = F.coalesce(F.get(F.filter(F.transform("categories", category), lambda k: k.isNotNull()), F.lit(0)), F.lit(NO_CATEGORY))
    price = F.coalesce(F.nullif("price", F.lit("")), F.nullif("regular_price", F.lit(""))).try_cast("double")
    condition = F.lower(meta("condition"))
    side = lambda c: F.coalesce(number(F.col(f"dimensions.{c}")), F.lit(0.0)).alias(c)
    sides = F.when(F.coalesce(*[F.nullif(F.col(f"dimensions.{c}"), F.lit("")) for c in ("length", "width", "height")]).isNotNull(), F.struct(side("length"), side("width"), side("height")))
    images = F.transform(F.filter("images", lambda i: i["src"] != ""), lambda i: F.struct(i["src"].alias("url"), F.lit(None).cast("int").alias("width_px"), F.lit(None).cast("int").alias("height_px")))
    return raw.select(
        F.concat(F.lit("woocommerce-"), F.col("id").cast("string")).alias("id"), F.col("id").cast("string").alias("source_id"), F.coalesce("name", F.lit("")).alias("title"), F.coalesce(F.nullif("description", F.lit("")), "short_description", F.lit("")).alias("description"),
        price.alias("price"), price.alias("landing_page_price"), images.alias("images"), meta("gtin", "ean", "upc").alias("gtin"), F.nullif("sku", F.lit("")).alias("mpn"), kind.alias("category"),
        F.when(condition.isin("new", "used", "refurbished"), condition).otherwise("new").alias("condition"), F.when(F.col("stock_status") == "instock", "in_stock").otherwise(F.coalesce("stock_status", F.lit("out_of_stock"))).alias("availability"),
        number(F.col("weight")).alias("shipping_weight_kg"), sides.alias("shipping_dims_cm"), F.map_from_entries(F.array_distinct(F.filter("attributes", lambda a: a["key"] != ""))).alias("attributes"),
    )


def category_rules(products: DataFrame) -> list[Column]:
    """(rule, severity) structs of the rules of a product's category, null where they hold. Words are looked for in title, description and attribute values."""
    col, kinds = F.col, dict(products.dtypes)
    v = lambda cond, rule, severity: F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))
    values = F.array_join(F.map_values("attributes"), " ") if "attributes" in kinds else F.lit("")
    blob = F.lower(F.concat_ws(" ", "title", "description", values))
    said = lambda words: F.coalesce(F.rlike(blob, F.lit("|".join(w.replace(".", r"\.") for w in words))), F.lit(False))
    attribute = lambda name: F.coalesce(F.try_element_at(col("attributes"), F.lit(name)) != "", F.lit(False)) if "attributes" in kinds else F.lit(False)
    weight = col("shipping_weight_kg") if "shipping_weight_kg" in kinds else F.lit(None).cast("double")
    playhouse, battery, appliance = col("category") == "playhouse", col("category").isin(BATTERY_CATEGORIES), col("category").isin(APPLIANCE_CATEGORIES)
    return [
        v(playhouse & ~attribute("age_grade") & ~said(AGE_WORDS), "playhouse_age_grading", "critical"), v(playhouse & ~said(SAFETY_WORDS), "playhouse_safety_warning", "critical"),
        v(battery & ~attribute("certification") & ~said(CERTIFICATION_WORDS), "battery_safety_certification", "critical"), v(battery & weight.isNull(), "shipping_weight_present", "warning"),
        v(appliance & (col("condition") != "new") & ~said(WARRANTY_WORDS), "warranty_disclosure", "warning"), v(appliance & said(["energy star", "energy-star"]) & ~attribute("energy_rating"), "energy_claim_substantiation", "warning"),
    ]


def feed_violations(products: DataFrame) -> DataFrame:
    """(id, rule, severity) of feed products by the fixed rules and those of their category."""
    v = lambda cond, rule, severity: F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))
    col, kinds = F.col, dict(products.dtypes)
    side = F.least(F.array_min(F.transform("images", lambda i: i["width_px"])), F.array_min(F.transform("images", lambda i: i["height_px"]))) if "images" in kinds else F.lit(None).cast("int")
    rules = [
        v(F.coalesce(col("gtin"), F.lit("")) == "", "gtin_present", "warning"), v(F.abs(col("price") - col("landing_page_price")) > 0.01, "price_match", "critical"), v(col("price").isNull() | (col("price") <= 0), "price_positive", "critical"),
        v(side < LEAST_SIDE, "image_size", "critical"), v((side >= LEAST_SIDE) & (side < GOOD_SIDE), "image_size", "warning"),
        *[v(F.coalesce(F.trim(c), F.lit("")) == "", f"required_{c}", "critical") for c in REQUIRED], *category_rules(products),
    ]
    return products.select("id", F.explode(F.array_compact(F.array(*rules))).alias("v")).select("id", "v.*")


def evaluated(products: DataFrame, violations: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, rule, severity, source, manual_review): rule violations and those a model named; no or broken answer means manual review."""
    schema = "array<struct<rule:string,severity:string>>"
    a = products.select("id").join(answers, "id", "left").withColumn("parsed", F.from_json("answer", schema, {"mode": "PERMISSIVE"}))
    review = a.select("id", F.col("parsed").isNull().alias("manual_review"))
    model = a.select("id", F.explode("parsed").alias("v")).select("id", "v.rule", "v.severity", F.lit("model").alias("source"))
    both = violations.select("id", "rule", "severity", F.lit("rule").alias("source")).unionByName(model)
    return review.join(both, "id", "left")


def gate(violations: DataFrame) -> DataFrame:
    """Counts by severity over a feed, and whether it is clean: without a critical violation."""
    n = violations.agg(F.count_if(F.col("severity") == "critical").alias("n_critical"), F.count_if(F.col("severity") == "warning").alias("n_warning"))
    return n.withColumn("clean", F.col("n_critical") == 0)


def _kinds(v: Column) -> Column:
    """The @type of an object, one or a list, in lower case."""
    several, one = F.try_variant_get(v, "$['@type']", "array<string>"), F.try_variant_get(v, "$['@type']", "string")
    return F.transform(F.coalesce(several, F.array(one)), F.lower)


def _scalar(v: Column, path: str) -> Column:
    """The text of a string or number that says something; null for all else."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(~F.rlike(kind, F.lit("OBJECT|ARRAY|VOID")), F.nullif(F.try_variant_get(v, path, "string"), F.lit("")))


def _price(v: Column, path: str) -> Column:
    """A number as it is, a text if it is a plain number without its thousands separators."""
    text = F.trim(F.replace(_scalar(v, path), F.lit(","), F.lit("")))
    is_number = F.rlike(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("BIGINT|DOUBLE|FLOAT|DECIMAL"))
    return F.when(is_number | F.rlike(text, F.lit(r"^\d+(\.\d+)?$")), text)


def _gtin(v: Column) -> Column:
    return F.coalesce(*[X.gtin(_scalar(v, f"$.{k}")) for k in ("gtin14", "gtin13", "gtin12", "gtin8", "gtin")])


def structured_products(pages: DataFrame) -> DataFrame:
    """(key, seq, k, url, price, currency, availability, condition, brand, gtin, mpn, sku, variant_key) of the product nodes of product pages' structured data.

    A node is a product if one of its types is, whatever its case. It gives a row without variant_key that has its brand and condition
    and, where it has no offers, its identifiers; and a row for each offer with price, currency of a price, availability and
    the identifiers of the offer, else of its node. An aggregate offer has its lowest price, and each offer inside it is one
    more row. The key of a variant is its gtin, else mpn, else sku, else a hash of the offer. price is text. k numbers
    the rows of a page. Pages that didn't load, or are of another type where page_type is given, have none.
    """
    for column, keeps in (("page_type", F.col("page_type") == "product"), ("reachable", F.col("reachable"))):
        pages = pages.filter(keeps) if column in pages.columns else pages
    n = pages.select("store_id", "run_id", "seq", "url", F.posexplode("nodes").alias("i", "node")).withColumn("v", F.try_parse_json("node"))
    n = n.filter(F.exists(_kinds(F.col("v")), lambda t: t == "product")).drop("node")
    v, o = F.col("v"), F.col("o")
    listed = F.coalesce(F.try_variant_get(v, "$.offers", "array<variant>"), F.array(F.try_variant_get(v, "$.offers", "variant")))
    inner = lambda x: F.coalesce(F.try_variant_get(x, "$.offers", "array<variant>"), F.array().cast("array<variant>"))
    aggregate = lambda x: F.coalesce(F.exists(_kinds(x), lambda t: t == "aggregateoffer"), F.lit(False))
    offers = F.flatten(F.transform(listed, lambda x: F.when(aggregate(x), F.concat(F.array(x), inner(x))).otherwise(F.array(x))))
    offers = F.filter(offers, lambda x: F.rlike(F.schema_of_variant(x), F.lit("^OBJECT")))
    n = n.withColumn("offers", offers)
    e = n.select("*", F.posexplode(F.concat(F.array(F.lit(None).cast("variant")), "offers")).alias("j", "o"))
    whole, bare = F.col("j") == 0, F.size("offers") == 0
    price = F.when(aggregate(o), _price(o, "$.lowPrice")).otherwise(_price(o, "$.price"))
    either = lambda c: F.when(whole, F.when(bare, c(v))).otherwise(F.coalesce(c(o), c(v)))
    gtin, mpn, sku = either(_gtin), either(lambda x: X.identifier(_scalar(x, "$.mpn"))), either(lambda x: X.identifier(_scalar(x, "$.sku")))
    brand, condition = F.trim(F.coalesce(_scalar(v, "$.brand.name"), _scalar(v, "$.brand"))), _scalar(v, "$.itemCondition")
    rows = e.select(
        "store_id", "run_id", "seq", (F.col("i") * 1000 + F.col("j")).alias("k"), "url", price.alias("price"), F.when(price.isNotNull(), F.upper(_scalar(o, "$.priceCurrency"))).alias("currency"),
        F.when(_scalar(o, "$.availability").isNotNull(), X.availability(_scalar(o, "$.availability"))).alias("availability"), F.when(whole & condition.isNotNull(), X.condition(condition)).alias("condition"),
        F.when(whole, F.nullif(brand, F.lit(""))).alias("brand"), gtin.alias("gtin"), mpn.alias("mpn"), sku.alias("sku"),
        F.when(~whole, F.coalesce(gtin, mpn, sku, F.left(F.sha2(F.to_json(o).cast("binary"), 256), F.lit(16)))).alias("variant_key"),
    )
    said = ["price", "currency", "availability", "condition", "brand", "gtin", "mpn", "sku"]
    return rows.filter(F.coalesce(*said).isNotNull())


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
