"""Ranking an inventory of URLs into a crawl plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storegrain.functions import urls as U
from storegrain.operators.rules import KEY

#: Pages of one plan at most, whatever its budget; so a store's rows are cut before they are ranked.
MOST_PAGES = 500


def category(url: Column, found_on: Column, found_on_type: Column) -> Column:
    """The collection page that a product URL was found on, else its parent path."""
    parent = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(U.path(url), "/+$", ""), "/[^/]*$", ""), F.lit("")), F.lit("/"))
    return F.when(found_on_type == "collection", found_on).otherwise(parent)


def capped(urls: DataFrame, by: list[str], order: list[str], cap: int) -> DataFrame:
    """At most `cap` rows of each group of `by`, in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return urls.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= cap).drop("k")


def first_seen(urls: DataFrame, order: list[str]) -> DataFrame:
    """(key, url, first): each URL of a run once, where it was seen first."""
    return urls.groupBy(*KEY, "url").agg(F.min(F.struct(*order)).alias("first"))


def interleaved(pages: DataFrame) -> DataFrame:
    """(key, url, child, parent): the first links of all pages of a run, then the second ones; each URL at its first place. pages: key, seq, links."""
    links = pages.select(*KEY, F.col("seq").alias("parent"), F.posexplode("links").alias("child", "url"))
    return first_seen(links, ["child", "parent"]).select(*KEY, "url", "first.child", "first.parent")


def page_budget(catalog: Column, listed: Column | None = None, default: int = 60, least: int = 60) -> Column:
    """Twice the catalog's pages and 40; without any the sitemap's URLs (listed); each not below `least`; without either the default."""
    by_catalog = F.greatest(F.lit(least), F.bround(2.0 * catalog).cast("long") + 40)
    return by_catalog if listed is None else F.when(catalog > 0, by_catalog).when(listed > 0, F.greatest(F.lit(least), listed)).otherwise(F.lit(default))


def plan(urls: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, url, tier, pos): per run its home page (tier 0), overview pages (1) up to max(10, a third of the budget), then catalog pages and others; budget rows in all.

    budgets: key, budget. No plan has more than MOST_PAGES rows, so each tier is cut to these before the shuffle.
    """
    kind = F.when(F.col("tier") == 0, 0).when(F.col("tier") == 1, 1).otherwise(2)
    w = Window.partitionBy(*KEY, "kind").orderBy("tier", "pos", "url")
    most = urls.select(*KEY, "url", "tier", "pos", kind.alias("kind")).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= MOST_PAGES)
    budget = F.least(F.col("budget").cast("long"), F.lit(MOST_PAGES))
    j = most.join(budgets.select(*KEY, budget.alias("budget")), KEY)
    cap = F.when(F.col("kind") == 0, 1).when(F.col("kind") == 1, F.greatest(F.lit(10), F.floor(F.col("budget") / 3))).otherwise(F.col("budget"))
    all_ = Window.partitionBy(*KEY).orderBy("tier", "pos", "url")
    return j.filter(F.col("k") <= cap).withColumn("k", F.row_number().over(all_)).filter(F.col("k") <= F.col("budget")).select(*KEY, "url", "tier", "pos")


def risk_sample(pages: DataFrame, cap: int = 50, cheap_share: float = 0.1) -> DataFrame:
    """(key, url, score): product pages most worth a look: cheap and thin ones first, then by seq.

    pages: key, seq, url, price, n_words. Cheap: the lowest tenth of prices, rounded up, where five pages or more
    have one. Thin: 1 to 39 words. The size is at most cap, at least five, else a twentieth of the pages.
    """
    key = KEY
    n = pages.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("priced"))
    by_price = Window.partitionBy(*key).orderBy(F.col("price").asc_nulls_last(), "seq")
    p = pages.join(n, key).withColumn("k", F.row_number().over(by_price))
    cheap = (F.col("priced") >= 5) & F.col("price").isNotNull() & (F.col("k") <= F.greatest(F.lit(1), F.ceil(cheap_share * F.col("priced"))))
    score = F.when(cheap, 1).otherwise(0) + F.when(F.col("n_words").between(1, 39), 1).otherwise(0)
    p = p.withColumn("score", score)
    by_score = Window.partitionBy(*key).orderBy(F.desc("score"), "seq")
    size = F.least(F.lit(cap), F.greatest(F.lit(5), F.ceil(0.05 * F.col("n"))))
    return p.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= size).select(*key, "url", "score")


def sample_coverage(pages: DataFrame, sample: DataFrame) -> DataFrame:
    """(key, n_products, n_checked, coverage, is_partial) of sampled product pages; coverage is null without products."""
    n = pages.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_products"))
    k = sample.groupBy(*KEY).agg(F.count(F.lit(1)).alias("k"))
    checked = F.coalesce("k", F.lit(0).cast("long"))
    return n.join(k, KEY, "full_outer").select(*KEY, F.coalesce("n_products", F.lit(0).cast("long")).alias("n_products"), checked.alias("n_checked"), F.try_divide(checked, F.col("n_products")).alias("coverage"), (checked < F.coalesce("n_products", F.lit(0))).alias("is_partial"))


def image_work(images: DataFrame, cap: int = 5) -> tuple[DataFrame, DataFrame]:
    """(key, url, image_url) of the first image of the first `cap` product pages of a run that have one, and the distinct images (image_url) of these, which a model has to see.

    images: key, seq, url, pos, image_url[, page_type, reachable]; seq is the page's place in the run. Pages that didn't load take no part.
    """
    for column, keeps in (("page_type", F.col("page_type") == "product"), ("reachable", F.col("reachable"))):
        images = images.filter(keeps) if column in images.columns else images
    first = images.groupBy(*KEY, "url").agg(F.min("seq").alias("seq"), F.min_by("image_url", F.struct("pos", "image_url")).alias("image_url"))
    shown = capped(first, KEY, ["seq", "url"], cap).select(*KEY, "url", "image_url")
    return shown, shown.select("image_url").distinct()
