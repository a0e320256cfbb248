"""Queries over crawled pages, and over documents as pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storegrain.functions import facts as X
from storegrain.functions import urls as U
from storegrain.operators import checks as C
from storegrain.operators import history as H
from storegrain.operators import findings as N
from storegrain.plans import read
from storegrain.sources import features as P



def pages(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "url", *more)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows of pages, with the keys; a store is a host."""
    return P.page_features(pages(spark, sf_dir, "html")).select(U.netloc(F.col("url")).alias("store_id"), F.lit("r1").alias("run_id"), F.col("page_id").alias("seq"), "url", "title", "lang", "headings", "links", "text", "main_text", "tags", "blocks")


# The same steps on URLs in DuckDB: the query's kept parameters, and the canonical forms.
URL_SQL = r"""
with u as (
  select page_id, url, regexp_extract(url, '^[^?#]*') as base, regexp_extract(url, '#.*$') as frag,
    array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda kv: kv <> ''
      and lower(string_split(kv, '=')[1]) not in ('on-sale', 'in-stock', 'on-backorder', 'featured')
      and not starts_with(lower(string_split(kv, '=')[1]), 'filter_') and not starts_with(lower(string_split(kv, '=')[1]), 'query_type_')), '&') as kept
  from pages),
q as (select *, case when kept = '' then '' else '?' || kept end as query from u)
"""


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", U.normalized(u).alias("normalized"), U.page_key(u).alias("page_key"), U.run_key(u).alias("run_key"))


CANONICAL_SQL = URL_SQL + r"""
select page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') || query as normalized,
  regexp_replace(base, '/page/\d+/?$', '') || query as page_key,
  lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') as run_key
from q
"""


def facet_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, fragment = F.regexp_extract("url", "^[^#]*", 0), F.regexp_extract("url", "#.*$", 0)
    query = F.concat_ws("&", F.concat(base, F.when(F.contains(base, F.lit("?")), "").otherwise("?x=1")), F.lit("filter_color=red"), F.lit("featured=1"), F.lit("keep=2"))
    return pages(spark, sf_dir).select("page_id", U.strip_facets(F.concat(query, fragment)).alias("stripped"))


FACET_SQL = "select page_id, regexp_extract(url, '^[^#]*') || (case when contains(regexp_extract(url, '^[^#]*'), '?') then '' else '?x=1' end) || '&keep=2' || regexp_extract(url, '#.*$') as stripped from pages"


def pagination_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rollup: the pages as numbered pages of their first path part, with facets, by the key that leaves both out, and the shortest URL of each."""
    first = F.concat(F.regexp_extract("url", "^[^/]*//[^/?#]*", 0), F.lit("/"), F.split(U.path(F.col("url")), "/")[1])
    facets = F.when(F.col("page_id") % 3 == 0, "?filter_size=xl&featured=1").when(F.col("page_id") % 3 == 1, "?Query_Type_color=or").otherwise("")
    listed = F.concat(first, F.when(F.col("page_id") % 5 > 0, F.concat(F.lit("/page/"), F.col("page_id"), F.when(F.col("page_id") % 2 == 0, "/").otherwise(""))).otherwise(""), facets)
    p = pages(spark, sf_dir).select("page_id", listed.alias("url"))
    return p.groupBy(U.page_key(F.col("url")).alias("page_group")).agg(F.count(F.lit(1)).alias("variants"), F.count_if(F.contains("url", F.lit("?"))).alias("with_query"), F.min_by("url", F.struct(F.char_length("url"), "page_id")).alias("representative"))


GROUPS_SQL = r"""
with p as (select page_id, regexp_extract(url, '^[^/]*//[^/?#]*') || '/' || string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/')[2] as page_group from pages),
u as (select *, page_group || case when page_id % 5 > 0 then '/page/' || page_id || case when page_id % 2 = 0 then '/' else '' end else '' end || case page_id % 3 when 0 then '?filter_size=xl&featured=1' when 1 then '?Query_Type_color=or' else '' end as url from p)
select page_group, count(*) as variants, count(*) filter (where contains(url, '?')) as with_query, arg_min(url, (length(url), page_id)) as representative from u group by 1
"""


def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed(spark, sf_dir)
    return p.select(F.col("seq").alias("page_id"), "lang", F.size("links").cast("long").alias("n_links"), F.size("headings").cast("long").alias("n_headings"), F.array_join(F.slice("links", 1, 3), " ").alias("first_links"))


FEATURES_SQL = r"""
select page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang, len(regexp_extract_all(html, '<a [^>]*href="')) as n_links,
  len(regexp_extract_all(html, '<h[12]>')) as n_headings, array_to_string(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)[1:3], ' ') as first_links
from pages
"""


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page links to the three pages before it by id, and to itself by a path."""
    p = pages(spark, sf_dir)
    back = p.select(F.explode(F.array(*[F.col("page_id") + k for k in (1, 2, 3)])).alias("page_id"), F.col("url").alias("link"))
    links = back.groupBy("page_id").agg(F.collect_set("link").alias("links"))  # three at most
    domain = F.regexp_extract(U.netloc(F.col("url")), r"([^.]+\.[^.]+)$", 1)
    return p.join(links, "page_id").select(domain.alias("store_id"), F.lit("r1").alias("run_id"), F.col("page_id").alias("seq"), "url", F.concat("links", F.array(U.path(F.col("url")))).alias("links"))


def internal_external_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.links(linked_pages(spark, sf_dir)).select(F.col("seq").alias("page_id"), "link", "internal")


LINKS_SQL = r"""
with p as (select page_id, url, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') as host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path from pages)
select distinct a.page_id, b.url as link, a.host = b.host as internal from p a join p b on a.page_id - b.page_id between 1 and 3
union all select page_id, path, true from p where page_id in (select page_id + k from pages, (values (1), (2), (3)) t(k))
"""


def external_link_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.external_links(linked_pages(spark, sf_dir)).select("store_id", "url", "check_id", "link").distinct()


EXTERNAL_SQL = "with l as (" + LINKS_SQL + r") select distinct regexp_extract(lower(regexp_extract(p.url, '://([^/?#]*)', 1)), '([^.]+\.[^.]+)$', 1) as store_id, p.url, 'external_domain_link' as check_id, link from l join pages p using (page_id) where not internal"


def insecure_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as the home page of its host, linking to the page after it."""
    p = pages(spark, sf_dir)
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next"))
    one = p.join(nxt, "page_id").select(F.col("page_id").cast("string").alias("store_id"), F.lit("r1").alias("run_id"), F.lit(0).cast("long").alias("seq"), "url", F.array(F.regexp_replace("next", r"://[^/?#]*", F.concat(F.lit("://"), U.netloc(F.col("url"))))).alias("links"))
    return C.insecure(one).select("store_id", "check_id", "link")


INSECURE_SQL = r"""
with p as (select a.page_id::varchar as store_id, a.url, regexp_replace(b.url, '://[^/?#]*', '://' || lower(regexp_extract(a.url, '://([^/?#]*)', 1))) as link from pages a join pages b on b.page_id = a.page_id + 1)
select store_id, 'https_enforced' as check_id, null as link from p where not starts_with(url, 'https:')
union all select store_id, 'https_mixed_content_link', link from p where starts_with(url, 'https:') and starts_with(link, 'http:')
"""


def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and crawl tiers of the pages by their URLs, headings and texts."""
    u = F.col("url")
    return parsed(spark, sf_dir).select(F.col("seq").alias("page_id"), C.page_type(u, U.path(u).isin("", "/"), F.col("headings"), F.left("main_text", F.lit(3000))).alias("page_type"), U.crawl_tier(U.path(u)).alias("tier"))


def _cases(column: str, rules: list, names: list | None = None) -> str:
    """SQL conditions of the rules in order. DuckDB's patterns have no look-ahead, so one of them is put otherwise."""
    return " ".join(f"when regexp_matches({column}, '{'|'.join(x.replace('(?!$)', '.') for x in patterns)}') then '{name}'" for name, patterns in rules if names is None or name in names)


TYPES_SQL = rf"""
with p as (
  select page_id, lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)) as path, lower(array_to_string(list_transform(regexp_extract_all(html, '<h[12][^>]*>([^<]*)', 1), lambda x: replace(x, '&amp;', '&')), ' ')) as said from pages)
select page_id, case when path in ('', '/') then 'homepage' {_cases('path', U.URL_RULES)} {_cases('said', U.TEXT_RULES)} else 'blog_other' end as page_type,
  case when regexp_matches(path, '{"|".join(x for n, ps in U.URL_RULES if n in U.OVERVIEW_TYPES for x in ps)}') then 0 {_cases('path', U.URL_RULES, ['product']).replace("'product'", "1")} else 2 end as tier from p
"""
#: Words of paths of every language and form, put before the paths of the given pages.
FORMS = [
    "cart", "panier", "checkout", "kasse", "my-account", "privacy-policy", "datenschutz", "aviso-de-privacidad", "informativa-sulla-privacy", "shipping_policy", "livraison", "versandkosten", "envios", "entrega", "refunds", "widerruf", "devolucion", "rimborso",
    "terms-of-use", "agb", "impressum", "mentions-legales", "faq", "preguntas-frecuentes", "kontakt", "a-propos", "chi-siamo", "basket", "products/blue-mug", "produkt/x", "shop/x", "shop", "collections/all", "categoria-prodotto/x", "blog/x", "plain",
]


def url_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types and tiers of the pages by URL alone: of their own paths, of these behind a word of some form, and of that word."""
    word = F.get(F.array(*map(F.lit, FORMS)), (F.col("page_id") % len(FORMS)).cast("int"))
    own = U.path(F.col("url"))
    p = pages(spark, sf_dir).select("page_id", F.explode(F.array(own, F.concat(F.lit("/"), word, own), F.concat(F.lit("/"), word))).alias("path"))
    return p.select("page_id", "path", F.coalesce(U.url_type(F.col("path")), F.lit("none")).alias("page_type"), U.crawl_tier(F.col("path")).alias("tier"))


FORMS_SQL = rf"""
with p as (select page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as own from pages),
q as (select page_id, unnest([own, '/' || {FORMS!r}[page_id % {len(FORMS)} + 1] || own, '/' || {FORMS!r}[page_id % {len(FORMS)} + 1]]) as path from p),
l as (select *, lower(path) as low from q)
select page_id, path, case {_cases('low', U.URL_RULES)} else 'none' end as page_type,
  case when regexp_matches(low, '{"|".join(x.replace('(?!$)', '.') for n, ps in U.URL_RULES if n in U.OVERVIEW_TYPES for x in ps)}') then 0 {_cases('low', U.URL_RULES, ['product']).replace("'product'", "1")} else 2 end as tier from l
"""


def dominant_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed(spark, sf_dir).withColumn("store_id", F.regexp_extract("store_id", r"([^.]+)$", 1))
    return C.dominant_language(p).select("store_id", "lang")


LANGUAGE_SQL = r"""
with p as (select page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang, regexp_extract(lower(regexp_extract(url, '://([^/?#]*)', 1)), '([^.]+)$', 1) as store_id from pages),
n as (select store_id, lang, count(*) as n, min(page_id) as first from p group by 1, 2)
select store_id, arg_min(lang, (-n, first)) as lang from n group by 1
"""


def content_dom_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("html", r"<[^>]+>", " ")
    return pages(spark, sf_dir, "html").select("page_id", X.content_hash(text).alias("content_hash"), P.dom_hash(F.transform(F.regexp_extract_all("html", F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1)), F.lower)).alias("dom_hash"))


# White space beyond ASCII is named, as DuckDB's class holds ASCII only.
HASH_SQL = r"""
select page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s\x0B\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) as content_hash,
  sha256(array_to_string(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1), '|')) as dom_hash from pages
"""


def changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of even number as the stored snapshots of a site, those of the next odd one as its snapshots of today; title and language stand for text and structure. Every seventh is not stored."""
    p = pages(spark, sf_dir, "html")
    seen = lambda pattern: F.md5(F.regexp_extract("html", pattern, 1).cast("binary"))
    s = p.select((F.col("page_id") - F.col("page_id") % 2).alias("page"), "page_id", seen(r"<title>\s*([A-Za-z]*)").alias("content_hash"), seen('<html lang="([a-z]+)"').alias("dom_hash"))
    stored, today = s.filter("page_id % 2 = 0 and page % 7 <> 0").drop("page_id"), s.filter("page_id % 2 = 1").drop("page_id")
    out = H.changed(today, stored, ["page"], ["content_hash", "dom_hash"])
    return out.select(F.col("page").alias("page_id"), F.when(F.col("old_dom_hash").isNull(), "new").otherwise("changed").alias("change"))


CHANGED_SQL = r"""
with s as (select page_id, regexp_extract(html, '<title>\s*([A-Za-z]*)', 1) as title, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang from pages),
j as (select n.page_id - 1 as page_id, o.page_id is null as fresh, n.title <> o.title or n.lang <> o.lang as differs from s n left join s o on o.page_id = n.page_id - 1 and o.page_id % 7 <> 0 where n.page_id % 2 = 1)
select page_id, case when fresh then 'new' else 'changed' end as change from j where fresh or differs
"""


def robots_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = pages(spark, sf_dir).select(U.netloc(F.col("url")).alias("host")).distinct()
    rows = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(allow).alias("a"), F.lit(k).alias("o")) for k, (p, allow) in enumerate([("/en/1", True), ("/en", False), ("/de", False)])])
    rules = hosts.filter("host not like 'www%'").select("host", F.explode(rows).alias("r")).select("host", F.col("r.p").alias("path_prefix"), F.col("r.a").alias("allow"), F.col("r.o").alias("rule_order"))
    return C.robots(pages(spark, sf_dir), rules).select("page_id", "allowed")


ROBOTS_SQL = r"""
with p as (select page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) as host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path from pages)
select page_id, case when host like 'www%' then true when starts_with(path, '/en/1') then true when starts_with(path, '/en') or starts_with(path, '/de') then false else true end as allowed from p
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("source").alias("store_id"), F.lit("r1").alias("run_id"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("url"), "text")


def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "part").select(F.lit("s").alias("store_id"), F.lit("r1").alias("run_id"), F.col("p_partkey").alias("seq"), F.col("p_partkey").cast("string").alias("url"), F.col("p_name").alias("title"))
    return C.same_titles(t).select("norm", "n_urls", "first_url")


DUPLICATE_SQL = r"select lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) as norm, count(distinct p_partkey) as n_urls, (min(p_partkey))::varchar as first_url from part group by 1 having count(distinct p_partkey) >= 2"


def near_duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of documents as titles of one run."""
    t = documents(spark, sf_dir).select(F.lit("all").alias("store_id"), "run_id", "seq", "url", F.split("text", "\n")[0].alias("title")).filter("title is not null")
    return C.near_titles(t).select("url_a", "url_b", F.round("ratio", 6).alias("ratio"))


def _baselines(d: DataFrame) -> DataFrame:
    """A probe of every run: the text of its first page with an odd number; runs without one have none."""
    return d.filter("seq % 2 = 1").groupBy("store_id", "run_id").agg(F.min_by(F.coalesce("text", F.lit("")), "seq").alias("baseline"))


def soft404_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return C.soft_404(d, _baselines(d)).filter("how = 'exact'").select("store_id", "url", "matched")


def soft404_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages that look like the probe or the home page, and how."""
    d = documents(spark, sf_dir)
    return C.soft_404(d, _baselines(d)).select("store_id", "url", "matched", "how")


SOFT_SQL = r"""
with d as (select source, doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x0B\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) as t from documents),
h as (select source, arg_min(t, doc_id) as home, min(doc_id) as home_id from d group by 1),
b as (select source, arg_min(t, doc_id) as base from d where doc_id % 2 = 1 group by 1)
select d.source as store_id, doc_id::varchar as url, case when d.t = base then 'baseline' else 'homepage' end as matched
from d left join b on d.source = b.source join h on d.source = h.source where d.t = base or (d.t = home and doc_id <> home_id)
"""


def document_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the crawls of their sources, 17 runs each; the number gives a page's type and how its fetch went."""
    from storegrain.operators.rules import PAGE_TYPES

    d = read(spark, sf_dir, "documents")
    kind = F.get(F.array(*map(F.lit, PAGE_TYPES)), (F.col("doc_id") % len(PAGE_TYPES)).cast("int"))
    return d.select(F.col("source").alias("store_id"), (F.col("doc_id") % 17).cast("string").alias("run_id"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("url"), kind.alias("page_type"), (F.col("doc_id") % 3 != 0).alias("reachable"), (F.col("doc_id") % 6 == 0).alias("cannot_verify"), F.when(F.col("doc_id") % 4 == 0, "pl").otherwise(F.col("lang")).alias("lang"), "text")


def required_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which required pages the runs lack; every seventh page counts as a soft 404."""
    p = document_audit(spark, sf_dir).drop("text")
    return C.required_pages(p, p.filter("seq % 7 = 0 and reachable"), p.select("store_id", "run_id").distinct())


REQUIRED_SQL = """
with t(page_type, label) as (values ('privacy_policy', 'Privacy policy'), ('shipping_policy', 'Shipping policy'), ('returns_policy', 'Returns/refund policy'), ('terms_of_service', 'Terms of service'), ('contact_about', 'Contact info')),
p as (
  select source as store_id, (doc_id % 17)::varchar as run_id, doc_id as seq, doc_id::varchar as url, doc_id % 3 <> 0 as ok, doc_id % 6 = 0 as unsure, doc_id % 7 = 0 as soft, case when doc_id % 4 = 0 then 'pl' else lang end as lang,
    ['homepage', 'product', 'collection', 'cart', 'checkout', 'privacy_policy', 'shipping_policy', 'returns_policy', 'terms_of_service', 'contact_about', 'faq', 'blog_other'][doc_id % 12 + 1] as page_type
  from documents),
r as (select store_id, run_id, bool_or(ok) as alive, arg_min(url, seq) as home from p group by 1, 2),
n as (select store_id, run_id, lang, count(*) as n, min(seq) as first from p where ok and lang is not null group by 1, 2, 3),
l as (select store_id, run_id, arg_min(lang, (-n, first)) as lang from n group by 1, 2),
g as (select store_id, run_id, page_type, bool_or(ok and not soft) as genuine, arg_min(url, seq) filter (where ok and soft) as soft_url, arg_min(url, seq) filter (where unsure) as unsure_url from p group by 1, 2, 3),
x as (
  select r.store_id, r.run_id, t.page_type, label, soft_url, unsure_url, lang not in ('en', 'es', 'fr', 'de', 'pt', 'it') as other
  from r cross join t left join g on g.store_id = r.store_id and g.run_id = r.run_id and g.page_type = t.page_type left join l on l.store_id = r.store_id and l.run_id = r.run_id
  where alive and not coalesce(genuine, false))
select store_id, run_id, 'required_page_present' as check_id, page_type,
  case when soft_url is not null then label || ' page could not be confirmed - content looks like a generic/catch-all page' when unsure_url is not null then label || ' page could not be verified'
    when other then label || ' page could not be confirmed - site content language not recognized' else 'Missing required page: ' || label end as title,
  case when coalesce(soft_url, unsure_url) is not null then 'high' when other then 'medium' else 'critical' end as severity, case when coalesce(soft_url, unsure_url) is not null or other then 'cannot_verify' else 'confirmed' end as confidence,
  coalesce(soft_url, unsure_url) as page_url from x
union all
select store_id, run_id, 'crawl_incomplete', null, 'Required-page presence could not be checked - this audit could not crawl the site', 'high', 'cannot_verify', home from r where not alive
"""


def identity_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = document_audit(spark, sf_dir)
    return C.identity_findings(p, p.select("store_id", "run_id").distinct()).select("store_id", "run_id", "check_id", "severity", "confidence", "page_url", "n_values")


_NAMES = ", ".join(f"('{code}', '{name}')" for code, names in X.CALLING_NAMES.items() for name in names)
IDENTITY_SQL = rf"""
with p as (
  select source as store_id, (doc_id % 17)::varchar as run_id, doc_id as seq, doc_id::varchar as url, text from documents
  where doc_id % 3 <> 0 and doc_id % 12 in (0, 5, 6, 7, 8, 9)),
s as (
  select distinct store_id, run_id, seq, url, 'email' as kind, lower(unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}'))) as value from p
  union select store_id, run_id, seq, url, 'phone', regexp_replace(v, '[^\d+]', '', 'g') from (select *, unnest(regexp_extract_all(text, '\+?\d[\d\s().-]{{7,}}\d')) as v from p) where length(regexp_replace(v, '\D', '', 'g')) between 8 and 15
  union select store_id, run_id, seq, url, 'address', trim(unnest(regexp_extract_all(text, '(?i)\d{{1,6}}\s+[A-Za-z0-9.,''\s]{{3,60}}(street|st\.|avenue|ave\.|road|rd\.|boulevard|blvd\.|drive|dr\.|lane|ln\.|suite|floor|way|court|ct\.)'))) from p),
c(code, name) as (values {_NAMES}),
said as (select distinct store_id, run_id, code from p join c on contains(lower(text), name)),
f as (select store_id, run_id, value, arg_min(url, seq) as url, (select max(code) from c where length(code) = (select max(length(code)) from c where starts_with(value, '+' || code)) and starts_with(value, '+' || code)) as code from s where kind = 'phone' and starts_with(value, '+') group by 1, 2, 3)
select store_id, run_id, 'business_identity_' || kind || '_consistency' as check_id, 'medium' as severity, 'potential_risk' as confidence, null as page_url, count(distinct value) as n_values from s where kind <> 'address' group by store_id, run_id, kind having count(distinct value) > 1
union all select distinct store_id, run_id, 'business_identity_present', 'critical', 'confirmed', null, 0 from p where (store_id, run_id) not in (select (store_id, run_id) from s)
union all select store_id, run_id, 'business_identity_phone_country_mismatch', 'high', 'potential_risk', url, 1 from f
where code is not null and (store_id, run_id) in (select (store_id, run_id) from said) and (store_id, run_id, code) not in (select (store_id, run_id, code) from said)
"""


def content_dedup_refcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.blobs(documents(spark, sf_dir).select(F.col("text").alias("content"), F.col("seq").alias("at"))).select("hash", "refcount", F.col("last_referenced_at").alias("last_referenced"))


def country_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("seq").alias("doc_id"), F.array_join(X.countries(F.coalesce("text", F.lit(""))), ",").alias("codes"))


COUNTRY_SQL = (
    "select doc_id, array_to_string(list_sort(list_distinct(list_filter(["
    + ", ".join(f"case when contains(lower(text), '{n}') then '{c}' end" for n, c in X.COUNTRIES)
    + "], lambda x: x is not null))), ',') as codes from documents"
)


def identifier_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", X.gtin(F.col("c_name")).alias("gtin"), X.identifier(F.concat("c_name", F.lit("-"), "c_mktsegment")).alias("mpn"))


IDENTIFIER_SQL = r"""
select c_custkey, case when regexp_replace(c_name, '\D', '', 'g') = '' then null when length(regexp_replace(c_name, '\D', '', 'g')) <= 14 then lpad(regexp_replace(c_name, '\D', '', 'g'), 14, '0') else regexp_replace(c_name, '\D', '', 'g') end as gtin,
  nullif(upper(regexp_replace(c_name || '-' || c_mktsegment, '[^A-Za-z0-9]', '', 'g')), '') as mpn from customer
"""


def no_price_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.product_text(documents(spark, sf_dir)).select("url", "check_id")


NO_PRICE_SQL = r"""
select doc_id::varchar as url, 'generic_product_price_missing' as check_id from documents where text <> '' and not regexp_matches(text, '(?i)([$£€¥]|usd|eur|gbp)\s?\d|\d\s?(usd|eur|gbp|\$|£|€)')
union all select doc_id::varchar, 'generic_product_availability_missing' from documents where text <> '' and not regexp_matches(text, '(?i)add to cart|add to bag|buy now|in stock|out of stock|sold out|available|pre-?order')
"""


def report_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir, "html").select("page_id", F.md5(X.report_text(F.col("html")).cast("binary")).alias("digest"))


SANITISE_SQL = r"""
select page_id, md5(left(replace(replace(replace(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), 2000)) as digest from pages
"""

def evidence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluation a host, which observes its first URL and names its last in a sentence."""
    p = pages(spark, sf_dir).select(U.netloc(F.col("url")).alias("store_id"), F.lit("r1").alias("run_id"), "url")
    ends = p.groupBy("store_id", "run_id").agg(F.min("url").alias("a"), F.max("url").alias("b"))
    ev = ends.select("store_id", "run_id", F.lit("x").alias("rule_id"), F.lit(None).cast("string").alias("resource_url"), F.array("a").alias("observed"), F.concat(F.lit("see "), "b", F.lit(").")).alias("text"))
    return N.cited_pages(ev, p).select("store_id", "url").distinct()


EVIDENCE_SQL = r"""
with p as (select lower(regexp_extract(url, '://([^/?#]*)', 1)) as store_id, url from pages)
select store_id, min(url) as url from p group by 1 union select store_id, max(url) from p group by 1
"""


_ALL = (url_canonical, facet_strip, pagination_groups, page_features, internal_external_links, external_link_findings, insecure_links, page_types, url_types, dominant_language, content_dom_hash, changed_pages, robots_filter, evidence_pages)
_DOCS = (duplicate_titles, near_duplicate_titles, soft404_exact, soft404_near, required_pages, identity_findings, content_dedup_refcount, country_mentions, identifier_normalise, no_price_pages, report_sanitise)
QUERIES = {f.__name__: f for f in (*_ALL, *_DOCS)}
SQL = {
    "url_canonical": CANONICAL_SQL, "facet_strip": FACET_SQL, "pagination_groups": GROUPS_SQL, "page_features": FEATURES_SQL, "internal_external_links": LINKS_SQL, "insecure_links": INSECURE_SQL,
    "external_link_findings": EXTERNAL_SQL, "page_types": TYPES_SQL, "url_types": FORMS_SQL, "required_pages": REQUIRED_SQL, "identity_findings": IDENTITY_SQL, "dominant_language": LANGUAGE_SQL, "content_dom_hash": HASH_SQL, "changed_pages": CHANGED_SQL, "robots_filter": ROBOTS_SQL, "evidence_pages": EVIDENCE_SQL, "duplicate_titles": DUPLICATE_SQL,
    "soft404_exact": SOFT_SQL, "content_dedup_refcount": "select sha256(text) as hash, count(*) as refcount, max(doc_id) as last_referenced from documents group by 1",
    "country_mentions": COUNTRY_SQL, "identifier_normalise": IDENTIFIER_SQL, "no_price_pages": NO_PRICE_SQL, "report_sanitise": SANITISE_SQL,
}
