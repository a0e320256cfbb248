"""URL parts and canonical forms as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only filter or sort a listing.
NOISE_KEYS = ["on-sale", "in-stock", "on-backorder", "featured"]
NOISE_PREFIXES = ["filter_", "query_type_"]

# URL patterns of page types, then patterns of headings and body; in both the first type that matches counts.
URL_RULES = [
    ("cart", [r"/cart/?($|\?)", r"/panier/?($|\?)", r"/warenkorb/?($|\?)", r"/carrito/?($|\?)", r"/carrello/?($|\?)"]),
    ("checkout", [r"/checkout/?($|\?)", r"/commande/?($|\?)", r"/kasse/?($|\?)"]),
    ("blog_other", [r"/my-account", r"/login/?($|\?)", r"/register/?($|\?)", r"/sign-in", r"/sign-up", r"/mon-compte", r"/mein-konto", r"/mi-cuenta"]),
    ("privacy_policy", [r"privacy[-_]?policy", r"/privacy/?($|\?)", r"politique[-_]?de[-_]?confidentialit", r"protection[-_]?des[-_]?donn", r"datenschutz", r"politica[-_]?de[-_]?privacidad", r"aviso[-_]?de[-_]?privacidad", r"politica[-_]?de[-_]?privacidade", r"informativa[-_]?sulla[-_]?privacy"]),
    ("shipping_policy", [r"shipping[-_]?policy", r"/shipping/?($|\?)", r"delivery[-_]?(policy|info)", r"shipment[-_]?policy", r"livraison", r"politique[-_]?d.exp.dition", r"versand(kosten|bedingungen|richtlinie)?", r"politica[-_]?de[-_]?env.o", r"/envios?/?($|\?)", r"politica[-_]?de[-_]?envio", r"/entrega/?($|\?)", r"politica[-_]?di[-_]?spedizione", r"/spedizion"]),
    ("returns_policy", [r"return|refund", r"retour|remboursement", r"r.ckgabe|widerruf|erstattung", r"devoluci.n|reembolso", r"devolu..o|reembolso", r"reso|rimborso"]),
    ("terms_of_service", [r"terms[-_]?(of[-_]?(service|use)|and[-_]?conditions)?", r"/tos/?($|\?)", r"conditions[-_]?g.n.rales", r"mentions[-_]?l.gales", r"allgemeine[-_]?gesch.ftsbedingungen", r"/agb/?($|\?)", r"impressum", r"t.rminos[-_]?y[-_]?condiciones", r"aviso[-_]?legal", r"termos[-_]?e[-_]?condi..es", r"termos[-_]?de[-_]?uso", r"termini[-_]?e[-_]?condizioni"]),
    ("faq", [r"/faq", r"foire[-_]?aux[-_]?questions", r"h.ufige[-_]?fragen", r"preguntas[-_]?frecuentes", r"perguntas[-_]?frequentes", r"domande[-_]?frequenti"]),
    ("contact_about", [r"/contact", r"/about", r"/nous[-_]?contacter|/.[-_]?propos", r"/kontakt", r"/.ber[-_]?uns", r"/contacto", r"/sobre[-_]?nosotros|/qui.nes[-_]?somos", r"/contato", r"/sobre[-_]?n.s", r"/contatt", r"/chi[-_]?siamo"]),
    ("cart", [r"/basket/?($|\?)"]),
    ("product", [r"/product/", r"/products/(?!$)", r"/shop/[^/]+/?$", r"/produit/", r"/produkt/", r"/producto/", r"/produto/", r"/prodotto/"]),
    ("collection", [r"/shop/?($|\?)", r"/collections/", r"/category/", r"/product-category/", r"/categorie-produit/", r"/produktkategorie/", r"/categoria-producto/", r"/categoria-produto/", r"/categoria-prodotto/"]),
    ("blog_other", [r"/blog/", r"/news/"]),
]
TEXT_RULES = [
    ("privacy_policy", [r"privacy policy", r"personal (data|information) we collect", r"politique de confidentialit", r"donn.es personnelles", r"datenschutzerkl.rung", r"datenschutzrichtlinie", r"pol.tica de privacidad", r"datos personales", r"pol.tica de privacidade", r"dados pessoais", r"informativa sulla privacy", r"dati personali"]),
    ("shipping_policy", [r"shipping policy", r"delivery times?", r"shipping (rates|costs|options)", r"shipment policy", r"politique de livraison", r"d.lais de livraison|frais de livraison", r"versandkosten|lieferzeiten|versandrichtlinie", r"pol.tica de env.o", r"tiempos de entrega|gastos de env.o", r"pol.tica de envio", r"prazos de entrega", r"politica di spedizione", r"tempi di consegna"]),
    ("returns_policy", [r"return(s)? (policy|process)", r"refund policy", r"how to return", r"politique de retour", r"politique de remboursement", r"r.ckgaberecht|widerrufsrecht|erstattungsrichtlinie", r"pol.tica de devoluci.n", r"pol.tica de reembolso", r"pol.tica de devolu..o", r"politica di reso", r"politica di rimborso"]),
    ("terms_of_service", [r"terms (of service|and conditions)", r"terms of use", r"conditions g.n.rales de vente", r"mentions l.gales", r"allgemeine gesch.ftsbedingungen", r"t.rminos y condiciones", r"aviso legal", r"termos e condi..es", r"termos de uso", r"termini e condizioni"]),
    ("faq", [r"frequently asked questions", r"foire aux questions", r"h.ufig gestellte fragen", r"preguntas frecuentes", r"perguntas frequentes", r"domande frequenti"]),
    ("contact_about", [r"contact us", r"get in touch", r"about us", r"nous contacter", r"contactez[-_]?nous|. propos de nous", r"kontaktieren sie uns|.ber uns", r"cont.ctenos|sobre nosotros", r"entre em contato|sobre n.s", r"contattaci|chi siamo"]),
    ("cart", [r"your (shopping )?cart", r"\bcart is empty\b"]),
    ("checkout", [r"proceed to checkout", r"billing details", r"place order"]),
    ("product", [r"add to cart", r"add to bag"]),
]
OVERVIEW_TYPES = ["privacy_policy", "shipping_policy", "returns_policy", "terms_of_service", "contact_about"]
# Content languages that the patterns cover.
LANGUAGES = ["en", "es", "fr", "de", "pt", "it"]


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def netloc(url: Column) -> Column:
    """Host with port, lower case; empty for relative links."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def root_host(url: Column) -> Column:
    return F.regexp_replace(netloc(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def clean_query(url: Column) -> Column:
    """The query without parameters that only filter a listing, with its leading question mark, or nothing."""
    key = lambda kv: F.lower(F.split(kv, "=")[0])
    noise = lambda kv: key(kv).isin(NOISE_KEYS) | key(kv).startswith(NOISE_PREFIXES[0]) | key(kv).startswith(NOISE_PREFIXES[1])
    kept = F.array_join(F.filter(F.split(query(url), "&"), lambda kv: (kv != "") & ~noise(kv)), "&")
    return F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))


def strip_facets(url: Column) -> Column:
    """url with the listing filters of its query left out; the fragment stays."""
    return F.concat(F.regexp_extract(url, r"^[^?#]*", 0), clean_query(url), F.regexp_extract(url, r"#.*$", 0))


def normalized(url: Column) -> Column:
    """Facets, fragment and trailing slash dropped, scheme and host in lower case."""
    return F.concat(scheme(url), F.lit("://"), netloc(url), F.regexp_replace(path(url), "/+$", ""), clean_query(url))


def page_key(url: Column) -> Column:
    """strip_facets, without a page number at the path's end."""
    u = strip_facets(url)
    return F.concat(F.regexp_replace(F.regexp_extract(u, r"^[^?#]*", 0), r"/page/\d+/?$", ""), clean_query(url))


def is_asset(url: Column) -> Column:
    return F.rlike(F.lower(path(url)), F.lit(r"\.(jpe?g|png|gif|webp|svg|ico|css|js|pdf|zip|mp4|woff2?)$"))


def is_cart_action(url: Column) -> Column:
    return F.rlike(F.lower(url), F.lit(r"[?&](add-to-cart|remove_item|undo_item)="))


def _first_type(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    return F.coalesce(*[F.when(F.rlike(text, F.lit("|".join(patterns))), F.lit(name)) for name, patterns in rules])


def url_type(p: Column) -> Column:
    """Page type by path; null if no rule matches."""
    return _first_type(F.lower(p), URL_RULES)


def text_type(text: Column) -> Column:
    """Page type by what a text says; null if no rule matches."""
    return _first_type(F.lower(text), TEXT_RULES)


def crawl_tier(p: Column) -> Column:
    """0 if any pattern of an overview page is in the path, 1 if any of a product page is, else 2."""
    has = lambda types: F.rlike(F.lower(p), F.lit("|".join(x for name, patterns in URL_RULES if name in types for x in patterns)))
    return F.when(has(OVERVIEW_TYPES), 0).when(has(["product"]), 1).otherwise(2)


def run_key(url: Column) -> Column:
    """Scheme-free lower-case host and path, as one run of a store is told from another."""
    return F.concat(netloc(url), F.regexp_replace(path(url), "/+$", ""))
