"""The page feature job: everything that needs a parse of the HTML, in one pass over each page."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Elements and class or id words whose text is no content; lengths kept.
NO_TEXT = {"script", "style", "noscript", "template"}
NO_CONTENT = {"nav", "header", "footer", *NO_TEXT}
NO_CONTENT_WORDS = ("cookie", "consent", "gdpr", "newsletter")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MAIN_CHARS = 8000
# Where themes show a price, in order of their first match; words for what can be bought, in order.
THEME_PRICES = {"product-price", "price__current", "price-item--sale", "price-item--regular", "price"}
AVAILABLE = {False: ("sold out", "out of stock"), True: ("add to cart", "add to bag", "buy now", "in stock")}
STOCK = {"instock": ("in stock", "available"), "outofstock": ("out of stock", "sold out", "unavailable"), "onbackorder": ("backorder",)}

FEATURES = (
    "title string, lang string, headings array<string>, links array<string>, image_srcs array<string>, images array<struct<src:string,alt:string>>, text string, main_text string, tags array<string>, "
    "forms array<struct<action:string,hint:string,fields array<struct<kind:string,hint:string,required:boolean,pattern:string>>>>, blocks array<struct<tag:string,hrefs:array<string>>>, "
    "sections array<struct<heading:string,text:string>>, nodes array<string>, "
    "rendered struct<theme_price:double,theme_available:boolean,order_price:double,order_stock:string>"
).replace("fields array<", "fields:array<")


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.around: list[tuple[str, set[str]]] = []
        self.title, self.lang, self.heading = None, None, None
        self.headings, self.links, self.images, self.text, self.main, self.tags = [], [], [], [], [], []
        self.forms, self.blocks, self.open_blocks, self.sections, self.json = [], [], [], [["", []]], []
        self.form, self.ld = None, None
        # texts of the first element of each kind that shows a price or a stock state, those still open with their depth, all text
        self.shown, self.open_shown, self.all = {}, [], []

    def _shows(self, tag: str, a: dict) -> Iterator[str]:
        """The kinds that an element is of, by its name, classes and the elements around it."""
        own = set(a.get("class", "").split())
        price = any(t == "p" and "price" in c for t, c in self.around)
        if "data-product-price" in a or own & THEME_PRICES:
            yield "theme"
        if tag == "ins" and price:
            yield "order 1"
        if "amount" in own and price:
            yield "order 2"
        if tag == "p" and "price" in own:
            yield "order 3"
        if "stock" in own:
            yield "stock"

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        self.tags.append(tag)
        words = (a.get("class", "") + " " + a.get("id", "")).lower()
        hidden = tag in NO_CONTENT or any(w in words for w in NO_CONTENT_WORDS)
        for kind in self._shows(tag, a):
            if kind not in self.shown:
                self.shown[kind] = []
                if tag not in VOID:
                    self.open_shown.append((kind, len(self.stack)))
        if tag not in VOID:
            self.stack.append((tag, hidden or (bool(self.stack) and self.stack[-1][1])))
            self.around.append((tag, set(a.get("class", "").split())))
        if tag == "html":
            self.lang = self.lang or a.get("lang")
        elif tag == "a" and "href" in a:
            self.links.append(a["href"])
            for b in self.open_blocks:
                b[1].append(a["href"])
        elif tag == "img":
            self.images.append({"src": a.get("src", ""), "alt": a.get("alt")})
        elif tag in ("h1", "h2", "h3"):
            self.heading = []
        elif tag == "form":
            self.form = {"action": a.get("action", ""), "hint": words.strip(), "fields": []}
            self.forms.append(self.form)
        elif tag in ("input", "textarea", "select") and self.form is not None:
            hint = " ".join(a.get(k, "") for k in ("name", "id", "placeholder", "aria-label")).lower().strip()
            self.form["fields"].append({"kind": a.get("type", "text").lower() if tag == "input" else tag, "hint": hint, "required": "required" in a, "pattern": a.get("pattern")})
        elif tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.ld = []
        if tag in ("nav", "footer"):
            self.open_blocks.append((tag, []))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack and self.stack.pop()[0] != tag:
            pass
        del self.around[len(self.stack) :]
        self.open_shown = [x for x in self.open_shown if x[1] < len(self.stack)]
        if tag in ("h1", "h2", "h3") and self.heading is not None:
            text = " ".join("".join(self.heading).split())
            if tag != "h3" and text:
                self.headings.append(text)
            self.sections.append([text, []])
            self.heading = None
        elif tag == "form":
            self.form = None
        elif tag == "script" and self.ld is not None:
            self.json.append("".join(self.ld))
            self.ld = None
        if tag in ("nav", "footer") and self.open_blocks:
            self.blocks.append(self.open_blocks.pop())

    def handle_data(self, data):
        inside = {t for t, _ in self.stack}
        if not inside & {"script", "style", "template"}:
            self.all.append(data.strip())
            for kind, _ in self.open_shown:
                self.shown[kind].append(data)
        if "title" in inside:
            self.title = (self.title or "") + data
        elif self.ld is not None:
            self.ld.append(data)
        elif not inside & NO_TEXT:
            self.text.append(data)
            if self.heading is not None:
                self.heading.append(data)
            elif not (self.stack and self.stack[-1][1]):
                self.sections[-1][1].append(data)
            if not (self.stack and self.stack[-1][1]):
                self.main.append(data)


def _flat(x: object, opened) -> Iterator[dict]:
    """The objects of x in order; lists, and what `opened` gives of an object in its place, are gone through at any depth."""
    todo = [x]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += x[::-1]
        elif isinstance(x, dict):
            inner = opened(x)
            if inner is None:
                yield x
            else:
                todo += inner[::-1]


def _members(node: dict) -> list | None:
    """What stands for a node: the members of its graph, else its variants, else itself."""
    inner = next((node[k] for k in ("@graph", "hasVariant") if isinstance(node.get(k), list | dict)), None)
    return [inner] if inner is not None else None


def _inner_offers(offer: dict) -> list | None:
    """An aggregate offer is followed by the offers inside it."""
    kinds = offer.get("@type") if isinstance(offer.get("@type"), list) else [offer.get("@type")]
    inner = offer.get("offers")
    return [{k: v for k, v in offer.items() if k != "offers"}, inner] if inner and any(str(k).lower() == "aggregateoffer" for k in kinds) else None


def product_nodes(blocks: list[str]) -> list[str]:
    """JSON texts of the nodes of structured data, one by one: lists, graphs and variant groups are opened, and so are the offers of
    each node, which then are one list. A block that doesn't parse is skipped.
    """
    out = []
    for b in blocks:
        try:
            parsed = json.loads(b)
        except ValueError:
            continue
        out += [json.dumps(n | {"offers": [*_flat(n["offers"], _inner_offers)]} if "offers" in n else n) for n in _flat(parsed, _members)]
    return out


def shown_price(text: str | None) -> float | None:
    """The first run of digits and points, commas left out; null if it is no number."""
    m = re.search(r"[\d.]+", (text or "").replace(",", ""))
    try:
        return float(m[0]) if m else None
    except ValueError:
        return None


def first_word_class(text: str, classes: dict) -> object:
    """The first class with a word that the text has."""
    return next((name for name, words in classes.items() if any(w in text for w in words)), None)


def rendered(p: _Page) -> dict:
    """What the page shows as price and as stock state, the way either platform's themes mark them."""
    every = " ".join(x for x in p.all if x).lower()
    text = {k: "".join(v) for k, v in p.shown.items()}
    order = next((text[k] for k in ("order 1", "order 2", "order 3") if k in text), None)
    stock = "".join(x.strip() for x in p.shown.get("stock", [])).lower() or every
    return {"theme_price": shown_price(text.get("theme")), "theme_available": first_word_class(every, AVAILABLE), "order_price": shown_price(order), "order_stock": first_word_class(stock, STOCK)}


def parse(html: str | None) -> dict:
    p = _Page()
    p.feed(html or "")
    p.close()
    squeeze = lambda parts: " ".join(" ".join(parts).split())
    return {
        "title": " ".join(p.title.split()) if p.title else None, "lang": (p.lang or "").split("-")[0].lower() or None, "headings": p.headings, "links": p.links,
        "image_srcs": [i["src"] for i in p.images], "images": p.images, "text": squeeze(p.text), "main_text": squeeze(p.main)[:MAIN_CHARS], "tags": p.tags, "forms": p.forms,
        "blocks": [{"tag": t, "hrefs": h} for t, h in p.blocks], "sections": [{"heading": h, "text": squeeze(t)} for h, t in p.sections if squeeze(t)], "nodes": product_nodes(p.json), "rendered": rendered(p),
    }


def page_features(pages: DataFrame) -> DataFrame:
    """pages with html replaced by its features. html is large, so nothing after this job reads it. Null html has no features but empty ones."""
    rest = [c for c in pages.columns if c != "html"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for big in batches:
            for i in range(0, len(big), 256):
                b = big.iloc[i : i + 256].reset_index(drop=True)
                yield pd.concat([b[rest], pd.DataFrame([parse(h) for h in b["html"]])], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "html")
    return pages.select(*rest, "html").mapInPandas(run, f"{kept}, {FEATURES}")


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sequence similarity of two texts, 0 if the quick bound is below the least that counts."""

    def one(x: str, y: str) -> float:
        m = difflib.SequenceMatcher(None, x, y)
        return m.ratio() if m.quick_ratio() >= 0.9 else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def may_be_similar(a: Column, b: Column, least: float = 0.92) -> Column:
    """An upper bound of ratio by lengths only; drops no pair that reaches least."""
    x, y = F.char_length(a), F.char_length(b)
    return F.when(x + y == 0, F.lit(True)).otherwise(2 * F.least(x, y) / (x + y) >= least)


#: Characters that are counted each; all others are counted together.
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789 .,"


def shared_characters(a: Column, b: Column) -> Column:
    """An upper bound of ratio by the characters that both texts have, counted with built-in functions."""
    n = lambda t, c: F.char_length(t) - F.char_length(F.replace(t, F.lit(c), F.lit("")))
    counts = lambda t: F.array(*[n(t, c) for c in COUNTED])
    least = F.zip_with(counts(a), counts(b), lambda x, y: F.least(x, y))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    rest = F.least(F.char_length(a) - total(counts(a)), F.char_length(b) - total(counts(b)))
    return 2 * (total(least) + rest) / (F.char_length(a) + F.char_length(b))


def dom_hash(tags: Column) -> Column:
    return F.sha2(F.array_join(tags, "|").cast("binary"), 256)
