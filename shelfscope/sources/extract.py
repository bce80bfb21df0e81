"""Products from HTML pages: JSON-LD, then microdata, then meta tags, then visible text.

The first extractor that finds a product gives the whole row. All of them are expressions. A JSON-LD
document is searched through lists, @graph and mainEntity to any depth: by expressions where two steps
reach all of it, as on nearly every page, and by a small Arrow function on the pages that nest deeper.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.functions import prices

ANCHOR = r"(?i)<a\s+[^>]*href=[\"']([^\"'#]+)[\"']"
PRODUCT = (
    "struct<name:string,description:string,image:string,brand:string,category:string,sku:string,gtin:string,mpn:string,"
    "price:double,currency:string,availability:string,rating:double,reviews:double,source:string>"
)
_FIELDS = [part.split(":") for part in PRODUCT[7:-1].split(",")]


def product(**fields: Column) -> Column:
    """A product struct; fields not given are null."""
    return F.struct(*(fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in _FIELDS))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once a row however often f names it."""
    return F.transform(F.array(value), f)[0]


def visible(html: Column) -> Column:
    """HTML without scripts and styles."""
    return F.regexp_replace(html, r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>", "")


def heading(html: Column) -> Column:
    inner = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return F.nullif(F.trim(F.regexp_replace(inner, "<[^>]+>", "")), F.lit(""))


def anchors(html: Column) -> Column:
    """The link targets of a page, without those that are only fragments."""
    return F.regexp_extract_all(html, F.lit(ANCHOR), 1)


# --- JSON-LD -----------------------------------------------------------------------------------


def json_items(text: Column) -> Column:
    """The JSON text of a list's elements; a single value is a list of one, null is empty."""
    many = F.from_json(text, "array<string>")
    none = F.lit(None).cast("array<string>")
    empty = F.array().cast("array<string>")
    kept = F.when(F.ltrim(text).startswith("["), many).when(text.isNotNull(), F.array(text)).otherwise(none)
    return F.filter(F.coalesce(kept, empty), lambda x: x.isNotNull())


def member(node: Column, name: str) -> Column:
    return F.get_json_object(node, f"$['{name}']")


def text_of(parsed: Column, name: str) -> Column:
    """A member of a parsed node that is a non-blank string; numbers and objects give null."""
    value = F.try_variant_get(parsed, f"$['{name}']", "variant")
    text = F.trim(F.try_variant_get(parsed, f"$['{name}']", "string"))
    return F.when(F.schema_of_variant(value) == "STRING", F.nullif(text, F.lit("")))


def text_member(node: Column, name: str) -> Column:
    return bound(F.try_parse_json(node), lambda parsed: text_of(parsed, name))


def named(parsed: Column, name: str) -> Column:
    """A member that may be a string, an object with a name, or a list of these."""
    raw = F.try_variant_get(parsed, f"$['{name}']", "variant")
    kind = F.schema_of_variant(raw)
    plain = F.try_variant_get(raw, "$", "string")
    listed = F.transform(json_items(F.when(kind.startswith("ARRAY"), F.to_json(raw))), lambda x: F.coalesce(F.get_json_object(x, "$.name"), F.when(~x.startswith("{"), x)))
    return F.coalesce(F.when(kind == "STRING", plain), F.when(kind.startswith("OBJECT"), F.try_variant_get(raw, "$.name", "string")), F.try_element_at(F.filter(listed, lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(1)))


def image_of(parsed: Column) -> Column:
    raw = F.try_variant_get(parsed, "$['image']", "variant")
    kind = F.schema_of_variant(raw)
    listed = F.transform(json_items(F.when(kind.startswith("ARRAY"), F.to_json(raw))), lambda x: F.coalesce(F.get_json_object(x, "$.url"), F.when(~x.startswith("{"), x)))
    return F.coalesce(F.when(kind == "STRING", F.try_variant_get(raw, "$", "string")), F.when(kind.startswith("OBJECT"), F.try_variant_get(raw, "$.url", "string")), F.try_element_at(F.filter(listed, lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(1)))


def is_product_node(node: Column) -> Column:
    types = F.transform(json_items(member(node, "@type")), F.lower)
    # The names under which the type is written.
    return F.arrays_overlap(types, F.array(F.lit("product"), F.lit("schema:product"), F.lit("https://schema.org/product")))


def below(node: Column) -> Column:
    graph = member(node, "@graph")
    return F.concat(json_items(F.when(graph.startswith("["), graph)), json_items(member(node, "mainEntity")))


def deepened(nodes: Column, times: int) -> Column:
    """Nodes followed each by what lies below it, in document order."""
    if times == 0:
        return nodes
    return F.flatten(F.transform(nodes, lambda n: F.concat(F.array(n), deepened(below(n), times - 1))))


#: Steps down that the expressions take.
STEPS = 2


def _inside(root: object) -> Iterator[dict]:
    """The objects of a JSON-LD document in order, each before what lies below it."""
    left = [root]
    while left:
        node = left.pop()
        if isinstance(node, list):
            left.extend(reversed(node))
        elif isinstance(node, dict):
            yield node
            graph = node.get("@graph")
            left.append(node.get("mainEntity"))
            left.append(graph if isinstance(graph, list) else None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _all_objects(blocks: pd.Series) -> pd.Series:
    def one(texts):
        return None if texts is None else [json.dumps(n, ensure_ascii=False) for t in texts for n in _inside(json.loads(t))]

    return blocks.map(one)


def product_nodes(html: Column) -> Column:
    """The JSON text of all product nodes of a page in order; broken blocks are skipped.

    A document takes no more steps down than it names members that lead down, so their number tells
    which pages the expressions read in full; the Arrow function is given no other's text.
    """
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), 1)
    good = F.filter(F.transform(blocks, F.trim), lambda b: F.try_parse_json(b).isNotNull())
    # An escaped name counts as one that leads down; lists straight in lists are left to the function too.
    deep = F.exists(good, lambda b: (F.regexp_count(b, F.lit(r"@graph|mainEntity|\\u")) > STEPS) | b.rlike(r"\[\s*\["))
    shallow = deepened(F.flatten(F.transform(good, json_items)), STEPS)
    return F.filter(F.when(deep, _all_objects(F.when(deep, good))).otherwise(shallow), is_product_node)


def price_of(parsed: Column, name: str) -> Column:
    """A price member: a number, or a text that reads as one; null if missing or no price."""

    def read(raw: Column) -> Column:
        text = bound(F.try_variant_get(raw, "$", "string"), prices.price_text)
        return F.when(raw.isNull(), F.lit(None)).when(F.schema_of_variant(raw) == "STRING", text).otherwise(F.try_variant_get(raw, "$", "double"))

    return bound(F.try_variant_get(parsed, f"$['{name}']", "variant"), read)


def ld_price(node: Column, name: str) -> Column:
    return bound(F.try_parse_json(node), lambda parsed: price_of(parsed, name))


def offers(node: Column) -> Column:
    """Offers with a price, in order: struct<price, currency, availability>. Ranges give both ends."""

    def told(o: Column, own: Column, spec: Column) -> Column:
        currency = F.coalesce(text_of(own, "priceCurrency"), text_of(spec, "priceCurrency"))
        state = F.coalesce(text_of(own, "availability"), F.lit("InStock"))
        ranged = F.contains(F.lower(member(o, "@type")), F.lit("aggregateoffer"))
        direct = F.coalesce(price_of(own, "price"), price_of(own, "Price"), F.when(member(o, "price").isNull(), price_of(spec, "price")))
        values = F.when(ranged, F.array(price_of(own, "lowPrice"), price_of(own, "highPrice"))).otherwise(F.array(direct))
        return F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.struct(v.alias("price"), currency.alias("currency"), state.alias("availability")))

    def one(o: Column) -> Column:
        spec = F.try_element_at(json_items(member(o, "priceSpecification")), F.lit(1))
        return bound(F.try_parse_json(o), lambda own: bound(F.try_parse_json(spec), lambda s: told(o, own, s)))

    return F.flatten(F.transform(json_items(member(node, "offers")), one))


def primary_offer(found: Column) -> Column:
    """The cheapest offer, of those in stock if any is; of equals the first."""

    def stocked(every: Column) -> Column:
        some = F.filter(every, lambda o: o["availability"].isin("InStock", "LimitedAvailability"))
        return bound(some, lambda own: F.when(F.size(own) > 0, own).otherwise(every))

    ranked = F.transform(bound(found, stocked), lambda o, i: F.struct(o["price"].alias("price"), i.alias("i"), o.alias("offer")))
    return F.array_min(ranked)["offer"]


def availability(text: Column, wide: bool = True) -> Column:
    """An availability text as in_stock, out_of_stock, preorder or unknown."""
    v = F.lower(F.coalesce(text, F.lit("")))
    has = lambda *words: v.rlike("|".join(words))
    if wide:
        return F.when(has("instock", "limitedavailability"), "in_stock").when(has("outofstock", "soldout", "discontinued"), "out_of_stock").when(has("preorder", "backorder", "presale"), "preorder").otherwise("unknown")
    return F.when(has("instock"), "in_stock").when(has("outofstock", "soldout"), "out_of_stock").when(has("preorder", "backorder"), "preorder").otherwise("unknown")


def first_product_node(html: Column) -> Column:
    """The JSON text of a page's first product node that has a name."""
    return F.try_element_at(F.filter(product_nodes(html), lambda n: text_member(n, "name").isNotNull()), F.lit(1))


def from_json_ld(node: Column) -> Column:
    """The product that a node describes with its primary offer, null without a node."""

    def made(parsed: Column, first: Column, rating: Column) -> Column:
        number = lambda *names: F.coalesce(*(F.try_variant_get(rating, f"$.{n}", "double") for n in names))
        return product(
            name=text_of(parsed, "name"),
            description=text_of(parsed, "description"),
            image=image_of(parsed),
            brand=named(parsed, "brand"),
            category=named(parsed, "category"),
            sku=text_of(parsed, "sku"),
            gtin=F.coalesce(*(text_of(parsed, k) for k in ("gtin13", "gtin12", "gtin8", "gtin", "ean"))),
            mpn=text_of(parsed, "mpn"),
            price=F.coalesce(first["price"], F.lit(0.0)),
            currency=first["currency"],
            availability=availability(first["availability"]),
            rating=number("ratingValue"),
            reviews=number("reviewCount", "ratingCount"),
            source=F.lit("jsonld"),
        )

    def read(n: Column) -> Column:
        rating = F.try_parse_json(member(n, "aggregateRating"))
        return bound(F.try_parse_json(n), lambda parsed: bound(primary_offer(offers(n)), lambda first: bound(rating, lambda r: made(parsed, first, r))))

    return bound(node, lambda n: F.when(n.isNotNull(), read(n)))


def from_microdata(html: Column) -> Column:
    """Not extracted: always null."""
    return F.lit(None).cast(PRODUCT)


def meta_tags(html: Column) -> Column:
    """property or name, in lower case, to content; the last tag of a name wins."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\s+[^>]*>"), 0)
    name = lambda t: F.lower(F.coalesce(F.nullif(F.regexp_extract(t, r"(?i)property=[\"']([^\"']+)[\"']", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"(?i)name=[\"']([^\"']+)[\"']", 1), F.lit(""))))
    good = F.filter(tags, lambda t: name(t).isNotNull() & t.rlike(r"(?i)content=[\"'][^\"']*[\"']"))
    entries = F.transform(good, lambda t: F.struct(name(t).alias("k"), F.regexp_extract(t, r"(?i)content=[\"']([^\"']*)[\"']", 1).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def from_meta(html: Column) -> Column:
    def read(tags: Column) -> Column:
        get = lambda *names: F.coalesce(*(F.try_element_at(tags, F.lit(n)) for n in names))
        price = F.trim(get("product:price:amount", "og:price:amount")).try_cast("double")
        name = F.nullif(get("og:title", "twitter:title"), F.lit(""))
        made = product(
            name=name,
            description=get("og:description", "description"),
            image=get("og:image"),
            price=price,
            currency=F.coalesce(get("product:price:currency", "og:price:currency"), F.lit("USD")),
            availability=availability(get("product:availability", "og:availability"), wide=False),
            source=F.lit("opengraph"),
        )
        return F.when(name.isNotNull() & (price > 0), made)

    return bound(meta_tags(html), read)


_CODES = "|".join(prices.PRICE_CODES)
#: A number is read as a whole or not at all, and a code begins a word: hashes and card numbers in a text are no prices.
#: A sign stands alone: one of several in a row is a mark of the text ("word$$$ 12").
_NUMBER = r"(?:\d{1,3}(?:[.,]\d{3})+|\d+)(?:[.,]\d{1,2})?(?![A-Za-z\d])"
_MARKED = rf"(?:(?<![$€£¥])([$€£¥])\s?|(?<![\p{{L}}\p{{N}}])({_CODES})\s?)({_NUMBER})"


def _price_in(text: Column, pattern: str) -> Column:
    """struct<price, currency> of the first match, null if it is no positive price."""
    sign, code, raw = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    value = prices.loose_number(F.nullif(raw, F.lit("")))
    currency = F.coalesce(F.nullif(code, F.lit("")), prices.symbol_currency(sign))
    return F.when(value > 0, F.struct(value.alias("price"), currency.alias("currency")))


def text_price(clean: Column) -> Column:
    """A price from visible markup: in an element of class price, after a price word, or anywhere."""
    boxes = F.regexp_extract_all(clean, F.lit(r"(?is)<[^>]*class=[\"'][^\"']*price[^\"']*[\"'][^>]*>(.*?)</[a-z0-9]+>"), 1)
    boxed = F.try_element_at(F.filter(F.transform(boxes, lambda b: _price_in(b, f"(?i){_MARKED}")), lambda p: p.isNotNull()), F.lit(1))
    return F.coalesce(boxed, _price_in(clean, rf"(?i)(?:price|total|final)(?:<[^>]+>|[^<>]){{0,120}}?{_MARKED}"), _price_in(clean, f"(?i){_MARKED}"))


def from_text(html: Column) -> Column:
    clean = visible(html)
    name, price, low = heading(clean), text_price(clean), F.lower(clean)
    state = F.when(low.rlike("out of stock|sold out"), "out_of_stock").when(low.rlike("add to cart|add to bag"), "in_stock").otherwise("unknown")
    made = product(name=name, price=price["price"], currency=F.coalesce(price["currency"], prices.guess_currency(clean)), availability=state, source=F.lit("html-heuristics"))
    return F.when(name.isNotNull() & price.isNotNull(), made)


def products(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with a struct `product`, null where no extractor finds one."""
    page = F.col(html)
    found = F.coalesce(from_json_ld(first_product_node(page)), from_microdata(page), from_meta(page), from_text(page))
    return pages.withColumn("product", found)


def crawled(pages: DataFrame) -> DataFrame:
    """Found products as ingest rows; in stock only if the page says so."""
    p = F.col("product")
    rows = pages.where("product IS NOT NULL")
    keep = [c for c in ("origin", "url", "ord") if c in pages.columns]
    return rows.select(*keep, p["name"].alias("name"), F.coalesce(p["brand"], F.lit("")).alias("brand"), p["price"].alias("price"), p["currency"].alias("currency"), (p["availability"] == "in_stock").alias("available"), F.coalesce(p["sku"], F.lit("")).alias("sku"), F.coalesce(p["gtin"], F.lit("")).alias("gtin"))
