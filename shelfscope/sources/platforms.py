"""Products from shop platforms' JSON: one row of raw JSON text to one product struct.

Prices are texts; unreadable, missing and negative ones are 0. A compare-at price is only kept where
it is above the price. Arrays are read whole and reduced with higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions import prices, urls

SHOPIFY = (
    "id long, title string, handle string, body_html string, vendor string, product_type string, tags string, "
    "images array<struct<src:string>>, variants array<struct<id:long,title:string,sku:string,price:string,"
    "compare_at_price:string,inventory_quantity:long,inventory_policy:string,barcode:string>>"
)
WOO = (
    "id long, name string, slug string, permalink string, sku string, price string, regular_price string, sale_price string, "
    "stock_status string, description string, global_unique_id string, gtin string, categories array<struct<name:string>>, "
    "images array<struct<src:string>>, meta_data array<struct<key:string,value:string>>"
)
BIGCOMMERCE = (
    "id long, name string, sku string, price string, calculated_price string, availability string, inventory_level long, "
    "description string, brand struct<name:string>, custom_url struct<url:string>, primary_image struct<url:string,url_standard:string>"
)
STOREFRONT = (
    "basic struct<product_sku:string,product_barcode:string,main_cat_name:string,cat_name:string>, "
    "en struct<product_name:string,brand:struct<brand_name:string>,long_desc:string,short_desc:string>, "
    "medias array<struct<media_type:string,media_url:string,media_list_url:string>>"
)


def _text(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def _filled(c: Column) -> Column:
    """A non-blank text, else null."""
    return F.nullif(F.trim(c), F.lit(""))


def _above(regular: Column, price: Column) -> Column:
    return F.when(regular > price, regular)


def _row(origin: Column, url: Column, name: Column, **rest: Column) -> list[Column]:
    types = {"handle": "string", "brand": "string", "category": "string", "description": "string", "image": "string", "price": "double", "compare_at": "double", "available": "boolean", "sku": "string", "gtin": "string", "tags": "array<string>"}
    return [origin.alias("origin"), url.alias("url"), name.alias("name"), *(rest.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items())]


def least_positive(values: Column) -> Column:
    return F.array_min(F.filter(values, lambda p: p > 0))


def shopify(rows: DataFrame) -> DataFrame:
    """(origin, json): prices are the least of the variants, stock is that of any."""
    p = rows.select("origin", F.from_json("json", SHOPIFY).alias("p")).select("origin", "p.*")
    variants = F.coalesce("variants", F.from_json(F.lit("[]"), "array<struct<id:long,title:string,sku:string,price:string,compare_at_price:string,inventory_quantity:long,inventory_policy:string,barcode:string>>"))
    first = F.try_element_at(variants, F.lit(1))
    stocked = F.exists(variants, lambda v: (F.coalesce(v["inventory_quantity"], F.lit(0)) > 0) | F.coalesce(v["inventory_policy"] == "continue", F.lit(False)))
    tags = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), F.trim), lambda t: t != "")
    return p.select(
        *_row(
            F.col("origin"), F.concat("origin", F.lit("/products/"), "handle"), F.col("title"), handle=F.col("handle"), brand=_text(F.col("vendor")), category=_text(F.col("product_type")),
            description=urls.strip_html(F.coalesce("body_html", F.lit(""))), image=F.try_element_at("images.src", F.lit(1)),
            price=F.coalesce(least_positive(F.transform(variants, lambda v: prices.positive(v["price"], commas=False))), F.lit(0.0)),
            compare_at=least_positive(F.transform(variants, lambda v: prices.positive(v["compare_at_price"], commas=False))),
            available=stocked, sku=_text(first["sku"]), gtin=_text(first["barcode"]), tags=tags,
        )
    )


def woocommerce(rows: DataFrame) -> DataFrame:
    p = rows.select("origin", F.from_json("json", WOO).alias("p")).select("origin", "p.*")
    price, regular = prices.positive(F.coalesce("price", "sale_price", "regular_price")), prices.positive(F.col("regular_price"))
    coded = F.filter("meta_data", lambda m: m["key"].rlike("(?i)gtin|barcode|ean|upc") & (F.trim(m["value"]) != ""))
    slug = F.coalesce(_filled(F.col("slug")), F.col("id").cast("string"))
    return p.select(
        *_row(
            F.col("origin"), F.coalesce(_filled(F.col("permalink")), F.concat("origin", F.lit("/product/"), F.url_encode(slug))),
            F.coalesce(_filled(F.col("name")), _filled(F.col("slug")), F.concat(F.lit("Product "), "id")), handle=slug, brand=F.lit(""),
            category=F.coalesce(F.try_element_at("categories.name", F.lit(1)), F.lit("")), description=urls.strip_html(F.coalesce("description", F.lit(""))),
            image=F.try_element_at("images.src", F.lit(1)), price=price, compare_at=_above(regular, price), available=F.coalesce("stock_status", F.lit("instock")) != "outofstock",
            sku=_text(F.col("sku")), gtin=F.coalesce(_filled(F.col("global_unique_id")), _filled(F.col("gtin")), F.trim(F.try_element_at(coded, F.lit(1))["value"]), F.lit("")),
        )
    )


def bigcommerce(rows: DataFrame) -> DataFrame:
    p = rows.select("origin", F.from_json("json", BIGCOMMERCE).alias("p")).select("origin", "p.*")
    price, base = prices.positive(F.coalesce("calculated_price", "price")), prices.positive(F.col("price"))
    name = F.coalesce(_filled(F.col("name")), F.concat(F.lit("Product "), "id"))
    custom = _filled(F.col("custom_url.url"))
    handle = urls.name_slug(name, F.col("id").cast("string"))
    url = F.when(custom.rlike("(?i)^https?://"), custom).when(custom.isNotNull(), F.concat("origin", F.when(~custom.startswith("/"), "/").otherwise(""), custom)).otherwise(F.concat("origin", F.lit("/"), handle, F.lit("/")))
    return p.select(
        *_row(
            F.col("origin"), url, name, handle=handle, brand=F.coalesce("brand.name", F.lit("")), category=F.lit(""), description=urls.strip_html(F.coalesce("description", F.lit(""))),
            image=F.coalesce("primary_image.url", "primary_image.url_standard"), price=price, compare_at=_above(base, price), available=F.coalesce("availability", F.lit("available")) == "available",
            sku=_text(F.col("sku")), gtin=F.lit(""),
        )
    )


def storefront(rows: DataFrame, price_rows: DataFrame) -> DataFrame:
    """(origin, url, product_id, media_base, json) and (product_id, retail, sale, available): the
    catalogue with its separately fetched prices; products without one have price 0."""
    p = rows.select("origin", "url", "product_id", "media_base", F.from_json("json", STOREFRONT).alias("p")).join(price_rows, "product_id", "left")
    name = F.coalesce(_filled(F.col("p.en.product_name")), urls.page_label(F.col("url")))
    sale, retail = F.coalesce("sale", F.lit(0.0)), F.col("retail")
    media = F.try_element_at(F.filter("p.medias", lambda m: F.coalesce(m["media_type"], F.lit("image")).isin("", "image")), F.lit(1))
    category = F.concat_ws(" > ", _filled(F.col("p.basic.main_cat_name")), _filled(F.col("p.basic.cat_name")))
    return p.select(
        *_row(
            F.col("origin"), F.col("url"), name, handle=urls.page_label(F.col("url")), brand=F.coalesce("p.en.brand.brand_name", F.lit("")), category=category,
            description=urls.strip_html(F.coalesce("p.en.long_desc", "p.en.short_desc", F.lit(""))), image=F.concat("media_base", F.coalesce(_filled(media["media_list_url"]), _filled(media["media_url"]))),
            price=sale, compare_at=_above(retail, sale), available=F.coalesce("available", F.lit(True)), sku=_text(F.col("p.basic.product_sku")), gtin=_text(F.col("p.basic.product_barcode")),
        )
    )


def storefront_prices(rows: DataFrame) -> DataFrame:
    """(product_id, item_retail_price, item_sale_price, price_with_tax, website_stock, serviceable)
    to price rows: the price with tax, else the sale price, else retail."""
    money = {c: prices.positive(F.col(c).cast("string")) for c in ("item_retail_price", "item_sale_price", "price_with_tax")}
    known = lambda c: F.when(c > 0, c)
    sale = F.coalesce(known(money["price_with_tax"]), known(money["item_sale_price"]), money["item_retail_price"])
    stocked = (F.coalesce("website_stock", F.lit(0)) > 0) | F.coalesce("serviceable", F.lit(False))
    return rows.where("product_id IS NOT NULL").select("product_id", money["item_retail_price"].alias("retail"), sale.alias("sale"), stocked.alias("available"))
