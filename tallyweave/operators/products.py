"""Product attributes from HTML pages and from search responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.binding import let
from tallyweave.functions.html import all_matches, attribute, by_class, by_id, node_text, page_text
from tallyweave.functions.numbers import price_text_value
from tallyweave.functions.text import strip

# Shop hosts, with or without "www.".
SHOP_HOSTS = [
    "amazon.ae", "amazon.com", "amazon.co.uk", "amazon.de", "amazon.fr", "amazon.sa", "amazon.it",
    "amazon.es", "amazon.in", "amazon.co.jp", "amazon.com.br", "amazon.nl", "amazon.pl",
    "amazon.se", "amazon.com.au",
]
# Marks of a robot check.
CHALLENGE_MARKS = [
    "captcha", "robot check", "type the characters you see",
    "sorry, we just need to make sure", "api-services-support@amazon.com",
]
# Page elements and formats.
DETAIL_TABLES = ["productDetails_techSpec_section_1", "productDetails_detailBullets_sections1"]
ORIGIN_FORMATS = [
    r"(?i)country\s+of\s+origin\s*[:\-\x{2013}]\s*(.+?)(?:\n|$|<)",
    r"(?i)made\s+in\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)",
    r"(?i)manufactured\s+in\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)",
    r"(?i)origin\s*[:\-\x{2013}]\s*(.+?)(?:\n|$|<)",
]
ASIN_IN_URL = r"(?i)/(?:dp|gp/product)/([A-Z0-9]{10})(?:[/?]|$)"
ASIN_IN_PAGE = r"(?i)\bASIN\s*[:\-\s]\s*([A-Z0-9]{10})\b"
TITLE_SUFFIX = r"\s*[-|:]\s*Amazon\.\w+.*$"
BYLINE_START = r"^(Visit the |Brand:\s*)"
BYLINE_END = r"\s*Store\s*$"
WEIGHT_KEYS = ["item weight", "weight", "product weight", "package weight"]
SIZE_KEYS = [
    "product dimensions", "item dimensions", "package dimensions", "item dimensions lxwxh",
    "product dimensions lxwxh",
]
# Search category codes.
CATEGORY_CODES = {
    "Electronics": {
        "all": "aps", "Computers": "computers", "Mobile Phones": "mobile", "Cameras": "photo",
        "Audio": "electronics",
    },
    "Home & Kitchen": {
        "all": "aps", "Kitchen": "kitchen", "Furniture": "furniture", "Home Decor": "garden",
    },
    "Fashion": {
        "all": "aps", "Men": "fashion-mens", "Women": "fashion-womens", "Kids": "fashion-boys",
    },
    "Beauty": {"all": "aps", "Skincare": "beauty", "Makeup": "beauty", "Fragrance": "beauty"},
    "Sports": {"all": "aps", "Fitness": "sporting", "Outdoor": "sporting"},
    "Automotive": {"all": "aps", "Parts": "automotive", "Accessories": "automotive"},
    "Industrial": {"all": "aps", "Tools": "tools", "Safety": "industrial"},
}
DEFAULT_CATEGORY = "aps"


def supports_url(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(F.regexp_replace(host, r"^www\.", "").isin(SHOP_HOSTS), F.lit(False))


def is_challenge(html: Column) -> Column:
    """A robot check instead of a page; its marks may stand anywhere in it."""
    top = F.lower(html)
    hit = F.lit(False)
    for mark in CHALLENGE_MARKS:
        hit = hit | F.contains(top, F.lit(mark))
    return hit


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _json_ld(html: Column) -> Column:
    """The first Product block of the page's structured data, as JSON text."""
    scripts = all_matches(
        html, r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
    )
    blocks = F.flatten(
        F.transform(
            scripts,
            lambda s: F.when(
                strip(s).startswith("["),
                F.coalesce(F.from_json(strip(s), "array<string>"), F.array().cast("array<string>")),
            ).otherwise(F.array(strip(s))),
        )
    )
    products = F.filter(blocks, lambda b: F.get_json_object(b, "$['@type']") == "Product")
    return F.try_element_at(products, F.lit(1))


def _detail_entries(html: Column) -> Column:
    """Key-value pairs of the detail tables and bullets; a later pair replaces an earlier one."""
    entry = "array<struct<key:string,value:string>>"
    rows = F.flatten(
        F.array(*[
            all_matches(F.coalesce(by_id(html, t, "</table>"), F.lit("")), r"(?is)<tr\b[^>]*>(.*?)</tr>")
            for t in DETAIL_TABLES
        ])
    )
    from_tables = F.transform(
        rows,
        lambda r: F.transform(
            all_matches(r, r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]\s*>"), node_text
        ),
    )
    table_pairs = F.transform(
        F.filter(from_tables, lambda c: F.size(c) >= 2),
        lambda c: F.struct(c[0].alias("key"), c[1].alias("value")),
    )
    bullets = all_matches(
        F.coalesce(by_id(html, "detailBullets_feature_div", "</ul>"), F.lit("")),
        r"(?is)<li\b[^>]*>(.*?)</li>",
    )
    bullet = (
        r"(?is)<span\b[^>]*class\s*=\s*[\"'][^\"']*\ba-text-bold\b[^\"']*[\"'][^>]*>(.*?)</span>"
        r".*?<span\b[^>]*>(.*?)</span>"
    )
    bullet_pairs = F.transform(
        bullets,
        lambda b: F.struct(
            F.regexp_replace(
                node_text(F.regexp_extract(b, bullet, 1)), r"[ :\x{200f}\x{200e}]+$", ""
            ).alias("key"),
            node_text(F.regexp_extract(b, bullet, 2)).alias("value"),
        ),
    )
    pairs = F.filter(
        F.concat(table_pairs.cast(entry), bullet_pairs.cast(entry)),
        lambda p: (p["key"] != "") & (p["value"] != ""),
    )
    return pairs


def _last_per_key(pairs: Column) -> Column:
    """Each key once, at its first place, with its last value."""

    def unique(all_pairs: Column) -> Column:
        return F.transform(
            F.filter(
                all_pairs, lambda p, i: F.array_position(all_pairs["key"], p["key"]) == i + 1
            ),
            lambda p: F.struct(
                p["key"].alias("key"),
                F.element_at(F.filter(all_pairs, lambda q: q["key"] == p["key"]), -1)["value"].alias(
                    "value"
                ),
            ),
        )

    return let(pairs, unique)


def _detail(pairs: Column, test) -> Column:
    return F.try_element_at(F.filter(pairs, test), F.lit(1))


def _origin(text: Column, pairs: Column) -> Column:
    """struct(country, confidence, evidence)."""
    listed = _detail(
        pairs,
        lambda p: F.contains(F.lower(p["key"]), F.lit("country"))
        & F.contains(F.lower(p["key"]), F.lit("origin")),
    )

    def result(country: Column, confidence: str, evidence: Column) -> Column:
        return F.struct(
            country.alias("country"), F.lit(confidence).alias("confidence"), evidence.alias("evidence")
        )

    found = F.when(
        listed.isNotNull(),
        result(
            listed["value"], "confirmed",
            F.concat(F.lit("Product detail table: "), listed["key"], F.lit(" = "), listed["value"]),
        ),
    )
    for pattern in ORIGIN_FORMATS:
        country = strip(
            F.regexp_replace(strip(F.regexp_extract(text, pattern, 1)), r"[<\n\r].*", "")
        )
        evidence = F.concat(
            F.lit("Pattern match: '"), strip(F.regexp_extract(text, pattern, 0)), F.lit("'")
        )
        found = found.when(
            (country != "") & (F.length(country) < 50), result(country, "likely", evidence)
        )
    none = F.lit(None).cast("string")
    return found.otherwise(result(none, "unknown", none))


def _price(html: Column) -> Column:
    whole = node_text(by_class(html, "span", "a-price-whole"))
    fraction = F.coalesce(node_text(by_class(html, "span", "a-price-fraction")), F.lit("00"))
    symbol = F.coalesce(node_text(by_class(html, "span", "a-price-symbol")), F.lit(""))
    block = F.coalesce(
        node_text(by_id(html, "priceblock_ourprice")), node_text(by_id(html, "priceblock_dealprice"))
    )
    hidden = node_text(by_class(html, "span", "a-offscreen"))
    return (
        F.when(
            whole.isNotNull(),
            strip(F.concat(symbol, F.regexp_replace(whole, r"\.+$", ""), F.lit("."), fraction)),
        )
        .when(block.isNotNull(), block)
        .when(hidden.rlike(r"\d"), hidden)
    )


def _stars(text: Column) -> Column:
    return F.regexp_extract(text, r"([\d.]+)\s+out\s+of\s+5", 1).try_cast("double")


def _rating(html: Column) -> Column:
    hook = F.regexp_extract(
        html, r"(?is)<span\b[^>]*data-hook\s*=\s*[\"']rating-out-of-text[\"'][^>]*>(.*?)</span>", 1
    )
    icon = F.regexp_extract(
        html, r"(?is)(<i\b[^>]*class\s*=\s*[\"'][^\"']*a-star-\d[^\"']*[\"'][^>]*>)", 1
    )
    return F.coalesce(_stars(hook), _stars(attribute(icon, "title")))


def _review_count(html: Column) -> Column:
    text = F.regexp_replace(node_text(by_id(html, "acrCustomerReviewText")), "[,.]", "")
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("int")


def suggested_synonyms(title: Column, brand: Column) -> Column:
    """The title without its brand, and the brand itself."""
    inside = F.contains(F.lower(title), F.lower(brand))
    without = F.regexp_replace(title, F.concat(F.lit(r"(?i)\Q"), brand, F.lit(r"\E")), "")
    trimmed = F.regexp_replace(
        F.regexp_replace(strip(without), r"\s+", " "), r"^[ ,/\-]+|[ ,/\-]+$", ""
    )
    return F.array_compact(
        F.array(
            F.when(inside & (F.length(trimmed) > 3), trimmed),
            F.when((F.length(brand) > 2) & (F.lower(brand) != F.lower(title)), brand),
        )
    )


def classify_pages(pages: DataFrame) -> DataFrame:
    """Pages (url, html) with `page_class`: challenge or product candidate."""
    return pages.withColumn(
        "page_class", F.when(is_challenge(F.col("html")), "challenge").otherwise("candidate")
    )


def extract_products(pages: DataFrame) -> DataFrame:
    """Attributes of product pages (url, html); `title` is NULL where none was found."""
    html = F.col("html")
    staged = pages.withColumns({
        "_ld": _json_ld(html),
        "_pairs": _last_per_key(_detail_entries(html)),
        "_text": page_text(html),
    })

    def ld(path: str) -> Column:
        return strip(F.get_json_object("_ld", path))

    page_title = F.regexp_replace(
        node_text(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)),
        TITLE_SUFFIX, "",
    )
    element_title = node_text(by_id(html, "productTitle"))
    title = (
        F.when(_filled(ld("$.name")).isNotNull(), ld("$.name"))
        .when(element_title.isNotNull(), _filled(element_title))
        .otherwise(_filled(page_title))
    )
    brand_json = F.get_json_object("_ld", "$.brand")
    ld_brand = F.when(strip(brand_json).startswith("{"), ld("$.brand.name")).otherwise(strip(brand_json))
    byline = F.regexp_replace(
        F.regexp_replace(node_text(by_id(html, "bylineInfo")), BYLINE_START, ""),
        BYLINE_END, "",
    )
    bullets = F.filter(
        F.transform(
            all_matches(
                F.coalesce(by_id(html, "feature-bullets", "</ul>"), F.lit("")),
                r"(?is)<span\b[^>]*class\s*=\s*[\"'][^\"']*\ba-list-item\b[^\"']*[\"'][^>]*>(.*?)</span>",
            ),
            node_text,
        ),
        lambda t: t != "",
    )
    description = F.coalesce(
        _filled(ld("$.description")),
        _filled(F.array_join(bullets, "; ")),
        _filled(node_text(by_id(html, "productDescription"))),
    )
    crumbs = all_matches(
        F.coalesce(by_id(html, "wayfinding-breadcrumbs_feature_div", "</div>"), F.lit("")),
        r"(?is)<a\b[^>]*>(.*?)</a>",
    )
    category = F.coalesce(
        _filled(ld("$.category")),
        F.when(F.size(crumbs) > 0, _filled(node_text(F.element_at(crumbs, -1)))),
    )
    asin_input = F.regexp_extract(
        html, r"(?is)(<input\b[^>]*\bid\s*=\s*[\"']ASIN[\"'][^>]*>)", 1
    )
    asin_value = attribute(asin_input, "value")
    asin = F.upper(
        F.coalesce(
            _filled(F.regexp_extract("url", ASIN_IN_URL, 1)),
            F.when(F.length(asin_value) == 10, asin_value),
            _filled(F.regexp_extract("_text", ASIN_IN_PAGE, 1)),
        )
    )

    def listed(keys: list[str]) -> Column:
        return _detail(F.col("_pairs"), lambda p: F.lower(strip(p["key"])).isin(keys))["value"]

    staged = staged.withColumns({
        "title": title,
        "brand": F.coalesce(_filled(ld_brand), _filled(strip(byline))),
        "_origin": _origin(F.col("_text"), F.col("_pairs")),
    })
    keep = [c for c in pages.columns if c != "html"]
    return staged.select(
        *keep,
        "title",
        "brand",
        description.alias("description"),
        category.alias("category"),
        F.map_from_entries("_pairs").alias("details"),
        F.col("_origin.country").alias("origin_country"),
        F.col("_origin.confidence").alias("origin_confidence"),
        F.col("_origin.evidence").alias("evidence_text"),
        asin.alias("asin"),
        listed(WEIGHT_KEYS).alias("weight"),
        listed(SIZE_KEYS).alias("dimensions"),
        _price(html).alias("price"),
        _rating(html).alias("rating"),
        _review_count(html).alias("num_ratings"),
        suggested_synonyms(F.col("title"), F.col("brand")).alias("suggested_synonyms"),
    )


def ingest_status(pages: DataFrame, products: DataFrame, key: str = "url") -> DataFrame:
    """Per page: succeeded, or the reason it failed."""
    found = products.select(key, F.col("title").isNotNull().alias("_ok"))
    return (
        classify_pages(pages)
        .join(found, key, "left")
        .select(
            key,
            F.when(~supports_url(F.col("url")), "unsupported url")
            .when(F.col("page_class") == "challenge", "blocked")
            .when(~F.coalesce("_ok", F.lit(False)), "no title")
            .otherwise("succeeded")
            .alias("status"),
        )
    )


_RESPONSE = (
    "struct<organic_results:array<struct<asin:string,title:string,brand:string,price:string,"
    "rating:double,reviews_total:long,reviews:long,thumbnail:string,image:string,link:string,"
    "is_prime:boolean>>>"
)


def parse_search_responses(responses: DataFrame, limit: int | None = None) -> DataFrame:
    """Product rows of search responses (response JSON text): all entries, or the first `limit`."""
    results = F.from_json("response", _RESPONSE)["organic_results"]
    if limit is not None:
        results = F.slice(results, 1, limit)
    keep = [c for c in responses.columns if c != "response"]
    rows = responses.select(
        *keep, F.posexplode(results).alias("position", "_r")
    ).filter(F.coalesce(F.col("_r.asin") != "", F.lit(False)))
    price = F.col("_r.price")
    is_object = F.coalesce(strip(price).startswith("{"), F.lit(False))
    value = F.get_json_object(price, "$.value")
    absent = price.isNull()
    return rows.select(
        *keep,
        "position",
        F.col("_r.asin").alias("asin"),
        F.coalesce("_r.title", F.lit("")).alias("title"),
        F.col("_r.brand").alias("brand"),
        F.when(is_object, F.coalesce(F.get_json_object(price, "$.raw"), value))
        .otherwise(price)
        .alias("price"),
        F.when(is_object, value.try_cast("double")).otherwise(price_text_value(price)).alias(
            "price_value"
        ),
        F.when(is_object, F.coalesce(F.get_json_object(price, "$.currency"), F.lit("AED")))
        .otherwise("AED")
        .alias("currency"),
        F.col("_r.rating").alias("rating"),
        F.coalesce(F.nullif("_r.reviews_total", F.lit(0)), "_r.reviews").alias("reviews"),
        F.coalesce("_r.thumbnail", "_r.image").alias("image_url"),
        F.coalesce(
            _filled(F.col("_r.link")), F.concat(F.lit("https://www.amazon.ae/dp/"), "_r.asin")
        ).alias("product_url"),
        F.coalesce("_r.is_prime", F.lit(False)).alias("is_prime"),
        absent.alias("price_missing"),
    )


def category_code(category: Column, subcategory: Column) -> Column:
    """Code of a (category, subcategory), else of the category's "all", else "aps"."""
    pairs = [
        F.lit(value)
        for name, codes in CATEGORY_CODES.items()
        for sub, code in codes.items()
        for value in (f"{name}\u0001{sub}", code)
    ]
    codes = F.create_map(*pairs)

    def look(sub: Column) -> Column:
        return F.try_element_at(codes, F.concat(category, F.lit("\u0001"), sub))

    return F.coalesce(look(subcategory), look(F.lit("all")), F.lit(DEFAULT_CATEGORY))
