"""Catalog matching, additions, imports, suggestions and manual links."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.operators import catalog, rollups
from tallyweave.plans import model
from tallyweave.plans.model import sql
from tallyweave.plans.registry import query


def varied_name():
    """Part names as suppliers may write them."""
    return (
        F.when(F.col("p_size") % 4 == 0, F.col("p_name"))
        .when(F.col("p_size") % 4 == 1, F.concat_ws(" ", "p_brand", "p_name"))
        .when(F.col("p_size") % 4 == 2, F.replace(F.col("p_name"), F.lit("l"), F.lit("")))
        .otherwise(F.concat_ws("  ", "p_name", F.lower("p_type")))
    )


def varied_items(spark, sf):
    line = model.table(spark, sf, "lineitem")
    part = model.table(spark, sf, "part")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        model.line_key().alias("id"),
        F.col("l_orderkey").alias("invoice_id"),
        varied_name().alias("item_name"),
        F.col("p_type").alias("hs_code"),
        F.when(F.col("l_returnflag") == "R", "pcs").alias("unit"),
        F.lit("line_item").alias("row_type"),
    )


_VARIED = f"""
    varied AS (
        SELECT {model._KEY} AS id, l_orderkey AS invoice_id, CASE p_size % 4 WHEN 0 THEN p_name
               WHEN 1 THEN p_brand || ' ' || p_name WHEN 2 THEN replace(p_name, 'l', '')
               ELSE p_name || '  ' || lower(p_type) END AS item_name, p_type AS hs_code,
               CASE WHEN l_returnflag = 'R' THEN 'pcs' END AS unit
        FROM lineitem JOIN part ON l_partkey = p_partkey),
    keyed AS (SELECT *, lower(trim(item_name)) AS k,
              regexp_replace(lower(trim(item_name)), '\\s+', ' ', 'g') AS mk FROM varied),
    bysyn AS (SELECT lower(synonym) AS k, min(material_id) AS material_id FROM syn GROUP BY 1)"""


@query("catalog_exact_match", sql("""
    SELECT v.id, v.item_name, m.id AS material_id FROM keyed v
    JOIN mat m ON m.normalized_name = v.mk""", "mat", "syn", extra=_VARIED))
def catalog_exact_match(spark, sf):
    items = varied_items(spark, sf).withColumn("_k", catalog.match_key(F.col("item_name")))
    return items.join(catalog.by_name(model.materials(spark, sf), "_k"), "_k").select(
        "id", "item_name", "material_id"
    )


@query("catalog_synonym_match", sql("""
    SELECT v.id, v.item_name, s.material_id FROM keyed v JOIN bysyn s ON s.k = v.mk""",
    "mat", "syn", extra=_VARIED))
def catalog_synonym_match(spark, sf):
    items = varied_items(spark, sf).withColumn("_k", catalog.match_key(F.col("item_name")))
    table = catalog.by_synonym(model.materials(spark, sf), model.synonyms(spark, sf), "_k")
    return items.join(table, "_k").select("id", "item_name", "material_id")


def _candidates(spark, sf):
    names = model.table(spark, sf, "part").select(varied_name().alias("item_name"))
    return catalog.match_catalog(names, model.materials(spark, sf), model.synonyms(spark, sf))


@query("catalog_fuzzy_match", None)
def catalog_fuzzy_match(spark, sf):
    return _candidates(spark, sf)


@query("auto_match", sql("""
    SELECT v.invoice_id, count(*) AS total_items, count(m.id) AS matched,
           count(*) - count(m.id) AS unmatched
    FROM keyed v LEFT JOIN mat m ON m.normalized_name = v.mk GROUP BY 1""",
    "mat", "syn", extra=_VARIED))
def auto_match(spark, sf):
    exact = catalog.exact_candidates(model.materials(spark, sf))
    linked = catalog.auto_match(varied_items(spark, sf), exact)
    return rollups.match_coverage(
        linked.withColumnRenamed("linked_material_id", "matched_material_id")
    )


def _additions(spark, sf):
    materials = model.materials(spark, sf).withColumn("unit", F.lit(None).cast("string"))
    return catalog.add_to_catalog(
        varied_items(spark, sf), materials, model.synonyms(spark, sf), ["invoice_id", "id"]
    )


_ADDED = """,
    found AS (
        SELECT k, arg_min(item_name, struct_pack(invoice_id, id)) AS item_name,
               arg_min(hs_code, struct_pack(invoice_id, id)) AS hs_code,
               arg_min(unit, struct_pack(invoice_id, id)) FILTER (unit IS NOT NULL) AS unit
        FROM keyed GROUP BY 1),
    resolved AS (SELECT f.*, coalesce(m.id, s.material_id) AS existing
                 FROM found f LEFT JOIN mat m ON m.normalized_name = f.k
                 LEFT JOIN bysyn s ON s.k = f.k)"""


@query("add_to_catalog_created", sql("""
    SELECT 'm-' || md5(k) AS id, item_name AS name, k AS normalized_name, hs_code, unit
    FROM resolved WHERE existing IS NULL""", "mat", "syn", extra=_VARIED + _ADDED))
def add_to_catalog_created(spark, sf):
    return _additions(spark, sf)["created"]


@query("add_to_catalog_updated", sql("""
    SELECT m.id, m.name, m.hs_code, o.unit FROM mat m JOIN (
        SELECT existing, arg_min(unit, k) FILTER (unit IS NOT NULL) AS unit FROM resolved
        WHERE existing IS NOT NULL GROUP BY 1) o ON o.existing = m.id""",
    "mat", "syn", extra=_VARIED + _ADDED))
def add_to_catalog_updated(spark, sf):
    return _additions(spark, sf)["updated"].select("id", "name", "hs_code", "unit")


@query("add_to_catalog_links", sql("""
    SELECT v.id, coalesce(r.existing, 'm-' || md5(v.k)) AS material_id
    FROM keyed v JOIN resolved r ON r.k = v.k""", "mat", "syn", extra=_VARIED + _ADDED))
def add_to_catalog_links(spark, sf):
    return _additions(spark, sf)["links"]


@query("near_duplicate_warnings", None)
def near_duplicate_warnings(spark, sf):
    created = _additions(spark, sf)["created"].select("name", F.col("id").alias("seq"))
    return catalog.near_duplicates(created, model.materials(spark, sf))


#: Product rows that come from suppliers are numbered from here.
SUPPLIED = 1_000_000_000


def product_rows(spark, sf):
    """Rows of an import: every part, whose names and synonyms the catalog knows, and three rows
    of every supplier, which it does not: a plain title that suppliers of a nation share, the
    same title behind a brand and earlier or later than it, and a title of its own."""
    title = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(
        F.concat_ws(" ", "p_brand", "p_name")
    )
    known = model.table(spark, sf, "part").select(
        F.col("p_partkey").alias("seq"), title.alias("title"), F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
    )
    nation = model.table(spark, sf, "nation")
    supplier = model.table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    place, kit = SUPPLIED + 3 * F.col("s_suppkey"), F.concat_ws(" ", F.lit("kit"), "s_nationkey")
    offers = F.explode(F.array(
        F.struct(place.alias("seq"), kit.alias("title"), F.lit(None).cast("string").alias("brand")),
        F.struct((place - 29).alias("seq"), F.concat_ws(" ", "n_name", kit).alias("title"), F.col("n_name").alias("brand")),
        F.struct((place + 2).alias("seq"), F.col("s_name").alias("title"), F.col("n_name").alias("brand")),
    ))
    new = supplier.select(offers.alias("o"), F.abs("s_acctbal").alias("price")).select("o.*", "price")
    return known.unionByName(new)


_IMPORT = f"""
    offered AS (
        SELECT p_partkey AS seq, p_brand AS brand,
               CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand || ' ' || p_name END AS title FROM part
        UNION ALL SELECT {SUPPLIED} + 3 * s_suppkey, NULL, 'kit ' || s_nationkey FROM supplier
        UNION ALL SELECT {SUPPLIED} + 3 * s_suppkey - 29, n_name, n_name || ' kit ' || s_nationkey
                  FROM supplier JOIN nation ON n_nationkey = s_nationkey
        UNION ALL SELECT {SUPPLIED} + 3 * s_suppkey + 2, n_name, s_name
                  FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    prod AS (SELECT seq, lower(title) AS k, CASE WHEN starts_with(lower(title), lower(brand) || ' ')
                    THEN substr(lower(title), length(brand) + 2) END AS short FROM offered),
    alias AS (SELECT lower(synonym) AS k, min(material_id) AS id FROM syn GROUP BY 1),
    fresh AS (SELECT p.*, coalesce(a.id, s.id) AS named, coalesce(a.id, s.id, b.id) AS existing
              FROM prod p LEFT JOIN mat a ON a.normalized_name = p.k LEFT JOIN alias s ON s.k = p.k
              LEFT JOIN mat b ON b.normalized_name = p.short),
    plain AS (SELECT k, min(seq) AS t FROM fresh WHERE short IS NULL AND existing IS NULL GROUP BY 1),
    firsts AS (SELECT f.*, row_number() OVER (PARTITION BY f.k ORDER BY f.seq) = 1 AS first,
                      pl.t < f.seq AS repeats
               FROM fresh f LEFT JOIN plain pl ON pl.k = f.short),
    status AS (SELECT seq, existing AS existing_material_id, CASE WHEN existing IS NULL AND first
                   AND NOT coalesce(repeats, false) THEN 'saved' ELSE 'skipped_duplicate' END
                   AS status FROM firsts)"""


@query("import_products", sql("SELECT * FROM status", "mat", "syn", extra=_IMPORT))
def import_products(spark, sf):
    done = catalog.import_status(product_rows(spark, sf), model.materials(spark, sf), model.synonyms(spark, sf))
    return done.select("seq", "existing_material_id", "status")


@query("import_summary", sql("""
    SELECT count(*) AS found, count(*) FILTER (status = 'saved') AS saved,
           count(*) FILTER (status = 'skipped_duplicate') AS skipped, 0::BIGINT AS errors
    FROM status""", "mat", "syn", extra=_IMPORT))
def import_summary(spark, sf):
    return catalog.import_summary(import_products(spark, sf))


@query("import_dry_run", sql("""
    SELECT seq, CASE WHEN named IS NULL THEN 'pending' ELSE 'skipped_duplicate' END AS status
    FROM fresh""", "mat", "syn", extra=_IMPORT))
def import_dry_run(spark, sf):
    done = catalog.import_status(
        product_rows(spark, sf), model.materials(spark, sf), model.synonyms(spark, sf), dry_run=True
    )
    return done.select("seq", "status")


def _product_pages(spark, sf):
    """A page of every part and of every supplier; suppliers of a nation share a title."""
    def page(seq, title, brand, description, url, category):
        return [
            seq.alias("seq"), title.alias("title"), brand.alias("brand"), description.alias("description"),
            F.lit(None).cast("string").alias("origin_country"), F.lit("unknown").alias("origin_confidence"),
            F.lit(None).cast("string").alias("evidence_text"), url.alias("source_url"), category.alias("category"),
        ]

    parts = model.table(spark, sf, "part").select(
        *page(F.col("p_partkey"), F.col("p_name"), F.nullif(F.col("p_brand"), F.lit("Brand#3")),
              F.when(F.col("p_size") > 25, F.col("p_type")),
              F.concat(F.lit("https://example.com/dp/"), "p_partkey"), F.col("p_type")),
        F.array("p_brand", F.concat_ws(" ", "p_brand", "p_name")).alias("suggested_synonyms"),
    )
    kit = F.concat_ws(" ", F.lit("Kit"), "s_nationkey")
    nation = model.table(spark, sf, "nation")
    suppliers = model.table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        *page(SUPPLIED + F.col("s_suppkey"), kit, F.nullif(F.col("n_name"), F.lit("FRANCE")),
              F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")),
              F.concat(F.lit("https://example.com/kit/"), "s_suppkey"), F.lit("kit")),
        F.array(F.col("n_name"), F.upper("n_name"), F.concat_ws(" ", "n_name", kit)).alias("suggested_synonyms"),
    )
    return parts.unionByName(suppliers)


def _ingested(spark, sf):
    return catalog.ingest_products(
        _product_pages(spark, sf), model.materials(spark, sf), model.synonyms(spark, sf)
    )


_PAGES = f"""
    pages_in AS (
        SELECT p_partkey AS seq, p_name AS title, nullif(p_brand, 'Brand#3') AS brand, p_type AS category,
               CASE WHEN p_size > 25 THEN p_type END AS description,
               'https://example.com/dp/' || p_partkey AS source_url, [p_brand, p_brand || ' ' || p_name] AS offers FROM part
        UNION ALL
        SELECT {SUPPLIED} + s_suppkey, 'Kit ' || s_nationkey, nullif(n_name, 'FRANCE'), 'kit',
               CASE WHEN s_suppkey % 2 = 0 THEN s_name END, 'https://example.com/kit/' || s_suppkey,
               [n_name, n_name || ' Kit ' || s_nationkey] FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    pg AS (SELECT lower(title) AS k, arg_min(title, seq) AS name, arg_min(category, seq) AS category,
               arg_max(source_url, seq) AS source_url, arg_max(brand, seq) FILTER (brand IS NOT NULL) AS brand,
               arg_max(description, seq) FILTER (description IS NOT NULL) AS description
        FROM pages_in GROUP BY 1)"""


@query("ingest_products_created", sql("""
    SELECT 'm-' || md5(k) AS id, name, category, source_url, brand, description
    FROM pg WHERE k NOT IN (SELECT normalized_name FROM mat)""", "mat", extra=_PAGES))
def ingest_products_created(spark, sf):
    return _ingested(spark, sf)["created"].select(
        "id", "name", "category", "source_url", "brand", "description"
    )


@query("ingest_products_updated", sql("""
    SELECT s.id, s.name, pg.source_url, pg.brand, pg.description
    FROM pg JOIN mat s ON s.normalized_name = pg.k""", "mat", extra=_PAGES))
def ingest_products_updated(spark, sf):
    return _ingested(spark, sf)["updated"].select(
        "id", "name", "source_url", "brand", "description"
    )


@query("ingest_products_synonyms", sql("""
    SELECT DISTINCT coalesce(s.id, 'm-' || md5(lower(title))) AS material_id, x.synonym
    FROM pages_in LEFT JOIN mat s ON s.normalized_name = lower(title),
         LATERAL (SELECT unnest(offers) AS synonym) x
    WHERE NOT EXISTS (SELECT 1 FROM syn e WHERE e.material_id = coalesce(s.id, '')
                      AND lower(e.synonym) = lower(x.synonym))""", "mat", "syn", extra=_PAGES))
def ingest_products_synonyms(spark, sf):
    return _ingested(spark, sf)["synonyms"].select("material_id", "synonym")


@query("product_descriptions", """
    SELECT p_partkey AS seq, nullif(concat_ws(' | ',
               CASE WHEN p_size % 4 > 0 THEN 'Brand: ' || p_brand END,
               'Reference price: ' || CAST(p_retailprice AS DECIMAL(12, 2)),
               CASE WHEN p_size % 6 > 0 THEN 'Rating: ' || (p_size % 6) || '/5' END,
               CASE WHEN p_size % 9 > 0 THEN 'Reviews: ' || (p_size % 9) END), '') AS description
    FROM part""")
def product_descriptions(spark, sf):
    rows = model.table(spark, sf, "part").select(
        F.col("p_partkey").alias("seq"), F.when(F.col("p_size") % 4 > 0, F.col("p_brand")).otherwise("").alias("brand"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("price"), (F.col("p_size") % 6).alias("rating"),
        (F.col("p_size") % 9).alias("reviews"),
    )
    return rows.select("seq", catalog.product_description().alias("description"))


@query("catalog_suggestions", sql("""
    SELECT item_name, material_id, material_name, rank FROM (
        SELECT n.item_name, m.id AS material_id, m.name AS material_name,
               CAST(row_number() OVER (PARTITION BY n.item_name ORDER BY m.id) AS INTEGER) AS rank
        FROM (SELECT DISTINCT regexp_replace(item_name, '\\s+', ' ', 'g') AS item_name
              FROM varied) n
        JOIN mat m ON list_has_all(string_split(m.name, ' '),
            list_filter(string_split_regex(lower(n.item_name), '[^a-z0-9]+'), lambda t: t <> '')))
    WHERE rank <= 5""", "mat", "syn", extra=_VARIED))
def catalog_suggestions(spark, sf):
    return catalog.suggestions(varied_items(spark, sf), model.materials(spark, sf))


@query("invoice_detail", sql("""
    SELECT i.id, i.invoice_id, i.matched_material_id IS NULL AS needs_catalog,
           CASE WHEN i.matched_material_id IS NULL THEN m.id ELSE '' END AS suggested
    FROM items i JOIN mat m ON m.name = lower(i.item_name)""", "items", "mat"))
def invoice_detail(spark, sf):
    detail = catalog.invoice_detail(model.invoice_items(spark, sf), model.materials(spark, sf))
    return detail.select(
        "id", "invoice_id", "needs_catalog", F.array_join("suggestions", ",").alias("suggested")
    )


def _manual_links(spark, sf):
    return (
        model.table(spark, sf, "lineitem")
        .filter("l_returnflag = 'R'")
        .select(
            (F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 1).otherwise(0)).alias(
                "invoice_id"
            ),
            model.line_key().alias("item_id"),
            F.col("l_partkey").cast("string").alias("material_id"),
        )
    )


_LINKS = f"""
    links AS (SELECT l_orderkey + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS invoice_id,
              {model._KEY} AS item_id, CAST(l_partkey AS VARCHAR) AS material_id
              FROM lineitem WHERE l_returnflag = 'R'),
    checked AS (SELECT l.*, CASE WHEN i.id IS NULL THEN 'item not on invoice'
                WHEN m.id IS NULL THEN 'unknown material' END AS reject
                FROM links l LEFT JOIN items i ON i.id = l.item_id AND i.invoice_id = l.invoice_id
                LEFT JOIN mat m ON m.id = l.material_id)"""


@query("manual_link_rejects", sql("""
    SELECT invoice_id, item_id, material_id, reject FROM checked WHERE reject IS NOT NULL""",
    "items", "mat", extra=_LINKS))
def manual_link_rejects(spark, sf):
    checked = catalog.check_links(
        _manual_links(spark, sf), model.invoice_items(spark, sf), model.materials(spark, sf)
    )
    return checked.filter("reject IS NOT NULL").select(
        "invoice_id", "item_id", "material_id", "reject"
    )


@query("manual_links", sql("""
    SELECT i.id, i.invoice_id, coalesce(c.material_id, i.matched_material_id)
           AS matched_material_id
    FROM items i LEFT JOIN checked c ON c.item_id = i.id AND c.reject IS NULL""",
    "items", "mat", extra=_LINKS))
def manual_links(spark, sf):
    items = model.invoice_items(spark, sf)
    checked = catalog.check_links(_manual_links(spark, sf), items, model.materials(spark, sf))
    return catalog.apply_links(items, checked).select("id", "invoice_id", "matched_material_id")
