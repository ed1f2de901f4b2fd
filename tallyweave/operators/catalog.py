"""Material catalog: matching, near duplicates, additions, imports, manual links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.text import collapse, match_key, search_tokens, strip
from tallyweave.operators.similarity import similar_materials
from tallyweave.session import cut_lineage

FUZZY_THRESHOLD = 0.6
DUPLICATE_THRESHOLD = 0.9


def plain_key(c: Column) -> Column:
    """Lower-case name without outer whitespace."""
    return F.lower(strip(c))


def by_name(materials: DataFrame, key: str) -> DataFrame:
    """(key, material_id, material_name): the smallest id per normalised name."""
    return materials.groupBy(F.col("normalized_name").alias(key)).agg(
        F.min("id").alias("material_id"), F.min_by("name", "id").alias("material_name")
    )


def by_synonym(materials: DataFrame, synonyms: DataFrame, key: str) -> DataFrame:
    """(key, material_id, material_name): the smallest id per lower-case synonym."""
    named = synonyms.join(
        materials.select(F.col("id").alias("material_id"), "name"), "material_id"
    )
    return named.groupBy(F.lower("synonym").alias(key)).agg(
        F.min("material_id").alias("material_id"),
        F.min_by("name", "material_id").alias("material_name"),
    )


def catalog_texts(materials: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Names and synonyms as comparable texts, each with its material."""
    names = materials.select(
        match_key(F.col("name")).alias("text"),
        F.col("id").alias("material_id"), F.col("name").alias("material_name"),
    )
    if synonyms is not None:
        names = names.unionByName(
            synonyms.join(
                materials.select(F.col("id").alias("material_id"), F.col("name").alias("material_name")),
                "material_id",
            ).select(match_key(F.col("synonym")).alias("text"), "material_id", "material_name")
        )
    return (
        names.filter("text <> ''")
        .distinct()
        .withColumn("text_id", F.concat_ws("\u0001", "material_id", "text"))
    )


def match_catalog(
    names: DataFrame, materials: DataFrame, synonyms: DataFrame, k: int = 5,
    threshold: float = FUZZY_THRESHOLD,
) -> DataFrame:
    """The k best materials per name: exact 1.0, synonym 0.9, similar by ratio.

    `names`: item_name. Result: name (the match key), material_id, material_name,
    score, match_type, rank from 1. Every distinct name is looked up once.
    """
    wanted = names.select(match_key(F.col("item_name")).alias("name")).filter("name <> ''").distinct()
    exact = wanted.join(by_name(materials, "name"), "name")
    synonym = wanted.join(by_synonym(materials, synonyms, "name"), "name").join(
        exact.select("name", "material_id"), ["name", "material_id"], "left_anti"
    )
    known = exact.select("name", "material_id").unionByName(synonym.select("name", "material_id"))
    # Two materials at most are taken out again, so k + 2 per block are enough.
    near = similar_materials(wanted, catalog_texts(materials, synonyms), threshold, k + 2).join(
        known, ["name", "material_id"], "left_anti"
    )

    def typed(df: DataFrame, kind: str, priority: int, score: Column) -> DataFrame:
        return df.select(
            "name", "material_id", "material_name", score.alias("score"),
            F.lit(kind).alias("match_type"), F.lit(priority).alias("_priority"),
        )

    union = (
        typed(exact, "exact_name", 0, F.lit(1.0))
        .unionByName(typed(synonym, "synonym", 1, F.lit(0.9)))
        .unionByName(typed(near, "fuzzy", 2, F.col("score")))
    )
    order = Window.partitionBy("name").orderBy(
        F.col("score").desc(), "_priority", "material_name", "material_id"
    )
    return (
        union.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .drop("_priority")
    )


def exact_candidates(materials: DataFrame) -> DataFrame:
    """The candidates that score 1.0: every material under its own name."""
    return by_name(materials, "name").withColumns({"score": F.lit(1.0), "rank": F.lit(1)})


def auto_match(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Line items with the material to link: the best candidate when it scores 1.0."""
    best = candidates.filter("rank = 1 AND score = 1.0").select(
        F.col("name").alias("_key"), F.col("material_id").alias("linked_material_id")
    )
    return (
        items.filter("row_type = 'line_item'")
        .withColumn("_key", match_key(F.col("item_name")))
        .join(best, "_key", "left")
        .drop("_key")
    )


def near_duplicates(
    names: DataFrame, materials: DataFrame, threshold: float = DUPLICATE_THRESHOLD
) -> DataFrame:
    """The most similar material of each new name, if similar enough.

    `names`: name and seq; names of a smaller seq count as materials too.
    """
    queries = names.select(match_key(F.col("name")).alias("name"), "seq").filter("name <> ''")
    queries = queries.groupBy("name").agg(F.min("seq").alias("seq"))
    existing = catalog_texts(materials).withColumn("seq", F.lit(None).cast(dict(queries.dtypes)["seq"]))
    earlier = queries.select(
        F.col("name").alias("text"), F.lit(None).cast("string").alias("material_id"),
        F.col("name").alias("material_name"), F.concat(F.lit("new:"), "name").alias("text_id"), "seq",
    )
    texts = existing.unionByName(earlier)
    found = similar_materials(
        queries, texts, threshold, 1, ordered=True, round_first=False
    )
    order = Window.partitionBy("name").orderBy(F.col("score").desc(), "material_name", "material_id")
    return (
        found.withColumn("_r", F.row_number().over(order))
        .filter("_r = 1")
        .select("name", "material_id", "material_name", F.round("score", 4).alias("similarity"))
    )


def new_material_id(key: Column) -> Column:
    """Natural id of a material: the same name gets the same id in every run."""
    return F.concat(F.lit("m-"), F.md5(key))


def add_to_catalog(
    items: DataFrame, materials: DataFrame, synonyms: DataFrame, order: list[str]
) -> dict[str, DataFrame]:
    """Put all line items into the catalog.

    Results: `links` (item id, material), `created` and `updated` materials,
    `synonyms` to add. Lines are reduced to one row per name first; the earliest
    filled hs_code and unit count.
    """
    lines = items.filter("row_type = 'line_item'").withColumn("_key", plain_key(F.col("item_name")))
    lines = lines.filter("_key <> ''")
    at = F.struct(*order)

    def earliest(column: str) -> Column:
        filled = F.coalesce(F.col(column) != "", F.lit(False))
        return F.min_by(column, F.when(filled, at)).alias(column)

    names = lines.groupBy("_key").agg(
        F.min_by("item_name", at).alias("item_name"), earliest("hs_code"), earliest("unit")
    )
    found = (
        names.join(by_name(materials, "_key").select("_key", F.col("material_id").alias("_by_name")),
                   "_key", "left")
        .join(by_synonym(materials, synonyms, "_key").select(
            "_key", F.col("material_id").alias("_by_synonym")), "_key", "left")
        .withColumn("_existing", F.coalesce("_by_name", "_by_synonym"))
    )
    known = found.filter(F.col("_existing").isNotNull())
    created = found.filter(F.col("_existing").isNull()).select(
        new_material_id(F.col("_key")).alias("id"), F.col("item_name").alias("name"),
        F.col("_key").alias("normalized_name"), "hs_code", "unit",
    )
    # Several names (a name and its synonyms) may lead to one material.
    offered = known.groupBy(F.col("_existing").alias("id")).agg(
        F.min_by("hs_code", F.when(F.col("hs_code").isNotNull(), F.col("_key"))).alias("_hs"),
        F.min_by("unit", F.when(F.col("unit").isNotNull(), F.col("_key"))).alias("_unit"),
    )

    def fill(old: str, new: str) -> Column:
        return F.when(F.coalesce(F.col(old) == "", F.lit(True)), F.col(new)).otherwise(F.col(old))

    updated = (
        materials.join(offered, "id")
        .withColumns({"hs_code": fill("hs_code", "_hs"), "unit": fill("unit", "_unit")})
        .drop("_hs", "_unit")
    )
    suggested = known.select(F.col("_existing").alias("material_id"), F.col("item_name").alias("synonym"))
    own_names = materials.select(F.col("id").alias("material_id"), F.col("normalized_name").alias("synonym"))
    links = lines.join(
        found.select("_key", F.coalesce("_existing", new_material_id(F.col("_key"))).alias("material_id")),
        "_key",
    )
    return {
        "links": links.select("id", "material_id"),
        "created": created,
        "updated": updated,
        "synonyms": synonyms_to_add(
            suggested, synonyms.select("material_id", "synonym").unionByName(own_names)
        ),
    }


def synonyms_to_add(suggested: DataFrame, existing: DataFrame) -> DataFrame:
    """Suggested synonyms a material does not have yet, ignoring case."""
    have = existing.select("material_id", F.lower("synonym").alias("_key")).distinct()
    return (
        suggested.withColumn("_key", plain_key(F.col("synonym")))
        .filter("_key <> ''")
        .groupBy("material_id", "_key")
        .agg(F.min("synonym").alias("synonym"))
        .join(have, ["material_id", "_key"], "left_anti")
        .drop("_key")
    )


def product_description() -> Column:
    """Short description of a search result row."""

    def part(label: str, column: str, suffix: str = "") -> Column:
        value = F.col(column).cast("string")
        filled = F.coalesce((value != "") & (value != "0") & (value != "0.0"), F.lit(False))
        return F.when(filled, F.concat(F.lit(label), value, F.lit(suffix)))

    text = F.concat_ws(
        " | ", part("Brand: ", "brand"), part("Reference price: ", "price"),
        part("Rating: ", "rating", "/5"), part("Reviews: ", "reviews"),
    )
    return F.nullif(text, F.lit(""))


def import_status(
    products: DataFrame, materials: DataFrame, synonyms: DataFrame, dry_run: bool = False
) -> DataFrame:
    """Each product row with its import status and the material it repeats.

    `products`: seq (unique, the row order), title, brand and more. A row repeats
    the catalog by name, else by synonym, else by its name without the brand. It
    also repeats an earlier saved row of the batch: by the same title, by the
    brand-less title, or by a title equal to that row's brand (which became a
    synonym). Whether the earlier row was saved can hang on yet earlier rows, so
    the first saved row per title and per brand is refined until nothing moves;
    each round handles one more link of such a chain, and each round only joins
    and aggregates. A dry run saves nothing: it skips the brand-less test and marks
    every row the catalog does not hold as pending.
    """
    brand = F.lower(F.coalesce("brand", F.lit("")))
    key = plain_key(F.col("title"))
    starts = (brand != "") & key.startswith(F.concat(brand, F.lit(" ")))
    rows = products.withColumns({
        "_key": key,
        "_brand": F.when((brand != "") & (brand != key), strip(brand)),
        "_short": F.lit(None).cast("string") if dry_run else F.nullif(
            F.when(starts, strip(F.substr(key, F.length(brand) + 2))), F.lit("")
        ),
    })

    def lookup(table: DataFrame, column: str) -> DataFrame:
        return table.select(F.col("_k").alias(column), F.col("material_id").alias(f"_m{column}"))

    names = by_name(materials, "_k")
    # A title names a material directly or as a synonym.
    checked = (
        rows.join(lookup(names, "_key"), "_key", "left")
        .join(
            by_synonym(materials, synonyms, "_k").select(
                F.col("_k").alias("_key"), F.col("material_id").alias("_m_syn")
            ), "_key", "left",
        )
        .join(lookup(names, "_short"), "_short", "left")
        .withColumn("existing_material_id", F.coalesce("_m_key", "_m_syn", "_m_short"))
        .drop("_m_key", "_m_syn", "_m_short")
    )
    if dry_run:
        known = F.col("existing_material_id").isNotNull()
        return checked.select(
            *products.columns, "existing_material_id",
            F.when(known, "skipped_duplicate").otherwise("pending").alias("status"),
            F.lit(None).cast("string").alias("material_id"),
        )
    fresh = cut_lineage(
        checked.filter(F.col("existing_material_id").isNull()).select(
            "seq", "_key", "_brand", "_short"
        )
    )

    def first_saved(saved: DataFrame, column: str) -> DataFrame:
        return saved.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min("seq").alias("_t"))

    def survivors(saved: DataFrame) -> DataFrame:
        titles = first_saved(saved, "_key")
        return (
            fresh.join(titles.select(F.col("_key").alias("_short"), F.col("_t").alias("_t1")), "_short", "left")
            .join(
                first_saved(saved, "_brand").select(
                    F.col("_brand").alias("_key"), F.col("_t").alias("_t2")
                ), "_key", "left",
            )
            .filter(
                F.coalesce(F.col("_t1") >= F.col("seq"), F.lit(True))
                & F.coalesce(F.col("_t2") >= F.col("seq"), F.lit(True))
            )
            .groupBy("_key")
            .agg(F.min_by(F.struct("seq", "_brand", "_short"), "seq").alias("_row"))
            .select("_key", "_row.*")
        )

    saved = cut_lineage(survivors(fresh.limit(0)))
    while True:
        refined = cut_lineage(survivors(saved))
        moved = refined.select("seq").join(saved.select("seq"), "seq", "full_outer").count()
        if moved == refined.count() == saved.count():
            break
        saved = refined
    return (
        checked.join(saved.select("seq", F.lit(True).alias("_saved")), "seq", "left")
        .withColumn("status", F.when(F.col("_saved"), "saved").otherwise("skipped_duplicate"))
        .withColumn("material_id", F.when(F.col("_saved"), new_material_id(F.col("_key"))))
        .drop("_key", "_brand", "_short", "_saved")
    )


def import_summary(statuses: DataFrame) -> DataFrame:
    return statuses.agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(F.col("status") == "saved").alias("saved"),
        F.count_if(F.col("status") == "skipped_duplicate").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def ingest_products(
    products: DataFrame, materials: DataFrame, synonyms: DataFrame
) -> dict[str, DataFrame]:
    """Merge product pages into the catalog by name; filled values win, later pages last.

    `products`: seq, title, brand, description, origin_country, origin_confidence,
    evidence_text, source_url, category, suggested_synonyms.
    """
    columns = ["brand", "description", "origin_country", "evidence_text"]
    rows = products.filter(F.coalesce(F.col("title") != "", F.lit(False))).withColumn(
        "_key", match_key(F.col("title"))
    )

    def last_filled(c: str) -> Column:
        return F.max_by(c, F.when(F.coalesce(F.col(c) != "", F.lit(False)), F.col("seq"))).alias(c)

    merged = rows.groupBy("_key").agg(
        F.min_by("title", "seq").alias("name"),
        F.min_by("category", "seq").alias("category"),
        F.max_by("source_url", "seq").alias("source_url"),
        F.max_by("origin_confidence", "seq").alias("origin_confidence"),
        *[last_filled(c) for c in columns],
    )
    target = by_name(materials, "_key").select("_key", F.col("material_id").alias("_existing"))
    resolved = merged.join(target, "_key", "left")
    created = resolved.filter(F.col("_existing").isNull()).select(
        new_material_id(F.col("_key")).alias("id"), "name", F.col("_key").alias("normalized_name"),
        "category", "source_url", "origin_confidence", *columns,
    )
    offered = resolved.filter(F.col("_existing").isNotNull()).select(
        F.col("_existing").alias("id"), "source_url", "origin_confidence",
        *[F.col(c).alias(f"_new_{c}") for c in columns],
    )
    old = materials.drop("source_url", "origin_confidence")
    for c in columns:
        if c not in old.columns:
            old = old.withColumn(c, F.lit(None).cast("string"))
    updated = old.join(offered, "id").withColumns(
        {c: F.coalesce(f"_new_{c}", c) for c in columns}
    ).drop(*[f"_new_{c}" for c in columns])
    suggested = rows.join(resolved.select("_key", "_existing"), "_key").select(
        F.coalesce("_existing", new_material_id(F.col("_key"))).alias("material_id"),
        F.explode("suggested_synonyms").alias("synonym"),
    )
    return {
        "created": created,
        "updated": updated,
        "synonyms": synonyms_to_add(suggested, synonyms.select("material_id", "synonym")),
    }


def suggestions(names: DataFrame, materials: DataFrame, k: int = 5) -> DataFrame:
    """Up to k materials per item name that hold all words of the name.

    Each name is joined through its rarest word only, then checked.
    """
    wanted = (
        names.select(collapse(F.col("item_name")).alias("item_name"))
        .distinct()
        .withColumn("_words", F.array_distinct(search_tokens(F.col("item_name"))))
        .filter(F.size("_words") > 0)
    )
    shelf = materials.select(
        F.col("id").alias("material_id"), F.col("name").alias("material_name"),
        F.array_distinct(search_tokens(F.col("name"))).alias("_material_words"),
    )
    posting = shelf.select("material_id", "material_name", "_material_words",
                           F.explode("_material_words").alias("_word"))
    frequency = posting.groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (
        wanted.select("item_name", "_words", F.explode("_words").alias("_word"))
        .join(frequency, "_word", "left")
        .withColumn("_n", F.coalesce("_n", F.lit(0)))
        .groupBy("item_name", "_words")
        .agg(F.min(F.struct("_n", "_word")).alias("_best"))
        .select("item_name", "_words", F.col("_best._word").alias("_word"))
    )
    order = Window.partitionBy("item_name").orderBy("material_id")
    return (
        rarest.join(posting, "_word")
        .filter(F.size(F.array_except("_words", "_material_words")) == 0)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("item_name", "material_id", "material_name", "rank")
    )


def invoice_detail(lines: DataFrame, materials: DataFrame, k: int = 5) -> DataFrame:
    """Lines with their catalog need and, where open, suggestions."""
    unmatched = (F.col("row_type") == "line_item") & F.coalesce(
        F.col("matched_material_id") == "", F.lit(True)
    )
    open_names = lines.filter(unmatched).select("item_name")
    nested = (
        suggestions(open_names, materials, k)
        .groupBy(F.col("item_name").alias("_wanted"))
        .agg(F.sort_array(F.collect_list(F.struct("rank", "material_id", "material_name"))).alias("_s"))
    )
    # Lines that want no suggestion are dealt by their id; as nulls they would all meet in one task.
    key = F.coalesce("_name", F.col("id").cast("string"))
    return (
        lines.withColumn("needs_catalog", unmatched)
        .withColumn("_name", F.when(F.col("needs_catalog"), collapse(F.col("item_name"))))
        .withColumns({"_key": key, "_open": F.col("_name").isNotNull()})
        .join(nested, (F.col("_key") == F.col("_wanted")) & F.col("_open"), "left")
        .withColumn("suggestions", F.coalesce(F.col("_s.material_id"), F.array().cast("array<string>")))
        .drop("_name", "_key", "_open", "_wanted", "_s")
    )


def check_links(links: DataFrame, lines: DataFrame, materials: DataFrame) -> DataFrame:
    """Manual links (invoice_id, item_id, material_id) with the reason of a reject."""
    items = lines.select("invoice_id", F.col("id").alias("item_id"), F.lit(True).alias("_item"))
    shelf = materials.select(F.col("id").alias("material_id"), F.lit(True).alias("_material"))
    return (
        links.join(items, ["invoice_id", "item_id"], "left")
        .join(shelf, "material_id", "left")
        .withColumn(
            "reject",
            F.when(F.col("_item").isNull(), "item not on invoice").when(
                F.col("_material").isNull(), "unknown material"
            ),
        )
        .drop("_item", "_material")
    )


def apply_links(lines: DataFrame, checked: DataFrame) -> DataFrame:
    """Lines with valid manual links in place of earlier ones."""
    valid = (
        checked.filter(F.col("reject").isNull())
        .groupBy("invoice_id", F.col("item_id").alias("id"))
        .agg(F.min("material_id").alias("_manual"))
    )
    return (
        lines.join(valid, ["invoice_id", "id"], "left")
        .withColumn("matched_material_id", F.coalesce("_manual", "matched_material_id"))
        .drop("_manual")
    )
