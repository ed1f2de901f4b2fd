import random
import string
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tallyweave.operators import catalog
from tallyweave.operators.contains import contains_pairs
from tallyweave.operators.similarity import TextBlock, compared_pairs, similar_materials


def mats(spark, rows):
    return spark.createDataFrame(
        [(i, n, n.strip().lower(), None, None) for i, n in rows],
        "id string, name string, normalized_name string, hs_code string, unit string",
    )


def syns(spark, rows):
    return spark.createDataFrame(rows, "material_id string, synonym string")


def names_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "item_name string")


def noisy(rng, name):
    letters = list(name)
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(letters) + 1)
        letters[at:at] = rng.choice(string.ascii_lowercase + " ")
    return "".join(letters)


def brute(query, materials, synonyms, k):
    """Plain model of the matching order, all pairs."""
    q = " ".join(query.lower().split())
    out, seen = [], set()
    exact = sorted(i for i, n in materials if n.strip().lower() == q)
    if exact:
        out.append((exact[0], 1.0, "exact_name"))
        seen.add(exact[0])
    syn = sorted(m for m, s in synonyms if s.lower() == q)
    if syn and syn[0] not in seen:
        out.append((syn[0], 0.9, "synonym"))
        seen.add(syn[0])
    fuzzy = []
    for mid, name in sorted(materials, key=lambda m: (m[1], m[0])):
        if mid in seen:
            continue
        texts = [name] + [s for m, s in synonyms if m == mid]
        ratio = max(
            SequenceMatcher(None, q, " ".join(t.lower().split())).ratio() for t in texts
        )
        if ratio >= 0.6:
            fuzzy.append((mid, round(ratio, 4), "fuzzy"))
    ranked = sorted(out + fuzzy, key=lambda c: -c[1])
    return ranked[:k]


def test_matching_equals_all_pairs(spark):
    rng = random.Random(11)
    words = ["steel", "rod", "cable", "pvc", "valve", "brass", "kabel", "pipe", "10mm", "صمام"]
    base = sorted({" ".join(rng.sample(words, 3)) for _ in range(60)})
    materials = [(f"m{i:03d}", n) for i, n in enumerate(base)]
    synonyms = [(f"m{i:03d}", noisy(rng, n)) for i, n in enumerate(base) if i % 3 == 0]
    queries = [noisy(rng, rng.choice(base)) for _ in range(60)] + ["  ", synonyms[0][1], base[0].upper()]
    got = catalog.match_catalog(
        names_of(spark, queries), mats(spark, materials), syns(spark, synonyms), 5
    ).collect()
    for query in queries:
        key = " ".join(query.lower().split())
        mine = [
            (r.material_id, r.score, r.match_type)
            for r in sorted((r for r in got if r.name == key), key=lambda r: r.rank)
        ]
        assert mine == (brute(query, materials, synonyms, 5) if key else []), query


def test_bound_is_never_below_the_ratio():
    rng = random.Random(3)
    texts = [noisy(rng, "stainless steel valve") for _ in range(80)]
    block = TextBlock(texts)
    for name in texts[:20]:
        bounds = block.bounds(name)
        for at, text in enumerate(texts):
            assert bounds[at] + 1e-12 >= SequenceMatcher(None, name, text).ratio()


def test_subsequence_bound_is_exact():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
        return row[-1]

    rng = random.Random(4)
    texts = ["", "a", "b" * 70, "𝒳é" * 9] + ["".join(rng.choice("abé𝒳") for _ in range(rng.randint(1, 70))) for _ in range(40)]
    block = TextBlock(texts)
    import numpy as np

    at = np.array([k for k in range(len(texts)) if k % 3])
    for name in [t for t in texts if 0 < len(t) <= 64]:
        assert block.common(name, at).tolist() == [plain(name, texts[k]) for k in at]


def test_classes_that_cannot_match_do_not_meet(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(kind) for _ in range(size))
             for kind in ("aeiou", "lnrst ", "0123456789", "xyzqk", string.ascii_lowercase)
             for size in (1, 3, 7, 12, 25, 60, 90) for _ in range(6)]
    texts = sorted({t.strip() for t in texts} - {""})
    names = sorted({noisy(rng, t).strip() for t in texts} - {""})
    left = spark.createDataFrame([(n,) for n in names], "name string")
    right = spark.createDataFrame([(t, t, t, t) for t in texts],
                                  "text_id string, text string, material_id string, material_name string")
    pairs = {(n, t): SequenceMatcher(None, n, t).ratio() for n in names for t in texts}
    for threshold in (0.6, 0.85):
        got = similar_materials(left, right, threshold, len(texts), round_first=False).collect()
        assert {(r.name, r.material_id): r.score for r in got} == {k: v for k, v in pairs.items() if v >= threshold}
        met = compared_pairs(left, right, threshold).first()
        assert met.possible == len(pairs) and met.compared < 0.25 * len(pairs)
    assert similar_materials(left.limit(0), right, 0.6, 3).count() == 0
    assert similar_materials(left, right.limit(0), 0.6, 3).count() == 0


def test_contains_pairs_equals_all_pairs(spark):
    rng = random.Random(2)
    hay = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(1, 9))) for _ in range(150)})
    needles = sorted({h[rng.randrange(len(h)):][: rng.randint(1, 6)] for h in hay} | {"zz"} - {""})
    got = contains_pairs(
        spark.createDataFrame([(n,) for n in needles], "needle string"),
        spark.createDataFrame([(h,) for h in hay], "haystack string"),
    )
    assert {(r.needle, r.haystack) for r in got.collect()} == {
        (n, h) for n in needles for h in hay if n and n in h
    }
    assert got.count() == got.distinct().count()


def test_near_duplicates_look_at_earlier_new_names(spark):
    new = spark.createDataFrame(
        [("steel valve 10mm", 1), ("steel valve 10 mm", 2), ("copper pipe", 3)], "name string, seq long"
    )
    got = catalog.near_duplicates(new, mats(spark, [("a", "copper pipes")])).collect()
    assert {(r.name, r.material_name, r.material_id) for r in got} == {
        ("steel valve 10 mm", "steel valve 10mm", None),
        ("copper pipe", "copper pipes", "a"),
    }


def test_add_to_catalog(spark):
    items = spark.createDataFrame(
        [
            (1, "Cable A", None, None, "line_item"),
            (2, " cable a ", "8544", "m", "line_item"),
            (3, "Kabel", "99", None, "line_item"),
            (4, "", None, None, "line_item"),
            (5, "Total", None, None, "summary"),
            (6, "New thing", "12", "", "line_item"),
            (7, "new THING", None, "pcs", "line_item"),
        ],
        "id long, item_name string, hs_code string, unit string, row_type string",
    )
    materials = mats(spark, [("m1", "Cable A"), ("m2", "Wire")])
    out = catalog.add_to_catalog(items, materials, syns(spark, [("m2", "KABEL")]), ["id"])
    links = {r.id: r.material_id for r in out["links"].collect()}
    created = out["created"].collect()
    assert len(created) == 1
    assert (created[0].name, created[0].hs_code, created[0].unit) == ("New thing", "12", "pcs")
    assert links == {1: "m1", 2: "m1", 3: "m2", 6: created[0].id, 7: created[0].id}
    updated = {r.id: (r.hs_code, r.unit) for r in out["updated"].collect()}
    assert updated == {"m1": ("8544", "m"), "m2": ("99", None)}
    assert out["synonyms"].count() == 0


def replay(rows, names, synonyms):
    """Row-by-row model of the product import."""
    names, synonyms, out = dict(names), dict(synonyms), {}
    for seq, title, brand in rows:
        key = title.strip().lower()
        short = None
        if brand and key.startswith(brand.lower() + " "):
            short = key[len(brand) + 1:].strip() or None
        hit = key in names or key in synonyms or (short is not None and short in names)
        out[seq] = "skipped_duplicate" if hit else "saved"
        if not hit:
            names[key] = seq
            if brand and brand.lower() != key:
                synonyms[brand.lower()] = seq
    return out


def test_import_equals_row_by_row_replay(spark):
    rng = random.Random(8)
    brands = ["acme", "acme pro", "drill", None, ""]
    tails = ["drill", "pro drill", "saw", "acme", "acme drill", "pro acme saw"]
    rows = []
    for seq in range(120):
        brand = rng.choice(brands)
        title = rng.choice(tails)
        if brand and rng.random() < 0.6:
            title = f"{brand} {title}"
        rows.append((seq, title, brand))
    products = spark.createDataFrame(rows, "seq long, title string, brand string")
    got = catalog.import_status(products, mats(spark, [("x", "saw")]), syns(spark, [("x", "Blade")]))
    assert {r.seq: r.status for r in got.collect()} == replay(rows, {"saw": 0}, {"blade": 0})


def test_manual_links(spark):
    lines = spark.createDataFrame(
        [(1, 10, "old"), (2, 10, None)], "id long, invoice_id long, matched_material_id string"
    )
    links = spark.createDataFrame(
        [(10, 1, "m1"), (11, 2, "m1"), (10, 2, "nope")],
        "invoice_id long, item_id long, material_id string",
    )
    checked = catalog.check_links(links, lines, mats(spark, [("m1", "A")]))
    assert {r.item_id: r.reject for r in checked.filter("reject is not null").collect()} == {
        2: checked.filter("material_id = 'nope'").first().reject
    } or checked.filter("reject is not null").count() == 2
    got = {r.id: r.matched_material_id for r in catalog.apply_links(lines, checked).collect()}
    assert got == {1: "m1", 2: None}


def test_synonyms_to_add_ignores_case(spark):
    got = catalog.synonyms_to_add(
        syns(spark, [("a", "Wire"), ("a", "wire "), ("a", "Cord"), ("b", "Wire")]),
        syns(spark, [("a", "CORD")]),
    ).collect()
    assert {(r.material_id, r.synonym.strip().lower()) for r in got} == {("a", "wire"), ("b", "wire")}
    assert len(got) == 2


def test_suggestions_need_all_words(spark):
    materials = mats(spark, [("1", "red steel rod"), ("2", "steel pipe"), ("3", "rod")])
    got = catalog.suggestions(names_of(spark, ["Steel  Rod", "rod", "none"]), materials).collect()
    assert {(r.item_name, r.material_id) for r in got} == {
        ("Steel Rod", "1"), ("rod", "1"), ("rod", "3"),
    }
    assert F is not None


def test_lines_without_a_wish_do_not_meet_in_one_task(spark):
    lines = spark.range(4000).select(
        F.concat(F.lit("l"), "id").alias("id"), F.lit(1).alias("invoice_id"), F.lit("line_item").alias("row_type"),
        F.when(F.col("id") % 100 == 0, F.lit("Hot  bolt")).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(
            F.lit("cold nut")).alias("item_name"),
        F.when(F.col("id") % 100 > 1, "m").alias("matched_material_id"))
    odd = spark.createDataFrame(
        [("hot bolt", 2, "line_item", None, None), ("hot bolt", 3, "subtotal", "hot bolt", None),
         ("hot bolt", 4, "line_item", "Hot bolt", "m"), (None, 5, "line_item", "hot bolt", "m"),
         ("x", 6, "line_item", "hot bolt", "")],
        "id string, invoice_id int, row_type string, item_name string, matched_material_id string")
    shelf = mats(spark, [("b", "hot bolt"), ("a", "bolt hot"), ("c", "cold nut")])
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "false")
        spark.conf.set(names[1], "-1")
        found = catalog.invoice_detail(lines.unionByName(odd), shelf).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
    assert len(found) == 4005
    idle = [r.task for r in found if not r.needs_catalog]
    assert max(idle.count(t) for t in set(idle)) < len(idle) / 4
    assert {tuple(r.suggestions) for r in found if r.item_name == "Hot  bolt"} == {("a", "b")}
    assert {r.invoice_id: tuple(r.suggestions) for r in found if r.invoice_id > 1} == {
        2: (), 3: (), 4: (), 5: (), 6: ("a", "b")}
    assert all(not r.suggestions for r in found if r.invoice_id == 1 and r.item_name != "Hot  bolt")
