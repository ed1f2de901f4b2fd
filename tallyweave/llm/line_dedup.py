"""Line dedup: windows of three lines that stood earlier are removed where they come again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.binding import let
from tallyweave.llm.common import text_key


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_lines(docs: DataFrame, width: int = 3, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, text_hash, dropped): the sorted positions of lines in windows that came earlier.

    A window is `width` consecutive lines of one document, lines being the parts between
    ``\\n``. Windows are ordered by (id, fingerprint of the text, position), null ids last;
    all but the first window of an equal sequence are dropped, and a line is dropped when
    any dropped window covers it. Windows are compared by two 64-bit hashes. Rows that repeat
    (id, text) count once. Documents with fewer lines than `width`, and null texts, keep all.

    Each document's lines are hashed once; windows are built from the hashes. The first
    position of a window is a combinable minimum that is joined back, so a window which a
    third of all documents hold is pre-aggregated and its rows stay a splittable skewed join.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    rows = texts.where(F.col("body").isNotNull()).select(
        F.coalesce(F.col("id").isNull(), F.lit(True)).alias("no_id"), "id",
        text_key(F.col("body")).alias("text_hash"),
        F.transform(_lines(F.col("body")), lambda x: F.xxhash64(x)).alias("h"),
        F.transform(_lines(F.col("body")), lambda x: F.xxhash64(F.lit("second"), x)).alias("g"))
    rows = rows.where(F.size("h") >= width)
    windows = rows.select("no_id", "id", "text_hash", F.posexplode(F.zip_with(
        F.transform(F.slice("h", 1, F.size("h") - (width - 1)), lambda x, i: F.xxhash64(
            F.slice(F.col("h"), i + 1, width))),
        F.transform(F.slice("g", 1, F.size("g") - (width - 1)), lambda x, i: F.xxhash64(
            F.slice(F.col("g"), i + 1, width))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("pos", "w"))
    windows = windows.select("no_id", "id", "text_hash", "pos", F.col("w.a").alias("a"), F.col("w.b").alias("b"))
    place = F.struct("no_id", "id", "text_hash", "pos")
    first = windows.groupBy("a", "b").agg(
        F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    later = windows.join(first.select(F.col("a").alias("fa"), F.col("b").alias("fb"), "first"),
                         (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb")))
    later = later.where(place > F.col("first"))
    return later.groupBy("no_id", "id", "text_hash").agg(F.collect_set("pos").alias("starts")).select(
        "id", "text_hash", F.array_sort(F.array_distinct(F.flatten(F.transform(
            "starts", lambda s: F.sequence(s, s + (width - 1)))))).alias("dropped"))


def drop_repeated_lines(docs: DataFrame, width: int = 3, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """`docs` with the text shortened, and columns n_lines and n_removed (replaced if there).

    See `repeated_lines` for what goes. The kept lines are joined by ``\\n``. A null text
    stays null with no lines; a text that loses every line becomes empty. All rows stay.
    """
    gone = repeated_lines(docs, width, id_col, text_col).select(
        "id", "text_hash", F.col("dropped").alias("at")).alias("gone")
    text = F.col(f"d.`{text_col}`")
    key = F.col(f"d.`{id_col}`")
    joined = docs.alias("d").join(
        gone, key.eqNullSafe(F.col("gone.id")) & (text_key(text) == F.col("gone.text_hash")), "left")
    removed = F.coalesce(F.size("gone.at"), F.lit(0))
    removed = F.when(F.col("gone.at").isNull(), F.lit(0)).otherwise(removed).cast("long")
    # Positions left over come from a hash set, so that a long document costs linear time.
    kept = F.array_join(let(_lines(text), lambda lines: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone.at")), lambda i: F.get(lines, i))), "\n")
    columns = [F.when(F.col("gone.at").isNull(), text).otherwise(kept).alias(c) if c == text_col
               else F.col(f"d.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*columns, F.when(text.isNull(), F.lit(0)).otherwise(
        F.size(_lines(text))).cast("long").alias("n_lines"), removed.alias("n_removed"))


def line_query(docs: DataFrame, width: int = 3) -> DataFrame:
    out = drop_repeated_lines(docs.select("doc_id", "text"), width)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(l) - 1)) AS p, l FROM d WHERE len(l) >= 3),
k AS (SELECT doc_id, p, [l[p], l[p + 1], l[p + 2]] AS s FROM w),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM k),
g AS (SELECT doc_id, list_distinct(flatten(list([p, p + 1, p + 2]))) AS gone FROM r WHERE n > 1 GROUP BY doc_id)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  CASE WHEN gone IS NULL THEN sha256(text) ELSE sha256(array_to_string(
    list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone, i)),
                   lambda i: l[i]), chr(10))) END AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
