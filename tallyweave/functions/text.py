"""Text expressions: names, lines, codes and currency marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.binding import let

# The whitespace class (Unicode spaces and the ASCII separators).
WS = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# The same whitespace as single characters.
WS_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# Words that mark a line of bank details.
BANK_WORDS = [
    "iban", "swift", "bic", "beneficiary", "bank", "account", "acct", "branch",
    "remittance", "transfer", "mt103", "mt202", "correspondent", "intermediary",
    "routing", "aba", "sort code", "clearing",
    "ايبان", "سويفت", "بيك", "المستفيد", "بنك", "حساب", "فرع", "تحويل",
]
# Account-number formats.
IBAN_FORMAT = r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"
SWIFT_FORMAT = r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?\b"

# Openings of lines that sum up or describe the invoice.
SUMMARY_FORMATS = [
    r"^total\s*:?\s*[\d,\.]+$",
    r"^\s*sub\s*total",
    r"^\s*grand\s*total",
    r"^\s*vat\s*[:@]",
    r"^\s*tax\s*[:@]",
    r"^\s*discount\s*[:@]",
    r"^\s*amount\s+in\s+words",
    r"^\s*payment\s+terms",
    r"^\s*delivery\s+terms",
    r"^\s*incoterms",
    r"^\s*port\s+of\s+",
    r"^\s*country\s+of\s+origin",
    r"^\s*date\s*:\s*\d",
    r"^\s*invoice\s+(no|number|#)",
    r"^\s*page\s+\d+\s+of\s+\d+",
    r"^\s*continued\s+on",
    r"^\s*see\s+attached",
]

# Currency marks and codes, in order of precedence.
CURRENCY_MARKS = {
    "$": "USD",
    "€": "EUR",
    "£": "GBP",
    "¥": "JPY",
    "₹": "INR",
    "د.ج": "DZD",
    "دج": "DZD",
    "DA": "DZD",
}
CURRENCY_CODES = [
    "USD", "EUR", "GBP", "JPY", "CNY", "INR", "AED", "SAR", "DZD",
    "EGP", "MAD", "TND", "LYD", "KWD", "BHD", "OMR", "QAR", "JOD",
]

# Accented Latin letters and their base letters, position by position.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyy"


def strip(c: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """One space for every run of whitespace, none at the ends."""
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def normalized_name(c: Column) -> Column:
    """Lower-case name without outer spaces; the key of price history."""
    return F.lower(F.trim(c))


def match_key(c: Column) -> Column:
    """Lower-case name with whitespace runs collapsed; the key of catalog matching."""
    return F.regexp_replace(F.lower(strip(c)), f"{WS}+", " ")


def clean_item_name(c: Column) -> Column:
    """Drop a leading line number ("1.", "1-", "1)") and collapse whitespace."""
    return F.coalesce(collapse(F.regexp_replace(c, rf"^{WS}*\d+[.\-)]{WS}*", "")), F.lit(""))


def safe_string(c: Column, max_length: int | None = None) -> Column:
    """NULL becomes "", whitespace collapses; text beyond `max_length` is cut and marked."""
    flat = collapse(F.coalesce(c, F.lit("")))
    if max_length is None:
        return flat
    return F.when(
        F.length(flat) > max_length,
        F.concat(F.substring(flat, 1, max_length), F.lit("...")),
    ).otherwise(flat)


def contains_any(c: Column, words: list[str]) -> Column:
    hit = F.contains(c, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(c, F.lit(word))
    return hit


def is_bank_line(c: Column) -> Column:
    words = let(F.lower(c), lambda lower: contains_any(lower, BANK_WORDS))
    return F.coalesce(words | c.rlike(IBAN_FORMAT) | c.rlike(SWIFT_FORMAT), F.lit(False))


def is_summary_line(c: Column) -> Column:
    pattern = "(?i)(" + "|".join(SUMMARY_FORMATS) + ")"
    return F.coalesce(let(strip(c), lambda s: (F.length(s) < 3) | s.rlike(pattern)), F.lit(True))


def is_item_line(c: Column) -> Column:
    return ~is_bank_line(c) & ~is_summary_line(c)


def is_hs_code(c: Column) -> Column:
    """Six to ten digits once dots and spaces are gone."""
    return F.coalesce(F.regexp_replace(c, r"[. ]", "").rlike(r"^\d{6,10}$"), F.lit(False))


def extract_hs_code(c: Column) -> Column:
    return F.nullif(
        F.regexp_extract(F.regexp_replace(c, r"\.", ""), r"\b(\d{6,10})\b", 1), F.lit("")
    )


def detect_currency(c: Column, default: str = "USD") -> Column:
    """First mark, then first code, that occurs in the text.

    A mark made of letters must stand alone, so that "DATE" is not a currency.
    """
    upper = F.upper(c)
    found = None
    for mark, code in CURRENCY_MARKS.items():
        hit = c.rlike(rf"\b{mark}\b") if mark.isascii() and mark.isalpha() else c.contains(mark)
        found = F.when(hit, code) if found is None else found.when(hit, code)
    for code in CURRENCY_CODES:
        found = found.when(upper.rlike(rf"\b{code}\b"), code)
    return found.otherwise(default)


def strip_currency(c: Column) -> Column:
    """Remove marks and codes, as the text part of an amount."""
    marks = "|".join(rf"\Q{m}\E" for m in CURRENCY_MARKS)
    codes = "|".join(CURRENCY_CODES)
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), marks, "")
    return strip(F.regexp_replace(bare, rf"(?i)\b({codes})\b", ""))


def expand_query(c: Column) -> Column:
    """Append, for each dotted or hyphenated token, its bare form and its parts."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"([A-Za-z0-9._-]+)"), F.lit(1))
    coded = F.filter(tokens, lambda t: t.rlike("[.-]"))
    extras = F.flatten(
        F.transform(
            coded,
            lambda t: F.filter(
                F.concat(F.array(F.regexp_replace(t, "[.-]", "")), F.split(t, "[.-]+")),
                lambda p: p != "",
            ),
        )
    )
    return F.concat_ws(" ", c, F.array_join(extras, " "))


def fold_accents(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTED, UNACCENTED)


def search_tokens(c: Column) -> Column:
    """Lower-case, accent-free runs of letters and digits, duplicates kept."""
    return F.filter(F.split(fold_accents(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def highlight(c: Column, terms: list[str]) -> Column:
    """Wrap every occurrence of a search term in <em> marks."""
    wanted = [t for t in terms if t]
    if not wanted:
        return c
    alternatives = "|".join(rf"\Q{t}\E" for t in sorted(wanted, key=len, reverse=True))
    return F.regexp_replace(c, f"(?i)({alternatives})", "<em>$1</em>")


def has_ocr_noise(c: Column) -> Column:
    """Short text, few letters or digits, or a run of five symbols."""
    alnum = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    ratio = F.try_divide(alnum.cast("double"), F.length(c).cast("double"))
    return F.coalesce(
        (F.length(c) < 100) | (ratio < 0.5) | c.rlike(r"[^\p{L}\p{N}_\s]{5,}"), F.lit(True)
    )


def embedding_text(chunk: Column, page_type: Column) -> Column:
    return F.when(
        page_type.isNotNull(), F.concat(F.lit("["), page_type, F.lit("] "), chunk)
    ).otherwise(chunk)


def item_search_text(name: Column, hs_code: Column, brand: Column, model: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (name, hs_code, brand, model)])


def cells(line: Column) -> Column:
    """Cells of a line, cut at gaps of two or more blanks, with their positions.

    Result: ``array<struct<text, start_pos, end_pos>>``. The first cell starts at
    0, the last one ends with the line, any other ends on its last character.
    """
    cell = r"[^ \t]+(?:[ \t][^ \t]+)*"
    parts = F.struct(
        F.regexp_extract_all(line, F.lit(f"({cell})"), F.lit(1)).alias("texts"),
        F.split(line, cell).alias("gaps"),
    )

    def placed(p: Column) -> Column:
        count = F.size(p["texts"])

        def one(t: Column, i: Column) -> Column:
            start = F.length(F.array_join(F.slice(p["gaps"], F.lit(1), i + 1), "")) + F.length(
                F.array_join(F.slice(p["texts"], F.lit(1), i), "")
            )
            is_last = (i == count - 1) & (F.length(F.element_at(p["gaps"], -1)) < 2)
            return F.struct(
                F.regexp_replace(t, r"\t", " ").alias("text"),
                F.when(i == 0, F.lit(0)).otherwise(start).alias("start_pos"),
                F.when(is_last, F.length(line))
                .otherwise(start + F.length(t) - 1)
                .alias("end_pos"),
            )

        return F.transform(p["texts"], one)

    return let(parts, placed)
