"""Small set of HTML expressions: elements by id or class, text, entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.text import strip

ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ",
    "&copy;": "©", "&middot;": "·", "&amp;": "&",
}


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def node_text(fragment: Column) -> Column:
    """Text of a fragment: its text nodes trimmed and put together."""
    return strip(unescape(F.regexp_replace(fragment, r"\s*<[^>]*>\s*", "")))


def page_text(html: Column) -> Column:
    """Visible text of a page, one line per text node."""
    bare = F.regexp_replace(
        html, r"(?is)<(script|style|template)\b.*?</\1\s*>|<!--.*?-->|<![^>]*>", ""
    )
    return unescape(F.regexp_replace(bare, r"<[^>]*>", "\n"))


def _first(html: Column, pattern: str) -> Column:
    """The last group of the first match, NULL where nothing matches."""
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 2))


def by_id(html: Column, element_id: str, end: str | None = None) -> Column:
    """Inner HTML of the element with an id, up to `end` (default: its closing tag)."""
    closing = end or r"</\1\s*>"
    return _first(
        html, rf"(?is)<(\w+)\b[^>]*\bid\s*=\s*[\"']{element_id}[\"'][^>]*>(.*?)(?:{closing}|\z)"
    )


def by_class(html: Column, tag: str, name: str) -> Column:
    return _first(
        html,
        rf"(?is)<({tag})\b[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?{name}(?:\s[^\"']*)?[\"'][^>]*>(.*?)</\1\s*>",
    )


def all_matches(html: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(group)), F.array().cast("array<string>")
    )


def attribute(tag: Column, name: str) -> Column:
    return F.nullif(
        F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("")
    )
