"""URLs held in other fields, and facets of URL paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprov.functions.domains import bind

# Terms that make a column name look URL-bearing, and what a URL looks like.
URL_TERMS = [
    "url", "link", "domain", "website", "site", "web", "http", "https", "www", "uri", "href",
    "address", "hyperlink", "path", "redirect", "source", "anchor", "api",
]
URL_PATTERN = (
    r"https?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+"
    r"|(?:www\.|(?!www))[a-zA-Z0-9][a-zA-Z0-9-]+[a-zA-Z0-9]\.[^\s]{2,}"
    r"|www\.[a-zA-Z0-9][a-zA-Z0-9-]+[a-zA-Z0-9]\.[^\s]{2,}"
    r"|https?://(?:www\.|(?!www))[a-zA-Z0-9]+\.[^\s]{2,}"
    r"|www\.[a-zA-Z0-9]+\.[^\s]{2,}"
)
INTEGER = r"^\s*[+-]?\d+\s*$"
DICT_TEXT_URL = r"'url'\s*:\s*'([^']*)'"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_url(text: str | Column, path: str = "$.url") -> Column:
    """URL inside JSON text."""
    return F.get_json_object(_col(text), path)


def dict_text_url(text: str | Column, strict_parity: bool = False) -> Column:
    """URL inside the printed form of a dict.

    Text without a match gives NULL; with ``strict_parity`` it gives the empty string.
    """
    found = F.regexp_extract(_col(text), DICT_TEXT_URL, 1)
    return found if strict_parity else F.nullif(found, F.lit(""))


def path_facets(df: DataFrame, url: str = "url", year_at: int = 3, section_at: int = 6) -> DataFrame:
    """Add ``year`` and ``section`` from the slash-separated parts of a URL.

    If either part is missing, or the year is no integer, both are NULL.
    """
    parts = bind(df, _parts=F.split(F.col(url), "/"))
    text = F.get("_parts", F.lit(year_at))
    # A failed try_cast costs an exception per row, so only integers reach it.
    year = F.when(text.rlike(INTEGER), text.try_cast("bigint"))
    section = F.get("_parts", F.lit(section_at))
    ok = year.isNotNull() & section.isNotNull()
    return parts.withColumns({"year": F.when(ok, year), "section": F.when(ok, section)}).drop("_parts")
