"""Posts: authors in order of first mention, time of publication, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlgrid.functions.html import page_chunks, parsed_pages
from marlgrid.functions.text import col, content_hash, iso_millis
from marlgrid.operators.staging import cut


def _meta(attribute: str, value: str) -> tuple[str, str]:
    a, c = rf'{attribute}\s*=\s*"{value}"', r'content\s*=\s*"([^"]+)"'
    return rf"(?i)<meta\s[^>]*?{a}[^>]*?\s{c}", rf"(?i)<meta\s[^>]*?{c}[^>]*?\s{a}"


def published_ms(html: Column | str) -> Column:
    """The first of the known marks that holds a date."""
    marks = [*_meta("property", "article:published_time"), *_meta("name", "article:published_time"), r'(?i)<time[^>]*datetime\s*=\s*"([^"]+)"']
    # each mark is looked for once: a date's many parts are taken from what was found, as a lambda's variable
    said = F.filter(F.array(*[F.regexp_extract(col(html), p, 1) for p in marks]), lambda m: m != "")
    return F.get(F.filter(F.transform(said, iso_millis), lambda ms: ms.isNotNull()), F.lit(0))


def authors(html: Column | str) -> Column:
    marks = [*_meta("property", "article:author"), *_meta("name", "author")]
    every = F.flatten(F.array(*[F.regexp_extract_all(col(html), F.lit(p), F.lit(1)) for p in marks]))
    return F.array_distinct(F.filter(F.transform(every, lambda a: F.trim(a)), lambda a: a != ""))


def posts(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posts, chunks) of pages (page_id, url, html)."""
    told = pages.where("page_id is not null").withColumns({"published_at_ms": published_ms("html"), "authors": authors("html")})
    # parsed once, for the posts and for the chunks
    parsed = cut(parsed_pages(told, keep=("url", "published_at_ms", "authors")))
    return parsed.select("page_id", "url", "published_at_ms", "authors", "title", content_hash("title", "text").alias("content_hash"), "error"), page_chunks(parsed)
