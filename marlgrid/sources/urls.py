"""Routing of urls to corpora, sections and entity parents, as Columns; hosts and prefixes are parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlgrid.functions.text import col


@dataclass(frozen=True)
class Corpus:
    """A documentation site: its host suffix, where its sections start in the path, and its name (or the first path part, of a closed set)."""

    host: str
    name: str
    section_at: int
    first_parts: tuple[str, ...] = ()


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_parts(url: Column | str) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def _on(url: Column | str, c: Corpus) -> Column:
    return (host(url) == c.host) | host(url).endswith("." + c.host)


def corpus_name(url: Column | str, corpora: Sequence[Corpus]) -> Column:
    """The first corpus whose host fits; one with a closed set of first path parts is named by that part, null outside it."""
    out = F
    for c in corpora:
        named = F.when(F.get(path_parts(url), F.lit(0)).isin(*c.first_parts), F.get(path_parts(url), F.lit(0))) if c.first_parts else F.lit(c.name)
        out = out.when(_on(url, c), named)
    return out.otherwise(F.lit(None).cast("string"))


def section_root(url: Column | str, corpora: Sequence[Corpus]) -> Column:
    """The section's path part with a slash, null at a corpus's root and elsewhere."""
    out = F
    for c in corpora:
        part = F.get(path_parts(url), F.lit(c.section_at))
        out = out.when(_on(url, c), F.when(part.isNotNull(), F.concat(part, F.lit("/"))))
    return out.otherwise(F.lit(None).cast("string"))


def is_skill_bearing(url: Column | str, corpora: Sequence[Corpus], denied: Sequence[str]) -> Column:
    """No foreign hosts, index pages, paths that end in a slash, nor denied sections."""
    parts = path_parts(url)
    last = F.lower(F.element_at(F.when(F.size(parts) > 0, parts), -1))
    section = F.rtrim(section_root(url, corpora), F.lit("/"))
    good = corpus_name(url, corpora).isNotNull() & (F.size(parts) > 0) & ~last.isin("index", "index.html", "index.htm") & ~path(url).endswith("/") & ~F.coalesce(section.isin(*denied), F.lit(False))
    return F.coalesce(good, F.lit(False))


def is_post(url: Column | str, host_name: str, root: str, denied_prefixes: Sequence[str]) -> Column:
    """A blog's posts: under its root on its host, no feeds, no landing pages of categories, no denied prefixes."""
    parts = path_parts(url)
    last = F.lower(F.element_at(F.when(F.size(parts) > 0, parts), -1))
    bare = F.regexp_replace(path(url), "^/+", "")
    denied = F.lit(False)
    for p in denied_prefixes:
        denied = denied | bare.startswith(p + "/") | (bare == p)
    good = ((host(url) == host_name) | (host(url) == "www." + host_name)) & (F.size(parts) > 1) & (F.get(parts, F.lit(0)) == root) & ~last.isin("sitemap.xml", "rss.xml", "feed.xml", "atom.xml", "feed", "rss") & ~((F.size(parts) == 3) & (F.get(parts, F.lit(1)) == "category")) & ~denied
    return F.coalesce(good, F.lit(False))


def routed(value: Column | str, prefixes: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The target of the first prefix that fits."""
    out = F
    for prefix, target in prefixes:
        out = out.when(col(value).startswith(prefix), target)
    return out.otherwise(F.lit(default).cast("string"))
