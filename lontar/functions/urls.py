"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import matches

_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def url_domain(url: Column) -> Column:
    """What stands between ``://`` and the path: port, user and case are kept; empty if there is no such part."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def url_normalize(url: Column) -> Column:
    """In this order: cut the fragment, strip all final slashes, delete tracking parameters."""
    plain = F.regexp_replace(F.substring_index(url, "#", 1), r"/+$", "")
    return F.regexp_replace(plain, vocab.TRACKING, "")


def url_same_domain(url: Column, base: Column) -> Column:
    domain = url_domain(url)
    return (domain == base) | F.endswith(domain, F.concat(F.lit("."), base))


def url_trap(url: Column) -> Column:
    """Paths that lead a crawler in circles or to what is no page. The query string is not looked at."""
    path = url_path(url)
    low = F.lower(path)
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    n = F.size(parts)
    twice = F.exists(F.zip_with(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(parts, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)
    fragments = F.lit(False)
    for fragment in vocab.SKIPPED_FRAGMENTS:
        fragments = fragments | F.contains(low, F.lit(fragment))
    return matches(low, rf"\.(?:{'|'.join(vocab.SKIPPED_EXTENSIONS)})$") | (n > vocab.MAX_SEGMENTS) | twice | matches(path, r"/[0-9]{4}/[0-9]{2}/[0-9]{2}/[0-9]{4}/") | fragments


def url_resolve(href: Column, base: Column) -> Column:
    """An href as an absolute URL: absolute, protocol-relative, root-relative, query-only and relative ones.

    Dot segments are not resolved."""
    scheme, origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    path = url_path(base)
    folder = F.concat(origin, F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", "")))
    return (
        F.when(matches(href, r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(F.startswith(href, F.lit("?")), F.concat(page, href))
        .otherwise(F.concat(folder, href))
    )
