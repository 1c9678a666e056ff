"""Addresses as column expressions. What is no address yields null, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HTTP = r"(?i)^https?://[^\s/?#]+"


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike(HTTP), F.lit(False))


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^@/?#]*@)?([^/?#:]+)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """The path of an address, or the text itself if it is none."""
    u = F.coalesce(url, F.lit(""))
    return F.when(u.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), F.regexp_extract(u, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)).otherwise(u)


def content_type(url: Column) -> Column:
    """video, podcast or article, by whole segments of the path."""
    p = F.lower(path(url))
    return F.when(p.rlike(r"(^|/)videos?(/|$)"), "video").when(p.rlike(r"(^|/)(podcasts?|episodes?)(/|$)"), "podcast").otherwise("article")


def without_slash(url: Column) -> Column:
    return F.regexp_replace(url, r"/$", "")


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def without_version(url: Column) -> Column:
    """A preprint address without its version and one trailing slash."""
    return without_slash(F.regexp_replace(url, r"v\d+$", ""))


def redacted_page(url: Column) -> Column:
    """Only scheme, host and path; "/" for anything but http(s)."""
    bare = F.regexp_replace(without_query(url), r"(?i)^(https?://)[^@/]*@", "$1")
    return F.when(is_http(url), bare).otherwise("/")


def thumbnail(url: Column, width: int = 420, height: int = 260) -> Column:
    size = f"w={width}&h={height}&crop=1"
    return F.when(url != "", F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit(size)))


def is_raster(url: Column) -> Column:
    return is_http(url) & ~F.lower(F.coalesce(url, F.lit(""))).rlike(r"\.svg(?:[?#]|$)|image/svg")


def form_encoded(c: Column) -> Column:
    """application/x-www-form-urlencoded, as browsers write it."""
    return F.replace(F.url_encode(F.coalesce(c, F.lit(""))), F.lit("~"), F.lit("%7E"))


def poster(base: str, **fields: Column) -> Column:
    """An address with the fields as its query."""
    parts = [F.concat(F.lit(f"{k}="), form_encoded(v)) for k, v in fields.items()]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *parts))


def first_valid(*urls: Column) -> Column:
    return F.get(F.filter(F.array(*urls), is_http), 0)


def resolved(url: Column, page: Column) -> Column:
    """An address relative to a page made absolute."""
    root = F.regexp_extract(page, r"(?i)^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(without_query(page), r"(?i)^(https?://.*/)[^/]*$", 1)
    return (
        F.when(is_http(url), url).when(url.startswith("//"), F.concat(F.regexp_extract(page, r"(?i)^(https?:)", 1), url))
        .when(url.startswith("/"), F.concat(root, url)).when(url != "", F.concat(F.when(folder != "", folder).otherwise(F.concat(root, F.lit("/"))), url))
    )


def is_allowed(url: Column, hosts: Sequence[str], path_pattern: str = ".*") -> Column:
    """https, exactly one of the hosts, no port or credentials, and a path that matches."""
    u = F.coalesce(url, F.lit(""))
    exact = F.lit(False)
    for h in hosts:
        exact = exact | u.startswith(f"https://{h}/")
    return exact & path(u).rlike(f"^(?:{path_pattern})$")


def screen_name(page_path: Column, screens: dict[str, str], app_prefix: str = "/app/") -> Column:
    p = F.regexp_replace(F.regexp_replace(page_path, r"\.html$", ""), r"/$", "")
    p = F.when(p == "", "/").otherwise(p)
    named = F.create_map(*[x for k, v in screens.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(named, p), F.when(p.startswith(app_prefix), "app_other").otherwise("site_other"))
