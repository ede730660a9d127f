"""Links and aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_link(link: Column, url: Column) -> Column:
    """Absolute links stay; others are put after the page's url with one slash (two if only the link brings it)."""
    joined = F.when(url.endswith("/") & link.startswith("/"), F.concat(url, F.substr(link, F.lit(2)))).when(url.endswith("/") | link.startswith("/"), F.concat(url, F.when(link.startswith("/"), F.concat(F.lit("/"), link)).otherwise(link))).otherwise(F.concat(url, F.lit("/"), link))
    return F.when(link.startswith("http") | link.startswith("www"), link).otherwise(joined)


def namespaced(alias: Column, domain: Column) -> Column:
    """``domain_alias``; nothing for a null or empty alias."""
    return F.when(alias != "", F.concat_ws("_", domain, alias))


def host_name(url: Column) -> Column:
    """The host without www. and without its last label."""
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.regexp_extract(url, r"^(?:https?://)?([^/?#]+)", 1))
    return F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"\.[^.]*$", "")


def same_site(link: Column, url: Column) -> Column:
    """Whether a link can be followed: not to the page itself, not to another host.  No link at all can be clicked."""
    relative = ~link.rlike(r"^(https?:)?//")
    itself = (link == "") | url.endswith(link)
    return link.isNull() | F.coalesce(~itself & (relative | (host_name(link) == host_name(url))), F.lit(False))


def without_dots(path: Column) -> Column:
    """A path (from its slash to a query or fragment) without its ``.`` and ``..`` steps."""
    bare, rest = F.regexp_extract(path, r"^([^?#]*)", 1), F.regexp_extract(path, r"^[^?#]*(.*)$", 1)
    steps = F.split(bare, "/")
    keep = F.aggregate(
        F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.concat(out, F.array(x))),
    )
    end = F.when(bare.rlike(r"/\.\.?$") & (F.size(keep) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(bare.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.concat_ws("/", keep), end, rest)).otherwise(path)


def absolute(href: Column, url: Column) -> Column:
    """A reference resolved against the page's url: full, scheme-relative, rooted, query, fragment or relative."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    site = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(url, r"[?#].*$", "")
    bare = F.regexp_replace(url, r"#.*$", "")
    folder = F.when(page.rlike(r"^[^:]+://[^/]*$"), F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href == "", url)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, without_dots(href)))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(bare, href))
        .otherwise(F.concat(site, without_dots(F.concat(F.substr(folder, F.length(site) + 1), href))))
    )
