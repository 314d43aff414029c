"""URLs of shops, sellers and products, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def full_host(url: Column) -> Column:
    """Lower-case host; empty if there is none.  Hosts with an underscore, which the parser knows as an authority alone, count."""
    part = lambda name: F.try_parse_url(F.trim(url), F.lit(name))
    return F.lower(F.coalesce(part("HOST"), F.regexp_replace(part("AUTHORITY"), r"^.*@|:\d*$", ""), F.lit("")))


def host(url: Column) -> Column:
    """The host without ``www.``."""
    return F.regexp_replace(full_host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(F.trim(url), F.lit("PATH")), F.lit(""))


def in_domain(domain: Column, domains) -> Column:
    """The domain itself or one below it."""
    out = F.lit(False)
    for d in domains:
        out = out | (domain == d) | domain.endswith("." + d)
    return out


def is_own_domain(domain: Column) -> Column:
    return in_domain(domain, vocab.OWN_DOMAINS)


def is_covered(domain: Column) -> Column:
    return in_domain(domain, vocab.COVERED_DOMAINS)


_EXPORT_HOST = r"(?i)^([\w-]+)-cs(\d+)\.prom\.ua$"


def export_seller(url: Column) -> tuple[Column, Column]:
    """(slug, id) of a host ``<slug>-cs<id>.prom.ua``, else nulls."""
    h = full_host(url)
    return tuple(F.nullif(F.regexp_extract(h, _EXPORT_HOST, i), F.lit("")) for i in (1, 2))


def is_export(url: Column) -> Column:
    return export_seller(url)[1].isNotNull()


def source_label(url: Column) -> Column:
    return F.when(is_export(url), F.lit("export")).otherwise(F.lit("scrape"))


def store_seller(url: Column) -> tuple[Column, Column, Column]:
    """(id, slug, language) of ``prom.ua/[lang/]c<id>-<slug>.html``, else nulls."""
    pattern = r"(?i)^(?:/([a-z]{2}))?/c(\d+)-([^/]+?)\.html$"
    fine = host(url) == "prom.ua"
    part = lambda i: F.when(fine, F.nullif(F.regexp_extract(path(url), pattern, i), F.lit("")))
    return part(2), part(3), part(1)


def host_seller_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(full_host(url), r"-cs(\d+)(?:\.|$)", 1), F.lit(""))


def product_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(path(url), r"(?i)/(?:[a-z]{2}/)?p(\d+)-", 1), F.lit(""))


def same_product(a: Column, b: Column) -> Column:
    """Equal product ids if both have one, else equal hosts and paths without a language; null urls are never the same."""
    place = lambda u: F.concat_ws(" ", host(u), F.lower(F.regexp_replace(F.regexp_replace(path(u), "/+$", ""), r"(?i)^/[a-z]{2}/", "/")))
    both = product_id(a).isNotNull() & product_id(b).isNotNull()
    same = F.when(both, product_id(a) == product_id(b)).otherwise(place(a) == place(b))
    return F.coalesce(same & (a != "") & (b != ""), F.lit(False))


def canonical_product(url: Column) -> Column:
    """The marketplace's own link for a product of an export host; other urls as they are."""
    last = F.regexp_extract(path(url), r"/([^/]+)/?$", 1)
    return F.when(is_export(url) & (last != ""), F.concat(F.lit("https://prom.ua/ua/"), last)).otherwise(url)


def image_url(value: Column) -> Column:
    return F.when(F.trim(value).rlike("^https?://"), F.trim(value))


def group_ids(html: Column) -> Column:
    """Distinct product group ids in the links of a page, in page order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?:[?&]|&amp;)product_group=(\d+)"), F.lit(1)))


def schema_stock(value: Column) -> Column:
    """Stock by the last part of a schema.org address."""
    last = F.lower(F.element_at(F.split(F.regexp_replace(value, "/+$", ""), "/"), -1))
    return F.when(last == "outofstock", "out_of_stock").when(last == "instock", "in_stock").when(last == "preorder", "on_order")
