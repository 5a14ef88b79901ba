"""Column expressions over URLs, following the usual reference-resolution rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetweave import rules
from assetweave.functions.names import strip_suffixes
from assetweave.functions.text import SPACE, contains_any

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
_ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)"
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def authority(url: Column) -> Column:
    """Host and port as written; '' when there is none or its brackets do not pair up."""
    raw = F.coalesce(F.regexp_extract(url, _AUTHORITY, 1), F.lit(""))
    return F.when(F.contains(raw, F.lit("[")) != F.contains(raw, F.lit("]")), "").otherwise(raw)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def url_domain(url: Column) -> Column:
    return F.replace(F.lower(authority(url)), F.lit("www."), F.lit(""))


def host(url: Column) -> Column:
    """Lower-case host without the port."""
    return F.regexp_replace(F.lower(authority(url)), r":.*$", "")


def valid_url(url: Column) -> Column:
    net = authority(url)
    return F.coalesce(scheme(url).isin("http", "https") & (net != "")
                      & ~contains_any(net, ["localhost", "127.0.0.1"]), F.lit(False))


def is_directory(domain: Column) -> Column:
    return contains_any(domain, rules.DIRECTORY_SITES)


def domain_matches(domain: Column, name: Column) -> Column:
    """Some word of the name, suffixes removed, occurs in the domain."""
    parts = F.split(strip_suffixes(name, "anywhere"), f"{SPACE}+|-")
    return F.exists(parts, lambda w: (F.length(w) > 2) & F.contains(domain, w))


def allowed_domain(url: Column, base: Column) -> Column:
    """Same host as `base` or one of its subdomains."""
    return (host(url) == base) | F.endswith(host(url), F.concat(F.lit("."), base))


def canonical_url(url: Column, document: Column | bool = False) -> Column:
    """Drop the fragment and trailing slashes; for documents drop the query instead."""
    page = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")
    if document is False:
        return page
    document = F.lit(True) if document is True else document
    return F.when(document, F.regexp_replace(url, "[#?].*$", "")).otherwise(page)


def is_document(url: Column, suffix: str = ".pdf") -> Column:
    return F.lower(url).endswith(suffix)


def _dot_free(path: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))),
        F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                        .when(s == ".", acc)
                        .otherwise(F.array_append(acc, s)))
    tail = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"),
                  F.concat(F.lit("/"), F.array_join(kept, "/"), tail)).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of `href` found on the page `base`."""
    origin = F.regexp_extract(base, _ORIGIN, 1)
    base_path = url_path(base)
    folder = F.when(base_path == "", "/").otherwise(F.regexp_replace(base_path, "[^/]*$", ""))
    ref_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    ref_tail = F.regexp_replace(href, r"^[^?#]*", "")
    merged = F.regexp_replace(F.concat(folder, ref_path), "/{2,}", "/")
    return (F.when(href == "", base)
            .when(href.rlike(_SCHEME), href)
            .when(href.startswith("//"), F.concat(F.regexp_extract(base, _SCHEME, 0), href))
            .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
            .when(href.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), href))
            .when(href.startswith("/"), F.concat(origin, _dot_free(ref_path), ref_tail))
            .otherwise(F.concat(origin, _dot_free(merged), ref_tail)))


def safe_file_name(url: Column, max_chars: int | None = None) -> Column:
    """File name for a downloaded document; too short ones get a hash of the URL."""
    base = F.regexp_extract(url_path(url), r"([^/]*)$", 1)
    name = F.regexp_replace(F.replace(base, F.lit(".."), F.lit("")), r'[/\\<>:"|?*]', "_")
    name = F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))
    if max_chars is not None:
        name = F.when(F.length(name) > max_chars,
                      F.concat(F.substring(name, 1, max_chars - 4), F.lit(".pdf"))).otherwise(name)
    made = F.concat(F.lit("document_"), F.substring(F.sha2(url, 256), 1, 16), F.lit(".pdf"))
    return F.when(F.length(name) < 5, made).otherwise(name)


def trusted_tld(domain: Column) -> Column:
    return F.contains(domain, F.lit(".")) & F.regexp_extract(domain, r"([^.]*)$", 1).isin(
        *rules.TRUSTED_TLDS)
