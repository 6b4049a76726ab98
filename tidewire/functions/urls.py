"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
DOMESTIC_SUFFIXES = [
    "sina.com.cn", "eastmoney.com", "jrj.com.cn", "cls.cn", "caijing.com.cn",
    "finance.qq.com", "163.com", "sohu.com", "people.com.cn", "xinhuanet.com",
    "cnstock.com", "stcn.com", "yicai.com", "caixin.com", "wallstreetcn.com",
    "hexun.com", "10jqka.com.cn", "ithome.com", "cnbeta.com", "chinaz.com",
    "36kr.com", "pingwest.com", "tmtpost.com", "baidu.com", "taobao.com",
    "tmall.com", "jd.com", "zhihu.com", "douban.com", "weibo.com",
]
FOREIGN_SUFFIXES = [
    "bbc.com", "bbc.co.uk", "reuters.com", "bloomberg.com", "wsj.com", "ft.com",
    "nytimes.com", "economist.com", "cnbc.com", "forbes.com", "fortune.com",
    "marketwatch.com", "seeking alpha.com", "morningstar.com", "techcrunch.com",
    "theverge.com", "arstechnica.com", "wired.com", "engadget.com", "openai.com",
    "anthropic.com", "google.com", "microsoft.com", "apple.com", "nvidia.com",
]
STATIC_EXCLUDED = [
    "#", "javascript:", "mailto:", ".jpg", ".png", ".gif", ".pdf", ".xml",
    "/tag/", "/category/", "/author/", "/page/", "/search", "/feed",
]
DYNAMIC_EXCLUDED = [
    "/tag/", "/category/", "/author/", "/search", "/login", "/register",
    ".pdf", ".jpg", ".png", ".gif",
]
DEFAULT_ALLOWED = ["/news", "/blog", "/press", "/story", "/article"]
# ---- end of fixed values ----------------------------------------------------

# scheme and host | path without its last slashes | params | query
URL_PARTS = r"^((?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?]*)?)([^?]*?)/*((?:;[^?/]*)?)(\?.*)?$"


def _quote(text: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\\/#" and c not in "/#" else c for c in text)


def contains_any(text: Column, parts: list[str]) -> Column:
    return text.rlike("|".join(_quote(p) for p in parts)) if parts else F.lit(False)


def ends_with_any(text: Column, suffixes: list[str]) -> Column:
    return text.rlike("(?:" + "|".join(_quote(s) for s in suffixes) + ")$")


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def host_of(url: Column) -> Column:
    """Network location, port included; empty when there is none."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def normalize_url(url: Column) -> Column:
    """Drop the fragment and the last slashes of the path, http becomes https."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[\t\r\n]", ""), r"(?s)#.*$", "")
    host = host_of(bare)
    broken = host.contains("[") != host.contains("]")
    joined = F.regexp_replace(F.regexp_replace(bare, URL_PARTS, "$1$2$3$4"), r"\?$", "")
    secure = F.regexp_replace(joined, r"^(?i:https?)://", "https://")
    return F.when(broken, url).otherwise(secure)


def _drop_dots(path: Column) -> Column:
    """Resolve `.` and `..` segments of an absolute path."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda done, seg: F.when(seg == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(seg == ".", done)
        .otherwise(F.concat(done, F.array(seg))),
    )
    slash = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")
    resolved = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.when(kept == F.array().cast("array<string>"), F.lit("/"))
                  .otherwise(F.concat(resolved, slash))).otherwise(path)


def join_url(base: Column, href: Column) -> Column:
    """`href` as seen from the page `base`."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    base_query = F.regexp_extract(base, r"(\?[^#]*)", 1)
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    href_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    href_rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    path = F.when(href_path.startswith("/"), href_path).otherwise(F.concat(folder, href_path))
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1), href))
        .when(href.startswith("?"), F.concat(origin, base_path, href))
        .when(href.startswith("#"), F.concat(origin, base_path, base_query, href))
        .otherwise(F.concat(origin, _drop_dots(path), href_rest))
    )


def resolve_static(base: Column, href: Column) -> Column:
    """Link of a plain list page; null for an empty link."""
    link = F.trim(href)
    full = (
        F.when(link.startswith("//"), F.concat(scheme_of(base), F.lit(":"), link))
        .when(link.startswith("http"), link)
        .otherwise(join_url(base, link))
    )
    return F.when(link == "", None).otherwise(normalize_url(full))


def resolve_dynamic(base: Column, href: Column) -> Column:
    """Link of a scripted list page; empty stays empty, nothing is normalised."""
    return (
        F.when(F.coalesce(href, F.lit("")) == "", F.lit(""))
        .when(href.startswith("http://") | href.startswith("https://"), href)
        .otherwise(join_url(base, href))
    )


def domain_of(url: Column) -> Column:
    """Host without port and leading www; the input itself when it has no host."""
    host = F.regexp_extract(url, r"https?://([^/]+)", 1)
    bare = F.regexp_replace(F.substring_index(host, ":", 1), r"^www\.", "")
    return F.when(host == "", url).otherwise(bare)


def domain_class(domain: Column) -> Column:
    return (
        F.when(ends_with_any(domain, DOMESTIC_SUFFIXES), "domestic")
        .when(ends_with_any(domain, FOREIGN_SUFFIXES), "foreign")
        .otherwise("unknown")
    )


def valid_static(url: Column, allow: Column | None = None, deny: Column | None = None,
                 domains: Column | None = None) -> Column:
    """Article link test for plain sites.

    `allow`, `deny` and `domains` are array columns of the site rule; a null
    `allow` means the default list, an empty one allows everything.
    """
    low = F.lower(url)
    default_ok = contains_any(low, DEFAULT_ALLOWED)
    ok = default_ok
    if allow is not None:
        ok = F.when(allow.isNull(), default_ok).otherwise(
            (F.size(allow) == 0) | F.exists(allow, lambda p: F.contains(low, p)))
    if deny is not None:
        ok = ok & ~F.coalesce(F.exists(deny, lambda p: F.contains(low, p)), F.lit(False))
    host = host_of(url)
    if domains is not None:
        ok = ok & ((host == "") | F.coalesce(F.size(domains) < 1, F.lit(True))
                   | F.exists(domains, lambda d: F.endswith(host, d)))
    return F.coalesce(
        (url != "") & ~contains_any(low, STATIC_EXCLUDED) & ok & scheme_of(url).isin("http", "https"),
        F.lit(False),
    )


def valid_dynamic(url: Column, source_url: Column, allow: Column | None = None) -> Column:
    """Article link test for scripted sites: same host, then allow or exclude list."""
    not_excluded = ~contains_any(F.lower(url), DYNAMIC_EXCLUDED)
    rule = not_excluded
    if allow is not None:
        rule = F.when(F.coalesce(F.size(allow) > 0, F.lit(False)),
                      F.exists(allow, lambda p: F.contains(url, p))).otherwise(not_excluded)
    return F.coalesce(url.startswith("http") & (host_of(url) == host_of(source_url)) & rule, F.lit(False))


def canonical_or_url(canonical: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(canonical, F.lit("")), url)


def dedup_key(canonical: Column, url: Column, title: Column, published_at: Column) -> Column:
    """md5 of address, title and time; a missing time is written as None."""
    stamp = F.coalesce(F.date_format(published_at, "yyyy-MM-dd HH:mm:ss"), F.lit("None"))
    return F.md5(F.concat_ws("|", canonical_or_url(canonical, F.coalesce(url, F.lit(""))),
                             F.coalesce(title, F.lit("")), stamp))
