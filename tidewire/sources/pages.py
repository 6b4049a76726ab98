"""Article rows and links from landed web pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewire.functions import html as H
from tidewire.functions.arrays import unfold
from tidewire.functions.times import parse_local
from tidewire.functions.urls import canonical_or_url, normalize_url, resolve_dynamic, resolve_static
from tidewire.functions.urls import valid_dynamic, valid_static
from tidewire.operators.registry import MAX_LINKS_DYNAMIC, MAX_LINKS_STATIC
from tidewire.params import DEFAULTS

_PAGE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("canonical", T.StringType()),
    T.StructField("dates", T.ArrayType(T.StringType())),
])
_LINK = T.ArrayType(T.StructType([T.StructField("selector", T.IntegerType()), T.StructField("href", T.StringType())]))
SLICE_CHARS = 1_000_000     # markup read before its results leave the worker


def _each_page(pages: DataFrame, listed: Column, read: Callable[[str, list[str]], object], made: T.DataType) -> DataFrame:
    """`pages` without their html, and `_made`: read(html, listed) of every page.

    A worker holds the Arrow batch, one page as text and tree, and the results of a slice.
    """
    asked = pages.withColumn("_listed", listed)
    kept = [f for f in pages.schema.fields if f.name != "html"]
    names, made_type = [f.name for f in kept], to_arrow_type(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, out = 0, 0, []
            markup, selectors = batch.column("html"), batch.column("_listed")
            for at in range(batch.num_rows):
                page = markup[at].as_py() or ""
                out.append(read(page, selectors[at].as_py() or []))
                held += len(page)
                if held >= SLICE_CHARS or at + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(n).slice(start, len(out)) for n in names], pa.array(out, made_type)], [*names, "_made"])
                    start, held, out = at + 1, 0, []

    return asked.mapInArrow(run, T.StructType([*kept, T.StructField("_made", made)]))


def _page_reader(dynamic: bool):
    def read(page: str, extra: list[str]) -> dict:
        root = None
        try:
            root = H.parse(page)
            text, method = H.main_text(root)
            return {"title": H.title(root, dynamic), "text": text, "method": method, "canonical": H.canonical(root),
                    "dates": H.date_candidates(root, dynamic, extra)}
        except Exception as fault:      # one bad page is a row with a reason, not the end of the job
            return {"title": None, "text": "", "method": f"unreadable: {type(fault).__name__}", "canonical": None, "dates": []}
        finally:
            if root is not None:
                H.release(root)
    return read


def _read_links(page: str, listed: list[str]) -> list[dict]:
    root = None
    try:
        root = H.parse(page)
        return [{"selector": n, "href": h} for n, h in H.select_links(root, listed)]
    except Exception:                   # the page has no links that can be read
        return []
    finally:
        if root is not None:
            H.release(root)


def page_articles(pages: DataFrame, dynamic: bool = False, as_of: Column | None = None,
                  site_selectors: Column | None = None) -> DataFrame:
    """Article row of every page with a title and a long enough text.

    The first written date that parses counts. A plain page without a date has
    none, a scripted page gets `as_of`.
    """
    extra = F.lit(None).cast("array<string>") if site_selectors is None else site_selectors
    read = _each_page(pages, extra, _page_reader(dynamic), _PAGE).withColumnRenamed("_made", "_p")
    published = F.try_element_at(F.filter(F.transform("_p.dates", lambda d: parse_local(d)), lambda d: d.isNotNull()), F.lit(1))
    if dynamic and as_of is not None:
        published = F.coalesce(published, as_of.cast("timestamp_ntz"))
    canonical = canonical_or_url(normalize_url(F.col("_p.canonical")), F.col("url"))
    return (read.where((F.col("_p.title") != "") & (F.length(F.trim("_p.text")) >= 100))
            .select(*[c for c in pages.columns if c != "html"],
                    F.substring("_p.title", 1, DEFAULTS.title_max).alias("title"), canonical.alias("canonical_url"),
                    published.alias("published_at"), F.col("_p.text").alias("content_text"), F.col("_p.method").alias("method")))


def _link_rows(pages: DataFrame, links: Column, key: str, limit: int) -> DataFrame:
    """Distinct links in order, cut per page; arrays only, so no shuffle."""
    kept = F.slice(F.array_distinct(F.filter(links, lambda u: u.isNotNull())), 1, limit)
    return unfold(pages, [key], kept, "at", "link")


def page_links(pages: DataFrame, key: str = "page_id", rule: bool = False, limit: int = MAX_LINKS_STATIC) -> DataFrame:
    """Article links of plain list pages.

    With `rule` the page carries `list_selectors`, `allow` and `allowed_domains`
    of its site; the first site selector that yields a link ends the search.
    """
    defaults = F.array(*[F.lit(s) for s in H.DEFAULT_LINK_SELECTORS])
    own = F.coalesce(F.col("list_selectors"), F.array().cast("array<string>")) if rule else F.array().cast("array<string>")
    found = _each_page(pages.withColumn("_own", F.size(own)), F.array_distinct(F.concat(own, defaults)),
                       _read_links, _LINK).withColumnRenamed("_made", "_l")
    allow = F.col("allow") if rule else None
    domains = F.col("allowed_domains") if rule else None
    good = F.filter(
        F.transform("_l", lambda x: F.struct(x["selector"].alias("s"), resolve_static(F.col("url"), x["href"]).alias("u"))),
        lambda x: valid_static(x["u"], allow, None, domains))
    found = found.withColumn("_g", good)
    stop = F.when(F.col("_own") > 0, F.array_min(F.transform("_g", lambda x: x["s"])))
    links = F.transform(F.filter("_g", lambda x: stop.isNull() | (x["s"] == stop)), lambda x: x["u"])
    return _link_rows(found, links, key, limit)


def page_links_dynamic(pages: DataFrame, selectors: list[str], key: str = "page_id", allow: list[str] | None = None,
                       limit: int = MAX_LINKS_DYNAMIC) -> DataFrame:
    """Article links of scripted list pages: same host, all selectors."""
    listed = F.array(*[F.lit(s) for s in selectors])
    rule = F.array(*[F.lit(a) for a in allow]) if allow else None
    found = _each_page(pages, listed, _read_links, _LINK)
    urls = F.transform("_made", lambda x: resolve_dynamic(F.col("url"), x["href"]))
    return _link_rows(found, F.filter(urls, lambda u: valid_dynamic(u, F.col("url"), rule)), key, limit)


def page_anchors(pages: DataFrame, key: str = "page_id", limit: int = MAX_LINKS_STATIC,
                 allow: list[str] | None = None) -> DataFrame:
    """Links of every anchor, wherever it stands; built-in expressions only."""
    hrefs = F.regexp_extract_all("html", F.lit(r"<a\s[^>]*?href=\"([^\"]*)\""), F.lit(1))
    rule = F.array(*[F.lit(a) for a in allow]).cast("array<string>") if allow is not None else None
    urls = F.transform(hrefs, lambda h: resolve_static(F.col("url"), h))
    return _link_rows(pages, F.filter(urls, lambda u: valid_static(u, rule)), key, limit)
