"""Websites: sitemaps, links, the crawl frontier, page fetches with a cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import patterns as P
from siltstone.functions.columns import url_to_filepath
from siltstone.scratch import write_table

from .http import Fetch, http_fetch  # noqa: F401

#: Pages at most, the links that make a start page a site, and pages that are fetched at once.
MAX_PAGES, MIN_LINKS, FETCHERS = 2000, 5, 16


def sitemap_urls(sitemaps: DataFrame, url_filter: str = "") -> DataFrame:
    """(framework, url) of each <loc> of a sitemap's <url>, whatever the namespace; sorted within a framework by readers."""
    xml = F.regexp_replace("content", r"\A\s*<\?xml[^>]*\?>", "")
    found = F.explode(F.xpath(xml, F.lit('//*[local-name()="url"]/*[local-name()="loc"]/text()')))
    urls = sitemaps.select("framework", found.alias("url")).withColumn("url", F.trim("url"))
    return urls.where(F.contains("url", F.lit(url_filter))) if url_filter else urls


def links(pages: DataFrame, prefix: str | None = None) -> DataFrame:
    """(page, link): distinct links of each page (url, html) that stay on its host (or ``prefix``'s) below its path.

    Relative addresses are resolved; fragments, queries and trailing slashes go; so do addresses of over 500 characters,
    scripts, mail and data, and static files."""
    base = F.lit(prefix) if prefix is not None else F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    raw = F.explode(F.regexp_extract_all("html", F.lit(P.HREF), F.lit(0)))
    rows = pages.select(F.col("url").alias("page"), base.alias("prefix"), raw.alias("raw"))
    value = F.regexp_replace(F.regexp_replace("raw", r"(?i)^href\s*=\s*", ""), r"""^["']|["']$""", "")
    rows = rows.withColumn("href", value).where((F.col("href") != "") & (F.length("href") <= P.MAX_LINK) & ~F.col("href").rlike(r"^(?:javascript:|mailto:|data:|\\)"))
    scheme, host = F.regexp_extract("page", r"^([a-z]+:)", 1), F.regexp_extract("page", r"^([a-z]+://[^/?#]+)", 1)
    path = F.regexp_extract("page", r"^[a-z]+://[^/?#]+(/[^?#]*)?", 1)
    folder = F.concat(host, F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), r"[^/]*$", ""))
    full = F.when(F.col("href").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("href")).when(F.startswith("href", F.lit("//")), F.concat(scheme, "href")).when(F.startswith("href", F.lit("/")), F.concat(host, "href")).when(F.startswith("href", F.lit("?")), F.concat(host, path, "href")).otherwise(F.concat(folder, "href"))
    plain = F.regexp_replace(F.regexp_replace(full, r"[#?].*$", ""), r"/+$", "")
    for _ in range(8):  # a/../ and ./ steps
        plain = F.regexp_replace(F.regexp_replace(plain, r"/\./", "/"), r"(?<=[^/:])/(?!\.\./)[^/]+/\.\./", "/")
    rows = rows.withColumn("link", F.regexp_replace(plain, r"(?<=[^/:])/(?!\.\.$)[^/]+/\.\.$|/\.$", ""))
    host_of = lambda c: F.regexp_extract(c, r"^[a-z]+://([^/?#]+)", 1)
    path_of = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[a-z]+://[^/?#]+", ""), r"/+$", "")
    static = F.col("link").rlike("(?:" + "|".join(s.replace(".", r"\.") for s in P.STATIC_SUFFIXES) + r")$")
    kept = rows.where((F.length("link") <= P.MAX_LINK) & (host_of("link") == host_of("prefix")) & F.startswith(path_of("link"), path_of("prefix")) & ~static)
    return kept.select("page", "link").distinct()


def resolve_urls(spark: SparkSession, source: dict, read_sitemap: Callable[[str], DataFrame], crawl_from: Callable[[str], DataFrame]) -> DataFrame:
    """(url): a sitemap's, else those listed, else those crawled from a URL that ends in /*, else the URL itself."""
    if source.get("sitemap"):
        return sitemap_urls(read_sitemap(source["sitemap"]), source.get("url_filter", "")).select("url")
    if source.get("urls"):
        return spark.createDataFrame([(u,) for u in sorted(source["urls"])], "url string")
    url = source.get("url") or ""
    if url.endswith("/*"):
        return crawl_from(url[:-2])
    return spark.createDataFrame([(url,)] if url else [], "url string")


def crawl(edges: DataFrame, starts: DataFrame, max_pages: int = MAX_PAGES, max_depth: int = 64) -> DataFrame:
    """(url, depth): what can be reached over ``edges`` (page, link) from ``starts`` (url), breadth first.

    Each round joins the frontier to the links and takes away what was seen.  Within a round addresses are taken in
    order; the search ends at ``max_pages``, the crawl's own limit."""
    seen = write_table(starts.select("url", F.lit(0).alias("depth")).distinct(), "frontier")
    frontier, count = seen, seen.count()
    for depth in range(1, max_depth + 1):
        found = edges.join(frontier.select(F.col("url").alias("page")), "page").select(F.col("link").alias("url")).distinct().join(seen, "url", "left_anti")
        frontier = write_table(found.orderBy("url").limit(max(0, max_pages - count)).withColumn("depth", F.lit(depth)), "frontier")
        new = frontier.count()
        if not new:
            break
        seen, count = seen.unionByName(frontier), count + new
    return seen


def reachable_sql(edges_view: str, start: int, max_depth: int = 64) -> str:
    """The same for a table of numbered pages, in one recursive query."""
    return f"""
      WITH RECURSIVE reach(page, depth) MAX RECURSION LEVEL {max_depth + 2} AS (
        SELECT CAST({start} AS BIGINT), 0 UNION ALL SELECT e.link, depth + 1 FROM reach r JOIN {edges_view} e ON e.page = r.page WHERE depth < {max_depth}
      ) SELECT page, min(depth) AS depth FROM reach GROUP BY page"""


def url_set_version(urls: DataFrame) -> DataFrame:
    """(framework, version_key) of a set of addresses; a changed page with the same address is not seen."""
    return urls.groupBy("framework").agg(F.left(F.sha2(F.array_join(F.array_sort(F.collect_set("url")), "\n"), 256), F.lit(12)).alias("version_key"))


def _fetched(urls: DataFrame, cache: DataFrame, fetch: Fetch, fetchers: int) -> DataFrame:
    """(framework, url, etag, body) of the pages that answer, stored: each is asked for once, on an executor.

    An unchanged page (304) comes from the cache; others than 200, and blank pages, are left out.  Repeated rows of either
    side are one; of several marks of a page the largest one counts, with its body."""
    known = cache.groupBy("framework", "url").agg(F.max(F.struct("etag", "body")).alias("c")).select("framework", "url", "c.etag", "c.body")
    asked = urls.select("framework", "url").distinct().join(known, ["framework", "url"], "left").repartition(fetchers)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for fw, url, etag, body in zip(*(batch.column(c).to_pylist() for c in ("framework", "url", "etag", "body")), strict=True):
                got = fetch(url, etag if body else None)
                if got and got[0] == 304 and body:
                    out.append((fw, url, etag, body))
                elif got and got[0] == 200 and got[2].strip():
                    out.append((fw, url, got[1], got[2]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=["framework", "url", "etag", "body"])

    return write_table(asked.mapInArrow(run, "framework string, url string, etag string, body string"), "pages")


def as_documents(pages: DataFrame, to_text: Callable[[str], str], url_filter: str = "") -> DataFrame:
    """Raw documents of fetched pages; those without text are left out."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [to_text(body) for body in batch.column("body").to_pylist()]
            rows = batch.select(["framework", "url"]).append_column("content", pa.array(texts, pa.string()))
            yield rows.filter(pa.array([bool(t.strip()) for t in texts], pa.bool_()))

    read = pages.select("framework", "url", "body").mapInArrow(run, "framework string, url string, content string")
    return read.select("framework", url_to_filepath(F.col("url"), url_filter).alias("source_file"), "content", F.lit("markdown").alias("content_type"))


def fetch_pages(urls: DataFrame, cache: DataFrame, fetch: Fetch, to_text: Callable[[str], str], url_filter: str = "", fetchers: int = FETCHERS) -> tuple[DataFrame, DataFrame]:
    """(raw documents, cache rows) of ``urls`` (framework, url).

    ``fetch`` runs on the executors, ``fetchers`` at a time; pages with an etag go to the cache as they came.  An address
    that ``urls`` repeats is fetched once, and is a document for each of its rows."""
    pages = _fetched(urls, cache, fetch, fetchers)
    return as_documents(urls.select("framework", "url").join(pages, ["framework", "url"]), to_text, url_filter), pages.where(F.col("etag").isNotNull())


def crawl_pages(start: str, framework: str, cache: DataFrame, fetch: Fetch, max_pages: int = MAX_PAGES, fetchers: int = FETCHERS, max_depth: int = 64) -> DataFrame:
    """(framework, url, etag, body) of the pages below ``start``, breadth first, each fetched once.

    A round fetches the frontier on the executors and joins its links with what was seen; addresses are taken in order,
    and the search ends at ``max_pages`` addresses, the crawl's own limit."""
    spark = cache.sparkSession
    start = start.rstrip("/")
    frontier = spark.createDataFrame([(framework, start)], "framework string, url string")
    seen, count, pages = frontier, 1, None
    for _ in range(max_depth):
        got = _fetched(frontier, cache, fetch, fetchers)
        pages = got if pages is None else pages.unionByName(got)
        found = links(got.select("url", F.col("body").alias("html")), start).select(F.lit(framework).alias("framework"), F.col("link").alias("url")).distinct()
        frontier = write_table(found.join(seen, ["framework", "url"], "left_anti").orderBy("url").limit(max(0, max_pages - count)), "frontier")
        new = frontier.count()
        if not new:
            break
        seen, count = seen.unionByName(frontier), count + new
    return pages


def discover_sitemap(url: str, fetch: Fetch) -> str | None:
    """The address of a site's sitemap: at the host's root, else below the address; only heads are asked for."""
    base = url.rstrip("/").removesuffix("/*").rstrip("/")
    root = "/".join(base.split("/")[:3])
    return next((f"{at}/sitemap.xml" for at in dict.fromkeys((root, base)) if (got := fetch(f"{at}/sitemap.xml", None, "HEAD")) and got[0] == 200), None)


def is_site(n_links: int, typedoc: bool = False, sitemap: bool = False) -> bool:
    """Whether a start page is worth crawling."""
    return n_links >= MIN_LINKS or typedoc or sitemap


def probe(spark: SparkSession, source: dict[str, Any], fetch: Fetch) -> dict[str, Any] | None:
    """What the entry of a website says after a look at its start page: to be crawled, or to be read by its sitemap."""
    url = source["url"]
    got = fetch(url)
    if got and got[0] == 200:
        pages = spark.createDataFrame([(url, got[2])], "url string, html string")
        if is_site(links(pages, url.rstrip("/")).count(), P.TYPEDOC_MARK in got[2]):
            return source | {"url": f"{url.rstrip('/')}/*"}
    sitemap = discover_sitemap(url, fetch)
    return source | {"sitemap": sitemap, "url_filter": source.get("url_filter") or url.rstrip("/")} if is_site(0, sitemap=sitemap is not None) else None


def _sitemap(spark: SparkSession, name: str, fetch: Fetch) -> Callable[[str], DataFrame]:
    def read(url: str) -> DataFrame:
        got = fetch(url)
        return spark.createDataFrame([(name, got[2] if got and got[0] == 200 else "<urlset/>")], "framework string, content string")

    return read


def read(spark: SparkSession, source: dict[str, Any], cache: DataFrame, fetch: Fetch, to_text: Callable[[str], str], content_type: str = "markdown") -> tuple[DataFrame, str, DataFrame]:
    """Raw documents, version and cache rows of a website."""
    name, url = source["name"], source.get("url") or ""
    if url.endswith("/*") and not source.get("sitemap") and not source.get("urls"):
        pages = crawl_pages(url[:-2], name, cache, fetch)
        urls = pages.select("framework", "url")
    else:
        urls = resolve_urls(spark, source, _sitemap(spark, name, fetch), lambda start: None).select(F.lit(name).alias("framework"), "url").distinct()
        pages = _fetched(urls, cache, fetch, FETCHERS)
    docs = as_documents(pages, to_text, source.get("url_filter") or "").withColumn("content_type", F.lit(content_type))
    told = url_set_version(urls).first()
    return docs, told["version_key"] if told else "", pages.where(F.col("etag").isNotNull())


def check_version(spark: SparkSession, source: dict[str, Any], cache: DataFrame, fetch: Fetch) -> str | None:
    """The version of the set of addresses at the other end; a site that is crawled has to be crawled for it."""
    name, url = source["name"], source.get("url") or ""
    if url.endswith("/*") and not source.get("sitemap") and not source.get("urls"):
        urls = crawl_pages(url[:-2], name, cache, fetch).select("framework", "url")
    else:
        urls = resolve_urls(spark, source, _sitemap(spark, name, fetch), lambda start: None).select(F.lit(name).alias("framework"), "url").distinct()
    told = url_set_version(urls).first()
    return told["version_key"] if told else None
