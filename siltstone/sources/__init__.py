"""Where documents come from: what kind a source is, and a reader and a version check for each kind."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schema

from . import config, github, llms_txt, local, website
from .config import UnsupportedSource
from .http import Fetch, http_fetch

#: Given the session, a source's entry (``cache``: its cached pages), and a fetch: raw documents, the version and, where
#: pages were fetched, what to cache of them.
Reader = Callable[..., tuple]
#: Given the same: the version at the other end, None if it does not tell.
Checker = Callable[..., "str | None"]
#: Versions that are checked at once.
CHECKERS = 8


def _cache(spark: SparkSession, source: dict[str, Any]) -> DataFrame:
    return source["cache"] if source.get("cache") is not None else spark.createDataFrame([], schema.PAGE_CACHE)


def _read_website(spark: SparkSession, source: dict[str, Any], fetch: Fetch = http_fetch) -> tuple[DataFrame, str, DataFrame]:
    from siltstone.functions.html import html_to_markdown

    html = source["doc_system"] in ("rustdoc", "typedoc")
    return website.read(spark, source, _cache(spark, source), fetch, (lambda h: h) if html else html_to_markdown, "html" if html else "markdown")


READERS: dict[str, Reader] = {
    "local": lambda spark, source, fetch=http_fetch: (local.read(spark, source["name"], source["path"]), local.fingerprint(spark, source["path"])),
    "github": lambda spark, source, fetch=http_fetch: github.read(spark, source),
    "llms_txt": lambda spark, source, fetch=http_fetch: llms_txt.read(spark, source, fetch),
    "website": _read_website,
}
CHECKERS_BY_KIND: dict[str, Checker] = {
    "local": lambda spark, source, fetch=http_fetch: local.fingerprint(spark, source["path"]),
    "github": lambda spark, source, fetch=http_fetch: github.check_version(source, fetch),
    "llms_txt": lambda spark, source, fetch=http_fetch: llms_txt.check_version(spark, source, fetch),
    "website": lambda spark, source, fetch=http_fetch: website.check_version(spark, source, _cache(spark, source), fetch),
}


def register_reader(kind: str, reader: Reader, checker: Checker | None = None) -> None:
    READERS[kind] = reader
    if checker is not None:
        CHECKERS_BY_KIND[kind] = checker


def reader(kind: str) -> Reader:
    if kind not in READERS:
        raise UnsupportedSource(f"no reader for sources of type {kind!r}; there are {', '.join(sorted(READERS))}")
    return READERS[kind]


def resolve(spark: SparkSession, source: dict[str, Any], fetch: Fetch = http_fetch) -> tuple[str, dict[str, Any]]:
    """The kind of a source and its entry, completed.

    What the entry does not tell the network does: a repository by its address, a site that offers one text, a site worth
    crawling or with a sitemap, in that order."""
    told = config.resolve(config.table(spark, {"sources": {source["name"]: source}})).first()
    entry = source | {"url": told["url"]}
    if told["kind"] != "auto":
        return told["kind"], (github.located(entry) or entry) if told["kind"] == "github" else entry
    if entry["url"]:
        if (found := github.located(entry)) is not None:
            return "github", found
        if (text := llms_txt.probe(spark, entry, fetch)) is not None:
            return "llms_txt", entry | {"url": text}
        if (site := website.probe(spark, entry, fetch)) is not None:
            return "website", site
    raise UnsupportedSource(f"{source['name']}: nothing at {entry['url']!r} can be read")


def read(spark: SparkSession, kind: str, entry: dict[str, Any], fetch: Fetch = http_fetch) -> tuple:
    """(raw documents, version, pages to cache or None) of a resolved source."""
    got = reader(kind)(spark, entry) if fetch is http_fetch else reader(kind)(spark, entry, fetch)
    return got if len(got) == 3 else (*got, None)


def remote_versions(spark: SparkSession, sources: dict[str, dict[str, Any]], fetch: Fetch = http_fetch) -> DataFrame:
    """(framework, version_key) at the other end of each source, several at once; a source that can't be told has null."""

    def one(entry: dict[str, Any]) -> str | None:
        try:
            kind, found = resolve(spark, entry, fetch)
            checker = CHECKERS_BY_KIND.get(kind)
            return checker(spark, found, fetch) if checker else None
        except (UnsupportedSource, OSError):
            return None

    with ThreadPoolExecutor(CHECKERS) as pool:
        versions = list(pool.map(one, sources.values()))
    return spark.createDataFrame(list(zip(sources, versions, strict=True)), "framework string, version_key string").select("framework", F.col("version_key"))
