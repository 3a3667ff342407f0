"""The public calls: ingest, search, look up, browse, bundle, and keep a library of documentation in order."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import sources
from siltstone.functions.embed import Embedder, embed, hashing_embedder
from siltstone.operators import health, search
from siltstone.operators.store import Store
from siltstone.operators.units import detect, ingest, pre_detect, symbols
from siltstone.reporter import PlainReporter
from siltstone.sources import config as C
from siltstone.sources.http import Fetch, http_fetch


class Library:
    """A store, its configuration, and the calls on it.  Results are DataFrames; ``to_json`` gives lines."""

    def __init__(self, spark: SparkSession, path: str, config: dict[str, Any] | None = None, embedder: Embedder = hashing_embedder, reporter: PlainReporter | None = None, fetch: Fetch = http_fetch):
        self.spark, self.store, self.config = spark, Store(spark, path), config or C.app_config({})
        self.embedder, self.reporter, self.fetch = embedder, reporter or PlainReporter(), fetch

    # -- keeping it in order

    def ingest(self, framework: str | None = None, rebuild: bool = False) -> dict[str, dict[str, Any]]:
        """Reads, parses, checks and publishes each source (or one).  What the gate rejects is never published."""
        wanted = {n: s for n, s in self.config["sources"].items() if framework in (None, n)}
        if framework is not None and not wanted:
            raise KeyError(f"no source is called {framework!r}")
        return {name: self._ingest_one(name, source, rebuild) for name, source in wanted.items()}

    def _ingest_one(self, name: str, source: dict[str, Any], rebuild: bool) -> dict[str, Any]:
        kind, entry = sources.resolve(self.spark, source, self.fetch)
        told = pre_detect(C.table(self.spark, {"sources": {name: entry}}).withColumn("type", F.lit(kind))).first()["doc_system"]
        self.reporter.update(name, "reading")
        cache = self.store.read("pages", name)
        docs, version, pages = sources.read(self.spark, kind, entry | {"doc_system": told, "cache": cache}, self.fetch)
        found = told or (detect(docs).first() or {"doc_system": "generic_md"})["doc_system"]
        units = ingest(docs, found, source["language"] or None).persist()
        versions = self.spark.createDataFrame([(name, found)], "framework string, doc_system string")
        score = health.health(units, symbols(units), versions, versions).select("framework", "score")
        accepted = health.gate(score, C.table(self.spark, {"sources": {name: entry}}), self.config["min_health_score"]).first()
        result = {"units": units.count(), "doc_system": found, "version": version, "score": accepted["score"], "accepted": accepted["accepted"]}
        if accepted["accepted"]:
            put = self.store.replace if rebuild else (lambda _, *args: self.store.insert(*args))
            put(name, units, lambda u: embed(u, self.embedder), (version, found))
            if pages is not None:
                self.store.put_pages(name, pages)
        self.reporter.update(name, "done" if accepted["accepted"] else "failed", units=result["units"], score=result["score"])
        units.unpersist()
        return result

    def remote(self) -> DataFrame:
        """(framework, version_key) at the other end of each source."""
        return sources.remote_versions(self.spark, {name: s | {"cache": self.store.read("pages", name)} for name, s in self.config["sources"].items()}, self.fetch)

    def update(self, remote: DataFrame | None = None) -> list[str]:
        """Ingests anew what is outdated against ``remote`` (framework, version_key), which is asked for if it is not
        given; which sources those were."""
        state = health.freshness(self.store.versions(), self.remote() if remote is None else remote).where("state = 'outdated'")
        names = [r["framework"] for r in state.select("framework").orderBy("framework").collect() if r["framework"] in self.config["sources"]]
        for name in names:
            self.ingest(name, rebuild=True)
        return names

    def remove(self, framework: str) -> int:
        return self.store.clear_framework(framework)

    def nuke(self, confirmed: bool = False) -> None:
        if not confirmed:
            raise ValueError("nuke removes everything; call it with confirmed=True")
        self.store.clear_all()

    # -- reading

    def search(self, query: str, framework: str | None = None, unit_type: str | None = None, top_k: int = 10) -> DataFrame:
        search.check_top_k(top_k)
        found = search.hybrid_search(self.store.index(), self.store.read("vectors"), query, self.embedder([query])[0], top_k, framework, unit_type)
        return found.drop("type").join(self.store.units(), "id").orderBy("rank")

    def lookup(self, symbol: str, framework: str | None = None, include_related: bool = True, include_examples: bool = True) -> DataFrame:
        found = search.lookup(self.store.units(), self.store.symbols(), symbol, framework, include_related, include_examples)
        return found.join(self.store.units(), "id")

    def browse(self, framework: str, module: str | None = None) -> DataFrame:
        if module:
            return search.browse_units(self.store.units(), framework, module)
        return search.browse_modules(self.store.units(), self.store.symbols(), framework).orderBy("module_path")

    def bundle(self, query: str, framework: str | None = None, top_k: int = 5) -> DataFrame:
        return search.bundle(self.store.index(), self.store.read("vectors"), query, self.embedder([query])[0], top_k, framework)

    def query(self, words: str, framework: str | None = None, top_k: int = 5) -> DataFrame:
        return search.smart(self.store.index(), self.store.units(), self.store.symbols(), self.store.read("vectors"), words, self.embedder([words])[0], top_k, framework)

    def stats(self) -> DataFrame:
        return health.stats(self.store.units())

    def health(self) -> DataFrame:
        return health.health(self.store.units(), self.store.symbols(), self.store.versions())

    def usage(self) -> DataFrame:
        return self.store.usage()

    def status(self, remote: DataFrame | None = None) -> DataFrame:
        """One row a framework; without ``remote`` the sources are not asked, and no state is known."""
        here = self.store.versions()
        fresh = health.freshness(here, remote) if remote is not None else here.select("framework", F.lit("unknown").alias("state"))
        return health.status(self.health(), here, fresh, C.table(self.spark, self.config), self.config["min_health_score"])


def to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))

