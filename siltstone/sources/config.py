"""Sources from configuration: a table of them, and which kind each is."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schema


class UnsupportedSource(ValueError):
    """No kind of source fits the configuration."""


#: What an entry is where it says nothing.
DEFAULTS: dict[str, Any] = {"type": "auto", "language": "", "repo": "", "docs_path": "", "glob": "**/*.md", "path": "", "url": "", "sitemap": "", "url_filter": "", "urls": [], "doc_system": "", "health_exclude": False}
APP_DEFAULTS: dict[str, Any] = {"embedding_model": "", "data_dir": "~/.siltstone", "host": "127.0.0.1", "port": 8787, "min_health_score": 80, "ingest_workers": 0}


def app_config(raw: dict) -> dict[str, Any]:
    """Settings with defaults, ~ expanded, and the sources as entries."""
    out = {k: raw.get(k, v) for k, v in APP_DEFAULTS.items()}
    out["data_dir"] = os.path.expanduser(out["data_dir"])
    out["sources"] = {name: source(name, entry or {}) for name, entry in (raw.get("sources") or {}).items()}
    return out


def source(name: str, entry: dict) -> dict[str, Any]:
    found = {"name": name} | {k: entry.get(k, v) for k, v in DEFAULTS.items()}
    if isinstance(found["urls"], str):
        found["urls"] = json_list(found["urls"])
    return found


def json_list(text: Any) -> list[str]:
    """A list, or a JSON list's items; anything else is empty."""
    if isinstance(text, list):
        return text
    try:
        value = json.loads(text)
    except (TypeError, ValueError):
        return []
    return value if isinstance(value, list) else []


def load(path: str) -> dict[str, Any]:
    """A JSON file, or a YAML one where a YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        return app_config(json.loads(text))
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise UnsupportedSource(f"{path} is not JSON, and no YAML reader is installed") from e
        return app_config(yaml.safe_load(text) or {})


def table(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    names = schema.struct(schema.SOURCES).fieldNames()
    return spark.createDataFrame([tuple(s[n] for n in names) for s in config["sources"].values()], schema.SOURCES)


def resolve(sources: DataFrame) -> DataFrame:
    """Adds ``kind``: the type that is said, or follows from the other fields; ``auto`` where only the network could tell.

    A start URL of a website to crawl gets its /* ."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    web = given("url_filter") | given("sitemap") | (F.coalesce(F.size("urls"), F.lit(0)) > 0)
    github = given("repo") | F.coalesce(F.col("url").rlike(r"^https?://(?:www\.)?github\.com/[^/]+/[^/]+"), F.lit(False))
    llms = F.coalesce(F.col("url").rlike(r"/llms(?:-full)?\.txt$"), F.lit(False))
    kind = F.when(F.col("type") != "auto", F.col("type")).when(web, "website").when(given("path"), "local").when(github, "github").when(llms, "llms_txt").otherwise("auto")
    crawl = (F.col("type") == "auto") & web & given("url") & ~given("sitemap") & (F.coalesce(F.size("urls"), F.lit(0)) == 0) & ~F.col("url").endswith("/*")
    return sources.withColumn("kind", kind).withColumn("url", F.when(crawl, F.concat(F.regexp_replace("url", "/+$", ""), F.lit("/*"))).otherwise(F.col("url")))
