"""The relations of the engine."""

from __future__ import annotations

from pyspark.sql.types import _parse_datatype_string as _schema

UNIT_TYPES = ("api", "example", "concept", "pitfall")

#: What a source gives: one row a file.
RAW_DOCS = "framework string, source_file string, content string, content_type string"
#: A part of a document below a heading.
SECTIONS = "framework string, source_file string, sec_idx int, heading string, level int, heading_hierarchy array<string>, content string"
#: A typed piece of documentation; ``unit_seq`` is the order of insertion.
UNITS = (
    "id string, type string, labels array<string>, framework string, module_path string, heading_hierarchy array<string>, content string, "
    "related_symbols array<string>, definition_symbols array<string>, relevance_decay double, language string, source_file string, unit_seq bigint"
)
SYMBOLS = "symbol string, unit_id string, framework string, is_definition int, sym_seq bigint"
VERSIONS = "framework string, version_key string, ingested_at timestamp, doc_system string"
SOURCES = (
    "name string, type string, language string, repo string, docs_path string, glob string, path string, url string, sitemap string, "
    "url_filter string, urls array<string>, doc_system string, health_exclude boolean"
)
PAGE_CACHE = "framework string, url string, etag string, body string"
#: What the store keeps of each framework.
STORED = {
    "units": UNITS,
    "vectors": "id string, embedding array<float>, framework string, type string, unit_seq bigint, source_file string",
    "pages": PAGE_CACHE,
    "postings": "term string, unit_id string, field int, pos int",
    "lengths": "unit_id string, len bigint",
    "entries": "id string, framework string, type string, unit_seq bigint, relevance_decay double, source_file string",
}
#: Raised when a stored layout is older or newer: it is rebuilt.
SCHEMA_VERSION = 2


def struct(text: str):
    return _schema(text)
