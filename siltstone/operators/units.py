"""From raw documents to units: parse, classify, extract, split, deduplicate.

A document is parsed and extracted where it is read, in one Arrow pass; the only shuffle is the one that keeps the
first unit of each id.  Parsers and extractors are looked up by documentation system and can be registered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.functions import documents as D
from siltstone.functions import html as H
from siltstone.functions import patterns as P

Parser = Callable[[str, str], list[D.Section]]
Extractor = Callable[[list[D.Section], str, str, str | None], list[D.Unit]]

PARSERS: dict[str, Parser] = {
    "generic_md": D.sections_of,
    "mkdocs": D.sections_of,
    "llms_txt": D.sections_of,
    "sphinx": lambda text, path: D.split_directives(D.sections_of(text, path)),
    "rustdoc": H.rustdoc_sections,
    "typedoc": H.typedoc_sections,
}
EXTRACTORS: dict[str, Extractor] = {}
#: Languages of generated reference pages that name none.
DEFAULT_LANGUAGE = {"rustdoc": "rust", "typedoc": "typescript"}


def register_parser(name: str, parser: Parser) -> None:
    PARSERS[name] = parser


def register_extractor(name: str, extractor: Extractor) -> None:
    EXTRACTORS[name] = extractor


def parse_sections(docs: DataFrame, doc_system: str = "generic_md") -> DataFrame:
    """Sections of each raw document, numbered; an unknown system is read as generic Markdown."""
    parser = PARSERS.get(doc_system, PARSERS["generic_md"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = pa.schema([("framework", pa.string()), ("source_file", pa.string()), ("sec_idx", pa.int32()), ("heading", pa.string()), ("level", pa.int32()), ("heading_hierarchy", pa.list_(pa.string())), ("content", pa.string())])
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("framework", "source_file", "content"))
            rows = [(fw, path, k, s.heading, s.level, s.hierarchy, s.content) for fw, path, text in zip(*columns, strict=True) for k, s in enumerate(parser(text or "", path or ""))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], schema=kinds)

    return docs.select("framework", "source_file", "content").mapInArrow(run, schema.SECTIONS)


def extract(docs: DataFrame, doc_system: str = "generic_md", language: str | None = None, carry: tuple[str, ...] = (), split: bool = True) -> DataFrame:
    """Units of each raw document, before deduplication; unit_seq orders them within a document.

    ``language`` is for documents without a ``language`` column; the columns ``carry`` of a document go with its units.
    Without ``split`` long units stay whole; a registered extractor splits as it likes."""
    parser = PARSERS.get(doc_system, PARSERS["generic_md"])
    extractor = EXTRACTORS.get(doc_system) or (lambda sections, fw, path, lang: (D.units_of if split else D.whole_units)(sections, fw, path, lang, doc_system))
    default = DEFAULT_LANGUAGE.get(doc_system)
    frame = docs if "language" in docs.columns else docs.withColumn("language", F.lit(language).cast("string"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ("id", "type", "labels", "framework", "module_path", "heading_hierarchy", "content", "related_symbols", "definition_symbols", "relevance_decay", "language", "source_file", "unit_seq")
        lists = pa.list_(pa.string())
        kinds = (pa.string(), pa.string(), lists, pa.string(), pa.string(), lists, pa.string(), lists, lists, pa.float64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            rows, at = [], []
            columns = [batch.column(c).to_pylist() for c in ("framework", "source_file", "content", "language")]
            for k, (fw, path, text, lang) in enumerate(zip(*columns, strict=True)):
                fw, path = fw or "", path or ""
                for seq, u in enumerate(extractor(parser(text or "", path), fw, path, lang or default)):
                    at.append(k)
                    rows.append((D.unit_id(fw, path, u.hierarchy, u.content), u.labels[0], u.labels, fw, u.module_path, u.hierarchy, u.content, u.related, u.definitions, u.decay, lang or default, path, seq))
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, *(batch.column(c).take(pa.array(at, pa.int64())) for c in carry)], names=[*names, *carry])

    from pyspark.sql import types as T

    fields = [*schema.struct(schema.UNITS).fields, *(frame.schema[c] for c in carry)]
    return frame.select("framework", "source_file", "content", "language", *carry).mapInArrow(run, T.StructType(fields))


def first_by_id(units: DataFrame, *order: str) -> DataFrame:
    """One row of each id: the first by ``order`` (source_file and unit_seq, unless told otherwise)."""
    keys = order or ("source_file", "unit_seq")
    first = F.row_number().over(Window.partitionBy("id").orderBy(*keys))
    return units.withColumn("__n", first).where("__n = 1").drop("__n")


def ingest(docs: DataFrame, doc_system: str = "generic_md", language: str | None = None) -> DataFrame:
    """Raw documents to units, one row an id."""
    return first_by_id(extract(docs, doc_system, language))


def by_label(units: DataFrame) -> DataFrame:
    """A row for each label of a unit, its type set to the label."""
    return units.withColumn("type", F.explode("labels"))


def symbols(units: DataFrame) -> DataFrame:
    """(symbol, unit_id, framework, is_definition, sym_seq): normalised names of units, with whether they are defined there.

    sym_seq orders the names of one file; source_file follows where the units have it."""
    file = [c for c in ("source_file",) if c in units.columns]
    listed = units.select("id", "framework", "definition_symbols", "unit_seq", *file, F.posexplode("related_symbols").alias("pos", "raw"))
    name = F.btrim(F.lower("raw"), F.lit("()"))
    return listed.select(name.alias("symbol"), F.col("id").alias("unit_id"), "framework", F.array_contains("definition_symbols", name).cast("int").alias("is_definition"), (F.col("unit_seq") * 100_000 + F.col("pos")).alias("sym_seq"), *file)


def sections_by_window(docs: DataFrame, split_level: int = P.SPLIT_LEVEL) -> DataFrame:
    """Sections of Markdown whose headings stand on lines of their own, without Python.

    Lines are exploded and regrouped within a document: a section's number is the running count of headings that
    open one, a heading's level is kept in the hierarchy if no heading at or above it came later."""
    line = F.posexplode(F.split("content", "\n")).alias("n", "line")
    lines = docs.select("framework", "source_file", line)
    marks = F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))
    title = F.regexp_extract("line", r"^#{1,6}\s+(.+?)(?:\s+\{.*\})?\s*$", 1)
    w = Window.partitionBy("framework", "source_file").orderBy("n")
    lines = lines.withColumn("level", marks).withColumn("title", F.when(marks > 0, title))
    lines = lines.withColumn("opens", ((F.col("level") > 0) & (F.col("level") <= split_level)).cast("int")).withColumn("sec", F.sum("opens").over(w))
    for k in range(1, split_level + 1):
        lines = lines.withColumn(f"t{k}", F.last(F.when(F.col("level") == k, F.col("title")), ignorenulls=True).over(w)).withColumn(f"p{k}", F.last(F.when(F.col("level") == k, F.col("n")), ignorenulls=True).over(w))
    above = lambda k: F.array_compact(F.array(*[F.when(F.col(f"p{j}") > F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"p{i}"), F.lit(-1)) for i in range(1, j)]), F.col(f"t{j}")) for j in range(1, k)]).cast("array<string>"))
    path = F.lit(None).cast("array<string>")
    for k in range(split_level, 0, -1):
        path = F.when((F.col("opens") == 1) & (F.col("level") == k), F.concat(above(k), F.array("title"))).otherwise(path)
    # Text behind a deeper heading that has no section above it is lost, as in the line-by-line reading.
    lines = lines.withColumn("deep", F.max((F.col("level") > split_level).cast("int")).over(w))
    lines = lines.withColumn("lead", F.max(((F.col("deep") == 0) & (F.col("level") == 0) & F.col("line").rlike(r"\S")).cast("int")).over(w))
    lost = (F.col("sec") == 0) & (F.col("deep") == 1) & (F.col("lead") == 0)
    lines = lines.withColumn("path", path).withColumn("body", F.when((F.col("opens") == 0) & ~lost, F.col("line")))
    parts = lines.groupBy("framework", "source_file", "sec").agg(
        F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("n", "body")))).alias("parts"), F.max(F.when(F.col("opens") == 1, F.col("title"))).alias("heading"), F.max(F.when(F.col("opens") == 1, F.col("level"))).alias("level"), F.max("path").alias("path")
    )
    content = F.regexp_replace(F.array_join("parts.body", "\n"), r"\A\s+|\s+\z", "")
    out = parts.select("framework", "source_file", "sec", F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("path", F.array().cast("array<string>")).alias("heading_hierarchy"), content.alias("content"))
    return out.where((F.col("sec") > 0) | (F.col("content") != ""))


def detect(docs: DataFrame, source_types: DataFrame | None = None, sampled: int = 5, first: int = 10) -> DataFrame:
    """(framework, doc_system) by what the documents show.

    Generated HTML counts if one of the first ``sampled`` HTML files among the first ``first`` files shows it; text by the
    first 2000 characters of every file.  The marks of a file are found where it is read; only ranks and flags move."""
    html, text = F.col("content_type") == "html", F.col("content_type").isin("markdown", "rst")
    head = F.substring("content", 1, 2000)
    flags = docs.select(
        "framework", "source_file", html.alias("html"),
        (html & F.coalesce(_any_of(F.col("content"), P.RUSTDOC_MARKS), F.lit(False))).alias("rustdoc"),
        (html & F.coalesce(F.contains("content", F.lit(P.TYPEDOC_MARK)) | F.contains(F.lower(head), F.lit("typedoc")), F.lit(False))).alias("typedoc"),
        (text & F.coalesce(head.rlike(P.SPHINX), F.lit(False))).alias("sphinx"), (text & F.coalesce(head.rlike(P.MKDOCS), F.lit(False))).alias("mkdocs"),
    )
    early = F.row_number().over(Window.partitionBy("framework").orderBy("source_file"))
    ranked = flags.withColumn("rank", early).where(F.col("rank") <= first).where("html").withColumn("of_html", F.row_number().over(Window.partitionBy("framework").orderBy("rank"))).where(F.col("of_html") <= sampled)
    pages = ranked.groupBy("framework").agg(F.bool_or("rustdoc").alias("rustdoc"), F.bool_or("typedoc").alias("typedoc"))
    found = flags.groupBy("framework").agg(F.bool_or("sphinx").alias("sphinx"), F.bool_or("mkdocs").alias("mkdocs")).join(pages, "framework", "left")
    if source_types is not None:
        found = found.join(source_types.select(F.col("name").alias("framework"), F.col("type").alias("source_type")), "framework", "left")
    else:
        found = found.withColumn("source_type", F.lit(None).cast("string"))
    return found.select("framework", F.when(F.col("source_type") == "llms_txt", "llms_txt").when(F.col("rustdoc"), "rustdoc").when(F.col("typedoc"), "typedoc").when(F.col("sphinx"), "sphinx").when(F.col("mkdocs"), "mkdocs").otherwise("generic_md").alias("doc_system"))


def _any_of(column: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | F.contains(column, F.lit(mark))
    return out


def pre_detect(sources: DataFrame) -> DataFrame:
    """(name, doc_system) from the configuration alone; empty where it does not tell."""
    url = F.coalesce(F.nullif("url", F.lit("")), F.nullif("sitemap", F.lit("")), F.lit(""))
    found = F.when(F.coalesce("doc_system", F.lit("")) != "", F.col("doc_system")).when(F.col("type") == "llms_txt", "llms_txt").when(F.contains(url, F.lit("docs.rs/")), "rustdoc").when(F.contains(F.lower(url), F.lit("typedoc")), "typedoc")
    return sources.select("name", F.coalesce(found, F.lit("")).alias("doc_system"))
