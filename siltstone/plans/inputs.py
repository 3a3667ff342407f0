"""The tables' columns in the roles that the queries need, in Spark and in SQL.

Documents have no Markdown structure, so parsing and classification run on a derived text: line i of document d becomes
a block of kind (d + i) mod 8, and blocks are joined by blank lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.columns import ACCENTS, PLAIN, module_path, relevance_decay

TYPES = ("api", "example", "concept", "pitfall")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as a unit: its source is the framework, its type follows from its number."""
    docs = table(spark, sf_dir, "documents")
    number = F.col("doc_id")
    kind = F.element_at(F.array(*(F.lit(t) for t in TYPES)), (number % 4 + 1).cast("int"))
    part = F.when(number % 10 == 0, "changelog").otherwise("guide")
    path = F.concat(F.lit("docs/"), F.coalesce("lang", F.lit("xx")), F.lit("/"), F.lpad((number % 100).cast("string"), 2, "0"), F.lit("-"), part, F.lit("/"), number.cast("string"), F.lit(".md"))
    rows = docs.select(number.alias("id"), kind.alias("type"), F.col("source").alias("framework"), path.alias("source_file"), F.array(F.coalesce("lang", F.lit("xx")), part).alias("heading_hierarchy"), F.coalesce("text", F.lit("")).alias("content"), F.col("lang").alias("language"), number.alias("unit_seq"))
    return rows.withColumns({"module_path": module_path(F.col("framework"), F.col("source_file")), "relevance_decay": relevance_decay(F.col("source_file"))})


UNITS_SQL = """u0 AS (
  SELECT doc_id AS id, ['api', 'example', 'concept', 'pitfall'][CAST(doc_id % 4 + 1 AS INT)] AS type, source AS framework, CASE WHEN doc_id % 10 = 0 THEN 'changelog' ELSE 'guide' END AS part,
         coalesce(lang, 'xx') AS lg, coalesce(text, '') AS content, doc_id AS unit_seq FROM documents
), u AS (
  SELECT *, 'docs/' || lg || '/' || lpad(CAST(id % 100 AS VARCHAR), 2, '0') || '-' || part || '/' || id || '.md' AS source_file, framework || '.' || lg || '.' || part || '.' || id AS module_path,
         CASE WHEN part = 'changelog' THEN 0.3 ELSE 1.0 END AS relevance_decay FROM u0
)"""


def _word(line: Column) -> Column:
    found = F.regexp_extract(line, "[A-Za-z]{3,}", 0)
    return F.when(found == "", "item").otherwise(found)


def _title(line: Column) -> Column:
    cut = F.regexp_replace(F.substring(line, 1, 40), r"^\s+|\s+$", "")
    return F.when(cut == "", "item").otherwise(cut)


#: Definitions of ``w`` by language, for blocks of kind 3.
DEFINITIONS = {
    "python": "def {w}(x):\n    return x", "rust": "pub fn {w}(x: u8) -> u8 {{\n    x\n}}", "js": "export function {w}(x) {{\n    return x\n}}", "go": "func {w}(x int) int {{\n    return x\n}}",
    "c": "int {w}(int x) {{\n    return x;\n}}", "java": "public class {w} {{\n}}", "csharp": "public struct {w} {{\n}}",
}


def block(doc_id: Column, i: Column, line: Column, language: str = "python") -> Column:
    w, k = _word(line), (doc_id + i) % 8
    before, after = DEFINITIONS[language].format(w="\x00").split("\x00")
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return (
        F.when(k == 0, text("# ", _title(line))).when(k == 1, text("## `", w, "`")).when(k == 2, text("!!! warning\n    ", line)).when(k == 3, text(f"```{language}\n", before, w, after, "\n```"))
        .when(k == 4, text(".. autoclass:: pkg.", w)).when(k == 5, text("/// tip\n", line, "\n///")).when(k == 6, text("### ", _title(line))).otherwise(line)
    )


def markdown(spark: SparkSession, sf_dir: str, language: str = "python") -> DataFrame:
    """doc_id, framework, source_file, content (Markdown), content_type."""
    docs = table(spark, sf_dir, "documents")
    blocks = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line, i: block(F.col("doc_id"), i, line, language))
    return docs.select("doc_id", F.col("source").alias("framework"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_file"), F.array_join(blocks, "\n\n").alias("content"), F.lit("markdown").alias("content_type"))


#: lines: doc_id, framework, i (from 0), line, k, w, t (title); blocks: with the block b; md: the joined text.
MARKDOWN_SQL = r"""lines AS (
  SELECT doc_id, framework, i, line, (doc_id + i) % 8 AS k, coalesce(nullif(regexp_extract(line, '[A-Za-z]{3,}', 0), ''), 'item') AS w,
         coalesce(nullif(regexp_replace(left(line, 40), '^\s+|\s+$', '', 'g'), ''), 'item') AS t
  FROM (SELECT doc_id, source AS framework, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), blocks AS (
  SELECT *, CASE k WHEN 0 THEN '# ' || t WHEN 1 THEN '## `' || w || '`' WHEN 2 THEN '!!! warning' || chr(10) || '    ' || line WHEN 3 THEN '```python' || chr(10) || 'def ' || w || '(x):' || chr(10) || '    return x' || chr(10) || '```'
    WHEN 4 THEN '.. autoclass:: pkg.' || w WHEN 5 THEN '/// tip' || chr(10) || line || chr(10) || '///' WHEN 6 THEN '### ' || t ELSE line END AS b FROM lines
), md AS (
  SELECT doc_id, framework, string_agg(b, chr(10) || chr(10) ORDER BY i) AS content FROM blocks GROUP BY doc_id, framework
)"""

#: What the parser makes of the blocks: a section for each heading of kinds 0 and 1, kind 6 goes to the one above.
SECTIONS_SQL = MARKDOWN_SQL + r""", marked AS (
  SELECT *, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 6 THEN 3 ELSE 0 END AS lv, sum(CASE WHEN k IN (0, 1) THEN 1 ELSE 0 END) OVER w1 AS sec, sum(CASE WHEN k IN (0, 1, 6) THEN 1 ELSE 0 END) OVER w1 AS part,
         last_value(CASE WHEN k = 0 THEN t END IGNORE NULLS) OVER w1 AS top
  FROM blocks WINDOW w1 AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)
), parts AS (
  SELECT doc_id, framework, sec, part, min(i) AS first_i, bool_or(lv = 3) AS deep, coalesce(regexp_replace(string_agg(b, chr(10) || chr(10) ORDER BY i) FILTER (WHERE lv <> 1 AND lv <> 2), '^\s+|\s+$', '', 'g'), '') AS body,
         max(CASE WHEN lv IN (1, 2) THEN lv END) AS level, max(CASE WHEN lv = 1 THEN t WHEN lv = 2 THEN '`' || w || '`' END) AS heading, max(CASE WHEN lv = 2 THEN top END) AS above
  FROM marked GROUP BY doc_id, framework, sec, part
), lead AS (
  SELECT doc_id, bool_or(part = 0 AND body <> '') AS has_lead FROM parts WHERE sec = 0 GROUP BY doc_id
), sections AS (
  SELECT p.doc_id, framework, sec, coalesce(max(heading), '') AS heading, coalesce(max(level), 0) AS level, max(above) AS above, string_agg(body, chr(10) || chr(10) ORDER BY part) AS content
  FROM parts p LEFT JOIN lead l ON p.doc_id = l.doc_id WHERE sec > 0 OR has_lead GROUP BY p.doc_id, framework, sec
)"""

#: The words of a text; :func:`siltstone.functions.columns.tokens` in SQL.
TOKENS_SQL = f"regexp_extract_all(translate(lower({{}}), '{ACCENTS}', '{PLAIN}'), '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"


def tokens_sql(text: str) -> str:
    return TOKENS_SQL.replace("{{", "{").replace("}}", "}").replace("{}", text)
