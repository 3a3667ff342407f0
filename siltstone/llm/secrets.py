"""Secret scans through an incremental ledger of blobs, with DataFrame operations alone.

A text is a blob, addressed by its SHA-256.  The ledger has one row for each pair of blob and rule version that was
ever scanned, with the spans found.  A scan takes the blobs whose pair is not there yet, one holder of each, and appends
their rows; what was scanned before is neither scanned nor written again.  The findings are joined back to every path
(document) of the blob, so copies and old versions cost no second scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import let, shared_dir

#: Kinds in the order in which they are listed; (pattern, least length, whether of group 2 only).  Fixed values.  The
#: least lengths of the two kinds that are one run of characters stand in their patterns: a run that is too short is
#: passed over whole either way, as no part of it is longer.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, True),
    "access": (r"AKIA[A-Z0-9]{12,}", 16, False),
    "hex": (r"[0-9a-f]{32,}", 32, False),
}
#: Kinds that this scanner adds.
ADDED = {"pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, False), "ghp": (r"gh[pousr]_[A-Za-z0-9]{36}", 1, False)}
RULES = BASE | ADDED
VERSION = 1
#: A cheap test, true wherever a pattern has a match that is long enough: other texts are not split.
HINTS = {"assign": BASE["assign"][0], "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}", "pem": "-----BEGIN ", "ghp": "gh[pousr]_"}
SPANS = "array<struct<start:bigint,order:int,stop:bigint,kind:string>>"
LEDGER = f"blob string, version int, spans {SPANS}"


def _running(sizes: Column) -> Column:
    """Running sums of an array of longs (a bound one).

    In blocks of about the square root of its length: an array can only be grown by copying it, so one block of n would
    take n * n steps, and n blocks as many."""
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    zero = F.array(F.lit(0).cast("long"))

    def summed(blocks: Column) -> Column:
        sums = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x)), zero, grow)
        return F.flatten(F.zip_with(blocks, F.slice(sums, 1, F.size(blocks)), lambda b, before: F.slice(F.aggregate(b, F.array(before), grow), 2, F.size(b))))

    def blocked(width: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(sizes) - 1) / width).cast("int"))), lambda b: F.slice(sizes, b * width + 1, width)), summed)

    return let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(sizes))).cast("int")), blocked)


def spans_of(text: Column, kind: str, order: int) -> Column:
    """array<struct<start, order, stop, kind>> of one kind: leftmost, non-overlapping, in code points.

    What stands between matches and the matches themselves alternate, so places are running sums of their lengths."""
    pattern, least, second = RULES[kind]
    lengths = lambda group: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x).cast("long"))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    span = lambda stop, size: F.struct((stop - size).alias("start"), F.lit(order).alias("order"), stop.alias("stop"), F.lit(kind).alias("kind"))

    def placed(sizes: Column) -> Column:
        stops = let(F.zip_with(F.slice(gaps, 1, F.size(sizes)), sizes, lambda g, s: g + s), _running)
        spans = F.zip_with(stops, sizes, span)
        if not second:
            return F.filter(spans, lambda x: x["stop"] - x["start"] >= least)
        judged = F.zip_with(spans, lengths(2), lambda x, n: F.struct(x.alias("span"), n.alias("n")))
        return F.transform(F.filter(judged, lambda r: r["n"] >= least), lambda r: r["span"])

    return F.when(text.rlike(HINTS[kind]), let(lengths(0), placed)).otherwise(F.array().cast(SPANS))


def scan(blobs: DataFrame, version: int = VERSION) -> DataFrame:
    """(blob, version, spans) of each row of ``blobs`` (blob, text); spans are sorted by start, then kind as listed."""
    found = F.concat(*[spans_of(F.col("text"), kind, k) for k, kind in enumerate(RULES)])
    return blobs.select("blob", F.lit(version).alias("version"), F.array_sort(found).alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).select("doc_id", F.sha2("text", 256).alias("blob"), "text")


class Ledger:
    """A folder of Parquet files to which each scan appends its rows."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self) -> DataFrame:
        """blob, version, spans; one row a pair."""
        if not self._fs.exists(self._path):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def update(self, docs: DataFrame, version: int = VERSION) -> Ledger:
        """Scans what ``docs`` has and the ledger has not, and appends it; a task that runs again writes its rows once."""
        scan(unseen(docs, self.read(), version), version).write.mode("append").parquet(self.path)
        return self

    def drop(self) -> None:
        self._fs.delete(self._path, True)


def unseen(docs: DataFrame, ledger: DataFrame | None, version: int = VERSION) -> DataFrame:
    """(blob, text) of the blobs of ``docs`` without a row of ``version`` in the ledger, each once.

    The holder is found on ids alone (reduced before the shuffle); texts are dealt by id and blob, which are spread
    however often a text repeats, and rows that repeat both are one before they are dealt."""
    every = _keyed(docs)
    paths = every.groupBy("blob", "doc_id").agg(F.any_value("text").alias("text"))
    holders = every.groupBy("blob").agg(F.min("doc_id").alias("holder"))
    if ledger is not None:
        holders = holders.join(ledger.where(F.col("version") == version).select("blob"), "blob", "left_anti")
    held = holders.withColumnRenamed("blob", "__blob")
    return paths.join(held, (F.col("blob") == F.col("__blob")) & F.col("doc_id").eqNullSafe(F.col("holder")), "left_semi").select("blob", "text")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def findings(docs: DataFrame, ledger: DataFrame, version: int = VERSION) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its blob's counts and spans.

    Null and empty texts are the empty blob, without spans; null ids and repeated rows stay as they are; texts of any
    length are read whole; extra columns are left out under whatever name; an empty table gives no rows."""
    seen = ledger.where((F.col("version") == version) & (F.size("spans") > 0)).select("blob", "spans")
    paths = _keyed(docs).select("doc_id", "blob")
    rows = paths.join(seen, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select("doc_id", *(count(kind).alias(f"n_{kind}") for kind in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The findings of every document, from a ledger that the documents reach in two commits, one half in each.

    The second commit scans only the blobs that the first has not left in the ledger; every document, of whichever
    commit, is then answered from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    later = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1, F.lit(False))
    return findings(docs, Ledger(spark).update(docs.where(~later)).update(docs.where(later)).read())


def _oracle() -> str:
    parts, columns = [], []
    for order, (kind, (pattern, least, second)) in enumerate(RULES.items()):
        pattern = {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}.get(kind, pattern)  # as they are asked for
        quoted = pattern.replace("'", "''")
        parts.append(f"""
  SELECT rid, {order} AS o, '{kind}' AS kind, start, start + size AS stop FROM (
    SELECT rid, unnest(list_transform(range(1, len(whole) + 1), lambda k: list_sum(list_transform(gaps[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(whole[1:k-1], lambda x: len(x))), 0))) AS start,
           unnest(list_transform(whole, lambda x: len(x))) AS size, unnest(list_transform(judged, lambda x: len(x))) AS judged
    FROM (SELECT rid, regexp_extract_all(text, '{quoted}', 0) AS whole, regexp_extract_all(text, '{quoted}', {2 if second else 0}) AS judged, regexp_split_to_array(text, '{quoted}') AS gaps FROM d WHERE regexp_matches(text, '{HINTS[kind].replace("'", "''")}'))
  ) WHERE judged >= {least}""")
        if kind in BASE:
            columns.append(f"coalesce(count(*) FILTER (WHERE kind = '{kind}'), 0) AS n_{kind}")
    item = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents), s AS ({" UNION ALL ".join(parts)}
), g AS (
  SELECT rid, {", ".join(columns)}, string_agg({item}, ',' ORDER BY start, o) FILTER (WHERE o < {len(BASE)}) AS base, string_agg({item}, ',' ORDER BY start, o) AS spans FROM s GROUP BY rid
)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""


OP10_SQL = _oracle()
