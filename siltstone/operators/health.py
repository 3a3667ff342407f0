"""Quality of each source: one conditional aggregation, then arithmetic; the gate; status and freshness reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.columns import grade, percent

MIN_SCORE = 80


def metrics(units: DataFrame, symbols: DataFrame | None = None, versions: DataFrame | None = None) -> DataFrame:
    """Counts by framework.  Without ``symbols``, or for frameworks that have none, symbol counts are zero."""
    kind = lambda t: F.count_if(F.col("type") == t).alias(f"{t}_count")
    template = F.col("content").like("%{{%}}%") | F.col("content").like("%{%- %-%}%")
    out = units.groupBy("framework").agg(
        F.count("*").alias("total_units"), *(kind(t) for t in ("api", "example", "concept", "pitfall")), F.count_if(F.length("content") < 50).alias("stub_count"), F.avg(F.length("content")).alias("avg_content_len"),
        F.count_if(F.col("relevance_decay") < 1.0).alias("decayed_units"), F.count_if(template).alias("template_stub_count"),
    )
    if symbols is not None:
        counted = symbols.groupBy("framework").agg(F.count("*").alias("total_symbols"), F.sum("is_definition").alias("definition_symbols"))
        out = out.join(counted, "framework", "left")
    else:
        out = out.withColumns({"total_symbols": F.lit(0), "definition_symbols": F.lit(0)})
    if versions is not None:
        out = out.join(versions.select("framework", "doc_system"), "framework", "left")
    else:
        out = out.withColumn("doc_system", F.lit(""))
    return out.withColumns({"total_symbols": F.coalesce("total_symbols", F.lit(0)).cast("long"), "definition_symbols": F.coalesce("definition_symbols", F.lit(0)).cast("long"), "doc_system": F.coalesce("doc_system", F.lit("")), "avg_content_len": F.coalesce("avg_content_len", F.lit(0.0))})


def _rules() -> list[tuple[Column, int, Column | None]]:
    """(condition, points taken off, signal), in the order in which signals are listed.  Fixed values."""
    c = F.col
    ratio = lambda a: c(a) / c("total_units")
    says = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    none_api, none_example = c("api_count") == 0, c("example_count") == 0
    most = F.greatest(*(c(f"{t}_count") for t in ("api", "example", "concept", "pitfall")))
    share, many = most / c("total_units"), c("total_units") > 20
    top = F.when(most == c("api_count"), "api").when(most == c("example_count"), "example").when(most == c("concept_count"), "concept").otherwise("pitfall")
    stubs, templates, decayed = ratio("stub_count"), ratio("template_stub_count"), ratio("decayed_units")
    defined = F.when(c("total_symbols") > 0, c("definition_symbols") / c("total_symbols")).otherwise(0.0)
    length = F.bround(c("avg_content_len")).cast("long").cast("string")
    diversity = sum((F.when(c(f"{t}_count") > 0, 1).otherwise(0) for t in ("api", "example", "concept", "pitfall")), F.lit(0))
    return [
        (none_api & none_example, 25, says("no api or example units")),
        (none_api & ~none_example, 12, says("no api units")),
        (~none_api & none_example, 8, says("no example units")),
        (diversity >= 3, 0, says(diversity.cast("string"), "/4 type diversity")),
        (many & (share > 0.95), 20, says(percent(share), " units are ", top, " (mono-type)")),
        (many & (share > 0.90) & (share <= 0.95), 8, says(percent(share), " single-type dominance")),
        (stubs > 0.5, 20, says(percent(stubs), " stub units (<50 chars)")),
        ((stubs > 0.3) & (stubs <= 0.5), 10, says(percent(stubs), " stub units")),
        ((c("total_symbols") > 10) & (defined == 0), 20, says("no definition sites for symbol lookup")),
        ((c("total_symbols") > 10) & (defined > 0) & (defined < 0.1), 10, says("low definition coverage (", percent(defined), ")")),
        ((c("total_symbols") > 10) & (defined >= 0.1), 0, says(percent(defined), " definition coverage")),
        (c("total_symbols") == 0, 10, says("no symbols extracted")),
        (c("avg_content_len") < 100, 15, says("avg content ", length, " chars (very short)")),
        ((c("avg_content_len") >= 100) & (c("avg_content_len") < 300), 5, says("avg content ", length, " chars (short)")),
        (templates > 0.3, 15, says(percent(templates), " units have unresolved template placeholders")),
        ((templates > 0.1) & (templates <= 0.3), 8, says(percent(templates), " template placeholders")),
        (decayed > 0.5, 10, says(percent(decayed), " units are changelog/release notes")),
        ((decayed > 0.3) & (decayed <= 0.5), 5, says(percent(decayed), " changelog/release notes")),
        (c("doc_system") == "generic_md", 5, says("generic parser (no doc-system detected)")),
        (c("doc_system") != "generic_md", 0, says("parser: ", c("doc_system"))),
    ]


def health(units: DataFrame, symbols: DataFrame | None = None, versions: DataFrame | None = None, frameworks: DataFrame | None = None) -> DataFrame:
    """Metrics, score (0 to 100), grade and signals of each framework.

    ``frameworks`` (framework) adds those without units, which score 0."""
    rules = _rules()
    points = sum((F.when(cond, F.lit(minus)).otherwise(0) for cond, minus, _ in rules if minus), F.lit(0))
    signals = F.array_compact(F.array(*(F.when(cond, signal) for cond, _, signal in rules)))
    out = metrics(units, symbols, versions)
    out = out.withColumn("score", F.greatest(F.lit(0), F.lit(100) - points)).withColumn("signals", signals)
    if frameworks is not None:
        out = frameworks.select("framework").distinct().join(out, "framework", "left")
        none = F.col("total_units").isNull()
        out = out.withColumn("score", F.when(none, 0).otherwise(F.col("score"))).withColumn("signals", F.when(none, F.array(F.lit("no units ingested"))).otherwise(F.col("signals"))).withColumn("total_units", F.coalesce("total_units", F.lit(0)).cast("long"))
    return out.withColumn("grade", grade(F.col("score")))


def gate(scores: DataFrame, sources: DataFrame | None = None, minimum: int = MIN_SCORE) -> DataFrame:
    """(framework, score, accepted): a score below ``minimum`` (if that is above 0) rejects, unless the source is excluded."""
    out = scores
    if sources is not None:
        out = out.join(sources.select(F.col("name").alias("framework"), "health_exclude"), "framework", "left")
    else:
        out = out.withColumn("health_exclude", F.lit(False))
    return out.select("framework", "score", (~_rejected(minimum)).alias("accepted"))


def _rejected(minimum: int) -> Column:
    return (F.col("score") < minimum) & F.lit(minimum > 0) & ~F.coalesce("health_exclude", F.lit(False))


def publishable(units: DataFrame, gated: DataFrame) -> DataFrame:
    """Units of accepted frameworks: rejected ones never reach the store."""
    return units.join(gated.where("NOT accepted").select("framework"), "framework", "left_anti")


def stats(units: DataFrame) -> DataFrame:
    """(framework, type, n): counts, with the framework's total where type is null and the whole where both are."""
    return units.rollup("framework", "type").agg(F.count("*").alias("n"))


def stats_wide(units: DataFrame) -> DataFrame:
    types = ["api", "example", "concept", "pitfall"]
    return units.groupBy("framework").pivot("type", types).count().na.fill(0, types).withColumn("total", sum((F.col(t) for t in types), F.lit(0)).cast("long"))


def freshness(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(framework, state): what an update has to do, from the versions (framework, version_key) here and at the source.

    outdated: the keys differ, or neither side has one; skipped: the source tells none though we have one; else current."""
    here, there = local.select("framework", F.col("version_key").alias("local_key")), remote.select("framework", F.col("version_key").alias("remote_key"))
    a, b = F.nullif(F.col("local_key"), F.lit("")), F.nullif(F.col("remote_key"), F.lit(""))
    state = F.when(b.isNull() & a.isNotNull(), "skipped").when(a.isNull() | (a != b), "outdated").otherwise("current")
    return here.join(there, "framework", "full_outer").select("framework", "local_key", "remote_key", state.alias("state"))


def status(scores: DataFrame, versions: DataFrame, fresh: DataFrame, sources: DataFrame | None = None, minimum: int = MIN_SCORE) -> DataFrame:
    """One row a framework: units, score, grade, version, state, and whether it is below the gate.

    The gate's answer is a column of the scores themselves, which are computed once."""
    out = scores.select("framework", "total_units", "score", "grade").join(versions.select("framework", "version_key", "doc_system"), "framework", "left").join(fresh.select("framework", "state"), "framework", "left")
    out = out.join(sources.select(F.col("name").alias("framework"), "health_exclude"), "framework", "left") if sources is not None else out.withColumn("health_exclude", F.lit(False))
    return out.withColumns({"below_minimum": _rejected(minimum), "state": F.coalesce("state", F.lit("unknown"))}).drop("health_exclude")


def summary(report: DataFrame) -> DataFrame:
    """(n_frameworks, total_units, n_outdated, below): the report's totals."""
    return report.agg(F.count("*").alias("n_frameworks"), F.coalesce(F.sum("total_units"), F.lit(0)).alias("total_units"), F.count_if(F.col("state") == "outdated").alias("n_outdated"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("below_minimum"), F.col("framework")))), ",").alias("below"))
