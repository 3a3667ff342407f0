"""Sites that offer their documentation as one text."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.functions.columns import content_hash, http_version
from siltstone.operators.units import extract

from .http import Fetch

#: What a text must give to be accepted.
MIN_UNITS, MIN_MEAN = 10, 200
PROBED = schema.RAW_DOCS + ", ord int, status int, url string"


def candidates(base: Column) -> Column:
    """Addresses to try, in order: below the base, then at the host's root."""
    bare = F.regexp_replace(base, "/+$", "")
    root = F.regexp_extract(bare, r"^(https?://[^/]+)", 1)
    at = lambda b: F.array(F.concat(b, F.lit("/llms-full.txt")), F.concat(b, F.lit("/llms.txt")))
    return F.when(bare == root, at(bare)).otherwise(F.concat(at(bare), at(root)))


def version(etag: Column, modified: Column, text: Column) -> Column:
    """The server's own mark, else the text's hash."""
    return F.coalesce(http_version(etag, modified), content_hash(text))


def good_enough(docs: DataFrame, split: bool = True) -> DataFrame:
    """(framework, n_units, mean_len, ok): whether raw documents give enough units of enough length; HTML never does.

    Long units count as their parts, or, without ``split``, as the one that their section is."""
    units = extract(docs.where(~F.lower(F.substring(F.ltrim("content"), 1, 15)).rlike("^(?:<!doctype|<html)")), "llms_txt", split=split)
    found = units.groupBy("framework").agg(F.count("*").alias("n_units"), F.avg(F.length("content")).alias("mean_len"))
    told = docs.select("framework").distinct().join(found, "framework", "left").select("framework", F.coalesce("n_units", F.lit(0)).alias("n_units"), F.coalesce("mean_len", F.lit(0.0)).alias("mean_len"))
    return told.withColumn("ok", (F.col("n_units") >= MIN_UNITS) & (F.col("mean_len") >= MIN_MEAN))


def first_good(probed: DataFrame) -> DataFrame:
    """(framework, url) of the first candidate (ord) that answered 200 with a text that is good enough."""
    return probed.where("status = 200 AND ok").groupBy("framework").agg(F.min_by("url", "ord").alias("url"))


def probe(spark: SparkSession, source: dict[str, Any], fetch: Fetch) -> str | None:
    """The address of a site's text, of the first candidate that is good enough; None if there is none."""
    urls = spark.createDataFrame([(source["url"],)], "url string").select(F.explode(candidates(F.col("url"))).alias("u")).collect()  # four at most
    rows = []
    for k, r in enumerate(urls):
        got = fetch(r["u"])
        if got and got[0] == 200:
            rows.append((r["u"], "llms.txt", got[2], "markdown", k, got[0], r["u"]))
    if not rows:
        return None
    asked = spark.createDataFrame(rows, PROBED)
    judged = asked.join(good_enough(asked).select("framework", "ok"), "framework").withColumn("framework", F.lit(source["name"]))
    found = first_good(judged).first()
    return found["url"] if found else None


def read(spark: SparkSession, source: dict[str, Any], fetch: Fetch) -> tuple[DataFrame, str]:
    got = fetch(source["url"])
    if not got or got[0] != 200:
        raise OSError(f"{source['name']}: {source['url']} can't be read")
    docs = spark.createDataFrame([(source["name"], "llms.txt", got[2], "markdown")], schema.RAW_DOCS)
    return docs, _mark(docs, got)


def _mark(docs: DataFrame, got: tuple) -> str:
    modified = got[3] if len(got) > 3 else None
    return docs.select(version(F.lit(got[1]).cast("string"), F.lit(modified).cast("string"), F.col("content")).alias("v")).first()["v"]


def check_version(spark: SparkSession, source: dict[str, Any], fetch: Fetch) -> str | None:
    """The mark of the text at the other end: of its head where that has one, else of the text itself."""
    got = fetch(source["url"], None, "HEAD")
    if got and got[0] == 200 and (got[1] or (len(got) > 3 and got[3])):
        return _mark(spark.createDataFrame([("",)], "content string"), got)
    try:
        return read(spark, source, fetch)[1]
    except OSError:
        return None
