"""Semantic and hybrid search, bundles by type, symbol lookup and browsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.columns import cosine_distance, description, normalize_symbol
from siltstone.schema import UNIT_TYPES

from siltstone.scratch import write_table

from .index import Index, _filtered, keyword_search, ranked
from .ranking import numbered, place

#: Fixed value of reciprocal rank fusion.
RRF = 60


def check_top_k(top_k: int, most: int = 100) -> int:
    if not 1 <= top_k <= most:
        raise ValueError(f"top_k must be 1 to {most}, not {top_k}")
    return top_k


def semantic_search(vectors: DataFrame, query: list[float], top_k: int = 20, framework: str | None = None, unit_type: str | None = None) -> DataFrame:
    """(id, distance, rank) of the nearest by cosine, exactly; filters come first.  ``vectors``: id, embedding, framework, type, and
    where the unit stands."""
    wanted = F.array(*(F.lit(float(x)) for x in query))
    near = _filtered(vectors, framework, unit_type).select(*place(vectors), cosine_distance(F.col("embedding"), wanted).alias("score")).where(F.col("score").isNotNull())
    return ranked(near, top_k, F.asc("score")).select("id", F.col("score").alias("distance"), "rank")


def fuse(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    """(id, score, sem_rank, kw_rank): reciprocal ranks of both lists, added."""
    none = F.lit(None).cast("int")
    both = semantic.select("id", F.col("rank").alias("sem_rank"), none.alias("kw_rank")).unionByName(keyword.select("id", none.alias("sem_rank"), F.col("rank").alias("kw_rank")))
    one = both.groupBy("id").agg(F.max("sem_rank").alias("sem_rank"), F.max("kw_rank").alias("kw_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.col(c) + RRF), F.lit(0.0))
    return one.withColumn("score", part("sem_rank") + part("kw_rank"))


def hybrid_search(index: Index, vectors: DataFrame, query: str, vector: list[float], top_k: int = 10, framework: str | None = None, unit_type: str | None = None) -> DataFrame:
    """(id, type, score, rank): both searches fused, cut to twice ``top_k``, weighted by decay and cut again.

    Equal scores are ordered by the semantic rank (none last), then the keyword rank."""
    fused = fuse(semantic_search(vectors, vector, 2 * top_k, framework, unit_type), keyword_search(index, query, 2 * top_k, framework, unit_type))
    order = (F.asc_nulls_last("sem_rank"), F.asc_nulls_last("kw_rank"))
    pool = fused.orderBy(F.desc("score"), *order).limit(2 * top_k)
    units = index.units.select("id", "type", "relevance_decay")
    decayed = pool.join(units, "id").withColumn("base", F.col("score")).withColumn("score", F.col("score") * F.col("relevance_decay"))
    best = decayed.orderBy(F.desc("score"), F.desc("base"), *order).limit(top_k)
    return best.select("id", "type", "score", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("base"), *order)).alias("rank"))


def bundle(index: Index, vectors: DataFrame, query: str, vector: list[float], top_k: int = 5, framework: str | None = None) -> DataFrame:
    """(id, type, score, bucket_rank): up to ``top_k`` of each type from a search four times as wide."""
    check_top_k(top_k, 50)
    wide = hybrid_search(index, vectors, query, vector, 4 * top_k, framework)
    place = F.row_number().over(Window.partitionBy("type").orderBy("rank"))
    return wide.where(F.col("type").isin(*UNIT_TYPES)).withColumn("bucket_rank", place).where(F.col("bucket_rank") <= top_k).select("id", "type", "score", "bucket_rank")


def _matching(symbols: DataFrame, symbol: str, framework: str | None) -> DataFrame:
    """(unit_id, is_def, key): units that have the symbol; by ``key`` those that define it come first, then by place."""
    hits = symbols.where(F.col("symbol") == normalize_symbol(F.lit(symbol)))
    hits = hits.where(F.col("framework") == framework) if framework else hits
    file = [F.min("source_file").alias("source_file")] if "source_file" in symbols.columns else []
    found = hits.groupBy("unit_id").agg(F.max("is_definition").alias("is_def"), F.min("sym_seq").alias("first"), *file)
    return found.select("unit_id", "is_def", F.struct((-F.col("is_def")).alias("other"), *(["source_file"] if file else []), "first", "unit_id").alias("key"))


def lookup_ids(symbols: DataFrame, symbol: str, framework: str | None = None) -> DataFrame:
    """(unit_id, is_def, ord): units that have the symbol, those that define it first."""
    found = _matching(symbols, symbol, framework).withColumn("section", F.lit("match"))
    return numbered(found, "section", "key").select("unit_id", "is_def", "ord")


def near(symbols: DataFrame, matching: DataFrame, framework: str | None = None) -> DataFrame:
    """(unit_id, of): units that share a symbol with one of ``matching`` (unit_id, key) but itself, and the first such one.

    A symbol is reduced to the first two of the matching units that have it; the second one serves the first, which is not
    its own neighbour.  So each row of ``symbols`` meets one row, however many units share a symbol."""
    own = symbols.select("symbol", "unit_id").join(matching.select("unit_id", "key"), "unit_id").select("symbol", "key")
    first = write_table(own.groupBy("symbol").agg(F.min("key").alias("one")), "symbols")
    second = own.join(first, "symbol").where("key <> one").groupBy("symbol").agg(F.min("key").alias("two"))
    two = first.join(second, "symbol", "left")
    pool = symbols.where(F.col("framework") == framework) if framework else symbols
    of = F.when(F.col("one.unit_id") != F.col("unit_id"), F.col("one")).otherwise(F.col("two"))
    return pool.select("symbol", "unit_id").join(two, "symbol").select("unit_id", of.alias("of")).where("of IS NOT NULL").groupBy("unit_id").agg(F.min("of").alias("of"))


def lookup(units: DataFrame, symbols: DataFrame, symbol: str, framework: str | None = None, include_related: bool = True, include_examples: bool = True) -> DataFrame:
    """(section, ord, id): the match, what is related to it, and examples of all units that have the symbol.  No match, no rows."""
    matching = write_table(_matching(symbols, symbol, framework), "matching")
    best = matching.agg(F.min("key").alias("key"))
    out = best.select(F.lit("match").alias("section"), F.lit(1).alias("ord"), F.col("key.unit_id").alias("id")).where("id IS NOT NULL")
    if not include_related and not include_examples:
        return out
    kinds = units.select("type", *place(units))
    beside = near(symbols, matching, framework).join(kinds, F.col("unit_id") == F.col("id")).crossJoin(best.withColumnRenamed("key", "best"))  # one row
    example = F.col("type") == "example"
    section = F.when(example & F.lit(include_examples), "example").when(~example & (F.col("of") == F.col("best")) & F.lit(include_related), "related")
    rows = beside.withColumn("section", section).where("section IS NOT NULL")
    # Related units all belong to the match, so they are ordered by their place alone.
    return out.unionByName(numbered(rows, "section", "of", *place(units)).select("section", "ord", "id"))


def browse_modules(units: DataFrame, symbols: DataFrame, framework: str, most: int = 20) -> DataFrame:
    """(module_path, n_units, description, symbols): each module with its first line and its first symbols by name."""
    own = units.where(F.col("framework") == framework)
    heads = own.groupBy("module_path").agg(F.count("*").alias("n_units"), F.min_by("content", F.struct(*place(own))).alias("content"))
    names = symbols.join(own.select(F.col("id").alias("unit_id"), "module_path"), "unit_id").select("module_path", "symbol").distinct()
    listed = names.withColumn("n", F.row_number().over(Window.partitionBy("module_path").orderBy("symbol"))).where(F.col("n") <= most).groupBy("module_path").agg(F.array_sort(F.collect_list("symbol")).alias("symbols"))
    return heads.join(listed, "module_path", "left").select("module_path", "n_units", description(F.col("content")).alias("description"), F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"))


def browse_units(units: DataFrame, framework: str, module: str) -> DataFrame:
    """Units whose module holds ``module``; upper and lower case are alike, _ and % stand for any character(s)."""
    return units.where((F.col("framework") == framework) & F.col("module_path").ilike(f"%{module}%"))


def smart(index: Index, units: DataFrame, symbols: DataFrame, vectors: DataFrame, query: str, vector: list[float], top_k: int = 5, framework: str | None = None) -> DataFrame:
    """(section, ord, id): one word is looked up as a symbol, and searched for if there is none; more words are searched for."""
    found = lookup(units, symbols, query, framework) if len(query.split()) == 1 else None
    if found is not None and not found.isEmpty():
        return found
    hits = bundle(index, vectors, query, vector, top_k, framework)
    return hits.select(F.col("type").alias("section"), F.col("bucket_rank").alias("ord"), "id")
