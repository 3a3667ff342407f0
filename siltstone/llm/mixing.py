"""Mixing sources to target weights by iterative proportional fitting, with DataFrame operations alone.

The corpus is reduced to cells (one for each combination of the dimensions' values) with their token mass.
Raking multiplies a cell by target / current share, one dimension after another, until no marginal is further than a
tolerance from its target; what is left (targets can contradict each other) is told as ``residual``.  The cells carry their
targets, so a sweep is three windows over the cells, written to the shared folder to cut the lineage.  A document's
sampling probability follows from its cell's calibrated ratio; what a probability above one would have asked for is
kept as a weight, so weighted token shares meet the targets in expectation.  Where no weight can be carried on, the
raking is bounded so that no probability above one is asked for, and the rate is lowered as far as that takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import drop_table, let, write_table

#: Topics by the beginnings of their words, in the four languages; a parameter of :func:`topic_of`.
TOPICS: dict[str, tuple[str, ...]] = {
    "science": ("scien", "physic", "chemi", "biolog", "experiment", "wissenschaft", "forsch", "recherch", "cienci"),
    "health": ("medic", "patient", "hospital", "disease", "gesund", "krank", "maladi", "salud"),
    "law": ("legal", "court", "lawyer", "attorney", "gericht", "gesetz", "tribunal", "abogad"),
    "finance": ("financ", "invest", "bank", "market", "econom", "wirtschaft", "aktie", "bourse"),
    "technology": ("software", "comput", "algorithm", "program", "internet", "rechner", "logiciel", "ordenador"),
    "sport": ("football", "soccer", "olympi", "athlet", "champion", "fussball", "sporti", "deport"),
    "politics": ("politic", "parliament", "election", "government", "regierung", "gouvernement", "gobierno", "wahl"),
    "travel": ("travel", "touris", "hotel", "airport", "reise", "voyage", "viaje", "flughafen"),
}
#: A text has the topic with the most such words, of so many at least; equal counts go to the first.
LEAST_WORDS = 2
#: Texts without a topic by the first pattern that they have; the others are prose.
FORMS = (("license", r"(?i:licensed? under|released under)"), ("table", r"\x20\|\x20"), ("marked", r"[%$&#*]{3}"), ("shout", r"[A-Z]{2}!!"))
NONE = "(none)"
DIMENSIONS = ("source", "lang", "topic")
#: Target shares by dimension; values that are not named share the rest in proportion to the share they have.  Where the
#: named ones leave no rest, the others keep the share they have and the named ones are scaled to what remains.
TARGETS: dict[str, dict[str, float]] = {"source": {"src0": 0.12}, "lang": {"en": 0.5, "de": 0.2, "fr": 0.18, "es": 0.12}, "topic": {"table": 0.02, "marked": 0.02, "shout": 0.01}}
RATE, SWEEPS, TOLERANCE = 0.5, 60, 1e-7


def _words_pattern(topics: dict[str, tuple[str, ...]]) -> str:
    """One pattern for all beginnings, by their first letters, of a text with a space before it; what stands before a word
    is taken with it, so no look-behind is needed."""
    words = [w for ws in topics.values() for w in ws]
    return "[^a-z](" + "|".join(f"{c}(?:{'|'.join(w[1:] for w in words if w[0] == c)})" for c in sorted({w[0] for w in words})) + ")"


def topic_of(text: Column, topics: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The topic of a text, else its form, else ``prose``; null texts are prose."""
    topics = TOPICS if topics is None else topics
    form = F.lit("prose")
    for name, pattern in reversed(FORMS):
        form = F.when(text.rlike(pattern), F.lit(name)).otherwise(form)
    lower = F.concat(F.lit(" "), F.lower(text))

    def counted(hits: Column, k: int, name: str) -> Column:
        return F.struct(F.size(F.filter(hits, lambda h: h.isin(*topics[name]))).alias("n"), F.lit(-k).alias("order"), F.lit(name).alias("name"))

    def best(hits: Column) -> Column:
        return F.array_max(F.array(*(counted(hits, k, name) for k, name in enumerate(topics))))

    found = F.when(lower.rlike(_words_pattern(topics)), let(F.regexp_extract_all(lower, F.lit(_words_pattern(topics)), F.lit(1)), best)) if topics else None
    out = form if found is None else let(found, lambda b: F.when(b["n"] >= LEAST_WORDS, b["name"]).otherwise(form))
    return F.coalesce(out, F.lit("prose"))


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def shares(cells: DataFrame, dim: str, targets: dict[str, float]) -> DataFrame:
    """(dim, target): the share each value that is there shall have; they add up to one.

    Targets of values that are not there are left out, and all others scaled to one."""
    mass = cells.groupBy(dim).agg(F.sum("mass").alias("mass"))
    given = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]) if targets else F.lit(None).cast("map<string,double>")
    named = mass.withColumn("named", F.try_element_at(given, F.col(dim)))
    totals = named.agg(F.coalesce(F.sum("named"), F.lit(0.0)).alias("given"), F.coalesce(F.sum(F.when(F.col("named").isNull(), F.col("mass"))), F.lit(0.0)).alias("rest"), F.sum("mass").alias("all")).first()
    free = max(0.0, 1.0 - totals["given"])
    left = free if totals["rest"] > 0 else 0.0
    if totals["rest"] > 0 and free < 1e-9:
        present = totals["rest"] / totals["all"]
        left = totals["given"] * present / (1.0 - present) if present < 1.0 else 1.0
    scale = totals["given"] + left
    raw = F.coalesce("named", F.col("mass") / F.lit(totals["rest"] or 1.0) * F.lit(left))
    return named.select(dim, (raw / F.lit(scale) if scale > 0 else F.lit(0.0)).alias("target"))


def _off(dims: list[str]) -> Column:
    """How far the furthest marginal is from its target."""
    return F.max(F.greatest(F.lit(0.0), *(F.abs(F.col(f"have_{d}") - F.col(f"target_{d}")) for d in dims)))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]], sweeps: int = SWEEPS, tolerance: float = TOLERANCE, cap: float | None = None) -> DataFrame:
    """``cells`` (the dimensions, mass) with ``ratio``: calibrated share over the share there is, and ``residual``: how
    far the furthest marginal has stayed from its target.

    With ``cap``, each sweep begins by cutting ratios to it, so the sweeps move what is above it to other cells; the last
    ones' ratios may still be a little above it.
    Stops when no marginal was further than ``tolerance`` from its target, or after ``sweeps`` sweeps; the residual tells
    which.  Cells are already reduced from documents; a sweep is one window a dimension over them, so its plan stays small
    on the driver."""
    dims = list(targets)
    total = cells.agg(F.sum("mass")).first()[0] or 0.0
    share = F.col("mass") / F.lit(total) if total > 0 else F.lit(0.0)
    start = cells.withColumn("share", share).withColumn("w", share)
    for d in dims:
        start = start.join(shares(cells, d, targets[d]).withColumnRenamed("target", f"target_{d}"), d)
    current = write_table(start, "cells")
    columns = current.columns
    have = {f"have_{d}": F.sum("w").over(Window.partitionBy(d)) for d in dims}
    for _ in range(sweeps):
        step = current if cap is None else current.withColumn("w", F.least("w", F.col("share") * F.lit(cap)))
        for d in dims:
            step = step.withColumn(f"have_{d}", have[f"have_{d}"]).withColumn("w", F.when(F.col(f"have_{d}") > 0, F.col("w") * F.col(f"target_{d}") / F.col(f"have_{d}")).otherwise(F.col("w")))
        before, current = current, write_table(step, "cells")
        worst = current.agg(_off(dims)).first()[0]
        drop_table(before)
        path, current = current._scratch_path, current.select(*columns)
        current._scratch_path = path
        if worst is None or worst <= tolerance:
            break
    # A cell without mass has no share to move, so a value without any is no miss.
    residual = current.withColumns(have).where(" OR ".join(f"have_{d} > 0" for d in dims)).agg(_off(dims)).first()[0] if total > 0 else None
    return current.select(*dims, "mass", F.when(F.col("share") > 0, F.col("w") / F.col("share")).otherwise(0.0).alias("ratio"), F.lit(float(residual or 0.0)).alias("residual"))


def _cell(docs: DataFrame) -> DataFrame:
    """doc_id and what a document's probability depends on; nulls of a dimension are a value of their own."""
    return docs.select("doc_id", F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"), topic_of(F.col("text")).alias("topic"), n_tokens(F.col("text")).alias("n_tokens"))


def draw(doc_id: str, seed: str) -> Column:
    """A number in [0, 1) from the id alone, in 32-bit steps."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(NONE)))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def calibrate(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE, seed: str = "mix", sweeps: int = SWEEPS) -> DataFrame:
    """doc_id, the dimensions, n_tokens, probability, weight, sampled and residual (of the fit, the same in all rows) of
    every row of ``docs``.

    ``rate``: the share of all tokens asked for.  m = rate * ratio of the cell; probability = min(1, m) and weight =
    max(1, m).  Null ids are drawn as one id; repeated rows share their draw; texts without words have no mass but
    the probability of their cell (0 in a cell without any); an empty table gives no rows."""
    targets = targets or TARGETS
    marked = write_table(_cell(docs), "marked")
    cells = write_table(marked.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("mass")), "mass")
    ratios = rake(cells, targets, sweeps)
    # The cells are as many as combinations of values: small as a rule, so AQE may broadcast them by their measured size.
    # Beyond that they are joined by a shuffle, dealt by the cell and a salt, as a cell can hold a third of all rows.
    multiple = F.col("ratio") * F.lit(rate)
    joined = salted_join(marked, ratios.select(*DIMENSIONS, "ratio", "residual"), list(DIMENSIONS))
    return joined.select(
        "doc_id", *DIMENSIONS, "n_tokens", F.least(F.lit(1.0), multiple).alias("probability"), F.greatest(F.lit(1.0), multiple).alias("weight"), (draw("doc_id", seed) < F.least(F.lit(1.0), multiple)).alias("sampled"), "residual"
    )


def salted_join(rows: DataFrame, small: DataFrame, keys: list[str], salts: int = 64) -> DataFrame:
    """``rows`` joined to ``small`` (one row a key), each key's rows spread over ``salts`` parts."""
    spread = rows.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in rows.columns]), F.lit(salts)))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(copies, [*keys, "__salt"]).drop("__salt")


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` that are drawn, with all columns; see :func:`calibrate`."""
    cells = write_table(_cell(docs).groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("mass")), "mass")
    ratios = rake(cells, targets or TARGETS)
    chance = write_table(ratios.select(*DIMENSIONS, F.least(F.lit(1.0), F.col("ratio") * rate).alias("p")), "chances")
    return _drawn(docs, chance, seed)


def attainable(cells: DataFrame, targets: dict[str, dict[str, float]], rate: float) -> float:
    """The largest rate up to ``rate`` at which every value has the mass that its target asks for."""
    total = cells.agg(F.sum("mass")).first()[0] or 0.0
    for d in targets if total > 0 else ():
        have = cells.groupBy(d).agg((F.sum("mass") / F.lit(total)).alias("have"))
        least = have.join(shares(cells, d, targets[d]), d).where("have > 0 AND target > 0").agg(F.min(F.col("have") / F.col("target"))).first()[0]
        rate = min(rate, rate if least is None else least)
    return rate


def chances(cells: DataFrame, targets: dict[str, dict[str, float]], rate: float = RATE, sweeps: int = SWEEPS) -> DataFrame:
    """(the dimensions, mass, p): probabilities of at most one whose expected token shares meet the targets unweighted.

    ``rate`` is lowered to what the scarcest value allows, and by what the bounded raking still asks for above one."""
    rate = attainable(cells, targets, rate)
    ratios = rake(cells, targets, sweeps, tolerance=1e-4, cap=1.0 / rate if rate > 0 else None)
    most = ratios.agg(F.max("ratio")).first()[0] or 0.0
    return ratios.select(*DIMENSIONS, "mass", F.least(F.lit(1.0), F.col("ratio") * F.lit(min(rate, 1.0 / most) if most > 0 else 0.0)).alias("p"))


def sample_unweighted(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` that are drawn, with all columns, so that they meet the targets without a weight; see :func:`chances`."""
    cells = write_table(_cell(docs).groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("mass")), "mass")
    return _drawn(docs, write_table(chances(cells, targets or TARGETS, rate).drop("mass"), "chances"), seed)


def _drawn(docs: DataFrame, chance: DataFrame, seed: str) -> DataFrame:
    rows = docs.select(F.struct(*docs.columns).alias("row"), *(F.coalesce(d, F.lit(NONE)).alias(d) for d in DIMENSIONS[:2]), topic_of(F.col("text")).alias("topic"), draw("doc_id", seed).alias("u"))
    # Beyond what a broadcast takes, a cell's rows (a third of all, maybe) are spread by a salt of the draw.
    salts = 64
    spread = rows.withColumn("__salt", F.floor(F.col("u") * F.lit(float(1 << 20))).cast("long") % salts)
    copies = chance.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(copies, [*DIMENSIONS, "__salt"]).where("u < p").select("row.*")


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Probability, weight and draw of every document; see :func:`calibrate`."""
    out = calibrate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return out.withColumns({c: F.round(c, 4) for c in ("probability", "weight", "residual")})


def _oracle() -> str:
    """The same fit in SQL: one dimension after another in a recursive query, SWEEPS times."""
    form = "'prose'"
    for name, pattern in reversed(FORMS):
        form = f"CASE WHEN regexp_matches(text, '{pattern}') THEN '{name}' ELSE {form} END"
    hits = f"regexp_extract_all(' ' || lower(text), '{_words_pattern(TOPICS)}', 1)"
    counts = ", ".join("len(list_filter(hits, lambda h: h IN (" + ", ".join(f"'{w}'" for w in words) + ")))" for words in TOPICS.values())
    names = ", ".join(f"'{name}'" for name in TOPICS)
    sql = f"""WITH RECURSIVE heard AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, text, {hits} AS hits FROM documents
), counted AS (
  SELECT *, [{counts}] AS n FROM heard
), marked AS (
  SELECT doc_id, source, lang, CASE WHEN text IS NULL THEN 'prose' WHEN list_max(n) >= {LEAST_WORDS} THEN [{names}][list_position(n, list_max(n))] ELSE {form} END AS topic,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM counted
), cells AS (
  SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS mass FROM marked GROUP BY ALL
), c0 AS (
  SELECT *, CASE WHEN sum(mass) OVER () > 0 THEN mass / sum(mass) OVER () ELSE 0 END AS share FROM cells
)"""
    for d in DIMENSIONS:
        named = " ".join(f"WHEN '{k}' THEN {v}" for k, v in TARGETS[d].items())
        sql += f""", m_{d} AS (
  SELECT {d}, sum(mass) AS mass, CASE {d} {named} END AS named FROM cells GROUP BY {d}
), s_{d} AS (
  SELECT *, coalesce(sum(named) OVER (), 0) AS given, coalesce(sum(mass) FILTER (WHERE named IS NULL) OVER (), 0) AS rest, sum(mass) OVER () AS whole FROM m_{d}
), r_{d} AS (
  SELECT {d}, coalesce(named, mass / rest * CASE WHEN 1.0 - given >= 1e-9 THEN 1.0 - given WHEN rest < whole THEN given * (rest / whole) / (1 - rest / whole) ELSE 1.0 END, 0) AS raw FROM s_{d}
), t_{d} AS (
  SELECT {d}, raw / sum(raw) OVER () AS target_{d} FROM r_{d}
)"""
    turn = " ".join(f"WHEN {k} THEN CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * target_{d} / sum(w) OVER (PARTITION BY {d}) ELSE w END" for k, d in enumerate(DIMENSIONS))
    columns = "source, lang, topic, share, target_source, target_lang, target_topic"
    off = ", ".join(f"abs(sum(w) OVER (PARTITION BY {d}) - target_{d})" for d in DIMENSIONS)
    drawn = f"CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '{NONE}')), 1, 8)) AS UBIGINT) / 4294967296.0"
    return sql + f""", swept AS (
  SELECT 0 AS k, {columns}, share AS w FROM c0 JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)
  UNION ALL
  SELECT k + 1, {columns}, CASE k % 3 {turn} END FROM swept WHERE k < {3 * SWEEPS}
), fitted AS (
  SELECT source, lang, topic, CASE WHEN share > 0 THEN w / share ELSE 0 END AS ratio, greatest({off}) AS off FROM swept WHERE k = {3 * SWEEPS}
)
SELECT doc_id, m.source, m.lang, m.topic, n_tokens, round(least(1.0, {RATE} * ratio), 4) AS probability, round(greatest(1.0, {RATE} * ratio), 4) AS weight, {drawn} < least(1.0, {RATE} * ratio) AS sampled,
       round((SELECT max(off) FROM fitted), 4) AS residual
FROM marked m JOIN fitted f ON m.source = f.source AND m.lang = f.lang AND m.topic = f.topic"""


OP2_SQL = _oracle()
