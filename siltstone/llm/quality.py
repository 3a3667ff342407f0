"""Quality by compression: how much better a text packs with a dictionary of good text than with one of bad text.

Two Zstandard dictionaries are built from good and bad labelled texts.  A text is packed whole, in blocks, with either,
and the difference of the two sizes is divided by the text's length.  A logistic curve, fitted on labelled texts that
are in neither dictionary, turns it into a probability, together with the size without a dictionary over the length:
neither dictionary tells anything about a text that only repeats itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, LEVEL, DICT_BYTES = 2 << 10, 3, 112 << 10
#: A text is predicted to be good from this score on.
THRESHOLD = 0.7


@dataclass
class QualityModel:
    """Dictionaries as bytes (empty: nothing was learnt), and the curve's intercept and slopes."""

    good: bytes
    bad: bytes
    intercept: float = 0.0
    slopes: tuple[float, float] = (0.0, 0.0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + x @ np.array(self.slopes), -30, 30)))


class Packers:
    """A compressor each for no, the good and the bad dictionary; made once a process."""

    def __init__(self, model: QualityModel):
        import zstandard

        self.packers = []
        for data in (b"", model.good, model.bad):
            args = {}
            if data:
                args["dict_data"] = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)
                args["dict_data"].precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, **args))

    def sizes(self, text: bytes) -> tuple[float, float]:
        """(size with the bad dictionary - size with the good one) and size without, over the length; 0 for empty texts."""
        if not text:
            return 0.0, 0.0
        total = [0, 0, 0]
        for lo in range(0, len(text), BLOCK):
            block = text[lo : lo + BLOCK]
            for k, p in enumerate(self.packers):
                total[k] += len(p.compress(block))
        return (total[2] - total[1]) / len(text), total[0] / len(text)


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or plain content where there is too little to train on."""
    import zstandard

    blocks = [t[lo : lo + 2048] for t in texts for lo in range(0, len(t), 2048)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICT_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, tuple[float, ...]]:
    """Intercept and slopes by Newton's method with a small ridge; labels are drawn in a little from 0 and 1."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    design = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, ridge = np.zeros(design.shape[1]), 1e-3 * np.eye(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, design.T @ (p - target) + ridge @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[1:] / scale
    return float(w[0] - slopes @ mean), tuple(slopes.tolist())


def fit(rows: list[tuple[bytes, int]]) -> QualityModel:
    """``rows``: text and label, in any fixed order; every second one of each label goes to the dictionaries."""
    good, bad = [t for t, y in rows if y == 1 and t], [t for t, y in rows if y == 0 and t]
    if len(good) < 2 or len(bad) < 2:
        share = (len(good) + 1) / (len(good) + len(bad) + 2)
        return QualityModel(b"", b"", float(np.log(share / (1 - share))))
    model = QualityModel(_dictionary(good[::2]), _dictionary(bad[::2]))
    packers = Packers(model)
    held = [(t, 1) for t in good[1::2]] + [(t, 0) for t in bad[1::2]]
    x, y = np.array([packers.sizes(t) for t, _ in held]), np.array([y for _, y in held], float)
    model.intercept, model.slopes = _logistic(x, y)
    return model


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 4; null ids are never held out, nor learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, per_label: int = 3000, max_chars: int = 16_000) -> list[tuple[bytes, int]]:
    """A bounded training sample: in expectation at most ``per_label`` texts of either label, at one rate for both
    unless a label is rarer, drawn by a hash of doc_id; of each text the first ``max_chars`` characters.

    The ids that are drawn are sent to the documents; what comes to the driver is bounded by both numbers."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if not counts:
        return []
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.create_map(*[F.lit(x) for q, n in counts.items() for x in (q, min(1.0, per_label / n))])
    chosen = known.withColumn("draw", draw).where(F.col("draw") < F.try_element_at(rate, "quality")).groupBy("doc_id").agg(F.min("quality").alias("__quality"), F.min("draw").alias("draw")).orderBy("draw", "doc_id").limit(3 * per_label)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.substring("text", 1, max_chars).alias("text")).join(F.broadcast(chosen.select("doc_id", "__quality")), "doc_id")
    rows = texts.orderBy(F.xxhash64(F.lit("order"), "doc_id"), "doc_id", "text").limit(3 * per_label).collect()
    return [(r["text"].encode(), r["__quality"]) for r in rows]


def score(docs: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with score (0 to 1) and predicted (1 from :data:`THRESHOLD` on).

    Null and empty texts get the score of sizes of zero; repeated rows stay repeated; texts of any length are
    packed whole, block by block; without labels of both kinds every text gets the labels' share of good ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from siltstone.llm.store import pieces, texts

        model = shared.value
        packers = Packers(model)
        for batch in pieces(batches):
            value = model.probability(np.array([packers.sizes(t or b"") for t in texts(batch, "__text")]).reshape(-1, 2))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(value, pa.float64()), pa.array(value >= THRESHOLD).cast(pa.int32())], names=[*keep, "score", "predicted"])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; see :func:`score`."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(sample(docs, labels))
    return score(docs.select("doc_id", "text", held_out().alias("held_out")), model, ["doc_id", "held_out"])
