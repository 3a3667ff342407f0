"""Language identification by prediction by partial matching (PPM).

One variable-order byte tree a language is counted on a bounded sample and frozen.  A byte's probability descends from
the context of three bytes to the shortest; each level gives up ``d / (n + d)`` of its mass as escape (method C) and
excludes what a longer context has already predicted; the bytes of no context share what is left equally.  Before a text
stand three zero bytes, in training as in scoring.

As the statistics are frozen, a byte's code length depends only on its three predecessors.  The tree is kept sparse: a
node for each context and byte that a language has, and for each context what it costs to leave it, so a model is as
large as its own nodes, whatever other languages there are.  A chunk of text is first reduced to its distinct four-byte
strings; each language looks those up, and a text's code length is the sum over all of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import pieces, texts

CHUNK = 1 << 19
UNKNOWN = "und"
#: Training bytes of all languages, of one language, and of one text.
TOTAL_BYTES, LANGUAGE_BYTES, TEXT_BYTES = 48 << 20, 2 << 20, 50_000
#: Texts that a language learns from at least, where it has as many.
LEAST_TEXTS = 24


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``asked`` stands in the sorted ``keys``, and whether it does."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


@dataclass
class Level:
    """The contexts of one length.  ``keys``, ``count``: context * 256 + byte, sorted, and how often it came;
    ``contexts``: sorted; ``n``, ``d``: their bytes and distinct bytes; ``below_n``, ``below_d``: those of the context
    one byte shorter, without the bytes that this one has."""

    keys: np.ndarray
    count: np.ndarray
    contexts: np.ndarray
    n: np.ndarray
    d: np.ndarray
    below_n: np.ndarray
    below_d: np.ndarray


@dataclass
class Tree:
    """One language: the levels of contexts of 0, 1, 2 and 3 bytes."""

    levels: list[Level]

    def bits(self, strings: np.ndarray) -> np.ndarray:
        """Code lengths of the last byte behind the three before it, of four-byte strings as big-endian numbers."""
        if not len(self.levels[0].keys):
            return np.full(len(strings), 8.0)
        out = np.zeros(len(strings))
        open_ = np.arange(len(strings))
        # How many bytes, and distinct ones, the present level has left; those of a context without an exclusion at first.
        left_n = left_d = None
        for order in range(3, -1, -1):
            level = self.levels[order]
            asked = strings[open_] if order == 3 else strings[open_] & np.uint32((1 << 8 * (order + 1)) - 1)
            context, there = _find(level.contexts, asked >> np.uint32(8))
            own_n, own_d = np.where(there, level.n[context], 0.0), np.where(there, level.d[context], 0.0)
            if left_n is not None:  # a longer context was there and has taken its bytes out
                own_n, own_d = np.where(np.isnan(left_n), own_n, left_n), np.where(np.isnan(left_d), own_d, left_d)
            at, found = _find(level.keys, asked)
            total = np.maximum(own_n + own_d, 1.0)
            out[open_[found]] += np.log2(total[found]) - np.log2(level.count[at[found]])
            gone = ~found
            escaped = gone & (own_n > 0)
            out[open_[escaped]] += np.log2(total[escaped]) - np.log2(own_d[escaped])
            if order:
                left_n = np.where(there, level.below_n[context], np.nan)[gone]
                left_d = np.where(there, level.below_d[context], np.nan)[gone]
            open_ = open_[gone]
        out[open_] += np.log2(256.0 - len(self.levels[0].keys)) if len(open_) else 0.0
        return out


@dataclass
class PpmModel:
    langs: list[str]
    trees: list[Tree]


def _strings(data: np.ndarray) -> np.ndarray:
    """The four-byte string that ends at each byte, from the third on."""
    wide = data.astype(np.uint32)
    return (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]


def _padded(docs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(b"\0\0\0" + t for t in docs), np.uint8)


def fit(samples: dict[str, list[bytes]]) -> PpmModel:
    """A tree for each language of ``samples``, every context and byte of them in it."""
    langs = sorted(samples)
    return PpmModel(langs, [_tree(samples[x]) for x in langs])


def _tree(docs: list[bytes]) -> Tree:
    strings = np.concatenate([np.zeros(0, np.uint32), *(_strings(_padded([t])) for t in docs if t)])
    keys, count = np.unique(strings, return_counts=True)
    levels: list[Level] = []
    by_order = [(keys, count)]
    for order in (2, 1, 0):
        keys, at = np.unique(by_order[0][0] & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
        by_order.insert(0, (keys, np.bincount(at, by_order[0][1], len(keys)).astype(np.int64)))
    for order, (keys, count) in enumerate(by_order):
        contexts, at = np.unique(keys >> np.uint32(8), return_inverse=True)
        n, d = np.bincount(at, count, len(contexts)), np.bincount(at, minlength=len(contexts)).astype(float)
        if order:
            shorter = levels[order - 1]
            where, _ = _find(shorter.keys, keys & np.uint32((1 << 8 * order) - 1))  # all of them are there
            below, _ = _find(shorter.contexts, contexts & np.uint32((1 << 8 * (order - 1)) - 1))
            below_n = shorter.n[below] - np.bincount(at, shorter.count[where], len(contexts))
            below_d = shorter.d[below] - d
        else:
            below_n = below_d = np.zeros(len(contexts))
        levels.append(Level(keys, count.astype(np.float32), contexts, n.astype(np.float32), d.astype(np.float32), below_n.astype(np.float32), below_d.astype(np.float32)))
    return Tree(levels)


def code_lengths(model: PpmModel, docs: list[bytes]) -> np.ndarray:
    """Bits by text and language, in chunks of whole and of cut texts."""
    import pyarrow as pa

    total = np.zeros((len(docs), len(model.langs)))

    def add(pieces: list[tuple[int, bytes]]) -> None:
        """Pieces of (text, its bytes behind three that are only context)."""
        data = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
        if len(data) < 4:
            return
        sizes = np.array([len(p) for _, p in pieces])
        starts = np.cumsum(sizes) - sizes
        encoded = pa.array(_strings(data)).dictionary_encode()
        codes, distinct = encoded.indices.to_numpy(), encoded.dictionary.to_numpy()
        # A string belongs to the byte it ends at; those that end in a piece's first three bytes count for nothing.
        counts = np.ones(len(data))
        for back in range(3):
            counts[starts + back] = 0.0
        counts = counts[3:]
        owner = np.maximum(starts - 3, 0)
        for k, tree in enumerate(model.trees):
            each = np.add.reduceat(tree.bits(distinct)[codes] * counts, owner)
            np.add.at(total[:, k], [i for i, _ in pieces], each)

    pieces, size = [], 0
    for i, text in enumerate(docs):
        for lo in range(0, len(text), CHUNK):
            piece = (text[lo - 3 : lo] if lo else b"\0\0\0") + text[lo : lo + CHUNK]
            pieces.append((i, piece))
            size += len(piece)
            if size >= CHUNK:
                add(pieces)
                pieces, size = [], 0
    if pieces:
        add(pieces)
    return total


def _has_letter(text: bytes | None) -> bool:
    import re

    if not text:
        return False
    return bool(re.search(rb"[A-Za-z]", text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(model: PpmModel, docs: list[bytes | None]) -> tuple[list[str], list[float], list[float | None]]:
    """Language, score and bits a byte of each text."""
    bits = code_lengths(model, [t or b"" for t in docs])
    langs, scores, rates = [], [], []
    for k, text in enumerate(docs):
        if not model.langs or not _has_letter(text):
            langs.append(UNKNOWN), scores.append(0.0), rates.append(None)
            continue
        best = int(np.argmin(bits[k]))
        langs.append(model.langs[best])
        scores.append(float(1.0 / np.exp2(np.maximum(bits[k][best] - bits[k], -1000)).sum()))
        rates.append(float(bits[k][best] / len(text)))
    return langs, scores, rates


def sample(docs: DataFrame, total_bytes: int = TOTAL_BYTES, language_bytes: int = LANGUAGE_BYTES, text_bytes: int = TEXT_BYTES) -> dict[str, list[bytes]]:
    """A bounded training sample of every language that is there, drawn by a hash of doc_id.

    All languages share ``total_bytes`` equally, none takes more than ``language_bytes`` in expectation (or LEAST_TEXTS
    texts), and a text is learnt up to ``text_bytes`` characters or an eighth of its language's share.  What comes to the
    driver is bounded by that and one row a language."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.least(F.octet_length("text"), F.lit(text_bytes)).cast("long")).alias("bytes"))
    found = sizes.collect()
    if not found:
        return {}
    share = min(language_bytes, total_bytes // len(found))
    cut = min(text_bytes, max(256, share // 8))
    rates = docs.sparkSession.createDataFrame([(r["lang"], max(min(1.0, share / max(1, r["bytes"])), min(1.0, LEAST_TEXTS / r["n"]))) for r in found], "__lang string, __rate double")
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = usable.withColumn("__draw", drawn).join(F.broadcast(rates), F.col("lang") == F.col("__lang")).where("__draw < __rate")
    out: dict[str, list[bytes]] = {}
    for r in rows.select("lang", F.substring("text", 1, cut).alias("text")).collect():
        out.setdefault(r["lang"], []).append(r["text"].encode())
    return out


def identify(docs: DataFrame, model: PpmModel, keep: list[str] = ()) -> DataFrame:
    """Adds lang_pred, score and bits_per_byte to the columns ``keep`` of ``docs`` (with a ``text``).

    Null texts and texts without a letter (empty ones too) give ``und``, score 0 and no bits_per_byte;
    so does every text if no labelled row was there to learn from.  Texts of any length are scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(*dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            langs, scores, rates = predict(shared.value, texts(batch))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())],
                names=[*keep, "lang_pred", "score", "bits_per_byte"],
            )

    fields = [f for c in keep for f in frame.schema.fields if f.name == c]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    return frame.mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: PpmModel, max_bits: float = 7.0) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, with all columns.

    ``und`` (null, empty and letterless texts) goes, and so does a text for which the best model needs more than
    ``max_bits`` bits a byte; repeated rows stay repeated, null ids and labels do not matter, texts of any length are
    scored whole, and an empty table gives no rows.  Without a learned language everything goes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            langs, _, rates = predict(shared.value, texts(batch))
            yield batch.filter(pa.array([lang != UNKNOWN and rate <= max_bits for lang, rate in zip(langs, rates, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id", mod: int = 3, rest: int = 1):
    """Whether crc32 of the id as text leaves ``rest``; ids that are null are never held out, nor learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))


def train(docs: DataFrame, **bounds) -> PpmModel:
    """A model from the labelled rows that are not held out; see :func:`sample`."""
    return fit(sample(docs.where(~held_out()), **bounds))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte of every document; see :func:`identify`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    marked = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identify(marked, train(docs), ["doc_id", "held_out"])
