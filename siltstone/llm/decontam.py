"""Benchmark decontamination: every window of a training text against the benchmark's word n-grams.

The benchmark's windows go to the executors as a hash set (blocks of a checked size).  A training text
becomes an array of word numbers, where words that no benchmark item has are -1; only runs of known
words that are long enough are hashed, all at once, and every hash that is found is verified word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import drop_table, pieces, texts, write_table

#: Bytes that are part of a word: 0-9, a-z (A-Z is lower-cased) and everything outside ASCII.
_TO_WORD = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORD).split()


def spans_of_words(text: bytes) -> np.ndarray:
    """Byte offsets (start, end) of each word."""
    inside = np.frombuffer(text.translate(_TO_WORD), np.uint8) != 32
    edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.column_stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)])


@dataclass
class WindowIndex:
    """``number``: word to number; ``words``: the items' numbers in a row; ``owner``: the item of each place in them;
    ``hashes``: by window length the sorted hashes, and where in ``words`` each window starts.  About 20 bytes a window."""

    number: dict[bytes, int] = field(default_factory=dict)
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    items: list = field(default_factory=list)
    hashes: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


def _hash(ids: np.ndarray, length: int) -> np.ndarray:
    """The hash of every window of ``length`` numbers."""
    out = np.zeros(len(ids) - length + 1, np.uint64)
    unsigned = ids.astype(np.uint64) + np.uint64(1)
    for j in range(length):
        out = out * _BASE + unsigned[j : j + len(out)]
    return out


def build_index(items: list[tuple], width: int = 10) -> WindowIndex:
    """``items``: (item id, text).  An item of fewer than ``width`` words is one window, one without words none."""
    index, parts, starts, at = WindowIndex(), [], {}, 0
    for item, text in items:
        ids = [index.number.setdefault(w, len(index.number)) for w in words_of(text)]
        if ids:
            size = min(width, len(ids))
            starts.setdefault(size, []).append(np.arange(at, at + len(ids) - size + 1))
            index.items.append(item)
            parts.append(np.array(ids, np.int32))
            at += len(ids)
    if parts:
        index.words = np.concatenate(parts)
        index.owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    for size in sorted(starts):
        places = np.concatenate(starts[size])
        found = _hash(index.words, size)[places]
        by = np.argsort(found, kind="stable")
        index.hashes[size] = found[by], places[by]
    return index


def scan(index: WindowIndex, text: bytes | None) -> tuple[int, np.ndarray, set]:
    """Number of words, which of them are hit (empty array: none) and the items met."""
    words = words_of(text)
    hit, items = np.zeros(0, bool), set()
    if not words or not index.hashes:
        return len(words), hit, items
    ids = np.fromiter(map(index.number.get, words, repeat(-1)), np.int32, len(words))
    shortest = min(index.hashes)
    unknown = np.concatenate([[-1], np.flatnonzero(ids < 0), [len(ids)]])
    for g in np.flatnonzero(np.diff(unknown) > shortest):
        lo, hi = int(unknown[g]) + 1, int(unknown[g + 1])
        run = ids[lo:hi]
        for size, (known, places) in index.hashes.items():
            if len(run) < size:
                continue
            found = _hash(run, size)
            first = np.searchsorted(known, found, side="left")
            for k in np.flatnonzero(known[np.minimum(first, len(known) - 1)] == found).tolist():
                last = int(np.searchsorted(known, found[k], side="right"))
                same = [p for p in places[first[k] : last].tolist() if (index.words[p : p + size] == run[k : k + size]).all()]
                if same:
                    hit = hit if len(hit) else np.zeros(len(words), bool)
                    hit[lo + k : lo + k + size] = True
                    items.update(index.items[index.owner[p]] for p in same)
    return len(words), hit, items


def cut(text: bytes, hit: np.ndarray) -> bytes:
    """``text`` without its hit words and what stands between two of them."""
    spans = spans_of_words(text)
    edges = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
        out.append(text[at : spans[a, 0]])
        at = int(spans[b - 1, 1])
    return b"".join([*out, text[at:]])


def benchmark_blocks(benchmark: DataFrame, width: int = 10, block_bytes: int = 8 << 20, max_blocks: int = 2) -> list[WindowIndex] | None:
    """The benchmark's windows in blocks for broadcasting; None if they take more than ``max_blocks`` blocks.

    The size is checked on the executors before anything is gathered."""
    usable = benchmark.where(F.col("text").isNotNull())
    total = usable.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if total > block_bytes * max_blocks:
        return None
    blocks, part, size = [], [], 0
    for r in usable.select("item_id", "text").toLocalIterator():
        part.append((r["item_id"], r["text"].encode()))
        size += len(part[-1][1]) + 16
        if size >= block_bytes:
            blocks.append(build_index(part, width))
            part, size = [], 0
    return [*blocks, build_index(part, width)]


def _scan_all(blocks: list[WindowIndex], text: bytes | None) -> tuple[int, np.ndarray, set]:
    n, hit, items = scan(blocks[0], text)
    for block in blocks[1:]:
        _, more, owners = scan(block, text)
        hit = more if not len(hit) else hit | more if len(more) else hit
        items |= owners
    return n, hit, items


def _digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in items)).encode()).hexdigest()


_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def find(docs: DataFrame, benchmark: DataFrame, width: int = 10, **sizes) -> DataFrame:
    """Contamination of every row of ``docs`` (doc_id, text) by ``benchmark`` (item_id, text).

    Null and empty texts have no words and are clean; null benchmark texts have no windows; equal items each
    count; repeated rows stay repeated; long texts are scanned whole; empty tables give no rows or no hits."""
    blocks = benchmark_blocks(benchmark, width, **sizes)
    frame = docs.select("doc_id", "text")
    if blocks is None:
        return _find_by_join(frame, benchmark, width)
    shared = docs.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            rows = [_scan_all(shared.value, t) for t in texts(batch)]
            n_hit = [int(h.sum()) for _, h, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([_digest(r[2]) for r in rows], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    fields = T._parse_datatype_string(_RESULT).fields
    return frame.mapInArrow(run, T.StructType([frame.schema["doc_id"], *fields]))


#: Bits of the filter that document windows pass before they are shuffled, as a power of two; 64 MB at most.
LEAST_FILTER, MOST_FILTER = 20, 29
#: Parts that a gram of many documents is spread over.
SALTS = 16


def _places(grams: list[bytes], power: int) -> np.ndarray:
    """Two places in a filter of 2 ** ``power`` bits for each digest."""
    words = np.frombuffer(b"".join(grams), ">u4").reshape(len(grams), 4)[:, :2].astype(np.int64)
    return words & ((1 << power) - 1)


def _filter(items: DataFrame) -> tuple[int, np.ndarray]:
    """A Bloom filter of the items' grams: its power, and its bits; made in blocks on the executors."""
    n = items.count()
    power = min(MOST_FILTER, max(LEAST_FILTER, int(16 * max(n, 1)).bit_length()))
    shift = min(power, 19)

    def places(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = np.unique(_places(batch.column("gram").to_pylist(), power))
            yield pa.RecordBatch.from_arrays([pa.array(at >> shift), pa.array(at & ((1 << shift) - 1))], names=["block", "bit"])

    def packed(table):
        import pyarrow as pa

        bits = np.zeros(1 << shift, np.uint8)
        bits[table.column("bit").to_numpy()] = 1
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    rows = items.select("gram").mapInArrow(places, "block long, bit long").distinct().groupBy("block").applyInArrow(packed, "block long, bits binary").collect()
    out = np.zeros((1 << (power - shift), 1 << (shift - 3)), np.uint8)
    for r in rows:
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return power, out.reshape(-1)


def _windows(df: DataFrame, key: str, sizes: list[int], width: int, whole_items: bool, shared=None) -> DataFrame:
    """(key, size, at, gram): every window of each text, as a digest of its words; with the broadcast filter ``shared``,
    those that may be in it."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *T._parse_datatype_string("size int, at long, gram binary").fields])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            for k, text in zip(batch.column(key).to_pylist(), texts(batch), strict=True):
                words = words_of(text)
                for size in [min(width, len(words))] if whole_items else sizes:
                    count = len(words) - size + 1 if words and size else 0
                    for lo in range(0, max(count, 0), 8192):
                        at = list(range(lo, min(lo + 8192, count)))
                        grams = [hashlib.md5(b" ".join(words[j : j + size])).digest() for j in at]
                        if shared is not None:
                            power, bits = shared.value
                            place = _places(grams, power)
                            maybe = ((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).all(axis=1)
                            at, grams = [at[j] for j in np.flatnonzero(maybe)], [grams[j] for j in np.flatnonzero(maybe)]
                        if grams:
                            yield pa.RecordBatch.from_pydict({key: [k] * len(grams), "size": [size] * len(grams), "at": at, "gram": grams}, schema=pa.schema([(key, batch.schema.field(key).type), ("size", pa.int32()), ("at", pa.int64()), ("gram", pa.binary())]))

    return df.select(key, "text").mapInArrow(run, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__key", F.sha2(F.coalesce("text", F.lit("")), 256))


def _met(keyed: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """(__key, size, at, item_id): the windows of the texts (by their SHA-256) that an item has.

    The way for benchmarks too large to broadcast: a filter of fixed size keeps nearly all other windows where they are,
    the rest meets the items' digests in a shuffle join, a gram of many texts in several parts.  Repeated texts are worked
    once."""
    items = write_table(_windows(benchmark, "item_id", [], width, True).distinct(), "windows")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most ``width`` numbers
    grams = items.select("item_id", "size", "gram").distinct()
    shared = keyed.sparkSession.sparkContext.broadcast(_filter(items))
    once = keyed.groupBy("__key").agg(F.any_value("text").alias("text"))
    asked = write_table(_windows(once, "__key", sizes, width, False, shared).withColumn("salt", F.pmod(F.xxhash64("__key", "at"), F.lit(SALTS))), "asked")
    copies = grams.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = write_table(asked.join(copies, ["size", "gram", "salt"]).select("__key", "size", "at", "item_id").distinct(), "hits")
    drop_table(items), drop_table(asked)
    return met


def _find_by_join(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    keyed = _keyed(docs)
    met = _met(keyed, benchmark, width)
    owners = met.select("__key", F.col("item_id").cast("string").alias("item")).distinct().groupBy("__key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = met.select("__key", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("w")).distinct().groupBy("__key").agg(F.count("*").alias("n_hit"))
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return keyed.join(owners, "__key", "left").join(hits, "__key", "left").select(
        "doc_id",
        F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, width: int = 10, mode: str = "documents", **sizes) -> DataFrame:
    """``docs`` without contaminated documents, or (``mode="spans"``) without their hit words.

    All columns stay, of whatever names; a text cut down to nothing stays as an empty one; null and empty texts are clean
    and stay; repeated rows stay repeated or go together; texts of any length are read whole; an empty table gives no
    rows, and an empty benchmark, or one of null texts, leaves all rows.  A benchmark of any size is taken in either
    mode."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode: {mode}")
    blocks = benchmark_blocks(benchmark, width, **sizes)
    if blocks is None:
        met = _met(_keyed(docs.select("text")), benchmark, width)
        key = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
        if mode == "documents":
            dirty = met.select(F.col("__key").alias("__dirty")).distinct()
            return docs.join(dirty, key == dirty["__dirty"], "left_anti")
        own = met.select("__key", "at", "size").groupBy(F.col("__key").alias("__dirty")).agg(F.collect_set(F.struct("at", "size")).alias("__hits"))
        joined = docs.join(own, key == own["__dirty"], "left").drop("__dirty")
    shared = None if blocks is None else docs.sparkSession.sparkContext.broadcast(blocks)

    def told(batch) -> list[np.ndarray]:
        """The hit words of each text, as the shuffle join has found them."""
        out = []
        for text, spans in zip(texts(batch), batch.column("__hits").to_pylist(), strict=True):
            hit = np.zeros(len(words_of(text)) if spans else 0, bool)
            for s in spans or []:
                hit[s["at"] : s["at"] + s["size"]] = True
            out.append(hit)
        return out

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            values = texts(batch)
            hits = told(batch) if shared is None else [_scan_all(shared.value, t)[1] for t in values]
            if mode == "documents":
                yield batch.filter(pa.array([not len(h) for h in hits], pa.bool_()))
                continue
            new = pa.array([t if t is None or not len(h) else cut(t, h) for t, h in zip(values, hits, strict=True)], pa.binary()).cast(pa.string())
            out = batch.set_column(batch.schema.get_field_index("text"), "text", new)
            yield out if shared is not None else out.drop_columns(["__hits"])

    return (docs if shared is not None else joined).mapInArrow(run, docs.schema)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark; see :func:`find`."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find(docs, benchmark)


OP4_SQL = r"""
WITH tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
         row_number() OVER () AS rid
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM grams
), windows AS (
  SELECT rid, size, k, array_to_string(w[k : k + size - 1], ' ') AS gram
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM tokens, sizes WHERE len(w) >= size)
), met AS (
  SELECT rid, w.size, k, item_id FROM windows w JOIN grams g ON w.size = g.size AND w.gram = g.gram
), hits AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + size)) AS p FROM met) GROUP BY rid
), owners AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM tokens LEFT JOIN hits USING (rid) LEFT JOIN owners USING (rid)
"""
