"""Removal of long repeated byte strings, by sorting suffixes of what may repeat.

Every 200-byte string has an owner inside it: the position whose 48 bytes have the smallest hash.  Neighbouring
strings share owners, so a text falls into units (an owner and the strings that are its own).  Equal strings have
owners at the same place in them, hence:

1. Units are counted by the hash of the owner's 48 bytes (the bucket) and of the whole unit.  Where a unit's bytes are
   there twice, all of its strings are repeated; where a bucket has one unit, none is.
2. Only units left, whose owner repeats but whose bytes differ, need comparing.  Bucket by bucket the suffixes that
   start at the owners are sorted, and the prefixes before them, read backwards.  The sort is deep-shallow: multikey
   quicksort by 8-byte characters down to a shallow depth, then the ranges that still agree (long common prefixes) are
   ordered by blind tries.  Two units share the string with l bytes before the owner if they are in one class of
   backward prefixes of l bytes and in one class of suffixes of 200 - l bytes; classes are runs of the sorted orders.
3. A bucket with more different units than a task should hold is dealt by whole strings instead: the strings themselves
   meet, reduced in each task before they are shuffled, so that no bucket has to fit one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import drop_table, pieces, texts, write_table

LENGTH, GRAM = 200, 48
CHUNK = 1 << 20
SHALLOW = 64
#: More different units than this in one bucket (about 40 MB of a task) meet string by string.
LARGE_BUCKET = 65_536

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, CHUNK + 2 * LENGTH), _powers(_INVERSE, CHUNK + 2 * LENGTH)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=out[1:])
    return out


def _hash_between(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return _mix((sums[stop] - sums[start]) * _DOWN[start])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - have : len(x) - width + 1 + width - have])


def units(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, count, lead, gram hash, unit hash) of each unit of a text, in chunks of it; the owner stands ``lead`` bytes after the start.

    A unit's strings start at ``start`` ... ``start + count - 1``; its bytes end ``length`` after the last of them."""
    total = len(data) - length + 1
    step = CHUNK
    for lo in range(0, total, step):
        n = min(step, total - lo)
        part = data[lo : lo + n + length - 1]
        sums = _prefix_sums(part)
        place = np.arange(len(part) - gram + 1)
        grams = _mix((sums[gram:] - sums[:-gram]) * _DOWN[: len(place)])
        # The place stands in the low bits: the leftmost of equal hashes wins.
        keys = (grams & ~np.uint64((1 << 21) - 1)) | place.astype(np.uint64)
        owner = (_sliding_min(keys, length - gram + 1) & np.uint64((1 << 21) - 1)).astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
        count = np.diff(np.append(start, n))
        at = owner[start]
        whole = _hash_between(sums, start, start + count - 1 + length) ^ _mix((at - start).astype(np.uint64) * np.uint64(1 << 32) + count.astype(np.uint64))
        yield start + lo, count, at - start, grams[at], whole


def deep_shallow(rows: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """An order of the rows (of bytes) in which, within each group, rows with a common prefix stand together.

    Multikey quicksort with 8-byte characters: all open ranges are partitioned by their next character at once, and
    ranges of one row, or of two, which need no order, are closed.  From ``shallow`` on open ranges go to blind tries."""
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    _, owner = np.unique(group[order], return_inverse=True)
    open_ = np.arange(len(order))  # places in ``order`` that are in open ranges, ranges in a row
    large = np.bincount(owner)[owner] > 2
    open_, owner = open_[large], owner[large]
    for depth in range(min(shallow, rows.shape[1]) // 8):
        if not len(open_):
            return order
        character = words[order[open_], depth]
        by = np.lexsort((character, owner))
        order[open_] = order[open_[by]]
        character, owner = character[by], owner[by]
        owner = np.cumsum(np.concatenate([[True], (owner[1:] != owner[:-1]) | (character[1:] != character[:-1])])) - 1
        large = np.bincount(owner)[owner] > 2
        open_, owner = open_[large], owner[large]
    if len(open_) and shallow < rows.shape[1]:  # else the rows of a range are equal
        for places in np.split(open_, np.flatnonzero(np.diff(owner)) + 1):
            order[places] = blind_trie(rows, order[places], shallow)
    return order


def blind_trie(rows: np.ndarray, members: np.ndarray, depth: int) -> np.ndarray:
    """Members of one range, which agree on ``depth`` bytes, so ordered that common prefixes stand together.

    A blind trie keeps of each branch only where it branches and the byte there.  It is grown from the first member:
    all others are compared with it, and those that leave it at one place with one byte are a branch of their own.
    Branches are read from the deepest on, so whatever shares more with the first member stands nearer to it."""
    out: list[int] = []
    stack = [members]
    while stack:
        range_ = stack.pop()
        out.append(int(range_[0]))
        rest = range_[1:]
        if not len(rest):
            continue
        differs = rows[rest, depth:] != rows[range_[0], depth:]
        branch = np.where(differs.any(axis=1), depth + differs.argmax(axis=1), rows.shape[1])
        byte = np.where(branch < rows.shape[1], rows[rest, np.minimum(branch, rows.shape[1] - 1)], 0)
        key = branch.astype(np.int64) * 256 + byte
        by = np.argsort(key, kind="stable")  # shallow branches first, as the stack is read from its end
        parts = np.split(rest[by], np.flatnonzero(np.diff(key[by])) + 1)
        if branch.max() == rows.shape[1]:  # equal rows
            out += parts.pop().tolist()
        stack += parts
    return np.array(out, np.int64)


def _classes(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by deep-shallow sort, and how many bytes each row shares with the one before it (-1: another group)."""
    order = deep_shallow(rows, group)
    common = np.full(len(rows), -1, np.int64)
    for lo in range(1, len(rows), 8192):
        at = np.arange(lo, min(lo + 8192, len(rows)))
        differs = rows[order[at]] != rows[order[at - 1]]
        shared = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
        common[at] = np.where(group[order[at]] == group[order[at - 1]], shared, -1)
    return order, common


def _padded(n: int) -> int:
    return -(-n // 8) * 8


def compare_units(bucket: np.ndarray, pieces: list[bytes], lead: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each unit, which of its strings another unit of its bucket has too."""
    sizes = np.array([len(p) for p in pieces])
    strings = sizes - length + 1
    offset = np.cumsum(sizes) - sizes
    data = np.concatenate([np.zeros(length, np.uint8), np.frombuffer(b"".join(pieces), np.uint8), np.zeros(2 * length, np.uint8)])
    owner = offset + lead + length
    after = np.arange(_padded(length))
    suffixes = np.where(after < (sizes - lead)[:, None], data[owner[:, None] + np.minimum(after, length)], 0).astype(np.uint8)
    back = np.arange(_padded(max(int(lead.max()), 1)))
    prefixes = np.where(back < lead[:, None], data[owner[:, None] - 1 - np.minimum(back, length - 1)], 0).astype(np.uint8)
    right, right_common = _classes(suffixes, bucket)
    left, left_common = _classes(prefixes, bucket)
    lowest = lead - strings + 1  # a unit's own strings have lowest ... lead bytes before the owner
    same = [np.zeros(s, bool) for s in strings]
    right_class, left_class = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
    for before in range(int(max(lowest.min(), 0)), int(lead.max()) + 1):
        has = np.flatnonzero((lowest <= before) & (lead >= before))
        if len(has) < 2:
            continue
        right_class[right] = np.cumsum(right_common < length - before)
        left_class[left] = np.cumsum(left_common < before)
        key = right_class[has] * (len(pieces) + 1) + left_class[has]
        by = np.argsort(key, kind="stable")
        twin = key[by][1:] == key[by][:-1]
        for k in has[by[np.concatenate([twin, [False]]) | np.concatenate([[False], twin])]].tolist():
            same[k][lead[k] - before] = True
    return same


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the key of a document's content (id and text), and the text; equal rows share a key."""
    text = F.coalesce("text", F.lit(""))
    own = F.struct(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("doc_id", text).alias("th"))
    return docs.select("doc_id", own.alias("k"), text.alias("text")).select("doc_id", "k.id", "k.th", "text")


def _all_units(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            ids, ths = (batch.column(c).to_numpy() for c in ("id", "th"))
            parts: list[list[np.ndarray]] = []
            for i, th, text in zip(ids, ths, texts(batch), strict=True):
                if len(text) < length:
                    continue
                for start, count, lead, bucket, whole in units(np.frombuffer(text, np.uint8), length, gram):
                    n = len(start)
                    parts.append([bucket.view(np.int64), whole.view(np.int64), np.full(n, i), np.full(n, th), start, count.astype(np.int16), lead.astype(np.int16)])
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in ("i8", "i8", "i8", "i8", "i8", "i2", "i2")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "unit", "id", "th", "start", "count", "lead"])

    return docs.select("id", "th", "text").mapInArrow(run, "bucket long, unit long, id long, th long, start long, count short, lead short")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, large: int = LARGE_BUCKET) -> DataFrame:
    """(id, th, starts, counts): per keyed document, runs of starting places whose strings are repeated."""
    found = write_table(_all_units(docs, length, gram), "units")
    # Stored, not only planned: a join of two stored sides is one whose hot buckets AQE can split.
    repeated = write_table(found.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("bucket").alias("__bucket")), "repeated")
    every, found = found, write_table(found.join(repeated, found["bucket"] == repeated["__bucket"], "left_semi"), "repeated-units")
    drop_table(every), drop_table(repeated)
    sign = F.xxhash64("id", "th", "start")
    sizes = write_table(found.groupBy("bucket", "unit").agg(F.count("*").alias("n"), F.min(sign).alias("sign")), "unit-sizes")
    kinds = write_table(sizes.groupBy("bucket").agg(F.count("*").alias("kinds")), "kinds")
    state = write_table(sizes.join(kinds, "bucket").select(F.col("bucket").alias("__bucket"), F.col("unit").alias("__unit"), "n", "sign", "kinds"), "state")
    marked = found.join(state, (F.col("bucket") == F.col("__bucket")) & (F.col("unit") == F.col("__unit"))).select("bucket", "id", "th", "start", "count", "lead", (F.col("n") > 1).alias("full"), "kinds", (sign == F.col("sign")).alias("chosen"))
    marked = write_table(marked, "marked")
    for table in (found, sizes, kinds, state):
        drop_table(table)
    whole = marked.where("full").select("id", "th", "start", F.col("count").cast("int").alias("count"))
    # Of a unit that is there twice one copy takes part in the comparison, of all others their only one.
    asked = marked.where("kinds > 1 AND (NOT full OR chosen)")
    per_doc = asked.groupBy("id", "th").agg(F.collect_set(F.struct("bucket", "start", "count", "lead", "full", "kinds")).alias("asked"))
    pieces = write_table(_pieces(per_doc.join(docs.select("id", "th", "text"), ["id", "th"]), length), "pieces")
    compared = _compare(pieces.where(F.col("kinds") <= large), length)
    counted = _count(pieces.where(F.col("kinds") > large), length)
    return whole.unionByName(compared).unionByName(counted)


def _pieces(rows: DataFrame, length: int) -> DataFrame:
    """The bytes of each unit that is asked for."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("lead", pa.int16()), ("full", pa.bool_()), ("kinds", pa.int64()), ("bytes", pa.binary())])
        for batch in pieces(batches):
            for i, th, asked, text in zip(batch.column("id").to_pylist(), batch.column("th").to_pylist(), batch.column("asked"), texts(batch), strict=True):
                one = pa.RecordBatch.from_struct_array(asked.values)
                start, count = one.column("start").to_pylist(), one.column("count").to_pylist()
                data = [text[s : s + c - 1 + length] for s, c in zip(start, count, strict=True)]
                yield pa.RecordBatch.from_arrays([one.column("bucket"), pa.array([i] * len(data), pa.int64()), pa.array([th] * len(data), pa.int64()), one.column("start"), one.column("lead"), one.column("full"), one.column("kinds"), pa.array(data, pa.binary())], schema=schema)

    return rows.select("id", "th", "asked", "text").mapInArrow(run, "bucket long, id long, th long, start long, lead short, full boolean, kinds long, bytes binary")


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of consecutive numbers."""
    first = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1])
    return at[first], np.diff(np.append(first, len(at)))


def _compare(pieces: DataFrame, length: int) -> DataFrame:
    """Buckets are dealt to tasks and sorted there; a task holds a run of whole buckets at a time."""
    dealt = pieces.repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            bucket = np.array([r[0] for r in rows])
            out: list[tuple] = []
            for r, same in zip(rows, compare_units(bucket, [r[5] for r in rows], np.array([r[6] for r in rows], np.int64), length), strict=True):
                if not r[4] and same.any():
                    out += [(r[1], r[2], r[3] + int(a), int(n)) for a, n in zip(*_runs(np.flatnonzero(same)), strict=True)]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int32())], names=["id", "th", "start", "count"])

        held: list[tuple] = []
        size = 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("bucket", "id", "th", "start", "full", "bytes", "lead"))
            for row in zip(*columns, strict=True):
                if size > CHUNK and held[-1][0] != row[0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield solve(held)

    return dealt.drop("kinds").mapInArrow(run, "id long, th long, start long, count int")


def _count(pieces: DataFrame, length: int) -> DataFrame:
    """Strings of very large buckets, byte by byte: equal ones are reduced in each task before they are shuffled."""

    def strings(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = list(zip(batch.column("id").to_pylist(), batch.column("th").to_pylist(), batch.column("start").to_pylist(), batch.column("full").to_pylist(), batch.column("bytes").to_pylist(), strict=True))
            for lo in range(0, len(rows), 64):
                out = [(i, th, s + k, full, data[k : k + length]) for i, th, s, full, data in rows[lo : lo + 64] for k in range(len(data) - length + 1)]
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["id", "th", "start", "full", "string"])

    every = pieces.select("id", "th", "start", "full", "bytes").mapInArrow(strings, "id long, th long, start long, full boolean, string binary")
    twice = every.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    return every.where("NOT full").join(twice, "string").select("id", "th", "start", F.lit(1).alias("count"))


def covered(starts: np.ndarray, counts: np.ndarray, n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the strings cover."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], starts[order] + counts[order] - 1 + length
    out: list[tuple[int, int]] = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if out and x <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], y)
        else:
            out.append((x, y))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, large: int = LARGE_BUCKET) -> DataFrame:
    """doc_id, kept (the bytes left), n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs`` (doc_id, text).

    Null texts are empty; texts under ``length`` bytes lose nothing; equal rows repeat each other and lose all that is
    long enough; null ids are ids of their own text; texts of any length are read in chunks; columns beside doc_id and text
    are left out under whatever name; an empty table gives no rows."""
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, length, gram, large)
    per_doc = spans.groupBy("id", "th").agg(F.collect_set(F.struct("start", "count")).alias("runs"))
    rows = keyed.join(per_doc, ["id", "th"], "left").select("doc_id", "text", F.col("runs.start").alias("starts"), F.col("runs.count").alias("counts"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            out = {"kept": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for k, text in enumerate(texts(batch)):
                starts = batch.column("starts")[k]
                runs = covered(starts.values.to_numpy(), batch.column("counts")[k].values.to_numpy(), len(text), length) if starts.is_valid else []
                edges = [0, *(x for run in runs for x in run), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else text
                out["kept"].append(kept), out["n_bytes"].append(len(text)), out["n_removed"].append(len(text) - len(kept))
                out["n_spans"].append(len(runs)), out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=["doc_id", *out])

    fields = T._parse_datatype_string("kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string").fields
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *fields]))


def op7_repeated_substrings(spark, sf_dir: str) -> DataFrame:
    """What every document loses; see :func:`remove_repeats`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).drop("kept")
