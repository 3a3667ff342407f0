"""Near duplicates by SimHash: a byte-position inverted index with count filtering.

A fingerprint is eight bytes, thus eight (position, byte) postings.  Two fingerprints that differ in at most two bits
differ in at most two bytes, so they share at least six postings: that is the guaranteed minimum.  Lists of a single
byte would hold a 256th of all fingerprints each and their tallies grow with the square of the corpus; the index is
therefore kept by four positions at once, two of the four pairs of neighbouring positions: two bytes that differ touch at
most two pairs, so two fingerprints to be linked meet in at least one of the six lists each of them is in.

Within a list the shared positional bytes of each pair are tallied, pairs that reach six are retained and verified on
their bits.  A list of many members is tallied through its own index: what shares six bytes differs in the list's four
free bytes by a small mask, so each member's neighbours are looked up, never all pairs.  Lists beyond LARGE members are
dealt again by two of their four free positions; what is left free are two bytes, so such a list has 65,536 members at
most, however many documents there are.  Each list gives only a spanning forest of its links, which keeps all components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import connected_components
from .store import write_table

SEED = 42
BLOCK = 255 * 64
#: Lists of so many members are tallied pair by pair; those with more than LARGE are dealt again.
SMALL, LARGE = 64, 65_536


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits; bit 0 is the highest."""
    counts = np.zeros(64, np.int64)
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for lo in range(0, len(raw), BLOCK):
        part = raw[lo : lo + BLOCK]
        pad = -len(part) % 255
        if pad:
            part = np.concatenate([part, np.zeros((pad, 8), np.uint8)])
        lanes = np.unpackbits(part, axis=1).view(np.uint64).reshape(-1, 255, 8)
        counts += lanes.sum(axis=1).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The 64-bit SimHash of a whole text's word shingles; 0 without words (null and empty texts too)."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxh64_intdigest(b" ".join(words), SEED)
    counts, n = np.zeros(64, np.int64), len(words) - width + 1
    for lo in range(0, n, 1 << 16):
        part = words[lo : lo + (1 << 16) + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))
        counts += _bit_counts(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64))
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", width: int = 3, name: str = "fp") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the fingerprint as a signed long."""
    frame = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from siltstone.llm.store import pieces, texts

        for batch in pieces(batches):
            values = np.fromiter((fingerprint(t, width) for t in texts(batch, "__text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(values.view(np.int64))], names=[*keep, name])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[:-1], T.StructField(name, T.LongType())]))


def _masks(bits: int, free: list[int]) -> np.ndarray:
    """What two fingerprints may differ by within the ``free`` positions (0: the lowest byte)."""
    places = [8 * p + k for p in free for k in range(8)]
    return np.array([sum(1 << b for b in c) for k in range(1, bits + 1) for c in combinations(places, k)], np.uint64)


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes are shared by each of ``a`` with each of ``b``."""
    shared = np.zeros((len(a), len(b)), np.uint8)
    for p in range(8):
        shift = np.uint64(8 * p)
        shared += ((a[:, None] >> shift) & np.uint64(0xFF)) == ((b[None, :] >> shift) & np.uint64(0xFF))
    return shared


def list_links(members: np.ndarray, free: list[int], bits: int = 2) -> list[tuple[int, int]]:
    """A spanning forest of one list's links, as pairs of member indexes; ``free``: the positions its members may differ in."""
    parent, links = list(range(len(members))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(pairs: Iterator[tuple[int, int]]) -> None:
        for i, j in pairs:
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, j))

    if len(members) <= SMALL:
        retained = np.argwhere(np.triu(tally(members, members) >= 8 - bits, 1))
        differ = members[retained[:, 0]] ^ members[retained[:, 1]]
        link(retained[np.bitwise_count(differ) <= bits].tolist())
        return links
    order = np.argsort(members, kind="stable")
    value = members[order]
    for mask in _masks(bits, free):  # a mask of two bits leaves at least six bytes shared
        other = value ^ mask
        at = np.minimum(np.searchsorted(value, other), len(value) - 1)
        hit = np.flatnonzero((value[at] == other) & (other > value))
        link(zip(order[hit].tolist(), order[at[hit]].tolist(), strict=True))
    return links


def _kept(positions: tuple[int, ...]) -> int:
    """The signed mask of the bytes at ``positions``."""
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


#: The positions that the members of a list share, by the list's number: first the six of four positions each, then, six
#: for each of them, those of six that large ones are dealt into.
_FOURS = [tuple(p for k in pairs for p in (2 * k, 2 * k + 1)) for pairs in combinations(range(4), 2)]
SHARED = [*_FOURS, *(four + two for four in _FOURS for two in combinations([p for p in range(8) if p not in four], 2))]


def _dealt(marked: DataFrame, lists: list[int]) -> DataFrame:
    """(list, rest, fp): each fingerprint in the lists with those numbers."""
    keys = F.array(*(F.struct(F.lit(k).cast("byte").alias("list"), F.col("fp").bitwiseAND(F.lit(_kept(SHARED[k])).cast("long")).alias("rest")) for k in lists))
    return marked.select("fp", F.explode(keys).alias("p")).select("p.list", "p.rest", "fp")


def _list_links(postings: DataFrame, bits: int, large: int | None) -> DataFrame:
    """(a, b, list): the links of each list; of lists with more than ``large`` members each member and the list's number.

    Lists lie together in sorted tasks and are read one after another; ``large`` members at most are held."""
    dealt = postings.repartition("list", "rest").sortWithinPartitions("list", "rest")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(a: np.ndarray, b: np.ndarray, k: int | None) -> pa.RecordBatch:
            number = pa.nulls(len(a), pa.int32()) if k is None else pa.array(np.full(len(a), k, np.int32))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), number], names=["a", "b", "list"])

        def solve(number: int, members: np.ndarray) -> pa.RecordBatch:
            found = np.array(list_links(members, [p for p in range(8) if p not in SHARED[number]], bits), np.int64).reshape(-1, 2)
            return out(members[found[:, 0]], members[found[:, 1]], None)

        held: list[np.ndarray] = []
        at, size, over = None, 0, False
        for batch in batches:
            number, rest = batch.column("list").to_numpy(), batch.column("rest").to_numpy()
            fp = batch.column("fp").to_numpy().view(np.uint64)
            edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(rest) != 0)) + 1 if len(fp) else []
            left, right = [], []
            for lo, hi in zip([0, *edges], [*edges, len(fp)], strict=True) if len(fp) else ():
                key = int(number[lo]), int(rest[lo])
                if key != at:
                    if size > 1 and not over:
                        yield solve(at[0], np.concatenate(held))
                    held, at, size, over = [], key, 0, False
                if hi - lo == 2 and hi < len(fp) and not size:  # nearly all lists of more than one
                    left.append(fp[lo]), right.append(fp[lo + 1])
                    at = None
                    continue
                size += hi - lo
                if over:
                    yield out(fp[lo:hi], fp[lo:hi], at[0])
                    continue
                held.append(fp[lo:hi])
                if large is not None and size > large:
                    whole, held, over = np.concatenate(held), [], True
                    yield out(whole, whole, at[0])
            if left:
                a, b = np.array(left), np.array(right)
                shared = sum((((a ^ b) >> np.uint64(8 * p)) & np.uint64(0xFF)) == 0 for p in range(8))
                good = (shared >= 8 - bits) & (np.bitwise_count(a ^ b) <= bits)
                yield out(a[good], b[good], None)
        if size > 1 and not over:
            yield solve(at[0], np.concatenate(held))

    return dealt.mapInArrow(run, "a long, b long, list int")


def links(distinct: DataFrame, bits: int = 2, large: int | None = None) -> DataFrame:
    """Pairs (a, b) of fingerprints that keep every component of "at most ``bits`` bits differ" (bits <= 2)."""
    if bits not in (1, 2):
        raise ValueError("a list's free bytes must not be more than bits can differ in: bits is 1 or 2")
    first = write_table(_list_links(_dealt(distinct, list(range(6))), bits, LARGE if large is None else large), "list-links")
    found = first.where("list IS NULL").select("a", "b")
    for k in sorted(r["list"] for r in first.where("list IS NOT NULL").select("list").distinct().collect()):  # six at most
        members = first.where(F.col("list") == k).select(F.col("a").alias("fp"))
        found = found.unionByName(_list_links(_dealt(members, list(range(6 + 6 * k, 12 + 6 * k))), bits, None).select("a", "b"))
    return found


def classes(marked: DataFrame, bits: int = 2, id_col: str = "doc_id") -> DataFrame:
    """(fp, component_id): of each distinct fingerprint of ``marked`` (id_col, fp), the smallest id reachable.

    Equal fingerprints are one node, so exact copies never meet pairwise.  Null ids are no candidates for
    component_id unless a component has no other (then null)."""
    # As many parts as a shuffle has: the nodes are few and small, but each is dealt into six lists.
    parts = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = write_table(marked.groupBy("fp").agg(F.min(id_col).alias("least")).repartition(parts, "fp"), "nodes")
    roots = connected_components(links(nodes.select("fp"), bits))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(nodes["fp"], "least", F.coalesce("root", nodes["fp"]).alias("root"))
    rooted = write_table(rooted, "rooted")
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(best, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows stay
    repeated; texts of any length are hashed whole, in blocks; an empty table gives no rows."""
    marked = write_table(fingerprints(docs, ["doc_id"], width=width), "fingerprints")
    return marked.join(classes(marked, bits), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of every document; see :func:`near_duplicates`."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
