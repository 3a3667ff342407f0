"""Near copies by resemblance, over the same byte-position index as SimHash.

Two bits of 64 are far less than what a fifth of changed five-word shingles moves: at a Jaccard similarity of 0.8
SimHash fingerprints differ in 8 bits or so at the median, and in up to 14, where eight byte positions guarantee no
match at all.  For documents that shall be dropped at 0.8 the signature is therefore 128 bytes, each the low byte of a
min-wise sample of the shingles: two positions match as often as the documents are similar.  The rest is the method
of :mod:`siltstone.llm.simhash`: an inverted index over byte positions (25 lists by five positions each), a tally of
shared positional bytes for each pair that meets, a least number of matches, and verification, here on the exact
shingle sets.  At 0.8 a pair fails to meet with a chance of 0.00005, and falls below the tally with one of 0.00003.

No list is compared with itself pair by pair.  First a list's members are compared with its first one, in an order that
is another in each list, and those that are not similar enough are dealt again by two more positions, then by four, eight
and so on, so what only shares a passage falls apart in a few rounds, until no list has two members.  That links nearly
all of a class, but it can lose a link: a member that leaves with the first takes its links to the others with it.

So every list is then looked at again.  Where its members have come to different classes, each member outside the list's
largest class (in lists of up to WHOLE members: each member, and each larger class) is compared exactly with that whole
class, shingle set by shingle set, in blocks of bounded size; what that finds joins classes, and it is repeated with the
joined ones until nothing new is found.  In lists of more than WHOLE members, those outside the largest class are also
compared exactly with one another, once, in such blocks.  So any two members of a list are of one class or have been
compared.  In a dense group few members are left outside, so this stays far from all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .store import drop_table, pieces, texts, write_table

WIDTH, SIMILARITY = 5, 0.8
POSITIONS, LISTS, BY = 128, 25, 5
#: Positions by which what did not match is dealt again the first time; twice as many each time after that.
FURTHER = 2
#: Matching positions a pair must have: four standard deviations below what the similarity asked for gives.
SLACK = 4.0
SEED = 42
#: So many nodes (24 bytes each) are broadcast.
MOST_SENT = 200_000
#: Lists in which all classes are compared as wholes (in larger ones member by member); bytes of shingle sets in a block, and of those asked of it.
WHOLE, BLOCK_BYTES, ASKED_BYTES = 64, 4 << 20, 4 << 20


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


_SCALES, _BANDS = _odd(POSITIONS, 11), _odd(POSITIONS, 12)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes, sorted; with fewer words the whole sequence is the only one, without words the empty one."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    n = len(words) - width + 1
    if n < 1:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    parts = []
    for lo in range(0, n, 1 << 16):
        part = words[lo : lo + (1 << 16) + width - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))
        parts.append(np.unique(np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64)))
    return np.unique(np.concatenate(parts))


def samples(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of POSITIONS orders."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[lo : lo + 2048, None] * _SCALES).min(axis=0), out=least)
    return least


def signature(least: np.ndarray) -> bytes:
    return ((least >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def list_keys(least: np.ndarray) -> np.ndarray:
    """The list of each band: a hash of its five samples and its number."""
    rows = (least[: LISTS * BY] * _BANDS[: LISTS * BY]).reshape(LISTS, BY)
    mixed = rows[:, 0]
    for k in range(1, BY):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + rows[:, k]
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def _row_keys(docs: DataFrame, *more) -> DataFrame:
    """__nid and __th, a row's id (null ids behind all others, by their text) and its text's hash, and the columns ``more``."""
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    last = F.lit((1 << 63) - 1) - F.pmod(th, F.lit(1 << 61))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("__nid"), th.alias("__th"), *more)


def _signed(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            least = [samples(shingles(t, width)) for t in texts(batch)]
            keys = pa.array([list_keys(x).tolist() for x in least], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("__nid"), batch.column("__th"), pa.array([signature(x) for x in least], pa.binary()), keys], names=["nid", "th", "sig", "keys"])

    rows = _row_keys(docs, "text").mapInArrow(run, "nid long, th long, sig binary, keys array<long>")
    return rows.withColumn("node", F.xxhash64("sig"))


def _tallied(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs with ``least`` or more equal positions."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, POSITIONS) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= least))

    return pairs.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, similarity: float) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            good = []
            for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, set): the shingles of the document that stands for each of ``nodes`` (node, nid, th).

    Up to MOST_SENT nodes are sent to where the texts are; beyond that, texts and nodes meet in a shuffle join.  Rows that
    are repeated with their id may give a set twice."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        for batch in pieces(batches):
            new = [k for k, n in enumerate(batch.column("node").to_pylist()) if not (n in seen or seen.add(n))]
            batch = batch.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingles(t, width).tobytes() for t in texts(batch)], pa.binary())], names=["node", "set"])

    few = nodes.count() <= MOST_SENT
    rows = _row_keys(docs, "text").join(F.broadcast(nodes) if few else nodes, (F.col("__nid") == F.col("nid")) & (F.col("__th") == F.col("th")))
    return rows.select("node", "text").mapInArrow(run, "node long, set binary")


def _with(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """``pairs`` (a, b) with ``value`` of both nodes."""
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("node").alias(side), F.col(value).alias(f"{value}_{side}")), side)
    return pairs


def first_near(asked: list[np.ndarray], members: list[np.ndarray], similarity: float) -> list[int]:
    """For each of ``asked``, the first of ``members`` (sorted shingle sets) that is similar enough, -1 if none is."""
    return [int(near[0]) if len(near) else -1 for near in all_near(asked, members, similarity)]


def all_near(asked: list[np.ndarray], members: list[np.ndarray], similarity: float) -> Iterator[np.ndarray]:
    """For each of ``asked``, those of ``members`` (sorted shingle sets) that are similar enough.

    The members' shingles are an index that each of ``asked`` is looked up in; nothing is held for all pairs at once."""
    sizes = np.array([len(m) for m in members])
    hashes, owner = np.concatenate(members), np.repeat(np.arange(len(members), dtype=np.int32), sizes)
    by = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[by], owner[by]
    for x in asked:
        lo, hi = np.searchsorted(hashes, x, "left"), np.searchsorted(hashes, x, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shared = np.bincount(owner[at], minlength=len(members))
        yield np.flatnonzero(shared >= similarity * (len(x) + sizes - shared) - 1e-9)


def _crossed(asked: DataFrame, placed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): a link of each of ``asked`` (node, other) into the class ``other``, by classes ``placed`` (node, root)."""
    bytes_of = F.sum(F.octet_length("set"))
    members = placed.join(asked.select(F.col("other").alias("root")).distinct(), "root", "left_semi").join(sets, "node").select(F.col("root").alias("other"), "node", "set")
    queries = asked.toDF("node", "other").join(sets.toDF("node", "set"), "node").select("other", "node", "set")
    parts = write_table(members.groupBy("other").agg(F.ceil(bytes_of / BLOCK_BYTES).alias("parts")), "parts")
    waves = write_table(queries.groupBy("other").agg(F.ceil(bytes_of / ASKED_BYTES).alias("waves")), "waves")
    many, same = parts.join(waves, "other"), parts.toDF("other", "parts").join(waves.toDF("other", "waves"), "other")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = members.join(many, "other").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("wave", each("waves"))
    right = queries.join(same, "other").withColumn("wave", F.pmod(F.xxhash64("node"), F.col("waves"))).withColumn("part", each("parts"))

    def run(held, asking):
        import pyarrow as pa

        a, b = [], []
        if held.num_rows and asking.num_rows:
            own, theirs = ([np.frombuffer(x, np.uint64) for x in side.column("set").to_pylist()] for side in (held, asking))
            nodes = held.column("node").to_pylist()
            for query, k in zip(asking.column("node").to_pylist(), first_near(theirs, own, similarity), strict=True):
                if k >= 0:
                    a.append(query), b.append(nodes[k])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    names = ("other", "part", "wave", "node", "set")
    return left.select(*names).groupBy("other", "part", "wave").cogroup(right.select(*names).groupBy("other", "part", "wave")).applyInArrow(run, "a long, b long")


def _between(outside: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between members of one list (key, node, root) whose classes differ, as many as join them in a block."""
    rows = outside.join(sets, "node")
    parts = write_table(rows.groupBy("key").agg(F.ceil(F.sum(F.octet_length("set")) / BLOCK_BYTES).alias("parts")), "parts")
    rows = rows.join(parts, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    # Each two blocks meet once: the earlier one is held, the later one (or the same) asks.
    left = rows.withColumn("part", F.col("own")).withColumn("wave", F.explode(F.sequence(F.col("own"), F.col("parts") - 1)))
    right = rows.toDF(*rows.columns).withColumn("wave", F.col("own")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own"))))

    def run(held, asking):
        import pyarrow as pa

        a, b, joined = [], [], {}

        def of(root: int) -> int:
            while (up := joined.get(root, root)) != root:
                joined[root] = joined.get(up, up)
                root = up
            return root

        if held.num_rows and asking.num_rows:
            own, theirs = ([np.frombuffer(x, np.uint64) for x in side.column("set").to_pylist()] for side in (held, asking))
            nodes, roots = held.column("node").to_pylist(), held.column("root").to_numpy()
            for query, root, near in zip(asking.column("node").to_pylist(), asking.column("root").to_pylist(), all_near(theirs, own, similarity), strict=True):
                others, first = np.unique(roots[near], return_index=True)
                for other, k in zip(others.tolist(), first.tolist(), strict=True):
                    if (x := of(root)) != (y := of(other)):
                        joined[x] = y
                        a.append(query), b.append(nodes[near[k]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    names = ("key", "part", "wave", "node", "root", "set")
    return left.select(*names).groupBy("key", "part", "wave").cogroup(right.select(*names).groupBy("key", "part", "wave")).applyInArrow(run, "a long, b long")


def _outside(bands: DataFrame, placed: DataFrame) -> DataFrame:
    """(key, node, root): in each list of more than WHOLE members, those outside its largest class, if of several classes."""
    own = bands.join(placed, "node").select("key", "node", "root")
    here = own.groupBy("key", "root").agg(F.count("*").alias("n"))
    lists = here.groupBy("key").agg(F.sum("n").alias("members"), F.count("*").alias("classes"), F.max_by("root", F.struct("n", "root")).alias("largest"))
    return own.join(lists.where((F.col("members") > WHOLE) & (F.col("classes") > 2)), "key").where("root <> largest").select("key", "node", "root")


def _apart(bands: DataFrame, placed: DataFrame) -> DataFrame:
    """(node, other, size): the classes that each node has met in a list without belonging to them.

    Lists of two have been compared.  In a list of up to WHOLE members all larger classes (by members there) count, in
    others the largest one; :func:`_between` compares the rest of those."""
    own = bands.join(placed, "node").select("key", "node", "root")
    here = own.groupBy("key", "root").agg(F.count("*").alias("n"))
    lists = here.groupBy("key").agg(F.sum("n").alias("members"), F.count("*").alias("classes"), F.max_by("root", F.struct("n", "root")).alias("largest")).where("classes > 1 AND members > 2")
    lists = write_table(lists, "apart")
    outside = own.join(lists, "key").where("root <> largest").select("node", F.col("largest").alias("other"))
    small = lists.where(F.col("members") <= WHOLE).select("key")
    classes = here.join(small, "key").select("key", F.col("root").alias("other"), F.col("n").alias("other_n"))
    mine = own.join(here, ["key", "root"]).join(classes, "key").where((F.col("other") != F.col("root")) & (F.struct("other_n", "other") > F.struct("n", "root")))
    sizes = placed.groupBy(F.col("root").alias("other")).agg(F.count("*").alias("size"))
    return outside.unionByName(mine.select("node", "other")).distinct().join(sizes, "other").select("node", "other", "size")


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` (doc_id, text and any more columns) with one row of each class of near copies.

    Classes are the components of "the sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or
    more".  The row with the smallest doc_id stays (a null id only where the class has no other), of several with that
    id the one with the smallest text hash, of fully repeated rows a single one.  Null, empty and blank texts are one
    class; texts of any length are read whole; an empty table gives no rows."""
    signed = write_table(_signed(docs, width), "signatures")
    best = write_table(signed.groupBy("node").agg(F.min(F.struct("nid", "th")).alias("best")).select("node", "best.nid", "best.th"), "nodes")
    chosen = signed.join(best.select(F.col("node").alias("__n"), F.col("nid").alias("__i"), F.col("th").alias("__t")), (F.col("node") == F.col("__n")) & (F.col("nid") == F.col("__i")) & (F.col("th") == F.col("__t")), "left_semi")
    spread = write_table(signed.select("node", F.explode("keys").alias("key")).distinct(), "postings")
    bands = write_table(spread.join(spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key").select("node", "key"), "bands")
    drop_table(spread)
    postings, scratch = bands, []
    least = int(POSITIONS * similarity - SLACK * (POSITIONS * similarity * (1 - similarity)) ** 0.5)
    links, sigs, sets, more = None, None, None, FURTHER
    while True:
        turned = F.xxhash64("key")  # an order of its own for each list, which can be turned back
        firsts = postings.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(turned)).alias("least"), F.count("*").alias("n")).where("n > 1")
        lists = write_table(firsts.select("key", F.col("least").bitwiseXOR(turned).alias("first")), "lists")
        if lists.isEmpty():
            break
        if sigs is None:
            asked = bands.select("node").distinct()
            sigs = write_table(chosen.join(asked, "node", "left_semi").select("node", "sig").dropDuplicates(["node"]), "sigs")
        members = write_table(postings.join(lists, "key").where("node <> first"), "members")
        pairs = members.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
        near = write_table(_tallied(_with(pairs, sigs, "sig"), least), "tallied")
        asked = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if sets is not None:
            asked = asked.join(sets.select("node"), "node", "left_anti")
        asked = write_table(best.join(asked, "node"), "asked")
        if not asked.isEmpty():
            new = write_table(_sets(docs, asked, width), "sets")
            scratch.append(new)
            sets = new if sets is None else sets.unionByName(new)
        # Without any set no pair was near.
        good = near if sets is None else write_table(_verified(_with(near, sets, "set"), similarity).distinct(), "links")
        scratch.append(good)
        links = good if links is None else links.unionByName(good)
        failed = members.join(good.select(F.col("a").alias("first"), F.col("b").alias("node")), ["first", "node"], "left_anti")
        byte = [F.substring("sig", (F.pmod(F.xxhash64("key", F.lit(more + k)), F.lit(POSITIONS)) + 1).cast("int"), F.lit(1)) for k in range(more)]
        before, postings = postings, write_table(failed.join(sigs, "node").select("node", F.xxhash64("key", *byte).alias("key")), "postings")
        for table in [lists, members, asked, *([near] if near is not good else []), *([before] if before is not bands else [])]:
            drop_table(table)
        more = min(2 * more, POSITIONS)
    if links is None:
        keepers = best.select("nid", "th")
    else:
        roots, done = connected_components(links), None
        while True:
            rooted = best.select("node", "nid", "th").join(roots.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").select("node", "nid", "th", F.coalesce("root", "node").alias("root"))
            placed = write_table(rooted, "placed")
            scratch.append(placed)
            apart = _apart(bands, placed.select("node", "root"))
            # Once is enough: classes only grow, so members that have been compared need not be again.
            outside = write_table(_outside(bands, placed.select("node", "root")), "outside") if done is None else None
            apart = write_table(apart if done is None else apart.join(done, ["node", "other", "size"], "left_anti"), "meet")
            scratch.append(apart)
            if apart.isEmpty():
                break  # a list with members outside has some that meet its largest class
            done = apart if done is None else done.unionByName(apart)
            wanted = apart.select("node").union(placed.join(apart.select(F.col("other").alias("root")).distinct(), "root", "left_semi").select("node")).distinct()
            asked = write_table(best.join(wanted if sets is None else wanted.join(sets.select("node"), "node", "left_anti"), "node"), "asked")
            if not asked.isEmpty():
                new = write_table(_sets(docs, asked, width), "sets")
                scratch.append(new)
                sets = new if sets is None else sets.unionByName(new)
            found = _crossed(apart.select("node", "other"), placed.select("node", "root"), sets.dropDuplicates(["node"]), similarity)
            if outside is not None:
                scratch.append(outside)
                found = found if outside.isEmpty() else found.unionByName(_between(outside, sets.dropDuplicates(["node"]), similarity))
            found = write_table(found, "links")
            scratch += [asked, found]
            if found.isEmpty():
                break
            links = links.unionByName(found)
            roots = connected_components(links)
        keepers = placed.groupBy("root").agg(F.min(F.struct("nid", "th")).alias("k")).select("k.nid", "k.th")
    # Rows that are repeated with id and text are counted here, so that only those have to meet.
    again = signed.groupBy("nid", "th").agg((F.count("*") > 1).alias("repeated"))
    kept = write_table(keepers.join(again, ["nid", "th"]), "kept")
    for table in [signed, best, bands, sigs, *scratch]:
        if table is not None:
            drop_table(table)
    rows = _row_keys(docs, F.struct(*docs.columns).alias("row")).join(kept, (F.col("__nid") == F.col("nid")) & (F.col("__th") == F.col("th")))
    out = rows.where("NOT repeated").select("row.*")
    if kept.where("repeated").isEmpty():
        return out
    return out.unionByName(rows.where("repeated").groupBy("__nid", "__th").agg(F.any_value("row").alias("row")).select("row.*"))
