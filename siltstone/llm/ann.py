"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Vectors get one more component that makes all norms equal, so the largest inner product is the smallest distance.
Centroids are fitted on a sample that grows with the lists, with a penalty for full clusters; every vector goes to its
nearest list, and at a boundary to one more list whose centroid lies in another direction.  A query walks a graph of the
centroids in memory and reads the lists whose distance is within a ratio of the nearest ones'.  How many lists, and the
ratio, are what vectors that took no part in the fit need to reach, at the recall asked for, their nearest neighbours
among all vectors; those come from a brute-force pass over the whole table.  Equal vectors are one entry with the
smallest ids that can be asked for, and lists or query sets that are still large are split by a hash, so no task gets
more than a fixed number of rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import write_table

TOP = 20
LIST_SIZE, MAX_LISTS = 512, 8192
#: Vectors to fit on, at least and for each list; vectors to tune on.
SAMPLE, PER_LIST, HELD_OUT = 20_000, 16, 256
COPIES, BOUNDARY = 2, 1.1
RECALL, LEAST_PROBES = 0.95, 4
SPLIT = 4096


@dataclass
class Index:
    """``centroids``: one row a list, in the space with equal norms; ``graph``: neighbours of each centroid;
    ``probes`` and ``ratio``: a query reads that many lists at most, no farther than ratio times its fourth nearest."""

    centroids: np.ndarray
    graph: list[np.ndarray]
    norm: float
    probes: int = 1
    ratio: float = np.inf

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (vectors**2).sum(axis=1), 0.0))
        return np.column_stack([vectors, rest])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0.0)


def fit(sample: np.ndarray, lists: int, norm: float, rounds: int = 10, degree: int = 24) -> Index:
    """Balanced k-means over ``sample``: a cluster's distance grows with its share of the rows."""
    index = Index(np.zeros((0, 0)), [], norm)
    points = index.lift(sample)
    lists = max(1, min(lists, len(points)))
    rng = np.random.default_rng(7)
    centroids = points[np.sort(rng.choice(len(points), lists, replace=False))].copy()
    load = np.ones(lists)
    block = min(2048, max(1, (1 << 22) // lists))
    for _ in range(rounds):
        own = np.concatenate([np.argmin(_squared(points[k : k + block], centroids) * load, axis=1) for k in range(0, len(points), block)])
        count = np.bincount(own, minlength=lists)
        load = np.clip(load * np.sqrt((count + 1) / (len(points) / lists + 1)), 0.5, 2.0)
        total = np.zeros_like(centroids)
        np.add.at(total, own, points)
        filled = count > 0
        centroids[filled] = total[filled] / count[filled, None]
    near = min(degree, lists - 1)
    graph = np.zeros((lists, near), np.int64)
    for k in range(0, lists, block):
        d = _squared(centroids[k : k + block], centroids)
        d[np.arange(len(d)), np.arange(k, k + len(d))] = np.inf
        graph[k : k + block] = np.argsort(d, axis=1, kind="stable")[:, :near]
    # Links hold both ways: a centroid that is nobody's near neighbour could not be reached otherwise.
    both = [set(row) for row in graph.tolist()]
    for k, row in enumerate(graph.tolist()):
        for c in row:
            both[c].add(k)
    return Index(centroids, [np.array(sorted(x), np.int64) for x in both], norm, lists)


def tune(index: Index, queries: np.ndarray, neighbours: list[np.ndarray], recall: float = RECALL) -> Index:
    """Sets probes and ratio by the ``neighbours`` of ``queries``, which took no part in the fit.

    The ratio alone loses half of what may be missed, and the probes what is left of it.  Without neighbours all lists
    are read."""
    ranks, ratios = [], []
    for query, true in zip(queries, neighbours, strict=True):
        d = np.sqrt(((index.centroids - np.append(query, 0.0)) ** 2).sum(1))
        order = np.argsort(d, kind="stable")
        rank = np.empty(len(d), np.int64)
        rank[order] = np.arange(len(d))
        base = max(float(d[order[min(LEAST_PROBES, len(d)) - 1]]), 1e-12)
        for owners in assign(index, true) if len(true) else ():
            best = owners[np.argmin(rank[owners])]
            ranks.append(int(rank[best])), ratios.append(float(d[best]) / base)
    if ranks:
        index.ratio = float(np.quantile(ratios, (1 + recall) / 2, method="higher"))
        reached = np.where((np.array(ratios) <= index.ratio) | (np.array(ranks) < LEAST_PROBES), ranks, len(index.centroids))
        index.probes = max(LEAST_PROBES, int(np.quantile(reached, recall, method="higher")) + 1)
    return index


def nearest(entries: DataFrame, queries: np.ndarray, top: int = TOP) -> list[np.ndarray]:
    """The ``top`` vectors of ``entries`` nearest to each of ``queries``, but for itself, by brute force; a task keeps
    its best ones while it reads."""
    spark = entries.sparkSession
    shared = spark.sparkContext.broadcast(queries)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        queries = shared.value
        own = [q.tobytes() for q in queries]
        best: list[list[tuple[float, bytes]]] = [[] for _ in own]
        for batch in batches:
            raw = batch.column("vec").to_pylist()
            score = queries @ _unpack(batch.column("vec")).T
            near = np.argpartition(-score, min(top, len(raw) - 1), axis=1)[:, : top + 1] if raw else np.zeros((len(own), 0), np.int64)
            for k, picked in enumerate(near):
                new = [(float(score[k, v]), raw[v]) for v in picked if raw[v] != own[k]]
                best[k] = sorted(best[k] + new, reverse=True)[:top]
        rows = [(k, s, v) for k, found in enumerate(best) for s, v in found]
        q, s, v = zip(*rows, strict=True) if rows else ((),) * 3
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(s, pa.float64()), pa.array(v, pa.binary())], names=["query", "score", "vec"])

    found = entries.select("vec").mapInArrow(run, "query int, score double, vec binary")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec"))
    out: list[list[bytes]] = [[] for _ in queries]
    for r in found.withColumn("place", place).where(F.col("place") <= top).collect():
        out[r["query"]].append(bytes(r["vec"]))
    return [np.frombuffer(b"".join(x), np.float64).reshape(len(x), -1) for x in out]


def build(entries: DataFrame, norm: float) -> Index:
    """An index fitted on a sample of ``entries`` (vec) by hash and tuned on others of them."""
    total = entries.count()
    lists = min(MAX_LISTS, total // LIST_SIZE + 1)
    held = min(HELD_OUT, total // 4)
    size = min(total, max(SAMPLE, PER_LIST * lists) + held)
    # Twice as many as asked for by the hash's range, so no task sorts more of the table.
    some = entries.select("vec", F.xxhash64("vec").alias("at")).where(F.col("at") <= F.lit(min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 2 * size // total)))
    taken = some.orderBy("at", "vec").limit(size).toPandas()["vec"]
    sample = np.frombuffer(b"".join(taken), np.float64).reshape(len(taken), -1)
    index = fit(sample[held:], lists, norm)
    return tune(index, sample[:held], nearest(entries, sample[:held]) if held and lists > LEAST_PROBES else [np.zeros((0, sample.shape[1]))] * held)


def assign(index: Index, vectors: np.ndarray) -> list[np.ndarray]:
    """The lists of each vector: the nearest, and up to COPIES - 1 more within BOUNDARY times its distance that are
    farther from every list chosen before than from the vector."""
    points, out = index.lift(vectors), []
    for lo in range(0, len(points), 1024):
        d = np.sqrt(_squared(points[lo : lo + 1024], index.centroids))
        near = np.argsort(d, axis=1, kind="stable")[:, : 4 * COPIES]
        for row, order in zip(d, near, strict=True):
            chosen = [int(order[0])]
            for c in order[1:]:
                if row[c] > BOUNDARY * row[chosen[0]] + 1e-12 or len(chosen) == COPIES:
                    break
                if (((index.centroids[chosen] - index.centroids[c]) ** 2).sum(1) > row[c] ** 2).all():
                    chosen.append(int(c))
            out.append(np.array(chosen))
    return out


def route(index: Index, query: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The lists to read for one query: best-first search of the graph from ``entries``, then the ratio's cut.

    A search that would look at most of the centroids ranks them all instead, which finds no farther ones."""
    point = np.append(query, 0.0)
    if (beam := 2 * index.probes + 16) * 2 >= len(index.centroids):  # the search would see nearly all of them, one by one
        d = np.sqrt(((index.centroids - point) ** 2).sum(1))
        order = np.argsort(d, kind="stable")[: index.probes]
        return order[(np.arange(len(order)) < LEAST_PROBES) | (d[order] <= index.ratio * d[order[min(LEAST_PROBES, len(order)) - 1]] + 1e-12)]
    dist = lambda ids: np.sqrt(((index.centroids[ids] - point) ** 2).sum(1))
    seen = np.zeros(len(index.centroids), bool)
    seen[entries] = True
    open_ = list(zip(dist(entries).tolist(), entries.tolist(), strict=True))
    heapq.heapify(open_)
    best = [(-d, c) for d, c in heapq.nsmallest(beam, open_)]
    heapq.heapify(best)
    while open_:
        d, c = heapq.heappop(open_)
        if len(best) == beam and d > -best[0][0]:
            break
        new = index.graph[c][~seen[index.graph[c]]]
        seen[new] = True
        for e, n in zip(dist(new).tolist(), new.tolist(), strict=True):
            if len(best) < beam or e < -best[0][0]:
                heapq.heappush(open_, (e, n))
                heapq.heappush(best, (-e, n)) if len(best) < beam else heapq.heapreplace(best, (-e, n))
    found = sorted((-d, c) for d, c in best)[: index.probes]
    limit = index.ratio * found[min(LEAST_PROBES, len(found)) - 1][0] + 1e-12
    return np.array([c for k, (d, c) in enumerate(found) if k < LEAST_PROBES or d <= limit])


def _valid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec): vectors as doubles; nulls, zero vectors and those with a null or non-finite component are out."""
    vec = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", vec.alias("vec"))
    return rows.where(finite).where(F.exists("vec", lambda x: x != 0))


def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """(vec, ids): equal vectors once, with their ``keep`` smallest ids; batches are reduced first."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, groups = batch.column("vec_id").to_pylist(), {}
            for i, raw in zip(ids, _matrix(batch.column("vec")), strict=True):
                groups.setdefault(raw.tobytes(), set()).add(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(groups), pa.binary()), pa.array([sorted(v)[:keep] for v in groups.values()], pa.list_(pa.int64()))], names=["vec", "ids"])

    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return rows.mapInArrow(run, "vec binary, ids array<long>").groupBy("vec").agg(ids.alias("ids"))


def _matrix(column) -> np.ndarray:
    """Lists of doubles of one length as a matrix; minus zero becomes zero, so equal vectors have equal bytes."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)) + 0.0


def _unpack(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1) if values else np.zeros((0, 0))


def best_of(queries: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many, ids, scores: the ``top`` ids of one list for each query, query by query; rough scores choose, with a
    margin for rounding, exact ones decide.  ``ids`` are those of all vectors, ``sizes`` how many each has.

    Exact scores are summed row by row, so equal vectors have equal scores whatever stands beside them."""
    rough = queries @ vectors.T
    margin = min(top + 8, len(vectors))
    near = np.argpartition(-rough, margin - 1, axis=1)[:, :margin]
    of, picked = np.repeat(np.arange(len(queries)), margin), near.ravel()
    scores = (queries[:, None, :] * vectors[near]).sum(axis=2).ravel()
    if margin < len(vectors):
        least = np.take_along_axis(rough, near, axis=1)
        cut = np.partition(least, margin - top, axis=1)[:, margin - top] - 1e-9
        tied = np.flatnonzero(least.min(axis=1) >= cut)  # ties beyond the margin
        if len(tied):
            more = [np.flatnonzero(rough[k] >= cut[k]) for k in tied]
            rest = ~np.isin(of, tied)
            scores = np.concatenate([scores[rest], *((queries[k][None, :] * vectors[m]).sum(axis=1) for k, m in zip(tied, more, strict=True))])
            of = np.concatenate([of[rest], np.repeat(tied, [len(m) for m in more])])
            picked = np.concatenate([picked[rest], *more])
    n = sizes[picked]
    first = (np.cumsum(sizes) - sizes)[picked]
    ids = ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    of, scores = np.repeat(of, n), np.repeat(scores, n)
    at = first_best(of, ids, scores, top)
    return np.bincount(of[at], minlength=len(queries)), ids[at], scores[at]


def search(embeddings: DataFrame, every: int = 20, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each vector whose id is divisible by ``every``.

    Candidates are all other ids.  Ties go to the smaller id; an id with several rows is listed once, with its best
    score; vectors of another dimension than the most frequent one take no part; fewer candidates give fewer rows; an
    empty table gives none."""
    rows = _valid(embeddings)
    spark = embeddings.sparkSession
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    widest = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("norm")).orderBy(F.desc("n"), "dim").first()
    if widest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    keep = top + 1
    rows = rows.where(F.size("vec") == widest["dim"])
    entries = write_table(_distinct(rows, keep), "vectors")
    queries = write_table(_queries(rows, every), "queries")
    index = build(entries, widest["norm"])
    shared = spark.sparkContext.broadcast(index)
    postings = write_table(_postings(entries, shared), "postings")
    routes = write_table(_routes(queries.select("vec").distinct(), shared), "routes")
    # One row a list, at most MAX_LISTS.
    parts, waves = (dict(df.groupBy("list").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("n")).where("n > 1").collect()) for df in (postings, routes))
    left = _dealt(routes, waves, parts, "wave", "part").groupBy("list", "part", "wave")
    right = _dealt(postings, parts, waves, "part", "wave").groupBy("list", "part", "wave")

    def scan(probe, posting):
        import pyarrow as pa
        import pyarrow.compute as pc

        kinds = pa.schema([("vec", pa.binary()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
        if not (probe.num_rows and posting.num_rows):
            return kinds.empty_table()
        vectors, ids = _unpack(posting.column("vec")), posting.column("ids").combine_chunks()
        sizes, ids = pc.list_value_length(ids).to_numpy(zero_copy_only=False), ids.flatten().to_numpy(zero_copy_only=False)
        asked, found = probe.column("vec").combine_chunks(), []
        for lo in range(0, len(asked), 512):
            found.append(best_of(_unpack(asked.slice(lo, 512)), vectors, sizes, ids, keep))
        n, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        return pa.table([asked, pa.ListArray.from_arrays(ends, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(scores, pa.float64()))], schema=kinds)

    hits = left.cogroup(right).applyInArrow(scan, "vec binary, ids array<long>, scores array<double>")
    return _ranked(queries.join(_merged(hits, keep), "vec"), top)


def first_best(of: np.ndarray, ids: np.ndarray, scores: np.ndarray, keep: int) -> np.ndarray:
    """Where the ``keep`` best of each of ``of`` are, best first, equal scores by id, an id once with its best score."""
    order = np.lexsort((ids, -scores, of))
    o, i = of[order], ids[order]
    by = np.lexsort((i, o))  # stable, so an id's best mention stays in front
    again = np.zeros(len(by), bool)
    again[by[1:]] = (o[by[1:]] == o[by[:-1]]) & (i[by[1:]] == i[by[:-1]])
    order, o = order[~again], o[~again]
    return order[np.arange(len(o)) - np.searchsorted(o, o) < keep]


def _merged(hits: DataFrame, keep: int) -> DataFrame:
    """(vec, ids, scores): one row for each vector of ``hits``, its ``keep`` best.

    Rows come in the order of their vectors, and the last one of a batch waits for the next batch; all pairs of a batch
    are sorted at once."""

    def best(rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        vec, ids, scores = (rows.column(c).combine_chunks() for c in ("vec", "ids", "scores"))
        new = np.ones(len(vec), bool)
        new[1:] = pc.not_equal(vec.slice(1), vec.slice(0, len(vec) - 1)).to_numpy(zero_copy_only=False)
        of = np.repeat(np.cumsum(new) - 1, pc.list_value_length(ids).to_numpy(zero_copy_only=False))
        ids, scores = ids.flatten().to_numpy(zero_copy_only=False), scores.flatten().to_numpy(zero_copy_only=False)
        at = first_best(of, ids, scores, keep)
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of[at], minlength=int(new.sum())))]), pa.int32())
        return pa.RecordBatch.from_arrays([vec.filter(pa.array(new)), pa.ListArray.from_arrays(ends, pa.array(ids[at], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(scores[at], pa.float64()))], names=["vec", "ids", "scores"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            last = pc.index(rows.column("vec"), rows.column("vec")[rows.num_rows - 1]).as_py()
            if last:
                yield best(rows.slice(0, last))
            rest = rows.slice(last)
        if rest is not None:
            yield best(rest)

    return hits.repartition("vec").sortWithinPartitions("vec").mapInArrow(run, "vec binary, ids array<long>, scores array<double>")


def _queries(rows: DataFrame, every: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array([v.tobytes() for v in _matrix(batch.column("vec"))], pa.binary())], names=["query_id", "vec"])

    return rows.where(F.col("vec_id") % every == 0).mapInArrow(run, "query_id long, vec binary").distinct()


def _postings(entries: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lists = assign(shared.value, _unpack(batch.column("vec")))
            at = np.repeat(np.arange(batch.num_rows), [len(x) for x in lists])
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists) if lists else [], pa.int32()), part.column("vec"), part.column("ids")], names=["list", "vec", "ids"])

    return entries.mapInArrow(run, "list int, vec binary, ids array<long>")


def _routes(queries: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = shared.value
        entries = np.unique(np.linspace(0, len(index.centroids) - 1, 16).astype(np.int64))
        for batch in batches:
            raw = batch.column("vec").to_pylist()
            lists = [route(index, q, entries) for q in _unpack(batch.column("vec"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists) if lists else [], pa.int32()), pa.array([r for r, x in zip(raw, lists, strict=True) for _ in x], pa.binary())], names=["list", "vec"])

    return queries.mapInArrow(run, "list int, vec binary")


def _dealt(rows: DataFrame, own: dict[int, int], other: dict[int, int], own_name: str, other_name: str) -> DataFrame:
    """Rows of large lists are dealt by a hash into parts, and copied to each part of the other side."""

    def of(sizes: dict[int, int]):
        known = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]) if sizes else None
        return F.lit(1) if known is None else F.coalesce(F.try_element_at(known, "list"), F.lit(1))

    dealt = rows.withColumn(own_name, F.pmod(F.xxhash64("vec"), of(own).cast("long")).cast("int"))
    return dealt.withColumn(other_name, F.explode(F.sequence(F.lit(0), of(other) - 1)))


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """One row for each of a query's answers, without the query's own id."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            ids, scores = batch.column("ids"), batch.column("scores").flatten().to_numpy(zero_copy_only=False)
            sizes, ids = pc.list_value_length(ids).to_numpy(zero_copy_only=False), ids.flatten().to_numpy(zero_copy_only=False)
            query = np.repeat(batch.column("query_id").to_numpy(zero_copy_only=False), sizes)
            other = ids != query
            rank = np.cumsum(other)
            rank = rank - np.repeat(np.concatenate([[0], rank])[np.cumsum(sizes) - sizes], sizes)
            at = np.flatnonzero(other & (rank <= top))
            yield pa.RecordBatch.from_arrays([pa.array(query[at], pa.int64()), pa.array(rank[at], pa.int32()), pa.array(ids[at], pa.int64()), pa.array(scores[at], pa.float64())], names=["query_id", "rank", "vec_id", "score"])

    return rows.select("query_id", "ids", "scores").mapInArrow(run, "query_id long, rank int, vec_id long, score double")


def op9_ann(spark, sf_dir: str) -> DataFrame:
    """The nearest neighbours of every twentieth vector; see :func:`search`."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
