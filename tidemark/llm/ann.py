"""Approximate nearest neighbours by inner product: balanced posting lists.

Largest inner product becomes nearest in space by one more dimension, sqrt(M^2 - |v|^2) for vectors, 0 for queries.
Centroids are fit on a bounded sample (SAMPLE distinct vectors, chosen by hash of the id) by k-means whose large
clusters are split. Every vector is indexed: it goes to its nearest list and, if it lies near a boundary, to further
ones (REPLICAS at most, distance at most 1 + EPSILON times the nearest). Centroids are found through an in-memory
neighbour graph by best-first search.

Lists follow the table: up to MAX_LISTS of LIST vectors from one fit. Beyond that each list is cut again by a task of
its own, into lists about LIST centroids fit on a bounded sample of that list, so a list stays short and the model of one task
stays small; no task, nor the driver, holds all centroids.

A query searches all lists whose centroid is at most RATIO times as far as the nearest, however many these are, and
more, nearest first, until lists of FEW times k vectors are taken. Queries that still find fewer than k (ids may
repeat) are compared with every row, in blocks, so each query gets min(k, candidates) rows.

Lists meet their queries in bins of about BIN vectors: a list longer than PART is dealt to several, a bin asked by more
than ASKED queries is dealt again by query. A bin returns k rows a query, whatever the number of its lists. Scores are sums
in double precision over the original vectors; within a list all vectors are compared exactly.

Defined cases: null ids, and vectors that are null, zero, or with null or non-finite components, take no part; of
vectors of several lengths the shorter count as filled up with zeros; rows with equal ids are one vector's entries and
none is a neighbour of itself; ties go to the smaller id; fewer candidates than k give all; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import freeing_shuffles, small, written

SAMPLE = 20_000
LIST = 128
MAX_LISTS = 4096
REPLICAS = 2
EPSILON = 0.1
RATIO = 1.25
FEW = 8
#: Lists first looked at for a query.
PROBES = 64
PART, BIN, ASKED = 4096, 16_384, 8192
NEIGHBOURS = 24
#: Width of the search for a query's lists, and for a vector's own.
BEAM, INDEX_BEAM = 96, 32


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means over x; each round the centroids of the smallest clusters move into the largest, which are split."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(x)))
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    for r in range(rounds):
        near = np.concatenate([_distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=lists)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        if r < rounds - 2:
            order = np.argsort(size)
            mean = len(x) / lists
            for small, large in zip(order, order[::-1]):
                if size[small] >= mean / 4 or size[large] <= 2 * mean:
                    break
                c[small] = x[rng.choice(np.flatnonzero(near == large))]
    return c


class Graph:
    """Centroids and for each its nearest others, with a few far links, searched best first for many vectors at once."""

    def __init__(self, c: np.ndarray, links: np.ndarray | None = None, seed: int = 11):
        self.c, n = c, len(c)
        self.norm = (c * c).sum(1)
        if links is not None:
            self.links = links
            return
        k = min(NEIGHBOURS, n - 1)
        if k > 0:
            d = _distances(c, c)
            np.fill_diagonal(d, np.inf)
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            far = np.random.default_rng(seed).integers(0, n, (n, 4))
            self.links = np.concatenate([near, far], axis=1)
        else:
            self.links = np.zeros((n, 1), np.int64)

    def search(self, x: np.ndarray, want: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The want nearest centroids found for each row, nearest first, and their squared distances."""
        n = len(self.c)
        want, beam = min(want, n), min(max(beam, want), n)
        found, dist = np.empty((len(x), want), np.int64), np.empty((len(x), want))
        for at in range(0, len(x), 512):
            y = x[at : at + 512]
            rows = np.arange(len(y))[:, None]
            y2 = (y * y).sum(1)
            entry = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(np.int64))
            seen = np.zeros((len(y), n), dtype=bool)
            seen[:, entry] = True
            ids = np.broadcast_to(entry, (len(y), len(entry))).copy()
            d = np.maximum(y2[:, None] - 2 * y @ self.c[entry].T + self.norm[entry], 0)
            opened = np.zeros(ids.shape, dtype=bool)
            while True:
                # Open each row's best few nodes not yet opened; stop when none is left in any beam.
                closed = np.where(opened, np.inf, d)
                take = np.argsort(closed, axis=1)[:, :4]
                fresh = np.isfinite(np.take_along_axis(closed, take, 1))
                if not fresh.any():
                    break
                opened[rows, take] = True
                new = self.links[np.take_along_axis(ids, take, 1)].reshape(len(y), -1)
                skip = seen[rows, new] | ~np.repeat(fresh, self.links.shape[1], axis=1)
                seen[rows, np.where(skip, ids[:, :1], new)] = True
                # A node may be linked twice in one step; only its first mention counts.
                order = np.argsort(new, axis=1, kind="stable")
                same = np.zeros(new.shape, dtype=bool)
                ordered = np.take_along_axis(np.where(skip, -1, new), order, 1)
                np.put_along_axis(same, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
                dn = np.maximum(y2[:, None] - 2 * np.einsum("ij,ikj->ik", y, self.c[new]) + self.norm[new], 0)
                dn[skip | same] = np.inf
                ids, d = np.concatenate([ids, new], 1), np.concatenate([d, dn], 1)
                opened = np.concatenate([opened, ~np.isfinite(dn)], 1)
                if ids.shape[1] > beam:
                    keep = np.argpartition(d, beam - 1, axis=1)[:, :beam]
                    ids, d, opened = (np.take_along_axis(v, keep, 1) for v in (ids, d, opened))
            if d.shape[1] < want:
                pad = want - d.shape[1]
                ids, d = np.pad(ids, ((0, 0), (0, pad))), np.pad(d, ((0, 0), (0, pad)), constant_values=np.inf)
            best = np.argsort(d, axis=1, kind="stable")[:, :want]
            found[at : at + 512], dist[at : at + 512] = np.take_along_axis(ids, best, 1), np.take_along_axis(d, best, 1)
        return found, dist


def _within(g: Graph, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, centroids and squared distances: for each row all centroids within ratio, and the PROBES nearest."""
    rows, ids, dist, todo, want = [], [], [], np.arange(len(x)), PROBES
    while len(todo):
        if 4 * want >= len(g.c):
            d = np.concatenate([_distances(x[todo[i : i + 1024]], g.c) for i in range(0, len(todo), 1024)])
            near = np.argsort(d, axis=1, kind="stable")
            d, ended = np.take_along_axis(d, near, 1), np.ones(len(todo), dtype=bool)
        else:
            near, d = g.search(x[todo], want)
            ended = d[:, -1] > d[:, 0] * ratio**2
        take = (d <= d[:, :1] * ratio**2 + 1e-12) | (np.arange(d.shape[1]) < PROBES)
        row, col = np.nonzero(take & ended[:, None] & np.isfinite(d))
        rows.append(todo[row])
        ids.append(near[row, col])
        dist.append(d[row, col])
        todo, want = todo[~ended], 4 * want
    join = lambda a, kind: np.concatenate(a) if a else np.zeros(0, kind)
    return join(rows, np.int64), join(ids, np.int64), join(dist, np.float64)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def valid(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, whatever their length."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = v.isNotNull() & F.col(vec_id).isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    return rows.where(good).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))


class _Space:
    """Vectors with one more dimension in which the largest inner product is nearest."""

    def __init__(self, norm2: float):
        self.norm2 = norm2

    def vectors(self, m: np.ndarray) -> np.ndarray:
        return np.concatenate([m, np.sqrt(np.maximum(self.norm2 - (m * m).sum(1), 0))[:, None]], 1)

    def queries(self, m: np.ndarray) -> np.ndarray:
        """Scaled to the vectors' radius, a query ranks centroids as its inner products do."""
        m = m * (math.sqrt(self.norm2) / np.sqrt((m * m).sum(1)))[:, None]
        return np.concatenate([m, np.zeros((len(m), 1))], 1)


def _nearest(g: Graph, y: np.ndarray, replicas: int, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, lists and whether the list is the row's nearest: the nearest list and those across a close boundary."""
    near, d2 = g.search(y, max(2 * replicas, 8), INDEX_BEAM)
    keep = d2 <= d2[:, :1] * (1 + epsilon) ** 2
    keep[:, 0] = True
    keep &= np.cumsum(keep, 1) <= replicas
    row, col = np.nonzero(keep)
    return row, near[row, col], col == 0


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def search(rows: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", **tuning) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that the condition queries picks (it sees vec_id and v)."""
    spark = rows.sparkSession
    opts = {"list_size": LIST, "max_lists": MAX_LISTS, "ratio": RATIO, "replicas": REPLICAS, "epsilon": EPSILON, "part": PART, "bin": BIN, "asked": ASKED} | tuning
    data = valid(rows, vec_id, vector)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, dim, shortest, norm2 = data.agg(F.count("*"), F.max(F.size("v")), F.min(F.size("v")), F.max(norm)).head()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    element = data.schema["v"].dataType.elementType
    if shortest < dim:
        data = data.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast(element), F.lit(dim) - F.size("v"))))
    kind, space = element.simpleString(), _Space(norm2)
    share = int(min(1.0, 1.2 * SAMPLE / n) * (1 << 31))
    sample = data.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31)) < share).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v")
    x = np.unique(_matrix(sample.toArrow()["v"]), axis=0)
    if not len(x):
        x = _matrix(data.select("v").limit(1).toArrow()["v"])
    lists = max(1, min(opts["max_lists"], math.ceil(n / opts["list_size"]), len(x) // 4))
    graph = Graph(balanced_centroids(space.vectors(x), lists))
    shipped = spark.sparkContext.broadcast((graph.c, graph.links))

    def to_lists(batches):
        g = Graph(*shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                row, found, main = _nearest(g, space.vectors(_matrix(piece.column(1))), opts["replicas"], opts["epsilon"])
                # A vector is written once, with its lists, the nearest first.
                offsets = np.searchsorted(row, np.arange(piece.num_rows + 1)).astype(np.int32)
                yield _table(vec_id=piece.column(0), v=piece.column(1), lists=pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.astype(np.int64))), main=found[main])

    def to_probes(batches):
        g = Graph(*shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                row, found, d2 = _within(g, space.queries(_matrix(piece.column(1))), opts["ratio"])
                yield _table(ask=piece.column(0).take(pa.array(row)), list=found, d2=d2)

    with freeing_shuffles(spark):
        placed = written(data.mapInArrow(to_lists, f"vec_id long, v array<{kind}>, lists array<long>, main long"), "placed")
        asks = written(data.where(queries).dropDuplicates(["vec_id", "v"]).select(F.xxhash64("vec_id", "v").alias("ask"), F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "asks")
        probes = asks.select("ask", "q").mapInArrow(to_probes, "ask long, list long, d2 double")
    postings = placed.select("vec_id", "v", F.explode("lists").alias("list"), "main").withColumn("main", F.col("list") == F.col("main"))
    if n > lists * opts["list_size"] * 4 and lists == opts["max_lists"]:
        postings, probes = _refined(placed, postings, probes, asks, space, kind, opts)
    hits = _compared(postings, _pruned(probes, postings, k, opts["ratio"]), asks, k, kind, opts)
    hits = written(hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "hits")
    few = asks.join(hits.groupBy("query_id").count().where(F.col("count") >= k), "query_id", "left_anti")
    found = _all_rows(data, few, k, hits)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _refined(placed: DataFrame, postings: DataFrame, probes: DataFrame, asks: DataFrame, space: _Space, kind: str, opts: dict) -> tuple[DataFrame, DataFrame]:
    """Postings and probes of lists within lists: each list's own centroids come from a sample of it."""
    size, most = opts["list_size"], opts["max_lists"]
    sizes = placed.groupBy(F.col("main").alias("list")).count()  # at most max_lists rows
    sampled = postings.where("main").join(F.broadcast(sizes), "list").where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 31)) < F.lit(1 << 31) * F.lit(16.0 * most) / F.col("count"))
    # The bound is 16 vectors a centroid on average; a list of fewer is its own sample.

    def fit(rows: pa.Table) -> pa.Table:
        x = np.unique(_matrix(rows["v"]), axis=0)
        g = Graph(balanced_centroids(space.vectors(x), max(1, min(most, math.ceil(rows["count"][0].as_py() / size), len(x) // 4))))
        return pa.table({"list": [rows["list"][0].as_py()], "c": [g.c.tobytes()], "links": [g.links.astype(np.int64).tobytes()], "n": [len(g.c)]})

    models = written(sampled.groupBy("list").applyInArrow(fit, "list long, c binary, links binary, n long"), "lists")

    def opened(model: pa.Table) -> Graph:
        n = model["n"][0].as_py()
        return Graph(np.frombuffer(model["c"][0].as_py()).reshape(n, -1), np.frombuffer(model["links"][0].as_py(), np.int64).reshape(n, -1))

    def place(model: pa.Table, rows: pa.Table) -> pa.Table:
        if not rows.num_rows or not model.num_rows:
            return pa.table({"vec_id": pa.array([], pa.int64()), "v": rows["v"].slice(0, 0), "list": pa.array([], pa.int64()), "main": pa.array([], pa.bool_())})
        near, _ = opened(model).search(space.vectors(_matrix(rows["v"])), 1, INDEX_BEAM)
        return pa.table({"vec_id": rows["vec_id"], "v": rows["v"], "list": rows["list"][0].as_py() * most + near[:, 0], "main": rows["main"]})

    def probe(model: pa.Table, rows: pa.Table) -> pa.Table:
        if not rows.num_rows or not model.num_rows:
            return pa.table({"ask": pa.array([], pa.int64()), "list": pa.array([], pa.int64()), "d2": pa.array([], pa.float64())})
        row, found, d2 = _within(opened(model), space.queries(_matrix(rows["q"])), opts["ratio"])
        return pa.table({"ask": rows["ask"].take(pa.array(row)), "list": rows["list"][0].as_py() * most + found, "d2": d2})

    def dealt(rows: DataFrame, key: str, run, schema: str) -> DataFrame:
        """rows meet their list's model in chunks of about 16 parts, so no list fills one task."""
        chunks = rows.groupBy("list").agg(F.ceil(F.count("*") / (16 * opts["part"])).cast("int").alias("chunks"))
        rows = rows.join(F.broadcast(chunks), "list").withColumn("chunk", F.pmod(F.xxhash64(key), F.col("chunks")).cast("int")).drop("chunks")
        copies = models.join(F.broadcast(chunks), "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        return copies.groupBy("list", "chunk").cogroup(rows.groupBy("list", "chunk")).applyInArrow(run, schema)

    fine = written(dealt(postings, "vec_id", place, f"vec_id long, v array<{kind}>, list long, main boolean"), "postings")
    asked = dealt(probes.join(asks.select("ask", "q"), "ask"), "ask", probe, "ask long, list long, d2 double")
    return fine, asked


def _pruned(probes: DataFrame, postings: DataFrame, k: int, ratio: float) -> DataFrame:
    """(ask, list): lists within ratio of the nearest, and the nearest until they hold FEW times k vectors."""
    sizes = postings.where("main").groupBy("list").agg(F.count("*").alias("held"))
    near = Window.partitionBy("ask").orderBy("d2", "list")
    rows = probes.join(small(sizes), "list", "left").withColumns({"least": F.min("d2").over(Window.partitionBy("ask")), "before": F.sum("held").over(near.rowsBetween(Window.unboundedPreceding, -1))})
    return rows.where((F.col("d2") <= F.col("least") * ratio**2 + 1e-12) | (F.coalesce("before", F.lit(0)) < FEW * k)).select("ask", "list")


def _compared(postings: DataFrame, probes: DataFrame, asks: DataFrame, k: int, kind: str, opts: dict) -> DataFrame:
    """(query_id, vec_id, score): for each query and bin the k best of the lists that the query searches there."""
    sizes = written(postings.groupBy("list").agg(F.count("*").alias("held")), "sizes")
    bins = max(1, math.ceil((sizes.agg(F.sum("held")).head()[0] or 0) / opts["bin"]))
    long_lists = small(sizes.where(F.col("held") > opts["part"]).select("list", F.ceil(F.col("held") / opts["part"]).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    place = F.xxhash64("list", "part").alias("place")
    left = postings.join(long_lists, "list", "left").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(3)), parts).cast("int")).select(place, "vec_id", "v")
    right = probes.join(long_lists, "list", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(place, "ask")
    bin_ = F.pmod(F.col("place"), F.lit(bins)).alias("bin")
    wanted = written(right.groupBy(bin_, "ask").agg(F.collect_list("place").alias("places")), "wanted")
    # One row a bin.
    chunks = small(wanted.groupBy("bin").agg(F.ceil(F.count("*") / opts["asked"]).cast("int").alias("chunks")))
    wanted = wanted.join(chunks, "bin").withColumn("chunk", F.pmod(F.xxhash64("ask", F.lit(7)), F.col("chunks")).cast("int")).drop("chunks")
    wanted = wanted.join(asks, "ask").select("bin", "chunk", "query_id", "q", "places")
    left = left.withColumn("bin", bin_).join(chunks, "bin").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("bin", "chunk", "place", "vec_id", "v")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            place, ids, v = left["place"].to_numpy(), left["vec_id"].to_numpy(), _matrix(left["v"])
            qid, q, lists = right["query_id"].to_numpy(), _matrix(right["q"]), right["places"].combine_chunks()
            asker = np.repeat(np.arange(len(qid)), np.diff(lists.offsets.to_numpy()))
            asked = lists.flatten().to_numpy()
            by_place, by_ask = np.argsort(place, kind="stable"), np.argsort(asked, kind="stable")
            for p in np.unique(asked):
                mine = by_place[np.searchsorted(place, p, "left", by_place) : np.searchsorted(place, p, "right", by_place)]
                who = asker[by_ask[np.searchsorted(asked, p, "left", by_ask) : np.searchsorted(asked, p, "right", by_ask)]]
                step = max(1, (1 << 22) // max(len(mine), 1))
                for at in range(0, len(who) if len(mine) else 0, step):
                    out.append(best_of(who[at : at + step], qid, q, ids[mine], v[mine], k))
        who, vec, score = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        # A vector stands in several lists; each query's best of all its lists here.
        who, vec, score = _first(who, vec, score, k)
        queries = right["query_id"].to_numpy()[who] if len(who) else np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array(queries, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})

    return left.groupBy("bin", "chunk").cogroup(wanted.groupBy("bin", "chunk")).applyInArrow(compare, "query_id long, vec_id long, score double")


def _all_rows(data: DataFrame, few: DataFrame, k: int, hits: DataFrame, block: int = 4096) -> DataFrame:
    """hits, with those of the queries in few (query_id, q) from all rows: blocks of queries pass over the table."""
    few = written(few.select("query_id", "q"), "few")
    blocks = math.ceil(few.count() / block)
    if not blocks:
        return hits
    out = hits.join(few.select("query_id").distinct(), "query_id", "left_anti")
    for b in range(blocks):
        asked = few.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        shipped = data.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(), _matrix(asked["q"])))

        def run(batches):
            qid, q = shipped.value  # noqa: B023
            who, vec, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for batch in batches:
                ids, v = batch.column(0).to_numpy(), _matrix(batch.column(1))
                parts = [(who, vec, score)]
                step = max(1, (1 << 22) // max(len(ids), 1))
                for at in range(0, len(qid), step):
                    parts.append(best_of(np.arange(at, min(len(qid), at + step)), qid, q, ids, v, k))
                who, vec, score = _first(*(np.concatenate(c) for c in zip(*parts)), k)
            yield _table(query_id=pa.array(qid[who], pa.int64()), vec_id=pa.array(vec, pa.int64()), score=pa.array(score, pa.float64()))

        best = data.mapInArrow(run, "query_id long, vec_id long, score double")
        out = out.unionByName(best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    return out


def best_of(who: np.ndarray, qid: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int):
    """For each query of who (positions in qid and q) its k best of these vectors, an id counting once; ties to smaller ids."""
    # So many rows hold k ids at least, if there are so many.
    most = k * int(np.unique(ids, return_counts=True)[1].max())
    s = q[who] @ v.T
    s[qid[who][:, None] == ids[None, :]] = -np.inf
    # Matrix products may round equal vectors apart; the k-th best less a margin lets all ties in, to be scored alike.
    kth = np.partition(s, max(s.shape[1] - most, 0), axis=1)[:, max(s.shape[1] - most, 0)]
    finite = np.isfinite(kth)
    least = np.where(finite, kth - 1e-9 * (np.abs(np.where(finite, kth, 0)) + 1), -np.inf)
    row, col = np.nonzero((s >= least[:, None]) & np.isfinite(s))
    score = np.concatenate([(q[who[row[i : i + 65536]]] * v[col[i : i + 65536]]).sum(1) for i in range(0, len(row), 65536)]) if len(row) else np.zeros(0)
    return _first(who[row], ids[col], score, k)


def _first(who: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best, an id with its best score; ties to smaller ids."""
    order = np.lexsort((-score, vec, who))
    who, vec, score = who[order], vec[order], score[order]
    new = np.ones(len(who), dtype=bool)
    new[1:] = (who[1:] != who[:-1]) | (vec[1:] != vec[:-1])
    who, vec, score = who[new], vec[new], score[new]
    order = np.lexsort((vec, -score, who))
    who, vec, score = who[order], vec[order], score[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[keep], vec[keep], score[keep]
