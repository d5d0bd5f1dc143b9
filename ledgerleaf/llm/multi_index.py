"""Approximate nearest neighbours by an inverted multi-index.

The halves of the vectors are quantised separately; a cell is a pair of centroids, one of each half. A query visits
cells in the order of their summed distance, found with a heap over the two sorted lists of centroids, until the cells
hold enough vectors; all of these are scored on the original vectors.

Equal vectors are indexed once and stand for their smallest ids, so a vector that a third of the rows share costs no
more than another. Cells are scored in blocks of bounded size.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bayes_minhash import starts_of
from .common import stored, table

K = 20
#: Codebooks are fitted on at most this many vectors, those with the smallest hashes.
SAMPLE = 16_384
#: A query scores at least this many vectors, and as large a share of the index as the sample needs for its own
#: neighbours to be found at the wanted rate: a few percent where vectors cluster, nearly half where they have no
#: structure and a query's nearest are hardly nearer than the rest.
LEAST, RECALL = 1500, 0.94
#: Queries of the sample by which the share is measured.
PROBES = 512
#: Vectors to a cell on average at least, and centroids of a half at most.
PER_CELL = 2
MOST_CENTROIDS = 64
#: Vectors of a block, queries for which a block is sent once, and queries whose cells one task finds.
BLOCK, TOGETHER, ROUTED = 4096, 1 << 16, 4096
SEED = 5


def usable(vector: Column, size: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """Lloyd's k-means; an empty cluster restarts at the vector that is farthest from its centroid."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = distances(x, centers)
        near = d.argmin(1)
        sums, n = np.zeros_like(centers), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        full = n > 0
        centers[full] = sums[full] / n[full, None]
        if (~full).any():
            far = d[np.arange(len(x)), near].argsort()[::-1]
            centers[~full] = x[far[: (~full).sum()]]
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)[None]


def cells_in_order(a: np.ndarray, b: np.ndarray):
    """Index pairs of two sorted lists, by increasing sum: each step takes the least of a heap of at most len(a) pairs."""
    heap, row_at = [(a[0] + b[0], 0, 0)], {0}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield i, j
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a) and i + 1 not in row_at:
            row_at.add(i + 1)
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))


def visited(q: np.ndarray, books: tuple[np.ndarray, np.ndarray], held: np.ndarray, enough: int) -> list[int]:
    """The cells a query visits: in order, those that hold vectors, until they hold ``enough``."""
    h = len(q) // 2
    # The distance to maximise an inner product: what each half's centroid lacks of it.
    da, db = -(books[0] @ q[:h]), -(books[1] @ q[h:])
    ia, ib = da.argsort(kind="stable"), db.argsort(kind="stable")
    found, n, kb = [], 0, len(ib)
    for i, j in cells_in_order(da[ia], db[ib]):
        cell = int(ia[i]) * kb + int(ib[j])
        if held[cell]:
            found.append(cell)
            n += held[cell]
            if n >= enough:
                break
    return found


def stack(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def cells_of(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    h = books[0].shape[1]
    return (distances(x[:, :h], books[0]).argmin(1) * len(books[1]) + distances(x[:, h:], books[1]).argmin(1)).astype(np.int64)


def share_needed(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int, recall: float, probes: int = PROBES) -> float:
    """The share of vectors ``x`` that a query has to visit, in the order of cells, to find its ``k`` nearest of them
    at the rate ``recall``; measured on the first ``probes`` of ``x``."""
    if len(x) < 2:
        return 1.0
    k, h, kb = min(k, len(x) - 1), books[0].shape[1], len(books[1])
    cell = cells_of(x, books)
    held = np.bincount(cell, minlength=len(books[0]) * kb)
    need = []
    for i, q in enumerate(x[:probes]):
        s = x @ q
        s[i] = -np.inf
        nearest = np.argpartition(-s, k - 1)[:k]
        far = (-(books[0] @ q[:h])[:, None] - (books[1] @ q[h:])[None]).ravel()
        order = np.argsort(far, kind="stable")
        before = np.empty(len(far))
        before[order] = np.cumsum(held[order]) - held[order]
        need.append(before[cell[nearest]] / len(x))
    return float(np.quantile(np.concatenate(need), recall))


def exact_products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Inner products of rows, the products added in the vectors' order."""
    return np.cumsum(q * m, axis=1)[:, -1]


def best_of(q: np.ndarray, m: np.ndarray, seen: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's ``k`` best seen vectors: by exact product, ties by ``first``.

    Matrix products find what can be among them: all that come within a rounding bound of the k-th.
    """
    s = np.where(seen, q @ m.T, -np.inf)
    if s.shape[1] > k:
        bound = 4 * m.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(m, axis=1).max()
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1] - bound
        i, j = np.nonzero((s >= least[:, None]) & seen)
    else:
        i, j = np.nonzero(seen)
    score = np.concatenate([np.zeros(0), *(exact_products(q[i[at : at + 65536]], m[j[at : at + 65536]]) for at in range(0, len(i), 65536))])
    order = np.lexsort((first[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
    return i[place < k], j[place < k], score[place < k]


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", least: int = LEAST, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``is_query``, the ``k`` rows found of largest inner product.

    The query's own id is never found; ties go to the smaller id; fewer rows come only where there are fewer. Scores
    are sums of products of doubles in the vectors' order. Null ids, null or zero vectors, vectors with null, infinite
    or NaN components and vectors not of the commonest length take no part. Repeated rows count once. Empty table: no
    rows. What a query visits is ranked exactly, however many scores are equal.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks")).where("id is not null and v is not null")
    length = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    out = "query_id long, rank int, vec_id long, score double"
    if length is None or length.n < 2:
        return spark.createDataFrame([], out)
    v = v.where(usable(F.col("v"), F.lit(length.n))).select("id", F.transform("v", lambda x: x + 0.0).alias("v"), "asks")

    # One entry per distinct vector with its k + 1 smallest ids. The limit within groups is applied before rows move.
    place = F.row_number().over(W.partitionBy("v").orderBy("id"))
    members = stored(v.select("id", "v").distinct().withColumn("place", place).where(F.col("place") <= k + 1), "ann-members")
    entries = members.where("place = 1").select(F.col("id").alias("first"), "v")
    entries = stored(entries.withColumn("entry", F.monotonically_increasing_id()), "ann-entries")
    n = entries.count()
    if n == 0:
        return spark.createDataFrame([], out)

    some = entries.orderBy(F.xxhash64(F.lit(SEED), "v"), "first").limit(sample).select("v").toPandas()  # bounded by `sample`
    x, h = stack(some["v"]), length.n // 2
    size = int(min(MOST_CENTROIDS, max(2, round((n / PER_CELL) ** 0.5))))
    books = (codebook(x[:, :h], size), codebook(x[:, h:], size))

    share = share_needed(x, books, k, recall)

    def assign(batches):
        for b in batches:
            if len(b):
                yield b.assign(cell=cells_of(stack(b["v"]), books))[["entry", "first", "v", "cell"]]

    index = stored(entries.select("entry", "first", "v").mapInPandas(assign, "entry long, first long, v array<double>, cell long"), "ann-index")
    held = np.zeros(len(books[0]) * len(books[1]), dtype=np.int64)
    for r in index.groupBy("cell").count().collect():  # at most MOST_CENTROIDS squared numbers
        held[r["cell"]] = r["count"]
    enough = max(least, int(share * n))

    asked = v.where("asks").select("id", "v").distinct()
    queries = stored(asked.join(entries.select("entry", "v"), "v").select("id", F.col("entry").alias("asked")), "ann-queries")
    asking = index.join(queries.select(F.col("asked").alias("entry")).distinct(), "entry", "left_semi")

    # Blocks of neighbouring cells with about BLOCK vectors; a larger cell is split over several parts of its block.
    block_of = (np.cumsum(held) - held) // BLOCK
    parts = np.maximum(1, -(-held // BLOCK))
    most_parts = np.ones(block_of.max() + 1, dtype=np.int64)
    np.maximum.at(most_parts, block_of, parts)
    n_asking = asking.count()
    chunks = max(1, -(-n_asking // TOGETHER))

    def route(batches):
        for b in batches:
            rows = []
            for entry, q in zip(b["entry"], stack(b["v"]) if len(b) else [], strict=True):
                cells = np.sort(np.array(visited(q, books, held, enough), dtype=np.int64))
                for some in np.split(cells, np.flatnonzero(np.diff(block_of[cells])) + 1):
                    block = int(block_of[some[0]])
                    rows.extend((entry, q, some, block, part, entry % chunks) for part in range(most_parts[block]))
            yield pd.DataFrame(rows, columns=["asked", "q", "cells", "block", "part", "chunk"])

    routed = asking.select("entry", "v").repartition(max(8, n_asking // ROUTED), "entry").mapInPandas(route, "asked long, q array<double>, cells array<long>, block long, part long, chunk long")

    def dealt(batches):
        for b in batches:
            cell = b["cell"].to_numpy()
            yield b.assign(block=block_of[cell], part=b["entry"].to_numpy() % parts[cell])

    # A block is copied once for every TOGETHER queries of the table; queries stream past it.
    blocks = index.mapInPandas(dealt, "entry long, first long, v array<double>, cell long, block long, part long")
    blocks = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    none = lambda kind: F.lit(None).cast(kind)
    keys = ["block", "part", "chunk"]
    have = blocks.select(*keys, F.lit(0).alias("side"), F.col("entry").alias("id"), "first", "v", "cell", none("array<long>").alias("cells"))
    ask = routed.select(*keys, F.lit(1).alias("side"), F.col("asked").alias("id"), F.lit(0).cast("long").alias("first"), F.col("q").alias("v"), F.lit(0).cast("long").alias("cell"), "cells")

    def best(batches):
        now, parts_, block = None, [], None
        for frame in batches:
            at = starts_of(frame, [*keys, "side"])
            for s, e in zip(at[:-1], at[1:], strict=True):
                g = frame.iloc[s:e]
                key = tuple(g[c].iloc[0] for c in keys)
                if key != now:
                    now, parts_, block = key, [], None
                if g["side"].iloc[0] == 0:
                    parts_.append(g)
                    continue
                if not parts_:
                    continue
                if block is None:  # at most about BLOCK vectors
                    all_ = pd.concat(parts_)
                    cells, column = np.unique(all_["cell"].to_numpy(), return_inverse=True)
                    block = stack(all_["v"]), all_["id"].to_numpy(), all_["first"].to_numpy(), cells, column
                m, entry, first, cells, column = block
                for some in (g.iloc[i : i + 512] for i in range(0, len(g), 512)):
                    held_ = np.zeros((len(some), len(cells)), dtype=bool)
                    for i, c in enumerate(some["cells"]):
                        held_[i] = np.isin(cells, c)
                    i, j, score = best_of(stack(some["v"]), m, held_[:, column], first, k + 1)
                    yield pd.DataFrame({"asked": some["id"].to_numpy()[i], "entry": entry[j], "first": first[j], "score": score})

    both = have.unionByName(ask).repartition(*keys).sortWithinPartitions(*keys, "side")
    near = both.mapInPandas(best, "asked long, entry long, first long, score double")
    top = F.row_number().over(W.partitionBy("asked").orderBy(F.desc("score"), "first"))
    scored = stored(near.withColumn("place", top).where(F.col("place") <= k + 1).select("asked", "entry", "score"), "ann-near")

    named = scored.join(entries.select("entry", "v"), "entry").join(members.select("v", "id"), "v").select("asked", F.col("id").alias("vec_id"), "score")
    # Of a query vector's finds, k + 1 are enough for each of the rows that share it.
    few = F.row_number().over(W.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))
    named = named.withColumn("place", few).where(F.col("place") <= k + 1).drop("place")
    each = queries.join(named, "asked").where(F.col("id") != F.col("vec_id"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_multi_index(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
