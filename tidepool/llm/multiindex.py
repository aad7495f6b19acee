"""Operator 9: nearest neighbours with an inverted multi-index.

Vectors are halved, and each half has a codebook of its own (fitted on a bounded sample); a vector's cell is the pair of its nearest
centroids, so K centroids a half make K x K cells. A search walks centroid pairs by the sum of their distances to the query's halves, with a
heap, until the cells seen hold a share of all vectors, and ranks all of those by their true distance. The share is the least that finds `recall`
of the true neighbours within the sample (where neighbours lie further apart than among all rows, so that it errs on the safe side):
small where vectors cluster, large where they do not.

Cells next to each other make shards of a bounded number of vectors (a larger cell is dealt over several), and a shard meets the
queries that walk through any of its cells in blocks of a bounded number of queries, each pair of which is one matrix product.

Equal vectors are one entry with its smallest ids: with k neighbours wanted, no more than k + 1 of them can ever be in a result. Equal
queries are searched once. So neither a vector nor a query that a third of all rows share is joined row by row.

Cases: null vectors, zero vectors and those with null or non-finite components take no part, nor do those of another length than most
have; repeated rows with one id count as one; queries get fewer neighbours where there are fewer candidates; ties go to the smaller id; an
empty table gives an empty one; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import ref
from tidepool.runtime import discard, ensure_workers, materialise


@dataclass(frozen=True)
class Settings:
    """centroids: of each half at least; more where cells would hold over cell_rows vectors on average, up to one for 20 vectors of the sample.
    sample: vectors that the codebooks and the share are fitted on, at most; trials: how many of these are
    searched for the latter. recall: of the true neighbours, within the sample. shard_rows, block_queries: vectors and queries of a task."""

    centroids: int = 64
    cell_rows: int = 64
    sample: int = 20_000
    rounds: int = 10
    trials: int = 300
    recall: float = 0.98
    shard_rows: int = 4_096
    block_queries: int = 8_192


@dataclass
class Codebooks:
    halves: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        middle = centroids.mean(0)
        vectors, centroids = vectors - middle, centroids - middle
        return np.maximum(0, (vectors**2).sum(1)[:, None] - 2 * vectors @ centroids.T + (centroids**2).sum(1)[None, :])

    def split(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.halves[0].shape[1]
        return self.distances(vectors[:, :cut], self.halves[0]), self.distances(vectors[:, cut:], self.halves[1])

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        a, b = self.split(vectors)
        return a.argmin(1) * len(self.halves[1]) + b.argmin(1)

    def walk(self, one: np.ndarray, two: np.ndarray, sizes: np.ndarray, least: float) -> list[int]:
        """Cells with vectors in order of the summed distance of their centroids, until they hold `least`."""
        i, j = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        x, y = one[i].tolist(), two[j].tolist()
        i, j, n = i.tolist(), j.tolist(), len(two)
        heap, found, held = [(x[0] + y[0], 0, 0)], [], 0
        while heap and held < least:
            _, a, b = heapq.heappop(heap)
            cell = i[a] * n + j[b]
            if sizes[cell]:
                found.append(cell)
                held += int(sizes[cell])
            # each pair is pushed once: along a row by its left neighbour, down the first column by the one above
            if b + 1 < n:
                heapq.heappush(heap, (x[a] + y[b + 1], a, b + 1))
            if b == 0 and a + 1 < len(i):
                heapq.heappush(heap, (x[a + 1] + y[0], a + 1, 0))
        return found


def kmeans(data: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    distinct = np.unique(data, axis=0)
    if len(distinct) <= k:
        return distinct
    centroids = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)].copy()
    for _ in range(rounds):
        near = Codebooks.distances(data, centroids).argmin(1)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, near, data)
        centroids[size > 0] = total[size > 0] / size[size > 0, None]
    return centroids


def share_to_walk(books: Codebooks, sample: np.ndarray, k: int, settings: Settings) -> float:
    """The least share of vectors whose cells, in the order of the walk, hold `recall` of the sample's own true neighbours."""
    n = len(sample)
    if n <= k + 1:
        return 1.0
    cell = books.cells(sample)
    sizes = np.bincount(cell, minlength=len(books.halves[0]) * len(books.halves[1]))
    step = max(1, n // settings.trials)
    tried = sample[::step]
    one, two = books.split(tried)
    shares = []
    for i, (q, x, y) in enumerate(zip(tried, one, two)):
        # a vector is no neighbour of its own
        squared = ((sample - q) ** 2).sum(1)
        squared[i * step] = np.inf
        near = np.argpartition(squared, k - 1)[:k]
        walked = books.walk(x, y, sizes, n)
        before = np.zeros(len(sizes))
        before[walked] = np.cumsum(sizes[walked])
        shares.append(before[cell[near]] / n)
    return float(np.quantile(np.concatenate(shares), settings.recall))


def valid(vector: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, and not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the k rows of x nearest to q, ties to the smaller id.

    One product of matrices, around the middle of x, tells a row's squared distance up to an error that its lengths bound; every row that
    may by this be among the k, equal ones included, is then measured by its true differences.
    """
    if len(x) > 4 * k:
        middle = x.mean(0)
        y, p = x - middle, q - middle
        square, length = (y**2).sum(1), float(p @ p)
        rough = square - 2 * (y @ p) + length
        most = max(np.abs(x).max(), np.abs(q).max())
        slack = 1e-12 * len(q) * (square + length) + 1e-14 * len(q) * most * (np.sqrt(square) + np.sqrt(length) + most * 1e-14)
        at = np.flatnonzero(rough - slack <= np.partition(rough + slack, k - 1)[k - 1])
    else:
        at = np.arange(len(x))
    score = np.sqrt(((x[at] - q) ** 2).sum(1))
    best = np.lexsort((ids[at], score))[:k]
    return at[best], score[best]


def _shards(held: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard of each cell, over how many shards it is dealt): cells in a row share a shard up to `most` vectors."""
    first, count = np.zeros(len(held), np.int64), np.maximum(1, -(-held // most))
    shard, filled = 0, 0
    for c, n in enumerate(held.tolist()):
        if filled and filled + n > most:
            shard, filled = shard + 1, 0
        first[c] = shard
        if count[c] > 1:
            shard, filled = shard + int(count[c]), 0
        else:
            filled += n
    return first, count


def search(df: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """One row per neighbour found: query_id, rank int from 1, id_col, score double (Euclidean distance). is_query: of df's columns."""
    ensure_workers(df.sparkSession)
    raw = df.select(ref(id_col).alias("id"), ref(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & valid(F.col("v")))
    sizes = raw.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    result = f"query_id {df.schema[id_col].dataType.simpleString()}, rank int, {id_col} {df.schema[id_col].dataType.simpleString()}, score double"
    if not sizes:
        return df.sparkSession.createDataFrame([], result)
    raw = raw.where(F.size("v") == sizes[0]["d"])
    group = F.sha2(F.array_join(F.transform("v", lambda x: F.hex(F.when(x == 0, F.lit(0.0)).otherwise(x).cast("string"))), ",").cast("binary"), 256)
    rows = materialise(raw.select("id", "v", "q", group.alias("g")), "vectors")
    first = F.row_number().over(Window.partitionBy("g").orderBy("id", F.col("q").desc()))
    entries = rows.dropDuplicates(["g", "id"]).withColumn("n", first).where(F.col("n") <= k + 1).select("id", "v", "g")

    chosen = rows.select("v", F.xxhash64(F.lit("fit"), "g").alias("h"), "g").dropDuplicates(["g"]).orderBy("h", "g").limit(settings.sample).select("v").toArrow()
    sample = _matrix(chosen["v"].combine_chunks())
    cut = sample.shape[1] // 2
    most = max(settings.centroids, min(len(sample) // 20, math.isqrt(entries.count() // settings.cell_rows)))
    books = Codebooks((kmeans(sample[:, :cut], most, settings.rounds, 1), kmeans(sample[:, cut:], most, settings.rounds, 2)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(books.cells(_matrix(b.column("v"))).astype(np.int32))], names=["id", "v", "g", "cell"])

    id_type = df.schema[id_col].dataType.simpleString()
    index = materialise(entries.mapInArrow(assign, f"id {id_type}, v array<double>, g string, cell int"), "index")
    share = share_to_walk(books, sample, k, settings)
    # at most centroids x centroids rows
    held = np.zeros(len(books.halves[0]) * len(books.halves[1]), np.int64)
    for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect():
        held[r["cell"]] = r["n"]
    least = min(held.sum(), share * held.sum() + k + 1)
    first_shard, shard_count = _shards(held, settings.shard_rows)
    asked = rows.where("q").select("g", "v").dropDuplicates(["g"])
    blocks = max(1, -(-asked.count() // settings.block_queries))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column("cell").to_numpy()
            salt = b.column("salt").to_numpy() % shard_count[cell]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), b.column("cell"), pa.array((first_shard[cell] + salt).astype(np.int32))], names=["id", "v", "cell", "shard"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            one, two = books.split(_matrix(b.column("v")))
            at, shards, cells = [], [], []
            for i, (x, y) in enumerate(zip(one, two)):
                by: dict[int, list[int]] = {}
                for c in books.walk(x, y, held, least):
                    for s in range(first_shard[c], first_shard[c] + shard_count[c]):
                        by.setdefault(s, []).append(c)
                at += [i] * len(by)
                shards += by
                cells += by.values()
            yield pa.RecordBatch.from_arrays([b.column("g").take(pa.array(at)), b.column("v").take(pa.array(at)), pa.array(cells, pa.list_(pa.int32())), pa.array(shards, pa.int32())], names=["qg", "qv", "cells", "shard"])

    block = lambda g: F.pmod(F.xxhash64(F.lit("block"), g), F.lit(blocks)).cast("int")
    probes = asked.mapInArrow(probe, "qg string, qv array<double>, cells array<int>, shard int").withColumn("block", block("qg"))
    dealt = index.select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.lit(1 << 20)).alias("salt")).mapInArrow(deal, f"id {id_type}, v array<double>, cell int, shard int")
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def rank_shard(_key: tuple, asks: pa.Table, holds: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asks.num_rows and holds.num_rows:
            q, x = _matrix(asks.column("qv").combine_chunks()), _matrix(holds.column("v").combine_chunks())
            cell, ids = holds.column("cell").to_numpy(), holds.column("id").to_numpy()
            cells = asks.column("cells").to_pylist()
            for i, (v, own) in enumerate(zip(q, cells)):
                here = np.flatnonzero(np.isin(cell, own))
                best, score = nearest(v, x[here], ids[here], k + 1)
                out.append((i, here[best], score))
        at = pa.array(np.concatenate([np.full(len(o[1]), o[0]) for o in out]) if out else np.zeros(0, np.int64), pa.int64())
        which = pa.array(np.concatenate([o[1] for o in out]) if out else np.zeros(0, np.int64), pa.int64())
        return pa.table({"qg": asks.column("qg").take(at), "id": holds.column("id").take(which), "score": pa.array(np.concatenate([o[2] for o in out]) if out else np.zeros(0))})

    near = probes.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInArrow(rank_shard, f"qg string, id {id_type}, score double")
    place = F.row_number().over(Window.partitionBy("qg").orderBy("score", "id"))
    # written, so that the join deals both sides anew and a vector that many queries share can be split
    near = materialise(near.withColumn("n", place).where(F.col("n") <= k + 1).select("qg", "id", "score"), "near")
    discard(index)
    queries = rows.where("q").select(F.col("id").alias("query_id"), F.col("g").alias("qg")).distinct()
    own = near.join(queries, "qg").where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return own.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
