"""Exact top-k inner-product search by Fagin's threshold algorithm.

Rows are held in blocks. A block keeps, for each dimension, the list of its rows by that component. A query reads the
lists of all dimensions in step, from the end that favours it (the largest components where its own is positive, the
smallest where it is negative), scores each row when it first meets it, and keeps the k best. The threshold is the
score that a row not met yet could have at most: the sum over dimensions of the query's component times the component
reached in that list. The search of a block stops when the threshold is less than the k-th best score; at an equal
threshold it goes on, since a row with that score and a smaller id may still come. The depth grows fourfold a round.

Queries are taken in blocks of bounded size, which are broadcast; rows stay where they are read. Each block of rows
sends at most k rows a query to the final ranking.

Scores are whole numbers, and exact: a block is held in single or double precision, in 64 bits or as Python integers,
the first of these in which no sum can be rounded.

Cases: vectors that are null, or hold a null, NaN or infinite component take no part; so do rows without id. Vectors of
different lengths have no product: a query meets those of its own length. Rows with the same id are one (the smallest
vector). Ties go to the smaller id. A score that a long can't hold is shown as the nearest one that it can; they
rank exactly up to 126 bits. Further columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.arrow import bounded_batches
from loomgraph.storage import Stage

K, SCALE = 20, 64
QUERY_BLOCK, ROW_BLOCK = 32768, 16384
FIRST_DEPTH, GROWTH = 16, 4
#: Sums below this are exact in single precision.
LARGEST_SINGLE = 1 << 24
#: Scaled components of greater size count as this, scores as that: a double and a long hold no more.
LARGEST, MOST = 1.7e308, (1 << 63) - 1


class Block:
    """Rows with sorted lists for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids)  # so that, at equal scores, places are in the order of ids
        self.ids, self.rows = ids[order], vectors[order]
        self.top = float(np.abs(self.rows).max(initial=0))
        self.fast = self.rows.astype(np.float32) if self.top < LARGEST_SINGLE else None
        self.kinds: dict[type, np.ndarray] = {np.float64: self.rows}
        self.lists = np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32)  # ascending, one list a dimension
        self.values = np.take_along_axis(self.rows, self.lists.T.astype(np.int64), axis=0).T

    def exact(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows and the query as numbers of a kind in which no sum is rounded."""
        most = float(np.abs(query).sum()) * self.top
        if most < LARGEST_SINGLE and self.fast is not None:
            return self.fast, query.astype(np.float32)
        kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object
        if kind not in self.kinds:
            self.kinds[kind] = whole_numbers(self.rows, kind)
        return self.kinds[kind], query if kind is np.float64 else whole_numbers(query, kind)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows but ``own``, best first."""
        n = len(self.ids)
        use = np.flatnonzero(query)
        matrix, weights = self.exact(query)
        single = matrix is self.fast
        whole = np.dtype(object if matrix.dtype == object else np.int64)
        column = query if single or matrix.dtype == np.float64 else weights  # for the threshold
        met = np.zeros(n, bool)
        at = np.searchsorted(self.ids, own)
        if at < n and self.ids[at] == own:
            met[at] = True  # the query's own row is no candidate
        best, scores = np.zeros(0, np.int64), np.zeros(0, whole)
        up, down = use[query[use] < 0], use[query[use] > 0]
        done, depth = 0, min(FIRST_DEPTH, n)
        while True:
            new = np.zeros(n, bool)
            if use.size:
                new[self.lists[up, done:depth].ravel()] = True
                new[self.lists[down, n - depth : n - done].ravel()] = True
            else:
                new[done:depth] = True  # a query of zeros scores every row 0: rows are met by id
            new &= ~met
            met |= new
            places = np.flatnonzero(new)
            if places.size:
                # scoring all rows at once is cheaper than picking many of them out
                got = (matrix @ weights)[places] if places.size * 4 > n else matrix[places] @ weights
                best = np.concatenate([best, places])
                scores = np.concatenate([scores, np.rint(got).astype(np.int64) if matrix.dtype.kind == "f" else got])
                if best.size > k:
                    order = np.lexsort((best, -scores))[:k] if best.size < 4 * k else self.first(best, scores, k)
                    best, scores = best[order], scores[order]
            if depth >= n:
                break
            if best.size >= k and use.size:
                ends = np.concatenate([self.values[up, depth - 1], self.values[down, n - depth]])
                if column is weights and not single and matrix.dtype.kind != "f":
                    ends = whole_numbers(ends, matrix.dtype)
                reached = (np.concatenate([column[up], column[down]]) * ends).sum()
                if reached < scores.min():
                    break
            elif best.size >= k:
                break
            done, depth = depth, min(n, depth * GROWTH)
        order = np.lexsort((best, -scores))
        return best[order], scores[order]

    @staticmethod
    def first(places: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        least = np.partition(scores, scores.size - k)[-k]
        some = np.flatnonzero(scores >= least)
        if some.size > 4 * k:  # many ties at the end: the smallest places of them
            above = some[scores[some] > least]
            tied = some[scores[some] == least]
            some = np.concatenate([above, tied[np.argsort(places[tied])[: k - above.size]]])
        return some[np.lexsort((places[some], -scores[some]))[:k]]


def whole_numbers(x: np.ndarray, kind) -> np.ndarray:
    """Doubles that are whole as integers of this kind; ``object`` holds any size."""
    return x.astype(np.int64) if np.dtype(kind) == np.int64 else np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): scaled and floored components of the rows that take part, one row an id."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(sound)
    # a double has no places behind the point from 2**52 on; floor() would make it a long
    floored = F.transform(x, lambda c: F.when(F.abs(SCALE * c) < 1 << 52, F.floor(SCALE * c).cast("double")).otherwise(F.least(F.greatest(SCALE * c, F.lit(-LARGEST)), F.lit(LARGEST))))
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), floored.alias("v"))
    if not out.groupBy("vec_id").count().filter("count > 1").isEmpty():
        out = out.groupBy("vec_id").agg(F.min("v").alias("v"))
    return out


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row of ``vectors`` (vec_id, embedding) that is a query."""
    rows = whole(vectors)
    queries = rows.filter(is_query)
    blocks = -(-queries.count() // QUERY_BLOCK) or 1
    parts = []
    for b in range(blocks):
        own = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        part = ranked(searched(rows, own, k), k)
        parts.append(part if blocks == 1 else Stage(part, "top-k").df)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def searched(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best rows of each block of rows for each query."""
    spark = rows.sparkSession
    bounded_batches(spark)
    table = queries.toArrow().sort_by("vec_id")  # one block of queries
    held = spark.sparkContext.broadcast(by_length(table.column("vec_id").combine_chunks(), table.column("v").combine_chunks()) if table.num_rows else {})
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("high", pa.int64())])

    def found(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        block = Block(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        query_ids, query_rows = held.value.get(block.rows.shape[1], (np.zeros(0, np.int64), None))
        for i in range(0, len(query_ids), 512):
            q, v, s, high = [], [], [], []
            for own, query in zip(query_ids[i : i + 512].tolist(), query_rows[i : i + 512], strict=True):
                places, scores = block.search(query, own, k)
                q.append(np.full(places.size, own))
                v.append(block.ids[places])
                if scores.dtype == object:  # what lies above 63 bits ranks first
                    high.append(np.array([max(-MOST, min(MOST, x >> 63)) for x in scores], np.int64))
                    s.append(np.array([x & MOST for x in scores], np.int64))
                else:
                    high.append(scores >> 63)
                    s.append(scores & MOST)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (q, v, s, high)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size: dict[int, int] = {}
        for batch in batches:
            for n, part in by_length(batch.column("vec_id"), batch.column("v")).items():
                blocks.setdefault(n, []).append(part)
                size[n] = size.get(n, 0) + len(part[0])
                if size[n] >= ROW_BLOCK:
                    yield from found(blocks.pop(n))
                    del size[n]
        for parts in blocks.values():
            yield from found(parts)

    return rows.mapInArrow(run, "query_id long, vec_id long, score long, high long")


def by_length(ids: pa.Array, column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors (a row each) of each length."""
    sizes, ids = column.value_lengths().to_numpy(zero_copy_only=False), ids.to_numpy()
    flat, begins = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    out = {}
    for n in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == n)
        out[n] = ids[own], flat[begins[own][:, None] + np.arange(n)] if n else np.zeros((own.size, 0))
    return out


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("high"), F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", F.when(F.col("high") > 0, MOST).when(F.col("high") < -1, -MOST).when(F.col("high") < 0, F.col("score") - MOST - 1).otherwise(F.col("score")).alias("score"))
    )
