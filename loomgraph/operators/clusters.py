"""K-means by Lloyd's iterations with fixed initial centres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assigned(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, cluster): the nearest centre, the first of equally near ones. Centres are k rows: they are broadcast."""
    held = points.sparkSession.sparkContext.broadcast(centres)
    schema = pa.schema([("id", pa.int64()), ("cluster", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = nearest(matrix(batch), held.value)
                yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(near.astype(np.int32))], schema=schema)

    return points.select("id", "features").mapInArrow(work, "id long, cluster int")


def moved(points: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The means of the points nearest to each centre; centres without points stay. Each batch sends k sums."""
    held = points.sparkSession.sparkContext.broadcast(centres)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                near = nearest(x, held.value)
                found = np.unique(near)
                sums = [x[near == c].sum(axis=0) for c in found]
                counts = [int((near == c).sum()) for c in found]
                columns = [pa.array(found, pa.int32()), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sums"])

    parts = points.select("features").mapInArrow(work, "cluster int, n long, sums array<double>")
    flat = parts.select("cluster", "n", F.posexplode("sums").alias("d", "s"))
    rows = flat.groupBy("cluster", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # k times dimensions
    out = centres.copy()
    for r in rows:
        out[r["cluster"], r["d"]] = r["s"] / r["n"]
    return out


def kmeans(points: DataFrame, centres: np.ndarray, iterations: int = 10, tolerance: float = 0.0) -> np.ndarray:
    """Centres after at most so many iterations over ``points`` (id, features)."""
    for _ in range(iterations):
        new = moved(points, centres)
        done = np.abs(new - centres).max(initial=0) <= tolerance
        centres = new
        if done:
            break
    return centres


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("features").to_pylist(), np.float64)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
