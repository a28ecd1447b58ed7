"""Groups of rows that lie side by side in a sorted partition, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm._common import written


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the bounds of each group; equal keys must be neighbours.

    A table holds the groups that end in a batch, so a group is held as a whole,
    but never more than one batch beside it.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        keys = batch.column(key)
        if keys[0] == keys[-1] and (len(held) == 1 or held[0].column(key)[-1] == keys[0]):
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        bounds = _bounds(whole.column(key))
        last = int(bounds[-2])
        yield whole.slice(0, last), bounds[:-1]
        held = whole.slice(last).to_batches()
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield whole, _bounds(whole.column(key))


def _bounds(keys: pa.ChunkedArray) -> np.ndarray:
    if len(keys) == 1:
        return np.array([0, 1])
    change = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy()
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(keys)]])


def smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of 0..n-1 the smallest one that the edges (a, b) connect it to."""
    up = np.arange(n)
    while len(a):
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
    return up


#: Edges that a task holds at once when it contracts them.
EDGES_AT_ONCE = 1 << 20


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the edges of a task: each vertex with the smallest one that they connect it to."""
    held: list[np.ndarray] = []

    def forest() -> tuple[np.ndarray, np.ndarray]:
        ends = np.concatenate(held, axis=1) if held else np.empty((2, 0), np.int64)
        names, place = np.unique(ends, return_inverse=True)
        up = smallest(*place.reshape(ends.shape), len(names))
        off = np.flatnonzero(up != np.arange(len(up)))
        return names[off], names[up[off]]

    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]))
        if sum(h.shape[1] for h in held) > EDGES_AT_ONCE:
            a, b = forest()
            held = [np.stack([a, b])]
            if len(a) > EDGES_AT_ONCE // 2:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                held = []
    a, b = forest()
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) of the same components: all edges of an ``a`` meet in a task, which keeps a forest of them.

    So about one edge for each vertex is left, however often it was tied.
    """
    return written(edges.select("a", "b").repartition("a").mapInArrow(_contract, "a long, b long"), "forest")


def components(edges: DataFrame) -> DataFrame:
    """(k, c) for each end of the edges (a, b): c is the smallest k connected to it.

    The edges are contracted within tasks first. Then come large-star and small-star
    rounds: every vertex hands its larger, then its smaller neighbours to the smallest
    one, until all edges point at the smallest vertex of their component. Hot vertices
    are no burden: minima are combined before the shuffle, and the joins that hand
    them out can be split.
    """
    now = written(_stars(contracted(edges.filter("a <> b"))), "edges")
    seen = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b")
        now = written(_stars(large), "edges")
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("k"), F.col("b").alias("c")).unionByName(now.select(F.col("b").alias("k"), F.col("b").alias("c"))).distinct()


def _stars(edges: DataFrame) -> DataFrame:
    """Small-star: each vertex and its smaller neighbours point at the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
