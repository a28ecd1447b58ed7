"""Exact deduplication by content-defined chunk recipes.

Each text is cut where a rolling hash of its last 32 bytes says so. A chunk's
identifier is its 64-bit hash, and the whole chunk store is checked: chunks are
grouped by (hash, bytes), so an identifier that stands for two byte strings is
found, and documents that hold one get a further variant number there. A
document is then an ordered list of identifiers, and only these lists (eight
bytes a chunk) are compared: the long texts are not moved a second time.

Defined cases: a null text is an empty one, and all empty texts are equal. Rows
that repeat a doc_id are rows of their own: exactly one row of each group stays,
the one with the largest doc_id (null is the smallest). Extra columns are
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm._common import written

#: Chunks end after a byte whose rolling hash has these bits clear (about 4 KiB apart) ...
MASK = np.uint32(0xFFF00000)
#: ... and have at least and at most so many bytes; the last may be shorter.
MIN_CHUNK, MAX_CHUNK = 256, 32768
WINDOW = 32
SEGMENT = 1 << 20
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=77) for b in range(256)], dtype=np.uint32)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end, over one flat byte array.

    The gear hash of a 32-byte window, h = sum(gear[b[i-j]] << j), by doubling:
    the hash of 2w bytes is that of the last w plus that of the w before, shifted.
    """
    found = []
    for start in range(0, len(data), SEGMENT):
        lead = min(start, WINDOW - 1)
        h = _GEAR[data[start - lead : start + SEGMENT]]
        for w in (1, 2, 4, 8, 16):
            older = h[:-w] << np.uint32(w)
            h = h.copy()
            h[w:] += older
        found.append(np.flatnonzero((h[lead:] & MASK) == 0) + start)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def chunk_ends(points: np.ndarray, start: int, end: int) -> list[int]:
    """Chunk ends of the text at [start, end), given the candidate positions inside it."""
    ends, last = [], start
    for p in points.tolist():
        p += 1
        while p - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if p - last >= MIN_CHUNK and p < end:
            ends.append(p)
            last = p
    while end - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if end > last:
        ends.append(end)
    return ends


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, memoryview]:
    """Offsets, bytes as an array and bytes as a view of a text column."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    return at, np.frombuffer(view, np.uint8), view


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, memoryview, list[memoryview]]]:
    at, data, view = _flat(batch.column(1))
    low = int(at[0])
    points = cut_points(data[low : int(at[-1])]) + low
    edges = np.searchsorted(points, at)
    for i in range(len(at) - 1):
        start, end = int(at[i]), int(at[i + 1])
        last, chunks = start, []
        for stop in chunk_ends(points[edges[i] : edges[i + 1]], start, end):
            chunks.append(view[last:stop])
            last = stop
        yield i, view[start:end], chunks


def _hash(chunk: memoryview, bits: int) -> int:
    h = xxhash.xxh3_64_intdigest(chunk)
    return (h & ((1 << bits) - 1)) - (1 << (bits - 1))


def _chunk_rows(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, chunks, size = [], [], 0
            for _, _, parts in _documents(batch):
                for part in parts:
                    hashes.append(_hash(part, bits))
                    chunks.append(bytes(part))
                    size += len(part)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(chunks, pa.binary())], ["h", "chunk"])
                    hashes, chunks, size = [], [], 0
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(chunks, pa.binary())], ["h", "chunk"])

    return rows


def _recipe_rows(bits: int, clash: dict[int, dict[bytes, int]]):
    """clash: for hashes of more than one byte string, each string's variant (almost always empty)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recipes, digests = [], []
            for _, text, parts in _documents(batch):
                ids = [_hash(part, bits) for part in parts]
                recipe = np.array(ids, np.int64).tobytes()
                if clash and any(h in clash for h in ids):
                    recipe += b"|" + b",".join(b"%d" % clash.get(h, {}).get(hashlib.sha256(p).digest(), 0) for h, p in zip(ids, parts))
                recipes.append(recipe)
                digests.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(recipes, pa.binary()), pa.array(digests, pa.string())], ["doc_id", "recipe", "text_sha256"])

    return rows


#: More colliding identifiers than this among 64-bit hashes mean a broken hash, not chance.
MOST_CLASHES = 10_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``hash_bits`` shortens the identifiers, which tests use to force collisions.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    store = slim.mapInArrow(_chunk_rows(hash_bits), "h long, chunk binary").groupBy("h", "chunk").agg(F.count("*").alias("uses"))
    # Equal bytes meet in one row, so an identifier is verified when one row has it.
    twins = store.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").limit(MOST_CLASHES + 1).collect()
    clash: dict[int, dict[bytes, int]] = {}
    if twins:
        if len(twins) > MOST_CLASHES:
            raise ValueError("chunk identifiers collide far beyond chance")
        some = docs.sparkSession.createDataFrame([(r.h,) for r in twins], "h long")
        for r in store.join(F.broadcast(some), "h").select("h", F.sha2("chunk", 256).alias("s")).orderBy("h", "s").collect():
            clash.setdefault(r.h, {})[bytes.fromhex(r.s)] = len(clash.get(r.h, {}))
    recipes = written(
        slim.mapInArrow(_recipe_rows(hash_bits, clash), "doc_id long, recipe binary, text_sha256 string").withColumn("row", F.monotonically_increasing_id()),
        "recipes",
    )
    # Written first: a join of two shuffled sides is one whose hot recipes Spark can split.
    groups = written(recipes.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size")), "groups")
    return recipes.join(groups, "recipe").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )
