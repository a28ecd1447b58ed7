"""Near-duplicates by a chosen-path set similarity join, as connected components.

A document is the set of its word shingles. Documents of equal sets form a class,
and only classes are joined. A class has 128 minwise values. Several independent
trees branch the classes: each node picks two of the 128 coordinates, and a class
goes to the two children that its own values there name. A pair of similarity s
stays together in a tree with probability 1 - q, where q = (1 - s + s*q)^2: at
s = 0.8 that is 0.9375 a tree however deep, so ``trees`` = 4 misses 15 pairs in a
million, and fewer above.

A node of at most ``LEAF`` classes is compared exhaustively, and so is one of up to 16
times as many if few of them are not tied yet (see below). A larger one chooses
a pivot: classes whose sketch is 3/8 like its own or more are tied to it, unless earlier
ties connect them already, and those that look nearly equal stop there, because
whatever they may be linked with is by the triangle inequality tied to the pivot
too. The others branch on, until ties connect all classes of a node. What the
deepest level leaves, or one that leaves few classes, is tied to the pivot as well: a
tie never decides, it only says that two classes must be compared.

Ties form candidate components. Each receives its texts once, and there every
pair not yet connected, whose sketches and sizes allow a link, is confirmed on
the full sets. Components too large for a task are cut in blocks, and a task
takes a pair of blocks, so that no pair is left out.

Defined cases: a null text or one without words has the empty set and is linked
with nothing. Rows without doc_id count as the largest. Rows that repeat a doc_id
are rows of their own with the same component if their texts are linked. Extra
columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm._common import SLICE_BYTES, text_map, written
from pairloom.llm._groups import components, runs, smallest
from pairloom.llm._memo import give_back
from pairloom.llm._words import no_blanks, plain, slices, words

COORDINATES = 128
LEAF = 256
TREES = 4
DEPTH = 8
#: Equal values of 128 from which two classes of a leaf, or a class and a pivot, are tied.
TIED, TIED_TO_PIVOT = 77, 48
#: Equal values from which a class stops at a pivot.
LIKE_PIVOT = 109
#: Most classes and shingles of a candidate component that one task takes.
BLOCK_CLASSES, BLOCK_SHINGLES = 8192, 4_000_000
NO_ID = (1 << 63) - 1
#: Most ids of candidates that are broadcast, to keep other texts where they are; with more all texts are joined by a shuffle.
BROADCAST_IDS = 500_000

_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``width`` words."""
    different, number, bounds = no_blanks(words(texts, lower=True))
    raw = different.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))[number]
    # Shingles of the whole run of words; those that reach into the next text are left out below.
    some = max(0, len(hashes) - width + 1)
    whole = np.full(some, width, np.uint64)
    for k in range(width):
        whole = _mix(whole * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + some])
    out = []
    for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = stop - start
        if n >= width:
            out.append(np.unique(whole[start : stop - width + 1]))
            continue
        s = np.full(min(n, 1), n, np.uint64)
        for k in range(n):
            s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + hashes[start + k])
        out.append(s)
    return out


def _least(shingles: np.ndarray) -> np.ndarray:
    """The 128 minwise values of a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        v = _A[:, None] * x[None, k : k + 2048]
        v += _B[:, None]
        np.minimum(least, v.min(axis=1), out=least)
    return least


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The 128 minwise values of a set, 16 bits of each."""
    return (_least(shingles) & np.uint32(0xFFFF)).astype(np.uint16)


def _picked(nodes: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """For child j of each node a number of its own and the coordinate that it looks at."""
    pick = _mix(nodes.view(np.uint64) + np.uint64(j))
    return pick, ((pick >> np.uint64(7)) % np.uint64(COORDINATES)).astype(np.int64)


def _roots(trees: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [_picked(np.array([7919 * (t + 1)], np.int64), j) for t in range(trees) for j in (1, 2)]


def _below(pick: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _mix(pick ^ (value.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _sketched(width: int, trees: int) -> Callable:
    """Size, print and sketch of each set; first: whole values of the coordinates that the roots look at.

    16 bits are enough to compare with and to part a node, but not to part all documents:
    in a large corpus unlike ones would share them by chance.
    """
    at = np.concatenate([c for _, c in _roots(trees)])

    def compute(texts: pa.Array) -> list:
        sets = shingle_sets(texts, width)
        least = [_least(s) if len(s) else None for s in sets]
        return [
            np.array([len(s) for s in sets], np.int64),
            pa.array([xxhash.xxh3_128_digest(s) if len(s) else None for s in sets], pa.binary()),
            pa.array([None if v is None else (v & np.uint32(0xFFFF)).astype(np.uint16).tobytes() for v in least], pa.binary()),
            pa.array([None if v is None else v[at].tobytes() for v in least], pa.binary()),
        ]

    return compute


def _matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.uint16) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, COORDINATES)


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of one byte for each value: enough to compare with, not to branch by."""
    for batch in batches:
        if batch.num_rows:
            short = (_matrix(batch.column(2)) & 0xFF).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in short], pa.binary())], ["k", "n", "sig"])


def _children(nodes: np.ndarray, sigs: np.ndarray) -> list[np.ndarray]:
    """The two children of each node, for the class of each row."""
    at, out = np.arange(len(nodes)), []
    for j in (1, 2):
        pick, coordinate = _picked(nodes, j)
        out.append(_below(pick, sigs[at, coordinate]))
    return out


def _plant(trees: int) -> Callable:
    """(node, k, mark) of each class in the first level of each tree; mark: the pivot it is tied to, or itself."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(0).to_numpy(zero_copy_only=False)
            first = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(k), -1)
            nodes = [_below(pick, first[:, i]) for i, (pick, _) in enumerate(_roots(trees))]
            many = pa.array(np.tile(k, len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), many, many], ["node", "k", "mark"])

    return rows


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large nodes, each with its pivot and the pivot's mark: ties (tie = true) and children.

    A tie (a: class, b: pivot, and both marks) joins what had different marks. A child
    is (a: node, b: class, mark).
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        node, k, mark, pivot, pivot_mark = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        sigs, pivots = _matrix(batch.column(5)), _matrix(batch.column(6))
        alike = (sigs == pivots).sum(axis=1)
        tied = (alike >= TIED_TO_PIVOT) & (k != pivot) & (mark != pivot_mark)
        # The pivot has met all classes of this node, and so have, through it, those that look like it.
        on = (alike < LIKE_PIVOT) & (k != pivot)
        kids = _children(node[on], sigs[on])
        a = np.concatenate([k[tied], *kids])
        b = np.concatenate([pivot[tied], k[on], k[on]])
        marks = np.concatenate([mark[tied], mark[on], mark[on]])
        other = np.concatenate([pivot_mark[tied], mark[on], mark[on]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(a)) < tied.sum()), *map(pa.array, (a, b, marks, other))], ["tie", "a", "b", "mark", "other"])


def _marked(out: DataFrame) -> DataFrame:
    """The children of a level, each with the smallest mark that this level's ties lead to, in two steps.

    A mark is handed to all that a tie names, and from there to all that have one of
    these as their mark. What has one mark is tied together; the reverse may take
    another level.
    """
    ends = F.explode(F.array("a", "b", "mark", "other"))
    told = out.filter("tie").select(ends.alias("v"), F.least("a", "b", "mark", "other").alias("m")).unionByName(out.filter("NOT tie").select(F.col("b").alias("v"), F.col("mark").alias("m")))
    # Written first: a join of two shuffled tables is one whose hot marks Spark can split.
    least = written(told.groupBy("v").agg(F.min("m").alias("m")).filter("m < v"), "marks")
    kids = out.filter("NOT tie").groupBy(F.col("a").alias("node"), F.col("b").alias("k")).agg(F.min("mark").alias("mark"))
    kids = kids.join(least.select(F.col("v").alias("k"), F.col("m").alias("m1")), "k", "left").select("node", "k", F.coalesce(F.least("mark", "m1"), "mark").alias("mark"))
    return kids.join(least.select(F.col("v").alias("mark"), F.col("m").alias("m2")), "mark", "left").select("node", "k", F.coalesce("m2", "mark").alias("mark"))


def _leaf_ties(percent: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, "node"):
            k, mark, n, sigs = table.column("k").to_numpy(), table.column("mark").to_numpy(), table.column("n").to_numpy(), _matrix(table.column("sig"), np.uint8)
            sizes = np.diff(bounds)
            end = np.repeat(bounds[1:], sizes)
            at = np.arange(len(k))
            # Classes of one mark are one group; each group is named by its first class.
            names, group = np.unique(mark, return_inverse=True)
            named = np.empty(len(names), np.int64)
            named[group[::-1]] = k[::-1]
            a, b, near = [], [], []
            for step in range(1, longest := int(sizes.max(initial=1))):
                i = at[: len(k) - step][at[step:] < end[: len(k) - step]]
                j = i + step
                fits = (group[i] != group[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                i, j = i[fits], j[fits]
                for s in range(0, len(i), 1 << 14):
                    x, y = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
                    alike = (sigs[x] == sigs[y]).sum(axis=1) >= TIED
                    near.append((group[x[alike]], group[y[alike]]))
                if step % 16 == 0 or step == longest - 1 or sum(len(x) for x, _ in near) > 4096:
                    up = smallest(*(np.concatenate(x) for x in zip(*near)), len(names)) if near else np.arange(len(names))
                    moved, near = np.flatnonzero(up != np.arange(len(up))), []
                    a.append(named[moved])
                    b.append(named[up[moved]])
                    group = up[group]
            if a and sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return rows


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def links(sets: list[np.ndarray], sigs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(member, smallest member) of each linked group of a block, confirmed on the full sets."""
    n = np.array([len(s) for s in sets])
    root = np.arange(len(sets))
    for i in range(1, len(sets)):
        fits = (root[:i] != root[i]) & (100 * np.minimum(n[:i], n[i]) >= percent * np.maximum(n[:i], n[i]))
        before = np.flatnonzero(fits)
        alike = (sigs[before] == sigs[i]).sum(axis=1)
        order = np.argsort(-alike, kind="stable")
        todo = before[order[alike[order] >= TIED - 7]]
        while len(todo):
            j, todo = int(todo[0]), todo[1:]
            both = _common(sets[i], sets[j])
            if 100 * both >= percent * (n[i] + n[j] - both):
                root[root == max(root[i], root[j])] = min(root[i], root[j])
                todo = todo[root[todo] != root[i]]
    grown = np.bincount(root, minlength=len(root)) > 1
    return [(i, r) for i, r in enumerate(root.tolist()) if grown[r]]


def _confirm(width: int, percent: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, "block"):
            a, b = [], []
            for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                part = table.slice(start, stop - start)
                ks, sets, at, seen = [], [], [], set()
                texts = plain(part.column("text").combine_chunks())
                all_sets = slices(texts, SLICE_BYTES, lambda some: shingle_sets(some, width))
                for i, (k, found, told) in enumerate(zip(part.column("k").to_pylist(), all_sets, part.column("print").to_pylist())):
                    if k in seen:
                        continue
                    if xxhash.xxh3_128_digest(found) == told:  # else another row with the same doc_id
                        seen.add(k)
                        ks.append(k)
                        sets.append(found)
                        at.append(i)
                if len(ks) > 1:
                    for i, j in links(sets, _matrix(part.column("sig").take(pa.array(at))), percent):
                        a.append(ks[i])
                        b.append(ks[j])
                del part, texts, sets, all_sets
            give_back()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows


def _ties(classes: DataFrame, trees: int, percent: int, leaf: int, depth: int, few: int) -> DataFrame:
    """Pairs (a, b) of classes that must be compared; their components hold all links.

    Nodes that have ``few`` classes in all branch no more, as one task can compare these.
    A mark is a class that ties connect a class with. It starts as the class itself.
    """
    sigs = classes.select("k", "n", "sig")
    short = written(sigs.mapInArrow(_shortened, "k long, n long, sig binary"), "short")
    rows = written(classes.select("k", "roots").mapInArrow(_plant(trees), "node long, k long, mark long"), "nodes")
    ties, leaves = [], []
    for level in range(depth):
        # The pivot is a class that is not tied yet, if there is one.
        first = F.min(F.struct((F.col("mark") != F.col("k")).alias("tied"), "k", "mark")).alias("p")
        free = F.count_if(F.col("mark") == F.col("k")).alias("free")
        sizes = rows.groupBy("node").agg(F.count("*").alias("size"), free, first, F.min("mark").alias("m0"), F.max("mark").alias("m1"))
        # Small, or not very large with few that are not tied yet: compared exhaustively.
        done = (F.col("size") <= leaf) | (F.col("size") <= 16 * leaf) & (F.col("size") * F.col("free") <= leaf * leaf)
        sizes = sizes.filter("size > 1 AND m0 <> m1").select("node", "size", done.alias("done"), F.col("p.k").alias("pivot"), F.col("p.mark").alias("pivot_mark"))
        # Written first: a join of two shuffled tables is one whose hot nodes Spark can split.
        sizes = written(sizes, "sizes")
        sized = written(rows.join(sizes.select("node", "size", "done"), "node"), "sized")
        leaves.append(sized.filter("done").select("node", "k", "mark"))
        pivots = sizes.filter("NOT done").drop("done")
        left = pivots.agg(F.sum("size")).first()[0] or 0
        if not left:
            break
        large = sized.filter("NOT done").drop("done")
        if level == depth - 1 or left <= few:
            ties.append(large.join(pivots.drop("size"), "node").filter("mark <> pivot_mark").select(F.col("k").alias("a"), F.col("pivot").alias("b")))
            break
        # A pivot goes once to each share of some ``leaf`` classes of its node, so no share is hot.
        shares = F.ceil(F.col("size") / leaf).cast("long")
        handed = pivots.join(sigs.select(F.col("k").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)))
        met = large.withColumn("share", F.pmod(F.xxhash64("k"), shares)).drop("size").join(sigs.select("k", "sig"), "k")
        met = met.join(handed.drop("size"), ["node", "share"]).select("node", "k", "mark", "pivot", "pivot_mark", "sig", "pivot_sig")
        out = written(met.mapInArrow(_branch, "tie boolean, a long, b long, mark long, other long"), "branches")
        ties.append(out.filter("tie").select("a", "b"))
        rows = written(_marked(out), "nodes")
    small = reduce(DataFrame.unionByName, leaves).join(short, "k").select("node", "k", "mark", "n", "sig")
    found = written(small.repartition("node").sortWithinPartitions("node", "k").mapInArrow(_leaf_ties(percent), "a long, b long"), "ties")
    return reduce(DataFrame.unionByName, ties, found)


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    trees: int = TREES,
    leaf: int = LEAF,
    depth: int = DEPTH,
    block_classes: int = BLOCK_CLASSES,
    block_shingles: int = BLOCK_SHINGLES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the sketches are made for a similarity of 0.8 or more")
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    made = [T.StructField("n", T.LongType()), T.StructField("print", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("roots", T.BinaryType())]
    sketched = written(text_map(slim, "text", lambda: _sketched(width, trees), made).drop("text"), "sketches")
    least = sketched.filter("n > 0").groupBy("print").agg(F.min(F.struct("id", "n", "sig", "roots")).alias("x"))
    classes = written(least.select(F.monotonically_increasing_id().alias("k"), "print", F.col("x.id").alias("first"), F.col("x.n").alias("n"), F.col("x.sig").alias("sig"), F.col("x.roots").alias("roots")), "classes")

    groups = components(_ties(classes, trees, percent, leaf, depth, 2 * block_classes))
    members = classes.join(groups, "k")
    per = members.groupBy("c").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    per = written(per.select("c", F.ceil(F.greatest(F.col("size") / block_classes, F.col("weight") / block_shingles)).cast("long").alias("blocks")), "blocks")
    # One block: all of a component in a task. More: a task for each pair of blocks, each class in all pairs of its own.
    mine = F.pmod(F.xxhash64("k"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least(o, mine).alias("p"), F.greatest(o, mine).alias("q")))
    dealt = written(members.join(per, "c").withColumn("pair", F.explode(pairs)).select(F.xxhash64("c", "pair.p", "pair.q").alias("block"), "k", "first", "print", "sig"), "dealt")
    # Only the texts of candidates need to move.
    wanted = dealt.select("first").distinct()
    some = slim.withColumnRenamed("id", "first")
    texts = (some.join(F.broadcast(wanted), "first", "left_semi") if wanted.count() <= BROADCAST_IDS else some).join(dealt, "first")
    linked = texts.select("block", "k", "print", "sig", "text").repartition("block").sortWithinPartitions("block", "k")
    joined = written(linked.mapInArrow(_confirm(width, percent), "a long, b long"), "links")
    # What one task has seen whole is done; only groups of several blocks are still to be put together.
    joined = joined.select(F.col("a").alias("k"), F.col("b").alias("c")) if per.filter("blocks > 1").isEmpty() else components(joined)

    named = joined.join(classes.select("k", "first"), "k")
    # Written first, so that Spark can split a hot component.
    least = written(named.groupBy("c").agg(F.min("first").alias("root")), "roots")
    roots = named.join(least, "c").select("k", "root")
    by_print = classes.join(roots, "k", "left").select(F.col("print").alias("class_print"), F.coalesce("root", "first").alias("root"))
    found = sketched.select("id", "n", "print").join(by_print, F.col("print") == F.col("class_print"), "left")
    doc, root = F.nullif("id", F.lit(NO_ID)), F.nullif(F.coalesce("root", "id"), F.lit(NO_ID))
    return found.select(doc.alias("doc_id"), F.col("n").alias("n_shingles"), root.alias("component_id"), doc.eqNullSafe(root).alias("kept"))
