"""Shared plumbing of the corpus operators: table reading and shared scratch tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm._memo import forget_other_stages, give_back
from pairloom.llm._words import cuts, plain

SLICE_BYTES = 4 << 20

_made: list[tuple[SparkSession, str]] = []
_own_root: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its whole name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def own(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[col(c) for c in columns])


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many ``_`` before it as it takes to differ from those taken, in any case of letters."""
    seen, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in seen:
            name = "_" + name
        seen.add(name.lower())
        out.append(name)
    return out


def prefix(taken: list[str]) -> str:
    """A beginning that no name has: for columns of one's own beside those of others."""
    some = "__"
    while any(t.startswith(some) for t in taken):
        some += "_"
    return some


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and Spark
    runs on one machine, as in tests, a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_root:
            _own_root.append("file://" + tempfile.mkdtemp(prefix="pairloom-"))
        root = _own_root[0]
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it again.

    A later loss of executors costs no recomputation of what is behind it. The
    table lives as long as the Python process; its folder goes at exit.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/pairloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def made_so_far() -> int:
    return len(_made)


def discard(since: int) -> None:
    """Delete the tables written since ``made_so_far()`` said so, but for the last one."""
    for entry in _made[since:-1]:
        _delete(*entry)
        _made.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _forget() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: the cluster clears its own checkpoint folder
            return


def text_map(docs: DataFrame, text_col: str, make: Callable[[], Callable[[pa.Array], list]], fields: list[T.StructField]) -> DataFrame:
    """``docs`` with further columns made from the texts, a few MB of them at a time.

    ``make()`` runs once in each task and gives the function from texts (null: empty)
    to columns. The other columns pass through as they are.
    """
    if any("." in c or "`" in c for c in docs.columns):
        # mapInArrow takes dots for the names of fields.
        names, new = docs.columns, [f.name for f in fields]
        made = text_map(docs.toDF(*fresh(new, *[f"c{i}" for i in range(len(names))])), f"c{names.index(text_col)}", make, fields)
        return made.toDF(*names, *new)
    at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_other_stages()
        compute = make()
        for batch in batches:
            texts = plain(batch.column(at))
            for start, stop in cuts(texts, SLICE_BYTES):
                part = batch.slice(start, stop - start)
                made = [pa.array(c) for c in compute(texts.slice(start, stop - start))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *(f.name for f in fields)])
        del compute
        give_back()

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, *fields]))


#: Most rows of a side that is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def join_small(large: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a written table: by broadcast if it has few rows (they are counted), else by a shuffle."""
    return large.join(F.broadcast(small) if small.count() <= most else small, on, how)
