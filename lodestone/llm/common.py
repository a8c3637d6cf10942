"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that lost executors never recompute it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete what ``cut`` wrote, once nothing reads it any more."""
    for df in written:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The columns an operator reads, typed; what else the table holds can't clash with its own names."""
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "page_id": "long", "url": "string", "item_id": "long"}
    return df.select(*[F.col(n).cast(kinds[n]).alias(n) for n in names])


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the output (uint64 in, uint64 out)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trim() -> None:
    """Give freed memory back: a Python worker lives on beside the next stages, which need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every libc can
        ctypes.CDLL(None).malloc_trim(0)


def tidy(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``kernel``, after which the worker gives its memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        trim()

    return run


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file; ``folder`` overrides the installed package."""
    return os.path.join(folder or os.environ.get("LODESTONE_TOKENIZERS", "/opt/tokenizers"), name)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of sorted batches: tables that hold whole runs of equal ``keys`` (integer columns), with the runs' bounds.

    A run may span batches; what a task holds at once is a batch and the longest run.
    """
    held: list[pa.RecordBatch] = []
    last = None

    def bounds(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        final = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
        if final == last and held and tuple(batch.column(k)[0].as_py() for k in keys) == last:
            held.append(batch)
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        b = bounds(t)
        if len(b) > 2:
            yield t.slice(0, b[-2]), b[:-1]
        held, last = t.slice(int(b[-2])).to_batches(), final
    if held:
        t = pa.Table.from_batches(held)
        yield t, bounds(t)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): of each id in ``edges`` (a, b) the smallest id that it reaches.

    Smallest labels spread over the edges and labels jump to their labels'
    labels, so rounds grow with the logarithm of a chain's length; each round
    is written to the shared folder in place of the one before.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component"), F.lit(True).alias("moved")), "labels")
    while label.where("moved").limit(1).count():
        near = both.join(label, both["b"] == label["id"]).groupBy(F.col("a").alias("near_id")).agg(F.min("component").alias("near"))
        step = label.join(near, label["id"] == near["near_id"], "left").select("id", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = label.select(F.col("id").alias("jump_id"), F.col("component").alias("jump"))
        fresh = step.join(jump, step["new"] == jump["jump_id"], "left").select("id", F.least("new", "jump").alias("component"), (F.least("new", "jump") != F.col("old")).alias("moved"))
        old, label = label, cut(fresh, "labels")
        discard(old)
    discard(both)
    return label.select("id", "component")


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps, whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
