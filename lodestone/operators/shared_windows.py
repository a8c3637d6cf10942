"""Runs of words that several documents hold, without sending every run of every document.

Each window of ``WIDTH`` words is stood for by one gram of ``GRAM`` of its words,
the one with the least hash; neighbouring windows mostly share it, so a document
has about one anchor for every dozen windows.  Equal windows have equal anchors:
only windows whose anchor another document has too can be shared, and only these
are sent, as digests of 128 bits of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH, GRAM = 50, 25
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
# Words whose hashes a task keeps, and rows that go into one batch
MOST_WORDS, MOST_ROWS = 500_000, 65_536


class WordHashes(dict):
    """64-bit hashes of words that are the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = found = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return found


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as ``generic.words_in`` cuts them."""
    return text.encode().split() if text else []


def anchors(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """The anchor of each window of ``WIDTH`` words, in order."""
    if len(words) < WIDTH:
        return np.empty(0, np.int64)
    step = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    gram, held, width = None, 0, 1
    while True:  # runs of doubled width, put together by the bits of GRAM
        if GRAM & width:
            gram = step if gram is None else gram[: len(step) - held] * np.uint64(pow(BASE, width, MASK + 1)) + step[held : held + len(gram)]
            held += width
        if held == GRAM:
            break
        step = step[:-width] * np.uint64(pow(BASE, width, MASK + 1)) + step[width:]
        width *= 2
    gram = (gram ^ (gram >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(29)
    least, width, wanted = gram, 1, WIDTH - GRAM + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = wanted - width
    return (np.minimum(least[: len(least) - rest], least[rest:]) if rest else least).view(np.int64)


def digests(words: list[bytes], places: np.ndarray) -> np.ndarray:
    """Digests of the distinct windows at these places, two long numbers each."""
    found = {blake2b(b"\0".join(words[i : i + WIDTH]), digest_size=16).digest() for i in places.tolist()}
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def _batches(rows: Iterator[tuple[object, np.ndarray]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of (key, numbers) as batches of one row a number, or a pair of them."""
    keys, parts, n = [], [], 0

    def batch() -> pa.RecordBatch:
        numbers = np.concatenate(parts)
        key = pa.array([k for k, _ in keys], schema.field(0).type).take(pa.array(np.repeat(np.arange(len(keys)), [m for _, m in keys])))
        return pa.RecordBatch.from_arrays([key, *[pa.array(np.ascontiguousarray(numbers[:, c])) for c in range(numbers.shape[1])]], schema=schema)

    for key, numbers in rows:
        if len(numbers):
            keys.append((key, len(numbers)))
            parts.append(numbers)
            n += len(numbers)
        if n >= MOST_ROWS:
            yield batch()
            keys, parts, n = [], [], 0
    if n:
        yield batch()


def _among_several(df: DataFrame, key: str, *by: str) -> DataFrame:
    """Rows of ``df`` whose ``by`` at least two keys have; one exchange."""
    all_ = Window.partitionBy(*by)
    return df.repartition(*by).withColumn("__least", F.min(key).over(all_)).withColumn("__most", F.max(key).over(all_)).where("__least < __most").select(*df.columns)


def shared_windows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_shared: how many distinct windows of a document another document holds too; documents without are left out."""
    docs = docs.select(F.col(key), F.col(text).alias("text")).where(F.length("text") >= 2 * WIDTH - 1)
    kind = docs.schema[key].dataType.simpleString()
    type_ = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def anchor_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        rows = ((k, np.unique(anchors(words_of(t), hashes)).reshape(-1, 1)) for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield from _batches(rows, pa.schema([(key, type_), ("anchor", pa.int64())]))

    def window_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def rows():
            for b in batches:
                for r, (k, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                    words = words_of(t)
                    yield k, digests(words, np.flatnonzero(np.isin(anchors(words, hashes), b.column(2)[r].values.to_numpy())))

        yield from _batches(rows(), pa.schema([(key, type_), ("h1", pa.int64()), ("h2", pa.int64())]))

    found = _among_several(docs.mapInArrow(anchor_kernel, f"{key} {kind}, anchor bigint"), key, "anchor")
    wanted = found.groupBy(F.col(key).alias("__key")).agg(F.collect_set("anchor").alias("anchors"))
    windows = docs.join(wanted, F.col(key).eqNullSafe(F.col("__key"))).select(key, "text", "anchors").mapInArrow(window_kernel, f"{key} {kind}, h1 bigint, h2 bigint")
    # a document that stands in several rows counts once
    return _among_several(windows.repartition("h1", "h2").dropDuplicates(), key, "h1", "h2").groupBy(key).agg(F.count("*").alias("n_shared"))
