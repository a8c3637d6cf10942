"""Language identification by a string kernel.

Two texts are as alike as the byte n-grams (one to three, blended, hashed) that
both hold, whatever their counts, over the geometric mean of how many each
holds.  The kernel is approximated on Nystroem landmarks and one-versus-rest
kernel ridge regression gives each language one weight per landmark, so that a
batch of texts is scored by two matrix products.

Learning takes at most ``per_language`` texts of each language, fewer where
``max_rows`` in all would be passed (but one of each at least), chosen by a hash
of doc_id: a bounded sample of every language there is.  Prediction sees the
whole text, however long, and nothing else, so other columns may have any name.

Null texts and texts without a letter are ``und`` with score 0.  A row without
doc_id is predicted, counts as not held out, and is never learnt from.  Without
any row to learn from everything is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, only, tidy, utf8

WIDTHS = (256, 4096, 8192)
FEATURES = sum(WIDTHS)
#: Languages whose counts are sent to every task at most.
MANY = 100_000
LETTER = re.compile(r"[^\W\d_]")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def presence(texts: list[bytes]) -> np.ndarray:
    """0/1 for each text (row) and hashed n-gram."""
    out = np.zeros((len(texts), FEATURES), dtype=np.uint8)
    for row, text in zip(out, texts, strict=True):
        for at in range(0, len(text), 1 << 20):  # bounded memory for very long texts; neighbours overlap by two bytes
            b = LOWER[np.frombuffer(text[at : at + (1 << 20) + 2], dtype=np.uint8)]
            row[b] = 1
            w = b.astype(np.uint32)
            two = w[:-1] * np.uint32(257) + w[1:]
            row[256 + (two * np.uint32(2654435761) >> np.uint32(20))] = 1
            if len(b) > 2:
                three = two[:-1] * np.uint32(65599) + w[2:]
                row[256 + 4096 + (three * np.uint32(2246822519) >> np.uint32(19))] = 1
    return out


def kernel_to(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of presence rows to landmark rows, as one matrix product."""
    a = x.astype(np.float32)
    norm = np.sqrt(np.maximum(a.sum(1), 1))[:, None] * np.sqrt(np.maximum(landmarks.sum(1), 1))[None, :]
    return a @ landmarks.T / norm


def fit(x: np.ndarray, y: list[str], n_landmarks: int, ridge: float) -> dict:
    """Landmarks (every language alike), and weights of each language on them."""
    names = sorted(set(y))
    n_landmarks = max(n_landmarks, 2 * len(names))
    codes = np.array([names.index(v) for v in y])
    chosen = np.lexsort((np.arange(len(y)), _turn(codes)))[:n_landmarks]
    landmarks = x[chosen].astype(np.float32)
    within = kernel_to(x[chosen], landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh((within + within.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = kernel_to(x, landmarks).astype(np.float64) @ root
    z = np.hstack([z, np.ones((len(z), 1))])
    target = np.where(codes[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    weight = 1.0 / np.bincount(codes)[codes]  # languages count alike
    zw = z * (weight / weight.mean())[:, None]
    solved = np.linalg.solve(zw.T @ z + ridge * np.eye(z.shape[1]), zw.T @ target)
    return {"names": names, "landmarks": np.packbits(x[chosen], axis=1), "weights": (root @ solved[:-1]).astype(np.float32), "bias": solved[-1].astype(np.float32)}


def _turn(codes: np.ndarray) -> np.ndarray:
    """The how-many-th of its language each row is."""
    out, seen = np.zeros(len(codes), int), {}
    for i, c in enumerate(codes.tolist()):
        out[i] = seen[c] = seen.get(c, -1) + 1
    return out


def held_out(parts: int, part: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == part, F.lit(False))


def learn(docs: DataFrame, per_language: int = 500, max_rows: int = 64_000, n_landmarks: int = 160, ridge: float = 0.1, parts: int = 4, part: int = 2) -> dict | None:
    """The model, learnt on the bounded sample of rows that aren't held out."""
    known = only(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(parts, part))
    counts = cut(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    n = counts.count()
    if not n:
        return None
    each = max(1, min(per_language, max_rows // n))
    # a draw by hash first, so that no task is sent more than about what it keeps
    rates = counts.select("lang", ((1.5 * each + 30) / F.col("n")).alias("rate"))
    drawn = known.join(F.broadcast(rates) if n <= MANY else rates, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")))
    sample = drawn.withColumn("rank", first).where(F.col("rank") <= each).select("doc_id", "lang", "text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keep = [i for i, t in enumerate(texts) if LETTER.search(t)]
            bits = np.packbits(presence([texts[i].encode() for i in keep]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(keep), batch.column("lang").take(keep), pa.array([b.tobytes() for b in bits], pa.binary())], names=["doc_id", "lang", "bits"])

    rows = sorted(sample.mapInArrow(tidy(kernel), "doc_id long, lang string, bits binary").collect(), key=lambda r: (r["doc_id"], r["lang"]))
    if not rows:
        return None
    x = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1), axis=1)[:, :FEATURES]
    return fit(x, [r["lang"] for r in rows], n_landmarks, ridge)


def predict(docs: DataFrame, model: dict | None, parts: int = 4, part: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        landmarks = model and np.unpackbits(model["landmarks"], axis=1)[:, :FEATURES].astype(np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part_ = batch.slice(at, 256)
                texts = part_.column("text").to_pylist()
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                has = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
                if model and has:
                    raw = utf8(part_.column("text"))
                    s = kernel_to(presence([raw[i] for i in has]), landmarks) @ model["weights"] + model["bias"]
                    best = s.argmax(1)
                    for i, k, v in zip(has, best.tolist(), s.max(1).tolist(), strict=True):
                        lang[i], score[i] = model["names"][k], min(1.0, max(0.0, (v + 1) / 2))
                yield pa.RecordBatch.from_arrays([part_.column("doc_id"), part_.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    read = only(docs, "doc_id", "text").withColumn("held_out", held_out(parts, part))
    return read.mapInArrow(tidy(kernel), "doc_id long, held_out boolean, lang_pred string, score double")
