"""Quality as a sparse rule ensemble over text statistics.

Small boosted trees are grown on statistics of labelled texts; every path in
them is a conjunctive rule; a logistic lasso weighs the rules and drops most;
the rules that stay are compiled into Spark column expressions over the
statistics columns.

Statistics cover the whole text.  Learning takes at most ``max_rows`` labelled
rows, chosen by a hash of doc_id.  A document labelled more than once counts by
its majority, a tie as good.  Null texts score like empty ones; a row without
doc_id is scored, counts as not held out, and is never learnt from; of texts
with one doc_id the one with the smallest statistics is learnt from.  With no
labels at all every score is 0.5, so nothing is rejected.  Other columns may
have any name; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.llm.common import only, tidy
from lodestone.llm.language_id import held_out

STATISTICS = ("log_bytes", "upper", "digit", "symbol", "mark", "stop", "white", "high", "word_mean", "word_long", "distinct", "top_word", "same_next", "line_mean", "line_repeat", "symbol_words")
CLASSES = np.full(256, 3, dtype=np.uint8)  # 0 lower, 1 upper, 2 digit, 3 symbol, 4 sentence mark, 5 white, 6 beyond ASCII, 7 '!?'
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[128:] = 0, 1, 2, 6
CLASSES[[*b".,;:'\"()-"]], CLASSES[[*b"!?"]], CLASSES[[9, 10, 11, 12, 13, 32]] = 4, 7, 5


def statistics(text: str | None) -> tuple[float, ...]:
    """One value for each name in STATISTICS; all are 0 for an empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    counts = np.bincount(CLASSES[np.frombuffer(raw, np.uint8)], minlength=8) / len(raw)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    return (
        float(np.log1p(len(raw))), counts[1], counts[2], counts[3], counts[4], counts[7], counts[5], counts[6],
        sum(map(len, words)) / n, max(map(len, words)) / len(raw), len(seen) / n, max(seen.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, len(raw) / len(lines) / 1000, 1 - len(set(lines)) / len(lines),
        sum(not (w[-1:].isalnum() or w[-1] > 127 or w[-1:] in b".,;:") for w in seen) / len(seen),
    )


def stem(df: DataFrame) -> str:
    """What the names of statistics start with, unlike those of all columns of ``df``."""
    out = "__stat_"
    while any(c.lower().startswith(out) for c in df.columns):
        out = "_" + out
    return out


def with_statistics(df: DataFrame) -> DataFrame:
    """``df`` with one double column for each statistic of its ``text``, behind all it has; one narrow pass."""
    names = [stem(df) + s for s in STATISTICS]
    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in names]])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(t) for t in batch.column("text").to_pylist()], dtype=np.float64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(values[:, k]) for k in range(len(names))]], names=[*batch.schema.names, *names])

    return df.mapInArrow(tidy(kernel), schema)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, threshold)


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, path: Rule, least: int, out: list[tuple[Rule, float, np.ndarray]], at: np.ndarray) -> None:
    """One regression tree on gradients; leaves and inner nodes go to ``out`` as rules with their value and rows."""
    if path:
        out.append((path, float(-g[at].sum() / (h[at].sum() + 1)), at))
    if depth == 0 or len(at) < 2 * least:
        return
    best = (1e-6, 0, 0.0)
    total = g[at].sum() ** 2 / (h[at].sum() + 1)
    for f in range(x.shape[1]):
        order = at[np.argsort(x[at, f], kind="stable")]
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        k = np.arange(least, len(at) - least + 1)
        k = k[v[k - 1] < v[np.minimum(k, len(at) - 1)]]
        if len(k):
            left, hl = gs[k - 1], hs[k - 1]
            gain = left**2 / (hl + 1) + (gs[-1] - left) ** 2 / (hs[-1] - hl + 1) - total
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (float(gain[j]), f, float((v[k[j] - 1] + v[k[j]]) / 2))
    gain, f, cut_at = best
    if gain <= 1e-6:
        return
    above = x[at, f] > cut_at
    for side in (False, True):
        grow(x, g, h, depth - 1, (*path, (f, side, cut_at)), least, out, at[above == side])


def fires(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, above, cut_at in rule:
        out &= (x[:, f] > cut_at) == above
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, shrink: float = 0.4, penalty: float = 0.002, steps: int = 400) -> dict:
    """Rules and weights of the log-odds that the label is 1."""
    rng = np.random.default_rng(7)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    odds, rules = np.full(len(y), base), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        rows = np.sort(rng.permutation(len(y))[: max(50, len(y) // 3)])
        found: list[tuple[Rule, float, np.ndarray]] = []
        grow(x, p - y, p * (1 - p), depth, (), max(5, len(rows) // 200), found, rows)
        for rule, value, _ in found:
            rules.setdefault(tuple(sorted(set(rule))), None)
            if len(rule) == depth:
                odds += shrink * np.clip(value, -3, 3) * fires(x, rule)
    names = list(rules)
    if not names:
        return {"bias": base, "rules": []}
    m = np.stack([fires(x, r) for r in names], axis=1).astype(np.float64)
    mean = m.mean(0)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-3))
    z = (m - mean) / scale
    step = 4.0 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    w, b, v, t = np.zeros(len(names)), base, np.zeros(len(names)), 1.0
    for _ in range(steps):  # accelerated proximal gradient
        e = 1 / (1 + np.exp(-(z @ v + b))) - y
        nw = v - step * (z.T @ e) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t, b = nw + (t - 1) / nt * (nw - w), nw, nt, b - step * e.mean()
    kept = [(names[i], float(w[i] / scale[i])) for i in np.flatnonzero(w)]
    return {"bias": float(b - (w * mean / scale).sum()), "rules": kept}


def compile_score(model: dict | None, start: str = "__stat_") -> Column:
    """The score as one Spark expression over the statistics columns."""
    if model is None:
        return F.lit(0.5)
    odds = F.lit(model["bias"])
    for rule, weight in model["rules"]:
        test = F.lit(True)
        for f, above, cut_at in rule:
            c = F.col(start + STATISTICS[f])
            test = test & ((c > cut_at) if above else (c <= cut_at))
        odds = odds + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, parts: int = 3, part: int = 1) -> dict | None:
    """The model, learnt on at most ``max_rows`` labelled rows outside the held-out part."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where("doc_id is not null and quality is not null").where(~held_out(parts, part))
    voted = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    sample = voted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # at most ``max_rows`` rows of 16 bytes: safe to send to every task
    texts = only(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")
    values = F.min(F.struct("y", *[f"__stat_{s}" for s in STATISTICS])).alias("values")
    rows = sorted((r["doc_id"], *r["values"]) for r in with_statistics(texts).groupBy("doc_id").agg(values).collect())
    if not rows:
        return None
    table = np.array(rows, dtype=np.float64)
    y, x = table[:, 1], np.ascontiguousarray(table[:, 2:])
    if y.min() == y.max():
        return {"bias": 4.0 if y[0] else -4.0, "rules": []}
    return fit(x, y)


def score(docs: DataFrame, model: dict | None, parts: int = 3, part: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""
    scored = with_statistics(only(docs, "doc_id", "text")).withColumn("score", compile_score(model))
    return scored.select("doc_id", held_out(parts, part).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of ``docs`` whose score is at least one half, with all their columns."""
    return with_statistics(docs).where(compile_score(model, stem(docs)) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
