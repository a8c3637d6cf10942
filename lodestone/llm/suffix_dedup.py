"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A byte goes if a string of ``depth`` bytes that covers it starts in a document
with a smaller doc_id too.  Suffixes are ordered only through ``depth`` bytes:
passes from the most significant digit on (eight bytes each) split groups and
drop suffixes that stand alone, and the groups left are the repeated windows.

Before that the corpus is dealt without moving it as suffixes: every window has
a smallest 16-byte gram (by hash), equal windows have equal ones, and runs of
windows with one such gram stay together as one short piece of text.  So

1. documents are laid out once in blocks, as a table bucketed by block;
2. each block sends the fingerprints of its grams to their range; ranges send
   back those that two documents hold;
3. blocks send the runs of those grams, each text once, to the gram's range,
   where equal runs are merged and the rest is radix sorted; back comes, for
   stretches of windows, the smallest doc_id that has them;
4. blocks mark the bytes and digest what is left.

What a block sends to a range is one row whatever its number of grams, and a
run that a block holds often is sent once, so no gram or passage, however
common, gathers more than a row per block.  A gram whose distinct runs would
fill a quarter of a range (boilerplate beside ever other words) is crowded: its
windows are dealt one by one, each to the range of its own hash, so that no
range gathers them and equal ones meet as before.

Null texts are empty.  Rows without doc_id are left out.  Repeated rows each
give a row; equal doc_ids never remove each other's bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, mix64, only, release, runs, shared_dir, tidy, trim

GRAM = 16
#: Windows whose grams are hashed at once, which bounds a task's memory.
STRETCH = 1 << 19
#: Bytes of run texts that a range orders at once.
SHARE = 2_000_000
#: Runs of a gram in a block from which on their distinct texts are counted (below, they count as one).
COUNTED = 4
MESSAGE = "block int, kind int, ids binary, a binary, b binary, c binary, d binary"
FIELDS = ["block", "kind", "ids", "a", "b", "c", "d"]
TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 5]


def message(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(TYPES)], names=FIELDS)


def load(data: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """Eight bytes from each place, big-endian."""
    view = np.ndarray((max(0, len(data) - 7),), ">u8", np.ascontiguousarray(data), strides=(1,))
    return view[at].astype(np.uint64)


def digits(depth: int) -> list[int]:
    """Places of the eight-byte digits that make up ``depth`` bytes; the last may overlap."""
    return [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]


def smallest_grams(data: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Of each of ``n`` windows the smallest hash of its grams."""
    wide, size = depth - GRAM + 1, 1
    u = load(data, slice(0, n + wide + 8))
    low = mix64(mix64(u[: n + wide - 1]) + u[8 : n + wide + 7])
    while size * 2 <= wide:  # by doubling
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    return np.minimum(low[:n], low[wide - size : wide - size + n])


def windows_hash(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Hash of each window that starts at ``at``."""
    out = np.full(len(at), depth, np.uint64)
    for digit in digits(depth):
        out = mix64(out + load(data, at + digit))
    return out


class Marked(NamedTuple):
    """Runs of windows, their distinct texts in order, and the number of each one's text."""

    start: np.ndarray
    doc: np.ndarray
    gram: np.ndarray
    seen: list[bytes]
    text: np.ndarray


class Block:
    """The documents of a block and their runs of windows with one smallest gram."""

    def __init__(self, t: pa.Table, depth: int):
        order = sorted(range(t.num_rows), key=lambda i: (ids[i], texts[i])) if (ids := t.column("doc_id").to_pylist()) and (texts := t.column("content").to_pylist()) else []
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        self.depth = depth
        self.lengths = np.array([len(x) for x in self.texts], dtype=np.int64)
        self.raw = b"".join(self.texts) + bytes(depth + 16)
        self.data = np.frombuffer(self.raw, np.uint8)
        ends = np.cumsum(self.lengths)
        self.begins = ends - self.lengths
        n = int(ends[-1]) - depth + 1 if len(ends) else 0
        if n <= 0:
            self.start = self.count = self.doc = np.zeros(0, np.int64)
            self.gram = np.zeros(0, np.uint64)
            return
        low = np.empty(n, np.uint64)
        for at in range(0, n, STRETCH):
            low[at : at + STRETCH] = smallest_grams(self.data[at : at + STRETCH + depth + 16], min(STRETCH, n - at), depth)
        valid = np.zeros(n + 1, dtype=np.int8)
        good = self.lengths >= depth
        np.add.at(valid, self.begins[good], 1)
        np.add.at(valid, np.minimum(ends[good] - depth + 1, n), -1)
        valid = np.cumsum(valid[:n], dtype=np.int8) > 0
        new = valid.copy()
        new[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
        new[self.begins[good]] = True
        self.start = np.flatnonzero(new)
        stop = np.append(self.start[1:], n)
        self.doc = np.searchsorted(self.begins, self.start, side="right") - 1
        empty = self.lengths[self.doc] == 0
        assert not empty.any()
        self.count = np.minimum(stop, ends[self.doc] - depth + 1) - self.start
        self.gram = mix64(low[self.start])  # a smallest hash is not even over its range

    def distinct(self, which: np.ndarray) -> int:
        """Distinct texts of runs."""
        raw, tail = self.raw, self.depth - 1
        return len({raw[a : a + c + tail] for a, c in zip(self.start[which].tolist(), self.count[which].tolist(), strict=True)})

    def marked(self, repeated: np.ndarray, crowded: np.ndarray, ranges: int) -> Marked:
        """Runs of repeated grams, those of crowded ones as single windows."""
        none = np.zeros(0, np.int64)
        if not len(repeated) or not len(self.gram):
            return Marked(none, none, self.gram[:0], [], none)
        key = spot(self.gram, ranges)
        at = np.minimum(np.searchsorted(repeated, key), len(repeated) - 1)
        which = np.flatnonzero(repeated[at] == key)
        heavy = np.isin(key[which], crowded)
        whole, split = which[~heavy], which[heavy]
        n = self.count[split]
        each = np.repeat(self.start[split], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = np.concatenate([self.start[whole], each])
        count = np.concatenate([self.count[whole], np.ones(len(each), np.int64)])
        seen: dict[bytes, int] = {}
        raw, tail = self.raw, self.depth - 1
        text = np.array([seen.setdefault(raw[a : a + c + tail], len(seen)) for a, c in zip(start.tolist(), count.tolist(), strict=True)], dtype=np.int64)
        return Marked(start, np.concatenate([self.doc[whole], np.repeat(self.doc[split], n)]), np.concatenate([self.gram[whole], windows_hash(self.data, each, self.depth)]), list(seen), text)


def spot(gram: np.ndarray, ranges: int) -> np.ndarray:
    """Range of a gram's hash in the upper bits, 40 bits of fingerprint below."""
    place = (gram >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)
    return place << np.uint64(40) | gram & np.uint64((1 << 40) - 1)


def five(key: np.ndarray) -> bytes:
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unfive(data: bytes, place: int) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel() | np.uint64(place) << np.uint64(40)


def repeated_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A block's repeated grams, and the crowded ones, of the messages of kind 0."""
    rows = [(int.from_bytes(i, "little"), a, b) for k, i, a, b in zip(*[t.column(c).to_pylist() for c in ("kind", "ids", "a", "b")], strict=True) if k == 0]
    none = [np.zeros(0, np.uint64)]
    return np.sort(np.concatenate([unfive(a, i) for i, a, _ in rows] or none)), np.concatenate([unfive(b, i) for i, _, b in rows] or none)


def radix(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``data`` at ``at`` that repeat through ``depth`` bytes: their numbers, in groups, and the groups' bounds."""
    live = np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    for digit in digits(depth):
        key = load(data, at[live] + digit)
        order = np.lexsort((key, group))
        live, key, group = live[order], key[order], group[order]
        new = np.ones(len(live), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new)
        keep = np.bincount(group)[group] > 1 if len(group) else new  # what stands alone needs no further digit
        live, group = live[keep], group[keep]
    bounds = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(live))
    return live, bounds


Span = tuple[int, int, int]


def first_docs(grams: np.ndarray, texts: list[bytes], low: np.ndarray, depth: int, most: int = 500_000) -> list[list[Span]]:
    """For each distinct run text: stretches of windows and the smallest doc_id that has them."""
    out: list[list[Span]] = [[(0, len(x) - depth + 1, v)] for x, v in zip(texts, low.tolist(), strict=True)]
    order = np.argsort(grams, kind="stable")
    edge = np.flatnonzero(np.diff(grams[order], prepend=grams[order[0]] + np.uint64(1))) if len(order) else np.zeros(0, int)
    sizes = np.diff(np.append(edge, len(order)))
    todo: list[int] = []
    total = 0
    for e, s in [*((int(e), int(s)) for e, s in zip(edge, sizes, strict=True) if s > 1), (-1, 0)]:
        if todo and (e < 0 or total > most):
            data = np.frombuffer(b"".join(texts[i] for i in todo) + bytes(8), np.uint8)
            n = np.array([len(texts[i]) for i in todo])
            begin = np.cumsum(n) - n
            windows = n - depth + 1
            owner = np.repeat(np.arange(len(todo)), windows)
            start = np.cumsum(windows) - windows
            offset = np.arange(int(windows.sum())) - start[owner]
            live, bounds = radix(data, begin[owner] + offset, depth)
            if len(live):
                own = low[np.array(todo)]
                value = own[owner]
                value[live] = np.repeat(np.minimum.reduceat(own[owner[live]], bounds[:-1]), np.diff(bounds))
                new = np.ones(len(value), dtype=bool)
                new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(value))
                for j in todo:
                    out[j] = []
                for j, p, q, v in zip(owner[first].tolist(), offset[first].tolist(), (last - start[owner[first]]).tolist(), value[first].tolist(), strict=True):
                    out[todo[j]].append((p, q, v))
            todo, total = [], 0
        if e >= 0:
            own_ = order[e : e + s].tolist()
            todo += own_
            total += sum(len(texts[i]) for i in own_)
    return out


def remove_repeats(docs: DataFrame, depth: int = 50, block_bytes: int | None = None, crowd: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row with a doc_id.

    ``crowd`` is the number of distinct runs beyond which a gram is crowded; it moves work, never rows.
    """
    if depth < 24:
        raise ValueError("depth must be 24 bytes at least")
    spark = docs.sparkSession
    read = only(docs, "doc_id", "text").where("doc_id is not null").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"))
    total = read.agg(F.sum(F.length("content"))).first()[0] or 0
    block_bytes = block_bytes or min(64 << 20, max(5 << 20, total // 2500))
    ranges = max(1, int(total // block_bytes) + 1)
    most = crowd if crowd is not None else block_bytes // 4 // (2 * depth)
    name = f"lodestone_blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/lodestone/{name}"
    laid = read.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int"))
    # one bucket for each block, as far as the catalogue's limit goes: later passes meet the documents where they lie
    laid.repartition(min(ranges, 50_000), "block").write.option("path", path).bucketBy(min(ranges, 50_000), "block").sortBy("block").saveAsTable(name)
    blocks = spark.table(name)
    release(spark)

    def grams(_: tuple, t: pa.Table) -> pa.Table:
        trim()
        b = Block(t, depth)
        key, doc = spot(b.gram, ranges), b.doc
        order = np.lexsort((doc, key))
        key, ids = key[order], np.array(b.ids, dtype=np.int64)[doc[order]] if len(order) else doc
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        if not len(first):
            return pa.Table.from_arrays([pa.array([], x) for x in types], names=["place", "block", "a", "b", "c"])
        size = np.diff(np.append(first, len(key)))
        often = np.flatnonzero(size >= COUNTED)
        texts_of = np.array([b.distinct(order[first[k] : first[k] + size[k]]) for k in often], dtype=np.int64)
        often, texts_of = often[texts_of >= COUNTED], texts_of[texts_of >= COUNTED]
        more = np.maximum.reduceat(ids, first) > np.minimum.reduceat(ids, first)
        key = key[first]
        place = (key >> np.uint64(40)).astype(np.int64)
        edge = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(key))
        block = t.column("block")[0].as_py()
        rows = []
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            p, q = np.searchsorted(often, [x, y])
            rows.append((int(place[x]), block, five(key[x:y]), np.packbits(more[x:y]).tobytes(), np.stack([often[p:q] - x, texts_of[p:q]]).astype("<i4").tobytes()))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate(types)], names=["place", "block", "a", "b", "c"])

    def shared(batches):
        for t, bounds in runs(batches, ["place"]):
            out = []
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = t.slice(x, y - x)
                place = part.column("place")[0].as_py()
                keys = [unfive(a, place) for a in part.column("a").to_pylist()]
                more = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8))[: len(k)] for k, m in zip(keys, part.column("b").to_pylist(), strict=True)])
                texts_of = [np.ones(len(k), np.int64) for k in keys]
                for own, c in zip(texts_of, part.column("c").to_pylist(), strict=True):
                    at, n = np.frombuffer(c, "<i4").reshape(2, -1)
                    own[at] = n
                key, block = np.concatenate(keys), np.repeat(part.column("block").to_numpy(), [len(k) for k in keys])
                order = np.argsort(key, kind="stable")
                s = key[order]
                again = more[order].astype(bool)
                again[1:] |= s[1:] == s[:-1]
                again[:-1] |= s[1:] == s[:-1]
                first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                heavy = np.zeros(len(key), dtype=bool)
                heavy[order] = np.repeat(np.add.reduceat(np.concatenate(texts_of)[order], first) > most, np.diff(np.append(first, len(s))))
                hit = order[again]
                hit = hit[np.argsort(block[hit], kind="stable")]
                edge = np.append(np.flatnonzero(np.diff(block[hit], prepend=-1)), len(hit))
                out += [(int(block[hit[p]]), 0, place.to_bytes(4, "little"), five(key[hit[p:q]]), five(key[hit[p:q]][heavy[hit[p:q]]]), None, None) for p, q in zip(edge[:-1], edge[1:], strict=True)]
            yield from message(out).to_batches()

    sent = blocks.groupBy("block").applyInArrow(grams, "place int, block int, a binary, b binary, c binary")
    back = cut(sent.repartitionById(ranges, F.col("place")).sortWithinPartitions("place", "block").mapInArrow(tidy(shared), MESSAGE), "repeated")
    release(spark)

    def texts(_: tuple, t: pa.Table, m: pa.Table) -> pa.Table:
        trim()
        rows = []
        if t.num_rows and m.num_rows:
            b = Block(t, depth)
            run = b.marked(*repeated_of(m), ranges)
            seen, text = run.seen, run.text
            ids = np.array(b.ids, dtype=np.int64)[run.doc]
            low, high = np.full(len(seen), np.iinfo(np.int64).max), np.full(len(seen), np.iinfo(np.int64).min)
            np.minimum.at(low, text, ids)
            np.maximum.at(high, text, ids)
            gram = np.zeros(len(seen), np.uint64)
            gram[text] = run.gram
            place = (spot(gram, ranges) >> np.uint64(40)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            edge = np.append(np.flatnonzero(np.diff(place[order], prepend=-1)), len(order))
            block = t.column("block")[0].as_py()
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                own = order[x:y]
                rows.append((int(place[own[0]]), block, own.astype("<i4").tobytes(), gram[own].tobytes(), np.stack([low[own], high[own]]).tobytes(), np.array([len(seen[i]) for i in own], "<i4").tobytes(), b"".join(seen[i] for i in own)))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate((pa.int32(), pa.int32(), *[pa.binary()] * 5))], names=["place", "block", "ids", "a", "b", "c", "d"])

    def sorted_(batches):
        for t, bounds in runs(batches, ["place"]):
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = []
                for r in t.slice(x, y - x).select(["block", "ids", "a", "b", "c", "d"]).to_pylist():
                    ends = np.cumsum(np.frombuffer(r["c"], "<i4"))
                    part.append((r["block"], np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["a"], np.uint64), *np.frombuffer(r["b"], np.int64).reshape(2, -1), ends, r["d"]))
                # a share of the range's grams at a time, which bounds what is held as single texts
                shares = 1 + sum(len(r[-1]) for r in part) // SHARE
                for share in range(shares):
                    yield from message(answered(part, share, shares)).to_batches()
                    trim()

    def answered(part: list[tuple], share: int, shares: int) -> list[tuple]:
        number: dict[bytes, int] = {}
        low, grams_, entries, out = [], [], [], []
        for block, ids, gram, lo, hi, ends, raw in part:
            own, mine = np.flatnonzero((gram & np.uint64(0xFFFFF)) % np.uint64(shares) == np.uint64(share)), []
            for g, v, p, q in zip(gram[own].tolist(), lo[own].tolist(), np.where(own > 0, ends[own - 1], 0).tolist(), ends[own].tolist(), strict=True):
                k = number.setdefault(raw[p:q], len(number))
                if k == len(low):
                    low.append(v)
                    grams_.append(g)
                elif v < low[k]:
                    low[k] = v
                mine.append(k)
            entries.append((block, ids[own], hi[own], mine))
        spans = first_docs(np.array(grams_, np.uint64), list(number), np.array(low, np.int64), depth)
        for block, ids, hi, mine in entries:
            found = [(i, p, q, v) for i, h, k in zip(ids.tolist(), hi.tolist(), mine, strict=True) for p, q, v in spans[k] if v < h]
            if found:
                c = np.array(found, dtype=np.int64).T
                out.append((block, 1, c[0].astype("<i4").tobytes(), c[1].astype("<i4").tobytes(), c[2].astype("<i4").tobytes(), c[3].tobytes(), None))
        return out

    asked = blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(texts, "place int, block int, ids binary, a binary, b binary, c binary, d binary")
    answer = cut(asked.repartitionById(ranges, F.col("place")).sortWithinPartitions("place", "block").mapInArrow(tidy(sorted_), MESSAGE), "covered")
    release(spark)

    def digest(_: tuple, t: pa.Table, m: pa.Table) -> pa.Table:
        trim()
        if not t.num_rows:
            return pa.Table.from_arrays([pa.array([], x) for x in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        b = Block(t, depth)
        delta = np.zeros(len(b.data) + 1, np.int32)
        own = b.marked(*repeated_of(m), ranges)
        rows = [r for r in m.to_pylist() if r["kind"] == 1]
        if rows and len(own.start):
            i, p, q = (np.concatenate([np.frombuffer(r[c], "<i4") for r in rows]).astype(np.int64) for c in ("ids", "a", "b"))
            v = np.concatenate([np.frombuffer(r["c"], np.int64) for r in rows])
            order = np.argsort(i, kind="stable")
            i, p, q, v = i[order], p[order], q[order], v[order]
            x, y = np.searchsorted(i, own.text), np.searchsorted(i, own.text, side="right")
            n = y - x
            run = np.repeat(np.arange(len(n)), n)
            at = np.repeat(x, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            ids = np.array(b.ids, dtype=np.int64)
            hit = v[at] < ids[own.doc[run]]
            run, at = run[hit], at[hit]
            np.add.at(delta, own.start[run] + p[at], 1)
            np.add.at(delta, own.start[run] + q[at] - 1 + depth, -1)
        gone = np.cumsum(delta, dtype=np.int32)[: len(b.data)] > 0
        out = []
        for doc, begin, n in zip(b.ids, b.begins.tolist(), b.lengths.tolist(), strict=True):
            mask = gone[begin : begin + n]
            removed = int(mask.sum())
            kept = b.data[begin : begin + n][~mask] if removed else b.data[begin : begin + n]
            out.append((doc, n, removed, int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if removed else 0, hashlib.sha256(kept.tobytes()).hexdigest()))
        return pa.Table.from_arrays([pa.array([r[k] for r in out], x) for k, x in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return blocks.groupBy("block").cogroup(back.union(answer).groupBy("block")).applyInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
