"""Benchmark decontamination by template windows.

Words become a template: numbers, units and names (capitalised inside a
sentence) turn into typed placeholders, all else is lower-cased without its
punctuation.  Windows of eight template words of every benchmark item are
hash-joined with those of every document, so a question with other numbers or
names still matches; then the slots are checked: over all matched windows of one
alignment (item and document at one distance) one benchmark value must stand for
one document value and the other way round, or the window is thrown out.  An
item leaks into a document if ``least`` of its windows (all, if it has fewer)
are left in one alignment, however long it is, or a ``share`` of them and
``least`` over all alignments, or if a run of ``exact`` words (the whole item, if
it is shorter) is in the document as it is, whatever its case, marks and
literals.  Of a window that an item holds more than once its first place counts,
so repeats cost as many rows as they have windows and no pairs of places.

A capitalised word at a sentence's start may be a name or not, and what starts a
sentence in one text may not in another (behind a heading): windows are also
matched with every capitalised word as a name.  A window needs three literal
words; what only starts of sentences make literal must then be equal.  Items
shorter than a window are matched as one window of their own length.

The join is Spark's: both sides give rows of windows, joined on their hash and
compared word by word.  Before it, documents drop the windows that no item can
have by a Bloom filter of the benchmark's windows, of ``MOST_BITS`` bits at most;
documents themselves are never shuffled.

Null and empty texts match nothing.  A row without doc_id matches like any other
and an item without item_id too.  Rows that are equal in doc_id and text give one
row for each item, as do items equal in item_id and text.  Very long texts are
matched whole.  Only ids and texts are read, so other columns may have any name;
empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, mix64, only, runs, tidy

WIDTH, LITERALS = 8, 3
MOST_BITS = 1 << 27
#: Rows of 24 bytes that are sent to every task at most.
FEW = 1_000_000
NUMBER = re.compile(r"[+-]?[$€£]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th|%)?")
GLUED = re.compile(r"([+-]?[$€£]?\d+(?:[.,]\d+)*)([a-zA-Zµ°]+)")
NUMERALS = set("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split())
UNITS = set("mm cm m km inch inches foot feet ft yard yards mile miles g kg mg gram grams kilogram kilograms pound pounds lb lbs oz ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur gbp percent mph kmh kph hz khz mhz ghz kb mb gb tb watt watts kw volt volts degree degrees celsius fahrenheit meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters".split())
POWER = np.uint64(0x9E3779B97F4A7C15)


EDGES = "\"'()[]{}<>.,;:!?*#&|~`_-–—…“”‘’«»¿¡"


def code(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) | 1


SPECIAL, NAME = NUMERALS | UNITS, code("<name>")


class Words(dict):
    """Word -> number of its record; records are (code at a sentence's start, code inside, slot at start, slot inside, ends a sentence, value)."""

    def __init__(self, most: int = 500_000):
        self.most, self.rows, self.columns = most, [], None

    def __missing__(self, word: str) -> int:
        if word.islower() and word.isalpha() and word not in SPECIAL:
            h = code(word)
            row = (h, h, False, False, False, h)
        elif word[-1] in ",." and word[:-1].isalpha():  # as without the mark
            row = self.rows[self[word[:-1]]]
            row = (*row[:4], word[-1] == ".", row[5])
        else:
            row = self.record(word)
        self[word] = n = len(self.rows)
        self.rows.append(row)
        return n

    @staticmethod
    def record(word: str) -> tuple[int, int, bool, bool, bool, int]:
        core = word.strip(EDGES)
        end = word.rstrip("\"')]}”’»")[-1:] in (".", "!", "?", ":")
        lower, kind = core.lower(), None
        if not core:
            return 0, 0, False, False, end, 0
        if lower in NUMERALS:
            kind = "<number>"
        elif lower in UNITS:
            kind = "<unit>"
        elif not core.isalpha():
            if NUMBER.fullmatch(core):
                kind = "<number>"
            elif (m := GLUED.fullmatch(core)) and m[2].lower() in UNITS:
                kind = "<number><unit>"
        named = kind is None and core[0].isupper() and not (len(core) > 1 and core.isupper())
        value = code(lower)
        start = code(kind) if kind else value
        return start, NAME if named else start, kind is not None, kind is not None or named, end, value

    def look(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Of all words with a core: the text it is in, template code, slot or not, both again with every capitalised word as a name, value."""
        if len(self) > self.most:
            self.clear()
            self.rows, self.columns = [], None
        lists = [(t or "").split() for t in texts]
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), dtype=np.int64, count=int(sizes.sum()))
        if self.columns is None or len(self.columns[0]) < len(self.rows):
            new = self.rows[0 if self.columns is None else len(self.columns[0]) :]
            fresh = [np.array([r[k] for r in new], dtype=t) for k, t in enumerate((np.uint64, np.uint64, bool, bool, bool, np.uint64))]
            self.columns = fresh if self.columns is None else [np.concatenate(x) for x in zip(self.columns, fresh, strict=True)]
        first, inner, slot_first, slot_inner, ends, value = self.columns
        text = np.repeat(np.arange(len(texts)), sizes)
        begins = np.ones(len(ids), dtype=bool)
        begins[1:] = ends[ids[:-1]] | (text[1:] != text[:-1])
        codes, slots, values = np.where(begins, first[ids], inner[ids]), np.where(begins, slot_first[ids], slot_inner[ids]), value[ids]
        keep = codes != 0
        return text[keep], codes[keep], slots[keep], inner[ids][keep], slot_inner[ids][keep], values[keep]


class Hashes:
    """Hashes of the windows of any width over ``codes``: those of doubled widths are kept and put together."""

    def __init__(self, codes: np.ndarray):
        self.doubled = [(codes, POWER)]

    def of(self, width: int) -> np.ndarray:
        n = max(0, len(self.doubled[0][0]) - width + 1)
        while 1 << len(self.doubled) <= width:
            h, power = self.doubled[-1]
            m, half = max(0, len(h) - (1 << len(self.doubled) - 1)), 1 << len(self.doubled) - 1
            self.doubled.append((h[:m] * power + h[half : half + m], POWER ** np.uint64(2 * half)))
        out, at = None, 0
        for k in reversed(range(len(self.doubled))):
            if width >> k & 1:
                h, power = self.doubled[k]
                out = h[at : at + n] if out is None else out * power + h[at : at + n]
                at += 1 << k
        return mix64(out)


def literals(slots: np.ndarray, width: int) -> np.ndarray:
    """Whether the window that starts at each word has literals enough."""
    n = max(0, len(slots) - width + 1)
    total = np.concatenate([[0], np.cumsum(~slots)])
    return total[width : width + n] - total[:n] >= min(LITERALS, width)


PLAIN, NAMED, SAME = 0, 1, 2  # kinds of windows
WINDOWS = "item_id long, item long, kind int, width int, hash long, codes binary, place int, slots int, marks int, values binary, total int"


def item_windows(text: str | None, exact: int) -> list[tuple]:
    """kind, width, hash, codes, place, its slots and those of its placeholders (bits), values and how many windows the item has."""
    _, codes, slots, names, named_slots, values = Words().look([text])
    n = len(codes)
    if not n:
        return []
    width, out = min(WIDTH, n), []
    good = literals(slots, width)
    kinds = [(PLAIN, codes, slots)]
    if width >= LITERALS:  # shorter items have literals alone, which the exact match finds
        kinds.append((NAMED, names, named_slots))
    total = len({codes[i : i + width].tobytes() for i in np.flatnonzero(good).tolist()})
    for kind, own, marks in kinds:
        seen, hashes = set(), Hashes(own).of(width).tolist()
        for i in np.flatnonzero(good).tolist():
            key = own[i : i + width].tobytes()
            if key not in seen:
                seen.add(key)
                bits = [int(sum(1 << x for x in np.flatnonzero(m[i : i + width]).tolist())) for m in (slots, marks)]
                out.append((kind, width, hashes[i], key, i, *bits, values[i : i + width].tobytes(), total))
    width = min(exact, n)
    same = {values[i : i + width].tobytes(): h for i, h in enumerate(Hashes(values).of(width).tolist())}
    return out + [(SAME, width, h, key, 0, 0, 0, b"", total) for key, h in same.items()]


def benchmark_windows(benchmark: DataFrame, exact: int) -> DataFrame:
    """WINDOWS of all items."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, item, text in zip(*[batch.column(c).to_pylist() for c in ("item_id", "item", "text")], strict=True):
                rows = item_windows(text, exact)
                hashes = pa.array(np.array([r[2] for r in rows], dtype=np.uint64).view(np.int64))
                ints, binary = pa.int32(), pa.binary()
                columns = [pa.array([item_id] * len(rows), pa.int64()), pa.array([item] * len(rows), pa.int64()), pa.array([r[0] for r in rows], ints), pa.array([r[1] for r in rows], ints), hashes]
                columns += [pa.array([r[k] for r in rows], t) for k, t in ((3, binary), (4, ints), (5, ints), (6, ints), (7, binary), (8, ints))]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "item", "kind", "width", "hash", "codes", "place", "slots", "marks", "values", "total"])

    items = only(benchmark, "item_id", "text").where("text is not null").distinct()
    return items.withColumn("item", F.xxhash64("item_id", "text")).mapInArrow(tidy(kernel), WINDOWS)


class Filter:
    """Bits of the benchmark's windows, two for each, and the widths of each kind."""

    def __init__(self, windows: DataFrame):
        self.widths = sorted((r["kind"], r["width"]) for r in windows.select("kind", "width").distinct().collect())  # under 50
        self.shift = 64 - min(MOST_BITS.bit_length() - 1, max(16, (32 * windows.count()).bit_length()))
        place = F.array(F.shiftrightunsigned("hash", self.shift), F.shiftrightunsigned(F.shiftleft("hash", 20), self.shift))
        words = windows.select(F.explode(place).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
        self.bits = np.zeros(1 << 58 - self.shift, np.uint64)
        for r in words.toLocalIterator():  # a word for 64 bits
            self.bits[r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where hashes may be the benchmark's."""
        at = np.arange(len(h))
        for left in (0, 20):
            p = h[at] << np.uint64(left) >> np.uint64(self.shift)
            at = at[self.bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1) == 1]
        return at


def groups(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Slices of about ``most`` characters."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


HITS = "doc_id long, doc long, kind int, hash long, codes binary, at int, found binary"


def hits(docs: DataFrame, known: Filter) -> DataFrame:
    """Windows of documents that the benchmark may hold: HITS."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            ids, keys, texts = (batch.column(c).to_pylist() for c in ("doc_id", "doc", "text"))
            for a, b in groups(texts):
                text, codes, _, names, _, values = words.look(texts[a:b])
                starts = np.searchsorted(text, np.arange(b - a))
                rows: list[tuple] = []
                prepared = {PLAIN: (codes, Hashes(codes)), NAMED: (names, Hashes(names)), SAME: (values, Hashes(values))}
                for kind, width in known.widths:
                    own, hashes = prepared[kind]
                    h = hashes.of(width)
                    at = known.find(h)
                    at = at[text[at] == text[at + width - 1]]
                    where = text[at]
                    rows += zip((where + a).tolist(), [kind] * len(at), h[at].view(np.int64).tolist(), [own[i : i + width].tobytes() for i in at.tolist()], (at - starts[where]).tolist(), [values[i : i + width].tobytes() if kind != SAME else b"" for i in at.tolist()], strict=True)
                columns = [pa.array([ids[r[0]] for r in rows], pa.int64()), pa.array([keys[r[0]] for r in rows], pa.int64())]
                columns += [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.binary()), (4, pa.int32()), (5, pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "doc", "kind", "hash", "codes", "at", "found"])

    return docs.mapInArrow(tidy(kernel), HITS)


def held(rows: list[dict]) -> tuple[set[int], dict[int, bool], int]:
    """Of one document and item: the windows that hold, slots and whether their value is another, and the most windows of one alignment."""
    kept, changed, most, last = set(), {}, 0, None
    for r in sorted(rows, key=lambda r: (r["at"] - r["place"], r["place"], r["kind"])):
        j, n = r["place"], len(r["values"]) // 8
        if last != r["at"] - j:
            last, there, back, here = r["at"] - j, {}, {}, set()
        if j in here:
            continue
        own, other = (np.frombuffer(r[c], np.uint64).tolist() for c in ("values", "found"))
        spots = [x for x in range(n) if r["marks"] >> x & 1]
        slots = [x for x in spots if r["slots"] >> x & 1]
        if n - len(spots) < min(LITERALS, n) and any(own[x] != other[x] for x in spots if x not in slots):
            continue
        trial, kcab = dict(there), dict(back)
        if all(trial.setdefault(own[x], other[x]) == other[x] and kcab.setdefault(other[x], own[x]) == own[x] for x in spots):
            there, back = trial, kcab
            here.add(j)
            kept.add(j)
            most = max(most, len(here))
            changed |= {j + x: own[x] != other[x] for x in spots if x in slots or own[x] != other[x]}
    return kept, changed, most


FOUND = "doc_id long, doc long, item_id long, n_windows int, n_item_windows int, n_slots int, n_slots_changed int"


def matched(docs: DataFrame, benchmark: DataFrame, least: int, share: float, exact: int) -> DataFrame:
    """FOUND for each document (doc_id and the hash of its text) and item that it holds; ``docs`` has doc_id, text and doc."""
    windows = cut(benchmark_windows(benchmark, exact), "windows")
    met = hits(docs, Filter(windows)).join(windows, ["kind", "hash", "codes"])
    met = met.withColumn("pair", F.xxhash64("doc_id", "doc", "item"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in runs(batches, ["pair"]):
            out = []
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                rows = t.slice(x, y - x).to_pylist()
                first, same = rows[0], any(r["kind"] == SAME for r in rows)
                kept, changed, most = held([r for r in rows if r["kind"] != SAME])
                total = first["total"]
                if same or kept and (most >= min(least, total) or len(kept) >= max(min(least, total), share * total)):
                    out.append((first["doc_id"], first["doc"], first["item_id"], len(kept), total, len(changed), sum(changed.values())))
            kinds = [pa.int64()] * 3 + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["doc_id", "doc", "item_id", "n_windows", "n_item_windows", "n_slots", "n_slots_changed"])

    return met.repartition("pair").sortWithinPartitions("pair").mapInArrow(tidy(kernel), FOUND)


def text_key(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 6, share: float = 0.25, exact: int = 13) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    read = only(docs, "doc_id", "text").withColumn("doc", text_key(F.col("text")))
    return matched(read, benchmark, least, share, exact).drop("doc")


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 6, share: float = 0.25, exact: int = 13) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    read = only(docs, "doc_id", "text").withColumn("doc", text_key(F.col("text")))
    bad = cut(matched(read, benchmark, least, share, exact).select(F.col("doc_id").alias("bad_id"), F.col("doc").alias("bad")).distinct(), "leaks")
    if bad.count() <= FEW:  # 24 bytes each
        bad = F.broadcast(bad)
    held_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    left = held_.join(bad, (F.col("key") == F.col("bad")) & F.col("doc_id").eqNullSafe(F.col("bad_id")), "left_anti")
    return left.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
