"""Best-fit packing by bin completion.

Every document becomes its token ids and one end mark; only what is longer than
a sequence is cut, the first piece taking the odd length.  A packing depends on
lengths alone, so the plan is made on the histogram of piece lengths, which has
no more entries than a sequence has tokens however large the corpus is: bin
completion takes the longest piece left and enumerates the undominated fillings
of the room beside it, least waste first, each with how many it takes of a
length; branch and bound goes on with the best-fit-decreasing packing as
incumbent and waste bounds to prune, until the number of sequences is known to
be the least or ``effort`` nodes are seen.  Pieces then find their place by their rank among the
pieces of one length: ranks are counted in salted chunks, so that no length,
however common, meets in one task.

Null and empty texts are the end mark alone.  Rows without doc_id are packed
like others.  Repeated rows are packed each.  An empty table gives no rows.
Very long texts are encoded whole and cut.  Only doc_id and text are read, so
other columns may have any name.  An added token in a text, such as an end
mark, is its id, as the tokenizer's defaults give it.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, only, tidy, tokenizer_path


class OddSpace(Exception):
    """A space that stands beside other white space."""


class Encoder(dict):
    """What follows a space, up to the next -> its ids as little-endian bytes; at most ``most`` are remembered.

    A single space between two visible characters always starts a new token, so
    texts without any other use of the space are encoded from space to space; a
    mark behind a letter is a token of its own as well.  Other texts are encoded
    whole, those that hold an added token (such as an end mark) by the tokenizer
    itself, which gives that token's id.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.most = most
        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path.removesuffix(".json") + ".tiktoken", "rb"))}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.marks = {m: array("I", self.encode(m)).tobytes() for m in ",.;:!?"}

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise OddSpace
        mark = self.marks.get(chunk[-1])
        if mark and chunk[-2:-1].isalpha():
            found = self[chunk[:-1]] + mark
        else:
            found = array("I", self.encode(" " + chunk)).tobytes()
        if len(chunk) <= 48:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = found
        return found

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.added):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise OddSpace
            return array("I", self.encode(first)).tobytes() + b"".join(map(self.__getitem__, rest))
        except OddSpace:
            return array("I", self.encode(text)).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, size: int, path: str, end_id: int) -> DataFrame:
    """One row for each piece of each document."""
    last = np.array([end_id], dtype="<u4").tobytes()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode.ids(text) + last
                total = len(ids) // 4
                first = total % size or size
                starts = [0, *range(first, total, size)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], total], strict=True)):
                    out.append((doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return only(docs, "doc_id", "text").mapInArrow(tidy(kernel), PIECES)


Filling = tuple[tuple[int, int], ...]  # (length, how many of it), longest first


def sums(taken: Filling) -> tuple[int, int]:
    """What some, and what two or more, of the pieces add up to, as bits."""
    one, more = 0, 0
    for n, k in taken:
        for _ in range(k):
            more |= (more | one) << n
            one |= 1 << n
    return 1 | one | more, more


def dominated(taken: Filling, waste: int, free: int) -> bool:
    """Whether a piece that is left over (bits ``free``) could stand for some of the pieces.

    It may be longer than they are together, by the waste at most, or as long
    as two or more of them: the exchange never needs another sequence.
    """
    some, more = sums(taken)
    if more & free:
        return True
    reach, width = some << 1, 1  # moved up by 1 to ``waste``
    if not waste:
        return False
    while width < waste:
        step = min(width, waste - width)
        reach |= reach << step
        width += step
    return bool(reach & free)


def fillings(counts: list[int], room: int, most: int) -> Iterator[tuple[int, Filling]]:
    """Undominated fillings of ``room`` that waste at most ``most``, least waste first: (waste, pieces)."""
    lengths = [n for n in range(1, min(room, len(counts) - 1) + 1) if counts[n]]
    full = (1 << room + 1) - 1
    reach = [1]  # bit s of reach[k]: the first k lengths can add up to s
    for n in lengths:
        r, left, step = reach[-1], min(counts[n], room // n), 1
        if r != full:
            while left:
                k = min(step, left)
                r |= r << n * k & full
                left, step = left - k, step * 2
        reach.append(r)
    free = sum(1 << n for n in lengths)

    def branches(top: int, left: int) -> Iterator[tuple[int, int, int, int]]:
        for i in range(min(top, bisect_right(lengths, left)) - 1, -1, -1):
            if not reach[i + 1] >> left & 1:
                return
            n = lengths[i]
            for k in range(min(counts[n], left // n), 0, -1):
                if reach[i] >> left - k * n & 1:
                    yield i, left - k * n, n, k

    def exactly(total: int) -> Iterator[Filling]:
        if not total:
            yield ()
            return
        taken: list[tuple[int, int]] = []
        stack = [branches(len(lengths), total)]
        while stack:
            found = next(stack[-1], None)
            if found is None:
                stack.pop()
                if taken:
                    taken.pop()
                continue
            i, left, n, k = found
            taken.append((n, k))
            if left:
                stack.append(branches(i, left))
            else:
                yield tuple(taken)
                taken.pop()

    for waste in range(min(most, room) + 1):
        if reach[-1] >> room - waste & 1:
            for taken in exactly(room - waste):
                gone = sum(1 << n for n, k in taken if k == counts[n])
                if not dominated(taken, waste, free & ~gone):
                    yield waste, taken


Pattern = tuple[int, Filling]  # how many sequences hold these pieces


def best_fit(counts: list[int], size: int) -> list[Pattern]:
    """Best-fit-decreasing, like sequences at once: the incumbent."""
    rooms: dict[int, list[list]] = {}  # room -> [sequences, pieces]
    for n in range(size, 0, -1):
        left = counts[n]
        for room in sorted(r for r in rooms if r >= n):
            while left and rooms.get(room):
                times, taken = rooms[room].pop()
                k = room // n
                used = min(times, left // k)
                if used < times:
                    rooms[room].append([times - used, taken])
                if used:
                    rooms.setdefault(room - k * n, []).append([used, (*taken, (n, k))])
                    left -= used * k
                elif left:  # one sequence takes what is left
                    times, taken = rooms[room].pop()
                    if times > 1:
                        rooms[room].append([times - 1, taken])
                    rooms.setdefault(room - left * n, []).append([1, (*taken, (n, left))])
                    left = 0
        k = size // n
        if left // k:
            rooms.setdefault(size - k * n, []).append([left // k, ((n, k),)])
        if left % k:
            rooms.setdefault(size - left % k * n, []).append([1, ((n, left % k),)])
    return [(times, taken) for found in rooms.values() for times, taken in found]


def bound(counts: list[int], size: int) -> int:
    """Sequences that the pieces need at least: by their sum, and beside those over half a sequence."""
    c = np.array(counts, dtype=np.int64)
    n = np.arange(size + 1)
    many, total = np.cumsum(c), np.cumsum(c * n)
    half = size // 2
    k = np.arange(half + 1)
    large, middle = many[size] - many[size - k], many[size - k] - many[half]
    room = middle * size - (total[size - k] - total[half])
    below = total[half] - np.where(k > 0, total[k - 1], 0)
    return int(max(-(-total[size] // size), (large + middle + np.maximum(0, -(-(below - room) // size))).max()))


def plan(histogram: dict[int, int], size: int, effort: int = 4000) -> list[Pattern]:
    """How many sequences hold which pieces, of the histogram of piece lengths: bin completion, depth first.

    A node takes the longest piece left and an undominated filling of the room
    beside it, the least waste first, as many times as the histogram allows:
    what was the best filling stays it while its pieces last.  Other fillings,
    and fewer times (halved), are tried on the way back.  A node is left if
    its waste, or what ``bound`` asks for the rest, can't beat the incumbent.
    The search ends at the bound, or when nothing is left to try, with the least
    number of sequences; or after ``effort`` nodes with the best it has seen.
    """
    counts = [0] * (size + 1)
    for n, c in histogram.items():
        counts[n] = c
    total, least = sum(n * c for n, c in enumerate(counts)), bound(counts, size)
    best = best_fit(counts, size)
    fewest = sum(t for t, _ in best)

    def choices(longest: int, waste: int) -> Iterator[tuple[int, int, Filling]]:
        counts[longest] -= 1
        # the first dive may end where the incumbent does: as good, and by completion
        allowed = (fewest - settled) * size - total - waste
        found = fillings(counts, size - longest, allowed)
        counts[longest] += 1
        for extra, taken in found_with(found, longest):
            need = dict(taken)
            need[longest] = need.get(longest, 0) + 1
            times = min(counts[n] // k for n, k in need.items())
            if extra:
                times = max(1, min(times, allowed // extra))
            pieces = tuple(sorted(need.items(), reverse=True))
            while times:
                yield times, extra, pieces
                times //= 2

    def found_with(found: Iterator[tuple[int, Filling]], longest: int) -> Iterator[tuple[int, Filling]]:
        while True:  # the fillings are looked for beside the longest piece, whenever that is asked for
            counts[longest] -= 1
            one = next(found, None)
            counts[longest] += 1
            if one is None:
                return
            yield one

    settled, longest, waste, used, steps = 0, size, 0, 0, 0
    path: list[tuple[int, Filling, int, int, int]] = []  # times, pieces, and longest, waste, used before
    stack: list[Iterator] = []

    def opened() -> Iterator | None:
        nonlocal longest
        while longest and not counts[longest]:
            longest -= 1
        return choices(longest, waste) if longest else None

    top = opened()
    if top is None:
        return []
    stack.append(top)
    while stack and steps < effort:
        steps += 1
        found = next(stack[-1], None)
        if found is None:
            stack.pop()
            if path:
                times, pieces, longest, waste, used = path.pop()
                for n, k in pieces:
                    counts[n] += k * times
            continue
        times, extra, pieces = found
        before = longest, waste, used
        for n, k in pieces:
            counts[n] -= k * times
        waste, used = waste + extra * times, used + times
        path.append((times, pieces, *before))
        inner = None
        if used + bound(counts, size) <= fewest - settled:
            inner = opened()
            if inner is None:  # nothing is left
                fewest, settled, best = used, 1, [(t, p) for t, p, *_ in path]
                if fewest <= least:
                    break
        stack.append(inner or iter(()))
    return best


def seats(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: by rank, where its intervals begin, their first sequence, how many a sequence takes, and the first offset."""
    used: dict[int, int] = Counter()
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for times, pieces in patterns:
        offset = 0
        for n, k in pieces:
            out.setdefault(n, []).append((used[n], first, k, offset))
            used[n] += k * times
            offset += n * k
        first += times
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for n, rows in out.items()}


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, size: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """PACKED rows of all documents, in as few sequences of at most ``size`` tokens as the plan can."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    cut_ = cut(pieces(docs, size, path, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in cut_.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    table = seats(plan(histogram, size))
    salts = max(1, min(4096, sum(histogram.values()) // 20_000))
    dealt = cut_.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))  # ``salts`` rows a length
    ranked = dealt.withColumn("at", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))).join(bases, ["length", "salt"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                starts, first, each, base = table[int(n)]
                k = np.searchsorted(starts, rank[at], side="right") - 1
                place = rank[at] - starts[k]
                sequence[at], offset[at] = first[k] + place // each[k], base[k] + place % each[k] * n
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("at") - 1).alias("rank")).mapInArrow(tidy(kernel), PACKED)
