"""Near-duplicate documents by an LSH forest of MinHash signatures, confirmed on full shingle sets.

Equal sets are one class from the start.  Every class goes into ``TREES`` trees.
A tree orders classes by its own sequence of signature values: the first
``DEPTH`` are one hash, the next ``DEEPER`` one byte each.  Classes that share a
prefix are a region of the tree, and the candidates are the neighbours in its
order: a region of at most ``ENOUGH`` classes is left whole, a larger one is cut
by its next values until it is small enough, so its depth is its own and what
still meets has the longest common prefix.  A few pivots of the larger region
stay with each of its parts.  Where all values are equal, parts are dealt by
hash, again with pivots.

Neighbours whose sketches agree well enough to be possible links chain classes
into clusters.  What cuts and parts have kept from each other meets then: a
region that was cut and still holds several clusters is dealt to blocks, and
each two of its blocks are neighbours in full.  So every two classes that share
the first values of a tree are either neighbours or in one cluster already, and
a region of near copies, all of one cluster, costs nothing more.

A cluster is verified on the full sets by one task; one of more than ``BLOCK``
shingles is dealt to blocks first.  Then neighbours in different blocks are
looked at, one pair for each two components at first and eight times as many in
each further round, until all that could still join two components have been
verified; after that the same with each two blocks of the cut regions in which
the cluster still has several components.  So no pair of one region that could
join two components is left out, and a group of near copies, however large,
costs a few pairs for each block and never all pairs.

A set holds the distinct shingles of ``shingle`` words (A-Z lower-cased, white
space between), or the whole sequence of a text with fewer words; texts without
words have none and are linked with nothing.  Two sets are linked if
100 * common >= ``percent`` * united.  Null texts count as empty, rows without
doc_id are left out, repeated rows each give a row.  Rows of one doc_id with
different texts are one document that is linked with whatever one of them is
linked with.  Very long texts are one set like others.  Only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import components, cut, mix64, only, release, runs, tidy, utf8

TREES, DEPTH, DEEPER, SKETCH = 40, 5, 8, 128
#: Sketch agreement from which two classes may be linked at 80 %; 4.6 deviations below.
MAYBE = 0.64
#: Classes that a region of a tree holds at most before it is cut by its next values.
ENOUGH = 256
#: Blocks of cut regions hold so many times as many.
WIDE = 4
#: Shingles that a task compares at once.
BLOCK = 1_000_000
RANDOM = np.random.default_rng(20240229)
FACTORS = RANDOM.integers(1, 1 << 63, TREES * DEPTH + SKETCH, dtype=np.uint64) | np.uint64(1)
#: The values below a tree's first ones are those of the sketch, in an order of its own.
BELOW = np.stack([RANDOM.permutation(SKETCH)[:DEEPER] for _ in range(TREES)])


class Hashes(dict):
    """Word -> 64-bit hash, a bounded number remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, n: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = text.lower().split()  # on bytes: A-Z, and exactly the white space of ASCII
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        out = mix64(out + h[j : j + len(out)] + np.uint64(j + 1))
    return np.unique(out)


def signature(s: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Each tree's first values as one hash, its next ones as bytes of a number (both int64), and the sketch (bytes)."""
    low = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(s), 4096):
        part = s[a : a + 4096]
        np.minimum(low, (FACTORS[:, None] * part[None, :]).min(axis=1), out=low)
    values = mix64(low)
    tree = values[: TREES * DEPTH].reshape(TREES, DEPTH)
    head = np.arange(1, TREES + 1, dtype=np.uint64)
    for d in range(DEPTH):
        head = mix64(head + tree[:, d])
    sketch = (values[TREES * DEPTH :] >> np.uint64(56)).astype(np.uint8)
    return head.tobytes(), sketch[BELOW].view(">u8").astype("<u8").tobytes(), sketch.tobytes()


def key_of(s: np.ndarray) -> bytes | None:
    """16 bytes that name a set."""
    with np.errstate(over="ignore"):
        return np.array([s.sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes() if len(s) else None


def _signed(read: DataFrame, n: int) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                for text in utf8(part.column("text")):
                    s = shingles(text, n, hashes)
                    rows.append((len(s), key_of(s), *(signature(s) if len(s) else (None, None, None))))
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=["doc_id", "n_shingles", "set_key", "heads", "below", "sketch"])

    return read.mapInArrow(tidy(kernel), "doc_id long, n_shingles long, set_key binary, heads binary, below binary, sketch binary")


def _keyed(read: DataFrame, n: int) -> DataFrame:
    """doc_id, text and the name of its set."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            keys = pa.array([key_of(shingles(t, n, hashes)) for t in utf8(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), keys], names=["doc_id", "text", "set_key"])

    return read.mapInArrow(tidy(kernel), "doc_id long, text string, set_key binary")


def _dealt(classes: DataFrame) -> DataFrame:
    """One row for each class and tree."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.repeat(batch.column("rep").to_numpy(), TREES)
            head, below = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64) for c in ("heads", "below"))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(head), pa.array(below)], names=["rep", "region", "below"])

    return classes.select("rep", "heads", "below").mapInArrow(tidy(kernel), "rep long, region long, below long")


def regions_of(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """region, rep: who is whose neighbour, each region of each tree as deep as it has to be; and the regions that were cut, whole.

    Depths are ``DEPTH``, and that with half or all of the values below; where
    all are equal and still too many meet, parts are dealt by hash.
    """
    dealt = _dealt(classes)
    shared = dealt.groupBy("region").agg(F.count("*").alias("m")).where("m > 1")
    rows = cut(dealt.join(shared, "region"), "met")
    release(classes.sparkSession)
    out, crowded = rows.where(F.col("m") <= ENOUGH).select("region", "rep"), rows.where(F.col("m") > ENOUGH)
    if not crowded.limit(1).count():
        return cut(out, "near"), None
    whole = crowded.select("region", "rep")
    half, full = (F.xxhash64("region", F.lit(d), F.shiftrightunsigned("below", 8 * (DEEPER - d))) for d in (DEEPER // 2, DEEPER))
    crowded = crowded.select("region", "rep", half.alias("half"), full.alias("full"))
    # the smallest comes first where neighbours are chained, so regions of one group agree on most edges
    pivots = [F.min("rep").alias("p0"), *[F.min_by("rep", F.xxhash64("rep", F.lit(k))).alias(f"p{k}") for k in (1, 2)]]
    three = F.explode(F.array("p0", "p1", "p2")).alias("rep")
    halves = cut(crowded.groupBy("region", "half").agg(F.count("*").alias("m"), *pivots), "halves")
    fulls = crowded.join(halves.where(F.col("m") > ENOUGH).select("half"), "half").groupBy("half", "full").agg(F.ceil(F.count("*") / ENOUGH).alias("parts"))
    fulls = cut(fulls, "fulls")
    part = lambda salt: F.xxhash64("full", salt).alias("region")
    deep = crowded.join(halves.where(F.col("m") <= ENOUGH).select("half"), "half").select(F.col("half").alias("region"), "rep")
    deepest = crowded.select("full", "rep").join(fulls.select("full", "parts"), "full").select(part(F.pmod(F.xxhash64("rep", "full"), "parts")), "rep")
    above = halves.where(F.col("m") <= ENOUGH).select("region", "half").join(crowded.groupBy("region").agg(*pivots), "region").select(F.col("half").alias("region"), three)
    above_deepest = fulls.join(halves.select("half", "p0", "p1", "p2"), "half").select("full", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.array("p0", "p1", "p2").alias("ps")).select(part(F.col("salt")), F.explode("ps").alias("rep"))
    return cut(out.union(deep).union(deepest).union(above).union(above_deepest), "near"), whole


def each_two_blocks(whole: DataFrame, held: list[str]) -> DataFrame | None:
    """region, rep and ``held``: each two blocks of the regions of ``whole`` that hold several components; None if no region does.

    ``whole`` has region, rep, component and ``held``.
    """
    apart = whole.groupBy("region").agg(F.count("*").alias("m"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    apart = cut(apart.select("region", F.ceil(F.col("m") / (WIDE * ENOUGH)).alias("blocks")), "apart")
    if not apart.limit(1).count():
        return None
    mine = F.pmod(F.xxhash64("rep", "region"), "blocks")
    rows = whole.join(apart, "region").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("blocks") - 1, F.lit(0)))))
    # a block meets itself wherever it meets another one
    rows = rows.where("blocks = 1 or mine <> other")
    return rows.select(F.xxhash64("region", F.least("mine", "other"), F.greatest("mine", "other"), F.lit("blocks")).alias("region"), "rep", *held)


def grouped(n: int, reach) -> list[tuple[int, int]]:
    """Edges of a spanning forest of 0..n-1, where ``reach(i, rest)`` tells which of ``rest`` are linked with i."""
    rest, edges = np.arange(n), []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = reach(i, rest)
            edges += [(i, int(j)) for j in rest[hit]]
            queue += rest[hit].tolist()
            rest = rest[~hit]
    return edges


def _maybe(near: DataFrame) -> DataFrame:
    """Edges (a, b) that chain the neighbours whose sketches agree; ``near`` is sorted by region."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in runs(batches, ["region"]):
            ids = t.column("rep").to_numpy()
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            a, b = [], []
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if y - x > 1:
                    own = sketch[x:y]
                    for i, j in grouped(y - x, lambda i, rest, own=own: (own[rest] == own[i]).mean(axis=1) >= MAYBE):
                        a.append(min(ids[x + i], ids[x + j]))
                        b.append(max(ids[x + i], ids[x + j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return near.mapInArrow(tidy(kernel), "a long, b long")


APART = "a long, b long, x long, y long, agree int, more boolean"


def _apart(near: DataFrame, most: int) -> DataFrame:
    """Of each region and each two components in it the ``most`` pairs of neighbours that agree best, if they may be links, and whether there are more."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in runs(batches, ["region"]):
            ids, component = t.column("rep").to_numpy(), t.column("component").to_numpy()
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            found: list[np.ndarray] = []
            for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own, comp, rep = sketch[p:q], component[p:q], ids[p:q]
                if (comp == comp[0]).all():
                    continue
                rows = []
                for i in range(q - p - 1):
                    others = np.flatnonzero((comp[i + 1 :] != comp[i]) & (rep[i + 1 :] != rep[i])) + i + 1
                    agree = (own[others] == own[i]).sum(axis=1)
                    j, agree = others[agree >= MAYBE * SKETCH], agree[agree >= MAYBE * SKETCH]
                    if len(j):
                        u, v = np.where(comp[i] < comp[j], i, j), np.where(comp[i] < comp[j], j, i)
                        rows.append(np.stack([rep[u], rep[v], comp[u], comp[v], agree], axis=1))
                if rows:
                    r = np.concatenate(rows)
                    r = r[np.lexsort((r[:, 1], r[:, 0], -r[:, 4], r[:, 3], r[:, 2]))]
                    new = np.ones(len(r), dtype=bool)
                    new[1:] = (r[1:, 2:4] != r[:-1, 2:4]).any(axis=1)
                    first, group = np.flatnonzero(new), np.cumsum(new) - 1
                    more = np.diff(np.append(first, len(r)))[group] > most
                    found.append(np.column_stack([r, more])[np.arange(len(r)) - first[group] < most])
            r = np.concatenate(found) if found else np.zeros((0, 6), np.int64)
            yield pa.RecordBatch.from_arrays([*[pa.array(r[:, k]) for k in range(4)], pa.array(r[:, 4].astype(np.int32)), pa.array(r[:, 5] > 0)], names=["a", "b", "x", "y", "agree", "more"])

    return near.mapInArrow(tidy(kernel), APART)


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the exact links among sets."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(universe), dtype=np.int64)

    state = {"rest": None, "flat": None, "starts": None}

    def reach(i: int, rest: np.ndarray) -> np.ndarray:
        if state["rest"] is None or len(rest) < 0.7 * len(state["rest"]):  # only what is left is gone through
            state.update(rest=rest, flat=np.concatenate([flat[starts[j] : starts[j + 1]] for j in rest]), starts=np.concatenate([[0], np.cumsum(sizes[rest])[:-1]]))
        own = flat[starts[i] : starts[i + 1]]
        mark[own] = 1
        common = np.add.reduceat(mark[state["flat"]], state["starts"])
        mark[own] = 0
        if len(rest) != len(state["rest"]):
            common = common[np.searchsorted(state["rest"], rest)]
        return 100 * common >= percent * (sizes[i] + sizes[rest] - common)

    return grouped(len(sets), reach)


def _confirmed(texts: DataFrame, blocks: DataFrame, keys: list[str], n: int, percent: int) -> DataFrame:
    """Exact edges among the texts of each block: (``keys``, rep)."""
    # always dealt by key: what is asked for grows with the table, so it is never sent to every task
    met = texts.hint("merge").join(blocks, "rep").dropDuplicates(["rep", *keys])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for t, bounds in runs(batches, keys):
            ids, texts, a, b = t.column("rep").to_numpy(), t.column("text"), [], []
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if y - x > 1:
                    sets = [shingles(v, n, hashes) for v in utf8(texts.slice(x, y - x).combine_chunks())]
                    for i, j in linked(sets, percent):
                        a.append(min(ids[x + i], ids[x + j]))
                        b.append(max(ids[x + i], ids[x + j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(tidy(kernel), "a long, b long")


def linked_classes(classes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(id, component) of the classes (rep, size, heads, below, sketch) that are linked with others; ``texts`` are (rep, text)."""
    spark = classes.sparkSession
    near, whole = regions_of(classes)
    ordered = lambda df: df.repartition("region").sortWithinPartitions("region", "rep")
    chained = lambda df: cut(_maybe(ordered(df.join(classes.select("rep", "sketch"), "rep"))).distinct(), "maybe")
    clusters = components(chained(near))
    release(spark)
    if whole is not None:
        labelled = whole.join(clusters.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        wide = each_two_blocks(labelled, [])
        if wide is not None:
            clusters = components(clusters.select(F.col("id").alias("a"), F.col("component").alias("b")).union(chained(wide)))
            release(spark)
    sized = cut(clusters.select(F.col("id").alias("rep"), F.col("component").alias("cluster")).join(classes.select("rep", "size"), "rep"), "clusters")
    wide = sized.groupBy("cluster").agg(F.sum("size").alias("total")).withColumn("blocks", F.ceil(F.col("total") / BLOCK))
    placed = cut(sized.join(wide, "cluster").select("rep", "cluster", "blocks", F.pmod(F.xxhash64("rep"), "blocks").alias("block")), "placed")
    found = components(cut(_confirmed(texts, placed.select("rep", "cluster", "block"), ["cluster", "block"], shingle, percent), "links"))
    release(spark)

    parted, most = placed.where("blocks > 1").select("rep"), 1
    if not parted.limit(1).count():
        return found
    few = cut(texts.hint("merge").join(parted, "rep").dropDuplicates(["rep"]).select("rep", "text"), "parted")
    hood = near.distinct().join(parted, "rep").join(classes.select("rep", "sketch"), "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    hood = cut(hood.withColumn("component", F.coalesce("component", "rep")).repartition("region").sortWithinPartitions("region", "rep"), "hood")
    tried = None
    while True:
        pairs = _apart(ordered(hood), most).drop("more").distinct()
        best = F.row_number().over(Window.partitionBy("x", "y").orderBy(F.desc("agree"), "a", "b"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        asked = cut(pairs.withColumn("rank", best).where(F.col("rank") <= most).select("a", "b", "x", "y"), "asked")
        if not asked.limit(1).count():
            if _apart(ordered(hood), most).where("more").limit(1).count():  # the best have been tried, under other components' names
                most *= 8
                continue
            if whole is None:
                return found
            # neighbours have joined what they can; what cuts and parts keep from each other is asked last
            hood = whole.join(placed.where("blocks > 1").select("rep", "cluster"), "rep").join(classes.select("rep", "sketch"), "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left")
            hood = each_two_blocks(hood.select(F.xxhash64("region", "cluster").alias("region"), "rep", "sketch", F.coalesce("component", "rep").alias("component")), ["sketch", "component"])
            if hood is None:
                return found
            hood, whole, most = cut(hood, "hood"), None, 1
            continue
        ends = asked.select("a", "b", F.explode(F.array("a", "b")).alias("rep"))
        links = _confirmed(few, ends, ["a", "b"], shingle, percent).join(asked, ["a", "b"])
        moved = components(cut(links.select(F.col("x").alias("a"), F.col("y").alias("b")), "links")).select(F.col("id").alias("component"), F.col("component").alias("fresh"))
        named = F.coalesce("fresh", "component").alias("component")
        # classes that had no link yet have one now
        alone = moved.select(F.col("component").alias("id"), "component").join(found, "id", "left_anti")
        found = cut(found.unionByName(alone).join(moved, "component", "left").select("id", named), "found")
        hood = cut(hood.join(moved, "component", "left").select("region", "rep", "sketch", named), "hood")
        tried = asked.select("a", "b") if tried is None else tried.union(asked.select("a", "b"))
        most *= 8
        release(spark)


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept, for each row with a doc_id."""
    read = only(docs, "doc_id", "text").where("doc_id is not null")
    signed = cut(_signed(read, shingle), "signed")
    own = signed.where("set_key is not null")
    # a doc_id with several sets: its first set goes by the doc_id, others are classes named by a hash
    several = own.groupBy("doc_id").agg(F.min("set_key").alias("first_key"), F.max("set_key").alias("last_key")).where("first_key <> last_key").select("doc_id", "first_key")
    any_several = several.limit(1).count() > 0
    keys = own.groupBy("set_key").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("size"), *[F.any_value(c).alias(c) for c in ("heads", "below", "sketch")])
    named = F.col("first")
    if any_several:
        several = cut(several, "several")
        keys, named = keys.join(several.withColumnRenamed("doc_id", "first"), "first", "left"), F.when(F.col("set_key") != F.col("first_key"), F.xxhash64("set_key")).otherwise(named)
    keys = cut(keys.withColumn("rep", named), "classes")
    classes = keys.select("rep", "size", "heads", "below", "sketch")
    if any_several:
        texts = _keyed(read, shingle).join(keys.select(F.col("first").alias("doc_id"), "set_key", "rep"), ["doc_id", "set_key"]).select("rep", "text")
    else:  # each doc_id has one set, which any of its texts gives
        texts = read.select(F.col("doc_id").alias("rep"), "text")
    found = linked_classes(classes, texts, shingle, percent)
    release(docs.sparkSession)
    if any_several:
        names = keys.select("set_key", F.col("rep").alias("b"))
        same = own.join(several, "doc_id").select("doc_id", "set_key", "first_key").where("set_key <> first_key").distinct()
        same = same.join(names, "set_key").join(names.select(F.col("set_key").alias("first_key"), F.col("b").alias("a")), "first_key")
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(same.select("a", "b")))
    classed = keys.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", "first", F.coalesce("component", "rep").alias("component_id"))
    if any_several:  # a hash may be the smallest name of a component
        lowest = classed.groupBy("component_id").agg(F.min("first").alias("lowest"))
        classed = classed.join(lowest, "component_id").select("set_key", F.col("lowest").alias("component_id"))
    classed = classed.select("set_key", "component_id")
    out = signed.select("doc_id", "n_shingles", "set_key").join(classed, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def first_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but those that a smaller doc_id stands for, with all their columns; rows without doc_id stay."""
    drop = near_duplicates(docs, shingle, percent).where("not kept").select("doc_id").distinct()
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return held.join(drop, "doc_id", "left_anti").select(*[F.col("doc")[c].alias(c) for c in docs.columns])


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents where doc_id is not null
), s as (
  select doc_id, unnest(list_distinct(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end)) as g from w
), n as (select doc_id, count(*) as n from s group by 1
), p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
), ends as (select a, b from e union all select b, a from e
), r as (select distinct a as id, a as root from ends union select ends.b, r.root from r join ends on ends.a = r.id
), c as (select id, min(root) as root from r group by 1)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.root, w.doc_id) as component_id, w.doc_id = coalesce(c.root, w.doc_id) as kept
from w left join n using (doc_id) left join c on c.id = w.doc_id
"""
