"""Line dedup by a segment-partition edit join, in DataFrame functions alone.

Lines (split at line feeds, trimmed, of at least ``least`` bytes) that are equal
are one class.  Classes within ``threshold`` byte edits of each other, if both
have ``linked`` bytes at least (``least`` if not given), are linked.  A class's bytes are split into threshold-plus-one segments, each an
entry of an index by length; a line probes the indexes of its own length and of
those up to ``threshold`` shorter with the substrings at which a segment can
still lie (few, as the edits before and behind it are bounded).  Pairs that
meet, and whose letter counts an edit or two could make alike, are verified: what both begin and end with is stripped, the rest goes
through a banded bit-parallel edit distance (the diagonal recurrence of Hyyro,
2003, "A bit-vector algorithm for computing Levenshtein and Damerau edit
distances") whose band is one small integer.

A key that more than ``crowd`` lines share isn't paired out.  Its lines go to a
finer index, of 8 pieces of which all but ``threshold`` are equal in a link: a
key is a line without one piece, or without two.  A key of that index that is
crowded again is refined by itself: each of the pieces it leaves out (holes) is
split in ``SPLIT``, and a line's next keys keep all of them but one of each hole,
or one or two of an only hole.  So on until no key is crowded or holes are single
bytes, where what meets is a link but for a byte or two.  A line pairs out at
most ``crowd`` others at a key, no group of near copies is compared pair by pair,
and no link is lost.  (Thresholds above two have no finer index:
they pair out crowded keys and are not for production.)

A line goes if an earlier line (by doc_id, then place) is equal or linked to
it; it need not be kept itself.  Shorter lines and blank ones always stay.

Null and empty texts have no lines; very long lines are lines like others.
Only doc_id and text are read, so other columns may have any name.  Rows without doc_id are not judged and lose
nothing; nor do rows of one doc_id remove each other's lines of equal place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, only, partitions, release, shared_dir

CROWD = 64
#: Pieces of the finer index, and parts of each hole of a key that is refined.
PIECES, SPLIT = 8, 4
BLANKS = " \t\r\x0b\x0c"
ID = ("h1", "h2")
#: Bytes whose counts are compared, by being odd or even, before two lines are.
COUNTED = "etaoinshrdlcumwfgypb0123456789"


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, row (of the text), line_no, line, h1, h2 of every line that is judged."""
    read = only(docs, "doc_id", "text").where("doc_id is not null")
    # the text's hash is taken before the lines are: beside the generator it would be taken for each line
    lines = read.select("doc_id", "text", F.xxhash64("text").alias("row")).select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.octet_length("line") >= least)
    return lines.select("doc_id", "row", F.col("line_no").cast("long").alias("line_no"), "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def classes_of(lines: DataFrame) -> DataFrame:
    """One row for each different line, as a table bucketed by its hashes: later joins move only what they add."""
    spark = lines.sparkSession
    found = lines.groupBy(*ID).agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("copies"), F.any_value("line").cast("binary").alias("content"))
    name = f"lodestone_lines_{uuid.uuid4().hex}"
    found.write.option("path", f"{shared_dir(spark)}/lodestone/{name}").bucketBy(min(50_000, partitions(spark)), *ID).saveAsTable(name)
    return spark.table(name)


def odd(line: Column) -> Column:
    """A bit for each of COUNTED that the line holds an odd number of times; an edit turns two at most."""
    n, out = F.length(line), F.lit(0)
    for k, c in enumerate(COUNTED):
        out = out.bitwiseOR(F.shiftleft((n - F.length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(F.lit(1)), k))
    return out


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def piece(content: Column, start: Column, length: Column) -> Column:
    """Bytes from a 0-based place."""
    return F.substring(content, start + 1, length)


def segment_keys(classes: DataFrame, threshold: int) -> DataFrame:
    """h1, h2, key: the index entries (odd keys) and the probes (even ones) of each line."""
    content, n, k = F.col("content"), F.length("content"), threshold + 1
    out = []
    for d in range(threshold + 1):
        m = n - d
        for i in range(k):
            at, size = F.floor(m * i / k).cast("int"), (F.floor(m * (i + 1) / k) - F.floor(m * i / k)).cast("int")
            for shift in range(max(-i, d - (threshold - i)), min(i, d + (threshold - i)) + 1):
                fits = (m > 0) & (at + shift >= 0) & (at + shift + size <= n)
                out.append(F.when(fits, marked(F.xxhash64(m, F.lit(i), piece(content, at + shift, size)), d == 0 and shift == 0)))
    return classes.select(*ID, F.explode(F.array(*out)).alias("key")).where("key is not null")


def marked(key: Column, own: bool) -> Column:
    """A key whose lowest bit tells an index entry."""
    return key.bitwiseOR(F.lit(1)) if own else key.bitwiseAND(F.lit(-2))


def n_keys(pieces: int, threshold: int) -> int:
    """How many keys ``hole_keys`` gives a line."""
    return (threshold + 1) * pieces + (0 if threshold == 1 else 5 * pieces * (pieces - 1) // 2)


#: Which shifts two holes can have between them, by how much longer the probing line is.
SHIFTS = {0: (0, 1), 1: (0, 1), 2: (1,)}


def hole(a: Column, b: Column, c: Column, e: Column, s: int | Column, d: int | Column) -> Column:
    """The bytes (places of the index's line) that a key leaves out: a to b and, unless null, c to e; a probing line has ``s`` bytes more before b, ``d`` in all."""
    named = {"a": a, "b": b, "c": c, "e": e, "s": s, "d": d}
    return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast("int").alias(n) for n, x in named.items()])


def hole_keys(classes: DataFrame, pieces: int, threshold: int) -> DataFrame:
    """The same, and the holes of each key, for ``pieces`` pieces of which as many as the threshold may differ; a line has no more pieces than bytes.

    Pieces are those of the index's line.  A line that is ``d`` longer is read
    as if it had ``d`` bytes more before the end of its only hole, or ``s`` of
    them before the end of the first of two.  Of lines of one length the one
    that has a byte more there asks for the other.
    """
    content, parts = F.col("content"), []
    for d in range(threshold + 1):
        m = F.length("content") - d
        k = F.least(F.lit(pieces), m)

        # all of these are used at once, before the loop goes on
        def edge(j: Column) -> Column:  # where a piece starts
            return F.floor(m.cast("long") * j / k).cast("int")

        def one(i: Column) -> Column:
            key = marked(F.xxhash64(F.lit(pieces), m, edge(i), F.lit(-1), piece(content, F.lit(0), edge(i)), piece(content, edge(i + 1) + d, m - edge(i + 1))), d == 0)
            return F.struct(key.alias("key"), hole(edge(i), edge(i + 1), F.lit(None), F.lit(None), d, d).alias("hole"))

        def two(s: int) -> Column:
            def key(i: Column, j: Column) -> Column:
                start, end, start2, end2 = edge(i), edge(i + 1), edge(j), edge(j + 1)
                key = marked(F.xxhash64(F.lit(pieces), m, start, start2, piece(content, F.lit(0), start), piece(content, end + s, start2 - end), piece(content, end2 + d, m - end2)), d == 0 and s == 0)
                return F.struct(key.alias("key"), hole(start, end, start2, end2, s, d).alias("hole"))

            firsts = F.when(k > 1, F.sequence(F.lit(0), k - 2)).otherwise(F.array().cast("array<int>"))
            return F.flatten(F.transform(firsts, lambda i: F.transform(F.sequence(i + 1, k - 1), lambda j: key(i, j))))

        keys = F.transform(F.sequence(F.lit(0), k - 1), one)
        if threshold == 2:
            keys = F.concat(keys, *[two(s) for s in SHIFTS[d]])
        parts.append(classes.where(m > 0).select(*ID, F.inline(keys)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def finer_keys(crowded: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """h1, h2, odd, key, hole: for each crowded key those that leave out less of its holes."""
    rows = crowded.select(*ID, "key", "odd", "hole").hint("shuffle_hash").join(classes.select(*ID, "content"), list(ID))
    content, place, own = F.col("content"), F.shiftright("key", 1), F.col("key").bitwiseAND(F.lit(1)) == 1
    a, b, c, e, s, d = (F.col("hole")[x] for x in "abcesd")

    def parts(start: Column, end: Column) -> Column:
        n = F.least(F.lit(SPLIT), end - start)
        edge = lambda u: (start + F.floor((end - start).cast("long") * u / n)).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda u: F.struct(edge(u).alias("x"), edge(u + 1).alias("y")))

    def entry(indexed: Column, out: Column, *kept: Column) -> Column:
        key = F.xxhash64(place, out["a"], out["b"], out["c"], out["e"], *kept)
        return F.struct(F.when(indexed, marked(key, True)).otherwise(marked(key, False)).alias("key"), out.alias("hole"))

    def one(p: Column) -> Column:
        return entry(own, hole(p["x"], p["y"], F.lit(None), F.lit(None), s, d), piece(content, a, p["x"] - a), piece(content, p["y"] + d, b - p["y"]))

    def two(p: Column, q: Column, shift: int) -> Column:  # of one hole
        out = hole(p["x"], p["y"], q["x"], q["y"], shift, d)
        return entry(own & F.lit(shift == 0), out, piece(content, a, p["x"] - a), piece(content, p["y"] + shift, q["x"] - p["y"]), piece(content, q["y"] + d, b - q["y"]))

    def each(p: Column, q: Column) -> Column:  # of two
        return entry(own, hole(p["x"], p["y"], q["x"], q["y"], s, d), piece(content, a, p["x"] - a), piece(content, p["y"] + s, b - p["y"]), piece(content, c + s, q["x"] - c), piece(content, q["y"] + d, e - q["y"]))

    def pairs(ps: Column, shift: int) -> Column:
        return F.flatten(F.transform(ps, lambda p: F.transform(F.filter(ps, lambda q: q["x"] > p["x"]), lambda q: two(p, q, shift))))

    def single(ps: Column) -> Column:
        found = F.transform(ps, one)
        if threshold < 2:
            return found
        none = F.slice(found, 1, 0)
        return F.concat(found, *[F.when(d.isin([x for x in SHIFTS if shift in SHIFTS[x]]), pairs(ps, shift)).otherwise(none) for shift in (0, 1)])

    double = F.flatten(F.transform(parts(a, b), lambda p: F.transform(parts(c, e), lambda q: each(p, q))))
    return rows.select(*ID, "odd", F.inline(F.when(c.isNull(), let(parts(a, b), single)).otherwise(double)))


def meetings(keys: DataFrame, classes: DataFrame, crowd: int | None) -> DataFrame:
    """h1, h2, odd, key (and hole) and whether too many index entries share a key that can be refined; rows that meet nothing are left out."""
    same = Window.partitionBy(F.shiftright("key", 1).alias("place"))
    entries = F.sum(F.col("key").bitwiseAND(F.lit(1))).over(same)
    met = keys.withColumn("entries", entries).withColumn("rows", F.count("*").over(same)).where("entries > 0 and rows > 1")
    crowded, more = F.col("entries") > (crowd or 1 << 62), [c for c in ("odd", "hole") if c in keys.columns]
    if "hole" in more:  # single bytes can't be split
        crowded = crowded & (F.col("hole.b") - F.col("hole.a") + F.coalesce(F.col("hole.e") - F.col("hole.c"), F.lit(1)) > 2)
    met = met.select(*ID, "key", crowded.alias("crowded"), *more)
    if "odd" not in more:
        met = met.hint("shuffle_hash").join(classes.select(*ID, "content"), list(ID))  # few are left
        met = met.withColumn("odd", odd(F.col("content").cast("string"))).drop("content")
    return cut(met, "met")


def paired(met: DataFrame, threshold: int) -> DataFrame:
    """a1, a2, b1, b2: pairs that meet at keys that are not crowded, unless their letter counts are too far apart."""
    small = met.where("not crowded")
    index = small.where(F.col("key").bitwiseAND(F.lit(1)) == 1).select(F.shiftright("key", 1).alias("place"), F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("odd").alias("b_odd"))
    probes = small.select(F.shiftright("key", 1).alias("place"), F.col("key").bitwiseAND(F.lit(1)).alias("own"), F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("odd").alias("a_odd"))
    # two index entries meet both ways; one is enough
    once = F.expr("own = 1 and (a1 < b1 or a1 = b1 and a2 < b2) or own = 0 and (a1 <> b1 or a2 <> b2)")
    alike = F.bit_count(F.col("a_odd").bitwiseXOR(F.col("b_odd"))) <= 2 * threshold
    return probes.join(index, "place").where(once & alike).select("a1", "a2", "b1", "b2")


def candidates(classes: DataFrame, threshold: int, crowd: int) -> DataFrame:
    """Distinct a1, a2, b1, b2 that hold all links."""
    met = meetings(segment_keys(classes, threshold), classes, crowd if threshold <= 2 else None)
    found, crowded = paired(met, threshold), met.where("crowded")
    if threshold <= 2 and crowded.limit(1).count():
        release(classes.sparkSession)
        fine = crowded.select(*ID).distinct().hint("shuffle_hash").join(classes, list(ID)).select(*ID, "content")
        keys = hole_keys(fine, PIECES, threshold)
        while True:
            met = meetings(keys, classes, crowd)
            found, crowded = found.unionByName(paired(met, threshold)), met.where("crowded")
            if not crowded.limit(1).count():
                break
            release(classes.sparkSession)
            keys = finer_keys(crowded, classes, threshold)
    turned = F.expr("a1 < b1 or a1 = b1 and a2 < b2")
    ends = [F.when(turned, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a1", "b1"), ("a2", "b2"), ("b1", "a1"), ("b2", "a2"))]
    return found.select(*ends).distinct()


def common_start(a: Column, b: Column, most: Column, place) -> Column:
    """How many bytes, at most ``most``, are equal from an end on, by halving; ``place(x, done, size)`` cuts the next bytes."""
    powers = F.when(most > 0, F.sequence(F.floor(F.log2(most.cast("double"))).cast("int"), F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))

    def step(done: Column, power: Column) -> Column:
        size = F.pow(F.lit(2.0), power).cast("int")
        return F.when((done + size <= most) & (place(a, done, size) == place(b, done, size)), done + size).otherwise(done)

    return F.aggregate(powers, F.lit(0), step)


def banded(x: Column, y: Column, threshold: int) -> Column:
    """Whether ``x``, the longer and longer than the threshold, is within ``threshold`` edits of ``y``.

    The band around the diagonal is one integer of 2 * threshold + 1 bits, in
    which a bit stands for a cell's rise over the one before it.
    """
    width = 2 * threshold + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    n, m = F.length(x), F.length(y)
    most = threshold + m - (n - threshold)  # further below the diagonal the distance can still fall so far

    def column(s: Column, j: Column) -> Column:
        spots = []
        for t in range(width):
            at = j + (threshold - (width - 1 - t))
            spots.append(F.when((at >= 0) & (piece(x, at, F.lit(1)) == piece(y, j, F.lit(1))), F.lit(1 << t)).otherwise(F.lit(0)))
        equal = spots[0]
        for c in spots[1:]:
            equal = equal + c

        def after(d: Column) -> Column:
            inv = lambda c: c.bitwiseXOR(F.lit(full))
            plus, minus = s["minus"].bitwiseOR(inv(d.bitwiseOR(s["plus"]))), d.bitwiseAND(s["plus"])
            down = F.shiftright(d, 1)
            low = j < n - threshold
            edge = F.call_function("shiftright", F.lit(top), F.greatest(F.lit(0), j - (n - threshold) + 1))
            walked = F.when(plus.bitwiseAND(edge) != 0, 1).otherwise(0) - F.when(minus.bitwiseAND(edge) != 0, 1).otherwise(0)
            rise = F.when(low, F.when(d.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)).otherwise(walked)
            return F.struct(minus.bitwiseOR(inv(down.bitwiseOR(plus))).alias("plus"), down.bitwiseAND(plus).alias("minus"), (s["distance"] + rise).alias("distance"))

        def diagonal(e: Column) -> Column:
            plus = s["plus"]
            return ((e.bitwiseAND(plus) + plus).bitwiseXOR(plus).bitwiseOR(e).bitwiseOR(s["minus"])).bitwiseAND(F.lit(full))

        return F.when(s["distance"] > most, s).otherwise(let(let(equal, diagonal), after))

    start = F.struct(F.lit(full ^ ((1 << threshold) - 1)).alias("plus"), F.lit(0).alias("minus"), F.lit(threshold).alias("distance"))
    return F.aggregate(F.sequence(F.lit(0), m - 1), start, column)["distance"] <= threshold


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether two binary values are at most ``threshold`` byte edits apart."""
    least = F.least(F.length(a), F.length(b))

    def behind(start: Column) -> Column:
        end = common_start(a, b, least - start, lambda x, done, size: piece(x, F.length(x) - done - size, size))

        def rest(e: Column) -> Column:
            x, y = (piece(c, start, F.length(c) - start - e) for c in (a, b))
            long, short = F.when(F.length(x) >= F.length(y), x).otherwise(y), F.when(F.length(x) >= F.length(y), y).otherwise(x)
            inner = F.transform(F.array(F.struct(long.alias("long"), short.alias("short"))), lambda p: F.when(F.length(p["long"]) <= threshold, True).when((F.length(p["short"]) == 0) | (F.length(p["long"]) - F.length(p["short"]) > threshold), False).otherwise(banded(p["long"], p["short"], threshold)))
            return inner[0]

        return let(end, rest)

    return let(common_start(a, b, least, piece), behind)


def links_of(classes: DataFrame, threshold: int = 2, crowd: int = CROWD) -> DataFrame:
    """a1, a2, b1, b2 and the first places of each pair of linked classes, once."""
    pairs = candidates(classes, threshold, crowd)
    a, b = (classes.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("content").alias(f"{x}_content"), F.col("first").alias(f"{x}_first")) for x in "ab")
    both = pairs.hint("shuffle_hash").join(a, ["a1", "a2"]).hint("shuffle_hash").join(b, ["b1", "b2"])
    return cut(both.where(within(F.col("a_content"), F.col("b_content"), threshold)).select("a1", "a2", "b1", "b2", "a_first", "b_first"), "links")


def judged(docs: DataFrame, threshold: int = 2, least: int = 16, crowd: int = CROWD, linked: int | None = None) -> DataFrame:
    """doc_id, row, line_no, class_doc_id, class_line_no (the class's first line), n_links (classes linked with it) and removed, of every judged line."""
    spark = docs.sparkSession
    classes = classes_of(lines_of(docs, least))
    release(spark)
    links = links_of(classes if linked is None else classes.where(F.length("content") >= linked), threshold, crowd)
    release(spark)
    ends = links.select(F.col("a1").alias("h1"), F.col("a2").alias("h2"), F.col("b_first").alias("near")).unionByName(links.select(F.col("b1").alias("h1"), F.col("b2").alias("h2"), F.col("a_first").alias("near")))
    near = ends.groupBy(*ID).agg(F.count("*").alias("n_links"), F.min("near").alias("near"))
    known = classes.select(*ID, "first", "copies").join(near, list(ID), "left").select(*ID, F.struct("first", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "near").alias("known"), "copies")
    total = classes.agg(F.sum("copies")).first()[0] or 0
    # at most a thousand classes hold a thousandth of the lines each: these go to every task, and their lines to any
    common = F.broadcast(known.where(F.col("copies") > max(100, total // 1000)).select(*ID, F.col("known").alias("common")))
    lines = lines_of(docs, least).drop("line").join(common, list(ID), "left")
    lines = lines.withColumn("h1", F.when(F.col("common").isNull(), F.col("h1")).otherwise(F.xxhash64("doc_id", "line_no")))
    found = lines.join(known.select(*ID, "known"), list(ID), "left").withColumn("known", F.coalesce("common", "known"))
    first = F.col("known.first")
    gone = (F.struct("doc_id", "line_no") > first) | F.coalesce(F.col("known.near") < first, F.lit(False))
    return found.select("doc_id", "row", "line_no", first["doc_id"].alias("class_doc_id"), first["line_no"].alias("class_line_no"), F.col("known.n_links").alias("n_links"), gone.alias("removed"))


def without_repeated_lines(docs: DataFrame, threshold: int = 2, least: int = 16) -> DataFrame:
    """``docs`` without the lines that go, ``n_chars`` (if there) set anew; a document of which only blanks are left goes."""
    drops = judged(docs, threshold, least).where("removed").groupBy("doc_id", "row").agg(F.collect_set(F.col("line_no").cast("int")).alias("drop"))
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    met = held.join(drops, ["doc_id", "row"], "left")

    def kept(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
        return F.array_join(F.transform(left, lambda p: F.get(lines, p)), "\n")

    text = F.when(F.col("drop").isNull(), F.col("doc.text")).otherwise(let(F.split("doc.text", "\n", -1), kept))
    met = met.withColumn("text", text).where(F.col("drop").isNull() | (F.length(F.btrim("text", F.lit(BLANKS + "\n"))) > 0))
    fresh = {"text": F.col("text"), "n_chars": F.when(F.col("drop").isNull(), F.col("doc")["n_chars"]).otherwise(F.char_length("text").cast("long")) if "n_chars" in docs.columns else None}
    return met.select(*[fresh[c].cast(docs.schema[c].dataType).alias(c) if c in fresh else F.col("doc")[c].alias(c) for c in docs.columns])


ORACLE = """
with l as (
  select doc_id, line_no, trim(line, e' \\t\\r\\x0b\\x0c') as line
  from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no from documents where doc_id is not null)
), o as (select * from l where strlen(line) >= 1
), c as (select line, strlen(line) as n, min(row(doc_id, line_no)) as first from o group by line
), p as (
  select a.line as x, b.line as y from c a join c b on b.n between a.n and a.n + 2 and a.n >= 16 and (a.n < b.n or a.line < b.line) where levenshtein(a.line, b.line) <= 2
), e as (select x, y from p union select y, x from p
), near as (select e.x as line, count(*) as n_links, min(c.first) as near from e join c on c.line = e.y group by 1)
select o.doc_id, cast(o.line_no as bigint) as line_no, c.first[1] as class_doc_id, cast(c.first[2] as bigint) as class_line_no,
  coalesce(n_links, 0) as n_links, row(o.doc_id, o.line_no) > c.first or coalesce(near < c.first, false) as removed
from o join c using (line) left join near using (line)
"""
