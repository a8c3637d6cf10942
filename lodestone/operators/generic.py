"""Relational building blocks that the rules and snapshot queries share; they work on any DataFrame."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def repeated(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """What ``first_of`` leaves out, with the place in its group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where("place > 1")


def numbered(df: DataFrame, scope: list[str], order: list[str], name: str = "finding_id", pattern: str = "F-%04d", lead: int = 1) -> DataFrame:
    """Numbers from 1 within a scope, as text.

    Rows are ranked only among those that agree on the first ``lead`` columns of
    the order, and start at the number of rows before these, which comes from
    counts.  So no task holds a scope, only its counts.
    """
    keys = [*scope, *order[:lead]]
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*scope).orderBy(*order[:lead]).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    starts = counts.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], before.alias("__before"))
    met = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order[lead:] or order)))
    return df.join(starts, met).withColumn(name, F.format_string(pattern, (F.col("__before") + place).cast("long"))).select(*df.columns, name)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of a small table that much work is done on, in as many tasks as a shuffle has: a table of few bytes is otherwise read, and worked on, by one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def budget(df: DataFrame, order: list[Column], most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` rows of a total order, and one row that tells how many were left out.

    The top rows are taken per partition before they meet.
    """
    return df.orderBy(*order).limit(most), df.agg(F.greatest(F.count("*") - most, F.lit(0)).cast("long").alias("left_out"))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """A 1-based page; a page holds at most 200 rows."""
    if number < 1 or not 1 <= size <= 200:
        raise ValueError("page numbers start at 1 and a page holds 1 to 200 rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def rank_of(column: Column | str, ranks: dict[str, int]) -> Column:
    """A closed vocabulary's rank; an unknown word is an error, never a default."""
    column = F.col(column) if isinstance(column, str) else column
    cases = reduce(lambda c, kv: c.when(column == kv[0], kv[1]), ranks.items(), F)
    return cases.otherwise(F.raise_error(F.concat(F.lit("unknown word: "), F.coalesce(column, F.lit("null")))).cast("int"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, fan_out, fan_in, coupling: distinct neighbours, self-loops left out, zero where there is none.

    Each figure is one distinct count over one exchange of the edges.
    """
    real = edges.where("src <> dst").select("src", "dst").distinct()
    side = lambda node, other, out: F.struct(F.col(node).alias("node"), F.col(other).alias("other"), F.lit(out).alias("is_out"), F.lit(1 - out).alias("is_in"))
    both = real.select(F.inline(F.array(side("src", "dst", 1), side("dst", "src", 0))))
    found = both.groupBy("node", "other").agg(F.max("is_out").alias("is_out"), F.max("is_in").alias("is_in")).groupBy("node")
    out = found.agg(F.sum("is_out").cast("long").alias("fan_out"), F.sum("is_in").cast("long").alias("fan_in"), F.count("*").alias("coupling"))
    return out if nodes is None else nodes.join(out, "node", "left").na.fill(0, ["fan_out", "fan_in", "coupling"])


def merged_edges(edges: DataFrame) -> DataFrame:
    """One row for each (src, dst): its sorted distinct sites, the first of them, and whether any is conditional or deferred."""
    sites = F.array_sort(F.collect_set("site"))
    return edges.groupBy("src", "dst").agg(sites.alias("sites"), F.min("site").alias("first_site"), F.bool_or("conditional").alias("conditional"), F.bool_or("deferred").alias("deferred"))


def peak(df: DataFrame, value: str, name: str) -> DataFrame:
    """The largest value and, sorted, all that have it; two small aggregates, no global sort."""
    top = df.agg(F.max(value).alias("peak"))
    return df.join(F.broadcast(top), F.col(value) == F.col("peak")).groupBy("peak").agg(F.array_join(F.array_sort(F.collect_list(F.col(name).cast("string"))), ",").alias("names"))


def over_threshold(df: DataFrame, value: str, threshold: int) -> DataFrame:
    """Strictly above; Medium from twice the threshold on."""
    return df.where(F.col(value) > threshold).withColumn("severity", F.when(F.col(value) >= 2 * threshold, "Medium").otherwise("Low"))


def prefixes(path: Column, separator: str = "/") -> Column:
    """All leading parts of a path, the shortest first."""
    parts = F.split(path, f"[{separator}]", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))


def longest_prefix(df: DataFrame, key: str, path: str, table: DataFrame, target: str, separator: str = "/") -> DataFrame:
    """``df`` with the longest entry of ``table`` (column ``target``) that leads ``path``, else null.

    Every row asks with its own leading parts, so the join is on equality and the
    winner is one aggregate per row.
    """
    asked = df.select(key, F.posexplode(prefixes(F.col(path), separator)).alias("__depth", target))
    best = asked.join(table.select(target).distinct(), target).groupBy(key).agg(F.max_by(target, "__depth").alias(target))
    return df.join(best, key, "left")


def latest_before(left: DataFrame, right: DataFrame, key: str, time: str, value: str, bucket: Column | None = None) -> DataFrame:
    """``left`` with ``value`` of the last row of ``right`` of its key strictly before it, null if none.

    One sorted pass over the union instead of a join on a range.  With a
    ``bucket`` (rising with the time, such as its day) a task holds a key's rows
    of one bucket only; what earlier buckets end with comes from one row of each.
    """
    width = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (key, time)]
    seen = right.select(key, time, *width, F.col(value).alias("__value"), F.lit(1).alias("__side"))
    both = seen.unionByName(left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("__value"), F.lit(0).alias("__side")))
    both = both.withColumn("__bucket", F.lit(0) if bucket is None else bucket)
    # at one time a question comes before what is seen
    before = Window.partitionBy(key, "__bucket").orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn(f"last_{value}", F.last("__value", ignorenulls=True).over(before)).where("__side = 0").drop("__value", "__side")
    if bucket is not None:
        ends = both.groupBy(F.col(key).alias("__key"), F.col("__bucket").alias("__own")).agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(time))).alias("__end"))
        earlier = Window.partitionBy("__key").orderBy("__own").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select("__key", "__own", F.last("__end", ignorenulls=True).over(earlier).alias("__carried"))
        found = found.join(carried, F.col(key).eqNullSafe(F.col("__key")) & F.col("__bucket").eqNullSafe(F.col("__own")))
        found = found.withColumn(f"last_{value}", F.coalesce(f"last_{value}", "__carried")).drop("__key", "__own", "__carried")
    return found.drop("__bucket")


def nesting(blocks: DataFrame, scope: list[str]) -> DataFrame:
    """``blocks`` (start, end within a scope) with ``depth``: how many distinct spans strictly hold it, and one."""
    outer = blocks.select(*scope, F.col("start").alias("o_start"), F.col("end").alias("o_end")).distinct()
    inside = (F.col("o_start") <= F.col("start")) & (F.col("o_end") >= F.col("end")) & ((F.col("o_start") < F.col("start")) | (F.col("o_end") > F.col("end")))
    held = blocks.select(*scope, "start", "end").distinct().join(outer, scope).where(inside).groupBy(*scope, "start", "end").agg((F.count("*") + 1).alias("depth"))
    return blocks.join(held, [*scope, "start", "end"], "left").na.fill(1, ["depth"])


def rolled_up(df: DataFrame, path: str, *aggregates: Column) -> DataFrame:
    """Aggregates of every directory over all below it."""
    return df.select("*", F.explode(prefixes(F.col(path))).alias("directory")).groupBy("directory").agg(*aggregates)


def compared(base: DataFrame, target: DataFrame, key: str, *kept: str) -> DataFrame:
    """new, resolved or unchanged for every key of either side."""
    left, right = (d.select(key, *[F.col(c).alias(f"{side}_{c}") for c in kept], F.lit(True).alias(f"in_{side}")) for d, side in ((base, "base"), (target, "target")))
    state = F.when(F.col("in_base").isNull(), "new").when(F.col("in_target").isNull(), "resolved").otherwise("unchanged")
    return left.join(right, key, "full_outer").withColumn("state", state).drop("in_base", "in_target")


def windows_of(tokens: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` tokens; the tokens are computed once, not per run."""

    def runs(t: Column) -> Column:
        n = F.size(t) - width
        return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.sha2(F.array_join(F.slice(t, i + 1, width), "\u0000"), 256))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(tokens), runs)[0]


def words_in(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, "[ \t\n\r\x0b\x0c]+", -1), lambda w: w != "")


def components(edges: DataFrame, save, rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable, direction ignored); ``save`` writes and rereads a step."""
    both = save(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct())
    label = save(both.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("component")))
    for _ in range(rounds):
        near = both.join(label, both["dst"] == label["node"]).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        fresh = save(label.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component")))
        if fresh.where("old <> component").isEmpty():
            return fresh.drop("old")
        label = fresh.drop("old")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def reachable(edges: DataFrame, most: int) -> DataFrame:
    """Distinct (src, dst) joined by a path of 1 to ``most`` edges; a bound keeps the closure finite on any graph."""
    step = edges.select("src", "dst").distinct()
    found = front = step
    for _ in range(most - 1):
        front = front.alias("f").join(step.alias("s"), F.col("f.dst") == F.col("s.src")).select("f.src", "s.dst").distinct()
        found = found.union(front).distinct()
    return found


def on_cycles(edges: list[tuple]) -> list[tuple]:
    """(node, component, named by its smallest node) of every node that a path of one edge or more leads back to (Tarjan, without recursion)."""
    out, order, low, held, stack, found = {}, {}, {}, set(), [], []
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    for root in out:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack.append(root)
        held.add(root)
        trail = [(root, iter(out[root]))]
        while trail:
            node, rest = trail[-1]
            for n in rest:
                if n not in order:
                    order[n] = low[n] = len(order)
                    stack.append(n)
                    held.add(n)
                    trail.append((n, iter(out.get(n, ()))))
                    break
                if n in held:
                    low[node] = min(low[node], order[n])
            else:
                trail.pop()
                if trail:
                    low[trail[-1][0]] = min(low[trail[-1][0]], low[node])
                if low[node] == order[node]:
                    members = [stack.pop()]
                    while members[-1] != node:
                        members.append(stack.pop())
                    held.difference_update(members)
                    if len(members) > 1 or node in out.get(node, ()):
                        least = min(members)
                        found += [(m, least) for m in members]
    return found


def strong_components(edges: DataFrame, scope: str) -> DataFrame:
    """scope, node, component (its smallest node) of every node on a cycle of its scope, however long; a task holds one scope's edges."""
    kind = dict(edges.dtypes)

    def kernel(table: pa.Table) -> pa.Table:
        rows = on_cycles(list(zip(table.column("src").to_pylist(), table.column("dst").to_pylist(), strict=True)))
        return pa.table([pa.array([table.column(scope)[0].as_py()] * len(rows), table.schema.field(scope).type), *[pa.array([r[k] for r in rows], table.schema.field("src").type) for k in (0, 1)]], names=[scope, "node", "component"])

    return edges.select(scope, "src", "dst").distinct().groupBy(scope).applyInArrow(kernel, f"{scope} {kind[scope]}, node {kind['src']}, component {kind['src']}")
