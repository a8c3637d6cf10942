"""Source text without its strings and comments, call spans and arguments, as Spark column expressions; runs two token lists share."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

QUOTED = r"""(?:\"{3}(?:\\.|[^\\])*?\"{3}|'{3}(?:\\.|[^\\])*?'{3}|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')"""
#: A string literal with its prefix, which no name runs into.
LITERAL = rf"(?:(?<![A-Za-z0-9_])[rRbBuUfF]{{1,3}})?{QUOTED}"


def strings_emptied(text: Column) -> Column:
    """String literals without what is in them; prefixes and quotes stay, so an f-string is still seen as one."""
    for quote in ('"""', "'''"):
        text = F.regexp_replace(text, rf"(?s){quote}(?:\\.|[^\\])*?{quote}", quote * 2)
    return F.regexp_replace(text, r"""(?s)(?<!["'])(?:"(?!"")(?:\\.|[^"\\\n])*(")|'(?!'')(?:\\.|[^'\\\n])*('))""", "$1$1$2$2")


def blanked(text: Column, comments: bool = True) -> Column:
    """Text of equal length in which string literals (and comments) are spaces, so that places in it are places in the text."""
    comment = "|#[^\n]*" if comments else ""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s){LITERAL}{comment}|[A-Za-z0-9_]+(?![\"'A-Za-z0-9_])|."), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(((F.length(p) > 1) & p.rlike("[\"']$")) | (F.lit(comments) & p.startswith("#")), F.repeat(F.lit(" "), F.length(p))).otherwise(p)), "")


def without_comment(line: Column) -> Column:
    """A line up to the ``#`` that begins a comment."""
    place = F.instr(blanked(line, comments=False), "#")
    return F.when(place > 0, F.substring(line, F.lit(1), place - 1)).otherwise(line)


def call_span(lines: Column, line: Column, column: Column, most: int = 60) -> Column:
    """Text from a place (1-based line, 0-based column) to where its first bracket closes, within ``most`` lines."""
    text = F.array_join(F.slice(lines, line, F.lit(most)), "\n")
    text = F.substring(text, column + 1, F.length(text))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c.isin("(", "["), 1).when(c.isin(")", "]"), -1).otherwise(0)
        closed = (s["end"] == 0) & c.isin(")", "]") & (depth <= 0)
        return F.struct((s["at"] + 1).alias("at"), depth.alias("depth"), F.when(closed, s["at"] + 1).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.split(blanked(text), ""), start, step, lambda s: s["end"])
    return F.when(end > 0, F.substring(text, F.lit(1), end)).otherwise(text)


def arguments(call: Column) -> Column:
    """Arguments of a call as written, trimmed; commas in brackets or strings part nothing.  Empty where no bracket opens or closes."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("from"), F.array().cast("array<struct<a:int,n:int>>").alias("parts"), F.lit(False).alias("done"))

    def step(s: Column, c: Column) -> Column:
        at, opens, closes = s["at"] + 1, c.isin("(", "[", "{"), c.isin(")", "]", "}")
        live = ~s["done"] & ((s["depth"] > 0) | (c == "("))
        depth = F.when(live & opens, s["depth"] + 1).when(live & closes, s["depth"] - 1).otherwise(s["depth"])
        ends = live & closes & (depth == 0)
        cut = ends | (live & (c == ",") & (s["depth"] == 1))
        begun = F.when(live & (s["depth"] == 0), at + 1).when(cut, at + 1).otherwise(s["from"])
        part = F.struct(s["from"].alias("a"), (at - s["from"]).alias("n"))
        return F.struct(at.alias("at"), depth.alias("depth"), begun.alias("from"), F.when(cut, F.concat(s["parts"], F.array(part))).otherwise(s["parts"]).alias("parts"), (s["done"] | ends).alias("done"))

    parts = F.aggregate(F.split(blanked(call), ""), start, step, lambda s: F.when(s["done"], s["parts"]).otherwise(F.array().cast("array<struct<a:int,n:int>>")))
    return F.transform(parts, lambda p: F.regexp_replace(F.substring(call, p["a"], p["n"]), r"^\s+|\s+$", ""))


def shared_run(first: list[str], second: list[str]) -> int:
    """Length of the longest run of tokens that both hold, by a suffix automaton of the first: one pass over each."""
    follow: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for token in first:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and token not in follow[p]:
            follow[p][token] = new
            p = link[p]
        if p >= 0:
            q = follow[p][token]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(token) == q:
                    follow[p][token] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    best = now = state = 0
    for token in second:
        while state and token not in follow[state]:
            state = link[state]
            now = length[state]
        if token in follow[state]:
            state = follow[state][token]
            now += 1
        best = max(best, now)
    return best


def longest_shared_run(first: Column, second: Column) -> Column:
    """``shared_run`` of two arrays of tokens; null where either is null."""
    @pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else shared_run(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return run(first, second)
