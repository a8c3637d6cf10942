"""URL filters by rules and a path-template tree, in DataFrame functions alone.

Rules come first: the longest that fits a url decides.  What no rule fits is
judged by the template of its path, learnt per host from the urls that rules
fit.  Digits of a segment become ``#``; then, from the host down, a segment that
fewer than ``support`` urls share under its parent is variable and becomes
``*``.  This goes on, level by level, to the last segment of the deepest path.
From the leaves up, branches whose share of blocked urls does not differ from their
parent's by more than ``z`` standard errors are merged into one ``*``; a branch
without labels never is, nor, from segment ``LEAST`` + 1 on, the end of a path
beside which nothing goes on.  A template is rejected if its purity, the share of
blocked among its labelled urls smoothed with ``weight`` urls of the table's
share, is ``reject`` at least.

A template's counts are summed before they are dealt, so a host with any share
of the urls costs a row per task; the look-up of templates is an equi-join that
Spark may split.  Statistics cover all rows.

Urls of any length are read whole.  Only page_id and url are read, so other
columns may have any name.  Null urls and those without ``://`` have an empty host and path, fit no rule and
share the empty template.  Repeated rows count each.  An empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, only

#: verdict and host with path, in the order in which they are stated
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
LEAST = 3  # levels that every tree has
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return tuple(F.coalesce(x, F.lit("")) for x in (F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)))


def fitting(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits; of rules of one length the one with the longer host."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        name, slash, start = rule.partition("/")
        out = F.when(((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start), F.lit(rule)).otherwise(out)
    return out


def located(pages: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """page_id, host, path, rule, ruled (1 blocked, 0 allowed, else null) and the shape of the path, its segments between slashes."""
    host, path = parts(F.col("url"))
    read = only(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    read = read.withColumn("rule", fitting(F.col("host"), F.col("path"), rules))
    ruled = F.lit(None).cast("int")
    for verdict, rule in rules:
        ruled = F.when(F.col("rule") == rule, F.lit(int(verdict == "block"))).otherwise(ruled)
    shape = F.regexp_replace(F.regexp_replace("path", "^/", ""), "[0-9]+", "#")
    return read.select("page_id", "host", "path", "rule", ruled.alias("ruled"), shape.alias("shape"))


def grown(shapes: DataFrame, support: int, depth: int) -> DataFrame:
    """``shapes`` with ``template``, an array: segments that few share turned into wildcards, from the host down.

    A segment is held behind its slash, so it is never taken for a wildcard ``*`` or for the end ``$``.
    """
    shapes = shapes.withColumn("template", F.array().cast("array<string>"))
    node = ["host", "template", "segment"]
    for k in range(depth):
        shapes = shapes.withColumn("segment", F.coalesce(F.concat(F.lit("/"), F.get("segments", F.lit(k))), F.lit("$")))
        common = shapes.groupBy(*node).agg(F.sum("n").alias("shared")).where(F.col("shared") >= support).select(*node, F.lit(True).alias("common"))
        kept = F.when(F.col("common") | (F.col("segment") == "$"), F.col("segment")).otherwise(F.lit("*"))
        shapes = cut(shapes.join(common, node, "left").withColumn("template", F.concat("template", F.array(kept))).drop("segment", "common"), "grown")
    return shapes


def merged(shapes: DataFrame, z: float, depth: int) -> DataFrame:
    """``shapes`` with like branches turned into wildcards, from the leaves up."""
    parent, branch = ["host", "parent"], ["host", "parent", "branch"]
    for k in range(depth, 0, -1):
        shapes = shapes.withColumn("parent", F.slice("template", 1, k - 1)).withColumn("branch", F.get("template", F.lit(k - 1)))
        nodes = shapes.groupBy(*branch).agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
        above = shapes.groupBy(*parent).agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"), F.bool_or(F.col("branch") != "$").alias("deeper"))
        share = (F.col("all_blocked") + 1) / (F.col("all_labelled") + 2)
        apart = F.abs(F.col("blocked") / F.col("labelled") - F.col("all_blocked") / F.col("all_labelled"))
        alike = apart <= z * F.sqrt(share * (1 - share) / F.col("labelled"))
        judged = nodes.where("labelled > 0").join(above, parent).select(*branch, (alike if k <= LEAST else alike & F.col("deeper")).alias("alike"))
        # a branch is merged only if all that is below it is one already
        one = F.lit(True) if k == depth else F.get("template", F.lit(k)).isin("*", "$")
        star = F.concat("parent", F.array(F.lit("*")), F.slice("template", k + 1, depth))
        shapes = cut(shapes.join(judged, branch, "left").withColumn("template", F.when(F.col("alike") & one, star).otherwise(F.col("template"))).drop("parent", "branch", "alike"), "merged")
    return shapes


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, support: int = 8, z: float = 1.96, weight: float = 4.0, reject: float = 0.8) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every url."""
    urls = located(pages, rules)
    place = ["host", "shape"]
    shapes = urls.groupBy(*place).agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.coalesce(F.sum("ruled"), F.lit(0)).alias("blocked"))
    shapes = cut(shapes.withColumn("segments", F.split("shape", "/", -1)), "shapes")
    depth = max(LEAST, shapes.agg(F.max(F.size("segments"))).first()[0] or 0)
    placed = merged(grown(shapes, support, depth), z, depth)
    total = placed.agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).first()
    share = total["blocked"] / total["labelled"] if total["labelled"] else 0.0
    sums = placed.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    purity = F.round((F.col("blocked") + weight * share) / (F.col("labelled") + weight), 9)
    scored = sums.select("host", "template", purity.alias("purity"))
    found = placed.select(*place, "template").join(scored, ["host", "template"])
    told = F.concat("host", F.array_join(F.transform(F.filter("template", lambda x: x != "$"), lambda x: F.when(x == "*", F.lit("/*")).otherwise(x)), ""))
    out = urls.join(found.select(*place, told.alias("template"), "purity"), place, "left")
    verdict = F.when(F.col("ruled").isNotNull(), F.when(F.col("ruled") == 1, F.lit("block")).otherwise(F.lit("allow"))).when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


ORACLE = """
with recursive u as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages
), r as (
  select *, case when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule from u
), p as (
  select *, case when rule in ('com/', 'www.example.com/en/') then 0 when rule is not null then 1 end as ruled,
    string_split(regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '#', 'g'), '/') as shape from r
), b as (
  select page_id, host, path, rule, ruled, coalesce('/' || shape[1], '$') as s1, coalesce('/' || shape[2], '$') as s2, coalesce('/' || shape[3], '$') as s3, case when len(shape) > 3 then '**' else '$' end as s4 from p
), g1 as (select *, case when s1 = '$' or count(*) over (partition by host, s1) >= 8 then s1 else '*' end as t1 from b
), g2 as (select *, case when s2 = '$' or count(*) over (partition by host, t1, s2) >= 8 then s2 else '*' end as t2 from g1
), g3 as (select *, case when s3 = '$' or count(*) over (partition by host, t1, t2, s3) >= 8 then s3 else '*' end as t3 from g2
), a3 as (
  select *, count(ruled) over c as n, coalesce(sum(ruled) over c, 0) as k, count(ruled) over a as an, coalesce(sum(ruled) over a, 0) as ak
  from g3 window c as (partition by host, t1, t2, t3), a as (partition by host, t1, t2)
), m3 as (
  select * exclude (t3, n, k, an, ak), case when n > 0 and abs(k / n - ak / an) <= 1.96 * sqrt((ak + 1) / (an + 2) * (1 - (ak + 1) / (an + 2)) / n) then '*' else t3 end as t3 from a3
), a2 as (
  select *, count(ruled) over c as n, coalesce(sum(ruled) over c, 0) as k, count(ruled) over a as an, coalesce(sum(ruled) over a, 0) as ak
  from m3 window c as (partition by host, t1, t2), a as (partition by host, t1)
), m2 as (
  select * exclude (t2, n, k, an, ak), case when t3 in ('*', '$') and n > 0 and abs(k / n - ak / an) <= 1.96 * sqrt((ak + 1) / (an + 2) * (1 - (ak + 1) / (an + 2)) / n) then '*' else t2 end as t2 from a2
), a1 as (
  select *, count(ruled) over c as n, coalesce(sum(ruled) over c, 0) as k, count(ruled) over a as an, coalesce(sum(ruled) over a, 0) as ak
  from m2 window c as (partition by host, t1), a as (partition by host)
), m1 as (
  select * exclude (t1, n, k, an, ak), case when t2 in ('*', '$') and n > 0 and abs(k / n - ak / an) <= 1.96 * sqrt((ak + 1) / (an + 2) * (1 - (ak + 1) / (an + 2)) / n) then '*' else t1 end as t1 from a1
), f as (
  select *, round((coalesce(sum(ruled) over c, 0) + 4.0::double * (select coalesce(avg(ruled), 0) from b)) / (count(ruled) over c + 4.0::double), 9) as purity
  from m1 window c as (partition by host, t1, t2, t3, s4)
)
select page_id, host, path, rule, case when ruled = 1 then 'block' when ruled = 0 then 'allow' when purity >= 0.8 then 'block' else 'allow' end as verdict,
  concat(host, if(t1 = '$', '', if(t1 = '*', '/*', t1)), if(t2 = '$', '', if(t2 = '*', '/*', t2)), if(t3 = '$', '', if(t3 = '*', '/*', t3)), if(s4 = '$', '', '/' || s4)) as template, purity
from f
"""
