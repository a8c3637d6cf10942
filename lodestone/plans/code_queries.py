"""The code readers and detectors on sources that are made from table rows (one small package per nation), so that they run at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import generic as G
from lodestone.plans import results, rules, views
from lodestone.sources import manifests, python_code, snapshot

QUERIES: dict = {}
#: What the template must yield, stated from the tables alone; only the rows of the parser have none.
ORACLES: dict[str, str] = {}

MODULE = """import sqlite3, subprocess
from flask import request
from pkg{a} import mod{b}
import pkg{c}.mod{d}

class Service{d}:
    def load(self, name, a{d}, b, c, d, e):
        q = request.args["q"]
        if name:
            for x in range({d}):
                while x and q:
                    if x > {b}:
                        if q:
                            cursor.execute("select * from t{d} where n = " + q)
        return subprocess.run(["ls", str({d})])

def key_{d}():
    token = "{h}"
    return token

def total(rows):
    count, size, seen = 0, 0, set()
    for row in rows:
        if row.key not in seen and row.size > 0:
            seen.add(row.key)
            count += 1
            size += row.size * row.weight + len(row.name)
    return count, size, sorted(seen)
"""


def tree(spark, sf_dir: str) -> DataFrame:
    """A module per supplier and, of every 5000 suppliers, a requirements file per nation, so that no file grows with the table."""
    s = G.dealt(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey"), "s_suppkey").select((F.col("s_suppkey") % 25).alias("n"), F.col("s_suppkey").alias("k"))
    text, values = F.lit(MODULE), {"a": (F.col("k") * 7 + 1) % 25, "b": (F.col("k") * 7 + 1) % 100, "c": F.col("n"), "d": F.col("k"), "h": F.substring(F.md5(F.col("k").cast("string")), 1, 20)}
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    modules = s.select(F.concat(F.lit("pkg"), "n", F.lit("/mod"), "k", F.lit(".py")).alias("path"), text.alias("text"))
    wanted = s.groupBy("n", F.floor(F.col("k") / 5000).alias("part")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("lib"), F.col("k") % 40, F.when(F.col("k") % 2 == 0, F.concat(F.lit("=="), F.col("k") % 3, F.lit(".0"))).otherwise(F.lit(">=1"))))), "\n").alias("text"))
    every = modules.unionByName(wanted.select(F.concat(F.lit("pkg"), "n", F.lit("/requirements"), F.when(F.col("part") > 0, F.concat(F.lit("-"), "part")).otherwise(""), F.lit(".txt")).alias("path"), "text"))
    return every.select(F.lit("tables").alias("analysis_id"), "path", F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("size"))


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(snapshot.classified(tree(spark, sf_dir)))
    return f


@query
def file_index(files) -> DataFrame:
    return files.drop("content")


@query
def parse_python(files) -> DataFrame:
    return python_code.parsed(files)


@query
def read_manifests(files) -> DataFrame:
    return manifests.occurrences(manifests.read_manifests(files))


@query
def import_graph(files) -> DataFrame:
    code = python_code.parsed(files)
    return rules.graph_metrics(code, rules.import_edges(code))


@query
def structure_rules(files) -> DataFrame:
    code = python_code.parsed(files)
    return rules.structure(code).unionByName(rules.sizes(code))


@query
def security_rules(files) -> DataFrame:
    return rules.security_rules(python_code.parsed(files))


@query
def hardcoded_secrets(files) -> DataFrame:
    return rules.hardcoded_secrets(files)


@query
def duplicate_candidates(files) -> DataFrame:
    return rules.duplicates(python_code.bodies(files))


@query
def imported_names(files) -> DataFrame:
    found = views.imported_names(python_code.parsed(files), ["analysis_id"])
    return found.withColumn("names", F.array_join("names", ","))


@query
def scope_summary(files) -> DataFrame:
    return views.scope_summary(files, python_code.parsed(files))


@query
def dependency_rules(files) -> DataFrame:
    spark = files.sparkSession
    advisories = spark.createDataFrame([("PyPI", "lib2", "2.0", "ADV-1"), ("PyPI", "lib4", "1.0", "ADV-2")], "ecosystem string, package_name string, affected_version string, advisory_id string")
    return rules.dependency_rules(manifests.occurrences(manifests.read_manifests(files)), python_code.parsed(files), advisories)


@query
def findings_summary(files) -> DataFrame:
    code = python_code.parsed(files)
    return results.summary(results.once(rules.structure(code), rules.security_rules(code), rules.hardcoded_secrets(files))).withColumn("by_rule", F.to_json("by_rule"))


# -- the same rows in SQL -----------------------------------------------------

MODULES = "m as (select s_suppkey as k, s_suppkey % 25 as n, 'pkg' || s_suppkey % 25 || '/mod' || s_suppkey || '.py' as path from supplier)"
WANTED = (
    "w as (select 'pkg' || s_suppkey % 25 as project_context, case when s_suppkey < 5000 then '' else '-' || s_suppkey // 5000 end as part, 'lib' || s_suppkey % 40 as name, case when s_suppkey % 2 = 0 then '==' || s_suppkey % 3 || '.0' else '>=1' end as spec, case when s_suppkey % 2 = 0 then s_suppkey % 3 || '.0' end as version from supplier),"
    " d as (select *, project_context || '/requirements' || part || '.txt' as path, cast(row_number() over (partition by project_context, part order by name || spec) as int) as line from w)"
)


def finding_sql(source: str, rule: str, category: str, severity: str, confidence: str, start: str, end: str, subject: str, detail: str) -> str:
    return (
        f"select 'tables' as analysis_id, '{rule}' as rule_id, '{category}' as category, '{severity}' as severity, '{confidence}' as confidence, path, {start} as start_line, {end} as end_line, {subject} as subject, {detail} as detail,"
        f" sha256('[\"{rule}\",\"{category}\",\"' || path || '\",' || {start} || ',' || {end} || ',\"' || {subject} || '\"]') as identity_key from {source}"
    )


STRUCTURE = [finding_sql("m", rule, "code_structure", "Low", "High", "7", "15", "'Service' || k || '.load'", detail) for rule, detail in (("CODE-DEEP-NESTING", "'nesting=5'"), ("CODE-HIGH-PARAMETER-COUNT", "'parameters=6'"))]
TEXT = "'" + MODULE + "'"
for key, value in (("a", "(k * 7 + 1) % 25"), ("b", "(k * 7 + 1) % 100"), ("c", "n"), ("d", "k"), ("h", "md5(cast(k as varchar))[1:20]")):
    TEXT = f"replace({TEXT}, '{{{key}}}', cast({value} as varchar))"
PLACE = "min(row(path, line)) as place"
AT = "place[1] as path, place[2] as line"
ORACLES |= {
    "file_index": f"with {MODULES}, {WANTED} select 'tables' as analysis_id, path, strlen({TEXT}) as size, 'Python' as language, false as is_binary, false as is_generated, null as manifest, 'pkg' || n as project_context, null as reason, true as eligible, 'supported' as support from m"
    " union all select 'tables', path, sum(strlen(name || spec) + 1)::bigint - 1, 'Text', false, false, 'requirements', project_context, null, true, 'unsupported' from d group by path, project_context",
    "read_manifests": f"with {WANTED} select 'tables' as analysis_id, project_context, 'PyPI' as ecosystem, name as canonical_name, path, name, spec, version, 'requirements' as section, 'runtime' as runtime_context, line, false as locked, 'direct' as dependency_class from d",
    "import_graph": f"with {MODULES}, e as (select a.k as src, b.k as dst from m a join m b on b.k = (a.k * 7 + 1) % 100 where a.k <> b.k), x as (select src as k, dst as other from e union select dst, src from e)"
    " select 'tables' as analysis_id, path, (select count(*) from e where src = m.k) as fan_out, (select count(*) from e where dst = m.k) as fan_in, (select count(*) from x where x.k = m.k) as coupling from m",
    "imported_names": f"with {MODULES}, i as (select 'pkg' || n as name from m union select 'pkg' || (k * 7 + 1) % 25 from m union select * from (values ('sqlite3'), ('subprocess'), ('flask'))) select 'tables' as analysis_id, string_agg(name, ',' order by name) as names, false as dynamic from i",
    "scope_summary": f"with {MODULES}, {WANTED} select 'tables' as analysis_id, 'modules' as scope, path from m union all select distinct 'tables', 'unsupported', path from d",
    "structure_rules": f"with {MODULES} {STRUCTURE[0]} union all {STRUCTURE[1]}",
    "security_rules": f"with {MODULES} " + finding_sql("m", "SEC-SQL-INJECTION", "security", "High", "High", "14", "14", "'Service' || k || '.load:cursor.execute'", "'cursor.execute external'"),
    "hardcoded_secrets": f"with {MODULES} " + finding_sql("m", "SEC-HARDCODED-SECRET", "security", "Medium", "Medium", "18", "18", "'assignment'", "'    ***'"),
    "duplicate_candidates": f"with {MODULES}, f as (select m.path, (select min(path) from m) as first from m where (select count(*) from m) > 1) " + finding_sql("f", "CODE-DUPLICATE-CANDIDATE", "code_structure", "Info", "Medium", "21", "28", "'total'", "'shares 25 runs, first in ' || first || ':21, longest 74 tokens'"),
    "dependency_rules": f"with {WANTED}, adv as (select * from (values ('lib2', '2.0', 'ADV-1'), ('lib4', '1.0', 'ADV-2')) v(name, version, advisory)),"
    f" k as (select name, version, advisory, {AT} from (select name, version, advisory, {PLACE} from d join adv using (name, version) group by 1, 2, 3)),"
    f" v as (select name, versions, {AT} from (select name, string_agg(distinct version, ',' order by version) as versions, count(distinct version) as n, {PLACE} from d where version is not null group by 1) where n > 1),"
    f" u as (select name, {AT} from (select name, {PLACE} from d group by 1)) "
    + " union all ".join([finding_sql("k", "DEP-KNOWN-VULNERABILITY", "dependency", "High", "High", "line", "line", "'PyPI:' || name || ':' || version || ':' || advisory", "advisory"), finding_sql("v", "DEP-DUPLICATE-VERSION", "dependency", "Low", "High", "line", "line", "'PyPI:' || name", "versions"), finding_sql("u", "DEP-UNUSED-CANDIDATE", "dependency", "Info", "Low", "line", "line", "'PyPI:' || name", "'no import found'")]),
    "findings_summary": "select 'tables' as analysis_id, 4 * count(*) as total, 0 as severity_critical, count(*) as severity_high, count(*) as severity_medium, 2 * count(*) as severity_low, 0 as severity_info, 3 * count(*) as confidence_high, count(*) as confidence_medium, 0 as confidence_low,"
    " '{\"CODE-DEEP-NESTING\":' || count(*) || ',\"CODE-HIGH-PARAMETER-COUNT\":' || count(*) || ',\"SEC-HARDCODED-SECRET\":' || count(*) || ',\"SEC-SQL-INJECTION\":' || count(*) || '}' as by_rule from supplier",
}
