"""State, storage and queries of sealed snapshots."""

from __future__ import annotations

import html
import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators import generic as G

# The closed vocabularies, in their order
SEVERITIES = ("Critical", "High", "Medium", "Low", "Info")
CONFIDENCES = ("High", "Medium", "Low")
AREAS = ("security", "dependency", "architecture", "code_structure")
COVERAGE = ("Failed", "Not analyzed", "Partially analyzed", "Fully analyzed")
RANK = {s: k for k, s in enumerate(SEVERITIES)}
CONFIDENCE_RANK = {s: k for k, s in enumerate(CONFIDENCES)}


def once(*findings: DataFrame) -> DataFrame:
    """All findings, once per (analysis, identity)."""
    every = reduce(DataFrame.unionByName, findings)
    return G.first_of(every, ["analysis_id", "identity_key"], [F.col("rule_id"), F.col("path"), F.col("start_line")])


def merged(*findings: DataFrame) -> DataFrame:
    """All findings, once per (analysis, identity), numbered F-0001 on per analysis in their presentation order."""
    return G.numbered(once(*findings), ["analysis_id"], ["rule_id", "path", "start_line", "identity_key"], lead=2)


def file_coverage(files: DataFrame, code: DataFrame) -> DataFrame:
    """analysis_id, path, area, state: what was not looked at in full; files that were are not listed."""
    failed = code.where("kind = 'diagnostic'").select("analysis_id", "path", F.lit(True).alias("failed")).distinct()
    rows = files.join(failed, ["analysis_id", "path"], "left").select("*", F.explode(F.array(*[F.lit(a) for a in AREAS])).alias("area"))
    state = F.when(F.col("failed"), "Failed").when(~F.col("eligible"), "Not analyzed").when((F.col("area") == "dependency") == F.col("manifest").isNull(), "Not analyzed").when((F.col("support") != "supported") & (F.col("area") == "security"), "Partially analyzed").otherwise("Fully analyzed")
    return rows.select("analysis_id", "path", "area", state.alias("state"), "reason").where("state <> 'Fully analyzed'")


def domain_states(findings: DataFrame, files: DataFrame, code: DataFrame, deps: DataFrame) -> DataFrame:
    """analysis_id, area, state, n_findings: four rows per analysis; a state of null means findings speak for themselves."""
    base = files.groupBy("analysis_id").agg(F.count_if((F.col("language") == "Python") & F.col("eligible")).alias("python"), F.count_if(F.col("manifest").isNotNull()).alias("manifests"))
    failed = code.where("kind = 'diagnostic'").groupBy("analysis_id").agg(F.count("*").alias("failed"))
    broken = deps.where("kind = 'failed'").groupBy("analysis_id").agg(F.count("*").alias("broken"))
    rows = base.join(failed, "analysis_id", "left").join(broken, "analysis_id", "left").na.fill(0).select("*", F.explode(F.array(*[F.lit(a) for a in AREAS])).alias("area"))
    counts = findings.groupBy("analysis_id", F.col("category").alias("area")).agg(F.count("*").alias("n_findings"))
    rows = rows.join(counts, ["analysis_id", "area"], "left").na.fill(0, ["n_findings"])
    dependency = F.col("area") == "dependency"
    state = (
        F.when(dependency & (F.col("broken") > 0), "Analysis failed")
        .when(dependency & (F.col("manifests") == 0), "Analysis not performed")
        .when(~dependency & (F.col("python") == 0), "Analysis not performed")
        .when(~dependency & (F.col("failed") == F.col("python")), "Analysis failed")
        .when(~dependency & (F.col("failed") > 0), "Completed with limitations")
        .when(F.col("n_findings") > 0, F.lit(None))
        .otherwise("No findings detected")
    )
    return rows.select("analysis_id", "area", state.alias("state"), "n_findings")


def outcomes(states: DataFrame) -> DataFrame:
    """analysis_id, outcome: Failed if nothing worked, Completed if all did."""
    bad, none = F.col("state") == "Analysis failed", F.col("state").isin("Analysis failed", "Analysis not performed")
    return states.groupBy("analysis_id").agg(F.when(F.bool_and(F.coalesce(none, F.lit(False))), "Failed").when(F.bool_or(F.coalesce(bad | (F.col("state") == "Completed with limitations"), F.lit(False))), "Completed with limitations").otherwise("Completed").alias("outcome"))


# -- storage ------------------------------------------------------------------


def seal(spark: SparkSession, store: str, tables: dict[str, DataFrame]) -> None:
    """Writes the tables into a folder of this run, dealt by analysis; an analysis is in the store once at most, and only whole.

    Its row in ``sealed`` comes last and names the run's folder: what a broken
    run has left is in a folder that nothing names, so a repeated run never
    meets it.
    """
    states = tables["states"]
    wrong = states.groupBy("analysis_id").agg(F.count("*").alias("n")).where(F.col("n") != len(AREAS))
    if not wrong.isEmpty():
        raise ValueError("an analysis needs a state for each of its four areas")
    ids = states.select("analysis_id").distinct()
    done = sealed(spark, store)
    if done is not None and not ids.join(done, "analysis_id", "left_semi").isEmpty():
        raise ValueError("a sealed analysis is never written again")
    run = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.partitionBy("analysis_id").parquet(f"{store}/runs/{run}/{name}")
    schemas = F.create_map(*[F.lit(x) for name, df in tables.items() for x in (name, df.schema.json())])  # an empty table has no file to tell
    ids.withColumn("sealed_at", F.current_timestamp()).withColumn("run", F.lit(run)).withColumn("schemas", schemas).write.mode("append").parquet(f"{store}/sealed")


def sealed(spark: SparkSession, store: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/sealed")
    return spark.read.parquet(f"{store}/sealed") if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def load(spark: SparkSession, store: str, table: str, analysis_id: str) -> DataFrame:
    """One table of one sealed analysis; only its folder is read."""
    done = sealed(spark, store)
    row = done and done.where(F.col("analysis_id") == analysis_id).select("run", "schemas").first()
    if not row:
        raise KeyError(f"no sealed analysis {analysis_id}")
    schema = StructType.fromJson(json.loads(row["schemas"][table]))
    return spark.read.schema(schema).parquet(f"{store}/runs/{row['run']}/{table}").where(F.col("analysis_id") == analysis_id)


def history(spark: SparkSession, store: str) -> DataFrame:
    """Sealed analyses, the newest first."""
    return sealed(spark, store).orderBy(F.desc("sealed_at"), F.desc("analysis_id"))


# -- queries ------------------------------------------------------------------

SORTS = {"severity": lambda: [G.rank_of("severity", RANK), F.col("path"), F.col("start_line"), F.col("finding_id")], "confidence": lambda: [G.rank_of("confidence", CONFIDENCE_RANK), F.col("finding_id")], "rule": lambda: [F.col("rule_id"), F.col("path"), F.col("start_line"), F.col("finding_id")], "category": lambda: [F.col("category"), F.col("rule_id"), F.col("finding_id")], "file": lambda: [F.col("path"), F.col("start_line"), F.col("finding_id")]}


def select_findings(findings: DataFrame, category=(), severity=(), confidence=(), rule_id=(), search: str = "", sort: str = "severity", descending: bool = False, page: int = 1, size: int = 50) -> tuple[DataFrame, int]:
    """A page of findings and how many there are before filters.

    Filters hold together; of one filter any value will do.  Sorting by severity is always from the worst.
    """
    known = {"category": AREAS, "severity": SEVERITIES, "confidence": CONFIDENCES}
    out = findings
    for name, values in (("category", category), ("severity", severity), ("confidence", confidence), ("rule_id", rule_id)):
        if bad := [v for v in values if name in known and v not in known[name]]:
            raise ValueError(f"unknown {name}: {bad}")
        if values:
            out = out.where(F.col(name).isin(*values))
    if search:
        out = out.where(F.contains(F.lower(F.concat_ws("\n", "rule_id", "path", "subject")), F.lit(search.lower())))
    if sort not in SORTS:
        raise ValueError(f"unknown sort: {sort}")
    order = [c.desc() if descending and sort != "severity" else c for c in SORTS[sort]()]
    return G.page(out, order, page, size), findings.count()


def summary(findings: DataFrame) -> DataFrame:
    """One row per analysis: total, a zero-filled count per severity and confidence, and counts by rule."""
    count = lambda c, v: F.count_if(F.col(c) == v).alias(f"{c}_{v.lower()}")
    by = findings.groupBy("analysis_id", "rule_id").agg(F.count("*").alias("total"), *[count("severity", s) for s in SEVERITIES], *[count("confidence", s) for s in CONFIDENCES])
    sums = [F.sum(c).alias(c) for c in by.columns[2:]]
    return by.groupBy("analysis_id").agg(*sums, F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", F.col("total").alias("count"))))).alias("by_rule"))


def compare(base: DataFrame, target: DataFrame, target_states: DataFrame) -> DataFrame:
    """New, resolved and unchanged findings by identity; a resolved one is qualified if its area was not fully looked at."""
    out = G.compared(base, target, "identity_key", "rule_id", "category", "path")
    weak = target_states.where("state in ('Analysis failed', 'Analysis not performed', 'Completed with limitations')").select(F.col("area").alias("base_category"), F.lit(True).alias("weak"))
    return out.join(F.broadcast(weak), "base_category", "left").withColumn("qualified", (F.col("state") == "resolved") & F.coalesce("weak", F.lit(False))).drop("weak")


def hotspots(findings: DataFrame) -> DataFrame:
    """Places with two findings at least, the most first."""
    by = findings.where("category = 'code_structure' or rule_id like 'ARCH-LARGE-%'").groupBy("analysis_id", "path", "start_line").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    return by.where("n >= 2").orderBy(F.desc("n"), "path", "start_line")


def tree(findings: DataFrame) -> DataFrame:
    """Findings of every directory and file."""
    rows = findings.select("analysis_id", "path", "severity", F.explode(G.prefixes(F.col("path"))).alias("directory"))
    return rows.groupBy("analysis_id", "directory").agg(F.count("*").alias("n_findings"), F.count_if(F.col("severity").isin("Critical", "High")).alias("n_serious"))


def document(findings: DataFrame, states: DataFrame) -> DataFrame:
    """One JSON text per analysis: its areas with their findings; an area without a result has null for them."""
    item = F.struct("finding_id", "rule_id", "severity", "confidence", "path", "start_line", "end_line", "subject", "detail", "identity_key")
    by = findings.groupBy("analysis_id", F.col("category").alias("area")).agg(F.array_sort(F.collect_list(item)).alias("findings"))
    rows = states.join(by, ["analysis_id", "area"], "left")
    kept = F.when(F.col("state").isin("Analysis failed", "Analysis not performed"), F.lit(None)).otherwise(F.coalesce("findings", F.array()))
    order = F.array_position(F.array(*[F.lit(a) for a in AREAS]), F.col("area"))
    areas = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("at"), "area", "state", kept.alias("findings")))), lambda x: F.struct(x["area"].alias("area"), x["state"].alias("state"), x["findings"].alias("findings")))
    return rows.groupBy("analysis_id").agg(F.to_json(F.struct(F.first("analysis_id").alias("analysis_id"), areas.alias("areas")), {"ignoreNullFields": "false"}).alias("document"))


MOST_REPORT_BYTES = 25_000_000


def report(text: str, form: str = "markdown") -> str:
    """A document as markdown or HTML; beyond the limit it is refused, not cut."""
    data = json.loads(text)
    cell = lambda s: str(s if s is not None else "").replace("|", "\\|").replace("\n", " ")
    out = [f"# Analysis {data['analysis_id']}"]
    for area in data["areas"]:
        out += ["", f"## {area['area']}", "", area["state"] or f"{len(area['findings'])} findings"]
        if area["findings"]:
            out += ["", "| id | rule | severity | confidence | place | detail |", "|-|-|-|-|-|-|"]
            out += [f"| {f['finding_id']} | {f['rule_id']} | {f['severity']} | {f['confidence']} | {cell(f['path'])}:{f['start_line']} | {cell(f['detail'])} |" for f in area["findings"]]
    body = "\n".join(out) + "\n"
    if form == "html":
        body = "<!doctype html><meta charset='utf-8'><title>Analysis</title><pre>" + html.escape(body) + "</pre>\n"
    if len(body.encode()) > MOST_REPORT_BYTES:
        raise ValueError("the report is larger than its limit")
    return body


def worst(column: Column | str) -> Column:
    """Of a group's coverage states the worst."""
    c = F.col(column) if isinstance(column, str) else column
    return F.min_by(c, G.rank_of(c, {s: k for k, s in enumerate(COVERAGE)}))
