"""Views of a sealed analysis: filters, details, counts and orders that a client asks for, and the clean-up of what comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import generic as G

# What a branch name may not hold
FORBIDDEN = ("..", "@{", "~", "^", ":", "?", "*", "[", "\\")


# -- filters ------------------------------------------------------------------


def holds(text: str, *columns: str) -> Column:
    """Whether the columns, one behind the other, hold ``text``, whatever the case."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower()))


def select_files(files: DataFrame, text: str = "", with_findings: bool = False, not_analyzed: bool = False, parse_issue: bool = False, language: str | None = None) -> DataFrame:
    """Files (path, language, n_findings, state, parse) that meet all that is asked."""
    out = files.where(holds(text, "path")) if text else files
    for wanted, test in ((with_findings, F.col("n_findings") > 0), (not_analyzed, F.col("state") == "Not analyzed"), (parse_issue, F.col("parse").isin("partial", "failed"))):
        out = out.where(test) if wanted else out
    return out.where(F.col("language") == language) if language else out


def select_dependencies(deps: DataFrame, kind: str = "all", text: str = "") -> DataFrame:
    """Dependencies (name, version, dependency_class, n_advisories) that are direct, transitive, vulnerable, or there in several versions."""
    tests = {"all": F.lit(True), "direct": F.col("dependency_class") == "direct", "transitive": F.col("dependency_class") == "transitive", "vulnerable": F.col("n_advisories") > 0, "duplicate": F.lit(True)}
    out = deps.where(tests[kind])
    if kind == "duplicate":
        several = deps.groupBy("name").agg(F.min("version").alias("low"), F.max("version").alias("high")).where("low < high").select("name")
        out = out.join(several, "name", "left_semi")
    return out.where(holds(text, "name")) if text else out


def subgraph(nodes: DataFrame, edges: DataFrame, text: str = "", layer: str | None = None, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, layer) that meet all that is asked, and the edges (src, dst) of which both ends do."""
    out = nodes.where(holds(text, "node")) if text else nodes
    out = out.where(F.col("layer") == layer) if layer else out
    out = out.join(members, "node", "left_semi") if members is not None else out
    return out, incident(edges, out)


def incident(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges between members (``node``)."""
    for end in ("src", "dst"):
        edges = edges.join(members.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    return edges


# -- details ------------------------------------------------------------------


def named_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` (src_id, dst_id) with the nodes' names ``src`` and ``dst``; what has no node at an end is left out."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(f"{end}_id"), F.col("node").alias(end)), f"{end}_id")
    return edges


def first_finding(metrics: DataFrame, findings: DataFrame) -> DataFrame:
    """``metrics`` (metric_id, metric, path) with the first finding of that metric and path, if any."""
    first = findings.groupBy("metric", "path").agg(F.min("finding_id").alias("finding_id"))
    return metrics.join(first, ["metric", "path"], "left")


def files_of_findings(locations: DataFrame) -> DataFrame:
    """path, n: findings (finding_id) that have a place in a file, each once however many places it has there."""
    return locations.select("finding_id", "path").distinct().groupBy("path").agg(F.count("*").alias("n"))


def node_detail(edges: DataFrame, findings: DataFrame, node: Column) -> DataFrame:
    """One row: what a module imports, what imports it, and its findings, all sorted."""
    ends = edges.agg(F.array_sort(F.collect_set(F.when(F.col("src") == node, F.col("dst")))).alias("outgoing"), F.array_sort(F.collect_set(F.when(F.col("dst") == node, F.col("src")))).alias("incoming"))
    own = findings.where(F.col("path") == node).agg(F.array_sort(F.collect_list("finding_id")).alias("findings"))
    return ends.join(own)


def findings_of_dependencies(deps: DataFrame, findings: DataFrame) -> DataFrame:
    """``deps`` (dependency_id, finding_ids) with a row for each of its findings."""
    return deps.select("dependency_id", F.explode("finding_ids").alias("finding_id")).join(findings, "finding_id")


def dependency_links(findings: DataFrame, deps: DataFrame) -> DataFrame:
    """finding_id, dependency_id: by the subject ``ecosystem:name[:version[:advisory]]`` all occurrences of the name, or of the version if it has one."""
    parts = F.split("subject", ":", -1)
    asked = findings.select("finding_id", parts[0].alias("ecosystem"), parts[1].alias("name"), F.get(parts, F.lit(2)).alias("wanted"))
    return asked.join(deps, ["ecosystem", "name"]).where("wanted is null or wanted = version").select("finding_id", "dependency_id")


def module_links(findings: DataFrame, modules: DataFrame) -> DataFrame:
    """finding_id, module_id: the modules that a subject (paths between commas) names."""
    asked = findings.select("finding_id", F.explode(F.array_distinct(F.split("subject", ",", -1))).alias("path"))
    return asked.join(modules, "path").select("finding_id", "module_id")


def introducers(deps: DataFrame, relations: DataFrame) -> DataFrame:
    """name, version and the sorted parents that bring it in: a relation (parent, child, child_version) without a version is about all."""
    brings = relations.select("parent", F.col("child").alias("name"), "child_version")
    met = deps.select("name", "version").distinct().join(brings, "name", "left").where("child_version is null or child_version = version or parent is null")
    found = met.groupBy("name", "version").agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    return deps.select("name", "version").distinct().join(found, ["name", "version"], "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))


def relationships(imports: DataFrame, calls: DataFrame) -> DataFrame:
    """src, dst, kind: imports and calls as one table."""
    return imports.select("src", "dst", F.lit("import").alias("kind")).unionByName(calls.select("src", "dst", F.lit("call").alias("kind")))


# -- counts -------------------------------------------------------------------


def dependency_counts(deps: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, total, direct, transitive, vulnerable, and packages with several versions."""
    versions = deps.groupBy(*keys, "name").agg((F.min("version") < F.max("version")).alias("several"))
    several = versions.groupBy(*keys).agg(F.count_if(F.coalesce("several", F.lit(False))).alias("duplicate"))
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    return deps.groupBy(*keys).agg(F.count("*").alias("total"), count(F.col("dependency_class") == "direct").alias("direct"), count(F.col("dependency_class") == "transitive").alias("transitive"), count(F.col("n_advisories") > 0).alias("vulnerable")).join(several, keys)


def graph_counts(nodes: DataFrame, edges: DataFrame, cycles: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, modules, imports (distinct) and cycles, zero where there is none."""
    counted = [d.groupBy(*keys).agg(F.count("*").alias(n)) for d, n in ((edges.select(*keys, "src", "dst").distinct(), "imports"), (cycles, "cycles"))]
    out = nodes.groupBy(*keys).agg(F.count("*").alias("modules"))
    for c in counted:
        out = out.join(c, keys, "left")
    return out.na.fill(0, ["imports", "cycles"])


def cycle_groups(edges: DataFrame, members: DataFrame, keys: list[str], package: Column) -> DataFrame:
    """``keys``, component, n_members, n_edges (distinct, inside) and whether it crosses packages (``package`` of ``node``)."""
    inside = edges.select(*keys, "src", "dst").distinct()
    for end in ("src", "dst"):
        inside = inside.join(members.select(*keys, F.col("node").alias(end), F.col("component").alias(f"{end}_component")), [*keys, end])
    n = inside.where("src_component = dst_component").groupBy(*keys, F.col("src_component").alias("component")).agg(F.count("*").alias("n_edges"))
    groups = members.groupBy(*keys, "component").agg(F.count("*").alias("n_members"), (F.min(package) != F.max(package)).alias("crosses"))
    return groups.join(n, [*keys, "component"])


def totals(files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, number of files, bytes and the deepest folder."""
    return files.groupBy(*keys).agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"), F.max(F.size(F.split("path", "/", -1)) - 1).alias("depth"))


# -- first, capped, ordered ---------------------------------------------------


def first_metric(metrics: DataFrame, order: list[Column]) -> DataFrame:
    """Of metrics with one name, kind, path and subject the first."""
    return G.first_of(metrics, ["name", "kind", "path", "subject"], order)


def first_sink(sinks: DataFrame, keys: list[str]) -> DataFrame:
    """Of each function's sinks (is_write, line, column) the first that writes, or else the first."""
    return G.first_of(sinks, keys, [F.col("is_write").desc(), F.col("line"), F.col("column")])


def shown(names: Column, most: int) -> Column:
    """The first of an array as text, with how many more there are."""
    text = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(F.size(names) > most, F.concat(text, F.format_string(" +%d more", F.size(names) - most))).otherwise(text)


def locations_in_order(places: Column) -> Column:
    """An array of structs (primary, path, line, column): the primary place first."""
    keyed = F.transform(places, lambda p: F.struct((~p["primary"]).alias("later"), p["path"].alias("path"), p["line"].alias("line"), p["column"].alias("column"), p.alias("place")))
    return F.transform(F.array_sort(keyed), lambda p: p["place"])


def metric_order(value: str, descending: bool) -> list[Column]:
    """By a figure, what has none last both ways, then by path."""
    return [F.desc_nulls_last(value) if descending else F.asc_nulls_last(value), F.col("path")]


def evidence(lines: Column, first: Column, last: Column, before: int = 10, after: int = 40) -> Column:
    """Struct of start_line, end_line and the lines around a place: ``before`` it and ``after`` it, the place never cut off."""
    start, end = F.greatest(F.lit(1), first - before), F.least(F.size(lines), F.greatest(last, first + after))
    return F.struct(start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), F.slice(lines, start.cast("int"), (end - start + 1).cast("int")).alias("lines"))


# -- what comes in ------------------------------------------------------------


def repository(url: Column, host: str = "github.com") -> Column:
    """Struct of owner and name in lower case, or null for what is not ``https://host/owner/name``."""
    parts = "(?i)^https://" + host.replace(".", "[.]") + "/+([A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?)/+([A-Za-z0-9_.-]{1,104}?)(?:[.]git)?/*$"
    text = F.trim(url)
    owner, name = (F.lower(F.regexp_extract(text, parts, k)) for k in (1, 2))
    good = text.rlike(parts) & ~name.isin("", ".", "..") & (F.length(name) <= 100)
    return F.when(good, F.struct(owner.alias("owner"), name.alias("name")))


def branch_is_valid(branch: Column) -> Column:
    """Whether a text can be the name of a branch."""
    bad = branch.rlike(r"[\s\x00-\x1f]") | branch.rlike(r"^[/.\-]") | branch.rlike(r"([/.]|\.lock)$")
    for part in FORBIDDEN:
        bad = bad | F.contains(branch, F.lit(part))
    return F.coalesce((F.length(branch) > 0) & (F.length(branch) <= 255) & ~bad, F.lit(False))


def commit(sha: Column) -> Column:
    """A commit's name in lower case, or null for what is none."""
    text = F.trim(sha)
    return F.when(text.rlike("^[0-9a-fA-F]{7,64}$"), F.lower(text))


def advisory(raw: Column) -> Column:
    """Struct of id, sorted distinct aliases and references, severity and summary of an advisory's JSON text; null without an id."""
    schema = "id string, summary string, aliases array<string>, published string, modified string, severity array<struct<type string, score string>>, database_specific struct<severity string>, references array<struct<url string>>"
    r = F.from_json(raw, schema)
    clean = lambda a: F.array_sort(F.array_distinct(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))
    severity = F.coalesce(F.nullif(r["database_specific"]["severity"], F.lit("")), F.get(r["severity"], F.lit(0))["score"])
    return F.when(r["id"] != "", F.struct(r["id"].alias("advisory_id"), clean(r["aliases"]).alias("aliases"), r["summary"].alias("summary"), severity.alias("severity"), clean(F.transform(r["references"], lambda x: x["url"])).alias("references"), r["published"].alias("published"), r["modified"].alias("modified")))


def coverage_of_files(files: DataFrame, coverage: DataFrame, key: str) -> DataFrame:
    """``coverage`` with the path of its file; a row whose file is unknown is an error."""
    known = files.select(key, "path").withColumn("__known", F.lit(True))
    unknown = F.raise_error(F.concat(F.lit("coverage of an unknown file: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return coverage.join(known, key, "left").withColumn("path", F.when(F.col("__known"), F.col("path")).otherwise(unknown.cast("string"))).drop("__known")


def imported_names(code: DataFrame, keys: list[str]) -> DataFrame:
    """Top-level names that absolute imports bring in, in lower case, and whether any module is brought in by a call."""
    found = code.where("kind in ('import', 'call')")
    top = F.when((F.col("kind") == "import") & ~F.col("name").startswith("."), F.lower(F.element_at(F.split("name", "[.]"), 1)))
    return found.select(*keys, top.alias("name"), ((F.col("kind") == "call") & F.col("name").isin("__import__", "importlib.import_module")).alias("dynamic")).groupBy(*keys).agg(F.array_sort(F.collect_set("name")).alias("names"), F.bool_or("dynamic").alias("dynamic"))


def scope_summary(files: DataFrame, code: DataFrame) -> DataFrame:
    """analysis_id, scope, path: modules read in full, Python files that failed, and files of other languages; a row a file, never one list of all."""
    failed = code.where("kind = 'diagnostic'").select("analysis_id", "path", F.lit(True).alias("failed")).distinct()
    python = F.col("language") == "Python"
    scope = F.when(python & F.col("failed"), "failed").when(python & F.col("eligible"), "modules").otherwise("unsupported")
    return files.join(failed, ["analysis_id", "path"], "left").select("analysis_id", scope.alias("scope"), "path")
