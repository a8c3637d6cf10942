"""Dependency manifests and lock files as occurrences and lock edges, by an Arrow kernel over their texts."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import python_package

SCHEMA = "analysis_id string, path string, kind string, ecosystem string, name string, spec string, version string, section string, runtime_context string, line int, child string, child_version string, error string"
REQUIREMENT = re.compile(r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(\[[^\]]*\])?\s*([^;#]*)")
EXACT = re.compile(r"^(?:===?)?\s*v?(\d+(?:\.\d+)*(?:[-+.]?[0-9A-Za-z]+)*)$")
NPM_SECTIONS = {"dependencies": "runtime", "devDependencies": "development", "peerDependencies": "peer", "optionalDependencies": "optional"}


def exact(spec: str, npm: bool = False) -> str | None:
    """The version that a constraint pins, else none; a bare number pins only in npm."""
    m = EXACT.match(spec.strip())
    return m[1] if m and "*" not in spec and (npm or spec.strip().startswith("=")) else None


def line_of(lines: list[str], name: str) -> int | None:
    """The first line that holds the name as a word of its own; comment lines are passed over."""
    word = re.compile(rf"(?<![\w.@/-]){re.escape(name)}(?![\w./-])")
    return next((n for n, x in enumerate(lines, 1) if not x.lstrip().startswith("#") and word.search(x)), None)


def requirement(spec: str) -> tuple[str, str] | None:
    m = REQUIREMENT.match(spec.strip())
    return (m[1], m[3].strip()) if m else None


def requirements(text: str):
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.split(" #")[0].strip()
        if line and not line.startswith(("#", "-")) and "://" not in line and (r := requirement(line)):
            yield "occurrence", "PyPI", *r, exact(r[1]), "requirements", "runtime", n


def pyproject(text: str):
    data, lines = tomllib.loads(text), text.splitlines()
    project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
    groups = [("project.dependencies", "runtime", project.get("dependencies", []))]
    groups += [(f"project.optional-dependencies.{k}", "optional", v) for k, v in project.get("optional-dependencies", {}).items()]
    for section, context, specs in groups:
        for spec in specs:
            if r := requirement(spec):
                yield "occurrence", "PyPI", *r, exact(r[1]), section, context, line_of(lines, r[0])
    tables = [("tool.poetry.dependencies", "runtime", poetry.get("dependencies", {})), ("tool.poetry.dev-dependencies", "development", poetry.get("dev-dependencies", {}))]
    tables += [(f"tool.poetry.group.{k}.dependencies", "development", v.get("dependencies", {})) for k, v in poetry.get("group", {}).items()]
    for section, context, table in tables:
        for name, value in table.items():
            if name.lower() != "python":
                spec = value if isinstance(value, str) else value.get("version", "") if isinstance(value, dict) else ""
                yield "occurrence", "PyPI", name, spec, exact(spec), section, context, line_of(lines, name)


def poetry_lock(text: str):
    lines = text.splitlines()
    for p in tomllib.loads(text).get("package", []):
        name, version = p.get("name", ""), p.get("version")
        yield "occurrence", "PyPI", name, f"=={version}", version, "package", "development" if p.get("category") == "dev" else "runtime", line_of(lines, name)
        for child, spec in p.get("dependencies", {}).items():
            spec = spec if isinstance(spec, str) else spec.get("version", "") if isinstance(spec, dict) else ""
            yield "edge", "PyPI", name, "", version, "package", "runtime", None, child, exact(spec)


def pipfile_lock(text: str):
    data, lines = json.loads(text), text.splitlines()
    for section, context in (("default", "runtime"), ("develop", "development")):
        for name, value in data.get(section, {}).items():
            spec = value.get("version", "") if isinstance(value, dict) else ""
            yield "occurrence", "PyPI", name, spec, exact(spec), section, context, line_of(lines, name)


def package(text: str):
    data, lines = json.loads(text), text.splitlines()
    for section, context in NPM_SECTIONS.items():
        for name, spec in (data.get(section) or {}).items():
            if isinstance(spec, str):
                yield "occurrence", "npm", name, spec, exact(spec, npm=True), section, context, line_of(lines, name)


def package_lock(text: str):
    data, lines = json.loads(text), text.splitlines()
    packages = data.get("packages")
    if packages is not None:
        for place, value in packages.items():
            if place:
                name, version = value.get("name") or place.rpartition("node_modules/")[2], value.get("version")
                yield "occurrence", "npm", name, version or "", version, "packages", "development" if value.get("dev") else "runtime", line_of(lines, name)
                for child in value.get("dependencies", {}):
                    # the nested instance is the one that is used, else the one at the top
                    found = packages.get(f"{place}/node_modules/{child}") or packages.get(f"node_modules/{child}") or {}
                    yield "edge", "npm", name, "", version, "packages", "runtime", None, child, found.get("version")
        return
    todo = [(data.get("dependencies") or {}, [data.get("dependencies") or {}])]
    while todo:
        tree, above = todo.pop()
        for name, value in tree.items():
            inner, version = value.get("dependencies") or {}, value.get("version")
            yield "occurrence", "npm", name, version or "", version, "dependencies", "development" if value.get("dev") else "runtime", line_of(lines, name)
            for child in value.get("requires") or {}:
                found = next((level[child] for level in [inner, *reversed(above)] if child in level), {})
                yield "edge", "npm", name, "", version, "dependencies", "runtime", None, child, found.get("version")
            if inner:
                todo.append((inner, [*above, inner]))


READERS = {"requirements": requirements, "pyproject": pyproject, "poetry-lock": poetry_lock, "pipfile-lock": pipfile_lock, "package": package, "package-lock": package_lock}


def rows_of(kind: str, text: str) -> list[tuple]:
    """Rows of one manifest; one that can't be read is one row that says why."""
    try:
        return [tuple(r) + (None,) * (11 - len(r)) for r in READERS[kind](text)]
    except (ValueError, KeyError, AttributeError, TypeError, RecursionError) as e:
        return [("failed", None, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:300])]


def read_manifests(files: DataFrame) -> DataFrame:
    """SCHEMA rows of all eligible manifests."""
    kinds = [pa.int32() if x.strip().endswith(" int") else pa.string() for x in SCHEMA.split(",")]
    names = [x.split()[0] for x in SCHEMA.split(",")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a, path, *r) for a, path, kind, text in zip(*[c.to_pylist() for c in batch.columns], strict=True) for r in rows_of(kind, text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return files.where("eligible and manifest is not null").select("analysis_id", "path", "manifest", F.col("content").cast("string").alias("text")).mapInArrow(kernel, SCHEMA)


def occurrences(rows: DataFrame) -> DataFrame:
    """Occurrences with their canonical name, and whether each is direct, transitive or unknown.

    What a manifest names is direct; an entry of a lock file is direct if a
    manifest beside it names it, else transitive if an edge leads to it.
    """
    canonical = lambda c: F.when(F.col("ecosystem") == "npm", F.trim(c)).otherwise(python_package(c))
    rows = rows.withColumn("canonical_name", canonical(F.col("name"))).withColumn("project_context", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    found = rows.where("kind = 'occurrence'").withColumn("locked", F.col("path").rlike(r"(?i)(poetry\.lock|pipfile\.lock|package-lock\.json)$"))
    key = ["analysis_id", "project_context", "ecosystem", "canonical_name"]
    named = found.where("not locked").select(*key).distinct().withColumn("named", F.lit(True))
    reached = rows.where("kind = 'edge'").select("analysis_id", "project_context", "ecosystem", canonical(F.col("child")).alias("canonical_name")).distinct().withColumn("reached", F.lit(True))
    kind = F.when(~F.col("locked") | F.col("named"), "direct").when(F.col("reached"), "transitive").otherwise("unknown")
    return found.join(named, key, "left").join(reached, key, "left").withColumn("dependency_class", kind).drop("named", "reached", "child", "child_version", "error", "kind")
