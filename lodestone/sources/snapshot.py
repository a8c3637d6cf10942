"""A source tree as the relation ``files``: one row per file with its class, read by Spark's binary source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import extension, file_name, parent

# Limits of an index
MAX_FILE_BYTES, SNIFFED_BYTES = 1_048_576, 8_192
# What a suffix says about a file
LANGUAGES = {".py": "Python", ".pyi": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".java": "Java", ".go": "Go", ".rs": "Rust", ".c": "C", ".h": "C", ".cpp": "C++", ".cs": "C#", ".rb": "Ruby", ".php": "PHP", ".sh": "Shell", ".sql": "SQL", ".html": "HTML", ".css": "CSS", ".json": "JSON", ".toml": "TOML", ".yaml": "YAML", ".yml": "YAML", ".md": "Markdown", ".txt": "Text"}
MANIFESTS = {"pyproject.toml": "pyproject", "poetry.lock": "poetry-lock", "pipfile.lock": "pipfile-lock", "package.json": "package", "package-lock.json": "package-lock"}


def read_tree(spark: SparkSession, root: str, analysis_id: str) -> DataFrame:
    """analysis_id, path (relative, POSIX), content and size of every file below ``root``; of files beyond the limit nothing is read."""
    base = root.rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + base.removeprefix("file://").replace(".", "[.]") + "/", "")
    content = {True: F.col("content"), False: F.lit(None).cast("binary").alias("content")}
    kept = [read.where(F.col("length") <= MAX_FILE_BYTES if small else F.col("length") > MAX_FILE_BYTES).select(F.lit(analysis_id).alias("analysis_id"), path.alias("path"), c, F.col("length").alias("size")) for small, c in content.items()]
    return kept[0].unionByName(kept[1])


def is_binary(content: Column) -> Column:
    """A zero byte among the first; an empty file is text."""
    return F.coalesce(F.locate("\u0000", F.decode(F.substring(content, 1, SNIFFED_BYTES), "ISO-8859-1")) > 0, F.lit(False))


def manifest_kind(path: Column) -> Column:
    name = F.lower(file_name(path))
    known = F.create_map(*[F.lit(x) for pair in MANIFESTS.items() for x in pair])
    return F.when(name.rlike(r"^requirements.*\.txt$"), "requirements").otherwise(known[name])


def classified(tree: DataFrame) -> DataFrame:
    """``tree`` as ``files``: language, support, binary, generated, manifest kind, eligibility and why not (the first reason that fits)."""
    language = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[extension(F.col("path"))]
    name = F.lower(file_name(F.col("path")))
    files = tree.select(
        "*",
        language.alias("language"),
        is_binary(F.col("content")).alias("is_binary"),
        (name.endswith(".min.js") | name.endswith(".min.css") | name.contains("generated")).alias("is_generated"),
        manifest_kind(F.col("path")).alias("manifest"),
        parent(F.col("path")).alias("project_context"),
    )
    reason = (
        F.when(F.col("path").rlike("(^|/)[.]git/"), "excluded directory")
        .when(F.col("size") > MAX_FILE_BYTES, "file too large")
        .when(F.col("is_binary"), "binary file")
        .when(F.col("is_generated"), "generated file")
        .when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8")
    )
    return files.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull()).withColumn("support", F.when(F.col("language") == "Python", "supported").when(F.col("language").isNull(), "unknown").otherwise("unsupported"))


def source_lines(files: DataFrame) -> DataFrame:
    """analysis_id, path, line (from 1), text of eligible files; a file's last empty piece is no line."""
    text = F.col("content").cast("string")
    parts = F.split(F.regexp_replace(text, "(\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ])$", ""), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]", -1)
    return files.where("eligible and size > 0").select("analysis_id", "path", F.posexplode(parts).alias("at", "text")).select("analysis_id", "path", (F.col("at") + 1).alias("line"), "text")
