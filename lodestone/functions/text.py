"""Scalar functions of the analysis as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "***"
#: name -> (pattern, severity): what is taken for a secret in a line of text
SECRETS = {
    "private-key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "Critical"),
    "aws-access-key": (r"AKIA[0-9A-Z]{16}", "High"),
    "bearer-token": (r"[Bb]earer +[A-Za-z0-9._~+/-]{20,}", "High"),
    "connection-string": (r"[a-z][a-z0-9+]*://[^/ :@]+:[^/ :@]+@[^ /]+", "High"),
    "assignment": (r"(?i)(?:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"'][^\"']{8,}[\"']", "Medium"),
}
#: values that stand for a secret and are none
PLACEHOLDER = r"(?i)(example|changeme|placeholder|your[_-]|xxxx|dummy|<[^>]+>|\$\{|os\.environ|getenv)"
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"


def secret_kind(line: Column) -> Column:
    """Name of the first kind of secret that a line holds, else null."""
    out = F.lit(None).cast("string")
    for name, (pattern, _) in reversed(SECRETS.items()):
        out = F.when(line.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(line.rlike(PLACEHOLDER), F.lit(None)).otherwise(out)


def secret_severity(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for name, (_, severity) in SECRETS.items() for x in (name, severity)])[kind]


def masked(text: Column) -> Column:
    """Text without the values of secrets; mail addresses keep their domain."""
    for pattern, _ in SECRETS.values():
        text = F.regexp_replace(text, pattern, MASK)
    return F.regexp_replace(text, MAIL, f"{MASK}@mail")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def parent(path: Column) -> Column:
    """Directory of a path, empty at the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; names that begin with their only dot have none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+([.][^.]+)$", 1))


def python_package(name: Column) -> Column:
    """Index name: lower case, runs of ``-``, ``_`` and ``.`` as one ``-``, extras cut."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), r"\[.*\]$", ""), "[-_.]+", "-"))


def specifier_kind(text: Column) -> Column:
    """exact, range, wildcard, url or any, of a version constraint."""
    t = F.trim(text)
    return (
        F.when(t.isNull() | (t == "") | (t == "*"), "any")
        .when(t.rlike("^(https?|git|file)[+:]"), "url")
        .when(t.rlike(r"^(==|=|===)? *v?\d+(\.\d+)*([-+.]?[0-9A-Za-z]+)*$") & ~t.contains("*"), "exact")
        .when(t.contains("*") | t.rlike(r"[.]x$"), "wildcard")
        .otherwise("range")
    )


def json_text(value: Column) -> Column:
    """A JSON string in ASCII (characters up to U+FFFF)."""
    escaped = F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"')
    for raw, short in (("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t")):
        escaped = F.regexp_replace(escaped, raw, short)
    chars = F.split(escaped, "")
    wide = F.transform(chars, lambda c: F.when((F.ascii(c) > 126) | ((F.ascii(c) < 32) & (c != "")), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))).otherwise(c))
    return F.concat(F.lit('"'), F.when(escaped.rlike("[^ -~]"), F.array_join(wide, "")).otherwise(escaped), F.lit('"'))


def identity(*fields: Column) -> Column:
    """SHA-256 of the compact JSON array of texts and whole numbers; a text must be given as ``json_text``."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *[f.cast("string") for f in fields]), F.lit("]")), 256)
