"""The detectors as DataFrame queries: each gives findings of one shape.

``code`` is ``python_code.parsed``, ``files`` ``snapshot.classified``,
``deps`` ``manifests.occurrences``.  Every rule runs over all analyses at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.source_text import longest_shared_run
from lodestone.operators import generic as G
from lodestone.sources.snapshot import source_lines

# Thresholds; all strict but for duplicate_tokens, which counts from its value on
THRESHOLDS = {"fan_out": 7, "fan_in": 10, "coupling": 12, "module_lines": 500, "module_declarations": 30, "class_lines": 200, "class_methods": 10, "function_lines": 50, "function_complexity": 10, "complexity": 10, "nesting": 4, "parameters": 5, "duplicate_tokens": 50, "dependencies": 200}
# Words of a path that tell its layer, and the layers' order
LAYERS = {
    "presentation": "presentation ui view views web frontend templates static",
    "application": "application app service services usecase usecases controller controllers handler handlers routes api",
    "domain": "domain model models entity entities core business",
    "infrastructure": "infrastructure infra repository repositories db database persistence dao storage external adapters migrations",
}
FINDING = ("analysis_id", "rule_id", "category", "severity", "confidence", "path", "start_line", "end_line", "subject", "detail", "identity_key")


def finding(df: DataFrame, rule: str, category: str, severity: Column | str, confidence: Column | str, subject: Column, detail: Column, line: str = "line", end: str = "end_line") -> DataFrame:
    """Findings of one rule, once per identity: the analysis is no part of it, so it lasts from run to run."""
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    out = df.select("analysis_id", F.lit(rule).alias("rule_id"), F.lit(category).alias("category"), text(severity).alias("severity"), text(confidence).alias("confidence"), "path", F.col(line).cast("int").alias("start_line"), F.col(end).cast("int").alias("end_line"), subject.alias("subject"), detail.alias("detail"))
    return identified(out.where("severity is not null"))


def identified(out: DataFrame, *apart: str) -> DataFrame:
    """Once per identity, and per value of the columns ``apart``."""
    key = T.identity(T.json_text(F.col("rule_id")), T.json_text(F.col("category")), T.json_text(F.col("path")), F.col("start_line"), F.col("end_line"), T.json_text(F.col("subject")))
    return G.first_of(out.withColumn("identity_key", key), ["analysis_id", "identity_key", *apart], [F.col("start_line"), F.col("severity"), F.col("detail")])


def findings(df: DataFrame, category: str, rules: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """Findings of several rules (rule, verdict, subject, detail) in one pass over ``df``; a verdict is ``Severity/Confidence`` or null."""
    each = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(rule).alias("rule_id"), verdict.alias("verdict"), subject.alias("subject"), detail.alias("detail")) for i, (rule, verdict, subject, detail) in enumerate(rules)])
    found = df.select("analysis_id", "path", "line", "end_line", F.explode(F.filter(each, lambda f: f["verdict"].isNotNull())).alias("f")).withColumn("v", F.split("f.verdict", "/", -1))
    out = found.select("analysis_id", "f.rule_id", F.lit(category).alias("category"), F.col("v")[0].alias("severity"), F.col("v")[1].alias("confidence"), "path", F.col("line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "f.subject", "f.detail", "f.part")
    return identified(out, "part").select(*FINDING)


# -- the import graph ---------------------------------------------------------


def import_edges(code: DataFrame) -> DataFrame:
    """analysis_id, src, dst (files), site, conditional, deferred: imports resolved by their longest leading part that is a module."""
    own = ["analysis_id", "path"]
    modules = code.where("kind = 'module'").select("analysis_id", F.col("path").alias("dst"), F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/__init__$", ""), "/", ".").alias("target"), F.when(F.col("path").endswith("/__init__.py"), 1).otherwise(0).alias("package"))
    modules = G.first_of(modules, ["analysis_id", "target"], [F.col("package"), F.col("dst")])
    package = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/", -1)
    level = F.col("attrs")["level"].cast("int")
    base = F.when(level > 0, F.array_join(F.slice(package, F.lit(1), F.greatest(F.lit(0), F.size(package) - level + 1)), ".")).otherwise("")
    stem = F.concat_ws(".", F.when(base != "", base), F.when(F.col("name") != "", F.col("name")))
    names = F.when(F.size("items") > 0, F.transform("items", lambda n: F.concat_ws(".", F.when(stem != "", stem), n))).otherwise(F.array(stem))
    imports = code.where("kind = 'import'").select(*own, F.col("line").alias("site"), (F.col("attrs")["conditional"] == "true").alias("conditional"), (F.col("attrs")["deferred"] == "true").alias("deferred"), F.explode(names).alias("full"))
    # one pass: each import asks with its leading parts and is put together again by all that it is; equal ones are counted
    asked = imports.select("*", F.posexplode(G.prefixes(F.col("full"), ".")).alias("depth", "target"))
    found = asked.join(modules, ["analysis_id", "target"], "left").groupBy(*imports.columns).agg(F.max_by("dst", F.when(F.col("dst").isNotNull(), F.col("depth"))).alias("dst"), F.count_if(F.col("depth") == 0).cast("int").alias("times"))
    return found.select("*", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("analysis_id", F.col("path").alias("src"), "dst", "site", "conditional", "deferred", "full")


def graph_metrics(code: DataFrame, edges: DataFrame) -> DataFrame:
    """analysis_id, path, fan_out, fan_in, coupling of every module."""
    joined = edges.where("dst is not null").select(F.struct("analysis_id", F.col("src").alias("path")).alias("src"), F.struct("analysis_id", F.col("dst").alias("path")).alias("dst"))
    nodes = code.where("kind = 'module'").select(F.struct("analysis_id", "path").alias("node"))
    return G.degrees(joined, nodes).select("node.*", "fan_out", "fan_in", "coupling")


def high_degree(code: DataFrame, edges: DataFrame) -> DataFrame:
    metrics = graph_metrics(code, edges).withColumn("line", F.lit(1))
    parts = []
    for rule, name in (("ARCH-HIGH-FAN-OUT", "fan_out"), ("ARCH-HIGH-FAN-IN", "fan_in"), ("ARCH-HIGH-COUPLING", "coupling")):
        over = G.over_threshold(metrics, name, THRESHOLDS[name])
        parts.append(finding(over, rule, "architecture", F.col("severity"), "High", F.col("path"), F.format_string(f"{name}=%d", name), end="line"))
    return reduce(DataFrame.unionByName, parts)


def cycles(edges: DataFrame) -> DataFrame:
    """ARCH-CIRCULAR-DEPENDENCY: modules that reach each other, over any number of imports, one finding per group; self-imports are groups of one."""
    mutual = G.strong_components(edges.where("dst is not null"), "analysis_id")
    groups = mutual.groupBy("analysis_id", F.col("component").alias("path")).agg(F.array_sort(F.collect_list("node")).alias("paths"))
    found = groups.withColumn("line", F.lit(1))
    folders = F.size(F.array_distinct(F.transform("paths", lambda p: T.parent(p))))
    return finding(found, "ARCH-CIRCULAR-DEPENDENCY", "architecture", F.when(folders > 1, "Medium").otherwise("Low"), "High", F.array_join(F.slice("paths", 1, 3), ","), F.array_join("paths", " -> "), end="line")


def layer_of(path: Column) -> Column:
    """Struct of layer, rank and whether the file's own name told: of all parts the deepest that holds a layer's word."""
    words = F.create_map(*[F.lit(x) for rank, (layer, names) in enumerate(LAYERS.items()) for n in names.split() for x in (n, f"{rank}{layer}")])
    parts = F.reverse(F.split(F.lower(F.regexp_replace(path, r"\.[^./]*$", "")), "/", -1))
    hit = lambda p: F.array_min(F.array_compact(F.transform(F.array_distinct(F.concat(F.array(p), F.split(p, "[-_]", -1))), lambda w: F.when(words[w].isNotNull(), F.struct(w.alias("word"), words[w].alias("layer"))))))
    hits = F.transform(parts, lambda p, i: F.struct(hit(p)["layer"].alias("layer"), (i == 0).alias("own")))
    first = F.get(F.filter(hits, lambda h: h["layer"].isNotNull()), F.lit(0))
    return F.struct(F.substring(first["layer"], 2, 40).alias("layer"), F.substring(first["layer"], 1, 1).cast("int").alias("rank"), F.coalesce(first["own"], F.lit(False)).alias("from_name"))


def layer_violations(edges: DataFrame) -> DataFrame:
    """ARCH-LAYER-VIOLATION: an import that goes up; only where an analysis shows two layers at least."""
    ranked = edges.where("dst is not null and src <> dst").groupBy("analysis_id", "src", "dst").agg(F.min("site").alias("line")).withColumn("s", layer_of(F.col("src"))).withColumn("d", layer_of(F.col("dst")))
    seen = ranked.select("analysis_id", F.explode(F.array("s.layer", "d.layer")).alias("layer")).groupBy("analysis_id").agg(F.count_distinct("layer").alias("n")).where("n >= 2").select("analysis_id")
    up = ranked.where("s.rank > d.rank").join(seen, "analysis_id").withColumn("path", F.col("src"))
    return finding(up, "ARCH-LAYER-VIOLATION", "architecture", "Low", F.when(F.col("s.from_name") | F.col("d.from_name"), "Low").otherwise("Medium"), F.concat_ws(",", "src", "dst"), F.concat_ws(" -> ", "s.layer", "d.layer"), end="line")


# -- sizes and structure ------------------------------------------------------


def functions_of(code: DataFrame) -> DataFrame:
    """Functions with lines, parameters, complexity (1 + if, for, while, except) and the deepest nesting inside."""
    own = ["analysis_id", "path"]
    named = F.concat_ws(".", F.when(F.col("scope") != "", F.col("scope")), "name")
    is_function = F.col("kind") == "function"
    rows = code.where("kind = 'function' or kind = 'flow' and scope <> ''").select(*own, F.when(is_function, named).otherwise(F.col("scope")).alias("qualified"), "kind", "name", "line", "end_line", F.col("attrs")["parameters"].cast("int").alias("parameters"))
    grouped = rows.groupBy(*own, "qualified").agg(
        F.collect_list(F.when(is_function, F.struct("line", "end_line", "parameters"))).alias("spans"),
        F.count_if(~is_function & F.col("name").isin("if", "for", "while", "except")).alias("decisions"),
        F.collect_set(F.when(~is_function & (F.col("name") != "except"), F.struct(F.col("line").alias("start"), F.col("end_line").alias("end")))).alias("blocks"),
    )
    # distinct blocks, so each holds itself and those around it
    depth = F.transform("blocks", lambda x: F.size(F.filter("blocks", lambda o: (o["start"] <= x["start"]) & (o["end"] >= x["end"]))))
    found = grouped.select(*own, "qualified", F.explode("spans").alias("span"), (F.col("decisions") + 1).alias("complexity"), F.coalesce(F.array_max(depth), F.lit(0)).cast("long").alias("nesting"))
    return found.select(*own, "qualified", "span.line", "span.end_line", (F.col("span.end_line") - F.col("span.line") + 1).alias("lines"), "span.parameters", "complexity", "nesting")


def sizes(code: DataFrame) -> DataFrame:
    """ARCH-LARGE-MODULE, -CLASS and -FUNCTION: either of two signals; Medium if both."""
    own, limit = ["analysis_id", "path"], THRESHOLDS
    by = code.groupBy(*own).agg(F.max(F.when(F.col("kind") == "module", F.col("end_line"))).alias("lines"), F.count_if(F.col("kind").isin("class", "function")).alias("declarations")).withColumn("line", F.lit(1)).withColumn("end_line", F.col("lines"))
    named = F.concat_ws(".", F.when(F.col("scope") != "", F.col("scope")), "name")
    is_class = F.col("kind") == "class"
    rows = code.where("kind = 'class' or kind = 'function' and attrs['owner'] is not null").select(*own, F.when(is_class, named).otherwise(F.col("scope")).alias("qualified"), "kind", "line", "end_line")
    held = rows.groupBy(*own, "qualified").agg(F.collect_list(F.when(is_class, F.struct("line", "end_line"))).alias("spans"), F.count_if(~is_class).alias("methods"))
    classes = held.select(*own, "qualified", "methods", F.explode("spans").alias("span")).select(*own, "qualified", "span.line", "span.end_line", (F.col("span.end_line") - F.col("span.line") + 1).alias("lines"), "methods")
    parts = []
    for df, rule, a, la, b, lb, subject in ((by, "ARCH-LARGE-MODULE", "lines", "module_lines", "declarations", "module_declarations", "path"), (classes, "ARCH-LARGE-CLASS", "lines", "class_lines", "methods", "class_methods", "qualified"), (functions_of(code), "ARCH-LARGE-FUNCTION", "lines", "function_lines", "complexity", "function_complexity", "qualified")):
        x, y = F.col(a) > limit[la], F.col(b) > limit[lb]
        confidence = F.when(~x & y, "Medium").otherwise("High") if "FUNCTION" in rule else "High"
        parts.append(finding(df, rule, "architecture", F.when(x & y, "Medium").when(x | y, "Low"), confidence, F.col(subject), F.format_string(f"{a}=%d, {b}=%d", a, b)))
    return reduce(DataFrame.unionByName, parts)


def structure(code: DataFrame) -> DataFrame:
    """CODE-HIGH-COMPLEXITY, -DEEP-NESTING and -HIGH-PARAMETER-COUNT."""
    rules = (("CODE-HIGH-COMPLEXITY", "complexity", "Medium"), ("CODE-DEEP-NESTING", "nesting", "Low"), ("CODE-HIGH-PARAMETER-COUNT", "parameters", "Low"))
    return findings(functions_of(code), "code_structure", [(rule, F.when(F.col(c) > THRESHOLDS[c], f"{severity}/High"), F.col("qualified"), F.format_string(f"{c}=%d", c)) for rule, c, severity in rules])


def duplicates(bodies: DataFrame) -> DataFrame:
    """CODE-DUPLICATE-CANDIDATE: bodies that share a run of fifty tokens with another body.

    A body is linked with the first body of each of its runs, never with all; the
    longest run that it shares with the first of these is exact, however long both are.
    """
    own = ["analysis_id", "path", "qualified", "start_line", "end_line"]
    place = F.struct("path", "start_line", "qualified")
    windows = bodies.where("tokens is not null").select(*own, F.explode(F.array_distinct(G.windows_of(F.col("tokens"), THRESHOLDS["duplicate_tokens"]))).alias("window"))
    first = windows.groupBy("analysis_id", "window").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = windows.join(first, ["analysis_id", "window"]).groupBy(*own).agg(F.min("first").alias("first"), F.count("*").alias("n_windows"))
    origin = bodies.select("analysis_id", place.alias("first"), F.col("tokens").alias("first_tokens")).dropDuplicates(["analysis_id", "first"])
    both = shared.join(bodies.select(*own, "tokens").dropDuplicates(own), own).join(origin, ["analysis_id", "first"])
    detail = F.concat(F.lit("shares "), "n_windows", F.lit(" runs, first in "), "first.path", F.lit(":"), "first.start_line", F.lit(", longest "), "longest", F.lit(" tokens"))
    return finding(both.withColumn("longest", longest_shared_run(F.col("tokens"), F.col("first_tokens"))), "CODE-DUPLICATE-CANDIDATE", "code_structure", "Info", "Medium", F.col("qualified"), detail, line="start_line")


def responsibilities(code: DataFrame, edges: DataFrame) -> DataFrame:
    """ARCH-MULTIPLE-RESPONSIBILITY: signals of two kinds at least in one module."""
    own = ["analysis_id", "path"]
    kinds = {"size": sizes(code).where("rule_id <> 'ARCH-LARGE-FUNCTION'"), "dependency_breadth": high_degree(code, edges).where("rule_id <> 'ARCH-HIGH-FAN-IN'"), "complexity": structure(code).where("rule_id = 'CODE-HIGH-COMPLEXITY'")}
    roles = code.where("kind = 'class'").groupBy(*own).agg(F.count_distinct(layer_of(F.regexp_replace("name", "(?<=[a-z])(?=[A-Z])", "_"))["layer"]).alias("n")).where("n > 1")
    signals = reduce(DataFrame.unionByName, [*[df.select(*own, F.lit(k).alias("signal")) for k, df in kinds.items()], roles.select(*own, F.lit("structural_roles").alias("signal"))])
    found = signals.groupBy(*own).agg(F.array_sort(F.collect_set("signal")).alias("signals")).where("size(signals) >= 2").withColumn("line", F.lit(1))
    return finding(found, "ARCH-MULTIPLE-RESPONSIBILITY", "architecture", "Low", "Low", F.col("path"), F.array_join("signals", ","), end="line")


# -- dependencies -------------------------------------------------------------


def dependency_rules(deps: DataFrame, code: DataFrame, advisories: DataFrame) -> DataFrame:
    """DEP-KNOWN-VULNERABILITY, -DUPLICATE-VERSION, -HIGH-DEPENDENCY-COUNT and -UNUSED-CANDIDATE."""
    name, eco = "canonical_name", "ecosystem"
    place = F.min(F.struct("path", F.coalesce("line", F.lit(1)).alias("line"))).alias("place")
    at = lambda df: df.select("*", "place.path", "place.line")
    known = deps.join(advisories.select(F.col("ecosystem"), F.col("package_name").alias(name), F.col("affected_version").alias("version"), "advisory_id"), [eco, name, "version"])
    known = at(known.groupBy("analysis_id", eco, name, "version", "advisory_id").agg(place))
    many = at(deps.where("version is not null").groupBy("analysis_id", eco, name).agg(F.array_sort(F.collect_set("version")).alias("versions"), place)).where("size(versions) > 1")
    count = at(deps.groupBy("analysis_id", eco).agg(F.count_distinct(name).alias("n"), place)).where(F.col("n") > THRESHOLDS["dependencies"])
    used = code.where("kind = 'import'").select("analysis_id", F.lower(F.split("name", "[.]", -1)[0]).alias("module")).distinct()
    mapped = F.create_map(*[F.lit(x) for kv in MODULES_OF.items() for x in kv])[F.col(name)]
    guess = F.array_distinct(F.array(F.coalesce(mapped, F.lit("")), F.regexp_replace(F.col(name), "-", "_"), F.regexp_replace(F.col(name), "-", ""), F.regexp_replace(F.regexp_replace(F.col(name), "^python-", ""), "-", "_"), F.regexp_replace(F.regexp_replace(F.col(name), "^py", ""), "-", "_")))
    direct = at(deps.where("ecosystem = 'PyPI' and dependency_class = 'direct'").groupBy("analysis_id", eco, name).agg(place))
    hit = direct.select("analysis_id", name, F.explode(guess).alias("module")).join(used, ["analysis_id", "module"]).select("analysis_id", name).distinct()
    unused = direct.join(used.select("analysis_id").distinct(), "analysis_id").join(hit, ["analysis_id", name], "left_anti")
    subject = F.concat_ws(":", eco, name)
    return reduce(
        DataFrame.unionByName,
        [
            finding(known, "DEP-KNOWN-VULNERABILITY", "dependency", "High", "High", F.concat_ws(":", eco, name, "version", "advisory_id"), F.col("advisory_id"), end="line"),
            finding(many, "DEP-DUPLICATE-VERSION", "dependency", "Low", "High", subject, F.array_join("versions", ","), end="line"),
            finding(count, "DEP-HIGH-DEPENDENCY-COUNT", "dependency", "Low", "High", F.col(eco), F.format_string("count=%d", "n"), end="line"),
            finding(unused, "DEP-UNUSED-CANDIDATE", "dependency", "Info", "Low", subject, F.lit("no import found"), end="line"),
        ],
    )


# -- security -----------------------------------------------------------------

# Callees that a rule looks at, those that need an import to be sure of, and the imports
VERBS = "get post put delete head options patch request"
SINKS = {
    "sql": ("", ".execute .executemany .executescript", "sqlite3 psycopg2 psycopg asyncpg pymysql MySQLdb cx_Oracle oracledb sqlalchemy pyodbc"),
    "command": ("subprocess.run subprocess.call subprocess.Popen subprocess.check_call subprocess.check_output os.system os.popen", ".run .call .Popen .check_call .check_output .system .popen", "subprocess os"),
    "path": ("open os.open os.remove os.unlink os.rename os.replace os.rmdir os.mkdir os.makedirs shutil.copy shutil.copy2 shutil.copytree shutil.move shutil.rmtree tarfile.extractall zipfile.extractall pathlib.Path", ".open .read_text .write_text .read_bytes .write_bytes .unlink .rename .replace .mkdir .rmdir .extractall .remove .copy .copy2 .move", "os pathlib shutil tarfile zipfile io"),
    "ssrf": (" ".join(f"{m}.{v}" for m in ("requests", "httpx") for v in VERBS.split()) + " urllib.request.urlopen urllib.request.Request http.client.HTTPConnection http.client.HTTPSConnection", ".urlopen .get .post .request", "requests httpx urllib.request urllib http.client"),
    "deserialization": ("pickle.loads pickle.load _pickle.loads _pickle.load cPickle.loads cPickle.load marshal.loads marshal.load shelve.open yaml.unsafe_load", ".loads .load .unsafe_load", "pickle _pickle cPickle marshal shelve yaml ruamel.yaml"),
    "execution": ("eval exec compile __import__", "", ""),
    "hash": ("hashlib.md5 hashlib.sha1 hashlib.new", ".md5 .sha1", "hashlib Crypto Cryptodome cryptography"),
    "tls": (" ".join(f"{m}.{v}" for m in ("requests", "httpx") for v in VERBS.split()) + " ssl._create_unverified_context ssl.SSLContext ssl.wrap_socket aiohttp.TCPConnector urllib3.request", ".get .post .request .TCPConnector", "requests httpx urllib3 ssl aiohttp"),
    "cors": ("CORSMiddleware", ".add_middleware add_middleware", "fastapi starlette"),
    "logging": ("print logging.debug logging.info logging.warning logging.warn logging.error logging.exception logging.critical logging.log", ".debug .info .warning .warn .error .exception .critical .log", "logging"),
}
SAFE_LOADS = ("json.loads", "json.load", "yaml.safe_load", "yaml.safe_load_all", "yaml.full_load")
DATABASE_WORDS = "cursor|conn|connection|db|database|session|engine|query"


# Names that show a list of allowed hosts, and what tells that a resolved path is held inside a folder
ALLOW_LISTS = ("allow_list", "allow-list", "allowlist", "allowed_hosts", "ALLOWED", "trusted_hosts")
CONTAINMENTS = ("relative_to", "commonpath", "startswith")
# Functions of the plain random generator
RANDOM = ("random", "choice", "choices", "randint", "randrange", "uniform", "sample", "shuffle")
# Words of a name that should not be drawn by it
SENSITIVE = ("token", "secret", "passwd", "password", "pwd", "nonce", "salt", "otp", "credential", "private", "auth", "api_key", "api-key", "apikey", "session_id", "session_key", "session_token")
# Paths and starts of function names that are public
PUBLIC_PATHS = ("health", "healthy", "healthz", "ready", "live", "liveness", "readiness", "public", "about", "status", "ping", "version", "docs", "openapi.json", "redoc", "static", "favicon.ico", "robots.txt")
PUBLIC_NAMES = ("health", "healthcheck", "healthy", "public", "public_page", "about", "status", "ping", "version", "docs", "openapi", "root", "index", "home", "landing")
# Modules of distributions whose names differ
MODULES_OF = {
    "pyyaml": "yaml", "pillow": "pil", "beautifulsoup4": "bs4", "scikit-learn": "sklearn", "python-dateutil": "dateutil", "python-dotenv": "dotenv", "pymupdf": "fitz", "opencv-python": "cv2", "protobuf": "google", "grpcio": "grpc",
    "psycopg2-binary": "psycopg2", "psycopg2": "psycopg2", "mysqlclient": "mysqldb", "pymysql": "pymysql", "sqlalchemy": "sqlalchemy", "djangorestframework": "rest_framework", "pytest-django": "pytest_django", "typing-extensions": "typing_extensions", "importlib-metadata": "importlib_metadata", "zope-interface": "zope",
}


def elements_of(code: DataFrame) -> DataFrame:
    """Calls and assignments with the imports of their file and what their function shows of checks (contained, listed, credentials): one exchange by file."""
    own = ["analysis_id", "path"]
    file, scope = Window.partitionBy(*own), Window.partitionBy(*own, "scope")
    attrs = [F.col("attrs")[k].alias(k) for k in ("first", "first_kind", "first_origin", "origin", "dynamic", "kwargs", "value", "target")]
    rows = code.where(F.col("kind").isin("import", "test", "call", "assignment")).select(*own, "kind", "name", "scope", "line", "end_line", "items", *attrs)
    seen = F.when(F.col("kind") != "import", F.concat_ws(" ", "name", F.coalesce("value", F.lit("")), F.coalesce("target", F.lit("")), F.array_join("items", " ")))
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(seen, w))
    signs = {
        "resolved": (F.col("kind") == "call") & F.col("name").rlike(r"(^|[.])resolve$"),
        "inside": has(CONTAINMENTS) | ((F.col("kind") == "test") & seen.rlike(r"\bin\b.*base|base.*\bin\b")),
        "listed": has(ALLOW_LISTS),
        "credentials": has(["Access-Control-Allow-Credentials"]),
    }
    rows = rows.select("*", *[c.alias(k) for k, c in signs.items()], F.when(F.col("kind") == "import", F.col("name")).alias("imported"))
    shown = lambda k: F.coalesce(F.bool_or(k).over(scope), F.lit(False))
    rows = rows.withColumns({"imports": F.collect_set("imported").over(file), "contained": shown("resolved") & shown("inside"), "listed_": shown("listed"), "credentials_": shown("credentials")})
    kept = rows.where("kind = 'call' and name <> '' or kind = 'assignment'").drop("listed", "credentials", "resolved", "inside", "imported").withColumnsRenamed({"listed_": "listed", "credentials_": "credentials"})
    return kept.withColumns({"dynamic": F.col("dynamic") == "true", "kwargs": F.from_json("kwargs", "map<string,string>")})


def header_verdict(value: Column, origin: Column) -> Column:
    """Of a value that answers for the allowed origin."""
    return (
        F.when(value.rlike(r"^['\"][*]['\"]$"), F.when(F.col("credentials"), "Medium/High").otherwise("Low/Medium"))
        .when((origin == "external") | value.rlike(r"(?i)\brequest\b"), F.when(F.col("credentials"), "High/High").otherwise("Medium/Medium"))
        .when(origin != "constant", "Info/Low")
    )


def sink(name: str) -> Column:
    """Whether a call (``name``, and ``imports`` of its file) is one that a rule looks at."""
    sure, guarded, hints = (x.split() for x in SINKS[name])
    callee = F.col("name")
    out = reduce(lambda a, b: a | b, [(callee == s) | (callee.endswith(f".{s}") if "." in s else F.lit(False)) for s in sure], F.lit(False))
    if guarded:
        known = F.exists("imports", lambda t: reduce(lambda a, b: a | b, [(t == h) | t.startswith(f"{h}.") for h in hints]))
        out = out | known & reduce(lambda a, b: a | b, [callee.endswith(g) | (callee == g.lstrip(".")) for g in guarded])
    return out


def by_origin(external: str | Column, unresolved: str, configurable: str, constant: Column | None = None) -> Column:
    """A verdict by where the first argument comes from."""
    origin = F.col("first_origin")
    return F.when(origin == "external", external).when(origin == "unresolved", unresolved).when(origin == "configurable", configurable).otherwise(constant)


def security_rules(code: DataFrame) -> DataFrame:
    """The rules on calls and assignments; constants are silent unless a rule says otherwise."""
    elements = elements_of(code)
    kw = lambda k: F.col("kwargs")[k]
    last = F.element_at(F.split("name", "[.]", -1), -1)
    receiver = F.lower(F.regexp_replace("name", "[.]?[^.]*$", ""))
    shell = (kw("shell") == "True") | F.col("name").rlike(r"(^|\.)(system|popen)$")
    listed = F.col("first_kind").isin("List", "Tuple")
    sql = last.isin("execute", "executemany", "executescript") & (sink("sql") | receiver.rlike(DATABASE_WORDS))
    loader = F.coalesce(kw("Loader"), F.get("items", F.lit(1)), F.lit(""))
    loads = sink("deserialization") & ~F.col("name").isin(*SAFE_LOADS) & ~loader.rlike("SafeLoader|BaseLoader")
    harsh = F.when(F.col("name").rlike("pickle|marshal|unsafe_load"), "Critical/High").otherwise("High/High")
    run = F.col("name").isin("eval", "exec")
    weak = F.col("name").rlike(r"(^|\.)(md5|sha1)$") | (F.col("name").endswith("hashlib.new") & F.lower("first").rlike("['\"](md5|sha1|sha)['\"]"))
    context = F.lower(F.concat_ws(" ", "scope", "first"))
    purpose = F.when(context.rlike("passw|token|secret|sign|auth|session|credential"), "High/High").when(context.rlike("checksum|etag|cache|dedup|fingerprint") | (kw("usedforsecurity") == "False"), "Low/Low").otherwise("Medium/Medium")
    tls = F.when(F.col("name").endswith("_create_unverified_context"), "Medium/High").when(kw("ssl") == "False", "Medium/High").when(F.col("first").rlike(r"PROTOCOL_(SSLv|TLSv1$|TLSv1_1)"), "Medium/Medium").when(kw("verify") == "False", F.when(F.col("first_origin") != "constant", "High/High").otherwise("Medium/High")).when(kw("verify").isNotNull() & ~kw("verify").isin("True") & kw("verify").rlike("^[A-Za-z_.]+$"), "Medium/Medium")
    origins = kw("allow_origins")
    wild = origins.rlike(r"['\"]\*['\"]")
    cors = F.when(wild & (kw("allow_credentials") == "True"), "Medium/High").when(wild, "Low/Medium").when(origins.isNotNull() & ~origins.startswith("["), "Info/Low")
    said = F.array_join("items", " ")
    secretive = said.rlike(r"(?i)\b\w*(password|passwd|secret|token|api_?key|credential)\w*\b(?!\s*\()")
    hidden = said.rlike(r"(?i)(mask|redact|hash|len|bool)\w*\(")
    logs = F.when(hidden, None).when(F.col("name") == "print", F.when(secretive & (F.col("origin") != "constant"), "Low/Low")).when(secretive & F.col("origin").isin("external", "configurable"), "High/High").when(secretive & (F.col("origin") != "constant"), "Medium/Medium").when(said.rlike(r"\brequest\.(body|headers|form|json)\b"), "Medium/Medium")
    header = "Access-Control-Allow-Origin"
    header_at = F.size(F.filter("items", lambda i: F.contains(i, F.lit(header))))
    rules = [
        ("SEC-SQL-INJECTION", F.when(sql & F.col("dynamic"), by_origin("High/High", "High/Medium", "Medium/Low"))),
        ("SEC-COMMAND-INJECTION", F.when(sink("command") & ~(listed & ~shell), by_origin(F.when(shell, "Critical/High").otherwise("High/High"), "High/Medium", "Medium/Low", F.when(shell, "Info/Low")))),
        ("SEC-PATH-TRAVERSAL", F.when(sink("path") & (last != "Path") & ~F.col("contained"), by_origin("High/High", "Medium/Medium", "Low/Low"))),
        ("SEC-SSRF", F.when(sink("ssrf") & ~F.col("listed"), F.when(F.col("first").rlike(r"^f?['\"]https?://[^/{]+/") & (F.col("first_origin") != "constant"), "Medium/Medium").otherwise(by_origin("High/High", "Medium/Medium", "Info/Low")))),
        ("SEC-UNSAFE-DESERIALIZATION", F.when(loads, by_origin(harsh, "High/Medium", "Medium/Low"))),
        ("SEC-DANGEROUS-DYNAMIC-EXECUTION", F.when(sink("execution"), by_origin(F.when(run, "Critical/High").otherwise("High/High"), "High/Medium", "Medium/Low", F.when(run, "Info/Low")))),
        ("SEC-WEAK-CRYPTO", F.when(sink("hash") & weak, purpose).when(F.col("name").endswith("hashlib.new") & (F.col("first_kind") != "Constant"), "Info/Low").when(F.col("first").contains("MODE_ECB") | F.array_join("items", " ").contains("MODE_ECB") | F.col("name").rlike(r"\.(DES|DES3|ARC4|ARC2)\.new$"), "High/High")),
        ("SEC-DISABLED-TLS", F.when(sink("tls"), tls)),
        ("SEC-INSECURE-CORS", F.when(sink("cors"), cors).when(header_at > 0, header_verdict(F.element_at("items", -1), F.col("origin")))),
        ("SEC-SENSITIVE-LOGGING", F.when(sink("logging"), logs)),
    ]
    subject = F.concat_ws(":", "scope", "name")
    call, assigned = F.col("kind") == "call", F.col("kind") == "assignment"
    parts = [(rule, F.when(call, verdict), subject, F.concat_ws(" ", "name", "first_origin")) for rule, verdict in rules]
    value, origin = F.col("value"), F.col("origin")
    drawn = value.rlike(r"\brandom\s*\.\s*(" + "|".join(RANDOM) + r")\s*\(") & F.lower("name").rlike("|".join(SENSITIVE) + r"|\bkey\b")
    off = (F.col("name").endswith(".verify") & (value == "False")) | (F.col("name").endswith(".check_hostname") & (value == "False")) | (F.col("name").endswith(".verify_mode") & value.endswith("CERT_NONE"))
    parts.append(("SEC-WEAK-CRYPTO", F.when(assigned & drawn, "Medium/High"), subject, F.lit("random")))
    parts.append(("SEC-INSECURE-CORS", F.when(assigned & F.contains(F.col("target"), F.lit(header)), header_verdict(value, origin)), F.concat_ws(":", "scope", F.lit(header)), origin))
    parts.append(("SEC-DISABLED-TLS", F.when(assigned & off, "Medium/High"), subject, value))
    return findings(elements, "security", parts)


def authorization(code: DataFrame) -> DataFrame:
    """SEC-POTENTIAL-AUTHORIZATION: a route handler that touches data and shows no sign of a check."""
    own = ["analysis_id", "path"]
    routes = code.where("kind = 'function'").withColumn("decorators", F.from_json(F.col("attrs")["decorators"], "array<string>")).where(F.exists("decorators", lambda d: d.rlike(r"(?i)(^|\.)(route|get|post|put|patch|delete)$")))
    routes = routes.withColumn("qualified", F.concat_ws(".", F.when(F.col("scope") != "", F.col("scope")), "name"))
    signs = F.concat_ws(" ", F.array_join("decorators", " "), F.array_join("items", " "), "called")
    called = code.where("kind = 'call'").groupBy(*own, F.col("scope").alias("qualified")).agg(F.array_join(F.collect_set("name"), " ").alias("called"))
    routes = routes.join(called, [*own, "qualified"], "left").withColumn("checked", signs.rlike(r"(?i)auth|login_required|permission|current_user|require_|jwt|is_admin"))
    routes = routes.withColumn("sibling", F.max(F.col("checked").cast("int")).over(Window.partitionBy(*own)) == 1)
    paths = F.from_json(F.col("attrs")["routes"], "array<string>")
    public = F.col("name").rlike("(?i)^(" + "|".join(PUBLIC_NAMES) + ")") | F.coalesce(F.exists(paths, lambda p: p.rlike("(?i)^/(" + "|".join(w.replace(".", "[.]") for w in PUBLIC_PATHS) + ")?/?$")), F.lit(False))
    write, read = F.col("called").rlike(r"(?i)\.(add|save|delete|update|commit|insert|create|remove|put)\b"), F.col("called").rlike(r"(?i)\.(get|filter|filter_by|query|find|find_one|select|first|all)\b")
    open_ = routes.where(~F.col("checked") & ~public & (write | read)).withColumn("write", write)
    return finding(open_, "SEC-POTENTIAL-AUTHORIZATION", "security", F.when(F.col("sibling") | F.col("write"), "Medium").otherwise("Low"), F.when(F.col("sibling"), "Medium").otherwise("Low"), F.col("qualified"), F.lit("no check found"))


def hardcoded_secrets(files: DataFrame) -> DataFrame:
    """SEC-HARDCODED-SECRET: lines of any eligible text file; values never leave the line."""
    lines = source_lines(files).withColumn("kind", T.secret_kind(F.col("text"))).where("kind is not null").withColumn("end_line", F.col("line"))
    confidence = F.when(F.col("path").rlike("(?i)(^|/)tests?/|test_"), F.when(F.col("kind") == "assignment", "Low").otherwise("Medium")).when(F.col("kind") == "assignment", "Medium").otherwise("High")
    return finding(lines, "SEC-HARDCODED-SECRET", "security", T.secret_severity(F.col("kind")), confidence, F.col("kind"), T.masked(F.col("text")))
