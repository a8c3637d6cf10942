"""Python sources as rows, by an Arrow kernel that parses and never runs them.

One row per syntax element: ``kind`` is module, import, class, function, call,
assignment, flow or diagnostic; ``attrs`` holds what only that kind has.  The
values that reach calls are placed on the spot, where the scope is at hand:
``origin`` is external, unresolved, configurable or constant (the worst of an
expression's parts), names being followed through the scope's assignments that
come before the line, eight steps at most.
"""

from __future__ import annotations

import ast
import json
import re
import signal
import threading
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "analysis_id string, path string, kind string, name string, scope string, line int, column int, end_line int, items array<string>, attrs map<string,string>"
ORIGINS = ("constant", "configurable", "unresolved", "external")
# Where values from outside and settings come from
EXTERNAL = re.compile(r"^(sys\.argv|sys\.stdin|sys\.environ|argv|input\(\))|^request\.(args|form|values|data|json|query_params|params|GET|POST|body|headers|cookies|path_params)\b|\.recv\(\)$")
CONFIGURABLE = re.compile(r"^(os\.environ|os\.getenv|getenv|environ|config\.|settings\.|CONFIG\b)")
PURE = {"str", "int", "float", "bool", "len", "repr", "format", "join", "upper", "lower", "strip", "encode", "decode", "range", "list", "dict", "tuple", "set", "replace"}
MOST_STEPS = 8
LINE_ENDS = re.compile(rb"\r\n|\n|\r")
# Fixed value: rows of elements that go into one batch
MOST_ROWS = 4096
# Fixed value: seconds that a file may take
SECONDS = 30


def dotted(node: ast.AST) -> str:
    """``a.b.c`` of names, attributes, calls and subscripts, else empty."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    if isinstance(node, ast.Call):
        return dotted(node.func) + "()"
    return dotted(node.value) if isinstance(node, ast.Subscript) else ""


class Reader(ast.NodeVisitor):
    def __init__(self, path: str, text: str):
        self.path, self.rows = path, []
        self.source = text.encode()
        self.starts = [0, *[m.end() for m in LINE_ENDS.finditer(self.source)]]
        self.names: list[tuple[str, str]] = []  # (kind, name) of the scopes around
        self.known: list[dict[str, list[tuple[int, ast.AST]]]] = [{}]
        self.excepts = 0

    @property
    def scope(self) -> str:
        return ".".join(n for _, n in self.names)

    def add(self, kind: str, name: str, node: ast.AST, items: list[str] | None = None, **attrs) -> None:
        self.rows.append((kind, name, self.scope, node.lineno, node.col_offset, node.end_lineno or node.lineno, items or [], {k: v if isinstance(v, str) else json.dumps(v) for k, v in attrs.items() if v is not None}))

    def _import(self, node: ast.Import | ast.ImportFrom, target: str, level: int, names: list[str]) -> None:
        self.add("import", target, node, names, level=level, conditional=self.excepts > 0, deferred=any(k == "function" for k, _ in self.names))

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self._import(node, a.name, 0, [])

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self._import(node, node.module or "", node.level, [a.name for a in node.names])

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.add("class", node.name, node, [dotted(b) for b in node.bases])
        self._inside("class", node.name, node.body)

    def _inside(self, kind: str, name: str, body: list[ast.AST]) -> None:
        self.names.append((kind, name))
        self.known.append({})
        for x in body:
            self.visit(x)
        self.known.pop()
        self.names.pop()

    def _function(self, node, name: str, body: list[ast.AST], decorators: list[ast.AST]) -> None:
        a = node.args
        names = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
        owner = self.names[-1][1] if self.names and self.names[-1][0] == "class" else None
        counted = names[1:] if owner and names and names[0] in ("self", "cls") else names
        self.add("function", name, node, names, owner=owner, parameters=len(counted), decorators=[dotted(d.func if isinstance(d, ast.Call) else d) for d in decorators], routes=[str(d.args[0].value) for d in decorators if isinstance(d, ast.Call) and d.args and isinstance(d.args[0], ast.Constant)])
        self._inside("function", name, body)

    def visit_FunctionDef(self, node) -> None:
        self._function(node, node.name, node.body, node.decorator_list)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Lambda(self, node: ast.Lambda) -> None:
        self._function(node, f"<lambda:{node.lineno}:{node.col_offset}>", [node.body], [])

    def _flow(self, kind: str, node: ast.AST) -> None:
        self.add("flow", kind, node)
        self.generic_visit(node)

    def visit_If(self, node: ast.If) -> None:
        self._flow("if", node)

    def visit_For(self, node) -> None:
        self._flow("for", node)

    visit_AsyncFor = visit_For

    def visit_While(self, node: ast.While) -> None:
        self._flow("while", node)

    def visit_With(self, node) -> None:
        self._flow("with", node)

    visit_AsyncWith = visit_With

    def visit_Try(self, node: ast.Try) -> None:
        self._flow("try", node)

    visit_TryStar = visit_Try

    def visit_ExceptHandler(self, node: ast.ExceptHandler) -> None:
        self.excepts += 1
        self._flow("except", node)
        self.excepts -= 1

    def visit_comprehension(self, node: ast.comprehension) -> None:
        for test in node.ifs:
            self.add("flow", "if", test)
        self.generic_visit(node)

    def _assign(self, node: ast.AST, targets: list[ast.AST], value: ast.AST | None) -> None:
        for t in targets:
            if value is not None:
                if isinstance(t, ast.Name):
                    self.known[-1].setdefault(t.id, []).append((node.lineno, value))
                self.add("assignment", dotted(t), node, value=self.shown(value), origin=self.origin(value, node.lineno), target=self.shown(t))
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        self._assign(node, node.targets, node.value)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._assign(node, [node.target], node.value)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        self._assign(node, [node.target], node.value)

    def visit_Compare(self, node: ast.Compare) -> None:
        self.add("test", "", node, value=self.shown(node))
        self.generic_visit(node)

    def shown(self, node: ast.AST) -> str:
        """The source of a node; lines are cut once for a file, not once for each of its nodes."""
        if getattr(node, "end_lineno", None) is None or node.end_col_offset is None:
            return ""
        return self.source[self.starts[node.lineno - 1] + node.col_offset : self.starts[node.end_lineno - 1] + node.end_col_offset].decode()

    def origin(self, node: ast.AST, line: int, steps: int = 0) -> str:
        if isinstance(node, ast.Constant):
            return "constant"
        name = dotted(node)
        if name and EXTERNAL.search(name):
            return "external"
        if name and CONFIGURABLE.search(name):
            return "configurable"
        if isinstance(node, ast.Name):
            before = [v for n, v in self.known[-1].get(node.id, self.known[0].get(node.id, [])) if n < line]
            return self.origin(before[-1], line, steps + 1) if before and steps < MOST_STEPS else "unresolved"
        if isinstance(node, ast.Call) and name.removesuffix("()").rpartition(".")[2] not in PURE:
            inner = [self.origin(x, line, steps + 1) for x in node.args] if steps < MOST_STEPS else []
            return "external" if "external" in inner else "unresolved"
        parts = [x for x in ast.iter_child_nodes(node) if isinstance(x, (ast.expr, ast.keyword, ast.FormattedValue))]
        if isinstance(node, ast.Attribute | ast.Call):
            parts = [x for x in parts if not (isinstance(node, ast.Call) and x is node.func and isinstance(x, ast.Name))]
        found = [self.origin(x.value if isinstance(x, ast.keyword | ast.FormattedValue) else x, line, steps) for x in parts]
        return max(found, key=ORIGINS.index, default="constant")

    def visit_Call(self, node: ast.Call) -> None:
        first = node.args[0] if node.args else node.keywords[0].value if node.keywords else None
        every = [*node.args, *[k.value for k in node.keywords]]
        kwargs = {k.arg or "**": self.shown(k.value) for k in node.keywords}
        self.add(
            "call", dotted(node.func), node, [self.shown(x) for x in node.args], kwargs=kwargs,
            first=self.shown(first) if first is not None else "", first_kind=type(first).__name__ if first is not None else None,
            first_origin=self.origin(first, node.lineno) if first is not None else "constant",
            origin=max((self.origin(x, node.lineno) for x in every), key=ORIGINS.index, default="constant"),
            dynamic=first is not None and any(isinstance(x, (ast.Name, ast.Attribute, ast.JoinedStr, ast.Subscript, ast.Call)) for x in ast.walk(first)),
        )
        self.generic_visit(node)


@contextmanager
def at_most(seconds: float):
    """TimeoutError in the block once the seconds are over (where the worker's thread can take a signal)."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def over(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, over)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def elements(path: str, text: str, seconds: float = SECONDS) -> list[tuple]:
    """Rows of one file; a file that can't be parsed, or not in time, has one diagnostic."""
    try:
        with at_most(seconds):
            return rows_of(path, text)
    except TimeoutError:
        return [("diagnostic", "Timeout", "", 1, 0, 1, [], {"message": f"not parsed within {seconds:g} seconds"})]


def rows_of(path: str, text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [("diagnostic", type(e).__name__, "", getattr(e, "lineno", None) or 1, max(0, (getattr(e, "offset", None) or 1) - 1), getattr(e, "lineno", None) or 1, [], {"message": str(getattr(e, "msg", e))})]
    reader = Reader(path, text)
    try:
        reader.visit(tree)
    except RecursionError as e:
        return [("diagnostic", type(e).__name__, "", 1, 0, 1, [], {"message": "nested too deeply"})]
    n = len(text.splitlines())
    return [("module", path, "", 1, 0, n, [], {"lines": str(n)}), *reader.rows]


def parsed(files: DataFrame) -> DataFrame:
    """SCHEMA rows of all eligible Python files; one narrow pass."""
    kinds = pa.schema([("analysis_id", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("scope", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("end_line", pa.int32()), ("items", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string()))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([list(r[k].items()) if isinstance(r[k], dict) else r[k] for r in rows], f.type) for k, f in enumerate(kinds)], schema=kinds)

        rows = []
        for batch in batches:
            for a, path, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows += [(a, path, *r) for r in elements(path, text)]
                if len(rows) >= MOST_ROWS:
                    yield packed(rows)
                    rows = []
        if rows:
            yield packed(rows)

    return files.where((F.col("language") == "Python") & F.col("eligible")).select("analysis_id", "path", F.col("content").cast("string").alias("text")).mapInArrow(kernel, SCHEMA)


def bodies(files: DataFrame) -> DataFrame:
    """Functions with their normalised tokens: names bound in the function become numbered placeholders, layout and comments go; one narrow pass."""
    kinds = pa.schema([("analysis_id", pa.string()), ("path", pa.string()), ("qualified", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("tokens", pa.list_(pa.string()))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)], schema=kinds)

        rows = []
        for batch in batches:
            for a, path, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows += [(a, path, *r) for r in bodies_of(path, text)]
                if len(rows) >= MOST_ROWS:
                    yield packed(rows)
                    rows = []
        if rows:
            yield packed(rows)

    schema = "analysis_id string, path string, qualified string, start_line int, end_line int, tokens array<string>"
    return files.where((F.col("language") == "Python") & F.col("eligible")).select("analysis_id", "path", F.col("content").cast("string").alias("text")).mapInArrow(kernel, schema)


def bodies_of(path: str, text: str) -> list[tuple]:
    """qualified name, lines and tokens of the functions of one file."""
    rows = elements(path, text)
    bound: dict[str, set[str]] = {}
    for kind, name, scope, *_ in rows:
        if kind == "assignment" and "." not in name:
            bound.setdefault(scope, set()).add(name)
    lines, out = re.split("\r\n|\n|\r", text), []
    for kind, name, scope, line, _, end, items, _ in rows:
        if kind == "function" and not name.startswith("<lambda"):
            qualified = f"{scope}.{name}" if scope else name
            out.append((qualified, line, end, normalised("\n".join(lines[line - 1 : end]), {*items, *bound.get(qualified, ())})))
    return out


def normalised(text: str, names: set[str]) -> list[str] | None:
    import io
    import textwrap
    import tokenize

    layout = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING, tokenize.ENDMARKER}
    out, places, before = [], {}, ""
    try:
        for t in tokenize.generate_tokens(io.StringIO(textwrap.dedent(text)).readline):
            if t.type not in layout:
                bound = t.type == tokenize.NAME and t.string in names and before != "."
                out.append(f"VAR{places.setdefault(t.string, len(places))}" if bound else t.string)
                before = t.string
    except (tokenize.TokenError, SyntaxError, ValueError):
        return None
    return out
