import pytest

from lodestone.plans import code_queries
from lodestone.sources import manifests, python_code
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(code_queries.QUERIES))
def test_runs(spark, name):
    assert code_queries.QUERIES[name](spark, DATA).count() > 0


def test_what_rules_find_in_made_sources(spark):
    n = spark.read.parquet(f"{DATA}/supplier.parquet").count()
    found = {r["rule_id"]: r["n"] for r in code_queries.QUERIES["security_rules"](spark, DATA).groupBy("rule_id").agg(F.count("*").alias("n")).collect()}
    assert found["SEC-SQL-INJECTION"] == n
    found = {r["rule_id"]: r["n"] for r in code_queries.QUERIES["structure_rules"](spark, DATA).groupBy("rule_id").agg(F.count("*").alias("n")).collect()}
    assert found["CODE-DEEP-NESTING"] == found["CODE-HIGH-PARAMETER-COUNT"] == n


def test_elements():
    rows = python_code.elements("m.py", "try:\n    import a.b\nexcept ImportError:\n    from .c import d as e\n\nx = [i for i in y if i if j]\nf = lambda q: g(q)\n")
    by = [(r[0], r[1]) for r in rows]
    assert ("import", "a.b") in by and by.count(("flow", "if")) == 2 and ("call", "g") in by
    last = next(r for r in rows if r[1] == "c")
    assert last[7]["conditional"] == "true" and last[7]["level"] == "1" and last[6] == ["d"]
    assert python_code.elements("m.py", "def f(:\n")[0][0] == "diagnostic"


def test_origins():
    def first(text):
        return next(r[7]["first_origin"] for r in python_code.elements("m.py", text) if r[0] == "call" and r[1] == "sink")

    assert first("def f():\n  a = 'x'\n  b = a + 'y'\n  sink(b)") == "constant"
    assert first("def f():\n  a = input()\n  b = f'{a}!'\n  sink(b)") == "external"
    assert first("def f():\n  sink(os.environ['A'] + 'x')") == "configurable"
    assert first("def f(p):\n  sink(str(p))") == "unresolved"
    assert first("def f():\n  a = a0\n  a = request.form['x']\n  sink(a)\n  a = 'c'") == "external"


@pytest.mark.parametrize(
    "kind, text, want",
    [
        ("requirements", "# c\nFlask[async]==1.0 ; python_version > '3'\n-r other.txt\nbare\n", [("Flask", "1.0", "runtime", 2), ("bare", None, "runtime", 4)]),
        ("pyproject", '[project]\ndependencies = ["a>=1", "b==2.0"]\n[project.optional-dependencies]\nx = ["c"]\n[tool.poetry.dependencies]\npython = "3"\nd = "^1"\n', [("a", None, "runtime", 2), ("b", "2.0", "runtime", 2), ("c", None, "optional", 4), ("d", None, "runtime", 7)]),
        ("pipfile-lock", '{"default": {"a": {"version": "==1.1"}},\n "develop": {"b": {}}}', [("a", "1.1", "runtime", 1), ("b", None, "development", 2)]),
        ("package", '{"dependencies": {"@s/a": "^1.0"},\n "devDependencies": {"b": "1.2.3"}}', [("@s/a", None, "runtime", 1), ("b", "1.2.3", "development", 2)]),
    ],
)
def test_manifests(kind, text, want):
    assert [(r[2], r[4], r[6], r[7]) for r in manifests.rows_of(kind, text)] == want


def test_lock_edges_prefer_the_nested_instance():
    text = '{"packages": {"": {}, "node_modules/a": {"version": "1", "dependencies": {"b": "*"}}, "node_modules/b": {"version": "2"}, "node_modules/a/node_modules/b": {"version": "3"}}}'
    assert [(r[2], r[8], r[9]) for r in manifests.rows_of("package-lock", text) if r[0] == "edge"] == [("a", "b", "3")]
    old = '{"dependencies": {"a": {"version": "1", "requires": {"b": "*"}, "dependencies": {"b": {"version": "3"}}}, "b": {"version": "2"}, "c": {"version": "1", "requires": {"b": "*"}}}}'
    assert {(r[2], r[9]) for r in manifests.rows_of("package-lock", old) if r[0] == "edge"} == {("a", "3"), ("c", "2")}
    assert manifests.rows_of("package", "{")[0][0] == "failed"
