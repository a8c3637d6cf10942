"""Functions on source text, the time limit of a file, and numbering by counts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions import source_text as S
from lodestone.operators import generic as G
from lodestone.plans import views
from lodestone.sources import python_code


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text, emptied, blank",
    [
        ("a = 'x' # 'y'", "a = '' # ''", "a = " + " " * 9),
        ('b"q" + bar"z"', 'b"" + bar""', " " * 4 + " + bar" + " " * 3),
        ("'it\\'s' + \"say \\\"#\\\"\"", "'' + \"\"", " " * 7 + " + " + " " * 11),
        ('"""one\n"two" # three""" + x', '"""""" + x', " " * 23 + " + x"),
        ("'open", "'open", "'open"),
        ("", "", ""),
    ],
)
def test_strings(spark, text, emptied, blank):
    assert len(blank) == len(text)
    assert one(spark, text, S.strings_emptied) == emptied
    assert one(spark, text, S.blanked) == blank


def test_null_source_is_null(spark):
    for f in (S.strings_emptied, S.blanked, S.without_comment):
        assert one(spark, None, f) is None


@pytest.mark.parametrize(
    "call, parts",
    [("f(a, b)", ["a", "b"]), ("f(g(1, 2), [3, {4: 5, 6: 7}], ',)')", ["g(1, 2)", "[3, {4: 5, 6: 7}]", "',)'"]), ("f", []), ("f(a", []), ("f(\n a,\n b = (1,)\n)", ["a", "b = (1,)"])],
)
def test_arguments(spark, call, parts):
    assert one(spark, call, S.arguments) == parts


def test_longest_shared_run():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(2))
        best = max((n for n in range(15) for i in range(len(a) - n + 1) for j in range(len(b) - n + 1) if a[i : i + n] == b[j : j + n]), default=0)
        assert S.shared_run(a, b) == best


def test_a_file_has_a_time_limit(monkeypatch):
    monkeypatch.setattr(python_code, "rows_of", lambda path, text: time.sleep(5))
    rows = python_code.elements("a.py", "x = 1", seconds=0.1)
    assert [r[:2] for r in rows] == [("diagnostic", "Timeout")]
    monkeypatch.undo()
    assert python_code.elements("a.py", "x = 1")[0][0] == "module"


def test_numbers_by_counts_equal_a_window(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, None]), rng.choice(["a", "b", None]), rng.choice([1, 2, 3, None]), k) for k in range(200)]
    df = spark.createDataFrame(rows, "s int, p string, q int, k int")
    key = lambda r: tuple((v is not None, v) for v in r[1:])
    want = {}
    for scope in (1, 2, None):
        want |= {r[3]: f"N{n}" for n, r in enumerate(sorted((r for r in rows if r[0] == scope), key=key), 1)}
    for lead in (1, 2):
        assert {r["k"]: r["n"] for r in G.numbered(df, ["s"], ["p", "q", "k"], "n", "N%d", lead).collect()} == want
    assert G.numbered(df.where("false"), ["s"], ["p", "k"]).count() == 0


def test_coverage_of_an_unknown_file_is_an_error(spark):
    files = spark.createDataFrame([(1, "a")], "file int, path string")
    assert [r["path"] for r in views.coverage_of_files(files, spark.createDataFrame([(1,)], "file int"), "file").collect()] == ["a"]
    with pytest.raises(Exception, match="unknown file"):
        views.coverage_of_files(files, spark.createDataFrame([(1,), (2,)], "file int"), "file").collect()


@pytest.mark.parametrize("width", [None, 1, 7, 1000])
def test_latest_before_by_buckets(spark, width):
    rng = random.Random(7)
    seen = [(rng.choice([1, 2]), t, f"v{t}" if rng.random() < 0.8 else None) for t in rng.sample(range(60), 30)]
    asked = [(rng.choice([1, 2, 3]), rng.randrange(60), n) for n in range(50)]
    left, right = spark.createDataFrame(asked, "k int, t int, n int"), spark.createDataFrame(seen, "k int, t int, v string")
    found = G.latest_before(left, right, "k", "t", "v", None if width is None else F.floor(F.col("t") / width))
    assert found.columns == ["k", "t", "n", "last_v"]
    want = {n: max(((s, v) for q, s, v in seen if q == k and s < t and v is not None), default=(0, None))[1] for k, t, n in asked}
    assert {r["n"]: r["last_v"] for r in found.collect()} == want
