import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_line_dedup import brute as removed_lines
from test_minhash_forest import brute as near_duplicates
from test_single_pass import check_packing

from lodestone.llm import line_dedup

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Each stage's input and output, written and read again."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path_factory.mktemp('stages')}/{k}"
        stage(spark, docs, DATA).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns_stay(steps):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_duplicates", "decontamination", "packing"]
    for name in names[:-1]:
        before, after = steps[name]
        assert after.columns == before.columns and after.dtypes == before.dtypes
        assert set(texts(after)) <= set(texts(before))


def test_quality_keeps_the_good(spark, steps):
    before, after = steps["quality"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet").join(before, "doc_id").select("doc_id", "quality").collect()
    kept = set(texts(after))
    good = [r["doc_id"] for r in labels if r["quality"] == 1]
    assert sum(d in kept for d in good) >= 0.95 * len(good)
    assert sum((r["doc_id"] in kept) == (r["quality"] == 1) for r in labels) >= 0.9 * len(labels)


def test_lines(steps):
    before, after = (texts(d) for d in steps["lines"])
    gone = {(d, n) for d, n, *_, removed in removed_lines(list(before.items()), 2, 16) if removed}
    assert gone
    for doc, text in before.items():
        left = [x for n, x in enumerate((text or "").split("\n")) if (doc, n) not in gone]
        if any(d == doc for d, _ in gone) and not "".join(left).strip():
            assert doc not in after
        else:
            assert after[doc] == (text if text is None else "\n".join(left))
    counts = steps["lines"][1].where(F.col("n_chars") != F.char_length("text")).count()
    assert counts == 0


def test_lines_of_a_crowd_are_not_paired_out(spark, monkeypatch):
    """Lines that differ in two words alone: the stage compares few of them, and removes what is linked."""
    rng, met, candidates = random.Random(8), [], line_dedup.candidates
    word = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQ") for _ in range(4))
    docs = [(k, f"depots {word()} opens again on the third {word()} by day") for k in range(90)]
    docs += [(100 + k, docs[k][1][:8] + "XYZ"[k % 3] + docs[k][1][9:]) for k in range(6)]

    def counted(*args):
        met.append(candidates(*args))
        return met[-1]

    monkeypatch.setattr(line_dedup, "candidates", counted)
    out = corpus_pipeline.lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), DATA)
    assert set(texts(out)) == {d for d, _, *_, removed in removed_lines(docs, 2, 16) if not removed} == set(range(90))
    assert [m.count() < 10 * len(docs) for m in met] == [True]


def test_near_duplicates(steps):
    before, after = (texts(d) for d in steps["near_duplicates"])
    assert set(after) == {d for d, *_, kept in near_duplicates(list(before.items()), 5, 80) if kept}


def test_decontamination(spark, steps):
    before, after = (texts(d) for d in steps["decontamination"])
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    flat = lambda s: re.sub(r"\W+", " ", (s or "").lower())
    held = {d for d, t in before.items() if any(flat(i).strip() in flat(t) for i in items if len(i.split()) > 12)}
    assert not held & set(after) and len(after) >= 0.9 * len(before)


def test_packing(steps):
    before, after = steps["packing"]
    check_packing(after.collect(), texts(before), 2048)


def test_odd_documents(spark):
    rows = [(1, None, None, None, None, 1), (2, "", "", "", 0, 2), (None, "some text without an id", "en", "s", 23, 3), (3, "x" * 200_000, "en", "s", 200_000, 4), (3, "x" * 200_000, "en", "s", 200_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rep int")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns[-1] == "rep" and docs.count() == 5
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() >= 5
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), DATA).count() == 0
