import random
import re

import pytest

from lodestone.llm import minhash_forest


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(docs, n, percent):
    docs = [(d, shingles(t, n)) for d, t in docs if d is not None]
    root = {d: d for d, _ in docs}  # rows of one doc_id are one document

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(docs):
        for b, t in docs[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in docs)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    stems = [text(rng.randint(2, 90)) for _ in range(12)]
    docs = []
    for d in range(150):
        t = list(rng.choice(stems))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
            t[rng.randrange(len(t))] = rng.choice(words)
        docs.append((d, rng.choice([" ", "\n", "\t "]).join(t).upper() if rng.random() < 0.3 else " ".join(t)))
    return docs + [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (None, "one"), (505, "é É"), (506, "É É"), (3, docs[3][1])]


@pytest.mark.parametrize("n, percent", [(2, 80), (5, 80)])
def test_against_brute_force(spark, n, percent):
    docs = corpus(n)
    out = minhash_forest.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), n, percent)
    assert sorted(tuple(r) for r in out.collect()) == brute(docs, n, percent)


@pytest.mark.parametrize("block, enough", [(300, 256), (300, 6), (10**6, 6)])
def test_large_regions_by_blocks_and_depth(spark, monkeypatch, block, enough):
    monkeypatch.setattr(minhash_forest, "BLOCK", block)
    monkeypatch.setattr(minhash_forest, "ENOUGH", enough)
    docs = corpus(9)
    out = minhash_forest.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2, 80)
    assert sorted(tuple(r) for r in out.collect()) == brute(docs, 2, 80)


def test_doc_ids_with_several_texts(spark):
    one, two = ([f"{c}{k}" for k in range(30)] for c in "xy")
    docs = [(1, one), (1, two), (2, [*one, "more"]), (3, [*two, "else"]), (0, ["z", *two]), (7, ["nothing", "like", "it"]), (7, []), (8, one)]
    docs = [(d, " ".join(t)) for d, t in docs]
    out = minhash_forest.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2, 80)
    got = sorted(tuple(r) for r in out.collect())
    assert got == brute(docs, 2, 80) and {r[2] for r in got} == {0, 7}


def test_recall_by_similarity(spark, monkeypatch):
    """Pairs alone in their neighbourhood and, with small regions, in a crowd that shares much."""
    monkeypatch.setattr(minhash_forest, "ENOUGH", 16)
    rng, docs, bands = random.Random(12), [], {}
    for k in range(300):
        base = [f"{k}w{j}" for j in range(rng.randint(40, 80))]
        other = list(base)
        for _ in range(rng.randint(0, 5)):
            other[rng.randrange(len(other))] = f"new{rng.random()}"
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    found = {r["doc_id"]: r["component_id"] for r in minhash_forest.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k in range(300):
        s, t = (shingles(docs[2 * k + i][1], 2) for i in (0, 1))
        share = len(s & t) / len(s | t)
        if share >= 0.8:
            band = bands.setdefault(min(9, int(share * 20) - 8), [0, 0])
            band[0] += found[2 * k] == found[2 * k + 1]
            band[1] += 1
        else:
            assert found[2 * k] != found[2 * k + 1]
    assert len(bands) >= 2 and all(hit >= 0.98 * n for hit, n in bands.values())


def test_long_chains_of_labels(spark):
    from lodestone.llm.common import components

    n = 700
    edges = spark.range(n - 1).selectExpr("id + 1 as a", "id as b").union(spark.createDataFrame([(2000, 1999), (5, 5)], "a long, b long"))
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(n)}, 2000: 1999, 1999: 1999}


def test_stage_keeps_the_first(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(4, text, "x"), (9, text + " more", "y"), (11, "something else that is short", "z"), (None, text, "n"), (12, None, None)]
    out = minhash_forest.first_of_each(spark.createDataFrame(rows, "doc_id long, text string, rep string"))
    assert out.columns == ["doc_id", "text", "rep"]
    assert sorted((r["doc_id"] or -1, r["rep"]) for r in out.where("rep is not null").collect()) == [(-1, "n"), (4, "x"), (11, "z")]
    assert out.count() == 4


def test_very_long_texts(spark):
    long = " ".join(f"word{k % 40_000}" for k in range(120_000))
    docs = [(3, long), (2, long + " end"), (9, "short text"), (4, long[: len(long) // 4])]
    out = minhash_forest.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2, 80)
    assert sorted(tuple(r) for r in out.collect()) == brute(docs, 2, 80)


def test_empty_table(spark):
    assert minhash_forest.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("block", [10**6, 200])
def test_cut_regions_lose_no_pair(spark, monkeypatch, block):
    """Classes that share each tree's first values and none of the others, so that every cut parts them."""
    monkeypatch.setattr(minhash_forest, "ENOUGH", 2)
    monkeypatch.setattr(minhash_forest, "BLOCK", block)
    rng, docs, rows = random.Random(3), [], []
    for k in range(20):
        own = [f"{k}w{j}" for j in range(60)]
        docs += [(2 * k, own), (2 * k + 1, [*own[:20], "other", *own[21:]])]
    # one group of near copies, more than a block and chained by none that is left out
    docs += [(100 + k, [*[f"c{j}" for j in range(60)][: 58 - k], *[f"new{j}" for j in range(k)]]) for k in range(30)]
    for rep, words in docs:
        heads, _, sketch = minhash_forest.signature(minhash_forest.shingles(" ".join(words).encode(), 2, minhash_forest.Hashes()))
        heads = b"".join(t.to_bytes(8, "little") for t in range(minhash_forest.TREES))
        rows.append((rep, len(words) - 1, bytearray(heads), bytearray(rng.randbytes(8 * minhash_forest.TREES)), bytearray(sketch)))
    classes = spark.createDataFrame(rows, "rep long, size long, heads binary, below binary, sketch binary")
    docs = [(d, " ".join(words)) for d, words in docs]
    found = minhash_forest.linked_classes(classes, spark.createDataFrame(docs, "rep long, text string"), 2, 80)
    got = {r["id"]: r["component"] for r in found.collect()}
    assert {d: got.get(d, d) for d, _ in docs} == {d: component for d, _, component, _ in brute(docs, 2, 80)}
