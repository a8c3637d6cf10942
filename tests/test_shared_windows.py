"""Windows that documents share: by brute force, and how few of them are sent."""

import random

import numpy as np

from lodestone.operators import shared_windows as W


def brute(rows):
    holders, of = {}, {}
    for key, text in rows:
        words = text.split()
        for i in range(len(words) - 49):
            w = tuple(words[i : i + 50])
            holders.setdefault(w, set()).add(key)
            of.setdefault(key, set()).add(w)
    found = {k: sum(len(holders[w] - {None}) > 1 for w in ws) for k, ws in of.items()}
    return {k: n for k, n in found.items() if n}


def documents():
    rng = random.Random(3)
    make = lambda n, most=10**6: [f"w{rng.randrange(most)}" for _ in range(n)]
    run, edge, flat = make(120), make(50), ["a"] * 130
    rows = [(1, make(30) + run + make(40)), (2, run[20:110] + make(9)), (3, run[:49]), (4, edge), (5, make(1) + edge), (6, flat), (7, flat[:60] + make(70)), (8, make(300)), (9, make(400, 3)), (10, make(400, 3))]
    # the same document twice shares nothing with itself, and a document in two rows is one
    alone = make(80)
    rows += [(11, alone), (11, alone), (12, make(60)), (12, run), (None, make(5) + edge), (None, run)]
    return [(k, " \n".join(w)) for k, w in rows]


def test_shared_windows_are_those_of_brute_force(spark):
    rows = documents()
    got = W.shared_windows(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text")
    assert {r["doc_id"]: r["n_shared"] for r in got.collect()} == brute(rows)



def test_words_are_cut_as_by_the_query():
    assert [w.decode() for w in W.words_of(" a\tb\x0bc\x0cd\r\ne\u00a0f\u2003g ")] == ["a", "b", "c", "d", "e\u00a0f\u2003g"]


def test_equal_windows_have_equal_anchors_and_there_are_few():
    rng, hashes = random.Random(4), W.WordHashes()
    words = [b"%d" % rng.randrange(10**6) for _ in range(5000)]
    whole = W.anchors(words, hashes)
    assert len(whole) == len(words) - 49
    for i in rng.sample(range(len(whole)), 50):
        assert W.anchors(words[i : i + 50], W.WordHashes()).tolist() == [whole[i]]
    assert len(np.unique(whole)) < len(whole) / 10
