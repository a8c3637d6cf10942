import hashlib
import random

import pytest

from lodestone.llm import suffix_dedup


def brute(docs, depth):
    raw = sorted((d, (t or "").encode()) for d, t in docs if d is not None)
    first = {}
    for d, b in raw:
        for i in range(len(b) - depth + 1):
            first[b[i : i + depth]] = min(first.get(b[i : i + depth], d), d)
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if first[b[i : i + depth]] < d:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(spark, docs, **more):
    df = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string, block int, content string"), **more)
    return sorted(tuple(r) for r in df.collect())


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("seed, block_bytes, depth, crowd", [(1, 500, 24, None), (2, 3000, 50, 3), (3, None, 31, 0)])
def test_against_brute_force(spark, seed, block_bytes, depth, crowd):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    shared = [text(rng.randint(20, 120)) for _ in range(5)] + ["a" * 90, "ab" * 60]
    docs = [(d, "".join(rng.choice([rng.choice(shared), text(rng.randint(0, 40))]) for _ in range(rng.randint(0, 6))), 1, "x") for d in range(60)]
    docs += [(200, None, None, None), (201, "", 0, ""), (None, shared[0], 0, ""), (7, docs[7][1], 0, ""), (300, "z" * 5000, 0, ""), (301, "z" * 700, 0, ""), (5, shared[1], 0, "")]
    assert found(spark, docs, depth=depth, block_bytes=block_bytes, crowd=crowd) == brute([d[:2] for d in docs], depth)


@pytest.mark.parametrize("crowd", [20, 10**9])
def test_boilerplate_beside_other_words(spark, crowd):
    """A passage that every document has, each with a number of its own on either side."""
    rng = random.Random(4)
    docs = [(d, f"{rng.getrandbits(60):x}{'all rights of this page are with its owner, see '}{rng.choice('abc')}{rng.getrandbits(60):x}", 1, "x") for d in range(150)]
    assert found(spark, docs, block_bytes=2000, crowd=crowd) == brute([d[:2] for d in docs], 50)


def test_windows_of_crowded_grams_are_single():
    import numpy as np
    import pyarrow as pa

    t = pa.table({"doc_id": [1, 2, 3], "content": [b"x" * 9 + b"0123456789abcdefghijklmnop" + bytes([65 + k]) * 30 for k in range(3)]})
    b = suffix_dedup.Block(t, 24)
    grams = np.unique(suffix_dedup.spot(b.gram, 1))
    whole, single = b.marked(grams, grams[:0], 1), b.marked(grams, grams, 1)
    assert len(single.start) == b.count.sum() and {len(x) for x in single.seen} == {24}
    assert sorted(np.unique(single.start)) == sorted(s + k for s, c in zip(b.start, b.count, strict=True) for k in range(c))
    assert len({g for g in single.gram.tolist()}) == len(single.seen) and len(whole.start) == len(b.start)
