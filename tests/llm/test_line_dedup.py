import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import line_dedup


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, threshold, least, linked=0):
    lines, first = [], {}
    for doc, text in docs:
        if doc is not None:
            for n, line in enumerate((text or "").split("\n")):
                raw = line.strip(line_dedup.BLANKS).encode()
                if len(raw) >= least:
                    lines.append((doc, n, raw))
                    first[raw] = min(first.get(raw, (doc, n)), (doc, n))
    near = {x: [y for y in first if y != x and min(len(x), len(y)) >= linked and abs(len(x) - len(y)) <= threshold and distance(x, y) <= threshold] for x in first}
    return sorted((d, n, *first[x], len(near[x]), (d, n) > min([first[x], *(first[y] for y in near[x])])) for d, n, x in lines)


def found(spark, docs, **more):
    out = line_dedup.judged(spark.createDataFrame(docs, "doc_id long, text string"), **more).collect()
    return sorted((r["doc_id"], r["line_no"], r["class_doc_id"], r["class_line_no"], r["n_links"], r["removed"]) for r in out)


def edited(rng, line):
    out = list(line)
    for _ in range(rng.randint(0, 2)):
        k = rng.randrange(len(out))
        rng.choice([lambda: out.insert(k, rng.choice("abé ")), lambda: out.pop(k), lambda: out.__setitem__(k, rng.choice("xyz"))])()
    return "".join(out)


@pytest.mark.parametrize("threshold, crowd", [(1, 64), (1, 2), (2, 64), (2, 2), (3, 64)])
def test_against_brute_force(spark, threshold, crowd):
    rng = random.Random(threshold * 100 + crowd)
    stems = ["".join(rng.choice("abcde ") for _ in range(rng.randint(16, 60))) for _ in range(6)]
    docs = [(d, "\n".join(edited(rng, rng.choice(stems)) for _ in range(4))) for d in range(25)]
    docs += [(None, stems[0]), (100, None), (101, ""), (102, "short\n\n \t\n" + stems[0]), (102, "short\n\n \t\n" + stems[0])]
    assert found(spark, docs, threshold=threshold, least=12, crowd=crowd) == brute(docs, threshold, 12)


def test_short_lines_are_judged_by_exact_repeats(spark):
    docs = [(1, "}\nab\nabcdefghijklmnop"), (2, "}\n \nac\nabcdefghijklmno\nabcdefghijklmnoq"), (3, "ab\nabcdefghijklmnx\n"), (4, "\r\nabcdefghijklmnop")]
    rows = found(spark, docs, threshold=2, least=1, linked=16)
    assert rows == brute(docs, 2, 1, 16)
    assert [r for r in rows if r[:2] == (2, 0)] == [(2, 0, 1, 0, 0, True)]


@pytest.mark.parametrize("threshold", [1, 2])
def test_crowded_keys_are_refined_and_lose_nothing(spark, threshold):
    rng = random.Random(4)
    stem = [rng.choice("abcdefgh") for _ in range(40)]
    lines = set()
    for k in range(70):
        x = list(stem)
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(x))
            rng.choice([lambda: x.insert(at, "Z"), lambda: x.pop(at), lambda: x.__setitem__(at, "XYZ"[k % 3])])()
        lines.add("".join(x))
    docs = list(enumerate(sorted(lines)))
    assert found(spark, docs, crowd=3, threshold=threshold) == brute(docs, threshold, 16)


@pytest.mark.parametrize("threshold", [1, 2])
def test_crowded_keys_of_the_finer_index_are_refined(spark, threshold):
    """Lines that differ in two words alone share a key of the finer index, and aren't compared with each other."""
    rng = random.Random(6)
    stem = "depots {} opens again on the third {} by day"  # 48 bytes; each word in a piece of its own
    word = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQ") for _ in range(4))
    lines = {stem.format(word(), word() if threshold == 2 else "MAYS") for _ in range(90)}
    for line in sorted(lines)[:8]:
        lines.add("".join(rng.choice("XYZ") if k in (rng.choice([8, 9]), 38) else c for k, c in enumerate(line)))
        lines.add(line[:9] + line[10:])
    docs = list(enumerate(sorted(lines)))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    classes = line_dedup.classes_of(line_dedup.lines_of(rows, 16))
    assert line_dedup.candidates(classes, threshold, 64).count() < 10 * len(lines)
    assert found(spark, docs, threshold=threshold) == brute(docs, threshold, 16)


@pytest.mark.parametrize("pieces, threshold", [(8, 1), (8, 2), (64, 2)])
def test_finer_keys_meet_all_links(spark, pieces, threshold):
    rng = random.Random(pieces)
    stem = "".join(rng.choice("abcd") for _ in range(30))
    lines = sorted({edited(rng, stem).encode() for _ in range(60)} | {rng.randbytes(3) for _ in range(8)})
    rows = spark.createDataFrame([(k, 0, bytearray(x)) for k, x in enumerate(lines)], "h1 long, h2 long, content binary")
    keys = line_dedup.hole_keys(rows, pieces, threshold)
    assert max(r["count"] for r in keys.groupBy("h1").count().collect()) <= line_dedup.n_keys(pieces, threshold)
    met = {tuple(sorted((r["a1"], r["b1"]))) for r in line_dedup.paired(line_dedup.meetings(keys, rows, None), threshold).collect()}
    near = {(i, j) for j in range(len(lines)) for i in range(j) if distance(lines[i], lines[j]) <= threshold}
    assert met >= near


@pytest.mark.parametrize("far", [0, 1, 2, 3])
def test_planted_links_at_each_distance(spark, far, monkeypatch):
    """Two edits far from each other are told by the banded distance alone."""
    line = "Deliveries to the northern depot resume on the third of May, at dawn."
    at = (5, 30, 61)[:far]
    other = "".join("#" if k in at else c for k, c in enumerate(line))
    docs = [(1, line), (2, other), (3, "a line of its own that is long enough")]
    assert [r[-1] for r in found(spark, docs, threshold=2)] == [False, far <= 2, False]
    if far == 2:
        monkeypatch.setattr(line_dedup, "banded", lambda x, y, t: F.lit(False))
        assert [r[-1] for r in found(spark, docs, threshold=2)] == [False, False, False]


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng = random.Random(threshold)
    pairs = []
    for _ in range(400):
        a = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 14)))
        b = bytearray(a)
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5 or not b:
                b.insert(rng.randint(0, len(b)), rng.choice(b"ab"))
            else:
                b.pop(rng.randrange(len(b)))
        pairs.append((a, bytes(b)))
    rows = spark.createDataFrame(pairs, "a binary, b binary").withColumn("near", line_dedup.within(F.col("a"), F.col("b"), threshold)).collect()
    assert all(r["near"] == (distance(bytes(r["a"]), bytes(r["b"])) <= threshold) for r in rows)


def test_stage(spark):
    one, two = "the first line of the text", "another line that is long enough"
    docs = [(1, f"{one}\n\n{two}", 60, "x"), (2, f"a new line, longer than the least\n{one}.\nok", 1, "y"), (3, two, 1, "z"), (4, None, None, None), (5, "", 0, ""), (None, one, 3, "n")]
    out = line_dedup.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string, n_chars long, row string"))
    assert out.columns == ["doc_id", "text", "n_chars", "row"]
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["row"]) for r in out.collect()}
    assert got == {1: (docs[0][1], 60, "x"), 2: ("a new line, longer than the least\nok", 36, "y"), 4: (None, None, None), 5: ("", 0, ""), None: (one, 3, "n")}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.judged(empty).count() == 0
    assert line_dedup.without_repeated_lines(empty).count() == 0
