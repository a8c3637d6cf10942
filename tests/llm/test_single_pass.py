"""Token counts, audio columns, decontamination, packing, language and quality."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import best_fit_packing, language_id, media_columns, quality_rules, template_decontamination, token_counts, url_filters
from lodestone.llm.common import tokenizer_path

SMALL = "/root/testdata/sf0.01"
ODD = [(1, "plain text here"), (2, None), (3, ""), (4, " "), (5, "word " * 5000), (6, "é ü\n\tß  double"), (None, "no id"), (1, "plain text here")]
EXTRA = "doc_id long, text string, score double, length int, held_out string"


def odd(spark):
    return spark.createDataFrame([(*r, 0.5, 1, "x") for r in ODD], EXTRA)


# -- token counts


def naive(vocabulary, text):
    text = "▁" + text.replace(" ", "▁") if text else ""
    unknown = min([0, *vocabulary.values()]) - 10
    best = [(0, 0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):  # the earliest start wins ties
            piece = text[start:end]
            if piece in vocabulary:
                option = (best[start][0] + vocabulary[piece], best[start][1] + 1, best[start][2])
            elif end - start == 1 and piece not in vocabulary:
                n = len(piece.encode())
                option = (best[start][0] + unknown, best[start][1] + n, best[start][2] + n)
            else:
                continue
            if best[end] is None or option[0] > best[end][0]:
                best[end] = option
    return best[-1][1], best[-1][2], best[-1][0]


def test_counts_against_a_plain_viterbi():
    rng = random.Random(5)
    for _ in range(60):
        letters = "abcé"
        vocabulary = {"▁": -3}
        for _ in range(rng.randint(3, 25)):
            piece = "".join(rng.choice(letters) for _ in range(rng.randint(1, 4)))
            vocabulary[rng.choice(["", "▁"]) + piece] = -rng.randint(1, 6)
        solver = token_counts.Solver(vocabulary)
        for _ in range(10):
            text = "".join(rng.choice(letters + " ☃") for _ in range(rng.randint(0, 25)))
            assert solver.count(text) == naive(vocabulary, text), (vocabulary, text)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model(raw, scores):
    """A model like ``raw`` whose kind is unigram and whose plain pieces have these scores; nothing is trained."""
    out = b""
    for number, value in token_counts.fields(raw):
        if number == 1:
            piece = dict(token_counts.fields(value))
            text = piece[1].decode()
            if piece.get(3, 1) == 1:
                value = field(1, piece[1]) + b"\x15" + struct.pack("<f", scores[text]) + field(3, 1)
        elif number == 2:
            value = b"".join(b"\x18\x01" if k == 3 else field(k, v) if isinstance(v, int) or len(v) != 4 else b"" for k, v in token_counts.fields(value))
        out += field(number, value)
    return out


def test_counts_are_those_of_a_unigram_encoder(spark, tmp_path):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        raw = file.read()
    scores = token_counts.read_vocabulary(path)
    assert not token_counts.is_unigram(raw) and len(set(scores.values())) < len(scores) / 20  # so many ties
    model = unigram_model(raw, scores)
    encoder, solver = sentencepiece.SentencePieceProcessor(model_proto=model), token_counts.Solver(scores)
    assert token_counts.is_unigram(model) and encoder.get_piece_size() > 31_000
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if r["text"] and len(r["text"]) < 20_000]
    rng = random.Random(9)
    texts += ["".join(rng.choice("aeinrst eE.,é☃\U0001f600\u0301\t\n 汉0123") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    texts += ["  two  spaces ", "x" * 500, "ab" * 300, "☃☃", " ", "a"]
    for text in texts:
        ids = encoder.encode(text)
        assert solver.count(text)[:2] == (len(ids), sum(map(encoder.is_byte, ids))), text[:80]
    (tmp_path / "unigram.model").write_bytes(unigram_model(raw, {p: v / 100 for p, v in scores.items()}))
    assert token_counts.read_vocabulary(str(tmp_path / "unigram.model")) == scores


def test_counts_of_odd_rows(spark):
    rows = token_counts.count_tokens(odd(spark)).collect()
    got = {r["doc_id"]: r["n_tokens"] for r in rows}
    assert len(rows) == len(ODD) and got[2] == got[3] == 0 and got[5] >= 5000 and got[None] > 0
    assert token_counts.count_tokens(odd(spark).limit(0)).count() == 0


# -- audio


def test_streams_give_their_payload_back(spark):
    rng = random.Random(3)
    for units in (1, 2, 6, 7, 8, 50, 333):
        payload = rng.randbytes(units * 192)
        stream = media_columns.store(payload)
        back, found = media_columns.load(stream)
        assert back == payload and found["junk"] == 0 and found["table"]["frames"] == len(found["frames"])
        assert found["table"]["bytes"] == len(stream) - found["frames"][0][0] + 288
    payload = b"\xff\xfa\x18\xc0" * 48 * 9  # a payload that looks like headers
    assert media_columns.load(media_columns.store(payload))[0] == payload


def test_parser_resynchronises_and_verifies():
    stream = media_columns.store(bytes(range(192)) * 20)
    start = media_columns.parse(stream)["frames"][0][0]
    frames = media_columns.parse(stream)["frames"]
    body = stream[start:]
    junk = b"junk\xff\xe0xx" * 5
    found = media_columns.parse(junk + body + b"TAG" + b"Title".ljust(125, b"\0"))
    assert found["junk"] == len(junk) and len(found["frames"]) == len(frames) and found["tags"]["id3v1"] == "Title"
    broken = bytearray(body)
    broken[8] ^= 1  # inside the first frame's side information
    assert [r for *_, r in media_columns.parse(bytes(broken))["frames"]][0] == 0
    assert media_columns.parse(b"")["frames"] == [] and media_columns.parse(b"\xff\xfb")["frames"] == []


def test_checksums_of_other_layers_are_not_called_right(spark):
    one, two = b"\xff\xfe\x10\xc0".ljust(32, b"a"), b"\xff\xfc\x10\xc0".ljust(104, b"a")
    streams = {1: one * 3, 2: two * 3, 3: media_columns.store(b"a" * 192)}
    rows = media_columns.parse_column(spark.createDataFrame([(k, bytearray(v)) for k, v in streams.items()], "k int, c binary"), "k", "c").collect()
    assert {r["k"]: (r["n_frames"], r["n_crc_ok"], r["n_crc_bad"]) for r in rows} == {1: (3, 0, 0), 2: (3, 0, 0), 3: (1, 1, 0)}


def test_audio_columns(spark):
    rows = media_columns.media_columns(odd(spark)).collect()
    assert len(rows) == len(ODD)
    for r, (_, text) in zip(sorted(rows, key=lambda r: (r["doc_id"] or 0, r["n_bytes"])), sorted(ODD, key=lambda r: (r[0] or 0, len((r[1] or "").encode()))), strict=True):
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    parsed = media_columns.parse_column(spark.createDataFrame([(1, bytearray(media_columns.store(b"a" * 192))), (2, None)], "k int, c binary"), "k", "c").collect()
    assert {r["k"]: (r["n_frames"], r["n_crc_ok"]) for r in parsed} == {1: (1, 1), 2: (0, 0)}


# -- decontamination

ITEM = "A train leaves Paris with 40 passengers and picks up 15 more at every stop until 100 passengers ride along the river."


def test_leaks(spark):
    other = ITEM.replace("Paris", "Berlin").replace("40", "36").replace("15", "12").replace("100", "84")
    mixed = ITEM.replace("15", "40")  # one value for two slots that differ in the item
    fill = "Nothing of interest happens in this sentence that goes on for quite a while without any number. "
    docs = [(1, fill + ITEM + " " + fill), (2, fill + other), (3, fill * 3), (4, None), (5, ""), (None, ITEM), (6, ITEM[:50])]
    bench = spark.createDataFrame([(7, ITEM, 1), (8, None, 1), (9, "", 1), (None, "Only one short line", 1)], "item_id long, text string, doc_id int")
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    got = {r["doc_id"]: (r["item_id"], r["n_slots_changed"]) for r in template_decontamination.leaks(df, bench).collect()}
    assert got[1] == (7, 0) and got[2][0] == 7 and got[2][1] >= 4 and got[None] == (7, 0)
    assert not {3, 4, 5} & set(got)
    kept = template_decontamination.without_leaks(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    few = template_decontamination.leaks(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), bench).collect()
    assert not few or few[0]["n_windows"] < few[0]["n_item_windows"]
    assert template_decontamination.leaks(df.limit(0), bench).count() == 0
    assert template_decontamination.without_leaks(df, bench.limit(0)).count() == len(docs)


def template(text):
    """(template word, with names everywhere, slot?, with names?, value) of each word, by the rules of the docstring."""
    out, begins = [], True
    for word in (text or "").split():
        core = word.strip(template_decontamination.EDGES)
        lower = core.lower()
        glued = template_decontamination.GLUED.fullmatch(core)
        kind = "<number>" if lower in template_decontamination.NUMERALS or template_decontamination.NUMBER.fullmatch(core) else "<unit>" if lower in template_decontamination.UNITS else "<number><unit>" if glued and glued[2].lower() in template_decontamination.UNITS else None
        named = not kind and core[:1].isupper() and not (len(core) > 1 and core.isupper())
        if core:
            inner = kind or ("<name>" if named else lower)
            out.append((kind or lower if begins else inner, inner, bool(kind) or named and not begins, bool(kind) or named, lower))
        begins = word.rstrip("\"')]}”’»")[-1:] in (".", "!", "?", ":")
    return out


def brute_leaks(docs, items, least=6, share=0.25, exact=13):
    out = set()
    for item_id, item in items:
        t = template(item)
        w, e = min(8, len(t)), min(exact, len(t))
        good = [j for j in range(len(t) - w + 1) if w and sum(not x[2] for x in t[j : j + w]) >= min(3, w)]
        places = [{}, {}]
        for j in good:
            for named in (0, 1):
                places[named].setdefault(tuple(x[named] for x in t[j : j + w]), j)
        total = len(places[0])
        for doc_id, text in docs:
            d = template(text)
            same = bool(e) and any([x[4] for x in d[i : i + e]] == [x[4] for x in t[j : j + e]] for i in range(len(d) - e + 1) for j in range(len(t) - e + 1))
            pairs = []
            for i in range(len(d) - w + 1):
                for named in (0, 1) if w >= 3 else (0,):
                    j = places[named].get(tuple(x[named] for x in d[i : i + w])) if w else None
                    if j is not None:
                        pairs.append((i - j, j, named))
            held, most = set(), 0
            for diagonal in {p[0] for p in pairs}:
                there, here = {}, set()
                for _, j, named in sorted(p for p in pairs if p[0] == diagonal):
                    spots = [x for x in range(w) if t[j + x][2 + named]]
                    own, other = [t[j + x][4] for x in spots], [d[diagonal + j + x][4] for x in spots]
                    if j in here or w - len(spots) < min(3, w) and any(a != b and not t[j + x][2] for x, a, b in zip(spots, own, other, strict=True)):
                        continue
                    more = {**there}
                    if all(more.setdefault(a, b) == b for a, b in zip(own, other, strict=True)) and len(set(more.values())) == len(more):
                        there = more
                        here.add(j)
                held |= here
                most = max(most, len(here))
            if same or held and (most >= min(least, total) or len(held) >= max(min(least, total), share * total)):
                out.add((doc_id, item_id, len(held), total))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(21)
    names, nouns = ["Ann", "Bob", "Paris", "Rome", "Li"], ["cat", "dog", "tree", "train", "shop", "river", "cake", "road"]
    word = lambda: rng.choice([rng.choice(names), rng.choice(nouns), rng.choice(nouns), str(rng.randint(1, 9)), "km", "the", "of", "Every"])
    text = lambda n: " ".join(word() + rng.choice(["", "", "", ".", ",", "?"]) for _ in range(n))
    items = [(k, text(rng.choice([2, 5, 9, 15, 30, 60]))) for k in range(25)] + [(50, "12 + 7 = ?"), (51, "Compute 12 * 17"), (52, "Convert 5 km to miles"), (53, ("the train of Ann runs to the river " * 6))]

    def other(t):
        new = {n: rng.choice(names) for n in names} if rng.random() < 0.5 else {}
        return " ".join(new.get(x, str(rng.randint(1, 9)) if x.isdigit() and rng.random() < 0.5 else x) for x in t.split())

    docs = []
    for d in range(120):
        part = rng.choice(items)[1]
        words = part.split()
        cut = " ".join(words[rng.randint(0, len(words) // 2) :])
        docs.append((d, " ".join([text(rng.randint(0, 20)), rng.choice([part, other(part), cut, other(cut), cut.lower(), ""]), text(rng.randint(0, 20))])))
    docs += [(200, items[28][1] * 3), (201, None), (202, ""), (None, items[3][1])] + [(210 + k, items[25 + k][1]) for k in range(3)]
    got = template_decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = brute_leaks(docs, items)
    assert {(r["doc_id"], r["item_id"], r["n_windows"], r["n_item_windows"]) for r in got} == expected and len(got) == len(expected) > 60
    assert {(210, 50), (211, 51), (212, 52)} <= {x[:2] for x in expected}


def test_repeated_windows_cost_rows_not_pairs(spark):
    sentence = "The train of Ann runs along the river to the old town every day. "
    docs, items = spark.createDataFrame([(1, sentence * 4000), (1, sentence * 4000)], "doc_id long, text string"), spark.createDataFrame([(1, sentence * 4000)] * 2, "item_id long, text string")
    windows = template_decontamination.benchmark_windows(items, 13)
    assert windows.count() < 60
    assert [(r["doc_id"], r["item_id"]) for r in template_decontamination.leaks(docs, items).collect()] == [(1, 1)]


def leaking(item, *texts):
    found = set()
    rows = [(r["kind"], r["hash"], r["codes"], r) for r in (dict(zip(("kind", "width", "hash", "codes", "place", "slots", "marks", "values", "total"), w, strict=True)) for w in template_decontamination.item_windows(item, 13))]
    for n, text in enumerate(texts):
        _, codes, _, names, _, values = template_decontamination.Words().look([text])
        met = []
        for kind, _, key, r in rows:
            own = (codes, names, values)[kind]
            met += [{**r, "at": i, "found": values[i : i + r["width"]].tobytes()} for i in range(len(own) - r["width"] + 1) if own[i : i + r["width"]].tobytes() == key]
        kept, _, most = template_decontamination.held([r for r in met if r["kind"] != 2])
        if any(r["kind"] == 2 for r in met) or kept and most >= min(6, rows[0][3]["total"]):
            found.add(n)
    return [n in found for n in range(len(texts))]


def test_leaks_of_long_items():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    other = " ".join(words[:13]) + " " + "filler " * 20
    assert leaking(" ".join(words), "before it " + " ".join(words[120:220]) + " after it", other, " ".join(words[:10]), "filler " * 200) == [True, True, False, False]


def test_leaks_behind_a_heading():
    item = "Which train leaves Paris with 40 passengers every single morning?"
    other = item.replace("Paris", "Berlin").replace("40", "36")
    assert leaking(item, f"Question 5\n{item}", f"Question 5\n{other}", f"of it {item.lower()}", f"Question 5\n{item[6:40]}") == [True, True, True, False]
    assert leaking("How much do 40 apples cost?", "Question 5\nHow much do 30 apples cost?", "Question 5\nHow much do 30 pears cost?") == [True, False]


def test_leaks_without_literals():
    item = "Who Was King Of France In 1789 Before Napoleon Bonaparte?"
    assert leaking(item, f"they ask: {item} Yes", item.lower(), item.replace("1789", "1790")) == [True, True, False]


def test_slots_of_each_alignment():
    first = ITEM.replace("40", "36").replace("15", "12").replace("100", "84").replace("Paris", "Rome")
    part = " ".join(ITEM.replace("40", "12").replace("Paris", "Oslo").split()[:10])
    assert leaking(ITEM, f"{part} and then nothing else. {first}") == [True]


# -- packing


def check_packing(rows, texts, size):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    for doc, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(docs[doc], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            part = ids[at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += r["length"]
        assert at == len(ids) and (len(ids) > size or len(docs[doc]) == 1)
    return len(bins), sum(r["length"] for r in rows)


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n, total = check_packing(best_fit_packing.pack(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()}, 2048)
    assert n <= -(-total // 2048) + 1


def test_packing_of_odd_rows(spark):
    rows = best_fit_packing.pack(odd(spark), size=64).collect()
    assert sum(r["doc_id"] is None for r in rows) == 1 and sum(r["doc_id"] == 1 for r in rows) == 2
    bins = defaultdict(int)
    for r in rows:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 64
    assert best_fit_packing.pack(odd(spark).limit(0)).count() == 0


def test_added_tokens_are_one_id(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = {1: "a<|endoftext|>b", 2: "some words <|endoftext|> and more,<|endoftext|>", 3: "no <|endoftex|> mark"}
    rows = best_fit_packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    ids = {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    assert len(ids[1]) == 3 and {r["doc_id"]: r["length"] - 1 for r in rows} == {d: len(x) for d, x in ids.items()}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in [*ids[r["doc_id"]], 0]))


def fewest(lengths, size):
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            rooms[k] -= lengths[i]
            go(i + 1, rooms)
            rooms[k] += lengths[i]
        go(i + 1, [*rooms, size - lengths[i]])

    go(0, [])
    return best


def sequences(histogram, size):
    """How many, after a look at what they hold."""
    used, patterns = defaultdict(int), best_fit_packing.plan(histogram, size)
    for times, pieces in patterns:
        assert sum(n * k for n, k in pieces) <= size
        for n, k in pieces:
            used[n] += times * k
    assert dict(used) == {n: c for n, c in histogram.items() if c}
    return sum(t for t, _ in patterns)


def test_completion_is_as_good_as_any():
    rng, better = random.Random(1), 0
    for _ in range(300):
        size = rng.choice([20, 30, 100])
        lengths = sorted((rng.randint(1, size) if rng.random() < 0.3 else rng.randint(size // 6, size // 2) for _ in range(rng.randint(1, 12))), reverse=True)
        histogram = Counter(lengths)
        least = fewest(lengths, size)
        assert sequences(histogram, size) == least, lengths
        better += sum(t for t, _ in best_fit_packing.best_fit([histogram.get(n, 0) for n in range(size + 1)], size)) > least
    assert better > 3  # best fit alone isn't


def test_completion_of_large_and_lopsided_histograms():
    cases = [({}, 0), ({1: 5000}, 3), ({2: 5000}, 5), ({1: 1500}, 1), ({1000: 1, 1: 2000}, 2), ({2048: 3}, 3), ({1300: 3 * 10**7, 700: 10**8, 1: 10**9}, 65_000_000)]
    for histogram, n in cases:
        assert sequences(histogram, 2048) == n
    rng = random.Random(3)
    many = Counter(min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(100_000))
    assert sequences(many, 2048) == -(-sum(n * c for n, c in many.items()) // 2048)


def test_fillings_are_all_the_undominated():
    rng = random.Random(6)
    for _ in range(60):
        room = rng.randint(5, 24)
        counts = [0] + [rng.choice([0, 0, 1, 2, 3]) for _ in range(room)]
        got = list(best_fit_packing.fillings(counts, room, room))
        assert [w for w, _ in got] == sorted(w for w, _ in got) and len({f for _, f in got}) == len(got)
        every = [()]
        for n in range(room, 0, -1):
            every = [(*f, (n, k)) if k else f for f in every for k in range(counts[n] + 1) if sum(m * j for m, j in f) + n * k <= room]

        def beaten(f):
            pieces, waste = [n for n, k in f for _ in range(k)], room - sum(n * k for n, k in f)
            parts = {(0, 0)}
            for n in pieces:
                parts |= {(s + n, c + 1) for s, c in parts}
            return any(x > s and x <= s + waste or x == s and c > 1 for s, c in parts for x in range(1, room + 1) if counts[x] > dict(f).get(x, 0))

        assert {f for _, f in got} == {f for f in every if not beaten(f)}


def test_packing_of_many_tiny_documents(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "case when id % 2 = 0 then '' end as text")
    rows = best_fit_packing.pack(docs).collect()
    n, total = check_packing(rows, {d: None for d in range(5000)}, 2048)
    assert (n, total) == (3, 5000)


# -- classifiers


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = language_id.predict(docs, language_id.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_kernel_is_the_share_of_common_grams():
    import numpy as np

    rng = random.Random(2)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(1, 40))).encode() for _ in range(12)]

    def grams(t):
        t = t.lower()
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    x = language_id.presence(texts)
    got = language_id.kernel_to(x, x.astype(np.float32))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            s, t = grams(a), grams(b)
            assert got[i, j] == pytest.approx(len(s & t) / (len(s) * len(t)) ** 0.5, abs=0.05)  # but for hashes that meet
    long = b"some words " * 200_000  # longer than what is looked at in one go
    assert (language_id.presence([long]) == language_id.presence([b"some words " * 3])).all()


def test_all_languages_are_learnt(spark):
    rows = [(3 * k + j, f"{chr(0x4E00 + k)}{chr(0x4E00 + k)} text {j}", f"lang{k}") for k in range(150) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs, max_rows=100)
    known = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    assert set(model["names"]) == known and len(known) > 128


def test_languages_of_odd_rows(spark):
    docs = odd(spark).withColumn("lang", F.when(F.col("doc_id") == 1, "en"))
    model = language_id.learn(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()}
    assert got[2] == got[3] == got[4] == ("und", 0.0) and got[5][0] == "en" and all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.learn(docs.limit(0))).collect()} == {"und"}


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = quality_rules.score(docs, quality_rules.learn(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    good = [r for r in rows if r["quality"] == 1]
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows)
    assert sum(r["predicted"] for r in good) >= 0.97 * len(good)


def test_quality_of_odd_rows(spark):
    docs = odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_rules.learn(docs, none)
    assert model is None and {r["score"] for r in quality_rules.score(docs, model).collect()} == {0.5}
    assert quality_rules.keep_good(docs, model).count() == len(ODD)
    one = quality_rules.learn(docs, spark.createDataFrame([(3, 1, 0), (3, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int"))
    kept = quality_rules.keep_good(docs, one)
    assert kept.columns == docs.columns and kept.count() == len(ODD)


def test_quality_of_clashing_names_and_repeated_ids(spark):
    rows = [(d, text, 0.1) for d in range(60) for text in (["word " * 30, "$$ %% ^^ " * 9] if d % 2 else ["word " * 40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __stat_upper double").withColumnRenamed("__stat_upper", "__STAT_upper")
    labels = spark.createDataFrame([(d, 1 - d % 2) for d in range(60)], "doc_id long, quality int")
    models = [quality_rules.learn(docs.repartition(n), labels) for n in (1, 3)]
    assert models[0] == models[1]
    kept = quality_rules.keep_good(docs, models[0])
    assert kept.columns == docs.columns and {r["doc_id"] % 2 for r in kept.collect()} >= {0}
    assert quality_rules.score(docs.limit(0), models[0]).count() == 0


def test_compiled_rules_are_the_rules(spark):
    model = {"bias": 0.1, "rules": [(((0, True, 1.5), (1, False, 0.25)), 2.0), (((4, True, 0.0),), -1.0)]}
    rows = quality_rules.with_statistics(odd(spark)).withColumn("s", quality_rules.compile_score(model)).collect()
    for r in rows:
        x = quality_rules.statistics(r["text"])
        z = 0.1 + 2.0 * (x[0] > 1.5 and x[1] <= 0.25) - 1.0 * (x[4] > 0)
        assert r["s"] == pytest.approx(1 / (1 + 2.718281828459045**-z))


# -- urls


def test_url_rules_and_templates(spark):
    urls = [
        ("http://A.Example.COM/en/1?x#y", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("https://www.example.com/en/2", "www.example.com", "/en/2", "www.example.com/en/", "allow"),
        ("https://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("http://example.com/EN/", "example.com", "/EN/", "com/", "allow"),
        ("ftp://net/es/x", "net", "/es/x", "net/es/", "block"),
        ("http://subnet/es/x", "subnet", "/es/x", None, "allow"),
        ("http://É.net/fr/", "É.net", "/fr/", "net/fr/", "block"),
        ("no scheme/com/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://h.org?q=://z.com/", "h.org", "", None, "allow"),
    ]
    df = spark.createDataFrame([(k, u[0], "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(df).collect()}
    assert got == {k: u[1:] for k, u in enumerate(urls)}
    assert url_filters.judge(df.limit(0)).count() == 0


def test_impure_templates_are_rejected(spark):
    rules = (("block", "a.org/x/bad"), ("allow", "b.org/"))
    rows = [f"http://a.org/x/bad{k}" for k in range(40)] + ["http://a.org/x/bod1", "http://c.org/x/bad1"] + [f"http://b.org/x/{k}" for k in range(40)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["template"]) for r in url_filters.judge(df, rules).collect()}
    assert got[0] == ("block", "a.org/*/*/*") and got[41][0] == "allow"


def test_segments_that_look_like_wildcards(spark):
    rules = (("block", "a.org/a/$"), ("allow", "a.org/a"))
    rows = ["http://a.org/a/$"] * 20 + ["http://a.org/a"] * 20 + ["http://a.org/*/b"] * 20 + [f"http://a.org/q{chr(97 + k)}/b" for k in range(5)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["page_id"]: (r["template"], r["purity"]) for r in url_filters.judge(df, rules).collect()}
    assert got[0][1] > 0.8 and got[20][1] < 0.2 and got[40][1] == got[59][1]


def test_templates_of_deep_paths(spark):
    rules = (("block", "a.org/x/y/z/bad/q"), ("allow", "a.org/x/y/z/good/q"))
    rows = [f"http://a.org/x/y/z/{k}/q/{p}/e" for k in ("bad", "good") for p in "rs" for _ in range(20)]
    rows += ["http://a.org/x/y/z/bad/u/r"] + [f"http://b.org/x/{k}" for k in "cd" for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filters.judge(df, rules).collect()}
    assert len(got) == len(rows)
    assert got[0]["template"] == "a.org/x/y/z/bad/*/*/*" and got[40]["template"] == "a.org/x/y/z/good/*/*/*"
    assert got[0]["purity"] > 0.9 and got[40]["purity"] < 0.1
    shallow = {r["page_id"]: r["template"] for r in url_filters.judge(df.where("url like '%b.org%'"), rules).collect()}
    assert shallow == {k: got[k]["template"] for k in shallow}  # depth elsewhere changes nothing here
