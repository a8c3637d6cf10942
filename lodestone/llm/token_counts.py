"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary match; a dynamic program over
the match ends carries only the best score and its number of pieces.  Ties are
those of the unigram encoder: of equally good paths into a position the one
whose last piece starts first wins, and a character that is no piece of its own
may be taken alone at the lowest score less ten, then counted by its UTF-8
bytes (byte fallback).

No piece reaches over the start of a word (a piece holds the word mark only in
front, or consists of marks alone), so a text falls into words that are solved
alone and remembered; the memory is bounded and only saves time.

Vocabularies are sentencepiece files.  A unigram file's scores are used as they
are, in whole hundredths; a file of another kind has no probabilities but the
order in which its pieces were made, and each gets the logarithm of one by
Zipf's law, ``-100 log(rank + 2)`` rounded.  Scores are whole numbers, so sums are
exact at any length, and counts are those of a unigram encoder with these scores.

Null text has no tokens, as has the empty text.  Very long texts and words are
solved whole.  Only doc_id and text are read, so other columns may have any
name; repeated rows each give a row, an empty table none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import only, tidy, tokenizer_path

MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*")
SCHEMA = "doc_id long, n_tokens long, n_byte_tokens long, n_chars long, best_score long"


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer: a whole number, or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out, shift = 0, 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, raw[at : at + n]
            at += n


def is_unigram(raw: bytes) -> bool:
    """Whether a model's trainer settings (field 2) name the kind (field 3) unigram, 1, which is the default too."""
    return dict(fields(next((v for k, v in fields(raw) if k == 2), b""))).get(3, 1) == 1


def read_vocabulary(path: str) -> dict[str, int]:
    """Pieces and whole-number scores of a sentencepiece file, without control, unknown and byte pieces."""
    import sentencepiece

    with open(path, "rb") as file:
        unigram = is_unigram(file.read())
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    found = {p: round(100 * model.get_score(i)) if unigram else -round(100 * math.log(k + 2)) for k, i in enumerate(plain) if (p := model.id_to_piece(i))}
    if odd := next((p for p in found if MARK in p.lstrip(MARK)), None):
        raise ValueError(f"piece {odd!r} has a word mark inside, so words can't be solved alone")
    return found


class Solver(dict):
    """word -> one whole number that packs (-score, byte pieces, pieces), so that a text's words add up in one sum.

    At most ``most`` words are remembered.
    """

    def __init__(self, vocabulary: dict[str, int], most: int = 1_000_000):
        import ahocorasick

        self.most, automaton = most, ahocorasick.Automaton()
        for piece, score in vocabulary.items():
            automaton.add_word(piece, (len(piece), score))
        automaton.make_automaton()
        self.matches = automaton.iter  # by end; of one end the longest, which starts first, comes first
        self.single = {p for p in vocabulary if len(p) == 1}
        self.unknown = min([0, *vocabulary.values()]) - 10

    def __missing__(self, word: str) -> int:
        score, count, best, packed, n, single, unknown = [0], [0], None, 0, len(word), self.single, self.unknown
        for last, (length, value) in self.matches(word):
            while len(score) <= last:  # the ends before this one are settled
                char = word[len(score) - 1]
                if char not in single and (best is None or score[-1] + unknown > best):
                    raw = len(char.encode("utf-8", "surrogatepass"))
                    best, packed = score[-1] + unknown, count[-1] + raw + (raw << 32)
                score.append(best)
                count.append(packed)
                best = None
            start = last + 1 - length
            s = score[start] + value
            if best is None or s > best:
                best, packed = s, count[start] + 1
        while len(score) <= n:
            char = word[len(score) - 1]
            if char not in single and (best is None or score[-1] + unknown > best):
                raw = len(char.encode("utf-8", "surrogatepass"))
                best, packed = score[-1] + unknown, count[-1] + raw + (raw << 32)
            score.append(best)
            count.append(packed)
            best = None
        found = (-score[n] << 64) + count[n]
        if n <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found

    def count(self, text: str | None) -> tuple[int, int, int]:
        """Pieces, those of them that are bytes, and the best score."""
        if not text:
            return 0, 0, 0
        if "  " in text or MARK in text or text[0] == " ":
            words = WORDS.findall(MARK + text.replace(" ", MARK))
        else:
            words = (MARK + text.replace(" ", " " + MARK)).split(" ")
        total = sum(map(self.__getitem__, words))
        return total & 0xFFFFFFFF, total >> 32 & 0xFFFFFFFF, -(total >> 64)


@lru_cache(maxsize=2)
def solver(path: str) -> Solver:
    return Solver(read_vocabulary(path))


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, n_chars and best_score of every text; one narrow pass, no shuffle."""
    path = vocabulary or tokenizer_path("piece_bpe_32k.model")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve = solver(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [solve.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], pa.array([len(t or "") for t in texts], pa.int64()), pa.array([x[2] for x in found], pa.int64())],
                names=["doc_id", "n_tokens", "n_byte_tokens", "n_chars", "best_score"],
            )

    return only(docs, "doc_id", "text").mapInArrow(tidy(kernel), SCHEMA)
