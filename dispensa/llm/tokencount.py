"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each
character; dynamic programming carries the best score and the number of pieces
of the best path, no path itself.  The rules of ties and unknown characters
are the tokenizer's: scores add up from the left in double precision; a later
candidate replaces an earlier one only if it is strictly better, candidates
for one end come longest first; a character that is no piece of its own may be
taken as unknown at the lowest score less 10, and counts one token for each of
its UTF-8 bytes (byte fallback).  Spaces become U+2581 and a text that is not
empty gets one in front.

The vocabulary (pieces and scores) is read from a public SentencePiece file;
its path is a parameter.  No piece of it holds U+2581 after another character,
so no piece crosses from one run of spaces and word into the next; nor does one
hold another character after a letter.  Texts are cut at such places, the
parts are solved one by one and remembered in a bounded table, with the same
result.  (If a vocabulary has such pieces, those cuts are not made.)

Defined results: null or empty text has 0 tokens and score 0; repeated rows
count alike; extra columns are ignored; empty table: no rows.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from .common import Memo, slices, space_units

SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value
# cut in front of U+2581, and behind letters too
RUN = re.compile(f"{SPACE}*[^{SPACE}]*")
# word characters that are neither letters (isalpha) nor decimal digits, as superscripts and fractions
OTHER = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
PART = re.compile(rf"{SPACE}*(?:[\W\d_{OTHER}](?<!{SPACE}))*[^\W\d_{OTHER}]*")
MEMO = 300_000


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a SentencePiece file with their scores."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]


class Counter:
    """Counts the tokens of texts for one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary:
            self.automaton.make_automaton()
        self.empty = not vocabulary
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        crossing = {(a, b) for p, _ in vocabulary for a, b in zip(p, p[1:])}
        by_run = not any(a != SPACE and b == SPACE for a, b in crossing)
        by_part = by_run and not any(a.isalpha() and not b.isalpha() for a, b in crossing)
        self.cut = PART if by_part else RUN if by_run else None
        self.memo = Memo(MEMO)

    def viterbi(self, text: str) -> tuple[int, float]:
        """(tokens, score) of the best segmentation."""
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        whole = bytearray(n + 1)  # a piece of one character ends here

        def unknown(end: int) -> None:
            # comes after all pieces that end here: it starts last
            s = best[end - 1] + self.unknown
            if best[end] is None or s > best[end]:
                best[end], count[end] = s, count[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))

        done = 0
        for last, (length, score) in () if self.empty else self.automaton.iter(text):
            end = last + 1
            while done < end - 1:  # ends without (further) pieces
                done += 1
                if not whole[done]:
                    unknown(done)
            if length == 1:
                whole[end] = 1
            s = best[end - length] + score
            if best[end] is None or s > best[end]:
                best[end], count[end] = s, count[end - length] + 1
        while done < n:
            done += 1
            if not whole[done]:
                unknown(done)
        return count[n], best[n]

    def whole(self, text: str) -> tuple[int, float]:
        """One text as the tokenizer sees it, cut where that is safe."""
        parts = [p for p in self.cut.findall(text) if p] if self.cut else [text]
        memo = self.memo
        for p in memo.missing(parts):
            memo[p] = self.viterbi(p)
        got = list(map(memo.__getitem__, parts))
        return sum([g[0] for g in got]), sum([g[1] for g in got], 0.0)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, score) of each whole text."""
        texts = pc.fill_null(texts, "")
        n, score = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
        # where each space stands alone, a text is its units with one space in front of each
        alone = ~pc.match_substring_regex(texts, f"^ |  |{SPACE}|^$").to_numpy(zero_copy_only=False)
        if self.cut is None:
            alone[:] = False
        plain = np.flatnonzero(alone)
        if len(plain):
            units, codes, bounds = space_units(texts.take(pa.array(plain)))
            got = [self.whole(SPACE + u) for u in units]
            n[plain] = np.add.reduceat(np.array([g[0] for g in got], dtype=np.int64)[codes], bounds[:-1])
            score[plain] = np.add.reduceat(np.array([g[1] for g in got])[codes], bounds[:-1])
        for i in np.flatnonzero(~alone):
            t = texts[int(i)].as_py()
            if t:
                n[i], score[i] = self.whole(SPACE + t.replace(" ", SPACE))
        self.memo.settle([k for k in self.memo if len(k) > 40])
        return n, score


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(read_vocabulary(path))


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = counter(path)  # kept by the Python worker for its next tasks
    for b in batches:
        for start, length in slices(b.column(1)):
            n, score = count(b.column(1).slice(start, length))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(start, length), pa.array(n), pa.array(score)],
                                             names=["doc_id", "n_tokens", "score"])


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, score (log score of the best path)."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_count, path=path), f"doc_id {kind}, n_tokens bigint, score double")
