"""Token counts against two reference tokenizers, the binary format's round trip."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from dispensa.llm import tokenbin, tokencount
from dispensa.llm.common import read_table
from dispensa.llm.queries import op6_token_counts, op10_token_binary, tokenizer_path

from ..conftest import SF_SMALL
from .helpers import AWKWARD, LONG, documents

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def unigram():
    """The tokenizers library's unigram model over the same pieces: one id per
    byte for unknown characters."""
    vocabulary = tokencount.read_vocabulary(tokenizer_path(PIECES))
    low = min(s for _, s in vocabulary)
    rows = [("\uE000", low)] + vocabulary
    model = Tokenizer(Unigram(rows, unk_id=0, byte_fallback=False))

    def count(text):
        if not text:
            return 0
        whole = "▁" + text.replace(" ", "▁")
        got = model.encode(whole)
        return sum(len(whole[s:e].encode()) if i == 0 else 1 for i, (s, e) in zip(got.ids, got.offsets))
    return count


def brute(vocabulary, unknown, text):
    best = [(0.0, 0)] + [None] * len(text)
    for i in range(len(text)):
        if best[i] is None:
            continue
        single = False
        for j in range(i + 1, min(len(text), i + 20) + 1):
            s = vocabulary.get(text[i:j])
            if s is not None:
                single |= j == i + 1
                if best[j] is None or best[i][0] + s > best[j][0]:
                    best[j] = (best[i][0] + s, best[i][1] + 1)
        if not single and (best[i + 1] is None or best[i][0] + unknown > best[i + 1][0]):
            best[i + 1] = (best[i][0] + unknown, best[i][1] + len(text[i].encode()))
    return best[-1][1], best[-1][0]


def test_counts_equal_the_library(spark, unigram):
    rows = read_table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["n_tokens"] for r in op6_token_counts(spark, SF_SMALL).collect()}
    assert got == {r["doc_id"]: unigram(r["text"]) for r in rows}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab ▁,.é\n", max_size=14), max_size=5),
       st.lists(st.tuples(st.text(alphabet="ab▁,", min_size=1, max_size=4), st.integers(-6, 0)), max_size=14))
def test_any_vocabulary_against_brute_force(texts, pieces):
    """Ties included: scores are small integers."""
    vocabulary = {p: float(s) for p, s in pieces}
    count = tokencount.Counter(list(vocabulary.items()))
    n, score = count(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, n, score):
        whole = "▁" + t.replace(" ", "▁") if t else ""
        assert (a, b) == brute(vocabulary, count.unknown, whole), t


def test_awkward_counts(spark, unigram):
    docs = documents(spark, AWKWARD)
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in tokencount.count_tokens(docs, tokenizer_path(PIECES)).collect())
    assert got == sorted((str(r[0]), unigram(r[1])) for r in AWKWARD)
    assert tokencount.count_tokens(docs.limit(0), tokenizer_path(PIECES)).count() == 0


# -- binary format ----------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2 ** 32 - 1) | st.integers(0, 300), max_size=40))
def test_pack_round_trip(values):
    assert tokenbin.unpack(tokenbin.pack(np.array(values, dtype=np.uint32))).tolist() == values


def test_common_values_take_one_byte():
    assert len(tokenbin.pack(np.zeros(4000, dtype=np.uint32))) == 12 + 1000 + 4000


def test_broken_segments_are_refused():
    s = tokenbin.pack(np.arange(1000, dtype=np.uint32))
    for bad in (b"X" + s[1:], s[:-1], s + b"\0"):
        with pytest.raises(ValueError):
            tokenbin.unpack(bad)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path(BYTES))
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


ODD = ["", " ", " a", "a ", "a  b", "\n a", "a\u00a0 b", "x²y ½", "\U0001f600 hi", "a\x1cb c", "don't we'll", "a\n\nb", "é à", None,
       "<|endoftext|> x", "１２ a", "a\tb \u3000", "_a __ b_c", "Ⅷ viii", "a\u0301 b", "\x85 x", "a \x0b b", "हिन्दी भाषा"]


def test_encoder_equals_whole_texts(library):
    enc = tokenbin.encoder(tokenizer_path(BYTES))
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab 1,.\n\t'sé²_\u00a0") for _ in range(rng.randrange(30))) for _ in range(600)] + [LONG]
    ids, n = enc.encode(pa.array(texts, pa.string()), 2)
    ends = np.cumsum(n)
    for t, s, e in zip(texts, ends - n, ends):
        assert ids[s:e].tolist() == library(t), repr(t)


def test_encoder_with_a_full_table_and_long_units(library, monkeypatch):
    """The table of known units turns over; units over its longest are not kept."""
    monkeypatch.setattr(tokenbin, "MEMO", 12)
    enc = tokenbin.Encoder(tokenizer_path(BYTES))
    rng = random.Random(2)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abc'.\n") for _ in range(rng.choice((1, 2, 60)))).strip() or "x"
                          for _ in range(rng.randrange(1, 9))) for _ in range(6)]
        ids, n = enc.encode(pa.array(texts, pa.string()), 2)
        assert [ids[e - k:e].tolist() for k, e in zip(n, np.cumsum(n))] == [library(t) for t in texts]
        assert len(enc.names) <= 12 and all(len(u) <= tokenbin.LONGEST for u in enc.names.to_pylist())


def check_rows(got, rows, library):
    """Ascending ids (null first), gapless starts, the library's ids."""
    import zlib
    got = sorted(got, key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert keys == sorted(keys)
    want = sorted((str(d), len(x := library(t)), zlib.crc32(np.array(x, "<u4").tobytes())) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_written_files_give_the_ids_back(spark, library):
    rows = [(r["doc_id"], r["text"]) for r in read_table(spark, SF_SMALL, "documents").collect()]
    check_rows(op10_token_binary(spark, SF_SMALL).collect(), rows, library)


def test_awkward_files(spark, library, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(tokenbin, "SEGMENT_IDS", 50)
    for rows in (AWKWARD, []):
        segments, ranks = tokenbin.write_segments(documents(spark, rows), tokenizer_path(BYTES), slices=3)
        got = tokenbin.read_segments(segments, ranks).withColumn("ids_crc32", F.crc32("ids")).collect()
        check_rows(got, [(r[0], r[1]) for r in rows], library)


def test_cut_agrees_with_uncut_on_other_numerals():
    """Superscripts and fractions are word characters but no letters."""
    from dispensa.llm import tokencount
    from dispensa.llm.queries import tokenizer_path
    cutting = tokencount.Counter(tokencount.read_vocabulary(tokenizer_path("piece_bpe_32k.model")))
    assert cutting.cut is tokencount.PART
    rng = np.random.default_rng(6)
    texts = ["x².", "m². y", "².", "a ². b", "½.x", "x½,5"]
    texts += ["".join(rng.choice(list("abm²³½.,5- _é"), 12)) for _ in range(300)]
    for text in texts:
        whole = tokencount.SPACE + text.replace(" ", tokencount.SPACE)
        parts = [p for p in cutting.cut.findall(whole) if p]
        assert "".join(parts) == whole
        assert sum(cutting.viterbi(p)[0] for p in parts) == cutting.viterbi(whole)[0], text
