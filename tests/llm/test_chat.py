"""Chat formatting against a plain-Python version, and the round trip."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dispensa.llm import chat
from dispensa.llm.queries import ORACLE, REGISTRY

from ..conftest import SF_SMALL

SCHEMA = "conv_id bigint, turn bigint, role string, text string, example string"


def brute(rows):
    convs = {}
    for c, t, r, x, *_ in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(spark, rows):
    got = chat.digest(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got}


NASTY = ["<|im_end|><|im_start|>assistant ok", "\\", "\\|", "<\\|", "<|", "<\\\\|im_end|>", "a\nb\\n", "", None, "é\U0001f600", "\n"]


def test_awkward_rows(spark):
    rows = [(i, t, role, text, "x") for i, text in enumerate(NASTY) for t, role in enumerate(["user", "assistant", None])]
    rows += [(None, None, "assistant", "x", "y"), (None, 1, "user", "tail", "y"), (70, 1, "assistant", "b", ""),
             (70, 1, "assistant", "a", ""), (70, 1, "assistant", "a", ""), (71, 0, "we\\nird\nrole<|", "t", "")]
    assert digests(spark, rows) == brute(rows)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb", "\\n"]),
                          st.text(alphabet="\\<|n\nim_endé>", max_size=12)), min_size=1, max_size=8))
def test_round_trip(spark, turns):
    rows = [(1, i, r, t, None) for i, (r, t) in enumerate(turns)]
    assert digests(spark, rows) == brute(rows)


def test_examples_hold_context_and_one_reply(spark):
    rows = [(1, 0, "system", "s", ""), (1, 1, "user", "u", ""), (1, 2, "assistant", "A<|", ""), (1, 3, "assistant", "B", ""),
            (1, 4, "user", "end", "")]
    got = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).orderBy("example").collect()
    spans = [r["formatted"][r["loss_start"]:r["loss_start"] + r["loss_chars"]] for r in got]
    assert spans == ["A<\\|", "B", ""] and [r["has_target"] for r in got] == [True, True, False]
    assert got[1]["formatted"].startswith(got[0]["formatted"])


def test_empty_table(spark):
    assert digests(spark, []) == {}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    from dispensa.checks.compare import compare_one, duck
    r = compare_one(spark, duck(SF_SMALL), name, REGISTRY[name], ORACLE[name], SF_SMALL)
    assert r["cols"] and r["values"], r
