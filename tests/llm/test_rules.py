"""Quality rules: base counts by brute force, the learned list."""

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dispensa.llm import rules
from dispensa.llm.common import col, read_table
from dispensa.llm.queries import op8_rules

from ..conftest import SF_CHECK
from .helpers import AWKWARD, documents, row


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    marked = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked))


def counts(spark, texts):
    stats = rules.narrow(documents(spark, [row(i, t) for i, t in enumerate(texts)]))
    return [tuple(r) for r in stats.orderBy("doc_id").select(*[F.col("stats")[b] for b in rules.BASE]).collect()]


def test_base_counts(spark):
    texts = [r[1] for r in AWKWARD] + ["\n\n a \n a\n a ", "a b c d e " * 3, "x y " * 9 + "q", "é\u00a0b c", "\x0b\x0ca\rb"]
    assert counts(spark, texts) == [brute(t) for t in texts]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#A1!", max_size=60), min_size=1, max_size=12))
def test_base_counts_any_text(spark, texts):
    assert counts(spark, texts) == [brute(t) for t in texts]


def test_list_on_held_out_labels(spark):
    got = op8_rules(spark, SF_CHECK)
    assert got.filter("base_failed AND kept").count() == 0
    rows = got.join(read_table(spark, SF_CHECK, "labels"), "doc_id").filter(
        F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0).collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad)


def made(spark, n=600):
    """Two kinds of bad rows: many symbols with short words, or many capitals."""
    out = []
    for i in range(n):
        bad = i % 5 == 0
        symbols = 0.9 if bad and i % 2 else 0.05 + (i % 7) / 50
        upper = 0.95 if bad and not i % 2 else (i % 11) / 40
        out.append((*[float((i * 13 + k * 7) % 17) if k not in (1, 2) else (symbols if k == 1 else upper)
                      for k in range(len(rules.STATISTICS))], bad, "prune" if i % 3 == 0 else "grow"))
    return spark.createDataFrame(out, [*rules.STATISTICS, "bad", "part"])


def test_covering_learns_one_rule_per_kind(spark):
    rows = made(spark)
    learned = rules.learn(rows)
    assert {r.conditions[0].statistic for r in learned} == {"symbols_per_word", "upper_share"}
    keep = rules.verdict(learned, F.col("s"))
    got = rows.select("bad", F.struct(F.lit(99).alias("n_words"), F.lit(0).alias("n_repeat_words"),
                                      *[F.col(k) for k in rules.STATISTICS if k != "n_words"]).alias("s")).select("bad", keep.alias("keep"))
    assert got.filter("bad = keep").count() == 0


def test_no_labels_and_one_class(spark):
    docs = documents(spark, AWKWARD)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one = spark.createDataFrame([(4, 1, 0), (6, 1, 0), (6, None, 0)], "doc_id bigint, quality int, toxic int")
    for labels in (none, one):
        got = rules.judge(docs, labels).collect()
        assert len(got) == len(AWKWARD) and all(r["kept"] != r["base_failed"] for r in got)
    out = rules.keep_documents(docs, none)
    assert out.columns == docs.columns
    want = Counter(r[0] for r in AWKWARD if not ((b := brute(r[1]))[0] < 10 or 100 * b[4] > 20 * b[0]))
    assert Counter(r["doc_id"] for r in out.collect()) == want
    assert rules.judge(docs.limit(0), one).count() == 0 and rules.keep_documents(docs.limit(0), one).count() == 0


def test_main_path_is_native(spark):
    docs = documents(spark, AWKWARD)
    with_stats, name = rules.with_statistics(docs)
    plan = with_stats.select(col(name))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
