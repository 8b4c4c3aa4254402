"""Quality rules as a learned decision list (DataFrame functions only).

Sequential covering over labelled documents: a rule (a conjunction of
thresholds on text statistics) is grown condition by condition for the
largest information gain on one part of the labelled rows, pruned to the
prefix that does best on the other part, and kept if it is precise enough;
the rows it covers are set aside and the next rule is learned from the rest.
The list is emitted as one ordered Spark expression (``when ... when ...
otherwise keep``).

Learning reads only counts: each statistic is cut into bins at quantiles of
both classes, and a growing step is one aggregate (bin counts by statistic and
class, at most ``len(STATISTICS) * bins * 2`` rows) over the table of binned,
labelled rows.  All labelled rows count; none is sampled.

Words are runs without white space; a 5-word window is known by a chained
64-bit hash of its words.

Defined results: null and blank text has zero statistics (and fails the base
rules); without labels, or with labels of one class, the list is empty and
only the base rules decide; conflicting labels of one id are all counted;
repeated rows are judged one by one; extra columns stay as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispensa.plans.lineage import materialize

from .common import SPACE_CHARS, col, fresh, remainder, trainable, word_array

SYMBOLS = "#*$%&|<>"  # fixed value
WINDOW = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = ["n_words", "symbols_per_word", "upper_share", "bangs_per_word", "dup_line_share",
              "repeat_share", "mean_word_chars", "distinct_share", "digit_share"]


@dataclass(frozen=True)
class Condition:
    statistic: str
    op: str  # "<=" or ">"
    value: float

    def column(self, where=lambda name: F.col(name)) -> Column:
        c = where(self.statistic)
        return c <= F.lit(self.value) if self.op == "<=" else c > F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.statistic} {self.op} {self.value:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    rejected: int

    def column(self, where=lambda name: F.col(name)) -> Column:
        return reduce(lambda a, b: a & b, [c.column(where) for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + f" -> reject ({self.rejected} of {self.covered})"


def _count(text: Column, chars: str) -> Column:
    """Number of characters of ``chars`` in the text."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` plus one struct column (its name is returned) that holds the
    base counts and the derived statistics of each whole text."""
    w, g, h, m = (fresh(docs.columns, x) for x in ("_words", "_windows", "_hashes", "_marks"))
    stats = fresh([*docs.columns, w, g, h, m], "_stats")
    t = F.coalesce(col(text), F.lit(""))
    # the few characters that are counted, taken out of the text in one pass
    marks = F.regexp_replace(t, r"[^\p{Lu}0-9!#*$%&|<>\x20\x09-\x0D]+", "")
    words = docs.withColumn(w, word_array(col(text))).withColumn(m, marks)
    hashed = words.withColumn(h, F.transform(col(w), lambda x: F.xxhash64(x)))
    # hash of the 5 words from each position on
    hashed = hashed.withColumn(g, F.when(
        F.size(col(w)) >= WINDOW,
        F.transform(F.slice(col(h), F.lit(1), F.size(col(h)) - (WINDOW - 1)), lambda x, i: F.xxhash64(
            x, *[F.get(col(h), i + k) for k in range(1, WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")))
    n = F.size(col(w)).cast("long")
    # positions of windows that occur twice or more: equal neighbours once sorted
    order = F.sort_array(F.transform(col(g), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def twice(rows: Column) -> Column:
        marked = F.transform(rows, lambda e, k: F.when(
            F.coalesce(F.get(rows, k - 1)["x"] == e["x"], F.lit(False))
            | F.coalesce(F.get(rows, k + 1)["x"] == e["x"], F.lit(False)), e["i"]))
        return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1), p + WINDOW) - p))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def covered_of(rows: Column) -> Column:
        # bind the sorted windows once, then the sorted positions once
        return F.aggregate(F.array(twice(rows)), F.lit(0).cast("long"), lambda _, at: covered(at))

    rep = F.when(F.size(F.array_distinct(col(g))) == F.size(col(g)), F.lit(0).cast("long")) \
        .otherwise(F.aggregate(F.array(order), F.lit(0).cast("long"), lambda _, rows: covered_of(rows)))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    counts = {
        "n_words": n,
        "word_chars": F.length(t) - _count(col(m), SPACE_CHARS),
        "n_symbols": _count(col(m), SYMBOLS),
        "n_dup_lines": F.aggregate(F.array(lines), F.lit(0).cast("long"),
                                   lambda _, x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_lines": _count(col(m), "\n") + 1,
        "n_repeat_words": rep,
        "n_distinct": F.size(F.array_distinct(col(h))).cast("long"),
        "n_upper": F.length(F.regexp_replace(col(m), r"\P{Lu}+", "")).cast("long"),
        "n_bangs": _count(col(m), "!"),
        "n_digits": _count(col(m), "0123456789")}
    # plain columns first: fields of a struct would be computed once per use
    names = {k: fresh([*hashed.columns, stats], f"_{k}") for k in counts}
    counted = hashed.select(*[col(c) for c in docs.columns], *[c.alias(names[k]) for k, c in counts.items()])
    s = {k: col(v) for k, v in names.items()}
    words_n, chars = F.greatest(s["n_words"], F.lit(1)), F.greatest(s["word_chars"], F.lit(1))
    derived = {
        "symbols_per_word": s["n_symbols"] / words_n, "upper_share": s["n_upper"] / chars,
        "bangs_per_word": s["n_bangs"] / words_n, "dup_line_share": s["n_dup_lines"] / s["n_lines"],
        "repeat_share": s["n_repeat_words"] / words_n, "mean_word_chars": s["word_chars"] / words_n,
        "distinct_share": s["n_distinct"] / words_n, "digit_share": s["n_digits"] / chars}
    packed = F.struct(*[s[b].alias(b) for b in BASE], *[v.alias(k) for k, v in derived.items()])
    return counted.select(*[col(c) for c in docs.columns], packed.alias(stats)), stats


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (n_repeat_words * 100 > n_words * 20)


def learn(labelled: DataFrame, *, max_rules: int = 12, max_conditions: int = 3, quantiles: int = 24,
          min_cover: int = 5, min_precision: float = 0.9) -> list[Rule]:
    """``labelled``: the STATISTICS as double columns, ``bad`` (boolean) and
    ``part`` ("grow" or "prune").  Returns the ordered reject rules."""
    cuts = _cuts(labelled, quantiles)
    cuts = {k: v for k, v in cuts.items() if v}
    if not cuts:
        return []
    # bin b holds cuts[b-1] < value <= cuts[b]; so "bin <= b" is "value <= cuts[b]"
    binned = labelled.select("bad", "part", *[
        F.when(F.col(k) <= v[0], 0).otherwise(_bin_of(F.col(k), v)).cast("int").alias(k) for k, v in cuts.items()])
    left = materialize(binned, "rule-bins")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        conditions = _grow(left, cuts, max_conditions)
        if not conditions:
            break
        conditions = _prune(left, cuts, conditions)
        mask = _mask(cuts, conditions)
        got = left.agg(F.sum((mask & F.col("bad")).cast("long")), F.sum(mask.cast("long"))).first()
        bad, all_ = int(got[0] or 0), int(got[1] or 0)
        if bad < min_cover or bad < min_precision * all_:
            break
        rules.append(Rule(tuple(conditions), all_, bad))
        left = left.filter(~mask)
    return rules


def _cuts(labelled: DataFrame, quantiles: int) -> dict[str, list[float]]:
    probs = [i / quantiles for i in range(quantiles + 1)]
    got = labelled.groupBy("bad").agg(*[F.percentile_approx(k, probs, 1000).alias(k) for k in STATISTICS]).collect()
    if len(got) < 2:
        return {}
    values = {k: sorted({v for r in got for v in (r[k] or []) if v is not None and math.isfinite(v)}) for k in STATISTICS}
    # between neighbours, so that a threshold does not sit on a training value
    return {k: [(a + b) / 2 for a, b in zip(v, v[1:])] for k, v in values.items()}


def _bin_of(c: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < c))


def _mask(cuts: dict[str, list[float]], conditions: list[Condition]) -> Column:
    def one(c: Condition) -> Column:
        at = cuts[c.statistic].index(c.value)
        return F.col(c.statistic) <= at if c.op == "<=" else F.col(c.statistic) > at
    return reduce(lambda a, b: a & b, [one(c) for c in conditions], F.lit(True))


def _grow(left: DataFrame, cuts: dict[str, list[float]], max_conditions: int) -> list[Condition]:
    conditions: list[Condition] = []
    while len(conditions) < max_conditions:
        rows = left.filter((F.col("part") == "grow") & _mask(cuts, conditions))
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("b")) for k in cuts])).alias("x")
        counts = rows.select("bad", each).groupBy("x.k", "x.b").agg(
            F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n")).collect()
        by: dict[str, dict[int, tuple[int, int]]] = {}
        for r in counts:
            by.setdefault(r["k"], {})[r["b"]] = (r["p"], r["n"])
        if not by:
            break
        some = next(iter(by.values()))
        p_all, n_all = sum(x[0] for x in some.values()), sum(x[1] for x in some.values())
        if p_all == 0 or n_all == 0:
            break
        best: tuple[float, Condition] | None = None
        for k in cuts:
            p = n = 0
            for at, cut in enumerate(cuts[k]):
                dp, dn = by.get(k, {}).get(at, (0, 0))
                p, n = p + dp, n + dn
                for op, pp, nn in (("<=", p, n), (">", p_all - p, n_all - n)):
                    if pp:
                        gain = pp * (math.log2(pp / (pp + nn)) - math.log2(p_all / (p_all + n_all)))
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, Condition(k, op, cut))
        if best is None or best[0] <= 1e-9:
            break
        conditions.append(best[1])
    return conditions


def _prune(left: DataFrame, cuts: dict[str, list[float]], conditions: list[Condition]) -> list[Condition]:
    """The shortest prefix with the best (p - n) / (p + n) on the prune part."""
    rows = left.filter(F.col("part") == "prune")
    sums = []
    for i in range(1, len(conditions) + 1):
        mask = _mask(cuts, conditions[:i])
        sums += [F.sum((mask & F.col("bad")).cast("long")), F.sum((mask & ~F.col("bad")).cast("long"))]
    got = [int(x or 0) for x in rows.agg(*sums).first()]
    worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in zip(got[::2], got[1::2])]
    if max(worth) <= -1.0:
        return conditions
    return conditions[:worth.index(max(worth)) + 1]


def labelled_statistics(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Join narrow statistics rows (doc_id, statistics...) with quality labels;
    only trainable ids take part, those with remainder 4 prune."""
    marks = labels.filter(F.col("quality").isNotNull()).select(
        F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("bad"))
    return stats.filter(trainable(F.col("doc_id"))).join(marks, F.col("doc_id") == F.col("_id")).select(
        *[F.col(k).cast("double").alias(k) for k in STATISTICS], "bad",
        F.when(remainder(F.col("doc_id")) == 4, "prune").otherwise("grow").alias("part"))


def verdict(rules: list[Rule], stats: Column) -> Column:
    """The ordered conditional expression over a statistics struct: true keeps
    the document."""
    at = lambda name: stats[name]
    out = F.when(base_failed(at("n_words"), at("n_repeat_words")), False)
    for r in rules:
        out = out.when(r.column(at), False)
    return out.otherwise(True)


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id and all statistics of ``docs`` as a written table."""
    with_stats, name = with_statistics(docs.select("doc_id", "text"))
    return materialize(with_stats.select("doc_id", col(name).alias("stats")), "rule-stats")


def fit(stats: DataFrame, labels: DataFrame, **how) -> list[Rule]:
    """Learn the list from ``narrow`` rows that the base rules pass."""
    passed = stats.select("doc_id", "stats.*").filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return learn(materialize(labelled_statistics(passed, labels), "rule-labelled"), **how)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed and kept."""
    stats = narrow(docs)
    rules = fit(stats, labels)
    s = F.col("stats")
    return stats.select("doc_id", *[s[b].alias(b) for b in BASE],
                        base_failed(s["n_words"], s["n_repeat_words"]).alias("base_failed"),
                        verdict(rules, s).alias("kept"))


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the base rules and the learned list keep, with the
    columns of ``docs``."""
    rules = fit(narrow(docs), labels)
    with_stats, name = with_statistics(docs)
    # as a generator, not a filter: a filter would be pushed below the
    # statistics and compute them once for each condition
    kept = F.filter(F.array(col(name)), lambda s: verdict(rules, s))
    return with_stats.select(*[col(c) for c in docs.columns], F.explode(kept).alias(name)).drop(name)
