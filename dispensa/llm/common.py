"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, as a Java/Python
# character class and as the characters themselves.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
# Copies of one row that a task makes at a time.
BLOCK = 1024
# Most rows of a counted table of hashes or keys (8 or 16 bytes) that is broadcast.
MAX_BROADCAST_KEYS = 200_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column of the table is called so (names
    compare without case, as Spark resolves them)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def word_array(text: Column) -> Column:
    """The words (runs without white space) of a text; null or blank: none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_CLASS + "+", -1))


def word_count(text: Column) -> Column:
    """Number of words of a text (long); null or blank: 0."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE_CLASS + "+", -1))).cast("long")


def row_hash(docs: DataFrame, seed: int) -> Column:
    """xxhash64 of the seed and all columns (one that holds a map: its JSON)."""
    return F.xxhash64(F.lit(seed), *[F.to_json(F.struct(col(f.name))) if "map<" in f.dataType.simpleString()
                                     else col(f.name) for f in docs.schema.fields])


def repeat_rows(grouped: DataFrame, n: str, index: str) -> DataFrame:
    """Each row ``n`` times, numbered 1 to n in ``index`` (in place of ``n``).
    A row of more than ``BLOCK`` copies is dealt over the tasks in blocks, so
    no task makes all copies of one row and no array holds all their numbers."""
    rest = [col(c) for c in grouped.columns if c != n]
    one = F.lit(1).cast("long")
    few = grouped.filter(col(n) <= BLOCK).select(*rest, F.explode(F.sequence(one, col(n))).alias(index))
    start = fresh(grouped.columns, "_start")
    parts = int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = grouped.filter(col(n) > BLOCK) \
        .withColumn(start, F.explode(F.sequence(one, col(n), F.lit(BLOCK).cast("long")))).repartition(parts)
    last = F.least(col(n), col(start) + (BLOCK - 1))
    return few.unionByName(blocks.select(*rest, F.explode(F.sequence(col(start), last)).alias(index)))


def remainder(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; null id: null."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts))


def held_out(doc_id: Column) -> Column:
    """True for the rows a model never learns from (null id: false)."""
    return F.coalesce(remainder(doc_id) == 0, F.lit(False))


def trainable(doc_id: Column) -> Column:
    """Rows a model may learn from: an id whose remainder is not 0."""
    return F.coalesce(remainder(doc_id) != 0, F.lit(False))


def bounded_sample(rows: DataFrame, doc_id: Column, bound: int, total: int, seed: int) -> DataFrame:
    """A repeatable sample of about ``bound`` of ``total`` rows: those whose
    seeded hash of the id lies below bound / total (all rows if they fit)."""
    if total <= bound:
        return rows
    cut = int(bound / total * (1 << 32))
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 32)) < cut)


def bounded_rows(rows: DataFrame, marks: DataFrame, class_col: str, bound: int, seed: int) -> DataFrame:
    """At most ``bound`` different (doc_id, text) rows of each class: ``rows``
    (doc_id, text) whose id ``marks`` (_id, class_col) gives a class; the
    columns are text, class_col and _n (rows that repeat it).  A seeded hash of
    id and text picks them, so an id on a third of all rows adds its different
    texts, not its rows, and the bound holds whatever repeats."""
    # copies are counted by hash first: texts are only read again for what is chosen
    keyed = rows.select("doc_id", F.xxhash64("text").alias("_h"))
    counted = keyed.groupBy("doc_id", "_h").agg(F.count("*").alias("_n")) \
        .join(marks.distinct(), F.col("doc_id") == F.col("_id")).drop("_id")
    draw = F.xxhash64(F.lit(seed), "doc_id", "_h")
    classes = [r[0] for r in counted.select(class_col).distinct().collect()]  # a row per class
    chosen = None
    for x in sorted(classes):
        some = counted.filter(F.col(class_col) == x).orderBy(draw, "doc_id", "_h").limit(bound)
        chosen = some if chosen is None else chosen.unionByName(some)
    if chosen is None:
        return rows.limit(0).select("text", F.lit(None).cast(marks.schema[class_col].dataType).alias(class_col),
                                    F.lit(0).cast("long").alias("_n"))
    chosen = chosen.select(F.col("doc_id").alias("_d"), F.col("_h").alias("_c"), class_col, "_n")
    # the chosen keys are few, a proven bound (classes * bound); one text of each key
    near = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_d")) & (F.xxhash64("text") == F.col("_c")))
    return near.groupBy("_d", "_c", class_col, "_n").agg(F.first("text").alias("text")).select("text", class_col, "_n")


class Memo(dict):
    """Results remembered in two generations, at most ``size`` keys each: when
    one is full, the older one goes.  Keys over 40 characters are not kept."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def missing(self, keys: Iterable) -> list:
        """Brings keys of the older generation into this one; returns the
        keys that neither has."""
        out = []
        for k in keys:
            if k not in self:
                got = self.old.get(k)
                if got is None:
                    out.append(k)
                else:
                    self[k] = got
        return out

    def settle(self, long_keys: Iterable = ()) -> None:
        """Called between batches: forgets long keys, turns the generation."""
        for k in long_keys:
            if len(k) > 40:
                self.pop(k, None)
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


def slices(texts: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """(start, length) of consecutive parts of a column of texts, each of
    about ``most`` bytes (a longer text is a part of its own)."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)]):
        if e > s:
            yield s, e - s


def space_units(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts (no nulls) split at each space: the distinct units, the unit
    codes of all texts in a row, and each text's bounds in them."""
    parts = pc.split_pattern(texts.cast(pa.large_string()), " ")
    bounds = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), bounds - bounds[0]
