"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records into buckets that fit in memory, by a seeded hash
of the row and its copy number (1 to n among n identical rows); the number of
buckets follows the total size of all columns.  Pass 2 puts
each bucket in a fixed order, shuffles it with a seeded Fisher-Yates pass and
writes it with its positions.  A record's place in the whole shuffle is its
bucket's offset plus its position there, and the shards cut that order.

Law ``rows``: shard counts differ by at most one, and slots count from 0
without a gap.  (Equal texts are not held together: their ids differ, so the
scatter spreads a large group of copies over all buckets and shards.)

The buckets are a table in the shared folder, so a lost executor costs only
its unfinished buckets; the shuffle is repeatable for the same rows, seed and
bucket size, whatever the partitions were.  Only one count per bucket is
gathered (total size / bucket size rows).

Copy numbers come from counts, not from a window: rows are grouped by all
columns, counted and made again n times, so the numbers are the same however
the rows arrive.  Row hashes are counted first, and where at most 200,000 of
them repeat, only the rows that have these are grouped (the rest has number 1
in either case).

Defined results: a null text has size 1; null ids scatter by the rest of the row; rows
that repeat are interchangeable, all kept and scattered one by one (a -0.0 in
them may come back as 0.0, its equal); fewer rows than shards leave the
last shards empty; an empty table gives no rows.  Extra columns are carried
along; a column of ``docs`` that is called shard or slot is kept out of the
way by naming the new ones (see ``shuffle_documents``).  A single text larger
than a bucket makes a bucket of its own size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dispensa.plans.lineage import materialize

from .common import MAX_BROADCAST_KEYS, col, fresh, repeat_rows, row_hash

LAW = "rows"


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniformly random order of 0..n-1: swap each place, from the last
    down, with a place at or below it."""
    order = np.arange(n)
    draws = (np.random.default_rng(seed).random(max(n - 1, 0)) * np.arange(n, 1, -1)).astype(np.int64)
    items = order.tolist()
    for i, j in zip(range(n - 1, 0, -1), draws.tolist()):
        items[i], items[j] = items[j], items[i]
    return np.array(items, dtype=np.int64)


def _shuffler(bucket: str, tie: str, position: str, seed: int):
    def run(table: pa.Table) -> pa.Table:
        number = table.column(bucket)[0].as_py()
        # rows come in the order of arrival; fix it by the seeded hash, then shuffle
        fixed = table.sort_by([(tie, "ascending")])
        order = fisher_yates(fixed.num_rows, (seed * 1_000_003 + number) & 0x7FFFFFFFFFFFFFFF)
        out = fixed.take(pa.array(order))
        return out.set_column(out.schema.get_field_index(position), position,
                              pa.array(np.arange(out.num_rows, dtype=np.int64)))
    return run


def _row_bytes(schema: T.StructType) -> Column:
    """About the bytes of a row in memory, all columns counted."""
    size = F.lit(64).cast("long")
    for f in schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(col(f.name)), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(col(f.name)))), F.lit(0))
        else:
            size = size + 8
    return size


def number_copies(docs: DataFrame, seed: int, index: str) -> DataFrame:
    """Adds ``index``, 1 to n among n identical rows."""
    h, n = (fresh([*docs.columns, index], x) for x in ("_hash", "_n"))
    hashed = docs.withColumn(h, row_hash(docs, seed))
    repeats = materialize(hashed.groupBy(h).agg(F.count("*").alias(n)).filter(col(n) > 1).select(h), "shard-repeats")
    found = repeats.count()
    if not found:
        return docs.withColumn(index, F.lit(1).cast("long"))
    several = docs
    if found <= MAX_BROADCAST_KEYS:
        several = hashed.join(F.broadcast(repeats), h, "left_semi").drop(h)
    several = several.groupBy(*[col(c) for c in docs.columns]).agg(F.count("*").alias(n))
    numbered = repeat_rows(several, n, index)
    if found <= MAX_BROADCAST_KEYS:
        single = hashed.join(F.broadcast(repeats), h, "left_anti").drop(h)
        numbered = numbered.unionByName(single.withColumn(index, F.lit(1).cast("long")))
    return numbered


def shuffle_documents(docs: DataFrame, shards: int = 16, seed: int = 11, bucket_bytes: int = 16 << 20,
                      shard: str = "shard", slot: str = "slot") -> DataFrame:
    """All columns of ``docs`` plus the shard (0..shards-1) and slot of each
    row.  If ``docs`` has columns of those names, the new ones get a trailing
    underscore."""
    spark = docs.sparkSession
    shard, slot = fresh(docs.columns, shard), fresh(docs.columns, slot)
    bucket, tie, position = (fresh(docs.columns, x) for x in ("_bucket", "_tie", "_position"))
    total = docs.select(F.sum(_row_bytes(docs.schema))).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    copy = fresh(docs.columns, "_copy")
    numbered = number_copies(docs, seed, copy)
    # the scatter uses the hash's low part, the fixed order inside a bucket all of it
    scattered = numbered.withColumn(tie, F.xxhash64(row_hash(docs, seed), col(copy))).drop(copy) \
        .withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 1), col(tie)), F.lit(buckets)).cast("long")) \
        .withColumn(position, F.lit(0).cast("long"))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in scattered.schema.fields])
    shuffled = scattered.groupBy(col(bucket)).applyInArrow(_shuffler(bucket, tie, position, seed), schema)
    written = materialize(shuffled, "shard-buckets")

    b, offset, everything = (fresh(docs.columns, x) for x in ("_b", "_offset", "_all"))
    sizes = written.groupBy(col(bucket).alias(b)).agg(F.count("*").alias("n"))
    before = Window.orderBy(col(b)).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(col(b), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(offset),
                           F.sum("n").over(every).alias(everything))
    if buckets <= 100_000:  # one row of 3 numbers per bucket; beyond, a plain join
        offsets = F.broadcast(offsets)
    placed = written.join(offsets, col(bucket) == col(b))
    # the first `extra` shards hold one row more than the others
    place = col(offset) + col(position)
    least, extra = F.floor(col(everything) / shards).cast("long"), F.pmod(col(everything), F.lit(shards))
    in_long = place < extra * (least + 1)
    rest = place - extra * (least + 1)
    per = F.greatest(least, F.lit(1))
    number = F.when(in_long, F.floor(place / (least + 1))).otherwise(extra + F.floor(rest / per))
    where = F.when(in_long, F.pmod(place, least + 1)).otherwise(F.pmod(rest, per))
    return placed.select(*[col(c) for c in docs.columns], number.cast("int").alias(shard), where.cast("long").alias(slot))
