"""Skew-safe running sums (distributed prefix sums).

A plain ``sum(x).over(partitionBy(key).orderBy(o))`` sends every row of a key
to one task; a key holding a third of the data would sort a third of the data
in one task.  Here the rows are range-partitioned on (keys, order) and a block
is the rows of a key in one range partition, so that

1. blocks follow the rows, not the values: sparse ids, common name prefixes
   and hot keys are cut alike, by sampled ranks;
2. per (key, block) totals are a partial/final aggregate (map-side combined);
3. the offset of each block is a window over block totals only (at most as
   many rows per key as there are range partitions), kept where the key began
   in an earlier block: fewer rows than there are blocks, sent to all tasks; and
4. the running value inside a block is a window over at most one range
   partition, plus the block offset.

The ranged rows are written once to the shared folder, so every later step
reads the same blocks and a lost executor recomputes from the files.  The
result equals the single-window running sum exactly (integers and decimals are
summed exactly; no sampling of rows, no cap).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispensa.plans.lineage import materialize
from dispensa.session import ensure_checkpoint_dir

# a key of at most this many rows is one window's work
WINDOW_ROWS = 1 << 18


def _blocked(df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int | None, name: str) -> DataFrame:
    """``df`` written in range partitions of (keys, order), with the number of
    each row's partition."""
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(n, *[F.col(c) for c in (*keys, *order)])
    return materialize(ranged.withColumn(name, F.spark_partition_id()), "prefix-blocks")


def max_key_rows(df: DataFrame, keys: Sequence[str]) -> int:
    """Largest number of rows of one key (one aggregate job, partial/final)."""
    if not keys:
        return int(df.count())
    m = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return int(m or 0)


def _join_blocks(base: DataFrame, offsets: DataFrame, on: Sequence[str]) -> DataFrame:
    """Block offsets onto the rows (null in a key's first block); a null key is
    a key like any other.  The blocks are ranges, so a block but the last holds
    one key at most that goes on in the next: the later blocks of all keys are
    fewer than the blocks, whatever the number of keys."""
    later = offsets.filter(F.col("__before") > 0).drop("__before")
    side = later.select(*[F.col(c).alias(f"__j_{c}") for c in on], *[c for c in later.columns if c not in on])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__j_{c}")) for c in on])
    return base.join(F.broadcast(side), same, "left").drop(*[f"__j_{c}" for c in on])


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 values: dict[str, Column], *, inclusive: bool = True,
                 blocks: int | None = None, key_rows_bound: int | None = None) -> DataFrame:
    """Add one running-sum column per entry of ``values``.

    ``order`` must be unique within a key.  ``inclusive=False`` gives the sum
    over strictly earlier rows.  Null values count as 0.  ``blocks`` is the
    number of range partitions (the session's shuffle partitions by default).

    ``key_rows_bound``: a proven upper bound on the rows of any one key (see
    ``max_key_rows``).  When it is within ``WINDOW_ROWS`` a single window per
    key is as bounded as one block, and the blocks are skipped.
    """
    keys = list(keys)
    order = list(order)
    upper = 0 if inclusive else -1
    if key_rows_bound is not None and keys and key_rows_bound <= WINDOW_ROWS:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, upper)
        out = df
        for name, expr in values.items():
            out = out.withColumn(name, F.coalesce(F.sum(F.coalesce(expr, F.lit(0))).over(w), F.lit(0)))
        return out
    blk = "__blk"
    tmp = {name: f"__v_{name}" for name in values}
    base = df
    for name, expr in values.items():
        base = base.withColumn(tmp[name], F.coalesce(expr, F.lit(0)))
    base = _blocked(base, keys, order, blocks, blk)

    totals = base.groupBy(*keys, blk).agg(*[F.sum(tmp[n]).alias(f"__t_{n}") for n in values])
    w_blocks = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, blk, F.count(F.lit(1)).over(w_blocks).alias("__before"),
        *[F.coalesce(F.sum(f"__t_{n}").over(w_blocks), F.lit(0)).alias(f"__o_{n}") for n in values])

    joined = _join_blocks(base, offsets, [*keys, blk])
    w_rows = Window.partitionBy(*keys, blk).orderBy(*order).rowsBetween(Window.unboundedPreceding, upper)
    out = joined
    for n in values:
        out = out.withColumn(n, F.coalesce(F.col(f"__o_{n}"), F.lit(0))
                             + F.coalesce(F.sum(tmp[n]).over(w_rows), F.lit(0)))
    drop = [blk, *tmp.values(), *[f"__o_{n}" for n in values]]
    return out.drop(*drop)


def number_rows(df: DataFrame, order: Sequence[str], name: str = "rn", *,
                keys: Sequence[str] = (), start: int = 1, blocks: int | None = None) -> DataFrame:
    """Dense 1-based (or ``start``-based) row numbers in ``order`` per key.

    Same plan as ``running_sums`` with value 1, so a global numbering does not
    pull the table into one partition (only one count per block goes there).
    """
    out = running_sums(df, keys, order, {name: F.lit(1).cast("long")}, blocks=blocks)
    if start != 1:
        out = out.withColumn(name, F.col(name) + F.lit(start - 1))
    return out


def running_mins(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], *,
                 inclusive: bool = True, blocks: int | None = None) -> DataFrame:
    """Running minimum per key in ``order`` (nulls ignored; null when no
    earlier value), with the same block plan as ``running_sums``."""
    keys = list(keys)
    order = list(order)
    blk = "__blk"
    tmp = {name: f"__v_{name}" for name in values}
    base = df
    for name, expr in values.items():
        base = base.withColumn(tmp[name], expr)
    base = _blocked(base, keys, order, blocks, blk)
    mins = base.groupBy(*keys, blk).agg(*[F.min(tmp[n]).alias(f"__t_{n}") for n in values])
    w_blocks = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = mins.select(*keys, blk, F.count(F.lit(1)).over(w_blocks).alias("__before"),
                          *[F.min(f"__t_{n}").over(w_blocks).alias(f"__o_{n}") for n in values])
    joined = _join_blocks(base, offsets, [*keys, blk])
    upper = 0 if inclusive else -1
    w_rows = Window.partitionBy(*keys, blk).orderBy(*order).rowsBetween(Window.unboundedPreceding, upper)
    out = joined
    for n in values:
        out = out.withColumn(n, F.least(F.col(f"__o_{n}"), F.min(tmp[n]).over(w_rows)))
    return out.drop(blk, *tmp.values(), *[f"__o_{n}" for n in values])


def running_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], *,
                 inclusive: bool = True, blocks: int | None = None) -> DataFrame:
    """Running last non-null value per key in ``order`` (null when there is no
    earlier one), with the same block plan as ``running_sums``.

    A value is a state function: null leaves the state as it is, any other
    value sets it.  Such functions compose to their last non-null one, so a
    block is summed up by one value, carried over the blocks of its key, and
    a key with a third of all rows is never gathered.
    """
    keys = list(keys)
    order = list(order)
    blk = "__blk"
    tmp = {name: f"__v_{name}" for name in values}
    base = df
    for name, expr in values.items():
        base = base.withColumn(tmp[name], expr)
    base = _blocked(base, keys, order, blocks, blk)
    place = F.struct(*[F.col(c) for c in order])
    composed = base.groupBy(*keys, blk).agg(
        *[F.max_by(tmp[n], F.when(F.col(tmp[n]).isNotNull(), place)).alias(f"__t_{n}") for n in values])
    w_blocks = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    carried = composed.select(
        *keys, blk, F.count(F.lit(1)).over(w_blocks).alias("__before"), *[F.last(f"__t_{n}", ignorenulls=True).over(w_blocks).alias(f"__o_{n}") for n in values])
    out = _join_blocks(base, carried, [*keys, blk])
    upper = 0 if inclusive else -1
    w_rows = Window.partitionBy(*keys, blk).orderBy(*order).rowsBetween(Window.unboundedPreceding, upper)
    for n in values:
        out = out.withColumn(n, F.coalesce(F.last(tmp[n], ignorenulls=True).over(w_rows), F.col(f"__o_{n}")))
    return out.drop(blk, *tmp.values(), *[f"__o_{n}" for n in values])
