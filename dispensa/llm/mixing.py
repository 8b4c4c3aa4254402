"""Mixing sources to target weights by Pareto order sampling (DataFrame
functions only).

Sizes are word counts.  Sources, by code point with null last, get the weights
5, 2, 1, repeating, and share ``budget`` times all words; a target stops at
``cap`` times its source's size and the excess is reshared by weight until
none is above (the water level of the capped shares).

A source with target / size = 1.3 takes every document once (the certain whole
copies) and then a sample of fixed size 0.3 x its words.  The sample is a
Pareto order sample: with u uniform per document and inclusion probability p,
documents rank by (u / (1 - u)) / (p / (1 - p)) and the first ones are taken
until the words are reached, cut where it is nearest; then the one document
whose addition or removal comes nearest to what is still missing is switched.
u is made of an md5 of the seed and doc_id, so reruns agree.  Where that md5
occurs more than once (an id, or a text without id, on several rows), each of
these rows has one of its own instead, made of it, of a hash of all columns
and of the row's copy number among identical rows (from counts), so every row
draws, is cut and is switched alone.

No source meets in one task: the rank cut is found from a histogram of ranks
(2^16 bins per source, partial sums before the shuffle), and only the bin that
holds the cut is ordered.  The decision then is a comparison with one row per
source; that table is broadcast only after counting its rows.

Defined results: null or blank text has size 0 and takes 0 words; a source
without words has target 0; a null source is a source of its own (last); a
null doc_id draws by its text; repeated rows draw one by one, each is a
document of its own (a -0.0 in one may come back as 0.0, its equal).  Extra columns stay as they are.  Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dispensa.plans.lineage import materialize

from .common import MAX_BROADCAST_KEYS, col, fresh, repeat_rows, row_hash, word_count

WEIGHTS = (5, 2, 1)
BINS = 1 << 16
MAX_BROADCAST_SOURCES = 50_000


def draw_key(seed: int, doc_id: Column, text: Column) -> Column:
    """32 hex digits per document, from the seed and doc_id (null: the text)."""
    name = F.coalesce(F.concat(F.lit("id:"), doc_id.cast("string")), F.concat(F.lit("text:"), text), F.lit("none"))
    return F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))


def _uniform(key: Column) -> Column:
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def _rank(u: Column, p: Column) -> Column:
    return (u / (1.0 - u)) / (p / (1.0 - p))


def _bin(q: Column) -> Column:
    return F.floor(q / (1.0 + q) * float(BINS)).cast("long")


def targets(per_source: DataFrame, budget: float = 1.5, cap: float = 2.0,
            weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``per_source``: source, source_size (one row each).  Adds weight and
    target.  The windows run over one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).cast("long")
    s = per_source.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * float(cap))
    s = s.withColumn("_fill", F.col("_cap") / F.col("weight"))
    # raise the level: sources reach their caps in the order of cap / weight
    order = Window.orderBy("_fill", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_pos", F.row_number().over(order)) \
        .withColumn("_left", F.sum("source_size").over(everything) * float(budget)
                    - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) \
        .withColumn("_open", F.sum("weight").over(after))
    s = s.withColumn("_level", F.col("_left") / F.col("_open"))
    s = s.withColumn("_free", F.min(F.when(F.col("_cap") > F.col("_level") * F.col("weight"),
                                           F.struct("_pos", "_level"))).over(everything))
    target = F.when(F.col("_free").isNull() | (F.col("_pos") < F.col("_free._pos")), F.col("_cap")) \
        .otherwise(F.col("_free._level") * F.col("weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def thin(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                       draw_key(seed, F.col("doc_id"), F.col("text")).alias("key"), row_hash(docs, 0).alias("same"))


def repeated_keys(rows: DataFrame) -> DataFrame:
    """The keys (16 bytes each) that more than one row of ``thin`` has."""
    return materialize(rows.groupBy(F.unhex("key").alias("_key")).agg(F.count("*").alias("_n"))
                       .filter("_n > 1").select("_key"), "mix-repeats")


def own_keys(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """``rows`` (key, same and others) with a key for each row alone instead of
    key and same; a key that one row has stays.  ``repeats``: repeated_keys."""
    found = repeats.count()
    if not found:
        return rows.drop("same")
    side = F.broadcast(repeats) if found <= MAX_BROADCAST_KEYS else repeats
    met = F.unhex(rows["key"]) == side["_key"]
    several = rows.join(side, met, "left_semi").groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    several = repeat_rows(several, "_n", "_copy").withColumn(
        "key", F.md5(F.concat_ws(":", "key", F.col("same").cast("string"), F.col("_copy").cast("string")).cast("binary")))
    return rows.join(side, met, "left_anti").drop("same").unionByName(several.drop("same", "_copy"))


def _keyed(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows to plan with, and the keys that were repeated."""
    rows = materialize(thin(docs, seed), "mix-rows")
    repeats = repeated_keys(rows)
    return (materialize(own_keys(rows, repeats), "mix-keys") if repeats.count() else rows.drop("same")), repeats


def plan(rows: DataFrame, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: how many whole copies all documents get, and which
    documents get one more.  ``rows``: source, size, key (see ``own_keys``)."""
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = targets(per_source, budget, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = shares.withColumn("copies", F.floor(ratio + 1e-9).cast("long")) \
        .withColumn("p", F.greatest(ratio - F.col("copies"), F.lit(0.0)))
    shares = shares.withColumn("p", F.when(F.col("p") > 1e-9, F.col("p")).otherwise(0.0)) \
        .withColumn("rest", F.when(F.col("p") > 0, F.col("target") - F.col("copies") * F.col("source_size"))
                    .otherwise(0.0))
    shares = materialize(shares, "mix-shares")
    drawn = _attach(rows, shares.filter("p > 0"), ["p", "rest"], "inner") \
        .withColumn("q", _rank(_uniform(F.col("key")), F.col("p"))).withColumn("bin", _bin(F.col("q")))

    # the bin in which each source's running words reach the rest
    bins = drawn.groupBy("source", "bin", "rest").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = bins.withColumn("upto", F.sum("words").over(run)).filter(F.col("upto") >= F.col("rest")) \
        .groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("cut")) \
        .select("source", F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("cut_before"))
    cuts = materialize(cuts, "mix-cuts")

    # the row inside that bin after which the sum is nearest to the rest
    inside = _attach(drawn, cuts, ["cut_bin", "cut_before"], "inner").filter(F.col("bin") == F.col("cut_bin"))
    peers = Window.partitionBy("source").orderBy("q", "key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.col("cut_before") + F.sum("size").over(peers))
    nearest = inside.groupBy("source").agg(
        F.min(F.struct(F.abs(F.col("upto") - F.col("rest")).alias("off"), "q", "key", "upto")).alias("n"))
    nearest = cuts.select(F.col("source").alias("_s"), "cut_bin", "cut_before") \
        .join(nearest, F.col("_s").eqNullSafe(F.col("source")), "left") \
        .join(shares.select(F.col("source").alias("_t"), "rest"), F.col("_s").eqNullSafe(F.col("_t")))
    none = F.col("n").isNull() | (F.abs(F.col("cut_before") - F.col("rest")) <= F.col("n.off"))
    nearest = materialize(nearest.select(
        F.col("_s").alias("source"), "cut_bin",
        F.when(none, F.lit(-1.0)).otherwise(F.col("n.q")).alias("cut_q"),
        F.when(none, F.lit("")).otherwise(F.col("n.key")).alias("cut_key"),
        (F.col("rest") - F.when(none, F.col("cut_before")).otherwise(F.col("n.upto"))).alias("missing")), "mix-cut-rows")

    # the one document whose switch comes nearest to what is still missing
    judged = _attach(drawn, nearest, ["cut_bin", "cut_q", "cut_key", "missing"], "inner") \
        .withColumn("taken", _selected())
    off = F.abs(F.abs(F.col("missing")) - F.col("size"))
    switch = judged.filter((F.col("taken") == (F.col("missing") < 0)) & (off < F.abs(F.col("missing")))) \
        .groupBy("source").agg(F.min(F.struct(off.alias("off"), "q", "key")).alias("w"))
    out = shares.select(F.col("source").alias("_s"), "source_size", "weight", "target", "copies", "p") \
        .join(nearest, F.col("_s").eqNullSafe(F.col("source")), "left").drop("source")
    out = out.join(switch, F.col("_s").eqNullSafe(F.col("source")), "left").drop("source")
    return materialize(out.select(F.col("_s").alias("source"), "source_size", "weight", "target", "copies", "p",
                                  "cut_bin", "cut_q", "cut_key", F.col("w.key").alias("switch_key")), "mix-plan")


def _selected() -> Column:
    return (F.col("bin") < F.col("cut_bin")) | (
        (F.col("bin") == F.col("cut_bin")) & ((F.col("q") < F.col("cut_q"))
                                              | ((F.col("q") == F.col("cut_q")) & (F.col("key") <= F.col("cut_key")))))


def _attach(rows: DataFrame, per_source: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Join per-source columns onto rows by source (null matches null).  The
    small side is broadcast only when its counted rows are within the bound."""
    side = per_source.select(F.col("source").alias("_src"), *columns)
    if side.count() <= MAX_BROADCAST_SOURCES:
        side = F.broadcast(side)
    return rows.join(side, F.col("source").eqNullSafe(F.col("_src")), how).drop("_src")


def mix(rows: DataFrame, plan_rows: DataFrame) -> DataFrame:
    """Adds source_size, target and copies (0, 1, 2...) to each row."""
    base = plan_rows.withColumnRenamed("copies", "_whole")
    j = _attach(rows, base, ["source_size", "target", "_whole", "p", "cut_bin", "cut_q", "cut_key", "switch_key"], "inner")
    j = j.withColumn("q", F.when(F.col("p") > 0, _rank(_uniform(F.col("key")), F.col("p")))) \
        .withColumn("bin", _bin(F.col("q")))
    more = F.coalesce(_selected(), F.lit(False)) != F.coalesce(F.col("key") == F.col("switch_key"), F.lit(False))
    return j.withColumn("copies", F.col("_whole") + F.when((F.col("p") > 0) & more, 1).otherwise(0)) \
        .drop("_whole", "p", "cut_bin", "cut_q", "cut_key", "switch_key", "q", "bin")


def mix_sizes(docs: DataFrame, seed: int = 7, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken."""
    rows, _ = _keyed(docs, seed)
    out = mix(rows, plan(rows, budget, cap))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies",
                      (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 7, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The documents of the mix, each row as often as the mix takes it, with
    the columns of ``docs``."""
    rows, repeats = _keyed(docs, seed)
    chosen = plan(rows, budget, cap)
    boxed, columns = fresh([], "row"), docs.columns
    packed = docs.select(F.struct(*[col(c) for c in columns]).alias(boxed), F.col("source").alias("source"),
                         draw_key(seed, F.col("doc_id"), F.col("text")).alias("key"), row_hash(docs, 0).alias("same"))
    out = mix(own_keys(packed, repeats), chosen).filter(F.col("copies") > 0)
    out = out.select(boxed, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.select(*[F.col(boxed).getField(c).alias(c) for c in columns])
