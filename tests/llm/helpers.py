"""Small tables with the awkward cases that every operator must take."""

import zlib

from pyspark.sql import types as T

# documents, with extra columns whose names clash with those that operators add
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("shard", T.StringType()),
    T.StructField("slot", T.IntegerType()), T.StructField("_stats", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("fp", T.LongType())])

LONG = " ".join(f"w{i % 977} zahl{i}" for i in range(20_000))
WORDS = "the quick brown fox jumps over the lazy dog while seven black cats sleep near a warm old stove".split()


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), "s", 1, None, "k", 0)


AWKWARD = [
    row(1, None), row(2, ""), row(3, " \t\n "), row(None, "no id here but some words to read"), row(None, None, None, None),
    row(4, "same text in two rows of one id that repeat"), row(4, "same text in two rows of one id that repeat"),
    row(5, LONG, None, "b"), row(6, " ".join(WORDS), "en", None), row(7, " ".join(WORDS), "en", "c"),
    row(8, "ÀÉÎ straße 数字 \U0001f600 x²", "de", "ü"), row(9, "... !!! 123", "en", "b"), row(10, "one"),
    row(11, "a b c d e a b c d e a b c d e f"), row(12, "#$% " * 50), row(-3, "line one\nline one\n\nline two")]


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def crc_mod5(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5
