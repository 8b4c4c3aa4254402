"""Page text assembled from recognised text lines.

Input: one row per recognised line ``(name, line_no, text)``.  Page files
with an image extension (case-insensitive) are kept; pages are numbered
1, 2, ... in file-name order; empty lines are dropped; the page text is its
lines joined with a newline, whitespace-trimmed; ``n_chars`` counts its
characters.  Lines are gathered per page (a page is one document); the page
numbering is a distributed prefix count, not a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispensa.plans.prefix import number_rows

IMAGE_EXT = ["jpg", "jpeg", "png", "bmp"]   # fixed values: accepted image extensions
# whitespace removed around a page's text (the Unicode whitespace set)
WS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
      r"\x{202F}\x{205F}\x{3000}]")


def page_text(lines: DataFrame) -> DataFrame:
    ext = F.lower(F.regexp_extract(F.col("name"), r"\.([^.]*)$", 1))
    li = lines.filter(ext.isin(*IMAGE_EXT)).filter(F.col("text").isNotNull() & (F.col("text") != ""))
    pages = lines.filter(ext.isin(*IMAGE_EXT)).select("name").distinct()
    joined = li.groupBy("name").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))),
                                 lambda x: x["text"]), "\n").alias("__t"))
    p = pages.join(joined, "name", "left")
    p = number_rows(p, ["name"], name="page_no")
    text = F.regexp_replace(F.coalesce(F.col("__t"), F.lit("")), f"^{WS}+|{WS}+$", "")
    return p.select("page_no", "name", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))


def page_total(pages: DataFrame) -> DataFrame:
    """Total characters over all pages (one row)."""
    return pages.agg(F.coalesce(F.sum("n_chars"), F.lit(0)).cast("long").alias("total_chars"),
                     F.count(F.lit(1)).alias("n_pages"))
