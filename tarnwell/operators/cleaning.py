"""Page texts without the lines that recur from page to page."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import dominant, trim_ws
from .legs import small


def _lines(pages: DataFrame) -> DataFrame:
    lines = pages.select("doc", "page", F.posexplode(F.split("text", "\n", -1)).alias("n", "raw"))
    return lines.withColumn("line", trim_ws(F.col("raw")))


def recurring(pages: DataFrame, fraction: float = 0.5) -> DataFrame:
    """(doc, line, pages): lines that are on at least two pages and ``fraction`` of a document's pages (doc, page, text).

    Hashes are counted first, without the lines, which for the most part don't recur; then only lines whose hash recurs often enough are counted themselves."""
    total = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("total"))
    enough = F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("total") * fraction))
    line = F.transform(F.split("text", "\n", -1), trim_ws)
    hashes = pages.select("doc", F.explode(F.array_distinct(F.transform(line, lambda x: F.xxhash64(x)))).alias("_hash"))
    often = hashes.groupBy("doc", "_hash").agg(F.count(F.lit(1)).alias("pages")).where("pages >= 2").join(total, "doc").where(enough).select("doc", "_hash")
    lines = pages.select("doc", "page", F.explode(F.array_distinct(line)).alias("line")).where("line <> ''").withColumn("_hash", F.xxhash64("line"))
    on = lines.join(small(often), ["doc", "_hash"], "left_semi").groupBy("doc", "line").agg(F.countDistinct("page").alias("pages"))
    return on.join(total, "doc").where(enough).select("doc", "line", "pages")


def without_recurring(pages: DataFrame, fraction: float = 0.5) -> DataFrame:
    """The pages (doc, page, text) without their documents' recurring lines; a page of nothing else keeps an empty text, one without a text is left out. Lines are dropped
    where the page is read: what travels are the recurring lines, a row a document, broadcast if they are few."""
    gone = recurring(pages, fraction).groupBy("doc").agg(F.collect_list("line").alias("_gone"))
    rest = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains(F.col("_gone"), trim_ws(x)))
    kept = pages.where("text is not null").select("doc", "page", "text").join(small(gone), "doc", "left")
    return kept.select("doc", "page", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")).alias("text"))


def clean_documents(pages: DataFrame, script: str, threshold: float = 0.5, fraction: float = 0.5) -> DataFrame:
    """(doc, text): lines in which the script prevails, of pages without recurring lines, in order."""
    lines = _lines(without_recurring(pages, fraction)).where((F.col("line") != "") & dominant(F.col("line"), script, threshold))
    told = F.transform(F.sort_array(F.collect_list(F.struct("page", "n", "line"))), lambda x: x["line"])
    return pages.select("doc").distinct().join(lines.groupBy("doc").agg(F.array_join(told, "\n").alias("text")), "doc", "left").withColumn("text", F.coalesce("text", F.lit("")))

