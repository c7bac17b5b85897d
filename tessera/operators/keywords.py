"""Which keywords a text contains, for keyword lists of any length.

A keyword stands in an index under one of its runs of ``GRAM`` characters (all of it, if it is shorter): the one that fewest keywords have.
A text meets the keywords of the runs it contains, each once, and what it meets is looked for in the text itself. So a
text is compared to few keywords, not to all, no keyword list has to fit the plan or the driver, and the result is that of all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import written

GRAM = 3


def _grams(chars: Column, n: int) -> Column:
    """All runs of ``n`` elements of an array of characters, joined."""
    at = F.sequence(F.lit(0), F.size(chars) - n)
    return F.when(F.size(chars) >= n, F.transform(at, lambda i: F.concat(*(F.get(chars, i + k) for k in range(n))))).otherwise(F.array().cast("array<string>"))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def contained(texts: DataFrame, keywords: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``<id_col>, keyword`` for each row of ``texts`` and each of the different ``keywords(keyword)`` that its text contains, case aside.

    ``id_col`` tells the rows apart. Null and empty keywords are in no text, null texts contain none. A keyword comes as it is
    given; where two differ by case alone, both come.
    """
    keys = keywords.select("keyword").where(F.length("keyword") > 0).distinct().withColumn("low", F.lower("keyword"))
    runs = keys.select("keyword", "low", _chars(F.col("low")).alias("c")).select("keyword", "low", F.least(F.size("c"), F.lit(GRAM)).alias("n"), "c")
    runs = runs.withColumn("gram", F.explode(F.array_distinct(F.concat(*(F.when(F.col("n") == n, _grams(F.col("c"), n)).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1))))))
    often = runs.groupBy("gram").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("keyword").orderBy("often", "gram"))  # as many rows as a keyword has characters
    index, _ = written(runs.join(often, "gram").withColumn("place", place).where("place = 1").select("keyword", "low", "gram"), "keywords")
    sizes = [r["n"] for r in index.select(F.char_length("gram").alias("n")).distinct().collect()]  # GRAM of them at most
    if not sizes:
        return texts.select(id_col).limit(0).withColumn("keyword", F.lit(""))
    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    found = rows.select("id", _chars(F.col("text")).alias("c"))
    found = found.select("id", F.explode(F.array_distinct(F.concat(*(_grams(F.col("c"), n) for n in sizes)))).alias("gram"))
    met = found.join(index, "gram").groupBy("id").agg(F.collect_list(F.struct("keyword", "low")).alias("met"))
    hits = rows.join(met, "id").select("id", F.explode(F.filter("met", lambda m: F.col("text").contains(m["low"]))).alias("hit"))
    return hits.select(F.col("id").alias(id_col), F.col("hit.keyword").alias("keyword"))


def mapped(items: DataFrame, mapping: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Specified only: ``items`` with the ``keyword`` and the ``target`` (a sheet, a group of slides) that ``mapping(keyword, target)`` gives them:
    the longest keyword inside the item's text wins, then the first by its letters; of the targets of one keyword the smallest.
    Items that no keyword covers come with nulls, to be reported as unmapped. Columns of these names are replaced.
    """
    targets = mapping.where(F.length("keyword") > 0).groupBy("keyword").agg(F.min("target").alias("target"))
    hits = contained(items, targets, id_col, text_col)
    best = hits.groupBy(id_col).agg(F.min_by("keyword", F.struct(-F.char_length("keyword"), "keyword")).alias("keyword"))
    return items.drop("keyword", "target").join(best.join(targets, "keyword"), id_col, "left")


def unmapped(mapped_items: DataFrame) -> DataFrame:
    """The items of ``mapped`` that nothing covers."""
    return mapped_items.where("keyword is null").drop("keyword", "target")
