"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text is cut at sentence ends and line breaks, so where a chunk ends depends on its
own characters. A chunk's identifier is a 64-bit hash, verified over all chunks: should
two different chunks share a hash, the identifier also takes the chunk's own digest.
Texts are equal when their ordered identifier lists are, so whole texts never move:
chunks move once, partially aggregated, and from then on lists of a few numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldjobs.llm.recovery import cut

#: At least 600 characters, then up to the next sentence end or line break, at most 4,000.
CHUNK = r"(?s).{600,3999}?[.!?\n]|.{1,4000}"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null texts count as empty, and empty texts are equal to each other. Of equal texts
    the largest doc_id stays; ``group_size`` counts rows, so a repeated row counts
    again and each copy of the staying row is kept. A group without any doc_id has a
    null keep_id and keeps none. Other columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cut_up = src.select(chunks(F.col("text")).alias("chunks"))
    table = cut_up.select(F.explode("chunks").alias("chunk")).groupBy(F.xxhash64("chunk").alias("id")).agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    clashes = cut(table.where("lo <> hi").select("id"))

    recipes = src.select("doc_id", F.sha2("text", 256).alias("text_sha256"), chunks(F.col("text")).alias("chunks"))
    if clashes.isEmpty():
        listed = recipes.select("doc_id", "text_sha256", F.transform("chunks", lambda c: F.xxhash64(c).cast("string")).alias("recipe"))
    else:
        rows = recipes.withColumn("row", F.monotonically_increasing_id())
        rows = cut(rows.select("row", "doc_id", "text_sha256", "chunks"))
        each = rows.select("row", F.posexplode("chunks").alias("pos", "chunk")).withColumn("id", F.xxhash64("chunk"))
        each = each.join(clashes.withColumn("clash", F.lit(True)), "id", "left")
        name = F.when(F.col("clash"), F.concat_ws("-", "id", F.sha2("chunk", 512))).otherwise(F.col("id").cast("string"))
        lists = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", name.alias("name")))).getField("name").alias("recipe"))
        listed = rows.join(lists, "row", "left").select("doc_id", "text_sha256", F.coalesce("recipe", F.array().cast("array<string>")).alias("recipe"))
    listed = cut(listed)
    groups = listed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    out = listed.join(groups, "recipe")
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")
