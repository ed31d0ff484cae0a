"""Near-duplicate documents from bottom-k sketches.

1. Every document's set of five-word shingle hashes is sketched by its k smallest
   values. Documents with equal sets form one class; a class is represented once.
2. Inverted lists hold retained values. Two sketches that can agree on 75 % share at
   least ``need`` of their values, so each class posts only its ``size - need + 1``
   rarest values: a passage that many documents share is then posted only by
   documents made of little else.
3. In each list all members meet a few pivots, one of them the smallest set, which a
   shared passage fills most, and the links found are joined into components, so a list of thousands of near copies costs a few pairs per member.
   Members of lists that are still in different components then meet by prefixes of
   their full sets, rarest values first, which loses no link between components: one
   class of each component first, then all whose components still differ.
4. A pair is kept when the bottom-k sample of the union, read off both sketches,
   estimates enough overlap, and linked when the full sets confirm it, in which words
   are told apart byte by byte.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fieldjobs.llm.graph import components
from fieldjobs.llm.recovery import cut
from fieldjobs.llm.words import few_at_a_time, shingle_sets, verified_shingle_sets

#: Values a sketch retains.
K = 64
#: Of the K smallest of a union at 75 % similarity 48 are shared on average; fewer than this, with a chance of about 1e-8.
LEAST_SHARED = 28
PIVOTS = 3


def _sketches(k: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_a_time(batches, "text"):
            sizes, classes, kept = [], [], []
            for s in shingle_sets(batch.column("text"), shingle):
                sizes.append(len(s))
                classes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                kept.append(s[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(kept, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "class", "sketch"],
            )

    return run


def _jaccard(shingle: int, similarity: float):
    percent = round(similarity * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_a_time(batches, "text_a", "text_b"):
            linked = []
            for x, y in verified_shingle_sets(batch.column("text_a"), batch.column("text_b"), shingle):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _estimate(k: int):
    """Share of the k smallest values of the union that both sketches hold, in SQL."""
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    return F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union)) / F.size(union)


def _full_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_a_time(batches, "text"):
            sets = [s.view(np.int64) for s in shingle_sets(batch.column("text"), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("root"), pa.array(sets, pa.list_(pa.int64()))], ["class", "root", "all"])

    return run


def _held(members: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Per class its component, the size of its full set, and the values that other classes hold too, rarest first."""
    sets = members.join(texts, "class").mapInArrow(_full_sets(shingle), "class binary, root binary, all array<long>")
    sets = cut(sets.withColumn("n", F.size("all")))
    each = sets.select("class", "root", "n", F.explode("all").alias("value"))
    shared = each.groupBy("value").count().where("count > 1")
    held = each.join(shared, "value").groupBy("class").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("count", "value"))).alias("common"))
    return cut(held)


def _exact_candidates(held: DataFrame, similarity: float, one_each: bool) -> DataFrame:
    """All pairs of classes in different components that can be linked, by prefixes of full sets.

    Of a linked pair the smaller set shares at least 2t/(1+t) of its values and the
    larger at least t, so in any common order of values, here the rarest first, two
    prefixes meet. Values that only one class holds meet nobody but take their places.
    A pair shares no more values than either side holds from the first meeting on, so
    a meeting with too few left is no candidate. ``one_each``: only one class of each
    component meets the others in a value, which joins most components before all meet.
    """
    posted = lambda least: F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1 - (F.col("n") - F.size("common"))
    rest = (F.col("size") - F.col("pos")).alias("rest")  # values from this one on that others hold

    def side(least: float, x: str) -> DataFrame:
        places = held.where(posted(least) > 0).select("class", "root", "n", F.size("common").alias("size"), F.posexplode(F.slice("common", 1, posted(least).cast("int"))).alias("pos", "c"))
        posts = places.select("root", "c.value", rest, "n", "class")
        if one_each:
            posts = posts.groupBy("root", "value").agg(F.max(F.struct("rest", "n", "class")).alias("r")).select("root", "value", "r.*")
        return posts.toDF(f"root_{x}", "value", f"rest_{x}", f"n_{x}", x)

    once = F.struct("n_a", "a") < F.struct("n_b", "b")
    alike = F.col("n_a") >= F.col("n_b") * similarity - 1e-9
    enough = F.least("rest_a", "rest_b") * (1 + similarity) >= (F.col("n_a") + F.col("n_b")) * similarity - 1e-9
    met = side(2 * similarity / (1 + similarity), "a").join(side(similarity, "b"), "value").where((F.col("root_a") != F.col("root_b")) & once & alike & enough)
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.75, k: int = K) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of non-white-space bytes, A-Z lower-cased. Null and empty texts have
    no shingles and no links. Repeated rows are each returned and share a component. A
    null doc_id takes no part: its component_id is null and kept false. Other columns
    of ``docs``, whatever their names, are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    src = src.withColumn("text_hash", F.xxhash64("text"))
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()),
        T.StructField("class", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType())),
    ])
    sketched = cut(src.mapInArrow(_sketches(k, shingle), schema))

    known = sketched.where("class is not null and doc_id is not null")
    classes = cut(known.groupBy("class").agg(F.min(F.struct("doc_id", "text_hash", "sketch", "n_shingles")).alias("r")).select("class", "r.*"))
    least_shared = max(1, math.floor(LEAST_SHARED * k / K * similarity / 0.75))
    size = F.size("sketch")
    need = F.when(size < F.ceil(F.lit(similarity * k)), F.ceil(size * similarity)).otherwise(F.least(F.lit(least_shared), size))
    values = classes.select("class", "n_shingles", (size - need + 1).alias("post"), size.alias("held"), F.explode("sketch").alias("value"))
    shared = values.groupBy("value").count().where("count > 1")
    common = values.join(shared, "value").groupBy("class").agg(
        F.first("n_shingles").alias("n"), F.first("post").alias("post"), F.first("held").alias("held"), F.array_sort(F.collect_list(F.struct("count", "value"))).alias("common")
    )
    room = F.col("post") - (F.col("held") - F.size("common"))  # values that no other class holds come first
    posted = common.where(room > 0).select("class", "n", F.explode(F.slice("common", 1, room)).alias("c")).select("class", "n", "c.value")
    posted = cut(posted)
    lists = posted.groupBy("value").count().where("count > 1").select("value")
    posted = cut(posted.join(lists, "value"))

    met = posted.select("class").distinct()
    texts = cut(
        src.join(classes.join(met, "class", "left_semi").select("class", "doc_id", "text_hash"), ["doc_id", "text_hash"])
        .select("class", "text").dropDuplicates(["class"])
    )
    sketches = classes.select("class", "sketch")

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda df, x, what: df.select(F.col("class").alias(x), F.col(what).alias(f"{what}_{x}"))
        near = pairs.join(side(sketches, "a", "sketch"), "a").join(side(sketches, "b", "sketch"), "b")
        near = cut(near.where(_estimate(k) >= least_shared / k).select("a", "b"))
        both = near.join(side(texts, "a", "text"), "a").join(side(texts, "b", "text"), "b")
        return cut(both.mapInArrow(_jaccard(shingle, similarity), "a binary, b binary"))

    pivots = [F.min(F.struct("n", "class"))["class"], *(F.min_by("class", F.xxhash64("class", F.lit(i))) for i in range(PIVOTS))]
    heads = posted.groupBy("value").agg(F.array_distinct(F.array(*pivots)).alias("pivots"))
    star = posted.join(heads, "value").select("class", F.explode("pivots").alias("pivot"))
    star = star.select(F.greatest("class", "pivot").alias("a"), F.least("class", "pivot").alias("b")).where("a <> b").distinct()
    star = cut(star)
    links = confirmed(star)
    found = components(links)

    placed = posted.join(found, posted["class"] == found["node"], "left").select("value", "class", F.coalesce("root", "class").alias("root"))
    placed = cut(placed)
    open_lists = placed.groupBy("value").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("value")
    left = cut(placed.join(open_lists, "value"))
    held, tested = _held(left.select("class", "root").distinct(), texts, shingle), star
    for one_each in (True, False):
        now = held.join(found, held["class"] == found["node"], "left").select("class", F.coalesce(found["root"], "class").alias("root"), "n", "common")
        rest = cut(_exact_candidates(now, similarity, one_each).join(tested, ["a", "b"], "left_anti"))
        more = confirmed(rest)
        found, tested = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), tested.union(rest)

    roots = classes.join(found, classes["class"] == found["node"], "left").select("class", F.coalesce("root", "class").alias("root"), "doc_id")
    smallest = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = cut(roots.join(smallest, "root").select("class", "component_id"))
    out = sketched.select("doc_id", "n_shingles", "class").join(ids, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
