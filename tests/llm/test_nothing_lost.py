"""Passages of rows without a doc_id and of texts that share one; repeated rows dealt over groups."""

import random

from pyspark.sql import functions as F
from test_llm import BYTE_VOCABULARY, docs

from fieldjobs.llm import line_dedup, packing


def test_passages_of_null_and_shared_ids_equal_brute_force(spark):
    r = random.Random(8)
    word = lambda: f"w{r.randrange(9000)}"
    passages = [[word() for _ in range(n)] for n in (50, 60, 90)]
    texts = []
    for i in [1, 2, 3, 7, 7, 7, 9, 9, *[None] * 12]:
        w = []
        for p in r.sample(passages, r.randrange(1, 3)):
            w += [word() for _ in range(r.randrange(1, 25))] + p
        texts.append((i, " ".join(w)))
    texts += [texts[-1], (2**63 - 2, "few words"), (None, texts[0][1]), (None, None), (None, "")]
    hashes = {x["text"]: x["h"] for x in docs(spark, texts).select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = lambda x: (x[0] is None, x[0] or 0, (hashes[x[1]] & (2**32 - 1)) | 1)
    seen, want = {}, {}
    for i, t in sorted(set(texts), key=order):
        w = (t or "").split()
        dead = set()
        for a in range(len(w) - 49):
            at = seen.setdefault(tuple(w[a : a + 50]), (i, t, a))
            if at[:2] != (i, t) or a >= at[2] + 50:
                dead |= set(range(a, a + 50))
        whole = any(t == x[1] and order(x) < order((i, t)) and x[0] != i for x in texts) and len(w) >= 50
        want[i, t] = [] if whole else [x for j, x in enumerate(w) if j not in dead]
    got = line_dedup.dedup_lines(docs(spark, texts).withColumn("was", F.col("text"))).collect()
    assert len(got) == len(texts)
    assert all((x["text"] or "").split() == want[x["doc_id"], x["was"]] for x in got)
    assert sum(len(v) < len((t or "").split()) for (i, t), v in want.items() if i is None) >= 10 and any(len(want[i, t]) < len(t.split()) for i, t in texts[3:8])


def test_repeated_rows_are_dealt_over_groups(spark):
    rows = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = packing.pack(rows, BYTE_VOCABULARY, spread=1_000)
    assert got.count() == 30_000
    # each place once
    n = got.select("sequence_id", "offset").distinct().count()
    length = got.first()["length"]
    assert n == 30_000 and got.agg(F.count_distinct("sequence_id")).first()[0] == -(-30_000 // (1024 // length))
    pieces = packing.token_pieces(rows, BYTE_VOCABULARY).withColumn("own", F.monotonically_increasing_id())
    sizes = [x["count"] for x in pieces.groupBy(F.pmod(F.xxhash64("own"), F.lit(30))).count().collect()]
    assert len(sizes) == 30 and max(sizes) < 1_500
