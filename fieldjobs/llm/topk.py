"""Exact top-k inner products by block-at-a-time pruning.

Candidates lie in blocks of consecutive ids. A block keeps its forward index (the
vectors) and, of each component, the largest and smallest value. For a query, the sum
over components of the larger of q*max and q*min bounds every score in the block. Each
query first scores the blocks with its highest bounds, which gives it a score that its
k-th can't fall below. All blocks are then visited in the order of their bounds, until
the next bound is below that score or below the k-th found so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fieldjobs.llm.recovery import cut

BLOCK = 256
#: Blocks that one task holds at a time, and queries that meet them at a time.
GROUP_BLOCKS = 32
QUERY_CHUNK = 2048
#: Blocks that each query scores first.
FIRST_BLOCKS = 3


def quantised(vectors: DataFrame, scale: float = 1024.0) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each component; vectors that are null or hold null or non-finite values are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten(), np.int64).reshape(-1, width)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut rows that come sorted by width and id into blocks."""
    for batch in batches:
        widths = np.asarray(batch.column("width"))
        ends = [*(np.flatnonzero(np.diff(widths)) + 1), len(widths)]
        begin = 0
        for end in map(int, ends):
            for i in range(begin, end, BLOCK):
                part = batch.slice(i, min(BLOCK, end - i))
                m = _matrix(part.column("v"), int(widths[i]))
                ids = np.asarray(part.column("vec_id"))
                yield pa.RecordBatch.from_pydict(
                    {"width": pa.array([int(widths[i])], pa.int32()), "ids": pa.array([ids]), "forward": pa.array([m.ravel()], pa.list_(pa.int64())), "high": pa.array([m.max(0)] if m.size else [[]], pa.list_(pa.int64())), "low": pa.array([m.min(0)] if m.size else [[]], pa.list_(pa.int64()))}
                )
            begin = end


def _product(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floating point while every partial sum fits 53 bits, else in 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q.astype(np.float64) @ m.T.astype(np.float64)).astype(np.int64)
    return np.stack([(row[None, :] * m).sum(1) for row in q]) if len(q) else np.zeros((0, len(m)), np.int64)


def _bounds(q: np.ndarray, blocks: pa.Table, width: int) -> np.ndarray:
    return _product(np.maximum(q, 0), _matrix(blocks.column("high"), width)) + _product(np.minimum(q, 0), _matrix(blocks.column("low"), width))


def _best_blocks(key, queries: pa.Table, blocks: pa.Table) -> pa.Table:
    """Of each query, the blocks of the group with the highest bounds."""
    ids, names, bounds = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if queries.num_rows and blocks.num_rows:
        width = int(key[0].as_py())
        bound = _bounds(_matrix(queries.column("v"), width), blocks, width)
        best = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS]
        ids = np.repeat(np.asarray(queries.column("query")), best.shape[1])
        names, bounds = np.asarray(blocks.column("block"))[best].ravel(), np.take_along_axis(bound, best, 1).ravel()
    return pa.table({"query": ids, "block": names, "bound": bounds})


def _search(k: int):
    def run(key, queries: pa.Table, blocks: pa.Table) -> pa.Table:
        out = {"query": [], "query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and blocks.num_rows:
            width = int(key[0].as_py())
            ids = np.asarray(queries.column("query_id"))
            q = _matrix(queries.column("v"), width)
            members = [np.asarray(x.values) for x in blocks.column("ids")]
            forward = [np.asarray(x.values, np.int64).reshape(-1, width) for x in blocks.column("forward")]
            bound = _bounds(q, blocks, width)
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
            kth = np.asarray(queries.column("floor"))  # no less than this is wanted, from the start on
            order = np.argsort(-bound, axis=1, kind="stable")
            kth = kth.copy()
            for step in range(len(members)):
                now = order[:, step]
                alive = bound[np.arange(len(ids)), now] >= kth  # a tie may hold a smaller id
                if not alive.any():
                    break
                for b in np.unique(now[alive]):
                    mine = np.flatnonzero(alive & (now == b))
                    scores = _product(q[mine], forward[b])
                    for i, s in zip(mine, scores):
                        ok = (members[b] != ids[i]) & (s >= kth[i])
                        if not ok.any():
                            continue
                        v, s = np.concatenate([best[i][0], members[b][ok]]), np.concatenate([best[i][1], s[ok]])
                        keep = np.lexsort((v, -s))[:k]
                        best[i] = v[keep], s[keep]
                        if len(keep) == k:
                            kth[i] = max(kth[i], s[keep][-1])
            out["query"], out["query_id"] = (np.repeat(x, [len(v) for v, _ in best]) for x in (np.asarray(queries.column("query")), ids))
            out["vec_id"] = np.concatenate([v for v, _ in best])
            out["score"] = np.concatenate([s for _, s in best])
        return pa.table({n: pa.array(x, pa.int64()) for n, x in out.items()})

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024.0) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k best other vectors.

    Queries are the rows whose vec_id is a multiple of ``every``. Ties go to the smaller
    vec_id. A vector only meets vectors of its own width. Query rows that share a vec_id
    but not their vector are each answered, apart from one another; equal ones are one
    query. A query meets no row of its own vec_id; a repeated candidate row may fill
    several ranks. Rows with a null id, vector or component, or a non-finite component,
    take no part. An empty table gives no row. The query set meets all rows in blocks, so
    the work is (queries x rows) at most and what pruning leaves of it.
    """
    all_rows = cut(quantised(vectors, scale).withColumn("width", F.size("v")))
    ordered = all_rows.repartitionByRange("width", "vec_id").sortWithinPartitions("width", "vec_id")
    blocks = cut(ordered.mapInArrow(_blocks, "width int, ids array<long>, forward array<long>, high array<long>, low array<long>").withColumn("block", F.xxhash64("width", "ids", "forward")))
    n_blocks = blocks.count()
    queries = cut(all_rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "width", "v").distinct().withColumn("query", F.monotonically_increasing_id()))
    groups, chunks = max(1, -(-n_blocks // GROUP_BLOCKS)), max(1, -(-queries.count() // QUERY_CHUNK))
    keys = ["width", "chunk", "group"]
    grouped = blocks.withColumn("group", F.pmod("block", F.lit(groups)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    chunked = queries.withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int"))
    spread = lambda q: q.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found_in = "query long, query_id long, vec_id long, score long"
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")

    bounds = spread(chunked).groupBy(*keys).cogroup(grouped.drop("ids", "forward").groupBy(*keys)).applyInArrow(_best_blocks, "query long, block long, bound long")
    first = bounds.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))).where(F.col("nth") <= FIRST_BLOCKS).drop("nth", "bound")
    least = -(2**63)
    asked = cut(chunked.join(first, "query").withColumn("floor", F.lit(least)))
    by_block = ["width", "chunk", "block"]
    wanted = cut(asked.select(*by_block).distinct())
    scored = asked.groupBy(*by_block).cogroup(blocks.join(wanted, ["width", "block"]).groupBy(*by_block)).applyInArrow(_search(k), found_in)
    floors = scored.withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") == k).select("query", F.col("score").alias("floor"))
    asked = spread(chunked.join(cut(floors), "query", "left").withColumn("floor", F.coalesce("floor", F.lit(least))))
    found = asked.groupBy(*keys).cogroup(grouped.groupBy(*keys)).applyInArrow(_search(k), found_in)
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
