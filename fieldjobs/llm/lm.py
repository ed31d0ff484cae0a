"""Deleted interpolation: a bigram model mixed by context-frequency buckets.

Documents are dealt to blocks by a hash. A block asks for the counts of the distinct
words and word pairs it holds, and says how often its training documents hold them. The
requests meet by key range, where the counts of the whole corpus are added up, and each
block gets its answers in the order it asked, so that keys travel once and answers are
bare numbers. The mixture weights of each bucket of context counts are learned by
expectation-maximisation over training tokens that are held out of their own counts
(each count less the token itself), and all texts are scored with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldjobs.llm.recovery import cut
from fieldjobs.llm.words import mix, word_hashes

_U = np.uint64
END = _U(0x5851F42D4C957F2D)
#: Characters that a block holds, and distinct keys that a key range holds, about.
BLOCK_CHARS, RANGE_KEYS = 4_500_000, 400_000
#: Bytes of a key that travel besides its range: words whole, pairs in part (two pairs share one with a chance of 2^-54 and less).
WORD_BYTES, PAIR_BYTES = 8, 6
#: Contexts are put in buckets by the power of two of their count; all beyond the last share it.
BUCKETS = 24
ROUNDS, SETTLED = 15, 1e-4


def _planes(a: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit numbers, byte by byte, so that shuffle files compress."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplaned(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


class _Block:
    """The tokens of a block's documents and their distinct words and pairs."""

    def __init__(self, table: pa.Table):
        h, at = word_hashes(table.column("text"))
        self.sizes = np.diff(at) + 1
        words = np.insert(h, at[1:], END)
        before = np.roll(words, 1)
        before[:1] = END  # a text follows an end
        self.kinds = [np.unique(words, return_inverse=True), np.unique(mix(mix(before + _U(1)) + words) >> _U(2), return_inverse=True)]
        self.trains = np.repeat(np.asarray(table.column("trains")), self.sizes)

    def keys(self, kind: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys as they travel, and each token's place among them."""
        keys, which = self.kinds[kind]
        if kind == 0:
            return keys, which
        # only PAIR_BYTES below the range's bits travel: keys equal in those are one key
        low = keys << _U(2) >> _U(64 - bits - 8 * PAIR_BYTES)
        short, again = np.unique(low, return_inverse=True)
        return short, again[which]


def _ranges(keys: np.ndarray, kind: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """Number, begin and end of each range that holds any of the sorted keys."""
    number = (keys >> _U(64 - bits if kind == 0 else 8 * PAIR_BYTES)).astype(np.int64)
    begins = np.flatnonzero(np.diff(number, prepend=-1))
    return zip(number[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(keys)])


def _requests(bits: int):
    def run(table: pa.Table) -> pa.Table:
        block, rows = _Block(table), []
        name = table.column("block")[0].as_py()
        for kind, width in ((0, WORD_BYTES), (1, PAIR_BYTES)):
            keys, which = block.keys(kind, bits)
            counts = np.bincount(which[block.trains], minlength=len(keys))
            rows += [(2 * r + kind, name, _planes(keys[a:b], width), _planes(counts[a:b], 4)) for r, a, b in _ranges(keys, kind, bits)]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["place", "block", "keys", "counts"])

    return run


def _answers(table: pa.Table) -> pa.Table:
    place = table.column("place")[0].as_py()
    width = PAIR_BYTES if place % 2 else WORD_BYTES
    order = np.argsort(np.asarray(table.column("block")), kind="stable").tolist()
    asked = [_unplaned(table.column("keys")[i].as_py(), width) for i in order]
    counts = np.concatenate([_unplaned(table.column("counts")[i].as_py(), 4) for i in order])
    _, first, which = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
    totals = np.bincount(which, weights=counts).astype(np.int64)
    cuts = np.cumsum([0, *map(len, asked)])
    # of words in training texts, each is credited to the first block that asks for it
    new = np.zeros(len(which), np.int64)
    new[first] = totals > 0
    given = totals[which]
    rows = [(place, table.column("block")[i].as_py(), _planes(given[a:b], 5), int(new[a:b].sum()) if place % 2 == 0 else 0) for i, a, b in zip(order, cuts, cuts[1:])]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["place", "block", "given", "new"])


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, kind))


def _counted(bits: int, kind: pa.DataType):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(docs)
        given = sorted(zip(answers.column("place").to_pylist(), answers.column("given").to_pylist()))
        per_token = []
        for which in (0, 1):
            all_counts = np.concatenate([_unplaned(g, 5) for p, g in given if p % 2 == which]).astype(np.int64)
            per_token.append(all_counts[block.keys(which, bits)[1]])
        new = np.zeros(docs.num_rows, np.int64)
        new[0] = sum(answers.column("new").to_pylist())
        return pa.table(
            [docs.column("doc_id").combine_chunks(), docs.column("fold").combine_chunks(), pa.array(new), _lists(per_token[0], block.sizes, kind), _lists(per_token[1], block.sizes, kind)],
            ["doc_id", "fold", "new", "words", "pairs"],
        )

    return run


def _tokens(batch: pa.RecordBatch, n_train: int):
    """Per token: its count, its pair's count, the count of the word before it (an end, at the start); and the texts' sizes."""
    sizes = np.diff(np.asarray(batch.column("words").offsets))
    words, pairs = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in ("words", "pairs"))
    before = np.roll(words, 1)
    if len(sizes):
        before[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = n_train
    return words, pairs, before, sizes


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Few texts at a time, as a batch of them unpacks to several arrays of all their tokens."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(np.maximum(count, 0).astype(np.float64))[1], BUCKETS - 1)


def _expectation(weights: np.ndarray, n_train: int, total: int, vocabulary: int):
    """Sums, by bucket, of each component's share in the held-out tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = np.zeros((BUCKETS, 3))
        for batch in _slices(batches):
            words, pairs, before, _ = _tokens(batch, n_train)
            words, pairs, before = words - 1, pairs - 1, before - 1  # the token is held out of its own counts
            b = _bucket(before)
            part = weights[b] * np.stack([np.where(before > 0, pairs / np.maximum(before, 1), 0), words / max(total - 1, 1), np.full(len(words), 1 / (vocabulary + 1))], 1)
            part /= part.sum(1, keepdims=True)
            for c in range(3):
                shares[:, c] += np.bincount(b, weights=part[:, c], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(BUCKETS), 3), pa.int32()), pa.array(np.tile(np.arange(3), BUCKETS), pa.int32()), pa.array(shares.ravel())], ["bucket", "component", "share"])

    return run


def _score(weights: np.ndarray, n_train: int, total: int, vocabulary: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words, pairs, before, sizes = _tokens(batch, n_train)
            w = weights[_bucket(before)]
            p = w[:, 0] * np.where(before > 0, pairs / np.maximum(before, 1), 0) + w[:, 1] * words / max(total, 1) + w[:, 2] / (vocabulary + 1)
            ends = np.cumsum(sizes)
            summed = lambda x: np.add.reduceat(x, ends - sizes) if len(sizes) else np.zeros(0)
            base = summed(np.log10(words + 1.0)) - sizes * np.log10(total + vocabulary + 1.0)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.asarray(batch.column("fold")) == held), pa.array(sizes.astype(np.int64)), pa.array(summed((words > 0).astype(np.int64)).astype(np.int64)),
                 pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(summed(np.log10(p)))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score_texts(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A row trains unless crc32(doc_id as text) mod ``folds`` is ``held``; the tokens of all
    training rows teach the weights. Null texts count as
    empty (one token, the end); a null doc_id as the empty string. Repeated rows each
    count and are each scored. Without training rows every token has the same
    probability. An empty table gives no row. Other columns are ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    src = src.withColumn("fold", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds).cast("long")).withColumn("trains", F.col("fold") != held)
    chars = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    bits = max(2, int(np.ceil(np.log2(max(1, chars / 12 / RANGE_KEYS)))))  # at most a pair to every six bytes, half of them new
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks, 20_000))
    dealt = src.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks))).repartition(parts, "block")
    # no count is above the number of bytes and ends
    kind, wide = (pa.int32(), "int") if chars + src.count() < 2**31 else (pa.int64(), "bigint")
    requests = dealt.groupBy("block").applyInArrow(_requests(bits), "place long, block long, keys binary, counts binary")
    answers = requests.groupBy("place").applyInArrow(_answers, "place long, block long, given binary, new long")
    counted = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_counted(bits, kind), f"doc_id long, fold long, new long, words array<{wide}>, pairs array<{wide}>")
    counted = cut(counted)

    trains = F.col("fold") != held
    got = counted.agg(F.sum("new"), F.sum(F.when(trains, F.size("words"))), F.count(F.when(trains, 1))).first()
    vocabulary, total, n_train = (int(x or 0) for x in got)
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    weights[0] = 0, 0.8, 0.2  # nothing follows a word that was never seen
    lessons = counted.where(trains).select("words", "pairs")
    for _ in range(ROUNDS if total > 1 else 0):
        sums = lessons.mapInArrow(_expectation(weights, n_train, total, vocabulary), "bucket int, component int, share double")
        shares = np.full((BUCKETS, 3), 1e-3)
        for r in sums.groupBy("bucket", "component").agg(F.sum("share").alias("share")).collect():  # 3 numbers a bucket
            shares[r["bucket"], r["component"]] += r["share"]
        shares[0, 0] = 0
        new = shares / shares.sum(1, keepdims=True)
        # a bucket without tokens keeps its weights
        new = np.where(shares.sum(1, keepdims=True) > 1, new, weights)
        moved, weights = np.abs(new - weights).max(), new
        if moved < SETTLED:
            break
    return counted.mapInArrow(_score(weights, n_train, total, vocabulary, held), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
