"""Best-two-fit packing of token sequences.

A document's pieces are at most ``capacity`` long, so all that packing needs to know is
how many pieces there are of each length: at most ``capacity`` numbers, however many
documents. The plan is made from these numbers. A pattern of lengths is filled greedily
with the largest that fit, then its smallest piece gives way to two others that fit the
gap more tightly, and the pattern is repeated as often as its lengths allow. Pieces get
their places by rank within their length, counted in two steps so that a length that a
third of all pieces share is spread over tasks.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from fieldjobs.llm.bpe import SPACE, Merges, byte_alphabet, character_classes, expanded, ranges
from fieldjobs.llm.recovery import cut
from fieldjobs.llm.words import groups, hash_words, numbered, text_bytes

CAPACITY = 1024
END_ID = 2


class Encoder:
    """Ids of whole batches under a byte-level vocabulary. Runs of characters between single spaces are encoded once per batch."""

    def __init__(self, path: str, classes: tuple[list[int], list[int]]):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        symbols = lambda t: tuple(byte[c] for c in t)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.merges = Merges({symbols(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}, [(symbols(a), symbols(b)) for a, b in spec["model"]["merges"]])
        self.classes = np.repeat(np.array(classes[1], np.uint8), classes[0]) & 3

    def runs(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts that lie end to end from the offsets ``at`` (none empty), and the offsets of each one's."""
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        place = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))
        kind = self.classes[points]
        new = np.zeros(len(points) + 1, bool)  # a text's first character
        new[np.searchsorted(place, at)] = True
        before = np.concatenate([[SPACE], kind[:-1]])
        open_, end = kind != SPACE, np.append(kind[1:], SPACE)  # and the kind behind
        start = open_ & ((kind != before) | new[:-1])
        # an apostrophe that opens a run of marks takes one of these endings along, but not behind a space
        behind_space = np.concatenate([[False], points[:-1] == 0x20]) & ~new[:-1]
        q = np.flatnonzero(start & (points == ord("'")) & ~behind_space)
        one, two = (np.concatenate([points, [0, 0]])[q + i] for i in (1, 2))
        apart = np.concatenate([new, [True, True]])
        short = np.isin(one, [ord(c) for c in "stmd"]) & ~apart[q + 1]
        pair = np.isin(one << 8 | two, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]) & (two < 256) & ~apart[q + 1] & ~apart[q + 2]
        start[q[short | pair] + 1] = False
        after = np.concatenate([q[short] + 2, q[pair] + 3])
        after = after[after < len(points)]
        start[after] |= open_[after]
        # a space right before other characters belongs to them; of other white space before them the last stands alone
        last = ~open_ & (end != SPACE) & ~new[1:]
        joined = np.flatnonzero(last & (points == 0x20))
        start[joined + 1] = False
        start |= last | (~open_ & ((before != SPACE) | new[:-1]))
        first = np.flatnonzero(start)
        begins = place[first]
        ids, counts = self.merges.encode(data, begins, np.append(begins[1:], len(data)), False)
        return ids, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(begins, at)]

    def _with_special(self, text: str) -> np.ndarray:
        parts, begin = [np.zeros(0, np.int64)], 0
        for m in [*self.specials.finditer(text), None]:
            part = np.frombuffer(text[begin : m.start() if m else len(text)].encode(), np.uint8)
            if len(part):
                parts.append(self.runs(part, np.array([0, len(part)]))[0])
            if m:
                parts.append(np.array([self.special[m[0]]]))
                begin = m.end()
        return np.concatenate(parts)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the offsets of each text's."""
        data, at = text_bytes(texts)
        whole = np.array([bool(t) and (t[0] == " " or t[-1] == " " or "  " in t or self.specials.search(t) is not None) for t in texts.to_pylist()], bool)
        # of the other texts, what stands between single spaces can be encoded apart: a space goes with what follows it
        space = data == 0x20
        space[ranges(at[:-1][whole], np.diff(at)[whole])] = False
        first = at[:-1][np.diff(at) > 0]
        cut = space.copy()
        cut[first] = True
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, len(data)))
        one, which = numbered(data, start, length, hash_words(data, start, length))
        runs = data[ranges(start[one], length[one])]
        if any(s.encode() in runs.tobytes() for s in self.special):
            odd = {i: self._with_special(data[a : a + n].tobytes().decode()) for i, (a, n) in enumerate(zip(start[one].tolist(), length[one].tolist())) if self.specials.search(data[a : a + n].tobytes().decode())}
            plain = np.array([i for i in range(len(one)) if i not in odd], np.int64)
            made, ends = self.runs(data[ranges(start[one][plain], length[one][plain])], np.concatenate([[0], np.cumsum(length[one][plain])])) if len(plain) else (np.zeros(0, np.int64), np.zeros(1, np.int64))
            parts = {**odd, **{int(i): made[a:b] for i, a, b in zip(plain, ends, ends[1:])}}
            pool, ends = np.concatenate([parts[i] for i in range(len(one))]), np.concatenate([[0], np.cumsum([len(parts[i]) for i in range(len(one))])])
        elif len(one):
            pool, ends = self.runs(runs, np.concatenate([[0], np.cumsum(length[one])]))
        else:
            pool, ends = np.zeros(0, np.int64), np.zeros(1, np.int64)
        ids, offsets = expanded(pool, ends, which)
        return ids, offsets[np.searchsorted(start, at)]


#: Bytes of text encoded at a time, about.
AT_ONCE = 1_000_000


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path, character_classes())


def _pieces(shared: Broadcast[Encoder], capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            for part in groups(batch.column("text"), AT_ONCE):
                ids, at = encoder.batch(batch.column("text")[part])
                n = np.diff(at) + 1
                written = np.insert(ids, at[1:], END_ID).astype("<u4").tobytes()
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = ranges(np.zeros(len(n), np.int64), pieces)
                head = ((n - 1) % capacity + 1)[row]  # the first piece may be short
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                begin = 4 * ((at[:-1] + np.arange(len(n)))[row] + start)
                view = memoryview(written)
                crc = [zlib.crc32(view[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist())]
                made = [pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part].take(pa.array(row)), *made], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and an end id, cut so that only the first piece may be short."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # made once and sent, since an executor has more workers than cores, and making it takes each of them several times its size
    shared = docs.sparkSession.sparkContext.broadcast(_encoder(path))
    return src.mapInArrow(_pieces(shared, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots ``(length, rank from, how many, first sequence, offset)`` for so many pieces of each length."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    used, slots, sequence = [0] * (capacity + 1), [], 0

    def largest(most: int) -> int:
        most = min(most, capacity)
        while most > 0 and left[most] <= taken.count(most):
            most -= 1
        return most

    top = capacity
    while True:
        while top > 0 and left[top] == 0:
            top -= 1
        if top == 0:
            return slots
        taken: list[int] = []
        gap = capacity
        while gap and (n := largest(gap)):
            taken.append(n)
            gap -= n
        while gap and len(taken) > 1:
            least = taken.pop()
            room, best = gap + least, (least, 0)
            a = largest(room - 1)
            while 2 * a > best[0] + best[1] and a:  # the larger of the two, from the top
                taken.append(a)
                b = largest(min(a, room - a))
                taken.pop()
                if b and a + b > sum(best):
                    best = (a, b)
                if sum(best) == room:
                    break
                a = largest(a - 1)
            if not best[1]:
                taken.append(least)
                break
            taken += sorted(best, reverse=True)
            taken.sort(reverse=True)
            gap = capacity - sum(taken)
        times = min(left[n] // taken.count(n) for n in set(taken))
        offset = 0
        for n in taken:
            slots.append((n, used[n], times, sequence, offset))
            used[n] += times
            left[n] -= times
            offset += n
        sequence += times


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, spread: int = 0) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is its end id alone. Repeated rows are packed each; null doc_ids
    are packed like others. An empty table gives no row. Other columns are ignored.
    """
    spark = docs.sparkSession
    # a number that equal rows don't share, written so that it stays the same when a task runs again
    pieces = cut(token_pieces(docs, path, capacity).withColumn("own", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    total = sum(counts.values())
    slots = plan(counts, capacity)
    # each length is dealt to as many groups as keep a group under a small share of all pieces
    most = spread or max(2_000, total // (16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    groups = spark.createDataFrame([(n, -(-c // most)) for n, c in counts.items()], "length long, groups long")
    dealt = pieces.join(F.broadcast(groups), "length").withColumn("group", F.pmod(F.xxhash64("own"), F.col("groups")))
    sizes = dealt.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "group", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "group").orderBy("doc_id", "piece", "own")) - 1
    ranked = dealt.withColumn("place", place).join(sizes, ["length", "group"]).withColumn("rank", F.col("before") + F.col("place"))
    # the plan's size is bounded by the capacity, not by the data
    slot = spark.createDataFrame(slots, "length long, first long, times long, sequence long, offset long")
    out = ranked.join(F.broadcast(slot), "length").where("rank >= first and rank < first + times")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
