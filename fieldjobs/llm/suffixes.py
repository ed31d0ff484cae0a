"""Repeated byte strings, by suffix arrays of shards.

Equal strings must meet in one shard. Of each string of ``size`` bytes the gram with the
smallest hash is its anchor, so equal strings have equal anchors. Strings that share an
anchor place lie side by side, so what moves is one stretch of bytes for each place of an
anchor that the corpus holds more than once. Anchors are dealt to shards.

A shard's stretches are laid end to end in the order of their documents. Their suffixes
are sorted by prefix doubling: by 8 bytes first, then by 16, 32 and so on up to ``size``,
each time by the ranks of both halves, and only where some are still equal. Suffixes that
share ``size`` bytes are neighbours with one rank; all but the earliest of them go.

An anchor of very many places is dealt to several shards. What is left of it in each is
compared between them by digests of whole strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType

from fieldjobs.llm.bpe import ranges
from fieldjobs.llm.line_dedup import _over
from fieldjobs.llm.recovery import cut
from fieldjobs.llm.words import eights_of, groups, hash_words, mix, numbered, text_bytes

#: Bytes of a repeated string, and of an anchor (at least 8, at most 16).
SIZE, GRAM = 100, 16
#: Bytes of text searched for anchors at a time, about; only a longer text makes a larger part.
PART = 1 << 20
#: Stretches of a shard, about, and places of an anchor beyond which it is dealt to several.
SHARD, HOT = 8192, 4096
_U = np.uint64


def anchors(data: np.ndarray, at: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts that lie end to end: gram hash, text, first string and number of strings of each place."""
    gram = min(GRAM, size)
    eights = eights_of(data)
    n = len(data) - gram + 1
    if len(data) < size:
        return np.zeros(0, np.int64), *(np.zeros(0, np.int64) for _ in range(3))
    h = mix(eights[:n] + eights[gram - 8 : gram - 8 + n] * _U(0x9E3779B97F4A7C15))
    bits = _U(max(24, n.bit_length()))
    least = _over(h >> bits << bits | np.arange(n, dtype=_U), size - gram + 1, np.minimum)  # the first of the smallest
    first = np.arange(len(data) - size + 1)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(first)]
    whole = first + size <= at[text + 1]
    first, text, place = first[whole], text[whole], (least[whole] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    new = np.flatnonzero(np.diff(place, prepend=-1))
    return h[place[new]].view(np.int64), text[new], first[new] - at[text[new]], np.diff(np.append(new, len(place)))


def _sum_before(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _doubled(first: np.ndarray, room: np.ndarray, depth: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts the places of a text by the ``size`` symbols that follow, from an order by ``depth`` of them (``first``).

    Returns each place's rank (equal strings share one), and of the places that the last
    round sorted their order and the sizes of their groups. Places have ``room`` for so
    many symbols; those with less take no part. A string's halves were ranked in the round
    before, so each round doubles the depth, and places that stand alone are done.
    """
    todo = np.flatnonzero(room >= depth)
    rank, key = np.zeros(len(room), np.int64), first[todo]
    while True:
        order = np.argsort(key)
        todo, key = todo[order], key[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        many = np.diff(np.append(edge, len(key)))
        old = rank[todo]  # groups only part, so ranks count from their group's
        opens = np.concatenate([[True], old[1:] != old[:-1]])[: len(old)]
        rank[todo] = old + np.repeat(edge, many) - np.maximum.accumulate(np.where(opens, np.arange(len(old)), 0))
        if depth >= size or not (many > 1).any():
            return rank, todo, many
        step = min(depth, size - depth)
        depth += step
        todo = todo[np.repeat(many > 1, many)]
        todo = todo[room[todo] >= depth]
        key = rank[todo] << 32 | rank[todo + step]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of all suffixes of ``s``, whose last symbol is 0 and the only 0."""
    n = len(s)
    room = np.repeat([2 * n, 0], n)  # what lies beyond the end is never decisive
    return np.argsort(_doubled(s, room, 1, n)[0][:n])


def common_prefixes(data: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """At each place of the text, the bytes its suffix shares with the suffix ``before`` it in order (-1: none), up to either's ``end``."""
    n = len(data)
    place = np.arange(n)
    opens = np.concatenate([[True], end[1:] != end[:-1]])
    back = np.maximum(before - 1, 0)
    reducible = ~opens & (before > 0) & (data[place - 1] == data[back]) & (end[back] == end[np.maximum(before, 0)])
    out = np.zeros(n, np.int64)
    todo = np.flatnonzero(~reducible & (before >= 0))
    most = np.minimum(end[todo] - todo, end[before[todo]] - before[todo])
    eights, step = eights_of(data), 0
    while len(todo):
        differ = eights[np.minimum(todo + step, n)] ^ eights[np.minimum(before[todo] + step, n)]
        lowest = differ & (~differ + _U(1))
        shared = np.where(differ == 0, 8, (np.log2(np.maximum(lowest, 1).astype(np.float64)).astype(np.int64)) >> 3)
        shared = np.minimum(shared, most - step)
        out[todo] += shared
        step += 8
        go = (shared == 8) & (most > step)
        todo, most = todo[go], most[go]
    irreducible = np.maximum.accumulate(np.where(reducible, 0, place))
    return np.maximum(out[irreducible] - (place - irreducible), 0)


def earlier_strings(data: np.ndarray, at: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Whether the string of ``size`` bytes (8 at least) at each place of some stretches stands at an earlier place too; False where none fits."""
    room = np.repeat(at[1:], np.diff(at)) - np.arange(len(data))
    _, order, many = _doubled(eights_of(data)[: len(data)].byteswap(), room, 8, size)
    out = np.zeros(len(data), bool)
    if len(order):
        out[order] = order > np.repeat(np.minimum.reduceat(order, _sum_before(many)[:-1]), many)
    return out


def _printed(size: int):
    most = PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch.column("text"), most):
                some = batch.slice(part.start, part.stop - part.start)
                data, at = text_bytes(some.column("text"))
                prints, text, begin, count = anchors(data, at, size)
                key = prints.view(_U) + mix(text.astype(_U))
                _, which, held = np.unique(key, return_inverse=True, return_counts=True)
                cuts = pa.array(np.searchsorted(text, np.arange(len(at))), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (prints, begin.astype(np.int32), count.astype(np.int32), held[which] > 1)]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("doc_id", "text_hash", "sha")), *lists], ["doc_id", "text_hash", "sha", "prints", "begins", "counts", "twice"])

    return run


def _cut_out(size: int):
    """One row for each place of an anchor: the bytes of its strings."""
    most, bits = PART, size.bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch.column("text"), most):
                some = batch.slice(part.start, part.stop - part.start)
                data, at = text_bytes(some.column("text"))
                places = some.column("places")
                row = np.repeat(np.arange(some.num_rows), np.diff(places.offsets.to_numpy()))
                prints, place, held = (pa.array(x) for x in places.flatten().flatten())
                begin, n = np.asarray(place) >> bits, np.asarray(place) & ((1 << bits) - 1)
                length = n + (size - 1)
                ends = _sum_before(length)
                cuts = pa.py_buffer(ends.astype(np.int32))
                found = pa.Array.from_buffers(pa.binary(), len(row), [None, cuts, pa.py_buffer(data[ranges(at[row] + begin, length)])])
                keys = [some.column(c).take(pa.array(row)) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(begin), prints, held, found], ["doc_id", "text_hash", "begin", "print", "held", "bytes"])

    return run


def _digests(data: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    eights = eights_of(data)
    out = [np.full(len(place), seed, _U) for seed in (1, 2)]
    for step in [*range(0, size - 8, 8), max(size - 8, 0)]:
        for i in range(2):
            out[i] = mix(out[i] * _U(0x9E3779B97F4A7C15) + eights[place + step] + _U(i))
    return out[0].view(np.int64), out[1].view(np.int64)


def _stretches(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the offsets of each value."""
    joined = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
    return np.frombuffer(joined.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8), at - at[0]


def _distinct(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind of equal stretches, in order, and which of them each stretch is."""
    length = np.diff(at)
    part = np.minimum(length, 64)
    h = hash_words(data, at[:-1], part) + mix(hash_words(data, at[1:] - part, part) + length.astype(_U))
    one, which = numbered(data, at[:-1], length, h)
    order = np.argsort(one)
    rank = np.empty(len(one), np.int64)
    rank[order] = np.arange(len(one))
    return one[order], rank[which]


def _shard(size: int):
    def run(_: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        null, ids = np.asarray(rows.column("doc_id").is_null()), np.asarray(rows.column("doc_id").fill_null(0))
        rows = rows.take(pa.array(np.lexsort([np.asarray(rows.column("begin")), np.asarray(rows.column("text_hash")), ids, null])))
        data, at = _stretches(rows.column("bytes"))
        one, which = _distinct(data, at)  # equal stretches are sorted once
        length = np.diff(at)
        # a stretch meets only stretches of its own anchor, and holds no string twice
        _, kind, many = np.unique(np.asarray(rows.column("print"))[one], return_inverse=True, return_counts=True)
        pool_at, met = _sum_before(length[one]), np.flatnonzero(many[kind] > 1)
        gone = np.zeros(int(pool_at[-1]), bool)
        gone[ranges(pool_at[met], length[one[met]])] = earlier_strings(data[ranges(at[one[met]], length[one[met]])], _sum_before(length[one[met]]), size)
        strings = length - size + 1
        row = np.repeat(np.arange(len(length)), strings)
        nth = ranges(np.zeros(len(length), np.int64), strings)
        # a repeated row is the same place, not a later one
        own = [np.asarray(rows.column(c).fill_null(0)) for c in ("doc_id", "text_hash", "begin")]
        copy = np.any([x != x[one[which]] for x in (*own, np.asarray(rows.column("doc_id").is_null()))], axis=0)
        later = copy[row] | gone[pool_at[which[row]] + nth]
        # runs of strings that go
        edge = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (later[1:] != later[:-1])])[: len(row)])
        many = np.diff(np.append(edge, len(row)))
        runs, many = edge[later[edge]], many[later[edge]]
        # strings that stay here, of anchors that other shards hold too
        left = np.flatnonzero(~later & np.asarray(rows.column("hot"))[row])
        digests = _digests(data, at[row[left]] + nth[left], size)
        took = np.concatenate([runs, left])
        begin = np.asarray(rows.column("begin"))[row[took]] + nth[took]
        keys = rows.select(["doc_id", "text_hash"]).take(pa.array(row[took]))
        sure = np.arange(len(took)) < len(runs)
        high, low = (pa.array(np.concatenate([np.zeros(len(runs), np.int64), d]), mask=sure) for d in digests)
        return pa.table({"doc_id": keys.column("doc_id"), "text_hash": keys.column("text_hash"), "begin": begin.astype(np.int64), "n": np.concatenate([many, np.ones(len(left), np.int64)]), "high": high, "low": low})

    return run


def repeated_strings(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, text_hash, runs, copy``: the runs (``begin``, ``n``) of strings that also start earlier, for texts that have any; ``copy``: an earlier row holds the whole text."""
    text = F.coalesce("text", F.lit(""))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    lists = "prints array<long>, begins array<int>, counts array<int>, twice array<boolean>"
    found = src.select("*", F.sha2("text", 256).alias("sha")).mapInArrow(_printed(size), f"doc_id long, text_hash long, sha string, {lists}")
    found = cut(found.where(F.size("prints") > 0).withColumn("row", F.monotonically_increasing_id()))
    # of rows with one text, the first by doc_id stands for all
    of = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    heads = cut(found.groupBy("sha").agg(F.min(F.struct(of.alias("of"), "row")).alias("head"), F.count("*").alias("n")).select("sha", "head.of", "head.row", "n"))
    copies = found.select("sha", "doc_id", "text_hash").join(heads.where("n > 1").select("sha", F.col("of").alias("first")), "sha").where(of > F.col("first")).select("doc_id", "text_hash").distinct()
    # anchors that two texts hold, or one text twice
    places = found.select("row", "text_hash", F.explode(F.arrays_zip("prints", "begins", "counts", "twice")).alias("p"))
    again = places.groupBy(F.col("p.prints").alias("print")).agg(F.count("*").alias("held"), F.min("text_hash").alias("a"), F.max("text_hash").alias("b"), F.max("p.twice").alias("twice"))
    again = cut(again.where("a <> b or twice").select("print", "held"))
    place = F.shiftleft(F.col("p.begins").cast("long"), size.bit_length()).bitwiseOR(F.col("p.counts").cast("long"))
    places = places.select("row", F.col("p.prints").alias("print"), place.alias("place"))
    asked = places.join(again, "print").groupBy("row").agg(F.collect_list(F.struct("print", "place", "held")).alias("places"))
    asked = cut(asked.join(heads.select("row"), "row", "left_semi").join(found.select("row", "doc_id", "text_hash"), "row").drop("row"))
    # the stretch of bytes of each place, dealt to shards of about one size
    repeated = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    once = src.dropDuplicates(["doc_id", "text_hash"]) if repeated else src
    both = once.alias("t").join(asked.alias("a"), F.col("t.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("t.text_hash") == F.col("a.text_hash"))).select("t.*", "places")
    stretches = both.mapInArrow(_cut_out(size), "doc_id long, text_hash long, begin long, print long, held long, bytes binary")
    shards = 1 + (again.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]) // SHARD
    deal = F.pmod(F.xxhash64("doc_id", "text_hash", "begin"), F.ceil(F.col("held") / HOT))
    dealt = stretches.select("doc_id", "text_hash", "begin", "print", "bytes", (F.col("held") > HOT).alias("hot"), F.pmod(F.xxhash64("print", deal), F.lit(shards)).alias("shard"))
    kinds = "doc_id long, text_hash long, begin long, n long, high long, low long"
    sorted_ = cut(dealt.groupBy("shard").applyInArrow(_shard(size), kinds))
    # between shards of one anchor: the earliest place of each string that is left
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash", "begin")
    left = sorted_.where("high is not null").withColumn("place", place)
    first = left.groupBy("high", "low").agg(F.min("place").alias("first"), F.count("*").alias("held")).where("held > 1").drop("held")
    later = left.join(first, ["high", "low"]).where("place > first").select("doc_id", "text_hash", "begin", "n")
    runs = sorted_.where("high is null").select("doc_id", "text_hash", "begin", "n").union(later).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("begin", "n")).alias("runs"))
    return cut(runs.withColumn("copy", F.lit(False)).union(copies.select("doc_id", "text_hash", F.array().cast("array<struct<begin: long, n: long>>"), F.lit(True))))


def _spans(size: int):
    @F.arrow_udf("array<struct<begin: long, end: long>>")
    def spans(n_bytes: pa.Array, runs: pa.Array, copy: pa.Array) -> pa.Array:
        out = []
        for n, of_text, whole in zip(n_bytes.to_pylist(), runs.to_pylist(), copy.to_pylist()):
            if whole:
                out.append([{"begin": 0, "end": n}])
                continue
            begin, many = (np.array([r[c] for r in of_text or []], np.int64) for c in ("begin", "n"))
            order = np.argsort(begin)
            begin, end = begin[order], (begin + many - 1 + size)[order]
            reach = np.maximum.accumulate(end) if len(end) else end
            new = np.concatenate([[True], begin[1:] > reach[:-1]])[: len(begin)]
            ends = reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)] if len(reach) else reach
            out.append([{"begin": x, "end": y} for x, y in zip(begin[new].tolist(), ends.tolist())])
        return pa.array(out, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))

    return spans


@F.arrow_udf(BinaryType())
def _without(data: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for d, gone in zip(data, spans.to_pylist()):
        view, kept, at = memoryview(d.as_buffer()) if d.is_valid else memoryview(b""), [], 0
        for s in gone:
            kept.append(view[at : s["begin"]])
            at = s["end"]
        out.append(b"".join([*kept, view[at:]]))
    return pa.array(out, pa.binary())


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, spans, kept``: the byte spans that go, and the bytes that stay.

    A byte goes if a string of ``size`` bytes (8 at least) that covers it also starts
    earlier: in a row with a smaller doc_id (null last, of rows that share one by the
    hash of their text), or earlier in its own text. Matches lie within a row and are
    judged on the input. Repeated rows (same doc_id and text) count as one and all get its
    result. Null and empty texts have no bytes. Other columns are ignored; an empty table
    gives no row. Strings are compared byte by byte within a shard, by 128 bits between
    the shards of one anchor; whole texts by SHA-256.
    """
    text = F.coalesce("text", F.lit(""))
    gone = repeated_strings(docs, size).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "runs", "copy")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.encode(text, "UTF-8").alias("data"))
    out = src.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left")
    loses = F.col("copy").isNotNull()
    out = out.withColumn("n_bytes", F.octet_length("data").cast("long"))
    out = out.withColumn("spans", _spans(size)("n_bytes", "runs", F.coalesce("copy", F.lit(False))))
    out = out.withColumn("left", _without(F.when(loses, F.col("data")), F.col("spans")))
    return out.select("doc_id", "n_bytes", "spans", F.when(loses, F.col("left")).otherwise(F.col("data")).alias("kept"))
