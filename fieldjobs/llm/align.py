"""Alignment of two tokenizers' tokens by lockstep merging.

Each document has two rising lists of byte offsets where its tokens end. They are merged
as two sorted lists are: the pointer with the smaller end advances, and where the ends are
equal both do, which links the two tokens and cuts the document there. All documents of a
batch take each step together: one numpy vector holds every A pointer, one every B
pointer, and documents that are done drop out. A long document takes part as several
lanes, each over a stretch of its bytes, so that the number of steps does not grow with
its length.

How often two ids are linked in the whole corpus is counted by blocks of documents: a
block asks once for each id pair it holds, and applies the answers to its own links.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fieldjobs.llm.bpe import byte_alphabet, character_classes, expanded, ranges
from fieldjobs.llm.packing import Encoder
from fieldjobs.llm.recovery import cut
from fieldjobs.llm.words import SPACE_WORDS, groups, hash_words, numbered, text_bytes

#: Bytes of text in a block, about; only a longer text makes a larger block.
BLOCK = 1 << 20
#: Bytes of a document that one lane merges.
LANE = 512


class Tokens:
    """The bytes of each of a vocabulary's tokens, and an encoder of strings that each begin with a space."""

    def __init__(self, names: list[bytes], encode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], apart: bool):
        self.size = np.array([len(t) for t in names], np.int64)
        self.blob = np.frombuffer(b"".join(names), np.uint8)
        self.first = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        #: All ids of strings that lie end to end from some offsets, and the offsets of each one's.
        self.encode = encode
        #: Whether no token has a space behind other characters, so that what stands before a space is encoded apart from it.
        self.apart = apart

    def spelt(self, ids: np.ndarray, ends: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the ids of each string (those between its ``ends``) spell its bytes (those between its ``at``)."""
        sizes = np.concatenate([[0], np.cumsum(self.size[ids])])[ends]
        same = np.diff(sizes) == np.diff(at)
        rows = np.flatnonzero(same)
        length = np.diff(at)[rows]
        blob = self.blob[ranges(self.first[ids], self.size[ids])]
        equal = blob[ranges(sizes[rows], length)] == data[ranges(at[rows], length)]
        wrong = np.concatenate([[0], np.cumsum(~equal)])[np.concatenate([[0], np.cumsum(length)])]
        same[rows] = np.diff(wrong) == 0
        return same


def byte_level(path: str, classes: tuple[list[int], list[int]]) -> Tokens:
    """A byte-level vocabulary; special tokens' strings are plain text."""
    encoder = Encoder(path, classes)
    with open(path, encoding="utf-8") as f:
        vocab: dict[str, int] = json.load(f)["model"]["vocab"]
    byte = {c: b for b, c in enumerate(byte_alphabet())}
    names = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        names[i] = b"" if t in encoder.special else bytes(byte[c] for c in t)
    return Tokens(names, lambda data, at: encoder.runs(data, at) if len(data) else (np.zeros(0, np.int64), np.zeros(1, np.int64)), True)


def pieces(path: str) -> Tokens:
    """A piece vocabulary with byte fallback, whose library adds the first space itself."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode() for i in range(library.get_piece_size())]

    def encode(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        written = data.tobytes()
        found = library.encode([written[x:y].decode() for x, y in zip((at[:-1] + 1).tolist(), at[1:].tolist())], num_threads=1)
        ends = np.concatenate([[0], np.cumsum([len(i) for i in found])]).astype(np.int64)
        return np.fromiter(itertools.chain.from_iterable(found), np.int64, int(ends[-1])), ends

    return Tokens(names, encode, not any(b" " in t.lstrip(b" ") for t in names))


def merged(a_end: np.ndarray, a_at: np.ndarray, b_end: np.ndarray, b_at: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """The A and the B token of each link, in order.

    Ends rise within each document and count on from document to document; ``a_at`` and
    ``b_at`` are the offsets of each document's tokens. The documents' last tokens end
    together.
    """
    # lanes: a document's bytes are dealt out by `lane`; tokens go by where they end
    last = np.concatenate([[0], a_end[a_at[1:] - 1]]) if len(a_at) > 1 else np.zeros(1, np.int64)
    many = np.maximum(-(-np.diff(last) // lane), 1)
    border = np.repeat(last[1:], many)
    nth = ranges(np.zeros(len(many), np.int64), many)
    begins = np.repeat(last[:-1], many) + nth * lane
    border[:-1] = np.where(nth[1:] > 0, begins[1:], border[:-1])
    a_stop, b_stop = np.searchsorted(a_end, border, side="right"), np.searchsorted(b_end, border, side="right")
    a, b = (np.concatenate([[0], stop])[: len(border)] for stop in (a_stop, b_stop))
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    a_end, b_end = np.append(a_end, 0), np.append(b_end, 0)
    while True:
        live = (a < a_stop) & (b < b_stop)  # a lane whose one side is used up has no more links
        if not live.all():
            a, b, a_stop, b_stop = a[live], b[live], a_stop[live], b_stop[live]
        if not len(a):
            break
        x, y = a_end[a], b_end[b]
        meet = x == y
        out.append((a[meet], b[meet]))
        a, b = a + (x <= y), b + (y <= x)
    linked_a, linked_b = (np.concatenate(p) for p in zip(*out))
    order = np.argsort(linked_a, kind="stable")
    return linked_a[order], linked_b[order]


def _written(a: np.ndarray, b: np.ndarray, linked_a: np.ndarray, linked_b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group of each document, and the offsets of each document's string."""
    a_group = np.searchsorted(linked_a, np.arange(len(a)))
    b_group = np.searchsorted(linked_b, np.arange(len(b)))
    a_first, b_first = np.concatenate([[0], linked_a + 1]), np.concatenate([[0], linked_b + 1])
    ids, sign = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    place_a, place_b = np.arange(len(a)) + b_first[a_group], np.arange(len(b)) + a_first[b_group + 1]
    ids[place_a], ids[place_b] = a, b
    sign[place_a[linked_a]], sign[place_b[linked_b]] = ord("|"), ord(";")
    digits = 1 + np.searchsorted(10 ** np.arange(1, 19), ids, side="right")
    ends = np.cumsum(digits + 1)
    text = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    text[ends - 1] = sign
    place, left = ends - 2, ids
    while len(place):
        text[place] = left % 10 + ord("0")
        left = left // 10
        place, left = place[left > 0] - 1, left[left > 0]
    return text.tobytes(), np.concatenate([[0], ends])[a_at + b_at]


#: Bytes that may begin white space beyond ASCII, or that some take for white space.
_DOUBTFUL = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3])


class _Block:
    """Tokens and links of some texts. What stands between spaces is encoded once each."""

    def __init__(self, first: Tokens, second: Tokens, texts: pa.Array):
        data, at = text_bytes(texts)
        data, at = np.insert(data, at[:-1], 0x20), at + np.arange(len(at))
        cuts = np.zeros(len(data) + 1, bool)
        if first.apart and second.apart:
            # a space right behind a word and right before other characters begins a pre-token of both
            cuts[1:-2] = (data[1:-1] == 0x20) & ~_DOUBTFUL[data[2:]] & SPACE_WORDS[data[:-2]]
        cuts[at] = True
        start = np.flatnonzero(cuts[:-1])
        length = np.diff(np.append(start, len(data)))
        one, which = numbered(data, start, length, hash_words(data, start, length))
        pool, pool_at = data[ranges(start[one], length[one])], np.concatenate([[0], np.cumsum(length[one])])
        owner = np.searchsorted(start, at)
        made, ok = [], np.diff(at) > 1
        for tokens in (first, second):
            ids, ends = tokens.encode(pool, pool_at)
            wrong = ~tokens.spelt(ids, ends, pool, pool_at)
            ok &= np.diff(np.concatenate([[0], np.cumsum(wrong[which])])[owner]) == 0
            made.append((ids, ends))
        kept = which[np.repeat(ok, np.diff(owner))]
        (self.a, a_ends), (self.b, b_ends) = (expanded(ids, ends, kept) for ids, ends in made)
        segments = np.concatenate([[0], np.cumsum(np.where(ok, np.diff(owner), 0))])
        a_at, b_at = a_ends[segments], b_ends[segments]
        self.n_a, self.n_b = np.diff(a_at), np.diff(b_at)
        full = np.append(np.flatnonzero(ok), len(ok))
        self.a_end = np.cumsum(first.size[self.a])
        self.linked_a, self.linked_b = merged(self.a_end, a_at[full], np.cumsum(second.size[self.b]), b_at[full])
        self.a_at, self.b_at = a_at, b_at
        self.at = np.searchsorted(self.linked_a, a_at)

    def digests(self) -> list[str]:
        written, ends = _written(self.a, self.b, self.linked_a, self.linked_b, self.a_at, self.b_at)
        view = memoryview(written)
        return [hashlib.sha256(view[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends.tolist(), ends[1:].tolist())]


_LOADED: dict[tuple[str, str], tuple[Tokens, Tokens]] = {}
_ROWS = "block long, doc_id long, n_a long, n_b long, sha string, links array<int>, pairs array<long>, n array<long>"


def _blocks(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, classes: tuple[list[int], list[int]], most: int) -> Iterator[tuple[pa.RecordBatch, _Block]]:
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = byte_level(a_path, classes), pieces(b_path)
    for batch in batches:
        for part in groups(batch.column("text"), most):
            if part.stop > part.start:
                some = batch.slice(part.start, part.stop - part.start)
                yield some, _Block(*_LOADED[a_path, b_path], some.column("text"))


def _aligned(a_path: str, b_path: str):
    """One row for each document, with its links as numbers of the block's id pairs; the block's first row holds the pairs and how often each is linked."""
    classes, most = character_classes(), BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        for number, (some, m) in enumerate(_blocks(batches, a_path, b_path, classes, most)):
            pair, which, n = np.unique(m.a[m.linked_a] << 32 | m.b[m.linked_b], return_inverse=True, return_counts=True)
            first = pa.array(np.append(0, np.full(some.num_rows, len(pair))), pa.int32())
            lists = [pa.ListArray.from_arrays(pa.array(m.at, pa.int32()), pa.array(which, pa.int32())), *(pa.ListArray.from_arrays(first, pa.array(x, pa.int64())) for x in (pair, n))]
            flat = [pa.array(np.full(some.num_rows, task + number)), some.column("doc_id"), pa.array(m.n_a, pa.int64()), pa.array(m.n_b, pa.int64()), pa.array(m.digests(), pa.string())]
            yield pa.RecordBatch.from_arrays([*flat, *lists], ["block", "doc_id", "n_a", "n_b", "sha", "links", "pairs", "n"])

    return run


def _applied(_: tuple[pa.Scalar, ...], block: pa.Table, answers: pa.Table) -> pa.Table:
    """Of one block: each document's links whose pair is its B id's most frequent, and the sum of its links' counts."""
    place = np.asarray(answers.column("place"))
    count, best = (np.zeros(len(place), np.int64) for _ in range(2))
    count[place], best[place] = np.asarray(answers.column("count")), np.asarray(answers.column("best"))
    rows = block.combine_chunks()
    links = rows.column("links")
    at = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(links)))])
    held = np.asarray(pc.list_flatten(links))
    sums = [np.diff(np.concatenate([[0], np.cumsum(x[held])])[at]) for x in (best, count)]
    n = np.diff(at)
    return pa.table({"doc_id": rows.column("doc_id"), "n_a": rows.column("n_a"), "n_b": rows.column("n_b"), "n_groups": n, "n_links": n, "n_best": sums[0], "count_sum": sums[1], "groups_sha256": rows.column("sha")})


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, count, best``: how often each two ids (A's above 32 bits, B's below) are linked, and whether no A id is linked to the B id more often (1 or 0)."""
    held = blocks.select(F.explode(F.arrays_zip("pairs", "n")).alias("p")).select("p.pairs", "p.n")
    counts = cut(held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("n").alias("count")))
    b = F.col("pair").bitwiseAND(F.lit(2**32 - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.join(most, b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A and B tokens that end at the same byte are linked, and every such byte ends a group.
    A text that is null, empty, or that either vocabulary doesn't spell back (its
    normaliser changed it) has no tokens: zeros and an empty string. Null doc_ids and
    repeated rows are returned as they come and count each. Other columns are ignored; an
    empty table gives no row. No document moves: blocks send their distinct id pairs.
    """
    blocks = cut(_source(docs).mapInArrow(_aligned(a_path, b_path), _ROWS))
    known = pair_counts(blocks)
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(known, "pair").select(F.col("block").alias("asker"), "place", "count", "best")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return blocks.drop("pairs", "n").groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(_applied, out)


def groups_of(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, group, begin, end, a_ids, b_ids``: one row per group, with its bytes of a space and the text. The last ids of both sides are linked."""
    classes, most = character_classes(), BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda ids, linked: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], linked + 1]), pa.int32()), pa.array(ids))
        for some, m in _blocks(batches, a_path, b_path, classes, most):
            doc = np.repeat(np.arange(some.num_rows), np.diff(m.at))
            nth = ranges(np.zeros(some.num_rows, np.int64), np.diff(m.at))
            ends = np.concatenate([[0], m.a_end])
            end = ends[m.linked_a + 1] - ends[m.a_at[doc]]
            begin = np.where(nth > 0, np.concatenate([[0], end])[:-1], 0)
            made = [some.column("doc_id").take(pa.array(doc)), pa.array(nth), pa.array(begin), pa.array(end), lists(m.a, m.linked_a), lists(m.b, m.linked_b)]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "group", "begin", "end", "a_ids", "b_ids"])

    return _source(docs).mapInArrow(run, "doc_id long, group long, begin long, end long, a_ids array<long>, b_ids array<long>")


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
