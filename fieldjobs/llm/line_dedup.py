"""Repeated passages, by winnowing.

A line here is any run of ``LINE`` words, since passages start and end inside the lines
that line breaks make. Of the lines of each window of ``min_words`` words the one with the
smallest hash is its fingerprint, so equal windows have equal fingerprints wherever they
stand, and a text has few fingerprints. The fingerprints' positions are joined over all
texts; those found at one place only end there. Around the others every window that the
fingerprint stands for is compared with the same windows elsewhere, by the fingerprint and
a hash of all its words, which extends a match both ways as far as whole windows agree. A
window is deleted where an earlier text, or an earlier place of its own text, holds the
same words, so all of a repeated passage goes but its earliest place. Texts are ordered by
doc_id, null last, and texts of one doc_id by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldjobs.llm.recovery import cut
from fieldjobs.llm.words import SPACE_WORDS, find_words, groups, mix, sequence_hashes, text_bytes

MIN_WORDS = 50
#: Words of a line; at most ``min_words``.
LINE = 10
#: Bytes of text hashed at a time, about; only a longer text makes a larger part.
PART = 1 << 22
#: Low bits of a place: the number of its first word, and whether its own text holds the window before. Above them the low bits of its text's hash.
WORD_BITS = 31
REPEATED = 1 << 30
#: The id that rows without one have here, the last of all.
LAST = 2**63 - 1
_U = np.uint64


def _over(x: np.ndarray, n: int, pick) -> np.ndarray:
    """The smallest or largest (``pick``) of each n numbers in a row."""
    held = 1
    while held < n and len(x):
        step = min(held, n - held)
        x = pick(x[:-step], x[step:]) if len(x) > step else x[:0]
        held += step
    return x


class _Words:
    """The words of some texts, their lines' hashes, and of each whole window its first word, text and fingerprint."""

    def __init__(self, texts: pa.Array, min_words: int):
        self.data, self.at = text_bytes(texts)
        self.h, self.starts, _ = find_words(self.data, self.at, SPACE_WORDS, fold=False)
        words = np.searchsorted(self.starts, self.at)
        line = min(LINE, min_words)
        self.lines = sequence_hashes(self.h, line)
        self.span = min_words - line + 1  # lines of a window
        first = np.arange(max(len(self.h) - min_words + 1, 0))
        text = np.searchsorted(words, first, side="right") - 1
        whole = first + min_words <= words[text + 1]
        self.first, self.text = first[whole], text[whole]
        self.least = _over(self.lines, self.span, np.minimum)[: len(first)][whole]
        self.n_texts = len(self.at) - 1

    def selected(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of each line that is a fingerprint, once for each place."""
        most = np.zeros(len(self.lines) + 2 * self.span, _U)  # a line is one if the largest of its windows' least is its own hash
        most[self.first + self.span - 1] = self.least
        most = _over(most, self.span, np.maximum)[: len(self.lines)]
        taken = np.flatnonzero((most == self.lines) & (most > 0))
        text = np.searchsorted(self.starts[taken], self.at, side="left")
        return self.lines[taken], np.diff(text)


def _prints(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch.column("text"), PART):
                w = _Words(batch.column("text")[part], min_words)
                prints, sizes = w.selected()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(prints.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], batch.column("text_hash")[part], pa.array(np.diff(w.at)), lists], ["doc_id", "text_hash", "bytes", "prints"])

    return run


def _windows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch.column("text"), PART):
                some = batch.slice(part.start, part.stop - part.start)
                w = _Words(some.column("text"), min_words)
                prints = some.column("prints")
                # a text and one of its fingerprints, as one number
                key = lambda text, least: mix(least + mix(text.astype(_U)))
                sizes = np.diff(prints.offsets.to_numpy())
                again = np.isin(key(w.text, w.least), key(np.repeat(np.arange(w.n_texts), sizes), np.asarray(prints.flatten()).view(_U)))
                first, text = w.first[again], w.text[again]
                # the hash of a window's words: ten by ten, then all that
                line = min(LINE, min_words)
                parts = [*range(0, min_words - line, line), min_words - line]
                check = np.zeros(len(first), _U)
                for p in parts:
                    check = mix(check + w.lines[first + p] + _U(0x632BE59BD9B4E019))
                begin = first - np.searchsorted(w.starts, w.at)[text]
                # the first place of each window in its text
                _, one, which = np.unique(mix(check + mix(text.astype(_U))), return_index=True, return_inverse=True)
                begin |= np.where(begin >= begin[one][which] + min_words, REPEATED, 0)
                place = np.asarray(some.column("tag"))[text] | begin
                # the fingerprint's low half and the window's own hash: 96 bits
                yield pa.RecordBatch.from_arrays([pa.array(w.least[again].astype(np.uint32).view(np.int32)), pa.array(check.view(np.int64)), some.column("doc_id").take(pa.array(text)), pa.array(place)], ["print", "check", "doc_id", "place"])

    return run


def _id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id")


def _tag(text_hash):
    """What tells a text from others of its doc_id, never 0."""
    return F.shiftleft(text_hash.bitwiseAND(F.lit(2**32 - 1)).bitwiseOR(F.lit(1)), WORD_BITS)


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text_hash, begins, copy``: the first words of the windows to delete, for texts that lose any; ``copy``: all of the text goes."""
    text = F.coalesce("text", F.lit(""))
    src = docs.select(_id(), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    printed = cut(src.mapInArrow(_prints(min_words), "doc_id long, text_hash long, bytes long, prints array<long>"))
    # tags are only needed where a doc_id has several texts, as rows without one have
    several = (F.min("text_hash") != F.max("text_hash")) | (F.col("doc_id") == LAST)
    tags = cut(printed.groupBy("doc_id").agg(several.alias("several"), F.count_if(F.size("prints") > 0).alias("n")).where("n > 0").drop("n"))
    tag = F.when(F.col("several"), _tag(F.col("text_hash"))).otherwise(F.lit(0).cast("long")).alias("tag")
    printed = printed.where(F.size("prints") > 0)
    # later copies of a whole text go as one
    first = cut(printed.groupBy("text_hash", "bytes").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")))
    copies = printed.select("doc_id", "text_hash", "bytes").join(first.where("n > 1"), ["text_hash", "bytes"]).where("doc_id > head").select("doc_id", "text_hash").distinct()
    one_each = printed.join(first, (printed["text_hash"] == first["text_hash"]) & (printed["bytes"] == first["bytes"]) & (printed["doc_id"] == first["head"]), "left_semi")
    # within this step a text is known by its hash alone: texts that share it are given each other's fingerprints, which costs a little work
    prints = one_each.select("text_hash", F.explode("prints").alias("print"))
    again = cut(prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"))
    prints = one_each.select("text_hash", F.explode(F.array_distinct("prints")).alias("print"))
    hot = cut(prints.join(again, "print").repartition("text_hash").groupBy("text_hash").agg(F.collect_set("print").alias("prints")))
    named = one_each.select("doc_id", "text_hash").distinct().join(tags, "doc_id").select("doc_id", "text_hash", tag)
    windows = cut(src.join(named.join(hot, "text_hash"), ["doc_id", "text_hash"]).mapInArrow(_windows(min_words), "print int, check long, doc_id long, place long"))
    earliest = windows.groupBy("print", "check").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1").select("print", "check", "head")
    earliest = cut(earliest)  # so that a window that very many texts hold is split
    word, of = F.col("place").bitwiseAND(F.lit(REPEATED - 1)), F.col("place").bitwiseAND(F.lit(~(2**WORD_BITS - 1)))
    later = windows.join(earliest, ["print", "check"]).where((F.col("doc_id") > F.col("head")) | (F.col("place").bitwiseAND(F.lit(REPEATED)) != 0))
    # of texts that share a doc_id, all but the one with the smallest tag
    tagged = windows.where(of != 0)
    own = cut(tagged.groupBy("print", "check", "doc_id").agg(F.min(of).alias("least"), F.max(of).alias("most")).where("least < most").drop("most"))
    second = tagged.join(own, ["print", "check", "doc_id"]).where(of > F.col("least"))
    lost = later.select("doc_id", of.alias("tag"), word.cast("int").alias("begin")).union(second.select("doc_id", of, word.cast("int")))
    begins = lost.repartition("doc_id", "tag").groupBy("doc_id", "tag").agg(F.collect_set("begin").alias("begins"))
    begins = cut(begins.join(named, ["doc_id", "tag"]).select("doc_id", "text_hash", "begins"))
    return begins.withColumn("copy", F.lit(False)).union(copies.select("doc_id", "text_hash", F.array().cast("array<int>"), F.lit(True)))


def _rewritten(min_words: int):
    """Of each text, the spans of characters of the windows that begin at these words, with the white space behind them, and what is left without them. One function, so that a task needs one Python worker."""

    @F.arrow_udf("struct<spans: array<struct<begin: int, end: int>>, left: string>")
    def rewritten(text: pa.Array, begins: pa.Array, copy: pa.Array) -> pa.Array:
        out = []
        for t, first, whole in zip(text.to_pylist(), begins.to_pylist(), copy.to_pylist()):
            if whole:
                out.append([{"begin": 0, "end": len(t)}])
                continue
            if not first:
                out.append([])
                continue
            data, at = text_bytes(pa.array([t]))
            _, starts, _ = find_words(data, at, SPACE_WORDS, fold=False)
            b = np.sort(np.array(first))
            new = np.concatenate([[True], b[1:] > b[:-1] + min_words])
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            begin = chars[starts[b[new]]]
            end = chars[np.append(starts, len(data))[b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)] + min_words]]
            out.append([{"begin": x, "end": y} for x, y in zip(begin.tolist(), end.tolist())])
        gone = pa.array(out, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
        return pa.StructArray.from_arrays([gone, _without(text, out)], ["spans", "left"])

    return rewritten


def _without(text: pa.Array, gone: list[list[dict[str, int]]]) -> pa.Array:
    """Of the white space before and behind a passage that goes, one stays; the one with a line break, if only one has any."""
    out = []
    for t, spans in zip(text.to_pylist(), gone):
        if not spans:
            out.append(t)
            continue
        kept, at = [], 0
        space = " \t\n\v\f\r"
        for s in spans:
            kept.append(t[at : s["begin"]])
            at = s["end"]
            cut_out = t[s["begin"] : at]
            behind = cut_out[len(cut_out.rstrip(space)) :]
            bare = kept[-1].rstrip(space)
            if at >= len(t) or ("\n" in behind and "\n" not in kept[-1][len(bare) :] and (bare or len(kept) > 1)):
                kept[-1] = bare + behind
        out.append("".join(kept) + t[at:])
    return pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` (and ``n_chars``, if it is there) rewritten, and ``n_lines``, ``gone`` added.

    Passages are compared word by word, whatever white space parts the words, and may
    start and end inside a line. ``gone`` has their spans of characters with the white
    space behind them. Nothing under ``min_words`` words in a row is ever deleted, nor a
    passage that overlaps its own earlier place. Null texts stay null and empty ones
    empty. Rows without a doc_id come after all others; texts of one doc_id, and of none,
    are ordered by a hash. Repeated rows (same doc_id, or none, and same text) count as
    one document and are all treated alike. All other columns are carried along,
    whatever their names; columns ``n_lines`` and ``gone`` of ``docs`` give way to the new
    ones. An empty table gives no row.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    col = dict(zip(docs.columns, names))
    gone = repeated_windows(docs.select("doc_id", "text"), min_words)
    text = F.coalesce(F.col(col["text"]), F.lit(""))
    keyed = docs.toDF(*names).withColumn("id", F.coalesce(F.col(col["doc_id"]).cast("long"), F.lit(LAST))).withColumn("mark", F.xxhash64(text))
    out = keyed.join(gone, (F.col("id") == F.col("doc_id")) & (F.col("mark") == F.col("text_hash")), "left")
    loses = F.col("text_hash").isNotNull()
    none = F.array().cast("array<struct<begin: int, end: int>>")
    out = out.withColumn("made", _rewritten(min_words)(F.when(loses, text), F.col("begins"), F.coalesce("copy", F.lit(False))))
    new = F.when(loses, F.col("made.left")).otherwise(F.col(col["text"]))
    kept = {"text": new, "n_chars": F.char_length(new).cast("long")}
    lines = F.coalesce(F.size(F.split(F.col(col["text"]), "\n", -1)), F.lit(0)).cast("long")
    return out.select(
        *(kept.get(c, F.col(n)).alias(c) for c, n in col.items() if c not in ("n_lines", "gone")),
        lines.alias("n_lines"), F.when(loses, F.col("made.spans")).otherwise(none).alias("gone"),
    )
