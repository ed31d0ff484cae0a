"""Fill-in-middle by content-defined chunks.

Texts are cut into chunks where a rolling hash of the last eight bytes says so, so equal
passages give equal chunks wherever they stand. Of each distinct chunk (equal hashes are
compared byte by byte) a summary is made once: the units that end inside it, whether it
opens with white space or closes with a word, and its characters. Adding up summaries,
with a look at each border, numbers the units of a whole text and names the chunk that
holds the n-th unit's end; only there is the place looked up. No row moves between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fieldjobs.llm.bpe import ranges
from fieldjobs.llm.words import SPACE_WORDS, groups, hash_words, mix, numbered, text_bytes

#: Bytes of text cut at a time, about; only a longer text makes a larger part.
PART = 1 << 22
#: A chunk's mean and largest number of bytes (powers of two).
MEAN, MOST = 32, 64
#: What stands before a prefix, a suffix and a middle.
MARKS = ("<P>", "<S>", "<M>")


class Chunks:
    """Chunks of texts that lie end to end, and the summaries of the distinct ones."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.at, n = at, len(data)
        eights = np.ndarray((max(n - 7, 0),), "<u8", data, strides=(1,)) if n > 7 else np.zeros(0, np.uint64)
        cut = np.zeros(n + 1, bool)
        cut[8 : n + 1] = mix(eights) % np.uint64(MEAN) == 0  # behind the eight bytes
        for back in range(8):  # a hash never reaches into the text before
            near = at[:-1] + back
            cut[near[near < np.maximum(at[1:], at[:-1] + 1)]] = False
        cut[at] = True
        start = np.flatnonzero(cut[:n])
        length = np.diff(np.append(start, n))
        parts = -(-length // MOST)
        nth = ranges(np.zeros(len(parts), np.int64), parts)
        self.start = np.repeat(start, parts) + nth * MOST
        self.length = np.diff(np.append(self.start, n))
        one, self.which = numbered(data, self.start, self.length, hash_words(data, self.start, self.length))
        self._summarise(data, self.start[one], self.length[one])
        which, inside = self.which, self.inner[self.which]
        # a unit ends at a chunk's last byte if that belongs to a word and white space or the text's end follows
        texts_end = np.isin(self.start + self.length, at[1:])
        opens = np.append(self.opens[which[1:]], True) if len(which) else np.zeros(0, bool)
        self.closing = self.closes[which] & (opens | texts_end)
        self.units = np.concatenate([[0], np.cumsum(inside + self.closing)])
        self.chars = np.concatenate([[0], np.cumsum(self.pool_chars[self.first[which + 1]] - self.pool_chars[self.first[which]])])
        at_chunk = np.searchsorted(self.start, at)
        self.words_before, self.chars_before = self.units[at_chunk], self.chars[at_chunk]
        blank = np.zeros(len(at) - 1, np.int64)
        long = np.diff(at) > 0
        blank[long] = ~SPACE_WORDS[data[at[1:][long] - 1]]
        self.n_words = np.diff(self.words_before)
        self.n = self.n_words + blank

    def _summarise(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        pool = data[ranges(start, length)]
        self.first = np.concatenate([[0], np.cumsum(length)])
        word = np.append(SPACE_WORDS[pool], False)
        self.opens, self.closes = ~word[self.first[:-1]], word[self.first[1:] - 1]
        ends = word[:-1] & ~word[1:]
        ends[self.first[1:] - 1] = False  # what follows isn't known here
        self.ends = np.flatnonzero(ends)
        self.first_end = np.searchsorted(self.ends, self.first)
        self.inner = np.diff(self.first_end)
        self.pool_chars = np.concatenate([[0], np.cumsum((pool & 0xC0) != 0x80)])

    def cut_at(self, text: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and characters of each text before the end of so many of its units."""
        size, chars = (self.at[text + 1] - self.at[text]), self.chars_before[text + 1] - self.chars_before[text]
        whole = units > self.n_words[text]  # the white space at the end is the last unit
        out, out_chars = np.where(whole, size, 0), np.where(whole, chars, 0)
        some = np.flatnonzero((units > 0) & ~whole)
        nth = self.words_before[text[some]] + units[some]
        chunk = np.searchsorted(self.units, nth, side="left") - 1
        nth = nth - self.units[chunk]
        which = self.which[chunk]
        inside = nth <= self.inner[which]
        place = self.first[which + 1]
        place[inside] = self.ends[self.first_end[which[inside]] + nth[inside] - 1] + 1
        into = place - self.first[which]
        out[some] = self.start[chunk] + into - self.at[text[some]]
        out_chars[some] = self.chars[chunk] + self.pool_chars[place] - self.pool_chars[self.first[which]] - self.chars_before[text[some]]
        return out, out_chars


def _transform(percent: int, spm_percent: int, marks: tuple[str, str, str]):
    p, s, m = (x.encode() for x in marks)
    most = PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch.column("text"), most):
                some = batch.slice(part.start, part.stop - part.start)
                data, at = text_bytes(some.column("text"))
                chunks = Chunks(data, at)
                drawn = [[int(d[i : i + 8], 16) for i in range(0, 32, 8)] for d in some.column("draw").to_pylist()]
                h = np.array(drawn, np.int64).reshape(-1, 4)
                a, b = h[:, 0] % (chunks.n + 1), h[:, 1] % (chunks.n + 1)
                row = np.arange(len(at) - 1)
                begin, before = chunks.cut_at(row, np.minimum(a, b))
                end, upto = chunks.cut_at(row, np.maximum(a, b))
                whole = data.tobytes()
                out, forms = [], []
                for i, (x, y, cut, stop) in enumerate(zip(at.tolist(), at[1:].tolist(), begin.tolist(), end.tolist())):
                    text = whole[x:y]
                    if not text or p in text or s in text or m in text or h[i, 2] % 100 >= percent:
                        forms.append("plain")
                        out.append(text)
                        continue
                    prefix, middle, suffix = text[:cut], text[cut:stop], text[stop:]
                    spm = h[i, 3] % 100 < spm_percent
                    forms.append("spm" if spm else "psm")
                    out.append(b"".join([s, suffix, p, prefix, m, middle] if spm else [p, prefix, s, suffix, m, middle]))
                plain = np.array([f == "plain" for f in forms], bool)
                made = [pa.array(chunks.n, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64(), mask=plain), pa.array(upto - before, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *made], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, percent: int = 50, spm_percent: int = 80, seed: int = 42, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    A unit is a word with the white space before it, or the white space that ends a text;
    ``n`` counts them. Two of the draws that SHA-256 of ``seed:doc_id`` gives place the
    cuts, one says whether the text is cut at all, one whether the suffix comes first.
    A text that is null, empty or holds a mark stays plain, with null lengths. A null
    doc_id draws as an empty one, repeated rows draw alike. Other columns are ignored; an
    empty table gives no row.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.sha2(key, 256).alias("draw"))
    return src.mapInArrow(_transform(percent, spm_percent, marks), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from. Parts hold no marks, so the first of each kind ends what stands before it."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.char_length(one) + F.lit(len(second) + 1))
        two = F.substring_index(rest, marks[2], 1)
        return one, two, F.substr(rest, F.char_length(two) + F.lit(len(marks[2]) + 1))

    prefix, suffix, middle = parts(marks[0], marks[1])
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(marks[1], marks[0])
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
