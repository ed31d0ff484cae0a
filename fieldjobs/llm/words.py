"""Vectorised word hashing over whole Arrow batches of texts.

A word is hashed by mixing its bytes eight at a time, all words of a batch together, so a
batch needs a handful of numpy passes and no loop over words or documents; the few very
long words are hashed one by one with blake2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Words of more bytes than this are hashed one by one.
LONG = 64
#: Bytes of text hashed at a time, about; only a longer text makes a larger part.
PART = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def byte_class(word_bytes: str) -> np.ndarray:
    """Which bytes belong to words. ``space``: all but white space; ``alnum``: digits, letters and all beyond ASCII."""
    table = np.ones(256, bool)
    if word_bytes == "space":
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[:0x80] = False
        table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SPACE_WORDS, ALNUM_WORDS = byte_class("space"), byte_class("alnum")
#: The low bytes of a 64-bit number that 0 to 8 bytes of text fill.
_FILLED = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the offsets of each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def _cuts(at: np.ndarray, most: int) -> Iterator[slice]:
    begin = 0
    while begin < len(at) - 1:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
        yield slice(begin, end)
        begin = end


def groups(texts: pa.Array, most: int) -> Iterator[slice]:
    """Texts of about so many bytes in all at a time; only one longer text makes a larger group."""
    return _cuts(text_bytes(texts)[1], most)


def few_at_a_time(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """Batches of about ``PART`` bytes in the text ``columns``, so that a worker's memory doesn't grow with the length of its rows."""
    for batch in batches:
        for part in _cuts(sum(text_bytes(batch.column(c))[1] for c in columns), PART):
            yield batch.slice(part.start, part.stop - part.start)


def eights_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hash_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of bytes; runs of up to eight bytes never share one."""
    eights = eights_of(data)
    out = mix(lengths.astype(_U) + _U(seed))
    todo = np.flatnonzero((lengths > 0) & (lengths <= LONG))
    done = 0
    while len(todo):
        left = lengths[todo] - done
        value = eights[starts[todo] + done] & _FILLED[np.minimum(left, 8)]
        out[todo] = mix(out[todo] + value + _U(0x9E3779B97F4A7C15))
        done += 8
        todo = todo[left > 8]
    for i in np.flatnonzero(lengths > LONG).tolist():
        run = data[starts[i] : starts[i] + lengths[i]]
        out[i] = int.from_bytes(hashlib.blake2b(run, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def find_words(data: np.ndarray, at: np.ndarray, is_word: np.ndarray = SPACE_WORDS, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and length of each word in texts that lie end to end from the offsets ``at``. fold: A-Z count as a-z."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    return hash_words(LOWER[data] if fold else data, starts, lengths), starts, lengths


def numbered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct run of bytes, and which of them each run is.

    Runs are grouped by hash and compared with their group's first, byte by byte; those
    that differ (a clash of hashes) get a number of their own by their bytes.
    """
    _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    head = one[which]
    differs = lengths != lengths[head]
    eights = eights_of(data)
    todo, done = np.flatnonzero(~differs & (head != np.arange(len(head)))), 0
    while len(todo):
        left = lengths[todo] - done
        held = _FILLED[np.minimum(left, 8)]
        same = (eights[starts[todo] + done] ^ eights[starts[head[todo]] + done]) & held == 0
        differs[todo[~same]] = True
        todo = todo[same & (left > 8)]
        done += 8
    if differs.any():
        odd: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(differs).tolist():
            run = data[starts[i] : starts[i] + lengths[i]].tobytes()
            if run not in odd:
                odd[run] = len(one) + len(more)
                more.append(i)
            which[i] = odd[run]
        one = np.concatenate([one, more])
    return one, which


def word_hashes(texts: pa.Array, is_word: np.ndarray = SPACE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the offsets of each text's words."""
    data, at = text_bytes(texts)
    found, where, _ = find_words(data, at, is_word)
    return found, np.searchsorted(where, at)


def sequence_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), _U)
    for j in range(k):
        if n > 0:
            out = mix(out + h[j : j + n] + _U(0x632BE59BD9B4E019 * (j + 1) & (2**64 - 1)))
    return out


def _shingled(h: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    grams = sequence_hashes(h, k)
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield mix(sequence_hashes(h[a:b], int(b - a)) + _U(b - a))
        else:
            yield np.zeros(0, _U)


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text under k words has its whole sequence, none has none."""
    return _shingled(*word_hashes(texts), k)


def verified_shingle_sets(a: pa.Array, b: pa.Array, k: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The shingle sets of each two texts; words are told apart byte by byte, not by their hashes alone."""
    data, at = text_bytes(pa.chunked_array([a, b]))
    data = LOWER[data]
    h, starts, lengths = find_words(data, at, fold=False)
    _, which = numbered(data, starts, lengths, h)
    sets = list(_shingled(mix(which.astype(_U)), np.searchsorted(starts, at), k))
    return zip(sets[: len(a)], sets[len(a) :])
