"""Byte-pair encoding with word ends, by backtracking, and decoding.

The encoder walks a word from the left. An Aho-Corasick automaton of the vocabulary (run
from the right over reversed tokens) gives the longest token that starts at each place; a
token may stand next to the one before it only if no merge would have crossed the border
between them, which a table of pairs remembers. Where no token fits, the walk steps back
and never tries that place again, so the merges are those of the merge list in time that
grows with the word's length. All new words of an Arrow batch take each step together, as
numpy arrays, and words that recur in the batch are encoded once.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from fieldjobs.llm.words import find_words, groups, numbered, text_bytes

#: Bytes of text encoded together, and written out together, about.
AT_ONCE, WRITTEN = 16_000_000, 2_000_000
#: Words of more bytes than this are walked one by one.
LONG = 400
#: Pairs of tokens that the compatibility table holds (a power of two).
PAIRS = 1 << 20
END = "</w>"
SPACE, LETTER, NUMBER, OTHER, NEW = 0, 1, 2, 3, 4
_NEVER = np.int64(1) << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


@functools.cache
def character_classes() -> tuple[list[int], list[int]]:
    """Runs of code points and their class, by the Unicode version of the tokenizers library.

    NEW is added to the class of code points that this Python's Unicode version doesn't know.
    """
    from tokenizers import Regex, pre_tokenizers

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    found = np.full(len(points), OTHER, np.uint8)
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for _, (a, b) in pre_tokenizers.Split(Regex(name), "removed", invert=True).pre_tokenize_str(text):
            found[a:b] = kind
    for m in regex.finditer(r"\s+", text):
        found[m.start() : m.end()] = SPACE
    found[[unicodedata.category(c) == "Cn" for c in text]] += NEW
    table = np.full(0x110000, OTHER, np.uint8)
    table[points] = found
    first = np.flatnonzero(np.diff(table, prepend=255))
    return np.diff(first, append=len(table)).tolist(), table[first].tolist()


class Merges:
    """A list of merges over strings of symbols: below 256 a byte, beyond it a byte that ends its word."""

    def __init__(self, tokens: dict[tuple[int, ...], int], merges: list[tuple[tuple[int, ...], tuple[int, ...]]]):
        n = max(tokens.values()) + 1
        self.size = np.zeros(n, np.int64)
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for t, i in tokens.items():
            self.size[i] = len(t)
        merged: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            pair, made = (tokens[a], tokens[b]), tokens[a + b]
            merged.setdefault(pair, (r, made))
            if self.rank[made] < 0:
                self.rank[made], (self.left[made], self.right[made]) = r, pair
        keys = np.array([a << 32 | b for a, b in merged], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in merged.values()], np.int64)[order]
        self._forget()

        single = {t[0]: i for t, i in tokens.items() if len(t) == 1}

        def reached(t: tuple[int, ...]) -> bool:
            """Whether merging the token's own symbols in the order of the merge list ends at the token."""
            parts = [single[s] for s in t]
            while len(parts) > 1:
                r, made, at = min((*merged.get(p, (n * n, 0)), j) for j, p in enumerate(zip(parts, parts[1:])))
                if r == n * n:
                    return False
                parts[at : at + 2] = [made]
            return True

        usable = {t: i for t, i in tokens.items() if len(t) == 1 or reached(t)}
        self.shorter = np.full(n, -1, np.int64)
        for t, i in usable.items():
            self.shorter[i] = next((usable[t[:m]] for m in range(len(t) - 1, 0, -1) if t[:m] in usable), -1)
        self._automaton(usable)

    def _forget(self) -> None:
        self.known_pairs, self.known_fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("known_pairs", "known_fits")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self._forget()

    def _automaton(self, usable: dict[tuple[int, ...], int]) -> None:
        """Moves of the automaton, sixteen bytes to a block. A node has the blocks of the node it falls back to, but for those that its own edges lie in."""
        ids, sizes = np.fromiter(usable.values(), np.int64), np.fromiter(map(len, usable), np.int64)
        symbols = np.fromiter((s for t in usable for s in reversed(t)), np.int64)
        begin, node = np.cumsum(sizes) - sizes, np.zeros(len(ids), np.int64)
        n, made, levels, live = 1, 16, [], np.arange(len(ids))
        while len(live):
            edges, which = np.unique(node[live] << 9 | symbols[begin[live] + len(levels)], return_inverse=True)
            node[live] = n + which
            levels.append((edges >> 9, edges & 511, np.arange(n, n + len(edges))))
            n += len(edges)
            made += len(np.unique(edges >> 4)) if len(levels) > 1 else 0
            live = live[sizes[live] > len(levels)]
        self.blocks, self.moves = np.zeros((n, 16), np.int32), np.zeros((made, 16), np.int32)
        self.first = np.zeros(512, np.int32)  # from the start, word ends too
        self.longest = np.full(n, -1, np.int64)
        self.longest[node] = ids
        _, s, nodes = levels[0]
        self.first[s] = nodes
        self.blocks[0], self.moves[:16] = np.arange(16), self.first[:256].reshape(16, 16)
        fail, made = np.zeros(n, np.int64), 16
        for v, s, w in [*levels[1:], (None, None, None)]:
            self.blocks[nodes] = self.blocks[fail[nodes]]
            self.longest[nodes] = np.where(self.longest[nodes] >= 0, self.longest[nodes], self.longest[fail[nodes]])
            if w is None:
                break
            fail[w] = self.step(v, s)
            own, which = np.unique(v << 4 | s >> 4, return_inverse=True)
            new = np.arange(made, made + len(own))
            self.moves[new] = self.moves[self.blocks[own >> 4, own & 15]]
            self.moves[new[which], s & 15] = w
            self.blocks[own >> 4, own & 15] = new
            nodes, made = w, made + len(own)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states that bytes lead to."""
        return self.moves[self.blocks[state, byte >> 4], byte & 15]

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each two tokens, side by side, are what merging would leave."""
        keys = left << 32 | right
        slot = ((keys * np.int64(-7046029254386353131)) >> 40) & (PAIRS - 1)
        out = self.known_fits[slot]
        new = np.flatnonzero(self.known_pairs[slot] != keys)
        if len(new):
            asked, which = np.unique(keys[new], return_inverse=True)
            made = self._apart(asked >> 32, asked & 0xFFFFFFFF)
            out[new] = made[which]
            at = ((asked * np.int64(-7046029254386353131)) >> 40) & (PAIRS - 1)
            self.known_fits[at], self.known_pairs[at] = made, asked
            # where two pairs want one slot, the slot must hold one whole pair
            self.known_fits[at] = made[np.searchsorted(asked, self.known_pairs[at])]
        return out

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        # undo the later of the two tokens' last merges again and again; a merge across the border
        # that comes before the merge just undone would have happened first
        out = np.ones(len(left), bool)
        left, right = left.copy(), right.copy()
        made, todo = np.full(len(left), _NEVER), np.arange(len(left))
        while len(todo):
            a, b = left[todo], right[todo]
            key = a << 32 | b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)
            crossed = across < made[todo]
            out[todo[crossed]] = False
            x, y = self.rank[a], self.rank[b]
            go = ~crossed & ((x >= 0) | (y >= 0))
            todo, a, b, x, y = todo[go], a[go], b[go], x[go], y[go]
            first = x > y
            made[todo] = np.where(first, x, y + 1)
            left[todo] = np.where(first, self.right[a], a)
            right[todo] = np.where(first, b, self.left[b])
        return out

    def encode(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, word_ends: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (runs of bytes, none empty, in order, apart), and how many each has."""
        longest = np.zeros(len(data), np.int64)
        sizes = ends - begins
        many = np.flatnonzero(sizes <= LONG)
        many = many[np.argsort(-sizes[many], kind="stable")]
        state = self.first[data[ends[many] - 1].astype(np.int64) + 256 * word_ends].astype(np.int64)
        longest[ends[many] - 1] = self.longest[state]
        still = np.searchsorted(-sizes[many], -np.arange(1, LONG + 2), side="right")  # words of at least so many bytes
        for back in range(2, LONG + 1):
            n = int(still[back - 1])
            if n == 0:
                break
            at = ends[many[:n]] - back
            state = self.step(state[:n], data[at])
            longest[at] = self.longest[state]
        token = np.zeros(len(data), np.int64)
        stands = np.zeros(len(data), bool)
        self._walk(begins[many], ends[many], longest, token, stands)
        for i in np.flatnonzero(sizes > LONG).tolist():
            self._walk_one(data, int(begins[i]), int(ends[i]), word_ends, token, stands)
        counts = np.concatenate([[0], np.cumsum(stands)])
        return token[stands], counts[ends] - counts[begins]

    def _walk(self, begin: np.ndarray, end: np.ndarray, longest: np.ndarray, token: np.ndarray, stands: np.ndarray) -> None:
        """Backtracking of all words at once. ``token`` and ``stands``: the token that starts at a place, and whether one does."""
        before = np.full(len(token), -1, np.int64)
        shut = np.zeros(len(token) + 1, bool)  # by the last byte before a place, so that words don't share places
        at, last, now = begin, np.full(len(begin), -1, np.int64), longest[begin]
        while len(at):
            to = at + self.size[now]
            fit = ~shut[to - 1]
            check = np.flatnonzero(fit & (last >= 0))
            fit[check] = self.fits(token[last[check]], now[check])
            put = np.flatnonzero(fit)
            token[at[put]], before[at[put]], stands[at[put]] = now[put], last[put], True
            miss = np.flatnonzero(~fit)
            less = self.shorter[now[miss]]
            back = miss[less < 0]
            now[miss] = less
            if len(back):
                shut[at[back] - 1] = True
                at_back = last[back]
                if (at_back < 0).any():
                    raise ValueError("no tokens make up a word")
                now[back], stands[at_back] = token[at_back], False
                last[back], at[back] = before[at_back], at_back
            last[put], at[put] = at[put], to[put]
            go = np.ones(len(at), bool)
            go[put] = to[put] < end[put]
            more = put[go[put]]
            now[more] = longest[at[more]]
            at, last, now, end = at[go], last[go], now[go], end[go]

    def _walk_one(self, data: np.ndarray, begin: int, end: int, word_ends: bool, token: np.ndarray, stands: np.ndarray) -> None:
        """The same for one long word, step by step."""
        n = end - begin
        word = data[begin:end].tolist()
        state, longest = int(self.first[word[-1] + 256 * word_ends]), [0] * n
        longest[-1] = int(self.longest[state])
        for j in range(n - 2, -1, -1):
            state = int(self.step(state, word[j]))
            longest[j] = int(self.longest[state])
        fits: dict[tuple[int, int], bool] = {}
        out, at, shut, now = [], 0, bytearray(n + 1), longest[0]
        while at < n:
            while now >= 0:
                size = int(self.size[now])
                if not shut[at + size]:
                    if not out:
                        break
                    pair = (out[-1], now)
                    if pair not in fits:
                        if len(fits) > PAIRS:
                            fits.clear()
                        fits[pair] = bool(self.fits(np.array([pair[0]]), np.array([pair[1]]))[0])
                    if fits[pair]:
                        break
                now = int(self.shorter[now])
            if now >= 0:
                out.append(now)
                at += int(self.size[now])
                now = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("no tokens make up a word")
                shut[at] = 1
                now = out.pop()
                at -= int(self.size[now])
        places = begin + np.cumsum([0, *(int(self.size[t]) for t in out[:-1])])
        token[places], stands[places] = out, True


class WordBpe:
    """A vocabulary file with its encoder and decoder."""

    def __init__(self, path: str, classes: tuple[list[int], list[int]]):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        byte = {c: b for b, c in enumerate(byte_alphabet())}

        def symbols(t: str) -> tuple[int, ...]:
            if t.endswith(END) and len(t) > len(END):
                t = t[: -len(END)]
                return (*(byte[c] for c in t[:-1]), 256 + byte[t[-1]])
            return tuple(byte[c] for c in t)

        self.merges = Merges({symbols(t): i for t, i in vocab.items()}, [(symbols(a), symbols(b)) for a, b in spec["model"]["merges"]])
        self.classes = np.repeat(np.array(classes[1], np.uint8), classes[0])
        names = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            names[i] = t.encode() + b" "
        self.blob, self.offsets = np.frombuffer(b"".join(names), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in names])])
        digits = [b"%d " % i for i in range(len(names))]
        self.digits, self.digit_at = np.frombuffer(b"".join(digits), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in digits])])

    @functools.cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).normalizer

    def _normalised(self, text: str) -> str:
        """NFC and lower case, space by space. Runs with characters newer than this Python's Unicode are left to the library's normaliser."""
        if text.isascii():
            return text.lower()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        new = np.flatnonzero(self.classes[points] >= NEW)
        if len(new):
            chunks = text.split(" ")
            for i in set(np.cumsum(points == 0x20)[new].tolist()):
                chunks[i] = self._library.normalize_str(chunks[i]).replace(" ", "\n")
            text = " ".join(chunks)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _pieces(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First character, character behind the end, and number of its chunk, of each pre-token of chunks joined by spaces."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.classes[points] & 3
        start = (kind != SPACE) & ((kind != np.concatenate([[SPACE], kind[:-1]])) | (kind == NUMBER))
        # an apostrophe that opens a run of marks takes one of these endings along
        q = np.flatnonzero(start & (points == ord("'")))
        if len(q):
            one, two = (np.concatenate([points, [0, 0]])[q + i] for i in (1, 2))
            short = np.isin(one, [ord(c) for c in "stmd"])
            pair = np.isin(one << 8 | two, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]) & (two < 256)
            start[q[short | pair] + 1] = False
            after = np.concatenate([q[short] + 2, q[pair] + 3])
            after = after[after < len(points)]
            start[after] = kind[after] != SPACE
        first = np.flatnonzero(start)
        borders = np.append(np.flatnonzero(start | (kind == SPACE)), len(points))
        return first, borders[np.searchsorted(borders, first, side="right")], np.cumsum(points == 0x20)[first]

    def encode_chunks(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text, and the offsets of those of each run between its spaces."""
        if self.specials.search(text):
            return self._with_specials(text)
        text = self._normalised(text)
        first, last, owner = self._pieces(text)
        data = np.frombuffer(text.encode(), np.uint8)
        place = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))
        ids, counts = self.merges.encode(data, place[first], place[last], True)
        per_chunk = np.bincount(owner, weights=counts, minlength=text.count(" ") + 1).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_chunk)])

    def _with_specials(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        chunks = text.split(" ")
        odd = [i for i, c in enumerate(chunks) if self.specials.search(c)]
        plain, at = self.encode_chunks(" ".join(["" if self.specials.search(c) else c for c in chunks]))
        parts, done, more = [], 0, np.zeros(len(chunks), np.int64)
        for i in odd:
            ids, begin = [], 0
            for m in [*self.specials.finditer(chunks[i]), None]:
                ids += self.encode_chunks(chunks[i][begin : m.start() if m else len(chunks[i])])[0].tolist()
                if m:
                    ids.append(self.special[m[0]])
                    begin = m.end()
            parts += [plain[done : at[i]], np.array(ids, np.int64)]
            done, more[i] = at[i], len(ids)
        return np.concatenate([*parts, plain[done:]]), at + np.concatenate([[0], np.cumsum(more)])

    def encode(self, text: str) -> list[int]:
        """Token ids of a text; the strings of special tokens stand for themselves."""
        return self.encode_chunks(text)[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings, read off one string by an offset table and set apart by spaces."""
        at = self.offsets
        return self.blob[np.concatenate([np.arange(at[i], at[i + 1]) for i in ids])[:-1]].tobytes().decode() if len(ids) else ""

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of several texts and the offsets of each one's. Runs between spaces are encoded once each."""
        data, at = text_bytes(texts)
        # a space ends a pre-token and no normaliser joins across it
        h, start, length = find_words(data, at, BETWEEN_SPACES, fold=False)
        one, which = numbered(data, start, length, h)
        pool, ends = self.encode_chunks(spaced(data, start[one], length[one]))
        ids, offsets = expanded(pool, ends, which)
        return ids, offsets[np.searchsorted(start, at)]


BETWEEN_SPACES = np.arange(256) != 0x20


def spaced(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> str:
    """Runs of bytes, joined by spaces."""
    if not len(start):
        return ""
    out = np.full(int(length.sum()) + len(start) - 1, 0x20, np.uint8)
    ends = np.cumsum(length + 1)
    from_, to = ranges(start, length), ranges(ends - length - 1, length)
    out[to] = data[from_]
    return out.tobytes().decode()


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as each length, end to end."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def expanded(pool: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pool's parts (from ``ends[i]`` to ``ends[i + 1]``) in the order asked for, and where each begins."""
    sizes = ends[which + 1] - ends[which]
    return pool[ranges(ends[which], sizes)], np.concatenate([[0], np.cumsum(sizes)])


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str, classes: tuple[list[int], list[int]]) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path, classes)
    return _LOADED[path]


def _hashes(blob: np.ndarray, at: np.ndarray, ids: np.ndarray, cuts: np.ndarray) -> list[str]:
    """The SHA-256 of each text's tokens, written out by an offset table, without the last space."""
    size = at[ids + 1] - at[ids]
    written = memoryview(blob[ranges(at[ids], size)].tobytes())
    ends = np.concatenate([[0], np.cumsum(size)])[cuts].tolist()
    return [hashlib.sha256(written[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends, ends[1:])]


def _digests(path: str, classes: tuple[list[int], list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, classes)
        for batch in batches:
            texts = batch.column("text")
            for part in groups(texts, AT_ONCE):
                some = texts[part]
                ids, at = bpe.batch(some)
                shas: list[list[str]] = [[], []]
                for few in groups(some, WRITTEN):
                    mine, cuts = ids[at[few.start] : at[few.stop]], at[few.start : few.stop + 1] - at[few.start]
                    shas[0] += _hashes(bpe.digits, bpe.digit_at, mine, cuts)
                    shas[1] += _hashes(bpe.blob, bpe.offsets, mine, cuts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], pa.array(np.diff(at)), *(pa.array(x, pa.string()) for x in shas)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` per row; null texts count as empty."""
    classes = character_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, classes)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return _source(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Null and empty texts have no tokens. Null doc_ids and repeated rows are returned as
    they come; other columns are ignored. An empty table gives no row. No row moves
    between tasks.
    """
    return _source(docs).mapInArrow(_digests(path, character_classes()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
