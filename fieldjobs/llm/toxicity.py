"""Toxic documents by fuzzy lexicon matching with context windows.

The lexicon is learned: word beginnings and whole words that mark labelled toxic texts.
It is kept as a trie and intersected with a Levenshtein automaton of one edit. States of
the product are made as the texts need them and are shared by all words, so a batch of
texts is matched in as many numpy steps as its longest word that still can match. A hit
inside quotation marks within its context window counts as a quotation, apart from
abuse. How much each kind of hit weighs is learned from labelled rows.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fieldjobs.llm.recovery import cut
from fieldjobs.llm.words import few_at_a_time

#: Labelled rows that the lexicon and the weights are learned from, at most about so many.
TRAINING_ROWS = 40_000
SHORTEST, LONGEST = 4, 12
#: Entries of at least this many letters also match with one edit.
FUZZY_FROM = 5
#: Characters on either side of a hit in which quotation marks are looked for.
WINDOW = 60
#: An entry is this much likelier in toxic texts, and in this share of them at least.
RATIO, SHARE = 20.0, 0.004
#: What a misspelt and a quoted hit count for.
MISSPELT, QUOTED = 0.8, 0.3
WHOLE = "$"
#: Characters that may stand in for letters inside a word.
INSIDE = "*@$#_'-"
#: Quotation marks.
QUOTES = "\"“”„«»‹›"


def _classes() -> np.ndarray:
    """By code point: 0 between words, 1 in words. ASCII besides INSIDE, digits and letters is between; so are spaces, dashes and marks beyond."""
    out = np.ones(0x110000, np.uint8)
    out[:0x80] = [chr(c).isalnum() or chr(c) in INSIDE for c in range(0x80)]
    out[[0x85, 0xA0, 0xA1, 0xAB, 0xB7, 0xBB, 0xBF, 0x1680, 0x202F, 0x205F, 0x3000]] = 0
    out[0x2000:0x2070] = 0
    out[0x3001:0x3030] = 0
    return out


def _folds() -> np.ndarray:
    """By code point below 0x600: its lower case, where that is one character."""
    return np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x600)], np.uint32)


_CLASSES, _FOLDS = _classes(), _folds()
QUOTE_POINTS = np.array([ord(c) for c in QUOTES], np.uint32)


class Matcher:
    """The product of a lexicon trie and a one-edit automaton, with states made on demand."""

    def __init__(self, entries: list[str]):
        self.entries = entries
        self.letters = {c: i + 2 for i, c in enumerate(sorted({c for e in entries for c in e.rstrip(WHOLE)}))}
        self.table = _CLASSES.astype(np.int16)
        for c, i in self.letters.items():
            self.table[ord(c)] = i
        self.width = len(self.letters) + 2
        self.children: list[dict[int, int]] = [{}]
        self.stem: list[int] = [-1]  # the entry that a beginning fulfils
        self.word: list[int] = [-1]  # the entry that a whole word fulfils
        self.fuzzy: list[bool] = [False]  # whether an entry below may match with an edit
        for e, entry in enumerate(entries):
            node, text = 0, entry.rstrip(WHOLE)
            loose = len(text) >= FUZZY_FROM
            self.fuzzy[0] |= loose
            for c in text:
                if self.letters[c] not in self.children[node]:
                    self.children[node][self.letters[c]] = len(self.children)
                    self.children.append({})
                    self.stem.append(-1)
                    self.word.append(-1)
                    self.fuzzy.append(False)
                node = self.children[node][self.letters[c]]
                self.fuzzy[node] |= loose
            (self.word if entry.endswith(WHOLE) else self.stem)[node] = e
        self.states: dict = {}
        self.sets: list = []
        self.next = np.full((64, self.width), -1, np.int32)
        self.found = np.full(64, -1, np.int64)  # 2 * entry + edits, of a word that ends in the state
        self.dead = self._state(frozenset(), None)
        self.start = self._state(self._closed({(0, 0)}), None)

    def _loose(self, e: int) -> bool:
        return len(self.entries[e].rstrip(WHOLE)) >= FUZZY_FROM

    def _closed(self, places) -> frozenset:
        """With the places that leaving out a letter of an entry reaches."""
        more = {(child, 1) for node, edits in places if edits == 0 and self.fuzzy[node] for child in self.children[node].values() if self.fuzzy[child]}
        places = set(places) | more
        return frozenset(p for p in places if p[1] == 0 or (p[0], 0) not in places)

    def _state(self, places: frozenset, done: tuple[int, int] | None) -> int:
        for node, edits in places:
            e = self.stem[node]
            if e >= 0 and (edits == 0 or self._loose(e)) and (done is None or (edits, e) < done):
                done = (edits, e)
        if done is not None and done[0] == 0:
            places = frozenset()  # nothing can be better
        if (known := self.states.get((places, done))) is not None:
            return known
        n = self.states[places, done] = len(self.sets)
        self.sets.append((places, done))
        if n >= len(self.found):
            self.next = np.vstack([self.next, np.full_like(self.next, -1)])
            self.found = np.concatenate([self.found, np.full_like(self.found, -1)])
        best = done
        for node, edits in places:
            e = self.word[node]
            if e >= 0 and (edits == 0 or self._loose(e)) and (best is None or (edits, e) < best):
                best = (edits, e)
        if best is not None:
            self.found[n] = 2 * best[1] + best[0]
        return n

    def _step(self, state: int, letter: int) -> int:
        places, done = self.sets[state]
        to = set()
        for node, edits in places:
            if (child := self.children[node].get(letter)) is not None:
                to.add((child, edits))
            if edits == 0 and self.fuzzy[node]:
                to.add((node, 1))  # a letter put in
                to.update((c, 1) for c in self.children[node].values() if self.fuzzy[c])  # a letter exchanged
        return self._state(self._closed(to), done)

    def hits(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each hit in a text: 2 * entry + edits, first character, and whether it is quoted."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.where(points < 0x600, _FOLDS[np.minimum(points, 0x5FF)], points)
        letters = self.table[low]
        inside = letters > 0
        first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) if len(points) else np.zeros(0, np.int64)
        last = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1 if len(points) else first
        state = np.full(len(first), self.start, np.int32)
        alive = np.arange(len(first))
        step = 0
        while len(alive):
            alive = alive[last[alive] - first[alive] > step]
            letter = letters[first[alive] + step]
            to = self.next[state[alive], letter]
            if (new := np.flatnonzero(to < 0)).size:
                for s, c in {(int(s), int(c)) for s, c in zip(state[alive[new]], letter[new])}:
                    n = self._step(s, c)
                    self.next[s, c] = n
                to = self.next[state[alive], letter]
            state[alive] = to
            alive = alive[to != self.dead]
            step += 1
        found = self.found[state]
        hit = np.flatnonzero(found >= 0)
        at = first[hit]
        marks = np.flatnonzero(np.isin(low, QUOTE_POINTS)) if len(hit) else np.zeros(0, np.int64)
        before, after = np.searchsorted(marks, at - WINDOW), np.searchsorted(marks, at)
        end = np.searchsorted(marks, at + WINDOW)
        # an odd number of marks before the hit in its window and one after it
        quoted = ((after - before) % 2 == 1) & (end > after)
        return found[hit], at, quoted


def _words(text: str) -> set[str]:
    low = text.lower()
    return set("".join(c if _CLASSES[ord(c)] else " " for c in set(low)) and low.translate({ord(c): " " for c in set(low) if not _CLASSES[ord(c)]}).split())


def _beginnings(text: str) -> set[str]:
    out = set()
    for w in _words(text):
        out.update(w[:n] for n in range(SHORTEST, min(len(w), LONGEST) + 1))
        if SHORTEST <= len(w) <= LONGEST:
            out.add(w + WHOLE)
    return out


def _count_beginnings(among: frozenset | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column("text").to_pylist():
                seen.update(_beginnings(text) if among is None else _beginnings(text) & among)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["entry", "n"])

    return run


def _matched(entries: list[str]):
    """Per text: the distinct ``2 * (2 * entry + edits) + quoted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(entries)
        for batch in few_at_a_time(batches, "text"):
            kinds = []
            for text in batch.column("text").to_pylist():
                found, _, quoted = matcher.hits(text)
                kinds.append(np.unique(2 * found + quoted).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(kinds, pa.list_(pa.int64()))], ["toxic", "kinds"])

    return run


_MATCHERS: dict[tuple[str, ...], Matcher] = {}


def _matcher(entries: list[str]) -> Matcher:
    key = tuple(entries)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(entries)
    return _MATCHERS[key]


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def _choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> list[str]:
    """Entries that mark toxic texts: the shortest whose continuations split its texts."""
    rate = lambda e: (toxic[e] + 0.5) / (n_toxic + 1) / ((clean.get(e, 0) + 0.5) / (n_clean + 1))
    pure = {e for e in toxic if rate(e) >= RATIO}
    goes_on = {e[:-1] for e in pure if len(e) > SHORTEST and toxic[e] >= 0.9 * toxic.get(e[:-1], 1 << 60)}
    kept = sorted(pure - goes_on, key=lambda e: (len(e.rstrip(WHOLE)), e.endswith(WHOLE), e))
    out: dict[str, None] = {}
    for e in kept:
        text = e.rstrip(WHOLE)
        if not any(text[:n] in out for n in range(SHORTEST, len(text) + 1)):
            out[e] = None
    return list(out)


def _part(rows: DataFrame, key: str, most: int) -> DataFrame:
    """All rows, or where there are more than ``most``, about so many, taken by the key's hash."""
    n = rows.count()
    below = 1 << 62
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(below)) < max(1, below * most // n))


def learn(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> dict:
    """A model from labelled texts that are not held out: lexicon and logistic weights.

    Uses ``labels(doc_id, toxic)`` with toxic 0 or 1 only. Texts that recur count once
    (toxic if any label says so), and where there are more than ``training_rows`` a part
    of about so many is taken by hash.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = _part(known.where(~held_out(F.col("doc_id"))), "doc_id", training_rows)
    # about `training_rows` ids at most, so they are sent to the rows; the texts of only one row for each hash then move
    marks = rows.join(F.broadcast(known), "doc_id").groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    marks = cut(_part(marks, "h", training_rows))
    train = rows.join(F.broadcast(marks), ["doc_id", "h"]).dropDuplicates(["h"]).select("toxic", "text").persist()
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    count = lambda df, among: {r["entry"]: r["n"] for r in df.select("text").mapInArrow(_count_beginnings(among), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n")).where(F.col("n") >= (max(4, SHARE * n_toxic) if among is None else 1)).collect()}
    toxic = count(train.where("toxic = 1"), None)  # in a fixed share of texts at least, so the longest texts bound their number
    clean = count(train.where("toxic = 0"), frozenset(toxic)) if toxic else {}
    entries = _choose(toxic, clean, n_toxic, n_clean)
    kinds = train.select("toxic", "text").mapInArrow(_matched(entries), "toxic int, kinds array<long>")
    rows = kinds.groupBy("toxic", "kinds").count().collect()  # no more than the training rows
    train.unpersist()
    return {"entries": entries} | _fit([(r["toxic"], r["kinds"], r["count"]) for r in rows], len(entries))


def _features(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one text's kinds of hits.

    An entry has two features: that it is hit, which a misspelling does by MISSPELT and a
    quotation by QUOTED of its value, and that it is hit by misspellings alone.
    """
    value: dict[int, float] = {}
    loose: dict[int, float] = {}
    for k in kinds:
        entry, edits, quoted = int(k) // 4, int(k) // 2 % 2, int(k) % 2
        v = (MISSPELT if edits else 1.0) * (QUOTED if quoted else 1.0)
        value[entry] = max(value.get(entry, 0.0), v)
        loose[entry] = min(loose.get(entry, 1.0), float(edits))
    names = [2 * e for e in value] + [2 * e + 1 for e, x in loose.items() if x]
    return np.array(names, np.int64), np.array([*value.values(), *(1.0 for x in loose.values() if x)])


def _fit(rows: list[tuple[int, list[int], int]], n_entries: int, steps: int = 800) -> dict:
    """Logistic regression by gradient steps; a misspelling departs from its entry only on evidence."""
    y = np.array([t for t, _, _ in rows], np.float64)
    times = np.array([n for _, _, n in rows], np.float64)
    found = [_features(k) for _, k, _ in rows]
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in found])
    name = np.concatenate([f for f, _ in found]) if found else np.zeros(0, np.int64)
    value = np.concatenate([v for _, v in found]) if found else np.zeros(0)
    w, bias = np.zeros(2 * n_entries), 0.0
    hold = np.tile([0.005, 0.2], n_entries)
    m, v, total = np.zeros(2 * n_entries + 1), np.zeros(2 * n_entries + 1), max(times.sum(), 1.0)
    for step in range(1, steps + 1):
        logit = bias + np.bincount(row, weights=value * w[name], minlength=len(rows))
        off = times * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)
        g = np.append(np.bincount(name, weights=value * off[row], minlength=2 * n_entries) + hold * w, off.sum()) / total
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return {"weights": w.tolist(), "bias": float(bias) if len(rows) else -5.0}


def _scored(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = json.loads(model)
        matcher = _matcher(m["entries"])
        weights = np.array(m["weights"])
        for batch in few_at_a_time(batches, "text"):
            score, n_hits, n_quoted = [], [], []
            for text in batch.column(0).to_pylist():
                found, _, quoted = matcher.hits(text)
                names, values = _features(np.unique(2 * found + quoted))
                logit = m["bias"] + float((weights[names] * values).sum())
                score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))))
                n_hits.append(len(found))
                n_quoted.append(int(quoted.sum()))
            made = [pa.array(score, pa.float64()), pa.array(n_hits, pa.int64()), pa.array(n_quoted, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*batch.schema.names[1:], "score", "n_hits", "n_quoted"])

    return run


def score_rows(docs: DataFrame, model: dict) -> DataFrame:
    """The columns of ``docs`` under the names c0, c1 and so on, and ``score`` (0 to 1), ``n_hits`` and ``n_quoted``; null texts count as empty."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    src = docs.toDF(*names)
    text = F.col(names[docs.columns.index("text")])
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))
    return src.select(F.coalesce(text, F.lit("")).alias("text"), *names).mapInArrow(_scored(json.dumps(model)), f"{kinds}, score double, n_hits long, n_quoted long")


def toxicity(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted, n_hits, n_quoted``.

    Null and empty texts have no hits and get the score of that. Without labels nothing
    is toxic: the lexicon is empty and all scores are the same. Repeated rows and null
    doc_ids are scored like others; columns besides doc_id and text are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score_rows(src, learn(src, labels, training_rows))
    out = out.select(F.col("c0").alias("doc_id"), held_out(F.col("c0")).alias("held_out"), "score", "n_hits", "n_quoted")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """The rows of ``docs`` scored under one half, with their own columns, whatever their names."""
    scored = score_rows(docs, learn(docs, labels, training_rows)).where("score < 0.5")
    return scored.drop("score", "n_hits", "n_quoted").toDF(*docs.columns)
