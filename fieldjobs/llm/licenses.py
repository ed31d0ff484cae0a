"""License notices by diagonal voting.

Every run of two words of a document is hashed and joined to the positions of the same
run in the license templates (a short fixed list, so it is broadcast). A hit votes for
the diagonal document position minus template position; votes are added up by diagonal,
neighbouring diagonals (words put in or left out) are merged into a span, and a span
counts when enough of its template is verified word for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fieldjobs.llm.recovery import cut
from fieldjobs.llm.words import ALNUM_WORDS, LOWER, few_at_a_time, find_words, sequence_hashes, text_bytes, word_hashes

#: Words are runs of these characters: digits, letters and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, by label. Their words have at most eight bytes, so a word's hash and length tell it.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Wording of public licenses and their notices, by label.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc", "this work is licensed under a creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
]
#: Word pairs that tell a label's notices from others of like wording; where a notice holds one, a span without it doesn't count.
TELLING = {"gpl": ["gnu general"], "lgpl": ["gnu lesser", "lesser general"], "mpl": ["mozilla public"]}
#: Diagonals this far apart belong to one span; the share of a template that a span needs.
NEAR, COVER = 2, 0.75
#: A span may be this much longer than its template.
STRETCH = 1.25


def _runs(h: np.ndarray) -> np.ndarray:
    return sequence_hashes(h, 2).view(np.int64)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in few_at_a_time(batches, "text"):
        h, at = word_hashes(batch.column("text"), ALNUM_WORDS)
        runs = _runs(h)
        last_of_text = np.zeros(len(h), bool)
        last_of_text[at[1:][np.diff(at) > 0] - 1] = True
        held = runs[~last_of_text[:-1]] if len(h) else runs
        sizes = np.maximum(np.diff(at) - 1, 0)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(held))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), lists], ["doc_id", "text_hash", "grams"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text its words, and the places of the phrases; nothing is held for a place."""
    for batch in few_at_a_time(batches, "text"):
        data, at = text_bytes(batch.column("text"))
        h, start, length = find_words(data, at, ALNUM_WORDS)
        words = np.searchsorted(start, at)
        place, label = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for number, phrase in enumerate(PHRASES.values()):
            wanted, _, sizes = find_words(*text_bytes(pa.array([phrase])), ALNUM_WORDS)
            n = len(wanted)
            here = np.flatnonzero((h == wanted[0]) & (length == sizes[0]))
            text = np.searchsorted(words, here, side="right") - 1
            here = here[here + n <= words[text + 1]]
            for i in range(1, n):
                here = here[(h[here + i] == wanted[i]) & (length[here + i] == sizes[i])]
            place.append(here)
            label.append(np.full(len(here), number))
        place, label = np.concatenate(place), np.concatenate(label)
        order = np.argsort(place, kind="stable")
        place, label = place[order], label[order]
        cuts = np.searchsorted(place, words)
        some = np.diff(cuts) > 0
        first, last = (np.append(place, 0)[np.minimum(x, len(place))] - words[:-1] for x in (cuts[:-1], np.maximum(cuts[1:] - 1, 0)))
        labels = [",".join(sorted({name for i, name in enumerate(PHRASES) if (label[x:y] == i).any()})) for x, y in zip(cuts.tolist(), cuts[1:].tolist())]
        made = [pa.array(np.diff(words)), pa.array(np.diff(cuts)), pa.array(first, mask=~some), pa.array(last, mask=~some), pa.array(labels, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), *made], ["id", "hash", "n_words", "n_base", "first_word", "last_word", "base_labels"])


def _templates(spark) -> DataFrame:
    rows = []
    for number, (_, text) in enumerate(NOTICES):
        hashes, _ = word_hashes(pa.array([text]), ALNUM_WORDS)
        rows += [(number, len(hashes), i, int(g)) for i, g in enumerate(_runs(hashes))]
    return spark.createDataFrame(rows, "template int, length int, at int, gram long")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the words of each span of a text with its template's, byte by byte. A text's words are found once, however many spans it has."""
    wording = [text.encode().split() for _, text in NOTICES]
    for batch in few_at_a_time(batches, "text"):
        data, at = text_bytes(batch.column("text"))
        _, start, length = find_words(data, at, ALNUM_WORDS)
        words, lower = np.searchsorted(start, at), LOWER[data].tobytes()
        out: dict[str, list] = {c: [] for c in ("doc_id", "text_hash", "label", "cover", "first_word", "last_word")}
        for row, spans in enumerate(batch.column("spans").to_pylist()):
            base = int(words[row])
            for span in spans:
                text, label = wording[span["template"]], NOTICES[span["template"]][0]
                word = lambda i: lower[start[base + i] : start[base + i] + length[base + i]]  # noqa: B023, E731
                held = [(p["at"], p["place"]) for p in span["held"] if word(p["place"]) == text[p["at"]] and word(p["place"] + 1) == text[p["at"] + 1]]
                found = {i for i, _ in held}
                pairs = [b" ".join(text[i : i + 2]).decode() for i in range(len(text) - 1)]
                telling = {pairs.index(p) for p in TELLING.get(label, []) if p in pairs}
                cover = len(found) / (len(text) - 1)
                if cover < COVER or not telling <= found:
                    continue
                first, last = min(p for _, p in held), max(p for _, p in held) + 1
                # a chain of neighbouring diagonals may drift, but a notice isn't much longer than its template
                if last - first + 1 <= int(len(text) * STRETCH) + NEAR:
                    for c, v in zip(out, (batch.column("doc_id")[row].as_py(), batch.column("text_hash")[row].as_py(), label, cover, first, last)):
                        out[c].append(v)
        yield pa.RecordBatch.from_pydict({c: pa.array(v, {"label": pa.string(), "cover": pa.float64()}.get(c, pa.int64())) for c, v in out.items()})


def license_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, label, cover, first_word, last_word``: one row per verified span of a notice.

    ``cover`` is the share of the template's word pairs that the span holds, and the
    words are its first and last in the document. A null doc_id is -1 here.
    """
    text = F.coalesce("text", F.lit(""))
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    runs = src.mapInArrow(_grams, "doc_id long, text_hash long, grams array<long>").select("doc_id", "text_hash", F.posexplode("grams").alias("place", "gram"))
    key = ["doc_id", "text_hash", "template"]
    hits = runs.join(F.broadcast(_templates(docs.sparkSession)), "gram")  # a fixed list of a few hundred word pairs
    votes = hits.groupBy(*key, "length", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set(F.struct("at", "place")).alias("held"))
    w = Window.partitionBy(*key).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > NEAR, F.lit(True))
    spans = votes.withColumn("span", F.sum(apart.cast("long")).over(w)).groupBy(*key, "span", "length").agg(F.flatten(F.collect_list("held")).alias("held"))
    cover = F.size(F.array_distinct(F.transform("held", lambda p: p["at"]))) / (F.col("length") - 1)
    by_text = spans.where(cover >= COVER).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("template", "held")).alias("spans"))
    named = src.join(cut(by_text), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    return named.select("doc_id", "text_hash", "text", "spans").mapInArrow(_verified, "doc_id long, text_hash long, label string, cover double, first_word long, last_word long")


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Null and empty texts have no words. ``first_word`` and ``last_word`` are the smallest
    and largest start of a phrase; null where there is none. ``labels`` holds the base
    labels and those of verified notices. Repeated rows (same doc_id and text) and null
    doc_ids are each returned with their own text's result. ``score`` is the largest
    share of a template found in one verified span, 1 where a phrase stands. Other
    columns are ignored; an empty table gives no row.
    """
    found = license_spans(docs).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    rows = rows.mapInArrow(_counted, "id long, hash long, n_words long, n_base long, first_word long, last_word long, base_labels string")
    out = rows.join(found, (F.coalesce("id", F.lit(-1)) == F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.coalesce("more", F.array().cast("array<string>"))))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0)))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))
