import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fieldjobs.llm import bpe, chat, exact_dedup, licenses, line_dedup, lm, near_dups, packing, topk, toxicity
from fieldjobs.llm.queries import BYTES, WORDS, vocabulary

BYTE_VOCABULARY, WORD_VOCABULARY = vocabulary(BYTES), vocabulary(WORDS)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, class string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, None, "x") for i, t in texts], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_duplicates(spark):
    got = by_id(exact_dedup.exact_duplicates(docs(spark, [(1, "a. b"), (2, "a. b"), (3, None), (4, ""), (5, "a. b "), (6, "x" * 9000)])))
    assert [(i, r["keep_id"], r["group_size"], r["kept"]) for i, r in sorted(got.items())] == [(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True)]
    assert got[3]["text_sha256"] == hashlib.sha256(b"").hexdigest()


def test_license_scan(spark):
    got = by_id(licenses.license_scan(docs(spark, [(1, "The MIT  License, mit-license"), (2, None), (3, "GNU General Public License"), (4, "mit")])))
    assert tuple(got[1])[1:6] == (5, 2, 1, 3, "mit") and got[3]["base_labels"] == "gpl" and got[3]["first_word"] == 1
    assert tuple(got[2])[1:] == (0, 0, None, None, "", "", 0.0) and got[4]["n_base"] == 0


def test_like_license_notices_are_told_apart(spark):
    notice = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License"
    source = "This Source Code Form is subject to the terms of the {} Public License"
    texts = [(1, notice.format("")), (2, notice.format("Lesser ")), (3, notice.format("Affero ")), (4, "Licensed under the GNU Lesser General Public License, version 3"), (5, source.format("Mozilla")), (6, source.format("Eclipse")), (7, notice.format("") + " x " * 9 + notice.format("Lesser "))]
    got = by_id(licenses.license_scan(docs(spark, texts)))
    assert [got[i]["labels"] for i, _ in texts] == ["gpl", "gpl,lgpl", "gpl", "gpl", "mpl", "", "gpl,lgpl"]
    assert got[2]["base_labels"] == "gpl" and got[2]["n_base"] == 1


def test_near_duplicates_equal_brute_force(spark):
    random.seed(5)
    texts = []
    for g in range(12):
        base = [f"w{random.randrange(4000)}" for _ in range(random.randrange(1, 160))]
        for _ in range(5):
            t = list(base)
            for _ in range(random.randrange(0, 4)):
                t[random.randrange(len(t))] = f"z{random.randrange(9999)}"
            texts.append((len(texts), " ".join(t)))
    texts += [(900, ""), (901, None), (902, "A b"), (903, "a B"), (904, texts[7][1])]
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[b] > root[a]:
                    root[b], changed = root[a], True
    got = by_id(near_dups.near_duplicates(docs(spark, texts)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), root[i]) for i in sets}


def test_pipeline_near_dedup_decides_by_row(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    table = docs(spark, [(1, a), (2, a + " z"), (2, b), (3, c), (3, c), (None, c + " z"), (None, "no other"), (None, ""), (None, None), (5, ""), (6, "")])
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each(spark, table, "").collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (3, c), (None, "no other"), (None, ""), (None, None), (5, ""), (6, "")], key=repr)


def test_line_dedup(spark):
    run = "\n".join(" ".join(f"r{i}_{j}" for j in range(30)) for i in range(3))
    got = by_id(line_dedup.dedup_lines(docs(spark, [(1, "one\n" + run + "\ntwo"), (2, "three\n" + run + "\nfour"), (3, None), (4, "short\nshort"), (5, "")])))
    assert got[2]["text"] == "three\nfour" and got[1]["gone"] == [] and got[3]["text"] is None and got[4]["text"] == "short\nshort"


def test_line_dedup_equals_brute_force_inside_lines(spark):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(5000)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 130)]
    texts = []
    for i in range(40):
        w = []
        for p in [r.choice(passages) for _ in range(r.randrange(0, 4))]:
            a = r.choice([0, 0, r.randrange(len(p))])
            w += [word() for _ in range(r.randrange(0, 30))] + p[a:] + [word() for _ in range(r.randrange(0, 9))]
        texts.append((i, "".join(x + r.choice([" "] * 9 + ["\n", "  "]) for x in ["\u00e9", *w])))
    texts += [(50, "ab " * 300), (51, texts[7][1]), (51, texts[8][1])]
    seen, want = {}, {}
    for i, t in sorted(texts[:-2]):
        w = t.split()
        dead = set()
        for a in range(len(w) - 49):
            at = seen.setdefault(tuple(w[a : a + 50]), (i, a))
            if at[0] != i or a >= at[1] + 50:
                dead |= set(range(a, a + 50))
        want[i] = [x for j, x in enumerate(w) if j not in dead]
    got = line_dedup.dedup_lines(docs(spark, texts)).collect()
    assert {x["doc_id"]: x["text"].split() for x in got if x["doc_id"] != 51} == want
    assert sorted(x["text"].strip() for x in got if x["doc_id"] == 51) == sorted("" if len(t.split()) >= 50 else t.strip() for _, t in texts[7:9])
    assert any(len(want[i]) < len(t.split()) for i, t in texts[:40])


def test_lm_base_and_held_out(spark):
    import math
    import zlib

    texts = [(i, " ".join(random.Random(i).choice(["a", "b", "c", "d"]) for _ in range(30))) for i in range(60)] + [(60, None)]
    got = by_id(lm.score_texts(docs(spark, texts)))
    counts = {}
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w in [*(t or "").split(), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in texts:
        tokens = [*(t or "").split(), None]
        assert got[i]["n_tokens"] == len(tokens) and got[i]["train_tokens"] == n
        assert math.isclose(got[i]["base_score"], sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        assert got[i]["score"] < 0


def test_lm_learns_from_all_training_rows(spark, monkeypatch):
    import zlib

    ids = [i for i in range(80) if zlib.crc32(str(i).encode()) % 7 not in (0, 2)][:40]
    table = docs(spark, [(i, "a b c d " * 8) for i in ids])
    learned = by_id(lm.score_texts(table))
    monkeypatch.setattr(lm, "ROUNDS", 0)
    start = by_id(lm.score_texts(table))
    assert all(learned[i]["score"] > start[i]["score"] + 1 for i in ids)


def test_bpe_equals_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = WORD_VOCABULARY
    t = tokenizers.Tokenizer.from_file(path)
    texts = [(1, "Hello, WORLD don't"), (2, None), (3, "<|endoftext|>x  é日本 ΣΑΣ"), (4, "aaaaaaaaaaaaaaaaaaaaaaaab" * 9)]
    got = by_id(bpe.encode_ids(docs(spark, texts), path))
    for i, x in texts:
        want = t.encode(x or "", add_special_tokens=False).ids
        assert got[i]["ids"] == want and got[i]["decoded"] == t.decode(want, skip_special_tokens=False)


def test_packing_is_gapless_and_whole(spark):
    texts = [(i, "word " * random.Random(i).randrange(0, 900) + "end") for i in range(60)] + [(99, None), (100, "two  spaces ")]
    got = packing.pack(docs(spark, texts), BYTE_VOCABULARY).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert {r["doc_id"] for r in got} == {i for i, _ in texts}


def test_call_order_and_links(spark):
    rows = [("a", []), ("b", ["a"]), ("c", ["b"]), ("d", ["c", "a"]), ("e", ["d"]), ("x", ["y"]), ("y", ["x"]), ("z", ["x", "a"]), ("n", None)]
    got = {r[0]: r[1] for r in chat.call_order(spark.createDataFrame(rows, "call_id string, depends_on array<string>").withColumn("conv_id", F.lit(1))).select("call_id", "level").collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "x": None, "y": None, "z": None, "n": 0}
    assert spark.range(1).select(chat.canonical(F.lit('{"b": 1, "a": [1, 2]}'))).first()[0] == '{"a":[1,2],"b":1}'


def test_toxicity_learns_and_catches_misspellings(spark):
    words = ["sun", "rain", "field", "maize", "green", "leaf", "river", "stone"]
    r = random.Random(2)
    texts = [(i, " ".join(r.choice(words) for _ in range(20)) + (" gremblat" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = by_id(toxicity.toxicity(docs(spark, texts + [(1000, "a grenblat here"), (1001, None), (1002, "green fields")]), labels))
    assert all(got[i]["predicted"] == (i % 4 == 0) for i in range(400))
    assert (got[1000]["predicted"], got[1001]["predicted"], got[1002]["predicted"]) == (1, 0, 0)


def test_top_k(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) / 8 for j in range(4)]) for i in range(500)] + [(600, None), (700, [float("nan")] * 4)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    v = {i: [int(x * 1024 // 1) for x in e] for i, e in rows[:500]}
    want = []
    for q in range(0, 500, 100):
        s = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:10]
        want += [(q, k + 1, c, -x) for k, (x, c) in enumerate(s)]
    assert got == sorted(want)


def test_calls_link_within_their_conversation(spark):
    calls = [(1, 2, "c", "open", '{"language":"en","length":3,"query":"a"}', []), (2, 2, "c", "open", "{not json", []), (None, 2, "c", "open", '{"language":"en","length":"x","query":"a"}', ["c"]), (1, 4, "d", "other", "{}", ["c"]), (1, 6, "e", "open", '{"query":"q","length":1,"language":"de"}', ["d", "c"]), (1, 8, None, "open", "{}", None)]
    results = [(1, 3, "c", "one"), (2, 1, "c", "two"), (2, 9, "z", "alone"), (1, 9, None, "none"), (1, 5, "c", "again")]
    got = chat.link_calls(
        spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>").withColumn("level", F.lit("x")),
        spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string").withColumn("name", F.lit("x")), chat.SCHEMAS,
    ).collect()
    rows = sorted([(r["conv_id"], r["call_id"], r["result_turn"], r["level"], r["status"], r["errors"]) for r in got], key=repr)
    assert rows == sorted([
        (1, "c", 3, 0, "ok", ""), (1, "c", 5, 0, "ok", ""), (2, "c", 1, 0, "invalid", "not an object"), (None, "c", None, None, "invalid", "length: not integer"), (1, "d", None, 1, "invalid", "unknown tool"),
        (1, "e", None, 2, "unanswered", ""), (1, None, None, None, "invalid", "language: missing; length: missing; query: missing"), (2, "z", 9, None, "orphan", ""), (1, None, 9, None, "orphan", ""),
    ], key=repr)
    record = {(r["conv_id"], r["call_id"]): r["record"] for r in got}
    assert record[2, "c"] == '{"arguments":"{not json","id":"c","level":0,"name":"open","result":"two"}' and record[2, "z"] is None
    assert record[1, "e"] == '{"arguments":{"language":"de","length":1,"query":"q"},"id":"e","level":2,"name":"open"}'
    none = [spark.createDataFrame([], t) for t in ("conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>", "conv_id long, turn long, call_id string, content string")]
    assert chat.link_calls(*none, chat.SCHEMAS).count() == 0


def thue_morse(n, swap):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_words_that_a_polynomial_hash_confounds(spark):
    import zlib

    x, y = thue_morse(1024, 0), thue_morse(1024, 1)
    table = docs(spark, [(1, x), (2, y), (3, f"{x} {y}"), (4, f"{x} {x}")])
    assert {i: r["component_id"] for i, r in by_id(near_dups.near_duplicates(table)).items()} == {i: i for i in (1, 2, 3, 4)}
    ids = [i for i in range(99) if zlib.crc32(str(i).encode()) % 7 != 2][:1] + [i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2][:1]
    got = by_id(lm.score_texts(docs(spark, list(zip(ids, (x, y))))))
    assert [got[i]["n_known"] for i in ids] == [2, 1]
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(BYTE_VOCABULARY)
    for r in packing.token_pieces(docs(spark, [(3, f"{x} {y}"), (4, f"{x} {x}")]), BYTE_VOCABULARY, 1 << 20).collect():
        assert r["length"] == len(t.encode(f"{x} {y}" if r["doc_id"] == 3 else f"{x} {x}", add_special_tokens=False).ids) + 1


def test_clashing_hashes_are_told_apart():
    import numpy as np
    import pyarrow as pa

    from fieldjobs.llm import words

    data, at = words.text_bytes(pa.array(["one two one three-is-longer-than-eight two", "three-is-longer-than-eighT"]))
    _, starts, lengths = words.find_words(data, at, fold=False)
    one, which = words.numbered(data, starts, lengths, np.zeros(len(starts), np.uint64))
    text = [data[a : a + n].tobytes() for a, n in zip(starts, lengths)]
    assert [text[one[w]] for w in which] == text and len(one) == 4


CONTEXTS = ["a{}b", "{}", "1{} ' {}'s", "  {}  {}\n"]


def _odd_texts():
    r = random.Random(7)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(c.replace("{}", x) for x in points[i : i + 4000]) for c in CONTEXTS for i in range(0, 0x20000, 4000)]
    texts += ["".join(r.choice(points) if r.random() < 0.4 else r.choice("abc' sretvlmd12,.\n\t") for _ in range(r.randrange(1, 60))) for _ in range(3000)]
    return texts + ["", " ", "'", "''s 's's", "a" * 3000 + "b" * 900, "<|endoftext|>x<|startoftext|> <|endoftext|>  y", "\n\nx \n\ny \n"]


def test_encoders_equal_the_library_over_all_characters(spark):
    import pyarrow as pa

    tokenizers = pytest.importorskip("tokenizers")
    texts, classes = _odd_texts(), bpe.character_classes()
    for path, encoder in ((WORD_VOCABULARY, bpe.WordBpe(WORD_VOCABULARY, classes)), (BYTE_VOCABULARY, packing.Encoder(BYTE_VOCABULARY, classes))):
        t = tokenizers.Tokenizer.from_file(path)
        ids, at = encoder.batch(pa.array(texts))
        for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
            assert ids[at[i] : at[i + 1]].tolist() == e.ids, texts[i]
            if path == WORD_VOCABULARY:
                assert encoder.decode(e.ids) == t.decode(e.ids, skip_special_tokens=False)


def test_digests_and_pieces_equal_the_library(spark):
    import zlib

    tokenizers = pytest.importorskip("tokenizers")
    texts = [(1, "Hello, WORLD don't"), (2, None), (3, ""), (None, "x y"), (5, "word " * 2100), (5, "word " * 2100), (6, "é<|endoftext|>")]
    table = docs(spark, texts)
    t = tokenizers.Tokenizer.from_file(WORD_VOCABULARY)
    want = []
    for i, x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.encode_digests(table, WORD_VOCABULARY).collect()), key=repr) == sorted(want, key=repr)
    t, want = tokenizers.Tokenizer.from_file(BYTE_VOCABULARY), []
    for i, x in texts:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(i, n, a, b - a, zlib.crc32(b"".join(v.to_bytes(4, "little") for v in ids[a:b]))) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = packing.pack(table, BYTE_VOCABULARY).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id").collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
    assert len({r["sequence_id"] for r in got}) == -(-sum(w[3] for w in want) // 1024)


def test_toxicity_tells_quotation_from_abuse_and_keeps_columns(spark):
    r = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("sun", "rain", "field", "leaf") for b in ("ing", "er", "ly") for c in ("", "ous", "al")]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [(i, say(15) + (" gremblat " if i % 4 == 0 else ' "gremblat" ' if i % 30 == 1 else " ") + say(15)) for i in range(1200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)], "doc_id long, toxic int")
    got = by_id(toxicity.toxicity(docs(spark, texts), labels))
    assert all(got[i]["predicted"] == (i % 4 == 0) for i in range(1200)) and got[1]["n_quoted"] == 1
    table = docs(spark, [*texts, (None, None), (4, "fine words")]).withColumn("_text", F.lit("t")).withColumn("score", F.lit(9)).withColumn("c0", F.lit("c")).withColumn("_hits", F.lit(1))
    left = toxicity.drop_toxic(table, labels)
    assert left.columns == table.columns and left.count() == 902 and {tuple(x) for x in left.select("_text", "score", "c0").collect()} == {("t", 9, "c")}
    assert toxicity.drop_toxic(table, labels.where("false")).count() == 1202
    assert toxicity.toxicity(docs(spark, []), labels).count() == 0


def test_line_dedup_keeps_columns_and_grows_in_proportion(spark):
    import time

    line = "one two three four five six seven\n"
    took = []
    for n in (4_000, 40_000):
        t0 = time.time()
        got = line_dedup.dedup_lines(docs(spark, [(1, line * n), (2, "x")]).withColumn("_gone", F.lit("g")).withColumn("c0", F.lit("c")).withColumn("id", F.lit(7)).withColumn("tag", F.lit(8))).collect()
        took.append(time.time() - t0)
        by = {r["doc_id"]: r for r in got}
        assert (by[1]["_gone"], by[1]["c0"], by[1]["id"], by[1]["tag"]) == ("g", "c", 7, 8) and 50 <= len(by[1]["text"].split()) < 110 and by[2]["text"] == "x"
    assert took[1] < 10 * took[0] + 5


def test_pipeline_stages_keep_rows_and_columns(spark):
    import corpus_pipeline

    passage = " ".join(f"p{i}" for i in range(60))
    texts = [(1, "a b\n" + passage), (2, passage + "\nc d"), (3, passage), (4, None), (4, ""), (None, passage), (5, "x"), (5, "x"), (6, "1 " + "y" * 100_000)]
    table = docs(spark, texts).withColumn("n_lines", F.lit(7)).withColumn("gone", F.lit("g"))
    left = corpus_pipeline.without_repeats(spark, table, "")
    assert left.columns == table.columns and {(r["n_lines"], r["gone"]) for r in left.collect()} == {(7, "g")}
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(1, "a b\n" + passage), (2, "c d"), *texts[3:]], key=repr)
    assert corpus_pipeline.one_of_each(spark, left, "").columns == table.columns
    for stage in (corpus_pipeline.without_repeats, corpus_pipeline.one_of_each, corpus_pipeline.packed):
        assert stage(spark, table.where("false"), "").count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.packed(spark, left, "").collect()} == {1, 2, 4, None, 5, 6}


def test_license_spans_dont_drift(spark):
    notice = "licensed under the apache license version 2 0"
    doubled = " ".join(f"{a} {b}" for a, b in zip(notice.split(), notice.split()[1:]))
    got = by_id(licenses.license_scan(docs(spark, [(1, notice), (2, " x ".join([doubled] * 3)), (3, notice.replace("the", "the said")), (4, "Kelvin \u212a mit license " + "z " * 3000), (None, "apache license")])))
    assert got[1]["labels"] == got[3]["labels"] == "apache" and got[4]["base_labels"] == "mit" and got[4]["n_words"] == 3004 and got[None]["n_base"] == 1


def test_top_k_with_few_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)
    r = random.Random(9)
    rows = [(i, [float(r.randrange(-3, 4)) for _ in range(3)]) for i in range(300)] + [(400, [1.0, 2.0]), (401, [1.0, 0.0]), (100, [9.0, 9.0, 9.0]), (None, [1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    q = [(i, e) for i, e in rows if i is not None and i % 100 == 0 and len(e) == 3]  # two of them have the id 100
    want = []
    for i, e in q:
        s = sorted((-sum(int(1024 * a) * int(1024 * b) for a, b in zip(e, x)), j) for j, x in rows if j not in (None, i) and len(x) == 3)[:10]
        want += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    assert sorted(tuple(x) for x in got if x["query_id"] != 400) == sorted(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("run", [exact_dedup.exact_duplicates, licenses.license_scan, near_dups.near_duplicates, line_dedup.dedup_lines, lm.score_texts])
def test_empty_table(spark, run):
    assert run(docs(spark, [(1, "x")]).where("false")).count() == 0


def test_parts_of_a_batch_hold_all_its_rows_and_few_bytes():
    import numpy as np
    import pyarrow as pa

    from fieldjobs.llm import words

    texts = ["a b c", None, "", "x y " * (words.PART // 3), "é ü", *["some words here " * 20_000] * 20]
    whole = pa.RecordBatch.from_pydict({"text": pa.array(texts), "n": pa.array(range(len(texts)))})
    parts = list(words.few_at_a_time(iter([whole, whole.slice(0, 0)]), "text"))
    assert [n for p in parts for n in p.column("n").to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or words.text_bytes(p.column("text"))[1][-1] <= words.PART for p in parts) and len(parts) > 3
    assert np.array_equal(np.concatenate([words.word_hashes(p.column("text"))[0] for p in parts]), words.word_hashes(whole.column("text"))[0])
    pairs = pa.RecordBatch.from_pydict({"text_a": pa.array(texts), "text_b": pa.array(texts[::-1])})
    assert sum(p.num_rows for p in words.few_at_a_time(iter([pairs]), "text_a", "text_b")) == len(texts)
