"""Alignment, repeated byte strings and fill-in-middle, against brute force and the libraries."""

import hashlib
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldjobs.llm import align, fim, suffixes
from fieldjobs.llm.bpe import byte_alphabet
from fieldjobs.llm.queries import BYTES, PIECES, vocabulary

DOCS = "doc_id long, text string, n long, block string, row string, spans string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", "y", "z") for i, t in texts], DOCS)


def odd_texts(seed):
    rnd = random.Random(seed)
    letters = list("ab  '\n\té漢😀 　 .,1٣▁<s>")
    fixed = [None, "", " ", "  ", "a", "▁", "a▁b", "<s> </s>", "x <|endoftext|> y", "  x", "a  b   c ", "\n\n a\t b\n c", "x" * 3000, "é ñ 漢字 " * 50, "'s don't I 'll", "\x00 a", "<P> a b", "a <S>b", "word " * 2000]
    return fixed + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(200)]


def _aligned_by_hand(texts):
    import sentencepiece
    import tokenizers

    first = tokenizers.Tokenizer.from_file(vocabulary(BYTES))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    byte = {c: bytes([i]) for i, c in enumerate(byte_alphabet())}
    found = []
    for t in texts:
        a, b = (first.encode(" " + t, add_special_tokens=False).ids, second.encode(t)) if t else ([], [])
        a_bytes = [b"".join(byte[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if t and not (b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode()):
            a, b, a_bytes, b_bytes = [], [], [], []
        a_ends, b_ends = (np.cumsum([len(x) for x in y]).tolist() for y in (a_bytes, b_bytes))
        where_a, where_b = ({e: i for i, e in enumerate(x)} for x in (a_ends, b_ends))
        groups, links, i, j = [], [], 0, 0
        for e in sorted(where_a.keys() & where_b.keys()):
            x, y = where_a[e] + 1, where_b[e] + 1
            groups.append((a[i:x], b[j:y]))
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        found.append((len(a), len(b), groups, links))
    count = Counter(p for f in found for p in f[3])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for a, b, groups, links in found:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        out.append((a, b, len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), sha))
    return out


@pytest.mark.parametrize("block", [align.BLOCK, 500])
def test_alignment_equals_the_libraries(spark, monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK", block)
    texts = odd_texts(5)
    ids = [None, *range(1, len(texts))]
    got = align.align(docs(spark, list(zip(ids, texts))).repartition(3), vocabulary(BYTES), vocabulary(PIECES)).collect()
    want = [(i, *w) for i, w in zip(ids, _aligned_by_hand(texts))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_alignment_of_repeated_rows_counts_each(spark):
    got = align.align(docs(spark, [(1, "the cat"), (1, "the cat"), (2, None)]), vocabulary(BYTES), vocabulary(PIECES)).collect()
    want = _aligned_by_hand(["the cat", "the cat", None])
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)
    assert align.align(docs(spark, []), vocabulary(BYTES), vocabulary(PIECES)).count() == 0


def test_groups_give_their_bytes(spark):
    text = "Straßenbahn, naïve 漢字!"
    rows = sorted(align.groups_of(docs(spark, [(4, text), (5, "")]), vocabulary(BYTES), vocabulary(PIECES)).collect(), key=lambda r: r["begin"])
    assert {r["doc_id"] for r in rows} == {4} and [r["group"] for r in rows] == list(range(len(rows)))
    assert rows[0]["begin"] == 0 and rows[-1]["end"] == len((" " + text).encode()) and all(x["end"] == y["begin"] for x, y in zip(rows, rows[1:]))


def test_lanes_do_not_change_links():
    rnd = np.random.default_rng(1)
    sizes = [1, 2, 40, 700, 3]
    ends, at = [[], []], [[0], [0]]
    done = 0
    for n in sizes:
        done += n
        for side in (0, 1):
            inner = np.flatnonzero(rnd.random(n - 1) < 0.4) + 1 + done - n
            ends[side] += [*inner.tolist(), done]
            at[side].append(len(ends[side]))
    a, b, a_at, b_at = (np.array(x) for x in (ends[0], ends[1], at[0], at[1]))
    both = sorted(set(ends[0]) & set(ends[1]))
    for lane in (1, 7, 64, 10_000):
        x, y = align.merged(a, a_at, b, b_at, lane)
        assert a[x].tolist() == b[y].tolist() == both


def _fim_by_hand(i, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[j : j + 8], 16) for j in range(0, 32, 8)]
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (i, n, "plain", None, None, text)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 80
    return (i, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("part", [fim.PART, 64])
def test_fill_in_middle_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(fim, "PART", part)
    texts = odd_texts(6) + ["same text twice"] * 2 + [("passage of many words " * 40 + str(i) + " ") * 3 for i in range(40)]
    rows = [(None, "a null id of some words"), *enumerate(texts), (1, "other text of one id")]
    out = fim.fill_in_middle(docs(spark, rows).repartition(3))
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == sorted((_fim_by_hand(i, t) for i, t in rows), key=repr)
    assert Counter((r["doc_id"], r["back"]) for r in got) == Counter((i, t or "") for i, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs(spark, [])).count() == 0


def test_cuts_fall_where_units_end():
    from fieldjobs.llm.words import text_bytes
    import pyarrow as pa

    texts = [t or "" for t in odd_texts(7)] + ["ab cd " * 300, "x" * 200 + " " * 200 + "y"]
    chunks = fim.Chunks(*text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        assert chunks.n[i] == len(units)
        for k in {0, len(units) // 2, max(len(units) - 1, 0), len(units)}:
            head = "".join(units[:k])
            size, chars = chunks.cut_at(np.array([i]), np.array([k]))
            assert (size[0], chars[0]) == (len(head.encode()), len(head))


def test_suffixes_are_sorted():
    rnd = random.Random(2)
    for _ in range(300):
        n, k = rnd.randrange(1, 150), rnd.choice([1, 2, 3, 200, 3000])
        s = [rnd.randrange(1, k + 1) for _ in range(n)] * rnd.choice([1, 1, 3]) + [0]
        assert suffixes.suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_common_prefixes_equal_a_direct_comparison():
    rnd = random.Random(9)
    for _ in range(50):
        parts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 40))) for _ in range(4)]
        data = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])
        tails = [data[i : ends[i]].tobytes() for i in range(len(data))]
        # suffixes go on into the next part behind a mark that is smaller than all
        order = sorted(range(len(data)), key=lambda i: b"\x00".join([tails[i], *parts[int(np.searchsorted(np.cumsum([len(p) for p in parts]), i, side="right")) + 1 :]]) + b"\x00")
        before = np.full(len(data), -1)
        before[order[1:]] = order[:-1]
        want = [0 if b < 0 else next((k for k, (x, y) in enumerate(zip(tails[i], tails[b])) if x != y), min(len(tails[i]), len(tails[b]))) for i, b in enumerate(before)]
        assert suffixes.common_prefixes(data, ends, before).tolist() == want


def _without_repeats(rows, size):
    """Removed spans and kept bytes by (doc_id, text), from all strings of all texts in order."""
    from fieldjobs.llm import words  # noqa: F401

    out, seen = {}, set()
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for a in range(len(data) - size + 1):
            if data[a : a + size] in seen:
                gone[a : a + size] = True
            seen.add(data[a : a + size])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        out[i, text] = (len(data), [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])], bytes(np.frombuffer(data, np.uint8)[~gone]))
    return out


def _check_repeats(spark, rows, size):
    got = suffixes.remove_repeats(docs(spark, rows).repartition(4), size).collect()
    want = _without_repeats(rows, size)
    mine = Counter((r["doc_id"], r["n_bytes"], tuple((s["begin"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in got)
    assert mine == Counter((i, n, tuple(spans), kept) for i, t in rows for n, spans, kept in [want[i, t]])


@pytest.mark.parametrize(("hot", "shard", "part"), [(4096, 8192, 1 << 22), (3, 8, 300)])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, shard, part):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "SHARD", shard)
    monkeypatch.setattr(suffixes, "PART", part)
    rnd = random.Random(4)
    words = ["ab", "Straße", "漢字", "of", "the", "a", "  ", "x\ny"]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = prose(60)
    rows = [(1, None), (2, ""), (3, "short"), (4, "z" * 250), (5, "z" * 120), (6, "z" * 99), (7, "ab" * 200), (8, prose(300)), (None, passage + prose(5)), (None, passage + prose(6))]
    rows += [(10 + i, prose(rnd.randrange(6)) + passage + prose(rnd.randrange(30))) for i in range(12)]
    rows += [(30, rows[8][1]), (31, rows[12][1]), (32, passage[20:150]), (33, passage[20:150]), (33, passage[20:150]), (34, prose(20) + passage[:110] + prose(20) + passage[:110])]
    # null ids stand last, so their order among each other only matters within the same text
    _check_repeats(spark, [r for r in rows if r[0] is not None] + rows[8:9], 100)


def test_texts_of_one_id_are_compared(spark):
    passage = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    got = suffixes.remove_repeats(docs(spark, [(1, passage + " one"), (1, passage + " two"), (None, passage)])).collect()
    assert sorted(len(r["spans"]) for r in got) == [0, 1, 1]
    assert [len(r["kept"]) for r in got if r["doc_id"] is None] == [0]


def test_repeats_of_an_empty_table(spark):
    assert suffixes.remove_repeats(docs(spark, [])).count() == 0


def test_a_shard_is_sorted_in_few_steps_over_all_places():
    """No loop over places, and no step for each symbol or run: the calls don't grow with the text."""
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(300)]
    passages = [b" ".join(words[i] for i in rng.integers(0, 300, 40)) for _ in range(30)]
    stretches = [passages[i][a : a + 150] for i, a in zip(rng.integers(0, 30, 300), rng.integers(0, 60, 300))]
    data, at = np.frombuffer(b"".join(stretches), np.uint8), np.cumsum([0, *map(len, stretches)])
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = suffixes.earlier_strings(data, at)
    finally:
        sys.setprofile(None)
    seen, want = set(), np.zeros(len(data), bool)
    for i, s in zip(at.tolist(), stretches):
        for j in range(len(s) - 99):
            want[i + j] = s[j : j + 100] in seen
            seen.add(s[j : j + 100])
    assert (got == want).all() and got.any() and calls < 400
