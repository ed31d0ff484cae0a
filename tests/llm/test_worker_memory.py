"""What a packing worker holds: its encoder's tables, as they are sent, and a part of the text at a time."""

import json
import pickle
import random
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
from test_llm import BYTE_VOCABULARY, docs

from fieldjobs.llm import line_dedup, packing, toxicity, words


def test_a_sent_encoder_is_small_and_encodes_large_batches_in_little_memory():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzé'9.") for _ in range(r.randrange(1, 9)))
    known = [word() for _ in range(40_000)]
    texts = [" ".join(r.choices(known, k=1_500)) for _ in range(1_500)] + [None, "", " two  spaces ", "<|endoftext|> x", "don't"]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": pa.array([t or "" for t in texts])})
    made = packing._encoder(BYTE_VOCABULARY)
    sent = pickle.dumps(made, 5)
    assert len(sent) < 30e6
    tracemalloc.start()
    try:
        shared = SimpleNamespace(value=pickle.loads(sent))
        pieces = [p for out in packing._pieces(shared, 1024)(iter([batch])) for p in out.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 150e6  # 12 MB at a time took over 300e6, tables aside
    # nothing is lost, and each text's ids are those it has alone
    assert {p["doc_id"] for p in pieces} == set(range(len(texts)))
    for i in [0, 700, *range(1_499, len(texts))]:
        ids, at = made.batch(pa.array([texts[i] or ""]))
        assert sum(p["length"] for p in pieces if p["doc_id"] == i) == len(ids) + 1 == at[1] + 1
    import tokenizers

    library = tokenizers.Tokenizer.from_file(BYTE_VOCABULARY)
    assert made.batch(pa.array([texts[3]]))[0].tolist() == library.encode(texts[3], add_special_tokens=False).ids


def test_line_dedup_rewrites_texts_in_one_worker_a_task(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    out = line_dedup.dedup_lines(docs(spark, [(1, "a\n" + passage), (2, passage + "\nc d"), (3, None), (4, passage)]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    got = {r["doc_id"]: (r["text"], [tuple(s) for s in r["gone"]]) for r in out.collect()}
    assert got == {1: ("a\n" + passage, []), 2: ("c d", [(0, len(passage) + 1)]), 3: (None, []), 4: ("", [(0, len(passage))])}


def test_toxicity_scores_large_batches_in_parts():
    texts = ["some words of abuse " * 5_000] * 100 + ["", "x"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts), "c0": pa.array(range(len(texts)))})
    run = toxicity._scored(json.dumps({"entries": ["abuse"], "weights": [2.0, 0.0], "bias": -1.0}))
    out = list(run(iter([batch])))
    assert max(b.num_rows for b in out[:-1]) <= words.PART // len(texts[0]) + 2 and len(out) > 3
    assert [x for b in out for x in b.column("c0").to_pylist()] == list(range(len(texts)))
    assert [x > 0.5 for b in out for x in b.column("score").to_pylist()] == [True] * 100 + [False] * 2
