"""Licenses in long and changed texts, and queries that share an id."""

import random
import re

from pyspark.sql import functions as F

from fieldjobs.llm import licenses, topk


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, n_words long, spans string")


def test_a_million_places_in_one_text(spark):
    n = 1_000_000
    got = licenses.license_scan(docs(spark, [(1, "mit license " * n), (2, "general public license")])).where("doc_id = 1").first()
    assert tuple(got) == (1, 2 * n, n, 0, 2 * n - 2, "mit", "mit", 1.0)


def test_a_notice_that_a_text_repeats_very_often(spark):
    notice = dict((text.split()[0] + label, text) for label, text in licenses.NOTICES)["permissionisc"]
    got = licenses.license_spans(docs(spark, [(1, (notice + " and some more words of another kind ") * 3000)]))
    assert {tuple(r) for r in got.groupBy("label").count().collect()} == {("isc", 3000)}


def test_base_columns_equal_brute_force(spark):
    rnd = random.Random(3)
    words = ["MIT", "license", "apache", "License,", "general", "public", "gnu", "mit-license", "Straße", "x"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(60)))) for i in range(80)] + [(None, "mit license"), (1, "apache license"), (90, None), (91, ""), (92, "general public"), (93, "mit license")]
    rows += [rows[5]] * 2
    got = licenses.license_scan(docs(spark, rows)).collect()
    want = []
    for i, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall(licenses.WORD, lower)
        at = [(j, label) for label, phrase in licenses.PHRASES.items() for j in range(len(found)) if found[j : j + len(phrase.split())] == phrase.split()]
        starts = [j for j, _ in at]
        want.append((i, len(found), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) for r in got)


def test_notices_are_found_with_words_put_in_and_left_out(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for i, (label, text) in enumerate(licenses.NOTICES):
        words = text.split()
        if len(words) < 16:
            continue
        put_in, left_out = list(words), list(words)
        put_in.insert(len(words) // 2, "really")
        del left_out[len(words) // 2]
        for j, changed in enumerate((words, put_in, left_out)):
            filler = [f"w{rnd.randrange(500)}" for _ in range(30)]
            rows.append((10 * i + j, " ".join(filler[:15] + changed + filler[15:]).upper()))
            want[10 * i + j] = label
    got = {r["doc_id"]: r for r in licenses.license_scan(docs(spark, rows)).collect()}
    told = [label in licenses.TELLING for label in want.values()]  # a telling pair may be the one that goes
    assert all(want[i] in got[i]["labels"].split(",") or told[k] for k, i in enumerate(want))
    assert sum(want[i] in got[i]["labels"].split(",") for i in want) >= len(want) - 2
    plain = licenses.license_scan(docs(spark, [(1, "some words of the software and its documentation without warranty of any kind")])).first()
    assert plain["labels"] == "" and plain["n_base"] == 0


def test_queries_that_share_an_id_are_each_answered(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [0.5, 0.25]), (2, [0.25, 0.5]), (3, [0.5, 0.5, 0.5])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2)
    found = sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", F.col("score")).collect())
    assert found == sorted([(0, 1, 1, 1024 * 512), (0, 2, 2, 1024 * 256), (0, 1, 3, 1024 * 512), (0, 1, 2, 1024 * 512), (0, 2, 1, 1024 * 256)])
