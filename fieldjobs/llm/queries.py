"""One query for each operator, with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldjobs.llm import align, bpe, chat, exact_dedup, fim, licenses, line_dedup, lm, near_dups, packing, suffixes, topk, toxicity

#: Vocabulary files.
WORDS, BYTES, PIECES = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """The place of a vocabulary file, looked up when a query that takes one runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_read(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_read(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join(F.transform("gone", lambda s: F.concat_ws("-", s["begin"], s["end"])), ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_read(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_read(spark, sf_dir, "documents"), vocabulary(WORDS))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_calls(*chat.conversation_calls(_read(spark, sf_dir, "conversations")), chat.SCHEMAS)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary(BYTES))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(_read(spark, sf_dir, "documents"), vocabulary(BYTES), vocabulary(PIECES))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(_read(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1,
    "op2_minhash_near_dedup": op2,
    "op3_line_dedup": op3,
    "op4_lm_scoring": op4,
    "op5_bpe": op5,
    "op6_chat_format": op6,
    "op7_toxicity": op7,
    "op8_best_fit_packing": op8,
    "op9_exact_dedup": op9,
    "op10_topk_search": op10,
    "op11_cross_tokenizer_alignment": op11,
    "op12_suffix_array_dedup": op12,
    "op13_fill_in_middle": op13,
}

ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.n >= 75 * (x.n + y.n - p.n)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT a AS node, a AS got FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.got),
        c AS (SELECT node, min(got) AS component_id FROM r GROUP BY node)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))""",
    "op10_topk_search": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
          FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op12_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        b AS (SELECT doc_id, z, n, x[2 * z + 1:2 * z + 710] AS x FROM (SELECT doc_id, n, x, unnest(range(0, n - 99, 256)) AS z FROM d)),
        w AS (SELECT doc_id, z + i AS s, x[2 * i + 1:2 * i + 200] AS g FROM (SELECT doc_id, z, x, unnest(range(0, least(256, n - 99 - z))) AS i FROM b)),
        g AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS nth FROM w),
        later AS (SELECT doc_id, s, s > lag(s, 1, -200) OVER (PARTITION BY doc_id ORDER BY s) + 100 AS opens FROM g WHERE nth > 1),
        run AS (SELECT doc_id, s, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM later),
        span AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM run GROUP BY doc_id, run),
        part AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM span),
        kept AS (
          SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(x[2 * z + 1:2 * a], '' ORDER BY a) || any_value(x)[2 * max(b) + 1:] AS x
          FROM part JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, d.n AS n_bytes, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.x, d.x))) AS kept_sha256
        FROM d LEFT JOIN kept k USING (doc_id)""",
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
        h AS (SELECT *, list_transform(range(4), lambda i: ('0x' || h[8 * i + 1:8 * i + 8])::BIGINT) AS r, regexp_extract_all(t, '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS u FROM d),
        c AS (
          SELECT *, len(u) AS n, least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS a, greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
        FROM p""",
}
