"""The registered queries of this subpackage, with their production parameters, and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoform.llm import chat_format, curve_packing, decontamination, exact_dedup, html_text, language_id, lexical_search, packing, pii, secret_scan, simhash_dedup, vector_codes, wavelet_output
from clonoform.llm.common import stage, table, tokenizer_path


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet_output.write_token_shards(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return wavelet_output.read_token_shards(shards)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "'</s>[INST] ok [/INST]'"
    probe = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', {said}), (-1L, 1L, 'assistant', {said}) AS t (conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = chat_format.read_chats(stage(chat_format.format_chats(rows), "chats"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, capacity=2048)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.pack_along_curve(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, capacity=4096)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), depth=50)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_pii": op2_pii,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_secret_scan": op4_secret_scan,
    "op5_token_output": op5_token_output,
    "op6_chat_format": op6_chat_format,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_language_id": op9_language_id,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_curve_packing": op11_curve_packing,
    "op12_lexical_search": op12_lexical_search,
    "op13_vector_codes": op13_vector_codes,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CHATS = """(SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')"""
_WRITTEN = "replace(replace(replace({}, chr(92), chr(92) || chr(92)), '<', '<' || chr(92)), '[', '[' || chr(92))"

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lexical_sql(depth: int) -> str:
    terms = f"unnest(regexp_extract_all({_LOWER}, '{_TERMS}'))"
    return f"""
WITH words AS (SELECT doc_id, {terms} AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), asked AS (SELECT DISTINCT item_id, {terms} AS term FROM benchmark),
m AS (SELECT doc_id, 50 + (50 * n * docs) // total AS m FROM lengths, corpus),
scores AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
 FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN m USING (doc_id), corpus GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {depth}"""


def _codes_sql(rounds: int) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT vec_id, p, min(struct_pack(d, e)) AS x FROM (SELECT vec_id, p, e, sum((c - x) * (c - x)) AS d
 FROM comps JOIN book{k} USING (p, j) GROUP BY vec_id, p, e) t GROUP BY vec_id, p)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN
 (SELECT p, x.e AS e, j, CAST(floor(sum(c) / count(*)) AS BIGINT) AS x FROM comps JOIN near{k} USING (vec_id, p) GROUP BY ALL) m ON b.p = m.p AND b.e = m.e AND b.j = m.j)""")
    return f"""
WITH kept AS (SELECT vec_id, label, embedding, len(embedding) // 8 AS s, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comps AS MATERIALIZED (SELECT vec_id, place, (i - 1) // s AS p, (i - 1) % s AS j, CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) AS c
 FROM (SELECT vec_id, place, s, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM kept) t),
book0 AS MATERIALIZED (SELECT p, place AS e, j, c AS x FROM comps WHERE place < 16),
{", ".join(steps)},
coded AS (SELECT vec_id, string_agg(lpad(format('{{:x}}', x.e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(x.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


ORACLE_SQL = {
    "op6_chat_format": f"""
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length({_WRITTEN.format("text")}) + 8
  + CASE WHEN first THEN 8 + 7 + length({_WRITTEN.format("role")}) ELSE 0 END) AS BIGINT) AS formatted_chars
FROM (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), chr(0)) <> role AS first FROM {_CHATS}) t
GROUP BY conv_id""",
    "op8_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
 doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS body FROM documents) t WINDOW w AS (PARTITION BY body)""",
    "op12_lexical_search": _lexical_sql(50),
    "op13_vector_codes": _codes_sql(6),
}
