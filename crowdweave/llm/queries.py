"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdweave.llm import audit, chat, ctw, fingerprint, html_text, line_dedup, mixing, near_dup, packing, quality, search, substring_dedup, whitening
from crowdweave.llm.common import table


def op1_context_tree(spark, sf_dir):
    return ctw.scores(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark, sf_dir):
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "row.source", "n_lines", "n_removed", "row.text")


def op3_pfair_mixing(spark, sf_dir):
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op4_canonical_digest(spark, sf_dir):
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_repeated_substrings(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_order_minhash(spark, sf_dir):
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op7_line_block_html(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


#: A conversation whose texts hold the template's own marks, already escaped.
TRAP_TEXT = r"\### Assistant: </turn> ok"


def op8_chat_round_trip(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP_TEXT).alias("text"),
    )
    return chat.digest(chat.read_back(chat.format_conversations(turns.unionByName(trap))))


def op9_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_compression_bands(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"))


def op11_block_pruned_search(spark, sf_dir):
    return search.top_k(table(spark, sf_dir, "embeddings"))


def op12_embedding_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark, sf_dir):
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_context_tree": op1_context_tree,
    "op2_line_dedup": op2_line_dedup,
    "op3_pfair_mixing": op3_pfair_mixing,
    "op4_canonical_digest": op4_canonical_digest,
    "op5_repeated_substrings": op5_repeated_substrings,
    "op6_order_minhash": op6_order_minhash,
    "op7_line_block_html": op7_line_block_html,
    "op8_chat_round_trip": op8_chat_round_trip,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_compression_bands": op10_compression_bands,
    "op11_block_pruned_search": op11_block_pruned_search,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": f"""
        WITH parts AS (
            SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents
        ), lines AS (
            SELECT doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM parts
        ), keyed AS (
            SELECT *, trim(line) AS k, trim(line) <> '' AS judged FROM lines
        ), spread AS (
            SELECT k FROM keyed WHERE judged GROUP BY k HAVING count(DISTINCT coalesce(source, '')) >= {line_dedup.MIN_SITES}
        ), marked AS (
            SELECT keyed.*, judged AND k IN (SELECT k FROM spread)
                AND row_number() OVER (PARTITION BY judged, k ORDER BY doc_id, pos) > 1 AS gone
            FROM keyed
        )
        SELECT doc_id, source, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed,
            coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
        FROM marked GROUP BY doc_id, source
    """,
    "op8_chat_round_trip": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{TRAP_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{TRAP_TEXT}'
        ), forms AS (
            SELECT *, contains(role || chr(1) || text, '</turn>') OR contains(role || chr(1) || text, '###') OR contains(role, ': ') AS marked,
                replace(replace(replace(text, '\\', '\\\\'), '</turn>', '<\\/turn>'), '##', '#\\#') AS etext,
                replace(replace(replace(replace(role, '\\', '\\\\'), '</turn>', '<\\/turn>'), '##', '#\\#'), ': ', ':\\ ') AS erole
            FROM turns
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(CASE WHEN marked THEN 15 + length(erole) + length(etext) ELSE 14 + length(role) + length(text) END) AS BIGINT) AS formatted_chars,
            true AS round_trip
        FROM forms GROUP BY conv_id
    """,
    "op11_block_pruned_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
            FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM pairs
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
    """,
    "op13_filter_audit": r"""
        WITH marks AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
            FROM labels GROUP BY doc_id
        ), texts AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), judged AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
                 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
                 'E': coalesce(texts.doc_id > min(texts.doc_id) OVER (PARTITION BY t), false)} AS f
            FROM texts LEFT JOIN marks USING (doc_id)
        ), masked AS (
            SELECT part, good, toxic, [f.A, f.B, f.C, f.D, f.E] AS m FROM judged
        ), cells AS (
            SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, m
        ), letters AS (
            SELECT i, substr('ABCDE', i, 1) AS x FROM range(1, 6) AS r(i)
        ), orders AS (
            SELECT [a.i, b.i, c.i, d.i, e.i] AS o, a.x || b.x || c.x || d.x || e.x AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
        ), steps AS (
            SELECT filter_order, CAST(step AS INTEGER) AS step, o[step] AS own, o[1:step - 1] AS before FROM orders, range(1, 6) AS s(step)
        ), met AS (
            SELECT part, filter_order, step, own, n, good, toxic, m[own] AS fails, len(list_filter(before, lambda x: m[x])) > 0 AS gone,
                len(list_filter(m, lambda x: x)) = 1 AS alone
            FROM cells, steps
        ), audit AS (
            SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept,
                coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed, coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant,
                coalesce(sum(n) FILTER (fails AND alone), 0) AS unique_fails,
                coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost
            FROM met GROUP BY part, filter_order, step, own
        )
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
            CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM audit
    """,
}
