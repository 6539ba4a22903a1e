"""The corpus operators' queries: production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, centroids, conversations, decontamination, exact_dedup, kneser_ney, online_packing, packing, pii, secrets, sharding, simhash, token_counts
from .common import ROW, read, prepare

TOKENIZER = "byte_bpe_50k.json"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_brown_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return brown.score_documents(read(spark, sf_dir, "documents"))


def op3_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = decontamination.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_multipart_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), token_counts.new_cache_path(spark))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.near_groups(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return kneser_ney.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop(ROW)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return centroids.cluster_vectors(read(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = read(spark, sf_dir, "conversations")
    return conversations.repair_digests(conversations.damaged(rows), rows)


def op13_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return online_packing.pack_online(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_brown_lm_scoring,
        op3_weak_supervision_pii,
        op4_exact_dedup,
        op5_benchmark_decontamination,
        op6_multipart_secret_scan,
        op7_hilbert_sharding,
        op8_token_counts,
        op9_simhash_near_dedup,
        op10_quality_classifier,
        op11_centroid_clustering,
        op12_conversation_repair,
        op13_online_packing,
    )
}

def _drop(state: str) -> str:
    return f"{{c: l.{state}.c + 3, e: 'D' || l.{state}.e, t: l.{state}.t}}"


def _keep(state: str) -> str:
    return f"{{c: l.{state}.c + cut, e: 'K' || l.{state}.e, t: concat_ws(chr(10), role || ':' || text, l.{state}.t)}}"


def _rerole(state: str, role: str) -> str:
    return f"{{c: l.{state}.c + cut + 2, e: 'R' || l.{state}.e, t: concat_ws(chr(10), '{role}:' || text, l.{state}.t)}}"


def _insert(state: str, role: str) -> str:
    return f"{{c: {state}.c + 2, e: 'I' || {state}.e, t: concat_ws(chr(10), '{role}:', {state}.t)}}"


def _best(state: str, kept: dict[str, str], role: str, to: str) -> str:
    """SQL of a state's best edit of a row, without inserts: cost, audit and repaired lines of the row and all after it."""
    whens = " ".join(f"WHEN left(role, 1) = '{i}' THEN {_keep(k)}" for i, k in kept.items())
    return f"CASE WHEN gone THEN {_drop(state)} ELSE least({_drop(state)}, {_rerole(to, role)}, CASE {whens} ELSE {_drop(state)} END) END"


#: States: s nothing yet, t after a system row, u after a user row, a after an assistant row.
REPAIR_SQL = f"""
    WITH RECURSIVE marked AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    crc AS (
        SELECT *, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT), lambda z, b: list_reduce(range(8), lambda v, j: xor(v >> 1, 3988292384 * (v & 1)), xor(z, b)), 4294967295), 4294967295) % 20 AS mark FROM marked),
    hurt AS (
        SELECT conv_id, turn, CASE WHEN mark = 4 THEN 'user' ELSE role END AS role, CASE mark WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(range(CASE WHEN mark = 3 THEN 2 ELSE 1 END)) AS copy
        FROM crc WHERE mark <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS p, count(*) OVER (PARTITION BY conv_id) AS n, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hurt),
    judged AS (
        SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
               left(lag(role) OVER (PARTITION BY conv_id ORDER BY p), 1) || left(role, 1) AS pair
        FROM placed),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
               count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM judged GROUP BY conv_id),
    best AS (
        SELECT conv_id, n AS pos, {{c: 0, e: '', t: NULL::VARCHAR}} AS s, {{c: 4, e: 'II', t: 'user:' || chr(10) || 'assistant:'}} AS t, {{c: 2, e: 'I', t: 'assistant:'}} AS u, {{c: 0, e: '', t: NULL::VARCHAR}} AS a
        FROM (SELECT DISTINCT conv_id, n FROM placed)
        UNION ALL
        SELECT conv_id, pos, least(s, {_insert("u", "user")}) AS s, least(t, {_insert("u", "user")}) AS t, u, a
        FROM (SELECT conv_id, pos, s, t, least(u, {_insert("a", "assistant")}) AS u, least(a, {_insert("u", "user")}) AS a
              FROM (SELECT l.conv_id, l.pos - 1 AS pos, {_best("s", {"s": "t", "u": "u"}, "user", "u")} AS s, {_best("t", {"u": "u"}, "user", "u")} AS t,
                           {_best("u", {"a": "a"}, "assistant", "a")} AS u, {_best("a", {"u": "u"}, "user", "u")} AS a
                    FROM best l JOIN (SELECT conv_id AS conv, p, role, text, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::INTEGER AS cut FROM judged) j ON l.conv_id IS NOT DISTINCT FROM conv AND l.pos = p)))
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s.c, 0)::BIGINT AS cost, coalesce(s.e, '') AS audit, sha256(coalesce(s.t, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN (SELECT conv_id, s FROM best WHERE pos = 0) b ON o.conv_id IS NOT DISTINCT FROM b.conv_id"""

ORACLE_SQL = {
    "op4_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op5_benchmark_decontamination": r"""
        WITH words AS (
            SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
            UNION ALL
            SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
        sized AS (SELECT kind, id, w, coalesce(len(w), 0) AS n, least(10, len(w)) AS k FROM words),
        item_windows AS (
            SELECT DISTINCT id AS item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
            FROM (SELECT id, w, k, unnest(range(1, n - k + 2)) AS i FROM sized WHERE kind = 'b' AND n > 0)),
        lengths AS (SELECT DISTINCT k FROM item_windows),
        doc_windows AS (
            SELECT id AS doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
            FROM (SELECT s.id, s.w, l.k, unnest(range(1, s.n - l.k + 2)) AS i FROM sized s JOIN lengths l ON s.n >= l.k WHERE s.kind = 'd')),
        hits AS (SELECT doc_id, i, k, item_id FROM doc_windows JOIN item_windows USING (k, g)),
        hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
        hit_items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT s.id AS doc_id, s.n::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM sized s LEFT JOIN hit_words h ON s.id = h.doc_id LEFT JOIN hit_items t ON s.id = t.doc_id
        WHERE s.kind = 'd'""",
    "op11_centroid_clustering": """
        WITH kept AS (
            SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), vec_id) - 1 AS r, vec_id, embedding FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x * 64::DOUBLE))) = 64),
        x AS (SELECT r, unnest(range(64)) AS i, floor(64 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM kept),
        c0 AS (SELECT r AS c, i, x FROM x WHERE r < 16),
        """ + ",\n        ".join(
            f"""d{k} AS (SELECT r, c, sum((x.x - y.x) * (x.x - y.x))::BIGINT AS d FROM x JOIN c{k} y USING (i) GROUP BY r, c),
        a{k} AS (SELECT r, c, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""" + (f""",
        m{k} AS (SELECT c, i, floor(sum(x.x)::DOUBLE / count(*))::BIGINT AS x FROM a{k} JOIN x USING (r) GROUP BY c, i),
        c{k + 1} AS (SELECT c, i, coalesce(m.x, o.x) AS x FROM c{k} o LEFT JOIN m{k} m USING (c, i))""" if k < 3 else "")
            for k in range(4)
        ) + """,
        h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c3 GROUP BY c)
        SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
        FROM a3 JOIN kept USING (r) JOIN h USING (c)""",
    "op12_conversation_repair": REPAIR_SQL,
}
