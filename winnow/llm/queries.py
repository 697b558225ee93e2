"""The operators' registered queries, on whole tables with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import decontamination, language, licenses, packing, repair, separators, sharding, simhash, suffixes, topk, toxicity, vector_codes, warc
from winnow.llm.common import read_table

# Fixed value: the end-of-text id of the word vocabulary.
END_OF_TEXT = 49407


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Vocabulary files stay where they are installed; WINNOW_TOKENIZERS names another folder."""
    import public_tokenizers

    folder = os.environ.get("WINNOW_TOKENIZERS")
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    return toxicity.classify(read_table(spark, sf_dir, "documents"), labels, ["low_quality", "toxic"])


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read_table(spark, sf_dir, "pages")).drop("archive")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (read_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return decontamination.contamination(docs, items).drop("key")


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return separators.count_documents(docs, tokenizer_path(), END_OF_TEXT).select("doc_id", "n_tokens")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read_table(spark, sf_dir, "embeddings"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, limit=3).drop("component_print")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(read_table(spark, sf_dir, "conversations")))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(read_table(spark, sf_dir, "documents")).drop("spans")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, _ = vector_codes.compress(read_table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_warc, op3_decontamination, op4_suffixes, op5_packing, op6_separator_scan, op7_sharding,
                                   op8_topk, op9_language, op10_simhash, op11_repair, op12_licenses, op13_vector_codes)}
ORACLES: dict[str, str] = {
    "op2_warc": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, strlen(coalesce(decode(b), ''))::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END
                   AS record_type,
               CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)""",
    "op3_decontamination": r"""
        WITH w AS (
            SELECT doc_id, row_number() OVER () AS k, list_filter(string_split_regex(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
        i AS (
            SELECT item_id::VARCHAR AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
        s AS (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS p0 FROM i WHERE len(words) > 0),
        t AS (SELECT DISTINCT item_id, array_to_string(list_slice(words, p0, p0 + 12), ' ') AS phrase, len(list_slice(words, p0, p0 + 12)) AS n FROM s),
        sizes AS (SELECT DISTINCT n FROM t),
        p AS (SELECT k, words, unnest(range(1, len(words) + 1)) AS p0 FROM w),
        h AS (SELECT k, p0, n, item_id FROM (
                SELECT k, p0, sizes.n, array_to_string(list_slice(words, p0, p0 + sizes.n - 1), ' ') AS phrase
                FROM p, sizes WHERE p0 + sizes.n - 1 <= len(words)) JOIN t USING (phrase, n)),
        hit AS (SELECT k, count(DISTINCT p0 + o) AS n_hit FROM (SELECT k, p0, unnest(range(n)) AS o FROM h) GROUP BY k),
        met AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
                FROM (SELECT DISTINCT k, item_id FROM h) GROUP BY k)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
               coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
        FROM w LEFT JOIN hit USING (k) LEFT JOIN met USING (k)""",
    "op8_topk": r"""
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
        SELECT query_id, rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        WHERE rank <= 20""",
    "op13_vector_codes": r"""
        WITH k AS (SELECT vec_id, label, row_number() OVER () AS r,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT r, part, list_slice(e, part * len(e) // 16 + 1, (part + 1) * len(e) // 16) AS v
              FROM k, (SELECT unnest(range(16)) AS part)),
        f AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < 64),
        c0 AS (SELECT part, entry, v AS c FROM f JOIN p USING (r)),
        a0 AS (SELECT r, part, v, min({'d': d, 'entry': entry}) AS best FROM (
            SELECT r, part, v, entry, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
            FROM p JOIN c0 USING (part)) GROUP BY r, part, v),
        m0 AS (SELECT part, entry, list(m ORDER BY pos) AS c FROM (
            SELECT part, best.entry AS entry, pos, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
            FROM (SELECT part, best, unnest(v) AS x, unnest(range(len(v))) AS pos FROM a0) GROUP BY ALL) GROUP BY ALL),
        c1 AS (SELECT part, entry, coalesce(m0.c, c0.c) AS c FROM c0 LEFT JOIN m0 USING (part, entry)),
        a1 AS (SELECT r, part, v, min({'d': d, 'entry': entry}) AS best FROM (
            SELECT r, part, v, entry, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
            FROM p JOIN c1 USING (part)) GROUP BY r, part, v),
        m1 AS (SELECT part, entry, list(m ORDER BY pos) AS c FROM (
            SELECT part, best.entry AS entry, pos, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
            FROM (SELECT part, best, unnest(v) AS x, unnest(range(len(v))) AS pos FROM a1) GROUP BY ALL) GROUP BY ALL),
        c2 AS (SELECT part, entry, coalesce(m1.c, c1.c) AS c FROM c1 LEFT JOIN m1 USING (part, entry)),
        a2 AS (SELECT r, part, v, min({'d': d, 'entry': entry}) AS best FROM (
            SELECT r, part, v, entry, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
            FROM p JOIN c2 USING (part)) GROUP BY r, part, v),
        t AS (SELECT r, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
              FROM a2 GROUP BY r),
        l AS (SELECT label, sum(error)::BIGINT AS label_error FROM k JOIN t USING (r) GROUP BY label)
        SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM (
            SELECT part, entry, unnest(c) AS x, unnest(range(len(c))) AS pos FROM c2)) AS codebooks_sha256
        FROM k JOIN t USING (r) JOIN l ON k.label IS NOT DISTINCT FROM l.label""",
    "op11_repair": r"""
        WITH RECURSIVE x AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
        v AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
        d AS (SELECT k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_concat([4294967295],
                list_transform(range(1, len(name) + 1), lambda p: ord(name[p])::BIGINT)),
                lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
              FROM (SELECT *, coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations c
                    JOIN v ON c.conv_id IS NOT DISTINCT FROM v.conv_id), x),
        e AS (SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                     CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
              FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM d)),
        o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
                     rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM e),
        f AS (SELECT *, left(role, 1) AS r, CASE WHEN bare = '' THEN 'blank'
                     WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate'
                     WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
                     lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS r0 FROM o),
        w AS (SELECT k, 0::BIGINT AS i, 0 AS st, 0 AS cost, '' AS audit FROM (SELECT DISTINCT k FROM f)
              UNION ALL
              SELECT k, i, st, cost, audit FROM (
                SELECT k, i, st, cost, audit, row_number() OVER (PARTITION BY k, st ORDER BY cost, audit) AS best FROM (
                    SELECT k, i, CASE edit WHEN 'D' THEN st WHEN 'R' THEN CASE st WHEN 2 THEN 3 ELSE 2 END
                                 ELSE CASE r WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS st,
                           cost + CASE edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + (edit <> 'D' AND coalesce(fault, '') = 'truncated')::INTEGER AS cost,
                           audit || edit AS audit
                    FROM (SELECT f.*, CASE WHEN ins THEN CASE w.st WHEN 2 THEN 3 ELSE 2 END ELSE w.st END AS st, cost + 2 * ins::INTEGER AS cost,
                                 audit || CASE WHEN ins THEN 'I' ELSE '' END AS audit, unnest(['D', 'K', 'R']) AS edit
                          FROM w JOIN f ON f.k = w.k AND f.i = w.i + 1, (VALUES (FALSE), (TRUE)) AS t(ins))
                    WHERE edit = 'D' OR (coalesce(fault, '') NOT IN ('blank', 'duplicate') AND (edit = 'R' OR (r = 's' AND st = 0)
                          OR (r = 'u' AND st IN (0, 1, 3)) OR (r = 'a' AND st = 2))))) WHERE best = 1),
        n AS (SELECT k, max(i) AS i, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                     count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                     count(*) FILTER (r0 || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY k),
        z AS (SELECT k, min({'cost': cost + CASE st WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END,
                     'audit': audit || CASE st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}) AS best FROM w JOIN n USING (k, i) GROUP BY k),
        a AS (SELECT *, sum((edit <> 'I')::INTEGER) OVER (PARTITION BY k ORDER BY p) AS i,
                     sum((edit <> 'D')::INTEGER) OVER (PARTITION BY k ORDER BY p) AS q
              FROM (SELECT k, unnest(string_split(best.audit, '')) AS edit, unnest(range(len(best.audit))) AS p FROM z WHERE best.audit <> '')),
        b AS (SELECT a.k, p, edit, q - (count(*) FILTER (edit = 'K' AND r = 's') OVER (PARTITION BY a.k)) AS q, role, text
              FROM a LEFT JOIN f ON f.k = a.k AND f.i = a.i),
        h AS (SELECT k, string_agg(CASE edit WHEN 'K' THEN role ELSE CASE WHEN q % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' ||
                     CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS repaired FROM b WHERE edit <> 'D' GROUP BY k)
        SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
               coalesce(best.audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM v LEFT JOIN n USING (k) LEFT JOIN z USING (k) LEFT JOIN h USING (k)""",
}
