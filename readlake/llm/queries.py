"""The operators as registered queries over the whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readlake.llm.bpe_tree import token_digests
from readlake.llm.cross_tokenizer import alignment_measures
from readlake.llm.exact_dedup import exact_dedup
from readlake.llm.fertility import fertility_rules
from readlake.llm.hidden_markov import score_documents
from readlake.llm.jaccard import jaccard_classes
from readlake.llm.merkle import verified_documents
from readlake.llm.mixing import mix_sources
from readlake.llm.recompression import substring_dedup
from readlake.llm.sharding import interleaved_shards
from readlake.llm.suffixes import repeated_bytes
from readlake.llm.templates import extract_main_text
from readlake.llm.warc import archived_pages


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_templates(spark, sf_dir):
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_recompression(spark, sf_dir):
    return substring_dedup(_documents(spark, sf_dir))


def op3_jaccard(spark, sf_dir):
    return jaccard_classes(_documents(spark, sf_dir))


def op4_bpe_tree(spark, sf_dir):
    return token_digests(_documents(spark, sf_dir))


def op5_sharding(spark, sf_dir):
    return interleaved_shards(_documents(spark, sf_dir))


def op6_hidden_markov(spark, sf_dir):
    return score_documents(_documents(spark, sf_dir))


def op7_fertility(spark, sf_dir):
    return fertility_rules(_documents(spark, sf_dir))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(_documents(spark, sf_dir))


def op9_suffixes(spark, sf_dir):
    return repeated_bytes(_documents(spark, sf_dir))


def op10_mixing(spark, sf_dir):
    return mix_sources(_documents(spark, sf_dir))


def op11_warc_index(spark, sf_dir):
    return archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_text_alignment(spark, sf_dir):
    return alignment_measures(_documents(spark, sf_dir))


def op13_merkle_descent(spark, sf_dir):
    return verified_documents(_documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_templates, op2_recompression, op3_jaccard, op4_bpe_tree, op5_sharding, op6_hidden_markov, op7_fertility, op8_exact_dedup, op9_suffixes, op10_mixing,
        op11_warc_index, op12_text_alignment, op13_merkle_descent,
    )
}

ORACLES = {
    "op3_jaccard": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS t FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id != b.doc_id GROUP BY 1, 2),
        link AS (SELECT u, v FROM common JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, l.v FROM reach r JOIN link l ON l.u = r.v)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, c.component_id
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u) c USING (doc_id)
    """.strip(),
    "op2_recompression": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS w FROM starts),
        least AS (SELECT w, min(doc_id) AS m FROM win GROUP BY w),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN least USING (w) WHERE m < doc_id),
        g AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(len(js), 0) AS n_removed,
            sha256(array_to_string(list_filter(ws, lambda w, i: NOT coalesce(list_contains(js, i), false)), ' ')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)
    """.strip(),
    "op8_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
    """,
    "op11_warc_index": r"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT payload_digest, min(page_id) AS least FROM p GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN least END AS refers_to
        FROM (SELECT *, payload_bytes >= 100 AND page_id <> least AS again FROM p JOIN g USING (payload_digest))
    """,
    "op13_merkle_descent": r"""
        WITH RECURSIVE plain AS (SELECT doc_id, lang, coalesce(lang, '') AS key, lang IS NOT NULL AS named, n_chars, source, text,
                list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda r, c:
                    list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(r, c)), 4294967295) AS r FROM documents),
            d AS (SELECT *, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS own, [doc_id::VARCHAR, source, lang, (n_chars + 1)::VARCHAR, text] AS wrong, xor(r, 4294967295) % 7 = 0 AS hit FROM plain),
            h AS (SELECT doc_id, key, named, sha256(list_reduce(list_transform(own, lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')), lambda a, b: a || b)) AS leaf,
                CASE WHEN hit THEN sha256(list_reduce(list_transform(wrong, lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')), lambda a, b: a || b)) END AS forged FROM d),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY named, key ORDER BY doc_id) - 1 AS rank, count(*) OVER (PARTITION BY named, key) AS size FROM h),
            n AS (
                SELECT named, key, 0 AS level, rank, leaf AS node, size FROM ranked
                UNION ALL SELECT named, key, level + 1, rank // 2, sha256(string_agg(node, '' ORDER BY rank)), (size + 1) // 2 FROM n WHERE size > 1 GROUP BY named, key, level, rank // 2, size),
            sub AS (SELECT named, key, node AS subroot, row_number() OVER (ORDER BY named, key) - 1 AS rank, count(*) OVER () AS size FROM n WHERE size = 1),
            t AS (SELECT 0 AS level, rank, subroot AS node, size FROM sub UNION ALL SELECT level + 1, rank // 2, sha256(string_agg(node, '' ORDER BY rank)), (size + 1) // 2 FROM t WHERE size > 1 GROUP BY level, rank // 2, size),
            p AS (
                SELECT doc_id, named, key, 0 AS level, rank, size, '' AS proof, coalesce(forged, leaf) AS fold FROM ranked
                UNION ALL SELECT p.doc_id, p.named, p.key, p.level + 1, p.rank // 2, (p.size + 1) // 2, proof || coalesce(s.node, ''), sha256(CASE WHEN p.rank % 2 = 0 THEN fold || coalesce(s.node, '') ELSE s.node || fold END)
                FROM p LEFT JOIN n s ON s.named = p.named AND s.key = p.key AND s.level = p.level AND s.rank = xor(p.rank, 1) WHERE p.size > 1),
            q AS (
                SELECT p.doc_id, 0 AS level, sub.rank, sub.size, proof, fold, subroot FROM p JOIN sub USING (named, key) WHERE p.size = 1
                UNION ALL SELECT q.doc_id, q.level + 1, q.rank // 2, (q.size + 1) // 2, proof || coalesce(s.node, ''), sha256(CASE WHEN q.rank % 2 = 0 THEN fold || coalesce(s.node, '') ELSE s.node || fold END), subroot
                FROM q LEFT JOIN t s ON s.level = q.level AND s.rank = xor(q.rank, 1) WHERE q.size > 1)
        SELECT q.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
        FROM q JOIN h USING (doc_id), (SELECT node AS root FROM t WHERE size = 1) WHERE q.size = 1
    """,
}
