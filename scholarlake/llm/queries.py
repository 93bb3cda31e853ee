"""The operators' queries over whole tables, with their contracts' parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholarlake.llm.alignment import align
from scholarlake.llm.decontaminate import contamination
from scholarlake.llm.exact_dedup import exact_dedup
from scholarlake.llm.langid import language
from scholarlake.llm.lm import lm_scores
from scholarlake.llm.mixing import label_domains, mix
from scholarlake.llm.near_dedup import near_dedup
from scholarlake.llm.packing import pack
from scholarlake.llm.prefix_trie import ordered_turns, prefix_trie, rebuilt
from scholarlake.llm.secrets import secrets
from scholarlake.llm.substring_dedup import substring_dedup
from scholarlake.llm.suffix_dedup import suffix_dedup
from scholarlake.llm.toxicity import toxicity as toxicity_scores

#: Shares of tokens that the mix aims at, by quality and toxicity label.
DOMAIN_WEIGHTS = {"q1t0": 0.90, "q0t0": 0.08, "q1t1": 0.02}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), DOMAIN_WEIGHTS)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), width=2, percent=80)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(documents(spark, sf_dir)).drop("lang_shares")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_soft_mixing": op3_soft_mixing,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_secret_scan": op6_secret_scan,
    "op7_decontamination": op7_decontamination,
    "op8_debruijn_dedup": op8_debruijn_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_language": op10_language,
    "op11_alignment": op11_alignment,
    "op12_packing": op12_packing,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op1_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS len,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY sha) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha AS text_sha256
        FROM t
        WINDOW w AS (PARTITION BY sha ORDER BY len DESC, doc_id)
    """,
    "op2_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        u AS (SELECT doc_id, unnest(list_transform(range(0, length(h) // 2), lambda i: {'i': i, 'c': substr(h, 2 * i + 1, 2), 's': CASE WHEN 2 * i + 100 <= length(h) THEN md5(substr(h, 2 * i + 1, 100)) END})) AS x FROM d),
        b AS (SELECT doc_id, x.i AS i, x.c AS c, x.s AS s FROM u),
        f AS (SELECT s, min(doc_id) AS m FROM b WHERE s IS NOT NULL GROUP BY s),
        hit AS (SELECT b.doc_id, i, c, coalesce(m < b.doc_id, false) AS starts FROM b LEFT JOIN f USING (s)),
        gone AS (SELECT doc_id, i, c, max(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS g FROM hit),
        edge AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM gone),
        r AS (SELECT doc_id, count_if(g)::BIGINT AS n_removed, count_if(opens)::BIGINT AS n_spans, string_agg(c, '' ORDER BY i) FILTER (NOT g) AS k FROM edge GROUP BY doc_id)
        SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(k, ''))) AS kept_sha256
        FROM d LEFT JOIN r USING (doc_id)
    """,
    "op4_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, doc_id = m AS kept
        FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
    """,
    "op8_debruijn_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        u AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) + 1), lambda i: {'i': i, 'c': ws[i], 's': CASE WHEN i + 49 <= len(ws) THEN md5(array_to_string(ws[i:i + 49], ' ')) END})) AS x FROM d),
        b AS (SELECT doc_id, x.i AS i, x.c AS c, x.s AS s FROM u),
        f AS (SELECT s, min(doc_id) AS m FROM b WHERE s IS NOT NULL GROUP BY s),
        hit AS (SELECT b.doc_id, i, c, coalesce(m < b.doc_id, false) AS starts FROM b LEFT JOIN f USING (s)),
        gone AS (SELECT doc_id, i, c, max(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS g FROM hit),
        r AS (SELECT doc_id, count_if(g)::BIGINT AS n_removed, string_agg(c, ' ' ORDER BY i) FILTER (NOT g) AS k FROM gone GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
        FROM d LEFT JOIN r USING (doc_id)
    """,
    "op13_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id, turn, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS nm,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT conv_id, nm, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, nm) - 1 AS pos FROM t),
        c AS (
            SELECT conv_id, conv_id - conv_id % 20 AS base,
                   xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                       lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h
            FROM (SELECT DISTINCT conv_id FROM t)),
        r AS (
            SELECT c.conv_id, pos, nm, w FROM c JOIN o ON o.conv_id = c.base AND o.pos < h
            UNION ALL SELECT c.conv_id, pos, nm, w FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos >= h),
        p AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d, w, md5(string_agg(nm, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS k FROM r
            UNION ALL SELECT conv_id, 0, 0, '' FROM c),
        l AS (SELECT conv_id, max(d) AS length FROM p GROUP BY conv_id),
        n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = length) AS ends FROM p JOIN l USING (conv_id) GROUP BY k, d),
        a AS (SELECT n.k, n.d, n.n_convs, n.w, p.k AS ak, p.d AS ad FROM n JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d),
        kids AS (SELECT ak AS k, count(*) AS n_children FROM a WHERE d = ad + 1 GROUP BY ak),
        below AS (SELECT ak AS k, count(*) FILTER (kids.k IS NULL) AS n_leaves, sum((n_convs - 1) * w)::BIGINT AS saved_tokens FROM a LEFT JOIN kids USING (k) GROUP BY ak)
        SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
        FROM n JOIN below USING (k) LEFT JOIN kids USING (k)
        LEFT JOIN p ON p.conv_id = n.conv_id AND p.d = n.d - 1 LEFT JOIN n u ON u.k = p.k
    """,
}
