"""The queries of this package by name: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import langid, lines, merkle, minhash, mixing, packing, quality, tokens, topk, toxicity, urls, warc, whitening
from seqloom.llm.common import table
from seqloom.storage import Scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with the first line of its class. Links within a class are not counted, as that takes all pairs of it."""
    return lines.line_report(table(spark, sf_dir, "documents"), all_links=False).drop("n_links")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.language_id(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op5_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), *tokens.vocabulary(os.fspath(vocabulary)))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.filter("vec_id % 100 = 0"), vectors)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives stay under the shared folder, as the result is read from them."""
    place = f"{Scratch(spark, 'warc').base}/archives"
    read = warc.archive(table(spark, sf_dir, "pages"), place)
    own = F.col("kind") == "response"
    return read.select(
        "page_id",
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("n_bytes")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        "refers_to",
    )


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def page_junk(html) -> "F.Column":
    """Outcome of a page: more than two marks such as ***, ### or !! in a hundred characters."""
    marks = F.regexp_count(html, F.lit("\\*\\*\\*|###|%%%|\\$\\$\\$|&&&|!!"))
    return 100 * marks > 2 * F.length(html)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = urls.url_filter(pages, bad=page_junk(F.col("html")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "n_words", "n_hits")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    name: made
    for name, made in list(globals().items())
    if name.startswith("op") and callable(made) and name[2].isdigit()
}

# The operators behind the other queries are tested in tests/llm; the queries themselves are not.
ORACLES: dict[str, str] = {
    "op6_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 10
    """,
    "op8_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages
        ), f AS (
            SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id THEN first END AS refers_to
        FROM f
    """,
    "op13_merkle_manifest": """
        WITH RECURSIVE crc_step(i, k, c) AS (
            SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
            UNION ALL
            SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_step WHERE k < 8
        ), crc_table AS (
            SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k = 8
        ), d AS (
            SELECT row_number() OVER () AS rid, doc_id, source, lang, n_chars, text,
                   7 * (crc // 7) = crc AND n_chars IS NOT NULL AS changed
            FROM (
                SELECT documents.*, xor(4294967295, list_reduce(
                    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                    lambda a, b: xor(a >> 8, t[1 + xor(a & 255, b)]), 4294967295)) AS crc
                FROM documents, crc_table
            )
        ), f AS (
            SELECT rid, doc_id, lang, changed,
                   coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                       || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                   coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS own,
                   coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS more,
                   coalesce(strlen(text) || ':' || text, '-') AS tail
            FROM d
        ), leaves AS (
            SELECT rid, doc_id, coalesce('=' || lang, '') AS grp, sha256(head || own || tail) AS leaf,
                   sha256(head || CASE WHEN changed THEN more ELSE own END || tail) AS shown
            FROM f
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
        ), nodes(grp, lvl, pos, h, n) AS (
            SELECT grp, 0, pos, leaf, count(*) OVER (PARTITION BY grp) FROM placed
            UNION ALL
            SELECT grp, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
            FROM nodes WHERE n > 1 GROUP BY grp, lvl, pos // 2, n
        ), subroots AS (
            SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS gpos FROM nodes WHERE n = 1
        ), tops(lvl, pos, h, n) AS (
            SELECT 0, gpos, subroot, count(*) OVER () FROM subroots
            UNION ALL
            SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
            FROM tops WHERE n > 1 GROUP BY lvl, pos // 2, n
        ), height AS (
            SELECT grp, max(lvl) AS up FROM nodes GROUP BY grp
        ), way AS (
            SELECT p.rid, l.i AS lvl, (p.pos >> l.i) & 1 AS slot, coalesce(s.h, '') AS sibling
            FROM placed p JOIN height USING (grp) JOIN range(64) l(i) ON l.i < up
            LEFT JOIN nodes s ON s.grp = p.grp AND s.lvl = l.i AND s.pos = xor(p.pos >> l.i, 1)
            UNION ALL
            SELECT p.rid, up + l.i, (g.gpos >> l.i) & 1, coalesce(s.h, '')
            FROM placed p JOIN height USING (grp) JOIN subroots g USING (grp)
            JOIN range(64) l(i) ON l.i < (SELECT max(lvl) FROM tops)
            LEFT JOIN tops s ON s.lvl = l.i AND s.pos = xor(g.gpos >> l.i, 1)
        ), ways AS (
            SELECT rid, list({'slot': slot, 'sibling': sibling} ORDER BY lvl) AS steps FROM way GROUP BY rid
        ), climb(rid, lvl, h, steps) AS (
            SELECT rid, 0, shown, coalesce(steps, []) FROM placed LEFT JOIN ways USING (rid)
            UNION ALL
            SELECT rid, lvl + 1, sha256(CASE WHEN steps[lvl + 1].slot = 1 THEN steps[lvl + 1].sibling || h ELSE h || steps[lvl + 1].sibling END), steps
            FROM climb WHERE lvl < len(steps)
        )
        SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root,
               sha256(array_to_string(list_transform(steps, lambda s: s.sibling), '')) AS proof_sha256,
               h AS folded_root, h = (SELECT h FROM tops WHERE n = 1) AS verified
        FROM climb JOIN placed USING (rid) JOIN subroots USING (grp)
        WHERE lvl = len(steps)
    """,
}
