"""The registered queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from mapgauge.llm import chat, exact_dedup, licenses, line_dedup, media, mixing, ngram_join, packing, pii, quality
from mapgauge.llm.common import table


def op2_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_media(spark, sf_dir):
    return media.store_and_read(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (line_dedup.op1_line_dedup, op2_mixing, quality.op3_quality, op4_exact_dedup, packing.op5_packing, pii.op6_pii, chat.op7_chat, op8_media, ngram_join.op9_ngram_join, licenses.op10_licenses)}

ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op7_chat": chat.ORACLE,
    "op9_ngram_join": ngram_join.ORACLE,
    "op10_licenses": licenses.ORACLE,
    "op4_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {ASCII_LOWER} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g USING (t)""",
    "op2_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        p AS (SELECT *, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)) AS place FROM d),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM s),
        w AS (SELECT *, CAST(1 + rk % 3 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM r),
        f AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS t,
                coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS below,
                sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
        l AS (SELECT arg_min((t - below) / open, struct_pack(a := cap / weight, b := rk)) AS level FROM f WHERE (t - below) / open <= cap / weight),
        g AS (SELECT source, source_size, least(cap, level * weight) AS target FROM f, l),
        q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS passes,
                CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) % source_size ELSE 0 END AS quota FROM g),
        e AS (SELECT p.doc_id, p.size, q.source_size, q.target, q.passes,
                greatest(0, least(p.size, q.quota - coalesce(sum(p.size) OVER (PARTITION BY p.source ORDER BY p.place, p.doc_id, p.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS extra
              FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(passes * size + extra AS BIGINT) AS taken,
               CAST(passes AS BIGINT) AS passes, CAST(extra AS BIGINT) AS extra FROM e""",
}
