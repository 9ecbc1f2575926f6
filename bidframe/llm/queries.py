"""Queries of the corpus operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidframe.llm.decontam import leaks
from bidframe.llm.divergence import audit_sources
from bidframe.llm.fingerprint import fingerprint_documents
from bidframe.llm.line_dedup import dedup_lines
from bidframe.llm.mixing import mixed
from bidframe.llm.pii import find_personal_data
from bidframe.llm.resampling import resample
from bidframe.llm.secret_scan import BASE, RULES, scan_secrets
from bidframe.llm.sharding import shard_documents
from bidframe.llm.simhash import simhash_components
from bidframe.llm.suffix import remove_repeats
from bidframe.llm.toxicity import score_documents
from bidframe.llm.warc import replay

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents"))


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its source's weight (six decimals) and the copies that the mixture takes."""
    found = mixed(_table(spark, sf_dir, "documents"), budget_share=1.0, max_repeats=2.0)
    return found.select("doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"), "copies")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op4_kk_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op5_pii_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


def op6_simhash_bitslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op7_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and benchmark item that it leaks."""
    found = leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "windows", "coverage", "reparameterised")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_temperature_mixing": op2_temperature_mixing,
    "op3_secret_scan": op3_secret_scan,
    "op4_kk_sharding": op4_kk_sharding,
    "op5_pii_offsets": op5_pii_offsets,
    "op6_simhash_bitslice": op6_simhash_bitslice,
    "op7_ctph": op7_ctph,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_template_decontamination": op10_template_decontamination,
    "op11_source_divergence": op11_source_divergence,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_warc_index": op13_warc_index,
}

_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"



def _secret_sql() -> str:
    """Positions follow from the lengths of the texts between matches."""

    def spans(number: int) -> str:
        rule = RULES[number]
        return f"""list_filter(list_transform(range(1, len(m{number}) + 1), lambda i: {{
            'a': (coalesce(list_sum(list_transform(g{number}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m{number}[1:i-1], lambda x: length(x))), 0))::BIGINT,
            'k': {number}, 'n': length(m{number}[i])::BIGINT, 'own': length(o{number}[i])}}), lambda x: x.own >= {rule.least})"""

    def found(number: int) -> str:
        rule = RULES[number]
        regex = rule.regex.replace("'", "''")
        return (f"regexp_extract_all(t, '{regex}', 0) AS m{number}, regexp_extract_all(t, '{regex}', {rule.group}) AS o{number}, "
                f"string_split_regex(t, '{regex}') AS g{number}")

    n = len(RULES)
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"

    def joined(numbers: range) -> str:
        every = " || ".join(f"s{k}" for k in numbers)
        return f"array_to_string(list_transform(list_sort({every}), lambda x: {kinds}[x.k + 1] || ':' || x.a || ':' || (x.a + x.n)), ',')"

    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        f AS (SELECT doc_id, {", ".join(found(k) for k in range(n))} FROM d),
        s AS (SELECT doc_id, {", ".join(f"{spans(k)} AS s{k}" for k in range(n))} FROM f)
        SELECT doc_id, {", ".join(f"len(s{k})::BIGINT AS n_{RULES[k].kind}" for k in range(BASE))},
               sha256({joined(range(BASE))}) AS base_sha256, {joined(range(n))} AS spans,
               ({" + ".join(f"len(s{k})" for k in range(BASE, n))})::BIGINT AS n_added FROM s"""


ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
        k AS (SELECT *, translate(trim(line, {_STRIP}), {_LOWER}) AS key FROM x),
        hot AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
                GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        m AS (SELECT k.doc_id, k.i, k.line, (hot.key IS NOT NULL AND k.doc_id <> hot.keeper) AS gone
              FROM k LEFT JOIN hot ON k.key = hot.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op3_secret_scan": _secret_sql(),
    "op2_temperature_mixing": f"""
        WITH RECURSIVE r AS (SELECT doc_id, source, md5(concat_ws(':', 'mix', doc_id::VARCHAR)) AS o,
            trim(coalesce(text, ''), {_STRIP}) AS t FROM documents),
        d AS (SELECT doc_id, source, o, CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '[\\x20\\x09-\\x0D]+')) END AS n_tokens FROM r),
        s AS (SELECT source, sum(n_tokens)::BIGINT AS t, count(*) AS n FROM d GROUP BY source),
        p AS (SELECT *, t::DOUBLE / (SELECT sum(t)::DOUBLE FROM s) AS p FROM s WHERE t > 0),
        b(i, low, high) AS (
            SELECT 0, 0.0::DOUBLE, CASE WHEN (SELECT pow(min(p), -1) / count(*) FROM p) <= 2.0 THEN 0.0 ELSE 1.0 END::DOUBLE
            UNION ALL
            SELECT i + 1, CASE WHEN fits THEN low ELSE mid END, CASE WHEN fits THEN mid ELSE high END
            FROM (SELECT i, low, high, (low + high) / 2 AS mid,
                  (SELECT pow(min(p), (low + high) / 2 - 1) / sum(pow(p, (low + high) / 2)) FROM p) <= 2.0 AS fits FROM b WHERE i < 40)),
        e AS (SELECT high AS t FROM b WHERE i = 40),
        w AS (SELECT source, t, n, pow(p, (SELECT t FROM e)) / (SELECT sum(pow(p, (SELECT t FROM e))) FROM p) AS weight, ceil(n / 10000.0)::BIGINT AS blocks FROM p),
        q AS (SELECT *, floor(weight * (SELECT sum(t) FROM s))::BIGINT AS quota FROM w),
        x AS (SELECT d.*, q.t, q.quota, q.weight, ('0x' || substr(o, 1, 8))::BIGINT % coalesce(blocks, 1) AS block FROM d LEFT JOIN q ON d.source IS NOT DISTINCT FROM q.source),
        y AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY md5(concat_ws(':', 'mix', source, block::VARCHAR)), block, o, doc_id
              ROWS UNBOUNDED PRECEDING) AS upto FROM x)
        SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, coalesce(round(weight, 6), 0.0) AS weight,
               (CASE WHEN n_tokens > 0 AND quota IS NOT NULL THEN quota // t + (upto <= quota % t)::BIGINT ELSE 0 END)::BIGINT AS copies FROM y""",
    "op11_source_divergence": f"""
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {_LOWER}) AS t FROM documents),
        w AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM w GROUP BY lang, source, term),
        l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
        v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS n FROM l GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        gn AS (SELECT g.lang, g.source, coalesce(sum(k.n), 0)::HUGEINT AS n FROM g
               LEFT JOIN (SELECT c.* FROM c JOIN l USING (lang, term)) k ON g.lang = k.lang AND g.source = k.source GROUP BY g.lang, g.source),
        p AS (SELECT gn.lang, gn.source, l.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (gn.n + 5 * v.v) AS p,
                     1 + 1000000000::HUGEINT * (l.n + 5) // (v.n + 5 * v.v) AS q
              FROM gn JOIN l ON gn.lang = l.lang JOIN v ON gn.lang = v.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = l.term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
        SELECT * FROM o WHERE part = 'pair' OR rank <= 50""",
    "op13_warc_index": """
        WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM d)
        SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((('0x' || substr(h, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM k""",
}
