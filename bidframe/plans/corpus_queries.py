"""Registered queries over documents, benchmark, embeddings and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidframe.functions import text
from bidframe.operators import corpus, latent, ledger, retrieval
from bidframe.plans.bindings import table
from bidframe.plans.queries import query
from bidframe.sources.scratch import stored

_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
_GLUED = rf"(\d+(?:\.\d+)?)({'|'.join(text.GLUED_UNITS)})"


def _tokens_sql(column: str) -> str:
    raw = f"regexp_extract_all(strip_accents(lower({column})), '[a-z0-9]+(?:[./-][a-z0-9]+)*', 0)"
    return (f"list_filter(flatten(list_transform({raw}, lambda t: CASE WHEN regexp_full_match(t, '{_GLUED}') THEN [regexp_extract(t, '{_GLUED}', 1), regexp_extract(t, '{_GLUED}', 2)] "
            f"WHEN regexp_matches(t, '[/-]') THEN list_concat([t], string_split_regex(t, '[/-]')) ELSE [t] END)), lambda t: t <> '' AND NOT list_contains({_STOP}, t))")


def _stem_sql(t: str) -> str:
    whens = []
    for suffix, new in text.SUFFIXES:
        base = f"(left({t}, length({t}) - {len(suffix)}) || '{new}')"
        if suffix in ("ing", "ed"):
            base = f"(CASE WHEN length({base}) >= 4 AND right({base}, 1) = left(right({base}, 2), 1) AND right({base}, 1) NOT IN ('l', 's', 'z') THEN left({base}, length({base}) - 1) ELSE {base} END)"
        if suffix == "s":
            base = f"(CASE WHEN regexp_matches({t}, '(ss|us|is)$') THEN {t} ELSE {base} END)"
        whens.append(f"WHEN {t} LIKE '%{suffix}' AND length({t}) - {len(suffix)} >= 3 THEN {base}")
    return f"CASE WHEN length({t}) <= 3 OR regexp_matches({t}, '[0-9]') THEN {t} {' '.join(whens)} ELSE {t} END"


@query("tokens", f"SELECT doc_id, len(t)::INT AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_tokens_sql('text')} AS t FROM documents)")
def q_tokens(spark, d):
    t = text.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("stem", f"WITH w AS (SELECT DISTINCT unnest({_tokens_sql('text')}) AS t FROM documents) SELECT t AS token, {_stem_sql('t')} AS stem FROM w")
def q_stem(spark, d):
    words = table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("token")).distinct()
    return words.withColumn("stem", text.stem(F.col("token")))


_W = "[ \\t\\n\\x0B\\f\\r]"
# DuckDB's expressions look ahead by none: the sign after the gap is put back
_SENT = (f"list_transform(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '([.!?;]){_W}+([A-Z0-9(\"''])', '\\1' || chr(30) || '\\2', 'g'), '\\n{{2,}}', chr(30), 'g'), '\\n({_W}*([-*•▪◦]|[0-9]+[.)]){_W})', chr(30) || '\\1', 'g'), chr(30)), "
         f"lambda x: trim(x, ' ' || chr(10) || '-*•▪◦')), lambda x: length(x) >= 3), lambda x: regexp_replace(x, '{_W}*\\n{_W}*', ' ', 'g'))")


@query("sentences", f"WITH s AS (SELECT doc_id, {_SENT} AS s FROM documents) SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, chr(10))) AS digest FROM s WHERE len(s) > 0")
def q_sentences(spark, d):
    rows = corpus.split_sentences(table(spark, d, "documents"))
    joined = F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"])
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(joined, "\n")).alias("digest"))


@query("line_shape", "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT regexp_replace(regexp_replace(lower(trim(line, ' ')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '[0-9]+', '#', 'g') AS shape, count(*) AS n FROM l GROUP BY 1")
def q_shape(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(text.line_shape(F.col("line")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("contacts", f"SELECT doc_id, nullif(regexp_extract(text, '{corpus.EMAIL}', 0), '') AS email, nullif(regexp_extract(text, '{corpus.PHONE}', 0), '') AS phone FROM documents")
def q_contacts(spark, d):
    return corpus.extract_contacts(table(spark, d, "documents")).select("doc_id", "email", "phone")


_FORBIDDEN = ["idiot", "token = ", "licensed under"]


# each document may name the value of the order of its number
@query("leak_check", f"""WITH a AS (SELECT doc_id, text, list_filter([{', '.join(repr(t) for t in _FORBIDDEN)}], lambda t: contains(lower(text), t)) AS terms,
list_filter(list_transform(regexp_extract_all(text, '\\b[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda x: try_cast(replace(x, ',', '') AS DOUBLE)), lambda x: x >= 10000 AND NOT coalesce(abs(x - o_totalprice) <= 1, false)) AS amounts
FROM documents LEFT JOIN orders ON o_orderkey = doc_id)
SELECT doc_id, array_to_string(terms, ',') AS terms, len(amounts)::INT AS amounts, list_max(amounts) AS largest FROM a WHERE len(terms) > 0 OR len(amounts) > 0""")
def q_leak(spark, d):
    value = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.array("o_totalprice").alias("allowed"))
    docs = table(spark, d, "documents").join(value, "doc_id", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<double>")))
    return corpus.leak_check(docs, _FORBIDDEN, F.col("allowed")).select("doc_id", F.array_join("terms", ",").alias("terms"), F.size("amounts").alias("amounts"), F.array_max("amounts").alias("largest"))


@query("page_chunks", """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
w AS (SELECT doc_id, pos, length(line) AS n, length(line) + 1 AS used, 1 AS page FROM l WHERE pos = 0
  UNION ALL SELECT l.doc_id, l.pos, length(l.line), CASE WHEN w.used + length(l.line) + 1 > 3200 THEN 0 ELSE w.used END + length(l.line) + 1, w.page + CAST(w.used + length(l.line) + 1 > 3200 AS INT) FROM w JOIN l ON l.doc_id = w.doc_id AND l.pos = w.pos + 1)
SELECT doc_id, CAST(page AS INT) AS page, count(*) AS lines, CAST(sum(n) AS BIGINT) AS chars FROM w GROUP BY 1, 2""")
def q_pages(spark, d):
    return corpus.page_chunks(table(spark, d, "documents")).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("strip_boilerplate", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), p AS (SELECT *, pos // 4 AS page FROM l),
s AS (SELECT *, regexp_replace(regexp_replace(lower(trim(line, ' ')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '[0-9]+', '#', 'g') AS shape, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) <= 2 OR row_number() OVER (PARTITION BY doc_id, page ORDER BY pos DESC) <= 2 AS edge FROM p),
e AS (SELECT doc_id, shape, count(DISTINCT page) AS n FROM s WHERE edge AND shape <> '' GROUP BY 1, 2), g AS (SELECT doc_id, count(DISTINCT page) AS pages FROM p GROUP BY 1 HAVING count(DISTINCT page) >= 3),
x AS (SELECT e.doc_id, e.shape FROM e JOIN g ON e.doc_id = g.doc_id WHERE n >= 2 AND n >= 0.4 * pages)
SELECT s.doc_id, count(*) AS kept FROM s WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = s.doc_id AND x.shape = s.shape) GROUP BY 1""")
def q_boilerplate(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("page", F.floor(F.col("pos") / 4))
    return corpus.strip_boilerplate(lines).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


_SEGMENTS = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{s}'" for s, p in corpus.SEGMENT_RULES) + " END"


@query("infer_segment", f"WITH n AS (SELECT s_suppkey, {_SEGMENTS} AS s FROM (SELECT s_suppkey, s_name AS t FROM supplier)), b AS (SELECT doc_id, {_SEGMENTS} AS s FROM (SELECT doc_id, text AS t FROM documents)) "
       "SELECT doc_id, coalesce(n.s, b.s, 'smb') AS segment FROM b LEFT JOIN n ON s_suppkey = doc_id")
def q_segment(spark, d):
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), "s_name")
    return table(spark, d, "documents").join(names, "doc_id", "left").select("doc_id", corpus.infer_segment(F.col("s_name"), F.col("text")).alias("segment"))


@query("content_fingerprint", """WITH h AS (SELECT source, sha256(coalesce(text, '')) AS h, count(*) AS n FROM documents GROUP BY 1, 2),
b AS (SELECT source, left(h, 3) AS b, sha256(string_agg(h || ':' || n, ',' ORDER BY h)) AS d FROM h GROUP BY 1, 2) SELECT source, sha256(string_agg(b || ':' || d, ',' ORDER BY b)) AS digest FROM b GROUP BY 1""")
def q_fingerprint(spark, d):
    return corpus.content_digest(table(spark, d, "documents"), ["source"])


_BM = f"""p AS (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens_sql('text')}) AS t FROM documents) GROUP BY 1, 2), ln AS (SELECT doc_id, len({_tokens_sql('text')}) AS len FROM documents),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_tokens_sql('text')}) AS term FROM benchmark), st AS (SELECT term, count(*) AS df FROM p GROUP BY 1), k AS (SELECT count(*) AS n, avg(len) AS m FROM ln),
bm AS (SELECT query_id, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (1 - 0.72 + 0.72 * len / m))) AS score FROM q JOIN p USING (term) JOIN st USING (term) JOIN ln ON ln.doc_id = p.doc_id CROSS JOIN k GROUP BY 1, 2)"""


@query("bm25_topk", f"WITH {_BM}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm) SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def q_bm25(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25_topk(queries, table(spark, d, "documents").select("doc_id", "text"), 5, 6)


@query("corpus_stats", f"WITH {_BM} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM st CROSS JOIN k")
def q_stats(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return retrieval.corpus_stats(retrieval.postings(docs, text.tokens(F.col("text"))), docs).withColumn("idf", F.round("idf", 9))


_NAMES = "SELECT p_partkey AS id, strip_accents(lower(p_name)) AS t FROM part"


@query("char_cosine_topk", f"""WITH n AS ({_NAMES}), w AS (SELECT id, ' ' || unnest(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) || ' ' AS w FROM n),
g AS (SELECT id, substr(w, i, k) AS term FROM w CROSS JOIN (VALUES (3), (4), (5)) kk(k) CROSS JOIN LATERAL (SELECT unnest(range(1, length(w) - k + 2)) AS i) WHERE length(w) >= k), p AS (SELECT id, term, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
x AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM n)) / (1 + df)) + 1) AS w FROM p JOIN df USING (term)), u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM x),
c AS (SELECT a.id AS query_id, b.id AS doc_id, round(least(1.0, sum(a.w * b.w)), 6) AS score FROM u a JOIN u b USING (term) WHERE a.id % 100 = 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0)
SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def q_char(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    queries = docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return retrieval.nearest_by_grams(queries, docs, 3, 6)


@query("knn", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c) SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def q_knn(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return retrieval.knn(v.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), v, 5).withColumn("score", F.round("score", 6))


@query("match_customer", f"""WITH c AS (SELECT c_custkey AS id, list_distinct({_tokens_sql('c_name')}) AS t FROM customer), s AS (SELECT s_suppkey AS id, list_distinct({_tokens_sql("replace(s_name, 'Supplier', 'Customer')")}) AS t FROM supplier),
j AS (SELECT s.id AS query_id, c.id AS doc_id, len(list_intersect(s.t, c.t))::DOUBLE / len(list_distinct(list_concat(s.t, c.t))) AS score FROM s JOIN c ON len(list_intersect(s.t, c.t)) > 0)
SELECT query_id, arg_max(doc_id, (score, -doc_id)) AS doc_id, round(max(score), 9) AS score FROM j WHERE score >= 0.6 GROUP BY 1""")
def q_match_customer(spark, d):
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("text"))
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.regexp_replace("s_name", "Supplier", "Customer").alias("text"))
    return retrieval.match_names(names, known).withColumn("score", F.round("score", 9))


@query("similar_examples", f"""WITH l AS (SELECT doc_id AS id, text FROM documents ORDER BY doc_id DESC LIMIT 500), a AS (SELECT DISTINCT item_id AS query_id, {_stem_sql('w')} AS term FROM (SELECT item_id, unnest({_tokens_sql('text')}) AS w FROM benchmark)), b AS (SELECT DISTINCT id, {_stem_sql('w')} AS term FROM (SELECT id, unnest({_tokens_sql('text')}) AS w FROM l)),
s AS (SELECT query_id, id, count(*) AS shared FROM a JOIN b USING (term) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, id DESC) AS rank FROM s) SELECT query_id, id, shared, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def q_examples(spark, d):
    labels = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.similar_examples(labels, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 3)


@query("lsa_search")
def q_lsa(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", F.transform(text.tokens(F.col("text")), lambda t: F.xxhash64(t)).alias("hashes"))
    vectors = stored(latent.fit(rows, n=docs.count(), terms=False).vectors(), "vectors")
    queries = vectors.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("vector"))
    return retrieval.knn(queries, vectors, 3).withColumn("score", F.round("score", 4))


@query("text_classifier")
def q_classifier(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = ledger.split_by_group(docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id"), "doc_id")
    model = ledger.fit_text_classifier(rows.where("NOT held_out"))
    return ledger.predict_distribution(model, rows.where("held_out")).select("doc_id", "label", "prediction", "confidence")
