"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm import byte_bpe, centroids, decontaminate, fill_middle, html_extract, jaccard_join, language_id, minhash, quality, suffix_dedup, token_counts, top_k, warc
from voxelweave.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=0)
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Five hex digits at a time to four letters of base 32.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::INTEGER >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    dictionaries = language_id.fit(docs.where(~docs.held_out))
    found = language_id.predict(docs.drop("lang"), dictionaries, min_margin=0.01)
    return found.select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.with_lengths(counted, limit=512)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] for z in list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path, pattern))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents"), width=5, percent=75)


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
sh AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4),
links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * k >= 75 * (na + nb - k)), e AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT doc_id, len(s) AS n_shingles, c AS component_id FROM sets JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) ON a = doc_id
"""


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.with_verdict(decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"), width=13))


_WORDS9 = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS9} AS w FROM documents), i AS (SELECT item_id, {_WORDS9} AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[p:p+n-1], ' ') AS s FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win), placed AS (SELECT doc_id, n, p, array_to_string(w[p:p+n-1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
m AS MATERIALIZED (SELECT doc_id, placed.n, p, item_id FROM placed JOIN win ON win.n = placed.n AND win.s = placed.s),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


OP11_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
sh AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4),
links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (na + nb - k)), e AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT doc_id, len(s) AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) ON a = doc_id
"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.sort_means(table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64, width=64, seed=1)
    return found.drop("centroid")


def _round_sql(r: int) -> str:
    """One round in SQL: assignment d{r} to the centroids c{r}, and with it the centroids of the next round."""
    return f"""d{r} AS MATERIALIZED (SELECT id, arg_min(n, d * 16 + n) AS n, min(d) AS d FROM (SELECT id, n, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.e, c.e)]) AS BIGINT) AS d FROM v, c{r} c) GROUP BY id),
s{r} AS (SELECT n, i, sum(x) AS s, count(*) AS k FROM (SELECT n, unnest(e) AS x, unnest(range(1, 65)) AS i FROM v JOIN d{r} USING (id)) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN (SELECT n, list(CAST((s - (((s % k) + k) % k)) // k AS BIGINT) ORDER BY i) AS e FROM s{r} GROUP BY n) m USING (n))"""


OP12_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS n, e FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v ORDER BY 1, 2 LIMIT 16)),
{", ".join(_round_sql(r) for r in range(4))}
SELECT vec_id, CAST(n AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY n) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.e, ',')) AS centroid_sha256
FROM v JOIN d3 USING (id) JOIN c3 USING (n)
"""


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), grammar="word", seed=1, plain_percent=10, spm_percent=20)
    return fill_middle.digests(cut).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
k AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS x, array_to_string(u[a+1:b], '') AS y, array_to_string(u[b+1:n], '') AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_language_id": op2_language_id,
        "op3_token_counts": op3_token_counts,
        "op4_top_k": op4_top_k,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_html_extract": op8_html_extract,
        "op9_decontaminate": op9_decontaminate,
        "op10_quality": op10_quality,
        "op11_minhash": op11_minhash,
        "op12_centroids": op12_centroids,
        "op13_fill_middle": op13_fill_middle,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op4_top_k": OP4_SQL, "op7_jaccard_join": OP7_SQL, "op9_decontaminate": OP9_SQL, "op11_minhash": OP11_SQL, "op12_centroids": OP12_SQL, "op13_fill_middle": OP13_SQL}
