"""The registered queries of this subpackage: each applies an operator to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.llm import best_position, contamination, context_tree, cover_tree, html_text, language, ngram_join, packing, quality, sharding, substring, vectors, warc
from labelmill.llm.registry import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op1_ngram_jaccard", rf"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
   ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS g FROM w),
 e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS an, any_value(b.n) AS bn FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (an + bn - k)), both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT doc_id AS d, doc_id AS root FROM s UNION SELECT b, root FROM r JOIN both_ways ON a = d)
 SELECT d AS doc_id, CAST(any_value(len(g)) AS BIGINT) AS n_shingles, min(root) AS component_id FROM r JOIN s ON doc_id = d GROUP BY d""")
def _(spark, d):
    return ngram_join.near_duplicates(table(spark, d, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op9_substring_dedup", r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 h AS (SELECT doc_id, unnest([md5(array_to_string(w[i:i + 19], ' ')) for i in range(1, len(w) - 18)]) AS h, generate_subscripts(range(1, len(w) - 18), 1) AS p FROM w WHERE len(w) >= 20),
 again AS (SELECT doc_id, p FROM h QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1),
 gone AS (SELECT DISTINCT doc_id, p + k AS p FROM again, range(0, 20) AS r(k)),
 one AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
 SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""")
def _(spark, d):
    out = substring.deduplicate(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op2_decontaminate", rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 iw AS (SELECT item_id, least(len(w), 10) AS n, unnest([array_to_string(w[s:s + 9], ' ') for s in range(1, greatest(len(w) - 9, 1) + 1)]) AS t FROM i WHERE len(w) > 0),
 sizes AS (SELECT DISTINCT n FROM iw),
 dw AS (SELECT doc_id, n, unnest([array_to_string(w[s:s + n - 1], ' ') for s in range(1, len(w) - n + 2)]) AS t, generate_subscripts(range(1, len(w) - n + 2), 1) AS p FROM d, sizes WHERE len(w) >= n),
 hit AS (SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n, t)),
 place AS (SELECT doc_id, count(*) AS k FROM (SELECT DISTINCT doc_id, p + o AS q FROM hit, range(0, 10) AS r(o) WHERE o < n) GROUP BY doc_id),
 item AS (SELECT doc_id, count(*) AS k, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(place.k, 0) AS BIGINT) AS n_hit, CAST(coalesce(item.k, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, place.k IS NOT NULL AS contaminated FROM d LEFT JOIN place USING (doc_id) LEFT JOIN item USING (doc_id)""")
def _(spark, d):
    out = contamination.decontaminate(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op7_bin_packing")
def _(spark, d):
    return packing.pack(table(spark, d, "documents").select("doc_id", "text"))


@query("op4_sharding")
def _(spark, d):
    out = sharding.shard(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_language_id")
def _(spark, d):
    docs = table(spark, d, "documents")
    filters = language.learn(docs.filter(~language.held_out()))
    out = language.identify(docs.select("doc_id", "text"), filters)
    return out.select("doc_id", F.coalesce(language.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op10_quality_rules")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = quality.fit(quality.training_sample(docs, table(spark, d, "labels")))
    out = quality.score(docs, model)
    return out.select("doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


@query("op3_html_text")
def _(spark, d):
    return html_text.extract(table(spark, d, "pages")).select("page_id", "url", "text", "n_chars")


@query("op5_warc_derivatives")
def _(spark, d):
    """Both derived records of every page, with their digests and text of the block."""
    records = warc.derivatives(warc.responses(table(spark, d, "pages")))
    return records.select("source_key", *[c for c in records.columns if c not in ("source_key", "block")], F.sha2("block", 256).alias("block_sha256"))


@query("op6_sorted_projections", """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum([x * x for x in CAST(embedding AS DOUBLE[])])) AS n FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter([x IS NULL OR NOT isfinite(x) for x in embedding], lambda b: b)) = 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
 r AS (WITH RECURSIVE r AS (SELECT vec_id AS d, vec_id AS root FROM embeddings UNION SELECT b, root FROM r JOIN l ON a = d) SELECT * FROM r)
 SELECT d AS vec_id, CAST((SELECT count(*) FROM l WHERE a = d) AS BIGINT) AS n_links, min(root) AS component_id, d = min(root) AS kept FROM r GROUP BY d""")
def _(spark, d):
    return vectors.near_duplicates(table(spark, d, "embeddings"))


@query("op11_cover_tree", """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter([x IS NULL OR NOT isfinite(x) for x in embedding], lambda b: b)) = 0),
 s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
 SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""")
def _(spark, d):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return cover_tree.mine(table(spark, d, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query("op12_best_position", rf"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
 c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM w WHERE len(w) > 0),
 m AS (SELECT doc_id, 100 - 90 + ((90 * CAST(len(w) AS BIGINT) * n_docs) // n_terms) AS m FROM w, c WHERE len(w) > 0),
 p AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM w) WHERE t IN (SELECT t FROM i) GROUP BY doc_id, t),
 f AS (SELECT t, CAST(floor(1000 * ln((2.0 * n_docs + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, c GROUP BY t, n_docs),
 s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN p USING (t) JOIN f USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
 SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""")
def _(spark, d):
    return best_position.rank(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op13_context_tree")
def _(spark, d):
    return context_tree.score(table(spark, d, "documents"))
