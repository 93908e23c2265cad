"""The queries of this subpackage and their SQL, for the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bbit_minhash, centroids, exact_dedup, hard_negatives, html_extract, langid, mixing, ngram_join, sentencepiece_codec, sharding, substring_dedup, token_counts
from .common import Scratch, few



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars and shard (its number in the manifest), tier, shard_rows and added (a version) of the shard that each row of the compacted store is in, after 16 arrivals."""
    store = sharding.sharded(table(spark, sf_dir, "documents"), f"{Scratch(spark, 'shards').root}/store", arrivals=16, target=32 << 20)
    m = store.manifest()
    shards = spark.createDataFrame([(s["name"], k, s["tier"], s["rows"], s["added"]) for k, s in enumerate(m["shards"])], "name string, shard int, tier int, shard_rows long, added long")
    if not m["shards"]:
        return table(spark, sf_dir, "documents").selectExpr("doc_id", "n_chars", "0 as shard", "0 as tier", "0L as shard_rows", "0L as added")
    rows = store.read().select("doc_id", "n_chars", F.col("shard").alias("name"))
    return rows.join(few(shards), "name").drop("name")  # a row for each shard


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label)


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.near_copies(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_substring_dedup, op3_html_extraction, op4_ngram_join, op5_sentencepiece, op6_exact_dedup, op7_sharding, op8_nearest_neighbours, op9_mixing, op10_token_counts, op11_centroid_clustering, op12_hard_negatives, op13_minhash)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SIZE = r"CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT)"

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"



def _linked(n: int, percent: int, columns: str) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - {n - 1}), lambda k: array_to_string(w[k : k + {n - 1}], ' '))) END AS g FROM d WHERE len(w) > 0),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(g), 0) AS BIGINT) AS n_shingles, {columns} FROM d JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""


def _lloyd(k: int, rounds: int) -> str:
    """Each round as two tables: assignments, and centroids by their floor divisions."""
    near = "a{i} AS MATERIALIZED (SELECT vec_id, q, min_by(k, struct_pack(d := d, k := k)) AS k, min(d) AS d FROM (SELECT vec_id, v.q, k, CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{i} c) GROUP BY vec_id, q)"
    move = """c{j} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN (
  SELECT k, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY p) AS q FROM (SELECT k, p, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(q) AS x, generate_subscripts(q, 1) AS p FROM a{i}) GROUP BY k, p) GROUP BY k) m USING (k))"""
    steps = [x.format(i=i, j=i + 1) for i in range(rounds) for x in (near, move)] + [near.format(i=rounds)]
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, q FROM v QUALIFY k < {k}),
{", ".join(steps)},
t AS (SELECT k, CAST(sum(d) AS BIGINT) AS s FROM a{rounds} GROUP BY k)
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, t.s AS cluster_inertia, (SELECT CAST(sum(s) AS BIGINT) FROM t) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN t USING (k) JOIN c{rounds} c USING (k)"""


SQL = {
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
v AS (SELECT doc_id, k, array_to_string(w[k : k + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS k FROM d WHERE len(w) >= 50)),
m AS (SELECT s, min(doc_id) AS least FROM v GROUP BY s),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(k, k + 49)) AS i FROM v JOIN m USING (s) WHERE least < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
y AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)""",
    "op4_ngram_join": _linked(4, 85, "component_id"),
    "op6_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)""",
    "op9_mixing": f"""
WITH d AS (SELECT doc_id, source, {_SIZE} AS size, md5(CAST(doc_id AS VARCHAR)) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE r % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST) AS k FROM w),
p AS (SELECT *, (SELECT sum(source_size) FROM o) - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_words,
  sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight FROM o),
f AS (SELECT k, rest_words, rest_weight FROM p WHERE 3 * source_size * rest_weight >= rest_words * weight ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN o.k < f.k THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(f.rest_words AS DOUBLE) * weight / CAST(f.rest_weight AS DOUBLE) END AS target FROM o, f),
e AS (SELECT *, CAST(least(floor(target + 0.5), 3 * source_size) AS BIGINT) AS budget FROM t),
x AS (SELECT doc_id, size, key, source_size, target, budget // greatest(source_size, 1) AS epochs, budget % greatest(source_size, 1) AS rest,
  CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id) - size AS BIGINT) AS lead FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - lead)) AS BIGINT) AS taken FROM x""",
    "op11_centroid_clustering": _lloyd(8, 10),
    "op12_hard_negatives": """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
    "op13_minhash": _linked(2, 80, "component_id, doc_id = component_id AS kept"),
}
