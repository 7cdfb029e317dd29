"""One query for each operator of this folder over the whole of its table, and the corpus pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from ..session import prepare, table
from . import alignment, bpe, clustering, decontaminate, minhash, neardup, quality, secret_scan, sharding, token_count, toxicity, urls, vectors

#: The rules of the url query: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of the rules on every page's url; without a rule the page is allowed."""
    return urls.url_verdicts(table(spark, folder, "pages"), urls.rule_table(spark, RULES))


def op2_shuffle_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in a uniform shuffle into 40 shards whose row counts differ by one at most."""
    placed = sharding.shards(table(spark, folder, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every document and the least id reachable over links of at most four bits."""
    found = neardup.near_duplicates(table(spark, folder, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; every fifth id by checksum is held out of the labels learnt from."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("passages").alias("n_passages"))


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items found in every document."""
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "contaminated", F.transform("hits", lambda h: h["item_id"]).alias("item_ids"),
                        F.array_max(F.transform("hits", lambda h: h["similarity"])).alias("similarity"))


def op6_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five greatest integer inner products for every vector whose id is divisible by 50."""
    return vectors.top_k(table(spark, folder, "embeddings"), every=50, k=5)


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and their text, as digests."""
    out = bpe.encode(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Log importance of every document, and whether the resampling selects it."""
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, digest and list of the secret spans of every document."""
    found = secret_scan.secrets(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_count.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Links between the tokens of two tokenizers in every document, weighed by how many documents hold them."""
    return alignment.alignment(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                               public_tokenizers.path("piece_bpe_32k.model"))


def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest of 16 centroids for every vector after three rounds."""
    return clustering.clusters(table(spark, folder, "embeddings"), k=16, rounds=3)


def op13_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose sets of two-word shingles share 80 percent, and the one of each group that is kept."""
    return minhash.near_duplicates(table(spark, folder, "documents"), shingle=2, percent=80)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus pipeline over documents."""
    return corpus_pipeline.run(spark, folder)


_ALL = (op1_url_filter, op2_shuffle_shards, op3_simhash, op4_toxicity, op5_decontaminate, op6_exact_topk, op7_bpe, op8_quality,
        op9_secrets, op10_token_counts, op11_alignment, op12_centroids, op13_minhash,
        pipeline)
QUERIES = {f.__name__: (lambda spark, folder, f=f: f(prepare(spark), folder)) for f in _ALL}


def _centroid_sql(rounds: int) -> str:
    """Centroids c0, c1, ... and assignments a0, a1, ...: each round repeats the same two tables."""
    tables = []
    for r in range(rounds + 1):
        tables.append(f"""
d{r} AS (SELECT v.n, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r} c),
a{r} AS (SELECT n, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, c) = 1)""")
        if r < rounds:
            tables.append(f"""
m{r} AS (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x
  FROM (SELECT a.c, i, sum(v.x[i]) AS s, count(*) AS n FROM a{r} a JOIN v USING (n), range(1, 65) t(i) GROUP BY a.c, i) GROUP BY c),
c{r + 1} AS (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (c))""")
    return ",".join(tables)


ORACLES = {
    "op12_centroids": f"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x
       FROM (SELECT x, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT 16)),{_centroid_sql(3)}
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM a3 a JOIN v USING (n) JOIN c3 k ON k.c = a.c""",
    "op1_url_filter": """
WITH place AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
    THEN regexp_replace(substr(url, instr(url, '://') + 3), '[?#].*', '', 's') ELSE '' END AS place FROM pages),
parted AS (
  SELECT page_id, translate(split_part(place, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(place, length(split_part(place, '/', 1)) + 1) AS path FROM place),
rules(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT p.page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM parted p JOIN rules r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
  GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parted p LEFT JOIN best b USING (page_id)""",
    "op6_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
