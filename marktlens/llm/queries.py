"""The registered queries of the corpus operators, over whole tables, and the oracles of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marktlens.llm import embeddings, hamming, mixing, negatives, pieces, pseudolikelihood, simhash, substrings, suffixes, tokenfiles, toxicity, variants, wordpiece
from marktlens.llm.common import folder


#: A parameter of the queries: where the public tokenizers' vocabulary files are.
TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_removed_units", "n_removed_chars", "removed", F.length("text").cast("long").alias("n_kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs, and for the components the closure of their links.
OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.93
), r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT e.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = e.vec_id) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.vec_id = e.vec_id
"""


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming.sign_codes(table(spark, sf_dir, "embeddings"))
    return hamming.top_k(codes, codes.filter("vec_id % 20 = 0"), k=10)


OP6_SQL = """
WITH c AS (
  SELECT vec_id, list_aggregate(list_transform(range(64), lambda i: CASE WHEN coalesce(embedding[i + 1], 0) > 0 THEN CAST(1 AS HUGEINT) << CAST(i AS INT) ELSE 0 END), 'sum') AS code
  FROM embeddings WHERE embedding IS NOT NULL
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code)) AS distance FROM c q JOIN c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, CAST(distance AS INT) AS distance FROM r WHERE rank <= 10
"""


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draw(table(spark, sf_dir, "documents"), target_entropy=0.95, blocks=64, seed=1)
    return drawn.select("doc_id", "source", "tokens", "epoch", "block", "start", F.col("order").alias("order_key"))


#: The same mixing in DuckDB: shares, fifty halvings of the exponent, quotas, then running sums over each permutation.
OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^	-
 ]+')) AS BIGINT) AS tokens FROM documents
), s AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS source_tokens FROM d GROUP BY source HAVING sum(tokens) > 0),
p AS (SELECT source, source_tokens, source_tokens / CAST((SELECT sum(source_tokens) FROM s) AS DOUBLE) AS p FROM s),
bis(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(8 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
      (SELECT ln(sum(pow(p.p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p.p, (lo + hi) / 2) * ln(p.p)) / sum(pow(p.p, (lo + hi) / 2)) >= 0.95 * ln(count(*)) FROM p) AS ok
    FROM bis WHERE i < 50)
), a AS (SELECT lo AS a FROM bis WHERE i = 50),
w AS (SELECT source, source_tokens, pow(p.p, a.a) / (SELECT sum(pow(p.p, a.a)) FROM p, a) AS weight FROM p, a),
q AS (SELECT *, CAST(round(weight * (SELECT max(source_tokens / weight) FROM w)) AS BIGINT) AS quota FROM w),
e AS (SELECT *, quota // source_tokens AS epochs, quota % source_tokens AS part FROM q),
x AS (
  SELECT d.doc_id, d.source, d.tokens, epochs, part, quota, source_tokens,
    unnest(generate_series(0, CASE WHEN d.tokens = 0 THEN 0 ELSE epochs - CASE WHEN part = 0 THEN 1 ELSE 0 END END)) AS epoch
  FROM d LEFT JOIN e USING (source)
), r AS (SELECT *, md5(concat('1:', doc_id, ':', epoch)) AS order_key FROM x),
pc AS (SELECT *, CAST(concat('0x', substr(order_key, 1, 4)) AS INT) % 1024 AS piece FROM r),
c AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY piece, order_key, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM pc),
k AS (SELECT *, CAST(epoch * coalesce(source_tokens, 0) + upto - tokens AS BIGINT) AS start FROM c WHERE tokens = 0 OR epoch < epochs OR upto <= part)
SELECT doc_id, source, tokens, CAST(epoch AS INT) AS epoch, CAST(least(coalesce(start * 64 // quota, 0), 63) AS INT) AS block, start, order_key FROM k
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out, "score", "predicted", F.size("passages").alias("n_passages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wordpiece.count_tokens(docs, f"{TOKENIZERS}/piece_bpe_32k.model").drop("text")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudolikelihood.train_and_score(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


#: crc32 by its table, made from the rule; deletions as texts; words of one length are near if one place differs, others by what they share.
OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY b) AS crc FROM (SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(b AS BIGINT)) AS c FROM (SELECT unnest(range(256)) AS b))
), r AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY ALL
), x AS (SELECT run, n, hex(encode(concat(doc_id, ':', run))) AS h FROM r
), h AS (
  SELECT run, n, xor(4294967295, list_reduce(list_transform(range(len(h) // 2), lambda i: CAST(concat('0x', substr(h, 2 * i + 1, 2)) AS BIGINT)), lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) % 256 AS INT) + 1]), CAST(4294967295 AS BIGINT))) AS h FROM x, t
), w AS (
  SELECT CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5
), k AS (
  SELECT word, n, word AS key FROM w UNION SELECT word, n, concat(substr(word, 1, i - 1), substr(word, i + 1)) FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), p AS (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM k a JOIN k b ON a.key = b.key AND a.word <> b.word
  WHERE length(a.word) <> length(b.word) AND (a.key = a.word OR b.key = b.word) OR length(a.word) = length(b.word) AND len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1
), f AS (
  SELECT w.word, w.n, count(near) AS n_near, max(near_n) AS best_n, arg_min(near, (-near_n, encode(near))) AS best FROM w LEFT JOIN p ON p.word = w.word GROUP BY ALL
), g AS (SELECT word, n, n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM f),
c(word, root, steps) AS (SELECT word, word, 0 FROM g UNION ALL SELECT c.word, g.form, steps + 1 FROM c JOIN g ON g.word = c.root WHERE g.form IS NOT NULL),
e AS (SELECT word, arg_max(root, steps) AS root FROM c GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM g JOIN e USING (word)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return negatives.mine(rows.select("vec_id", label.alias("label"), q.alias("q")), F.col("vec_id") % 50 == 0)


#: Every anchor with every row, ranked.
OP12_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), p AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS alike, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score FROM v a JOIN v ON len(a.q) = len(v.q) AND a <> v WHERE a.vec_id % 50 = 0
), f AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS rn FROM p WHERE alike) WHERE rn <= 5
), r AS (
  SELECT f.*, p.vec_id AS negative_id, p.score AS negative_score, row_number() OVER (PARTITION BY f.anchor_id, f.positive_id ORDER BY p.score DESC, p.vec_id) AS rank
  FROM f JOIN p ON p.anchor_id = f.anchor_id AND NOT p.alike AND 50 * positive_score <= 100 * p.score AND 100 * p.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
"""


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "token-files")
    tokenfiles.write(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json", path, end=1)
    return tokenfiles.read(spark, path)


QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op2_embedding_near_dedup": op2_embedding_near_dedup, "op3_source_mixing": op3_source_mixing, "op4_toxicity": op4_toxicity, "op5_suffix_array_dedup": op5_suffix_array_dedup, "op6_topk_search": op6_topk_search, "op7_sentencepiece": op7_sentencepiece, "op8_token_counts": op8_token_counts, "op9_lm_scoring": op9_lm_scoring, "op10_simhash_near_dedup": op10_simhash_near_dedup, "op11_spelling_variants": op11_spelling_variants, "op12_hard_negatives": op12_hard_negatives, "op13_token_files": op13_token_files}
ORACLES: dict[str, str] = {"op2_embedding_near_dedup": OP2_SQL, "op3_source_mixing": OP3_SQL, "op6_topk_search": OP6_SQL, "op11_spelling_variants": OP11_SQL, "op12_hard_negatives": OP12_SQL}
