"""The queries of the corpus operators: each applies its operator to a whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import token_digests
from .centroids import clustered
from .decontamination import contaminations
from .exact_search import top_k
from .language_id import identify_languages
from .license_scan import scan_licenses
from .mixing import mixture_counts
from .near_duplicates import near_duplicate_classes
from .pii import session_key, with_pseudonyms
from .shared import table
from .sharding import SHARDS, TABLE_SIZE, lookup_table, shard_names, with_shards
from .spelling import spelling_variants
from .substring_dedup import remove_repeats
from .toxicity import train, with_toxicity


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_toxicity(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_languages(docs).select("doc_id", "held_out", "lang_pred", "score")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=50, with_text=False)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_shards(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_counts(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=8, rounds=10)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


_OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
win AS (
  SELECT r, doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS h
  FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM d) t),
hit AS (
  SELECT r, p FROM (SELECT r, p, doc_id, min(doc_id) OVER (PARTITION BY h) AS m FROM win) t WHERE m < doc_id),
word AS (
  SELECT r, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM d),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 50)) AS p FROM hit),
kept AS (
  SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t
  FROM word WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.r = word.r AND g.p = word.p) GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words,
       CAST(len(d.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.r = d.r
"""


_OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def _crc32_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = 0xEDB88320 ^ c >> 1 if c & 1 else c >> 1
        out.append(c)
    return out


_OP11_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00c0-\u00ff]+')) AS run
    FROM documents) t
  WHERE length(run) >= 5 GROUP BY doc_id, run),
bytes AS (SELECT *, hex(encode(concat(doc_id, ':', run))) AS x FROM runs),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
    lambda c, b: xor({_crc32_table()}[(xor(c, b) & 255) + 1], c >> 8))) AS h
  FROM bytes),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed) t
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words) t),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, n_near, other, other_n FROM (
    SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near) t
  WHERE place = 1),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM forms f JOIN ends e USING (word)
"""


def _op12_sql(k: int = 8, rounds: int = 10) -> str:
    parts = [
        """
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""
c0 AS MATERIALIZED (
  SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), e) - 1 AS c, e FROM kept WHERE vec_id IS NOT NULL) t WHERE c < {k})""",
    ]
    for n in range(rounds + 1):
        parts.append(f"""
a{n} AS MATERIALIZED (
  SELECT r, c, d FROM (
    SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM (
      SELECT r, c, CAST(list_sum(list_transform(list_zip(v.e, m.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept v, c{n} m) t) t
  WHERE place = 1)""")
        if n < rounds:
            parts.append(f"""
c{n + 1} AS MATERIALIZED (
  SELECT c, coalesce(m.e, o.e) AS e FROM c{n} o LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS e FROM (
      SELECT c, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
        SELECT c, unnest(e) AS x, unnest(range(64)) AS p FROM a{n} JOIN kept USING (r)) t GROUP BY c, p) t GROUP BY c) m USING (c))""")
    return f"""
WITH {",".join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} m USING (c)
"""


def _op5_sql() -> str:
    table_ = ", ".join(map(str, lookup_table(shard_names(SHARDS), TABLE_SIZE)))
    return f"""
WITH t AS (SELECT [{table_}] AS shards),
d AS (SELECT doc_id, CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15)) AS BIGINT) % {TABLE_SIZE} AS slot FROM documents)
SELECT doc_id, slot, CAST(shards[slot + 1] AS INTEGER) AS shard FROM d, t
"""


QUERIES = {
    "op1_toxicity_chain": op1_toxicity_chain,
    "op2_pii_pseudonyms": op2_pii_pseudonyms,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_sharding": op5_sharding,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_decontamination": op7_decontamination,
    "op8_license_scan": op8_license_scan,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_mixing": op10_mixing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLES = {
    "op4_substring_dedup": _OP4_SQL,
    "op5_sharding": _op5_sql(),
    "op6_exact_top_k": _OP6_SQL,
    "op11_spelling_variants": _OP11_SQL,
    "op12_centroid_clustering": _op12_sql(),
}
