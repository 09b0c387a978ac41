"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hamming, minhash, packing, quality, sharding, sstable, substring_dedup, toxicity, vector_dedup
from .encoder import byte_bpe_path, word_bpe_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_int8_tile_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_b_bit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), byte_bpe_path())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))


def op6_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), byte_bpe_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_de_bruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_sorted_string_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sstable.round_trip(_table(spark, sf_dir, "documents"), word_bpe_path())
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming.sign_codes(_table(spark, sf_dir, "embeddings"))
    return hamming.top_k(codes, codes.where("vec_id % 20 = 0"), 10)


def op10_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


#: All pairs by their definition: fit for small tables only, and independent of the tiles. Vectors are scaled by powers of two, which
#: changes no cosine, so that squares of very large and very small components neither overflow nor vanish.
_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), directed AS (
  SELECT vec_id, e, -floor(log2(list_max(list_transform(e, lambda x: abs(x))))) AS k FROM v
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), good AS (
  SELECT vec_id, list_transform(e, lambda x: x * pow(2.0, least(k, 1000)) * pow(2.0, greatest(k - 1000, 0))) AS e FROM directed
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, l.component_id, v.vec_id = l.component_id AS kept
FROM v JOIN least l ON l.a = v.vec_id LEFT JOIN degree d ON d.a = v.vec_id
"""

#: Sets of distinct 2-word shingles compared through the shingles that they share; a component's smallest id by reachability.
_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 2 THEN words ELSE words[i:i + 1] END AS s
  FROM w, unnest(CASE WHEN len(words) = 0 THEN [] ELSE range(1, greatest(len(words), 2)) END) AS t(i)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l ON l.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

#: The first document of each window of 13 words, and the words that later documents' windows cover.
_OP7 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS k FROM w, unnest(range(1, len(words) - 11)) AS t(i)
), firsts AS (
  SELECT k, min(doc_id) AS src FROM windows GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, i + j AS pos FROM windows JOIN firsts USING (k), unnest(range(13)) AS t(j) WHERE src < doc_id
), placed AS (
  SELECT doc_id, pos, words[pos] AS word FROM w, unnest(range(1, len(words) + 1)) AS t(pos)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM placed ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""

_OP9 = """
WITH c AS (
  SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INT) AS bits FROM embeddings
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.bits, c.bits), lambda x: (x[1] <> x[2])::INT))::INT AS distance
  FROM c q JOIN c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM d
)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_int8_tile_dedup": _OP1, "op2_b_bit_minhash": _OP2, "op7_de_bruijn_substrings": _OP7, "op9_multi_index_hamming": _OP9}
