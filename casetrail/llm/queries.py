"""One query per text operator over the provided tables, with reference SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casetrail.llm.decontamination import contamination

    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casetrail.llm.pii import personal_data

    return personal_data(read_table(spark, sf_dir, "documents")).drop("found")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casetrail.llm.mixing import mix_sources

    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).cast("string").alias("shards"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casetrail.llm.quality import quality_verdicts

    return quality_verdicts(read_table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casetrail.llm.language_model import score_texts

    return score_texts(read_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casetrail.llm.tokens import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casetrail.llm.neardup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("first", "text_hash")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casetrail.llm.windows import remove_repeated_windows

    return remove_repeated_windows(read_table(spark, sf_dir, "documents"), texts=False).drop("kept_text")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casetrail.llm.sharding import shard_by_size

    return shard_by_size(read_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casetrail.llm.suffixes import remove_repeated_strings

    return remove_repeated_strings(read_table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document's tokens."""
    from casetrail.llm.packing import pack_texts

    return pack_texts(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    from casetrail.llm.phrases import collocations

    return collocations(read_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 50; each seventh row has the next label."""
    from casetrail.llm.negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_decontamination, op2_pii_disclosure, op3_mix_sources, op4_quality_rules, op5_lm_scoring, op6_token_counts, op7_minhash_near_dedup, op8_substring_dedup, op9_sharding, op10_suffix_dedup, op11_best_fit_packing, op12_collocations, op13_hard_negatives)
}
_COLLOCATIONS = """
WITH pieces AS (
  SELECT doc_id, lang, p.n AS piece, p.piece AS body FROM (
    SELECT row_number() OVER () AS doc_id, coalesce(lang, 'und') AS lang,
      string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents
  ), LATERAL (SELECT unnest(pieces) AS piece, unnest(range(len(pieces))) AS n) p
), words AS (
  SELECT doc_id, lang, piece, w.n AS place, w.word FROM (SELECT doc_id, lang, piece, list_filter(string_split_regex(body, '[ \\t]+'), lambda x: x <> '') AS ws FROM pieces),
    LATERAL (SELECT unnest(ws) AS word, unnest(range(len(ws))) AS n) w
), near AS (
  SELECT lang, word AS w1, lead(word, 1) OVER along AS w2, lead(word, 2) OVER along AS w3 FROM words WINDOW along AS (PARTITION BY doc_id, piece ORDER BY place)
), f AS (
  SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM near GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM near WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM near WHERE w3 IS NOT NULL GROUP BY ALL
), totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang
), found AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT lang, phrase, a, w, 1 AS cut, w[1] AS head, array_to_string(w[2:], ' ') AS rest FROM found
  UNION ALL SELECT lang, phrase, a, w, 2, array_to_string(w[1:2], ' '), w[3] FROM found WHERE k = 3
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS m FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM found WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM found WHERE k = 3
  ) GROUP BY ALL
), ranked AS (
  SELECT v.lang, row_number() OVER (PARTITION BY v.lang ORDER BY v.score DESC, v.a DESC, v.phrase) AS rank, v.phrase, v.a, v.l, v.r, t.n, v.score
  FROM worst v LEFT JOIN longer g ON g.lang = v.lang AND g.phrase = v.phrase JOIN totals t ON t.lang = v.lang
  WHERE g.m IS NULL OR 100 * g.m < 50 * v.a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

_HARD_NEGATIVES = """
WITH vecs AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, id, score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 3
"""

ORACLES: dict[str, str] = {"op12_collocations": _COLLOCATIONS, "op13_hard_negatives": _HARD_NEGATIVES}
