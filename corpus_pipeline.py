"""Corpus preparation: quality rules, near-duplicate removal, decontamination, mixing and sharding.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of ``documents``; nulls, repeated rows and empty tables are treated as the stage's operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casetrail.llm.common import cut, read_table, words_of
from casetrail.llm.decontamination import contaminated_regions
from casetrail.llm.mixing import mix_sources
from casetrail.llm.neardup import near_duplicates
from casetrail.llm.quality import quality_verdicts
from casetrail.llm.sharding import shard_by_size

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the limits of their language and source."""
    # Rows equal in all that is judged have one verdict.
    judged = [F.col(c) for c in ("doc_id", "text", "lang", "source")]
    keyed = docs.select(*COLUMNS, F.struct(F.xxhash64(*judged).alias("a"), F.xxhash64(F.lit(1), *judged).alias("b")).alias("row_key"))
    kept = quality_verdicts(keyed, id_col="row_key").where("kept").select("row_key")
    return keyed.join(kept, "row_key", "left_semi").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id. Rows equal in id and text are one group's repeats."""
    first = near_duplicates(docs).where("first").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "n_shingles").distinct()
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("__own"))
    kept = keyed.join(first, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")))
    repeat = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy("lang", "source", "n_chars"))
    return kept.withColumn("__repeat", repeat).where((F.col("__repeat") == 1) | (F.col("n_shingles") == 0)).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a region of a benchmark item."""
    found = contaminated_regions(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))
    return found.where(F.size("regions") == 0).select(*[F.col("kept")[c].alias(c) for c in COLUMNS])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes it; where it takes only a part, the leading words."""
    mixed = mix_sources(docs, keep=COLUMNS)
    taken = mixed.select("kept", "size", F.explode("draws").alias("draw")).select("kept", "size", "draw.words")
    part = F.array_join(F.slice(words_of(F.col("kept.text")), 1, F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), part).otherwise(F.col("kept.text"))
    columns = {c: F.col("kept")[c] for c in COLUMNS} | {"text": text}
    columns["n_chars"] = F.when(F.col("words") < F.col("size"), F.char_length(part).cast("long")).otherwise(F.col("kept.n_chars"))
    return taken.select(*[columns[c].alias(c) for c in COLUMNS])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return shard_by_size(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicate removal", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("sharding", shard),
]
#: Near duplicates are found by hashing and mixing orders rows by hash, which SQL cannot restate; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is materialised in the shared checkpoint folder."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
