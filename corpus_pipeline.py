"""A corpus pipeline of five stages; each reads what the one before it wrote.

Language ID drops documents without a language, the n-gram join keeps one document of
each near-duplicate group, suffix-array dedup cuts passages that stand earlier in the
corpus, mixing repeats and thins documents to the target weights of their sources, and
byte-level BPE encodes what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosecha.llm import bpe, language_id, mixing, ngram_join, suffix_dedup
from cosecha.llm.tables import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle and the Jaccard similarity in percent from which documents are near duplicates.
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80
#: Bytes from which a repeated passage is cut: under fifty words.
PASSAGE_BYTES, PASSAGE_GRAM = 240, 60


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a letter and share an n-gram with some learned language."""
    return language_id.keep_known(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of smallest id, and one of the rows without an id.

    Rows are told apart by id and text: those that share an id but not a text are documents of their own.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row_id"))
    rows = ngram_join.jaccard_rows(keyed, SHINGLE_WORDS, SHINGLE_PERCENT).filter("component is not null")
    best = rows.groupBy("component", F.col("doc_id").isNull().alias("unnamed")).agg(F.min(F.struct("doc_id", "row_id")).alias("best"))
    best = written(best.select("component", "unnamed", F.col("best.row_id").alias("kept")), "representatives")
    beside = (rows["component"] == best["component"]) & (rows["doc_id"].isNull() == best["unnamed"])
    gone = rows.join(best, beside).filter("row_id != kept").select("row_id").distinct()
    return keyed.join(gone, "row_id", "left_anti").dropDuplicates(["doc_id", "row_id"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one, or an earlier place, has; those cut to nothing go."""
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS), PASSAGE_BYTES, gram=PASSAGE_GRAM, whole_characters=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_bytes").cast("string")).otherwise(F.col("text"))
    left = cut.filter((F.col("n_removed") == 0) | (F.length("kept_bytes") > 0)).withColumn("text", text)
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many documents as came, sources weighted by the square root of their counts, in global random order."""
    return mixing.mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, little-endian unsigned 32-bit; decoding gives the text's bytes again."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(docs.select(*COLUMNS), ranks, public_tokenizers.PATTERN)
    exact = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return encoded.select("doc_id", "lang", "source", "n_chars", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", exact.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("byte_level_bpe", encode),
]

#: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
