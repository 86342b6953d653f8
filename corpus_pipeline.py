"""Documents to packed training sequences, in five stages.

Each stage is (name, function of spark, docs and sf_dir). Its result is
written as Parquet and read again as the next stage's docs; all but the last
keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.base import Scratch, table, tokenizer_path
from ledgerweave.llm.line_dedup import kept_text, line_dedup
from ledgerweave.llm.minhash import one_of_each
from ledgerweave.llm.mixing import mix_sources
from ledgerweave.llm.packing import pack_tokens
from ledgerweave.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5.

    Null and empty texts have the score of an empty text; repeated rows are
    judged alike; ties at 0.5 go; an empty table gives none.
    """
    scored = toxicity(docs, table(spark, sf_dir, "labels"), keep=COLUMNS[1:])
    return scored.filter("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has, equal or within two edits.

    A null text stays null, an empty one empty; n_chars follows the text.
    Null ids come last; rows with the same id and text are one document, so
    they lose the same lines; an empty table gives none.
    """
    found = line_dedup(docs).withColumn("text", kept_text("text"))
    return found.withColumn("n_chars", F.when(F.size("__removed") == 0, F.col("n_chars")).otherwise(F.char_length("text"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, similarity 0.8.

    The smallest id stays, of repeated ids one row; documents without a word,
    null texts among them, are in no group and all stay; an empty table gives
    none.
    """
    return one_of_each(docs.select(*COLUMNS), size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number of times (halves up).

    Documents without words are not taken. Rows alike in id and text are
    taken equally often, by what the mix takes of them together. An empty
    table gives none.
    """
    mixed = mix_sources(docs, text_key="__key").groupBy("doc_id", "__key").agg(F.sum("size").alias("__size"), F.sum("taken").alias("__taken"))
    mixed = mixed.filter("__size > 0").select(F.col("doc_id").alias("__id"), "__key", F.floor(F.col("__taken") / F.col("__size") + 0.5).cast("int").alias("__times")).filter("__times > 0")
    taken = docs.withColumn("__own", F.xxhash64("text")).join(mixed.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")))
    return taken.withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of at most 4096 tokens.

    A null or empty text is its end mark alone; repeated rows are documents
    of their own; an empty table gives none.
    """
    return pack_tokens(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("near-duplicates", drop_near_duplicates), ("mixing", mix), ("packing", pack)]

#: SQL cannot express these stages; a brute-force version tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), str(i))
        if i:
            scratch.drop(str(i - 1))
    return STAGES[-1][1](spark, docs, sf_dir)
