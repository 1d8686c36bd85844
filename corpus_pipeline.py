"""A corpus pipeline over ``documents``: five stages, each calling one training-data operator.

1. ``language``: documents without a language, in a language that none learned resembles, or
   with no language that holds two fifths of the text, go; a null ``lang`` becomes the predicted one.
2. ``near_duplicates``: one document of each near-duplicate group stays.
3. ``repeated_passages``: words in 20-word windows that occur earlier go; ``n_chars`` follows.
4. ``mix``: documents are repeated to their source's target: whole copies as rows of their
   own, and the one document at a source's edge in part.  What is not taken goes.
5. ``tokens``: BPE encoding and decoding of each row.

A stage works on all rows that its predecessor kept, and all but the last return the
columns of ``documents``.  :func:`run` writes each stage's result to the shared folder.

A text of two languages in equal parts stays: the estimate puts its larger proportion near a
half, on either side, so the floor is two fifths; three or more languages without a larger one go.

Edge cases: texts that are null, empty or without a letter have no language and go in the first
stage, so an empty table, or one of such texts, gives an empty result; a null ``lang`` is filled
in, and a null ``source`` is a source of its own; repeated rows are copies, of which one stays; of
rows with one id the order of the scan decides; texts are read whole, however long.  Columns
besides those of ``documents``, whatever their names, are left out in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, language, mixing, neardup, substrings
from loomgraph.llm.common import WORD, held_out, staged, word_count
from loomgraph.llm.queries import tokenizer_json

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SHARE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names, logp = language.learn(docs, ~held_out(F.col("doc_id"), 4, 2))
    found = language.predict(docs, names, logp, keep=[F.col(c) for c in COLUMNS])
    kept = found.where(F.col("lang_known") & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = neardup.classes(docs).where(~F.col("keep")).select(F.col("rid").alias("_rid"))
    rows = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_rid"))
    return rows.join(gone.hint("merge"), "_rid", "left_anti").select(*COLUMNS)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(docs.select(*COLUMNS), layout=True)
    return left.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs.select(*COLUMNS), word_count(F.col("text"))).where("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = (F.col("taken") % F.col("size")).cast("int")
    times = F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = mixed.select("row.*", F.explode(times).alias("_words"))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("_words")), " ")
    cut = rows.withColumn("text", F.when(F.col("_words") > 0, part).otherwise(F.col("text")))
    return cut.withColumn("n_chars", F.when(F.col("_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, tokenizer_json(), digests=True)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("mix", mix_sources),
    ("tokens", encode),
]

#: Mixture inference and near-duplicate groups can't be told in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
