"""The driver's tables seen as items, observations, stance edges and reply edges.

A document with an event of its number is an item: the event gives time, type and, for
the ten largest property values, a media key.  Stance edges come from the labels:
toxic is negative, quality is positive, else neutral.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import normalize_text, text_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("published_at"), "event_type", "value", "props")
    normalized = normalize_text(F.col("text"))
    media = F.when(F.get_json_object("props", "$.k").try_cast("int") >= 90, F.sha2("props", 256))
    return docs.join(events, "doc_id").select(
        F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("item_id"),
        "doc_id",
        F.col("event_type").alias("source_type"),
        F.col("source").alias("author_native_id"),
        "published_at",
        "text",
        "lang",
        normalized.alias("text_normalized"),
        text_hash(normalized).alias("text_hash"),
        media.alias("media_hash"),
        "value",
    )


def stance_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    polarity = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return items(spark, sf_dir).join(labels, "doc_id").select("item_id", F.col("lang").alias("entity_id"), polarity.alias("polarity"), F.least(F.lit(1.0), F.col("value") / 500).alias("strength"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("node_item_id"), F.col("ts").cast("timestamp").alias("observed_at"), F.col("event_id").alias("view_count"), F.round(F.col("value")).cast("long").alias("subscriber_or_follower_count"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as messages: ``conv:turn``, each replying to the turn before it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    native = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    return rows.select(native(F.col("turn")).alias("source_native_id"), F.when(F.col("turn") > 0, native(F.col("turn") - 1)).alias("reply_to"), "role", "text")
