"""Stance rolled up by narrative and by author.

An author's consistency and the synchrony of different authors stay apart: no column here
combines them, and none is a verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def signed_strength() -> Column:
    return F.when(F.col("polarity") == "positive", F.col("strength")).when(F.col("polarity") == "negative", -F.col("strength")).otherwise(F.lit(0.0))


def polarity_counts() -> list[Column]:
    return [F.count_if(F.col("polarity") == p).alias(f"{p}_count") for p in ("positive", "negative", "neutral")]


def narrative_stance(members: DataFrame, item_entities: DataFrame, stance: DataFrame) -> DataFrame:
    """Counts by polarity and mean strength of each narrative and entity; rows without a stance yet stay, with a null mean."""
    each = members.join(item_entities.select("item_id", "entity_id").distinct(), "item_id").join(stance, ["item_id", "entity_id"], "left")
    return each.groupBy("narrative_id", "entity_id").agg(*polarity_counts(), F.avg(F.when(F.col("polarity").isNotNull(), F.col("strength"))).alias("mean_strength"))


def _entropy_term(count: Column, volume: Column) -> Column:
    return F.when(count == 0, F.lit(0.0)).otherwise((count / volume) * F.log(count / volume))


def author_profiles(stance: DataFrame, items: DataFrame, members: DataFrame) -> DataFrame:
    """Net stance, consistency, volume, time span and narrative spread of each author and entity."""
    authors = items.where("author_native_id is not null").select("item_id", F.concat_ws(":", "source_type", "author_native_id").alias("author_id"), "published_at")
    edges = stance.join(authors, "item_id")
    base = edges.groupBy("author_id", "entity_id").agg(F.count("*").alias("volume"), *polarity_counts(), F.avg(signed_strength()).alias("net_stance"), F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"))
    spread = edges.join(members, "item_id").groupBy("author_id", "entity_id").agg(F.count_distinct("narrative_id").alias("spread"))
    terms = sum((_entropy_term(F.col(f"{p}_count"), F.col("volume")) for p in ("negative", "neutral")), _entropy_term(F.col("positive_count"), F.col("volume")))
    return base.join(spread, ["author_id", "entity_id"], "left").select(
        "author_id", "entity_id", "net_stance", (1 + terms / F.log(F.lit(3.0))).alias("stance_consistency"), "volume", "positive_count", "negative_count", "neutral_count", "first_seen", "last_seen",
        F.datediff("last_seen", "first_seen").cast("long").alias("time_span_days"), F.coalesce("spread", F.lit(0)).alias("narrative_spread"),
    )


def entity_authors(profiles: DataFrame, limit: int, positive_only: bool = False) -> DataFrame:
    """For each entity and sign of the net stance, the authors by |net| * consistency * ln(volume) * spread."""
    score = F.abs("net_stance") * F.col("stance_consistency") * F.log("volume") * F.col("narrative_spread")
    rows = profiles.where("volume > 0 and net_stance <> 0").withColumn("score", score).withColumn("side", F.when(F.col("net_stance") > 0, "positive").otherwise("negative"))
    if positive_only:
        rows = rows.where("score > 0")
    place = Window.partitionBy("entity_id", "side").orderBy(F.desc(F.round("score", 9)), "author_id")
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit)


def author_history(profiles: DataFrame, author_id: str) -> DataFrame:
    return profiles.where(F.col("author_id") == author_id).orderBy(F.desc("volume"), "entity_id")


def first_posters(members: DataFrame, items: DataFrame) -> DataFrame:
    """Order of appearance within a narrative (an extension): place 1 posted first, the others amplify."""
    rows = members.join(items.select("item_id", "author_native_id", "published_at"), "item_id")
    return rows.withColumn("place", F.rank().over(Window.partitionBy("narrative_id").orderBy("published_at")))


def velocity(observations: DataFrame) -> DataFrame:
    """Change of followers a day between a node's observations (an extension)."""
    w = Window.partitionBy("node_item_id").orderBy("observed_at", "view_count")
    days = (F.unix_micros("observed_at") - F.unix_micros(F.lag("observed_at").over(w))) / F.lit(86_400e6)
    change = F.col("subscriber_or_follower_count") - F.lag("subscriber_or_follower_count").over(w)
    return observations.withColumn("change", change).withColumn("per_day", F.when(days > 0, change / days))
