"""Source records (messages, channels, videos) to items, observations and collected edges.

Records come as columns, so a mapping is one projection; references between records are joins,
and what they don't find stays an external reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import records as R
from loomgraph.functions.text import entities


def item_id(source: Column | str, native_id: Column) -> Column:
    """Ids are content hashes of the source and its own id, so a record collected twice has one id."""
    return F.sha2(F.concat_ws(":", F.lit(source) if isinstance(source, str) else source, native_id), 256)


def _text(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def message_items(messages: DataFrame) -> DataFrame:
    """``messages``: channel_id, message_id, channel_title, channel_username, text, date, edit_date, from_user_id,
    from_channel_id, views, forwards, replies, reactions, media, spans, scheduled."""
    native = F.concat_ws(":", F.col("channel_id").cast("string"), F.col("message_id").cast("string"))
    own = F.struct("message_id", "channel_id", "channel_username", F.col("edit_date").isNotNull().alias("is_edited"), F.coalesce("scheduled", F.lit(False)).alias("has_scheduled_flag"))
    return messages.select(
        item_id("telegram", native).alias("item_id"),
        F.lit("telegram").alias("source_type"),
        native.alias("source_native_id"),
        item_id("channel", F.col("channel_id").cast("string")).alias("parent_item_id"),
        _text("text").alias("text"),
        F.col("date").alias("published_at"),
        F.col("edit_date").alias("edited_at"),
        F.coalesce("from_user_id", "from_channel_id", "channel_id").cast("string").alias("author_native_id"),
        F.col("channel_title").alias("author_display_name"),
        R.engagement(F.col("views"), F.col("forwards"), F.col("replies"), F.col("reactions")).alias("engagement"),
        R.media_descriptors(F.col("media")).alias("media"),
        R.message_entities(F.col("spans")).alias("entities"),
        own.alias("source_specific"),
    )


def channel_items(channels: DataFrame) -> DataFrame:
    """``channels``: channel_id, username, title, about, broadcast, megagroup, linked_chat_id, first_message, oldest_message.

    The source tells no creation date: the estimate has its own key, and account_created_at stays null.
    """
    native = F.col("channel_id").cast("string")
    guess = R.created_estimate(F.col("first_message"), F.col("oldest_message"))
    own = F.struct(F.col("username").alias("channel_username"), R.channel_type(F.col("broadcast"), F.col("megagroup")).alias("channel_type"), (F.length(F.coalesce("username", F.lit(""))) > 0).alias("is_public"), "linked_chat_id", guess["date"].alias("estimated_creation_from_earliest_msg"), guess["confidence"].alias("estimated_creation_confidence"))
    return channels.select(item_id("channel", native).alias("item_id"), F.lit("channel").alias("source_type"), native.alias("source_native_id"), _text("about").alias("text"), F.coalesce(_text("username"), native).alias("author_native_id"), F.col("title").alias("author_display_name"), F.lit(None).cast("timestamp").alias("account_created_at"), own.alias("source_specific"))


def channel_observations(channels: DataFrame, run_id: str, observed_at: Column) -> DataFrame:
    """``channels``: channel_id, participants, verified, post_count_seen."""
    return channels.select(item_id("channel", F.col("channel_id").cast("string")).alias("node_item_id"), observed_at.alias("observed_at"), F.col("participants").cast("long").alias("subscriber_or_follower_count"), F.lit(None).cast("long").alias("view_count"), F.col("post_count_seen").cast("long").alias("post_count_seen"), F.coalesce("verified", F.lit(False)).alias("verified_status"), F.lit(run_id).alias("collection_run_id"))


def _at(path: str) -> Column:
    return F.get_json_object("resource", f"$.{path}")


def video_items(videos: DataFrame) -> DataFrame:
    """``videos``: resource, a video as JSON text with snippet, statistics and contentDetails."""
    count = lambda k: _at(f"statistics.{k}Count").try_cast("long").alias(f"{k}_count")
    thumbnails = F.create_map(*[x for s in R.THUMBNAILS for x in (F.lit(s), _at(f"snippet.thumbnails.{s}.url"))])
    own = F.struct(
        _at("id").alias("video_id"),
        _at("snippet.channelId").alias("channel_id"),
        F.coalesce(F.from_json(_at("snippet.tags"), "array<string>"), F.array().cast("array<string>")).alias("tags"),
        R.duration_seconds(_at("contentDetails.duration")).alias("duration_seconds"),
        (F.coalesce(_at("snippet.liveBroadcastContent"), F.lit("none")) != "none").alias("is_live_broadcast"),
        R.best_thumbnail(thumbnails).alias("thumbnail_url"),
    )
    return videos.select(
        item_id("youtube_video", _at("id")).alias("item_id"),
        F.lit("youtube_video").alias("source_type"),
        _at("id").alias("source_native_id"),
        item_id("channel", _at("snippet.channelId")).alias("parent_item_id"),
        R.title_text(_at("snippet.title"), _at("snippet.description")).alias("text"),
        R.declared_language(_at("snippet.defaultLanguage"), _at("snippet.defaultAudioLanguage")).alias("language_declared"),
        R.parse_time(_at("snippet.publishedAt")).alias("published_at"),
        _at("snippet.channelId").alias("author_native_id"),
        _at("snippet.channelTitle").alias("author_display_name"),
        F.struct(*[count(k) for k in ("view", "like", "comment", "favorite")]).alias("engagement"),
        entities(_at("snippet.description")).alias("entities"),
        own.alias("source_specific"),
    )


def video_channel_items(channels: DataFrame) -> DataFrame:
    """``channels``: resource, a channel as JSON text; this source declares the creation date."""
    own = F.struct(_at("snippet.customUrl").alias("channel_custom_url"), _at("snippet.country").alias("channel_country_declared"))
    return channels.select(item_id("channel", _at("id")).alias("item_id"), F.lit("channel").alias("source_type"), _at("id").alias("source_native_id"), F.nullif(_at("snippet.description"), F.lit("")).alias("text"), F.coalesce(F.nullif(_at("snippet.customUrl"), F.lit("")), _at("id")).alias("author_native_id"), _at("snippet.title").alias("author_display_name"), R.parse_time(_at("snippet.publishedAt")).alias("account_created_at"), own.alias("source_specific"))


def video_channel_observations(channels: DataFrame, run_id: str, observed_at: Column) -> DataFrame:
    """Hidden subscribers are null; the source tells nothing about verification."""
    count = lambda k: _at(f"statistics.{k}").try_cast("long")
    hidden = _at("statistics.hiddenSubscriberCount") == "true"
    return channels.select(item_id("channel", _at("id")).alias("node_item_id"), observed_at.alias("observed_at"), R.visible_subscribers(count("subscriberCount"), hidden).alias("subscriber_or_follower_count"), count("viewCount").alias("view_count"), count("videoCount").alias("post_count_seen"), F.lit(None).cast("boolean").alias("verified_status"), F.lit(run_id).alias("collection_run_id"))


def _edges(rows: DataFrame, kind: str, evidence: Column) -> DataFrame:
    return rows.select("src_item_id", "dst_item_id", F.when(F.col("dst_item_id").isNull(), F.col("ref")).alias("dst_external_ref"), F.lit(kind).alias("edge_type"), F.lit(True).alias("directed"), F.lit("collected").alias("origin"), F.to_json(evidence, {"ignoreNullFields": "false"}).alias("evidence"))


def forward_edges(messages: DataFrame, items: DataFrame) -> DataFrame:
    """``messages``: src_item_id, date, origin_channel, origin_message, origin_name, origin_date (null origin fields: not told)."""
    told = F.col("origin_channel").isNotNull() & F.col("origin_message").isNotNull()
    rows = messages.withColumn("native", F.when(told, F.concat_ws(":", F.col("origin_channel").cast("string"), F.col("origin_message").cast("string"))))
    known = items.select(F.col("source_native_id").alias("native"), F.col("item_id").alias("dst_item_id"))
    joined = rows.join(known, "native", "left").withColumn("ref", F.when(told, F.concat(F.lit("telegram:"), "native")).otherwise(F.coalesce("origin_name", F.lit("telegram:unresolved"))))
    return _edges(joined, "forward", F.struct(F.col("origin_channel").alias("origin_channel_id"), F.col("origin_message").alias("origin_msg_id"), F.col("origin_date").alias("origin_timestamp"), R.forward_latency(F.col("date"), F.col("origin_date")).alias("forward_latency_seconds")))


def mention_edges(items: DataFrame) -> DataFrame:
    """An edge to each mention that an item's entities name; handles aren't looked up."""
    rows = items.select(F.col("item_id").alias("src_item_id"), F.explode("entities.mentions").alias("ref")).withColumn("dst_item_id", F.lit(None).cast("string"))
    return _edges(rows, "mention", F.struct(F.col("ref").alias("mention_text")))


def description_link_edges(items: DataFrame, known: DataFrame) -> DataFrame:
    """An edge to each link of an item's entities: to a collected video or channel whose id the link bears, else external.

    ``known``: item_id, source_type, source_native_id.
    """
    rows = items.select(F.col("item_id").alias("src_item_id"), F.explode("entities.urls").alias("ref"))
    rows = rows.withColumn("video", R.video_id(F.col("ref"))).withColumn("kind", F.when(F.col("video").isNotNull(), "youtube_video").otherwise("channel")).withColumn("native", F.coalesce("video", R.channel_id(F.col("ref"))))
    found = known.select(F.col("source_type").alias("kind"), F.col("source_native_id").alias("native"), F.col("item_id").alias("dst_item_id"))
    return _edges(rows.join(found, ["kind", "native"], "left"), "mention", F.struct(F.col("ref").alias("description_url")))
