"""Registered queries of record mapping, collected edges, seeds, merging, reports and providers, with their SQL.

Conversations stand for channels of messages, parts for videos and their makers' sizes for channels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import records
from loomgraph.functions import text as T
from loomgraph.operators import graph
from loomgraph.operators import items as I
from loomgraph.operators import resolution as R
from loomgraph.plans.registry import register, rounded
from loomgraph.plans.sql import ITEMS, query
from loomgraph.session import scratch
from loomgraph.sources import adapter, mapping, providers, readers, writers

_NTZ = "timestamp_ntz"
_SENT = "TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 60)"
_SPANS = "array<struct<kind:string,text:string,url:string>>"


def _messages(spark, sf_dir) -> DataFrame:
    talk = adapter.table(spark, sf_dir, "conversations")
    turn, conv = F.col("turn"), F.col("conv_id")
    sent = F.timestamp_seconds(F.lit(1704067200) + conv * 3600 + turn * 60)
    span = lambda kind, text, url=None: F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(url).cast("string").alias("url"))
    kind = F.when(turn % 4 == 1, "photo").when(turn % 4 == 2, "document").when(turn % 4 == 3, "MessageMediaPoll")
    mime = F.when(turn % 8 == 2, "video/mp4").when(turn % 8 == 6, "text/plain")
    return talk.select(
        conv.alias("channel_id"),
        turn.alias("message_id"),
        F.concat(F.lit("c"), conv.cast("string")).alias("channel_title"),
        F.when(conv % 3 > 0, F.concat(F.lit("chan"), conv.cast("string"))).alias("channel_username"),
        "text",
        sent.alias("date"),
        F.when(turn % 4 == 0, sent + F.expr("INTERVAL 30 SECONDS")).alias("edit_date"),
        F.when(turn % 2 == 0, conv * 10 + turn).alias("from_user_id"),
        F.when(turn % 3 == 1, conv + 1000).alias("from_channel_id"),
        F.length("text").alias("views"),
        turn.alias("forwards"),
        F.when(turn % 5 > 0, turn + 1).alias("replies"),
        F.when(turn % 2 == 1, F.array(*[F.struct(F.lit(n).alias("name"), c.alias("count")) for n, c in (("+", turn), ("x", F.lit(1).cast("long")), ("+", turn + 1))])).alias("reactions"),
        F.when(kind.isNotNull(), F.struct(kind.alias("kind"), mime.alias("mime_type"), conv.cast("string").alias("ref"))).alias("media"),
        F.array(span("mention", F.concat(F.lit("@a"), conv.cast("string"))), span("hashtag", F.lit("#t")), span("url", F.lit("http://x")), span("text_url", F.lit("here"), "http://y"), span("bold", F.lit("b"))).cast(_SPANS).alias("spans"),
        (turn % 6 == 0).alias("scheduled"),
    )


@register("f33_message_items", f"""SELECT sha256('telegram:' || conv_id || ':' || turn) AS item_id, conv_id || ':' || turn AS source_native_id, sha256('channel:' || conv_id) AS parent_item_id, nullif(text, '') AS text,
  {_SENT} AS published_at, CASE WHEN turn % 4 = 0 THEN {_SENT} + INTERVAL 30 SECONDS END AS edited_at,
  (CASE WHEN turn % 2 = 0 THEN conv_id * 10 + turn WHEN turn % 3 = 1 THEN conv_id + 1000 ELSE conv_id END)::VARCHAR AS author_native_id, 'c' || conv_id AS author_display_name, turn % 4 = 0 AS is_edited, turn % 6 = 0 AS has_scheduled_flag FROM conversations""")
def f33_messages(spark, sf_dir):
    rows = mapping.message_items(_messages(spark, sf_dir))
    return rows.select("item_id", "source_native_id", "parent_item_id", "text", F.col("published_at").cast(_NTZ).alias("published_at"), F.col("edited_at").cast(_NTZ).alias("edited_at"), "author_native_id", "author_display_name", "source_specific.is_edited", "source_specific.has_scheduled_flag")


@register("f9_message_entities", "SELECT conv_id || ':' || turn AS source_native_id, 'http://x http://y' AS urls, '#t' AS hashtags, '@a' || conv_id AS mentions, 'a' || conv_id AS handles FROM conversations")
def f9(spark, sf_dir):
    rows = mapping.message_items(_messages(spark, sf_dir))
    return rows.select("source_native_id", *[F.array_join(f"entities.{c}", " ").alias(c) for c in ("urls", "hashtags", "mentions", "handles")])


@register("f10_media_descriptors", """SELECT conv_id || ':' || turn AS source_native_id, CASE WHEN turn % 4 = 1 THEN 'photo' WHEN turn % 8 = 2 THEN 'video' WHEN turn % 4 = 2 THEN 'document' WHEN turn % 4 = 3 THEN 'MessageMediaPoll' END AS kind,
  CASE WHEN turn % 4 IN (1, 2) THEN conv_id::VARCHAR END AS source_ref, CASE WHEN turn % 8 = 2 THEN 'video/mp4' WHEN turn % 8 = 6 THEN 'text/plain' END AS mime_type FROM conversations""")
def f10(spark, sf_dir):
    rows = mapping.message_items(_messages(spark, sf_dir)).select("source_native_id", F.get("media", F.lit(0)).alias("m"))
    return rows.select("source_native_id", F.col("m.type").alias("kind"), "m.source_ref", "m.mime_type")


@register("f11_engagement", """SELECT conv_id || ':' || turn AS source_native_id, length(text)::BIGINT AS view_count, turn::BIGINT AS forward_count, CASE WHEN turn % 5 > 0 THEN turn + 1 END::BIGINT AS reply_count,
  CASE WHEN turn % 2 = 1 THEN turn + 1 END::BIGINT AS plus, CASE WHEN turn % 2 = 1 THEN 2 ELSE 0 END::BIGINT AS n_reactions FROM conversations""")
def f11(spark, sf_dir):
    rows = mapping.message_items(_messages(spark, sf_dir))
    found = F.col("engagement.reactions")
    return rows.select("source_native_id", *[f"engagement.{c}" for c in ("view_count", "forward_count", "reply_count")], F.try_element_at(found, F.lit("+")).alias("plus"), F.size(found).cast("long").alias("n_reactions"))


def _channels(spark, sf_dir) -> DataFrame:
    n = F.col("n_nationkey")
    first, oldest = F.timestamp_seconds(n * 86400), F.timestamp_seconds(n * 86400 + 60)
    return adapter.table(spark, sf_dir, "nation").select(
        n.alias("channel_id"), F.when(n % 4 > 0, F.lower("n_name")).alias("username"), F.col("n_name").alias("title"), F.when(n % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("about "), "n_name")).alias("about"),
        (n % 3 == 0).alias("broadcast"), (n % 3 == 1).alias("megagroup"), F.lit(None).cast("long").alias("linked_chat_id"),
        F.when(n % 3 == 0, first).alias("first_message"), F.when(n % 3 < 2, oldest).alias("oldest_message"), F.when(n % 6 > 0, n * 100).alias("participants"), F.when(n % 2 == 0, n % 4 == 0).alias("verified"), (n + 7).alias("post_count_seen"),
    )


@register("f33_channel_items", """SELECT n_nationkey::VARCHAR AS source_native_id, CASE WHEN n_nationkey % 5 > 0 THEN 'about ' || n_name END AS text, CASE WHEN n_nationkey % 4 > 0 THEN lower(n_name) ELSE n_nationkey::VARCHAR END AS author_native_id,
  n_name AS author_display_name, CASE n_nationkey % 3 WHEN 0 THEN 'broadcast' WHEN 1 THEN 'megagroup' ELSE 'group' END AS channel_type, n_nationkey % 4 > 0 AS is_public FROM nation""")
def f33_channels(spark, sf_dir):
    return mapping.channel_items(_channels(spark, sf_dir)).select("source_native_id", "text", "author_native_id", "author_display_name", "source_specific.channel_type", "source_specific.is_public")


@register("f35_creation_estimate", """SELECT n_nationkey::VARCHAR AS source_native_id, CASE n_nationkey % 3 WHEN 0 THEN TIMESTAMP '1970-01-01' + to_days(n_nationkey::INT) WHEN 1 THEN TIMESTAMP '1970-01-01' + to_days(n_nationkey::INT) + INTERVAL 1 MINUTE END AS estimate,
  CASE n_nationkey % 3 WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM nation""")
def f35(spark, sf_dir):
    own = mapping.channel_items(_channels(spark, sf_dir)).select("source_native_id", "source_specific.*")
    return own.select("source_native_id", F.col("estimated_creation_from_earliest_msg").cast(_NTZ).alias("estimate"), F.col("estimated_creation_confidence").cast("double").alias("confidence"))


@register("f34_channel_observations", "SELECT sha256('channel:' || n_nationkey) AS node_item_id, CASE WHEN n_nationkey % 6 > 0 THEN n_nationkey * 100 END::BIGINT AS followers, (n_nationkey + 7)::BIGINT AS post_count_seen, n_nationkey % 4 = 0 AS verified_status FROM nation")
def f34(spark, sf_dir):
    rows = mapping.channel_observations(_channels(spark, sf_dir), "run", F.lit("2024-01-01").cast("timestamp"))
    return rows.select("node_item_id", F.col("subscriber_or_follower_count").alias("followers"), "post_count_seen", "verified_status")


def _videos(spark, sf_dir) -> DataFrame:
    k, key, size = F.col("p_partkey"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    nothing = F.lit(None).cast("string")
    url = lambda c: F.struct(c.alias("url"))
    about = F.concat(F.lit("by @maker"), size, F.lit(" https://www.youtube.com/watch?v=video-"), (k + 1).cast("string"), F.lit("&t=3 and https://youtube.com/channel/chan_"), size, F.lit(" http://example.org/"), key)
    snippet = F.struct(
        F.concat(F.lit("chan_"), size).alias("channelId"), F.col("p_brand").alias("channelTitle"), F.col("p_name").alias("title"), about.alias("description"), F.lit("2024-02-03T04:05:06Z").alias("publishedAt"),
        F.when(k % 3 == 0, "en").alias("defaultLanguage"), F.when(k % 2 == 0, "fr").alias("defaultAudioLanguage"), F.when(k % 4 == 0, "live").when(k % 4 == 1, "none").alias("liveBroadcastContent"),
        F.struct(url(F.when(k % 2 == 0, F.concat(F.lit("m"), key)).otherwise(F.lit(""))).alias("maxres"), url(F.when(k % 3 == 0, F.concat(F.lit("h"), key))).alias("high"), url(F.when(k % 5 > 0, F.concat(F.lit("d"), key)).otherwise(nothing)).alias("default")).alias("thumbnails"),
    )
    numbers = F.struct((k * 3).cast("string").alias("viewCount"), F.when(k % 2 == 0, key).alias("likeCount"), F.when(k % 7 == 0, F.lit("many")).otherwise(key).alias("commentCount"))
    return adapter.table(spark, sf_dir, "part").select(F.to_json(F.struct(F.concat(F.lit("video-"), key).alias("id"), snippet.alias("snippet"), numbers.alias("statistics"), F.struct(F.concat(F.lit("PT"), (k % 60).cast("string"), F.lit("M5S")).alias("duration")).alias("contentDetails"))).alias("resource"))


@register("f33_video_items", """SELECT 'video-' || p_partkey AS source_native_id, p_name || chr(10) || chr(10) || 'by @maker' || p_size || ' https://www.youtube.com/watch?v=video-' || (p_partkey + 1) || '&t=3 and https://youtube.com/channel/chan_' || p_size || ' http://example.org/' || p_partkey AS text,
  CASE WHEN p_partkey % 3 = 0 THEN 'en' WHEN p_partkey % 2 = 0 THEN 'fr' END AS language_declared, TIMESTAMP '2024-02-03 04:05:06' AS published_at, 'chan_' || p_size AS author_native_id,
  (p_partkey * 3)::BIGINT AS view_count, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END::BIGINT AS like_count, CASE WHEN p_partkey % 7 > 0 THEN p_partkey END::BIGINT AS comment_count, p_partkey % 4 = 0 AS is_live_broadcast, (p_partkey % 60 * 60 + 5)::BIGINT AS duration_seconds FROM part""")
def f33_videos(spark, sf_dir):
    rows = mapping.video_items(_videos(spark, sf_dir))
    return rows.select("source_native_id", "text", "language_declared", F.col("published_at").cast(_NTZ).alias("published_at"), "author_native_id", *[f"engagement.{c}" for c in ("view_count", "like_count", "comment_count")], "source_specific.is_live_broadcast", "source_specific.duration_seconds")


@register("f13_best_thumbnail", "SELECT 'video-' || p_partkey AS source_native_id, CASE WHEN p_partkey % 2 = 0 THEN 'm' || p_partkey WHEN p_partkey % 3 = 0 THEN 'h' || p_partkey WHEN p_partkey % 5 > 0 THEN 'd' || p_partkey END AS thumbnail_url FROM part")
def f13(spark, sf_dir):
    return mapping.video_items(_videos(spark, sf_dir)).select("source_native_id", "source_specific.thumbnail_url")


@register("f34_video_channel_observations", "SELECT sha256('channel:chan_' || s_suppkey) AS node_item_id, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey * 10 END::BIGINT AS followers, s_suppkey::BIGINT AS view_count, CASE WHEN s_suppkey % 2 = 0 THEN 4 END::BIGINT AS post_count_seen, NULL::BOOLEAN AS verified_status FROM supplier")
def f34_videos(spark, sf_dir):
    k = F.col("s_suppkey")
    numbers = F.struct((k * 10).cast("string").alias("subscriberCount"), k.cast("string").alias("viewCount"), F.when(k % 2 == 0, "4").otherwise("four").alias("videoCount"), F.when(k % 3 == 0, F.lit(True)).alias("hiddenSubscriberCount"))
    rows = adapter.table(spark, sf_dir, "supplier").select(F.to_json(F.struct(F.concat(F.lit("chan_"), k.cast("string")).alias("id"), numbers.alias("statistics"))).alias("resource"))
    found = mapping.video_channel_observations(rows, "run", F.lit("2024-01-01").cast("timestamp"))
    return found.select("node_item_id", F.col("subscriber_or_follower_count").alias("followers"), "view_count", "post_count_seen", "verified_status")


@register("g4_mention_edges", "SELECT sha256('telegram:' || conv_id || ':' || turn) AS src_item_id, '@a' || conv_id AS dst_external_ref, '@a' || conv_id AS mention_text FROM conversations")
def g4_mentions(spark, sf_dir):
    rows = mapping.mention_edges(mapping.message_items(_messages(spark, sf_dir)))
    return rows.select("src_item_id", "dst_external_ref", F.get_json_object("evidence", "$.mention_text").alias("mention_text"))


_LINKS = """linked AS (SELECT p_partkey AS k, p_size, sha256('youtube_video:video-' || p_partkey) AS src_item_id FROM part)
SELECT l.src_item_id, sha256('youtube_video:video-' || n.p_partkey) AS dst_item_id, CASE WHEN n.p_partkey IS NULL THEN 'https://www.youtube.com/watch?v=video-' || (l.k + 1) || '&t=3' END AS dst_external_ref FROM linked l LEFT JOIN part n ON n.p_partkey = l.k + 1
UNION ALL SELECT src_item_id, CASE WHEN p_size % 2 = 0 THEN sha256('channel:chan_' || p_size) END, CASE WHEN p_size % 2 > 0 THEN 'https://youtube.com/channel/chan_' || p_size END FROM linked
UNION ALL SELECT src_item_id, NULL, 'http://example.org/' || k FROM linked"""


@register("g4_description_links", "WITH " + _LINKS)
def g4_links(spark, sf_dir):
    videos = mapping.video_items(_videos(spark, sf_dir))
    sizes = adapter.table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.concat(F.lit("chan_"), F.col("p_size").cast("string")).alias("source_native_id")).distinct()
    channels = sizes.select(mapping.item_id("channel", F.col("source_native_id")).alias("item_id"), F.lit("channel").alias("source_type"), "source_native_id")
    known = videos.select("item_id", "source_type", "source_native_id").unionByName(channels)
    return mapping.description_link_edges(videos, known).select("src_item_id", "dst_item_id", "dst_external_ref")


@register("g4_forward_edges", """SELECT sha256('telegram:' || f.conv_id || ':' || f.turn) AS src_item_id, CASE WHEN o.conv_id IS NOT NULL THEN sha256('telegram:' || o.conv_id || ':' || o.turn) END AS dst_item_id,
  CASE WHEN f.turn % 4 = 0 THEN CASE WHEN f.turn % 8 = 0 THEN 'telegram:unresolved' ELSE 'name' END WHEN o.conv_id IS NULL THEN 'telegram:' || (f.conv_id + 1) || ':' || f.turn END AS dst_external_ref
FROM conversations f LEFT JOIN conversations o ON f.turn % 4 > 0 AND o.conv_id = f.conv_id + 1 AND o.turn = f.turn""")
def g4_forwards(spark, sf_dir):
    return mapping.forward_edges(*_forwards(spark, sf_dir)).select("src_item_id", "dst_item_id", "dst_external_ref")


def _forwards(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    items = mapping.message_items(_messages(spark, sf_dir))
    at = F.split("source_native_id", ":")
    conv, turn = at[0].cast("long"), at[1].cast("long")
    told = turn % 4 > 0
    fields = {"origin_channel": F.when(told, conv + 1), "origin_message": F.when(told, turn), "origin_name": F.when(~told & (turn % 8 > 0), "name"), "origin_date": F.when(turn % 3 > 0, F.col("published_at") - F.expr("INTERVAL 90 SECONDS"))}
    return items.select(F.col("item_id").alias("src_item_id"), F.col("published_at").alias("date"), *[c.cast("timestamp" if n == "origin_date" else "string" if n == "origin_name" else "long").alias(n) for n, c in fields.items()]), items


@register("f19_forward_latency", "SELECT sha256('telegram:' || conv_id || ':' || turn) AS src_item_id, CASE WHEN turn % 3 > 0 THEN 90.0 END::DOUBLE AS seconds FROM conversations")
def f19(spark, sf_dir):
    rows = mapping.forward_edges(*_forwards(spark, sf_dir))
    return rows.select("src_item_id", F.get_json_object("evidence", "$.forward_latency_seconds").cast("double").alias("seconds"))


@register("f29_answers", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'e' || user_id END AS entity_id, CASE WHEN event_id % 3 < 2 THEN CASE WHEN event_id % 2 = 0 THEN 'positive' ELSE 'negative' END END AS polarity, CASE WHEN event_id % 3 < 2 THEN least(1.0::DOUBLE, value / 100) END AS strength FROM events")
def f29(spark, sf_dir):
    """Answers as fenced or bare JSON, each with a good row, one of unknown polarity and one out of range; every third is no array."""
    n = F.col("event_id")
    row = lambda index, polarity: F.to_json(F.struct(F.lit(index).alias("index"), polarity.alias("polarity"), (F.col("value") / 100).alias("strength"), F.lit(0.5).alias("confidence")))
    rows = F.concat(F.lit("["), F.concat_ws(",", row(1, F.when(n % 2 == 0, "Positive").otherwise("NEGATIVE")), row(1, F.lit("odd")), row(3, F.lit("positive"))), F.lit("]"))
    raw = F.when(n % 3 == 0, F.concat(F.lit("```json\n"), rows, F.lit("\n```"))).when(n % 3 == 1, rows).otherwise(F.lit('{"no": "array"'))
    found = adapter.table(spark, sf_dir, "events").select("event_id", records.parse_stances(raw, F.array(F.concat(F.lit("e"), F.col("user_id").cast("string")))).alias("s"))
    return found.select("event_id", F.explode_outer("s").alias("s")).select("event_id", "s.entity_id", "s.polarity", "s.strength")


@register("f36_transcript_blocks", query("SELECT item_id, text_hash, CASE WHEN text_hash IS NULL THEN NULL ELSE text END AS text FROM items WHERE doc_id % 3 = 0 AND text IS NOT NULL", ITEMS))
def f36(spark, sf_dir):
    said = adapter.items(spark, sf_dir).where("doc_id % 3 = 0 and text is not null")
    block = records.transcript_block(F.col("text"), F.lit("en"), F.lit(True), F.lit("fixture"), F.col("published_at"))
    rows = said.select("item_id", block.alias("b"))
    return rows.select("item_id", "b.text_hash", F.when(F.col("b.text_hash").isNotNull(), F.col("b.text")).alias("text"))


# ---- transcripts, payloads, reports ------------------------------------------------------------------------------


@register("s13_transcripts", "SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 3 = 0 THEN 'hi' ELSE 'en' END AS language_code, CASE WHEN conv_id % 5 = 0 THEN 'no_transcript' END AS reason, CASE WHEN conv_id % 5 > 0 THEN 1 - conv_id % 2 END::INT AS is_generated FROM (SELECT DISTINCT conv_id FROM conversations)")
def s13(spark, sf_dir):
    """A provider of fixtures: what it lacks is a reason, never an error; manual captions win, then the order of languages."""
    ids = adapter.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    ids = ids.withColumn("video_id", F.col("conv_id").cast("string"))

    def fetch(video_id: str) -> list[dict]:
        n = int(video_id)
        if n % 5 == 0:
            raise LookupError("no captions")
        made = [{"language_code": "en", "is_generated": n % 2 == 0, "text": f"spoken {n}"}, {"language_code": "xx", "is_generated": False, "text": "?"}]
        return made + ([{"language_code": "hi", "is_generated": n % 2 == 0, "text": f"bola {n}"}] if n % 3 == 0 else [])

    found = providers.transcripts(ids, fetch)
    return found.select(F.col("video_id").cast("long").alias("conv_id"), "language_code", "reason", F.col("is_generated").cast("int").alias("is_generated"))


@register("k4_raw_payloads", "SELECT conv_id || ':' || turn AS ref, sha256(text) AS digest FROM conversations WHERE text IS NOT NULL")
def k4(spark, sf_dir):
    path = scratch(spark, "payloads")
    talk = adapter.table(spark, sf_dir, "conversations").where("text is not null")
    rows = talk.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("ref"), F.to_json(F.struct("text")).alias("payload"))
    writers.write_payloads(rows, path, "run-1")
    back = readers.read_payloads(spark, path, "run-1")
    return back.select("ref", F.sha2(F.get_json_object("payload", "$.text"), 256).alias("digest"))


@register("k6_report", query("SELECT 'items' AS section, source_type AS name, count(*)::BIGINT AS n FROM items GROUP BY ALL UNION ALL SELECT 'languages', lang, count(*) FROM items GROUP BY ALL UNION ALL SELECT * FROM (SELECT 'authors', author_native_id, count(*) AS n FROM items GROUP BY ALL ORDER BY n DESC, 2 LIMIT 5)", ITEMS))
def k6(spark, sf_dir):
    return I.report(adapter.items(spark, sf_dir), {"items": "source_type", "languages": "lang"}, {"authors": ("author_native_id", 5)})


# ---- seeds and loading -------------------------------------------------------------------------------------------


@register("s6_load_all", query("SELECT 'items' AS name, count(*)::BIGINT AS n FROM items WHERE doc_id % 2 = 0 UNION ALL SELECT 'edges', 0 UNION ALL SELECT 'observations', count(*) FROM events", ITEMS))
def s6(spark, sf_dir):
    """A folder is loaded, gets other items, and is loaded again: the tables are those of the second load."""
    base = scratch(spark, "raw")
    items = adapter.items(spark, sf_dir)
    writers.append_observations(adapter.observations(spark, sf_dir), f"{base}/observations")
    found = []
    for part in (1, 0):
        writers.write_items(items.where(F.col("doc_id") % 2 == part), f"{base}/{part}/items")
        found = readers.load_all(spark, f"{base}/{part}", observations=f"{base}/observations")
    counts = [spark.sql(f"SELECT '{name}' AS name, count(*) AS n FROM {name}") for name in ("items", "edges", "observations")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


_SEEDS = "SELECT n_name AS canonical_name, 'country' AS entity_type, 0::BIGINT AS observation_count, CASE WHEN n_nationkey % 3 = 0 THEN 'discovered' ELSE 'seed' END AS created_from, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS n_aliases FROM nation"


@register("s8_seed_entities", _SEEDS)
def s8(spark, sf_dir):
    """Seeds of all nations onto a state that knows every third; loading twice changes nothing."""
    nations = adapter.table(spark, sf_dir, "nation")
    path = scratch(spark, "seeds")
    entry = F.struct(F.initcap("n_name").alias("canonical_name"), F.lit("country").alias("entity_type"), F.array(F.concat(F.lit("the "), "n_name")).alias("aliases"))
    nations.coalesce(1).agg(F.collect_list(entry).alias("entities")).write.json(path)
    seeds = readers.read_seed_entities(spark, path)
    some = nations.where("n_nationkey % 3 = 0")
    name = T.normalize_name(F.col("n_name"))
    entities = some.select(F.concat(F.lit("old:"), name).alias("entity_id"), F.col("n_name").alias("canonical_name"), name.alias("canonical_name_normalized"), F.lit("country").alias("entity_type"), F.lit("discovered").alias("created_from"), F.lit(0).cast("long").alias("observation_count"))
    aliases = some.select(name.alias("surface_form_normalized"), F.col("n_name").alias("surface_form"), F.concat(F.lit("old:"), name).alias("entity_id"))
    for _ in range(2):
        entities, aliases, _ = R.load_seeds(seeds, entities, aliases)
    forms = aliases.groupBy("entity_id").agg(F.count("*").alias("n_aliases"))
    return entities.join(forms, "entity_id").select(F.upper("canonical_name").alias("canonical_name"), "entity_type", "observation_count", "created_from", "n_aliases")


@register("s9_seed_handles", "SELECT lower(n_name) AS handle FROM nation WHERE n_nationkey % 2 = 0")
def s9(spark, sf_dir):
    path = scratch(spark, "handles")
    rows = adapter.table(spark, sf_dir, "nation").select(F.col("n_name").alias("Name"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lower("n_name"), F.lit(" "))).otherwise(F.lit(" ")).alias("Telegram Handle"))
    rows.write.option("header", True).csv(path)
    return readers.seed_handles(spark, explicit=[], csv=path, default=["unused"])


# ---- merging -----------------------------------------------------------------------------------------------------


def _twins(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Each nation twice, the second with an S at its end: entities, aliases, item links, candidate pairs."""
    n = F.col("n_nationkey")
    side = F.explode(F.array(*[F.struct(F.concat(F.lit(p), F.lpad(n.cast("string"), 2, "0")).alias("entity_id"), F.concat("n_name", F.lit(s)).alias("canonical_name"), c.alias("observation_count"), F.lit(o).alias("created_from")) for p, s, c, o in (("a", "", n, "discovered"), ("b", "S", F.lit(10).cast("long"), "seed"))]))
    rows = adapter.table(spark, sf_dir, "nation").select(n.cast("string").alias("entity_type"), side.alias("e")).select("entity_type", "e.*")
    entities = rows.withColumn("canonical_name_normalized", F.lower("canonical_name"))
    aliases = entities.select(F.col("canonical_name_normalized").alias("surface_form_normalized"), F.col("canonical_name").alias("surface_form"), "entity_id")
    links = entities.select(F.lit("i1").alias("item_id"), "entity_id", F.lit("form").alias("surface_form"), F.when(F.startswith("entity_id", F.lit("a")), 0.25).otherwise(0.75).alias("confidence"))
    pairs = R.candidate_pairs(entities.select("entity_id", "entity_type", F.col("canonical_name").alias("name")))
    return entities, aliases, links, pairs


def _adjudicate(row: dict) -> str:
    """A rule in the provider's place: yes for names of an even length, else something that can't be read."""
    return '```json\n{"same_entity": true, "confidence": 0.8}\n```' if len(row["canonical_name"]) % 2 == 0 else "perhaps"


_MERGES = """pairs_of AS (SELECT n_nationkey AS k, 'a' || lpad(n_nationkey::VARCHAR, 2, '0') AS a, 'b' || lpad(n_nationkey::VARCHAR, 2, '0') AS b, n_name, 200.0 * length(n_name) / (2 * length(n_name) + 1) AS ratio FROM nation),
decided AS (SELECT *, ratio >= 93 AS alike, ratio >= 93 OR length(n_name) % 2 = 0 AS same, CASE WHEN k >= 10 THEN a ELSE b END AS keep, CASE WHEN k >= 10 THEN b ELSE a END AS gone FROM pairs_of)"""


@register("e4_merge_decisions", f"WITH {_MERGES} SELECT a || '|' || b AS pair_key, CASE WHEN alike THEN 'auto' ELSE 'adjudicator' END AS method, CASE WHEN same THEN 'merge' ELSE 'reject' END AS decision, round(CASE WHEN alike THEN ratio / 100 WHEN same THEN 0.8 ELSE 0 END, 6)::DOUBLE AS confidence FROM decided")
def e4(spark, sf_dir):
    entities, aliases, _, pairs = _twins(spark, sf_dir)
    return R.merge_decisions(pairs, entities, aliases, _adjudicate).select("pair_key", "method", "decision", rounded("confidence", "confidence"))


@register("e5_survivors", f"WITH {_MERGES} SELECT gone AS entity_id, keep AS survivor FROM decided WHERE same")
def e5(spark, sf_dir):
    entities, aliases, _, pairs = _twins(spark, sf_dir)
    return R.survivors(R.merge_decisions(pairs, entities, aliases, _adjudicate))


@register("e6_merged_state", f"""WITH {_MERGES} SELECT keep AS entity_id, (k + 10)::BIGINT AS observation_count, 'seed' AS created_from, 2::BIGINT AS n_aliases, 1::BIGINT AS n_links, CASE WHEN keep = a THEN 0.25 ELSE 0.75 END::DOUBLE AS confidence FROM decided WHERE same
UNION ALL SELECT a, k, 'discovered', 1, 1, 0.25 FROM decided WHERE NOT same UNION ALL SELECT b, 10, 'seed', 1, 1, 0.75 FROM decided WHERE NOT same""")
def e6(spark, sf_dir):
    entities, aliases, links, pairs = _twins(spark, sf_dir)
    decisions = R.merge_decisions(pairs, entities, aliases, _adjudicate)
    out = R.apply_merges(entities, {"aliases": (aliases, ["surface_form_normalized"]), "links": (links, ["item_id", "entity_id", "surface_form"])}, decisions)
    forms = out["aliases"].groupBy("entity_id").agg(F.count("*").alias("n_aliases"))
    held = out["links"].groupBy("entity_id").agg(F.count("*").alias("n_links"), F.min("confidence").cast("double").alias("confidence"))
    return out["entities"].join(forms, "entity_id").join(held, "entity_id").select("entity_id", "observation_count", "created_from", "n_aliases", "n_links", "confidence")


@register("e6_merge_log", f"WITH {_MERGES} SELECT keep AS survivor_id, CASE WHEN keep = a THEN n_name ELSE n_name || 'S' END AS survivor_name, gone AS merged_id, CASE WHEN keep = a THEN n_name || 'S' ELSE n_name END AS merged_name FROM decided WHERE same")
def e6_log(spark, sf_dir):
    entities, aliases, _, pairs = _twins(spark, sf_dir)
    return R.apply_merges(entities, {}, R.merge_decisions(pairs, entities, aliases, _adjudicate))["log"].select("survivor_id", "survivor_name", "merged_id", "merged_name")


@register("e7_adjudications", "SELECT event_id, event_id % 4 = 0 AS same, CASE WHEN event_id % 4 < 2 THEN 0.5 ELSE 0 END::DOUBLE AS confidence FROM events")
def e7(spark, sf_dir):
    n = F.col("event_id") % 4
    raw = F.when(n == 0, F.lit('```json\n{"same_entity": true, "confidence": 0.5}\n```')).when(n == 1, F.lit('{"same_entity": false, "confidence": "0.5"}')).when(n == 2, F.lit('{"same_entity": true}')).otherwise(F.lit("yes!"))
    return adapter.table(spark, sf_dir, "events").select("event_id", records.parse_adjudication(raw).alias("t")).select("event_id", "t.same", F.col("t.confidence").cast("double").alias("confidence"))


# ---- semantic narratives, message marks --------------------------------------------------------------------------


_COSINE = "near AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95)"


@register("g3_semantic_links", f"WITH {_COSINE} SELECT lpad(a::VARCHAR, 12, '0') AS a, lpad(b::VARCHAR, 12, '0') AS b, round(cosine, 6) AS cosine FROM near")
def g3(spark, sf_dir):
    return graph.semantic_links(_vectors(spark, sf_dir), 0.95).select("a", "b", rounded("cosine", "cosine"))


def _vectors(spark, sf_dir) -> DataFrame:
    return adapter.table(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("item_id"), F.col("embedding").alias("vector"))


@register("x3_loose_narratives", f"WITH RECURSIVE {_COSINE}, linked AS (SELECT a, b FROM near UNION SELECT b, a FROM near), reach(v, label) AS (SELECT a, a FROM linked UNION SELECT l.b, r.label FROM reach r JOIN linked l ON l.a = r.v WHERE r.label < l.b) SELECT 'loose:' || lpad(min(label)::VARCHAR, 12, '0') AS narrative_id, lpad(v::VARCHAR, 12, '0') AS item_id FROM reach GROUP BY v")
def x3(spark, sf_dir):
    return graph.CLUSTERERS["loose"](_vectors(spark, sf_dir))


@register("s11_channels_in_order", "SELECT channel, place, id FROM (SELECT user_id AS channel, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS place FROM events WHERE user_id % 5 <> 0) WHERE place <= 3")
def s11(spark, sf_dir):
    """Messages of live channels oldest first, up to a limit each; a dead channel is skipped, the others go on."""
    rows = adapter.table(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), F.col("event_id").alias("id"))
    dead = rows.where("channel % 5 = 0").select("channel").distinct()
    first = Window.partitionBy("channel").orderBy("id")
    return rows.join(dead, "channel", "left_anti").withColumn("place", F.row_number().over(first)).where("place <= 3").select("channel", "place", "id")


@register("s12_search_batches", "SELECT batch, count(*)::BIGINT AS n, min(id)::BIGINT AS first_id FROM (SELECT id, (row_number() OVER (ORDER BY query, place) - 1) // 50 AS batch FROM (SELECT event_id % 97 AS id, min_by(user_id, (user_id, event_id)) AS query, min_by(event_id, (user_id, event_id)) AS place FROM events GROUP BY 1)) GROUP BY 1")
def s12(spark, sf_dir):
    """Results of several searches, each id once where it first came, in detail requests of 50."""
    found = adapter.table(spark, sf_dir, "events").select((F.col("event_id") % 97).alias("id"), F.col("user_id").alias("query"), F.col("event_id").alias("place"))
    return providers.batches(found, 50).groupBy("batch").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
