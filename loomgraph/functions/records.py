"""Columns that map source records (messages, videos, channels) and model responses to the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import clamp01, language, normalize_text, script, seconds_between, text_hash
from loomgraph.schemas import ENTITY_TYPES, POLARITIES

# Thumbnail sizes, best first.
THUMBNAILS = ("maxres", "standard", "high", "medium", "default")


def duration_seconds(text: Column) -> Column:
    """``PT#H#M#S`` in full, else null."""
    pattern = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    part = lambda k: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0))
    return F.when(F.rlike(text, F.lit(pattern)), part(1) * 3600 + part(2) * 60 + part(3))


def best_thumbnail(sizes: Column) -> Column:
    """First non-empty url of a map from size to url."""
    return F.coalesce(*[F.nullif(F.try_element_at(sizes, F.lit(s)), F.lit("")) for s in THUMBNAILS])


def _link(url: Column) -> tuple[Column, Column, Column]:
    """Host (lower case, without www. or m.), path and the whole link of the first link in a text; scheme optional."""
    link = F.regexp_extract(url, r"(?i)(https?://)?[a-z0-9.-]+\.[a-z]{2,}/[^\s#]*", 0)
    link = F.when(F.rlike(link, F.lit("(?i)^https?://")), link).otherwise(F.concat(F.lit("https://"), link))
    host = F.regexp_replace(F.lower(F.try_parse_url(link, F.lit("HOST"))), r"^(www|m)\.", "")
    return host, F.try_parse_url(link, F.lit("PATH")), link


def _id(text: Column, least: int = 1) -> Column:
    """Leading identifier characters, if there are at least so many."""
    found = F.regexp_extract(text, "^[A-Za-z0-9_-]*", 0)
    return F.when(F.length(found) >= least, found)


def video_id(url: Column) -> Column:
    """Video of a watch link (query field v) or a short link (first path part); null for other links."""
    host, path, link = _link(url)
    short = F.when(host == "youtu.be", _id(F.substring(path, 2, 64), 6))
    return F.coalesce(short, F.when((host == "youtube.com") & (path == "/watch"), _id(F.try_parse_url(link, F.lit("QUERY"), F.lit("v")), 6)))


def channel_id(url: Column) -> Column:
    """Channel of a link whose path is channel/id; null for other links."""
    host, path, _ = _link(url)
    parts = F.split(path, "/")
    return F.when((host == "youtube.com") & (F.get(parts, F.lit(1)) == "channel"), _id(F.get(parts, F.lit(2))))


def forward_ref_channel(ref: Column) -> Column:
    """Channel of ``telegram:channel:message``, else null."""
    return F.try_to_number(F.nullif(F.regexp_extract(ref, r"^telegram:(-?\d+):(-?\d+)$", 1), F.lit("")), F.lit("S999999999999999999")).cast("long")


def title_text(title: Column, description: Column) -> Column:
    """Title and description with a blank line between, ends trimmed; empty becomes null."""
    both = F.concat_ws("\n\n", F.nullif(title, F.lit("")), F.nullif(description, F.lit("")))
    return F.nullif(F.regexp_replace(both, r"^\s+|\s+$", ""), F.lit(""))


def parse_time(text: Column) -> Column:
    """ISO time with or without offset to an instant; null or empty or bad gives null."""
    return F.try_to_timestamp(F.nullif(text, F.lit("")))


def account_age_days(seen: Column, created: Column) -> Column:
    return (F.unix_micros(seen) - F.unix_micros(created)) / F.lit(86_400e6)


def media_kind(media: Column) -> Column:
    """photo; video or document by mime type; else the media's own name. ``media``: struct<kind, mime_type>."""
    video = F.coalesce(F.startswith(media["mime_type"], F.lit("video")), F.lit(False))
    return F.when(media["kind"] == "document", F.when(video, "video").otherwise("document")).otherwise(media["kind"])


def message_entities(spans: Column) -> Column:
    """urls, hashtags, mentions, handles from a message's typed spans: array<struct<kind, text, url>>."""
    pick = lambda *kinds: F.filter(spans, lambda s: s["kind"].isin(*kinds))
    mentions = F.transform(pick("mention", "mention_name"), lambda s: s["text"])
    return F.struct(
        F.transform(pick("url", "text_url"), lambda s: F.when(s["kind"] == "url", s["text"]).otherwise(s["url"])).alias("urls"),
        F.transform(pick("hashtag"), lambda s: s["text"]).alias("hashtags"),
        mentions.alias("mentions"),
        F.transform(mentions, lambda m: F.regexp_replace(m, "^@+", "")).alias("handles"),
        F.array().cast("array<string>").alias("named_entities"),
    )


def reactions_map(reactions: Column) -> Column:
    """array<struct<name, count>> to a map; the last of a name wins."""
    names = F.array_distinct(F.transform(reactions, lambda r: r["name"]))
    last = lambda n: F.element_at(F.filter(reactions, lambda r: r["name"] == n), -1)["count"]
    return F.map_from_arrays(names, F.transform(names, last))


def engagement(views: Column, forwards: Column, replies: Column, reactions: Column) -> Column:
    """Engagement of a message; without reactions the map is empty."""
    none = F.create_map().cast("map<string,bigint>")
    return F.struct(views.cast("long").alias("view_count"), forwards.cast("long").alias("forward_count"), replies.cast("long").alias("reply_count"), F.coalesce(reactions_map(reactions).cast("map<string,bigint>"), none).alias("reactions"))


def media_descriptors(media: Column) -> Column:
    """One descriptor of a message's media, without its content; null without media. ``media``: struct<kind, mime_type, ref>."""
    ref = F.when(media["kind"].isin("photo", "document"), media["ref"])
    one = F.struct(media_kind(media).alias("type"), ref.alias("source_ref"), F.lit(None).cast("string").alias("file_hash"), F.when(media["kind"] == "document", F.coalesce(media["mime_type"], F.lit(""))).alias("mime_type"))
    return F.when(media.isNotNull() & media["kind"].isNotNull(), F.array(one))


def forward_latency(sent: Column, origin: Column) -> Column:
    """Seconds from the original to the forward; null unless both times are known."""
    return seconds_between(sent, origin)


def transcript_block(text: Column, language_code: Column, is_generated: Column, provider: Column, fetched_at: Column) -> Column:
    """What is kept of a transcript: script, language and hash are those of the spoken text, beside the item's own."""
    spoken = script(text)
    return F.struct(text.alias("text"), language_code.alias("language_code"), is_generated.alias("is_generated"), provider.alias("provider_name"), fetched_at.alias("fetched_at"), text_hash(normalize_text(text)).alias("text_hash"), spoken.alias("transcript_script"), language(text, spoken).alias("transcript_language"))


def parse_adjudication(raw: Column) -> Column:
    """struct<same, confidence> of an adjudicator's answer; one that can't be read is a rejection with confidence 0."""
    bare = F.trim(F.regexp_replace(F.trim(raw), r"^`+(?:json)?\s*|\s*`+$", ""))
    same, sure = F.get_json_object(bare, "$.same_entity"), F.get_json_object(bare, "$.confidence").try_cast("double")
    good = same.isin("true", "false") & sure.isNotNull()
    return F.struct(F.coalesce(good & (same == "true"), F.lit(False)).alias("same"), F.when(good, sure).otherwise(0.0).alias("confidence"))


def channel_type(broadcast: Column, megagroup: Column) -> Column:
    return F.when(broadcast, "broadcast").when(megagroup, "megagroup").otherwise("group")


def declared_language(default_language: Column, audio_language: Column) -> Column:
    return F.coalesce(F.nullif(default_language, F.lit("")), F.nullif(audio_language, F.lit("")))


def created_estimate(first_message: Column, oldest_message: Column) -> Column:
    """Date and confidence of a channel's creation: message 1, else the oldest left, else none."""
    confidence = F.when(first_message.isNotNull(), 0.75).when(oldest_message.isNotNull(), 0.5).otherwise(0.0)
    return F.struct(F.coalesce(first_message, oldest_message).alias("date"), confidence.alias("confidence"))


def visible_subscribers(count: Column, hidden: Column) -> Column:
    return F.when(~F.coalesce(hidden, F.lit(False)), count.try_cast("long"))


def author_parts(author: Column) -> Column:
    """(source type, native id), cut at the first colon."""
    return F.struct(F.substring_index(author, ":", 1).alias("source_type"), F.regexp_replace(author, "^[^:]*:", "").alias("native_id"))


def _rows(raw: Column) -> Column:
    """Elements of a JSON array in an answer that may stand in a code fence; null unless an array."""
    bare = F.trim(F.regexp_replace(F.trim(raw), r"^`+(?:json)?\s*|\s*`+$", ""))
    return F.from_json(F.when(F.startswith(bare, F.lit("[")), bare), "array<string>")


def _number(row: Column, path: str) -> Column:
    return F.get_json_object(row, path).try_cast("double")


def parse_mentions(raw: Column) -> Column:
    """array<struct<surface_form, entity_type_guess, canonical_name, confidence>>; bad rows drop, a bad answer is empty."""
    text = lambda r, k: F.get_json_object(r, f"$.{k}")
    good = F.filter(_rows(raw), lambda r: text(r, "surface_form").isNotNull() & text(r, "entity_type_guess").isNotNull() & text(r, "canonical_name").isNotNull() & _number(r, "$.confidence").isNotNull())
    made = F.transform(good, lambda r: F.struct(text(r, "surface_form").alias("surface_form"), F.lower(text(r, "entity_type_guess")).alias("entity_type_guess"), text(r, "canonical_name").alias("canonical_name"), _number(r, "$.confidence").alias("confidence")))
    return F.coalesce(made, F.array().cast("array<struct<surface_form:string,entity_type_guess:string,canonical_name:string,confidence:double>>"))


def parse_stances(raw: Column, entity_ids: Column) -> Column:
    """array<struct<entity_id, polarity, strength, confidence>>; unknown polarity or a 1-based index out of range drops the row."""
    index = lambda r: F.get_json_object(r, "$.index").try_cast("int")
    polarity = lambda r: F.lower(F.get_json_object(r, "$.polarity"))
    good = F.filter(_rows(raw), lambda r: index(r).between(1, F.size(entity_ids)) & polarity(r).isin(*POLARITIES) & _number(r, "$.strength").isNotNull() & _number(r, "$.confidence").isNotNull())
    made = F.transform(good, lambda r: F.struct(F.get(entity_ids, index(r) - 1).alias("entity_id"), polarity(r).alias("polarity"), clamp01(_number(r, "$.strength")).alias("strength"), clamp01(_number(r, "$.confidence")).alias("confidence")))
    return F.coalesce(made, F.array().cast("array<struct<entity_id:string,polarity:string,strength:double,confidence:double>>"))


def entity_type(guess: Column) -> Column:
    return F.when(guess.isin(*ENTITY_TYPES), guess).otherwise("other")
