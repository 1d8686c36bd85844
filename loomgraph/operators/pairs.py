"""Derived edges: equal content, and equal content within a time window.

The number of pairs of a group grows with its square; that is the operator's result.
Whatever needs only the groups (components, narratives) works on items and hashes
instead, see :mod:`loomgraph.operators.graph`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import seconds_between

WINDOW_HOURS = 24.0


def hash_pool(items: DataFrame, kinds: tuple[str, ...] = ("text", "transcript", "media")) -> DataFrame:
    """item_id, field, hash, author and time: a row for each hash that an item has, in one pass."""
    have = set(items.columns)
    transcript = F.get_json_object("source_specific", "$.transcript.text_hash") if "source_specific" in have else F.lit(None).cast("string")
    value = {"text": F.col("text_hash"), "transcript": transcript, "media": F.col("media_hash") if "media_hash" in have else F.lit(None).cast("string")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), value[k].alias("hash")) for k in kinds]))
    rows = items.select("item_id", "author_native_id", "published_at", each.alias("h"))
    return rows.select("item_id", "author_native_id", "published_at", "h.field", "h.hash").where("hash is not null")


def equal_pairs(pool: DataFrame) -> DataFrame:
    """Pairs of different items with one hash, smaller id first; text pairs with text or transcript, media with media."""
    family = F.when(F.col("field") == "media", "shared_media").otherwise("near_duplicate_text")
    rows = pool.withColumn("edge_type", family)
    sides = {s: rows.select("edge_type", "hash", *[F.col(c).alias(f"{c}_{s}") for c in ("item_id", "field", "author_native_id", "published_at")]) for s in ("src", "dst")}
    pairs = sides["src"].join(sides["dst"], ["edge_type", "hash"]).where("item_id_src < item_id_dst")
    return pairs.select(F.col("item_id_src").alias("src_item_id"), F.col("item_id_dst").alias("dst_item_id"), "edge_type", "hash", F.col("field_src").alias("src_field"), F.col("field_dst").alias("dst_field"), "author_native_id_src", "author_native_id_dst", "published_at_src", "published_at_dst")


def pair_counts(pool: DataFrame) -> DataFrame:
    """(edge_type, n): how many pairs :func:`equal_pairs` has, from the sizes of the groups.

    Rows of one item don't pair with each other: of n rows, k_i of item i, (n * n - sum k_i * k_i) / 2 pairs.
    """
    family = F.when(F.col("field") == "media", "shared_media").otherwise("near_duplicate_text")
    own = pool.groupBy(family.alias("edge_type"), "hash", "item_id").agg(F.count("*").alias("k"))
    sizes = own.groupBy("edge_type", "hash").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("same"))
    return sizes.groupBy("edge_type").agg(F.expr("sum((n * n - same) div 2)").alias("n")).where("n > 0")


def shared_media(items: DataFrame) -> DataFrame:
    return equal_pairs(hash_pool(items, ("media",)))


def near_duplicate_text(items: DataFrame) -> DataFrame:
    return equal_pairs(hash_pool(items, ("text", "transcript")))


def temporal_cocluster(pairs: DataFrame, window_hours: float = WINDOW_HOURS) -> DataFrame:
    """Pairs by different known authors at known times at most the window apart (both ends included)."""
    delta = F.abs(seconds_between(F.col("published_at_src"), F.col("published_at_dst")))
    near = pairs.where("author_native_id_src <> author_native_id_dst").withColumn("time_delta_seconds", delta)
    near = near.where(F.col("time_delta_seconds") <= window_hours * 3600)
    return near.select("src_item_id", "dst_item_id", F.lit("temporal_cocluster").alias("edge_type"), F.lit(float(window_hours)).alias("window_hours"), F.col("edge_type").alias("basis_edge_type"), F.col("author_native_id_src").alias("author_src"), F.col("author_native_id_dst").alias("author_dst"), "time_delta_seconds")


def as_edges(found: DataFrame) -> DataFrame:
    """Edge rows: a deterministic id, evidence as JSON of the other columns."""
    ends = {"src_item_id", "dst_item_id", "edge_type"}
    evidence = F.to_json(F.struct(*[c for c in found.columns if c not in ends]), {"ignoreNullFields": "false"})
    return found.select(F.sha2(F.concat_ws("\x01", "edge_type", "src_item_id", "dst_item_id", evidence), 256).alias("edge_id"), "edge_type", "src_item_id", "dst_item_id", F.lit(None).cast("string").alias("dst_external_ref"), F.lit(False).alias("directed"), F.lit(None).cast("double").alias("weight"), F.lit("derived").alias("origin"), evidence.alias("evidence"))


def derive_all(items: DataFrame, window_hours: float = WINDOW_HOURS) -> DataFrame:
    """All derived edges of the items, as one plan: nothing is read back from storage."""
    pairs = equal_pairs(hash_pool(items))
    plain = pairs.select("src_item_id", "dst_item_id", "edge_type", F.col("hash").alias("shared_hash"), "src_field", "dst_field")
    return as_edges(plain).unionByName(as_edges(temporal_cocluster(pairs, window_hours)))


def collected_edges(messages: DataFrame, reference: str, edge_type: str, directed: bool = True) -> DataFrame:
    """Edges from a reference to another record's native id; what can't be resolved stays an external reference."""
    known = messages.select(F.col("source_native_id").alias("_ref"), F.col("source_native_id").alias("dst_item_id"))
    rows = messages.where(F.col(reference).isNotNull()).select(F.col("source_native_id").alias("src_item_id"), F.col(reference).alias("_wanted"))
    joined = rows.join(known, F.col("_wanted") == F.col("_ref"), "left")
    return joined.select("src_item_id", "dst_item_id", F.when(F.col("dst_item_id").isNull(), F.col("_wanted")).alias("dst_external_ref"), F.lit(edge_type).alias("edge_type"), F.lit(directed).alias("directed"))
