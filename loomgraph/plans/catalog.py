"""The registered queries of the content graph, with the SQL that says the same.

tables.  Floats are rounded to 6 places on both sides; collected lists are sorted and joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import fuzzy, records
from loomgraph.functions import text as T
from loomgraph.operators import graph
from loomgraph.operators import items as I
from loomgraph.operators import pairs as P
from loomgraph.operators import resolution as R
from loomgraph.operators import rollups as U
from loomgraph.plans.registry import QUERIES, SQL, register  # noqa: F401
from loomgraph.plans.registry import rounded as _r
from loomgraph.plans.sql import COCLUSTER, ITEMS, MEMBERS, PAIRS, PROFILES, STANCE, TOKEN_SET, query
from loomgraph.session import cut, scratch
from loomgraph.sources import adapter, readers, writers
from loomgraph.streaming import collection

def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.items(spark, sf_dir)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.equal_pairs(P.hash_pool(_items(spark, sf_dir), ("text", "media")))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.hash_pool(_items(spark, sf_dir), ("text", "media"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("origin", F.lit("derived"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return graph.narratives(items, P.hash_pool(items, ("text", "media")))[1]


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.author_profiles(adapter.stance_edges(spark, sf_dir), _items(spark, sf_dir), _members(spark, sf_dir))


# ---- sources and sinks -------------------------------------------------------------------------------------------


def _raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = F.to_json(F.struct("text_hash", "media_hash"), {"ignoreNullFields": "false"})
    return _items(spark, sf_dir).withColumn("content_hashes", hashes).withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))


@register("s1_items_ndjson", query("SELECT item_id, source_type, author_native_id, published_at, text_hash, media_hash FROM items", ITEMS))
def s1(spark, sf_dir):
    path = scratch(spark, "items")
    writers.write_items(_raw_items(spark, sf_dir), f"{path}/run")
    return readers.read_items(spark, f"{path}/run/*.json").select("item_id", "source_type", "author_native_id", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "text_hash", "media_hash")


@register("s2_edges_parquet", query("SELECT src_item_id, dst_item_id, edge_type, hash FROM pairs", ITEMS, PAIRS))
def s2(spark, sf_dir):
    path = scratch(spark, "edges")
    found = _pairs(spark, sf_dir).select("src_item_id", "dst_item_id", "edge_type", F.col("hash").alias("shared_hash"))
    writers.write_edges(P.as_edges(found), f"{path}/run")
    return readers.read_edges(spark, f"{path}/run/*.parquet").select("src_item_id", "dst_item_id", "edge_type", F.get_json_object("evidence", "$.shared_hash").alias("hash"))


@register("s3_observations", "SELECT 'u' || user_id AS node_item_id, ts AS observed_at, event_id AS view_count, round(value)::BIGINT AS followers FROM events")
def s3(spark, sf_dir):
    path = scratch(spark, "observations")
    rows = adapter.observations(spark, sf_dir)
    writers.append_observations(rows.where("view_count % 2 = 0"), path)
    writers.append_observations(rows.where("view_count % 2 = 1"), path)
    read = readers.read_observations(spark, f"{path}/*.parquet")
    return read.select("node_item_id", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), "view_count", F.col("subscriber_or_follower_count").alias("followers"))


@register("s4_empty_inputs", "SELECT 0::BIGINT AS n_items, 0::BIGINT AS n_edges, 0::BIGINT AS n_observations")
def s4(spark, sf_dir):
    none = scratch(spark, "nothing")
    counts = [(readers.read_items(spark, f"{none}/*.jsonl"), "n_items"), (readers.read_edges(spark, f"{none}/*.parquet"), "n_edges"), (readers.read_observations(spark, f"{none}/*.parquet"), "n_observations")]
    parts = [df.agg(F.count("*").alias(name)).withColumn("k", F.lit(1)) for df, name in counts]
    return parts[0].join(parts[1], "k").join(parts[2], "k").drop("k")


_FLOW = "CASE WHEN source_type = 'view' THEN 'channel' ELSE source_type END"


@register("s5_nodes", query(f"SELECT item_id, {_FLOW} AS source_type FROM items WHERE {_FLOW} IN ('channel', 'author')", ITEMS))
def s5(spark, sf_dir):
    items = _items(spark, sf_dir).withColumn("source_type", F.when(F.col("source_type") == "view", "channel").otherwise(F.col("source_type")))
    return readers.nodes(items).select("item_id", "source_type")


@register("s7_two_catalogs", query("SELECT i.lang, count(*)::BIGINT AS n FROM items i JOIN labels l ON l.doc_id = i.doc_id GROUP BY i.lang", ITEMS))
def s7(spark, sf_dir):
    _items(spark, sf_dir).createOrReplaceTempView("processed_items")
    adapter.table(spark, sf_dir, "labels").createOrReplaceTempView("analysis_labels")
    return spark.sql("SELECT i.lang, count(*) AS n FROM processed_items i JOIN analysis_labels l ON l.doc_id = i.doc_id GROUP BY i.lang")


@register("s10_edge_mining", "SELECT DISTINCT conv_id AS channel_id FROM conversations WHERE conv_id % 5 <> 0")
def s10(spark, sf_dir):
    talk = adapter.table(spark, sf_dir, "conversations")
    edges = talk.select(F.lit("forward").alias("edge_type"), F.lit(None).cast("string").alias("dst_item_id"), F.concat_ws(":", F.lit("telegram"), "conv_id", "turn").alias("dst_external_ref"))
    done = talk.where("conv_id % 5 = 0").select(F.col("conv_id").cast("string").alias("key")).distinct()
    return readers.unresolved_forward_channels(edges, done)


@register("k5_transcript_snapshot", query("SELECT i.item_id, c.text AS transcript FROM items i LEFT JOIN (SELECT conv_id, text FROM conversations WHERE turn = 0) c ON c.conv_id = i.doc_id", ITEMS))
def k5(spark, sf_dir):
    items = _items(spark, sf_dir).withColumn("source_specific", F.lit(None).cast("string"))
    first = adapter.table(spark, sf_dir, "conversations").where("turn = 0")
    block = F.to_json(F.struct("text"))
    said = first.select(F.concat(F.lit("d"), F.lpad(F.col("conv_id").cast("string"), 9, "0")).alias("item_id"), block.alias("block"))
    return writers.with_transcripts(items, said).select("item_id", F.get_json_object("source_specific", "$.transcript.text").alias("transcript"))


# ---- projections and filters -------------------------------------------------------------------------------------


@register("p1_load_projection", query("SELECT item_id, published_at, text_hash, media_hash FROM items", ITEMS))
def p1(spark, sf_dir):
    rows = _raw_items(spark, sf_dir)
    return rows.select("item_id", records.parse_time(F.col("published_at")).cast("timestamp_ntz").alias("published_at"), F.get_json_object("content_hashes", "$.text_hash").alias("text_hash"), F.get_json_object("content_hashes", "$.media_hash").alias("media_hash"))


@register("p2_text_present", query("SELECT item_id FROM items WHERE text IS NOT NULL AND text_hash IS NOT NULL", ITEMS))
def p2(spark, sf_dir):
    return I.with_text(_items(spark, sf_dir)).select("item_id")


_ENDS = "ends AS (SELECT src_item_id AS item_id FROM pairs UNION SELECT dst_item_id FROM pairs)"


@register("p3_clustered_items", query("SELECT item_id, lang FROM items WHERE item_id IN (SELECT item_id FROM ends)", ITEMS, PAIRS, _ENDS))
def p3(spark, sf_dir):
    return _items(spark, sf_dir).join(I.sharing(_pool(spark, sf_dir)), "item_id", "left_semi").select("item_id", "lang")


@register("p5_qualified_edges", query("SELECT p.src_item_id, p.dst_item_id, p.edge_type FROM pairs p JOIN items a ON a.item_id = p.src_item_id JOIN items b ON b.item_id = p.dst_item_id WHERE a.lang = 'en' AND b.lang = 'en'", ITEMS, PAIRS))
def p5(spark, sf_dir):
    english = _items(spark, sf_dir).where("lang = 'en'")
    return I.qualified_edges(_edges(spark, sf_dir), english, ("near_duplicate_text", "shared_media")).select("src_item_id", "dst_item_id", "edge_type")


@register("p6_in_and_not_in", query("SELECT item_id, lang FROM items WHERE lang IN ('de', 'fr') AND source_type NOT IN (SELECT source_type FROM items WHERE value > 480)", ITEMS))
def p6(spark, sf_dir):
    items = _items(spark, sf_dir)
    return items.where(F.col("lang").isin("de", "fr")).join(items.where("value > 480").select("source_type").distinct(), "source_type", "left_anti").select("item_id", "lang")


@register("p7_language_or_script", query("SELECT DISTINCT item_id, lang FROM items WHERE lang IN ('es', 'fr') OR regexp_matches(text, '[ऀ-ॿ؀-ۿ]')", ITEMS))
def p7(spark, sf_dir):
    items = _items(spark, sf_dir)
    return items.where(F.col("lang").isin("es", "fr") | T.script(F.col("text")).isin("devanagari", "arabic")).select("item_id", "lang").distinct()


@register("p9_snippets", query("SELECT item_id, left(text, 200) AS snippet FROM items WHERE length(text) > 0", ITEMS))
def p9(spark, sf_dir):
    return _items(spark, sf_dir).where(F.length("text") > 0).select("item_id", F.left("text", F.lit(200)).alias("snippet"))


@register("p4_induced_subgraph", query("SELECT i.item_id, i.author_native_id, array_to_string(list_sort(list(DISTINCT e.surface_form)), ',') AS names FROM items i JOIN item_entities e ON e.item_id = i.item_id WHERE i.item_id IN (SELECT item_id FROM ends) GROUP BY ALL", ITEMS, PAIRS, _ENDS, r"""item_entities AS (SELECT item_id, lang AS surface_form FROM items UNION SELECT item_id, upper(lang) FROM items)"""))
def p4(spark, sf_dir):
    inside = _items(spark, sf_dir).join(I.sharing(_pool(spark, sf_dir)), "item_id", "left_semi")
    names = inside.select("item_id", F.explode(F.array("lang", F.upper("lang"))).alias("name"))
    return inside.select("item_id", "author_native_id").join(names, "item_id").groupBy("item_id", "author_native_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"))


@register("p8_known_authors", query("SELECT item_id, source_type || ':' || author_native_id AS author_id FROM items WHERE author_native_id IS NOT NULL", ITEMS))
def p8(spark, sf_dir):
    return _items(spark, sf_dir).where("author_native_id is not null").select("item_id", F.concat_ws(":", "source_type", "author_native_id").alias("author_id"))


# ---- joins -------------------------------------------------------------------------------------------------------


@register("j1_shared_media", query("SELECT src_item_id, dst_item_id, hash FROM pairs WHERE edge_type = 'shared_media'", ITEMS, PAIRS))
def j1(spark, sf_dir):
    return P.shared_media(_items(spark, sf_dir)).select("src_item_id", "dst_item_id", "hash")


_POOL = r"""pool AS (
  SELECT item_id, 'text' AS field, text_hash AS hash FROM items WHERE text_hash IS NOT NULL
  UNION ALL SELECT item_id, 'transcript', text_hash FROM items WHERE text_hash IS NOT NULL AND doc_id % 3 = 0)"""


@register("j2_near_duplicate_text", query("SELECT a.item_id AS src_item_id, b.item_id AS dst_item_id, a.field AS src_field, b.field AS dst_field, a.hash FROM pool a JOIN pool b ON a.hash = b.hash AND a.item_id < b.item_id", ITEMS, _POOL))
def j2(spark, sf_dir):
    said = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.struct("text_hash").alias("transcript"))))
    items = _items(spark, sf_dir).withColumn("source_specific", said)
    return P.near_duplicate_text(items).select("src_item_id", "dst_item_id", "src_field", "dst_field", "hash")


@register("j3_temporal_cocluster", query("SELECT src_item_id, dst_item_id, basis_edge_type, author_src, author_dst, round(time_delta_seconds, 6) AS time_delta_seconds FROM cocluster", ITEMS, PAIRS, COCLUSTER))
def j3(spark, sf_dir):
    found = P.temporal_cocluster(_pairs(spark, sf_dir))
    return found.select("src_item_id", "dst_item_id", "basis_edge_type", "author_src", "author_dst", _r("time_delta_seconds", "time_delta_seconds"))


@register("j4_unprocessed", query("SELECT item_id FROM items WHERE text_hash IS NOT NULL AND doc_id % 3 <> 0", ITEMS))
def j4(spark, sf_dir):
    items = _items(spark, sf_dir)
    return I.unprocessed(items, items.where("doc_id % 3 = 0").select("item_id")).select("item_id")


_ITEM_ENTITIES = r"""item_entities AS (
  SELECT item_id, lang AS entity_id, lang AS surface_form, 0.9::DOUBLE AS confidence FROM items
  UNION ALL SELECT item_id, author_native_id, author_native_id, 0.5 FROM items
  UNION ALL SELECT item_id, lang, upper(lang), 0.7 FROM items)"""
_DONE = "done AS (SELECT item_id, lang AS entity_id FROM items WHERE doc_id % 3 = 0 UNION ALL SELECT item_id, author_native_id FROM items WHERE doc_id % 6 = 0)"


def _item_entities(spark, sf_dir) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.col(e).alias("entity_id"), s.alias("surface_form"), F.lit(c).alias("confidence")) for e, s, c in (("lang", F.col("lang"), 0.9), ("author_native_id", F.col("author_native_id"), 0.5), ("lang", F.upper("lang"), 0.7))]))
    return _items(spark, sf_dir).select("item_id", each.alias("m")).select("item_id", "m.*")


def _done(spark, sf_dir) -> DataFrame:
    items = _items(spark, sf_dir)
    return items.where("doc_id % 3 = 0").select("item_id", F.col("lang").alias("entity_id")).union(items.where("doc_id % 6 = 0").select("item_id", "author_native_id"))


@register("j5_counts_behind", query("SELECT w.item_id, w.wanted, coalesce(f.found, 0) AS found FROM (SELECT item_id, count(DISTINCT entity_id)::BIGINT AS wanted FROM item_entities GROUP BY 1) w LEFT JOIN (SELECT item_id, count(DISTINCT entity_id)::BIGINT AS found FROM done GROUP BY 1) f ON f.item_id = w.item_id WHERE f.found IS NULL OR f.found < w.wanted", ITEMS, _ITEM_ENTITIES, _DONE))
def j5(spark, sf_dir):
    return I.counts_behind(_item_entities(spark, sf_dir), _done(spark, sf_dir))


@register("j5_pending_pairs", query("SELECT DISTINCT e.item_id, e.entity_id FROM item_entities e WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.item_id = e.item_id AND d.entity_id = e.entity_id)", ITEMS, _ITEM_ENTITIES, _DONE))
def j5b(spark, sf_dir):
    return I.pending_pairs(_item_entities(spark, sf_dir), _done(spark, sf_dir))


@register("j6_entity_lookup", query("SELECT s.item_id, upper(s.entity_id) AS canonical_name, s.polarity, i.author_native_id FROM stance s JOIN items i ON i.item_id = s.item_id", ITEMS, STANCE))
def j6(spark, sf_dir):
    items = _items(spark, sf_dir)
    entities = items.select(F.col("lang").alias("entity_id"), F.upper("lang").alias("canonical_name")).distinct()
    return adapter.stance_edges(spark, sf_dir).join(entities, "entity_id").join(items.select("item_id", "author_native_id"), "item_id").select("item_id", "canonical_name", "polarity", "author_native_id")


@register("j7_items_with_names", query("SELECT i.item_id, array_to_string(list_sort(list(DISTINCT e.surface_form) FILTER (WHERE e.surface_form IS NOT NULL)), ',') AS names FROM items i LEFT JOIN (SELECT item_id, nullif(surface_form, 'DE') AS surface_form FROM item_entities WHERE entity_id <> 'en') e ON e.item_id = i.item_id GROUP BY i.item_id", ITEMS, _ITEM_ENTITIES))
def j7(spark, sf_dir):
    """Items with the names of their entities; some entities and some names are unknown."""
    some = _item_entities(spark, sf_dir).where("entity_id <> 'en'").withColumn("surface_form", F.nullif("surface_form", F.lit("DE")))
    joined = _items(spark, sf_dir).select("item_id").join(some, "item_id", "left")
    names = F.sort_array(F.collect_set("surface_form"))
    return joined.groupBy("item_id").agg(F.when(F.size(names) > 0, F.array_join(names, ",")).alias("names"))


_TYPED = "names AS (SELECT DISTINCT p_name AS name, p_type AS entity_type FROM part), pairs_of AS (SELECT x.name AS a, y.name AS b, x.entity_type FROM names x JOIN names y ON x.entity_type = y.entity_type AND x.name < y.name), compared AS (SELECT DISTINCT a, b FROM pairs_of)"


@register("j10_candidate_pairs", query("SELECT p.a, p.b, p.entity_type, round(s.score, 6) AS score FROM pairs_of p JOIN scores s ON s.a = p.a AND s.b = p.b WHERE s.score >= 65", _TYPED, TOKEN_SET))
def j10(spark, sf_dir):
    names = adapter.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("entity_type")).distinct()
    return R.candidate_pairs(names.withColumn("entity_id", F.col("name"))).select("a", "b", "entity_type", _r("score", "score"))


_TURNS = "turns AS (SELECT conv_id || ':' || turn AS src, CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS ref FROM conversations)"


@register("j11_reply_edges", query("SELECT t.src AS src_item_id, k.src AS dst_item_id, CASE WHEN k.src IS NULL THEN t.ref END AS dst_external_ref FROM turns t LEFT JOIN turns k ON k.src = t.ref WHERE t.ref IS NOT NULL", _TURNS))
def j11(spark, sf_dir):
    return P.collected_edges(adapter.messages(spark, sf_dir), "reply_to", "reply").select("src_item_id", "dst_item_id", "dst_external_ref")


@register("j12_cache_misses", query("SELECT DISTINCT text_hash FROM items WHERE text_hash IS NOT NULL AND text_hash NOT IN (SELECT text_hash FROM items WHERE doc_id % 3 = 0 AND text_hash IS NOT NULL)", ITEMS))
def j12(spark, sf_dir):
    items = _items(spark, sf_dir)
    return I.uncached(items, items.where("doc_id % 3 = 0").select("text_hash"))


# ---- aggregates --------------------------------------------------------------------------------------------------


@register("a1_counts_by_kind", query("SELECT source_type AS kind, count(*)::BIGINT AS n FROM items GROUP BY 1 UNION ALL SELECT edge_type, count(*)::BIGINT FROM pairs GROUP BY 1", ITEMS, PAIRS))
def a1(spark, sf_dir):
    kinds = _items(spark, sf_dir).groupBy(F.col("source_type").alias("kind")).agg(F.count("*").alias("n"))
    return kinds.unionByName(P.pair_counts(_pool(spark, sf_dir)).withColumnRenamed("edge_type", "kind")).orderBy(F.desc("n"), "kind")


@register("a2_time_range", query("SELECT count(*)::BIGINT AS n, min(published_at) AS first_at, max(published_at) AS last_at FROM items WHERE text_hash IS NOT NULL", ITEMS))
def a2(spark, sf_dir):
    at = F.col("published_at").cast("timestamp_ntz")
    return I.with_text(_items(spark, sf_dir)).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


@register("a3_hash_clusters", query("SELECT text_hash AS hash, count(DISTINCT item_id)::BIGINT AS n_items, count(DISTINCT author_native_id)::BIGINT AS n_authors FROM items WHERE text_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY n_items DESC, hash LIMIT 20", ITEMS))
def a3(spark, sf_dir):
    pool = P.hash_pool(_items(spark, sf_dir), ("text",))
    found = pool.groupBy("hash").agg(F.count_distinct("item_id").alias("n_items"), F.count_distinct("author_native_id").alias("n_authors"), F.count("*").alias("n"))
    return found.where("n > 1").orderBy(F.desc("n_items"), "hash").limit(20).drop("n")


@register("a4_entities_per_item", query("SELECT item_id, count(DISTINCT entity_id)::BIGINT AS n FROM item_entities GROUP BY 1", ITEMS, _ITEM_ENTITIES))
def a4(spark, sf_dir):
    return _item_entities(spark, sf_dir).groupBy("item_id").agg(F.count_distinct("entity_id").alias("n"))


@register("a5_forms_of_entities", query("SELECT entity_id, array_to_string(list_sort(list(surface_form)), ',') AS forms, count(*)::BIGINT AS n FROM (SELECT DISTINCT entity_id, surface_form FROM item_entities) GROUP BY 1 HAVING count(*) > 1", ITEMS, _ITEM_ENTITIES))
def a5(spark, sf_dir):
    forms = _item_entities(spark, sf_dir).select("entity_id", "surface_form").distinct()
    return forms.groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_list("surface_form")), ",").alias("forms"), F.count("*").alias("n")).where("n > 1")


@register("a7_narrative_stance", query("SELECT m.narrative_id, i.lang AS entity_id, count(*) FILTER (WHERE s.polarity = 'positive')::BIGINT AS positive_count, count(*) FILTER (WHERE s.polarity = 'negative')::BIGINT AS negative_count, count(*) FILTER (WHERE s.polarity = 'neutral')::BIGINT AS neutral_count, round(avg(s.strength) FILTER (WHERE s.polarity IS NOT NULL), 6) AS mean_strength FROM members m JOIN items i ON i.item_id = m.item_id LEFT JOIN stance s ON s.item_id = m.item_id AND s.entity_id = i.lang GROUP BY ALL", ITEMS, STANCE, MEMBERS))
def a7(spark, sf_dir):
    entities = _items(spark, sf_dir).select("item_id", F.col("lang").alias("entity_id"))
    return U.narrative_stance(_members(spark, sf_dir), entities, adapter.stance_edges(spark, sf_dir)).withColumn("mean_strength", F.round("mean_strength", 6))


_PROFILE = "author_id, entity_id, round(net_stance, 9) AS net_stance, round(stance_consistency, 6) AS stance_consistency, volume, positive_count, negative_count, neutral_count, first_seen, last_seen, time_span_days, narrative_spread"


@register("a9_author_profiles", query(f"SELECT {_PROFILE} FROM profiles", ITEMS, STANCE, MEMBERS, PROFILES))
def a9(spark, sf_dir):
    rows = _profiles(spark, sf_dir)
    ntz = {c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")}
    return rows.withColumns(ntz | {"net_stance": F.round("net_stance", 9), "stance_consistency": F.round("stance_consistency", 6)})


@register("a14_profile_rollups", query("SELECT author_id, count(DISTINCT entity_id)::BIGINT AS n_entities, sum(volume)::BIGINT AS volume FROM profiles GROUP BY 1", ITEMS, STANCE, MEMBERS, PROFILES))
def a14(spark, sf_dir):
    return _profiles(spark, sf_dir).groupBy("author_id").agg(F.count_distinct("entity_id").alias("n_entities"), F.sum("volume").alias("volume"))


@register("a14_top_entity", query("SELECT entity_id, count(DISTINCT author_id)::BIGINT AS n_authors FROM profiles GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", ITEMS, STANCE, MEMBERS, PROFILES))
def a14b(spark, sf_dir):
    return _profiles(spark, sf_dir).groupBy("entity_id").agg(F.count_distinct("author_id").alias("n_authors")).orderBy(F.desc("n_authors"), "entity_id").limit(1)


_SIZES = "sizes AS (SELECT narrative_id, count(*)::BIGINT AS size FROM members GROUP BY 1)"
_BUCKET = "CASE WHEN size <= 2 THEN '2' WHEN size <= 5 THEN '3-5' WHEN size <= 10 THEN '6-10' WHEN size <= 50 THEN '11-50' ELSE '51+' END"


@register("a15_size_buckets", query(f"SELECT {_BUCKET} AS bucket, count(*)::BIGINT AS n FROM sizes GROUP BY 1", ITEMS, MEMBERS, _SIZES))
def a15(spark, sf_dir):
    sizes = _members(spark, sf_dir).groupBy("narrative_id").agg(F.count("*").alias("size"))
    return sizes.groupBy(F.expr(_BUCKET).alias("bucket")).agg(F.count("*").alias("n"))


@register("a15_size_distribution", query("SELECT min(size) AS least, quantile_cont(size, 0.5)::DOUBLE AS median, round(avg(size), 6) AS mean, max(size) AS most FROM sizes", ITEMS, MEMBERS, _SIZES))
def a15b(spark, sf_dir):
    sizes = _members(spark, sf_dir).groupBy("narrative_id").agg(F.count("*").alias("size"))
    return sizes.agg(F.min("size").alias("least"), F.percentile("size", F.lit(0.5)).alias("median"), F.round(F.avg("size"), 6).alias("mean"), F.max("size").alias("most"))


@register("a16_narratives", query("SELECT m.narrative_id, min(i.published_at) AS time_range_start, max(i.published_at) AS time_range_end, count(*)::BIGINT AS size, count(DISTINCT i.author_native_id)::BIGINT AS distinct_authors FROM members m JOIN items i ON i.item_id = m.item_id GROUP BY 1", ITEMS, MEMBERS))
def a16(spark, sf_dir):
    items = _items(spark, sf_dir)
    found, _ = graph.narratives(items, P.hash_pool(items, ("text", "media")))
    ntz = {c: F.col(c).cast("timestamp_ntz") for c in ("time_range_start", "time_range_end")}
    return found.withColumns(ntz).drop("basis")


_LABELS = r"""named AS (SELECT narrative_id, upper(lang) AS name, count(*) AS n FROM members m JOIN items i ON i.item_id = m.item_id WHERE i.doc_id % 2 = 0 GROUP BY ALL),
top2 AS (SELECT narrative_id, string_agg(name, ' / ' ORDER BY n DESC, name) AS names FROM (SELECT *, row_number() OVER (PARTITION BY narrative_id ORDER BY n DESC, name) AS k FROM named) WHERE k <= 2 GROUP BY 1),
texts AS (SELECT narrative_id, m.item_id, trim(regexp_replace(i.text, '\s+', ' ', 'g')) AS t FROM members m JOIN items i ON i.item_id = m.item_id),
longest AS (SELECT narrative_id, left(t, 80) || CASE WHEN length(t) > 80 THEN '...' ELSE '' END AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY narrative_id ORDER BY length(t) DESC, item_id) AS k FROM texts WHERE t <> '') WHERE k = 1)"""


@register("a17_narrative_labels", query("SELECT DISTINCT m.narrative_id, coalesce(t.names, l.snippet, '(no text)') AS label FROM members m LEFT JOIN top2 t ON t.narrative_id = m.narrative_id LEFT JOIN longest l ON l.narrative_id = m.narrative_id", ITEMS, MEMBERS, _LABELS))
def a17(spark, sf_dir):
    items = _items(spark, sf_dir)
    return graph.labels(_members(spark, sf_dir), items, items.where("doc_id % 2 = 0").select("item_id", F.upper("lang").alias("name")))


@register("a18_counters", query("SELECT polarity, count(*)::BIGINT AS n FROM stance GROUP BY 1", ITEMS, STANCE))
def a18(spark, sf_dir):
    return adapter.stance_edges(spark, sf_dir).groupBy("polarity").agg(F.count("*").alias("n"))


@register("a20_best_name_score", query("SELECT a, b, round(score, 6) AS score FROM scores", "compared AS (SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_name < y.n_name)", TOKEN_SET))
def a20(spark, sf_dir):
    names = adapter.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("entity_type"), F.col("n_name").alias("entity_id"))
    return R.candidate_pairs(names, least=0.0).select("a", "b", _r("score", "score"))


@register("a21_latest_per_key", query("SELECT source_type, max(published_at) AS latest FROM items GROUP BY 1", ITEMS))
def a21(spark, sf_dir):
    return _items(spark, sf_dir).groupBy("source_type").agg(F.max(F.col("published_at").cast("timestamp_ntz")).alias("latest"))


@register("a22_call_estimate", query("SELECT count(*)::BIGINT AS calls FROM (SELECT DISTINCT text_hash FROM items WHERE text_hash IS NOT NULL EXCEPT SELECT text_hash FROM items WHERE doc_id % 3 = 0)", ITEMS))
def a22(spark, sf_dir):
    items = _items(spark, sf_dir)
    return I.uncached(items, items.where("doc_id % 3 = 0").select("text_hash")).agg(F.count("*").alias("calls"))


# ---- windows, top-k, sets ----------------------------------------------------------------------------------------


@register("w1_best_surface", query("SELECT item_id, entity_id, surface_form, confidence FROM (SELECT *, row_number() OVER (PARTITION BY item_id, entity_id ORDER BY confidence DESC, surface_form) AS k FROM item_entities) WHERE k = 1", ITEMS, _ITEM_ENTITIES))
def w1(spark, sf_dir):
    return I.best_surface(_item_entities(spark, sf_dir))


@register("t1k_top_pairs", query("SELECT src_item_id, dst_item_id, basis_edge_type, round(time_delta_seconds, 6) AS time_delta_seconds FROM cocluster ORDER BY time_delta_seconds, src_item_id, dst_item_id, basis_edge_type LIMIT 10", ITEMS, PAIRS, COCLUSTER))
def t1k(spark, sf_dir):
    rows = P.temporal_cocluster(_pairs(spark, sf_dir)).select("src_item_id", "dst_item_id", "basis_edge_type", _r("time_delta_seconds", "time_delta_seconds"))
    return rows.orderBy("time_delta_seconds", "src_item_id", "dst_item_id", "basis_edge_type").limit(10)


@register("t2k_largest_narratives", query("SELECT narrative_id, count(DISTINCT i.author_native_id)::BIGINT AS distinct_authors, count(*)::BIGINT AS size FROM members m JOIN items i ON i.item_id = m.item_id GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 5", ITEMS, MEMBERS))
def t2k(spark, sf_dir):
    items = _items(spark, sf_dir)
    found, _ = graph.narratives(items, P.hash_pool(items, ("text", "media")))
    return found.select("narrative_id", "distinct_authors", "size").orderBy(F.desc("distinct_authors"), F.desc("size"), "narrative_id").limit(5)


@register("t3k_loudest_entities", query("SELECT m.narrative_id, s.entity_id, count(*)::BIGINT AS total FROM members m JOIN stance s ON s.item_id = m.item_id GROUP BY ALL ORDER BY total DESC, narrative_id, entity_id LIMIT 5", ITEMS, STANCE, MEMBERS))
def t3k(spark, sf_dir):
    entities = _items(spark, sf_dir).select("item_id", F.col("lang").alias("entity_id"))
    rows = U.narrative_stance(_members(spark, sf_dir), entities, adapter.stance_edges(spark, sf_dir))
    total = (F.col("positive_count") + F.col("negative_count") + F.col("neutral_count")).alias("total")
    return rows.select("narrative_id", "entity_id", total).where("total > 0").orderBy(F.desc("total"), "narrative_id", "entity_id").limit(5)


@register("t4k_next_candidates", query("SELECT item_id FROM items WHERE text_hash IS NOT NULL AND doc_id % 3 <> 0 ORDER BY item_id LIMIT 25", ITEMS))
def t4k(spark, sf_dir):
    items = _items(spark, sf_dir)
    return I.unprocessed(items, items.where("doc_id % 3 = 0").select("item_id"), limit=25).select("item_id")


@register("u1_hash_union", query("SELECT item_id, 'text' AS field, text_hash AS hash FROM items WHERE text_hash IS NOT NULL UNION ALL SELECT item_id, 'media', media_hash FROM items WHERE media_hash IS NOT NULL", ITEMS))
def u1(spark, sf_dir):
    return P.hash_pool(_items(spark, sf_dir), ("text", "media")).select("item_id", "field", "hash")


@register("u2_endpoints", query("SELECT item_id FROM ends", ITEMS, PAIRS, _ENDS))
def u2(spark, sf_dir):
    return I.sharing(_pool(spark, sf_dir))


@register("p3_clustered_by_edges", query("SELECT item_id, lang FROM items WHERE item_id IN (SELECT item_id FROM ends)", ITEMS, PAIRS, _ENDS))
def p3b(spark, sf_dir):
    """The same over given edges, as where they were collected."""
    return I.clustered(_items(spark, sf_dir), _edges(spark, sf_dir)).select("item_id", "lang")


@register("u3_both_polarities", query("SELECT author_native_id FROM items i JOIN stance s ON s.item_id = i.item_id WHERE polarity = 'positive' INTERSECT SELECT author_native_id FROM items i JOIN stance s ON s.item_id = i.item_id WHERE polarity = 'negative'", ITEMS, STANCE))
def u3(spark, sf_dir):
    rows = adapter.stance_edges(spark, sf_dir).join(_items(spark, sf_dir).select("item_id", "author_native_id"), "item_id")
    side = lambda p: rows.where(F.col("polarity") == p).select("author_native_id")
    return side("positive").intersect(side("negative"))


@register("u5_first_of_each", "SELECT role, text FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn, text) AS k FROM conversations) WHERE k = 1")
def u5(spark, sf_dir):
    talk = adapter.table(spark, sf_dir, "conversations")
    w = Window.partitionBy("role").orderBy("conv_id", "turn", "text")
    return talk.withColumn("k", F.row_number().over(w)).where("k = 1").select("role", "text")


# ---- scalar functions --------------------------------------------------------------------------------------------


@register("f1_normalize_text", query("SELECT item_id, text_normalized FROM items", ITEMS))
def f1(spark, sf_dir):
    return _items(spark, sf_dir).select("item_id", "text_normalized")


@register("f2_normalize_name", "SELECT p_partkey, lower(trim(regexp_replace('  ' || upper(p_name) || ' ', '\\s+', ' ', 'g'))) AS name FROM part")
def f2(spark, sf_dir):
    return adapter.table(spark, sf_dir, "part").select("p_partkey", T.normalize_name(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).alias("name"))


@register("f4_text_hash", query("SELECT item_id, text_hash FROM items", ITEMS))
def f4(spark, sf_dir):
    return I.enrich(_items(spark, sf_dir).drop("text_hash", "text_normalized")).select("item_id", "text_hash")


@register("f5_media_hash", "SELECT conv_id, CASE WHEN count(*) FILTER (WHERE text <> '') > 0 THEN sha256(string_agg(text, ':' ORDER BY turn, text) FILTER (WHERE text <> '')) END AS media_hash FROM conversations GROUP BY 1")
def f5(spark, sf_dir):
    refs = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"])
    return adapter.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(T.media_hash(refs).alias("media_hash"))


_SCRIPT = """SELECT doc_id, CASE WHEN la + de + ar = 0 THEN NULL
  WHEN la >= 0.85 * (la + de + ar) AND de + ar < 20 THEN 'latin' WHEN de >= 0.85 * (la + de + ar) AND la + ar < 20 THEN 'devanagari'
  WHEN ar >= 0.85 * (la + de + ar) AND la + de < 20 THEN 'arabic' ELSE 'mixed' END AS script
FROM (SELECT doc_id, length(text) - length(regexp_replace(text, '[A-Za-zÀ-ɏ]', '', 'g')) AS la, length(text) - length(regexp_replace(text, '[ऀ-ॿ]', '', 'g')) AS de,
             length(text) - length(regexp_replace(text, '[؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]', '', 'g')) AS ar FROM documents)"""


@register("f6_script", _SCRIPT)
def f6(spark, sf_dir):
    return adapter.table(spark, sf_dir, "documents").select("doc_id", T.script(F.col("text")).alias("script"))


_COUNTED = ", ".join(f"len(list_filter(w, lambda x: list_contains([{', '.join(repr(c) for c in common)}], x))) AS n_{la}" for la, common in T.COMMON_WORDS.items())
_LATIN = " ".join(f"WHEN n_{la} = greatest(n_de, n_en, n_es, n_fr) THEN '{la}'" for la in T.COMMON_WORDS)


@register("f7_language", f"""SELECT doc_id, CASE WHEN length(text) >= 10 THEN CASE script WHEN 'latin' THEN CASE WHEN greatest(n_de, n_en, n_es, n_fr) > 0 THEN CASE {_LATIN} END END
  WHEN 'devanagari' THEN 'hi' WHEN 'arabic' THEN CASE WHEN regexp_matches(text, '[ٹڈڑںھے]') THEN 'ur' ELSE 'ar' END END END AS language_detected
FROM (SELECT d.doc_id, d.text, s.script, {_COUNTED} FROM (SELECT doc_id, text, string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}]+') AS w FROM documents) d JOIN ({_SCRIPT}) s ON s.doc_id = d.doc_id)""")
def f7(spark, sf_dir):
    return adapter.table(spark, sf_dir, "documents").select("doc_id", T.language(F.col("text")).alias("language_detected"))


@register("f8_entities", r"""SELECT doc_id, array_to_string(regexp_extract_all(text, 'https?://\S+'), ' ') AS urls, array_to_string(regexp_extract_all(text, '#[\p{L}\p{N}_]+'), ' ') AS hashtags,
  array_to_string(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_.])(@[\p{L}\p{N}_.]+)', 1), ' ') AS mentions FROM documents""")
def f8(spark, sf_dir):
    found = adapter.table(spark, sf_dir, "documents").select("doc_id", T.entities(F.col("text")).alias("e"))
    return found.select("doc_id", *[F.array_join(f"e.{c}", " ").alias(c) for c in ("urls", "hashtags", "mentions")])


@register("f12_duration", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 3) * 3600 + (event_id % 50) * 60 + event_id % 60 END::BIGINT AS seconds FROM events")
def f12(spark, sf_dir):
    n = F.col("event_id")
    part = lambda m, unit: F.concat((n % m).cast("string"), F.lit(unit))
    iso = F.when(n % 5 == 0, F.lit("P1D")).otherwise(F.concat(F.lit("PT"), part(3, "H"), part(50, "M"), part(60, "S")))
    return adapter.table(spark, sf_dir, "events").select("event_id", records.duration_seconds(iso).alias("seconds"))


@register("f15_title_text", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 4 = 1 THEN n_name ELSE n_name || chr(10) || chr(10) || 'about ' || n_name END AS text FROM nation")
def f15(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    title = F.when(k == 0, F.lit(" ")).otherwise(F.col("n_name"))
    about = F.when(k == 0, F.lit("")).when(k > 1, F.concat(F.lit("about "), "n_name", F.lit(" ")))
    return adapter.table(spark, sf_dir, "nation").select("n_nationkey", records.title_text(title, about).alias("text"))


@register("f16_parse_time", "SELECT event_id, CASE WHEN event_id % 7 > 0 THEN ts END AS at FROM events")
def f16(spark, sf_dir):
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    text = F.when(F.col("event_id") % 14 == 0, F.lit("")).when(F.col("event_id") % 7 == 0, F.lit("no time")).otherwise(iso)
    return adapter.table(spark, sf_dir, "events").select("event_id", records.parse_time(text).cast("timestamp_ntz").alias("at"))


@register("f17_months_ago", "SELECT o_orderkey, (o_orderdate::DATE - to_months((o_orderkey % 14)::INT))::DATE::VARCHAR AS since FROM orders")
def f17(spark, sf_dir):
    return adapter.table(spark, sf_dir, "orders").select("o_orderkey", F.add_months(F.col("o_orderdate").cast("date"), -(F.col("o_orderkey") % 14).cast("int")).cast("string").alias("since"))


@register("f18_account_age", "SELECT o_orderkey, round((epoch(TIMESTAMP '2030-01-01') - epoch(o_orderdate)) / 86400, 6) AS days FROM orders")
def f18(spark, sf_dir):
    age = records.account_age_days(F.lit("2030-01-01").cast("timestamp"), F.col("o_orderdate").cast("timestamp"))
    return adapter.table(spark, sf_dir, "orders").select("o_orderkey", _r(age, "days"))


@register("f14_url_ids", r"SELECT page_id, CASE WHEN u LIKE 'https://youtu.be/%' AND length(split_part(u, '/', 4)) >= 6 THEN split_part(u, '/', 4) END AS video, CASE WHEN u LIKE 'https://youtube.com/channel/%' THEN split_part(u, '/', 5) END AS channel FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://youtu.be/abc-' || page_id WHEN page_id % 3 = 1 THEN 'https://youtube.com/channel/ch_' || page_id ELSE url END AS u FROM pages)")
def f14(spark, sf_dir):
    n = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://youtu.be/abc-"), n)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://youtube.com/channel/ch_"), n)).otherwise(F.col("url"))
    return adapter.table(spark, sf_dir, "pages").select("page_id", records.video_id(url).alias("video"), records.channel_id(url).alias("channel"))


@register("f20_epoch_delta", "SELECT user_id, event_id, round(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 6) AS delta FROM events")
def f20(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = adapter.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select("user_id", "event_id", _r(T.seconds_between(F.col("ts"), F.lag("ts").over(w)), "delta"))


@register("f21_json_path", "SELECT event_id, (props->>'$.k')::BIGINT AS k, props->>'$.absent' AS absent FROM events")
def f21(spark, sf_dir):
    return adapter.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.absent").alias("absent"))


@register("f22_struct_json", query("SELECT src_item_id, dst_item_id, edge_type, hash AS shared_hash, NULL::VARCHAR AS missing FROM pairs", ITEMS, PAIRS))
def f22(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("src_item_id", "dst_item_id", "edge_type", F.col("hash").alias("shared_hash"), F.lit(None).cast("string").alias("missing"))
    keep = P.as_edges(rows)
    return keep.select("src_item_id", "dst_item_id", "edge_type", F.get_json_object("evidence", "$.shared_hash").alias("shared_hash"), F.get_json_object("evidence", "$.missing").alias("missing"))


@register("f25_clamp", "SELECT event_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 100 - 1)) AS x FROM events")
def f25(spark, sf_dir):
    return adapter.table(spark, sf_dir, "events").select("event_id", T.clamp01(F.col("value") / 100 - 1).alias("x"))


@register("f26_pair_key", query("SELECT least(src_item_id, dst_item_id) || '|' || greatest(src_item_id, dst_item_id) AS pair_key FROM pairs", ITEMS, PAIRS))
def f26(spark, sf_dir):
    return _pairs(spark, sf_dir).select(T.pair_key(F.col("dst_item_id"), F.col("src_item_id")).alias("pair_key"))


_LCS = r"""SELECT a, b, round(200.0 * list_reduce(list_prepend([0 for j in range(length(b) + 1)], [[ascii(x)] for x in string_split(a, '')]),
  lambda prev, x: list_reduce(list_prepend([0], [[j] for j in range(1, length(b) + 1)]),
    lambda done, j: done || [CASE WHEN ascii(substr(b, j[1]::INT, 1)) = x[1] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], done[j[1]]) END]))[-1] / (length(a) + length(b)), 6) AS ratio
FROM (SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_name < y.n_name)"""


@register("f27_indel_ratio", _LCS)
def f27(spark, sf_dir):
    n = adapter.table(spark, sf_dir, "nation")
    pairs = n.select(F.col("n_name").alias("a"), "n_regionkey").join(n.select(F.col("n_name").alias("b"), "n_regionkey"), "n_regionkey").where("a < b")
    return pairs.select("a", "b", _r(fuzzy.ratio(F.col("a"), F.col("b")), "ratio"))


_VARIANT = "CASE WHEN p_partkey % 3 = 0 THEN upper(left(p_type, 1)) || p_name WHEN p_partkey % 3 = 1 THEN lower(p_brand) || ' ' || p_name ELSE lower(p_type) || ' ' || split_part(p_name, ' ', 2) END"


@register("f28_token_set_ratio", query("SELECT p.p_partkey, p.a, p.b, round(s.score, 6) AS score FROM variants p JOIN scores s ON s.a = p.a AND s.b = p.b", f"variants AS (SELECT p_partkey, p_name AS a, {_VARIANT} AS b FROM part), compared AS (SELECT DISTINCT a, b FROM variants)", TOKEN_SET))
def f28(spark, sf_dir):
    """Each name against a variant of its own."""
    names = adapter.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.expr(_VARIANT).alias("b"))
    return names.select("p_partkey", "a", "b", _r(fuzzy.token_set_ratio(F.col("a"), F.col("b")), "score"))


@register("f31_author_parts", query("SELECT item_id, source_type, author_native_id AS native_id FROM items", ITEMS))
def f31(spark, sf_dir):
    rows = _items(spark, sf_dir).select("item_id", records.author_parts(F.concat_ws(":", "source_type", "author_native_id")).alias("p"))
    return rows.select("item_id", "p.*")


# ---- graph and resolution ----------------------------------------------------------------------------------------


@register("g1_components", query("SELECT narrative_id, item_id FROM members", ITEMS, MEMBERS))
def g1(spark, sf_dir):
    return _members(spark, sf_dir)


@register("g2_rebuild_basis", query("SELECT narrative_id, 'tight' AS basis FROM members GROUP BY 1 UNION ALL SELECT 'loose:1', 'loose'", ITEMS, MEMBERS))
def g2(spark, sf_dir):
    old = spark.createDataFrame([("tight:stale", "tight"), ("loose:1", "loose")], "narrative_id string, basis string")
    new = _members(spark, sf_dir).select("narrative_id").distinct().withColumn("basis", F.lit("tight"))
    return graph.replace_basis(old, new, "tight")


def _mentions(spark, sf_dir) -> DataFrame:
    rows = _items(spark, sf_dir)
    name = F.concat(F.lit("Lang "), F.upper("lang"))
    form = F.when(F.col("doc_id") % 2 == 0, name).otherwise(F.col("lang"))
    return rows.select("item_id", F.lit(0).alias("position"), form.alias("surface_form"), name.alias("canonical_name"), F.lit("Topic").alias("entity_type_guess"), F.lit(0.9).alias("confidence"))


_ENTITY = "entity_id string, canonical_name string, canonical_name_normalized string, entity_type string, created_from string, observation_count long"
_ALIAS = "surface_form_normalized string, surface_form string, entity_id string"


@register("e1_resolve_mentions", query("SELECT 'Lang ' || upper(lang) AS canonical_name, 'other' AS entity_type, count(*)::BIGINT AS observation_count, count(DISTINCT doc_id % 2)::BIGINT AS n_aliases FROM items GROUP BY lang", ITEMS))
def e1(spark, sf_dir):
    found = R.resolve(_mentions(spark, sf_dir), spark.createDataFrame([], _ENTITY), spark.createDataFrame([], _ALIAS))
    forms = found["aliases"].groupBy("entity_id").agg(F.count("*").alias("n_aliases"))
    return found["entities"].join(forms, "entity_id").select("canonical_name", F.when(F.col("entity_type") == "Topic", "topic").otherwise(F.col("entity_type")).alias("entity_type"), "observation_count", "n_aliases")


@register("e2_extract_once", query("SELECT item_id, string_split(text_normalized, ' ')[1] AS surface_form FROM items WHERE text_hash IS NOT NULL AND doc_id % 3 <> 0", ITEMS))
def e2(spark, sf_dir):
    """Unprocessed items; the provider is asked once for each content that the cache lacks, its answer joins back."""
    items = _items(spark, sf_dir)
    first = F.split("text_normalized", " ")[0]
    cache = items.where("doc_id % 3 = 0 and text_hash is not null").groupBy("text_hash").agg(F.min(first).alias("surface_form"))
    todo = I.unprocessed(items, items.where("doc_id % 3 = 0").select("item_id"))
    asked = I.uncached(todo, cache).join(todo.groupBy("text_hash").agg(F.min("text_normalized").alias("text")), "text_hash")
    new = I.provider_answers(asked, "text_hash string, surface_form string", lambda row: [{"text_hash": row["text_hash"], "surface_form": row["text"].split(" ")[0]}])
    return todo.select("item_id", "text_hash").join(cache.unionByName(new), "text_hash").select("item_id", "surface_form")


@register("e3_insert_absent", query("SELECT text_hash, min(item_id) AS item_id FROM items WHERE text_hash IS NOT NULL GROUP BY 1", ITEMS))
def e3(spark, sf_dir):
    rows = _items(spark, sf_dir).where("text_hash is not null").select("text_hash", "item_id")
    return I.insert_absent(spark.createDataFrame([], "text_hash string, item_id string"), rows, ["text_hash"], ["item_id"])


@register("e8_stance_results", query("SELECT i.item_id, i.lang AS entity_id, coalesce(s.polarity, 'neutral') AS polarity, coalesce(s.strength, 0) AS strength, s.polarity IS NULL AS gap FROM items i LEFT JOIN stance s ON s.item_id = i.item_id", ITEMS, STANCE))
def e8(spark, sf_dir):
    pending = _items(spark, sf_dir).select("item_id", F.col("lang").alias("entity_id"))
    answers = adapter.stance_edges(spark, sf_dir).withColumn("confidence", F.lit(1.0))
    return R.stance_results(pending, answers).drop("confidence")


# ---- incremental features ----------------------------------------------------------------------------------------


@register("r1_high_water_marks", "SELECT event_type AS source, user_id::VARCHAR AS key, max(event_id) AS mark FROM events GROUP BY ALL")
def r1(spark, sf_dir):
    rows = adapter.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"))
    old = collection.advance(spark.createDataFrame([], "source string, key string, mark long"), rows.where("id % 2 = 0"))
    return collection.advance(old, rows)


@register("r2_beyond_mark", "SELECT e.event_id AS id FROM events e LEFT JOIN (SELECT event_type, max(event_id) AS mark FROM events WHERE event_id % 10 = 0 AND event_id < 500 GROUP BY 1) m ON m.event_type = e.event_type WHERE m.mark IS NULL OR e.event_id > m.mark")
def r2(spark, sf_dir):
    rows = adapter.table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.lit("all").alias("key"), F.col("event_id").alias("id"))
    marks = collection.advance(spark.createDataFrame([], "source string, key string, mark long"), rows.where("id % 10 = 0 and id < 500"))
    return collection.beyond(rows, marks).select("id")


@register("r3_stream_collect", "SELECT count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM events")
def r3(spark, sf_dir):
    base = scratch(spark, "stream")
    events = adapter.table(spark, sf_dir, "events")
    events.repartition(3).write.parquet(f"{base}/in")
    collection.collect(spark, f"{base}/in", events.schema, f"{base}/out", f"{base}/marks")
    return spark.read.parquet(f"{base}/out").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@register("r5_quota_budget", "SELECT queue, place, spent FROM (SELECT user_id AS queue, event_id AS place, sum(1 + event_id % 3) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS spent FROM events) WHERE spent <= 20")
def r5(spark, sf_dir):
    work = adapter.table(spark, sf_dir, "events").select(F.col("user_id").alias("queue"), F.col("event_id").alias("place"), (F.col("event_id") % 3 + 1).alias("cost"))
    return collection.within_budget(work, 20).select("queue", "place", "spent")


@register("r6_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start_at, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def r6(spark, sf_dir):
    rows = adapter.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return collection.windowed_counts(rows).select(F.col("window.start").cast("timestamp_ntz").alias("start_at"), "event_type", "n", F.round("total", 4).alias("total"))


# ---- output queries ----------------------------------------------------------------------------------------------


@register("q1_entity_topics", query("SELECT s.entity_id, m.narrative_id, date_trunc('day', i.published_at)::TIMESTAMP AS day, s.polarity, count(*)::BIGINT AS n FROM stance s JOIN members m ON m.item_id = s.item_id JOIN items i ON i.item_id = s.item_id GROUP BY ALL", ITEMS, STANCE, MEMBERS))
def q1(spark, sf_dir):
    items = _items(spark, sf_dir).select("item_id", F.date_trunc("day", "published_at").cast("timestamp_ntz").alias("day"))
    rows = adapter.stance_edges(spark, sf_dir).join(_members(spark, sf_dir), "item_id").join(items, "item_id")
    return rows.groupBy("entity_id", "narrative_id", "day", "polarity").agg(F.count("*").alias("n"))


@register("q2_narrative_overlay", query("SELECT m.narrative_id, count(*) FILTER (WHERE s.polarity = 'positive')::BIGINT AS positive_count, count(*) FILTER (WHERE s.polarity = 'negative')::BIGINT AS negative_count, coalesce(max(c.n), 0)::BIGINT AS synchronous_pairs FROM members m LEFT JOIN stance s ON s.item_id = m.item_id LEFT JOIN (SELECT m.narrative_id, count(*) AS n FROM cocluster c JOIN members m ON m.item_id = c.src_item_id GROUP BY 1) c ON c.narrative_id = m.narrative_id GROUP BY 1", ITEMS, STANCE, PAIRS, COCLUSTER, MEMBERS))
def q2(spark, sf_dir):
    members = _members(spark, sf_dir)
    stance = members.join(adapter.stance_edges(spark, sf_dir), "item_id", "left").groupBy("narrative_id").agg(*U.polarity_counts()[:2])
    near = P.temporal_cocluster(_pairs(spark, sf_dir)).join(members, F.col("src_item_id") == F.col("item_id")).groupBy("narrative_id").agg(F.count("*").alias("n"))
    return stance.join(near, "narrative_id", "left").select("narrative_id", "positive_count", "negative_count", F.coalesce("n", F.lit(0)).alias("synchronous_pairs"))


@register("q3_entity_authors", query("SELECT entity_id, side, author_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, side ORDER BY round(score, 9) DESC, author_id) AS k FROM (SELECT *, abs(net_stance) * stance_consistency * ln(volume) * narrative_spread AS score, CASE WHEN net_stance > 0 THEN 'positive' ELSE 'negative' END AS side FROM profiles WHERE volume > 0 AND net_stance <> 0)) WHERE k <= 5", ITEMS, STANCE, MEMBERS, PROFILES))
def q3(spark, sf_dir):
    return U.entity_authors(_profiles(spark, sf_dir), 5).select("entity_id", "side", "author_id", _r("score", "score"))


@register("q4_author_history", query("SELECT author_id, entity_id, volume, round(net_stance, 9) AS net_stance FROM profiles WHERE author_id = (SELECT min(author_id) FROM profiles)", ITEMS, STANCE, MEMBERS, PROFILES))
def q4(spark, sf_dir):
    profiles = cut(_profiles(spark, sf_dir), "profiles")
    who = profiles.agg(F.min("author_id")).first()[0]
    return U.author_history(profiles, who).select("author_id", "entity_id", "volume", F.round("net_stance", 9).alias("net_stance"))


@register("x_first_posters", query("SELECT m.narrative_id, m.item_id, rank() OVER (PARTITION BY m.narrative_id ORDER BY i.published_at)::INT AS place FROM members m JOIN items i ON i.item_id = m.item_id", ITEMS, MEMBERS))
def x_first(spark, sf_dir):
    return U.first_posters(_members(spark, sf_dir), _items(spark, sf_dir)).select("narrative_id", "item_id", "place")


@register("x_follower_velocity", "SELECT 'u' || user_id AS node_item_id, event_id AS view_count, round(value)::BIGINT - lag(round(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS change FROM events")
def x_velocity(spark, sf_dir):
    return U.velocity(adapter.observations(spark, sf_dir)).select("node_item_id", "view_count", "change")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with equal content by different authors within a day: the co-cluster edges."""
    return j3(spark, sf_dir)
