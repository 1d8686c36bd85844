"""Enrichment of items, and selection of those that a pass still has to see."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T


def enrich(items: DataFrame, language: Callable[[Column, Column], Column] = T.language) -> DataFrame:
    """Fill text_normalized, script, language_detected and the text hash where they are unset."""
    have = set(items.columns)
    old = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    normalized = F.coalesce(old("text_normalized"), T.normalize_text(F.col("text")))
    script = F.coalesce(old("script"), T.script(F.col("text")))
    rows = items.withColumns({"text_normalized": normalized, "script": script})
    return rows.withColumns({"language_detected": F.coalesce(old("language_detected"), language(F.col("text"), F.col("script"))), "text_hash": F.coalesce(old("text_hash"), T.text_hash(F.col("text_normalized")))})


def with_text(items: DataFrame) -> DataFrame:
    return items.where("text is not null and text_hash is not null")


def endpoints(edges: DataFrame) -> DataFrame:
    """Items at either end of an edge."""
    return edges.select(F.col("src_item_id").alias("item_id")).union(edges.select("dst_item_id")).where("item_id is not null").distinct()


def clustered(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Items at an end of a derived edge."""
    return items.join(endpoints(edges.where("origin = 'derived'")), "item_id", "left_semi")


def sharing(pool: DataFrame) -> DataFrame:
    """Items that share a hash of the pool with another: the ends of its pairs, found without making pairs."""
    keyed = pool.select("item_id", F.when(F.col("field") == "media", "media").otherwise("text").alias("family"), "hash")
    shared = keyed.groupBy("family", "hash").agg(F.min("item_id").alias("least"), F.max("item_id").alias("most")).where("least <> most").select("family", "hash")
    return keyed.join(shared, ["family", "hash"], "left_semi").select("item_id").distinct()


def qualified_edges(edges: DataFrame, items: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Derived edges of the types with both ends among the items."""
    ids = items.select("item_id")
    some = edges.where((F.col("origin") == "derived") & F.col("edge_type").isin(*types))
    some = some.join(ids.withColumnRenamed("item_id", "src_item_id"), "src_item_id", "left_semi")
    return some.join(ids.withColumnRenamed("item_id", "dst_item_id"), "dst_item_id", "left_semi")


def unprocessed(items: DataFrame, status: DataFrame, limit: int | None = None) -> DataFrame:
    left = with_text(items).join(status.select("item_id"), "item_id", "left_anti")
    return left if limit is None else left.orderBy("item_id").limit(limit)


def pending_pairs(item_entities: DataFrame, done: DataFrame) -> DataFrame:
    """(item, entity) pairs without a result; by pair, since equal counts may hide different entities."""
    return item_entities.select("item_id", "entity_id").distinct().join(done.select("item_id", "entity_id"), ["item_id", "entity_id"], "left_anti")


def counts_behind(item_entities: DataFrame, done: DataFrame) -> DataFrame:
    """Items with fewer distinct results than distinct entities."""
    want = item_entities.groupBy("item_id").agg(F.countDistinct("entity_id").alias("wanted"))
    have = done.groupBy("item_id").agg(F.countDistinct("entity_id").alias("found"))
    return want.join(have, "item_id", "left").where("found is null or found < wanted").select("item_id", "wanted", F.coalesce("found", F.lit(0)).alias("found"))


def uncached(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct content hashes that no cache entry answers; an empty answer counts as one."""
    return items.select("text_hash").where("text_hash is not null").distinct().join(cache.select("text_hash"), "text_hash", "left_anti")


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Existing rows and, for each new key, its first new row by ``order``; existing keys win."""
    first = Window.partitionBy(*keys).orderBy(*order)
    fresh = new.join(existing.select(*keys), keys, "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return existing.unionByName(fresh, allowMissingColumns=True)


def best_surface(item_entities: DataFrame) -> DataFrame:
    """Surface form of highest confidence of each entity of an item; ties by the form."""
    w = Window.partitionBy("item_id", "entity_id").orderBy(F.desc("confidence"), "surface_form")
    return item_entities.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def provider_answers(rows: DataFrame, schema: str, answer: Callable[[dict], list[dict]]) -> DataFrame:
    """Ask a provider (extractor, stance detector, transcripts) once a row, in batches of rows on the executors."""
    import pandas as pd

    names = [part.split()[0] for part in schema.split(",")]

    def run(frames):
        for frame in frames:
            found = [r for row in frame.to_dict("records") for r in answer(row)]
            yield pd.DataFrame(found, columns=names)

    return rows.mapInPandas(run, schema)


def report(items: DataFrame, counted: dict[str, str], top: dict[str, tuple[str, int]]) -> DataFrame:
    """(section, name, n): what a run prints: counts of each value of some columns, and the commonest values of others."""
    by = lambda section, c: items.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "name", "n")
    parts = [by(section, c) for section, c in counted.items()]
    parts += [by(section, c).orderBy(F.desc("n"), "name").limit(k) for section, (c, k) in top.items()]
    return reduce(DataFrame.unionByName, parts)
