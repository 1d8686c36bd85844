"""Narratives: connected components of items that share content.

Components are found on the bipartite graph of items and hashes, which has an edge for
each hash an item holds.  It has the same components as the graph of all equal pairs,
without its quadratic number of edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import semantic
from loomgraph.session import cut


def components(memberships: DataFrame) -> DataFrame:
    """(item_id, hash) -> (item_id, label): the smallest item id of each component; lone items are left out.

    A round takes the least label of each hash's items, then of each item's hashes, then the
    label of that label.  Each round is written, so lineage stays short.
    """
    shared = memberships.groupBy("hash").agg(F.count_distinct("item_id").alias("n")).where("n > 1").select("hash")
    links = cut(memberships.select("item_id", "hash").distinct().join(shared, "hash"), "links")
    labels = cut(links.select("item_id", F.col("item_id").alias("label")).distinct(), "labels")
    while True:  # labels only fall, so this ends; jumps halve what is left
        least = links.join(labels, "item_id").groupBy("hash").agg(F.min("label").alias("least"))
        near = links.join(least, "hash").groupBy("item_id").agg(F.min("least").alias("near"))
        at = labels.select(F.col("item_id").alias("near"), F.col("label").alias("jump"))
        new = labels.join(near, "item_id").join(at, "near", "left")
        new = cut(new.select("item_id", F.least("label", "near", "jump").alias("label"), F.col("label").alias("old")), "labels")
        labels = new.select("item_id", "label")
        if new.where("label <> old").isEmpty():
            return labels


def narratives(items: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(narratives, members) of the tight basis: id, time range, size and distinct authors of each component."""
    found = components(pool.select("item_id", F.concat_ws(":", F.when(F.col("field") == "media", "m").otherwise("t"), "hash").alias("hash")))
    members = found.select(F.concat(F.lit("tight:"), "label").alias("narrative_id"), "item_id")
    facts = members.join(items.select("item_id", "author_native_id", "published_at"), "item_id")
    summary = facts.groupBy("narrative_id").agg(F.min("published_at").alias("time_range_start"), F.max("published_at").alias("time_range_end"), F.count("*").alias("size"), F.count_distinct("author_native_id").alias("distinct_authors"))
    return summary.withColumn("basis", F.lit("tight")), members


def labels(members: DataFrame, items: DataFrame, item_names: DataFrame, longest: int = 80) -> DataFrame:
    """narrative_id, label: the two commonest entity names (count, then name), else the longest text's beginning.

    ``items``: item_id, text; ``item_names``: item_id, name.
    """
    from loomgraph.functions.text import collapse

    counted = members.join(item_names.select("item_id", "name").distinct(), "item_id").groupBy("narrative_id", "name").agg(F.count("*").alias("n"))
    place = Window.partitionBy("narrative_id").orderBy(F.desc("n"), "name")
    top = counted.withColumn("place", F.row_number().over(place)).where("place <= 2")
    names = top.groupBy("narrative_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda t: t["name"]), " / ").alias("names"))
    texts = members.join(items.select("item_id", F.nullif(collapse(F.col("text")), F.lit("")).alias("t")), "item_id")
    best = texts.where("t is not null").groupBy("narrative_id").agg(F.min(F.struct((-F.length("t")).alias("k"), "item_id", F.left("t", F.lit(longest)).alias("head"))).alias("best"))
    snippet = F.concat("best.head", F.when(-F.col("best.k") > longest, F.lit("...")).otherwise(F.lit("")))
    each = members.select("narrative_id").distinct().join(names, "narrative_id", "left").join(best, "narrative_id", "left")
    return each.select("narrative_id", F.coalesce("names", snippet, F.lit("(no text)")).alias("label"))


def replace_basis(existing: DataFrame, new: DataFrame, basis: str) -> DataFrame:
    """The table with one basis rebuilt."""
    return existing.where(F.col("basis") != basis).unionByName(new.where(F.col("basis") == basis))


def semantic_links(vectors: DataFrame, threshold: float, item: str = "item_id", vector: str = "vector", *, tables: int = 24, bits: int = 10, seed: int = 11) -> DataFrame:
    """(a, b, cosine): pairs of items whose vectors have a cosine of at least ``threshold``, each pair once.

    Candidates share the signs of ``bits`` random projections in one of ``tables``; at a cosine
    of 0.95 a pair misses all 24 with probability 3e-5.  Candidates are compared exactly.
    Equal vectors meet as one, so copies make no pairs of candidates.
    """
    import numpy as np
    import pandas as pd

    def keyed(frames):
        for frame in frames:
            if len(frame):
                x = np.array(frame["v"].tolist(), float)
                sign = x @ np.random.default_rng(seed).normal(size=(x.shape[1], tables * bits)) > 0
                keys = sign.reshape(len(x), tables, bits) @ (1 << np.arange(bits)) + (np.arange(tables) << bits)
                yield pd.DataFrame({"id": frame["id"], "v": frame["v"], "keys": list(keys)})

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select(F.col(item).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(norm > 0)
    same = rows.groupBy("v").agg(F.min("id").alias("id"))
    found = cut(same.select("id", "v").mapInPandas(keyed, "id string, v array<double>, keys array<long>"), "signs")
    sides = {s: found.select(F.col("id").alias(s), F.explode("keys").alias("key")) for s in ("a", "b")}
    pairs = sides["a"].join(sides["b"], "key").where("a < b").select("a", "b").distinct()
    for s in ("a", "b"):
        pairs = pairs.join(found.select(F.col("id").alias(s), F.col("v").alias(f"v_{s}")), s)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    cosine = dot(F.col("v_a"), F.col("v_b")) / F.sqrt(dot(F.col("v_a"), F.col("v_a")) * dot(F.col("v_b"), F.col("v_b")))
    near = pairs.select("a", "b", cosine.alias("cosine")).where(F.col("cosine") >= threshold)
    copies = rows.join(same.select(F.col("v").alias("_v"), F.col("id").alias("a")), F.col("v") == F.col("_v")).where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("cosine"))
    return near.unionByName(copies)


def loose_narratives(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(narrative_id, item_id) of the loose basis: components of all pairs with a cosine of at least ``threshold``.

    All vectors are compared, but only links that join groups are kept, see :mod:`loomgraph.operators.semantic`.
    """
    ends = semantic.linking(vectors, threshold).select(F.explode(F.array("a", "b")).alias("item_id"), F.struct("a", "b").alias("hash"))
    return components(ends).select(F.concat(F.lit("loose:"), "label").alias("narrative_id"), "item_id")


#: Clusterers by basis; each returns (narrative_id, item_id).
CLUSTERERS = {"tight": lambda items, pool: narratives(items, pool)[1], "loose": loose_narratives}
