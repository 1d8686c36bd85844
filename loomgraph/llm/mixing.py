"""Mixing sources to target weights by capped water-filling.

Each source gets a share of the mix in proportion to its weight, but never more than
``cap`` times its own size; what a capped source leaves is shared again by weight.
In closed form: sort the sources by ``cap * size / weight``.  If the sources before i
are capped, the others fill to the level ``(total - caps before i) / weights from i``.
That level rises over the capped sources and falls after them, so the water level is
its maximum, and a source's target is ``min(cap * size, weight * level)``.  No loop.

A source's target is then drawn from its documents: every document is taken
``floor(target / size)`` whole times, and the rest comes from the documents in the
order of a seeded hash, until it is used up; the document at the edge is taken in
part.  So each source meets its target to a word.  The order is found without sorting a
source in one task: hash ranges (``ranges`` a source) are summed first, prefix sums over
them find the one range that the edge falls in, and only within ranges are documents
ordered.  A hot source is spread over its ranges.

Edge cases: null or blank text has size 0 and takes 0; a text of any length counts whole; a
null source is a source of its own, last in the order; an empty table gives an empty table;
repeated rows count as rows of their own, and which of equal rows is cut makes no difference;
a row with a null id is placed by its text (``key``), so that many of them spread over the
ranges.  Other columns, of any name, are carried in the struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"


def key(doc_id: Column, text: Column) -> Column:
    """What a document is ordered by: its id, or, where that is null, its text's hash."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def order_hash(key: Column, seed: str = SEED) -> Column:
    """52 bits of md5(seed:key)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target).

    The windows without a partition hold one row for each source, not for each document.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(names) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    most = F.lit(float(cap)) * F.col("source_size")
    ratio = Window.orderBy(F.col("_ratio"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("_most", most)
        .withColumn("_ratio", F.col("_most") / F.col("weight"))
        .withColumn("_level", level)
        .withColumn("target", F.least(F.col("_most"), F.col("weight") * F.max("_level").over(whole)))
        .select("source", "source_size", "weight", "target")
    )


def mix(docs: DataFrame, size: Column, doc_id: str = "doc_id", source: str = "source", *, key: Column | None = None, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, ranges: int = 4096) -> DataFrame:
    """Add ``size, source_size, target, taken`` (words the mix takes) to each row.

    ``key``: what orders a row, the id if not given (see :func:`key`).
    ``docs`` is read twice (sizes, then rows); its columns are kept in a struct, so
    any column names may occur.  Returns ``row`` (the struct) and the four columns.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{source}`").cast("string").alias("source"), size.cast("long").alias("size"), order_hash(F.col(f"`{doc_id}`") if key is None else key, seed).alias("_h"), F.col(f"`{doc_id}`").alias("_id"))
    rows = rows.withColumn("_range", F.shiftright(F.col("_h"), 40) % ranges)
    sums = rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    sizes = sums.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target") - F.col("_times") * F.col("source_size")).cast("long")
    targets = targets.withColumn("_times", times).withColumn("_rest", rest)
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    edge = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    edge = edge.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_sum")
    edge = edge.select(F.col("source").alias("_es"), F.col("_range").alias("_er"), "_before", "source_size", "target", "_times", "_rest")
    joined = rows.join(edge, F.col("source").eqNullSafe(F.col("_es")) & (F.col("_range") == F.col("_er")))
    inside = Window.partitionBy("_es", "_er").orderBy("_h", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    done = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - done))
    return joined.withColumn("taken", (F.col("_times") * F.col("size") + extra).cast("long")).select("row", "size", "source_size", "target", "taken")
