"""Near-duplicate groups by ProbMinHash.

A text is the set of its 5-word shingles (a shorter text is one shingle).  ProbMinHash:
each shingle starts a Poisson process whose rate is its weight and whose points each
fall on one of ``REGISTERS`` registers; a register keeps the shingle of its earliest
point.  A process ends once its next point comes later than all registers' earliest.
Two texts agree in a register with the probability Jaccard similarity of their weighted
shingles.  Each distinct shingle weighs 1, however often it occurs, as this similarity
is then the Jaccard of the sets, which is what is verified.  Bands of ``ROWS`` registers
bring candidates together (at similarity 0.8 all 16 bands miss with probability 2e-4),
and candidates are verified exactly: Jaccard of their shingle sets at least
``SIMILARITY``.

Texts with the same words are one text from the start.  Within a bucket no pairs are
sent: its task takes one text after another that is not yet in the largest group and
compares it to all others at once, and returns each text's group.  Every pair of a
bucket is thus in one group, or compared.  A bucket of over ``CHUNK`` texts is dealt to
chunks that share one text; afterwards what lies outside its largest group is compared, in
blocks of ``BLOCK``, to the whole bucket.  Groups are the components of these links.

Edge cases: texts without words are never near-duplicates; null ids sort last as
representatives; repeated rows are copies; a text of any length is compared whole; other
columns, of any name, are ignored; an empty table gives an empty result.  ``docs`` is scanned
twice and must give its rows in one order, as a file scan does; where the second scan's text
has other words than the first's, an error is raised.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import WordHashes, arrow_map, mix64, small_batches, staged
from loomgraph.llm.graph import components

REGISTERS, ROWS = 64, 4
SHINGLE = 5
SIMILARITY = 0.8
CHUNK = 250
BLOCK = 1000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``size`` word hashes; of all words, if they are fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = mix64(h * _ODD + words[k : k + n])
    return h


def prob_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (docs, registers) of weighted sets; 0 for a set without elements.

    ``doc``: number of the set of each element.  All sets run at once, a point of each live process a round.
    """
    least = np.full(docs * registers, np.inf)
    owner = np.zeros(docs * registers, np.uint32)
    time = np.zeros(len(doc))
    live = np.arange(len(doc))
    step = 0
    while len(live):
        with np.errstate(over="ignore"):
            r = mix64(element[live] + np.uint64(step + 1) * _ODD)
        gap = -np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight[live]
        time[live] += gap
        t = time[live]
        slot = doc[live] * registers + (mix64(r) % np.uint64(registers)).astype(np.int64)
        wins = np.flatnonzero(t < least[slot])
        wins = wins[np.argsort(-t[wins], kind="stable")]  # the last one written to a slot is its earliest
        least[slot[wins]] = t[wins]
        owner[slot[wins]] = (element[live[wins]] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        latest = least.reshape(docs, registers).max(1)
        live = live[t < latest[doc[live]]]
        step += 1
    return owner.reshape(docs, registers)


def _groups(sets: list[np.ndarray], similarity: float, asked: np.ndarray | None = None) -> np.ndarray:
    """Group number of each shingle set, linking sets of at least ``similarity``.

    With ``asked`` (flags) only these are compared to all; else every set outside the largest group is.
    """
    n = len(sets)
    parent = np.arange(n)
    if n < 2:
        return parent
    size = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(size) - size
    mark = np.zeros(int(ids.max()) + 1, bool)
    todo = np.ones(n, bool) if asked is None else asked.copy()
    while True:
        if asked is None:
            largest = np.bincount(parent, minlength=n).argmax()
            left = np.flatnonzero(todo & ((parent != largest) if (parent == largest).sum() > 1 else True))
        else:
            left = np.flatnonzero(todo)
        if not len(left):
            return parent
        a = left[0]
        todo[a] = False
        own = ids[starts[a] : starts[a] + size[a]]
        mark[own] = True
        both = np.add.reduceat(mark[ids].astype(np.int64), starts)
        mark[own] = False
        alike = np.flatnonzero(both >= similarity * (size + size[a] - both) - 1e-9)
        joined = np.unique(parent[alike])
        parent[np.isin(parent, joined)] = joined.min()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, similarity: float = SIMILARITY, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (the least id of its group), keep (true for one document of each group), rid (place in the scan)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed_schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("content", pa.binary()), ("signature", pa.binary())])

    def sign(batches):
        hashes = WordHashes()
        for b in batches:
            words = [(x or "").encode().split() for x in b.column(2).to_pylist()]
            sets = [np.unique(shingles(hashes.of(w))) for w in words]
            n = [len(s) for s in sets]
            signature = prob_min_hash(np.repeat(np.arange(len(n)), n), np.concatenate(sets), np.ones(sum(n)), len(n))
            yield {"rid": b.column(0), "doc_id": b.column(1), "content": [hashlib.md5(b" ".join(w)).digest() if w else None for w in words], "signature": [s.tobytes() if k else None for s, k in zip(signature, n, strict=True)]}

    signed = staged(rows.mapInArrow(arrow_map(sign, signed_schema), "rid long, doc_id long, content binary, signature binary"), "signed")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    texts = signed.where("content is not null").groupBy("content").agg(F.min(rank).alias("least"), F.min("rid").alias("tid"), F.min("signature").alias("signature"))
    texts = staged(texts, "texts")
    width = 4 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda b: F.xxhash64(F.substring("signature", b * width + 1, F.lit(width)), b))
    banded = texts.select("tid", F.explode(keys).alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(tid))").alias("x"), F.expr("bit_xor(xxhash64(tid, 1))").alias("y"), F.min("tid").alias("first")).where("n > 1")
    buckets = buckets.groupBy("n", "x", "y", "first").agg(F.min("key").alias("key"))  # buckets with the same members are one
    members = staged(banded.join(buckets.select("key", "n", "first"), "key"), "members")
    wanted = members.select("tid").distinct().join(texts.select("tid", "content"), "tid")

    def packed(batches):
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            texts = [b" ".join((x or "").encode().split()) for x in b.column(1).to_pylist()]
            yield {"tid": b.column(0), "body": [c.compress(x) for x in texts], "is": [hashlib.md5(x).digest() for x in texts]}

    bodies = rows.select("rid", "text").mapInArrow(arrow_map(packed, pa.schema([("tid", pa.int64()), ("body", pa.binary()), ("is", pa.binary())])), "tid long, body binary, is binary")
    # a merge join at every size: each text moves once, compressed, and what is wanted is never broadcast
    same = F.when(F.col("is") == F.col("content"), F.col("body")).otherwise(F.raise_error(F.lit("a text differs between two scans: the input's rows came in another order")))
    bodies = staged(bodies.join(wanted.hint("merge"), "tid").select("tid", same.alias("body")), "bodies")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    dealt = members.select("key", "n", "first", "tid", F.pmod(F.xxhash64("tid"), chunks).cast("int").alias("chunk"))
    shared = members.where((F.col("n") > chunk) & (F.col("tid") == F.col("first"))).select("key", "n", "first", "tid", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    dealt = dealt.where((F.col("n") <= chunk) | (F.col("tid") != F.col("first"))).unionByName(shared)

    def opened(bodies) -> list[np.ndarray]:
        hashes, d = WordHashes(), zstandard.ZstdDecompressor()
        return [np.unique(shingles(hashes.of(d.decompress(x).split()))) for x in bodies]

    def links(tid: np.ndarray, group: np.ndarray) -> pd.DataFrame:
        least = np.full(len(tid), np.iinfo(np.int64).max)
        np.minimum.at(least, group, tid)
        root = least[group]
        return pd.DataFrame({"a": tid[root != tid], "b": root[root != tid]})

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        return links(part["tid"].to_numpy(), _groups(opened(part["body"]), similarity))

    edges = staged(dealt.join(bodies, "tid").groupBy("key", "chunk").applyInPandas(compare, "a long, b long"), "edges")
    if not members.where(F.col("n") > chunk).isEmpty():
        found = components(edges)
        big = members.where(F.col("n") > chunk).join(found.withColumnRenamed("v", "tid"), "tid", "left").withColumn("label", F.coalesce("label", "tid"))
        largest = big.groupBy("key", "label").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "label")).alias("top"))
        big = big.join(largest, "key").withColumn("outside", F.col("label") != F.col("top.label"))
        out = big.groupBy("key").agg(F.count_if("outside").alias("outs")).where("outs > 0")
        big = big.join(out, "key").select("key", "tid", "outside", F.ceil(F.col("outs") / block).cast("int").alias("rows"), F.ceil(F.col("n") / block).cast("int").alias("cols"))
        deal = lambda side: F.pmod(F.xxhash64("tid", F.lit(side)), F.col(side)).cast("int")
        targets = big.withColumn("col", deal("cols")).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("asks", F.lit(False))
        askers = big.where("outside").withColumn("row", deal("rows")).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))).withColumn("asks", F.lit(True))

        def ask(part: pd.DataFrame) -> pd.DataFrame:
            return links(part["tid"].to_numpy(), _groups(opened(part["body"]), similarity, part["asks"].to_numpy(bool)))

        both = targets.unionByName(askers).groupBy("key", "row", "col", "tid").agg(F.max("asks").alias("asks"))
        more = both.join(bodies, "tid").groupBy("key", "row", "col").applyInPandas(ask, "a long, b long")
        edges = staged(edges.unionByName(more), "edges")
    label = components(edges)
    grouped = texts.select("content", "least", "tid").join(label.withColumnRenamed("v", "tid"), "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    top = grouped.groupBy("label").agg(F.min("least").alias("top"))
    grouped = staged(grouped.join(top, "label").select("content", "top"), "classes")
    done = signed.select("rid", "doc_id", "content").join(grouped, "content", "left")
    return done.select("doc_id", F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("class_id"), F.coalesce(F.col("top.rid") == F.col("rid"), F.lit(True)).alias("keep"), "rid")
