"""Nearest neighbours by largest inner product, with multiprobe p-stable hashing.

Vectors are scaled by the largest norm and given one more coordinate that makes all
norms 1, so the largest inner product with a unit query is the least distance.  A table
has ``FUNCTIONS`` projections on Gaussian (2-stable) directions, cut into slots of
``SLOT``; slots beyond ``REACH`` count as the last, so a table has at most
``(2 * REACH + 1) ** FUNCTIONS`` buckets whatever the data.

A query visits buckets in the order of their estimated success: a neighbour of
similarity s projects near ``s * projection`` with variance ``1 - s * s``, which gives
each bucket the probability that it holds one.  It visits them until their sum reaches
what ``SUCCESS`` over all tables needs.  s is that of the query's own k-th neighbour,
estimated, at the sample's scale, on a bounded sample of ``SAMPLE`` vectors, so that a
query in a dense group visits few buckets and one far from all visits many.
Everything else covers all rows.

Equal vectors are one entry with its ``k + 1`` smallest ids (no more can be needed).
Entries and the queries that visit them meet by table and cell (the slots of the first
functions), in blocks of bounded size on both sides.  Within a block each bucket's entries
are multiplied with the queries that visit this bucket, and with no others.  A block
returns of each query all candidates down to its k-th score, ties included, and the
candidates of all blocks and tables are merged.  Scores are double-precision inner
products of the original vectors.

Edge cases: vectors that are null, zero, or hold a null or non-finite component take no
part, nor do rows with a null id.  Repeated rows are one; of rows with one id and different
vectors the least vector counts.  An inner product needs equal lengths, so the vectors of
each length are searched among themselves.  With fewer candidates than k all that are
found come back; ties go to the smaller id, however many there are.  Other columns, of
any name, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import arrow_map, staged

TABLES, FUNCTIONS, SLOT, REACH = 2, 8, 1.0, 1
SUCCESS = 0.94
SAMPLE = 2000
ENTRY_BLOCK, QUERY_BLOCK = 32_768, 8192
WIDE = 2 * REACH + 1
IN_CELL = WIDE**6  # buckets of a cell


class Hashing:
    """Directions and offsets of all tables; codes of vectors and visits of queries.

    ``sample``: vectors on which the similarity of a query's k-th neighbour is estimated, as that of the ``place``-th there.
    """

    def __init__(self, dim: int, longest: float, sample: np.ndarray, place: int, tables: int = TABLES, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.direction = rng.normal(size=(tables, FUNCTIONS, dim + 1))
        self.offset = rng.uniform(0, SLOT, (tables, FUNCTIONS))
        self.longest, self.sample, self.place, self.tables = longest, sample / longest, place, tables
        self.target = 1 - (1 - SUCCESS) ** (1 / tables)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bucket numbers (tables, vectors)."""
        x = x / self.longest
        more = np.sqrt(np.clip(1 - (x * x).sum(1, keepdims=True), 0, 1))
        at = np.einsum("lkd,nd->lnk", self.direction, np.hstack([x, more]))
        slot = np.clip(np.floor((at + self.offset[:, None, :]) / SLOT), -REACH, REACH).astype(np.int64) + REACH
        return slot @ (WIDE ** np.arange(FUNCTIONS - 1, -1, -1))

    def similarity(self, q: np.ndarray) -> float:
        """Estimate for the k-th neighbour of a unit query; the query itself may be in the sample, so one more is left out."""
        near = self.sample @ q
        place = min(len(near), self.place + 1)
        return float(np.clip(np.partition(near, len(near) - place)[len(near) - place], 0.05, 0.98))

    def visits(self, q: np.ndarray) -> list[np.ndarray]:
        """For each table the buckets that a query visits, likeliest first."""
        q = q / np.linalg.norm(q)
        s = self.similarity(q)
        q = np.append(q, 0.0)
        spread = math.sqrt(max(1e-6, 1 - s * s))
        edge = np.arange(-REACH, REACH + 2) * SLOT
        edge[0], edge[-1] = -np.inf, np.inf
        out = []
        for t in range(self.tables):
            mean = s * (self.direction[t] @ q)
            z = (edge[None, :] - self.offset[t][:, None] - mean[:, None]) / spread
            below = _normal(z)
            chance = np.diff(below, axis=1)
            p = chance[0]
            for k in range(1, FUNCTIONS):
                p = (p[:, None] * chance[k][None, :]).ravel()
            order = np.argsort(-p, kind="stable")
            out.append(order[: int(np.searchsorted(np.cumsum(p[order]), self.target)) + 1])
        return out


def _normal(z: np.ndarray) -> np.ndarray:
    """Normal distribution function (Abramowitz and Stegun 7.1.26, error under 1e-7)."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-np.minimum(x * x, 700))
    return np.where(z >= 0, 1 - tail / 2, tail / 2)


def _sound(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors])


def block_candidates(v: np.ndarray, code: np.ndarray, q: np.ndarray, visited: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, entry, score) numbers of each query's candidates down to its k-th score, and how many products were made.

    ``code``: bucket of each entry; ``visited``: flags (queries, buckets).  Only visited buckets are multiplied.
    """
    order = np.argsort(code, kind="stable")
    bounds = np.flatnonzero(np.append(True, np.diff(code[order]) != 0)) if len(code) else np.zeros(0, np.int64)
    ends = np.append(bounds[1:], len(code))
    step = max(1, (1 << 21) // max(1, len(v)))  # 16 MB of scores at a time
    found, made = [], 0
    for i in range(0, len(q), step):
        scores = np.full((len(q[i : i + step]), len(v)), -np.inf)
        for a, b in zip(bounds, ends, strict=True):
            mine = order[a:b]
            asks = np.flatnonzero(visited[i : i + step, code[mine[0]]])
            if len(asks):
                scores[np.ix_(asks, mine)] = q[i + asks] @ v[mine].T
                made += len(asks) * len(mine)
        most = min(k, scores.shape[1])
        kth = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
        margin = 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0.0)))  # products of a block may be rounded otherwise
        row, col = np.nonzero((scores >= (kth - margin)[:, None]) & (scores > -np.inf))
        found.append((i + row, col, (q[i + row] * v[col]).sum(1)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), made
    return *map(np.concatenate, zip(*found, strict=True)), made


def search(vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", *, tables: int = TABLES, block: int = ENTRY_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best found for each row where ``queries`` (of column vec_id) holds."""
    spark = vectors.sparkSession
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"  # kept as they are until they are compared
    kind = "array<float>" if single else "array<double>"
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast(kind).alias("v")).where(F.col("vec_id").isNotNull() & _sound(F.col("v")))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    place = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("rn", F.row_number().over(place)).where(F.col("rn") <= k + 1)
    entries = staged(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.col("ids")[0]), "entries")
    asked = staged(rows.where(queries).select(F.col("vec_id").alias("query_id"), "v"), "queries")
    found = [_search(entries.where(F.size("v") == dim), asked.where(F.size("v") == dim), dim, k, tables, block, query_block) for dim in sorted(r[0] for r in asked.select(F.size("v")).distinct().collect())]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def _search(entries: DataFrame, asked: DataFrame, dim: int, k: int, tables: int, block: int, query_block: int) -> DataFrame:
    """:func:`search` among vectors of one length: entries (v, ids, entry), asked (query_id, v)."""
    spark = entries.sparkSession
    kind = entries.schema["v"].dataType.simpleString()
    vector = pa.list_(pa.float32() if kind == "array<float>" else pa.float64())
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, longest = entries.agg(F.count("*"), F.max(norm)).first()
    order = F.pmod(F.xxhash64("entry"), F.lit(1 << 30))
    some = entries.where(order < math.ceil(min(1.0, 4 * SAMPLE / n) * (1 << 30)))  # so that no task sends a sample of its own
    sample = _matrix([r["v"] for r in some.orderBy(order, "entry").limit(SAMPLE).select("v").collect()])
    shipped = spark.sparkContext.broadcast(Hashing(dim, longest, sample, max(1, math.ceil(k / n * len(sample))), tables))

    def hashed(batches):
        h = shipped.value
        for b in batches:
            v = _matrix(b.column(1).to_pylist())
            codes = h.codes(v)
            for t in range(h.tables):
                yield {"entry": b.column(0), "v": b.column(1), "t": np.full(len(v), t, np.int32), "cell": (codes[t] // IN_CELL).astype(np.int32), "code": (codes[t] % IN_CELL).astype(np.int32)}

    def visiting(batches):
        h = shipped.value
        for b in batches:
            ids, raw = b.column(0).to_pylist(), b.column(1).to_pylist()
            out = {x: [] for x in ("query_id", "v", "t", "cell", "buckets")}
            for q, v in zip(ids, raw, strict=True):
                for t, codes in enumerate(h.visits(np.asarray(v, np.float64))):
                    flags = np.zeros((WIDE**FUNCTIONS // IN_CELL, IN_CELL), bool)
                    flags.ravel()[codes] = True
                    for cell in np.flatnonzero(flags.any(1)):
                        for key, x in zip(out, (q, v, t, int(cell), np.packbits(flags[cell]).tobytes()), strict=True):
                            out[key].append(x)
            yield out

    index = entries.select("entry", "v").mapInArrow(arrow_map(hashed, pa.schema([("entry", pa.int64()), ("v", vector), ("t", pa.int32()), ("cell", pa.int32()), ("code", pa.int32())])), f"entry long, v {kind}, t int, cell int, code int")
    visits = asked.mapInArrow(arrow_map(visiting, pa.schema([("query_id", pa.int64()), ("v", vector), ("t", pa.int32()), ("cell", pa.int32()), ("buckets", pa.binary())])), f"query_id long, v {kind}, t int, cell int, buckets binary")
    index, visits = staged(index, "index"), staged(visits, "visits")
    size = index.groupBy("t", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("cols")).join(visits.groupBy("t", "cell").agg(F.ceil(F.count("*") / query_block).cast("int").alias("rows")), ["t", "cell"])
    size = F.broadcast(size)  # at most tables * WIDE ** FUNCTIONS / IN_CELL rows
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda x, n: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
    left = index.join(size, ["t", "cell"]).select("t", "cell", deal("entry", "cols").alias("col"), each("rows").alias("row"), "entry", "v", "code")
    right = visits.join(size, ["t", "cell"]).select("t", "cell", each("cols").alias("col"), deal("query_id", "rows").alias("row"), "query_id", "v", "buckets")

    def best(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not len(queries):
            return pd.DataFrame({"query_id": [], "entry": [], "score": []})
        visited = np.unpackbits(np.frombuffer(b"".join(queries["buckets"]), np.uint8).reshape(len(queries), -1), axis=1, count=IN_CELL).astype(bool)
        entry, ids = entries["entry"].to_numpy(), queries["query_id"].to_numpy()
        row, col, score, _ = block_candidates(_matrix(entries["v"]), entries["code"].to_numpy(), _matrix(queries["v"]), visited, k + 1)
        order = np.lexsort((entry[col], -score, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        kept = order[place <= k]  # ties beyond go to larger ids
        return pd.DataFrame({"query_id": ids[row[kept]], "entry": entry[col[kept]], "score": score[kept]})

    keys = ["t", "cell", "col", "row"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "query_id long, entry long, score double")
    found = found.groupBy("query_id", "entry").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry")
    found = found.withColumn("rn", F.row_number().over(by_score)).where(F.col("rn") <= k + 1).drop("rn")
    found = found.join(entries.select("entry", "ids"), "entry").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
