"""Language-model scoring with a log-bilinear neural model.

The model predicts a token's symbol from the two tokens before it.  Symbols are the words
with vectors of their own (each with at least ``least`` occurrences, the most frequent
first, at most ``shortlist``; the end token is one), and ``SHAPES`` classes that the other words
fall in by their last two bytes.  Each position before has its own context vectors: the nearer
token by its symbol, the farther by its group (the ``GROUPS`` commonest tokens, else the
class).  The predicted vector is their sum; a symbol's logit is its product with the
symbol's vector, plus a bias.

Training is by noise-contrastive estimation in numpy, over every token of every training
document: each task sweeps its own tokens from one common start, and the parameters are
averaged, each row weighted by its occurrences.  So steps, words with vectors and word counts grow
with the corpus.  Batched matrix products give the normaliser of each context:
``sum_w exp(far.w + near.w + bias) = exp(far) @ exp(near + bias)``, one product over all
symbols.  Within a class a word has the share
``(c + 0.5) / (class tokens + 0.5 * (class words + 1))``, so a text's score is a normalised log10
probability over all words.

Every word's count comes from all training documents.  The ``head`` most frequent
words are broadcast (a bounded table); the rest of each document's words go through a
join by word, so no frequent word is ever shuffled.

Edge cases: null and empty texts have the end token only; null ids count as training;
with no training documents c, N and V are 0 and the formulas still hold; repeated rows are
rows of their own, in counts and in results; texts are read whole, however long; words of one
count are ordered by their bytes; other columns, of any name, are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import arrow_map, small_batches, staged

END = b""
SHORTLIST, LEAST = 16_384, 50
SHAPES, GROUPS = 128, 64
HEAD = 200_000
WIDTH = 16
BATCH, NOISE, RATE, STEPS = 2048, 32, 0.3, 200
FLUSH = 400_000


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased (bytes.lower changes nothing else), then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def shape(word: bytes) -> int:
    """Class by the last two bytes: endings tell a language and a kind of word."""
    return zlib.crc32(word[-2:]) % SHAPES


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all rows; the end token is the empty word."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def count(batches):
        held: Counter = Counter()
        for b in batches:
            for x in b.column(0).to_pylist():
                held.update(tokens(x))
            if len(held) >= FLUSH:
                yield {"word": list(held.keys()), "c": list(held.values())}
                held = Counter()
        yield {"word": list(held.keys()), "c": list(held.values())}

    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{text}`")).mapInArrow(arrow_map(count, schema), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> tuple[list[bytes], list[int]]:
    """Words and counts of the highest count ranges that hold at most ``most`` words in all, most frequent first.

    The ranges (16 to a doubling) are counted first, so that each task sends only words that
    are wanted, and the driver never gets over ``most`` of them.
    """
    level = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    least, held = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        held += r["n"]
        if held > most:
            break
        least = r["level"]
    if least is None:
        return [], []
    found = sorted(((-r["c"], bytes(r["word"])) for r in counts.where(level >= least).collect()))
    return [w for _, w in found], [-c for c, _ in found]


class Symbols:
    """Head words, their counts, and the symbol and group of each; words with vectors of their own come first."""

    def __init__(self, words: list[bytes], counts: list[int], shortlist: int, least: int) -> None:
        self.at = {w: i for i, w in enumerate(words)}
        self.logc = np.log10(np.append(np.array(counts, float), 0.0) + 0.5)
        self.short = min(shortlist, sum(c >= least for c in counts))
        kind = np.array([shape(w) for w in words] + [0], np.int64)
        place = np.arange(len(kind))
        self.symbol = np.where(place < self.short, place, self.short + kind)
        common = min(GROUPS, self.short)
        self.group = np.where(place < common, place, common + kind)
        self.n, self.groups = self.short + SHAPES, common + SHAPES

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Places in the head (-1: none), symbols, groups, and the words that aren't in the head."""
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        symbols, groups = self.symbol[at], self.group[at]
        rest = np.flatnonzero(at < 0)
        tail = [words[i] for i in rest]
        if tail:
            kinds = np.fromiter(map(shape, tail), np.int64, len(tail))
            symbols[rest] = self.short + kinds
            groups[rest] = self.groups - SHAPES + kinds
        return at, symbols, groups, tail

    def contexts(self, symbols: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group of the token two before and symbol of the one before each; ``groups`` and ``n`` stand for a text's beginning."""
        far, near = np.full(len(symbols), self.groups), np.full(len(symbols), self.n)
        far[2:], near[1:] = groups[:-2], symbols[:-1]
        return far, near


class Parameters:
    """Context vectors of both positions and target vectors, whose last column is the bias."""

    def __init__(self, n: int, groups: int, unigram: np.ndarray, width: int = WIDTH, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.far = rng.normal(0, 0.1, (groups + 1, width)).astype(np.float32)
        self.near = rng.normal(0, 0.1, (n + 1, width)).astype(np.float32)
        self.target = np.hstack([rng.normal(0, 0.1, (n, width)), np.log(unigram)[:, None]]).astype(np.float32)

    def rows(self) -> list[np.ndarray]:
        return [self.far, self.near, self.target]

    def vector(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Predicted vectors, with a one for the bias."""
        out = np.ones((len(far), self.far.shape[1] + 1), np.float32)
        out[:, :-1] = self.far[far] + self.near[near]
        return out

    def normaliser(self) -> np.ndarray:
        """log sum over all symbols of exp(logit), (far, near)."""
        left = self.far @ self.target[:, :-1].T
        left_top = left.max(1, keepdims=True)
        left = np.exp(left - left_top)
        out = np.empty((len(self.far), len(self.near)), np.float32)
        for i in range(0, len(self.near), 128):  # a few MB at a time
            right = self.near[i : i + 128] @ self.target[:, :-1].T + self.target[:, -1]
            top = right.max(1, keepdims=True)
            right -= top
            out[:, i : i + 128] = np.log(left @ np.exp(right, out=right).T) + left_top + top.T
        return out


def _push(value: np.ndarray, total: np.ndarray, at: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """AdaGrad step on the rows ``at``, which may repeat."""
    order = np.argsort(at, kind="stable")
    ids = at[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    sums, rows = np.add.reduceat(grad[order], first), ids[first]
    total[rows] += sums * sums
    value[rows] += rate * sums / np.sqrt(total[rows])


def train(p: Parameters, far: np.ndarray, near: np.ndarray, word: np.ndarray, unigram: np.ndarray, seed: int, batch: int = BATCH, noise: int = NOISE, rate: float = RATE, least_steps: int = STEPS) -> None:
    """NCE over the tokens in a seeded order, in place; few tokens are swept again until there were ``least_steps``."""
    if not len(word):
        return
    rng = np.random.default_rng(seed)
    log_noise = np.log(noise * unigram).astype(np.float32)
    share = np.cumsum(unigram)
    totals = [np.full_like(x, 1e-4) for x in p.rows()]
    sweeps = max(1, -(-least_steps * batch // len(word)))
    steps = sweeps * -(-len(word) // batch)
    step = 0
    for _ in range(sweeps):
        order = rng.permutation(len(word))
        for i in range(0, len(word), batch):
            some = order[i : i + batch]
            f, c, w = far[some], near[some], word[some]
            v = p.vector(f, c)
            false = np.minimum(np.searchsorted(share, rng.random(noise) * share[-1]), len(unigram) - 1)  # one noise draw for a batch
            true_v, false_v = p.target[w], p.target[false]
            true_s = np.einsum("ij,ij->i", v, true_v) - log_noise[w]
            false_s = v @ false_v.T - log_noise[false]
            gt = 1 / (1 + np.exp(np.clip(true_s, -30, 30)))
            gf = -1 / (1 + np.exp(-np.clip(false_s, -30, 30)))
            pace = rate * (1 - step / steps)
            scale = np.float32(1 / len(some))
            dv = (gt[:, None] * true_v + gf @ false_v)[:, :-1] * scale
            _push(p.target, totals[2], np.concatenate([w, false]), np.concatenate([gt[:, None] * v, gf.T @ v]) * scale, pace)
            _push(p.far, totals[0], f, dv, pace)
            _push(p.near, totals[1], c, dv, pace)
            step += 1


def fit(docs: DataFrame, symbols, unigram: np.ndarray, text: str = "text") -> Parameters:
    """Parameters averaged over the tasks' sweeps of their own tokens.

    The driver gets one averaged row of each table, at most ``2 * (shortlist + SHAPES) + GROUPS + SHAPES`` or so.
    """
    schema = pa.schema([("table", pa.int32()), ("row", pa.int32()), ("times", pa.float64()), ("values", pa.list_(pa.float32()))])

    def sweep(batches):
        from pyspark import TaskContext

        s = symbols.value
        held: list[list[np.ndarray]] = [[], [], []]
        for b in batches:
            for x in b.column(0).to_pylist():
                _, y, groups, _ = s.read(tokens(x))
                for out, part in zip(held, (*s.contexts(y, groups), y), strict=True):
                    out.append(part.astype(np.int32))
        if not held[0]:
            return
        far, near, word = map(np.concatenate, held)
        held.clear()
        p = Parameters(s.n, s.groups, unigram)
        train(p, far, near, word, unigram, TaskContext.get().partitionId())
        for table, (value, at) in enumerate(zip(p.rows(), (far, near, word), strict=True)):
            times = np.bincount(at, minlength=len(value))
            seen = np.flatnonzero(times)
            for i in range(0, len(seen), 4096):
                some = seen[i : i + 4096]
                flat = pa.array(value[some].ravel(), pa.float32())
                yield {"table": np.full(len(some), table, np.int32), "row": some.astype(np.int32), "times": times[some].astype(float), "values": pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * value.shape[1]), flat)}

    def average(part: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(part["row"].to_numpy(), kind="stable")
        row, times = part["row"].to_numpy()[order], part["times"].to_numpy()[order]
        values = np.array(part["values"].tolist(), float)[order] * times[:, None]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        mean = np.add.reduceat(values, first) / np.add.reduceat(times, first)[:, None]
        return pd.DataFrame({"table": np.full(len(first), part["table"].iloc[0]), "row": row[first], "values": list(mean.astype(np.float32))})

    swept = docs.select(F.col(f"`{text}`")).mapInArrow(arrow_map(sweep, schema), "table int, row int, times double, values array<float>")
    found = swept.groupBy("table", F.expr("row div 256")).applyInPandas(average, "table int, row int, values array<float>").toPandas()
    p = Parameters(symbols.value.n, symbols.value.groups, unigram)
    for table, value in enumerate(p.rows()):
        mine = found[found["table"] == table]
        if len(mine):
            value[mine["row"].to_numpy()] = np.array(mine["values"].tolist(), np.float32)
    return p


def score(docs: DataFrame, training: Column, text: str = "text", doc_id: str = "doc_id", *, shortlist: int = SHORTLIST, least: int = LEAST, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark = docs.sparkSession
    small_batches(spark)
    counts = staged(word_counts(docs.where(training), text), "lm-words")
    total, words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    symbols = Symbols(*most_frequent(counts, head), shortlist, least)
    shipped = spark.sparkContext.broadcast(symbols)
    # tokens and words of each class: of the words without vectors
    listed = [w for w, i in symbols.at.items() if i < symbols.short]
    sizes = {r["k"]: (r["c"], r["v"]) for r in shapes(counts, listed).collect()}
    log_class = np.array([np.log10(sizes.get(k, (0, 0))[0] + 0.5 * (sizes.get(k, (0, 0))[1] + 1)) for k in range(SHAPES)])
    times = np.append(10 ** symbols.logc[: symbols.short], [sizes.get(k, (0, 0))[0] + 0.5 for k in range(SHAPES)])
    parameters = fit(docs.where(training), shipped, times / times.sum(), text)
    model = spark.sparkContext.broadcast((parameters, parameters.normaliser(), log_class, float(np.log10(total + 0.5 * (words + 1)))))
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("word", pa.binary()), ("times", pa.int64())])

    def run(batches):
        s, (p, normaliser, log_class, log_all) = shipped.value, model.value
        for b in batches:
            out = {k: [] for k in schema.names}
            for rid, d, held, x in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                words = tokens(x)
                at, y, groups, tail = s.read(words)
                far, near = s.contexts(y, groups)
                inside = at[at >= 0]
                classed = y[y >= s.short] - s.short
                known = float(s.logc[inside].sum())
                in_class = float(s.logc[inside[inside >= s.short]].sum())
                logp = np.einsum("ij,ij->i", p.vector(far, near), p.target[y]) - normaliser[far, near]
                neural = float(logp.sum(dtype=np.float64)) / np.log(10)
                out["rid"].append(rid)
                out["doc_id"].append(d)
                out["held_out"].append(held)
                out["n_tokens"].append(len(words))
                out["n_known"].append(len(inside))
                out["base_score"].append(known - len(words) * log_all)
                out["score"].append(neural + in_class - float(log_class[classed].sum()))
                out["word"].append(b" %d" % rid)  # no word has a space: finds no partner
                out["times"].append(0)
                for w, n in Counter(tail).items():
                    out["rid"].append(rid)
                    out["doc_id"].append(None)
                    out["held_out"].append(None)
                    out["n_tokens"].append(None)
                    out["n_known"].append(None)
                    out["base_score"].append(None)
                    out["score"].append(None)
                    out["word"].append(w)
                    out["times"].append(n)
            yield out

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{doc_id}`").cast("long"), (~training).alias("held"), F.col(f"`{text}`"))
    parts = rows.mapInArrow(arrow_map(run, schema), "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, word binary, times long")
    joined = parts.join(counts, "word", "left").withColumn("c", F.coalesce(F.col("c"), F.lit(0)))
    tail = F.sum(F.col("times") * F.log10(F.col("c") + 0.5))
    return (
        joined.groupBy("rid")
        .agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.max("n_known").alias("_known"), F.max("base_score").alias("_base"), F.max("score").alias("_score"), tail.alias("_tail"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("_more"))
        .select("doc_id", "held_out", "n_tokens", (F.col("_known") + F.col("_more")).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("_base") + F.col("_tail")).alias("base_score"), (F.col("_score") + F.col("_tail")).alias("score"))
    )


def shapes(counts: DataFrame, listed: list[bytes]) -> DataFrame:
    """(k, c, v): tokens and words of each class, the ``listed`` words left out."""
    schema = pa.schema([("k", pa.int32()), ("c", pa.int64()), ("v", pa.int64())])
    out_of = set(listed)

    def run(batches):
        c, v = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if w not in out_of:
                    k = shape(w)
                    c[k] += n
                    v[k] += 1
        yield {"k": np.arange(SHAPES, dtype=np.int32), "c": c, "v": v}

    return counts.select("word", "c").mapInArrow(arrow_map(run, schema), "k int, c long, v long").groupBy("k").agg(F.sum("c").alias("c"), F.sum("v").alias("v"))
