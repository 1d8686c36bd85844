"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.  A
text's windows of ``window`` words are compressed with each; the difference of the
lengths says which text a window is closer to.  Windows at or over a calibrated
difference are hits, and a logistic model of the hits gives the score.

What makes short windows comparable:

* The training samples are the parts of each class's text that tell it apart: runs of
  byte 5-grams that are over ``ratio`` times as common, by documents, as in the other
  class.  What both share would only add noise to the difference.
* Every window starts with a primer that both dictionaries end in.  So both frames are
  compressed blocks with their fixed costs paid, and one match more shows in the length.

Labels are learned from a bounded sample: at most ``sample`` labelled rows of each
class, in the order of a hash of the id, so that only their texts are gathered.  The dictionaries are trained on all of it; threshold and
model are calibrated on each half's windows with dictionaries of the other half.
Scoring covers every window of every text.

Edge cases: null and empty texts have one empty window and get the score of no hit;
with no label of one class the score is 0 (no toxic) or 1 (no ordinary).
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import small_batches

SAMPLE = 2000
RATIO = 30.0
LEAST = 5
DICT_BYTES = 2048
WINDOW = 3
PRIMER = bytes(range(128, 160))


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def _grams(word: bytes, n: int = 5) -> set[bytes]:
    padded = b" " + word + b" "
    return {padded[i : i + n] for i in range(len(padded) - n + 1)}


def _document_counts(texts: list[str]) -> Counter:
    counts: Counter = Counter()
    for x in texts:
        seen: set[bytes] = set()
        for w in set(_words(x)):
            seen |= _grams(w)
        counts.update(seen)
    return counts


def _telling(own: Counter, n_own: int, other: Counter, n_other: int, ratio: float) -> set[bytes]:
    return {g for g, c in own.items() if c >= LEAST and (c + 0.5) / (n_own + 1) > ratio * (other[g] + 0.5) / (n_other + 1)}


def _runs(texts: list[str], telling: set[bytes], n: int = 5) -> list[bytes]:
    """Of each text the parts of words that telling grams cover."""
    out = []
    for x in texts:
        parts = []
        for w in _words(x):
            padded = b" " + w + b" "
            covered = bytearray(len(padded))
            for i in range(len(padded) - n + 1):
                if padded[i : i + n] in telling:
                    covered[i : i + n] = b"\1" * n
            if any(covered):
                parts += [p for p in bytes(c if k else 10 for c, k in zip(padded, covered, strict=True)).split(b"\n") if len(p) >= n]
        if parts:
            out.append(b"".join(parts))
    return out


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's content; too few samples to train on are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


class Distance:
    """Compressed length with the ordinary less that with the toxic dictionary, of each window."""

    def __init__(self, toxic: bytes, ordinary: bytes, window: int = WINDOW) -> None:
        self.window, self.contents = window, (toxic, ordinary)
        self.toxic, self.ordinary = self._compressor(toxic), self._compressor(ordinary)

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters.from_level(3, min_match=5, write_checksum=False, write_content_size=False, write_dict_id=False)
        content = zstandard.ZstdCompressionDict(content + PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=content, compression_params=params)

    def of(self, text: str | None) -> np.ndarray:
        words, w, toxic, ordinary = _words(text), self.window, self.toxic.compress, self.ordinary.compress
        windows = [PRIMER + b" " + b" ".join(words[i : i + w]) + b" " for i in range(0, len(words), w)] or [PRIMER]
        return np.array([len(ordinary(x)) - len(toxic(x)) for x in windows])


def _features(d: np.ndarray, threshold: int) -> list[float]:
    hits = int((d >= threshold).sum())
    return [1.0, math.log1p(hits), math.sqrt(hits / (len(d) + 5)), float(min(10, max(0, d.max()))) / 10]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.01, rounds: int = 50) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionaries(toxic: list[str], ordinary: list[str], ratio: float, size: int) -> tuple[bytes, bytes]:
    ct, co = _document_counts(toxic), _document_counts(ordinary)
    own = _runs(toxic, _telling(ct, len(toxic), co, len(ordinary), ratio))
    other = _runs(ordinary, _telling(co, len(ordinary), ct, len(toxic), ratio))
    return _dictionary(own, size), _dictionary(other, size)


def fit(toxic: list[str], ordinary: list[str], window: int = WINDOW, ratio: float = RATIO, size: int = DICT_BYTES) -> dict:
    """Dictionaries, threshold and model from labelled texts."""
    if not toxic or not ordinary:
        return {"constant": 1.0 if toxic else 0.0}
    distance = Distance(*_dictionaries(toxic, ordinary, ratio, size), window)
    found: list[np.ndarray] = []
    y: list[float] = []
    for k in (0, 1):  # windows are calibrated with dictionaries that haven't seen their text
        seen = (toxic[k::2], ordinary[k::2])
        other = Distance(*_dictionaries(*seen, ratio, size), window) if all(seen) else distance
        for label, texts in ((1.0, toxic[1 - k :: 2]), (0.0, ordinary[1 - k :: 2])):
            found += [other.of(x) for x in texts]
            y += [label] * len(texts)
    y = np.array(y)
    best = None
    for threshold in range(1, 9):
        x = np.array([_features(d, threshold) for d in found])
        w = _logistic(x, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        if best is None or loss < best[0] - 1e-9:
            best = (loss, threshold, w)
    return {"toxic": distance.contents[0], "ordinary": distance.contents[1], "window": window, "threshold": best[1], "weights": best[2]}


def learn(docs: DataFrame, labels: DataFrame, use: Column, sample: int = SAMPLE) -> dict:
    """Fit on at most ``sample`` labelled rows of each class where ``use`` (of doc_id) holds."""
    labelled = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", "toxic").where(use)
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    chosen = [labelled.where(F.col("toxic") == label).distinct().orderBy(order, "doc_id").limit(sample) for label in (0, 1)]
    both = chosen[0].unionByName(chosen[1])
    texts: dict[int, list[str]] = {0: [], 1: []}
    found = docs.select("doc_id", "text").join(F.broadcast(both), "doc_id")  # at most 2 * sample ids
    for r in found.orderBy("toxic", order, "doc_id").collect():
        texts[r["toxic"]].append(r["text"] or "")
    return fit(texts[1], texts[0])


def score(docs: DataFrame, model: dict, keep: list[Column], text: str = "text") -> DataFrame:
    """The ``keep`` columns, score, and hits and windows of each text."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{text}`").alias("_text"), *keep)
    kept = rows.schema.fields[1:]

    def run(batches):
        model = shipped.value
        distance = Distance(model["toxic"], model["ordinary"], model["window"]) if "toxic" in model else None
        for b in batches:
            scores, hits, windows = [], [], []
            for x in b.column(0).to_pylist():
                if distance is None:
                    scores.append(model["constant"])
                    hits.append(0)
                    windows.append(0)
                    continue
                d = distance.of(x)
                z = float(np.dot(_features(d, model["threshold"]), model["weights"]))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                hits.append(int((d >= model["threshold"]).sum()))
                windows.append(len(d))
            cols = [b.column(i + 1) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(scores, pa.float64()), pa.array(hits, pa.int64()), pa.array(windows, pa.int64())], names=[*(f.name for f in kept), "score", "n_hits", "n_windows"])

    small_batches(spark)
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double, n_hits long, n_windows long"])
    return rows.mapInArrow(run, out)
