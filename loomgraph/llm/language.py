"""Language identification by multilingual mixture inference.

A language is a distribution over byte trigrams of the lower-cased text (marks and
digits become spaces; ``grams`` hash buckets), counted over every labelled document.  A
text is a mixture of languages.  Expectation-maximisation estimates the proportions:
each trigram is shared out among the languages in proportion to ``share * likelihood``,
and the shares are what they received.  The language set is chosen by penalised
likelihood: one language unless a larger set raises the log-likelihood by more than
``0.5 * ln(n) + slack * n`` for each language more (n trigrams).  The prediction is the
largest proportion of the chosen set, which is also the score.  ``lang_fit`` says how well the
chosen set explains the text: the gain of its log-likelihood a trigram over that of a text
whose trigrams fall on all buckets alike.  ``lang_known`` is false where the fit is below
``LEAST_FIT`` of what the predicted language's own texts have on average, by more than
``DEVIATIONS`` standard errors of their trigrams over the text's length: the text is then in no
learned language, while a short one of a learned language stays within its spread.

Edge cases: null text, or text without a letter (Unicode category L), is ``und`` with score and fit 0, not known;
so is every text if nothing was learned; a null label is not learned from; one class gives
score 1.  Equal likelihoods go to the language that comes first by name.  Repeated rows are
rows of their own, in learning and prediction; texts are read whole, however long; ``keep``
columns of any name but ``_text`` and the result's five pass through
(these raise an error); an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import arrow_map, small_batches

GRAMS = 8192
SLACK = 0.02
LEAST_FIT, DEVIATIONS = 1 / 3, 4.0
TOGETHER = 64
_FOUND = ("lang_pred", "score", "lang_set", "lang_fit", "lang_known")
_LETTER = regex.compile(r"\p{L}")
_SPACED = bytes(32 if i < 128 and not chr(i).isalpha() else i for i in range(256))


def gram_counts(text: str, grams: int = GRAMS) -> np.ndarray:
    """Counts of the hashed byte trigrams; those with two spaces side by side don't count."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_SPACED) + b" ", np.uint8).astype(np.uint32)
    a, b, c = data[:-2], data[1:-1], data[2:]
    keep = ~((b == 32) & ((a == 32) | (c == 32)))
    code = (a << np.uint32(16) | b << np.uint32(8) | c)[keep]
    with np.errstate(over="ignore"):
        code = (code * np.uint32(2654435761)) >> np.uint32(32 - int(grams).bit_length() + 1)
    return np.bincount(code, minlength=grams)


def learn(docs: DataFrame, use: Column, text: str = "text", lang: str = "lang", grams: int = GRAMS) -> tuple[list[str], np.ndarray]:
    """Language names and log P(gram | language), from the rows where ``use`` holds and lang isn't null.

    Each task adds up its documents and sends at most ``languages * grams`` counts; the
    driver gets as many in all, whatever the corpus.
    """
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])

    def count(batches):
        sums = defaultdict(lambda: np.zeros(grams, np.int64))
        for b in batches:
            for la, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[la] += gram_counts(x, grams)
        for la, v in sums.items():
            at = np.flatnonzero(v)
            yield {"lang": [la] * len(at), "gram": at.astype(np.int32), "n": v[at]}

    small_batches(docs.sparkSession)
    rows = docs.where(use & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    counts = rows.mapInArrow(arrow_map(count, schema), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(counts["lang"]))
    table = np.zeros((len(names), grams))
    if names:
        table[counts["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(), counts["gram"].to_numpy()] = counts["n"].to_numpy()
    return names, np.log((table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * grams))


def _mixture(counts: np.ndarray, p: np.ndarray, starts: np.ndarray, totals: np.ndarray, rounds: int, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once: proportions (documents, languages) and log-likelihoods.

    ``p``: likelihoods of each document's grams, documents one after another from
    ``starts``; documents that no longer change drop out.
    """
    n_docs, n_langs = len(starts), p.shape[1]
    share = np.full((n_docs, n_langs), 1 / n_langs)
    best = np.zeros(n_docs)
    lengths = np.diff(np.append(starts, len(counts)))
    live = np.arange(n_docs)
    for _ in range(rounds):
        of = np.repeat(np.arange(len(live)), lengths[live])
        weighed = share[live][of] * p
        total = weighed.sum(1)
        first = np.append(0, np.cumsum(lengths[live])[:-1])
        best[live] = np.add.reduceat(counts * np.log(total), first)
        new = np.add.reduceat(weighed * (counts / total)[:, None], first) / totals[live][:, None]
        moving = np.abs(new - share[live]).max(1) > tolerance
        share[live] = new
        if not moving.any():
            break
        stay = np.repeat(moving, lengths[live])
        counts, p, live = counts[stay], p[stay], live[moving]
    return share, best


def infer(texts: list[str | None], names: list[str], logp: np.ndarray, slack: float = SLACK, rounds: int = 30) -> list[tuple[str, float, str]]:
    """(language, its proportion, the language set as text) of each text."""
    return [x[:3] for x in explain(texts, names, logp, slack, rounds)]


def explain(texts: list[str | None], names: list[str], logp: np.ndarray, slack: float = SLACK, rounds: int = 30) -> list[tuple[str, float, str, float, bool]]:
    """What :func:`infer` gives, the fit, and whether the language is known.

    ``TOGETHER`` texts are estimated at once, as the arrays of EM have a row for each of their trigrams.
    """
    parts = (texts[i : i + TOGETHER] for i in range(0, len(texts), TOGETHER))
    return [x for part in parts for x in _explain(part, names, logp, slack, rounds)]


def _explain(texts: list[str | None], names: list[str], logp: np.ndarray, slack: float, rounds: int) -> list[tuple[str, float, str, float, bool]]:
    out = [("und", 0.0, "", 0.0, False)] * len(texts)
    found, grams, counts = [], [], []
    for i, x in enumerate(texts):
        if names and x and _LETTER.search(x):
            c = gram_counts(x, logp.shape[1])
            at = np.flatnonzero(c)
            found.append(i)
            grams.append(at)
            counts.append(c[at])
    if not found:
        return out
    lengths = np.array([len(g) for g in grams])
    starts = np.append(0, np.cumsum(lengths)[:-1])
    grams, counts = np.concatenate(grams), np.concatenate(counts).astype(float)
    totals = np.add.reduceat(counts, starts)
    log = logp.T[grams]
    single = np.add.reduceat(log * counts[:, None], starts)
    share, joint = _mixture(counts, np.exp(log), starts, totals, rounds)
    cost = 0.5 * np.log(totals) + slack * totals
    even, p = -np.log(logp.shape[1]), np.exp(logp)
    usual = (p * logp).sum(1) - even
    spread = np.sqrt((p * (logp - even - usual[:, None]) ** 2).sum(1))

    def answer(k: int, top: int, share: float, some: str, likelihood: float) -> tuple[str, float, str, float, bool]:
        fit = likelihood / totals[k] - even
        return names[top], share, some, float(fit), bool(fit >= LEAST_FIT * usual[top] - DEVIATIONS * spread[top] / np.sqrt(totals[k]))

    for k, i in enumerate(found):
        one = int(single[k].argmax())
        if joint[k] - single[k, one] <= cost[k]:
            out[i] = answer(k, one, 1.0, names[one], single[k, one])
            continue
        order, own = np.argsort(-share[k], kind="stable"), slice(starts[k], starts[k] + lengths[k])
        best = (single[k, one] - cost[k], np.array([one]), np.array([1.0]), single[k, one])
        for size in range(2, len(names) + 1):
            some = order[:size]
            part, ll = _mixture(counts[own], np.exp(log[own][:, some]), np.array([0]), totals[k : k + 1], rounds)
            if ll[0] - size * cost[k] <= best[0]:
                break
            best = (ll[0] - size * cost[k], some, part[0], ll[0])
        _, some, part, reached = best
        top = int(part.argmax())
        out[i] = answer(k, some[top], float(min(1.0, part[top])), "+".join(sorted(names[j] for j in some)), reached)
    return out


def predict(docs: DataFrame, names: list[str], logp: np.ndarray, text: str = "text", keep: list[Column] = (), slack: float = SLACK) -> DataFrame:
    """The ``keep`` columns of each row, and lang_pred, score, lang_set, lang_fit, lang_known."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((names, logp))
    rows = docs.select(F.col(f"`{text}`").alias("_text"), *keep)
    kept = rows.schema.fields[1:]
    if taken := {f.name for f in kept} & {"_text", *_FOUND}:
        raise ValueError(f"columns to keep have names of the result: {sorted(taken)}")

    def run(batches):
        names, logp = shipped.value
        for b in batches:
            got = explain(b.column(0).to_pylist(), names, logp, slack)
            cols = [b.column(i + 1) for i in range(len(kept))]
            extra = [pa.array([x[j] for x in got], t) for j, t in enumerate((pa.string(), pa.float64(), pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*cols, *extra], names=[*(f.name for f in kept), *_FOUND])

    small_batches(spark)
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string, score double, lang_set string, lang_fit double, lang_known boolean"])
    return rows.mapInArrow(run, out)
