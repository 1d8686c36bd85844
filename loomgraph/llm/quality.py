"""Quality rules by distribution divergence.

Two histograms of a document are held against references of each language by
Jensen-Shannon distance: its character classes, and its common words (with all other
words in one bin).  A document's distance is that to the nearest reference.  A document
fails if a distance is over its limit; the limits widen for short texts by what
sampling alone gives, and below ``min_chars`` / ``min_words`` a histogram is not judged.
Words have a second limit, of the nearest reference and by length: the median distance
of that language's own documents of like length and ``SPREADS`` times what lies between
it and the upper quartile, and at most ``NEAR`` of the distance that a text without any
common word has (no text without common words passes, at any length).

References are learned from all documents, their words in one pass and the distances
of documents in a second.  A language's common words are
those with at least ``share`` of its words.  All words are counted; partial counts are
passed on whole, each time ``chunk_words`` words or ``FLUSH`` distinct ones are held, and
the threshold applies to their sums only, so counts are exact however rows are dealt.

The base columns (words, symbols, repeated lines and windows) are exact, over whole
texts.  Repeated 8-word windows are found by hash, and where hashes repeat they are
named exactly by doubling (equal pairs of names get equal names: 2, 4, 8 words).

Edge cases: null text has no words and fails the base; null languages form a reference
of their own; without any reference (an empty table) there are no rows.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import WordHashes, arrow_map, mix64, small_batches, staged

SYMBOLS = b"#*$%&|<>"
CLASSES = ("space", "lower", "upper", "digit", "stop", "symbol", "letter", "other")
SHARE = 0.002
CHUNK_WORDS = 1_000_000
FLUSH = 400_000
SPREADS, NEAR, ENOUGH = 6, 0.95, 20
LENGTHS, BINS = 64, 400


@cache
def _class_of() -> np.ndarray:
    """Class of each code point: lower and upper case letters, digits, spaces, sentence marks, symbols, other letters and marks, the rest."""
    kinds = {"Ll": 1, "Lu": 2, "Lt": 2, "Nd": 3, "Nl": 3, "No": 3, "Zs": 0, "Lo": 6, "Lm": 6, "Mn": 6, "Mc": 6}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i)), 7) for i in range(0x110000)), np.uint8, 0x110000)
    for i in range(128):
        if table[i] == 7:
            table[i] = 4 if chr(i) in ".,;:!?'\"()-" else 5
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_class_of()[points], minlength=len(CLASSES))


def repeated_words(names: np.ndarray, width: int = 8) -> int:
    """Words in windows of ``width`` (a power of 2) names that are found twice or more; names are word hashes."""
    n = len(names) - width + 1
    if n < 2:
        return 0
    h = mix64(names)
    step = 1
    with np.errstate(over="ignore"):
        while step < width:
            h = mix64(h[: len(h) - step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
            step *= 2
    ordered = np.sort(h)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    exact = np.unique(names, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < width:
        pairs = exact[: len(exact) - step] * (len(names) + 1) + exact[step:]
        exact = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        step *= 2
    twice = np.bincount(exact)[exact] > 1
    edge = np.zeros(len(names) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_columns(text: str | None, hashes: WordHashes) -> tuple[list[bytes], int, int, int, int]:
    """words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.split()] if b"\n" in data else []
    return words, chars, symbols, len(lines) - len(set(lines)), repeated_words(hashes.of(words)) if len(words) > 8 else 0


def references(docs: DataFrame, text: str = "text", lang: str = "lang", share: float = SHARE, chunk_words: int = CHUNK_WORDS) -> dict:
    """{lang: (class histogram, {word: share}, word limit by length)}, learned from all rows.

    The driver gets one row for each language and class, at most 1 / share words a language,
    and at most LENGTHS * BINS counts of distances a language.
    """
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        words, held, classes = defaultdict(Counter), 0, defaultdict(lambda: np.zeros(len(CLASSES), np.int64))

        def flush():
            out = []
            for la, c in words.items():
                n = sum(c.values())
                out += [(la, None, n)] + [(la, w, k) for w, k in c.items()]
            out += [(la, b" %d" % i, int(k)) for la, v in classes.items() for i, k in enumerate(v) if k]
            words.clear()
            classes.clear()
            return dict(zip(("lang", "word", "n"), map(list, zip(*out, strict=True)), strict=True)) if out else None

        for b in batches:
            for la, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not x:
                    continue
                got = x.encode("utf-8", "surrogatepass").split()
                words[la].update(got)
                classes[la] += class_counts(x)
                held += len(got)
                if held >= chunk_words or sum(map(len, words.values())) >= FLUSH:
                    held = 0
                    if out := flush():
                        yield out
        if out := flush():
            yield out

    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    # read twice below; staged so that the documents are counted once
    counts = staged(rows.mapInArrow(arrow_map(count, schema), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "quality-words")
    totals = counts.where("word is null").select(F.col("lang").alias("_l"), F.col("n").alias("_total"))
    kept = counts.join(F.broadcast(totals), F.col("lang").eqNullSafe(F.col("_l"))).where(f"word is null or substring(word, 1, 1) = X'20' or n >= {share} * _total")
    found: dict = {}
    for r in kept.collect():
        hist, common, _ = found.setdefault(r["lang"], (np.zeros(len(CLASSES)), {}, 0))
        if r["word"] is not None and bytes(r["word"])[:1] == b" ":
            hist[int(bytes(r["word"])[1:])] = r["n"]
        elif r["word"] is not None:
            common[bytes(r["word"])] = r["n"] / r["_total"]
    learned = {la: (hist / max(1.0, hist.sum()), dict(sorted(common.items()))) for la, (hist, common, _) in found.items()}
    limits = word_limits(rows, learned)
    return {la: (*r, limits[la]) for la, r in learned.items()}


def word_shares(common: dict) -> np.ndarray:
    """Shares of the common words, and of all other words in the last bin."""
    return np.array([*common.values(), max(0.0, 1 - sum(common.values()))])


def word_distance(seen: Counter, n: int, place: dict, shares: np.ndarray) -> float:
    """Distance of a text of ``n`` words, counted in ``seen``, to a reference; ``place`` numbers its common words."""
    own = np.zeros(len(shares))
    for w in place.keys() & seen.keys():
        own[place[w]] = seen[w]
    own[-1] = n - own[:-1].sum()
    return float(js_distance(own[None] / n, shares[None])[0, 0])


def length_bin(n: int) -> int:
    """Two bins to a doubling of the number of words."""
    return min(LENGTHS - 1, int(2 * np.log2(max(1, n))))


def word_limits(rows: DataFrame, learned: dict) -> dict:
    """{lang: limit of each length bin}, from the distances of all rows (lang, text) to their own language's reference."""
    shipped = rows.sparkSession.sparkContext.broadcast({la: ({w: i for i, w in enumerate(r[1])}, word_shares(r[1])) for la, r in learned.items()})
    schema = pa.schema([("lang", pa.string()), ("cell", pa.int64()), ("n", pa.int64())])

    def measure(batches):
        cells: Counter = Counter()
        for b in batches:
            for la, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (x or "").encode("utf-8", "surrogatepass").split()
                if words and la in shipped.value:
                    d = word_distance(Counter(words), len(words), *shipped.value[la])
                    cells[la, length_bin(len(words)) * BINS + min(BINS - 1, int(d * BINS))] += 1
        yield {"lang": [c[0] for c in cells], "cell": [c[1] for c in cells], "n": list(cells.values())}

    counts = {la: np.zeros((LENGTHS, BINS)) for la in learned}
    if learned:
        for r in rows.mapInArrow(arrow_map(measure, schema), "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect():
            counts[r["lang"]][divmod(r["cell"], BINS)] = r["n"]
    out = {}
    for la, (_, common) in learned.items():
        shares = word_shares(common)
        alien = word_distance(Counter(), 1, {}, shares)  # of any text without common words
        # without common words (every word rare) there is nothing to be far from
        limit = np.full(LENGTHS, NEAR * alien if common else np.inf)
        for i, row in enumerate(counts[la]):
            if common and row.sum() >= ENOUGH:
                half, upper = ((np.searchsorted(np.cumsum(row), q * row.sum()) + 1) / BINS for q in (0.5, 0.75))
                limit[i] = min(limit[i], half + SPREADS * max(upper - half, 1 / BINS))
        out[la] = limit
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of ``p`` to each row of ``q``."""
    p, q = p[:, None, :], q[None, :, :]
    m = (p + q) / 2

    def part(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0.0).sum(-1)

    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


CLASS_LIMIT, WORD_LIMIT, MIN_CHARS, MIN_WORDS = 0.25, 0.35, 100, 40


def judge(docs: DataFrame, refs: dict, text: str = "text", doc_id: str = "doc_id", *, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """One row a document: the base columns, both distances, base_failed and kept."""
    spark = docs.sparkSession
    names = sorted(refs, key=str)
    vocabulary = [{w: i for i, w in enumerate(refs[la][1])} for la in names]
    shares = [word_shares(refs[la][1]) for la in names]
    limits = [refs[la][2] for la in names]
    classes = np.array([refs[la][0] for la in names]) if names else np.zeros((0, len(CLASSES)))
    shipped = spark.sparkContext.broadcast((vocabulary, shares, classes, limits))
    fields = [("doc_id", pa.int64())] + [(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("class_distance", pa.float64()), ("word_distance", pa.float64())]
    schema = pa.schema(fields)

    def score(batches):
        vocabulary, shares, classes, limits = shipped.value
        hashes = WordHashes()
        for b in batches:
            out = defaultdict(list)
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            hists = np.array([class_counts(x or "") for x in texts], float).reshape(-1, len(CLASSES))
            n_chars = hists.sum(1)
            cd = js_distance(hists / np.maximum(1, n_chars)[:, None], classes).min(1) if len(classes) else np.zeros(len(texts))
            for i, (d, x) in enumerate(zip(ids, texts, strict=True)):
                words, chars, symbols, lines, repeated = base_columns(x, hashes)
                n = len(words)
                failed = n < 20 or 100 * repeated > 30 * n
                wd, words_good = 0.0, True
                if n >= min_words and vocabulary:
                    seen = Counter(words)
                    wd, near = min((word_distance(seen, n, v, s), k) for k, (v, s) in enumerate(zip(vocabulary, shares, strict=True)))
                    words_good = wd <= min(word_limit + np.sqrt(min(len(shares[near]), n) / (8 * n)), limits[near][length_bin(n)])
                good = (n_chars[i] < min_chars or cd[i] <= class_limit + 1.5 / np.sqrt(n_chars[i])) and words_good
                for k, v in zip(schema.names, (d, n, chars, symbols, lines, repeated, failed, bool(good and not failed), float(cd[i]), wd), strict=True):
                    out[k].append(v)
            yield out

    small_batches(spark)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(arrow_map(score, schema), ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'boolean' if f.type == pa.bool_() else 'double'}" for f in schema))
