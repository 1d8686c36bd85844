"""Removal of repeated long word sequences by recompression.

A window is ``WINDOW`` consecutive words of one document.  Each word covered by a window
whose word sequence also starts earlier (smaller id, or the same document, earlier
start) is removed; windows are judged on the input.

Recompression names parts of the text in Spark rounds, so that equal substrings get equal
names inside.  Runs of one token come first.  In a round, symbols fall left and right by a hash of
their name and the round, and a left symbol with a right one behind it is a pair.  Blocks of texts
send their distinct pairs, packed by hash parts; the task of a part holds the round's name
table: it tells which pairs occur twice or more in the corpus and gives each of these its
global name (round, number), which replaces the pair in all blocks.  Each symbol carries the
span of words that its being formed depends on.  A pair whose dependence lies within a window is
formed in every occurrence of that window, so a window with a pair that occurs once in
the corpus is itself unique.  Its words leave the rounds, unless another window still needs them,
and later rounds name ever longer symbols of ever less text.  Where something left, the
neighbour's dependence is taken as endless, so what is left is judged as in the whole text.

Windows that hold shared symbols only, up to the highest, reveal the repeats.  They are
verified by names of all their words (96 bits, from two independent 64-bit hashes of each word); of
each the task of its part finds the first place.  A name that a third of all texts hold is one
entry a block, in no task more than the number of blocks.

``docs`` is scanned three times and must give its rows in one order, as a file scan does;
where a block's pairs differ between scans, an error is raised.

Edge cases: null text has no words; texts shorter than a window keep all; a text of any length
is one text, in one block; equal ids are told apart by the order of the scan; a null id comes
after all others; repeated rows repeat each other, so the first keeps its words.  An input
column with the name of a result column gives way to it; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from loomgraph.llm.common import WordHashes, arrow_map, mix64, release, small_batches, staged, unstage

WINDOW = 20
ROUNDS = 5
FAR = 2 * WINDOW  # a dependence that no window holds
BLOCK_BYTES = 8 << 20
_WORDS = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RUN = np.uint64(0x632BE59BD9B4E019)


def _name(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(a + np.uint64(salt)) * _ODD + b)


class Symbols:
    """Symbols of a block that are still in play, by place: name, words [start, end), and the words [lo, hi) they depend on.

    ``at``: where each text begins, and the number of words; ``live``: flags of the windows that can repeat, by start.
    """

    def __init__(self, arrays: tuple[np.ndarray, ...], at: np.ndarray, live: np.ndarray) -> None:
        self.name, self.start, self.end, self.lo, self.hi = arrays
        self.at, self.live = at, live
        self.doc = np.searchsorted(at, self.start, "right") - 1

    @classmethod
    def of_words(cls, words: np.ndarray, lengths: np.ndarray) -> Symbols:
        """Runs of one token; ``words``: word hashes of texts of these lengths, one after another."""
        at = np.append(0, np.cumsum(lengths))
        new = np.ones(len(words) + 1, bool)
        new[1:-1] = words[1:] != words[:-1]
        new[at] = True
        start = np.flatnonzero(new[:-1])
        end = np.append(start[1:], len(words)) if len(start) else start
        name = words[start]
        runs = end - start > 1
        name = np.where(runs, _name(name ^ _RUN, (end - start).astype(np.uint64), 0), name)
        live = np.arange(len(words)) + WINDOW <= np.repeat(at[1:], lengths)
        return cls((name, start, end, start - 1, end + 1), at, live)  # a run ends where another token stands

    def pair(self, r: int) -> None:
        """The pairs of round ``r``: ``left`` (their first symbols), their distinct keys, and which of these each is."""
        n = len(self.name)
        right = (mix64(self.name + np.uint64(1000003 * r)) & np.uint64(1)).astype(bool)
        same = (self.end[:-1] == self.start[1:]) & (self.doc[:-1] == self.doc[1:])
        self.left = np.flatnonzero(~right[:-1] & right[1:] & same)  # a symbol is left or right, so pairs can't overlap
        self.keys, self.which, times = np.unique(_name(self.name[self.left], self.name[self.left + 1], r), return_inverse=True, return_counts=True)
        self.twice = times > 1
        # what stays single depends on the neighbour that it didn't join
        next_hi, prev_lo = self.end + FAR, self.start - FAR
        if n > 1:
            next_hi[:-1] = np.where(same, self.hi[1:], next_hi[:-1])
            prev_lo[1:] = np.where(same, self.lo[:-1], prev_lo[1:])
        lo, hi = np.where(right, np.minimum(self.lo, prev_lo), self.lo), np.where(right, self.hi, np.maximum(self.hi, next_hi))
        lo[self.left], hi[self.left] = np.minimum(self.lo[self.left], self.lo[self.left + 1]), np.maximum(self.hi[self.left], self.hi[self.left + 1])
        self.new_lo, self.new_hi = lo, hi

    def settle(self, repeated: np.ndarray, numbers: np.ndarray) -> Symbols:
        """After :meth:`pair`: windows with a pair that occurs once are dead; the others' pairs get their global names."""
        shared = repeated[self.which]
        once = self.left[~shared]
        lo, hi = self.new_lo[once], self.new_hi[once]
        first, last = self.at[self.doc[once]], self.at[self.doc[once] + 1]
        held = (lo >= first) & (hi <= last) & (hi - lo <= WINDOW)
        edge = np.zeros(len(self.live) + 1, np.int64)
        edge += np.bincount(np.maximum(hi - WINDOW, first)[held], minlength=len(edge))
        edge -= np.bincount(lo[held] + 1, minlength=len(edge))
        live = self.live & (np.cumsum(edge)[:-1] == 0)
        name, end = self.name.copy(), self.end.copy()
        name[self.left], end[self.left] = numbers[self.which], end[self.left + 1]
        covered = np.append(0, np.cumsum(cover(live)))
        stay = covered[end] - covered[self.start] == end - self.start
        stay[self.left + 1] = False
        stay[once] = False
        return Symbols(tuple(x[stay] for x in (name, self.start, end, self.new_lo, self.new_hi)), self.at, live)

    def packed(self) -> bytes:
        """Names once each and their numbers, gaps and widths, byte by byte, so that little is left after compression."""
        names, which = np.unique(self.name, return_inverse=True)
        gap = self.start - np.append(0, self.end[:-1]) if len(self.start) else self.start
        columns = np.array([which, gap, self.end - self.start, self.start - self.lo, self.hi - self.end], "<i4")
        planes = columns.view(np.uint8).reshape(5, -1, 4).transpose(0, 2, 1)
        return _pack(np.array([len(self.at), len(self.live), len(self.name), len(names)], "<i8"), np.diff(self.at, prepend=0).astype("<i8"), np.packbits(self.live), names.astype("<u8"), np.ascontiguousarray(planes))

    @classmethod
    def loaded(cls, blob: bytes) -> Symbols:
        data = _load(blob)
        docs, words, n, k = np.frombuffer(data, "<i8", 4).tolist()
        at = np.cumsum(np.frombuffer(data, "<i8", docs, 32))
        place = 32 + 8 * docs
        live = np.unpackbits(np.frombuffer(data, np.uint8, (words + 7) // 8, place), count=words).astype(bool)
        place += (words + 7) // 8
        names = np.frombuffer(data, "<u8", k, place).astype(np.uint64)
        planes = np.frombuffer(data, np.uint8, 20 * n, place + 8 * k).reshape(5, 4, n).transpose(0, 2, 1)
        which, gap, length, before, after = np.ascontiguousarray(planes).view("<i4").reshape(5, n).astype(np.int64)
        end = np.cumsum(gap + length)
        start = end - length
        return cls((names[which], start, end, start - before, end + after), at, live)


def cover(starts: np.ndarray) -> np.ndarray:
    """Flags of the words in the windows at the flagged starts."""
    at = np.flatnonzero(starts)
    edge = np.bincount(at, minlength=len(starts) + 1) - np.bincount(at + WINDOW, minlength=len(starts) + 1)
    return np.cumsum(edge)[:-1] > 0


def window_names(words: np.ndarray, seed: int) -> np.ndarray:
    """A name of the 20 words from each place on (the last 19 places have none)."""
    h = mix64(words ^ np.uint64(seed))
    four = None
    for k in range(4):
        h = _name(h[: len(h) - (1 << k)], h[1 << k :], seed + k)
        if k == 1:
            four = h
    n = len(words) - WINDOW + 1
    return _name(h[:n], four[16 : 16 + n], seed + 9)


#: One memory of word hashes for all blocks of a Python worker, which idles between tasks and keeps it.
_HASHES = WordHashes(150_000)


def block_symbols(texts: Iterable[list[bytes]]) -> Symbols:
    """Symbols of texts given by their words, best one by one, as the words of a whole block take many times its size."""
    hashes = [_HASHES.of(w) for w in texts]
    return Symbols.of_words(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.fromiter(map(len, hashes), np.int64, len(hashes)))


def distinct_windows(words: list[bytes], covered: np.ndarray, starts: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows at ``starts`` in order of their names, as the rows (name, name, id, place in its
    text, place in the block) of the first of each, and the number of the distinct one of each start.

    ``words``: those that ``covered`` flags, all that the windows need.
    """
    if not len(starts):
        return np.zeros((5, 0), np.uint64), np.zeros(0, np.int64)
    import xxhash

    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    full = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, number)), ">u8").reshape(-1, 2).astype(np.uint64)
    moved = (np.cumsum(covered) - 1)[starts]
    a, b = (window_names(full[which, side], seed)[moved] for side, seed in ((0, 11), (1, 23)))
    doc = np.searchsorted(at, starts, "right") - 1
    d, place = ids[doc], starts - at[doc]
    order = np.lexsort((starts, place, d, b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    one = order[new]
    return np.array([a[one], b[one], d[one].astype(np.uint64), place[one].astype(np.uint64), starts[one].astype(np.uint64)]), out


def _ids(meta: list, key: str) -> np.ndarray:
    """Document ids for comparing, null last."""
    return np.array([np.iinfo(np.int64).max if m[key] is None else m[key] for m in meta], np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in arrays))


def _load(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _planes(values: np.ndarray, kind: str) -> np.ndarray:
    """The values' bytes, all first ones first, so that the high ones compress."""
    return np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), -1).T)


def _unplaned(data: bytes, kind: str, n: int, place: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, width * n, place).reshape(width, n).T).view(kind).ravel()


def _steps(ordered: np.ndarray) -> np.ndarray:
    """Differences of ascending keys; their sums give the keys back."""
    return _planes(np.diff(ordered, prepend=np.uint64(0)), "<u8")


def _dealt(keys: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """The places of the keys of each part."""
    part_of = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part_of, kind="stable")
    ends = np.cumsum(np.bincount(part_of, minlength=parts))
    return [(p, order[a:b]) for p, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if b > a]


def _answers(reply: pd.DataFrame, keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Flag and number of each key, from the parts' answers."""
    flags, numbers = np.zeros(len(keys), bool), np.zeros(len(keys), np.uint64)
    got = {p: (n, data) for p, n, data in zip(reply["part"], reply["n"], reply["data"], strict=True)}
    for p, mine in _dealt(keys, parts):
        n, data = got.get(p, (0, b""))
        if len(mine) != n:
            raise RuntimeError("a block's pairs differ between two scans: the input's rows came in another order")
        data = _load(data)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8), count=n).astype(bool)
        flags[mine] = bits
        if len(data) > (n + 7) // 8:
            numbers[mine[bits]] = np.frombuffer(data, "<u8", -1, (n + 7) // 8)
    return flags, numbers


def _gathered(batches, block_bytes: int) -> Iterator[tuple[int, list, list[bytes]]]:
    from pyspark import TaskContext

    block, meta, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
    for b in batches:
        for m, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            meta.append(m)
            texts.append((x or "").encode())
            held += len(texts[-1]) + 64
            if held >= block_bytes:
                yield block, meta, texts
                block, meta, texts, held = block + 1, [], [], 0
    if meta:
        yield block, meta, texts


def _packed_texts(texts: list[bytes]) -> bytes:
    """Texts of a block, compressed with all of the block in reach, as they are moved twice."""
    parameters = zstandard.ZstdCompressionParameters.from_level(6, window_log=23)
    lengths = np.fromiter(map(len, texts), "<u4", len(texts))
    return zstandard.ZstdCompressor(compression_params=parameters).compress(np.array([len(texts)], "<u4").tobytes() + lengths.tobytes() + b"".join(texts))


def _loaded_texts(blob: bytes) -> list[bytes]:
    data = _load(blob)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(data, "<u4", n, 4))).tolist()
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends[:-1]], ends, strict=True)] if n else []


def _cut(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words that are gone and the space before them."""
    if not gone.any():
        return text
    pieces = _WORDS.findall(text)
    left = b"".join(p for p, g in zip(pieces, gone, strict=True) if not g)
    return left.lstrip(b" \t\n\v\f\r") if gone[0] else left


_STATE, _ASK, _NEEDED = 0, 1, 2
_PACKED = "kind int, part int, block long, n long, data binary"
_ROWS = ("kind", "part", "block", "n", "data")


def _asks(block: int, keys: np.ndarray, parts: int, twice: np.ndarray) -> list[tuple]:
    """Requests of a block for its distinct pairs, which are in order."""
    return [(_ASK, p, block, len(i), _pack(_steps(keys[i]), twice[i].astype(np.uint8))) for p, i in _dealt(keys, parts)]


def _window_asks(block: int, found: np.ndarray, parts: int) -> list[tuple]:
    """Requests for distinct windows: 96 bits of their names, and document and place of the first of each."""
    out = []
    for p, i in _dealt(found[0], parts):
        docs, which = np.unique(found[2, i], return_inverse=True)
        data = _pack(_steps(found[0, i]), _planes(found[1, i] & np.uint64(0xFFFFFFFF), "<u4"), _planes(which, "<u4"), _planes(found[3, i], "<u4"), docs)
        out.append((_ASK, p, block, len(i), data))
    return out


def _asked_windows(blob: bytes, n: int) -> np.ndarray:
    data = _load(blob)
    a = np.cumsum(_unplaned(data, "<u8", n, 0), dtype=np.uint64)
    b, which, place = (_unplaned(data, "<u4", n, (8 + 4 * k) * n).astype(np.uint64) for k in range(3))
    return np.array([a, b, np.frombuffer(data, np.uint64, -1, 20 * n)[which.astype(np.int64)], place])


def name_table(part: pd.DataFrame, r: int, parts: int) -> pd.DataFrame:
    """The round's names of a part: for each block which of its pairs the corpus holds twice, and their global names."""
    n = part["n"].to_numpy()
    loaded = [_load(x) for x in part["data"]]
    keys = np.concatenate([np.cumsum(_unplaned(x, "<u8", k, 0), dtype=np.uint64) for x, k in zip(loaded, n, strict=True)])
    twice = np.concatenate([np.frombuffer(x, np.uint8, k, 8 * k) for x, k in zip(loaded, n, strict=True)]).astype(bool)
    names, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    shared = times > 1
    shared[which[twice]] = True
    number = (np.cumsum(shared) - 1) * parts + int(part["part"].iloc[0]) + (r << 56)
    flags, numbers, ends = shared[which], number[which].astype("<u8"), np.cumsum(n)
    data = [_pack(np.packbits(flags[a:b]), numbers[a:b][flags[a:b]]) for a, b in zip(ends - n, ends, strict=True)]
    return pd.DataFrame({"block": part["block"], "part": part["part"], "n": n, "data": data})


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, digests: bool = False, layout: bool = False, block_bytes: int = BLOCK_BYTES, parts: int | None = None) -> DataFrame:
    """All columns but the text, then n_words, n_removed and ``kept``, the words left, joined by a space.

    With ``layout`` the words left keep the space before them, and a text that loses none
    stays as it is.  With ``digests`` kept_sha256 stands for ``kept``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    results = ("n_words", "n_removed", "kept_sha256" if digests else "kept")
    others = [f for f in docs.schema.fields if f.name != text and f.name not in results]
    meta = F.struct(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(others)])
    key = f"c{[f.name for f in others].index(doc_id)}"
    meta_type = meta_schema(docs, others)
    rows = docs.select(meta.alias("meta"), F.col(f"`{text}`").alias("text"))
    parts = parts or max(8, rows.rdd.getNumPartitions() // 2)
    frame = lambda found: pd.DataFrame(found, columns=list(_ROWS))

    def ask_first(batches):
        for block, _, x in _gathered(batches, block_bytes):
            s = block_symbols(t.split() for t in x)
            s.pair(1)
            found = _asks(block, s.keys, parts, s.twice)
            yield dict(zip(_ROWS, map(list, zip(*found, strict=True)), strict=True)) if found else {c: [] for c in _ROWS}

    def texts(batches):
        for block, m, x in _gathered(batches, block_bytes):
            yield {"block": [block], "meta": [m], "texts": [_packed_texts(x)]}

    def opened(text: pd.DataFrame):
        return list(text["meta"].iloc[0]), _loaded_texts(text["texts"].iloc[0])

    def advance(block: int, s: Symbols, r: int, last: bool) -> list[tuple]:
        """Rows of a block after round ``r``: its symbols, and its pairs of the next round."""
        if not s.live.any():
            return []
        if last:
            return [(_STATE, 0, block, 0, s.packed())]
        state = (_STATE, 0, block, 0, s.packed())
        s.pair(r + 1)
        return [state, *_asks(block, s.keys, parts, s.twice)]

    def first_round(text: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        if not len(text):
            return frame([])
        m, x = opened(text)
        s = block_symbols(t.split() for t in x)
        s.pair(1)
        s = s.settle(*_answers(reply, s.keys, parts))
        block = int(text["block"].iloc[0])
        found = advance(block, s, 1, ROUNDS == 1)
        if found:  # the words that are still needed, for verification
            needed = cover(s.live)
            mine = [needed[a:b] for a, b in zip(s.at[:-1], s.at[1:], strict=True)]
            some = b" ".join([b" ".join(compress(t.split(), n)) for t, n in zip(x, mine, strict=True) if n.any()])
            found.append((_NEEDED, 0, block, len(m), _pack(_ids(m, key), np.packbits(needed), np.frombuffer(some, np.uint8))))
        return frame(found)

    def next_round(r: int):
        def run(state: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
            if not len(state):
                return frame([])
            s = Symbols.loaded(state["data"].iloc[0])
            s.pair(r)
            s = s.settle(*_answers(reply, s.keys, parts))
            return frame(advance(int(state["block"].iloc[0]), s, r, r == ROUNDS))

        return run

    def windows_of(state: pd.DataFrame, words: pd.DataFrame):
        """Live starts, distinct windows and the number of each start, of a block."""
        s = Symbols.loaded(state["data"].iloc[0])
        n, data = int(words["n"].iloc[0]), _load(words["data"].iloc[0])
        ids = np.frombuffer(data, np.int64, n)
        bits = (len(s.live) + 7) // 8
        then = np.unpackbits(np.frombuffer(data, np.uint8, bits, 8 * n), count=len(s.live)).astype(bool)
        kept = data[8 * n + bits :].split()
        now = cover(s.live)
        starts = np.flatnonzero(s.live)
        return s, starts, *distinct_windows([kept[i] for i in np.flatnonzero(now[then])], now, starts, s.at, ids)

    def ask_windows(state: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        if not len(state):
            return frame([])
        _, _, found, _ = windows_of(state, words)
        return frame(_window_asks(int(state["block"].iloc[0]), found, parts))

    def find_first(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")  # equal ids: the order of the scan
        n = part["n"].to_numpy()
        a, b, d, place = np.concatenate([_asked_windows(x, k) for x, k in zip(part["data"], n, strict=True)], axis=1)
        order = np.lexsort((np.repeat(np.arange(len(n)), n), place, d.astype(np.int64), b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        is_first = np.empty(len(order), bool)
        is_first[order] = new
        return pd.DataFrame({"block": part["block"], "part": part["part"], "n": n, "data": [_pack(np.packbits(x)) for x in np.split(is_first, np.cumsum(n)[:-1])]})

    def removed(held: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        """The words of a block that go, as flags."""
        if not len(held):
            return pd.DataFrame({"block": [], "gone": []})
        s, starts, found, number = windows_of(held[held["kind"] == _STATE], held[held["kind"] == _NEEDED])
        first, _ = _answers(reply, found[0], parts)
        own = np.zeros(len(s.live), bool)
        own[found[4][first].astype(np.int64)] = True
        gone = np.zeros(len(s.live), bool)
        gone[starts[~own[starts]]] = True
        return pd.DataFrame({"block": [int(held["block"].iloc[0])], "gone": [_pack(np.packbits(cover(gone)))]})

    def finish(text: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        m, x = opened(text)
        out = np.unpackbits(np.frombuffer(_load(reply["gone"].iloc[0]), np.uint8)).astype(bool) if len(reply) else None
        n, gone, kept, at = [], [], [], 0
        for t in x:
            w = t.split()
            mine = np.zeros(len(w), bool) if out is None else out[at : at + len(w)]
            k = int(mine.sum())
            left = _cut(t, mine) if layout else b" ".join(compress(w, ~mine) if k else w)
            at += len(w)
            n.append(len(w))
            gone.append(k)
            kept.append(hashlib.sha256(left).hexdigest() if digests else left.decode())
        columns = {f"c{i}": pd.Series([r[f"c{i}"] for r in m], dtype=object) for i in range(len(others))}
        return pd.DataFrame(columns | {"n_words": n, "n_removed": gone, "kept": kept})

    packed_schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
    text_schema = pa.schema([("block", pa.int64()), ("meta", pa.list_(to_arrow_type(meta_type))), ("texts", pa.binary())])
    blocks = rows.mapInArrow(arrow_map(texts, text_schema), f"block long, meta array<{meta_type.simpleString()}>, texts binary")
    told = "block long, part int, n long, data binary"

    def table(asked: DataFrame, r: int) -> DataFrame:
        return asked.groupBy("part").applyInPandas(lambda part: name_table(part, r, parts), told)

    state = staged(blocks.groupBy("block").cogroup(table(rows.mapInArrow(arrow_map(ask_first, packed_schema), _PACKED), 1).groupBy("block")).applyInPandas(first_round, _PACKED), "round-1")
    release(spark)  # texts and pairs of the first round
    words = staged(state.where(F.col("kind") == _NEEDED), "needed-words")
    for r in range(2, ROUNDS + 1):
        reply = table(state.where(F.col("kind") == _ASK), r)
        before = state
        state = staged(state.where(F.col("kind") == _STATE).groupBy("block").cogroup(reply.groupBy("block")).applyInPandas(next_round(r), _PACKED), f"round-{r}")
        unstage(before)
        release(spark)
    left = state.where(F.col("kind") == _STATE)
    asked = left.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(ask_windows, _PACKED)
    first = asked.groupBy("part").applyInPandas(find_first, told)
    held = left.unionByName(words.join(left.select("block"), "block", "left_semi"))
    gone = held.groupBy("block").cogroup(first.groupBy("block")).applyInPandas(removed, "block long, gone binary")
    fields = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(others)] + ["n_words long, n_removed long, kept string"])
    done = blocks.groupBy("block").cogroup(gone.groupBy("block")).applyInPandas(finish, fields)
    return done.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(others)], "n_words", "n_removed", F.col("kept").alias(results[2]))


def meta_schema(docs: DataFrame, others: list):
    return StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(others)])
