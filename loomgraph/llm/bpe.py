"""Byte-level BPE encoding and decoding through a distinct-word table.

Texts are split into pre-tokens ("words") by the tokenizer's own pattern.  The scan
gathers texts into blocks of about ``block_bytes`` and sends, for each block, its
distinct words, dealt by hash into parts and packed (sorted, compressed).  The task of a
part holds the distinct-word table of that part: each distinct word of the corpus is
encoded once, there, and the ids go back to every block that asked, in the order of the
block's words.  A block then joins ids to its words by position and writes each text's
ids; decoding joins the ids with the id-to-piece table, which is as long as the
vocabulary.  So what moves is one compressed copy of the text, and each block's distinct
words and their ids; a frequent word is sent once a block, never once an occurrence.

Special tokens in a text are found first, as the tokenizer does by default.

``docs`` is scanned twice, once for words and once for texts, so its rows must come in
the same order both times, as those of a file scan do; :func:`loomgraph.llm.common.staged`
makes it so for others.  A block whose words don't fit their ids raises an error.

Edge cases: null text is encoded as the empty text (no ids); repeated rows and null ids
stay rows of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import arrow_map, small_batches

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_BYTES = 16 << 20
CHUNK_BYTES = 1 << 20


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Splitter, encoder and piece table of a byte-level BPE tokenizer file."""

    def __init__(self, content: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(content)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN).findall
        letters = byte_letters()
        self.pieces = [b""] * (1 + max([*spec["model"]["vocab"].values(), *self.special.values()], default=0))
        for piece, i in spec["model"]["vocab"].items():
            self.pieces[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        for piece, i in self.special.items():
            self.pieces[i] = piece.encode()

    def split(self, text: str) -> list[str]:
        """Words, with special tokens as words of their own."""
        if self.cut is None or not any(x in text for x in self.special):
            return self.words(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.words(part)
        return out

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        got = self.tokenizer.encode_batch(words, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in got]

    def decode(self, ids: bytes) -> str:
        """Join with the id-to-piece table; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _pack(items: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, items), "<u4", len(items))
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<I", len(items)) + lengths.tobytes() + b"".join(items))


def _unpack(blob: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<I", data)[0]
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4)).tolist()
    at = 4 + 4 * n
    return [data[at + a : at + b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if n else []


def _parts(words, parts: int) -> list[list[bytes]]:
    """Distinct words by part, sorted."""
    out: list[list[bytes]] = [[] for _ in range(parts)]
    for w in words:
        w = w.encode()
        out[zlib.crc32(w) % parts].append(w)
    for p in out:
        p.sort()
    return out


def _blocks(batches, block_bytes: int):
    """(block number, ids, texts) runs of a task's rows; a block is closed once it holds ``block_bytes``."""
    from pyspark import TaskContext

    block, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
    for b in batches:
        for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(d)
            texts.append(x or "")
            held += len(texts[-1]) + 16
            if held >= block_bytes:
                yield block, ids, texts
                block, ids, texts, held = block + 1, [], [], 0
    if ids:
        yield block, ids, texts


def encode_decode(docs: DataFrame, tokenizer_json: str, doc_id: str = "doc_id", text: str = "text", *, digests: bool = False, block_bytes: int = BLOCK_BYTES, parts: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded text of each row.

    With ``digests`` their SHA-256 instead: ids_sha256, decoded_sha256.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    parts = parts or max(8, rows.rdd.getNumPartitions())
    shipped = spark.sparkContext.broadcast(tokenizer_json)

    def words(batches):
        v = Vocabulary(shipped.value)
        for block, _, texts in _blocks(batches, block_bytes):
            found: set[str] = set()
            for x in texts:
                found.update(v.split(x))
            packed = [(p, _pack(w)) for p, w in enumerate(_parts(found, parts)) if w]
            yield {"part": [p for p, _ in packed], "block": [block] * len(packed), "words": [w for _, w in packed]}

    def texts(batches):
        for block, ids, texts in _blocks(batches, block_bytes):
            at = 0
            while at < len(ids):
                end, held = at, 0
                while end < len(ids) and (held < CHUNK_BYTES or end == at):
                    held += len(texts[end])
                    end += 1
                blob = _pack([x.encode() for x in texts[at:end]])
                yield {"block": [block], "place": [at], "ids": [ids[at:end]], "texts": [blob]}
                at = end

    def encode(part: pd.DataFrame) -> pd.DataFrame:
        v = Vocabulary(shipped.value)
        asked = [_unpack(x) for x in part["words"]]
        table = list({w for ws in asked for w in ws})
        ids = dict(zip(table, v.encode([w.decode() for w in table]), strict=True))
        return pd.DataFrame({"block": part["block"], "part": part["part"], "ids": [_pack([ids[w] for w in ws]) for ws in asked]})

    def join(text: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        v = Vocabulary(shipped.value)
        number: dict[str, int] = {}
        docs: list[tuple[int | None, np.ndarray]] = []
        for ids, blob in text.sort_values("place")[["ids", "texts"]].itertuples(index=False):
            for d, x in zip(ids, _unpack(blob), strict=True):
                ws = v.split(x.decode())
                docs.append((d, np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int32, len(ws))))
        got = {p: _unpack(x) for p, x in zip(reply["part"], reply["ids"], strict=True)}
        table: list[bytes] = [b""] * len(number)
        for p, ws in enumerate(_parts(number, parts)):
            if len(ws) != len(got.get(p, [])):
                raise RuntimeError("a block's words differ between the two scans: the input's rows came in another order")
            for w, ids in zip(ws, got.get(p, []), strict=True):
                table[number[w.decode()]] = ids
        out = []
        for d, places in docs:
            ids = b"".join(map(table.__getitem__, places.tolist()))
            decoded = v.decode(ids)
            if digests:
                out.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            else:
                out.append((d, len(ids) // 4, ids, decoded))
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
        frame = pd.DataFrame(out, columns=names)
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    asked = rows.mapInArrow(arrow_map(words, pa.schema([("part", pa.int32()), ("block", pa.int64()), ("words", pa.binary())])), "part int, block long, words binary")
    replies = asked.groupBy("part").applyInPandas(encode, "block long, part int, ids binary")
    packed = rows.mapInArrow(arrow_map(texts, pa.schema([("block", pa.int64()), ("place", pa.int32()), ("ids", pa.list_(pa.int64())), ("texts", pa.binary())])), "block long, place int, ids array<long>, texts binary")
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, n_tokens long, ids binary, decoded string"
    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(join, out)
