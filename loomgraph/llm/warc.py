"""WARC captures and the resolution of not-modified revisits.

A revisit record with profile server-not-modified (a 304 answer) has no body: what the
server stood by is the latest earlier full response of the same canonical URL.
:func:`resolve` finds it with an as-of join, checks the validators (entity tags by weak
comparison; without a tag on both sides, last-modified), and merges the headers: those of
the stored response, replaced by those of the 304, except the fields that a 304 may not
change (body fields and hop-by-hop fields).

The as-of join is exact and has no hot task.  Captures are first summed up by URL and
second: of all responses of a second the last one.  A window within a time slice (at most
``slice_seconds`` rows) carries the last response forward, and a second window over one
row a slice carries it across slices.  The revisits join the answer of their URL and
second, which is one row, so a hot side can be split.  Bodies don't move.

Each revisit gets ``status``: ``resolved``; ``mismatch`` if the validators
differ; ``unchecked`` if neither side has a validator to compare; ``orphan`` without an
earlier response.

Edge cases: equal times: a response counts as earlier than a revisit at its time; of
responses at one time the larger id is the later (then the larger validators and headers).
A response whose ``status_code`` is not 200 is not full and is passed over; without that
column, or where it is null, it counts as 200.  A null URL or time matches nothing; such a
revisit is an ``orphan`` with ``unkeyed`` and has no row without.  Each revisit row has
one result row: repeated revisits have repeated results, and repeated responses add none.
Header names differ by more than case: of names that differ by case alone the last in byte
order counts, and merged headers have lower-case names.  Null headers are none; values of
any length pass.  Extra columns, of any name, are ignored; an empty table gives an empty result.

:func:`write` and :func:`read` are the files: WARC files, one gzip member a record.
"""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import arrow_map, small_batches

# Fields of a stored response that a 304 doesn't replace (HTTP caching, connection and body fields).
KEPT_FIELDS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
SLICE_SECONDS = 86_400
FILE_BYTES = 1 << 30


def canonical_url(url: Column) -> Column:
    """Key under which captures of one page meet.

    Scheme, user, ``www.``, default ports, fragment and tracking parameters
    (``utm_*``, ``ref``) are dropped, the host is lower-cased, a trailing slash or ``?`` goes.
    """
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    u = F.regexp_replace(u, "^[^/?@]*@", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), ":(80|443)$", ""), "^www[0-9]*[.]", "")
    rest = F.regexp_replace(u, "^[^/?]*", "")
    rest = F.regexp_replace(rest, "([?&])(utm_[a-z]+|ref)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "[?]&+", "?"), "&&+", "&")
    rest = F.regexp_replace(rest, "[?&/]+$", "")
    return F.concat(host, rest)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def lower_names(headers: Column) -> Column:
    """The map with lower-case names; of names that differ by case the last in byte order counts; null is none."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]))


def latest_response(captures: DataFrame, slice_seconds: int = SLICE_SECONDS, unkeyed: bool = False) -> DataFrame:
    """record_id, url_key, validators and headers of each revisit, and ``found``: those of the latest earlier full response (or null).

    ``captures``: record_id, url, ts (seconds), kind ('response' or 'revisit'), etag, last_modified, headers,
    and status_code, if it has one.
    """
    code = F.col("status_code").cast("int") if "status_code" in captures.columns else F.lit(None).cast("int")
    rows = captures.select(canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), F.col("record_id").cast("long").alias("record_id"), "kind", "etag", "last_modified", lower_names(F.col("headers")).alias("headers"), F.coalesce(code, F.lit(200)).alias("code"))
    keyed = rows.where("url_key is not null and ts is not null").withColumn("slice", F.floor(F.col("ts") / slice_seconds))
    own = F.struct("record_id", "etag", "last_modified", "headers")
    full = (F.col("kind") == "response") & (F.col("code") == 200)
    order = F.when(full, F.struct("record_id", "etag", "last_modified", F.to_json(F.map_entries("headers"))))
    moments = keyed.where(full | (F.col("kind") == "revisit")).groupBy("url_key", "slice", "ts").agg(F.max_by(own, order).alias("full"), F.max(F.col("kind") == "revisit").alias("asks"))
    moments = moments.withColumn("near", F.last("full", ignorenulls=True).over(Window.partitionBy("url_key", "slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = moments.groupBy("url_key", "slice").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.col("ts"))).alias("end"))
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("far", F.last("end", ignorenulls=True).over(before)).select("url_key", "slice", "far")
    answers = moments.where("asks").join(ends, ["url_key", "slice"]).select("url_key", "ts", F.coalesce("near", "far").alias("found"))
    asked = keyed.where("kind = 'revisit'").select("url_key", "ts", "record_id", "etag", "last_modified", "headers")
    matched = asked.join(answers, ["url_key", "ts"], "left").drop("ts")
    if not unkeyed:
        return matched
    keyless = rows.where("kind = 'revisit' and (url_key is null or ts is null)")
    return matched.unionByName(keyless.select("url_key", "record_id", "etag", "last_modified", "headers", F.lit(None).cast(matched.schema["found"].dataType).alias("found")))


def resolve(captures: DataFrame, slice_seconds: int = SLICE_SECONDS, unkeyed: bool = False) -> DataFrame:
    """record_id, url_key, status, response_id and merged ``headers`` of each revisit.

    With ``unkeyed`` also of revisits without a URL or time, which are orphans.
    """
    tags = F.col("etag").isNotNull() & F.col("found.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("found.last_modified").isNotNull()
    same = F.when(tags, _weak(F.col("etag")) == _weak(F.col("found.etag"))).when(dates, F.col("last_modified") == F.col("found.last_modified"))
    status = F.when(F.col("found").isNull(), "orphan").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    new = F.map_filter("headers", lambda k, _: ~k.isin(*KEPT_FIELDS))
    old = F.map_filter("found.headers", lambda k, _: ~F.array_contains(F.map_keys(new), k))
    merged = F.when(status == "resolved", F.map_concat(old, new))
    return latest_response(captures, slice_seconds, unkeyed).select("record_id", "url_key", status.alias("status"), F.col("found.record_id").alias("response_id"), merged.alias("headers"))


def _head(fields: dict[str, str]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode()


def record_bytes(kind: str, url: str, date: str, headers: dict[str, str] | None, body: bytes | None, record_id: int) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    revisit = kind == "revisit"
    http = (b"HTTP/1.1 304 Not Modified\r\n" if revisit else b"HTTP/1.1 200 OK\r\n") + _head(headers or {}) + b"\r\n" + (b"" if revisit else body or b"")
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.UUID(int=record_id & (1 << 128) - 1)}>", "WARC-Date": date, "WARC-Target-URI": url, "Content-Type": "application/http;msgtype=response"}
    if revisit:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
    fields["Content-Length"] = str(len(http))
    return gzip.compress(b"WARC/1.1\r\n" + _head(fields) + b"\r\n" + http + b"\r\n\r\n", mtime=0)


def _fields(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, content) of each record of a plain or gzip WARC file, read as it goes; a damaged tail ends the file."""
    head = stream.read(2)
    stream.seek(0)
    if head == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)
    try:
        while True:
            line = stream.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                continue
            block = b""
            while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                block += line
            fields = _fields(block)
            length = int(fields.get("content-length", "0"))
            content = stream.read(length)
            if len(content) < length:
                return
            yield fields, content
    except (EOFError, OSError, zlib.error, ValueError):
        return


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it; a path without a scheme is local."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write(captures: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> list[str]:
    """Write captures (record_id, url, date, kind, headers, body) as WARC files and return their names.

    A partition fills ``part-<partition>-<number>.warc.gz`` one after another, each up to about
    ``file_bytes``.  A file is moved to its name once it is whole, and a retried task writes
    the same names, so a lost executor leaves no half or double file.  ``path`` must be in a store that
    the executors share (a URI that pyarrow knows, or a mounted folder).
    """

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, folder = _store(path)
        fs.create_dir(folder, recursive=True)
        stem = f"{folder}/part-{task.partitionId():05d}"
        number, out, held = 0, None, 0
        own = f"{folder}/_{task.taskAttemptId()}.tmp"

        def close():
            out.close()
            fs.move(own, f"{stem}-{number:05d}.warc.gz")
            return {"path": [f"{stem}-{number:05d}.warc.gz"]}

        for b in batches:
            c = {n: b.column(i).to_pylist() for i, n in enumerate(("record_id", "url", "date", "kind", "headers", "body"))}
            for r, u, d, k, h, x in zip(*c.values(), strict=True):
                data = record_bytes(k, u or "", d or "", dict(h or []), x, r or 0)
                if out is None:
                    out, held = fs.open_output_stream(own), 0
                out.write(data)
                held += len(data)
                if held >= file_bytes:
                    yield close()
                    number, out = number + 1, None
        if out is not None:
            yield close()

    small_batches(captures.sparkSession)
    rows = captures.select("record_id", "url", "date", "kind", "headers", "body")
    return sorted(r[0] for r in rows.mapInArrow(arrow_map(run, pa.schema([("path", pa.string())])), "path string").collect())


def read(spark: SparkSession, path: str) -> DataFrame:
    """url, date, kind, status_code, headers and body of the records of the WARC files under ``path``, a task a file.

    A file is read as a stream, so its length isn't bounded; a record is one row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")  # lists, and reads no content
    texts = pa.map_(pa.string(), pa.string())
    schema = pa.schema([("url", pa.string()), ("date", pa.string()), ("kind", pa.string()), ("status_code", pa.int32()), ("headers", texts), ("body", pa.binary())])

    def parse(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, at = _store(name)
                with fs.open_input_file(at) as stream:
                    for fields, content in records(stream):
                        head, _, body = content.partition(b"\r\n\r\n")
                        first, _, rest = head.partition(b"\r\n")
                        code = first.split()[1:2]
                        yield {"url": [fields.get("warc-target-uri")], "date": [fields.get("warc-date")], "kind": [fields.get("warc-type")], "status_code": [int(code[0]) if code and code[0].isdigit() else None], "headers": pa.array([list(_fields(rest).items())], texts), "body": [body]}

    return files.mapInArrow(arrow_map(parse, schema), "url string, date string, kind string, status_code int, headers map<string,string>, body binary")
