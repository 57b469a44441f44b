"""WARC archives and a two-level capture index: sorted reversed-host keys in compressed blocks, and a sparse block directory."""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path
from .common import kept

_URL = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?(.*)", re.DOTALL)
_LENGTH = re.compile(rb"\r\ncontent-length: *([0-9]+)", re.IGNORECASE)
ENTRY = "url_key string, page_id bigint, file string, offset bigint, length bigint"


def url_key(url: str | None) -> str:
    """Reversed-host key: `http://blog.example.com/a?b` is `com,example,blog)/a?b`; other texts stand behind a `)`; null is empty."""
    if url is None:
        return ""
    m = _URL.fullmatch(url)
    if not m:
        return ")" + url
    return ",".join(reversed(m[2].lower().split("."))) + (m[3] or "") + ")" + (m[4] or "/")


def _first(row: list) -> str:
    return row[0]


def _open_folder(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (pyarrow.fs.LocalFileSystem(), folder)


def _record(kind: str, date: str, page: int | None, url: str | None, payload: bytes, refers: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, which tells the payload's length, and leaves the payload out."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{'uuid:' + str(uuid.uuid4()) if page is None else f'page:{page}'}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Type, page id, payload length and digest of a record; those of a response are taken from its payload itself."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.decode().lower(): v.decode() for k, _, v in (line.partition(b": ") for line in head.split(b"\r\n")[1:])}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page, refers = (re.fullmatch(r"<urn:page:(-?[0-9]+)>", fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
    out = {"kind": fields["warc-type"], "page": int(page[1]) if page else None, "refers": int(refers[1]) if refers else None}
    if out["kind"] == "revisit":
        return out | {"bytes": int(_LENGTH.search(http)[1]), "digest": base64.b32decode(fields["warc-payload-digest"][5:]).hex(), "payload": None}
    return out | {"bytes": len(payload), "digest": hashlib.sha1(payload).hexdigest(), "payload": payload}


def write_archives(pages: DataFrame, folder: str, least: int = 1_000, roll: int = 256 << 20, date: str = "1970-01-01T00:00:00Z",
                   id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per page into .warc.gz files of about `roll` bytes, one gzip member a record, and return their
    places: (url_key, page_id, file, offset, length). Equal payloads of `least` bytes or more are stored once, at the largest
    page id. A task that runs again writes files of new names; only the places of the run that counted are kept."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= least, F.sha1("html")))
    first = kept(rows.where("digest IS NOT NULL").groupBy("digest").agg(F.max("page").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "payloads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open_folder(folder)
        fs.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for b in batches:
                found = [[], [], [], [], []]
                for page, url, html, original in zip(*(c.to_pylist() for c in b.columns)):
                    if out is None or at >= roll:
                        if out is not None:
                            out.close()
                        name = f"pages-{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                        at = out.write(gzip.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode(), mtime=0))
                    again = original is not None and page != original
                    member = gzip.compress(_record("revisit" if again else "response", date, page, url, html.encode(), original), 6, mtime=0)
                    for column, v in zip(found, (url_key(url), page, name, at, len(member))):
                        column.append(v)
                    out.write(member)
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.string()),
                                                  pa.array(found[3], pa.int64()), pa.array(found[4], pa.int64())], names=["url_key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return kept(rows.join(first, "digest", "left").select("page", "url", "html", "first").mapInArrow(run, ENTRY), "places")


def write_index(places: DataFrame, folder: str, block: int = 2_000, per_shard: int = 100_000, most_shards: int = 10_000) -> DataFrame:
    """Sort the places by key into shards of compressed blocks; each shard has a directory of its blocks' first keys.
    Returns one row per shard: (first_key, last_key, file, directory_at, directory_length, number), of which there are at most
    `most_shards`: with more captures the shards grow, and with them the directories, not the table of shards."""
    number = max(1, min(most_shards, -(-places.count() // per_shard)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open_folder(folder)
        fs.create_dir(path, recursive=True)
        name = f"index-{uuid.uuid4().hex}.gz"
        out, at, held, directory, last = None, 0, [], [], ""

        def flush() -> None:
            nonlocal at, out
            if out is None:
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            data = gzip.compress("\n".join(map(json.dumps, held)).encode(), 6, mtime=0)
            directory.append([held[0][0], at, len(data)])
            out.write(data)
            at += len(data)
            held.clear()

        for b in batches:
            for entry in zip(*(c.to_pylist() for c in b.columns)):
                held.append(entry)
                last = entry[0]
                if len(held) == block:
                    flush()
        if held:
            flush()
        if out is not None:
            data = gzip.compress(json.dumps(directory).encode(), 6, mtime=0)
            out.write(data)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (directory[0][0], last, name, at, len(data), len(directory))],
                                             names=["first_key", "last_key", "file", "directory_at", "directory_length", "number"])

    ordered = places.repartitionByRange(number, "url_key", "page_id", "file", "offset").sortWithinPartitions("url_key", "page_id", "file", "offset")
    return kept(ordered.mapInArrow(run, "first_key string, last_key string, file string, directory_at bigint, directory_length bigint, number bigint"), "shards")


def look_up(keys: DataFrame, shards: DataFrame, folder: str, key_col: str = "url_key") -> DataFrame:
    """All places of the given distinct keys. First the shards and then their directories are searched by bisection, which
    gives the blocks that may hold a key; each such block is read once, by range, and searched for its keys. A key whose
    captures fill many blocks becomes a row per block, so that no task holds them all."""
    rows = sorted((r["first_key"], r["file"], r["last_key"], r["directory_at"], r["directory_length"]) for r in shards.collect())
    firsts, lasts = [r[0] for r in rows], [r[2] for r in rows]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open_folder(folder)
        loaded: dict[str, list] = {}
        for b in batches:
            found = [[], [], [], []]
            for key in b.column(0).to_pylist():
                for s in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    _, file, _, at, size = rows[s]
                    if file not in loaded:
                        if len(loaded) >= 64:
                            loaded.clear()
                        with fs.open_input_file(f"{path}/{file}") as f:
                            loaded[file] = json.loads(gzip.decompress(f.read_at(size, at)))
                    directory = loaded[file]
                    low = max(0, bisect.bisect_left(directory, key, key=_first) - 1)
                    for d in directory[low:bisect.bisect_right(directory, key, key=_first)]:
                        for column, v in zip(found, (key, file, d[1], d[2])):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.int64()), pa.array(found[3], pa.int64())],
                                             names=["key", "file", "at", "size"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open_folder(folder)
        now, lines, heads, handle, handle_of = None, [], [], None, None
        for b in batches:
            found: list = []
            for key, file, at, size in zip(*(c.to_pylist() for c in b.columns)):
                if (file, at) != now:
                    if file != handle_of:
                        handle, handle_of = fs.open_input_file(f"{path}/{file}"), file
                    now, lines = (file, at), [json.loads(x) for x in gzip.decompress(handle.read_at(size, at)).decode().split("\n")]
                    heads = [x[0] for x in lines]
                found += lines[bisect.bisect_left(heads, key):bisect.bisect_right(heads, key)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                                             names=["url_key", "page_id", "file", "offset", "length"])

    asked = keys.select(F.col(key_col).alias("key")).sort("key").mapInArrow(blocks, "key string, file string, at bigint, size bigint")
    return asked.repartition("file", "at").sortWithinPartitions("file", "at", "key").mapInArrow(entries, ENTRY)


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """Read the records at the given places, in order of file and offset:
    (page_id, payload_bytes, payload_digest, record_type, refers_to, payload)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open_folder(folder)
        handle, handle_of = None, None
        for b in batches:
            for at in range(0, b.num_rows, 500):
                out = [[], [], [], [], [], []]
                for file, offset, length in zip(*(c.to_pylist() for c in b.slice(at, 500).columns)):
                    if file != handle_of:
                        handle, handle_of = fs.open_input_file(f"{path}/{file}"), file
                    r = parse_record(zlib.decompress(handle.read_at(length, offset), 31))
                    for column, v in zip(out, (r["page"], r["bytes"], r["digest"], r["kind"], r["refers"], r["payload"])):
                        column.append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    ordered = places.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def url_keys(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct keys of a table's URLs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({url_key(u) for u in b.column(0).to_pylist()}), pa.string())], names=["url_key"])
    return pages.select(url_col).mapInArrow(run, "url_key string").distinct()


def archive_round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive all pages, index them, look every URL up and read the records found, one row per input row.

    Null HTML is an empty payload, a null URL has the empty key and no target URI, a null page id comes back as null and is
    never the one that others refer to; rows of equal page id and payload are responses all. Texts of any length are whole records. Other columns
    are left aside; an empty table gives an empty result and an index without shards.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    shards = write_index(write_archives(pages, folder, id_col=id_col, url_col=url_col, html_col=html_col), folder)
    return read_records(look_up(url_keys(pages, url_col), shards, folder), folder)
