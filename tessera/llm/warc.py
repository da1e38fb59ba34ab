"""WARC archives: writing, normalising whole-file gzip to one member per record, and reading back through an offset index.

An archive that is one gzip stream can only be read from its start. The normaliser inflates each such file once, rewrites
every record as a gzip member of its own, and writes a sidecar with each record's offset, so that later reads can seek.
Archives go to the cluster's shared folder; each file is written under a name of its own attempt and only files that a
finished task reports are read, so a task that is lost or run twice does no harm.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, table

SMALLEST = 100
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
_BREAK = b"\r\n\r\n"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _clean(value: str) -> str:
    """A header value: blanks and control characters, which a reader would strip or take for its end, are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in value)


def record_id(page_id, url: str | None, digest: str, copy: int) -> str:
    """A record's identifier: the same whenever the row is written again; copy tells repeated rows apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([str(page_id), url, digest, copy]))}>"


def record(row: dict) -> bytes:
    """One WARC record of a classified row, uncompressed. A revisit carries headers only."""
    page_id, url, digest, size, first = row["page_id"], row["url"], row["payload_digest"], row["payload_bytes"], row["refers_to"]
    revisit = row["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {size}".encode() + _BREAK
    block = http + (b"" if revisit else row["payload"])
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(page_id, url, digest, row['copy'])}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page_id is not None:
        head.append(f"X-Page-ID: {json.dumps(str(page_id))}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Date: {DATE}"]
        if row["refers_url"] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_clean(row['refers_url'])}")
        if not row["refers_repeated"]:
            head.append(f"WARC-Refers-To: {record_id(first, row['refers_url'], digest, 0)}")
        head += [f"X-Refers-To-Page-ID: {json.dumps(str(first))}", f"X-Payload-Length: {size}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _BREAK + block + _BREAK


def headers(raw: bytes) -> dict[str, str]:
    """The fields of a record's or message's head, names in lower case; its first line is under the empty name."""
    first, *rest = raw.decode("utf-8", "replace").split("\r\n")
    return {"": first} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}


def inflate(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The bytes of a gzip stream, whatever number of members it has, some at a time; one that is cut off is an error."""
    unzip, inside = zlib.decompressobj(31), False
    while data := read(CHUNK):
        while data:
            inside = True
            yield unzip.decompress(data, 4 * CHUNK)
            while unzip.unconsumed_tail:
                yield unzip.decompress(unzip.unconsumed_tail, 4 * CHUNK)
            data = unzip.unused_data
            if unzip.eof:
                unzip, inside = zlib.decompressobj(31), False
    yield unzip.flush()
    if inside and not unzip.eof:
        raise ValueError("an archive ends inside a gzip member")


def records(parts: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(head, block) of each record of an inflated archive; holds one record at a time."""
    have, head, need = bytearray(), None, 0
    for part in parts:
        have += part
        while True:
            if head is None:
                at = have.find(_BREAK)
                if at < 0:
                    break
                head = bytes(have[:at])
                need = int(headers(head)["content-length"])
                del have[: at + 4]
            if len(have) < need + 4:
                break
            yield head, bytes(have[:need])
            del have[: need + 4]
            head = None
    if head is not None or have.strip():
        raise ValueError("an archive ends inside a record")


def classify(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, ...), one row per page.

    Digests are summed to the smallest page before the shuffle, so a payload that a third of all pages share is one row per
    task. The digests that occur twice are written, so that Spark knows whether they are few enough to go to the pages; if not,
    adaptive execution splits the common ones. The same holds for page ids that occur twice, whose rows get a ``copy`` number.
    """
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    twice = scratch.write(p.groupBy("page_id").count().where("count > 1").select(F.col("page_id").alias("twice")))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", F.sha2("payload", 256))
    first = p.where(F.col("payload_bytes") >= SMALLEST).groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    if twice.isEmpty():
        first, copy = first.withColumn("refers_repeated", F.lit(False)), F.lit(0)
    else:
        ids = twice.select("twice").where("twice is not null").withColumn("refers_repeated", F.lit(True))
        first = first.join(ids, F.col("first.page_id") == F.col("twice"), "left").drop("twice").withColumn("refers_repeated", F.coalesce("refers_repeated", F.lit(False)))
        p = p.join(twice.withColumn("again", F.lit(True)), F.col("page_id").eqNullSafe(F.col("twice")), "left").drop("twice")
        copy = F.when(F.col("again"), F.monotonically_increasing_id() + 1).otherwise(0)
    first = scratch.write(first)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return p.join(first, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first.page_id")).alias("refers_to"),
        F.when(again, F.col("first.url")).alias("refers_url"), "refers_repeated", copy.cast("bigint").alias("copy"),
    )


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """(path, n_records): each partition of classified rows as one archive, a single gzip stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, out, zipped, n = None, None, None, 0
        uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    store, path = _open(uri)
                    store.create_dir(path.rpartition("/")[0])
                    out, zipped = store.open_output_stream(path, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(zipped.compress(record(r)))
                n += 1
        if out is not None:
            out.write(zipped.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": pa.array([uri]), "n_records": pa.array([n], pa.int64())})

    return rows.mapInArrow(run, T.StructType([T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType())]))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(path, index_path, n_records): the archives in ``path``, rewritten with one gzip member per record, and their sidecars.

    A sidecar has a JSON line for each record: offset and length of its member, type, digest and target. Archives that
    already have several members are taken as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b["path"].to_pylist():
                store, path = _open(uri)
                to, into = _open(folder)
                to.create_dir(into)
                name, at, n = uuid.uuid4().hex, 0, 0
                with store.open_input_stream(path, compression=None) as source, to.open_output_stream(f"{into}/{name}.warc.gz", compression=None) as out, to.open_output_stream(f"{into}/{name}.index", compression=None) as index:
                    for head, block in records(inflate(source.read)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(head + _BREAK + block + _BREAK) + z.flush()
                        h = headers(head)
                        entry = {"offset": at, "length": len(member), "type": h.get("warc-type"), "digest": h.get("warc-payload-digest"), "target": h.get("warc-target-uri")}
                        out.write(member)
                        index.write(json.dumps(entry).encode() + b"\n")
                        at += len(member)
                        n += 1
                yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{name}.warc.gz"]), "index_path": pa.array([f"{folder}/{name}.index"]), "n_records": pa.array([n], pa.int64())})

    fields = [T.StructField("path", T.StringType()), T.StructField("index_path", T.StringType()), T.StructField("n_records", T.LongType())]
    return archives.select("path").mapInArrow(run, T.StructType(fields))


READ_SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("page_id", T.StringType()), ("url", T.StringType()), ("record_type", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("refers_to", T.StringType()), ("payload", T.BinaryType()))])


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of normalised archives (path, index_path), each read by its offset; payload is null for revisits.

    The digest and the length of every payload that is there are computed again; a record that does not match its own digest fails
    the job. A revisit's length is the one that its record states.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                (store, path), (side, index) = _open(r["path"]), _open(r["index_path"])
                rows, held = [], 0
                with store.open_input_file(path) as source, side.open_input_stream(index, compression=None) as lines:
                    for line in _lines(lines):
                        e = json.loads(line)
                        raw = zlib.decompress(source.read_at(e["length"], e["offset"]), 31)
                        head, _, block = raw.partition(_BREAK)
                        h, payload = headers(head), block[:-4].partition(_BREAK)[2]
                        digest, revisit = h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"] == "revisit"
                        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{r['path']} at {e['offset']}: the payload is not that of its digest")
                        size = int(h["x-payload-length"]) if revisit else len(payload)
                        rows.append({"page_id": _own(h, "x-page-id"), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "payload_bytes": size, "payload_digest": digest, "refers_to": _own(h, "x-refers-to-page-id"), "payload": None if revisit else payload})
                        held += len(payload)
                        if held > 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return archives.select("path", "index_path").mapInArrow(run, READ_SCHEMA)


_ARROW = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])


def _own(head: dict[str, str], name: str) -> str | None:
    return json.loads(head[name]) if name in head else None


def _lines(source) -> Iterator[bytes]:
    rest = b""
    while data := source.read(CHUNK):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole


def archive(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write, normalise and index the pages; returns (path, index_path, n_records) of the archives.

    A null html is an empty payload. Payloads of SMALLEST bytes or more that are equal are stored once, as the response of
    the smallest page id, and as revisits for the rest; rows of that very id are all responses. A null id or url leaves out
    its header and never is the smallest, unless all are null: then each is a response. Other columns are ignored. An
    empty table gives no archives.
    """
    written = scratch.write(write_archives(classify(pages, scratch, id_col, url_col, html_col), f"{scratch.path}/whole"), with_folder=f"{scratch.path}/whole")
    return scratch.write(normalise(written, f"{scratch.path}/members"), with_folder=f"{scratch.path}/members")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    scratch = Scratch(spark, "warc")
    kind = pages.schema["page_id"].dataType
    back = read_archives(archive(pages, scratch))
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
