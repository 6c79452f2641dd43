"""WARC archives (operator 2): a writer of one gzip member per record and a splittable reader.

Writing: payload digests are computed in the JVM; the smallest page_id of each digest (of at least
`MIN_REVISIT` bytes) is found by a combined aggregate over narrow rows, and only pages that revisit
another are joined back, by page_id, which has no hot keys. Each task writes its own files under fresh
names and returns a manifest; only files of the manifest are read, so a lost or repeated task leaves at
most files that nobody reads.

Reading: a split is a byte range. A task looks for the gzip magic in its range, inflates the beginning of
each candidate and accepts it only if that decodes to a whole WARC header: version, well-formed fields, and a
type, record id and content length among them. It owns the records that start in its range and reads past
the end to finish the last; the next search begins where the accepted member ended. Bytes that don't
inflate, or to something else, are passed over; an accepted member that breaks, ends early or is longer or
shorter than its header says raises. The records read of each file are held against the manifest.

Defined cases: a null html is an empty payload; equal payloads under the bound are all responses; rows
with one page_id are written each; CR and LF in a url are percent-encoded; an empty table gives no files and no rows;
only page_id, url and html are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_REVISIT = 100
FILE_BYTES, SPLIT_BYTES, MAX_TASKS = 1 << 30, 16 << 20, 50_000
MAGIC, PIECE, HEADER, STEP = b"\x1f\x8b\x08", 1 << 16, 1 << 20, 128
READ_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string"


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        uri = path if "://" in path else "file://" + path[5:]
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), path


def with_roles(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    narrow = pages.select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("x")).select("page_id", F.octet_length("x").alias("n"), F.sha2("x", 256).alias("digest")).where(f"n >= {MIN_REVISIT} and page_id is not null")
    narrow = common.persist(narrow.select("page_id", "digest"), "warc-digests")
    firsts = common.persist(narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("_max")).where("refers_to < _max").select("digest", "refers_to"), "warc-firsts")
    # a written table, so that the planner knows its size: few revisits are broadcast and the pages stay where they are
    revisits = common.persist(narrow.join(firsts, "digest").where("page_id <> refers_to").select("page_id", F.col("digest").alias("_d"), "refers_to").distinct(), "warc-revisits")
    common.drop(narrow, firsts)
    p = p.withColumn("digest", F.sha2("payload", 256))
    return p.join(revisits, (p.page_id == revisits.page_id) & (p.digest == revisits._d), "left").select(p.page_id, "url", "payload", "digest", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response or revisit record as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes rows of with_roles(); returns the manifest (path, bytes, records)."""

    def run(batches):
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        out, path, size, n = None, "", 0, 0
        done = []
        for b in batches:
            ids, urls, digests, refs = (b.column(k).to_pylist() for k in (0, 1, 3, 4))
            for i in range(b.num_rows):
                if out is None:
                    path, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(root + path[len(folder) :], compression=None)
                data = record(ids[i], urls[i], b.column(2)[i].as_buffer().to_pybytes(), digests[i], refs[i])
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    out.close()
                    done.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "bytes", "records"])

    return common.persist(rows.mapInArrow(run, "path string, bytes bigint, records bigint"), "warc-manifest")


def _header(raw: bytes) -> tuple[dict[str, str], int] | None:
    """(fields in lower case, length of the header) where raw begins with a whole and well-formed WARC header."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not re.match(rb"WARC/1\.[01]\r\n", raw):
        return None
    head = {}
    for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        k, colon, v = line.partition(":")
        if not colon or not k.strip():
            return None
        head[k.strip().lower()] = v.strip()
    if not head.keys() >= {"warc-type", "warc-record-id", "content-length"} or not head["content-length"].isdigit():
        return None
    return head, end + 4


def members(f, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position, header fields, block) of the WARC members of an open file that start in [start, stop)."""
    size = f.size()
    stop = min(stop, size)
    buf = f.read_at(max(0, min(stop + len(MAGIC) - 1, size) - start), start)
    pos = 0
    while (pos := buf.find(MAGIC, pos)) >= 0 and start + pos < stop:
        z, out, at, head, piece = zlib.decompressobj(31), [b""], start + pos, None, b""
        try:
            while not z.eof:
                if not piece:  # of the split from memory, past its end piece by piece
                    piece = buf[at - start : at - start + PIECE] if at < start + len(buf) else f.read_at(min(PIECE, size - at), at) if at < size else b""
                    at += len(piece)
                    if not piece:
                        break
                if head is None:  # in small steps, so that damage behind the header is known for what it is
                    out[0] += z.decompress(piece, STEP)
                    head = _header(out[0])
                    if head is None and (len(out[0]) > HEADER or not b"WARC/1.".startswith(out[0][:7])):
                        break
                    piece = z.unconsumed_tail
                else:
                    out.append(z.decompress(piece))
                    piece = b""
        except zlib.error as e:
            if head is not None:
                raise ValueError(f"broken WARC member at {start + pos}: {head[0]['warc-record-id']}") from e
        if head is None:
            pos += 1
            continue
        raw = b"".join(out)
        n = int(head[0]["content-length"])
        if not z.eof or len(raw) != head[1] + n + 4 or raw[-4:] != b"\r\n\r\n":
            raise ValueError(f"broken WARC member at {start + pos}: {head[0]['warc-record-id']}")
        yield start + pos, head[0], raw[head[1] : head[1] + n]
        pos = at - len(z.unused_data) - start
        if pos >= len(buf):
            return


def read(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the manifest's files; split into byte ranges whatever the files' sizes. The result is a written table, complete by the manifest."""
    splits = manifest.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint"))).alias("start"))
    # a task per split (at most MAX_TASKS): the rows are too narrow for adaptive execution to see what they cost
    total = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    splits = splits.repartition(min(int(total), MAX_TASKS), "path", "start")

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, at = _open(path)
                rows = []
                with fs.open_input_file(at) as f:
                    for _, head, block in members(f, start, start + split_bytes):
                        if head["warc-type"] in ("response", "revisit"):
                            rows.append((*_row(head, block), path))
                        if len(rows) >= 2000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    out = common.persist(splits.mapInArrow(run, f"{READ_SCHEMA}, path string"), "warc-read")
    lost = manifest.select("path", "records").join(out.groupBy("path").agg(F.count("*").alias("n")), "path", "left").where("records <> coalesce(n, 0)")
    if bad := lost.limit(3).collect():
        raise ValueError(f"records read differ from the manifest: {bad}")
    return out.drop("path")


def _page(uri: str | None) -> int | None:
    x = (uri or "").strip("<>").rpartition(":")[2]
    return int(x) if x.lstrip("-").isdigit() else None


def _row(head: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = head["warc-payload-digest"].partition(":")[2]
    if head["warc-type"] == "response":
        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if digest != stated:
            raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
    else:  # a revisit keeps the HTTP head of the full payload
        n, digest = next(int(x[15:]) for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:")), stated
    return _page(head["warc-record-id"]), n, digest, head["warc-type"], _page(head.get("warc-refers-to")), head.get("warc-target-uri")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "path"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_roles(common.table(spark, sf_dir, "pages"))
    manifest = write(rows, common.shared_dir(spark, "warc"))
    return read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {MIN_REVISIT} GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first IS NULL OR f.first = p.page_id THEN NULL ELSE f.first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= {MIN_REVISIT}
"""
