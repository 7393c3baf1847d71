"""WARC archives: written with one gzip member per record, read back sequentially.

Which record is the response is decided on digests and row numbers alone; html meets the decision
by row number, a key that no two rows share. Each task then appends its records to an archive of its own in the shared folder. File
names carry the task attempt, and only the archives of attempts that Spark commits appear in the
manifest, so a lost executor leaves at most an orphan file. The reader inflates one member at a
time in fixed chunks, takes the block by Content-Length, and verifies both digests; memory is one
record.

Defined results
---------------
* Null html is the empty payload. Payloads of equal bytes, the empty one included, share a response:
  the row with the largest page_id (null is smallest; full ties: the row that comes first).
* A floor ``min_bytes`` can exempt small payloads: those are all responses.
* A null page_id is written as ``null`` and read back as null. A null url becomes ``about:blank``;
  control characters in a url are percent-encoded. Extra columns are ignored.
* An empty table gives no records. A digest, length or framing fault raises ``WarcError``.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolk.llm.storage import fresh_path, stored

CHUNK = 1 << 16
#: Compressed bytes after which a task begins another archive.
ROLL_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record that breaks the format or fails its digest."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- records -----------------------------------------------------------------------------------

def record_bytes(kind: str, record_id: str, block: bytes, fields: dict[str, str], date: str) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date, **fields, "WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def read_records(stream, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], bytes]]:
    """Yield (header fields, block) of each record of an open binary stream."""
    rest = b""
    while True:
        if not rest and not (rest := stream.read(chunk)):
            return
        member, buffer = zlib.decompressobj(31), bytearray()
        fields, start, length = None, 0, 0
        while not member.eof:
            if not rest and not (rest := stream.read(chunk)):
                raise WarcError("the archive ends inside a gzip member")
            try:
                buffer += member.decompress(rest, chunk)
            except zlib.error as e:
                raise WarcError(f"damaged gzip member: {e}") from e
            rest = member.unconsumed_tail if not member.eof else member.unused_data
            if fields is None and (end := buffer.find(b"\r\n\r\n")) >= 0:
                first, *lines = bytes(buffer[:end]).decode().split("\r\n")
                if not first.startswith("WARC/1."):
                    raise WarcError(f"not a WARC record: {first[:40]!r}")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                start = end + 4
                try:
                    length = int(fields["content-length"])
                except (KeyError, ValueError) as e:
                    raise WarcError("no usable Content-Length") from e
            if not rest and not member.eof:
                rest = stream.read(chunk)
                if not rest:
                    rest = b""
                    buffer += member.flush()
                    if not member.eof:
                        raise WarcError("the archive ends inside a gzip member")
        if fields is None or bytes(buffer[start + length :]) != b"\r\n\r\n":
            raise WarcError("the block's length differs from Content-Length")
        block = bytes(buffer[start : start + length])
        if (said := fields.get("warc-block-digest")) and said != f"sha1:{sha1_base32(block)}":
            raise WarcError("block digest mismatch")
        if fields["warc-type"] == "response" and (said := fields.get("warc-payload-digest")):
            if said != f"sha1:{sha1_base32(block.partition(b'\r\n\r\n')[2])}":
                raise WarcError("payload digest mismatch")
        yield fields, block


# --- writing -----------------------------------------------------------------------------------

def _page_urn(page_id, row) -> str:
    return f"<urn:page:{'null' if page_id is None else int(page_id)}:{int(row)}>"


def _plain_url(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "about:blank"


def page_records(page_id, row, url, html, response, response_row, date: str) -> bytes:
    payload = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"WARC-Target-URI": _plain_url(url), "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}"}
    if response_row == row:
        return record_bytes("response", _page_urn(page_id, row), http + payload, fields, date)
    fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _page_urn(response, response_row)}
    return record_bytes("revisit", _page_urn(page_id, row), http, fields, date)


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Each page with the row of its response: page_id, url, html, row, response_id, response_row."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.monotonically_increasing_id().alias("row"))
    digests = stored(rows.select("page_id", "row", F.sha1(html).alias("sha1"), (F.octet_length(html) < min_bytes).alias("own")), "warc-digests")
    top = F.max(F.struct("page_id", (-F.col("row")).alias("r"))).alias("top")
    tops = digests.groupBy("sha1").agg(top).select("sha1", F.col("top.page_id").alias("response_id"), (-F.col("top.r")).alias("response_row"))
    decided = digests.join(tops.hint("merge"), "sha1").select(
        "row",
        F.when(F.col("own"), F.col("page_id")).otherwise(F.col("response_id")).alias("response_id"),
        F.when(F.col("own"), F.col("row")).otherwise(F.col("response_row")).alias("response_row"),
    )
    return rows.join(decided.hint("merge"), "row").select("page_id", "url", "html", "row", "response_id", "response_row")


def write_archives(planned: DataFrame, folder: str, level: int = 4, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write one archive or more per task; return the stored manifest (path, n_records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        task, out, path, count, size, done = TaskContext.get(), None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html, row, response, response_row in zip(*((x.as_py() for x in column) for column in batch.columns)):
                if out is None:
                    path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                    out = files.open_output_stream(path, compression=None)
                    out.write(first := gzip_member(record_bytes("warcinfo", f"<urn:archive:{task.partitionId()}:{len(done)}>", b"format: WARC File Format 1.1\r\n", {"Content-Type": "application/warc-fields"}, date), level))
                    count, size = 0, len(first)
                out.write(data := gzip_member(page_records(page_id, row, url, html, response, response_row, date), level))
                count, size = count + 1, size + len(data)
                if size >= ROLL_BYTES:
                    out.close()
                    done.append((path, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "n_records"])

    return stored(planned.select("page_id", "url", "html", "row", "response_id", "response_row").mapInArrow(write, "path string, n_records long"), "warc-manifest")


# --- reading -----------------------------------------------------------------------------------

RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def _urn_page(urn: str | None):
    part = (urn or "<urn:page:null:0>").split(":")[2]
    return None if part == "null" else int(part)


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The page records of all archives in the manifest, digests verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for fields, block in read_records(stream):
                        if fields["warc-type"] not in ("response", "revisit"):
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        rows.append((_urn_page(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], payload if with_payload else None, size, fields["warc-payload-digest"].removeprefix("sha1:"), _urn_page(fields.get("warc-refers-to"))))
                        held += (len(payload) if with_payload else 0) + 300
                        if held > 16 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    parts = max(2, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(parts, "path").mapInArrow(read, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD)


def archive_round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Write every page to archives in ``folder``, then read the archives back."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(plan_records(pages, min_bytes), folder), folder, with_payload)
