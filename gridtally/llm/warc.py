"""WARC archives: written with an index, read back by sorted byte ranges.

Each task writes one archive of gzip members and returns an index row per record:
file, offset, length, URL and digest. Readers sort the index rows of the selected
records, merge neighbours into one range and read each range once. Files have a name
of their own per attempt and only those of finished tasks are in the index, so a lost
executor costs nothing but a file that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridtally.session import materialize, new_folder

MIN_REVISIT_BYTES = 0
RANGE_GAP = 64 * 1024
RANGE_BYTES = 4 * 1024 * 1024
# Archive bytes that one task reads.
TASK_BYTES = 16 * 1024 * 1024
DATE = "1970-01-01T00:00:00Z"
NO_PAYLOAD = base64.b32encode(hashlib.sha1(b"").digest()).decode()

INDEX = (
    "page_id long, url string, file string, offset long, length long, "
    "record_type string, digest string, payload_bytes long"
)
RECORD = (
    "page_id long, url string, record_type string, refers_to long, digest string, "
    "payload_bytes long, payload binary"
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _unurn(text: str) -> int | None:
    number = text[len("<urn:page:") : -1]
    return int(number) if number else None


def _header(text: str | None) -> str:
    """A header value on one line; control characters are percent-encoded."""
    return "".join(c if c.isprintable() and c != "%" else f"%{ord(c):X};" for c in text or "")


def _unheader(text: str) -> str:
    parts = text.split("%")
    out = [parts[0]]
    for part in parts[1:]:
        code, _, rest = part.partition(";")
        out.append(chr(int(code, 16)) + rest)
    return "".join(out)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record; ``first`` is the page that a revisit refers to."""
    body = payload if first is None else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if first is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {_urn(first)}")
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """The fields of RECORD from one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = dict(line.split(": ", 1) for line in lines)
    payload = rest[: int(fields["Content-Length"])]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and digest_of(payload) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    refers = _unurn(fields["WARC-Refers-To"]) if kind == "revisit" else None
    url = _unheader(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None
    return (
        _unurn(fields["WARC-Record-ID"]), url, kind, refers, digest,
        int(fields["X-Payload-Length"]), payload if kind == "response" else None,
    )


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of ``folder``, by pyarrow: a path, or a URI of file, s3, gs, abfs or hdfs.

    ``s3a`` and ``s3n``, as Hadoop calls it, are the same store as ``s3``. ``hdfs`` needs
    the native library of Hadoop on all executors.
    """
    scheme, _, rest = folder.partition("://")
    if scheme in ("s3a", "s3n"):
        folder = f"s3://{rest}"
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), folder


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``page_id, url, html`` as archives in ``folder``; the stored index (INDEX).

    The payload is the html in UTF-8, null as empty. Of equal payloads of at least
    ``min_revisit_bytes`` bytes the one with the smallest page_id is a response and the
    others are revisits of it. Rows that share that page_id, and rows without an id
    where no row has one, are all responses. Payloads are equal if length and SHA-256 are:
    the digest in the records, SHA-1, has known collisions. Extra columns are ignored; no rows give an
    empty index.
    """
    html = F.coalesce("html", F.lit(""))
    size, sha = F.octet_length(html), F.sha2(html.cast("binary"), 256)
    keyed = pages.select("page_id", "url", html.alias("html"), sha.alias("sha"), size.alias("size"))
    plain = pages.select("page_id", sha.alias("sha"), size.alias("size"))
    repeated = (
        plain.where(F.col("size") >= min_revisit_bytes)
        .groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL").drop("n")
    )
    firsts = materialize(repeated, "repeated_payloads")
    joined = keyed.join(firsts, ["sha", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = joined.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _file_system(folder)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, offset = None, 0
        for batch in batches:
            index: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for page_id, url, text, first in zip(*columns):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                payload = text.encode()
                digest = digest_of(payload)
                member = gzip_member(record_bytes(page_id, url, payload, digest, first))
                out.write(member)
                kind = "response" if first is None else "revisit"
                index.append((page_id, url, name, offset, len(member), kind, digest, len(payload)))
                offset += len(member)
            if index:
                yield _batch(index, INDEX)
        if out is not None:
            out.close()

    # The index is stored by the same job that writes the archives.
    return materialize(rows.mapInArrow(write, INDEX), "warc_index")


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [field.split() for field in schema.split(", ")]
    arrays = [pa.array(values, _TYPES[kind]) for values, (_, kind) in zip(zip(*rows), fields)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def read_warc(
    index: DataFrame,
    folder: str,
    gap: int = RANGE_GAP,
    range_bytes: int = RANGE_BYTES,
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """The records of the selected ``index`` rows (RECORD), payloads verified.

    Rows are dealt by file and stretch of file and sorted by offset; records closer than
    ``gap`` are read in one range of about ``range_bytes`` at most. There is a task for
    every ``task_bytes`` of the selected records: the index itself is small, and by its
    size alone adaptive execution would deal all archives to one task.
    """
    selected_bytes = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(math.ceil(selected_bytes / task_bytes), 1)
    stretch = F.floor(F.col("offset") / min(2 * range_bytes, task_bytes))
    selected = index.select("file", "offset", "length", stretch.alias("stretch"))
    dealt = selected.repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset").drop("stretch")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _file_system(folder)
        for batch in batches:
            wanted = list(zip(*[batch.column(i).to_pylist() for i in range(3)]))
            at = 0
            while at < len(wanted):
                name, start, length = wanted[at]
                upto, end = at + 1, start + length
                while (
                    upto < len(wanted) and wanted[upto][0] == name
                    and wanted[upto][1] - end <= gap
                    and wanted[upto][1] + wanted[upto][2] - start <= range_bytes
                ):
                    end = max(end, wanted[upto][1] + wanted[upto][2])
                    upto += 1
                with store.open_input_file(f"{path}/{name}") as source:
                    data = source.read_at(end - start, start)
                rows = []
                for _, offset, size in wanted[at:upto]:
                    member = data[offset - start : offset - start + size]
                    rows.append(parse_record(zlib.decompress(member, 31)))
                yield _batch(rows, RECORD)
                at = upto

    return dealt.mapInArrow(read, RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = new_folder(spark, "warc")
    records = read_warc(write_warc(pages, folder), folder)
    return records.select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP2_SQL = f"""
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages
), digests AS (
    SELECT page_id, octet_length(encode(html)) AS payload_bytes, html,
           array_to_string(list_transform(range(0, 32), lambda k:
             '{_BASE32}'[((CAST('0x' || sha[((k // 4) * 5 + 1):((k // 4) * 5 + 5)] AS BIGINT)
                         >> (15 - 5 * (k % 4))) & 31) + 1]), '') AS payload_digest
    FROM payloads
), firsts AS (
    SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM digests
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts
"""
