"""Legacy ARC archives turned into WARC, and WARC archives read.

An ARC file starts with a ``filedesc:`` record whose body names the header version; a record is one header
line, whose fields depend on that version, and as many bytes as the line declares, then a line feed.
The converter synthesises what WARC has and ARC has not: record identifiers (from the place and
digest of the record, so that a rerun gives the same), ISO timestamps, record types and digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.llm.common import new_path, rows_of, through, utf8

#: Header fields by ARC version, as the version block of a file declares them. Fixed values.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Ends of the identifiers' namespace and of a WARC record.
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
GAP = "\r\n\r\n"
#: Date of the captures and size of the ARC files that pages become.
ARC_DATE, ARC_SIZE = "20040102030405", 1 << 20


@dataclass
class ArcRecord:
    fields: dict[str, str]
    offset: int
    body: bytes


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, the version block first.

    A header line with fewer fields than its version has, or a length that isn't a number or that leads beyond
    the end, is a damaged place: reading goes on at the next line that parses.
    """
    at, names = 0, ARC_FIELDS[1].split()
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            return
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace")
        first = line.startswith("filedesc:")
        now = ARC_FIELDS[1].split() if first else names
        parts = line.rsplit(" ", len(now) - 1)  # a URL may hold spaces
        if len(parts) != len(now) or not re.fullmatch("[0-9]{1,15}", parts[-1]) or end + 1 + int(parts[-1]) > len(data):
            at = end + 1
            continue
        body = data[end + 1 : end + 1 + int(parts[-1])]
        if first:
            declared = body.split(b"\n")
            version = int(m[1]) if (m := re.match(rb"(\d+) ", declared[0])) else 1
            names = declared[1].decode("ascii", "replace").split() if len(declared) > 1 and declared[1].startswith(b"URL ") else ARC_FIELDS.get(version, ARC_FIELDS[1]).split()
        yield ArcRecord(dict(zip(now, parts, strict=True)), at, body)
        at = end + 1 + len(body)
        at += data[at : at + 1] == b"\n"


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n".encode() + body + b"\n"


def arc_line(version: int, url: str, date: str, kind: str, code: int, body: bytes, name: str, offset: int) -> bytes:
    more = f" {code} {hashlib.md5(body).hexdigest()} - {offset} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {kind}{more} {len(body)}\n".encode()


def _to_arc(date: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """id, url, html to arc_name, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part}-{k}.arc"]), pa.array([b"".join(parts)], pa.binary())], names=["arc_name", "content"])

        for batch in rows_of(batches):
            for page, url, html in zip(*batch.columns, strict=True):
                version, name = 1 + k % 2, f"part-{part}-{k}.arc"
                if not parts:
                    parts.append(arc_version_block(name, version, date))
                    size = len(parts[0])
                html, page = html.as_py(), page.as_py()
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + ("" if page is None else f"X-Page-Id: {page}\r\n") + f"Content-Length: {len(html)}\r\n\r\n"
                body = head.encode() + html
                where = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url.as_py() or "") or "urn:page"
                parts += [arc_line(version, where, date, "text/html", 200, body, name, size), body, b"\n"]
                size += len(parts[-3]) + len(body) + 1
                if size >= most:
                    yield done()
                    parts, k = [], k + 1
        if parts:
            yield done()

    return run


def _arc_input(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), utf8(html_col).alias("html"))


def pages_to_arc(pages: DataFrame, date: str = ARC_DATE, most: int = ARC_SIZE, **columns) -> DataFrame:
    """``arc_name, content``: ARC files of about ``most`` bytes, versions 1 and 2 in turn, one HTTP response a page.

    Null html is an empty body, a null url is ``urn:page``, white space in urls is escaped. The page's id stands in
    the HTTP header ``X-Page-Id``, which a null id leaves out.
    """
    return through(_arc_input(pages, **columns), "arc_name string, content binary", _to_arc(date, most))


WARC_ROW = "record_id string, record_type string, target_uri string, date string, content_type string, http_head binary, payload binary, payload_bytes long, payload_sha1 binary, refers_to string"


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """arc_name, content to ``WARC_ROW``, of about 4 MB each."""
    for batch in rows_of(batches, 1):
        name, out = batch.column(0)[0].as_py() or "", []
        for r in read_arc(batch.column(1)[0].as_py()):
            url, day = r.fields["URL"], r.fields["Archive-date"]
            http = r.body.startswith(b"HTTP/")
            cut = r.body.find(b"\r\n\r\n") + 4 if http and b"\r\n\r\n" in r.body else 0
            kind = "warcinfo" if url.startswith("filedesc:") else "response" if http else "resource"
            sha = hashlib.sha1(r.body[cut:]).digest()
            made = uuid.uuid5(SPACE, f"{name}:{r.offset}:{sha.hex()}")
            date = f"{day[:4]}-{day[4:6]}-{day[6:8]}T{day[8:10]}:{day[10:12]}:{day[12:14]}Z" if re.fullmatch("[0-9]{14}", day) else "1970-01-01T00:00:00Z"
            content = "application/warc-fields" if kind == "warcinfo" else "application/http; msgtype=response" if http else r.fields["Content-type"]
            out.append((f"urn:uuid:{made}", kind, url, date, content, r.body[:cut], r.body[cut:], len(r.body) - cut, sha, None))
        kinds = [pa.string()] * 5 + [pa.binary()] * 2 + [pa.int64(), pa.binary(), pa.string()]
        cols = list(zip(*out, strict=True)) or [[]] * 10
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in WARC_ROW.split(", ")])


def arc_to_warc(arcs: DataFrame) -> DataFrame:
    """WARC records of ARC files (``arc_name, content``): see ``WARC_ROW``; `write_warc` writes them.

    The version block becomes ``warcinfo``, an HTTP answer ``response``, anything else ``resource``. A 14-digit date
    becomes ISO 8601; a date that isn't one, 1970. Null or empty contents give no record.
    """
    d = arcs.select(F.col("arc_name").cast("string").alias("arc_name"), F.coalesce(F.col("content"), F.lit(b"")).alias("content"))

    return through(d, WARC_ROW, _to_warc)


def page_of(http_head: str) -> Column:
    """The id in a stored HTTP header, null without one."""
    return F.nullif(F.regexp_extract(F.col(http_head).cast("string"), r"(?m)^X-Page-Id: (-?\d+)\r?$", 1), F.lit("")).cast("long")


def revisits(records: DataFrame, least: int = 1000) -> DataFrame:
    """Of responses with equal payloads of ``least`` bytes or more, only that with the largest page id keeps its payload.

    The others become ``revisit`` and name its record; all rows that share the largest id (repeated rows) stay
    responses, and so do all if no record of the group has an id. Digests are summed by group before
    they move, and the join is one that Spark can split where a payload is very frequent; records that can't be revisits are dealt
    by their own ids there, so that they don't meet under a null key. Null and empty payloads are short ones; no records give none.
    """
    r = records.withColumn("page_id", page_of("http_head"))
    big = (F.col("record_type") == "response") & (F.col("payload_bytes") >= least)
    kept = r.filter(big).groupBy(F.col("payload_sha1").alias("k_sha1"), F.col("payload_bytes").alias("k_bytes")).agg(F.max(F.struct("page_id", "record_id")).alias("kept"), F.count("*").alias("n"))
    kept = kept.filter((F.col("n") > 1) & F.col("kept.page_id").isNotNull()).drop("n")
    # No digest has an id's length.
    digest = F.when(F.coalesce(big, F.lit(False)), F.col("payload_sha1")).otherwise(F.col("record_id").cast("binary"))
    out = r.join(kept, (digest == F.col("k_sha1")) & (F.col("payload_bytes") == F.col("k_bytes")), "left")
    again = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept.page_id"))
    return out.select(
        "record_id",
        F.when(again, "revisit").otherwise(F.col("record_type")).alias("record_type"),
        "target_uri",
        "date",
        "content_type",
        "http_head",
        F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_sha1",
        F.when(again, F.col("kept.record_id")).alias("refers_to"),
    )


def write_warc(records: DataFrame, path: str, most_records: int = 2000, most_bytes: int = 32 << 20) -> None:
    """Gzipped WARC 1.1 files of ``most_records`` records and about ``most_bytes`` at most, through Spark's own writer and committer.

    The writer puts the two line ends that close a record between rows. Payloads must be UTF-8; a null one is empty.
    A record larger than ``most_bytes`` ends its file. Equal records are written as often as they come, in no order
    that is promised; no records give an empty folder.
    """
    d = records.select(F.struct("*").alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, size = 0, 0
        for batch in rows_of(batches):
            out, files = [], []
            for x in batch.column(0):
                r = x.as_py()
                block = (r["http_head"] or b"") + (r["payload"] or b"")
                head = [
                    "WARC/1.1",
                    f"WARC-Type: {r['record_type']}",
                    f"WARC-Record-ID: <{r['record_id']}>",
                    f"WARC-Date: {r['date']}",
                    f"WARC-Target-URI: {r['target_uri']}",
                    f"WARC-Payload-Digest: sha1:{base64.b32encode(r['payload_sha1']).decode()}",
                    f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
                    *([f"WARC-Refers-To: <{r['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if r["refers_to"] else []),
                    f"Content-Type: {r['content_type']}",
                    f"Content-Length: {len(block)}",
                ]
                out.append("\r\n".join(head).encode() + b"\r\n\r\n" + block)
                files.append(file)
                size += len(out[-1])
                if size >= most_bytes:
                    file, size = file + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(files, pa.int32())], names=["value", "file"])

    text = through(d, "value binary, file int", run).select(F.col("value").cast("string").alias("value"), "file")
    text.write.partitionBy("file").option("lineSep", GAP).option("compression", "gzip").option("maxRecordsPerFile", most_records).text(path)


class _Buffer:
    """Bytes that arrive in chunks, read from the front."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.data, self.at = iter(chunks), b"", 0

    def more(self) -> bool:
        got = next(self.chunks, None)
        if got is None:
            return False
        self.data, self.at = self.data[self.at :] + got, 0
        return True

    def has(self, n: int) -> bool:
        while len(self.data) - self.at < n:
            if not self.more():
                return False
        return True

    def upto(self, mark: bytes) -> bytes | None:
        """What stands before the next ``mark``, which is skipped; None, and all is skipped, if there is none."""
        while (end := self.data.find(mark, self.at)) < 0:
            if not self.more():
                self.at = len(self.data)
                return None
        out, self.at = self.data[self.at : end], end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]


def warc_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower case) and block of each record in a stream of bytes; what can't be a record is skipped."""
    b = _Buffer(chunks)
    while (top := b.upto(b"\r\n\r\n")) is not None:
        lines = top.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = head.get("content-length", "")
        if not lines[0].startswith("WARC/") or not size.isdigit():
            continue
        if not b.has(int(size)):
            return
        yield head, b.take(int(size))
        if b.has(4) and b.data[b.at : b.at + 4] == b"\r\n\r\n":
            b.take(4)


def unzipped(data: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The bytes in pieces; gzip members one after another are told by their signature, other data is as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        got, rest = zlib.decompressobj(31), data
        while not got.eof:
            out = got.decompress(rest, piece)
            rest = got.unconsumed_tail
            if out:
                yield out
            elif not rest and not got.eof:
                return
        data = got.unused_data


def read_warc(spark, path: str) -> DataFrame:
    """``record_id, record_type, target_uri, page_id, payload, payload_bytes, payload_digest, refers_to`` of WARC files.

    Payload size and digest are counted on the payload where the record holds it; of a ``revisit`` they are what the
    record's headers say. An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in rows_of(batches, 1):
            out = []
            size = 0
            for head, block in warc_records(unzipped(file.column(0)[0].as_py())):
                cut = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
                http = block[:cut].decode("utf-8", "replace")
                page = m[1] if (m := re.search(r"(?m)^X-Page-Id: (-?\d+)\r?$", http)) else None
                kind, payload = head.get("warc-type"), block[cut:]
                if kind == "revisit":
                    n = int(m[1]) if (m := re.search(r"(?mi)^Content-Length: (\d+)\r?$", http)) else None
                    said = head.get("warc-payload-digest", "").rpartition(":")[2]
                    digest = base64.b32decode(said).hex() if said else None
                else:
                    n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                refers = head.get("warc-refers-to", "").strip("<>") or None
                out.append((head.get("warc-record-id", "").strip("<>"), kind, head.get("warc-target-uri"), None if page is None else int(page), payload, n, digest, refers))
                size += len(payload)
                if size > 1 << 23:
                    yield batch_of(out)
                    out, size = [], 0
            yield batch_of(out)

    names = ["record_id", "record_type", "target_uri", "page_id", "payload", "payload_bytes", "payload_digest", "refers_to"]
    kinds = [pa.string()] * 3 + [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return through(files, "record_id string, record_type string, target_uri string, page_id long, payload binary, payload_bytes long, payload_digest string, refers_to string", run)


def archive_pages(pages: DataFrame, least: int = 1000, **columns) -> DataFrame:
    """Pages through ARC, the converter and WARC files, and back: what `read_warc` gives of their records.

    One record for each row of ``pages``, with ``refers_page``, the page id of the record that a revisit names. Null html is
    an empty payload, null ids stay null, and repeated rows are records of their own: those that share the largest id of equal
    payloads are all responses. Other columns of ``pages`` are left out. No pages give none.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    converted = through(_arc_input(pages, **columns), WARC_ROW, _to_arc(ARC_DATE, ARC_SIZE), _to_warc)
    write_warc(revisits(converted, least), path)
    records = read_warc(spark, path).filter(F.col("record_type").isin("response", "revisit"))
    named = records.filter(F.col("record_type") == "response").select(F.col("record_id").alias("n_id"), F.col("page_id").alias("refers_page"))
    # Responses name nothing; dealt by their own ids they don't meet under a null key.
    names = F.coalesce("refers_to", F.concat(F.lit("-"), F.col("record_id")))
    return records.join(named, names == F.col("n_id"), "left").drop("n_id")
