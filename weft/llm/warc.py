"""WARC archives: a writer that stores equal payloads once, and a reader that salvages what damage has left.

A record is a gzip member of its own, or stands plainly in the file. The reader goes from record to record; each is
checked (gzip's checksum, version line, header, length, end mark, digests). After a failed check it searches for the
next gzip magic or version line at which a record passes all checks, goes on there, and logs the bytes between as a
quarantined gap. A file is read by pieces: a task holds one record (or one member) at a time.

Equal payloads are found by their digest; only (digest, size, id) rows are exchanged for that. The first of them is
written as ``response``, the others as ``revisit`` records, which hold the HTTP header without the payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import dealt, shared_dir, stash, store_of, table, task_of, text_slices

MANIFEST = pa.schema([("archive", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
#: What the reader gives for a record or, with ``fault``, for a gap.
READ = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("fault", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
READ_DDL = "archive string, start long, stop long, fault string, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"

GZIP, VERSION, END = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[0-9]\r\n"), b"\r\n\r\n"
#: Bytes read at a time; bytes handed to gzip at a time; the longest header; bytes of payloads in a batch of rows.
PIECE, FED, HEAD, BATCH = 4 << 20, 32 << 10, 16 << 20, 8 << 20


class Damaged(Exception):
    """A check failed."""


class Window:
    """Bytes of a file by place; the piece read last is held."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if at < self.start or at + n > self.start + len(self.data):
            self.file.seek(at)
            self.start, self.data = at, self.file.read(min(max(n, PIECE), self.size - at))
        return self.data[at - self.start : at - self.start + n]

    def find(self, what: bytes, at: int, most: int | None = None) -> int:
        """The next place of ``what`` from ``at`` on, -1 if there is none (among ``most`` bytes)."""
        stop = self.size if most is None else min(self.size, at + most)
        step = 4096 if most else PIECE
        while at < stop:
            n = min(step, stop - at)
            found = self.get(at, n).find(what)
            if found >= 0:
                return at + found
            if n < step or at + n >= stop:
                return -1
            at += n - len(what) + 1
            step = PIECE
        return -1


class Bytes(Window):
    """The same over what a gzip member held."""

    def __init__(self, data: bytes):
        super().__init__(None, len(data))
        self.data = data


def member(file: Window, at: int) -> tuple[bytes, int]:
    """What the gzip member at ``at`` holds, and where it stops."""
    gzip, out, place, begun = zlib.decompressobj(31), [], at, False
    while not gzip.eof:
        fed = file.get(place, FED)
        if not fed:
            raise Damaged("gzip member cut short")
        try:
            got = gzip.decompress(fed)
        except zlib.error as error:
            raise Damaged(f"gzip: {error}") from error
        place += len(fed)
        if got and not begun:  # garbage that inflates is found out at once
            if not b"WARC/".startswith(got[:5]) and not got.startswith(b"WARC/"):
                raise Damaged("gzip member without a WARC record")
            begun = True
        out.append(got)
    return b"".join(out), place - len(gzip.unused_data)


def header_fields(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    name = ""
    for line in text.split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif line:
            name, colon, value = line.partition(":")
            if not colon:
                raise Damaged("header line without a colon")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def hex_digest(labelled: str | None) -> tuple[str, str] | None:
    """(algorithm, lower-case hex) of a labelled digest, whether it is written in hex or base 32."""
    name, _, value = (labelled or "").partition(":")
    name = name.lower().replace("-", "")
    size = {"md5": 32, "sha1": 40, "sha256": 64}.get(name)
    if not size:
        return None
    try:
        text = value.lower() if len(value) == size else base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
    except ValueError:
        raise Damaged("digest that can't be read") from None
    if len(text) != size:
        raise Damaged("digest that can't be read")
    return name, text


def checked(labelled: str | None, data: bytes, what: str) -> str | None:
    known = hex_digest(labelled)
    if known and hashlib.new(known[0], data, usedforsecurity=False).hexdigest() != known[1]:
        raise Damaged(f"{what} digest differs")
    return known[1] if known and known[0] == "sha1" else None


def record_at(file: Window, at: int) -> tuple[dict, int]:
    """The plain record at ``at`` and where it stops."""
    if not VERSION.match(file.get(at, 10)):
        raise Damaged("no member or version line")
    stop = file.find(END, at, HEAD)
    if stop < 0:
        raise Damaged("header without an end")
    try:
        head = header_fields(file.get(at + 10, stop - at - 10).decode())
    except UnicodeDecodeError:
        raise Damaged("header isn't UTF-8") from None
    length = head.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no length")
    begin, n = stop + 4, int(length)
    if begin + n + 4 > file.size:
        raise Damaged("record cut short")
    if file.get(begin + n, 4) != END:
        raise Damaged("no end mark")
    block = file.get(begin, n)
    checked(head.get("warc-block-digest"), block, "block")
    kind, payload, stated = head.get("warc-type", ""), block, None
    if head.get("content-type", "").replace(" ", "").startswith("application/http"):
        top, _, payload = block.partition(END)
        found = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", top)
        stated = int(found[1]) if found else None
    if kind == "revisit":
        known = hex_digest(head.get("warc-payload-digest"))
        digest, size = known[1] if known and known[0] == "sha1" else None, stated
    else:
        digest = checked(head.get("warc-payload-digest"), payload, "payload") or hashlib.sha1(payload, usedforsecurity=False).hexdigest()
        size = len(payload)
    row = {"record_type": kind, "record_id": head.get("warc-record-id"), "target_uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to"), "payload_bytes": size, "payload_digest": digest, "payload": None if kind == "revisit" else payload}
    return row, begin + n + 4


def salvage(file: Window) -> Iterator[dict]:
    """Every record of a file in order, and a row with ``fault`` for each run of bytes without a valid one."""
    at, bad, ahead = 0, None, {GZIP: -1, b"WARC/1.": -1}

    def next_start(place: int) -> int:
        for what, found in ahead.items():
            if found < place:
                found = file.find(what, place)
                ahead[what] = file.size if found < 0 else found
        return min(ahead.values())

    while at < file.size:
        try:
            if file.get(at, 3) == GZIP:
                content, stop = member(file, at)
                rows = list(salvage(Bytes(content)))
                if rows and all(r["fault"] for r in rows):
                    raise Damaged(rows[0]["fault"])
                rows = [r | {"start": at, "stop": stop} for r in rows]
            else:
                row, stop = record_at(file, at)
                rows = [row | {"start": at, "stop": stop, "fault": None}]
        except Damaged as damage:
            bad = bad or (at, str(damage))
            at = next_start(at + 1)
            continue
        if bad:
            yield {"start": bad[0], "stop": at, "fault": bad[1]}
            bad = None
        yield from rows
        at = stop
    if bad:
        yield {"start": bad[0], "stop": file.size, "fault": bad[1]}


def record_bytes(kind: str, record_id: str, uri: str | None, payload: bytes, refers_to: str | None, date: str, compress: bool, level: int = 6) -> bytes:
    """A record of an HTTP answer; a ``revisit`` has its header alone, with the payload's length."""
    digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind != "revisit":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:  # control characters and spaces would end a header line or a field
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    if not compress:
        head.append("WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block, usedforsecurity=False).digest()).decode())
    whole = "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + END + block + END
    if not compress:
        return whole
    gzip = zlib.compressobj(level, zlib.DEFLATED, 31)
    return gzip.compress(whole) + gzip.flush()


def with_types(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, record_type and refers_page (a revisit's response) of every row of ``pages``.

    Of rows with equal payloads of at least ``least`` bytes, that with the largest id (then url) is the response. The
    rows of many copies aren't gathered: their ids are counted before they are exchanged, and the join's skewed keys
    are split at run time. Rows that agree in id, url and payload are merged with a count and dealt out again, so just
    one of them is the response.
    """
    own = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    own = own.withColumns({"bytes": F.octet_length("payload"), "digest": F.sha1(F.col("payload").cast("binary"))})
    counted = own.filter(F.col("bytes") >= least).groupBy("digest", "bytes", "page_id", "url").agg(F.count("*").alias("n"))
    tops = counted.groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "url", "n")).alias("top"), F.sum("n").alias("copies"))
    tops = stash(tops.filter("copies > 1").select("digest", "bytes", "top"))  # payloads that are there more than once
    joined = own.join(tops, ["digest", "bytes"], "left")
    is_top = F.col("top").isNotNull() & F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url"))
    typed = F.when(F.col("top").isNull() | is_top, "response").otherwise("revisit")
    refers = F.when(typed == "revisit", F.col("top.page_id"))
    columns = ["page_id", "url", "payload", "digest", "record_type", "refers_page"]
    if tops.filter("top.n > 1").isEmpty():
        return joined.select("page_id", "url", "payload", "digest", typed.alias("record_type"), refers.alias("refers_page"))
    repeated = is_top & (F.col("top.n") > 1)
    single = joined.filter(~repeated).select("page_id", "url", "payload", "digest", typed.alias("record_type"), refers.alias("refers_page"))
    merged = joined.filter(repeated).groupBy("digest", "bytes", "page_id", "url").agg(F.count("*").alias("n"), F.any_value("payload").alias("payload"))
    again = merged.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    first = F.col("k") == 1
    again = again.select("page_id", "url", "payload", "digest", F.when(first, "response").otherwise("revisit").alias("record_type"), F.when(~first, F.col("page_id")).alias("refers_page"))
    return single.unionByName(again).select(*columns)


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, compress: bool = True, bytes_per_file: int = 256 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for every row of ``pages`` into archives below ``folder``; return the manifest (archive, bytes, records).

    Each task writes its rows where they are, a new file after every ``bytes_per_file``. A null payload is an empty
    one; a row without an id is a record without one (``urn:page:-``), and of equal payloads it is the response only
    if none has an id. Extra columns aren't archived. A task that runs again writes files of its own; the manifest
    names those of the attempt that counted. An empty table gives no archive.
    """
    typed = dealt(pages).transform(lambda p: with_types(p, key, url, payload, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = store_of(folder)
        store.create_dir(place, recursive=True)
        context, made = TaskContext.get(), []
        stem, out, n = f"part-{context.partitionId():05d}-{context.taskAttemptId()}", None, 0
        for rows, texts in text_slices(batches, "payload"):
            ids, urls, digests, kinds, refers = (rows.column(c).to_pylist() for c in ("page_id", "url", "digest", "record_type", "refers_page"))
            for page, uri, text, digest, kind, other in zip(ids, urls, texts, digests, kinds, refers, strict=True):
                if out is None or made[-1]["bytes"] >= bytes_per_file:
                    if out is not None:
                        out.close()
                    made.append({"archive": f"{folder}/{stem}-{len(made):04d}.warc" + (".gz" if compress else ""), "bytes": 0, "records": 0})
                    out = store.open_output_stream(f"{place}/{made[-1]['archive'].rpartition('/')[2]}", compression=None)
                urn = f"urn:page:{'-' if page is None else page}/{digest}"
                urn, other = (urn, None) if kind == "response" else (f"{urn}/{stem}.{n}", f"urn:page:{'-' if other is None else other}/{digest}")
                n += 1
                whole = record_bytes(kind, urn, uri, text.encode() if isinstance(text, str) else text, other, date, compress)
                out.write(whole)
                made[-1]["bytes"] += len(whole)
                made[-1]["records"] += 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pylist(made, MANIFEST)

    return stash(typed.mapInArrow(task_of(run), "archive string, bytes long, records long"))


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, bytes) of the archives at ``path`` (a folder or a pattern); their content isn't read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.col("length").alias("bytes"))


def read_archives(listed: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in ``listed`` (archive), and a row with ``fault`` for each quarantined gap.

    archive, start and stop are the file and the bytes of the record, its member or the gap. ``payload_bytes`` and
    ``payload_digest`` (SHA-1 in hex) are those of the full payload, which a revisit only names. Each archive is read
    by a task; archives are about as many as the writers' tasks, and much larger ones of others are read by pieces.
    Without ``payloads`` they are checked and left out. A file that isn't an archive is one gap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                store, place = store_of(re.sub(r"^file:/+", "file:///", archive))
                out, held = [], 0
                with store.open_input_file(place) as file:
                    for row in salvage(Window(file, file.size())):
                        payload = row.get("payload") if payloads else None
                        out.append(row | {"archive": archive, "payload": payload})
                        held += len(payload or b"") + 500
                        if held > BATCH:
                            yield pa.RecordBatch.from_pylist(out, READ)
                            out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, READ)

    files = listed.select("archive")
    return files.repartitionByRange(max(1, files.count()), "archive").mapInArrow(task_of(run), READ_DDL)


def records(read: DataFrame) -> DataFrame:
    return read.filter("fault is null").drop("fault")


def gaps(read: DataFrame) -> DataFrame:
    """archive, start, stop and fault (the check that failed first) of the bytes that were quarantined."""
    return read.filter("fault is not null").select("archive", "start", "stop", "fault")


def op11_salvage_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    page = lambda urn: F.regexp_extract(urn, r"urn:page:(-?\d+)/", 1).try_cast("long")
    return records(read_archives(manifest, payloads=False)).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


ORACLE = """select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
  case when strlen(coalesce(html, '')) >= 1000 and page_id < max(page_id) over w then 'revisit' else 'response' end as record_type,
  case when strlen(coalesce(html, '')) >= 1000 and page_id < max(page_id) over w then max(page_id) over w end as refers_to
  from pages window w as (partition by coalesce(html, ''))"""
